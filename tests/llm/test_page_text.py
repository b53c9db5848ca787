"""Main text of pages: templates, slots, odd markup."""

import random
import time

import numpy as np
import pytest

from cloakwork.llm import page_text as P


def page(rnd, article, extra=""):
    w = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(n))
    menu = "".join(f'<li><a href="/{w(1)}">{w(1)}</a></li>' for _ in range(rnd.randint(2, 6)))
    return (
        f'<!DOCTYPE html><html><head><title>{w(3)}</title><style>p{{}}</style><script>var t="<p>no</p>";</script></head><body><nav><ul>{menu}</ul></nav>'
        f'<!-- <p>no</p> --><div class="ad">{w(5)}</div><header>{w(2)}</header>{article}{extra}<aside>{w(4)}</aside><footer>&copy; {w(3)}</footer></body></html>'
    )


def test_articles():
    rnd = random.Random(1)
    bodies = [f"<article><h1>T{i} &amp; &lt;b&gt;</h1><p>One\n <b>bo</b>ld&nbsp;{i}<br>end.<p>Two{'<div class=comments>no</div>' if i % 2 else ''}</article>" for i in range(9)]
    got = P.extract([page(rnd, b, '<form>no <input value="x"></form><section id="comments">no</section>') for b in bodies])
    assert got == [f"T{i} & <b>\nOne bold {i} end.\nTwo" for i in range(9)]


def test_without_article_the_slots_with_most_words_count():
    rnd = random.Random(2)
    texts = [" ".join("".join(rnd.choices("klmnop", k=5)) for _ in range(40)) for _ in range(8)]
    pages = [page(rnd, f'<div class="wrap"><div class="cookie-notice">We use cookies here.</div><div id="content"><p>{t}</p><p>Always the same closing words.</p></div></div>') for t in texts]
    assert P.extract(pages) == texts


def test_the_template_decides_without_article(monkeypatch):
    rnd = random.Random(9)
    texts = [_words(rnd, 30) for _ in range(6)]
    pages = [page(rnd, f'<div id="content"><p>Tell your friends about this page!</p><p>{t}</p></div>') for t in texts]
    assert P.extract(pages) == texts
    monkeypatch.setattr(P, "template_tokens", lambda pages, n: np.zeros(n, bool))
    assert P.extract(pages) == [f"Tell your friends about this page!\n{t}" for t in texts]


def test_the_template_decides_inside_an_article(monkeypatch):
    rnd = random.Random(12)
    texts = [_words(rnd, 30) for _ in range(6)]
    pages = [page(rnd, f'<article><h1>t{i}</h1><div class="tools"><p>Print this page</p><span>Send it on</span></div><div class="body"><p>Told by our own staff</p><p>{t}</p></div></article>') for i, t in enumerate(texts)]
    want = [f"t{i}\nTold by our own staff\n{t}" for i, t in enumerate(texts)]
    assert P.extract(pages) == want
    assert P.extract(pages + pages[:3]) == want + want[:3]
    monkeypatch.setattr(P, "template_tokens", lambda pages, n: np.zeros(n, bool))
    assert P.extract(pages) == [f"t{i}\nPrint this page\nSend it on\n{w[3:]}" for i, w in enumerate(want)]


def test_copies_keep_their_text():
    rnd = random.Random(13)
    for body in (f"<article><h1>h</h1><div class=body><p>{_words(rnd, 40)}</p></div></article>", f"<div id=content><p>{_words(rnd, 40)}</p></div>"):
        one = page(rnd, body)
        assert P.extract([one] * 5) == P.extract([one]) * 5 and len(P.extract([one])[0].split()) >= 40
    # Near copies: what they share is not taken for a frame.
    shared = _words(rnd, 40)
    got = P.extract([page(rnd, f"<article><h1>head {i}</h1><div class=body><p>{shared}</p></div></article>") for i in range(8)])
    assert got == [f"head {i}\n{shared}" for i in range(8)]


def test_marked_words_at_the_head_of_a_paragraph():
    html = '<article><p><span class="share">Shares</span> rose by a third.</p><span class="ad">Buy</span><p class="notice">We use cookies.</p><p>End.</p></article>'
    assert P.extract([html]) == ["Shares rose by a third.\nEnd."]


def test_pages_without_host_stand_alone(spark):
    rnd = random.Random(11)
    rows = [(i, (None, "", "no url")[i % 3], f"<p>{_words(rnd, 5 + 9 * i)}</p><div><p>same {_words(random.Random(1), 4)}</p></div>") for i in range(12)]
    got = {r.page_id: r.text for r in P.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)).collect()}
    assert got == {i: P.extract([h])[0] for i, _, h in rows} and all(got.values())


def _words(rnd, n):
    return " ".join("".join(rnd.choices("klmnop", k=5)) for _ in range(n))


def test_ids_of_each_page_without_article():
    rnd = random.Random(5)
    parts = [[_words(rnd, n) for n in (4, 30, 3, 5, 12, 8)] for _ in range(9)]
    pages = [
        page(rnd, f'<div class="wrap"><div id="post-{i}x{i * 7}" class="post entry-{i}"><h1>{h}</h1><div class="body"><p>{p}</p><ul><li>{a}</li></ul><table><tr><th>{b}</th><td>{c}</td></tr></table><pre>{d}</pre></div></div><div class="col2">{_words(rnd, 3)}</div></div>')
        for i, (h, p, a, b, c, d) in enumerate(parts)
    ]
    assert P.extract(pages) == ["\n".join(x) for x in parts]


def test_mixed_layouts_without_article():
    rnd = random.Random(6)
    texts = [_words(rnd, 60 if i % 3 else 12) for i in range(12)]
    pages = [page(rnd, f'<div id="content"><p>{t}</p></div><div class="other">{_words(rnd, 2)}</div>' if i % 3 else f'<div class="story"><section><h2>a{i}</h2><p>{t}</p></section><section><p>b{i}</p></section></div>') for i, t in enumerate(texts)]
    assert P.extract(pages) == [t if i % 3 else f"a{i}\n{t}\nb{i}" for i, t in enumerate(texts)]


def test_long_pre_is_part_of_its_text():
    rnd = random.Random(7)
    pairs = [(_words(rnd, 10), _words(rnd, 90)) for _ in range(6)]
    assert P.extract([page(rnd, f'<div id="content"><h2>{h}</h2><pre>{t}</pre></div>') for h, t in pairs]) == [f"{h}\n{t}" for h, t in pairs]


def test_odd_markup():
    odd = [None, "", "plain text", "<p>a < b &am &amp", "<article><p>cut <b>off", "<article>x<script>never ends", "<div", "</p></div>", "<ul><li>one<li>two</ul>", "<p title='>'>q</p>", "a" * 5000]
    alone = [P.extract([h])[0] for h in odd]
    assert alone == ["", "", "plain text", "a < b &am &", "cut off", "x", "", "", "one\ntwo", "q", "a" * 5000]


def test_template_is_of_equal_vectors_in_one_order():
    rnd = random.Random(3)
    numbers, paths = {}, P.Paths()
    pages = [P.Page(page(rnd, f"<article><p>{i} words</p></article>"), numbers, paths) for i in range(6)]
    template = P.template_tokens(pages, len(numbers))
    name = {v: k for k, v in numbers.items()}
    kept = {name[i][0] for i in np.flatnonzero(template)}
    assert {"<article>", "<nav>", "<footer>", "&copy;", "<li>", "</li>"} <= kept and not {"0", "5"} & kept


def test_rows_and_large_hosts(spark):
    rnd = random.Random(4)
    rows = [(i, f"https://big.example.com/{i}", page(rnd, f"<article><p>text {i}</p></article>")) for i in range(40)]
    rows += [(50, None, page(rnd, "<article>no host</article>")), (51, "https://u@Small.example.com:8/x", None), (51, "https://u@Small.example.com:8/x", None), (None, "x", "<main>m</main>")]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, n_chars int").repartition(3)
    for size in (8, 128):
        got = P.main_text(df, group_pages=size).collect()
        want = [(i, f"text {i}") for i in range(40)] + [(50, "no host"), (51, ""), (51, ""), (None, "m")]
        assert sorted(((r.page_id or 0, r.text) for r in got)) == sorted((i or 0, t) for i, t in want)
        assert all(r.n_chars == len(r.text) for r in got)
    assert P.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("html", ["<font>" * 50_000 + "<p>The end.</p>", "<div>" * 20_000 + "The end.", "".join(f"<div class='c{i}'>" for i in range(3_000)) + "The end.", "<p><div>" + "<font>" * 20_000 + "<h1></h1>" * 20_000 + "The end.", "</font>" * 50_000 + "The end.", "<li>" * 50_000 + "The end."])
def test_deep_nesting_takes_linear_time(html):
    start = time.process_time()
    assert P.extract([html]) == ["The end."]
    assert time.process_time() - start < 4


def test_elements_below_the_depth_count_as_siblings():
    inside = "<span>" * (P.DEPTH + 100) + "one <b>two</b> three" + "</span>" * (P.DEPTH + 100)
    html = f"<body><nav>menu</nav><article><p>{inside}</p><p>four</p></article><footer>end</footer></body>"
    assert P.extract([html]) == ["one two three\nfour"]
