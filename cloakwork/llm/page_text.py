"""Main text of web pages by deduced templates.

Pages of one host, in groups of about ``GROUP_PAGES``, are compared as token sequences; a token is a
tag or word together with the elements it stands in. Tokens that occur equally often on each page
of the group form a class; a class is valid if its tokens keep one order on every page, and the
valid classes that nest in each other, the largest first, are the group's template. What lies
between template tokens are slots. The main text is the text of the slots inside the article: the
container that says so (article, main, or their roles), else the one found for the page's layout: of
the pages that have slots in the container of most words, the lowest element that holds all slots but
what stands in lighter containers beside it; then the same for the pages left. Ids and classes of one
page only don't tell containers apart. Menus, footers, forms, comments and the like are known by element names and by words of
class, id and role. In a page without article or main, template text is dropped. Inside an article or main, a container
is dropped if it holds template text only, on every page of the group (share bars, notices), while template text
beside slots is kept; nothing goes this way where it would be as many words as the slots of the page, as among near copies.

Null and empty html give an empty text, an empty table no rows. A page without a host stands alone, and a page
alone in its group has a template of its own structure. Repeated rows are pages each, which count once for the template and get the
same text; ties between containers go to the first. Pages of any length count whole; columns besides page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_PAGES = 128
#: Up to so many hosts of more than a group's pages are broadcast; beyond it they are joined by shuffle.
BROADCAST_HOSTS = 50_000
#: A class holds at least so many tokens.
CLASS_SIZE = 3
#: Without article or main: a container goes on to the one inside it that holds at least this share of its words,
#: unless at least ``BESIDE`` of its words, or slots of half of the pages, stand in it directly.
INSIDE, BESIDE = 0.75, 0.1
#: A page belongs to a layout if the layout's heaviest container holds this share of its words.
LAYOUT = 0.1

#: Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select button canvas video audio".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Parts of the text they stand in, never containers of a main text.
PARTS = frozenset("address blockquote caption dd details dialog dir dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr legend li menu ol p pre summary ul".split())
_CELLS = frozenset("table tbody thead tfoot tr td th".split())
_DIGITS = re.compile(r"\d+")
OUTSIDE = frozenset("nav footer aside form head menu dialog".split())
#: What an opening tag closes: an open element of these names, up to the nearest list, table or container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = frozenset("ul ol dl table article section main body div nav aside footer header form".split())
_MAIN = re.compile(r"^(?:article|main)$|\brole=(?:main|article)\b")
_HINT = re.compile(
    r"(?:^|[\s=_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|masthead|menu|modal|nav\w*|newsletter|notice|pagination|popup|"
    r"promo\w*|recommended|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])"
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))|<|[^<]+",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


#: Elements below this depth count as children of the last one above it, as browsers have it.
DEPTH = 512


class Paths:
    """Paths of elements by number. A path is known by its parent's number and its last element."""

    def __init__(self):
        self.tuples: list[tuple[str, ...]] = [()]
        self._below: dict[tuple[int, str], int] = {}

    def below(self, parent: int, element: str) -> int:
        number = self._below.setdefault((parent, element), len(self.tuples))
        if number == len(self.tuples):
            self.tuples.append((*self.tuples[parent], element))
        return number


class Stack:
    """Open elements: each one's name and path, and where the elements of a name stand."""

    def __init__(self, paths: Paths):
        self.paths = paths
        self.names: list[str] = []
        self.numbers: list[int] = []
        self.bare: list[bool] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        #: Open elements without class, id and role, by name.
        self.plain: Counter = Counter()

    @property
    def path(self) -> int:
        return self.numbers[-1] if self.numbers else 0

    def push(self, name: str, hints: str) -> None:
        depth = len(self.names)
        parent = self.path if depth < DEPTH else self.numbers[DEPTH - 2]
        self.at[name].append(depth)
        self.names.append(name)
        self.bare.append(not hints)
        self.plain[name] += not hints
        self.numbers.append(self.paths.below(parent, f"{name} {hints}" if hints else name))

    def pop(self) -> str:
        name = self.names.pop()
        self.at[name].pop()
        self.plain[name] -= self.bare.pop()
        self.numbers.pop()
        return name

    def nearest(self, names: Iterable[str]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def close(self, names: set[str]) -> None:
        """Close the nearest open element of these names with all inside it, unless a container stands between."""
        i = self.nearest(names)
        if i >= 0 and i >= self.nearest(_STOPS):
            while len(self.names) > i:
                self.pop()


class Page:
    """A page's tokens as numbers, and its blocks: (path, raw text, first token, last token)."""

    def __init__(self, html: str, numbers: dict, paths: Paths):
        self.tokens: list[int] = []
        self.blocks: list[tuple[int, str, int, int]] = []
        stack = Stack(paths)
        text: list[str] = []
        first = 0
        own = 0

        def close_block() -> None:
            nonlocal text, first
            if text:
                self.blocks.append((own, "".join(text), first, len(self.tokens)))
            text = []
            first = len(self.tokens)

        position, end = 0, len(html)
        while position < end:
            match = _TOKEN.match(html, position)
            position = match.end()
            name = match["name"]
            if name is None:
                piece = match[0]
                if piece[0] != "<" or piece == "<":
                    if not text:
                        own, first = stack.path, len(self.tokens)
                    text.append(piece)
                    for word in piece.split():
                        self.tokens.append(numbers.setdefault((word, stack.path), len(numbers)))
                continue
            name = name.lower()
            if match["end"]:
                if stack.at.get(name):
                    if name in BLOCKS:
                        close_block()
                    while stack.pop() != name:
                        pass
                    self.tokens.append(numbers.setdefault((f"</{name}>", stack.path), len(numbers)))
                continue
            if name in BLOCKS:
                close_block()
                if stack.plain["p"] and name != "p" or name == "p" and stack.at.get("p"):
                    stack.close({"p"})
            elif name == "br" and text:
                text.append(" ")
            if name in CLOSES:
                stack.close(CLOSES[name])
            if name not in VOID:
                hints = " ".join(f"{k.lower()}={(a or b or c).lower()}" for k, a, b, c in _ATTRIBUTE.findall(match["more"]))
                stack.push(name, hints)
            self.tokens.append(numbers.setdefault((f"<{name}>", stack.path), len(numbers)))
            if name in RAW and not match["more"].endswith("/>"):
                found = _ENDS[name].search(html, position)
                position = found.end() if found else end
                stack.pop()
        close_block()


def template_tokens(pages: list[Page], n_tokens: int) -> np.ndarray:
    """Which token numbers belong to the template: the valid, nested classes of equal occurrence vectors."""
    template = np.zeros(n_tokens, bool)
    n = len(pages)
    arrays = [np.array(p.tokens, np.int64) for p in pages]
    seen = np.zeros(n_tokens, np.int64)
    for a in arrays:
        seen[np.unique(a)] += 1
    # Tokens of most pages only: what a few pages share is content.
    common = np.flatnonzero(seen >= max(2, -(-3 * n // 4)) if n > 1 else seen > 0)
    if not len(common):
        return template
    number = np.full(n_tokens, -1)
    number[common] = np.arange(len(common))
    vectors = np.zeros((len(common), n), np.int32)
    for i, a in enumerate(arrays):
        own = number[a]
        vectors[:, i] = np.bincount(own[own >= 0], minlength=len(common))
    classes: dict[bytes, list[int]] = defaultdict(list)
    for k, row in enumerate(vectors):
        classes[row.tobytes()].append(k)
    kept: list[np.ndarray] = []
    places = [np.flatnonzero(number[a] >= 0) for a in arrays]
    shown = [number[a[at]] for a, at in zip(arrays, places, strict=True)]
    for members in sorted((m for m in classes.values() if len(m) >= CLASS_SIZE), key=lambda m: (-len(m), m[0])):
        chosen = np.zeros(len(common), bool)
        chosen[members] = True
        if _ordered(shown, chosen, len(members)) and _nested(shown, chosen, kept, len(members)):
            kept.append(chosen)
            template[common[members]] = True
    return template


def _ordered(shown: list[np.ndarray], chosen: np.ndarray, size: int) -> bool:
    """One order on every page: each page repeats the same permutation of the class."""
    order = None
    for own in shown:
        own = own[chosen[own]]
        if len(own):
            order = own[:size] if order is None else order
            if len(own) % size or (own.reshape(-1, size) != order).any():
                return False
    return True


def _nested(shown: list[np.ndarray], chosen: np.ndarray, kept: list[np.ndarray], size: int) -> bool:
    """Each run of the class lies in one gap of every class kept before."""
    for other in kept:
        for own in shown:
            gap = np.cumsum(other[own])[chosen[own]]
            if len(gap) and (gap.reshape(-1, size).min(axis=1) != gap.reshape(-1, size).max(axis=1)).any():
                return False
    return True


@lru_cache(maxsize=65_536)
def _marks(element: str) -> tuple[str, bool, bool]:
    """An element's name, whether it is the main text's, and whether its class, id or role marks it as beside the text."""
    name, _, hints = element.partition(" ")
    return name, bool(_MAIN.search(name) or _MAIN.search(element)), bool(hints and _HINT.search(hints))


def _judge(path: tuple[str, ...]) -> tuple[bool, int]:
    """Whether a path leads out of the main text, and how many of its elements reach down to the innermost article."""
    marks = [_marks(element) for element in path]
    main = max((i + 1 for i, (_, of_main, _) in enumerate(marks) if of_main), default=0)
    part = len(path)
    for i, (name, _, marked) in enumerate(marks):
        if name not in BLOCKS and i > part:
            # Marked words at the head of a paragraph say nothing about the paragraph.
            continue
        if name in PARTS:
            part = min(part, i)
        # A header belongs to the page unless it stands inside the article; html and body are never left.
        if name in OUTSIDE or name == "header" and i >= 0 and not main or name not in ("html", "body") and i + 1 != main and marked:
            return True, main
    return False, main


def _generic(pages: list[Page], numbers: dict, paths: Paths) -> list[tuple[str, ...]]:
    """Each path without the classes, ids and roles of one page only; digits of words on few pages count as one.

    Tokens that differ by these alone become equal.
    """
    every = paths.tuples
    if len(pages) < 2 or not any(" " in x for path in every for x in path):
        return every
    number_path = np.fromiter((at for _, at in numbers), np.int64, len(numbers))
    on: Counter = Counter()
    for page in pages:
        used = np.unique(number_path[np.array(page.tokens, np.int64)]).tolist()
        on.update({word for element in {x for at in used for x in every[at]} for word in element.split(" ")[1:]})
    few = len(pages) / 4

    def shown(element: str) -> str:
        name, *words = element.split(" ")
        kept = [_DIGITS.sub("#", w) if on[w] < few else w for w in words if on[w] > 1]
        return " ".join([name, *kept])

    elements = {x: shown(x) for path in every for x in path}
    generic = [tuple(elements[x] for x in path) for path in every]
    if generic != every:
        known: dict = {}
        place = [known.setdefault(path, i) for i, path in enumerate(generic)]
        # As numbers of tokens: those of the first path that looks the same.
        same: dict = {}
        to = np.array([same.setdefault((word, place[at]), k) for (word, at), k in numbers.items()], np.int64)
        for page in pages:
            page.tokens = to[np.array(page.tokens, np.int64)].tolist()
    return generic


def _region(path: tuple[str, ...]) -> tuple[str, ...]:
    """The innermost container of a path; a table's cells are containers if they hold blocks, else the table is part of the text."""
    names = [x.split(" ", 1)[0] for x in path]
    depth = next((i for i, x in enumerate(names) if x in PARTS), len(names))
    while depth and (names[depth - 1] not in BLOCKS or names[depth - 1] in _CELLS and not any(x in BLOCKS for x in names[depth:])):
        depth -= 1
    return path[:depth]


def _containers(slots: list[Counter]) -> list[tuple[str, ...]]:
    """The container of the main text of each page, by the words of its slots in each region."""
    found: list[tuple[str, ...]] = [()] * len(slots)
    left = [i for i, own in enumerate(slots) if own]
    while left:
        weight: Counter = Counter()
        for i in left:
            weight.update(slots[i])
        seed = max(weight, key=weight.get)
        holding = [i for i in left if seed in slots[i]]
        layout = [i for i in holding if slots[i][seed] >= LAYOUT * slots[i].total()] or holding
        words: Counter = Counter()
        for i in layout:
            words.update(slots[i])
        node: tuple[str, ...] = ()
        while True:
            depth = len(node)
            inside: Counter = Counter()
            for region, n in words.items():
                if region[:depth] == node and len(region) > depth:
                    inside[region[: depth + 1]] += n
            total = words[node] + inside.total()
            direct = sum(node in slots[i] for i in layout)
            if not inside or 2 * direct >= len(layout) or words[node] >= BESIDE * total:
                break
            best = max(inside, key=inside.get)
            if inside[best] < INSIDE * total:
                break
            node = best
        for i in layout:
            # A page of the layout that has nothing there keeps what it has.
            found[i] = node if any(region[: len(node)] == node for region in slots[i]) else ()
        done = set(layout)
        left = [i for i in left if i not in done]
    return found


def _in_article(kept: list[list[tuple]], generic: list[tuple[str, ...]]) -> list[list[str]]:
    """The raw texts inside article or main of each page: its slots, and template text that stands beside slots."""
    regions = {at: _region(generic[at]) for own in kept for at, main, *_ in own if main}
    live = set()
    for own in kept:
        for at, main, is_slot, *_ in own:
            if main and is_slot:
                region = regions[at]
                live.update(region[:depth] for depth in range(main + 1, len(region) + 1))
    chosen = []
    for own in kept:
        inside = [(at, is_slot or len(regions[at]) <= main or regions[at] in live, is_slot, raw, n) for at, main, is_slot, raw, n in own if main]
        fixed = sum(n for _, stays, _, _, n in inside if not stays)
        slots = sum(n for _, _, is_slot, _, n in inside if is_slot)
        chosen.append([raw for _, stays, _, raw, _ in inside if stays or fixed >= slots])
    return chosen


def extract(htmls: list[str | None]) -> list[str]:
    """The main texts of pages that share a template."""
    distinct = list(dict.fromkeys(h or "" for h in htmls))
    texts = dict(zip(distinct, _extract(distinct), strict=True))
    return [texts[h or ""] for h in htmls]


def _extract(htmls: list[str]) -> list[str]:
    numbers: dict = {}
    paths = Paths()
    pages = [Page(h, numbers, paths) for h in htmls]
    generic = _generic(pages, numbers, paths)
    template = template_tokens(pages, len(numbers))
    judged = [_judge(path) for path in paths.tuples]
    kept = []
    for page in pages:
        own = []
        tokens = np.array(page.tokens, np.int64)
        for at, raw, a, b in page.blocks:
            out, main = judged[at]
            if out or b <= a:
                continue
            # A block all of whose words are template words is no slot.
            own.append((at, main, len(pages) == 1 or not template[tokens[a:b]].all(), raw, b - a))
        kept.append(own)
    slots = [[] if any(main for _, main, *_ in own) else [(at, raw, n) for at, _, is_slot, raw, n in own if is_slot] for own in kept]
    # What stands on several pages (lists of other pages, say) doesn't tell where the main text is, if a page has anything else.
    often = Counter(raw for own in slots for raw in {raw for _, raw, _ in own})
    regions = {at: _region(generic[at]) for own in slots for at, _, _ in own}
    weights = []
    for own in slots:
        words: Counter = Counter()
        for at, _, n in [x for x in own if often[x[1]] == 1] or own:
            words[regions[at]] += n
        weights.append(words)
    texts = []
    for own, inside, best in zip(kept, _in_article(kept, generic), _containers(weights), strict=True):
        raws = inside
        if not any(main for _, main, *_ in own):
            raws = [raw for at, _, is_slot, raw, _ in own if is_slot and generic[at][: len(best)] == best]
        texts.append("\n".join(x for raw in raws if (x := " ".join(unescape(raw).split()))))
    return texts


def main_text(pages: DataFrame, group_pages: int = GROUP_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    read = pages.select("page_id", "url", "html", host.alias("host"))
    # Large hosts are dealt into groups of about group_pages pages; small ones stay whole.
    large = read.groupBy("host").count().where(F.col("count") > group_pages).select("host", F.ceil(F.col("count") / group_pages).alias("groups"))
    if large.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        large = F.broadcast(large)
    dealt = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("groups", F.lit(1)))
    grouped = read.join(large, "host", "left").withColumn("deal", F.when(F.col("host") == "", F.monotonically_increasing_id()).otherwise(dealt))

    def run(table: pa.Table) -> pa.Table:
        texts = extract(table["html"].to_pylist())
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return grouped.select("host", "deal", "page_id", "url", "html").groupBy("host", "deal").applyInArrow(run, "page_id long, url string, text string, n_chars long")
