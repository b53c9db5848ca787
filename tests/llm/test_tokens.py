"""Token counts, packing and Simple-8b files against the tokenizer libraries and exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cloakwork.llm import packing, simple8b, token_counts
from cloakwork.llm.bytebpe import Encoder, vocabulary_path

ODD = [
    None, "", " ", "  ", " a  b ", "x \n y\n\n  z", "don't 'll we've", "a<|endoftext|>b <s> </s> <unk> <0x0A>", "é²³½ x", "a　b\x85c\xa0d", "— “q” it's…",
    "日本 語 ▁ ▁▁x", "\x00\x01\x02 \x1c", "!!!! ,, a,b;c", "word " * 3000, "q" * 5000, "🙂 👍🏽", "a\tb \r\n c", "İ ẞ ǅ", "1234567890 12,345.67",
]


def frame(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, n int").repartition(3)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(vocabulary_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\tab'sT1é²,.!—ß<|>")) | st.characters(codec="utf-8"), max_size=30), max_size=6))
def test_encoder_agrees_with_the_library(texts):
    encoder = test_encoder_agrees_with_the_library.__dict__.setdefault("e", Encoder(vocabulary_path(), limit=20))
    assert encoder.encode(texts) == encoder.whole(texts)


def test_token_counts(spark):
    texts = [*ODD, *ODD[3:6]]
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts)}
    for head in (0, 3, 1000):
        got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, texts), head=head).collect()}
        assert {k: (r.n_bytes, r.n_tokens) for k, r in got.items()} == want
    assert [k for k, r in got.items() if r.over_limit] == [k for k, (_, n) in want.items() if n > 4096]
    assert token_counts.token_counts(frame(spark, texts).limit(0)).count() == 0


def test_packing(spark, bpe):
    texts = [*ODD, *("alpha beta " * k for k in range(1, 90)), *ODD[2:5]]
    ids = {i: [*bpe.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    for window in (64, 1024):
        rows = packing.pack(frame(spark, texts), window=window).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
        assert pieces.keys() == ids.keys()
        for k, own in ids.items():
            at = 0
            for r in sorted(pieces[k], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == crc(own[at : at + r.length])
                at += r.length
            assert at == len(own)
        short = 0
        for rows in sequences.values():
            at = 0
            for r in sorted(rows, key=lambda r: r.offset):
                assert r.offset == at and r.length > 0
                at += r.length
            assert at <= window
            short += at < window
        assert short <= 3
    assert packing.pack(frame(spark, texts).limit(0)).count() == 0


def test_packing_encodes_the_units_of_a_task_once(monkeypatch):
    texts = [" ".join(["a", *(f"w{i}" for i in range(k, k + 10_000))]) for k in range(0, 150_000, 10_000)]
    encoder, encoded = Encoder(vocabulary_path(), packing.UNITS), 0
    codes = encoder._codes

    def counted(units):
        nonlocal encoded
        encoded += len(units)
        return codes(units)

    monkeypatch.setattr(encoder, "_codes", counted)
    for text in texts * 2:
        encoder.encode([text])
    assert encoded == 150_000


def test_packer_takes_the_level_of_least_squares():
    rng = np.random.default_rng(1)
    packer = packing.Packer(16)
    levels: dict[int, int] = defaultdict(int)
    for size in rng.integers(1, 16, 500).tolist():
        def cost(h, size=size):
            after = dict(levels)
            if h:
                after[h] -= 1
            if h + size < 16:
                after[h + size] = after.get(h + size, 0) + 1
            return sum(n * n for n in after.values())

        best = min(cost(h) for h in [0, *(h for h in levels if levels[h] and h + size <= 16)])
        packer._place((0, 0, b"\0\0\0\0" * size, size))
        levels = defaultdict(int, {h: int(n) for h, n in enumerate(packer.count) if n})
        assert sum(n * n for n in levels.values()) == best
        assert packer.n_open == sum(levels.values()) == sum(map(len, packer.open))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60).flatmap(lambda b: st.integers(0, min(2**32 - 1, 2**b))), max_size=600), st.integers(1, 40))
def test_simple8b_round_trip(ids, repeat):
    ids = np.array(ids * repeat, "<u4")
    words, blocks = simple8b.encode_ids(ids)
    assert (simple8b.decode_ids(words) == ids).all() and len(blocks) == -(-len(ids) // simple8b.BLOCK) + 1
    shard = simple8b.Shard(simple8b.shard_bytes([1], [len(ids)], ids.tobytes(), 7))
    a, b = len(ids) // 3, len(ids) // 2
    assert (shard.read(a, b) == ids[a:b]).all() and (shard.read(0, len(ids)) == ids).all() and shard.before == 7


def test_simple8b_files(spark, bpe):
    texts = [*ODD, *("alpha beta " * k for k in range(1, 90))]
    ids = {i: [*bpe.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    got = {r.doc_id: r for r in simple8b.encode_round_trip(frame(spark, texts), shard_ids=500).collect()}
    before = 0
    for k, own in ids.items():
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (before, len(own), crc(own))
        before += len(own)
    assert simple8b.encode_round_trip(frame(spark, texts).limit(0)).count() == 0
    rows = spark.createDataFrame([(1, "a"), (None, "b c"), (1, "a"), (-5, None)], "doc_id long, text string")
    assert sorted(((r.doc_id is not None, r.doc_id), r.start, r.n_tokens) for r in simple8b.encode_round_trip(rows).collect()) == [((False, None), 0, 3), ((True, -5), 3, 1), ((True, 1), 4, 2), ((True, 1), 6, 2)]


def test_a_hot_long_pre_token_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "HOT", 4)
    monkeypatch.setattr(token_counts, "SALTS", 16)
    long = "x" * 70
    texts = [f"word{i % 5} {long} and {long if i % 3 else 'more'}" for i in range(900)] + ["", None]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, salt string").repartition(5)
    vocabulary = token_counts.materialise(token_counts.vocabulary_counts(docs, public_tokenizers.path("piece_bpe_32k.model")), "t")
    assert len(token_counts._hot(vocabulary, docs, token_counts.frequent(vocabulary))) == 1
    processor = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for head in (token_counts.HEAD, 0):
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, head=head).collect()}
        assert got == {i: len(processor.encode(t or "")) for i, t in enumerate(texts)}
