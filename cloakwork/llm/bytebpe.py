"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library, with a cache of space-delimited units."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts with other characters, or with a blank after white space, go to the library whole.
_ODD = re.compile("[\x00\x01\x0b\x0c\x1c-\x1f\x7f-\xa0²³¹¼½¾]|[^\x00-ɏ‐-‧‰-‾€]")
_ODD_ASCII = "\x0b\x0c\x1c\x1d\x1e\x1f\x7f"
_BLANKS = ("  ", "\n ", "\t ", "\r ")
#: White space that a unit may end with, at the end of its text.
_ENDS = ("\n", "\t", "\r")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


#: Units in a generation of the cache.
LIMIT = 500_000
#: Short units that stay in the cache between tasks.
KEPT = 60_000
#: Units that are encoded as one text, and such texts that go to the library at once.
JOINED, TEXTS = 128, 32


class _Cache(dict):
    """Ids by unit, in two generations. A unit that neither has gets an empty array, which ``fill`` fills."""

    def __init__(self, older: dict[str, bytes]):
        self.older = dict(older)
        self.new: dict[str, bytearray] = {}

    def __missing__(self, unit: str) -> bytes | bytearray:
        code = self.older.get(unit)
        if code is None:
            code = self.new[unit] = bytearray()
        self[unit] = code
        return code

    def fill(self, units: list[str], codes: Iterable[bytes]) -> None:
        for unit, code in zip(units, codes, strict=True):
            self.new.pop(unit).extend(code)
            self[unit] = code


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    The pre-tokenisation pattern of byte-level BPE lets a blank stand only at the start of a
    pre-token or inside a run of white space. Where every blank follows a character that is not
    white space, the text can therefore be cut before each blank without changing an id. The
    library encodes each distinct unit that the cache does not hold. The cache has two generations of
    ``limit`` units; a unit of the older one that is met again moves to the newer.
    """

    def __init__(self, path: str, limit: int = LIMIT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: By id, whether a token begins with a blank.
        self.blank = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.blank[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.limit = limit
        self.cache = _Cache({})

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, text: str) -> bool:
        if any(b in text for b in _BLANKS) or any(s in text for s in self.special):
            return False
        return not any(c in text for c in _ODD_ASCII) if text.isascii() else not _ODD.search(text)

    def _codes(self, units: list[str]) -> Iterator[bytes]:
        """Ids of units, many encoded as one text: only a unit's first token begins with its blank."""
        for at in range(0, len(units), JOINED * TEXTS):
            part = units[at : at + JOINED * TEXTS]
            ids = array("I")
            for e in self.tokenizer.encode_batch_fast([" " + " ".join(part[i : i + JOINED]) for i in range(0, len(part), JOINED)], add_special_tokens=False):
                ids.extend(e.ids)
            data, cuts = ids.tobytes(), (np.flatnonzero(self.blank[np.frombuffer(ids, np.uint32)]) * 4).tolist()
            yield from map(data.__getitem__, map(slice, cuts, [*cuts[1:], len(data)]))

    def shrink(self) -> None:
        """Keep some short units only, which come up again most; for the end of a task, as workers outlive it."""
        self.cache = _Cache(dict(islice(((u, c) for u, c in self.cache.items() if len(u) <= 8), KEPT)))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain: list[tuple[int, str, list]] = []
        rest: list[int] = []
        if len(self.cache) > self.limit:
            self.cache = _Cache(self.cache)
        found = self.cache.__getitem__
        for i, text in enumerate(texts):
            if self.plain(text):
                head, *parts = text.split(" ")
                plain.append((i, head, list(map(found, parts))))
            else:
                rest.append(i)
        for i, ids in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = ids
        alone = [u for u in self.cache.new if not u or u.endswith(_ENDS)]
        joined = [u for u in self.cache.new if u and not u.endswith(_ENDS)]
        self.cache.fill(alone, self.whole([" " + u for u in alone]))
        self.cache.fill(joined, self._codes(joined))
        for (i, _, codes), head in zip(plain, self.whole([head for _, head, _ in plain]), strict=True):
            out[i] = head + b"".join(codes)
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, limit: int = LIMIT) -> Encoder:
    """One encoder for each Python worker, file and bound of the cache."""
    if (path, limit) not in _encoders:
        _encoders[path, limit] = Encoder(path, limit)
    return _encoders[path, limit]
