"""Personal data in whole texts: exact patterns, and spans that a linear-chain conditional random field adds.

The field labels the words of a line (B- and I- of each kind, O) from features of the shapes of a word and
its two neighbours and from words that stand beside personal data. It is trained here by gradient steps
on the likelihood of a small labelled table (``examples``: sentences made from templates by a fixed rule,
``EXAMPLES`` of them at most) and decoded by Viterbi in numpy, many lines at once. Words of the same shape
are one class, so a text is a list of class numbers and scores are looked up. A line whose words all score
so low that no path can beat the one of O throughout isn't decoded; that is exact.

Spans of the field that touch a span of a pattern give way to it, and each must pass a check of its kind:
numbers of cards pass Luhn, phone numbers have 9 to 15 digits, secrets 16 letters and digits or more in one
run, IPs and addresses have their form.

Null and empty texts have no spans; texts of any length count whole; rows without doc_id and repeated rows stay, one
row each; an empty table gives no rows; other columns are ignored, whatever their names. Ties between paths go to O.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map, chunks

#: Kinds of the patterns, in the order of the results, and the one that only the field knows.
BASE, SECRET = ("email", "ip", "card", "phone"), "secret"
KINDS = (*BASE, SECRET)
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Labelled sentences at most; steps of the training.
EXAMPLES, STEPS = 900, 120
#: Classes and words of shapes that a task remembers before it begins anew.
_CLASSES, _WORDS = 100_000, 800_000

Span = tuple[str, int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9][0-9. -]*")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _card(value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _ip(value: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in value.split("."))


def _phone(value: str) -> bool:
    return 9 <= sum(c in "0123456789" for c in value) <= 15


def patterns(text: str) -> list[Span]:
    """Spans of the four patterns: leftmost, not overlapping within a kind, those that fail their check dropped."""
    out: list[Span] = []
    last, end, at = 0, 0, text.find("@")
    while at >= 0:
        low = max(last, end)
        start = low + len(text[low:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
        last = at + 1
        at = text.find("@", max(last, end))
    zones = [m.span() for m in _NUMBERS.finditer(text)]
    out += [("ip", *m.span()) for a, b in zones for m in _IP.finditer(text, a, b) if _ip(m[0])]
    out += [("card", *m.span()) for a, b in zones for m in _CARD.finditer(text, a, b) if _card(m[0])]
    at = text.find("+")
    while at >= 0:
        found = _PHONE.match(text, at)
        if found and _phone(found[0]):
            out.append(("phone", *found.span()))
        at = text.find("+", found.end() if found else at + 1)
    return out


# Shapes of words.

_MARKS = "\"'`“”„«»<>[]{}()|,;:.!?*#%&$="
_RUN = re.compile(r"(.)\1+")
_ALNUM = re.compile(r"[A-Za-z0-9]+")


def _bucket(n: int, bounds: tuple[int, ...]) -> int:
    return sum(n >= b for b in bounds)


def shape(word: str, lexicon: frozenset[str]) -> tuple:
    """What the features of a word are made of; words of one shape are one class."""
    if word.isalpha():
        core, lead, tail = word, "", ""
    else:
        core = word.strip(_MARKS)
        lead, tail = word[: word.find(core[0])][-1:] if core else word[:1], "" if not core or word.endswith(core) else word[-1]
    if core.isalpha():
        low = core.lower()
        return ("a" if core == low else "A" if core.isupper() else "Aa" if core[1:] == low[1:] else "aA", _bucket(len(core), (2, 4, 13)), lead, tail, low if low in lexicon else "")
    mapped = "".join("0" if c in "0123456789" else "A" if c.isupper() else "a" if c.isalpha() else c for c in core)
    runs = [m[0] for m in _ALNUM.finditer(core)]
    longest = max(runs, key=len, default="")
    mixed = any(c.isdigit() for c in longest) and any(c.isalpha() for c in longest)
    at_least = _bucket(len(longest), (8, 16, 24, 32))
    pressed = "mix" if mixed and at_least else _RUN.sub(r"\1", mapped)[:12]
    head = core.split("=")[0].split(":")[0].lower()
    return (pressed, min(mapped.count("0"), 20), lead, tail, head if head in lexicon else "", at_least, mixed)


def features(s: tuple) -> list[str]:
    out = [f"shape {s[0]}", f"size {s[1]}", f"shape {s[0]} size {s[1]}", f"lead {s[2]}", f"tail {s[3]}", f"word {s[4]}", f"shape {s[0]} lead {s[2]} tail {s[3]}"]
    return out if len(s) == 5 else [*out, f"number {s[1]}", f"longest {s[5]} {s[6]}"]


# The labelled table.

#: Words and sentences beside personal data in four languages, and beside numbers that are none. Slots in braces.
TEMPLATES = (
    "call me at {phone} tomorrow", "phone {phone}", "tel: {phone}", "tel. {phone} or write", "my number is {phone} .", "mobile {phone} , office {phone}", "fax {phone}", "contact {phone} today",
    "appelez le {phone} avant midi", "téléphone : {phone}", "mein Telefon ist {phone}", "rufen Sie {phone} an", "llame al {phone} hoy", "teléfono {phone}", "{w} {w} {phone} {w} {w}", "{w} {phone} {w} {w} , {w}",
    "write to {email} soon", "email {email}", "e-mail: {email}", "schreiben an {email}", "écrivez à {email}", "correo {email}", "{w} {w} {email} {w}", "contact {email} or {phone}",
    "card {card}", "my card number is {card}", "paid with {card} yesterday", "Karte {card} gesperrt", "carte {card} expire", "tarjeta {card}", "{w} {w} {card} {w} {w}", "{w} {card} {card} {w}",
    "server {ip} is down", "from ip {ip}", "adresse ip {ip}", "host {ip} {w}", "{w} {w} {ip} {w} {w}",
    'token = "{secret}"', 'token = "{secret}" {w} {w}', "{w} {w} token = \"{secret}\" {w}", "api_key: {secret}", "secret={secret}", "password {secret}", "key = '{secret}'", "access token {secret} {w}", "apikey \"{secret}\"",
    "order {number} was sent on {date}", "invoice {number} of {date}", "version {version} of {w}", "price {price} EUR", "page {small} of {small}", "isbn {isbn}", "{w} {number} {w}", "{w} {w} {small} {w}", "{w} {date} {w} {w}",
    "population {thousands} in {year}", "room {small} , floor {small}", "between {year} and {year}", "{small} {small} {small} {small} {w}", "see table {version} and page {small}", "ratio {price} to {price}", "commit {short} {w}", "artikel {number}",
    "{w} {w} {w} {w} {w} {w}", "{W} {w} {w} , {w} {w} .", "{W} {w} {w} {w} ; {w} ( {w} ) .", "{w} | {w} | {w}", "the {w} of {w} is {w} .", "der {w} und die {w}", "la {w} de {w}", "le {w} est {w}", "token of {w}", "the key {w} is {w}", "call the {w}", "a card for {w}",
)


def _value(slot: str, rng: np.random.Generator) -> str:
    """A made value of a slot."""

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def pick(*options):
        return options[rng.integers(len(options))]

    def word(low: int = 2, high: int = 9) -> str:
        return "".join(pick(*"aeiou") if i % 2 else pick(*"bcdfghlmnprstvéñüç") for i in range(rng.integers(low, high)))

    if slot == "w":
        return word() + pick("", "", "", ",", ".", "***", "%%%")
    if slot == "W":
        return word().capitalize()
    if slot == "phone":
        form = pick("+1 (ddd) ddd-dddd", "(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "0d dd dd dd dd", "0d.dd.dd.dd.dd", "+dd ddd ddddddd", "00dd ddd dddd ddd", "0ddd/ddddddd", "ddd ddd ddd")
        return re.sub("d", lambda _: digits(1), form)
    if slot == "email":
        name, host = word(3, 8), word(3, 8)
        return pick(f"{name}.{digits(2)}@{host}.example.com", f"{name}@{host}.org", f"{name} (at) {host} (dot) com", f"{name}[at]{host}.com", f"{name} [at] {host} [dot] org", f"<{name}@{host}.net>")
    if slot == "card":
        body = digits(15)
        body += next(d for d in "0123456789" if luhn(body + d))
        return pick(body, body, " ".join(body[i : i + 4] for i in range(0, 16, 4)), ".".join(body[i : i + 4] for i in range(0, 16, 4)), "-".join(body[i : i + 4] for i in range(0, 16, 4)))
    if slot == "ip":
        parts = [str(x) for x in rng.integers(1, 255, 4)]
        return pick(".".join(parts), ".".join(parts), ":".join(f"{x:x}" for x in rng.integers(4096, 65535, 8)))
    if slot == "secret":
        alphabet = pick("0123456789abcdef", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return pick("", "", "sk_", "ghp_") + "".join(pick(*alphabet) for _ in range(rng.integers(24, 48)))
    if slot == "number":
        return pick(digits(4), digits(6), digits(8), f"A{digits(5)}", f"{digits(3)}-{digits(2)}")
    if slot == "date":
        return pick(f"20{digits(2)}-0{rng.integers(1, 10)}-1{digits(1)}", f"1{digits(1)}.0{rng.integers(1, 10)}.20{digits(2)}", f"1{digits(1)}/0{rng.integers(1, 10)}/{digits(2)}", f"1{digits(1)}:{rng.integers(10, 60)}")
    if slot == "version":
        return f"{rng.integers(1, 10)}.{rng.integers(0, 20)}" + pick("", f".{rng.integers(0, 9)}")
    if slot == "price":
        return f"{rng.integers(1, 999)}{pick('.', ',')}{digits(2)}"
    if slot == "isbn":
        return f"978-3-{digits(4)}-{digits(4)}-{digits(1)}"
    if slot == "thousands":
        return f"{rng.integers(1, 999)},{digits(3)},{digits(3)}"
    if slot == "short":
        return "".join(pick(*"0123456789abcdef") for _ in range(7))
    return str(rng.integers(1900, 2100)) if slot == "year" else digits(rng.integers(1, 4))


def examples(n: int = EXAMPLES, seed: int = 13) -> list[tuple[str, list[Span]]]:
    """The labelled table: (text, spans), ``n`` sentences."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        text, spans = "", []
        for part in re.split(r"(\{\w+\})", TEMPLATES[i % len(TEMPLATES)]):
            if part.startswith("{") and part.endswith("}"):
                value = _value(part[1:-1], rng)
                if part[1:-1] in KINDS:
                    spans.append((part[1:-1], len(text), len(text) + len(value)))
                text += value
            else:
                text += part
        rows.append((text, spans))
    return rows


# The field.

_LABEL = {x: i for i, x in enumerate(LABELS)}
_NEVER = -1e4


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Masks of the steps between labels and of first labels: I follows B or I of its kind only."""
    steps, first = np.zeros((len(LABELS),) * 2), np.zeros(len(LABELS))
    for b, to in enumerate(LABELS):
        if to[0] == "I":
            first[b] = _NEVER
            steps[[a for a, x in enumerate(LABELS) if x[1:] != to[1:]], b] = _NEVER
    return steps, first


def labels_of(text: str, spans: list[Span]) -> list[int]:
    out = []
    for m in re.finditer(r"\S+", text):
        of = next(((k, a) for k, a, b in spans if a < m.end() and m.start() < b), None)
        out.append(0 if of is None else _LABEL[f"{'B' if m.start() <= of[1] else 'I'}-{of[0]}"])
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


class Field:
    """Weights of the features of a word and its neighbours, and of steps between labels."""

    def __init__(self, index: dict[str, int], lexicon: frozenset[str], weights: np.ndarray, steps: np.ndarray, first: np.ndarray):
        self.index, self.lexicon, self.weights, self.steps, self.first = index, lexicon, weights, steps, first
        # What a label other than O, and the end of its span, can gain by steps.
        enter = max((steps[:, 1:] - steps[0, 0]).max(), (first[1:] - first[0]).max())
        self.bound = float(enter + max(0.0, (steps[1:, 0] - steps[0, 0]).max()))

    @classmethod
    def train(cls, rows: list[tuple[str, list[Span]]], steps: int = STEPS, most: int = EXAMPLES, penalty: float = 0.5) -> Field:
        """From at most ``most`` labelled rows."""
        rows = rows[:most]
        said = [text.split() for text, _ in rows]
        counts: dict[str, int] = {}
        for word in chain.from_iterable(said):
            low = word.strip(_MARKS).split("=")[0].split(":")[0].lower()
            counts[low] = counts.get(low, 0) + 1
        # Words that stand in many rows; made words don't.
        lexicon = frozenset(w for w, n in counts.items() if n >= 4 and w.replace("_", "").replace("-", "").isalpha())
        shapes: dict[tuple, int] = {}
        told = [[shapes.setdefault(shape(w, lexicon), len(shapes) + 1) for w in words] for words in said]
        index: dict[str, int] = {"edge": 0}
        own = [[0]] + [[index.setdefault(f, len(index)) for f in features(s)] for s in shapes]
        x = np.zeros((len(own), len(index)))
        for i, fs in enumerate(own):
            x[i, fs] = 1.0
        n, t = len(rows), max(map(len, told))
        word = np.zeros((n, t + 2), np.int64)
        gold, there = np.zeros((n, t), np.int64), np.zeros((n, t), bool)
        for i, (ids, (text, spans)) in enumerate(zip(told, rows, strict=True)):
            word[i, 1 : len(ids) + 1] = ids
            gold[i, : len(ids)], there[i, : len(ids)] = labels_of(text, spans), True
        size = len(LABELS)
        mask, first_mask = _allowed()
        one = np.eye(size)[gold] * there[:, :, None]
        pairs = np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])
        parts = [np.zeros((3, len(index), size)), np.zeros((size, size)), np.zeros(size)]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
        for step in range(1, steps + 1):
            w, trans, first = parts[0], parts[1] + mask, parts[2] + first_mask
            tables = [x @ w[k] for k in range(3)]
            score = tables[0][word[:, 1:-1]] + tables[1][word[:, :-2]] + tables[2][word[:, 2:]]
            alpha, beta = np.zeros((n, t, size)), np.zeros((n, t, size))
            alpha[:, 0] = first + score[:, 0]
            for i in range(1, t):
                new = _lse(alpha[:, i - 1, :, None] + trans, 1) + score[:, i]
                alpha[:, i] = np.where(there[:, i, None], new, alpha[:, i - 1])
            for i in range(t - 2, -1, -1):
                new = _lse(trans + (score[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
                beta[:, i] = np.where(there[:, i + 1, None], new, 0.0)
            z = _lse(alpha[:, -1], 1)
            p = np.exp(alpha + beta - z[:, None, None]) * there[:, :, None]
            both = np.exp(np.minimum(0.0, alpha[:, :-1, :, None] + trans + (score + beta)[:, 1:, None, :] - z[:, None, None, None])) * there[:, 1:, None, None]
            wrong = one - p
            grads = [np.zeros_like(w), pairs - both.sum(axis=(0, 1)), wrong[:, 0].sum(axis=0)]
            for k, at in enumerate((slice(1, -1), slice(0, -2), slice(2, None))):
                by_class = np.zeros((len(own), size))
                np.add.at(by_class, word[:, at].ravel(), wrong.reshape(-1, size))
                grads[0][k] = x.T @ by_class
            for k, (part, grad, (m, v)) in enumerate(zip(parts, grads, moments, strict=True)):
                grad = grad - penalty * part
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                parts[k] = part + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(index, lexicon, parts[0], parts[1] + mask, parts[2] + first_mask)

    def row(self, s: tuple | None) -> np.ndarray:
        """Scores of the labels by a shape for the word itself, the word after it and the word before it; None is the edge of a line."""
        own = [0] if s is None else [i for f in features(s) if (i := self.index.get(f)) is not None]
        return self.weights[:, own].sum(axis=1)


class Decoder:
    """Viterbi over lines, with the classes of words that a task has met."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()

    def forget(self) -> None:
        decoder = self

        class Known(dict):
            def __missing__(self, word: str) -> int:
                self[word] = number = decoder.number(shape(word, decoder.field.lexicon))
                return number

        self.words: dict[str, int] = Known()
        self.shapes: dict[tuple, int] = {}
        self.rows = [self.field.row(None)]
        self.table = self.gain = None

    def number(self, s: tuple) -> int:
        if s not in self.shapes:
            self.shapes[s] = len(self.rows)
            self.rows.append(self.field.row(s))
        return self.shapes[s]

    def lines(self, lines: list[list[str]], every: bool = False) -> dict[int, list[int]]:
        """Labels of the words of each line that has any but O. With ``every`` no line is passed over."""
        if len(self.rows) > _CLASSES or len(self.words) > _WORDS:
            self.forget()
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        flat = list(map(self.words.__getitem__, chain.from_iterable(lines)))
        if not flat:
            return {}
        if self.table is None or len(self.table) < len(self.rows):
            self.table = np.stack(self.rows)
            self.gain = (self.table[:, :, 1:] - self.table[:, :, :1]).max(axis=2)
        ids = np.array(flat, np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        before, after = np.append(0, ids[:-1]), np.append(ids[1:], 0)
        full = sizes > 0
        before[starts[full]], after[ends[full] - 1] = 0, 0
        # More than any label but O can gain at a word.
        gain = self.gain[ids, 0] + self.gain[before, 1] + self.gain[after, 2]
        hot = np.flatnonzero((gain + self.field.bound > -1e-9) | every)
        chosen = np.unique(np.searchsorted(ends, hot, side="right"))
        chosen = chosen[np.argsort(sizes[chosen], kind="stable")]
        out: dict[int, list[int]] = {}
        begin = 0
        while begin < len(chosen):
            # Lines of like length together, in bounded blocks.
            end = begin + 1
            while end < len(chosen) and (end - begin + 1) * sizes[chosen[end]] <= 65_536 and sizes[chosen[end]] <= 2 * sizes[chosen[begin]] + 8:
                end += 1
            block = chosen[begin:end]
            begin = end
            at = starts[block][:, None] + np.arange(sizes[block].max())
            there = np.arange(at.shape[1]) < sizes[block][:, None]
            at = np.minimum(at, len(ids) - 1)
            score = self.table[ids[at], 0] + self.table[before[at], 1] + self.table[after[at], 2]
            for line, path in zip(block.tolist(), self._viterbi(score, there), strict=True):
                if path.any():
                    out[line] = path.tolist()
        return out

    def _viterbi(self, score: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
        n, t, size = score.shape
        best = self.field.first + score[:, 0]
        back = np.zeros((t, n, size), np.int8)
        for i in range(1, t):
            ways = best[:, :, None] + self.field.steps
            back[i] = ways.argmax(axis=1)
            new = np.take_along_axis(ways, back[i][:, None, :].astype(np.int64), 1)[:, 0] + score[:, i]
            best = np.where(there[:, i, None], new, best)
            back[i][~there[:, i]] = np.arange(size)
        label = best.argmax(axis=1)
        paths = np.zeros((n, t), np.int64)
        for i in range(t - 1, -1, -1):
            paths[:, i] = label
            label = back[i][np.arange(n), label] if i else label
        return [p[: k.sum()] for p, k in zip(paths, there, strict=True)]


_SECRET = re.compile(r"[A-Za-z0-9_-]{16,}")
_HEXTETS = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}")
_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+")


def checked(kind: str, text: str, start: int, end: int) -> Span | None:
    """The span of a kind within start and end, without marks around it, if it passes its check."""
    value = text[start:end]
    if kind in ("secret", "ip", "email"):
        pattern = {"secret": _SECRET, "ip": _HEXTETS, "email": _WRITTEN}[kind]
        found = max(pattern.finditer(value), key=lambda m: len(m[0]), default=None)
        if found is None or kind == "secret" and not (re.search("[0-9]", found[0]) and re.search("[A-Za-z]", found[0])):
            return None
        return kind, start + found.start(), start + found.end()
    while value and value[-1] not in "0123456789":
        value, end = value[:-1], end - 1
    while value and not (value[0] in "0123456789+" or value[0] == "(" and ")" in value):
        value, start = value[1:], start + 1
    fits = re.fullmatch(r"[0-9+(][0-9 ()./-]*", value) and (_card(value) if kind == "card" else _phone(value))
    return (kind, start, end) if fits else None


def added(text: str, words: Iterator[tuple[int, int]], labels: list[int]) -> Iterator[Span]:
    """Spans of a labelled line; ``words`` are the places of its words in ``text``."""
    kind, start, end = "", 0, 0
    for (a, b), label in zip(words, labels, strict=True):
        name = LABELS[label]
        if name[0] == "I":
            end = b
            continue
        if kind and (span := checked(kind, text, start, end)):
            yield span
        kind, start, end = name[2:], a, b
    if kind and (span := checked(kind, text, start, end)):
        yield span


def scan(texts: list[str], decoder: Decoder) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the patterns and those that the field adds."""
    lines: list[list[str]] = []
    origin: list[tuple[int, int, int]] = []
    for i, text in enumerate(texts):
        start = 0
        for line in text.split("\n"):
            lines.append(line.split())
            origin.append((i, start, start + len(line)))
            start += len(line) + 1
    base = [patterns(t) for t in texts]
    more: list[list[Span]] = [[] for _ in texts]
    for number, labels in sorted(decoder.lines(lines).items()):
        i, start, end = origin[number]
        places = (m.span() for m in re.compile(r"\S+").finditer(texts[i], start, end))
        taken = [(a, b) for _, a, b in base[i]] if len(base[i]) < 64 else [(a, b) for _, a, b in base[i] if b > start and a < end]
        more[i] += [s for s in added(texts[i], places, labels) if not any(s[1] < b and a < s[2] for a, b in taken)]
    return list(zip(base, more, strict=True))


def written(spans: list[Span]) -> str:
    """kind:start:end, comma-joined, by kind as listed and start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


_trained: dict[tuple[int, int], Field] = {}


def field(n: int = EXAMPLES, steps: int = STEPS) -> Field:
    """The field trained from the labelled table of this module, once a process."""
    if (n, steps) not in _trained:
        _trained[n, steps] = Field.train(examples(n), steps)
    return _trained[n, steps]


def find(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the patterns), n_added, base_sha256 and spans of every row of ``docs`` (doc_id, text)."""
    known = docs.sparkSession.sparkContext.broadcast(model or field())
    decoders: list[Decoder] = []

    def run(columns):
        if not decoders:
            decoders.append(Decoder(known.value))
        texts = columns["text"].to_pylist()
        for a, b in chunks(texts):
            found = scan([t or "" for t in texts[a:b]], decoders[0])
            counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in BASE}
            yield {"doc_id": columns["doc_id"][a:b], "n_added": [len(more) for _, more in found], **counts,
                   "base_sha256": [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found],
                   "spans": [written(base + more) for base, more in found]}

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"
    return arrow_map(docs.select("doc_id", "text"), run, schema)
