"""Free-text detection: ordered stages that each replace what they find by a token.

A stage finds all matches of a pattern, decides about each one from the match and its surroundings,
and weaves the decided replacements between what the matches leave. Later stages see earlier tokens.
Everything is a column expression. A token carries a provisional number made of its key, which
``vault`` replaces by the order of first appearance; it starts with 9 and has 18 digits, so no later
pattern takes it for something else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import LETTER, LOWER, UPPER
from ..functions.wordlists import AMBIGUOUS_GIVEN, LEGAL_FORMS, RESERVED, Dictionaries
from ..plans.tables import with_row_id

DETECTION = "struct<stage:int,place:int,type:string,prefix:string,key:string,value:string,stat:string,risk:string,hit:boolean,token:string>"
PERSON = "PERSONNE"
#: What stands for a person in irreversible output, and the type of detections that have no token.
REMOVED, HIDDEN = "[SUPPRIMÉ]", "-"


#: Cheap tests of the given text, each worked out once a row.
HINTS: dict[str, Callable[[Column], Column]] = {
    "digit": lambda t: F.rlike(t, F.lit("[0-9]")),
    "number": lambda t: F.rlike(t, F.lit(r"[0-9](?:[^0-9]*[0-9]){8}")),
    "at": lambda t: t.contains("@"),
    "any_at": lambda t: t.contains("@") | F.rlike(t, F.lit(r"(?i)[(\[](?:at|arobase)[)\]]")),
    "link": lambda t: t.contains("://") | t.contains("www."),
    "colon": lambda t: t.contains(":"),
    "secret": lambda t: t.contains("_") | t.contains("eyJ"),
    "capitals": lambda t: F.rlike(t, F.lit(f"[{UPPER}]{{2}}")),
}


@dataclass(frozen=True)
class Options:
    strong: bool = False
    tech: bool = False
    whitelist: tuple[str, ...] = ()
    blacklist: tuple[str, ...] = ()
    dictionaries: Dictionaries = field(default_factory=Dictionaries)
    #: If given, only the stages of these names run.
    names: tuple[str, ...] = ()
    #: An array column of person names that a model has found in the text.
    entities: str | None = None
    #: Stages of the caller, each with the name of the stage that it follows ("" for the first place): see ``register_stage``.
    extra: tuple[tuple[str, Stage], ...] = ()


@dataclass(frozen=True)
class Match:
    """A match with its surroundings, as columns. ``before`` and ``after`` are the text beside it."""

    value: Column
    before: Column
    after: Column
    words: dict[str, Column]


@dataclass(frozen=True)
class Stage:
    name: str
    pattern: str | Column
    type: str = "personne"
    prefix: str = PERSON
    risk: str | None = "direct"
    accept: Callable[[Match], Column] | None = None
    #: What of the match becomes the token; what stays before it.
    part: Callable[[Column], Column] = staticmethod(lambda m: m)
    kept: Callable[[Column], Column] = staticmethod(lambda m: F.lit(""))
    #: Type and prefix where they depend on the match.
    kind: Callable[[Column], tuple[Column, Column]] | None = None
    stat: str | Callable[[Match], Column] | None = None
    hit: bool = False
    guard: bool = True
    only: str | None = None
    #: Name of a test in ``HINTS`` that a text must pass to hold any match; saves looking.
    hint: str | None = None


def provisional(type_: Column, key: Column, prefix: Column) -> Column:
    number = F.pmod(F.xxhash64(type_, key), F.lit(10**17))
    return F.concat(F.lit("["), prefix, F.lit("_9"), F.lpad(number.cast("string"), 17, "0"), F.lit("]"))


def person(value: Column) -> tuple[Column, Column]:
    key = T.person_key(value)
    return key, F.when(key == "", F.lit(f"[{PERSON}]")).otherwise(provisional(F.lit("personne"), key, F.lit(PERSON)))


def detection(stage: int | Column, place: Column, type_: Column, prefix: Column, key: Column, value: Column, stat: Column, risk: Column, hit: Column, token: Column) -> Column:
    stage = F.lit(stage) if isinstance(stage, int) else stage
    return F.struct(
        stage.cast("int").alias("stage"), place.cast("int").alias("place"), type_.alias("type"), prefix.alias("prefix"), key.alias("key"),
        T.trim(value).alias("value"), stat.alias("stat"), risk.cast("string").alias("risk"), hit.alias("hit"), token.alias("token"),
    ).cast(DETECTION)


def apply_stage(text: Column, number: int, stage: Stage, words: dict[str, Column]) -> Column:
    """struct<text, found>: the text after the stage and an array of detections."""
    pattern = F.lit(stage.pattern) if isinstance(stage.pattern, str) else stage.pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))

    def woven(pair: Column) -> Column:
        matches, parts = pair["matches"], pair["parts"]

        def decide(value: Column, i: Column) -> Column:
            left = F.right(F.concat(F.coalesce(F.get(matches, i - 1), F.lit("")), F.get(parts, i)), F.lit(40))
            right = F.concat(F.get(parts, i + 1), F.coalesce(F.get(matches, i + 1), F.lit("")), F.coalesce(F.get(parts, i + 2), F.lit("")))
            match = Match(value, left, right, words)
            ok = ~value.contains("[") if stage.guard else F.lit(True)
            if stage.accept:
                ok = ok & stage.accept(match)
            part = stage.part(value)
            if stage.type == HIDDEN:
                type_, prefix, key, token = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(REMOVED)
            elif stage.type == "personne":
                type_, prefix = F.lit("personne"), F.lit(PERSON)
                key, token = person(part)
            else:
                type_, prefix = stage.kind(value) if stage.kind else (F.lit(stage.type), F.lit(stage.prefix))
                key = T.typed_key(part)
                token = F.when(key == "", value).otherwise(provisional(type_, key, prefix))
            stat = stage.stat(match) if callable(stage.stat) else F.lit(stage.stat) if stage.stat else type_
            det = detection(number, i, type_, prefix, key, part, stat, F.lit(stage.risk), F.lit(stage.hit), token)
            return F.when(F.coalesce(ok, F.lit(False)), F.struct(F.concat(stage.kept(value), token).alias("shown"), det.alias("det"))).otherwise(
                F.struct(value.alias("shown"), F.lit(None).cast(DETECTION).alias("det"))
            )

        decided = F.transform(matches, decide)

        def joined(d: Column) -> Column:
            shown = F.zip_with(parts, d["shown"], lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
            return F.struct(F.array_join(shown, "").alias("text"), F.filter(d["det"], lambda x: x.isNotNull()).alias("found"))

        return T.let(decided, joined)

    nothing = F.struct(text.alias("text"), F.array().cast(f"array<{DETECTION}>").alias("found"))
    pair = F.struct(found.alias("matches"), F.split(text, pattern, -1).alias("parts"))
    here = F.rlike(text, pattern)
    return F.when(F.col(f"_hint_{stage.hint}") & here if stage.hint else here, T.let(pair, woven)).otherwise(nothing)


def _beside_institution(m: Match, institutions: list[str]) -> Column:
    after = F.lower(F.regexp_extract(m.after, r"(?U)^\s+(\S+)", 1))
    before = F.lower(F.regexp_extract(m.before, r"(?U)(\S+)\s+$", 1))
    return after.isin(institutions) | before.isin(institutions)


def lookups(given: Column, surname: Column, hide: bool) -> list[Stage]:
    """Stages for the person a row is about. A given name of fewer than four letters counts only beside the surname."""
    first, last = T.trim(F.coalesce(given, F.lit(""))), T.trim(F.coalesce(surname, F.lit("")))
    named = F.coalesce(given, F.lit("")) != ""
    short = (F.length(first) < 4) & (last != "")

    def word(*parts: Column) -> Column:
        return F.concat(F.lit("(?iU)\\b"), *parts, F.lit("\\b"))

    gap = F.lit("\\s+")
    patterns = (
        ("lookup_nom", named & short, word(T.quoted(first), gap, T.quoted(last))),
        ("lookup_nom", named & short, word(T.quoted(last), gap, T.quoted(first))),
        ("lookup_prenom", named & ~short & (first != ""), word(T.quoted(first))),
        ("lookup_nom", named & ~short & (last != ""), word(T.quoted(last))),
    )
    return [Stage(stat, F.when(on, p), HIDDEN if hide else "personne", risk=None, stat=stat, guard=False) for stat, on, p in patterns]


def _entities(names: Column) -> Column:
    """A pattern of the names that have three letters or more and begin with a capital, the longest first."""
    kept = F.array_distinct(F.filter(names, lambda n: (F.length(n) >= 3) & n.rlike(r"^\p{Lu}")))
    kept = F.array_sort(kept, lambda a, b: F.length(b) - F.length(a))
    return F.when(F.size(kept) > 0, F.concat(F.lit("(?U)\\b(?:"), F.array_join(F.transform(kept, T.quoted), "|"), F.lit(")\\b")))


def stages(options: Options) -> list[Stage]:
    """All stages in their order; those of strong and technical mode carry it in ``only``."""
    d = options.dictionaries
    name = f"[{UPPER}][{LETTER}'-]+"
    sep = r"[\s.\-]*"
    domain = r"[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+"
    local = "[a-zA-Z0-9_.+-]+"
    street = "rue|avenue|boulevard|chemin|impasse|allée|route"
    street_name = rf"\s+[{LETTER}'\s-]{{3,}}"
    octet = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
    hextet = "[a-fA-F0-9]{1,4}"
    greeting = "|".join(x + g[1:] for g in ("Bonjour", "Salut", "Bonsoir", "Hello", "Hi", "Coucou", "Cher", "Chère") for x in (g[0], g[0].lower()))
    unit = "kg|g|m|cm|mm|km|€|eur|euros|%|degrés?"
    counted = rf"n°|n\.|numéro|décret|article|art\.|référence|ref\.|dossier|commande|lot|page|p\.|chapitre|volume|tome|fig\.|figure|tableau|tab\.|{unit}"
    greeted = rf"(?U)^(?:{greeting})[ \t]+"
    born = r"(?iU)^(?:né|née|naissance)(?:e|s)?"

    def first_word(m: Column) -> Column:
        return F.regexp_extract(m, r"(?U)^\s*(\S+)", 1)

    def not_stopword(m: Column) -> Column:
        return ~first_word(m).isin(d.stopwords)

    def free(m: Match) -> Column:
        return ~_beside_institution(m, d.institutions)

    def known(which: str) -> Callable[[Match, Column], Column]:
        return lambda m, w: F.array_contains(m.words[which], F.upper(T.trim(w))) | F.array_contains(m.words[which], T.fold(T.trim(w)))

    given = known("given")

    def surname(m: Match) -> Column:
        return F.array_contains(m.words["surname"], F.upper(m.value))

    def capitals(m: Match) -> Column:
        v = m.value
        alone = (F.right(m.before, F.lit(1)).isin("", "\t", "\n", "\r")) & (F.left(m.after, F.lit(1)).isin("", "\t", "\n", "\r"))
        plain = ~v.isin(RESERVED) & ~v.isin(d.kept_capitals) & ~v.isin(d.stopwords) & ~F.lower(v).isin(d.institutions)
        return plain & ~alone & (((F.length(v) >= 2) & surname(m)) | (F.length(v) >= 5))

    def siret(m: Column) -> tuple[Column, Column]:
        whole = F.length(T.digits(m)) == 14
        return F.when(whole, "siret_txt").otherwise("siren_txt"), F.when(whole, "SIRET").otherwise("SIREN")

    def typed(name_, pattern, prefix, risk, **more) -> Stage:
        return Stage(name_, pattern, name_, prefix, risk, **more)

    # What each pattern matches, its type and prefix, and the order of the stages.
    found = [
        typed("url_txt", r"(?U)\b(?:https?://|www\.)\S+", "URL", None, hint="link"),
        *([Stage("blacklist", rf"(?iU)\b(?:{T.alternation([w])})\b", guard=False, stat="blacklist") for w in sorted(options.blacklist, key=lambda w: (-len(w), w))]),
        typed("fiscal_txt", r"(?U)\b[0-3]\d{12}\b", "ID_FISCAL", "finance", accept=lambda m: ~(F.right(m.before, F.lit(20)).rlike(rf"(?iU)\b(?:{counted})\s*$") | F.left(m.after, F.lit(20)).rlike(rf"(?iU)^\s*(?:{unit}|°|exemplaires?|pages?)")), hint="number"),
        typed("nir_txt", rf"(?iU)(?<!\d)[12]{sep}\d{{2}}{sep}\d{{2}}{sep}(?:\d{{2}}|2[AB]){sep}\d{{3}}{sep}\d{{3}}(?:{sep}\d{{2}})?(?!\d)", "NIR", "finance", accept=lambda m: T.social_number(m.value), hint="number"),
        typed("iban_txt", r"(?iU)\b[A-Z]{2}\d{2}(?:[\s-]?[0-9A-Z]{4}){4}[\s-]?[0-9A-Z]{0,4}[\s-]?[0-9A-Z]{0,3}\b", "IBAN", "finance", hint="digit"),
        typed("cb_txt", r"(?U)\b(?:\d[\s-]*?){13,19}\b", "CB", "finance", accept=lambda m: T.card_number(m.value), hint="number"),
        typed("cvv_txt", r"(?iU)\b(?:cvv|cvc|cryptogramme|cv2)\W+\d{3,4}\b", "CVV", "finance", hint="digit"),
        typed("siret_txt", r"(?U)\b\d{3}[\s.]?\d{3}[\s.]?\d{3}(?:[\s.]?\d{5})?\b", "SIRET", "finance", accept=lambda m: T.company_number(m.value), kind=siret, hint="number"),
        typed("email_txt", rf"(?iU)\bmailto:{local}@{domain}", "EMAIL", "direct", hint="at"),
        typed("email_txt", rf"(?iU)\b{local}\s*(?:@|\[at\]|\(at\)|\[arobase\])\s*[a-zA-Z0-9-]+\s*(?:\.|\[dot\]|\(dot\)|point)\s*[a-zA-Z0-9.-]+\b", "EMAIL", "direct", hint="any_at"),
        typed("email_txt", rf"(?U){local}@{domain}", "EMAIL", "direct", hint="at"),
        typed("jwt_txt", r"(?U)\b(?:eyJ[a-zA-Z0-9_-]{10,}\.){2}[a-zA-Z0-9_-]{10,}\b", "JWT_TOKEN", "tech", only="tech", hint="secret"),
        typed("apikey_txt", r"(?U)\b(?:sk|pk|api)_[a-zA-Z0-9]{20,}\b", "API_KEY", "tech", only="tech", hint="secret"),
        typed("ipv6_txt", rf"(?:{hextet}:){{7}}{hextet}|(?:{hextet}:){{1,7}}:|::(?:{hextet}:){{0,5}}{hextet}", "IPV6", "tech", only="tech", hint="colon"),
        typed("mac_txt", r"(?U)\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", "MAC_ADDR", "tech", only="tech"),
        typed("ipv4_txt", rf"(?U)\b(?:{octet}\.){{3}}{octet}\b", "IPV4", "tech", only="tech", hint="digit"),
        typed("gps_txt", r"(?U)\b-?(?:[1-8]?\d\.\d+|90\.0+)[,\s]+-?(?:1[0-7]\d|[1-9]?\d)\.\d+\b", "GPS", "tech", only="tech", hint="digit"),
        typed("plaque_txt", r"(?U)\b(?:[A-Z]{2}[-\s]?\d{3}[-\s]?[A-Z]{2}|\d{1,4}[-\s]?[A-Z]{2,3}[-\s]?\d{2})\b", "PLAQUE_IMMAT", "tech", only="tech", hint="digit"),
        typed("tel_txt", r"(?U)(?<!\d)(?:(?:\+|00)33|0)\s*[1-9](?:[\s._-]*\d){8}(?!\d)", "TEL", "direct", hint="number"),
        typed("tel_txt", r"(?iU)TEL\s*:\s*[\d\s.-]+", "TEL", "direct", hint="colon"),
        typed("orga_txt", rf"(?U)\b[{UPPER}][{LETTER}&'-]+(?:\s+[{UPPER}][{LETTER}&'-]+)*\s+(?:{'|'.join(LEGAL_FORMS)})\b", "ORGANISATION", "indirect", hint="capitals"),
        typed("orga_txt", rf"(?iU)\b(?:{T.alternation(d.organisations)})\b", "ORGANISATION", "indirect", accept=lambda m: m.value.rlike(r"^\p{Lu}") & ~m.value.isin("Sa", "Son", "Un", "Une")),
        typed("ville_txt", rf"(?iU)\b(?:{T.alternation(d.cities)})\b", "VILLE", "indirect"),
        typed(
            "date_naiss_txt", r"(?iU)\b(?:né|née|naissance)(?:e|s)?\s+(?:le|du|au)?\s*:?\s*\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", "DATE_NAISSANCE", "indirect", only="strong", hint="digit",
            part=lambda m: F.regexp_extract(m, r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})$", 1), kept=lambda m: F.concat(F.regexp_extract(m, born.replace("(?:né|née|naissance)", "(né|née|naissance)"), 1), F.lit(" ")),
        ),
        typed("voie_txt", rf"(?iU)\b\d+\s+(?:{street}|bis|ter){street_name}", "VOIE", "indirect", hint="digit"),
        typed("voie_txt", rf"(?iU)\b(?:{street}){street_name}", "VOIE", "indirect", only="strong"),
        typed("cp_txt", r"(?U)\b\d{5}\b", "CP", None, only="strong", hint="digit"),
        Stage("salutation", rf"(?U)\b(?:{greeting})[ \t]+{name}(?:[ \t]+{name})*", stat="salutation", accept=lambda m: not_stopword(F.regexp_replace(m.value, greeted, "")), part=lambda m: F.regexp_replace(m, greeted, ""), kept=lambda m: F.regexp_extract(m, f"({greeted})", 1)),
        Stage("titre", rf"(?iU)\b(?:M\.|Mme\.?|Mlle\.?|monsieur|madame|mademoiselle)\s*[{UPPER}](?:[{LOWER}]+|[{UPPER}]+)[{LETTER}'-]*(?:\s+[{UPPER}][{LETTER}'-]+)*", stat="titre"),
        *(
            [Stage("nlp", _entities(F.col(options.entities)), stat="nlp", accept=lambda m: not_stopword(m.value) & free(m) & (given(m, first_word(m.value)) | m.value.rlike(r"(?U)^\p{Lu}\S*(?:\s+\p{Lu}\S*)+$")))]
            if options.entities else []
        ),
        Stage(
            "prenom_nom_maj", rf"(?U)\b[{UPPER}][{LOWER}'-]+ +[{UPPER}]{{2,}}[A-ZÀ-ÖØ-öø-ÿ'-]*(?: +[{UPPER}][{LETTER}'-]+)*", stat="prenom_nom_maj", hit=True, only="strong", hint="capitals",
            accept=lambda m: not_stopword(m.value) & free(m) & ~((F.size(F.split(m.value, " +")) == 2) & F.element_at(F.split(m.value, " +"), -1).isin(d.kept_capitals)),
        ),
        Stage("prenom_nom", rf"(?U)\b[{UPPER}][{LOWER}'-]+(?: +[{UPPER}][{LOWER}'-]+)+", stat="prenom_nom", hit=True, only="strong", accept=lambda m: not_stopword(m.value) & free(m)),
        Stage(
            "prenom_isole", rf"(?<![{LETTER}])[{UPPER}][{LOWER}]*(?:-[{UPPER}][{LOWER}]+)*(?![{LETTER}])", stat="prenom_isole", hit=True, only="strong", guard=False,
            accept=lambda m: (F.length(m.value) >= 2) & not_stopword(m.value) & free(m) & given(m, m.value),
        ),
        Stage(
            "prenom_isole_min", rf"(?<![{LETTER}])[{LOWER}]{{3,}}(?:-[{LOWER}]{{3,}})?(?![{LETTER}])", stat="prenom_isole_min", only="strong", guard=False,
            accept=lambda m: ~m.value.isin(d.lower_stopwords) & ~m.value.isin(AMBIGUOUS_GIVEN) & given(m, m.value),
        ),
        Stage("patronyme_prefixe", rf"(?iU)\b(?:BEN|EL|AL|AIT|ABDEL)(?:[\s-][{UPPER}][{LETTER}]{{2,}})+\b", stat="patronyme_prefixe", only="strong", accept=lambda m: free(m) & ~m.value.isin(d.stopwords)),
        Stage("capitals", rf"(?U)\b(?:[Ll]'|[Dd]')?[{UPPER}]{{2,}}(?:-[{UPPER}]{{2,}})*\b", hit=True, only="strong", hint="capitals", accept=capitals, stat=lambda m: F.when((F.length(m.value) >= 2) & surname(m), "maj_patronyme").otherwise("maj_long")),
    ]
    for after, stage in options.extra:
        # Behind the last stage of that name, and behind those that were put there before.
        places = [i for i, s in enumerate(found) if s.name == after]
        if after and not places:
            raise ValueError(f"there is no stage {after}")
        at = places[-1] + 1 if places else 0
        while at < len(found) and any(found[at] is s for a, s in options.extra if a == after):
            at += 1
        found.insert(at, stage)
    return [s for s in found if (s.only is None or getattr(options, s.only)) and (not options.names or s.name in options.names)]


def register_stage(options: Options, stage: Stage, after: str = "") -> Options:
    """``options`` with a stage of one's own behind all stages named ``after``, or before all stages; it sees what they left."""
    return replace(options, extra=(*options.extra, (after, stage)))


def _absorb(df: DataFrame, column: str, d: Dictionaries) -> DataFrame:
    """A word in capitals beside a person's token is taken into it, up to three times on each side."""
    token = rf"\[{PERSON}_\d+\]"
    sides = ((rf"(?U){token}\s+[{UPPER}]{{2,}}\b", rf"(?U)^{token}\s+"), (rf"(?U)\b[{UPPER}]{{2,}}\s+{token}", rf"(?U)\s+{token}$"))
    for pattern, rest in sides * 3:

        def shown(m: Column, rest: str = rest) -> Column:
            own = F.regexp_replace(m, rest, "")
            keep = own.isin(d.stopwords) | F.lower(own).isin(d.institutions) | own.isin(d.kept_capitals)
            return F.when(keep, m).otherwise(F.regexp_extract(m, token, 0))

        df = df.withColumn(column, _replaced(F.col(column), pattern, shown))
    return df


def _replaced(text: Column, pattern: str, shown: Callable[[Column], Column]) -> Column:
    """Each match replaced by a function of it."""

    def one(m: Column) -> Column:
        return shown(m)

    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)
    woven = F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(woven, "")).otherwise(text)


def detect(df: DataFrame, column: str, options: Options = Options(), out: str = "text", found: str = "found", row: str | None = None, lookup: tuple[Column, Column] | None = None, hide: bool = False) -> DataFrame:
    """``df`` with the rewritten ``column`` as ``out`` and an array of detections as ``found``.

    ``lookup`` is the given name and surname of the person a row is about, looked for before all else;
    with ``hide`` these become a constant. ``row`` is a column that tells rows apart; without it, frames that
    meet a dictionary that is a table (or a list too long for the plan) are numbered and written first. Null texts stay null and have no detections.
    """
    d = options.dictionaries
    words: dict[str, Column] = {}
    for name, dictionary, used in (("given", d.given_names, options.strong or options.entities), ("surname", d.surnames, options.strong)):
        value = _known(df, column, dictionary, name, row) if used else None
        if isinstance(value, tuple):
            df, value = value
        words[name] = value
    empty = F.array().cast(f"array<{DETECTION}>")
    chain = stages(options)
    hints = {s.hint for s in chain if s.hint}
    df = df.withColumns({"_text": F.col(column), "_found": empty} | {f"_hint_{h}": F.coalesce(HINTS[h](F.col(column)), F.lit(False)) for h in sorted(hints)})
    for number, stage in enumerate(lookups(*lookup, hide) if lookup else [], -4):
        df = df.withColumn("_done", apply_stage(F.col("_text"), number, stage, words)).withColumns({"_text": F.col("_done.text"), "_found": F.concat("_found", F.col("_done.found"))})
    white = sorted(options.whitelist, key=lambda w: (-len(w), w))
    for number, stage in enumerate(chain, 1):
        df = df.withColumn("_done", apply_stage(F.col("_text"), number, stage, words)).withColumns({"_text": F.col("_done.text"), "_found": F.concat("_found", F.col("_done.found"))})
        if number == 1:
            for i, w in enumerate(white):
                df = df.withColumn("_text", F.regexp_replace("_text", rf"(?iU)\b(?:{T.alternation([w])})\b", f"__WL{i}__"))
    if options.strong and not options.names:
        df = _absorb(df, "_text", d)
    text = F.regexp_replace("_text", rf"(?U)([\wÀ-ž])(\[{PERSON}_\d+\])", "$1 $2")
    text = F.regexp_replace(text, rf"(?U)(\[{PERSON}_\d+\])([\wÀ-ž])", "$1 $2")
    for i, w in enumerate(white):
        text = F.replace(text, F.lit(f"__WL{i}__"), F.lit(w))
    df = df.withColumns({out: text, found: F.when(F.col(column).isNull(), empty).otherwise(F.col("_found"))})
    return df.drop(*{"_text", "_found", "_done", "_known_given", "_known_surname", *(f"_hint_{h}" for h in hints)} - {out, found})


#: Dictionaries given as lists stand in the plan itself, up to so many words; longer ones are joined.
LITERAL_WORDS = 500


def _known(df: DataFrame, column: str, dictionary, name: str, row: str | None):
    """The words of a text that a dictionary holds, upper-cased: an array column (with the frame that has it)."""
    if isinstance(dictionary, DataFrame):
        key = dictionary.columns[0]
        words = dictionary.select(F.upper(T.trim(F.col(key))).alias("_word")).distinct()
        if row is None:
            df, row = with_row_id(df, "_row_of"), "_row_of"
        parts = F.split(F.upper(F.coalesce(F.col(column), F.lit(""))), f"[^{LETTER}-]+")
        candidates = F.array_distinct(F.concat(parts, F.transform(parts, T.fold)))
        hits = df.select(F.col(row).alias("_of"), F.explode(candidates).alias("_word")).join(words, "_word")
        hits = hits.groupBy("_of").agg(F.collect_set("_word").alias(f"_known_{name}"))
        joined = df.join(hits, F.col(row) == F.col("_of"), "left").drop("_of", "_row_of")
        return joined.withColumn(f"_known_{name}", F.coalesce(f"_known_{name}", F.array().cast("array<string>"))), F.col(f"_known_{name}")
    words = sorted({w.strip().upper() for w in dictionary})
    if len(words) > LITERAL_WORDS:
        return _known(df, column, df.sparkSession.createDataFrame([(w,) for w in words], "word string"), name, row)
    return F.array(*map(F.lit, words)).cast("array<string>")
