"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score. Column expressions only.

Base kinds (email, ip, card, phone) are those of the fixed patterns; what passes its check is always a span. Further
kinds (iban, tel, ssn) are spans if their score reaches THRESHOLD and no base span overlaps them. A score starts at the
kind's own, and grows by CHECKED where a checksum or rule confirms the match and by NEARBY where the CONTEXT characters
before it hold one of the kind's words.

The patterns are written so that a search never goes over the same run of characters twice (possessive groups, and a
look behind that rejects starts inside a run), with the same matches as the plain form. The text is cut at the matches,
and the lengths of the pieces give the positions, in code points.

Defined results: a null text has no spans, and is null after redaction. Texts are searched whole, however long. Every row gives one row,
repeated rows too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

THRESHOLD = 70
CHECKED = 30
NEARBY = 20
CONTEXT = 40
_STEP = 128

#: The patterns of the kinds, in the order in which spans with one start are listed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "tel": r"(?<![A-Za-z0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![A-Za-z0-9-])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
}
#: What a text holds if it holds a match.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "tel": None, "ssn": "-"}
OWN_SCORE = {"email": 80, "ip": 60, "card": 70, "phone": 70, "iban": 60, "tel": 50, "ssn": 40}
WORDS = {
    "email": r"e-?mail|mail|contact|courriel|correo",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|visa|master|amex|credit|carte|karte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|cell",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "tel": r"phone|\btel\b|call|mobile|\bfax\b|\bcell\b|t[ée]l[ée]phone|telefon",
    "ssn": r"\bssn\b|social security|tax id",
}
BASE = ("email", "ip", "card", "phone")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _mod97(compact: Column) -> Column:
    turned = F.split(F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4))), "")

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step) == 1


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _check(kind: str, m: Column) -> Column:
    """Whether the kind's rule confirms a match; null where the kind has no rule."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(_digits(m)) <= 19, _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return _mod97(F.regexp_replace(m, " ", ""))
    if kind == "ssn":
        return ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(None).cast("boolean")


def _matches(kind: str, text: Column) -> Column:
    """array<struct<gap, m>>: each match with what lies between it and the one before; null where there is none."""
    sign = SIGNS[kind]
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    possible = F.contains(text, F.lit(sign)) if sign else text.rlike(PATTERNS[kind])
    return F.when(possible, found)


def _judged(kind: str, text: Column, matches: Column) -> Column:
    """array<struct<gap int, size int, keep, score>> of the matches."""
    pieces = F.split(text, PATTERNS[kind], -1)

    def one(gap: Column, m: Column) -> Column:
        checked = _check(kind, m)
        near = F.lower(F.right(gap, F.lit(CONTEXT))).rlike(WORDS[kind])
        score = F.lit(OWN_SCORE[kind]) + F.when(checked, CHECKED).otherwise(0) + F.when(near, NEARBY).otherwise(0)
        keep = F.coalesce(checked, F.lit(True)) if kind in BASE else F.coalesce(checked, F.lit(True)) & (score >= THRESHOLD)
        return F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), keep.alias("keep"), F.least(score, F.lit(100)).alias("score"))

    return F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, one)


_SPAN = "struct<start:int,place:int,stop:int,kind:string,score:int>"


def _placed(kind: str, judged: Column) -> Column:
    """array<struct<start, place, stop, kind, score>> of the matches that are kept; in steps, so that no array is copied once for each match."""
    place = list(PATTERNS).index(kind)

    def add(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        stop = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), stop.alias("stop"), F.lit(kind).alias("kind"), x["score"].alias("score"))
        return F.struct(stop.alias("pos"), F.when(x["keep"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        got = F.aggregate(F.slice(judged, i * _STEP + 1, F.lit(_STEP)), F.struct(acc["pos"].alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out")), add)
        return F.struct(got["pos"].alias("pos"), F.concat(acc["out"], F.array(got["out"])).alias("out"))

    steps = F.sequence(F.lit(0), F.ceil(F.size(judged) / F.lit(_STEP)).cast("int") - 1)
    all_ = F.aggregate(steps, F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<array<{_SPAN}>>").alias("out")), step)
    return F.when(F.size(judged) > 0, F.flatten(all_["out"])).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _with_spans(df: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """df with the spans of its column text (never null): of each base kind, of all base kinds, and of all kinds; and their names."""
    name = {x: fresh(df, f"pw_{x}") for x in [*(f"{c}_{k}" for c in "mjs" for k in PATTERNS), "base", "more", "all"]}
    t, keep = F.col(text), df.columns
    df = df.withColumns({name[f"m_{k}"]: _matches(k, t) for k in PATTERNS})
    df = df.withColumns({name[f"j_{k}"]: F.when(F.size(name[f"m_{k}"]) > 0, _judged(k, t, F.col(name[f"m_{k}"]))) for k in PATTERNS}).select(*keep, *[name[f"j_{k}"] for k in PATTERNS])
    empty = F.array().cast(f"array<{_SPAN}>")
    df = df.withColumns({name[f"s_{k}"]: F.when(F.col(name[f"j_{k}"]).isNotNull(), _placed(k, F.col(name[f"j_{k}"]))).otherwise(empty) for k in PATTERNS})
    base = F.array_sort(F.concat(*[F.col(name[f"s_{k}"]) for k in BASE]))
    more = F.concat(*[F.col(name[f"s_{k}"]) for k in PATTERNS if k not in BASE])
    df = df.withColumns({name["base"]: base, name["more"]: more})
    alone = F.filter(name["more"], lambda s: ~F.exists(name["base"], lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return df.withColumn(name["all"], F.when(F.size(name["more"]) > 0, F.array_sort(F.concat(name["base"], alone))).otherwise(F.col(name["base"]))), name


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, scores (of all spans, in their order)."""
    df, name = _with_spans(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "text")
    counts = [F.size(name[f"s_{k}"]).cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(_listed(F.col(name["base"])), 256).alias("base_sha256"), _listed(F.col(name["all"])).alias("spans"), F.array_join(F.transform(name["all"], lambda s: s["score"].cast("string")), ",").alias("scores"))


_PIECE = "struct<start:int,stop:int,kind:string>"


def _pieces(spans: Column) -> Column:
    """array<struct<start, stop, kind>>: the text before each span and the kind that takes the span's place; a span that begins in another one lengthens it."""

    def add(acc: Column, s: Column) -> Column:
        piece = F.struct(acc["pos"].alias("start"), s["start"].alias("stop"), s["kind"].alias("kind"))
        out = F.when(s["start"] >= acc["pos"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["stop"]).alias("pos"), out.alias("out"))

    def step(acc: Column, i: Column) -> Column:
        got = F.aggregate(F.slice(spans, i * _STEP + 1, F.lit(_STEP)), F.struct(acc["pos"].alias("pos"), F.array().cast(f"array<{_PIECE}>").alias("out")), add)
        return F.struct(got["pos"].alias("pos"), F.concat(acc["out"], F.array(got["out"])).alias("out"))

    steps = F.sequence(F.lit(0), F.ceil(F.size(spans) / F.lit(_STEP)).cast("int") - 1)
    return F.aggregate(steps, F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<array<{_PIECE}>>").alias("out")), step)


def _without(text: Column, spans: Column) -> Column:
    """The text with the spans' kinds in their place. The text is cut once for _STEP spans, and that part once for each of them."""

    def part(ps: Column) -> Column:
        first = F.get(ps, F.lit(0))["start"]
        block = F.substr(text, first + 1, F.element_at(ps, -1)["stop"] - first)
        shown = lambda b: F.array_join(F.transform(ps, lambda p: F.concat(F.substr(b, p["start"] - first + 1, p["stop"] - p["start"]), F.lit("["), F.upper(p["kind"]), F.lit("]"))), "")
        return let(block, shown)

    whole = lambda x: F.concat(F.array_join(F.transform(F.filter(x["out"], lambda ps: F.size(ps) > 0), part), ""), F.substr(text, x["pos"] + 1))
    return F.when(F.size(spans) > 0, let(_pieces(spans), whole)).otherwise(text)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of its texts that find() lists replaced by its kind in brackets; spans that overlap become one, of the first one's kind."""
    text = fresh(docs, "pw_text")
    df, name = _with_spans(docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))), text)
    hidden = F.when(F.col(text_col).isNotNull(), _without(F.col(text), F.col(name["all"])))
    return df.withColumn(text_col, hidden).select(*docs.columns)
