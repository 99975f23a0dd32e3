"""Personal data: patterns propose spans, checksums confirm them, context moves the score.

Only DataFrame expressions run.  A pattern's matches and the texts between
them (``regexp_extract_all`` and ``split`` walk the same matches) give the
places in code points.  Digits of card numbers pass Luhn, account numbers
(IBAN) mod 97; words such as "account" or "ssn" shortly before a span raise
its score, and words such as "order" or "version" lower it.  Base spans of
the four main kinds always stay; a span of another kind needs a score of
``LEAST``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, with the cheap test that must hold, and the pattern.
#: \G or the look-behind lets a match start only where a run of its characters starts or the last match
#: ended; elsewhere a match that starts earlier is always found first.  Possessive runs never backtrack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PATTERNS = {
    "email": ("@", EMAIL),
    "ip": (r"[0-9]\.[0-9]", IP),
    "card": (r"[0-9][\x20-]?[0-9]", CARD),
    "phone": (r"\+[0-9]", PHONE),
    "iban": (r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", IBAN),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", SSN),
}
BASE = ("email", "ip", "card", "phone")
#: Start score, what a passed checksum adds, and words that raise or lower it.
START, CHECKSUM, RAISE, LOWER, LEAST = 0.5, 0.4, 0.3, -0.3, 0.75
RAISING = {
    "email": r"\b(e-?mail|contact|write|kontakt|correo)\b",
    "ip": r"\b(ip|address|host|login)\b",
    "card": r"\b(card|credit|visa|pay|karte|carte|tarjeta)\b",
    "phone": r"\b(phone|call|tel|mobile|telefon)\b",
    "iban": r"\b(iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"\b(ssn|social security|tax id)\b",
}
LOWERING = r"\b(order|invoice|version|serial|part|isbn)\b"
CONTEXT = 40
_CHUNK = 256


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _proposed(text: Column, kind: str) -> Column:
    """Array of (start, match); starts count code points.

    Lengths are summed over chunks first, so the work stays near linear in the number of matches.
    """
    test, pattern = PATTERNS[kind]

    def places(parts: Column) -> Column:
        found, between = parts["found"], parts["between"]
        sizes = F.zip_with(between, found, lambda b, f: F.coalesce(F.length(b), F.lit(0)) + F.coalesce(F.length(f), F.lit(0)))

        def summed(s: Column) -> Column:
            chunks = F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(s) - 1) / F.lit(_CHUNK)).cast("int")), lambda c: _total(F.slice(s, c * _CHUNK + 1, F.lit(_CHUNK))))

            def start(c: Column) -> Column:
                def at(m: Column, i: Column) -> Column:
                    whole = F.floor(i / F.lit(_CHUNK)).cast("int")
                    before = _total(F.slice(c, F.lit(1), whole)) + _total(F.slice(s, whole * _CHUNK + 1, i - whole * _CHUNK))
                    return F.struct((before + F.length(F.get(between, i))).alias("start"), m.alias("match"))

                return F.transform(found, at)

            return _let(chunks, start)

        return _let(sizes, summed)

    none = F.expr("cast(array() as array<struct<start:int,match:string>>)")
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    got = _let(parts, lambda p: F.when(F.size(p["found"]) > 0, places(p)).otherwise(none))
    return F.when(F.regexp_like(text, F.lit(test)), got).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return a + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(compact: Column) -> Column:
    """Whether an account number's letters and digits, first four last, leave 1 modulo 97."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def add(a: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (a * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(add(a, c))) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_like(p, F.lit("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")))
    if kind == "card":
        return _let(_digits(match), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _let(F.replace(match, F.lit(" "), F.lit("")), lambda c: F.when(F.length(c).between(15, 34), mod97(c)).otherwise(False))
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    order = list(PATTERNS).index(kind)
    checked = CHECKSUM if kind in ("card", "iban") else 0.0

    def scored(x: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(F.lit(1), x["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), x["start"])))
        score = F.lit(START + checked) + F.when(F.regexp_like(before, F.lit(RAISING[kind])), RAISE).otherwise(0.0) + F.when(F.regexp_like(before, F.lit(LOWERING)), LOWER).otherwise(0.0)
        return F.struct(
            x["start"].alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["match"])).alias("stop"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("score")
        )

    spans = F.transform(F.filter(_proposed(text, kind), lambda x: _valid(kind, x["match"])), scored)
    return spans if kind in BASE else F.filter(spans, lambda x: x["score"] >= LEAST)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every row.

    Columns: doc_id, spans (array of start, rank, kind, stop, score; code points,
    stop exclusive; by start, then kind).

    Nulls: a null text has no spans; a null doc_id is kept.  Spans of different
    kinds may overlap.  Repeated rows get the same spans.  Empty input gives no
    rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[_spans(text, kind).alias(kind) for kind in PATTERNS])
    return parts.select("doc_id", F.array_sort(F.concat(*PATTERNS)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of base spans, and all spans as text."""
    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    def cut(text: Column, spans: Column) -> Column:
        start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

        def step(a: Column, s: Column) -> Column:
            fresh = F.struct(F.concat(a["done"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("done"), s["stop"].alias("at"))
            return F.when(s["start"] >= a["at"], fresh).otherwise(a)

        return F.aggregate(spans, start, step, lambda a: F.concat(a["done"], F.substring(text, a["at"] + 1, F.length(text))))

    spans = F.array_sort(F.concat(*[_spans(F.col("text"), kind) for kind in PATTERNS]))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), _let(spans, lambda s: F.when(F.size(s) > 0, cut(F.col("text"), s)).otherwise(F.col("text")))))
