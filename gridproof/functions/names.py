"""Strings of trackers and inventories: flags, lists, slugs, and name matching."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridproof.functions.exprs import col

#: Words that wrap a dataset's name in front, and behind.
PREFIXES = ("dataset", "datasets", "data", "ds", "folder", "files", "download", "downloads", "input", "inputs", "source", "sources")
SUFFIXES = (
    "dataset", "datasets", "data", "folder", "folders", "file", "files", "archive", "backup", "copy", "copies", "raw", "processed",
    "proc", "final", "latest", "updated", "update", "export", "exports", "deliverable", "delivery",
)
#: A token that names a version, by its form or by itself.
VERSION_PATTERN = r"^(?:v(?:er(?:sion)?)?|rev|r)\d+[a-z]*$|^\d{8}$|^\d{6}$|^\d{4}$"
VERSION_WORDS = ("final", "latest", "new")
#: Texts of a quality column, and of a flag.
YES = ("yes", "y", "true", "1", "high", "suitable")
NO = ("no", "n", "false", "0", "low", "unsuitable")
TRUTHY = ("true", "1", "yes", "y", "t")


#: Blocks with letters that decompose to several: Latin, number forms, and ligatures.
_SPELT = (*range(0x100, 0x250), *range(0x2150, 0x2190), *range(0xFB00, 0xFB07))


@functools.cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition without marks is one ASCII character, and those that are several letters."""
    one, many = {}, {}
    for code in range(0xA0, 0x10000):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if base.isascii() and len(base) == 1:
            one[chr(code)] = base
        elif base.isascii() and base.isalnum() and code in _SPELT:
            many[chr(code)] = base
    return "".join(one), "".join(one.values()), many


def ascii_lower(value) -> Column:
    """Lower case without accents and outer white space, wide letters, signs as digits and ligatures spelt plainly; NULL is empty."""
    old, new, many = _folding()
    text = F.translate(F.coalesce(col(value).cast("string"), F.lit("")), old, new)
    spelt = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    rare = F.regexp_like(text, F.lit("[" + "".join(many) + "]"))
    plain = F.when(rare, F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(spelt, c), c)), "")).otherwise(text)
    return F.trim(F.lower(F.regexp_replace(plain, r"\p{Mn}", "")))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), then), 0)


def tokens(value) -> Column:
    return F.regexp_extract_all(ascii_lower(value), F.lit("[a-z0-9]+"), F.lit(0))


def is_version(token: Column) -> Column:
    return F.regexp_like(token, F.lit(VERSION_PATTERN)) | token.isin(*VERSION_WORDS)


def strip_outer(words: Column) -> Column:
    """Without wrapper words in front, and without wrapper words and versions at the end."""
    front = F.transform(words, lambda t: ~t.isin(*PREFIXES))
    first = F.array_position(front, True).cast("int")
    rest = F.when(first == 0, F.expr("cast(array() as array<string>)")).otherwise(F.slice(words, F.greatest(first, F.lit(1)), F.size(words)))
    back = F.reverse(F.transform(rest, lambda t: ~(t.isin(*SUFFIXES) | is_version(t))))
    last = F.array_position(back, True).cast("int")
    return F.when(last == 0, F.expr("cast(array() as array<string>)")).otherwise(F.slice(rest, F.lit(1), F.greatest(F.lit(0), F.size(rest) - last + 1)))


def contains_run(needle: Column, words: Column) -> Column:
    """Whether an array stands, in order and without gaps, within another; an empty one doesn't."""
    n, m = F.size(needle), F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), m - n + 1))
    return (n > 0) & (n <= m) & F.exists(starts, lambda i: F.slice(words, i, n) == needle)


def name_parts(value) -> Column:
    """Struct of tokens, core (without wrappers), norm and core_norm (joined; core_norm falls back to norm)."""
    def parts(words: Column, core: Column) -> Column:
        norm = F.array_join(words, "")
        return F.struct(words.alias("tokens"), core.alias("core"), norm.alias("norm"), F.when(F.size(core) > 0, F.array_join(core, "")).otherwise(norm).alias("core_norm"))

    return _let(tokens(value), lambda words: _let(strip_outer(words), lambda core: parts(words, core)))


def match_score(code: Column, folder: Column) -> Column:
    """Struct of score and rule for two ``name_parts``; the first rule that holds wins, NULL if none does."""
    def hit(score: int, rule: str) -> Column:
        return F.struct(F.lit(score).alias("score"), F.lit(rule).alias("rule"))

    named = (code["norm"] != "") & (folder["norm"] != "")
    rules = (
        (code["norm"] == folder["norm"], 100, "exact_normalized"),
        (code["core_norm"] == folder["core_norm"], 96, "exact_core"),
        (contains_run(code["core"], folder["tokens"]), 90, "core_token_subsequence"),
        (contains_run(code["tokens"], folder["tokens"]), 88, "token_subsequence"),
        ((F.length(code["core_norm"]) >= 5) & F.contains(folder["core_norm"], code["core_norm"]), 84, "core_substring"),
        ((F.length(code["norm"]) >= 6) & F.contains(folder["norm"], code["norm"]), 82, "normalized_substring"),
        ((F.length(folder["core_norm"]) >= 5) & F.contains(code["core_norm"], folder["core_norm"]), 78, "reverse_core_substring"),
    )
    out = F.when(~named, F.lit(None))
    for holds, score, rule in rules:
        out = out.when(holds, hit(score, rule))
    return out


def code_keys(code: Column) -> Column:
    """Keys of a code's ``name_parts``: every folder that any rule of ``match_score`` gives it shares one with ``folder_keys``."""
    def key(kind: str, value: Column) -> Column:
        return F.concat(F.lit(kind), value)

    firsts = F.array(
        key("n", code["norm"]), key("c", code["core_norm"]), key("t", F.get(code["core"], 0)), key("t", F.get(code["tokens"], 0)),
        F.when(F.length(code["core_norm"]) >= 5, key("g", F.substring(code["core_norm"], 1, 5))), F.when(F.length(code["norm"]) >= 6, key("g", F.substring(code["norm"], 1, 5))),
    )
    return F.array_distinct(F.filter(F.concat(firsts, F.transform(_grams(code["core_norm"]), lambda g: key("r", g))), lambda k: k.isNotNull()))


def folder_keys(folder: Column) -> Column:
    """Keys of a folder's ``name_parts``, see ``code_keys``."""
    def key(kind: str, value: Column) -> Column:
        return F.concat(F.lit(kind), value)

    firsts = F.array(key("n", folder["norm"]), key("c", folder["core_norm"]), F.when(F.length(folder["core_norm"]) >= 5, key("r", F.substring(folder["core_norm"], 1, 5))))
    grams = F.transform(F.concat(_grams(folder["norm"]), _grams(folder["core_norm"])), lambda g: key("g", g))
    return F.array_distinct(F.filter(F.concat(firsts, F.transform(folder["tokens"], lambda t: key("t", t)), grams), lambda k: k.isNotNull()))


def _grams(text: Column) -> Column:
    """All parts of five letters."""
    n = F.length(text)
    return F.when(n >= 5, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 4)), lambda i: F.substring(text, i, F.lit(5)))).otherwise(F.expr("cast(array() as array<string>)"))


def quality_flag(value) -> Column:
    """Exact words first, then any text with "yes", "suitable" or "high"; so "unsuitable for use" is true."""
    def flag(v: Column) -> Column:
        return F.when(v.isin(*YES), True).when(v.isin(*NO), False).otherwise(F.contains(v, F.lit("yes")) | F.contains(v, F.lit("suitable")) | F.contains(v, F.lit("high")))

    return _let(ascii_lower(value), flag)


def truthy(value) -> Column:
    v = F.lower(F.trim(F.coalesce(col(value), F.lit(""))))
    return v.isin(*TRUTHY) | F.coalesce(v.try_cast("double") != 0, F.lit(False))


def pipe_values(value) -> Column:
    """Trimmed parts of a list with bars; blank parts and NULL give none."""
    return F.filter(F.transform(F.split(F.coalesce(col(value), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def sub_area_id(file_name) -> Column:
    """File stem without a closing _aoi in any case."""
    return F.regexp_replace(F.regexp_replace(col(file_name), r"\.[^./]*$", ""), "(?i)_aoi$", "")


def slug(value) -> Column:
    """Signs and blanks to underscores; case stays, as file names keep it."""
    return F.translate(col(value), "- ", "__")


def file_dataset(value) -> Column:
    """A dataset's name as it stands in file names."""
    return F.translate(col(value), "-", "_")


def title(value) -> Column:
    return F.initcap(F.translate(col(value), "-", " "))


def joined_distinct(value) -> Column:
    """Aggregate: trimmed distinct non-blank strings, sorted, with bars between."""
    v = F.trim(col(value))
    return F.array_join(F.array_sort(F.collect_set(F.when(v != "", v))), " | ")


def column_like(columns: list[str], wanted: str) -> str:
    """The column whose name equals ``wanted`` but for case and signs; KeyError if there is none."""
    def plain(s: str) -> str:
        return "".join(c for c in s.lower() if c.isalnum())

    for c in columns:
        if plain(c) == plain(wanted):
            return c
    raise KeyError(wanted)


def url_column(columns: list[str]) -> str:
    """The column "data", else the first whose name holds url, href, path or link."""
    if "data" in columns:
        return "data"
    for c in columns:
        if any(w in c.lower() for w in ("url", "href", "path", "link")):
            return c
    raise KeyError("no column with addresses")
