"""Line dedup: winnowing over line hashes.

The lines of a document are its \\n-split lines with a word, trimmed.

1. Select.  Of each ``window`` neighbouring lines the first of the smallest hashes
   is selected, so two equal runs of that length always select the same line.
   A selected line is kept once, with the hashes around it.
2. Join positions.  Selected lines whose hash is met at no other place end here.
3. Extend.  Each position left is extended both ways to the windows that
   selected it, and met with the first place of the same lines: what stood
   earlier, in a document with a smaller doc_id or further up, stays, and the
   position's run is a later repeat.
4. Delete.  Overlapping runs of a document merge, so a repeat of any length goes whole.

A document of fewer lines is one window by itself and meets only documents with
the same lines.  A line of at least ``line_words`` words is a fingerprint by itself
too: it meets every equal line, whatever its neighbours and however many lines
either document has, and each but the first goes.

Only hashes and places are shuffled for the search.  Counts and first places
are minima, aggregated before the shuffle.  A fingerprint or a run that more than
one in 200 places has is no shuffle key: there are fewer than 200 such, and they
are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridproof.llm.hot import hot_keys, join_hot
from gridproof.sources.scratch import written

#: The white space that is trimmed and that makes no word.
_BLANK = " \t\n\v\f\r"
#: Words from which a line is compared by itself.
LINE_WORDS = 20


#: Kinds of fingerprints: of a window, of a whole document of fewer lines, and of a long line.
_WINDOW, _SHORT, _LONG = 0, 1, 2


def fingerprints(docs: DataFrame, window: int, line_words: int | None) -> DataFrame:
    """(id, key, kind, pos, at, h, own, fingerprint) of every selected line.

    pos counts lines with a word.  h and own hold the hashes and the numbers
    among all lines of the lines that windows with this one can have; at is its
    place among them.  key is the text's hash.
    """
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(_BLANK)).alias("t")))

    def counted(t):
        """Whether a trimmed line has that many words; a text shorter than so many letters and blanks needs no split."""
        return F.lit(False) if line_words is None else (F.length(t) >= 2 * line_words - 1) & (F.size(F.split(t, r"[\x20\x09-\x0D]+", line_words)) >= line_words)

    kept = F.transform(F.filter(line, lambda x: x["t"] != ""), lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["t"]).alias("h"), counted(x["t"]).alias("long")))
    base = docs.where("text is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), kept.alias("lines"))
    hashes = F.transform("lines", lambda x: x["h"])
    base = base.select("id", "key", hashes.alias("h"), F.transform("lines", lambda x: x["i"]).alias("i"), F.transform("lines", lambda x: x["long"]).alias("long"))
    n = F.size("h")
    # a short document is one window as long as it is, selected by its first line's place
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), n - window)), lambda k: (k < n) & (n >= window))
    selected = F.array_distinct(F.transform(starts, lambda k: F.struct((k + _least(F.slice("h", k + 1, window))).alias("pos"), F.lit(_WINDOW).alias("kind"))))
    short = F.when((n > 0) & (n < window), F.array(F.struct(F.lit(0).alias("pos"), F.lit(_SHORT).alias("kind")))).otherwise(F.array().cast("array<struct<pos:int,kind:int>>"))
    singles = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1)), lambda k: F.coalesce(F.get("long", k), F.lit(False))), lambda k: F.struct(k.alias("pos"), F.lit(_LONG).alias("kind")))
    every = F.concat(selected, short) if line_words is None else F.concat(selected, short, singles)
    # outer, as an inner one makes Spark filter by the array's size, which computes all of the above twice
    at = base.select("id", "key", "h", "i", F.explode_outer(every).alias("s")).where("s is not null").select("id", "key", "h", "i", "s.*")
    first = F.when(F.col("kind") == _WINDOW, F.greatest(F.lit(0), F.col("pos") - (window - 1))).otherwise(F.col("pos"))
    length = F.when(F.col("kind") == _LONG, 1).otherwise(F.col("pos") - first + window)
    part, own = F.slice("h", first + 1, length), F.slice("i", first + 1, length)
    print_ = F.when(F.col("kind") == _WINDOW, F.get("h", F.col("pos"))).otherwise(F.xxhash64(part, "kind"))
    return at.select("id", "key", "kind", "pos", (F.col("pos") - first).alias("at"), part.alias("h"), own.alias("own"), print_.alias("fingerprint"))


def _least(hashes):
    """Place of the first of the smallest values."""
    return F.array_position(hashes, F.array_min(hashes)).cast("int") - 1


def _extended(positions: DataFrame, window: int) -> DataFrame:
    """(id, key, pos, own, content): each position with every run of lines around it that selected it."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("h") - window)), lambda k: (k + window <= F.size("h")) & (k + _least(F.slice("h", k + 1, window)) == F.col("at")))
    runs = F.transform(starts, lambda k: F.struct(k.alias("from"), F.lit(window).alias("n")))
    whole = F.array(F.struct(F.lit(0).alias("from"), F.size("h").alias("n")))
    at = positions.withColumn("r", F.explode(F.when(F.col("kind") == _WINDOW, runs).otherwise(whole)))
    own, content = F.slice("own", F.col("r.from") + 1, F.col("r.n")), F.xxhash64(F.slice("h", F.col("r.from") + 1, F.col("r.n")), "kind")
    return at.select("id", "key", (F.col("pos") - F.col("at") + F.col("r.from")).alias("pos"), own.alias("own"), content.alias("content"))


def _place(df: DataFrame):
    """Order of places: by doc_id, nulls last, then text and line."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"), F.col("pos").alias("pos"))


def repeated_lines(docs: DataFrame, window: int = 2, line_words: int | None = LINE_WORDS) -> DataFrame:
    """(id, key, gone): numbers of the lines to delete, for each document that has any. key is the text's hash."""
    selected = written(fingerprints(docs, window, line_words))
    met = selected.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    hot = hot_keys(met, "fingerprint", "n", selected.count())
    runs = written(_extended(join_hot(selected, met.select("fingerprint"), "fingerprint", hot, "left_semi"), window))
    first = runs.groupBy("content").agg(F.min(_place(runs)).alias("first"), F.count("*").alias("n")).where("n > 1")
    hot = hot_keys(first, "content", "n", runs.count())
    later = join_hot(runs, first.select("content", "first"), "content", hot).where(_place(runs) != F.col("first"))
    return later.groupBy("id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("gone"))


def _rest(docs: DataFrame, window: int, line_words: int | None) -> DataFrame:
    """d (the row as a struct), text (shortened), n_lines, n_removed."""
    gone = repeated_lines(docs, window, line_words)
    rows = docs.select(F.struct("*").alias("d"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("k"))
    left = rows.join(gone, F.expr("i <=> id") & (F.col("k") == F.col("key")), "left").select("d", "gone")
    # runs of lines between deleted ones: each slice is cut once, so the work grows with the text, not with its square
    lines, ends = F.split("d.text", "\n"), F.concat(F.array(F.lit(-1)), "gone", F.array(F.size(F.split("d.text", "\n"))))
    left = left.withColumn("lines", lines).withColumn("ends", ends)
    between = F.zip_with(F.slice("ends", 1, F.size("ends") - 1), F.slice("ends", 2, F.size("ends") - 1), lambda a, b: F.slice("lines", a + 2, b - a - 1))
    rest = F.array_join(F.flatten(between), "\n")
    text = F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(rest)
    return left.select("d", text.alias("text"), F.coalesce(F.greatest(F.lit(0), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.greatest(F.lit(0), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"))


def _columns(docs: DataFrame, replaced: dict) -> list:
    return [replaced[c].alias(c) if c in replaced else F.col(f"d.`{c}`") for c in docs.columns]


def dedup_lines(docs: DataFrame, window: int = 2, line_words: int | None = LINE_WORDS) -> DataFrame:
    """``docs`` without later repeats of runs of at least ``window`` lines and of lines of at least ``line_words`` words, and two columns more.

    With ``line_words`` None only runs count.

    n_lines counts all lines of the input text, n_removed those deleted; columns of
    ``docs`` with these names are replaced, all others stay as they are.

    Nulls: a null text stays null with 0 and 0; rows with a null doc_id come
    after all others.  Blank lines are never deleted and don't part a run.  Rows
    with the same doc_id and text are one document and share its fate.  Empty
    input gives no rows.
    """
    own = {"text": F.col("text"), "n_lines": F.col("n_lines"), "n_removed": F.col("n_removed")}
    more = [F.col(c) for c in ("n_lines", "n_removed") if c not in docs.columns]
    return _rest(docs, window, line_words).select(*_columns(docs, own), *more)


def keep_rest(docs: DataFrame, window: int = 2, line_words: int | None = LINE_WORDS, least_percent: int = 0) -> DataFrame:
    """``docs`` with the shortened texts, and n_chars, where there is one, to match; documents that lost all their words go.

    With ``least_percent``, so do those that keep a smaller percentage of their
    words: nearly all that they say stands earlier, and what is left of such a near
    copy is too little to be found as one.  A document that lost no line never goes.

    Nulls, ties and repeats are as in ``dedup_lines``: a null text stays null, rows
    with a null doc_id come after all others, rows with the same doc_id and text
    share their fate.  A text that had no words before stays.  Empty input gives
    no rows.  All columns and their order are kept; a null n_chars stays null
    unless the text was shortened.
    """
    found = _rest(docs, window, line_words)
    empty = (F.col("n_removed") > 0) & ~F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    words = [F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long") for t in ("text", "d.text")]
    little = (F.col("n_removed") > 0) & (100 * words[0] < least_percent * words[1]) if least_percent else F.lit(False)
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("d.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.where(~F.coalesce(empty | little, F.lit(False))).select(*_columns(docs, own))


ORACLE = """
WITH lines AS (
  SELECT doc_id AS id, u.i - 1 AS line, trim(u.t, E' \\t\\n\\x0B\\x0C\\r') AS t
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i) u
), kept AS (
  SELECT id, line, t, row_number() OVER (PARTITION BY id ORDER BY line) AS pos, count(*) OVER (PARTITION BY id) AS n
  FROM lines WHERE t <> ''
), windows AS (
  SELECT a.id, a.pos, a.line AS line, CASE WHEN a.n < 2 THEN a.line ELSE b.line END AS line2,
         CASE WHEN a.n < 2 THEN 'short' || chr(10) || a.t ELSE a.t || chr(10) || b.t END AS content
  FROM kept a LEFT JOIN kept b ON a.id = b.id AND b.pos = a.pos + 1
  WHERE b.id IS NOT NULL OR a.n < 2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY id, pos) AS k FROM windows
), gone AS (
  SELECT DISTINCT id, line FROM (SELECT id, line FROM ranked WHERE k > 1 UNION ALL SELECT id, line2 FROM ranked WHERE k > 1)
), rest AS (
  SELECT l.id, string_agg(raw.t, chr(10) ORDER BY l.line) AS text
  FROM lines l
  JOIN (SELECT doc_id AS id, u.i - 1 AS line, u.t FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i) u) raw
    ON raw.id = l.id AND raw.line = l.line
  LEFT JOIN gone g ON g.id = l.id AND g.line = l.line
  WHERE g.id IS NULL GROUP BY l.id
)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed,
       md5(coalesce(r.text, '')) AS kept_md5
FROM documents d LEFT JOIN rest r ON r.id = d.doc_id
LEFT JOIN (SELECT id, count(*) AS n FROM gone GROUP BY id) c ON c.id = d.doc_id
"""

#: The same with long lines by themselves; ORACLE stays as it is.
ORACLE_LONG_LINES = ORACLE.replace(
    "), gone AS (",
    """), firsts AS (
  SELECT id, line, row_number() OVER (PARTITION BY t ORDER BY id, pos) AS k FROM kept WHERE len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) >= 20
), gone AS (""",
).replace("SELECT id, line2 FROM ranked WHERE k > 1)", "SELECT id, line2 FROM ranked WHERE k > 1 UNION ALL SELECT id, line FROM firsts WHERE k > 1)")
