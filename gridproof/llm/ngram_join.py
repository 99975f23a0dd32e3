"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence.

The matrix A has a row for each document and a column for each word shingle;
A times its transpose holds the overlaps.  Only columns that two rows or more
have can add to an overlap, so only those are stored.

1. Which pairs to multiply.  Columns are ordered by document frequency, then
   hash.  In that order two rows of n and m columns that link must meet within
   the first ``n - ceil(0.8 n) + 1`` and ``m - ceil(0.8 m) + 1`` of their columns,
   in sizes of ``5 min(n, m) >= 4 max(n, m)``, and with ``4 (n + m) / 9`` stored columns
   left in both from the first meeting on.
2. The product of those pairs runs in column blocks (a block is a set of
   columns, by hash).  A block adds its part of the overlap to the pair's
   count; a pair goes as soon as its count, with all columns of the blocks
   left, can't reach ``4 (n + m) / 9``.  Later blocks are read for what is left only.

Rows of equal sets are one row (a copy links with its class).  Within a column
every row is first paired with one pivot row only, the most central one; pairs of
rows that this already brought into one component need no product.  All others
are paired in a second round, where the bounds of step 1 are part of the join's
key: a row meets only rows of sizes that both rows' bounds allow, and a row with
too few columns left for any partner isn't dealt out at all.  So pages that
share one passage, too short to link them, make no pairs; rows whose bounds do
allow a link are paired each with each, in as many slices as it needs.  No link
between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridproof.llm import packs as pk
from gridproof.llm import textops
from gridproof.llm.components import connected
from gridproof.llm.hot import hot_keys, join_hot
from gridproof.sources.scratch import written

#: Column blocks: the share of all columns in each, in eighths.  A small first one drops most pairs that don't link.
BLOCKS = (1, 2, 5)
#: Larger rows of a cell in one slice of the second round.
SLICE_ROWS = 2000
#: Row classes of each pack.  first and the blocks are null for a row that can't link with another class.
#: met: how many columns any other row has; central: their mean frequency level; b0 and so on: those columns by block.
ROWS = "doc_id long, key long, n_shingles long, sig binary, met long, central double, first array<long>, " + ", ".join(f"b{k} array<long>" for k in range(len(BLOCKS)))
_LONGS = pa.list_(pa.int64())
_ARROW = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("met", pa.int64()), ("central", pa.float64()), ("first", _LONGS), *[(f"b{k}", _LONGS) for k in range(len(BLOCKS))]])


def _sets(pack: pk.Pack, width: int):
    """Shingles of all documents of a pack, their offsets, signatures, and which are first of their set."""
    grams, sizes = [], [np.zeros(1, np.int64)]
    for _, data, offsets in pack.slices():
        g, at = textops.text_shingles(data, offsets, width)
        grams.append(g)
        sizes.append(np.diff(at))
    g, at = np.concatenate([np.zeros(0, np.uint64), *grams]), np.cumsum(np.concatenate(sizes))
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(textops.mix(g, salt), dtype=np.uint64)]) for salt in (1, 2)]
    sigs = np.stack([textops.mix(s[at[1:]] - s[at[:-1]], 3) for s in sums], 1)
    first = np.zeros(len(at) - 1, bool)
    if len(first):
        first[np.unique(sigs, axis=0, return_index=True)[1]] = True
    return g, at, sigs, first & (np.diff(at) > 0)


def _names(g: np.ndarray, at: np.ndarray, first: np.ndarray, bits: int):
    """Distinct shortened shingles of the first rows, their counts, and the row entries' places among them."""
    own = np.repeat(first, np.diff(at))
    names, place, counts = np.unique(g[own] >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
    return names, counts, place, own


def _level(counts: np.ndarray) -> np.ndarray:
    """Document frequency in eighths of a doubling: 0 for 1, and 8 or more for 2 or more."""
    return np.minimum(255, np.rint(8 * np.log2(np.maximum(1, counts)))).astype(np.uint8)


def incidence(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """ROWS of all documents, written."""
    packs = pk.packed(docs, 4 << 20)
    size = pk.sizes(packs)
    # shortened names serve the order of columns only; equal names by chance are ever rarer than one in a thousand
    bits = min(64, max(32, size.words.bit_length() + 10))
    block_of = np.repeat(np.arange(len(BLOCKS)), BLOCKS)

    def keys(pack):
        g, at, _, first = _sets(pack, width)
        names, counts, _, _ = _names(g, at, first, bits)
        return names, counts

    def rows(pack, levels):
        g, at, sigs, first = _sets(pack, width)
        _, _, place, own = _names(g, at, first, bits)
        level = np.zeros(len(g), np.uint8)
        level[own] = levels[place]
        met = np.concatenate([[0], np.cumsum(level > 0)])
        for d in range(len(at) - 1):
            n = int(at[d + 1] - at[d])
            row = {"doc_id": pack.ids[d], "key": pack.keys[d], "n_shingles": n, "sig": sigs[d].tobytes()}
            if first[d] and 100 * (met[at[d + 1]] - met[at[d]]) >= percent * n:
                s, v = g[at[d] : at[d + 1]], level[at[d] : at[d + 1]]
                head = np.lexsort((s, v))[: n - (percent * n + 99) // 100 + 1]
                # a column that no other row has takes its place in the order but can't be met
                row |= {"met": int((v > 0).sum()), "central": float(v.mean()), "first": np.where(v[head] > 0, s[head], 0).astype(np.uint64).view(np.int64)}
                s = s[v > 0]
                block = block_of[(s % np.uint64(len(block_of))).astype(np.int64)]
                row |= {f"b{k}": s[block == k].view(np.int64) for k in range(len(BLOCKS))}
            yield row

    answers = pk.ask(packs, keys, bits, _level, parts=pk.buckets(docs.sparkSession, size.words))
    out = written(pk.answered(packs, answers, rows, ROWS, _ARROW, tasks=pk.buckets(docs.sparkSession, size.packs, pk.PACKS)))
    pk.discard(packs)
    pk.release(docs.sparkSession)
    return out


def _product(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose overlap, summed block by block, reaches the asked share of their union."""
    size = sets.select("sig", "n", F.col("met").alias("left"))
    out = pairs.select("u", "v", F.lit(0).alias("overlap"))
    out = out.join(size.toDF("u", "n", "left_u"), "u").join(size.toDF("v", "m", "left_v"), "v")
    for k in range(len(BLOCKS)):
        a, b = (sets.select(F.col("sig").alias(end), F.col(f"b{k}").alias(block)) for end, block in (("u", "x"), ("v", "y")))
        out = out.join(a, "u").join(b, "v").withColumns({"overlap": F.col("overlap") + F.size(F.array_intersect("x", "y")), "left_u": F.col("left_u") - F.size("x"), "left_v": F.col("left_v") - F.size("y")})
        out = out.drop("x", "y").where(F.expr(f"(100 + {percent}) * (overlap + least(left_u, left_v)) >= {percent} * (n + m)"))
    # after the last block nothing is left, so what stays are links
    return out.select("u", "v")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents that link, one row for each row of ``docs``.

    Columns: doc_id, n_shingles (long, size of the document's set), component_id
    (smallest doc_id reachable by links), class_size (documents with an equal set).
    Two documents link when ``100 * |intersection| >= percent * |union|``.

    Nulls: a null text has no shingles, links with nothing and is its own
    component; a null doc_id is kept as null and never the smallest id unless
    all of its component are null.  Repeated rows are copies.  Empty input gives
    no rows; other columns of ``docs`` are ignored.
    """
    return _labelled(docs, width, percent).select("doc_id", "n_shingles", "component_id", "class_size")


def class_links(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Links found between classes of equal sets, as pairs (doc_id, linked_id) of the smallest doc_id of either class.

    They join every component: documents are in one component of
    ``jaccard_components`` if a path of these pairs, or an equal set, joins
    them.  Pairs inside a component that the path already joins needn't be there.
    Nulls are as in ``jaccard_components``; empty input gives no rows.
    """
    _, classes, links, _ = _linked(docs, width, percent)
    ids = classes.select("sig", "rep")
    return links.join(ids.toDF("u", "a"), "u").join(ids.toDF("v", "b"), "v").select(F.least("a", "b").alias("doc_id"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest("a", "b")).alias("linked_id"))


def _band(size):
    """Sixteenths of a doubling; sizes up to 22 have one each."""
    return F.floor(16 * F.log2(size)).cast("int")


def _roles(cells: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of each column as the smaller and as the larger of a pair: sig, root, n, room, cell.

    Of a pair's two sets of n and m columns, room (what a row has left from the
    column on) bounds the overlap, so ``n + m <= (100 + percent) room / percent`` for
    either room: each row knows the largest partner it can have.  A row that can't have one
    in a role isn't there.  cell hashes the column and both bands of sizes; a row has
    its own band in it and goes to each of the partner's that its bounds allow.
    """
    n = F.col("n")
    top = F.floor((100 + percent) * F.col("room") / percent) - n
    last = F.least(F.floor(100 * n / percent), top)
    least_ = F.ceil(percent * n / 100)
    keep = ("sig", "root", "n", "room")
    small = cells.where(last >= n).select(*keep, "shingle", F.explode(F.sequence(_band(n), _band(last))).alias("b"))
    large = cells.where(top >= least_).select(*keep, "shingle", F.explode(F.sequence(_band(least_), _band(F.least(n, top)))).alias("a"))
    return small.select(*keep, F.xxhash64("shingle", _band(n), "b").alias("cell")), large.select(*keep, F.xxhash64("shingle", "a", _band(n)).alias("cell"))


def _meeting(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v), u < v, of rows in different components that meet in a column with bounds that let them link."""
    mixed = written(cells.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("shingle", "k"))
    hot = hot_keys(mixed, "shingle", "k", _total(mixed, "k"))
    small, large = (written(side) for side in _roles(join_hot(cells, mixed.select("shingle"), "shingle", hot, "left_semi"), percent))
    of = [side.groupBy("cell").agg(F.count("*").alias(f"k{e}"), F.min("root").alias(f"lo{e}"), F.max("root").alias(f"hi{e}")) for e, side in enumerate((small, large))]
    both = written(of[0].join(of[1], "cell").where("least(lo0, lo1) <> greatest(hi0, hi1)").select("cell", (F.col("k0") + F.col("k1")).alias("k"), F.ceil(F.col("k1") / SLICE_ROWS).cast("int").alias("slices")))
    hot = hot_keys(both, "cell", "k", _total(both, "k"))
    small, large = (join_hot(side, both.select("cell", "slices"), "cell", hot) for side in (small, large))
    large = large.withColumn("slice", F.pmod(F.xxhash64("sig"), "slices").cast("int"))
    small = small.select("cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("sig").alias("sig2"), F.col("root").alias("root2"), F.col("n").alias("m"), F.col("room").alias("room2"))
    fits = F.expr(f"100 * m >= {percent} * n and (100 + {percent}) * least(room, room2) >= {percent} * (n + m)")
    met = large.join(small, ["cell", "slice"]).where((F.col("root") != F.col("root2")) & (F.expr("m < n or (m = n and sig2 < sig)")) & fits)
    return met.select(F.least("sig", "sig2").alias("u"), F.greatest("sig", "sig2").alias("v")).distinct()


def _total(counts: DataFrame, n: str) -> int:
    return counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows, their classes of equal sets, links between classes and the root of each class with a link."""
    rows = incidence(docs, width, percent)
    classes = written(rows.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size")))
    one = [F.first(c).alias(c) for c in ("first", *[f"b{k}" for k in range(len(BLOCKS))])]
    sets = written(rows.where("first is not null").groupBy("sig").agg(F.first("n_shingles").alias("n"), F.max("met").alias("met"), F.max("central").alias("central"), *one))
    # what a row has left from a column on: stored columns, as n - met others come first and can't be met
    cells = sets.select("sig", "n", "met", "central", F.posexplode("first").alias("at", "shingle")).where("shingle <> 0").withColumn("room", F.expr("n - at"))
    columns = written(cells.groupBy("shingle").agg(F.max(F.struct("central", "sig", "n")).alias("p"), F.count("*").alias("k")).where("k > 1").select("shingle", F.col("p.sig").alias("u"), F.col("p.n").alias("m"), "k"))
    near = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    pivots = join_hot(cells, columns.drop("k"), "shingle", hot_keys(columns, "shingle", "k", _total(columns, "k")))
    stars = written(pivots.where((F.col("sig") != F.col("u")) & near).select("u", F.col("sig").alias("v")).distinct())
    links = written(_product(stars, sets, percent))
    label = written(connected(links))

    # second round: rows that meet in a column and are still apart
    apart = cells.select("sig", "n", "room", "shingle").join(label.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    more = _meeting(apart, percent).join(stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti")
    links = written(links.unionByName(_product(more, sets, percent)))
    return rows, classes, links, written(connected(links))


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``jaccard_components`` with key, the hash of the text, and root, which names the component (null without words)."""
    rows, classes, _, label = _linked(docs, width, percent)
    roots = written(label.join(classes.select(F.col("sig").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("k")))
    linked = join_hot(label, roots.drop("k"), "root", hot_keys(roots, "root", "k", _total(roots, "k"))).select(F.col("node").alias("sig"), "root", "component")
    of_class = classes.join(linked, "sig", "left").select("sig", "class_size", F.coalesce("root", "sig").alias("root"), F.coalesce("component", "rep").alias("component_id"))
    full = join_hot(rows.where("n_shingles > 0").select("doc_id", "key", "n_shingles", "sig"), of_class, "sig", hot_keys(classes, "sig", "class_size", _total(classes, "class_size"))).drop("sig")
    none = rows.where("n_shingles = 0").select("doc_id", "key", "n_shingles", F.lit(None).cast("binary").alias("root"), F.lit(1).cast("long").alias("class_size"), F.col("doc_id").alias("component_id"))
    return full.unionByName(none)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, of each component the first by doc_id (null last), then by a hash of the text.

    A document is a row, whatever others share its doc_id: rows that share it
    but link with nothing all stay.  Rows equal in doc_id and text are repeats, of
    which one stays, any one if they differ elsewhere.  Rows with a null text or
    without words all stay.  Empty input gives no rows.  All columns and their
    order are kept.
    """
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("i"), F.col("key").alias("k")))
    chosen = _labelled(docs, width, percent).where("root is not null").groupBy("root").agg(one.alias("one")).select("one.i", "one.k")
    rows = docs.select(F.struct("*").alias("d"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    named = F.coalesce(F.regexp_like("d.text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    kept = rows.where(named).join(chosen, F.expr("id <=> i and key = k"), "left_semi").dropDuplicates(["id", "key"])
    return kept.select("d.*").unionByName(rows.where(~named).select("d.*"))


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM words
), cells AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS s FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM cells a JOIN cells b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sets UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node
), classes AS (
  SELECT doc_id, count(*) OVER (PARTITION BY key, CASE WHEN n = 0 THEN doc_id END) AS class_size
  FROM (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS key FROM sets)
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.root) AS component_id, CAST(min(c.class_size) AS BIGINT) AS class_size
FROM sets s JOIN reach r ON r.node = s.doc_id JOIN classes c ON c.doc_id = s.doc_id GROUP BY s.doc_id, len(s.g)
"""
