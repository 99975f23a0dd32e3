"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

Document frequencies, mean length and passage length are those of all items.
A word's impact on an item is its BM25 weight over the item's own best score, so
1 means that all its words are there and one threshold serves all items.
Postings are cut into parts of bounded size, which changes nothing in any score,
and items of a part into blocks of a few.  Parts are built by tasks and written;
a pass over the documents takes some parts with it, so what is broadcast at once
has a bound whatever the number of items.

Every document is cut into half passages as long as the longest item; each two
neighbours form a passage, so an item copied anywhere lies within one.  Each
passage is a query.  The largest impact of a word in a block bounds what the
block can score; bounds of a slice of passages are summed in numpy, and only
blocks that can reach the threshold are searched, document at a time, with WAND
pivots.  Retrieved items are verified on whole text: the five-word shingles of
the question and the words of the answer must be found in the passage.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridproof.llm import textops
from gridproof.llm.hot import hot_keys, join_hot
from gridproof.sources.scratch import written

K1, B = 1.2, 0.75
#: Item bytes of one part of the index, whose bounds are a dense table of words by blocks, and parts searched in one
#: pass, 4 MB of items.  More items make further passes over the documents.
PART_BYTES = 128 << 10
PASS_PARTS = 32


_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts without ASCII signs at their ends, and their text index.

    Words of signs alone are left out, so marks strewn between words don't hide a passage.
    """
    data = textops.lower_ascii(data)
    starts, ends, doc = textops.spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), doc
    at = np.arange(len(data))
    solid = ~_SIGN[data]
    after = np.minimum.accumulate(np.where(solid, at, len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, at, -1))
    starts = np.minimum(after[starts], ends)
    ends = np.maximum(before[ends - 1] + 1, starts)
    keep = ends > starts
    return textops.range_hash(textops.prefix_hash(data), starts[keep], ends[keep]), doc[keep]


def split_item(n_words: int) -> int:
    """Where an item without fields of its own parts: the last fifth of its words, three at least, is the answer."""
    return max(0, n_words - max(3, n_words // 5))


@dataclass
class Block:
    """Some items: postings of each word, sorted by item."""

    first: int
    postings: dict[int, tuple[np.ndarray, np.ndarray]]
    top: dict[int, float]


@dataclass
class Index:
    """Item ids, their words in order, and blocks of postings over numbered words."""

    items: list
    words: list[np.ndarray]
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    bounds: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    blocks: list[Block] = field(default_factory=list)
    longest: int = 1

    @classmethod
    def build(cls, items: list, words: list[np.ndarray], df: list[np.ndarray], n: int, mean: float, longest: int, per_block: int = 8) -> Index:
        """A part with some items, the frequency of each of their words among all ``n`` items, and all items' mean and greatest length."""
        index = cls(items, words, longest=longest)
        size = np.array([len(w) for w in words], float)
        h, doc = np.concatenate([np.zeros(0, np.uint64), *words]), np.repeat(np.arange(len(items)), size.astype(int))
        index.vocabulary, first = np.unique(h, return_index=True)
        frequency = np.concatenate([np.zeros(0), *df])[first]
        pairs, tf = np.unique(np.stack([doc, np.searchsorted(index.vocabulary, h)], 1), axis=0, return_counts=True) if len(h) else (np.zeros((0, 2), np.int64), np.zeros(0))
        item, term = pairs[:, 0], pairs[:, 1]
        idf = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / mean))
        best = np.bincount(item, weight, minlength=len(items))
        impact = weight / np.maximum(1e-12, best[item])
        n_blocks = -(-len(items) // per_block)
        index.bounds = np.zeros((len(index.vocabulary), n_blocks), np.float32)
        np.maximum.at(index.bounds, (term, item // per_block), impact.astype(np.float32))
        # float32 may round down
        index.bounds *= np.float32(1.00001)
        for b in range(n_blocks):
            own = np.flatnonzero(item // per_block == b)
            order = own[np.lexsort((item[own], term[own]))]
            cut = np.flatnonzero(np.diff(term[order])) + 1
            groups = np.split(order, cut) if len(order) else []
            postings = {int(term[g[0]]): (item[g], impact[g]) for g in groups}
            index.blocks.append(Block(b * per_block, postings, {t: float(w.max()) for t, (_, w) in postings.items()}))
        return index


def wand(block: Block, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items of a block that the words score at least ``threshold``, by document-at-a-time pivots."""
    lists = [[block.postings[t][0], block.postings[t][1], 0, block.top[t]] for t in terms if t in block.postings]
    found = []
    # sums in another order may differ in the last digits
    goal = threshold - 1e-9
    while lists:
        lists.sort(key=lambda x: x[0][x[2]])
        bound, pivot = 0.0, -1
        for k, x in enumerate(lists):
            bound += x[3]
            if bound >= goal:
                pivot = k
                break
        if pivot < 0:
            break
        item = lists[pivot][0][lists[pivot][2]]
        if lists[0][0][lists[0][2]] == item:
            score = 0.0
            for x in lists:
                if x[0][x[2]] == item:
                    score += float(x[1][x[2]])
                    x[2] += 1
            if score >= goal:
                found.append((int(item), score))
        else:
            for x in lists[:pivot]:
                x[2] += int(np.searchsorted(x[0][x[2] :], item))
        lists = [x for x in lists if x[2] < len(x[0])]
    return found


def _shingled(words: np.ndarray, width: int = 5) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(textops.runs_hash(words, min(width, len(words))))


def overlaps(item: np.ndarray, passage: np.ndarray) -> tuple[float, float]:
    """Shares of the item's question shingles and of its answer words that the passage has."""
    at = split_item(len(item))
    question, answer = item[:at], np.unique(item[at:])
    shingles = _shingled(question)
    width = min(5, max(1, len(question)))
    asked = float(np.isin(shingles, _shingled(passage, width)).mean()) if len(shingles) and len(passage) >= width else float(not len(shingles))
    told = float(np.isin(answer, passage).mean()) if len(answer) else 0.0
    return asked, told


def search(some: list[Index], data: np.ndarray, offsets: np.ndarray, threshold: float, question: float, answer: float) -> list[tuple[int, object, int, float, float, float]]:
    """(text, item_id, first word of the passage, score, overlaps) of verified items of all indexes, each text and item once."""
    h, doc = word_hashes(data, offsets)
    return [(d, index.items[item], *more) for index in some for d, item, *more in _search(index, h, doc, len(offsets) - 1, threshold, question, answer)]


def _search(index: Index, h: np.ndarray, doc: np.ndarray, n_texts: int, threshold: float, question: float, answer: float) -> list[tuple]:
    if not len(h) or not len(index.vocabulary):
        return []
    term = np.minimum(np.searchsorted(index.vocabulary, h), len(index.vocabulary) - 1)
    known = np.flatnonzero(index.vocabulary[term] == h)
    if not len(known):
        return []
    first_word = np.searchsorted(doc, np.arange(n_texts), "left")
    inner = np.arange(len(doc)) - first_word[doc]
    # half passages, numbered through the slice with a free number after each text
    halves = -(-np.bincount(doc, minlength=n_texts) // index.longest)
    half_at = np.concatenate([[0], np.cumsum(halves + 1)])
    half = half_at[doc] + inner // index.longest
    pair = np.unique(half[known].astype(np.int64) * len(index.vocabulary) + term[known])
    half_of, term_of = pair // len(index.vocabulary), pair % len(index.vocabulary)
    new = np.flatnonzero(np.concatenate([[True], half_of[1:] != half_of[:-1]]))
    sums = np.zeros((half_at[-1] + 1, index.bounds.shape[1]), np.float32)
    for at in range(0, len(new), 4096):
        part = new[at : at + 4096]
        stop = new[at + 4096] if at + 4096 < len(new) else len(pair)
        sums[half_of[part]] = np.add.reduceat(index.bounds[term_of[part[0] : stop]], part - part[0], 0)
    passage = sums[:-1] + sums[1:]
    best: dict[tuple[int, int], tuple] = {}
    stops = np.append(new, len(pair))
    where = {int(v): k for k, v in enumerate(half_of[new])}
    for p, b in zip(*np.nonzero(passage >= np.float32(threshold * 0.9999)), strict=True):
        d = int(np.searchsorted(half_at, p, "right")) - 1
        terms = set()
        for side in (p, p + 1):
            k = where.get(int(side))
            if k is not None:
                terms.update(term_of[stops[k] : stops[k + 1]].tolist())
        lo = first_word[d] + (p - half_at[d]) * index.longest
        hi = min(lo + 2 * index.longest, first_word[d] + np.searchsorted(doc[first_word[d] :], d, "right"))
        for item, score in wand(index.blocks[b], sorted(terms), threshold):
            asked, told = overlaps(index.words[item], h[lo:hi])
            if asked >= question and told >= answer:
                row = (d, item, int(lo - first_word[d]), score, asked, told)
                if (d, item) not in best or (asked, told) > best[d, item][4:]:
                    best[d, item] = row
    return [best[k] for k in sorted(best)]


def _item_words(batches):
    for batch in batches:
        h, doc = word_hashes(*textops.column_bytes(batch.column(1)))
        at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        words = [h[at[k] : at[k + 1]].view(np.int64) for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.list_(pa.int64()))], ["item_id", "size", "words"])


def index_parts(benchmark: DataFrame) -> DataFrame:
    """(part, data): the index of all items that have words, in written parts of about PART_BYTES of items."""
    items = benchmark.select(F.col("item_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    items = written(items.mapInArrow(_item_words, "item_id long, size long, words array<long>"))
    n, total, words, longest = items.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.size("words")), F.lit(0)), F.coalesce(F.max(F.size("words")), F.lit(0))).first()
    longest, mean = max(5, longest), max(1.0, words / max(1, n))
    # rows as read from the written table keep their numbers; repeated items are items of their own
    items = written(items.where(F.size("words") > 0).withColumn("row", F.monotonically_increasing_id()))
    df = written(items.select(F.explode(F.array_distinct("words")).alias("h")).groupBy("h").agg(F.count("*").alias("df")))
    told = join_hot(items.select("row", F.posexplode("words").alias("pos", "h")), df, "h", hot_keys(df, "h", "df", words)).groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "df"))), lambda x: x["df"]).alias("df"))
    parts = max(1, -(-int(total) // PART_BYTES))
    known = items.join(told, "row").withColumn("part", F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["words"]))
        index = Index.build([r["item_id"] for r in rows], [np.array(r["words"], np.int64).view(np.uint64) for r in rows], [np.array(r["df"], float) for r in rows], n, mean, longest)
        return pa.Table.from_pylist([{"part": rows[0]["part"], "data": pickle.dumps(index)}], pa.schema([("part", pa.int32()), ("data", pa.binary())]))

    return written(known.select("part", "item_id", "words", "df").groupBy("part").applyInArrow(build, "part int, data binary"))


def _passes(benchmark: DataFrame) -> Iterator[list[bytes]]:
    """The parts of each pass over the documents; one pass at a time is in memory."""
    parts = index_parts(benchmark)
    numbers = [r["part"] for r in parts.select("part").orderBy("part").collect()]
    for k in range(0, len(numbers), PASS_PARTS):
        some = numbers[k : k + PASS_PARTS]
        yield [bytes(r["data"]) for r in parts.where(F.col("part").between(some[0], some[-1])).orderBy("part").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.8, answer: float = 0.8) -> DataFrame:
    """One row for each document and test item found in it.

    Columns: doc_id, item_id, passage (first word of the best passage, by words with a letter or digit), score
    (share of the item's best BM25 score), question_overlap, answer_overlap.

    Nulls: null texts and items without words find nothing; null ids are kept.
    Repeated rows are found alike.  Items with equal texts are all found.  Empty
    tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    fields = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("passage", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]
    schema = "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double"
    found = []
    for some in _passes(benchmark):

        def run(batches, some=some):
            some = [pickle.loads(x) for x in some]
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                data, offsets = textops.column_bytes(batch.column(1))
                for a, b in textops.slices(offsets):
                    for d, item, at, score, asked, told in search(some, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], threshold, question, answer):
                        rows.append((ids[a + d], item, at, score, asked, told))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

        if found:
            # the last pass stays lazy; the parts of earlier ones are let go
            found[-1] = written(found[-1])
        found.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.8, answer: float = 0.8) -> DataFrame:
    """Rows of ``docs`` without any test item, with all their columns, without a shuffle.

    Nulls: rows with a null text hold no item and stay; ids play no part.
    Repeated rows go or stay together.  Items without words are in no document;
    an empty benchmark keeps all rows, and empty ``docs`` give none.
    """
    at = docs.columns.index("text")
    for some in _passes(benchmark):

        def run(batches, some=some):
            some = [pickle.loads(x) for x in some]
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                data, offsets = textops.column_bytes(batch.column(at))
                for a, b in textops.slices(offsets):
                    clean[[a + r[0] for r in search(some, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], threshold, question, answer)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
