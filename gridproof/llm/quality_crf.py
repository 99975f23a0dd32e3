"""Line sequence labelling: a linear-chain CRF marks lines as content or boilerplate.

Every line gets binary features from binned shares (symbols, capitals, digits,
stops, repeats, length).  The CRF has a weight for each feature and label and
for each pair of neighbouring labels; it is fitted on a bounded sample of
labelled documents, whose lines take the document's label as a weak one.
Viterbi decoding labels all lines of all documents; the share of words on
content lines, with the base rules, decides retention.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridproof.llm import textops

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?=~^_{}[]\\/@"]] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in ".,;:"]] = True

#: Upper ends of the bins of each share, but the last bin.
_BINS = {
    "symbols": (0.0005, 0.01, 0.03, 0.08),
    "marks": (0.0005, 0.01, 0.04, 0.1),
    "capitals": (0.01, 0.06, 0.15, 0.4),
    "digits": (0.0005, 0.02, 0.1, 0.3),
    "points": (0.0005, 0.01, 0.05, 0.12),
    "mean_word": (2.5, 3.5, 8.0, 12.0),
    "words": (1.5, 4.5, 9.5, 24.5),
    "distinct": (0.3, 0.5, 0.7, 0.9),
    "repeated": (0.5,),
}
N_FEATURES = sum(len(b) + 1 for b in _BINS.values())


def _per(offsets: np.ndarray, mask: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of all \\n-split lines; every text has one at least."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    stops = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    return starts, stops


class Batch:
    """Counts of the texts and of their lines for one slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        starts, ends, doc = textops.spans(data, offsets)
        prefix = textops.prefix_hash(data)
        hashes = textops.range_hash(prefix, starts, ends)
        self.n_words = np.bincount(doc, minlength=n)
        chars = (~textops.SPACE[data]) & ((data & 0xC0) != 0x80)
        self.word_chars = _per(offsets, chars)
        self.n_symbols = _per(offsets, _SYMBOL[data])

        # lines: the k-th line of a text starts after its k-th break
        line_start, line_stop = line_offsets(data, offsets)
        breaks = _per(offsets, data == 10)
        self.n_lines = breaks + 1
        owner = np.repeat(np.arange(n), self.n_lines)
        line_of_word = np.searchsorted(line_start, starts, "right") - 1
        self.line_words = np.bincount(line_of_word, minlength=len(owner))
        key = textops.mix(textops.range_hash(prefix, line_start, line_stop) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 5)
        first = np.zeros(len(key), bool)
        first[np.unique(key, return_index=True)[1]] = True
        repeated = ~first & (self.line_words > 0)
        self.n_dup_lines = np.bincount(owner[repeated], minlength=n)

        grams = textops.runs_hash(hashes, 5)
        whole = doc[: len(grams)] == doc[4:] if len(grams) else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        key = textops.mix(grams[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 6)
        edge = np.zeros(len(doc) + 1, np.int32)
        if len(key):
            _, index, counts = np.unique(key, return_inverse=True, return_counts=True)
            twice = at[counts[index] > 1]
            np.add.at(edge, twice, 1)
            np.add.at(edge, twice + 5, -1)
        self.n_repeat_words = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)

        lines = np.stack([line_start, line_stop])
        shares = self._shares(data, lines, hashes, line_of_word, repeated)
        self.features = np.empty((len(owner), len(_BINS)), np.int32)
        base = 0
        for k, (name, bins) in enumerate(_BINS.items()):
            self.features[:, k] = base + np.searchsorted(np.array(bins), shares[name], "left")
            base += len(bins) + 1
        self.line_at = np.concatenate([[0], np.cumsum(self.n_lines)])

    def _shares(self, data, lines, hashes, line_of_word, repeated):
        def count(mask):
            sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return sums[lines[1]] - sums[lines[0]]

        size, words = np.maximum(1, lines[1] - lines[0]), np.maximum(1, self.line_words)
        letters = count(_LETTER[data])
        kinds = np.unique(textops.mix(hashes + line_of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 7), return_index=True)[1]
        distinct = np.bincount(line_of_word[kinds], minlength=len(size))
        return {
            "symbols": count(_SYMBOL[data]) / size,
            "marks": count(_MARK[data]) / size,
            "capitals": count(_UPPER[data]) / np.maximum(1, letters),
            "digits": count(_DIGIT[data]) / size,
            "points": count(_POINT[data]) / size,
            "mean_word": letters / words,
            "words": self.line_words,
            "distinct": np.where(self.line_words > 0, distinct / words, 1),
            "repeated": repeated,
        }


@dataclass
class Crf:
    """Weights of content (label 1) against boilerplate (label 0)."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(1)

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi labels of one text; of equal paths the one with more content from the end."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b, back = 0.0, 0.0, []
        for k, s in enumerate(scores):
            if k:
                from0, from1 = a + m00 > b + m10, a + m01 > b + m11
                back.append((from0, from1))
                a, b = (a + m00 if from0 else b + m10), (a + m01 if from1 else b + m11)
            b += s
        label = int(b >= a) if scores else 0
        out = [label] if scores else []
        for from0, from1 in reversed(back):
            label = 0 if (from1 if label else from0) else 1
            out.append(label)
        return out[::-1]


def fit(samples: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.2, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam, for (features of lines, labels of lines) of each text."""
    weights, moves = np.zeros(N_FEATURES), np.zeros((2, 2))
    samples = [s for s in samples if len(s[1])]
    if not samples:
        # without labels: all is content
        weights[:] = 1.0
        return Crf(weights, moves)
    longest = sorted(samples, key=lambda s: -len(s[1]))
    size = np.array([len(y) for _, y in longest])
    steps, n = int(size[0]), len(longest)
    active = [int((size > t).sum()) for t in range(steps)]
    at = np.concatenate([[0], np.cumsum(size)])
    x = np.concatenate([f for f, _ in longest])
    y = np.concatenate([v for _, v in longest]).astype(int)
    rows = [at[: active[t]] + t for t in range(steps)]
    known = np.zeros(N_FEATURES)
    np.add.at(known, x[y == 1].ravel(), 1)
    paired = np.zeros((2, 2))
    inner = np.setdiff1d(np.arange(len(y)), at[:-1])
    np.add.at(paired, (y[inner - 1], y[inner]), 1)
    state = [np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)]
    for k in range(1, rounds + 1):
        s = np.zeros((len(y), 2))
        s[:, 1] = weights[x].sum(1)
        forward, backward = np.zeros((len(y), 2)), np.zeros((len(y), 2))
        forward[rows[0]] = s[rows[0]]
        for t in range(1, steps):
            prev = forward[rows[t] - 1]
            forward[rows[t]] = s[rows[t]] + np.logaddexp(prev[:, :1] + moves[0], prev[:, 1:] + moves[1])
        for t in range(steps - 2, -1, -1):
            after = rows[t + 1]
            v = s[after] + backward[after]
            backward[after - 1] = np.logaddexp(v[:, :1] + moves[:, 0], v[:, 1:] + moves[:, 1])
        both = forward + backward
        z = np.logaddexp(both[:, 0], both[:, 1])
        p = np.exp(both[:, 1] - z)
        expected = np.zeros(N_FEATURES)
        np.add.at(expected, x.ravel(), np.repeat(p, x.shape[1]))
        pairs = np.exp(forward[inner - 1][:, :, None] + moves + (s[inner] + backward[inner])[:, None, :] - z[inner][:, None, None]).sum(0)
        grad = np.concatenate([known - expected, (paired - pairs).ravel()]) / n - ridge * np.concatenate([weights, moves.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        step = rate * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-8)
        weights, moves = weights + step[:N_FEATURES], moves + step[N_FEATURES:].reshape(2, 2)
    return Crf(weights, moves)


def train(docs: DataFrame, labels: DataFrame, most: int = 1000) -> Crf:
    """A CRF from at most ``most`` documents of either quality, picked by a hash of doc_id.

    Labels with a null doc_id or quality are ignored; of contradicting labels the
    lower counts, and of rows that share a doc_id the text with the least hash, so
    twice ``most`` texts are collected at most.  Without labels all is content.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids: dict[int, int] = {}
    for quality in (0, 1):
        top = known.where((F.col("quality") > 0) == bool(quality)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids |= {r[0]: quality for r in top.select("doc_id").collect()}

    def lines(batches):
        for batch in batches:
            for _, rows, b in _batches(batch):
                for k, i in enumerate(rows):
                    if i in ids:
                        yield pa.RecordBatch.from_pydict({"doc_id": [i], "f": [b.features[b.line_at[k] : b.line_at[k + 1]].ravel().tobytes()]}, pa.schema([("doc_id", pa.int64()), ("f", pa.binary())]))

    picked = docs.where(F.col("doc_id").isin(list(ids)) & F.col("text").isNotNull()) if ids else docs.limit(0)
    one = picked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = one.mapInArrow(lines, "doc_id long, f binary").collect()
    # in order, so that reruns agree
    samples = []
    for r in sorted(found, key=lambda r: (r["doc_id"], bytes(r["f"]))):
        f = np.frombuffer(r["f"], np.int32).reshape(-1, len(_BINS))
        samples.append((f, np.full(len(f), ids[r["doc_id"]])))
    return fit(samples)


def _batches(batch: pa.RecordBatch):
    """(first row, ids, Batch) of slices of a batch of (doc_id, text)."""
    data, offsets = textops.column_bytes(batch.column(1))
    ids = batch.column(0).to_pylist()
    for a, b in textops.slices(offsets):
        lo = offsets[a]
        yield a, ids[a:b], Batch(data[lo : offsets[b]], offsets[a : b + 1] - lo)


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(batch: pa.RecordBatch, model: Crf, share: float) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("doc_id", *_NAMES, "base_failed", "content_words", "kept")}
    for _, ids, b in _batches(batch):
        scores = model.scores(b.features)
        content = np.zeros(len(scores), bool)
        for k in range(len(ids)):
            lo, hi = b.line_at[k], b.line_at[k + 1]
            content[lo:hi] = model.decode(scores[lo:hi].tolist())
        words = np.add.reduceat(np.where(content, b.line_words, 0), b.line_at[:-1]) if len(ids) else np.zeros(0)
        failed = (b.n_words < 10) | (100 * b.n_repeat_words > 20 * b.n_words)
        out["doc_id"] += ids
        for name in _NAMES:
            out[name] += getattr(b, name).tolist()
        out["base_failed"] += failed.tolist()
        out["content_words"] += words.tolist()
        out["kept"] += (~failed & (words >= share * b.n_words)).tolist()
    return out


def judge(docs: DataFrame, model: Crf, share: float = 0.5) -> DataFrame:
    """Counts and verdict for each document; ``content_words`` stand on lines labelled content.

    Nulls: a null text has no words and fails the base rules; a null doc_id is
    kept as null.  Repeated rows are judged alike.  Empty input gives no rows;
    other columns are ignored.
    """
    fields = [("doc_id", pa.int64()), *((k, pa.int64()) for k in _NAMES), ("base_failed", pa.bool_()), ("content_words", pa.int64()), ("kept", pa.bool_())]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict(_judged(batch, model, share), pa.schema(fields))

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in _NAMES) + ", base_failed boolean, content_words long, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def keep(docs: DataFrame, model: Crf, share: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that ``judge`` keeps, with all their columns, in one pass without a shuffle.

    Nulls: rows with a null text go, as they have no words; a null doc_id plays no
    part.  Repeated rows stay or go together.  Empty input gives no rows.
    """
    at = [docs.columns.index("doc_id"), docs.columns.index("text")]

    def run(batches):
        for batch in batches:
            two = pa.RecordBatch.from_arrays([batch.column(k) for k in at], ["doc_id", "text"])
            yield batch.filter(pa.array(_judged(two, model, share)["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
