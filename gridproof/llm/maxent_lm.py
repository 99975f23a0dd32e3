"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context).

The class softmax has a bias and three hashed features: the previous word, the
word before it (skip), and both (n-gram).  Frequent words are classes of their
own or share one with words as frequent; all others fall into classes by their
last two bytes.  Its weights are few and of a fixed size.

Within a class the softmax has a base share for each word, (count + 1) / (counts +
words + 1) in a tail class with one slot for the unknown, and one feature for
each pair of previous word and word that the corpus holds.  Their number grows
with the corpus; their weights live in the buckets of ``packs``, never in one
place.  The constraint of such a feature is its count, smoothed by the base share
as often as the context has different successors in the class; as a pair touches
no other context, the weight that meets it is in closed form,
``log((n(prev, word) + t * share) / ((n(prev) + t) * share))``, and the normaliser is 1.

Counts and gradients cover every training token.  Documents are dealt to training
parts by a hash, so the model does not depend on the input's partitions.  Each
part makes Adagrad steps over its packs from common weights; the weights are then
averaged by tokens, in two levels so that no group holds all parts.  Scoring
gathers weights for batches of tokens in numpy.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridproof.llm import packs as pk
from gridproof.llm import textops
from gridproof.sources.scratch import written

TAILS = 16
END = np.uint64(0xE0D0_E0D0_E0D0_E0D0 | (TAILS - 1))
_NONE = np.uint64(0x5EED)
#: Bits of a pair's key that tell the word; the others tell the previous word and the class.
WORD_BITS = 28
#: Bytes of text whose documents train together.
PART_BYTES = 32 << 20


@dataclass(frozen=True)
class Shape:
    """Sizes of the class softmax; none grows with the data."""

    singles: int = 20
    shared: int = 4
    shared_words: int = 48
    buckets: int = 4096
    batch: int = 8192
    rate: float = 0.25
    rounds: int = 1

    @property
    def head(self) -> int:
        return self.singles + self.shared * self.shared_words

    @property
    def classes(self) -> int:
        return self.singles + self.shared + TAILS


def held_out(doc_id) -> bool:
    """Documents with crc32(doc_id as text) mod 7 = 2; a null doc_id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word keys in order with an end after each text, and their text index.  The low bits of a key tell its tail class."""
    data = textops.lower_ascii(data)
    starts, ends, doc = textops.spans(data, offsets)
    n = len(offsets) - 1
    keys = np.empty(len(starts) + n, np.uint64)
    own = np.arange(len(starts)) + doc
    if len(starts):
        # the last two bytes, which tell endings and languages apart
        pair = data[ends - 1].astype(np.uint64) + np.where(ends - starts > 1, data[ends - 2], 0).astype(np.uint64) * np.uint64(256)
        tail = (textops.mix(pair, 14) % np.uint64(TAILS)).astype(np.int64)
    else:
        tail = np.zeros(0, np.int64)
    keys[own] = textops.range_hash(textops.prefix_hash(data), starts, ends) & np.uint64(2**64 - TAILS) | tail.astype(np.uint64)
    last = np.cumsum(np.bincount(doc, minlength=n) + 1) - 1
    keys[last] = END
    owner = np.empty(len(keys), np.int64)
    owner[own], owner[last] = doc, np.arange(n)
    return keys, owner


#: A pack with its tokens in place of the texts: distinct keys with counts as ``packs.cut`` has them, tokens of each document, and each token's key by its rank.
TOKENS = "pack_id long, ids array<long>, n_words long, n_bytes long, words struct<n: long, width: int, keys: binary, counts: binary>, lengths binary, ranks binary"
_TOKENS = pa.schema(
    [("pack_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_words", pa.int64()), ("n_bytes", pa.int64())]
    + [("words", pa.struct([("n", pa.int64()), ("width", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])), ("lengths", pa.binary()), ("ranks", pa.binary())]
)


def _by_count(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts, kind="stable")


def token_columns(data: bytes, offsets: np.ndarray) -> dict:
    """Columns of TOKENS for the texts of a pack.  Ranks by count go byte by byte, high bytes being mostly zero."""
    parts = [(first, *tokens(d, o)) for first, d, o in pk.text_slices(np.frombuffer(data, np.uint8), offsets)]
    names, index, counts = np.unique(np.concatenate([k for _, k, _ in parts]), return_inverse=True, return_counts=True)
    lengths = np.bincount(np.concatenate([first + owner for first, _, owner in parts]), minlength=len(offsets) - 1)
    rank = np.empty(len(names), np.uint32)
    rank[_by_count(counts)] = np.arange(len(names))
    (words,) = pk.cut(0, names, counts, 64, 1)
    return {
        "n_words": len(index) - len(lengths),
        "words": {x: words[x] for x in ("n", "width", "keys", "counts")},
        "lengths": lengths.astype(np.int64).tobytes(),
        "ranks": pk.squeeze(rank[index].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()),
    }


class Tokens:
    """Tokens of one pack: sorted distinct keys (``names``), each token's place among them (``index``) and its document (``owner``)."""

    def __init__(self, row: dict):
        self.pack_id, self.ids = row["pack_id"], row["ids"]
        self.names = pk.join_keys(row["words"], 64, 1)
        rank = np.ascontiguousarray(np.frombuffer(pk.expand(row["ranks"]), np.uint8).reshape(4, -1).T).view("<u4")[:, 0]
        self.index = _by_count(pk.widened(pk.expand(row["words"]["counts"])))[rank]
        self.owner = np.repeat(np.arange(len(self.ids)), np.frombuffer(row["lengths"], np.int64))

    def used(self) -> np.ndarray:
        """Which tokens are trained on."""
        return np.array([not held_out(x) for x in self.ids])[self.owner]

    def before(self, steps: int) -> np.ndarray:
        """Place among the names of the token some steps before each in its text; one past the last for none."""
        out = np.full(len(self.index), len(self.names))
        same = self.owner[steps:] == self.owner[:-steps]
        out[steps:][same] = self.index[:-steps][same]
        return out

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The names and how often each is trained on."""
        return self.names, np.bincount(self.index, self.used(), minlength=len(self.names)).astype(np.int64)

    def pairs(self, target: np.ndarray) -> np.ndarray:
        """For classes of the names: each token's key of (previous word, class) in the high bits and of the word in the low ones."""
        context = np.append(self.names, _NONE)[self.before(1)]
        context += (target.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[self.index]
        context = textops.mix(context, 15)
        return (context >> np.uint64(WORD_BITS) << np.uint64(WORD_BITS)) | (textops.mix(self.names, 16) >> np.uint64(64 - WORD_BITS))[self.index]


def within(share: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Log probability of words in their class, from their base share and rows (pair's count, context's count, context's successors)."""
    n, total, kinds = met.astype(np.float64).T
    return np.log(np.where(total > 0, (n + kinds * share) / np.maximum(1, total + kinds), share))


def features(pack: Tokens, shape: Shape) -> np.ndarray:
    """Rows of the weight matrix for each token: previous word, skip, and both."""
    one, two = pack.before(1), pack.before(2)
    names = np.append(pack.names, _NONE)
    size = np.uint64(shape.buckets)
    out = np.empty((3, len(one)), np.int32)
    out[0] = (textops.mix(names, 11) % size)[one]
    out[1] = (textops.mix(names, 12) % size + size)[two]
    out[2] = textops.mix((names * np.uint64(0x9E3779B97F4A7C15))[one] + names[two], 13) % size + size + size
    return out


class Head:
    """Frequent words, most frequent first, and the shares of words in their classes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tail_counts: np.ndarray, tail_words: np.ndarray, shape: Shape):
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order
        rank = np.arange(len(keys))
        group = np.where(rank < shape.singles, rank, shape.singles + (rank - shape.singles) // shape.shared_words)
        sums = np.bincount(group, counts, minlength=shape.classes) if len(keys) else np.zeros(shape.classes)
        self.group, self.share = group, counts / np.maximum(1, sums[group])
        low = (keys % np.uint64(TAILS)).astype(np.int64)
        counted, words = tail_counts.astype(float).copy(), tail_words.astype(float).copy()
        np.subtract.at(counted, low, counts)
        np.subtract.at(words, low, 1)
        self.tail_size = counted + words + 1
        first = shape.singles + shape.shared
        prior = sums.copy()
        prior[first:] = counted + 1
        self.bias = np.log((prior + 0.5) / (prior + 0.5).sum()).astype(np.float32)
        self.first_tail = first

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each key, and its rank among the frequent words or -1."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        rank = np.where(self.keys[at] == keys, self.rank[at], -1) if len(self.keys) else np.full(len(keys), -1)
        tail = self.first_tail + (keys % np.uint64(TAILS)).astype(np.int64)
        return (np.where(rank >= 0, self.group[rank], tail) if len(self.keys) else tail), rank


    def shares(self, counts: np.ndarray, target: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Base share of each word, of the given count, class and rank, in its class."""
        out = (counts + 1) / self.tail_size[np.maximum(0, target - self.first_tail)]
        return np.where(rank >= 0, self.share[rank], out) if len(self.keys) else out


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of weights for each class, less the greatest of the row."""
    z = weights.take(rows[0], 0)
    z += weights.take(rows[1], 0)
    z += weights.take(rows[2], 0)
    z += bias
    z -= z.max(1, keepdims=True)
    return z


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = _logits(weights, bias, rows)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def log_chance(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``log_softmax`` of one class for each row."""
    z = _logits(weights, bias, rows)
    out = z[np.arange(len(target)), target]
    return out - np.log(np.exp(z, out=z).sum(1))


def row_sums(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and for each the sum of its values: in runs of equal rows, neighbours are added, then sums of two, of four, and so on."""
    # numbers of 16 bits are sorted by digits
    order = np.argsort(rows.astype(np.uint16) if rows.max(initial=0) < 1 << 16 else rows, kind="stable")
    ranked = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    place = np.arange(len(rows)) - np.repeat(first, np.diff(first, append=len(rows)))
    # a place in its run is added to the one before it by its lowest bit, once all higher places of that bit's width have come in
    lowest, most = place & -place, place.max(initial=0)
    sums = values.take(order, 0)
    step = 1
    while step <= most:
        at = np.flatnonzero(lowest == step)
        both = sums.take(at - step, 0)
        both += sums.take(at, 0)
        sums[at - step] = both
        step *= 2
    return ranked[first], sums.take(first, 0)


def _step(weights, bias, power, power_bias, rows, target, rate):
    """One Adagrad step on a batch, in place."""
    grad = _logits(weights, bias, rows)
    np.exp(grad, out=grad)
    grad /= grad.sum(1, keepdims=True)
    grad[np.arange(len(target)), target] -= 1
    g = grad.sum(0)
    power_bias += g * g
    bias -= rate * g / np.sqrt(power_bias + 1)
    for row in rows:
        at, g = row_sums(grad, row)
        p = power.take(at, 0)
        p += g * g
        power[at] = p
        p += 1
        g *= rate
        g /= np.sqrt(p, out=p)
        weights[at] -= g


_CHUNK = "chunk int, salt int, n double, part binary"
_CHUNK_ARROW = pa.schema([("chunk", pa.int32()), ("salt", pa.int32()), ("n", pa.float64()), ("part", pa.binary())])


def _sum_chunks(chunks: DataFrame, *by: str) -> DataFrame:
    def add(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("salt", "ascending"), ("n", "ascending")]).to_pylist()
        total = sum(np.frombuffer(r["part"], np.float32).astype(np.float64) for r in rows)
        return pa.Table.from_pylist([{"chunk": rows[0]["chunk"], "salt": rows[0]["salt"], "n": sum(r["n"] for r in rows), "part": total.astype(np.float32).tobytes()}], _CHUNK_ARROW)

    return chunks.groupBy(*by).applyInArrow(add, _CHUNK)


def train(packs: DataFrame, head: Head, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after ``rounds`` rounds of steps over all training tokens."""
    size = 3 * shape.buckets
    weights, bias = np.zeros((size, shape.classes), np.float32), head.bias
    step = 128
    for _ in range(shape.rounds):

        def learn(batches, weights=weights, bias=bias):
            w, b = weights.copy(), bias.copy()
            power, power_bias, n = np.zeros_like(w), np.zeros_like(b), 0
            for batch in batches:
                for i in range(batch.num_rows):
                    pack = Tokens(batch.slice(i, 1).to_pylist()[0])
                    used = np.flatnonzero(pack.used())
                    rows, target = features(pack, shape)[:, used], head.find(pack.names)[0][pack.index[used]]
                    for at in range(0, len(target), shape.batch):
                        _step(w, b, power, power_bias, rows[:, at : at + shape.batch], target[at : at + shape.batch], shape.rate)
                    n += len(target)
            if n:
                salt = TaskContext.get().partitionId() % 64
                every = np.concatenate([w, b[None]])
                rows = [{"chunk": k, "salt": salt, "n": float(n), "part": (every[at : at + step] * np.float32(n)).tobytes()} for k, at in enumerate(range(0, size + 1, step))]
                yield pa.RecordBatch.from_pylist(rows, _CHUNK_ARROW)

        sums = _sum_chunks(_sum_chunks(packs.mapInArrow(learn, _CHUNK), "chunk", "salt"), "chunk")
        # as many rows as the fixed shape has chunks
        found = sorted(sums.collect(), key=lambda r: r["chunk"])
        if found:
            every = np.concatenate([np.frombuffer(r["part"], np.float32) / r["n"] for r in found]).astype(np.float32).reshape(-1, shape.classes)
            weights, bias = every[:-1], every[-1]
    return weights, bias


def told(tails: np.ndarray, names: np.ndarray, sums: np.ndarray, most: int) -> bytes:
    """Counts of tail classes and the ``most`` frequent words of a bucket."""
    top = np.lexsort((names, -sums))[:most]
    return tails.astype(np.float64).tobytes() + names[top].tobytes() + sums[top].astype(np.int64).tobytes()


def untold(parts: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts of tail classes, words, counts) of several buckets, of the words the ``most`` frequent."""
    tails, names, sums = np.zeros((2, TAILS)), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in parts:
        tails += np.frombuffer(part[: 16 * TAILS], np.float64).reshape(2, TAILS)
        half = (len(part) - 16 * TAILS) // 16
        names.append(np.frombuffer(part, np.uint64, half, 16 * TAILS))
        sums.append(np.frombuffer(part, np.int64, half, 16 * TAILS + 8 * half))
    names, sums = np.concatenate(names), np.concatenate(sums)
    top = np.lexsort((names, -sums))[:most]
    return tails, names[top], sums[top]


#: Rows that one task merges, and that the driver gets.
FAN = 256


def merged(rows: DataFrame, most: int, fan: int = FAN) -> list:
    """At most ``fan`` rows (held, total, stats) that sum up one row for each bucket: merged by tasks, level by level."""

    def add(table: pa.Table) -> pa.Table:
        parts = table.sort_by("bucket").to_pylist()
        tails, names, sums = untold([r["stats"] for r in parts], most)
        row = {"bucket": parts[0]["bucket"] // fan, "held": sum(r["held"] for r in parts), "total": float(sum(r["total"] for r in parts)), "stats": told(tails, names, sums, most)}
        return pa.Table.from_pylist([row], pa.schema([("bucket", pa.int32()), ("held", pa.int64()), ("total", pa.float64()), ("stats", pa.binary())]))

    last = rows.agg(F.max("bucket")).first()[0] or 0
    while last >= fan:
        rows = rows.groupBy(F.floor(F.col("bucket") / fan)).applyInArrow(add, "bucket int, held long, total double, stats binary")
        last //= fan
    return sorted(rows.collect(), key=lambda r: r["bucket"])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_sum", pa.float64()), ("score", pa.float64())])


def score_texts(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Log10 probability of every text under the model learnt from the training texts.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (unigram with one added to each count), score (maximum-entropy model).
    Tokens are the words of the A-Z lower-cased text and one end.

    Nulls: a null text is empty and has the end alone; a null doc_id is kept
    and its text is trained on.  Repeated rows each count.  Empty input gives no
    rows; other columns are ignored.
    """
    packs = pk.packed(docs, part_bytes=PART_BYTES, columns=token_columns, schema=TOKENS, arrow=_TOKENS)
    size = pk.sizes(packs)

    def stats(bucket, names, sums):
        held = sums > 0
        names, sums = names[held], sums[held]
        low = (names % np.uint64(TAILS)).astype(np.int64)
        return told(np.stack([np.bincount(low, sums, minlength=TAILS), np.bincount(low, minlength=TAILS)]), names, sums, shape.head)

    answers = written(pk.ask(packs, Tokens.counts, 64, pk.narrow, stats, parts=pk.buckets(docs.sparkSession, size.words), kind=Tokens))
    said = merged(answers.where("stats is not null").select("bucket", "held", "total", "stats"), shape.head)
    n, v = int(sum(r["total"] for r in said)), int(sum(r["held"] for r in said))
    tails, names, sums = untold([r["stats"] for r in said], shape.head)
    head = Head(names, sums.astype(np.float64), tails[0], tails[1], shape)
    weights, bias = train(packs, head, shape)
    pk.release(docs.sparkSession)
    answers = answers.select("pack_id", "bucket", "found")

    def pair_keys(pack):
        found, index = np.unique(pack.pairs(head.find(pack.names)[0]), return_inverse=True)
        return found, np.bincount(index, pack.used(), minlength=len(found)).astype(np.int64)

    parts = pk.buckets(docs.sparkSession, size.words)
    met = pk.ask(packs, pair_keys, 64, pk.narrow, parts=parts, low=WORD_BITS, kind=Tokens)
    # counts of words come before those of pairs
    answers = answers.unionByName(met.select("pack_id", (F.col("bucket") + parts).cast("int").alias("bucket"), "found"))

    def score(row, counts):
        pack = Tokens(row)
        owner, index, n_docs = pack.owner, pack.index, len(pack.ids)
        c = counts[: len(pack.names)].astype(np.float64)
        target, rank = head.find(pack.names)
        pair = np.unique(pack.pairs(target), return_inverse=True)[1]
        chosen = within(head.shares(c, target, rank)[index], counts[len(c) :].reshape(-1, 3)[pair])
        rows, target = features(pack, shape), target[index]
        for at in range(0, len(index), shape.batch):
            part = slice(at, at + shape.batch)
            chosen[part] += log_chance(weights, bias, rows[:, part], target[part])
        total = np.bincount(owner, chosen / np.log(10), minlength=n_docs)
        base = np.bincount(owner, np.log10((c + 1) / (n + v + 1))[index], minlength=n_docs)
        length, known = np.bincount(owner, minlength=n_docs), np.bincount(owner, (c > 0)[index], minlength=n_docs)
        for d, i in enumerate(pack.ids):
            yield {"doc_id": i, "held_out": held_out(i), "n_tokens": int(length[d]), "n_known": int(known[d]), "base_sum": float(base[d]), "score": float(total[d])}

    rows = pk.met(packs, answers, score, SCORES, _SCORES, pk.widened, tasks=pk.buckets(docs.sparkSession, size.packs, pk.PACKS))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base_sum").alias("base_score"), "score")
