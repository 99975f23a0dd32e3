"""Token counts by a unigram model, with forward scores shared through a trie.

The distinct pre-tokens of a slice are put in a trie: in sorted order a
pre-token shares its longest common prefix with its neighbour, so walking the
sorted list is a depth-first walk of the trie, and the stack holds one forward
score and token count for each node on the current path.  A shared prefix is
scored once; the count at a pre-token's last node is its number of tokens.

A vocabulary is a list of pieces.  Where it has no probabilities, the piece of
rank r has log probability -log(r + 2.7), up to a constant (Zipf-Mandelbrot).
Characters outside the vocabulary are spelt in bytes, one token each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridproof.llm import textops

WORD_START = "▁"
CACHE = 1 << 20
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    """Log scores of pieces, and of one byte."""

    pieces: dict[str, float]
    byte: float
    #: pieces spelt backwards: character -> node; the key "" holds a score
    backward: dict = field(init=False)

    def __post_init__(self):
        self.backward = {}
        for piece, score in self.pieces.items():
            node = self.backward
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, last = {}, 0
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = -math.log(last + 2.7)
                last += 1
        return cls(pieces, -math.log(last + 2.7) - 1)


def forward_counts(words: list[str], vocabulary: Vocabulary) -> list[int]:
    """Tokens of each word's best segmentation; words must be sorted and distinct.

    Of segmentations with equal scores the one with fewer tokens counts.
    """
    root, byte = vocabulary.backward, vocabulary.byte
    best, count, out = [0.0], [0], []
    before = ""
    for word in words:
        text = WORD_START + word
        shared = 0
        for a, b in zip(before, text, strict=False):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(text) + 1):
            spelt = len(text[end - 1].encode("utf-8", "surrogatepass"))
            top, n = best[end - 1] + byte * spelt, count[end - 1] + spelt
            node, start = root, end
            while start:
                start -= 1
                node = node.get(text[start])
                if node is None:
                    break
                score = node.get("")
                if score is not None:
                    score += best[start]
                    if score > top or score == top and count[start] < n - 1:
                        top, n = score, count[start] + 1
            best.append(top)
            count.append(n)
        out.append(count[-1])
        before = text
    return out


class _Counter:
    """Counts of pre-tokens seen by a task; forgets all when there are too many."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, doc = textops.spans(data, offsets)
        n = len(offsets) - 1
        if not len(starts):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        names, first, index = np.unique(textops.range_hash(textops.prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, names), max(0, len(self.keys) - 1))
        known = self.keys[at] == names if len(self.keys) else np.zeros(len(names), bool)
        counts = np.empty(len(names), np.int64)
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        raw = data.tobytes()
        words = sorted((raw[starts[first[k]] : ends[first[k]]].decode("utf-8", "surrogateescape"), k) for k in new)
        counts[[k for _, k in words]] = forward_counts([w for w, _ in words], self.vocabulary)
        if len(self.keys) + len(new) > CACHE:
            self.keys, self.counts = names, counts
        else:
            keys = np.concatenate([self.keys, names[new]])
            order = np.argsort(keys)
            self.keys, self.counts = keys[order], np.concatenate([self.counts, counts[new]])[order]
        return np.bincount(doc, minlength=n), np.bincount(doc, counts[index], minlength=n).astype(np.int64)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row; pre-tokens are the words, each with a word start.

    Nulls: a null or empty text has 0 and 0; a null doc_id is kept.  Repeated rows
    count alike.  Empty input gives no rows; other columns are ignored.  Very long
    words are whole pre-tokens.
    """
    def run(batches):
        counter = _Counter(vocabulary)
        for batch in batches:
            data, offsets = textops.column_bytes(batch.column(1))
            words, counts = [], []
            for a, b in textops.slices(offsets):
                w, c = counter(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                words.append(w)
                counts.append(c)
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(none + words)), pa.array(np.concatenate(none + counts))], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
