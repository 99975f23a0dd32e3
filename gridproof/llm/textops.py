"""Byte-level text primitives in numpy, shared by the corpus operators.

Texts arrive as Arrow string columns; these helpers work on their UTF-8
buffers for many documents at once.  A word is a maximal run of bytes outside
``\\x20 \\x09-\\x0D``; as those are ASCII, cutting bytes never cuts a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Texts are handled in slices of about this many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Strings are hashed by two polynomials modulo this prime, at fixed random points; a modulus of 2**64 would make
#: some regular strings collide whatever the point.
_PRIME = (1 << 31) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240607)
_POINTS = [int(x) for x in _rng.integers(1 << 20, _PRIME - 1, 2)]
_TABLES = [_rng.permutation(np.arange(1, _PRIME, _PRIME // 257))[:256].astype(np.uint64) + _rng.integers(0, 1 << 20, 256, dtype=np.uint64) for _ in _POINTS]
_powers = [np.ones(1, np.uint64) for _ in _POINTS]
_inverses = [np.ones(1, np.uint64) for _ in _POINTS]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits (a bijection)."""
    x = np.asarray(x, np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges (first, last+1) of texts whose bytes sum to about ``most``."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of every word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = SPACE[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    before[edge], after[edge - 1] = True, True
    word = ~space
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: Elements handled at once, so that intermediate arrays stay in a core's cache.
_CHUNK = 1 << 14


def _fold(x: np.ndarray) -> np.ndarray:
    """Values below 2**63 to equal ones modulo the prime, below 2**33; in place."""
    high = x >> np.uint64(31)
    x &= np.uint64(_PRIME)
    x += high
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    """The least values modulo the prime, of values below 2**63; in place."""
    x = _fold(_fold(x))
    x[x >= np.uint64(_PRIME)] -= np.uint64(_PRIME)
    return x


def _chain(step: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of a number modulo the prime, by doubling."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = _reduced(out[:more] * np.uint64(pow(step, have, _PRIME)))
        have += more
    return out


def _grow(n: int) -> None:
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + (1 << 18))
        for k, point in enumerate(_POINTS):
            _powers[k] = _chain(point, size)
            _inverses[k] = _chain(pow(point, -1, _PRIME), size)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """For each of two points, sums of table[byte] * point**i before each place, to be read modulo the prime."""
    _grow(len(data))
    out = np.zeros((len(_POINTS), len(data) + 1), np.uint64)
    for k, table in enumerate(_TABLES):
        for at in range(0, len(data), _CHUNK):
            x = table[data[at : at + _CHUNK]]
            x *= _powers[k][at : at + len(x)]
            # below 2**33 each, so 2**30 bytes sum without overflow
            np.cumsum(_fold(x), dtype=np.uint64, out=x)
            out[k, at + 1 : at + 1 + len(x)] = x + out[k, at]
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62-bit hash, spread over 64 bits, of the bytes of each range, the same wherever they stand."""
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(out), _CHUNK):
        lo, hi = starts[at : at + _CHUNK], ends[at : at + _CHUNK]
        h = None
        for k in range(len(_POINTS)):
            x = prefix[k].take(hi)
            x -= prefix[k].take(lo)
            _fold(_fold(x))
            x *= _inverses[k].take(lo)
            _reduced(x)
            h = x if h is None else (h << np.uint64(31)) | x
        out[at : at + len(h)] = mix(h)
    return out


def runs_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` neighbouring values, in order."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out) * _ODD + values[k : k + n]
    return mix(out)


def shingle_sets(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text: (shingle hashes sorted within the text, offsets).

    A text of fewer words than ``width`` has one shingle, its whole sequence;
    a text without words has none.
    """
    counts = np.bincount(doc, minlength=n_docs)
    grams = runs_hash(hashes, width)
    owner = doc[: len(grams)]
    whole = owner == doc[width - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[whole], owner[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at = np.concatenate([[0], np.cumsum(counts)])
        extra = np.array([mix(runs_hash(hashes[at[d] : at[d + 1]], counts[d]), int(counts[d]))[0] for d in short], np.uint64)
        grams, owner = np.concatenate([grams, extra]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        keep = np.ones(len(grams), bool)
        keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[keep], owner[keep]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_docs))])


def text_shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of texts given as bytes, after lower-casing A-Z."""
    data = lower_ascii(data)
    starts, ends, doc = spans(data, offsets)
    return shingle_sets(range_hash(prefix_hash(data), starts, ends), doc, len(offsets) - 1, width)
