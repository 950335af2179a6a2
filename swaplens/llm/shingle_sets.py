"""Sets of word shingles of whole texts, in NumPy: hashes, SimHash prints and prefixes of sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .simhash import LOWER, UPPER
from .substring_dedup import text_bytes, scramble, words_of
from .tokenizing import slices

#: Bytes of text that a worker cuts into shingles at once, about.
SLICE = 1 << 20
TALLIES = 256
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LONGS = pa.int64()


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin of each text's hashes and the end, the distinct hashes of its runs of ``size`` words,
    ascending). A text of fewer words is one run; one of none has no hash."""
    doc, codes = words_of([t.translate(_LOWERED) for t in texts])
    words = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(words) - words, words)
    left = words[doc] - place
    starts = np.flatnonzero((left >= size) | (place == 0))
    taken, h = np.minimum(left[starts], size), np.zeros(len(starts), np.uint64)
    for j in range(size):
        more = taken > j
        h[more] = (h[more] + codes[starts[more] + j]) * _STEP
    h, of = scramble(h + taken.astype(np.uint64)), doc[starts]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return np.searchsorted(of, np.arange(len(texts) + 1)), h


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between begins; 0 where there are none."""
    out = np.zeros((len(begins) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        out[full] = np.add.reduceat(values, begins[full], axis=0)
    return out


def prints(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """SimHash of each set: a bit is 1 if it is set in over half the hashes."""
    votes = np.zeros((len(begins) - 1, 64), np.int32)
    for bit in range(64):
        votes[:, bit] = _sums((values >> np.uint64(bit) & np.uint64(1)).astype(np.int32), begins)
    ones = 2 * votes > np.diff(begins)[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]


def prefix_of(values: np.ndarray, begins: np.ndarray, last: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(begins, hashes) of the first n - ceil(similarity n) + 1 of each set of n, ascending but for the
    hashes ``last`` (ascending), which come after all others."""
    n = np.diff(begins)
    of = np.repeat(np.arange(len(n)), n)
    common = last[np.minimum(np.searchsorted(last, values), len(last) - 1)] == values if len(last) else np.zeros(len(values), bool)
    order = np.argsort(2 * of + common, kind="stable")
    length = np.where(n > 0, n - np.ceil(np.round(similarity * n, 9)).astype(np.int64) + 1, 0)
    keep = np.arange(len(values)) - np.repeat(begins[:-1], n) < length[of]
    return np.concatenate([[0], np.cumsum(length)]), values[order][keep]


def tallies(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many hashes of each set fall in each of ``TALLIES`` buckets: sets share no more than their lesser counts."""
    rows = len(begins) - 1
    of = np.repeat(np.arange(rows), np.diff(begins))
    return np.bincount(of * TALLIES + (values & np.uint64(TALLIES - 1)).astype(np.int64), minlength=rows * TALLIES).astype(np.int32)


def _lists(begins: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values.view(np.int64)))


def sketch(batches, size: int, last: np.ndarray, similarity: float):
    """(k1, k2, doc_id, text) -> k1, k2, doc_id, s1, s2 (the set's identity), n, fp, prefix, tally."""
    for batch in batches:
        for a, rows in slices(batch.column(3), SLICE):
            part = batch.slice(a, rows)
            begins, h = shingle_sets(text_bytes(part.column(3)), size)
            same = [_sums(scramble(h ^ np.uint64(salt)), begins).view(np.int64) for salt in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], *(pa.array(s) for s in same), pa.array(np.diff(begins).astype(np.int32)),
                 pa.array(prints(h, begins).view(np.int64)), _lists(*prefix_of(h, begins, last, similarity)),
                 pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * TALLIES), pa.array(tallies(h, begins)))],
                ["k1", "k2", "doc_id", "s1", "s2", "n", "fp", "prefix", "tally"])


def whole_sets(batches, size: int):
    """(node, text) -> node, hs: the whole set."""
    for batch in batches:
        for a, rows in slices(batch.column(1), SLICE):
            part = batch.slice(a, rows)
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(*shingle_sets(text_bytes(part.column(1)), size))], ["node", "hs"])
