"""A tokenizer per Python worker, and exact ways to encode huge texts in pieces."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import worker_env

_loaded: dict = {}


def load(path: str):
    """The worker's tokenizer of that file; loaded once per worker."""
    if path not in _loaded:
        worker_env()
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def slices(texts: pa.Array, most_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of texts of about ``most_bytes`` in total: a run is worked on at once."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most_bytes, "right")))
        yield a, b - a
        a = b


def batches(texts: Iterable[str], most_chars: int = 1 << 19):
    """Runs of texts of about ``most_chars`` in total: encodings of a run are held at once."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= most_chars:
            yield run
            run, n = [], 0
    if run:
        yield run


# A cut before a space between a non-space and a non-space is stable: byte-level pre-tokenization
# never carries a run of letters, digits or signs over a space, so both sides are encoded alike
# whatever stands beyond. Overlapping pieces are spliced where both have a token boundary at such
# a place and agree on the tokens around it.
_STABLE = re.compile(r"(?<=\S) (?=\S)")


def _splice(left, right, shift: int, lo: int, hi: int, text: str) -> tuple[int, int] | None:
    """Token counts (of left up to, of right from) a stable boundary in text[lo:hi] that both
    encodings have, with one more equal token on either side; None if there is none.

    ``shift`` is where the right piece begins in the coordinates of ``text``; left begins at 0.
    """
    ends = {e: i for i, (_, e) in enumerate(left.offsets)}
    starts = {s + shift: i for i, (s, _) in enumerate(right.offsets)}
    middle = (lo + hi) // 2
    for m in sorted((m.start() for m in _STABLE.finditer(text, lo, hi)), key=lambda c: abs(c - middle)):
        i, j = ends.get(m), starts.get(m)
        if i is None or j is None or j == 0 or i + 1 >= len(left.ids):
            continue
        if left.ids[i] == right.ids[j - 1] and left.ids[i + 1] == right.ids[j]:
            return i + 1, j
    return None


def encode_spliced(tokenizer, text: str, chunk: int, overlap: int) -> np.ndarray:
    """Ids of a text of any length, encoded in overlapping pieces of about ``chunk`` characters.

    Neighbouring pieces are spliced at a proven stable boundary within their overlap; where none
    is found the overlap is doubled, at last up to the whole rest, which needs no splice.
    """
    out, start, skip = [], 0, 0
    end = min(len(text), chunk)
    left = tokenizer.encode(text[start:end], add_special_tokens=False)
    while end < len(text):
        span = overlap
        while True:
            begin = max(start, end - span)
            stop = min(len(text), begin + max(chunk, 2 * (end - begin)))
            right = tokenizer.encode(text[begin:stop], add_special_tokens=False)
            cut = _splice(left, right, begin - start, begin - start, end - start, text[start:end])
            if cut and cut[0] >= skip:
                out.append(np.asarray(left.ids[skip : cut[0]], np.uint32))
                start, end, left, skip = begin, stop, right, cut[1]
                break
            if begin == start:  # no stable place in the whole piece: take more text at once
                end = min(len(text), start + 2 * (end - start))
                left = tokenizer.encode(text[start:end], add_special_tokens=False)
                if end == len(text):
                    break
                continue
            span *= 2
    out.append(np.asarray(left.ids[skip:], np.uint32))
    return np.concatenate(out)
