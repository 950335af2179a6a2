"""Repeated passages across documents, by content-defined chunks.

A gear hash rolls over the words of a text, h = (h << 8) + entry, where a word's entry is drawn from
its bytes; of 24 bits, it depends on the last ``REACH`` words only. A chunk ends at each word whose hash
is the least in some window of ``WINDOW`` consecutive words. Cuts depend on nearby words alone, so
inserted text shifts no later chunk, nor does other white space; and a passage of
``2 * WINDOW + REACH - 1`` words that repeats holds at least one whole chunk, the same in both places,
whatever surrounds it.

Chunks are deduplicated by digest. Of a text only the runs of shared chunks go on, and only those
that could, with the words beside them, reach the wanted length. Chains of consecutive
chunks that are long enough are deduplicated by digest in turn; what chains leave open is compared
word for word, by the digests of all windows around the open chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import map_arrow, materialize
from .tokenizing import slices

WINDOW, REACH, MIN_WORDS = 24, 3, 50
#: Documents with open chunks up to which they are found by broadcast.
BROADCAST_IDS = 100_000
#: Bytes of text that a task works on at once, about, and bytes that it hashes at once.
SLICE, BLOCK = 4 << 20, 1 << 19
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_ONE = np.uint64(1)
#: Odd multipliers of polynomial digests, and their inverses modulo 2^64.
_BASES = tuple((np.uint64(b), np.uint64(pow(b, -1, 1 << 64))) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_BASE, _INVERSE = _BASES[0]
_FAR = 1 << 40


def gear(doc: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """h = (h << 8) + entry, modulo 2^24, after each word; each text begins anew."""
    entry = (codes & np.uint64(0xFFFFFF)).astype(np.int64)
    h = entry.copy()
    for k in range(1, REACH):
        h[k:] += (entry[:-k] << 8 * k) * (doc[k:] == doc[:-k])
    return h & 0xFFFFFF


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = scramble(np.arange(1, 257, dtype=np.uint64) * _BASE)
_PLACES = scramble(np.arange(1, 257, dtype=np.uint64) * _INVERSE) | _ONE


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[_ONE], np.full(max(n - 1, 0), base)]))[:n]


def ranges_digest(codes: np.ndarray, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
    """Digests of codes[first:last] for each pair, the same wherever the codes stand; there are two of them."""
    base, inverse = _BASES[which]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * _powers(base, len(codes)), dtype=np.uint64)])
    back = _powers(inverse, len(codes) + 1)
    return scramble((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, code) of every word of the texts, in order. Bytes are hashed in blocks that end
    between words."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    begins = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    codes, a = [np.empty(0, np.uint64)], 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK)))
        lo, hi = int(starts[a]), int(ends[b - 1])
        s = starts[a:b] - lo
        place = np.arange(hi - lo) - np.repeat(s, np.diff(s, append=hi - lo))
        # longer words repeat the multipliers, with the number of the round
        mixed = _BYTES[data[lo:hi]] * (_PLACES[place & 255] + (place >> 8 << 1).astype(np.uint64))
        mixed[space[lo:hi]] = 0
        codes.append(scramble(np.add.reduceat(mixed, s)))
        a = b
    return np.searchsorted(begins, starts, "right") - 1, np.concatenate(codes)


def cuts(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a chunk ends after each word: least of a window within the text, or the text's last."""
    n = len(doc)
    cut = np.zeros(n, bool)
    if n >= WINDOW:
        least = np.lib.stride_tricks.sliding_window_view(hashes << 38 | np.arange(n), WINDOW).min(1) & ((1 << 38) - 1)
        cut[least[doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]]] = True
    if n:
        cut[np.flatnonzero(np.diff(doc, append=doc[-1] + 1))] = True
    return cut


def _room(doc: np.ndarray, hashes: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Up to ``WINDOW - 1``: words of the text beside each cut before a hash that would have been cut
    instead, had the window reached it: a lower one after, one as low before."""
    room, alive = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for k in range(1, WINDOW):
        to = np.clip(at + step * k, 0, len(doc) - 1)
        higher = hashes[to] >= hashes[at] if step > 0 else hashes[to] > hashes[at]
        alive &= higher & (doc[to] == doc[at]) & (to == at + step * k)
        room += alive
    return room


def chunk_table(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, first word, words, words that a passage can hold before it and after it without
    another whole shared chunk, digest) of every chunk."""
    doc, codes = words_of(texts)
    hashes = gear(doc, codes)
    last = np.flatnonzero(cuts(doc, hashes))
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    own, n = doc[first], last - first + 1
    start = first - np.searchsorted(doc, np.arange(len(texts)))[own]
    before, after = np.zeros_like(n), _room(doc, hashes, last, 1)
    if len(last):
        before[1:] = _room(doc, hashes, last[:-1], -1) + REACH
    return own, start, n, np.minimum(before, start), after, ranges_digest(codes, first, last + 1)


def text_bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in pc.cast(texts, pa.binary()).to_pylist()]


#: A document: its id, or else a hash of its text, and which of these and which of its texts.
DOC = "doc_id long, part long"
CHUNKS = f"{DOC}, at long, h long"


def _chunk(batches):
    for batch in batches:
        for a, n in slices(batch.column(2), SLICE):
            rows = batch.slice(a, n)
            own, start, words, before, after, digest = chunk_table(text_bytes(rows.column(2)))
            at = start << 24 | words << 16 | before << 8 | after
            own = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(own), rows.column(1).take(own), pa.array(at, pa.int64()), pa.array(digest.view(np.int64))], ["doc_id", "part", "at", "h"])


CANDIDATES = f"{DOC}, start int, n_words int, lo int, hi int, h long, chain_words int, chain long, chain2 long"


def _chains(batches, size: int):
    """(doc_id, part, its shared chunks) -> the chunks whose run could reach ``size`` words: the run's
    bounds with what could belong to a passage beside its chunks, and the words and digest of the shortest chain
    of the run that starts there and is long enough (none: 0 words and the chunk's digest, which keeps
    such rows apart when they are dealt by it)."""
    for batch in batches:
        lists = batch.column(2)
        flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(batch.num_rows), counts)
        at, h = flat.field("at").to_numpy(), flat.field("h").to_numpy().view(np.uint64)
        order = np.lexsort((at, doc))
        doc, at, h = doc[order], at[order], h[order]
        # rows that repeat a document bring the same chunks again
        fresh = np.ones(len(at), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
        doc, at, h = doc[fresh], at[fresh], h[fresh]
        start, n, before, after = at >> 24, at >> 16 & 255, at >> 8 & 255, at & 255
        end = start + n
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != end[:-1])
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        final = np.append(first[1:], len(at)) - 1 if len(at) else first
        lo = np.minimum.reduceat(start - before, first)[run] if len(at) else start
        hi = np.maximum.reduceat(end + after, first)[run] if len(at) else end
        upto = np.searchsorted(end + doc * _FAR, start + doc * _FAR + size)
        whole = upto <= final[run] if len(at) else new
        upto = np.where(whole, upto, np.arange(len(at)))
        chain, chain2 = (np.where(whole, ranges_digest(h, np.arange(len(at)), upto + 1, k), h) if len(at) else h for k in (0, 1))
        keep = hi - lo >= size
        at_doc = pa.array(doc[keep])
        chain_words = np.where(whole, end[upto] - start, 0) if len(at) else start
        ints = [pa.array(x[keep].astype(np.int32)) for x in (start, n, lo, hi, chain_words)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at_doc), batch.column(1).take(at_doc), *ints[:4], pa.array(h[keep].view(np.int64)), ints[4],
             pa.array(chain[keep].view(np.int64)), pa.array(chain2[keep].view(np.int64))],
            ["doc_id", "part", "start", "n_words", "lo", "hi", "h", "chain_words", "chain", "chain2"])


def _windows(batches, size: int):
    """(doc_id, part, ranges, text) -> doc_id, part, start and digest of the windows of ``size`` words."""
    for batch in batches:
        for a, n in slices(batch.column(3), SLICE):
            rows = batch.slice(a, n)
            doc, codes = words_of(text_bytes(rows.column(3)))
            begin = np.searchsorted(doc, np.arange(n + 1))
            lists = rows.column(2)
            flat, own = lists.flatten(), np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            x, y = flat.field("a").to_numpy().astype(np.int64), flat.field("b").to_numpy().astype(np.int64)
            y = np.minimum(y, (begin[1:] - begin[:-1])[own] - size)
            counts = np.maximum(y - x + 1, 0)
            first = np.repeat(begin[own] + x, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            first = np.unique(first)  # ranges overlap
            own = np.searchsorted(begin, first, "right") - 1
            digests = [pa.array(ranges_digest(codes, first, first + size, k).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(own)), rows.column(1).take(pa.array(own)), pa.array((first - begin[own]).astype(np.int32)), *digests],
                ["doc_id", "part", "start", "d", "d2"])


def _given():
    return F.col("part") % 2 == 0


#: Of a key that several documents have, two of them.
TWO = ["least", "least_given", "most", "most_given"]


def _shared(df: DataFrame, *key: str) -> DataFrame:
    """key columns, and two documents (``TWO``) of the keys that more than one has: those with ids before those without, by number. Written
    out, so that what joins it is dealt anew: a key that very many rows share is then split."""
    ends = [f(F.when(c, F.col("doc_id"))).alias(n) for n, f, c in (("_a", F.min, _given()), ("_b", F.max, _given()), ("_c", F.min, ~_given()), ("_d", F.max, ~_given()))]
    several = F.when(F.col("_a").isNull(), F.col("_c") < F.col("_d")).otherwise(F.col("_c").isNotNull() | (F.col("_a") < F.col("_b")))
    two = [F.coalesce("_a", "_c").alias("least"), F.col("_a").isNotNull().alias("least_given"), F.coalesce("_d", "_b").alias("most"), F.col("_d").isNull().alias("most_given")]
    return materialize(df.groupBy(*key).agg(*ends).where(several).select(*key, *two), "shared")


def _other():
    """The id, null if there is none, of the one of the two that the row's document isn't."""
    first = (F.col("doc_id") == F.col("least")) & (_given() == F.col("least_given"))
    return F.when(first, F.when(F.col("most_given"), F.col("most"))).otherwise(F.when(F.col("least_given"), F.col("least"))).alias("other_doc_id")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per stretch of a document that lies in passages of at least ``min_words`` words which
    other documents have too: doc_id, start_word, n_words, other_doc_id (one that has its start).

    Every such passage is found; where chains of chunks confirm it, its ends are those of whole
    chunks, fewer than ``WINDOW + REACH`` words inside. ``min_words`` must be at least
    2 * WINDOW + REACH - 1, so that each passage holds a whole chunk. Words are runs other than white space, which itself isn't
    compared. Digests of 128 bits stand for passages, of 64 bits for chunks and words, which only propose them. Null, empty and
    shorter texts have no passage; rows that repeat a doc_id count as one document; rows without one are
    documents told apart by their texts, reported with a null id; other columns are not read. A document's own chunks, and no more, meet in one task.
    """
    if min_words < 2 * WINDOW + REACH - 1:
        raise ValueError(f"min_words must be at least {2 * WINDOW + REACH - 1}")
    # part tells apart unlike texts under one doc_id; it is even where there is an id, else odd and doc_id a hash of the text
    given = F.col(id_col).cast("long")
    part = F.xxhash64(F.lit(2), text_col).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(given.isNull().cast("long"))
    rows = docs.select(F.coalesce(given, F.xxhash64(text_col)).alias("doc_id"), part.alias("part"), F.col(text_col).alias("text"))
    chunks = materialize(rows.transform(map_arrow, _chunk, CHUNKS), "chunks")
    found = chunks.join(_shared(chunks, "h").select("h"), "h")
    per_text = found.groupBy("doc_id", "part").agg(F.collect_list(F.struct("at", "h")).alias("chunks"))
    candidates = materialize(per_text.transform(map_arrow, lambda it: _chains(it, min_words), CANDIDATES), "candidates")
    chains = _shared(candidates.where("chain_words > 0"), "chain", "chain2").select("chain", "chain2", *TWO, F.lit(True).alias("known"))
    in_text = Window.partitionBy("doc_id", "part").orderBy("start")
    flagged = candidates.join(chains, ["chain", "chain2"], "left").withColumn("known", F.coalesce(F.col("known") & (F.col("chain_words") > 0), F.lit(False)))
    reach = F.max(F.when(F.col("known"), F.col("start") + F.col("chain_words"))).over(in_text.rowsBetween(Window.unboundedPreceding, 0))
    end = F.col("start") + F.col("n_words")
    flagged = materialize(
        flagged.select(
            "doc_id", "part", "start", "chain_words", "known", *TWO, "h", (F.coalesce(reach, F.lit(0)) < end).alias("open"),
            F.greatest(F.col("lo"), end - min_words, F.lit(0)).alias("a"), F.least(F.col("start"), F.col("hi") - min_words).alias("b")),
        "flagged")
    confirmed = flagged.where("known").select("doc_id", "part", "start", "chain_words", _other())
    # a chunk that is open in one document is compared in all that have it
    around = flagged.where("a <= b")
    opened = materialize(around.where("open").select("h").distinct(), "open")
    wanted = around.join(opened, "h").groupBy("doc_id", "part").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    wanted = materialize(wanted, "wanted")
    ids = wanted.select("doc_id").distinct()
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(ids), "doc_id", "left_semi") if small else rows  # a shuffle to leave some out would move all
    windows = materialize(
        wanted.join(texts, ["doc_id", "part"]).select("doc_id", "part", "ranges", "text")
        .transform(map_arrow, lambda it: _windows(it, min_words), f"{DOC}, start int, d long, d2 long"), "windows")
    settled = windows.join(_shared(windows, "d", "d2"), ["d", "d2"]).select("doc_id", "part", "start", F.lit(min_words).alias("chain_words"), _other())
    # rows that repeat a document give the same stretches
    by_start = Window.partitionBy("doc_id", "part").orderBy("start", F.desc("chain_words"))
    end = F.col("start") + F.col("chain_words")
    fresh = F.when(F.col("start") <= F.max(end).over(by_start.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    stretches = confirmed.unionByName(settled).withColumn("new", fresh).withColumn("run", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return stretches.groupBy("doc_id", "part", "run").agg(
        F.min("start").cast("long").alias("start_word"), (F.max(end) - F.min("start")).cast("long").alias("n_words"), F.min_by("other_doc_id", "start").alias("other_doc_id")
    ).select(F.when(_given(), F.col("doc_id")).alias("doc_id"), "start_word", "n_words", "other_doc_id")
