"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, all of them, to the end of the text. A passage is
encoded from how its bytes and words follow each other; a learned layer embeds it; gated attention,
learned from document labels alone, weighs the passages; the weighted mean is scored. The model is fitted
on the driver, on a bounded sample of labelled documents; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow
from .tokenizing import batches as runs_of

PASSAGE = 64
#: Bounds of the fit: labelled documents, and bytes of their texts; all passages of each are learned from.
SAMPLE, SAMPLE_BYTES = 3000, 16 << 20
EMBED, GATE, EPOCHS, RATE, DECAY, SEED = 24, 12, 120, 0.03, 1e-4, 5
THRESHOLD = 0.3

#: Classes of bytes. Lower, upper, digit, space, line break, sentence marks, brackets
#: and quotes, symbols, beyond ASCII; everything else is the last class.
_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c",
    b".,;:", b"!?", b"()[]{}<>\"'`", b"#$%&*+/=@\\^_|~-", bytes(range(128, 256)),
)
N_CLASSES = len(_CLASSES) + 1
N_FEATURES = N_CLASSES * N_CLASSES + 4


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.int64)
    for i, members in enumerate(_CLASSES):
        table[list(members)] = i
    return table


CLASS_OF = _class_table()
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_MIX = (np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts -> (passages x features, passages of each text); an empty text is one blank passage."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    doc = np.searchsorted(begins, starts, "right") - 1
    words = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    n_passages = np.maximum(1, -(-words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(n_passages)[:-1]])
    of_word = base[doc] + (np.arange(len(starts)) - first[doc]) // PASSAGE
    total = int(n_passages.sum())
    # a passage begins with its first word, that of a text's first passage with the text
    cut = np.zeros(total, np.int64)
    cut[base] = begins[:-1]
    later = np.flatnonzero(np.diff(of_word, prepend=-1) > 0)
    later = later[of_word[later] > base[doc[later]]]
    cut[of_word[later]] = starts[later]
    of_byte = np.repeat(np.arange(total), np.diff(cut, append=len(data)))
    classes = CLASS_OF[data]
    pairs = of_byte[:-1] * (N_CLASSES * N_CLASSES) + classes[:-1] * N_CLASSES + classes[1:]
    pairs = np.delete(pairs, begins[1:-1] - 1)  # of a text's end and the next one's start
    counts = np.bincount(pairs, minlength=total * N_CLASSES * N_CLASSES).reshape(total, -1)
    out = np.zeros((total, N_FEATURES), np.float32)
    out[:, : N_CLASSES * N_CLASSES] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    if len(starts):
        ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        length = ends - starts
        place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data))) if starts[0] == 0 else (
            np.arange(len(data)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(starts, append=len(data)))]))
        mixed = np.where(space, np.uint64(0), _MIX[data] * (2 * place + 1).astype(np.uint64))
        code = np.add.reduceat(mixed, starts)
        per = np.maximum(1, np.bincount(of_word, minlength=total))
        again = lambda lag: np.concatenate([np.zeros(min(lag, len(code)), bool), (code[lag:] == code[:-lag]) & (of_word[lag:] == of_word[:-lag])])
        out[:, -4] = np.bincount(of_word, again(1), total) / per
        out[:, -3] = np.bincount(of_word, again(2), total) / per
        out[:, -2] = np.bincount(of_word, length, total) / per / 10
        out[:, -1] = np.log1p(np.bincount(of_word, minlength=total)) / 5
    return out, n_passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(m: dict, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple:
    x = (x - m["mean"]) / m["scale"]
    h = np.tanh(x @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * g) @ m["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts)
    return x, h, t, g, a, z, _sigmoid(z @ m["c"] + m["d"])


def fit(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Passages, passages of each bag, labels of the bags -> the model. Adam on all bags; the
    same bags in the same order give the same model."""
    rng = np.random.default_rng(seed)
    m = {
        "W": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], EMBED)), "b": np.zeros(EMBED),
        "V": rng.normal(0, 0.3, (EMBED, GATE)), "U": rng.normal(0, 0.3, (EMBED, GATE)), "w": rng.normal(0, 0.3, GATE),
        "c": rng.normal(0, 0.3, EMBED), "d": np.zeros(1),
    }
    fixed = {"mean": x.mean(0), "scale": np.maximum(x.std(0), 0.02)}
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    for step in range(1, epochs + 1):
        xs, h, t, g, a, z, p = _forward(m | fixed, x, starts, sizes)
        dp = (p - y) / len(y)
        dz = np.repeat(dp[:, None] * m["c"], sizes, 0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, dg = de[:, None] * m["w"] * g * (1 - t * t), de[:, None] * m["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
        grads = {"W": xs.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dp, "d": dp.sum(keepdims=True)}
        for k, v in grads.items():
            v = v + DECAY * m[k]
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            m[k] = m[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m | fixed


def held_out(doc_id: Column) -> Column:
    """Rows that no fit sees: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(batches):
    for batch in batches:
        bags = [encode([(t or "").encode()])[0].tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bags, pa.binary())], ["doc_id", "label", "x"])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, most_bytes: int) -> DataFrame:
    """doc_id, label, text of the labelled documents that are learned from, one row an id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")
    h = F.xxhash64("text")
    one = texts.groupBy("doc_id").agg(F.min(F.struct(h.alias("h"), F.octet_length("text").alias("bytes"))).alias("t"))
    first = one.join(known, "doc_id").select("doc_id", "label", "t.h", "t.bytes").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen, room = [], most_bytes
    for r in first.collect():  # ``sample`` rows at most, in order
        if r["bytes"] <= room:  # a text that doesn't fit is passed over, those after it are not
            chosen.append((r["doc_id"], r["h"], r["label"]))
            room -= r["bytes"]
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, h long, label double")
    rows = texts.withColumn("h", h).join(F.broadcast(chosen), ["doc_id", "h"])  # ``sample`` rows at most
    return rows.dropDuplicates(["doc_id"]).select("doc_id", "text", "label")


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES,
) -> dict | None:
    """The model, from at most ``sample`` labelled documents that are not held out: those with the
    least hashes of their ids, passing over texts that don't fit into ``most_bytes`` bytes together; each with all its passages.
    None where no document that fits has a label."""
    bags = _sample(docs, labels, id_col, text_col, label_col, sample, most_bytes)
    got = bags.transform(map_arrow, _features, "doc_id long, label double, x binary").toPandas().sort_values("doc_id")
    if not len(got):
        return None
    x = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got["x"]]
    return fit(np.concatenate(x), np.array([len(b) for b in x]), got["label"].to_numpy())


def _score(batches, model: dict | None):
    for batch in batches:
        scores = []
        for run in runs_of((t or "" for t in batch.column(1).to_pylist()), 1 << 20):
            x, sizes = encode([t.encode() for t in run])
            # the last bits of sums depend on what is scored together
            scores.append(np.full(len(run), 0.5) if model is None else np.round(_forward(model, x, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)[-1], 9))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.empty(0))], ["doc_id", "score"])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **kwargs) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= ``threshold``).

    Only the text is scored, the whole of it. Null texts count as empty; an empty text is one
    blank passage. Without any usable label all scores are 0.5. Labels of ids that are not in the
    table are ignored, of several labels of an id the larger counts; null ids are never held out.
    """
    model = train(docs, labels, id_col, text_col, **kwargs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = texts.transform(map_arrow, lambda it: _score(it, model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _accept(batches, model: dict | None, text: int, threshold: float):
    for batch in batches:
        scores = next(_score([pa.RecordBatch.from_arrays([batch.column(text), batch.column(text)], ["doc_id", "text"])], model)).column(1)
        yield batch.filter(pa.array(scores.to_numpy() >= threshold))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **kwargs) -> DataFrame:
    """The rows that the classifier accepts, each by its own text; columns as they are. One pass
    without a shuffle. A null text is judged as an empty one; without any usable label all rows stay; of no rows none."""
    model = train(docs, labels, id_col, text_col, **kwargs)
    at = docs.columns.index(text_col)
    return docs.transform(map_arrow, lambda it: _accept(it, model, at, threshold), docs.schema)
