"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole document.

A text's bytes are cut into chunks of `CHUNK` that overlap by `OVERLAP` and cover it whole. Learned filters run over a
chunk's byte embeddings, each filter's largest answer is kept (max-pooling), and a small dense layer turns these into
the chunk's evidence. The document's evidence is the mean over the third of its chunks that speak most for low quality,
so that a text that is poor in part is found and a long clean one is not lost to a single chunk.

The network is fitted by Adam on a bounded sample of labelled rows: at most `SAMPLE` of each label, the ones with the
smallest hash of doc_id, and at most `SAMPLE_CHUNKS` chunks of each, spread evenly over the whole text. Scoring is one
pass over all rows without a shuffle.

Null and empty texts are one chunk of padding. Labels that are null or rows without a text are not learned from; with
labels of one kind or none the score is that share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.llm import text as tx
from gradeframe.llm.rows import apart, prepared

CHUNK, OVERLAP = 256, 32
SAMPLE, SAMPLE_CHUNKS = 1500, 6
KEEP = 0.3
_PAD, _WIDE, _TALL, _FILTERS, _HIDDEN = 256, 6, 8, 24, 16
_STEPS, _BATCH, _RATE = 900, 32, 0.004
_AT_ONCE = 256


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def chunks(off: np.ndarray, data: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Chunk bytes (padded with _PAD) and the chunks of each row; `most`: of a row, spread over its whole length."""
    sizes = np.diff(off)
    counts = np.maximum(1, -(-(sizes - OVERLAP) // (CHUNK - OVERLAP)))
    taken = counts if most is None else np.minimum(counts, most)
    row = np.repeat(np.arange(len(sizes)), taken)
    at = tx.ragged(np.zeros(len(sizes), np.int64), taken)
    if most is not None:
        at = at * (counts[row] - 1) // np.maximum(1, taken[row] - 1)
    start = np.minimum(at * (CHUNK - OVERLAP), np.maximum(0, sizes[row] - CHUNK)) + off[row]
    place = start[:, None] + np.arange(CHUNK)
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    out = padded[np.minimum(place, len(data))].astype(np.int16)
    out[place >= off[row + 1][:, None]] = _PAD
    return out, taken


class Network:
    """Embedding, convolution, max-pooling over the chunk, two dense layers; positive evidence is low quality."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)

        def small(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "embed": small(257, _TALL, scale=0.5),
            "conv": small(_WIDE * _TALL, _FILTERS, scale=(_WIDE * _TALL) ** -0.5),
            "conv0": np.zeros(_FILTERS, np.float32),
            "dense": small(_FILTERS, _HIDDEN, scale=_FILTERS**-0.5),
            "dense0": np.zeros(_HIDDEN, np.float32),
            "out": small(_HIDDEN, 1, scale=_HIDDEN**-0.5),
            "out0": np.zeros(1, np.float32),
        }

    def _windows(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x]
        n, step = len(x), e.strides
        shape = (n, CHUNK - _WIDE + 1, _WIDE * _TALL)
        return np.lib.stride_tricks.as_strided(e, shape, (step[0], step[1], step[2]), writeable=False)

    def _pooled(self, x: np.ndarray, places: bool = False):
        answers = np.ascontiguousarray(self._windows(x)).reshape(-1, _WIDE * _TALL) @ self.p["conv"]
        answers = answers.reshape(len(x), -1, _FILTERS)
        top = answers.max(1) + self.p["conv0"]
        return (top, answers.argmax(1)) if places else (top, None)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """One number for each chunk, worked off in steps of bounded memory."""
        out = np.empty(len(x), np.float32)
        for at in range(0, len(x), _AT_ONCE):
            top, _ = self._pooled(x[at : at + _AT_ONCE])
            h = np.maximum(0, np.maximum(0, top) @ self.p["dense"] + self.p["dense0"])
            out[at : at + _AT_ONCE] = (h @ self.p["out"])[:, 0] + self.p["out0"]
        return out

    def gradients(self, x: np.ndarray, by_chunk) -> dict[str, np.ndarray]:
        """Of a loss whose derivative by each chunk's evidence is by_chunk(evidence)."""
        p = self.p
        top, places = self._pooled(x, places=True)
        a = np.maximum(0, top)
        h = np.maximum(0, a @ p["dense"] + p["dense0"])
        d = by_chunk((h @ p["out"])[:, 0] + p["out0"])[:, None].astype(np.float32)
        g = {"out": h.T @ d, "out0": d.sum(0)}
        d = (d @ p["out"].T) * (h > 0)
        g |= {"dense": a.T @ d, "dense0": d.sum(0)}
        d = (d @ p["dense"].T) * (top > 0)
        g["conv0"] = d.sum(0)
        # only the place of each filter's largest answer has a share
        row = np.arange(len(x))[:, None, None]
        at = places[:, :, None] + np.arange(_WIDE)
        symbols = x[row, at]  # chunk x filter x place in filter
        seen = p["embed"][symbols].reshape(len(x), _FILTERS, _WIDE * _TALL)
        g["conv"] = np.einsum("nf,nfk->kf", d, seen)
        back = (d[:, :, None] * p["conv"].T[None]).reshape(-1, _TALL)
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], symbols.ravel(), back)
        return g


def _leading(evidence: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The weight of each chunk in its document: the third with the most evidence, in equal parts."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((-evidence, row))
    rank = np.empty(len(evidence), np.int64)
    rank[order] = tx.ragged(np.zeros(len(counts), np.int64), counts)
    used = np.maximum(1, counts // 3)
    return np.where(rank < used[row], 1.0 / used[row], 0.0)


def _documents(evidence: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(counts):
        return np.zeros(0)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.add.reduceat(evidence * _leading(evidence, counts), first)


def probability(evidence: np.ndarray) -> np.ndarray:
    """Of label 1."""
    return 1 / (1 + np.exp(np.clip(evidence, -30, 30)))


def fit(samples: list[tuple[np.ndarray, int]], seed: int = 7) -> Network:
    """samples: chunks of a document, and its label."""
    net, r = Network(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    good = sum(label for _, label in samples)
    weight = (len(samples) / (2 * max(1, len(samples) - good)), len(samples) / (2 * max(1, good)))
    step = 0
    while step < _STEPS:
        order = r.permutation(len(samples))
        for at in range(0, len(order), _BATCH):
            part = [samples[i] for i in order[at : at + _BATCH]]
            x = np.concatenate([c for c, _ in part])
            counts = np.array([len(c) for c, _ in part])
            bad = np.array([1 - label for _, label in part], float)
            scale = np.array([weight[label] for _, label in part]) / len(part)

            def by_chunk(evidence, counts=counts, bad=bad, scale=scale):
                share = _leading(evidence, counts)
                d = (1 - probability(_documents(evidence, counts)) - bad) * scale
                return np.repeat(d, counts) * share

            step += 1
            rate = _RATE * max(0.05, 1 - step / _STEPS)
            for k, g in net.gradients(x, by_chunk).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return net


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of an id the one with the least hash of its text: at most a row for each sampled id."""
    least: dict[int, tuple[int, int, bytes]] = {}
    for batch in tx.slices(batches, "text"):
        ids, hashes, labels = (batch.column(c).to_pylist() for c in ("id", "h", "quality"))
        better = [i for i, key in enumerate(ids) if key not in least or hashes[i] < least[key][0]]
        if not better:
            continue
        x, counts = chunks(*tx.buffer(batch.column("text").take(pa.array(better))), most=SAMPLE_CHUNKS)
        raw = x.astype("<i2")
        ends = np.cumsum(counts)
        for i, c, e in zip(better, counts, ends, strict=True):
            if ids[i] not in least or hashes[i] < least[ids[i]][0]:
                least[ids[i]] = (hashes[i], labels[i], raw[e - c : e].tobytes())
    rows = [(key, *value) for key, value in least.items()]
    names, kinds = ["id", "h", "quality", "chunks"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for at in range(0, len(rows), 500):
        columns = zip(*rows[at : at + 500], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """Fits on a bounded sample of the rows that are not held out."""
    prepared(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("id IS NOT NULL AND quality IN (0, 1)").filter(~held_out("id"))
    known = known.groupBy("id").agg(F.min("quality").alias("quality"))
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("quality") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * sample ids
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text IS NOT NULL")
    rows = rows.join(F.broadcast(picked), "id").select("id", F.xxhash64("text").alias("h"), "quality", "text")
    got = rows.mapInArrow(_sampled, "id long, h long, quality int, chunks binary")
    # one row an id, however many rows share it
    got = got.groupBy("id", "quality").agg(F.min_by("chunks", "h").alias("chunks")).collect()
    samples = [(np.frombuffer(r.chunks, "<i2").reshape(-1, CHUNK), r.quality) for r in got]
    samples.sort(key=lambda s: (s[1], s[0].tobytes()))
    good = sum(label for _, label in samples)
    if not 0 < good < len(samples):
        return good / len(samples) if samples else 0.5
    return fit(samples)


def scores(net: Network | float, off: np.ndarray, data: np.ndarray) -> np.ndarray:
    if isinstance(net, float):
        return np.full(len(off) - 1, net)
    x, counts = chunks(off, data)
    return probability(_documents(net.evidence(x).astype(float), counts))


def _scored(net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "__text"):
            score = pa.array(scores(net.value, *tx.buffer(batch.column("__text"))))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*names, "__score"])

    return run


def scored(docs: DataFrame, net: Network | float, text: str = "text") -> DataFrame:
    """The rows with `__score`, the probability of label 1."""
    rows = docs.withColumn("__text", F.col(text))
    schema = rows.withColumn("__score", F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return rows.mapInArrow(_scored(shared), schema).drop("__text")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= KEEP).cast("int").alias("predicted"),
    )


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, columns as they were, whatever their names."""
    rows = scored(apart(docs, "text"), train(docs, labels))
    return rows.filter(F.col("__score") >= KEEP).drop("__score").toDF(*docs.columns)
