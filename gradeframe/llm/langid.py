"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; for each bit a binary classifier tells the languages with a 1 from those with a 0 by the
log odds of hashed byte trigrams. The trigrams of all training documents are counted in Spark, a row per language and
bucket and task, and summed; a bit's weights come from these counts. Scoring adds a text's weights bit by bit over the
whole text and takes the codeword with the least logistic loss, each bit weighted by how well it parts its two sides;
a text whose two nearest codewords are close is flagged as ambiguous.

Texts that are null or have no letter get `und` with score 0. Without any training row every text gets `und`. Equal
losses go to the language that comes first in the alphabet. The model holds `BUCKETS` numbers a bit, and a count for
each learned language and bucket passes the driver: fixed by the number of languages, not by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.llm import text as tx
from gradeframe.llm.rows import prepared

BUCKETS = 1 << 16
UNKNOWN = "und"
#: The evidence of a text counts as that of so many trigrams at most, so that scores of long texts stay apart.
EVIDENCE = 60.0
AMBIGUOUS = 0.2
_MULTIPLY = np.uint32(2654435761)

# letters fold to lower case; all other ASCII bytes part words
_FOLD = tx.LETTER_WORDS.copy()
_FOLD[0x30:0x3A] = tx.SPACE


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def grams(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte (row ends and blanks count as one), and the byte's row start offsets.

    A row's bytes are framed by a blank on each side; trigrams without a letter are in bucket 0."""
    folded = np.full(len(data) + 2, tx.SPACE, np.uint8)
    folded[1:-1] = _FOLD[data]
    left, mid, right = folded[:-2].copy(), folded[1:-1], folded[2:].copy()
    starts, ends = off[:-1], off[1:]
    filled = ends > starts
    left[starts[filled]] = tx.SPACE
    right[ends[filled] - 1] = tx.SPACE
    key = (left.astype(np.uint32) << np.uint32(16)) | (mid.astype(np.uint32) << np.uint32(8)) | right
    bucket = (key * _MULTIPLY) >> np.uint32(16)
    bucket[mid == tx.SPACE] = 0
    return bucket.astype(np.int64), off


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in tx.slices(batches, "text"):
        bucket, off = grams(*tx.buffer(batch.column("text")))
        codes = batch.column("lang").dictionary_encode()
        row = np.repeat(codes.indices.to_numpy(), np.diff(off))
        for i, lang in enumerate(codes.dictionary.to_pylist()):
            sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            sums[lang] += np.bincount(bucket[row == i], minlength=BUCKETS)
    for lang, counts in sums.items():
        counts[0] = 1  # tells that the language occurs
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"]
        )


def codewords(k: int) -> np.ndarray:
    """A row of 1 and -1 for each of k languages: all ways to part up to six of them, else random ones."""
    if k <= 6:
        bits = [[1 if j == 0 or b >> (j - 1) & 1 else -1 for j in range(k)] for b in range(max(1, (1 << (k - 1)) - 1))]
        return np.array(bits).T
    n = 12 * int(np.ceil(np.log2(k)))
    signs = np.random.default_rng(k).permuted(np.where(np.arange(k)[:, None] % 2 == 0, 1, -1) * np.ones((1, n), int), axis=0)
    return signs


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x buckets
    trust: np.ndarray  # bits

    def margins(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Log odds of each bit, as if the text had EVIDENCE trigrams at most."""
        out = np.zeros((len(off) - 1, len(self.weights)))
        bucket, _ = grams(off, data)
        filled = np.flatnonzero(np.diff(off) > 0)
        if len(filled):
            for bit, weights in enumerate(self.weights):
                out[filled, bit] = np.add.reduceat(weights[bucket], off[:-1][filled])
            used = np.add.reduceat((bucket > 0).astype(np.int64), off[:-1][filled])
            out[filled] *= np.minimum(1.0, EVIDENCE / np.maximum(1, used))[:, None]
        return out

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its share of exp(-loss) among all, and whether the next one is close."""
        loss = np.stack([(np.logaddexp(0, -margins * c) * self.trust).sum(1) for c in self.code], 1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        top = np.sort(share, 1)[:, ::-1]
        close = top[:, 0] - top[:, 1] < AMBIGUOUS if share.shape[1] > 1 else np.zeros(len(best), bool)
        return best, share[np.arange(len(best)), best], close


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts the trigrams of all rows with a language and makes the bits' weights from them."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL")
    counted = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n"))
    found = counted.toPandas().to_numpy()
    languages = sorted(set(found[:, 0])) if len(found) else []
    place = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    if len(found):
        counts[[place[x] for x in found[:, 0]], found[:, 1].astype(int)] = found[:, 2].astype(float)
    counts[:, 0] = 0
    code = codewords(len(languages)) if languages else np.zeros((0, 1), int)
    used = max(1, int((counts.sum(0) > 0).sum()))
    chance = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * used)
    weights = np.zeros((code.shape[1], BUCKETS))
    trust = np.ones(code.shape[1])
    for bit in range(code.shape[1]):
        one, zero = code[:, bit] == 1, code[:, bit] == -1
        if one.any() and zero.any():
            p, q = chance[one].mean(0), chance[zero].mean(0)
            weights[bit] = np.log(p) - np.log(q)
            trust[bit] = 0.5 * float(np.abs(p - q).sum() / max(p.sum(), q.sum()))
        elif languages:
            weights[bit] = 1e-3 if one.any() else -1e-3
    weights[:, 0] = 0
    return Model(languages, code, weights, trust / max(trust.mean(), 1e-9))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in tx.slices(batches, "text"):
            letters = np.array(batch.column("letters").fill_null(False).to_pylist(), bool)
            if m.languages:
                best, share, close = m.decide(m.margins(*tx.buffer(batch.column("text"))))
                names = [m.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                share, close = np.where(letters, share, 0.0), close & letters
            else:
                names, share = [UNKNOWN] * len(letters), np.zeros(len(letters))
                close = np.zeros(len(letters), bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held"), pa.array(names, pa.string()), pa.array(share), pa.array(close)],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return run


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: predicted language, score and whether the decision is close."""
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(
        F.col(doc_id).alias("id"),
        F.coalesce(held_out(doc_id), F.lit(False)).alias("held"),
        F.col(text).alias("text"),
        F.col(text).rlike(r"\p{L}").alias("letters"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(
        _score(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )


def digest(docs: DataFrame) -> DataFrame:
    model = train(docs.filter(~F.coalesce(held_out("doc_id"), F.lit(False))))
    return predict(docs, model)
