"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled texts. A text is cut into blocks, each
block is compressed with either dictionary, and the sums of sizes give the normalised difference
(bad - good) / (bad + good). Endless repetition compresses to next to nothing with either dictionary, which the
difference cannot show, so the logarithm of the better size over the text's own size stands beside it. A logistic
curve over both, fitted on labelled texts that built no dictionary, gives the score: the probability of label 1.

Cases: null and empty text score as the share of label 1 among the texts of the curve; without labels of both
kinds every score is that share (0.5 without labels); labels that are null, or that differ for one id, are left
out of learning; texts of any length are scored whole, block by block; repeated rows score alike; columns called
score or predicted are replaced, other columns are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out, table

BLOCK, LEVEL = 2048, 3


def _blocks(text: bytes) -> list[bytes]:
    return [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; the texts' own last bytes where there are too few to train on."""
    blocks = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(size, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


class Sizes:
    """Compressed sizes of a text with the dictionary of either kind."""

    def __init__(self, dictionaries: list[bytes]):
        self.compress = []
        for d in dictionaries:
            data = zstandard.ZstdCompressionDict(d)
            data.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def features(self, text: str) -> tuple[float, float]:
        """(difference, log ratio) of a text that is not empty."""
        bad = good = 0
        raw = text.encode()
        for b in _blocks(raw):
            bad += len(self.compress[0](b))
            good += len(self.compress[1](b))
        return (bad - good) / (bad + good), math.log(min(bad, good) / len(raw))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[list[float], float]:
    """Weights and share of label 1 of the logistic curve over the columns of x and a constant, by Newton steps on
    columns scaled by their spread, with a small ridge."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    m = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(m.shape[1]), np.diag([*[1e-2] * x.shape[1], 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + ridge, m.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / scale
    return [*slopes.tolist(), float(w[-1] - slopes @ mean)], float(y.mean())


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_bytes: int = 48_000_000, dictionary_size: int = 65_536) -> dict:
    """A model from at most max_rows labelled texts, those with the smallest hashes of their ids, and of those, in this
    order, no more than max_bytes together; only these come to the driver. Of a repeated id the least text counts.
    Every second one builds the dictionaries, the others the curve."""
    marks = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("quality").alias("_p"))
    chosen = marks.filter("_q = _p").select("doc_id", "_q", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").filter(F.length("text") > 0).join(F.broadcast(chosen), "doc_id")  # max_rows ids at most
    rows = rows.groupBy("_h", "doc_id", "_q").agg(F.min("text").alias("text")).orderBy("_h", "doc_id")
    ordered: list[tuple[bytes, int]] = []
    total = 0
    for r in rows.toLocalIterator():
        raw = r.text.encode()
        if total + len(raw) <= max_bytes:
            ordered.append((raw, r._q))
            total += len(raw)
    share = sum(q for _, q in ordered) / len(ordered) if ordered else 0.5
    first, second = ordered[::2], ordered[1::2]
    kinds = [[t for t, q in first if q == k] for k in (0, 1)]
    if not all(kinds) or len({q for _, q in second}) < 2:
        return {"dictionaries": [], "curve": ([0.0, 0.0, 0.0], share)}
    dictionaries = [_dictionary(k, dictionary_size) for k in kinds]
    sizes = Sizes(dictionaries)
    x = np.array([sizes.features(t.decode()) for t, _ in second])
    return {"dictionaries": dictionaries, "curve": _curve(x, np.array([q for _, q in second], float))}


_sizes: dict[tuple, Sizes] = {}


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted (1 from the threshold on)."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double"

    def run(batches):
        (slope, steep, offset), share = model["curve"]
        sizes = None
        if model["dictionaries"]:
            key = tuple(model["dictionaries"])
            sizes = _sizes.get(key) or _sizes.setdefault(key, Sizes(model["dictionaries"]))
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                if not t or sizes is None:
                    out.append(share)
                else:
                    difference, ratio = sizes.features(t)
                    out.append(1 / (1 + math.exp(-min(30.0, max(-30.0, slope * difference + steep * ratio + offset)))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.float64())], names=[*keep, "score"])

    return docs.select(*keep).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
