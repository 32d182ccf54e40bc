"""Language identification by hyperdimensional profiles.

Each letter has a random +1/-1 vector that follows from the letter alone. The vector of an n-gram binds the
letters' vectors, each rotated by its place, by elementwise product; a text's profile bundles (sums) the
vectors of its n-grams. A language's prototype bundles the unit profiles of its learning texts. A text gets the
language whose prototype has the largest cosine with its profile; ties go to the first in code point order.

Letters of any script are lower-cased; a run of other characters is one blank, so n-grams also hold word ends. The
vectors of n-grams are made on first use and kept up to `CACHE`, then begun anew, so memory is bounded for any alphabet.

Cases: null text, empty text and text without a letter get `und` and score 0; with nothing to learn from, all
texts do; a text of any length is taken in pieces that
split no n-gram; documents that repeat are judged alike; columns called
held_out, lang_pred or score are replaced, other columns are kept.
"""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out, released, small_batches, table

PIECE, CACHE, CHUNK = 1 << 20, 1 << 16, 4096
#: A unit profile as whole numbers, so that sums do not depend on their order.
UNIT = 1 << 20
BITS = 21  # of a code point


def _letter_vector(code: int, dim: int) -> np.ndarray:
    """The +1/-1 vector of a code point (code 0: blank)."""
    return np.random.Generator(np.random.PCG64([code, 77])).integers(0, 2, dim, dtype=np.int8) * 2 - 1


class Profiles:
    """n-gram vectors."""

    def __init__(self, n: int = 3, dim: int = 1024):
        if n * BITS > 63:
            raise ValueError("n-grams have 3 letters at most")
        self.n, self.dim = n, dim
        self._plain = np.array([chr(c).isalpha() for c in range(0x250)])
        self._rest: dict[int, bool] = {}
        self._rotated: dict[int, list[np.ndarray]] = {}
        self.vectors: dict[int, int] = {}
        self.matrix = np.empty((CHUNK, dim), np.int8)

    def _letters(self, low: str) -> np.ndarray:
        """Code points of a lower-cased text, 0 for all but letters."""
        points = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        small = points < len(self._plain)
        alpha = self._plain[np.where(small, points, 0)]
        if not small.all():
            used, place = np.unique(points[~small], return_inverse=True)
            for c in used.tolist():
                if c not in self._rest:
                    self._rest[c] = chr(c).isalpha()
            alpha[~small] = np.array([self._rest[c] for c in used.tolist()])[place]
        return np.where(alpha, points, 0)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a text and how often each occurs. The text has a blank at each end; runs of blanks are
        one."""
        low, found, tail = text.lower(), {}, np.zeros(1, np.int64)
        for k in range(0, max(1, len(low)), PIECE):
            c = np.concatenate((tail, self._letters(low[k : k + PIECE]), [0] if k + PIECE >= len(low) else []))
            c = c[(c > 0) | np.r_[True, c[:-1] > 0]].astype(np.int64)
            tail = c[len(c) - min(len(c), self.n - 1) :]
            gram = c[: max(0, len(c) - self.n + 1)].copy()
            for j in range(1, self.n):
                gram = gram << BITS | c[j : j + len(gram)]
            codes, n = np.unique(gram, return_counts=True)
            if len(low) <= PIECE:
                return codes, n
            for g, m in zip(codes.tolist(), n.tolist()):
                found[g] = found.get(g, 0) + m
        return np.array(sorted(found), np.int64), np.array([found[g] for g in sorted(found)], np.int64)

    def _turned(self, code: int) -> list[np.ndarray]:
        """The vector of a code point, rotated by each place."""
        found = self._rotated.get(code)
        if found is None:
            if len(self._rotated) >= CACHE // 16:
                self._rotated.clear()
            v = _letter_vector(code, self.dim)
            found = self._rotated[code] = [np.roll(v, k) for k in range(self.n)]
        return found

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the matrix that hold the vectors of at most CHUNK n-grams."""
        if len(self.vectors) + len(codes) > CACHE:
            self.vectors.clear()
        rows = []
        for g in codes.tolist():
            row = self.vectors.get(g)
            if row is None:
                row = self.vectors[g] = len(self.vectors)
                if row == len(self.matrix):
                    self.matrix = np.concatenate((self.matrix, np.empty_like(self.matrix)))
                v, rest = np.ones(self.dim, np.int8), g
                for k in range(self.n):
                    v = v * self._turned(rest & (1 << BITS) - 1)[k]
                    rest >>= BITS
                self.matrix[row] = v
            rows.append(row)
        return np.array(rows, np.int64)

    def profile(self, text: str) -> np.ndarray:
        codes, n = self.counts(text)
        total = np.zeros(self.dim, np.float32)
        for k in range(0, len(codes), CHUNK):
            rows = self._rows(codes[k : k + CHUNK])
            total += n[k : k + CHUNK].astype(np.float32) @ self.matrix[rows].astype(np.float32)
        return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def learn(docs: DataFrame, per_lang: int = 3000, n: int = 3, dim: int = 1024) -> dict:
    """Prototypes of the languages of docs (text, lang; rows without either are left out), from about per_lang
    texts of each language: a row counts if the hash of its id falls below its language's share, so the sample
    is the same on every run. Each task sums its texts by language, and the sums, no more than the sample has texts,
    are summed by language on executors; one vector for each language comes to the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    size = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not size:
        return {"langs": [], "prototypes": np.zeros((0, dim), np.float32), "n": n, "dim": dim}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = spark.createDataFrame([(k, min(1 << 20, int((1 << 20) * per_lang / v) + 1)) for k, v in size.items()], "lang string, _share long")
    sample = docs.join(F.broadcast(share), "lang").filter(draw < F.col("_share")).select("text", "lang")  # a row for each language

    def bundle(batches):
        p, sums = Profiles(n, dim), {}
        for b in batches:
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                if has_letter(t):
                    v = p.profile(t).astype(np.float64)
                    sums[lang] = sums.get(lang, 0) + np.rint(v * (UNIT / max(float(np.linalg.norm(v)), 1e-9))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    def total(key, rows):
        v = np.asarray(rows.column("v").combine_chunks().flatten()).reshape(rows.num_rows, dim).sum(0)
        return pa.table({"lang": pa.array([key[0].as_py()]), "v": pa.array([v.tolist()], pa.list_(pa.int64()))})

    kind = "lang string, v array<long>"
    sums = {r.lang: np.array(r.v, float) for r in sample.mapInArrow(released(bundle), kind).groupBy("lang").applyInArrow(total, kind).collect()}
    langs = sorted(sums)
    protos = np.array([sums[k] / max(np.linalg.norm(sums[k]), 1e-9) for k in langs], np.float32).reshape(len(langs), dim)
    return {"langs": langs, "prototypes": protos, "n": n, "dim": dim}


_profiles: dict[tuple, Profiles] = {}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred and score, the cosine with the predicted language's prototype (0 where negative)."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double"

    def run(batches):
        key = (model["n"], model["dim"])
        p = _profiles.get(key) or _profiles.setdefault(key, Profiles(*key))
        for b in batches:
            langs, scores = [], []
            for t in b.column("text").to_pylist():
                if not model["langs"] or not has_letter(t):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                v = p.profile(t)
                cos = model["prototypes"] @ v / max(float(np.linalg.norm(v)), 1e-9)
                k = int(np.argmax(cos))
                langs.append(model["langs"][k])
                scores.append(min(1.0, max(0.0, float(cos[k]))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep).mapInArrow(released(run), schema)


def identify(docs: DataFrame) -> DataFrame:
    """docs with lang_pred and score, learnt from the rows of docs that are not held out."""
    return predict(docs, learn(docs.filter(~held_out(F.col("doc_id")))))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
