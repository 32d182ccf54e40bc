"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line keys (128-bit hash, number of documents, largest document id), hashed into buckets
and sorted within them, kept in the shared folder. Documents come in batches, dealt by their id. A batch's keys are
merge-anti-joined with every run, bucket by bucket: those that no run holds become a run of their own, so no key is in
two runs; the others are kept beside it as further counts, which only repeated lines have. When a level holds `fanout`
runs they are compacted into one run of the next level. Runs have the same buckets and one sorted file for each, so
neither the anti-join nor the compaction shuffles or sorts a run that is read; only a batch's own keys are shuffled,
counted before by each task.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. A key of at least
`min_chars` code points that at least `min_docs` documents hold loses all its lines but those of the largest
document id that holds it.

Cases: null or empty text is one empty line; a document with a null id keeps its whole text and counts
nowhere; rows that repeat an id count as one document, and each keeps or loses its own lines; columns called
n_lines or n_dropped are replaced, other columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, drop_path, new_path, released, shuffle_partitions, small_batches, table, written

_SPACE = b" \t\n\x0b\x0c\r"


def _key_hash(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes for a line whose key is long enough."""
    key = line.strip(_SPACE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2): each eligible key of a document once."""

    def run(batches):
        for b in batches:
            ids, halves = [], ([], [])
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if i is None or not text:
                    continue
                for h in {_key_hash(x, min_chars) for x in text.encode().split(b"\n")} - {None}:
                    ids.append(i)
                    halves[0].append(int.from_bytes(h[:8], "little", signed=True))
                    halves[1].append(int.from_bytes(h[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, *halves)], names=["doc_id", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, h1 long, h2 long")


_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def _sorted_scans(spark: SparkSession):
    """Within it, a scan of a run counts as sorted: each bucket is one file."""
    old = spark.conf.get(_SORTED)
    spark.conf.set(_SORTED, "true")
    try:
        yield
    finally:
        spark.conf.set(_SORTED, old)


class LineRuns:
    """The runs, level by level, and the further counts of keys that older runs hold."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.buckets = spark, fanout, shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        self.tables: dict[str, str] = {}  # name -> path
        self.further: list[str] = []

    def _write(self, df: DataFrame) -> str:
        """Writes (h1, h2, n_docs, max_doc, fresh), dealt by (h1, h2) already, and gives the table's name. The two kinds
        of rows are partitions, so a run's scan reads fresh rows alone."""
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        with _sorted_scans(self.spark):
            df.write.partitionBy("fresh").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        self.tables[name] = path
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, self.tables.pop(name))

    def clear(self) -> None:
        for name in list(self.tables):
            self._drop(name)
        self.levels, self.further = [], []

    def runs(self) -> list[DataFrame]:
        return [self._run(name) for level in self.levels for name in level]

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("fresh").select("h1", "h2", "n_docs", "max_doc")

    def marked(self, keys: DataFrame) -> DataFrame:
        """keys with fresh: whether no run holds them. One merge with each run; keys are dealt like the buckets by the
        aggregation that made them, and the hint keeps the join a merge."""
        seen = []
        for k, run in enumerate(self.runs()):
            keys = keys.hint("merge").join(run.select("h1", "h2", F.lit(True).alias(f"_s{k}")), ["h1", "h2"], "left")
            seen.append(F.col(f"_s{k}").isNull())
        fresh = reduce(lambda a, b: a & b, seen, F.lit(True))
        return keys.select("h1", "h2", "n_docs", "max_doc", fresh.alias("fresh"))

    def add(self, lines: DataFrame) -> None:
        """Takes in a batch of (doc_id, h1, h2)."""
        once = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        counted = once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        name = self._write(self.marked(counted))
        if self.runs():
            self.further.append(name)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        k = 0
        while len(self.levels[k]) >= self.fanout:
            if k + 1 == len(self.levels):
                self.levels.append([])
            old, self.levels[k] = self.levels[k], []
            whole = old[0]
            for run in old[1:]:
                parts, whole = (whole, run), self._write(self.merged(self._run(whole), self._run(run)))
                for done in parts:
                    if done not in self.further:
                        self._drop(done)
            self.levels[k + 1].append(whole)
            k += 1

    @staticmethod
    def merged(run: DataFrame, other: DataFrame) -> DataFrame:
        """Two runs, which have no key in common, as one: sorted files are merged bucket by bucket."""
        more = other.select("h1", "h2", F.col("n_docs").alias("_n"), F.col("max_doc").alias("_m"))
        both = run.hint("merge").join(more, ["h1", "h2"], "full")
        return both.select("h1", "h2", F.coalesce("n_docs", "_n").alias("n_docs"), F.coalesce("max_doc", "_m").alias("max_doc"), F.lit(True).alias("fresh"))

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, max_doc) of keys that at least min_docs documents hold."""
        counts = [self.spark.table(n).filter("NOT fresh").select("h1", "h2", "n_docs", "max_doc") for n in self.further]
        whole = reduce(DataFrame.unionByName, self.runs())
        if counts:
            more = reduce(DataFrame.unionByName, counts).groupBy("h1", "h2").agg(F.sum("n_docs").alias("_n"), F.max("max_doc").alias("_m"))
            joined = [r.join(more, ["h1", "h2"], "left") for r in self.runs()]
            whole = reduce(DataFrame.unionByName, joined).select(
                "h1", "h2", (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "_m").alias("max_doc")
            )
        return whole.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "max_doc")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with the repeated lines gone from `text`, and n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    small_batches(spark)
    path = new_path(spark, "line-keys")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    line_keys(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("doc_id long, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    for k in range(batches):
        runs.add(keys.filter(F.col("batch") == k).drop("batch"))
    with _sorted_scans(spark):
        gone = written(runs.repeated(min_docs), "line-repeated")
    runs.clear()
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own_id, own_gone = (next(f"_{x}{k}" for k in range(len(keep) + 1) if f"_{x}{k}" not in keep) for x in ("id", "gone"))
    hits = (
        keys.join(broadcast_if_small(gone, gone.count(), 100_000), ["h1", "h2"])
        .filter(F.col("doc_id") != F.col("max_doc"))
        .groupBy(F.col("doc_id").alias(own_id))
        .agg(F.collect_set(F.struct("h1", "h2")).alias(own_gone))
    )
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_lines long, n_dropped long"
    at = keep.index("text")

    def run(batches_):
        for b in batches_:
            texts, lines, dropped = [], [], []
            for text, hit in zip(b.column("text").to_pylist(), b.column(own_gone).to_pylist()):
                rows = (text or "").encode().split(b"\n")
                lines.append(len(rows))
                if hit:
                    drop = {h["h1"].to_bytes(8, "little", signed=True) + h["h2"].to_bytes(8, "little", signed=True) for h in hit}
                    rows = [x for x in rows if _key_hash(x, min_chars) not in drop]
                    text = b"\n".join(rows).decode()
                texts.append(text)
                dropped.append(lines[-1] - len(rows))
            columns = [b.column(c) for c in keep]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*keep, "n_lines", "n_dropped"])

    found = docs.select(*keep).join(hits, F.col("doc_id").cast("long") == F.col(own_id), "left").drop(own_id)
    return found.mapInArrow(released(run), schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The kept lines of every document, as a relation `kept`.
KEPT_SQL = r"""
lines AS (
  SELECT doc_id, i, parts[i] AS line, length(parts) AS n,
         translate(regexp_replace(parts[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {docs}), LATERAL unnest(range(1, length(parts) + 1)) u(i)
),
gone AS (
  SELECT k, max(doc_id) AS stays FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
),
kept AS (
  SELECT doc_id, any_value(n) AS n_lines, count(stays) FILTER (doc_id <> stays) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays IS NULL OR stays = doc_id), '') AS text
  FROM lines LEFT JOIN gone USING (k) GROUP BY doc_id
)
"""
OP1_SQL = "WITH " + KEPT_SQL.replace("{docs}", "documents") + """
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(text) AS kept_sha256 FROM kept
"""
