"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Test items are partitioned by the size of their shingle set, by powers of two. Each item is sketched by the
shingles with its least hashes (bottom-k MinHash), as many as its class says: a set of n shingles contained to share c
lacks at most floor((1-c) n), and the class takes that number, for its largest n, and `SPARE` more. A document that
holds the item holds at least the rest of its sketch, so (document, item) is a candidate from that many distinct sketch
hashes on. The search loses nothing at any document length, where signatures of whole documents would need a length in
proportion to the document. Documents' shingle hashes are probed against the sketches (class, item, hash) as they are
made: the sketch table is broadcast below a counted size and shuffled beyond it. Candidates alone are verified: each
document comes once to the shingle lists of its candidate items, and shared distinct shingles, as words and not as
hashes, are counted by intersection.

Cases: with fewer words than a shingle, a text's whole sequence is its one shingle; null, empty and blank texts
have none and neither hold nor match anything; equal items match alike under each id, rows that repeat an item id
are one item with all their shingles, rows that repeat a doc_id give one row of the most any of their texts
shares; rows with a null id are ignored; columns beyond the ids and text are ignored; empty tables match nothing. An
item of fewer words than a shingle is contained only in texts that are this sequence: a word or two inside a longer
text is no sign of contamination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import bound
from .shared import ascii_lower, broadcast_if_small, table, written

SPARE = 3
#: Bytes of item lists up to which they are broadcast.
LIST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _each(words: str | Column, size: int, one, whole) -> Column:
    """one(i) for every place where a shingle of the words column starts; [whole] where there are too few words."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), n - size + 1), one)
    return F.when(n >= size, many).when(n > 0, F.array(whole))


def shingle_words_all(words: str | Column, size: int) -> Column:
    """The shingles of a column of words, not made distinct."""
    return _each(words, size, lambda i: F.array_join(F.slice(words, i, size), " "), F.array_join(words, " "))


@bound
def _shingles_of(words: Column, size: int) -> Column:
    return shingle_words_all(words, size)


def shingle_words_of(text: Column, size: int) -> Column:
    """The shingles of a text, not made distinct."""
    return _shingles_of(words_of(text), size)


def shingle_hashes(words: str, size: int) -> Column:
    """64-bit hashes of the shingles, not made distinct."""
    at = lambda i, k: F.get(F.col(words), i + (k - 1))
    return _each(words, size, lambda i: F.xxhash64(*(at(i, k) for k in range(size))), F.xxhash64(words))


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """(class, item_id, need, h): sketch hashes by size class, and how many of them a document must hold. items:
    (item_id, h) hashes of shingles, distinct."""
    lacks = lambda n: F.floor(n * (100 - percent) / 100)
    order = F.array_sort(F.transform(F.collect_list("h"), lambda h: F.struct(F.xxhash64(F.lit(5), h).alias("o"), h.alias("h"))))
    sets = items.groupBy("item_id").agg(F.count("*").alias("n"), order.alias("order")).withColumn("class", F.floor(F.log2("n")).cast("int"))
    take = lacks(F.pow(F.lit(2), F.col("class") + 1) - 1) + SPARE  # for the largest size of the class
    sets = sets.withColumn("take", F.least(take, F.col("n")).cast("int"))
    need = F.greatest(F.lit(1), F.col("take") - lacks(F.col("n"))).cast("int")
    return sets.select("class", "item_id", need.alias("need"), F.explode(F.slice("order", F.lit(1), F.col("take"))).alias("x")).select("class", "item_id", "need", "x.h")


def contaminated(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of documents that hold at least percent of an item's
    distinct shingles."""
    docs = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    tests = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long"), words_of(F.col("text")).alias("w"))
    both = F.arrays_zip(shingle_words_all("w", words).alias("s"), shingle_hashes("w", words).alias("h"))
    tests = written(tests.select("item_id", F.explode(both).alias("x")).select("item_id", "x.s", "x.h").distinct(), "bench-shingles")
    probe = written(sketches(tests.select("item_id", "h").distinct(), percent), "bench-sketches")
    made = docs.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", F.explode(shingle_hashes("w", words)).alias("h"))
    hits = made.join(broadcast_if_small(probe, probe.count()), "h")
    found = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("held"), F.min("need").alias("need")).filter("held >= need")
    found = written(found.select("doc_id", "item_id"), "bench-candidates")
    lists = written(tests.select("item_id", "s").distinct().groupBy("item_id").agg(F.collect_list("s").alias("s")), "bench-lists")
    least = lists.agg(F.sum(F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.length(x) + 16))).first()[0] or 0
    wanted = found.join(broadcast_if_small(lists, least, LIST_BYTES), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "s")).alias("items"))
    wanted = written(wanted, "bench-wanted")
    n = wanted.count()
    few = docs.join(broadcast_if_small(wanted.select("doc_id"), n), "doc_id", "left_semi")  # before the lists, so that texts without a candidate stay where they are
    held = few.join(wanted, "doc_id").select("doc_id", "items", shingle_words_of(F.col("text"), words).alias("own"))
    shared = held.select("doc_id", F.explode(_shared(F.col("items"), F.col("own"))).alias("x")).select("doc_id", "x.*")
    best = shared.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared")).filter(100 * F.col("n_shared") >= percent * F.col("n_item"))
    return best.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


@bound
def _shared(items: Column, own: Column) -> Column:
    """(item_id, n_item, n_shared) of each candidate item."""
    return F.transform(items, lambda x: F.struct(x["item_id"].alias("item_id"), F.size(x["s"]).cast("long").alias("n_item"), F.size(F.array_intersect(x["s"], own)).cast("long").alias("n_shared")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Shingles of a relation, as SQL; {0} id, {1} table.
SHINGLES_SQL = r"""
  SELECT DISTINCT {0}, s FROM (
    SELECT {0}, CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]
                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS ss
    FROM (SELECT {0}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {1} WHERE {0} IS NOT NULL)
  ), LATERAL unnest(ss) u(s)
"""
LEAKS_SQL = """
tests AS ({items}),
sizes AS (SELECT item_id, count(*) AS n_item FROM tests GROUP BY item_id),
leaks AS (
  SELECT doc_id, item_id, n_item, count(*) AS n_shared
  FROM ({docs}) d JOIN tests USING (s) JOIN sizes USING (item_id)
  GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
)
"""
OP9_SQL = f"""
WITH {LEAKS_SQL.format(items=SHINGLES_SQL.format('item_id', 'benchmark'), docs=SHINGLES_SQL.format('doc_id', 'documents'))}
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM leaks
"""
