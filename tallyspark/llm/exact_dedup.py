"""Exact dedup (7): two-pass Bloom filtering; only rows that may be repeated shuffle.

Pass one reads every text, normalises its white space and writes (doc_id, digest, hash); each task adds
its hashes to a two-plane Bloom filter (``repeats``). Pass two probes that filter: a row that surely is
unique goes straight through; the others meet by digest in a grouped minimum with partial
aggregation, so a group that holds a third of all rows sends one row from each task.

Edge cases: a null text counts as empty; null doc_ids order last and ``keep_id`` is null only where a
group has no other; repeated rows (same doc_id and text) count in ``group_size`` and exactly one of them
is kept; an empty table gives an empty result; extra columns of any name stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import BROADCAST_ROWS, SPACES, fresh, scratch, semi, table, written
from tallyspark.llm.repeats import may_repeat, repeat_filter

#: A group of more rows is never shuffled to one task.
HOT = 100_000


def digest(text: Column) -> Column:
    """Bare hexadecimal SHA-256 of the text with each run of white space as one blank."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256)


def _prepared(docs: DataFrame, id_col: str, text_col: str):
    """The hashed table, the broadcast filter and the row that stays of each group that may be repeated."""
    hashed = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"))
    hashed = written(hashed.select("*", F.xxhash64("digest").alias("h"), F.monotonically_increasing_id().alias("row")), "hashed")
    sent = docs.sparkSession.sparkContext.broadcast(repeat_filter(hashed.select("h"), hashed.count()))
    maybe = hashed.where(may_repeat(sent, F.col("h")))
    groups = maybe.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count("*").alias("n"),
    )
    groups = written(groups.select("digest", F.col("first.id").alias("keep"), F.col("first.row").alias("keep_row"), "n"), "groups")
    return hashed, sent, maybe, groups


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256."""
    hashed, sent, maybe, groups = _prepared(docs, id_col, text_col)
    alone = hashed.where(~may_repeat(sent, F.col("h"))).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256")
    )
    met = _met(maybe, groups).select(
        "id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    return alone.unionByName(met).withColumnRenamed("id", id_col)


def _met(maybe: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with their groups. Groups are sent to the rows if they are few; beyond that at least the large ones are.

    There are at most rows / HOT large groups, so a text that a third of all rows have never meets in one task.
    """
    if groups.count() <= BROADCAST_ROWS // 5:  # about 15 MB of digests and ids at most
        return maybe.join(F.broadcast(groups), "digest")
    hot = F.broadcast(groups.where(F.col("n") > HOT))
    cold = maybe.join(hot, "digest", "left_anti").join(groups.where(F.col("n") <= HOT), "digest")
    return maybe.join(hot, "digest").unionByName(cold)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the smallest id.

    Rows that surely are unique are not shuffled. The rest meet the rows that stay by (digest, id), in a broadcast
    if those are counted few, else spread over all partitions however large a group is; only rows that
    stay, and their repetitions, shuffle with their texts.
    """
    with scratch(docs.sparkSession) as kept:
        _, sent, _, groups = _prepared(docs, id_col, text_col)
        kept.append(groups)
    d, h = fresh(docs, "digest", "h")
    marked = docs.withColumn(d, digest(F.col(text_col))).withColumn(h, F.xxhash64(d))
    alone = marked.where(~may_repeat(sent, F.col(h)))
    first = semi(marked.where(may_repeat(sent, F.col(h))), groups.select("digest", "keep"), [(d, "digest"), (id_col, "keep")])
    first = first.dropDuplicates([d, id_col])
    return alone.unionByName(first).select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
