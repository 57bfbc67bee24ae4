"""Benchmark decontamination (10): winnowed fingerprints, joined and extended. DataFrame operations only.

Words are hashed, each run of GRAM words is one hash, and of every SPAN consecutive such hashes the
smallest is kept as a fingerprint. Two texts that share ``GRAM + SPAN - 1`` words in a row (13, a window)
keep the same smallest hash inside that run, so no shared window is missed. Where the benchmark has shorter
items, SPAN shrinks to what their length allows; items shorter than GRAM words get a pass of their own
with grams of their length. A document's fingerprints meet the benchmark's in a broadcast join inside the
scan, so only hits leave the task; each hit is extended to the left and right word by word, which also
rules out hash collisions, and counts if it covers a whole window.

The benchmark's side of the join is bounded: items are cut into overlapping pieces of PIECE words and
dealt into blocks of about BLOCK_ROWS fingerprints, each of which is one broadcast; more blocks take more
passes over the documents.

Edge cases: null and empty texts have no words and no hits; items without words are never met; items
with a null id make hits but are not counted in n_items; several items with one id count once; repeated
rows each get their row; an empty benchmark or documents table gives no hits or no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import fresh, semi, table, written

WINDOW = 13
GRAM = 5
PIECE = 256
#: Each row carries its piece, about 5 kB, so a block is about 100 MB.
BLOCK_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _positions(n: Column) -> Column:
    """0 .. n-1; empty where n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: str, gram: int) -> Column:
    return F.transform(_positions(F.size(hashes) - (gram - 1)), lambda i: F.xxhash64(*(F.get(F.col(hashes), i + j) for j in range(gram))))


def _minima(grams: str, span: int) -> Column:
    if span == 1:
        return F.array_distinct(grams)
    low = lambda i: F.least(*(F.get(F.col(grams), i + j) for j in range(span)))
    return F.array_distinct(F.transform(_positions(F.size(grams) - (span - 1)), low))


# An inner explode would have the optimiser infer a filter on its array and push it down, which writes the
# expression of every gram into each element's lambda; explode_outer infers none, and nulls are dropped behind it.
def _fingerprints(df: DataFrame, gram: int, span: int) -> DataFrame:
    """Adds ``grams`` and ``prints`` to rows with ``words``."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("grams", _grams("hashes", gram))
    return df.withColumn("prints", _minima("grams", span)).drop("hashes")


def _plan(items: DataFrame) -> list[tuple[int, int, int, int]]:
    """(gram, span, shortest, longest): how items of these lengths are fingerprinted. At most GRAM entries."""
    lengths = {r[0] for r in items.select(F.least(F.col("length"), F.lit(WINDOW)).alias("n")).distinct().collect()}
    out = [(n, 1, n, n) for n in sorted(lengths) if n < GRAM]
    if rest := [n for n in lengths if n >= GRAM]:
        out.append((GRAM, min(rest) - GRAM + 1, min(rest), 2**31 - 1))
    return out


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, words, length: the benchmark in pieces that share WINDOW - 1 words."""
    b = benchmark.select(
        F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("all"),
    ).where(F.size("all") > 0).distinct()
    starts = F.when(
        F.size("all") > PIECE, F.sequence(F.lit(0), F.size("all") - WINDOW, F.lit(PIECE - WINDOW + 1)),
    ).otherwise(F.array(F.lit(0)))
    b = b.select("item", "all", F.explode(starts).alias("at"))
    return b.select("item", F.slice("all", F.col("at") + 1, F.lit(PIECE)).alias("words")).withColumn("length", F.size("words"))


def hit_spans(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """Rows of id, digest, n_words, item, start, end: one with null item for each document, and one for each extended hit."""
    items = written(_items(benchmark, item_col, item_text), "items")
    base = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), words(F.col(text_col)).alias("words"),
    ).withColumn("n_words", F.size("words").cast("long"))
    head = lambda prints: F.concat(F.array(F.lit(None).cast("long")), prints)  # noqa: E731  the null stands for the document itself
    out, first = [], True
    for gram, span, low, high in _plan(items):
        some = _fingerprints(items.where(F.col("length").between(low, high)), gram, span)
        some = some.select(
            "item", F.col("words").alias("item_words"), "length", "grams", F.explode_outer("prints").alias("item_print"),
        ).where(F.col("item_print").isNotNull())
        some = some.select(
            "item", "item_words", "length", "item_print",
            F.explode_outer(
                F.filter(_positions(F.size("grams")), lambda i: F.get(F.col("grams"), i) == F.col("item_print"))
            ).alias("item_at"),
        )
        some = written(some, "prints")
        blocks = max(1, -(-some.count() // BLOCK_ROWS))
        for k in range(blocks):
            block = some if blocks == 1 else some.where(F.pmod(F.xxhash64("item", "item_words"), F.lit(blocks)) == k)
            d = _fingerprints(base, gram, span)
            d = d.select(
                "id", "digest", "n_words", "words", "grams",
                F.explode_outer(head(F.col("prints")) if first else F.col("prints")).alias("print"),
            )
            d = d.join(F.broadcast(block), F.col("print") == F.col("item_print"), "left" if first else "inner")
            d = d.where(F.col("print").isNull() | F.col("item_print").isNotNull()) if first else d
            out.append(_extended(d))
            first = False
    if first:  # no item has words
        nothing = F.lit(None)
        return base.select(
            "id", "digest", "n_words", nothing.cast("string").alias("item"), nothing.cast("int").alias("start"),
            nothing.cast("int").alias("end"), F.lit(True).alias("own"),
        )
    return reduce(DataFrame.unionByName, out)


def _extended(met: DataFrame) -> DataFrame:
    """Each meeting of fingerprints, stretched over the equal words around it; kept if it covers a window."""
    own = F.col("print").isNull()
    places = F.filter(_positions(F.size("grams")), lambda i: F.get(F.col("grams"), i) == F.col("print"))
    met = met.select(
        "id", "digest", "n_words", "words", own.alias("own"), "item", "item_words", "length", "item_at",
        F.explode(F.when(own, F.array(F.lit(0))).otherwise(places)).alias("at"),
    )
    same = F.transform(
        _positions(F.col("length")),
        lambda i: F.coalesce(F.get("words", F.col("at") - F.col("item_at") + i) == F.get(F.col("item_words"), i), F.lit(False)),
    )
    met = met.withColumn("same", F.when(~F.col("own"), same))
    miss = lambda part: F.array_position(part, False).cast("int")
    left, right = miss(F.reverse(F.slice("same", 1, F.col("item_at")))), miss(F.slice("same", F.col("item_at") + 1, F.col("length")))
    met = met.withColumn("left", F.when(left == 0, F.col("item_at")).otherwise(left - 1))
    met = met.withColumn("right", F.when(right == 0, F.col("length") - F.col("item_at")).otherwise(right - 1))
    met = met.where(F.col("own") | (F.col("left") + F.col("right") >= F.least(F.col("length"), F.lit(WINDOW))))
    return met.select(
        "id", "digest", "n_words", "item", F.when(~F.col("own"), F.col("at") - F.col("left")).alias("start"),
        F.when(~F.col("own"), F.col("at") + F.col("right")).alias("end"), "own",
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text",
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, and its text's digest."""
    g = hit_spans(docs, benchmark, id_col, text_col, item_col, item_text).groupBy("id", "digest").agg(
        F.max("n_words").alias("n_words"), F.count_if("own").alias("rows"), F.collect_set(
            F.when(~F.col("own"), F.struct("start", "end"))
        ).alias("spans"), F.sort_array(F.collect_set("item")).alias("items")
    )
    covered = F.aggregate(
        F.sort_array("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n"),
            F.greatest(a["to"], s["end"]).alias("to"),
        ),
    )["n"].cast("long")
    g = g.withColumn("n_hit", covered).select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "digest", "rows",
    )
    return g.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("copy", "rows")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` without the contaminated ones; the others are not shuffled unless the dropped keys are too many to broadcast."""
    bad = contamination(docs, benchmark, id_col, text_col).where("contaminated").select(
        F.col(id_col).alias("bad_id"), F.col("digest").alias("bad_digest"),
    ).distinct()
    (d,) = fresh(docs, "digest")
    marked = docs.withColumn(d, F.xxhash64(text_col))
    return semi(marked, written(bad, "contaminated"), [(id_col, "bad_id"), (d, "bad_digest")], "left_anti").select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("digest")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), n AS (SELECT DISTINCT n FROM v),
p AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2))
  AS i FROM d, n)
), h AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM p JOIN v ON p.n = v.n AND p.gram = v.gram),
k AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id,
  CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
