"""Source divergence audit (11): how far the sources of each language are apart, word by word.

Identical texts of a language are collapsed first: each text stands once with the number of its copies in every source
(``collapsed``). A Bloom filter tells which texts may have copies; the others pass straight through. Each distinct text
is then taken apart once (``tallied``), and its words count with the copies as weight, both as occurrences of a
source and as documents. What a task has met is summed before it shuffles, so a word that every document has sends one
row from each task and source.

Pairs of sources are compared over words that both have, and in closed form elsewhere (``pair_values``): a kept word that
a source lacks has the same share there whatever the word, so the distance over a source's own words to that share is a
sum over its distinct counts, and the words that neither has are one product. No row is made for an absent word.

All arithmetic is in whole numbers: shares are parts of SCALE, rounded down, from decimals of 38 digits.

Edge cases: null text, lang and source count as empty strings; a text without words counts as a document of its group;
groups without kept words have pairs of value 0 where the language keeps none, and no words; languages with one
source have no pairs; repeated rows count each; an empty table gives an empty result; extra columns are passed over.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import BROADCAST_ROWS, scratch, table, written
from tallyspark.llm.repeats import may_repeat, repeat_filter

SCALE = 1_000_000_000
#: Words that a task counts before it hands them on.
HELD = 1_000_000
#: Bytes of UTF-8 that belong to a word, with A-Z lower-cased; all others part words.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def collapsed(docs: DataFrame) -> DataFrame:
    """lang, text, copies (array of source, n): each distinct text of a language once."""
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    read = read.withColumn("h", F.xxhash64("lang", "text"))
    hashes = written(read.select("h"), "texts")
    sent = docs.sparkSession.sparkContext.broadcast(repeat_filter(hashes, hashes.count()))
    one = F.struct("source", F.lit(1).cast("long").alias("n"))
    alone = read.where(~may_repeat(sent, F.col("h"))).select("lang", "text", F.array(one).alias("copies"))
    met = read.where(may_repeat(sent, F.col("h"))).groupBy("lang", "text", "source").agg(F.count("*").alias("n"))
    met = met.groupBy("lang", "text").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    return alone.unionByName(met)


def tallied(texts: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents), summed by task only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: defaultdict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = 0
        for batch in batches:
            texts = pc.cast(batch.column(1), pa.binary())
            for lang, text, copies in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                words = text.as_py().translate(LETTERS).split()
                once = set(words)
                for c in copies:
                    n, docs = met[lang, c["source"], c["n"]]
                    n.update(words)
                    docs.update(once)
                    held += len(words)
                if held > HELD:
                    yield from rows(met)
                    met.clear()
                    held = 0
        yield from rows(met)

    def rows(met) -> Iterator[pa.RecordBatch]:
        for (lang, source, weight), (n, docs) in met.items():
            if n:
                same = lambda s, k=len(n): pa.array([s], pa.string()).take(pa.array([0] * k, pa.int32()))
                by = lambda xs, w=weight: pc.multiply(pa.array(xs, pa.int64()), w)
                terms = pc.cast(pa.array(list(n), pa.binary()), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [same(lang), same(source), terms, by(list(n.values())), by([docs[t] for t in n])], ["lang", "source", "term", "n", "docs"]
                )

    return texts.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """lang, term, source, n, all_n, lead: counts of the words that at least ``min_docs`` documents of their language have.

    ``all_n``: of the whole language; ``lead``: true for one of a word's rows. One shuffle, by (lang, term): its rows
    are sums of tasks, so a frequent word has few of them.
    """
    t = tallied(collapsed(docs)).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    word = Window.partitionBy("lang", "term")
    t = t.select(
        "lang", "term", "source", "n", F.sum("n").over(word).alias("all_n"), F.sum("docs").over(word).alias("all_docs"),
        (F.row_number().over(word.orderBy("source")) == 1).alias("lead"),
    )
    return t.where(F.col("all_docs") >= min_docs).drop("all_docs")


def share(n: Column, total: Column, kept: Column, alpha: int) -> Column:
    """The smoothed share of a word in parts of SCALE, rounded down, and one more; exact, null without kept words."""
    whole = lambda c: c.cast("decimal(20,0)")
    up, down = whole(n + F.lit(alpha)) * F.lit(SCALE).cast("decimal(10,0)"), whole(total) + F.lit(alpha).cast("decimal(5,0)") * whole(kept)
    return F.call_function("div", up, F.nullif(down, F.lit(0).cast("decimal(27,0)"))) + 1


def group_sizes(docs: DataFrame, terms: DataFrame, alpha: int) -> DataFrame:
    """lang, source, kept (words of the language), total, lang_total, zero (the share of an absent word) of every group."""
    names = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    of = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("lead").alias("lead"))
    lang, none = Window.partitionBy("lang"), F.lit(0).cast("long")
    g = names.join(of, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("total", none).alias("total"), F.coalesce(F.sum("lead").over(lang), none).alias("kept"),
        F.coalesce(F.sum("total").over(lang), none).alias("lang_total"),
    )
    return g.withColumn("zero", F.coalesce(share(F.lit(0), F.col("total"), F.col("kept"), alpha), none))


def pair_values(shares: DataFrame, groups: DataFrame, alpha: int) -> DataFrame:
    """lang, source, item, value: the sum of the absolute differences over all kept words, for each ordered pair of sources.

    ``shares``: lang, term, source, n, p, zero. With z the share of an absent word and a, b the sources of a pair, it is
    kept * |za - zb|, plus for each word of a (of b) |p - zb| - |za - zb|, plus for each common word what that misses.
    """
    a, b = (groups.select("lang", F.col("source").alias(x), F.col("zero").alias(f"z{x}"), "kept") for x in "ab")
    base = a.join(b.drop("kept"), "lang").where(F.col("a") < F.col("b"))
    base = base.select("lang", "a", "b", (F.col("kept") * F.abs(F.col("za") - F.col("zb"))).alias("value"))
    counts = shares.groupBy("lang", "source", "n", "p", "zero").agg(F.count("*").alias("words"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("z"))
    own = counts.join(_small(other), "lang").where(F.col("source") != F.col("other"))
    own = own.groupBy("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")).agg(
        F.sum(F.col("words") * (F.abs(F.col("p") - F.col("z")) - F.abs(F.col("zero") - F.col("z")))).alias("value")
    )
    x, y = (shares.select("lang", "term", F.col("source").alias(k), F.col("p").alias(f"p{k}"), F.col("zero").alias(f"z{k}")) for k in "ab")
    gap = lambda s, t: F.abs(F.col(s) - F.col(t))
    both = x.join(y, ["lang", "term"]).where(F.col("a") < F.col("b")).groupBy("lang", "a", "b")
    both = both.agg(F.sum(gap("pa", "pb") - gap("pa", "zb") - gap("za", "pb") + gap("za", "zb")).alias("value"))
    v = base.unionByName(own).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return v.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(v.select("lang", "b", "a", "value"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def divergence(docs: DataFrame, min_docs: int = 30, alpha: int = 5, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: the distances to all other sources of the language, and the ``top`` words above its share."""
    with scratch(docs.sparkSession) as kept:
        kept.append(terms := written(kept_terms(docs, min_docs), "terms"))
        kept.append(groups := written(group_sizes(docs, terms, alpha), "groups"))
    shares = terms.join(_small(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"), alpha))
    ordered = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(shares, groups, alpha).withColumn("rank", F.row_number().over(ordered))
    more = shares.withColumn("value", F.col("p") - share(F.col("all_n"), F.col("lang_total"), F.col("kept"), alpha))
    more = more.where((F.col("value") > 0) & (F.col("n") > 0)).select("lang", "source", F.col("term").alias("item"), "value")
    more = more.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(more, "term"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), o AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (
  SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source)
  GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS BIGINT) AS p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (sum(n) + 5)) // (total + 5 * v) AS BIGINT) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) USING (lang) GROUP BY lang, term, total, v
), pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
), term AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term
) WHERE rank <= 50
"""
