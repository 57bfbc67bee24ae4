"""Spelling variant grouping (12): neighbours of one edit by a relational trie frontier.

Two words are near if they differ by one inserted, deleted or replaced code point. Every word goes into a trie twice, as
it stands (behind ``>``) and reversed (behind ``<``). An edit in the second half of a word leaves its first half
as it is, one in the first half leaves the reversed word's, so a search may begin at the node of that half, where
the trie is thin, instead of at its root, where each letter has an edge.

The trie is a table of edges (node, first letter, label, child). Nodes that neither branch nor end a word are
passed over by labels of several letters, so a long word has as many edges as it has branches, and the search as many
levels. Nodes are 64-bit hashes of their prefix; were two alike, their edges would mix, which loses no path, and found pairs
are compared in the end. Where a word ends, its node has an edge without letters that carries the word. Edges know the letters
behind their child, so a state that cannot go on is not written.

The frontier is a table of states (word, position, node, edits). It starts with every word at its own nodes behind the half, with
no edit. Level by level it is joined with the edges on the node:

* without an edit so far, edges of letters behind the word's own one replace it, and the edge of the next letter, if it is
  another, skips one: of equal letters in a row only the last is skipped;
* with an edit, the edge of the next letter goes on, if its label is what the word goes on with;
* states with an edit that take the edge without letters at the end of their word have found a neighbour.

A pair of different lengths is found from the longer word, one of equal lengths from the word whose letter comes first;
both words then get each other. Each level is written, so a lost executor repeats one level at most.
A node that many states stand at (all words of one beginning) is dealt over SALTS parts, and so are its edges.

A word's form is its near word of largest count, if that is ``ratio`` times its own or more. As counts grow from word to form, the
forms make no circle, and roots are found by doubling: a few joins for any chain.

Edge cases: null texts have no words; a null id counts as an empty text; words of any length are kept whole; ties of forms go
to the smallest word by code points; repeated rows count each; an empty table gives an empty result; extra columns are passed over.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import BROADCAST_ROWS, scratch, table, written

#: Words that a task counts before it hands them on.
HELD = 500_000
#: Words of more code points are named by a digest in the table of prefixes.
NAMED = 48
#: Fixed odd factor of the polynomial that hashes prefixes, modulo 2 to the power of 64.
FACTOR, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: A node with more states is dealt over so many parts.
HOT, SALTS = 50_000, 32


def word_counts(docs: DataFrame, least: int = 7, drop: int | None = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of Latin letters with A-Z lower-cased, of ``least`` code points or more.

    With ``drop``, a run whose crc32 (of id, colon and run) it divides loses one letter, as that number says.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shorter runs never become words, as runs only lose letters.
        runs, met, held = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall, Counter(), 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = runs((text or "").encode().lower().decode())  # bytes: only A-Z have another case
                if drop:
                    start = zlib.crc32(f"{id_}:".encode())
                    for k, w in enumerate(words):
                        h = zlib.crc32(w.encode(), start)
                        if h % drop == 0:
                            at = h % len(w)
                            words[k] = w[:at] + w[at + 1 :]
                met.update(words)
                held += len(words)
            if held > HELD:
                yield rows(met)
                met, held = Counter(), 0
        yield rows(met)

    def rows(met: Counter) -> pa.RecordBatch:
        kept = [w for w in met if len(w) >= least]
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([met[w] for w in kept], pa.int64())], ["word", "n"])

    rows_in = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows_in.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _nodes(keys: DataFrame, shallow: int) -> DataFrame:
    """key, n, position, node, next: every prefix of each word of ``shallow`` code points or more, and the letter behind it (0 at the end).

    ``node`` is a 64-bit hash of the prefix, made letter by letter. ``key`` is the word, or length and digest of a long one.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, node = [*map(ord, word), 0], 0
                for c in codes[: shallow - 1]:
                    node = (node * FACTOR + c) & MASK
                ends = range(shallow, len(word) + 1)
                for at in ends:
                    node = (node * FACTOR + codes[at - 1]) & MASK
                    out[3].append(node - (node >> 63 << 64))
                key = word if len(word) <= NAMED else f"{len(word)}#{hashlib.md5(word.encode()).hexdigest()}"
                for column, values in zip((0, 1, 2, 4), ([key] * len(ends), [n] * len(ends), ends, codes[shallow:]), strict=True):
                    out[column].extend(values)
                if len(out[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, out, kinds)), names)
                    out = [[], [], [], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, out, kinds)), names)

    names, kinds = ["key", "n", "position", "node", "next"], [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    return keys.select("word", "n").mapInArrow(prefixes, "key string, n long, position int, node long, next int")


def _said(word: str = "word"):
    """The word that a key of the trie stands for."""
    return F.expr(f"CASE WHEN {word} LIKE '>%' THEN substring({word}, 2) ELSE reverse(substring({word}, 2)) END")


def trie(keys: DataFrame, shallow: int) -> tuple[DataFrame, DataFrame]:
    """The edges below depth ``shallow``, and the nodes of each key (word, n): word, n, position, node.

    Edges: node, first (code point, 0 at an end), label, child, fan (the letters behind the child, ``.`` for an end), found and
    found_n (the word that ends there).
    """
    nodes = written(_nodes(keys, shallow), "nodes")
    forks = nodes.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high"), F.min("position").alias("position"))
    forks = forks.where((F.col("low") != F.col("high")) | (F.col("low") == 0) | (F.col("position") == shallow)).select("node")
    own = nodes.select("key", "n", "position", "node").join(forks, "node").groupBy("key").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("position", "node"))).alias("path")
    )
    long = F.col("key").contains("#")  # only these were renamed, as no letter is a number sign
    name = F.concat(F.char_length("word"), F.lit("#"), F.md5("word"))
    renamed = keys.where(F.char_length("word") > NAMED).select("word", name.alias("key"))
    own = own.where(~long).withColumn("word", F.col("key")).unionByName(own.where(long).join(renamed, "key")).drop("key")
    steps = own.select("word", "n", "path", F.posexplode("path").alias("k", "at")).select(
        "word", "n", F.col("at.position").alias("position"), F.col("at.node").alias("node"), F.get("path", F.col("k") + 1).alias("to")
    )
    steps = written(steps.withColumn("label", F.expr("substring(word, position + 1, coalesce(to.position - position, 0))")), "steps")
    inner = steps.where(F.col("to").isNotNull()).select("node", F.ascii("label").alias("first"), "label", F.col("to.node").alias("child")).distinct()
    ends = steps.where(F.col("to").isNull()).select("node", F.lit(0).alias("first"), F.lit("").alias("label"), F.lit(None).cast("long").alias("child"), _said().alias("found"), F.col("n").alias("found_n"))
    fans = inner.select("node", F.substring("label", 1, 1).alias("letter")).unionByName(ends.select("node", F.lit(".").alias("letter")))
    fans = fans.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set("letter"), "").alias("fan"))
    edges = inner.join(fans, "child").select("node", "first", "label", "child", "fan", F.lit(None).cast("string").alias("found"), F.lit(None).cast("long").alias("found_n"))
    return written(edges.unionByName(ends.withColumn("fan", F.lit(None).cast("string")).select(*edges.columns)), "edges"), steps


def _dealt(states: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with a column ``salt`` that deals the states of crowded nodes over SALTS parts, and repeats those nodes' edges."""
    hot = written(states.groupBy("node").count().where(F.col("count") > HOT).select("node"), "hot")
    if hot.isEmpty():
        return states.withColumn("salt", F.lit(0)), edges.withColumn("salt", F.lit(0))
    hot = (F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot).withColumn("hot", F.lit(True))  # at most states / HOT nodes
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("word", "position"), F.lit(SALTS)).cast("int")).otherwise(0)
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return states.join(hot, "node", "left").withColumn("salt", part).drop("hot"), edges.join(hot, "node", "left").withColumn("salt", F.explode(parts)).drop("hot")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of near words once, of ``words`` (word, n)."""
    keys = written(words.select(F.explode(F.array(F.concat(F.lit(">"), "word"), F.concat(F.lit("<"), F.reverse("word")))).alias("word"), "n"), "keys")
    shortest = words.agg(F.min(F.char_length("word"))).first()[0]
    if shortest is None:
        return words.selectExpr("word AS a", "n AS a_n", "word AS b", "n AS b_n")
    edges, steps = trie(keys, 1 + shortest // 2)
    letters = F.char_length("word") - 1
    half = F.when(F.col("word").startswith(">"), F.floor(letters / 2)).otherwise(F.ceil(letters / 2))
    own = steps.where((F.col("position") > half) & (F.col("position") <= letters)).select("word", "n", "position", "node")
    states, e = _dealt(own, edges)
    here, after = (F.expr(f"substring(word, position + {k}, 1)") for k in (1, 2))
    rest = F.expr("substring(word, position + 2, char_length(label))")
    skips = (F.col("first") == F.ascii(after)) & (here != after) & (rest == F.col("label"))
    changed = (F.col("first") > F.ascii(here)) & (rest == F.expr("concat(substring(label, 2), substring(word, position + 1 + char_length(label), 1))"))
    behind = F.col("position") + F.char_length("label")  # one edge may do both
    met = states.join(e, ["node", "salt"]).where(skips | changed)
    met = met.withColumn("position", F.explode(F.array_compact(F.array(F.when(skips, behind + 1), F.when(changed, behind)))))
    following = F.expr("CASE WHEN position >= char_length(word) THEN '.' ELSE substring(word, position + 1, 1) END")
    goes_on = F.col("found").isNotNull() | (F.instr("fan", following) > 0)  # what the child lacks need not be written
    found = None
    while True:
        met = written(met.where(goes_on).select("word", "n", "position", F.col("child").alias("node"), "found", "found_n"), "states")
        pairs = met.where(F.col("found").isNotNull()).select(_said().alias("a"), F.col("n").alias("a_n"), F.col("found").alias("b"), F.col("found_n").alias("b_n"))
        found = pairs if found is None else found.unionByName(pairs)
        states = met.where(F.col("found").isNull()).drop("found", "found_n")
        if states.isEmpty():
            # Two prefixes of one hash could only add pairs: no path is lost, and these go.
            return found.where(F.levenshtein("a", "b", 1) == 1).distinct()
        states, e = _dealt(states.withColumn("first", F.ascii(F.expr("substring(word, position + 1, 1)"))), edges)
        met = states.join(e, ["node", "first", "salt"]).where(F.expr("substring(word, position + 1, char_length(label)) = label"))
        met = met.withColumn("position", F.col("position") + F.char_length("label"))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of ``words`` (word, n; each word once)."""
    with scratch(words.sparkSession) as kept:
        words = written(words.select("word", "n"), "words")
        pairs = written(near_pairs(words), "pairs")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
        best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"))
        w = words.join(best, "word", "left")
        is_form = -F.col("best.less") >= F.col("n") * ratio
        w = w.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.b")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
        kept.append(w := written(w, "forms"))
        most = w.agg(F.max("n")).first()[0] or 1
        roots = w.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
        for _ in range(max(1, math.ceil(math.log2(math.log(most, max(2, ratio)) + 1)))):
            roots = written(roots, "roots")
            on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
            roots = roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        kept.append(roots := written(roots, "roots"))
    return w.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents")).where("n >= 2"))


#: crc32 is a fold over bits: each byte enters with seven zeros behind it.
OP12_SQL = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
), c AS (
  SELECT run, count(*) AS n, hex(concat(doc_id, ':', run)) AS h FROM r WHERE length(run) >= 7 GROUP BY ALL
), b AS (
  SELECT run, n, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(CAST(4 * length(h) AS BIGINT)), lambda i: CASE WHEN i % 8 = 0 THEN CAST('0x' || substr(h, i // 4 + 1, 2) AS BIGINT) ELSE 0::BIGINT END)),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))
  ) AS state FROM c
), e AS (SELECT run, n, xor(state, 4294967295) AS h FROM b),
s AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM e),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
v AS (SELECT word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM v x JOIN v y ON x.less = y.less AND x.i = y.i AND x.word <> y.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word
), k AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM p GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN (SELECT min(other) FROM p WHERE p.word = w.word AND p.other_n = most) END AS form,
         CASE WHEN most >= 10 * w.n THEN most END AS form_n
  FROM w LEFT JOIN k USING (word)
), t AS (
  SELECT word, word AS root FROM f WHERE form IS NULL
  UNION ALL SELECT f.word, t.root FROM f JOIN t ON f.form = t.word
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON f.word = t.word
"""
