"""Source divergence (11) against a dense brute force and SQL."""

import random
import re
from collections import Counter, defaultdict
from itertools import groupby

import duckdb
import pyarrow as pa

from tallyspark.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string, term string, n long, H string"


def dense(rows, min_docs, alpha, top):
    """Every group's share of every kept word, laid out in full."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        met = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in met.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if t in set(kept))
        counts[None] = sum((counts[s] for s in {d[1] for d in mine}), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + alpha) // (c.total() + alpha * len(kept)) for t in kept} for s in {d[1] for d in mine} | {None} for c in [counts[s]]}
        for s in {d[1] for d in mine}:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in {d[1] for d in mine} - {s}]
            terms = [(p[None][t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "déjà", "ÉTÉ", "日本", "x", "co-op", "a1b", "ſ", "K", "zulu", "rare"]
    texts = [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(12))) for _ in range(60)] + ["", None, "123 !!", "alpha " * 3000]
    return [(i, rng.choice(texts), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s1", "s2", "é", None, "S1"]), "t", 1, "h") for i in range(400)] + [(1, "lonely", "xx", "one", None, None, None), (2, "12", "yy", "a", None, None, None), (3, None, "yy", "b", None, None, None)] + [(9, "alpha beta", "en", "hot", "t", 1, "h")] * 300


def taken(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_against_dense_shares(spark):
    for seed, min_docs, alpha, top in ((1, 30, 5, 50), (2, 2, 1, 3)):
        rows = rows_of(seed)
        docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
        assert taken(divergence.divergence(docs, min_docs, alpha, top)) == dense(rows, min_docs, alpha, top)


def test_sql_and_flushes(spark, tmp_path, monkeypatch):
    rows = rows_of(3)
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    documents = pa.Table.from_pylist([{"text": r[1], "lang": r[2], "source": r[3]} for r in rows])  # noqa: F841
    want = sorted(duckdb.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.OP11_SQL})").fetchall())
    monkeypatch.setattr(divergence, "HELD", 7)
    assert taken(divergence.op11_source_divergence(spark, str(tmp_path))) == want == dense(rows, 30, 5, 50)
    assert taken(divergence.divergence(docs.limit(0))) == []
    assert taken(divergence.divergence(docs, min_docs=10**6)) == dense(rows, 10**6, 5, 50)


def test_shares_stay_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    data = [(10**14 + 7, 3 * 10**15, 10**9), (0, 0, 0), (0, 0, 3)]
    out = [r[0] for r in spark.createDataFrame(data, "n long, total long, kept long").select(divergence.share(F.col("n"), F.col("total"), F.col("kept"), 5)).collect()]
    assert out == [1 + 10**9 * (n + 5) // (t + 5 * v) if t + 5 * v else None for n, t, v in data]


def test_texts_stand_once_with_their_copies(spark):
    data = [("a b", "en", "s"), ("a b", "en", "s"), ("a b", "en", "t"), ("a b", "fr", "s"), ("c", "en", None)]
    out = divergence.collapsed(spark.createDataFrame(data, "text string, lang string, source string")).collect()
    assert sorted((r.lang, r.text, sorted((c.source, c.n) for c in r.copies)) for r in out) == [("en", "a b", [("s", 2), ("t", 1)]), ("en", "c", [("", 1)]), ("fr", "a b", [("s", 1)])]
