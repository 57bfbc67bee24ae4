"""Spelling variants (12) against brute force over all pairs, and the query against SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from tallyspark.llm import spelling

COLUMNS = "doc_id long, text string, word string, n long, said string, KEY string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(((-counts[v], v.encode(), v) for v in vs), default=None)
        if best and -best[0] >= ratio * counts[w]:
            form[w] = best[2]

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()), key=str)


def taken(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


def words_of(rng, n, letters, low, high):
    out = set()
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))
        out.add(w)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            out.add(w[:k] + rng.choice(["", rng.choice(letters), w[k] + rng.choice(letters)]) + w[k + 1 :])
    return {w for w in out if w}


@pytest.mark.parametrize("case", ["dense", "accents", "short", "beginnings", "long"])
def test_near_words_equal_all_pairs(spark, monkeypatch, case):
    rng = random.Random(case)
    if case == "dense":
        words = words_of(rng, 300, "ab", 5, 9)
    elif case == "accents":
        words = words_of(rng, 300, "aéßÿ×z", 7, 11)
    elif case == "short":
        words = words_of(rng, 60, "abc", 1, 4)
    elif case == "beginnings":  # one node that most states stand at
        words = {"internat" + w for w in words_of(rng, 300, "abc", 3, 6)}
        monkeypatch.setattr(spelling, "HOT", 20)
    else:
        words = {"x" * k for k in range(40, 60)} | {"ab" * 3000, "ab" * 3000 + "a", "b" * 6000, "ab" * 1500 + "c" + "ab" * 1500} | words_of(rng, 40, "ab", 30, 34)
    counts = {w: int(10 ** rng.uniform(0.3, 5)) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert taken(spelling.variants(frame)) == plain(counts)


def test_chains_of_forms_end_at_their_root(spark):
    counts = {"a" * k: 10**k for k in range(1, 13)} | {"zzzzzzz": 5}
    out = taken(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert out == plain(counts) and {r[2] for r in out} == {"a" * 12, "zzzzzzz"}


def test_query_against_sql_and_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    base = ["straßen", "façades", "Internet", "running", "Größere", "xxxxxxxx", "naïvetés"]
    texts = [" ".join(rng.choices(base, weights=range(7, 0, -1), k=80)) + rng.choice(["", "!", "9abcdefgh", "Āabcdefgh"]) for _ in range(300)]
    rows = [(i, t, "w", 1, "s", "k") for i, t in enumerate([*texts, "", None, "abcdefg" * 500, "abcdefg" * 500])] + [(5, texts[5], "w", 1, "s", "k")]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = plain({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    monkeypatch.setattr(spelling, "HELD", 100)
    assert taken(spelling.op12_spelling_variants(spark, str(tmp_path))) == want and any(r[1] for r in want)
    documents = pa.Table.from_pylist([{"doc_id": r[0], "text": r[1]} for r in rows])  # noqa: F841
    assert sorted(duckdb.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.OP12_SQL})").fetchall(), key=str) == want


def test_empty_tables_and_missing_ids(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert taken(spelling.variants(spelling.word_counts(empty))) == []
    docs = spark.createDataFrame([(None, "abcdefgh abcdefgh", None, None, None, None)] * 3, COLUMNS)
    assert {r.n for r in spelling.word_counts(docs, drop=None).collect()} == {6}
    h = zlib.crc32(b":abcdefgh")
    w = "abcdefgh"
    assert [r.word for r in spelling.word_counts(docs, drop=h).collect()] == [w[: h % 8] + w[h % 8 + 1 :]]
