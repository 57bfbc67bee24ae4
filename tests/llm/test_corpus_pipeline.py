"""The pipeline against a plain version of each stage."""

import re
import zlib

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F
from tallyspark.llm import language_id, mixing
from tallyspark.llm.common import written

DIR = "/root/testdata/sf0.001"


def test_stages_drop_what_they_must_and_nothing_else(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, docs
    hashes = dict(docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), "text")).collect())
    bench = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        previous, kept = kept, written(stage(spark, kept, DIR), name)
        after = {r.doc_id for r in kept.collect()}
        gone = set(before) - after
        if name == "language_id":
            # the same documents, picked and scored one at a time without Spark
            langs = {r.doc_id: r.lang for r in docs.collect()}
            chosen: dict[str, dict[int, str]] = {}
            for i, t in before.items():
                if zlib.crc32(str(i).encode()) % 5 and langs[i] and t and any(map(str.isalpha, t)):
                    chosen.setdefault(langs[i], {})[hashes[i]] = t
            texts = {lang: [t for _, t in sorted(by.items())][: language_id.DOCS_PER_LANGUAGE] for lang, by in chosen.items()}
            known = language_id.Identifier(texts)
            assert gone == {i for i, t in before.items() if known.predict([t or ""])[3][0]} and len(gone) <= 0.02 * len(before)
        elif name == "exact_dedup":
            norm = {i: re.sub(r"\s+", " ", t) for i, t in before.items()}
            assert after == {min(i for i in norm if norm[i] == t) for t in set(norm.values())}
        elif name == "near_duplicates":
            sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})(t.lower().split()) for i, t in before.items()}
            near = {i: [j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
            seen, want = set(), set()
            for i in sorted(sets):
                if i not in seen:
                    want.add(i)
                    todo = [i]
                    while todo:
                        x = todo.pop()
                        if x not in seen:
                            seen.add(x)
                            todo += near[x]
            assert after == want
        elif name == "decontaminate":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
            windows = {tuple(w[k : k + 13]) for w in map(words, bench) for k in range(max(1, len(w) - 12))}
            for i, t in before.items():
                w, hit = words(t), set()
                for n in {len(x) for x in windows}:
                    for k in range(len(w) - n + 1):
                        if tuple(w[k : k + n]) in windows:
                            hit.update(range(k, k + n))
                assert (i in gone) == (len(hit) > 0 and 20 * len(hit) >= len(w))
        else:
            assert not gone and kept.where("taken > 2 * size").count() == 0
            con = duckdb.connect()
            con.register("documents", previous.toArrow())
            out = con.execute(mixing.OP4_SQL)
            names = [d[0] for d in out.description]
            assert {tuple(r) for r in kept.select(*names).collect()} == set(out.fetchall())
        if name != "mix_sources":
            assert kept.columns == columns


def test_run_applies_all_stages(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 100
