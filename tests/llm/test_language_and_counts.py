"""Language models against a dictionary version, rejection of foreign and junk texts, counts, orders and hot groups."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import exact_dedup, language_id, mixing, quality, token_count


def coded(text):
    out = [" "]
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or out[-1] != " ":
            out.append(c)
    return out if out[-1] == " " else [*out, " "]


class Slow:
    """Interpolated Kneser-Ney over dictionaries, one gram at a time."""

    def __init__(self, texts, order, letters):
        self.order, self.floor, self.counts = order, 1 / (letters + 2), {}
        top = Counter()
        for t in texts:
            codes = [" "] * (order - 1) + coded(t)
            top.update(tuple(codes[i - order + 1 : i + 1]) for i in range(order - 1, len(codes)))
        self.counts[order] = top
        for m in range(order - 1, 0, -1):
            self.counts[m] = Counter(g[1:] for g in self.counts[m + 1])
        self.left = {m: defaultdict(list) for m in self.counts}
        for m, c in self.counts.items():
            for g, n in c.items():
                self.left[m][g[:-1]].append(n)

    def p(self, gram):
        if not gram:
            return self.floor
        m, below = len(gram), self.p(gram[1:])
        followers = self.left[m].get(gram[:-1])
        if not followers:
            return below
        ones, twos = (sum(n == k for n in self.counts[m].values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        return max(self.counts[m].get(gram, 0) - d, 0) / sum(followers) + d * len(followers) / sum(followers) * below

    def bits(self, text):
        codes = [" "] * (self.order - 1) + coded(text)
        return [-math.log2(self.p(tuple(codes[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(codes))]


def test_models_match_a_dictionary_version():
    texts = {"x": ["Abra cadabra, alakazam 12!", "abba baba", "Öl"], "y": ["zuz zaz azure", "", "buzz"]}
    letters = len({c for ts in texts.values() for t in ts for c in t.lower() if c.isalpha()})
    for order in (1, 2, 3, 4):
        model = language_id.KneserNey(texts, order)
        coder = language_id.Coder(model.alphabet)
        queries = ["abracadabra zaz", "Q?", "a", "", "zuz  buzz öl!", "qqq abba"]
        got, _ = model.entropies(coder, queries)
        for k, lang in enumerate(sorted(texts)):
            slow = Slow(texts[lang], order, letters)
            for q, h in zip(queries, got[:, k], strict=True):
                bits = slow.bits(q)
                assert abs(h - sum(bits) / len(bits)) < 1e-3, (order, lang, q)


def speaker(rng, syllables):
    return lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_foreign_and_junk_texts_go_and_known_ones_stay(spark):
    rng = random.Random(9)
    known = {"aa": speaker(rng, ["lor", "em", "ip", "sum", "dol", "a"]), "bb": speaker(rng, ["the", "an", "er", "in", "on", "s"])}
    foreign = [
        speaker(rng, ["qy", "xz", "wk", "vj"]), speaker(rng, ["zyg", "krz", "szcz", "ow"]), speaker(rng, ["мир", "дом"]),
        speaker(rng, ["ee", "oo", "uu"]),
    ]
    rows = [(k, speak(rng.randrange(5, 90)), lang) for k, (lang, speak) in enumerate(list(known.items()) * 150)]
    bad = [(1000 + k, speak(rng.randrange(10, 60)), None) for k, speak in enumerate(foreign * 10)]
    bad += [
        (2000, "for(i=0;i<n;i++){x[i]^=y[j]&z;}", None), (2001, "q" * 500, None), (2002, "!!! 123", None), (2003, None, "aa"),
        (2004, "", None),
    ]
    frame = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language_id.in_known_languages(frame).collect()}
    held = {r[0] for r in rows}
    assert len(kept & held) >= 0.99 * len(held) and len(kept - held) <= 0.05 * len(bad)
    frame = frame.withColumn("Score", F.lit("mine")).withColumn("rejected", F.lit(1))
    out = language_id.identified(frame, language_id.learn(frame, language_id.crc_bucket(F.col("doc_id"), 5) != 0))
    assert out.columns == [*frame.columns, "lang_pred", "score_", "rejected_"]
    for r in out.collect():
        assert r.Score == "mine" and 0 <= r.score_ <= 1 and (r.score_ <= 0.5 or not r.rejected_)


def test_chunks_and_widenings_are_told(spark):
    import public_tokenizers

    rows = [(1, "ab cd " * 50, 1, "x"), (2, "w" * 900, 2, "y"), (3, "short", 3, "z"), (None, None, 4, None), (2, "w" * 900, 2, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, N_BYTES string")
    got = {r.doc_id: r for r in token_count.token_counts(frame, public_tokenizers.path("word_bpe_49k.json"), chunk=100, overlap=10).collect()}
    assert got[1].n_chunks >= 3 and got[1].n_widened == 0 and got[2].n_widened > 0 and (got[3].n_chunks, got[3].n_widened) == (1, 0)
    assert (got[None].n_bytes, got[None].n_tokens) == (0, 0)
    counter = token_count.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    assert counter.counts(["x" * 500 + " y", "y"]) == counter.count_all(["x" * 500 + " y", "y"]) and all(len(w) <= token_count.MEMO_BYTES for w in counter.memo)


def test_null_ids_do_not_share_a_bucket(spark):
    frame = spark.createDataFrame(
        [(None, f"text number {k} of many", "a") for k in range(300)] + [(None, None, "a")],
        "doc_id long, text string, source string",
    )
    got = mixing.mix(frame)
    assert got.count() == 301 and got.agg(F.sum("taken")).first()[0] == 1500 * 3 // 2
    places = [r.position for r in got.collect() if r.position is not None]
    assert len(set(places)) > 200  # the order among them is that of their texts


@pytest.mark.parametrize("limit,hot", [(500_000, 100_000), (0, 3), (0, 100_000)])
def test_large_groups_are_not_shuffled(spark, monkeypatch, limit, hot):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    rows = [(k, "hot  text" if k % 3 else f"own {k % 40}") for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.copies(frame).collect()}
    groups = defaultdict(list)
    for k, t in rows:
        groups[t].append(k)
    assert got == {k: (min(groups[t]), len(groups[t]), k == min(groups[t])) for k, t in rows}


def test_repeated_labels_are_learnt_from_once(spark):
    rng = random.Random(4)
    words = ["lorem", "ipsum", "dolor", "sit", "amet"]
    data = [(i, " ".join(rng.choice(words) for _ in range(40)) + "." if i % 2 else "BUY NOW!! " * 9) for i in range(200)]
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("n_chars", F.lit(90))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    usable = language_id.crc_bucket(F.col("doc_id"), 4) != 2
    once = quality.scored(frame, quality.learn(frame, labels, usable))
    again = quality.scored(
        frame,
        quality.learn(frame.unionByName(frame.where("doc_id = 4")), labels.unionByName(labels.where("doc_id < 9")), usable),
    )
    a, b = ({r.doc_id: r.score for r in x.collect()} for x in (once, again))
    assert max(abs(a[k] - b[k]) for k in a) < 1e-6 and all((a[k] > 0.5) == bool(k % 2) for k in a)


def test_tables_that_are_no_longer_needed_are_deleted(spark):
    import os

    from tallyspark.llm import ngram_join
    from tallyspark.llm.common import scratch, shared_dir, written

    folder = lambda: set(os.listdir(shared_dir(spark).removeprefix("file:") + "/tally"))
    written(spark.range(3), "before")
    before = folder()
    with scratch(spark):
        with scratch(spark) as kept:
            a, b = written(spark.range(4), "a"), written(spark.range(5), "b")
            kept.append(b)
        assert folder() - before == {b.written_path.rsplit("/", 1)[-1]} and b.count() == 5
    assert folder() == before
    docs = spark.createDataFrame([(k, "one two three four five six seven eight") for k in range(9)], "doc_id long, text string")
    left = ngram_join.one_of_each(docs)
    assert left.count() == 1 and [p.split("-")[0] for p in folder() - before] == ["gone"]


def test_junk_among_the_training_texts_does_not_lift_the_limits(spark):
    """5 % of junk, code and foreign text in training: what is foreign still goes, and known texts stay."""
    rng = random.Random(12)
    known = {"aa": speaker(rng, ["lor", "em", "ip", "sum", "dol", "a"]), "bb": speaker(rng, ["the", "an", "er", "in", "on", "s"])}
    junk = lambda: " ".join("".join(rng.choice("qwxzvkjpyg0147#&%") for _ in range(9)) for _ in range(30))
    rows = [(k, junk() if k % 20 < 2 and k % 40 < 21 else speak(rng.randrange(20, 90)), lang) for k, (lang, speak) in enumerate(list(known.items()) * 300)]
    foreign = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura", "De kat zit op de mat en kijkt naar buiten waar het regent",
        "Wczoraj wieczorem poszliśmy do kina na nowy film", "Os meninos foram para a escola muito cedo hoje de manhã", "Jag tycker mycket om att läsa böcker på kvällen",
        "int main(int argc, char **argv) { return printf(argv[0]); }", "deadbeef0123456789abcdefcafebabe", "zxqv jkwq vbnm qwrtp lkjhg fdsaz xcvbq",
    ]
    bad = [(10_000 + k, t, None) for k, t in enumerate(foreign + [junk() for _ in range(40)])]
    frame = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    learnt = language_id.learn(frame, language_id.crc_bucket(F.col("doc_id"), 5) != 0)
    out = {r.doc_id: r.rejected for r in language_id.identified(frame, learnt).collect()}
    clean = [k for k, t, _ in rows if not set(t) & set("0147#&%qwxzvk")]
    assert sum(out[k] for k in clean) <= 0.01 * len(clean)
    assert sum(out[k] for k, *_ in bad) >= 0.95 * len(bad)


def test_languages_learnt_are_those_with_most_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    rows = [(k, f"some text number {'abc'[k % 3] * (k + 1)}", f"l{k % 4}" if k % 4 < 2 else f"x{k}") for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.learn(frame, F.lit(True)).model.languages == ["l0", "l1"]


PROSE = (
    "The secret: nobody knows it. A client 20240506 meeting was moved. Our password: please ask at the desk, and the token: well, lost. "
    "The account of the year 1998 was long; customer number one came by. An api key: what is that? Chapter 12, A1 road, B52 and DE89 are no accounts. "
)


def test_personal_data_in_sentences(spark):
    from tallyspark.llm import pii

    anchors = pii.automaton()
    found = lambda t: {k: [t[a:b] for a, b in v] for k, v in pii.spans(t, anchors).items() if v}
    assert found(PROSE) == {}
    for text, kind, want in (
        ("My SSN is 123-45-6789, keep it.", "account", "123-45-6789"), ("the account number is 12345678", "account", "12345678"),
        ("Kontonummer ist 99887766", "account", "99887766"), ("pay to DE89 3704 0044 0532 0130 00 now", "account", "DE89 3704 0044 0532 0130 00"),
        ("GB82WEST12345698765432.", "account", "GB82WEST12345698765432"), ("password: hunter2", "secret", "hunter2"), ("password=hunter", "secret", "hunter"),
        ('secret: "nobody"', "secret", "nobody"), ("jwt eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4", "secret", "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4"),
    ):
        assert found(text)[kind] == [want], text


def test_no_anchor_makes_scanning_more_than_linear():
    import time

    from tallyspark.llm import pii

    anchors = pii.automaton()
    hostile = ["eyJ-", "eyJaaaaaaaaa.", "x-accountaaaa-", "ssn-", "xoxb-", "glpat-", "-----BEGIN ", "http://", "ssh://a", "a@", "@", "+1", "+1(", "12", "1.2.", "token/", "account:", "password=", "AKIA", "DE89 ", "secret: "]
    for part in hostile:
        took = []
        for n in (100_000, 1_000_000):
            text, began = part * (n // len(part)), time.process_time()
            pii.spans(text, anchors)
            took.append(time.process_time() - began)
        assert took[1] < 4 and took[1] < 40 * max(took[0], 0.02), part
