"""Quality classifier (1): a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector: its lower-case words hashed into WORDS buckets (log counts, unit length) and, for
each statistic of its structure and each metadata column, the bin its value falls in. The score is
``sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; the pairwise sum over RANK latent dimensions
takes linear time as ``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

The machine is fitted by Adagrad on at most SAMPLE labelled documents (those with the smallest hash of their
id), a bound that is a parameter; bins are quantiles of that sample. Every text is scored as a whole, where
it is read: no row is shuffled.

Edge cases: null counts as empty text; an empty text has no words and is scored by its statistics; null
metadata fall in a bin of their own; documents labelled more than once take their largest label and null
labels are passed over; with no usable label every score is the prior, 0.5; repeated rows each get a row, but
of the rows of one id only one (that with the smallest hash) is learnt from; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import table
from tallyspark.llm.language_id import crc_bucket

WORDS = 1 << 16
RANK = 8
BINS = 12
SAMPLE = 6000
EPOCHS = 6
SLICE = 256
MEMO = 400_000
STATISTICS = (
    "bytes", "words", "word_length", "upper", "digits", "stops", "marks", "symbols", "bars", "lines", "distinct_words",
    "top_word", "distinct_lines", "stop_lines",
)


def _classes() -> np.ndarray:
    """Class of each byte: 0 other, 1 upper case, 2 digit, 3 sentence stop, 4 exclamation or question mark, 5 symbol, 6 bar, 7 line end."""
    out = np.zeros(256, np.uint8)
    for group, k in (
        (range(65, 91), 1), (range(48, 58), 2), (b".,;:", 3), (b"!?", 4), (b"#$%&*+/<=>@\\^_`{}~[]()\"", 5), (b"|", 6),
        (b"\n", 7),
    ):
        out[list(group)] = k
    return out


class Featuriser:
    """Words as hashed buckets and statistics of texts; made once in each task."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}
        self.classes = _classes()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, bucket, value) of each word feature, and the statistics of each document."""
        memo, docs, stats = self.memo, [], np.zeros((len(texts), len(STATISTICS)))
        if len(memo) > MEMO:
            memo.clear()
        for k, t in enumerate(texts):
            words = t.lower().split()
            for w in set(words).difference(memo):
                memo[w] = zlib.crc32(w) % WORDS
            b = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
            b, n = np.unique(b, return_counts=True)
            x = np.log1p(n)
            docs.append((np.full(len(b), k), b, x / np.sqrt((x * x).sum() or 1.0)))
            size, count = max(len(t), 1), max(len(words), 1)
            c = np.bincount(self.classes[np.frombuffer(t, np.uint8)], minlength=8) / size
            lines = t.split(b"\n")
            stats[k] = (
                np.log1p(len(t)), np.log1p(len(words)), len(t) / count, c[1], c[2], c[3], c[4], c[5], c[6], c[7],
                len(b) / count, n.max(initial=0) / count, len(set(lines)) / len(lines), sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
            )
        return *(np.concatenate(x) for x in zip(*docs, strict=True)), stats


class Machine:
    """The fitted machine: plain arrays, so that it can be broadcast."""

    def __init__(self, edges: np.ndarray, rank: int = RANK, seed: int = 7):
        self.edges = edges  # [statistic, BINS - 1]
        size = WORDS + len(edges) * (BINS + 1)
        self.w0, self.w = 0.0, np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, rank)).astype(np.float32)

    def binned(self, stats: np.ndarray) -> np.ndarray:
        """Feature numbers of the statistics of each document; missing values have the last bin."""
        out = np.empty(stats.shape, np.int64)
        for k, e in enumerate(self.edges):
            out[:, k] = WORDS + k * (BINS + 1) + np.where(
                np.isnan(stats[:, k]), BINS, np.searchsorted(e, np.nan_to_num(stats[:, k]), side="right"),
            )
        return out

    def rows(self, doc, bucket, value, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features ordered by document: (start of each document, feature, value)."""
        bins = self.binned(stats)
        n, s = bins.shape
        d = np.concatenate([doc, np.repeat(np.arange(n), s)])
        by = np.argsort(d, kind="stable")
        i = np.concatenate([bucket, bins.ravel()])[by]
        x = np.concatenate([value, np.full(n * s, 1 / np.sqrt(max(s, 1)))])[by].astype(np.float32)
        return np.searchsorted(d[by], np.arange(n)), i, x

    def margin(self, start, i, x) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each document and its sums of v_if x_i."""
        vx = self.v[i] * x[:, None]
        total = np.add.reduceat(vx, start, axis=0)
        pairs = 0.5 * (total * total - np.add.reduceat(vx * vx, start, axis=0)).sum(axis=1)
        return self.w0 + np.add.reduceat(self.w[i] * x, start) + pairs, total

    def fit(
        self, start, i, x, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.08, decay: float = 1e-4,
        seed: int = 7,
    ) -> None:
        rng, end = np.random.default_rng(seed), np.append(start[1:], len(i))
        gw, gv, g0 = np.full(self.w.shape, 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32), 1e-3
        self.w0 = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                docs = order[at : at + batch]
                pick = np.concatenate([np.arange(start[d], end[d]) for d in docs])
                size = end[docs] - start[docs]
                b_start, b_i, b_x = np.cumsum(size) - size, i[pick], x[pick]
                m, total = self.margin(b_start, b_i, b_x)
                slope = ((1 / (1 + np.exp(-m)) - y[docs]) / len(docs)).astype(np.float32)
                e = np.repeat(slope, size) * b_x
                by = np.argsort(b_i, kind="stable")
                u, first = np.unique(b_i[by], return_index=True)
                dw = np.add.reduceat(e[by], first) + decay * self.w[u]
                dv = np.add.reduceat(
                    (e[:, None] * (np.repeat(total, size, axis=0) - self.v[b_i] * b_x[:, None]))[by], first, axis=0,
                ) + decay * self.v[u]
                gw[u] += dw * dw
                gv[u] += dv * dv
                self.w[u] -= rate * dw / np.sqrt(gw[u])
                self.v[u] -= rate * dv / np.sqrt(gv[u])
                g0 += float(slope.sum()) ** 2
                self.w0 -= rate * float(slope.sum()) / g0**0.5

    def scores(self, texts: list[bytes], meta: np.ndarray, featurise: Featuriser) -> np.ndarray:
        doc, bucket, value, stats = featurise(texts)
        m, _ = self.margin(*self.rows(doc, bucket, value, np.hstack([stats, meta])))
        return 1 / (1 + np.exp(-m))


def _texts_and_meta(batch: pa.RecordBatch, first: int) -> tuple[list[bytes], np.ndarray]:
    """Texts (the column ``first``, binary) and metadata (all later columns) of a batch."""
    texts = [t or b"" for t in batch.column(first).to_pylist()]
    meta = [np.log1p(np.abs(np.array(batch.column(k).to_pylist(), float))) for k in range(first + 1, batch.num_columns)]
    return texts, np.array(meta).reshape(len(meta), len(texts)).T


def learn(
    docs: DataFrame, labels: DataFrame, usable: Column, meta: tuple[str, ...] = ("n_chars",), sample: int = SAMPLE,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Machine | None:
    """Fit on at most ``sample`` labelled documents among those whose id is ``usable`` (a condition on ``doc_id``)."""
    lab = labels.select(
        F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label"),
    ).where(usable & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    lab = lab.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
        *(F.col(c).cast("double").alias(f"meta{k}") for k, c in enumerate(meta)),
    )
    rows = rows.join(F.broadcast(lab), "doc_id")  # at most ``sample`` labels
    kept = ["text", *(f"meta{k}" for k in range(len(meta)))]
    rows = rows.groupBy("doc_id", "label").agg(
        F.min(F.struct(F.xxhash64(*kept).alias("h"), *kept)).alias("row")
    ).select("doc_id", "label", *(f"row.{c}" for c in kept))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurise = Featuriser()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts, more = _texts_and_meta(part, 2)
                doc, bucket, value, stats = featurise(texts)
                cut = np.searchsorted(doc, np.arange(1, len(texts)))
                lists = [[x.tolist() for x in np.split(a, cut)] for a in (bucket, value)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(lists[0], pa.list_(pa.int64())),
                        pa.array(lists[1], pa.list_(pa.float64())),
                        pa.array(np.hstack([stats, more]).tolist(), pa.list_(pa.float64())),
                    ],
                    ["doc_id", "label", "bucket", "value", "stats"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(
        extract, f"doc_id {kind}, label double, bucket array<long>, value array<double>, stats array<double>",
    ).toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    y, stats = got["label"].to_numpy().clip(0, 1), np.array(got["stats"].to_pylist())
    sizes = np.array(got["bucket"].combine_chunks().value_lengths())
    machine = Machine(
        np.array(
            [np.nan_to_num(np.nanquantile(s, np.arange(1, BINS) / BINS)) if (~np.isnan(s)).any() else np.zeros(BINS - 1) for s in stats.T]
        )
    )
    machine.fit(
        *machine.rows(
            np.repeat(np.arange(len(y)), sizes), got["bucket"].combine_chunks().flatten().to_numpy(),
            got["value"].combine_chunks().flatten().to_numpy(), stats,
        ),
        y,
    )
    return machine


def scored(
    docs: DataFrame, machine: Machine | None, meta: tuple[str, ...] = ("n_chars",), id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id and score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
        *(F.col(c).cast("double").alias(f"meta{k}") for k, c in enumerate(meta)),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, featurise = sent.value, Featuriser()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts, more = _texts_and_meta(part, 1)
                s = fitted.scores(texts, more, featurise) if fitted else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, score double").withColumnRenamed("doc_id", id_col)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = learn(docs, table(spark, sf_dir, "labels"), crc_bucket(F.col("doc_id"), 4) != 2)
    out = scored(docs, machine)
    return out.select(
        "doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
