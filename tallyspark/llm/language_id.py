"""Language ID (5): interpolated Kneser-Ney character language models in sorted hash arrays.

A text becomes a row of letter codes: letters in lower case, everything else one separator between words.
Every letter of the training texts has codes of its own; one code is left to letters never seen in training.
For each language and order 1..ORDER the model has the discounted share of a character after its context and
the weight left to the shorter context; raw counts at the highest order, numbers of distinct left
neighbours below it. All languages share, for each order, one sorted array of hashed grams with a matrix of
log probabilities, so a text is scored in one binary search for each of its characters; grams that no
language has seen are backed off through the context weights. The language with the lowest cross-entropy
for each character wins.

Models are fitted on at most DOCS_PER_LANGUAGE whole documents of each language (those with the smallest
hash of their id), a bound that is a parameter. A quarter of them is held back to calibrate. The temperature turns
cross-entropies into shares of the languages. Rejection compares two kinds of texts, at lengths from a word to pages:
held-back texts in their own language, and held-back texts when their language is not among the models, which is how
a text in a language never learnt looks. The limit at each length lies halfway between the highest cross-entropies of
the first kind and the lowest of the second (quantiles), but SLACK above the first at least: what is like the training texts stays.
Before all that, texts of a language that a model of the others finds far stranger than most are left out (``_usual``), so that
junk among the training texts neither enters the models nor lifts the limits. At most LANGUAGES languages, those with most texts,
are learnt. The score is the share of the language times how surely the text is within that limit (a half at the limit itself), so
rejected texts score below a half.

Edge cases: null text, and text without a letter, is ``und`` with score 0 and rejected; rows with a null
language are never learnt from; ties go to the language first in order; repeated rows each get a row, and are
learnt from once; if nothing can be learnt, every text is ``und``; an empty table gives an empty result; columns of
the table that have the name of an added one stay, and the added one gets underscores until its name is free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tallyspark.llm.common import fresh, table

ORDER = 4
DOCS_PER_LANGUAGE = 400
#: Codes: 0 separator, 1 letter unknown in training, 2.. the letters of the training texts by frequency. Up to
#: NARROW codes take 8 bits each, more take 16. The last 2 * PAIRED of the WIDE codes are for alphabets that
#: are larger still: each letter past the others is a code of the first half followed by one of the second.
NARROW, WIDE, PAIRED = 1 << 8, 1 << 16, 1 << 9
UND = "und"
SLICE = 1 << 18


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, each followed by one blank, and where each text starts."""
    whole = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return whole, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)


def letter_table() -> np.ndarray:
    """For each code point the one of its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Coder:
    """Turns texts into letter codes; ``alphabet`` are the lower-case letters with codes from 2 on."""

    def __init__(self, alphabet: np.ndarray):
        low = letter_table()
        codes = np.full(0x110000, 1, np.uint32)
        codes[alphabet] = np.arange(2, 2 + len(alphabet))
        self.width = 8 if len(alphabet) + 2 <= NARROW else 16
        self.single = WIDE - 2 * PAIRED  # codes from here on stand for two
        self.paired = len(alphabet) + 2 > self.single
        kind = np.uint8 if self.width == 8 else np.uint32 if self.paired else np.uint16
        self.codes = np.where(low == 0, 0, codes[low]).astype(kind)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, runs of separators as one, and where each text starts (it starts with a separator)."""
        points, starts = code_points([" " + t for t in texts])
        codes = self.codes[points]
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        keep[starts] = True
        at = np.cumsum(keep) - 1
        codes, starts = codes[keep], at[starts]
        return self._in_pairs(codes, starts) if self.paired else (codes, starts)

    def _in_pairs(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rare = codes >= self.single
        place = np.arange(len(codes)) + np.cumsum(rare) - rare
        first, second = np.divmod(codes - np.uint32(self.single), np.uint32(PAIRED))
        out = np.zeros(len(codes) + int(rare.sum()), np.uint16)
        out[place] = np.where(rare, self.single + first, codes)
        out[place[rare] + 1] = self.single + PAIRED + second[rare]
        return out, place[starts]


def grams(codes: np.ndarray, n: int, starts: np.ndarray | None = None, width: int = 8) -> np.ndarray:
    """For each place the last n codes packed into one integer; codes before the start count as separators."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(n):
        shifted = np.concatenate([np.zeros(min(k, len(codes)), np.uint64), codes[: max(0, len(codes) - k)].astype(np.uint64)])
        if k and starts is not None:
            for j in range(k):
                edge = starts + j
                shifted[edge[edge < len(codes)]] = 0
        out |= shifted << (width * k)
    return out


def hashed(packed: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so equal hashes are equal grams."""
    x = packed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class KneserNey:
    """Models of several languages; plain arrays, so that it can be broadcast."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.languages, self.order = sorted(texts), order
        low = letter_table()
        seen = [low[code_points(t)[0]] for t in texts.values()]
        letters, n = np.unique(np.concatenate([s[s > 0] for s in seen] or [np.zeros(0, np.uint32)]), return_counts=True)
        self.alphabet = letters[np.lexsort((letters, -n))]
        coder = Coder(self.alphabet)
        self.width = coder.width
        if order * self.width > 64:
            raise ValueError(f"grams of {order} codes of {self.width} bits do not fit in 64 bits")
        raw = []
        for lang in self.languages:
            codes, starts = coder(texts[lang])
            packed = grams(codes, order, starts, self.width)
            raw.append(np.unique(packed, return_counts=True))
        self.uniform = -np.log2(1 / (WIDE if coder.paired else len(self.alphabet) + 2))
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []  # by order from 1: hashes and bits [gram, language]
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []  # by order from 1: hashes of contexts and bits
        below: dict[int, np.ndarray] = {}
        counted = [self._counts(g, c, order, self.width) for g, c in raw]
        for m in range(1, order + 1):
            union = np.unique(np.concatenate([c[m][0] for c in counted]))
            contexts = np.unique(union >> self.width)
            prob = np.zeros((len(union), len(self.languages)))
            left = np.ones((len(contexts), len(self.languages)))
            shorter = union & ((1 << (self.width * (m - 1))) - 1)
            base = np.full(
                (len(union), len(self.languages)), 2.0**-self.uniform,
            ) if m == 1 else below["p"][np.searchsorted(below["g"], shorter)]
            for k, c in enumerate(counted):
                g, n, ones = c[m]
                discount = ones
                ctx, at = np.unique(g >> self.width, return_inverse=True)
                total, kinds = np.bincount(at, n), np.bincount(at)
                own = np.zeros(len(union))
                own[np.searchsorted(union, g)] = np.maximum(n - discount, 0) / total[at]
                left[np.searchsorted(contexts, ctx), k] = discount * kinds / total
                prob[:, k] = own + left[np.searchsorted(contexts, union >> self.width), k] * base[:, k]
            below = {"g": union, "p": prob}
            self.tables.append(self._sorted(union, prob))
            self.backoff.append(self._sorted(contexts, left))

    @staticmethod
    def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashed(keys)
        by = np.argsort(h)
        return h[by], -np.log2(np.maximum(values[by], 1e-30)).astype(np.float32)

    @staticmethod
    def _counts(g: np.ndarray, n: np.ndarray, order: int, width: int) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
        """By order: grams, counts (raw at the top, distinct left neighbours below) and the absolute discount."""
        out = {}
        for m in range(order, 0, -1):
            one, two = int((n == 1).sum()), int((n == 2).sum())
            out[m] = g, n.astype(np.float64), one / (one + 2 * two) if one and two else 0.5
            g, n = np.unique(g & ((1 << (width * (m - 1))) - 1), return_counts=True) if m > 1 else (g, n)
        return out

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def bits(self, packed: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each gram's last character after the others, for each language."""
        out = np.zeros((len(packed), len(self.languages)), np.float32)
        packed, rest = packed.astype(np.uint64), np.arange(len(packed))
        for m in range(self.order, 0, -1):
            g = packed[rest] & ((1 << (self.width * m)) - 1)
            keys, values = self.tables[m - 1]
            at, found = self._find(keys, hashed(g))
            out[rest[found]] += values[at[found]]
            rest, g = rest[~found], g[~found]
            if not len(rest):
                return out
            keys, values = self.backoff[m - 1]
            at, found = self._find(keys, hashed(g >> self.width))
            out[rest[found]] += values[at[found]]
        out[rest] += self.uniform
        return out

    def entropies(self, coder: Coder, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits for each character in each language, and the number of letters of each text."""
        h, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for some in _parts([len(t) for t in texts]):
            codes, starts = coder([texts[k] for k in some])
            h[some] = np.add.reduceat(self.bits(grams(codes, self.order, starts, self.width)), starts, axis=0, dtype=np.float64)
            size = np.diff(np.append(starts, len(codes)))
            letters = (codes != 0) & (codes < coder.single + PAIRED)  # a letter of two codes counts once
            n[some] = np.add.reduceat(letters.astype(np.int64), starts)
            h[some] /= np.maximum(size, 1)[:, None]
        return h, n


def _parts(sizes: list[int]) -> Iterator[list[int]]:
    """Runs of texts of about SLICE characters; a longer text is one part of its own."""
    some, total = [], 0
    for k, n in enumerate(sizes):
        if some and total + n > SLICE:
            yield some
            some, total = [], 0
        some.append(k)
        total += n
    if some:
        yield some


#: Lengths in characters at which rejection is calibrated, and snippets of each held-back text at each.
LENGTHS, SNIPPETS = (8, 16, 32, 64, 128, 256, 512, 1024, 4096), 4
#: Share of snippets at either end that calibration passes over, and how far above nearly all others a text to learn from may be.
TAIL, STRANGE = 0.0005, 4.0
#: How far above the held-back texts the limit is at least, as a factor: texts a little stranger than all of a few hundred stay.
SLACK = 1.15
#: Languages that are learnt at most: those with the most texts.
LANGUAGES = 256


class Identifier:
    """Models with their calibration."""

    def __init__(self, texts: dict[str, list[str]]):
        texts = {k: self._usual(t) for k, t in texts.items()}
        held = {k: t[::4] if len(t) > 8 else t for k, t in texts.items()}
        fit = {k: [x for i, x in enumerate(t) if i % 4] if len(t) > 8 else t for k, t in texts.items()}
        self.model = KneserNey(fit)
        self.coder, best = Coder(self.model.alphabet), (np.inf, 1.0)
        seen = [(self.model.entropies(self.coder, held[lang]), k) for k, lang in enumerate(self.model.languages)]
        for power in np.linspace(0.1, 6, 30):
            loss = -sum(np.log(np.maximum(self._shares(h, n, power)[:, k], 1e-9)).sum() for (h, n), k in seen)
            best = min(best, (loss, power))
        self.power = best[1]
        self.limits, self.spread = self._calibrated(held)

    @staticmethod
    def _usual(texts: list[str]) -> list[str]:
        """``texts`` without those that a model of the language's other texts finds far stranger than nine tenths of them.

        Each half is read by a model of the other half, so a stray text (junk, code, another language) does not vouch for itself.
        """
        if len(texts) <= 16:
            return texts
        bits = np.zeros(len(texts))
        for half in (0, 1):
            model = KneserNey({"": texts[1 - half :: 2]})
            h, n = model.entropies(Coder(model.alphabet), texts[half::2])
            bits[half::2] = np.where(n > 0, h[:, 0], np.inf)
        middle, high = np.quantile(bits, [0.5, 0.85], method="lower")
        return [t for t, b in zip(texts, bits, strict=True) if b <= middle + STRANGE * max(high - middle, 0.05 * middle)]

    def _calibrated(self, held: dict[str, list[str]]) -> tuple[np.ndarray, float]:
        """Bits for each character beyond which a text is in none of the languages, at each of LENGTHS; and their scale."""
        limits, spread, high = [], [], 0.0
        for size in LENGTHS[::-1]:
            own, foreign = [], []
            for k, lang in enumerate(self.model.languages):
                some = [t[a : a + size] for t in held[lang] for a in np.linspace(0, max(0, len(t) - size), SNIPPETS).astype(int).tolist()]
                h, n = self.model.entropies(self.coder, sorted(set(some)))
                h = h[n > 0]
                own.append(h.min(axis=1))
                foreign.append(np.delete(h, k, axis=1).min(axis=1) if h.shape[1] > 1 else np.full(len(h), self.model.uniform))
            own, foreign = np.concatenate(own), np.concatenate(foreign)
            # Quantiles, as a few strange texts may be left; shorter texts vary more, so their limit is no lower.
            high = max(high, np.quantile(own, 1 - TAIL) if len(own) else 0.0)
            near = np.quantile(foreign, 10 * TAIL) if len(foreign) else self.model.uniform
            limits.append(max(SLACK * high, (high + near) / 2))
            spread.append(own.std() if len(own) else 0.0)
        return np.array(limits[::-1]), max(float(np.mean(spread)), 1e-3)

    @staticmethod
    def _shares(h: np.ndarray, n: np.ndarray, power: float) -> np.ndarray:
        x = -h * power * np.log(2) * np.sqrt(np.maximum(n, 1))[:, None]
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits for each character and rejection of each text."""
        h, n = self.model.entropies(self.coder, texts)
        best = h.argmin(axis=1)
        rows = np.arange(len(texts))
        low = h[rows, best]
        beyond = low - np.interp(np.log(np.maximum(n, 1)), np.log(LENGTHS), self.limits)
        within = 1 / (1 + np.exp(np.clip(beyond / self.spread, -50, 50)))
        score = np.where(n > 0, self._shares(h, n, self.power)[rows, best] * within, 0.0)
        names = [self.model.languages[b] if k else UND for b, k in zip(best, n, strict=True)]
        return names, score, low, (n == 0) | (beyond > 0)


def learn(
    docs: DataFrame, learn_from: Column, per_language: int = DOCS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang",
) -> Identifier | None:
    """Fit on at most ``per_language`` whole documents of each language among rows where ``learn_from`` holds."""
    rows = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(
        F.col(lang_col).alias("lang"), F.col(id_col).alias("id"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).alias("h"),
    )
    # Only ids whose hash is small enough for about four times the bound go on, so what meets in a language's task does not grow.
    # Repeated rows count once in all of this; the size only has to be about right, so it is estimated without a shuffle of hashes.
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("size")).orderBy(F.desc("size"), "lang").limit(LANGUAGES)
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    rows = rows.join(F.broadcast(sizes), "lang").where(share * F.col("size") <= 4.0 * per_language).select("lang", "h").distinct()
    picked = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= per_language)
    # at most per_language rows for each language, so this broadcast is bounded
    sample = docs.where(learn_from).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).alias("h"),
    )
    sample = sample.join(
        F.broadcast(picked.select("lang", "h")), ["lang", "h"], "left_semi",
    ).groupBy("lang", "h").agg(F.min("text").alias("text"))
    texts: dict[str, dict[int, str]] = {}
    for r in sample.collect():
        texts.setdefault(r["lang"], {})[r["h"]] = r["text"]
    chosen = {lang: [t for _, t in sorted(ts.items()) if any(c.isalpha() for c in t)] for lang, ts in texts.items()}
    chosen = {lang: ts for lang, ts in chosen.items() if ts}
    return Identifier(chosen) if chosen else None


def identified(
    docs: DataFrame, identifier: Identifier | None, text_col: str = "text",
    names: tuple[str, str, str] = ("lang_pred", "score", "rejected"),
) -> DataFrame:
    """``docs`` with the predicted language, its score and whether it is rejected; no row is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(identifier)
    taken, free = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        free.append(name)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            if known and texts:
                lang, score, _, out = known.predict(texts)
            else:
                lang, score, out = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(out)], [*batch.schema.names, *free],
            )

    added = [StructField(name, kind) for name, kind in zip(free, (StringType(), DoubleType(), BooleanType()), strict=True)]
    return docs.mapInArrow(predict, StructType([*docs.schema.fields, *added]))


def in_known_languages(docs: DataFrame, held_back: int = 5, text_col: str = "text") -> DataFrame:
    """``docs`` without texts that no learnt language explains and without texts that have no letter."""
    known = learn(docs, crc_bucket(F.col("doc_id"), held_back) != 0)
    names = tuple(fresh(docs, "lang_pred", "lang_score", "lang_rejected"))
    return identified(docs, known, text_col, names).where(~F.col(names[2])).select(*docs.columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_bucket(F.col("doc_id"), 5) == 0
    out = identified(docs.select("doc_id", "text", held.alias("held_out")), learn(docs, ~held))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
