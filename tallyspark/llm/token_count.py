"""Token counts (3): overlap resynchronisation of huge documents.

A text of at most CHUNK characters is counted as a whole. A longer one is encoded in chunks that
overlap; where a chunk and the next one both start a token at an edge of white space, at the same offset, and
agree on the tokens that follow, the scan of the second has caught up with the first: such a place
is a stable boundary, at which the two encodings are spliced. If an overlap has no such place (say, one
word longer than it), it is doubled, if need be until the two chunks are one, so the count is always that
of the whole text.

Why the boundary is stable: the tokenizer cuts a text into pieces by a pattern that scans from left to
right without memory, and merges inside pieces only. Two scans that both start a piece at one place
continue alike; no piece reaches over that edge (behind the white space where pieces drop it, before it
where they keep it), so what precedes is not changed by the end of the left chunk either.

Shorter texts need no splicing. For tokenizers whose pieces never contain white space (``pieces_drop_blanks``)
their count is the sum over their blank-separated words, and each task remembers the counts of short words it
has met, which is faster than encoding each text and gives the same. ``n_chunks`` and ``n_widened`` tell, for each
document, how many chunks were encoded (1 for a short text) and how often an overlap was widened.

Edge cases: null counts as empty (no tokens); texts of white space only have none; strings of special
tokens inside a text are handled as the library does by default; an empty table gives an empty result;
extra columns are passed over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import table

CHUNK = 16_384
OVERLAP = 256
AGREE = 3
#: Words whose counts a task remembers, and their bytes at most; beyond the number the memory is emptied.
MEMO, MEMO_BYTES = 400_000, 48
SLICE = 256
#: Fixed value: the pattern of a word tokenizer's pieces, none of which can contain white space.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def pieces_drop_blanks(spec: dict) -> bool:
    """Whether a tokenizers file keeps only matches of WORD_PIECES, so that white space always parts pieces."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    known = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and first.get("pattern") == {"Regex": WORD_PIECES}
    plain = all(n.get("type") in ("NFC", "Lowercase", "Replace") and n.get("pattern", {"Regex": r"\s+"}) == {"Regex": r"\s+"} for n in (spec.get("normalizer") or {}).get("normalizers", [{"type": ""}]))
    added = all(not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    return known and plain and added


class TokenCounter:
    """Counts tokens as the library of the file does; made once in each task."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.chunk, self.overlap, self.memo = chunk, overlap, {}
        if path.endswith(".model"):
            import sentencepiece

            self.pieces, self.by_word = sentencepiece.SentencePieceProcessor(model_file=path), False
            self.count_all = lambda texts: [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            self.pieces = Tokenizer.from_file(path)
            self.pieces.no_truncation()
            self.pieces.no_padding()
            with open(path, encoding="utf-8") as f:
                self.by_word = pieces_drop_blanks(json.load(f))
            self.count_all = lambda texts: [len(x.ids) for x in self.pieces.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (code points) at which the tokens start, and their ids."""
        if hasattr(self.pieces, "encode_batch_fast"):
            e = self.pieces.encode(text, add_special_tokens=False)
            return np.array([a for a, _ in e.offsets], np.int64), np.array(e.ids, np.int64)
        found = self.pieces.encode(text, return_type="proto").pieces
        place = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1  # these offsets count bytes
        return np.append(place, len(text))[[p.begin for p in found]], np.array([p.id for p in found], np.int64)

    def spliced(self, text: str) -> tuple[int, int, int]:
        """The count of a huge text, from overlapping chunks; their number, and how many overlaps were widened."""
        total, done, end, chunks, widened = 0, 0, self.chunk, 1, 0
        starts, ids = self.encoded(text[:end])
        while end < len(text):
            overlap = self.overlap
            while True:
                begin = max(done, end - overlap)
                if begin == done:  # no boundary in the whole chunk: encode on from its own start
                    end += end - begin
                    starts, ids = self._resumed(text, begin, end)
                    chunks += 1
                    break
                stop = max(begin + self.chunk, end + self.chunk // 2)  # a widened overlap must not stop the advance
                nxt, nxt_ids = self.encoded(text[begin:stop])
                nxt, chunks = nxt + begin, chunks + 1
                at = self._boundary(text, starts, ids, nxt, nxt_ids, end)
                if at is not None:
                    total += int(np.searchsorted(starts, at))
                    keep = np.searchsorted(nxt, at)
                    starts, ids, done, end = nxt[keep:], nxt_ids[keep:], at, stop
                    break
                overlap, widened = overlap * 2, widened + 1
        return total + len(starts), chunks, widened

    def _resumed(self, text: str, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of text[at:end] for a stable boundary ``at``, with text before it, as some tokenizers mark a text's start."""
        back = self.overlap
        while True:
            begin = max(0, at - back)
            starts, ids = self.encoded(text[begin:end])
            starts += begin
            k = int(np.searchsorted(starts, at))
            if begin == 0 or (0 < k < len(starts) and starts[k] == at):
                return starts[k:], ids[k:]
            back *= 2

    def _boundary(self, text: str, a, a_ids, b, b_ids, end: int) -> int | None:
        """The last place before ``end`` where both encodings start a token at an edge and agree on what follows."""
        _, i, j = np.intersect1d(a, b, return_indices=True)
        for x, y in zip(i[::-1], j[::-1], strict=True):
            n = min(AGREE, len(a) - x, len(b) - y)
            if n == AGREE and b[y] > b[0] and self._edge(text, int(a[x])) and a[x + n - 1] < end and (a[x : x + n] == b[y : y + n]).all() and (a_ids[x : x + n - 1] == b_ids[y : y + n - 1]).all():
                return int(a[x])
        return None

    def _edge(self, text: str, at: int) -> bool:
        """Whether a piece surely starts here: behind white space if pieces drop it, else where white space begins."""
        before, here = text[at - 1].isspace(), text[at : at + 1].isspace()
        return before and not here if self.by_word else here and not before

    def counts(self, texts: list[str]) -> list[int]:
        return [n for n, _, _ in self.counted(texts)]

    def counted(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """Tokens, chunks and widened overlaps of each text."""
        out = [self.spliced(t) if len(t) > self.chunk else None for t in texts]
        short = [k for k, x in enumerate(out) if x is None]
        counted = self._by_word if self.by_word else self.count_all
        for k, n in zip(short, counted([texts[k] for k in short]), strict=True):
            out[k] = n, 1, 0
        return out

    def _by_word(self, texts: list[str]) -> list[int]:
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list({w for ws in words for w in ws if w not in self.memo})
        known = dict(zip(new, self.count_all([w.decode("utf-8", "replace") for w in new]), strict=True))
        self.memo.update(known)
        out = [sum(map(self.memo.__getitem__, ws)) for ws in words]
        for w in new:
            if len(w) > MEMO_BYTES:
                del self.memo[w]
        return out


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """id, n_bytes, n_tokens, n_chunks, n_widened, over_limit of each document. The tokenizer's file is read where each executor finds it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = TokenCounter(tokenizer_path, chunk, overlap)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = [pa.array(c, pa.int64()) for c in zip(*counter.counted(texts), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *counts], ["id", "n_bytes", "n_tokens", "n_chunks", "n_widened"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
    )
    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, n_chunks long, n_widened long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
