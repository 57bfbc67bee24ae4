"""SentencePiece encoding and decoding (13): vectorised merge rounds over flat numpy arrays.

Encoding lays the characters of a slice of texts into one flat array of symbols and cuts it between two
characters that follow each other inside no piece (so at every start of blanks, among others): no merge reaches over
such a cut. Then rounds of merges run over all segments together:

1. every adjacent pair of symbols has a rank, the order of the score of the piece it makes (NONE if there is none);
2. a segmented minimum gives each segment's best rank; segments without a pair are done and leave;
3. in each segment the pairs of that rank merge at once, from the left, where overlapping ones alternate;
4. the arrays are compacted and the ranks beside the merges looked up anew, until no pair remains.

The library merges one pair at a time, the best score first and of equal ones the leftmost. Merging many at once
is the same as long as no merge makes a pair that comes before, or is on a par with, the current rank. Where one
does, the merges to its right wait for the next round, so the result equals the library's in any case.

Characters that no piece covers become byte pieces. Decoding joins the bytes of the pieces, drops the blank that
encoding had put before the text, and turns every byte that is not valid UTF-8 into U+FFFD.

Only models of this kind are taken, others raise ValueError: BPE with byte fallback, the identity as
normaliser with escaped blanks that are neither removed nor suffixes, no pieces of the user or unused ones.

Edge cases: null counts as empty and has no ids; text of blanks only is encoded like any other; texts of any length are
encoded whole (the arrays hold SYMBOLS at a time, or one longer segment); repeated rows are encoded each; null ids decode to an empty text, ids outside the model raise; an empty table gives an empty result; extra columns
stay untouched, whatever their names.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import table

#: Fixed value: the character that stands for a blank inside pieces.
BLANK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Symbols that merge together, at most (but for one longer segment), and texts and characters of a slice.
SYMBOLS, SLICE, SLICE_CHARS = 1 << 19, 512, 1 << 20
#: Slots of the set of neighbours inside pieces. Two neighbours that share a slot only make a segment longer.
NEIGHBOURS = 1 << 22
NONE = np.iinfo(np.int32).max

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class _Pairs:
    """The rank of each pair of symbols and the piece it makes, in an open hash table of arrays."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks, self.made = np.full(1 << self.bits, NONE, np.int32), np.zeros(1 << self.bits, np.int32)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.ranks[slot[put]], self.made[slot[put]] = keys[put], values[put, 0], values[put, 1]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a.astype(np.int64) << 32) | b
        slot = self._slot(key)
        met = self.keys[slot]
        rank, made = np.where(met == key, self.ranks[slot], NONE), self.made[slot]
        left = np.flatnonzero((met != key) & (met != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            met = self.keys[slot[left]]
            hit = left[met == key[left]]
            rank[hit], made[hit] = self.ranks[slot[hit]], self.made[slot[hit]]
            left = left[(met != key[left]) & (met != -1)]
        return rank, made


class PieceCodec:
    """The tables of one model file; made once in each Python worker."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds, (train, norm) = [p.type for p in model.pieces], (model.trainer_spec, model.normalizer_spec)
        plain = norm.escape_whitespaces and not (norm.precompiled_charsmap or norm.remove_extra_whitespaces or model.denormalizer_spec.precompiled_charsmap)
        if train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix or not plain or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("not a BPE model with byte fallback and the identity as normaliser")
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece reaches over the start of a blank")
        self.prefix, size = norm.add_dummy_prefix, len(kinds)
        # A character is the symbol of its piece, or else a symbol behind all pieces.
        self.first = np.arange(0x110000, dtype=np.int32) + size
        self.size, symbol = size, lambda s: pieces[s] if s in pieces else size + ord(s) if len(s) == 1 else None
        for p, i in pieces.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        order = {s: k for k, s in enumerate(sorted({model.pieces[i].score for i in pieces.values()}, reverse=True))}
        pairs, self.inner = {}, np.zeros(NEIGHBOURS, bool)
        inside = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.inner[self._neighbours(np.array([list(map(ord, x)) for x in inside], np.uint32).reshape(-1, 2).T)] = True
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = order[model.pieces[i].score], i
        self.pair = _Pairs(pairs)
        self.byte = np.zeros(256, np.int32)
        self.surface = [p.piece.replace(BLANK, " ").encode() for p in model.pieces]
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type != NORMAL:
                self.surface[i] = train.unk_surface.encode() if p.type == UNKNOWN else b""
        self.normal, self.control = (np.array([k == kind for k in kinds]) for kind in (NORMAL, CONTROL))

    # -- encoding

    @staticmethod
    def _neighbours(two: np.ndarray) -> np.ndarray:
        """Slots of pairs of characters."""
        return (two[0] * np.uint32(0x9E3779B1) + two[1] * np.uint32(0x85EBCA77)) >> np.uint32(32 - 22)

    def _rounds(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of the segments ``seg`` of symbols ``sym``; what remains, with its segments, in order."""
        done = []
        last = np.append(seg[1:] != seg[:-1], True)  # no pair reaches over the end of a segment
        rank, made = self.pair(sym, np.append(sym[1:], 0))
        rank[last] = NONE
        while len(sym):
            starts = np.flatnonzero(np.append(True, last[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            live = best < NONE
            if not live.all():
                over, on = np.flatnonzero(~live), np.flatnonzero(live)
                done.append((seg.take(over), sym.take(over)))
                sym, seg, rank, made, best, last = (x.take(on) for x in (sym, seg, rank, made, best, last))
            at = np.flatnonzero(rank == best)
            if not len(at):
                break
            # Of overlapping pairs (they stand side by side) every other one, from the left.
            k = np.arange(len(at))
            at = at[(k - np.maximum.accumulate(np.where(np.append(True, np.diff(at) > 1), k, 0))) % 2 == 0]
            # A merge whose new pairs do not come later than it lets those to its right wait.
            new, here = made[at], seg[at]
            left, right = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
            opens = np.append(True, here[1:] != here[:-1])
            joined = np.append(False, np.diff(at) == 2) & ~opens
            has_left, has_right = (at > 0) & ~last[left], ~last[at + 1]
            before, before_made = self.pair(np.where(joined, np.append(0, new[:-1]), sym[left]), new)
            after, after_made = self.pair(new, sym[right])
            early = (has_left & (before <= best[at])) | (has_right & (after <= best[at]))
            if early.any():
                so_far = np.cumsum(early) - early
                go = so_far == np.maximum.accumulate(np.where(opens, so_far, 0))
                at, new, left, has_left, has_right = at[go], new[go], left[go], has_left[go], has_right[go]
                before, before_made, after, after_made = before[go], before_made[go], after[go], after_made[go]
            sym[at], last[at] = new, ~has_right
            # Between two merges side by side the later one's left pair holds, and is written over the earlier one's right pair.
            rank[at], made[at] = np.where(has_right, after, NONE), after_made
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            left = np.where(keep[left], left, left - 1)[has_left]
            rank[left], made[left] = before[has_left], before_made[has_left]
            on = np.flatnonzero(keep)
            sym, seg, rank, made, last = (x.take(on) for x in (sym, seg, rank, made, last))
        seg, sym = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (seg, sym)
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def _bytes(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes."""
        at = np.flatnonzero(sym >= self.size)
        if not len(at):
            return sym, seg
        raw = [chr(c).encode() for c in (sym[at] - self.size).tolist()]
        n = np.ones(len(sym), np.int64)
        n[at] = [len(r) for r in raw]
        out, begins = np.repeat(sym, n), np.cumsum(n) - n
        spread = np.repeat(begins[at] - (np.cumsum(n[at]) - n[at]), n[at]) + np.arange(n[at].sum())
        out[spread] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.repeat(seg, n)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and how many each has."""
        marked = [BLANK + t if t and self.prefix else t for t in texts]
        chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).copy()
        chars[chars == ord(" ")] = ord(BLANK)
        ends = np.cumsum([len(t) for t in marked])
        cut = np.ones(len(chars) + 1, bool)  # before each character, and behind the last
        cut[1:-1] = ~self.inner[self._neighbours(np.stack([chars[:-1], chars[1:]]))]
        cut[ends] = True
        cuts, at, ids, counts = np.flatnonzero(cut), 0, [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        while at < len(chars):
            k = np.searchsorted(cuts, at + SYMBOLS, "right") - 1
            end = int(cuts[k] if cuts[k] > at else cuts[k + 1])
            begins = cuts[(cuts >= at) & (cuts < end)]
            seg = np.cumsum(cut[at:end], dtype=np.int32) - 1
            sym, seg = self._bytes(*self._rounds(self.first[chars[at:end]], seg))
            counts += np.bincount(np.searchsorted(ends, begins, "right")[seg], minlength=len(texts))
            ids.append(sym)
            at = end
        return np.concatenate(ids), counts

    # -- decoding

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and not (0 <= ids.min() and ids.max() < self.size):
            raise ValueError("an id is outside the model")
        apart = np.flatnonzero(self.control[ids])  # bytes on both sides of a control piece make no character together
        runs = np.split(ids, apart) if len(apart) else [ids]
        text = "".join(b"".join(map(self.surface.__getitem__, r.tolist())).decode("utf-8", "each_byte") for r in runs)
        said = ids[~self.control[ids]][:1]
        return text[1:] if self.prefix and len(said) and self.normal[said[0]] and text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encoded(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text_col`` in ``ids_col`` (array<int>) in place of the text.

    The model's file is read where each executor finds it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model_path)
        for batch in batches:
            column, at = batch.column(batch.num_columns - 1), 0
            while at < batch.num_rows:
                texts, chars = [], 0
                while at + len(texts) < batch.num_rows and len(texts) < SLICE and chars < SLICE_CHARS:
                    texts.append(column[at + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                ids, n = pieces.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()))
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names)
                at += len(texts)

    return _mapped(docs, run, text_col, (names := []), ids_col, "array<int>")


def decoded(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids in ``text_col``; the ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(model_path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat, edges = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for at in range(0, batch.num_rows, SLICE):
                texts = [pieces.decode(flat[a:b]) for a, b in zip(edges[at : at + SLICE], edges[at + 1 : at + SLICE + 1], strict=False)]
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)

    return _mapped(rows, run, ids_col, (names := []), text_col, "string", keep=True)


def _mapped(df: DataFrame, run, last: str, names: list[str], new: str, kind: str, keep: bool = False) -> DataFrame:
    """``df`` through ``run`` with the column ``last`` behind all others, under positional names while in Python."""
    if new.lower() in {c.lower() for c in df.columns if keep or c != last}:
        raise ValueError(f"{new} is a column already")
    others = [c for c in df.columns if c != last]
    value = F.col(f"`{last}`")
    value = F.coalesce(value, F.array().cast("array<int>")) if keep else value
    inside = [f"c{k}" for k in range(len(others) + 1)]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(others, inside, strict=False)), value.alias(inside[-1]))
    names.extend([*inside, "made"] if keep else [*inside[:-1], "made"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names) - 1])
    out = rows.mapInArrow(run, f"{schema}, made {kind}" if schema else f"made {kind}")
    return out.toDF(*others, *([last] if keep else []), new)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decoded(encoded(docs, path), path)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
