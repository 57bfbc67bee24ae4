"""N-gram Jaccard join (8): exact, by group signatures, count vectors in an R-tree, and verification.

A document is the set of its distinct word shingles. Two documents link when their Jaccard similarity is at
least ``num / den``, that is, when their sets differ in at most ``(|A| + |B|) (den - num) / (den + num)``
shingles. The join finds every link in these steps.

1. Group signatures. Shingles are hashed into more groups than a linked pair can have differences, so of the
   groups that hold anything at least one is equal in both. Each document emits a key (size class, group,
   hash of the group's content) for as many of its groups as that needs; a pair's class is that of its
   larger set, so a document near its class's end also emits for the next one. Keys that two different
   sets share, found by a grouped minimum and maximum with partial aggregation, name a hub: the smallest
   signature that has the key. Whoever shares a key with a hub joins its group; a pair that links is
   together in at least one group.
2. Count vectors. In a group, the counts of shingles by hash residue are points of an R-tree; the
   intersection of two sets, and of all sets below two nodes, is at most the sum of the coordinate minima, which
   rules out nodes and then pairs. Only the points travel to this step, not the sets.
3. Verification. The sets of what survives are read again and intersected in full, except pairs that are
   connected already. Equal groups of candidates from several hubs are verified once, and overlapping ones
   together if all their members fit a tile, so that a set travels once and not once for each hub.
4. Components of the verified edges, by large-star and small-star rounds.

Equal sets are one node throughout, however many copies there are. A group larger than TILE is cut into
tiles by size band and hash; each pair of tiles of equal or adjoining bands is a task of its own, so no
group is ever in one task as a whole, and each task returns at most a spanning forest.

Edge cases: null and empty texts have an empty set, link with nothing and are their own component; texts
with fewer words than a shingle are one shingle; null ids never name a component that has another id;
rows that repeat an id and text are one document; an empty table gives an empty result. Sets are named by 64-bit hashes
while candidates are searched: of two different sets of one hash only one would be met (among a billion sets a chance of three
in a hundred that there is such a pair at all); what is verified is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import BROADCAST_ROWS, fresh, scratch, semi, table, written
from tallyspark.llm.count_tree import candidates, packed, point, unpacked
from tallyspark.llm.repeats import hit, repeat_filter

TILE = 512
#: Bytes of text shingled at once.
PART = 1 << 20
SEEN = 100_000
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * TWO
    return x ^ (x >> np.uint64(29))


#: By byte: whether it is ASCII white space, and its lower case.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted without repetitions."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]


class Shingler:
    """Sets of shingle hashes (64 bits, sorted) of texts: words parted by ASCII white space, A-Z in lower case."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        h, ends = self._words(raw, at - at[0])
        whole = self._windows(h, self.size) if len(h) >= self.size else None
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a >= self.size:
                out.append(distinct(whole[a : b - self.size + 1]))
            else:
                out.append(self._windows(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
        return out

    @staticmethod
    def _words(raw: np.ndarray, edges: np.ndarray, step: int = PART) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, each a sum over its bytes and their places, and how many start before each edge of a text.

        Sums are taken over ``step`` bytes at a time, so the memory for a very long text is that of its words.
        """
        inside = ~SPACE[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = edges[:-1][edges[:-1] < len(raw)]
        begins[first] = inside[first]
        starts = np.flatnonzero(begins)
        sums, before = np.zeros(len(starts), np.uint64), 0
        for at in range(0, len(raw), step):
            some, begun = inside[at : at + step], begins[at : at + step]
            place = np.flatnonzero(some)
            if len(place):
                word = before + np.cumsum(begun)[place] - 1
                x = (place + at - starts[word]).astype(np.uint64) << np.uint64(8) | LOWER[raw[at + place]]
                cuts = np.flatnonzero(np.diff(word, prepend=-1))
                sums[word[cuts]] += np.add.reduceat(mix(x * ONE + TWO), cuts)
            before += int(begun.sum())
        return mix(sums * ONE), np.searchsorted(starts, edges)

    @staticmethod
    def _windows(h: np.ndarray, n: int) -> np.ndarray:
        x = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            x = mix((x ^ h[j : len(h) - n + 1 + j]) * ONE)
        return x


class Signer:
    """Keys of a set: enough group signatures that any linked pair shares one."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differences(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def keys(self, s: np.ndarray) -> np.ndarray:
        n, most = len(s), len(s) * self.den // self.num  # no set larger than ``most`` links
        if not n or not self.differences(n, most):
            return np.zeros(0, np.int64)
        c = n.bit_length() - 1
        out = [self._class_keys(s, c, min(most, 2 ** (c + 1) - 1))]
        if most >= 2 ** (c + 1):
            out.append(self._class_keys(s, c + 1, most))
        return np.concatenate(out)

    def _class_keys(self, s: np.ndarray, c: int, most: int) -> np.ndarray:
        top = 2 ** (c + 1) - 1
        groups = self.differences(top, top) * 23 // 20 + 2
        need = self.differences(len(s), most) + 1
        m = mix(s * ONE + np.uint64(c))
        g = (m % np.uint64(groups)).astype(np.int64)
        size, content = np.bincount(g, minlength=groups), np.zeros(groups, np.uint64)
        np.add.at(content, g, mix(m))
        keys = mix((content + mix((np.arange(groups, dtype=np.uint64) + np.uint64(c << 32)) * TWO)) * ONE)
        # Fullest groups first: an order that depends on the key alone, so the first equal one is in both prefixes.
        keys = (np.uint64(255) - np.minimum(size, 255).astype(np.uint64) << np.uint64(56)) | (keys >> np.uint64(8))
        return np.partition(keys, need - 1)[:need].view(np.int64)


class Forest:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


#: Up to so many pairs are verified one by one; more, by products of incidence blocks.
FEW = 3000
BLOCK = 4096


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, num: int, den: int) -> Forest:
    """The forest of all links within ``left``, or between ``left`` and ``right`` (positions in ``sets``)."""
    forest, sizes = Forest(len(sets)), [len(s) for s in sets]
    i, j, bound = candidates([point(s) for s in sets], left, right, num, den)
    for at in range(0, len(i), 1 << 20):
        part = slice(at, at + (1 << 20))
        order = np.argsort(-bound[part], kind="stable")
        pi, pj = i[part][order], j[part][order]
        shared = _products(sets, pi, pj) if len(pi) > FEW else None
        if shared is not None:
            n = np.array(sizes)
            good = shared * (den + num) >= num * (n[pi] + n[pj])
            for x, y in zip(pi[good].tolist(), pj[good].tolist(), strict=True):
                forest.join(x, y)
            continue
        for x, y in zip(pi.tolist(), pj.tolist(), strict=True):
            if forest.root(x) != forest.root(y):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both * (den + num) >= num * (sizes[x] + sizes[y]):
                    forest.join(x, y)
    return forest


def _products(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray | None:
    """Sizes of the intersections of many pairs by dense products, or None if one by one is cheaper."""
    docs = np.unique(np.concatenate([i, j]))
    sizes = np.array([len(sets[d]) for d in docs])
    _, token, df = np.unique(np.concatenate([sets[d] for d in docs]), return_inverse=True, return_counts=True)
    new = np.cumsum(df > 1) - 1  # shingles that only one set has add nothing
    wide, row = int((df > 1).sum()), np.repeat(np.arange(len(docs)), sizes)
    if wide * float(len(docs)) ** 2 > 2e5 * len(i):
        return None
    keep = df[token] > 1
    row, token = row[keep], new[token[keep]]
    by = np.argsort(token, kind="stable")
    row, token = row[by], token[by]
    out = np.zeros((len(docs), len(docs)), np.float32)
    for at in range(0, wide, BLOCK):
        a, b = np.searchsorted(token, [at, at + BLOCK])
        x = np.zeros((len(docs), min(BLOCK, wide - at)), np.float32)
        x[row[a:b], token[a:b] - at] = 1
        out += x @ x.T
    return out[np.searchsorted(docs, i), np.searchsorted(docs, j)].round().astype(np.int64)


def _short(name: str) -> int:
    """The first 64 bits of a signature."""
    return int.from_bytes(bytes.fromhex(name[:16]), "big", signed=True)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about PART bytes of text; a longer text is one of its own."""
    for batch in filter(lambda b: b.num_rows, batches):
        sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy()
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PART, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def _scan(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """For slices of a task's batches: the slice, and (set, name, whether this task sees it first) of each text."""
    shingle, seen = Shingler(size), set()
    for part in _parts(batches):
        if len(seen) > SEEN:
            seen.clear()
        out = []
        for s in shingle(part.column(2)):
            name = xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None
            out.append((s, name, name is not None and name not in seen))
            seen.add(name)
        yield part, out


def _keys(rows: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """First scan: (key, sig) of each set that a task meets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(num, den)
        for _, sets in _scan(batches, size):
            keys = [(sign.keys(s), _short(name)) for s, name, new in sets if new]
            if keys:
                sigs = np.repeat(np.array([x for _, x in keys], np.int64), [len(k) for k, _ in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in keys])), pa.array(sigs)], ["key", "sig"])

    return rows.mapInArrow(scan, "key long, sig long")


def _points(rows: DataFrame, size: int, num: int, den: int, plane) -> DataFrame:
    """Second scan: a row for each document; shared keys and the count vector once for each set and task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, shared = Signer(num, den), np.frombuffer(plane.value, np.uint8)
        for part, sets in _scan(batches, size):
            keys = [np.unique(sign.keys(s)) if new else np.zeros(0, np.int64) for s, _, new in sets]
            keys = [k[hit(shared, k)] if len(k) else k for k in keys]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            points = [packed(point(s)) if len(k) else None for k, (s, _, _) in zip(keys, sets, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array([len(s) for s, _, _ in sets], pa.int64()), pa.array([n for _, n, _ in sets], pa.string()), pa.array([_short(n) if n else 0 for _, n, _ in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))), pa.array(points, pa.binary()),
                ],
                ["id", "digest", "n", "name", "sig", "keys", "point"],
            )

    return rows.mapInArrow(
        scan,
        f"id {rows.schema['id'].dataType.simpleString()}, digest long, n long, name string, sig long, keys array<long>, point binary",
    )


def _sets(rows: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """Third scan: (s, name, shingles) of the texts whose digests are in ``wanted``; others are not shingled again."""
    sent = rows.sparkSession.sparkContext.broadcast(repeat_filter(wanted, wanted.count(), once=True))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = np.frombuffer(sent.value, np.uint8)
        some = (b.filter(pa.array(hit(plane, b.column(1).to_numpy()))) for b in batches)
        for _, sets in _scan(some, size):
            new = [(_short(name), name, s.tobytes()) for s, name, first in sets if first]
            if new:
                kinds = (pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*new, strict=True), kinds, strict=True)], ["s", "name", "shingles"],
                )

    return rows.mapInArrow(scan, "s long, name string, shingles binary")


def _mapped(df: DataFrame, row, schema: str) -> DataFrame:
    """``df`` with each row's first columns, and ``row`` of its last two (binary) columns in place of these."""
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = [row(x.as_py(), y.as_py()) for x, y in zip(*batch.columns[-2:], strict=True)]
                added = [pa.array(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *added], names)

    return df.mapInArrow(scan, schema)


def _spokes(members: DataFrame, hubs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """``members`` of large groups with their own ``value`` and their hub's, which meet in as many tasks as a group has tiles."""
    salts = F.ceil(F.col("total") / TILE).cast("int")
    spokes = members.join(hubs, "hub").where("sig <> hub").withColumn("salt", F.pmod(F.xxhash64("sig"), salts).cast("int")).drop("total")
    spokes = spokes.join(values.select(F.col("s").alias("sig"), F.col(value).alias("own")), "sig")
    centres = hubs.join(values.select(F.col("s").alias("hub"), F.col(value).alias("of_hub")), "hub")
    centres = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("total")
    return spokes.join(centres, ["hub", "salt"]).drop("salt")


def _roles(members: DataFrame, hubs: DataFrame, points: DataFrame, sets_of, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """For members of large groups: (hub, sig, n, linked, near), and the edges (a, b) between hubs and those linked.

    Linked ones are connected through the hub. By the triangle inequality of the Jaccard distance the others can
    only link to them if they are within twice the greatest distance of a link from the hub, which is ``near``.
    """

    def bounded(own: bytes, of_hub: bytes) -> tuple[bool, bool]:
        p, q = unpacked(own), unpacked(of_hub)
        k, total = min(len(p), len(q)), int(p.sum()) + int(q.sum())
        most = int(np.minimum(p.reshape(-1, k).sum(axis=0), q.reshape(-1, k).sum(axis=0)).sum())
        return most * (den + num) >= num * total, most * den >= (2 * num - den) * (total - most)

    def links(own: bytes, of_hub: bytes) -> tuple[bool]:
        p, q = np.frombuffer(own, np.uint64), np.frombuffer(of_hub, np.uint64)
        return (len(np.intersect1d(p, q, assume_unique=True)) * (den + num) >= num * (len(p) + len(q)),)

    if hubs.count() <= BROADCAST_ROWS:
        hubs = F.broadcast(hubs)
    spokes = _spokes(members.select("hub", "sig", "n"), hubs, points, "point").select("hub", "sig", "n", "own", "of_hub")
    spokes = written(_mapped(spokes, bounded, "hub long, sig long, n long, fits boolean, near boolean"), "spokes")
    fits = spokes.where("fits").select("hub", "sig")
    sets = written(sets_of(fits.select("sig").unionByName(hubs.select(F.col("hub").alias("sig")))), "hub_sets")
    pairs = _spokes(fits, hubs, sets, "shingles").join(sets.select(F.col("s").alias("sig"), F.col("name").alias("a")), "sig")
    pairs = pairs.join(sets.select(F.col("s").alias("hub"), F.col("name").alias("b")), "hub")
    met = _mapped(pairs.select("hub", "sig", "a", "b", "own", "of_hub"), links, "hub long, sig long, a string, b string, linked boolean")
    linked = written(met.where("linked"), "linked")
    centres = members.where("sig = hub").join(hubs, "hub", "left_semi").select(
        "hub", "sig", "n", F.lit(True).alias("linked"), F.lit(True).alias("near"),
    )
    others = spokes.join(linked.select("hub", "sig", "linked"), ["hub", "sig"], "left")
    others = others.select("hub", "sig", "n", F.coalesce("linked", F.lit(False)).alias("linked"), "near")
    return written(centres.unionByName(others), "roles"), linked.select("a", "b")


TASK = ["hub", "kind", "b1", "s1", "b2", "s2"]


def _tiled(roles: DataFrame, num: int, den: int) -> DataFrame:
    """Tasks of large groups: pairs of tiles of members that are not linked to the hub, and of near ones with linked ones."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))).cast("int")
    roles = roles.withColumn("band", band)
    tiles = lambda c: F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col(c) / TILE).cast("int").alias("k")))).alias(c)
    counts = roles.groupBy("hub", "band").agg(
        F.count_if(~F.col("linked")).alias("free"), F.count_if(~F.col("linked") & F.col("near")).alias("close"), F.count_if("linked").alias("held")
    )
    plan = written(counts.groupBy("hub").agg(tiles("free"), tiles("close"), tiles("held")), "tiles")
    if plan.count() <= BROADCAST_ROWS // 25:  # each row has a few numbers for each size band
        plan = F.broadcast(plan)
    m, b = roles.join(plan, "hub"), F.col("band")
    k = lambda c, d: F.coalesce(F.try_element_at(c, b + d), F.lit(0))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = lambda c: F.pmod(F.xxhash64("sig"), F.greatest(k(c, 0), F.lit(1)).cast("long")).cast("int")
    names = ("kind", "b1", "s1", "b2", "s2", "side")

    def task(*values):
        return F.struct(*((F.lit(v) if isinstance(v, int) else v).cast("int").alias(n) for n, v in zip(names, values, strict=True)))

    free, close, held = own("free"), own("close"), own("held")
    among = [
        F.transform(
            upto(k("free", 0)),
            lambda s: task(0, b, F.least(free, s), b, F.greatest(free, s), F.when(free == s, 0).when(free < s, 1).otherwise(2)),
        ),
        F.transform(upto(k("free", 1)), lambda s: task(0, b, free, b + 1, s, 1)),
        F.transform(upto(k("free", -1)), lambda s: task(0, b - 1, s, b, free, 2)),
    ]
    across = [F.transform(upto(k("held", d)), lambda s, d=d: task(1, b, close, b + d, s, 1)) for d in (-1, 0, 1)]
    back = [F.transform(upto(k("close", d)), lambda s, d=d: task(1, b + d, s, b, held, 2)) for d in (-1, 0, 1)]
    tasks = F.when(F.col("linked"), F.concat(*back)).when(F.col("near"), F.concat(*among, *across)).otherwise(F.concat(*among))
    return m.select("hub", "sig", F.explode(tasks).alias("t")).select("hub", "sig", "t.*")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of each group of equal first ``keys`` columns, which follow one another."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield held


def _halves(sides: list[int]) -> tuple[np.ndarray, np.ndarray | None]:
    """Positions of the two tiles of a task, or of its only tile."""
    s, here = np.array(sides), np.arange(len(sides))
    return (here[s == 1], here[s == 2]) if s.any() else (here, None)


def _survivors(tasks: DataFrame, num: int, den: int) -> DataFrame:
    """group, side, sig: members of a task that the R-tree's bound connects. Groups met in several tasks are one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _runs(batches, len(TASK)):
            sides, sigs, raw = zip(*rows, strict=True)
            left, right = _halves(sides)
            if len(rows) < 2 or not len(left) or (right is not None and not len(right)):
                continue
            points = [unpacked(p) for p in raw]
            forest, met = Forest(len(rows)), set()
            i, j, _ = candidates(points, left, right, num, den)
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                forest.join(x, y)
            met.update(i.tolist(), j.tolist())
            groups: dict[int, list[tuple]] = {}
            for x in met:
                groups.setdefault(forest.root(x), []).append((sides[x], sigs[x]))
            for g in groups.values():
                name = xxhash.xxh3_128_hexdigest(repr(sorted(g)))
                out += [(name, side, sig) for side, sig in g]
            if len(out) > 20_000:
                yield _columns(out, ("group", "side", "sig"))
                out = []
        if out:
            yield _columns(out, ("group", "side", "sig"))

    dealt = tasks.select(*TASK, "side", "sig", "point").repartition(*TASK).sortWithinPartitions(*TASK, "side", "sig")
    return dealt.mapInArrow(scan, "group string, side int, sig long").distinct()


def _merged(groups: DataFrame) -> DataFrame:
    """Overlapping groups as one where all their members fit a tile; the others, and halves of tile pairs, as they are."""
    whole = groups.where("side = 0")
    low = whole.groupBy("group").agg(F.min("sig").alias("b"))
    found = components(whole.join(low, "group").select(F.col("sig").alias("a"), "b"))
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    fits = found.groupBy("root").count().where(F.col("count") <= TILE)
    small = written(
        found.join(fits, "root").select(
            F.concat(F.lit("merged "), F.col("root").cast("string")).alias("group"), F.lit(0).alias("side"),
            F.col("node").alias("sig"),
        ),
        "merged",
    )
    rest = whole.join(small.select("sig"), "sig", "left_anti")
    return written(small.unionByName(rest).unionByName(groups.where("side <> 0")), "candidates")


def _columns(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"side": pa.int32(), "sig": pa.int64()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds.get(n, pa.string())) for c, n in zip(zip(*rows, strict=True), names, strict=True)], list(names),
    )


def _edges(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) names of linked sets: a spanning forest for each group of candidates."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 1):
            sides, names, raw = zip(*rows, strict=True)
            left, right = _halves(sides)
            if right is not None and not (len(left) and len(right)):
                continue
            forest = verified([np.frombuffer(x, np.uint64) for x in raw], left, right, num, den)
            edges = [(names[x], names[r]) for x in range(len(rows)) if (r := forest.root(x)) != x]
            if edges:
                yield _columns(edges, ("a", "b"))

    dealt = groups.select("group", "side", "name", "shingles").repartition("group").sortWithinPartitions("group", "side", "name")
    return dealt.mapInArrow(scan, "a string, b string")


def components(edges: DataFrame) -> DataFrame:
    """node, root for all nodes of ``edges`` (a, b) but the roots; the root is the smallest node it can reach."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = written(
            both.join(low, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large",
        )
        low = written(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")), "low")
        small = large.join(low, F.col("u") == F.col("x")).select("v", "m").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"),
        )
        e = written(small.unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def joined(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (of the text), n_shingles, component_id of each document: links at similarity num / den or more."""
    with scratch(docs.sparkSession) as kept:
        rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
        sent = docs.sparkSession.sparkContext.broadcast
        keys = _keys(rows, size, num, den).groupBy("key").agg(
            F.min("sig").alias("hub"), F.max("sig").alias("last"),
        ).where("hub <> last").select(F.col("key").alias("k"), "hub")
        keys = written(keys, "keys")
        read = written(_points(rows, size, num, den, sent(repeat_filter(keys.select("k"), keys.count(), once=True))), "points")
        members = read.where(F.size("keys") > 0).select("sig", "n", F.explode("keys").alias("key"))
        members = written(members.join(keys, F.col("key") == F.col("k")).select("hub", "sig", "n").distinct(), "members")
        points = read.where(F.col("point").isNotNull()).select(F.col("sig").alias("s"), "point").dropDuplicates(["s"])

        def sets_of(sigs: DataFrame) -> DataFrame:
            wanted = read.select("digest", "sig").join(sigs.distinct(), "sig", "left_semi").select("digest")
            return _sets(rows, size, written(wanted, "wanted")).repartition("s").dropDuplicates(["s", "name"])  # dealt as the joins need them

        hubs = written(members.groupBy("hub").agg(F.count("*").alias("total")).where(F.col("total") > TILE), "large")
        whole = members.select("hub", *(F.lit(0).alias(c) for c in (*TASK[1:], "side")), "sig")
        if hubs.isEmpty():
            tasks, edges = whole, None
        else:
            roles, edges = _roles(members, hubs, points, sets_of, num, den)
            few = F.broadcast(hubs) if hubs.count() <= BROADCAST_ROWS else hubs
            tasks = whole.join(few, "hub", "left_anti").unionByName(_tiled(roles, num, den))
        groups = _merged(written(_survivors(tasks.join(points, F.col("sig") == F.col("s")), num, den), "groups"))
        found = _edges(groups.join(sets_of(groups.select("sig")), F.col("sig") == F.col("s")), num, den)
        found = components(found if edges is None else found.unionByName(edges))
        labels = read.select("id", "digest", "n", "name").join(found, F.col("name") == F.col("node"), "left")
        labels = written(labels.select("id", "digest", "n", F.coalesce("root", "name").alias("label")), "labels")
        first = written(
            labels.where(F.col("label").isNotNull()).groupBy(F.col("label").alias("l")).agg(F.min("id").alias("first")),
            "firsts",
        )
        kept += [labels, first]
    out = labels.join(first, F.col("label") == F.col("l"), "left")
    return out.select(
        F.col("id").alias(id_col), "digest", F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("first")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id."""
    with scratch(docs.sparkSession) as kept:
        gone = joined(docs, size, num, den, id_col, text_col).where(~F.col(id_col).eqNullSafe(F.col("component_id")))
        gone = written(gone.select(F.col(id_col).alias("gone_id"), F.col("digest").alias("gone_digest")).distinct(), "gone")
        kept.append(gone)
    (d,) = fresh(docs, "digest")
    return semi(
        docs.withColumn(d, F.xxhash64(text_col)), gone, [(id_col, "gone_id"), (d, "gone_digest")], "left_anti",
    ).select(*docs.columns)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).drop("digest")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
  FROM d
), n AS (SELECT doc_id, len(g) AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
b AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id
), l AS (
  SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n JOIN (SELECT a, min(b) AS component_id
  FROM r GROUP BY a) c ON c.a = n.doc_id
"""
