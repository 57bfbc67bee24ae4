"""WARC (2): archives with revisit records, and an external merge of their capture index.

Writing. Pages with equal payloads of at least MIN_REVISIT bytes are stored once: the one with the smallest
id is a response record, the others are revisit records that name it. Rows whose digest surely occurs once (a
two-plane Bloom filter, see ``repeats``) go to the writer where they are read; only the others meet by digest.
Archives are written by Spark's text writer, whose line separator is set to a record's closing bytes,
so the files are plain WARC 1.1 on any file system Spark can write to, and a task that is lost is simply
run again. Pages of like size are written together, so that an archive has at most ARCHIVE_BYTES of payload
unless a single record has more.

Reading. Each archive is parsed by the lengths its records state (payloads may hold any bytes), the payload's
digest is computed anew, and the captures are sorted by (URL key, timestamp, id, place): a sorted run for each
archive, written in blocks. Heads of blocks, taken at regular places of the runs, give the boundaries of ranges; blocks
are cut there, and each range merges what it has of the k runs with a loser tree. A range's blocks come to it
in the order of their first keys, so it opens a block only when the merge has come to it, and holds at most one
block of each run; captures are sorted nowhere but in their run. Hot URLs are split by time and id. The result is
the globally ordered capture history, by partition and within each.

Edge cases: a null payload is empty; null ids order last and only count as smallest where a group has no
other; rows that repeat the smallest id of their group are all responses; null URLs become
``urn:page:<id>``; white space and control characters in URLs are percent-encoded in the archives; an empty
table gives no archives and an empty history; extra columns are passed over. Timestamps come from ``time_col``
or, without one or where it is null, from the id, one second each from EPOCH on.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice, pairwise
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import scratch, shared_dir, table, written
from tallyspark.llm.repeats import may_repeat, repeat_filter

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
#: Pages up to each size share archives; larger ones have one each.
SIZE_CLASSES = (16 << 10, 128 << 10, 1 << 20, 8 << 20)
BLOCK_ROWS = 512
ROWS_PER_RANGE = 50_000
#: At most so many ranges, each with so many heads to choose its boundary from: what the driver collects is bounded.
MAX_RANGES, HEADS = 2_000, 32
EPOCH = 1_704_067_200
END = "\r\n\r\n"
HISTORY = (
    "url_key string, timestamp string, page_id {id}, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to {id}, archive string, offset long, length long"
)
#: What captures are ordered by; null ids come last.
KEY = ("url_key", "timestamp", "none", "page", "archive", "offset")
KEY_TYPES = "url_key string, timestamp string, none boolean, page {id}, archive string, offset long"


def _shared_payloads(pages: DataFrame):
    """The largest size, the filter of repeated digests and the smallest id of each digest that is repeated."""
    small = pages.select("id", "digest", "size", F.xxhash64("digest").alias("h"))
    small = written(small.where(F.col("size") >= MIN_REVISIT), "digests")
    sent = pages.sparkSession.sparkContext.broadcast(repeat_filter(small.select("h"), small.count()))
    maybe = small.where(may_repeat(sent, F.col("h")))
    first = maybe.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"), F.count("*").alias("n"),
    ).where("n > 1")
    largest = small.agg(F.max("size")).first()[0] or 0
    return largest, sent, written(first.select(F.col("digest").alias("first_digest"), F.col("first.id").alias("first_id")), "firsts")


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None,
) -> str:
    """Write all pages as WARC files into the shared folder; returns their folder."""
    payload, ident = F.coalesce(F.col(html_col), F.lit("")), F.col(id_col)
    numeric = F.coalesce(ident.try_cast("long"), F.lit(0))
    at = F.timestamp_seconds(F.lit(EPOCH) + F.pmod(numeric, F.lit(10**9)))
    if time_col:
        at = F.coalesce(F.col(time_col).try_cast("timestamp"), at)
    rows = pages.select(
        ident.alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("digest"), at.alias("at"),
    )
    with scratch(pages.sparkSession):
        largest, sent, first = _shared_payloads(rows)
        maybe = (F.col("size") >= MIN_REVISIT) & may_repeat(sent, F.xxhash64("digest"))
        none = F.lit(None).cast(rows.schema["id"].dataType)
        alone = rows.where(~maybe).withColumn("first_id", none).withColumn("again", F.lit(False))
        met = rows.where(maybe).join(first, F.col("digest") == F.col("first_digest"), "left").withColumn(
            "again", F.col("first_digest").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")),
        ).drop("first_digest")
        path = f"{shared_dir(pages.sparkSession)}/tally/warc-{uuid.uuid4().hex}"
        records = alone.unionByName(met)
        for low, high in zip((-1, *SIZE_CLASSES), (*SIZE_CLASSES, None), strict=True):
            if low < largest:
                some = records.where(
                    (F.col("size") > low) & (F.col("size") <= high if high else F.lit(True))
                ).select(_record().alias("value"))
                most = max(1, ARCHIVE_BYTES // high) if high else 1
                some.write.option("lineSep", END).option("maxRecordsPerFile", most).text(f"{path}/over-{low + 1}")
    return path


def _record():
    """The record of a row without its closing bytes."""
    name = lambda i: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws(" ", i.cast("string"), F.col("digest"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    ident = F.coalesce(F.col("id").cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), ident)), r"[\x00-\x20\x7F]", "%20")
    body = F.when(F.col("again"), F.lit("")).otherwise(F.col("payload"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"),
        F.lit(END),
    )
    refers = F.concat(
        F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
        name(F.col("first_id")), F.lit("\r\nX-Refers-To-Page: "), F.coalesce(F.col("first_id").cast("string"), F.lit("")),
    )
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")), F.lit("\r\nX-Page: "), ident,
        F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: "), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.when(F.col("again"), refers).otherwise(""),
        F.lit(
            "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "
        ), (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(END), http, body,
    )


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, without scheme, port 80/443, leading www and fragment."""
    try:
        u = urlsplit(url)
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    port = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{port}){quote(u.path or '/', safe='/%:@!$&()*+,;=~-._').lower()}{'?' + u.query if u.query else ''}"


def parsed(content: memoryview) -> Iterator[tuple]:
    """Records of one archive: headers, offset, length, block; blocks are views, not copies."""
    at = 0
    while at < len(content):
        head, start = _head(content, at)
        if not head.startswith(b"WARC/1."):
            raise ValueError(f"no record starts at byte {at}")
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
        end = start + int(fields["Content-Length"])
        yield fields, at, end + 4 - at, content[start:end]
        at = end + 4


def _head(content: memoryview, at: int) -> tuple[bytes, int]:
    """The header block that starts at a place, and where what follows it starts."""
    size = 1024
    while True:
        some = bytes(content[at : at + size])
        end = some.find(b"\r\n\r\n")
        if end >= 0:
            return some[:end], at + end + 4
        if at + size >= len(content):
            raise ValueError(f"the headers at byte {at} have no end")
        size *= 4


def run_of(name: str, content: memoryview, number) -> list[tuple]:
    """The sorted run of one archive."""
    out = []
    for f, at, length, block in parsed(content):
        http, start = _head(block, 0)
        again = f["WARC-Type"] == "revisit"
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        payload, stated = block[start:], f["WARC-Payload-Digest"].removeprefix("sha256:")
        if not again and (len(payload) != size or hashlib.sha256(payload).hexdigest() != stated):
            raise ValueError(f"{name}, byte {at}: the payload does not match its digest")
        page, first = number(f.get("X-Page", "")), number(f.get("X-Refers-To-Page", "")) if again else None
        url = f["WARC-Target-URI"]
        out.append((url_key(url), f["WARC-Date"], page, url, f["WARC-Type"], size, stated, first, name, at, length))
    return sorted(out, key=_key)


def _key(row: tuple) -> tuple:
    """The values of KEY: an absent id has a place of its own behind all others."""
    return row[0], row[1], row[2] is None, ("" if isinstance(row[2], str) else 0) if row[2] is None else row[2], row[8], row[9]


class Cursor:
    """A place in a sorted block."""

    def __init__(self, rows: list[tuple], key):
        self.rows, self.of, self.at, self.key = rows, key, 0, key(rows[0])

    def step(self) -> None:
        self.at += 1
        key = self.of(self.rows[self.at]) if self.at < len(self.rows) else None
        if key is not None and key < self.key:
            raise ValueError(f"a run is not sorted: {key} follows {self.key}")
        self.key = key


class LoserTree:
    """Merges k sorted blocks: each inner node keeps the loser of its match, so the next row costs log2(k) comparisons."""

    def __init__(self, cursors: list[Cursor]):
        self.cursors, self.k = cursors, len(cursors)
        self.tree = [-1] * max(1, self.k)
        for j in range(self.k):
            self._play(j)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.cursors[a].key, self.cursors[b].key
        return y is None if x is not None and y is None else x is not None and (x, a) < (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) >> 1
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node >>= 1
        self.tree[0] = winner

    def until(self, limit: tuple | None) -> Iterator[tuple]:
        """Rows in order, as long as their keys are below the limit."""
        while (key := (best := self.cursors[self.tree[0]]).key) is not None and (limit is None or key < limit):
            yield best.rows[best.at]
            best.step()
            self._play(self.tree[0])


def merged(blocks: Iterator[list[tuple]], key=_key) -> Iterator[tuple]:
    """All rows of sorted blocks in order; the blocks come by their first keys and are open only while they are met."""
    coming, active = next(blocks, None), []
    while coming is not None or active:
        limit = key(coming[0]) if coming is not None else None
        if active:
            yield from LoserTree(active).until(limit)
            active = [c for c in active if c.key is not None]
        while coming is not None and key(coming[0]) == limit:
            active.append(Cursor(coming, key))
            coming = next(blocks, None)


def capture_history(
    spark: SparkSession, folder: str, id_type: str = "bigint", rows_per_range: int = ROWS_PER_RANGE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All captures of the archives in ``folder``, ordered by URL key, timestamp and id across partitions."""
    whole = id_type in ("bigint", "int", "smallint", "tinyint")
    kind = "bigint" if whole else "string"
    schema, key_types = HISTORY.format(id=kind), KEY_TYPES.format(id=kind)
    fields = [x.strip().split()[0] for x in schema.split(",")]
    packed = f"{key_types}, seq int, n int, rows array<struct<{schema.replace(' ', ':').replace(',:', ', ')}>>"

    def number(text: str):
        return None if text == "" else int(text) if whole else text

    def blocks_of(rows: list[tuple]) -> list[list[tuple]]:
        return [rows[k : k + block_rows] for k in range(0, len(rows), block_rows)]

    def as_batch(blocks: list[list[tuple]], extra: dict[str, list]) -> pa.RecordBatch:
        keys = dict(zip(KEY, zip(*(_key(b[0]) for b in blocks), strict=True), strict=True))
        ends = pa.array(np.concatenate([[0], np.cumsum([len(b) for b in blocks])]), pa.int32())
        flat = _batch([r for b in blocks for r in b], fields, whole)
        cells = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat.columns, fields))
        kinds = {"page": pa.int64() if whole else pa.string(), "offset": pa.int64(), "none": pa.bool_()}
        columns = [pa.array(keys[k], kinds.get(k, pa.string())) for k in KEY] + [pa.array(v, pa.int32()) for v in extra.values()]
        return pa.RecordBatch.from_arrays([*columns, cells], [*KEY, *extra, "rows"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            cells = batch.column(batch.schema.get_field_index("rows"))
            for k in range(batch.num_rows):
                yield list(zip(*(c.to_pylist() for c in cells[k].values.flatten()), strict=True))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                run = blocks_of(run_of(path.as_py().rsplit("/", 1)[-1], memoryview(content.as_buffer()), number))
                if run:
                    yield as_batch(run, {"seq": list(range(len(run))), "n": [len(b) for b in run]})

    with scratch(spark) as kept:
        archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
        runs = written(archives.mapInArrow(read, packed), "runs")
        total, blocks = runs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        n = int(min(MAX_RANGES, max(1, -(-total // rows_per_range))))
        step = max(1, blocks // (n * HEADS))
        heads = runs.where(F.pmod(F.col("seq") + F.xxhash64("archive"), F.lit(step)) == 0) if n > 1 else runs.limit(0)
        heads = sorted(map(tuple, heads.select(*KEY).collect()))
        bounds = [heads[k * len(heads) // n] for k in range(1, n) if heads]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in opened(batches):
                ranges = [bisect_right(bounds, _key(r)) for r in rows]
                edges = [0, *(k for k in range(1, len(rows)) if ranges[k] != ranges[k - 1]), len(rows)]
                yield as_batch([rows[a:b] for a, b in pairwise(edges)], {"range": [ranges[a] for a in edges[:-1]]})

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = merged(opened(batches))
            while some := list(islice(rows, 10_000)):
                yield _batch(some, fields, whole)

        dealt = written(runs.drop("n", "seq").mapInArrow(cut, packed.replace("seq int, n int", "range int")), "cut_runs")
        kept.append(dealt)
    return dealt.repartitionByRange(n, "range").sortWithinPartitions("range", *KEY).mapInArrow(merge, schema)


def _batch(rows: list[tuple], fields: list[str], whole: bool) -> pa.RecordBatch:
    numbers = {"payload_bytes", "offset", "length", *(("page_id", "refers_to") if whole else ())}
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64() if f in numbers else pa.string()) for c, f in zip(columns, fields, strict=True)], fields,
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    history = capture_history(spark, write_archives(pages), pages.schema["page_id"].dataType.simpleString())
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE
  WHEN first <> page_id THEN first END AS refers_to FROM f
"""
