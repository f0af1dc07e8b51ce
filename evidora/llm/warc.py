"""WARC archives with an external, merged capture index.

Writing: one record per page, payload the html in UTF-8. Of records with equal payloads of at least
``min_revisit`` bytes the one with the largest id is a response and the others are revisits, which carry
headers only, so a payload is stored once however often it was captured. Records are made of string
functions and written by Spark's text writer with CRLF CRLF between records, which makes each file an
archive in WARC/1.1 form.

Reading: whole archives by Spark's binary reader (any store), cut by Content-Length, never by
searching for marks that a payload could hold. A task merges its archives' captures into runs sorted
by URL key and timestamp, which are stored. Runs are then cut into blocks at the bounds of key ranges, and
blocks are dealt to their range in the order of their first keys. That is the order in which an
external merge needs them: a loser tree gives all rows up to a block's first key before the block is opened, so
that a task holds one open block a run at most, however many rows its range has. Ranges
follow each other, so the index is globally ordered. record_offset and record_length are a record's place in
its unpacked archive.

Archives hold about ``archive_bytes`` of html each, so reading one fits a worker. Null html is an
empty payload, a null url an empty target, a null id stays null. Equal ids are kept (ties in the choice
of the response go to one id; all rows with that id are responses). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm.shared import scratch_path, written
from evidora.session import table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, urlkey string, captured string, run string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_offset long, record_length long"
#: Ids give dates by what is left of division by this, so that any id gives a year of four digits.
DATES = 1 << 32
BLOCKS = "range int, page_id long, urlkey string, captured string, block binary"


def url_key(url: str) -> str:
    """Host parts from the last to the first, then path and query, lower case: captures of a site and
    of a page sort together."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_revisit: int) -> tuple[DataFrame, DataFrame]:
    """The pages as (id, url, html, size, digest), and (digest, response) of payloads found twice
    or more, response the id of the record that keeps them."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html"), "digest": F.sha1(F.col("html").cast("binary"))})
    # digests only: the html itself isn't shuffled for this
    several = rows.filter(F.col("size") >= min_revisit).groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).filter("n > 1").select("digest", "response")
    return rows, several


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 1000, archive_bytes: int = 32 << 20) -> None:
    """Write all pages as archives below ``path``."""
    rows, several = revisits(pages, id_col, url_col, html_col, min_revisit)
    total = rows.agg(F.sum("size")).first()[0] or 0
    # fewer partitions than Spark's own number would make the join shuffle the html again
    archives = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // archive_bytes))
    key = F.concat_ws(":", "id", "digest").alias("key")
    marks = rows.select("id", "digest", key).join(several, "digest").filter("response <> id").select("key", "response").distinct()
    # the html is dealt to archives once, by the key on which the marks are joined
    joined = rows.select("*", key).repartition(archives, "key").join(marks.repartition(archives, "key"), "key", "left").withColumn("revisit", F.col("response").isNotNull())
    eol = F.lit("\r\n")
    record = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    date = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(F.coalesce(F.col("id"), F.lit(0)), F.lit(DATES))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    refers = F.when(F.col("revisit"), F.concat(F.lit("WARC-Profile: " + PROFILE), eol, F.lit("WARC-Refers-To: <urn:page:"), F.col("response").cast("string"), F.lit(">\r\n"))).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"), eol,
        F.lit("WARC-Record-ID: <urn:page:"), record, F.lit(">\r\n"),
        F.lit("WARC-Date: "), date, eol,
        F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", ""), eol,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), eol, refers,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"),
    )
    made = joined.select("id", "url", "size", "digest", "response", "revisit", block.alias("block"))
    lines = made.select(F.concat(head, "block").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record of one archive."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, archive[end + 4 : end + 4 + size], at, end + 4 + size - at
        at = end + 4 + size + 4


def page_of(record: str) -> int | None:
    name = record.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def read_run(name: str, archive: bytes) -> list[tuple]:
    """The captures of an archive, sorted by URL key, timestamp and id: rows of INDEX. The digest
    and size of a response are those of the payload as read; a mismatch is an error."""
    run = []
    for headers, block, at, length in parse(archive):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if headers["WARC-Type"] == "response":
            read = hashlib.sha1(payload).hexdigest()
            if (len(payload), read) != (size, digest):
                raise ValueError(f"payload of {headers['WARC-Record-ID']} in {name} is damaged")
        refers = page_of(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None
        run.append((page_of(headers["WARC-Record-ID"]), url_key(headers["WARC-Target-URI"]), headers["WARC-Date"], name, size, digest, headers["WARC-Type"], refers, at, length))
    return sorted(run, key=order)


def order(row: tuple) -> tuple:
    return row[1], row[2], row[0] is not None, row[0] or 0


class LoserTree:
    """Merges k sorted runs with about log2(k) comparisons a row: an inner node holds the loser of
    its match, the winner goes up. Of each run one row is read ahead. Runs may be added on the way."""

    def __init__(self, runs: Iterable[Iterable], key: Callable = order):
        self.key = key
        self.rows, self.heads, self.keys = [], [], []
        for run in runs:
            self._cursor(run)
        self._build()

    def _cursor(self, run: Iterable) -> None:
        rows = iter(run)
        for head in rows:
            self.rows.append(rows)
            self.heads.append(head)
            self.keys.append(self.key(head))
            break

    def _build(self) -> None:
        self.k = len(self.keys)
        self.tree = [-1] * max(1, self.k)
        for run in range(self.k):
            self._play(run)

    def add(self, run: Iterable) -> None:
        """One more run; those that ended make room."""
        live = [i for i, key in enumerate(self.keys) if key is not None]
        self.rows, self.heads, self.keys = ([x[i] for i in live] for x in (self.rows, self.heads, self.keys))
        self._cursor(run)
        self._build()

    def _less(self, a: int, b: int) -> bool:
        """An ended run (None) loses against any other; ties go to the earlier run."""
        x, y = self.keys[a], self.keys[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:  # while building: wait here for the other side
                self.tree[node] = run
                return
            if self._less(self.tree[node], run):
                run, self.tree[node] = self.tree[node], run
            node //= 2
        self.tree[0] = run

    def upto(self, limit: tuple | None = None) -> Iterator:
        """The next rows in order, those with keys beyond ``limit`` left."""
        while self.k and (least := self.keys[run := self.tree[0]]) is not None and (limit is None or least <= limit):
            yield self.heads[run]
            for head in self.rows[run]:
                self.heads[run], self.keys[run] = head, self.key(head)
                break
            else:
                self.heads[run] = self.keys[run] = None
            self._play(run)

    def __iter__(self) -> Iterator:
        return self.upto()


_FIELDS = [("page_id", pa.int64()), ("urlkey", pa.string()), ("captured", pa.string()), ("run", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_offset", pa.int64()), ("record_length", pa.int64())]


def _batches(rows: Iterator[tuple], most: int = 8192) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def sorted_runs(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Archives (path, content) to rows of INDEX: runs of about ``most`` rows, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        held: list[list[tuple]] = []
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                held.append(read_run(name.as_py().rpartition("/")[2], gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                if sum(map(len, held)) >= most:
                    yield from _batches(iter(LoserTree(held)))
                    held = []
        yield from _batches(iter(LoserTree(held)))

    return run


def cut(bounds: list[tuple], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of stored runs to BLOCKS: sorted rows of one range, ``most`` or fewer, with the first one's key. A
    key below the one before it begins another run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema(_FIELDS)
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([c.cast(t) for c, (_, t) in zip(batch.columns, _FIELDS, strict=True)], schema=kinds)
            rows = list(zip(*(c.to_pylist() for c in whole.columns[:3]), strict=True))
            keys = [order(r) for r in rows]
            ranges = [bisect_right(bounds, k) for k in keys]
            starts: list[int] = []
            for i in range(len(rows)):
                if not starts or i - starts[-1] == most or ranges[i] != ranges[i - 1] or keys[i] < keys[i - 1]:
                    starts.append(i)
            blocks = [whole.slice(lo, hi - lo).serialize().to_pybytes() for lo, hi in zip(starts, [*starts[1:], len(rows)], strict=True)]
            first = [[rows[i][k] for i in starts] for k in range(3)]
            columns = [pa.array([ranges[i] for i in starts], pa.int32()), *(pa.array(c, t) for c, (_, t) in zip(first, _FIELDS, strict=False)), pa.array(blocks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "page_id", "urlkey", "captured", "block"])

    return run


def block_rows(block: bytes, step: int = 256) -> Iterator[tuple]:
    """The rows of a block, ``step`` of them unpacked at a time."""
    batch = pa.ipc.read_record_batch(pa.py_buffer(block), pa.schema(_FIELDS))
    for lo in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(lo, step).columns), strict=True)


def merged(blocks: Iterator[tuple[tuple, Iterable[tuple]]]) -> Iterator[tuple]:
    """All rows of blocks (first key, rows) in order, where blocks come in the order of their first keys."""
    tree = LoserTree([])
    for first, rows in blocks:
        yield from tree.upto(first)
        tree.add(rows)
    yield from tree


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def blocks() -> Iterator[tuple[tuple, Iterable[tuple]]]:
        for batch in batches:
            for *key, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield order(tuple(key)), block_rows(block)

    yield from _batches(merged(blocks()))


def range_bounds(runs: DataFrame, rows: int, ranges: int, each: int = 32) -> list[tuple]:
    """Keys that part the runs into about equal ranges, by a sample of about ``each`` keys a range. They only
    balance the ranges; results do not depend on them."""
    key = ["page_id", "urlkey", "captured"]
    sample = runs.select(*key).filter(F.pmod(F.xxhash64(*key), F.lit(max(1, rows // (ranges * each)))) == 0)
    keys = sorted(order(tuple(r)) for r in sample.collect())
    return sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []


def read_index(spark: SparkSession, path: str, run_rows: int = 200_000, range_rows: int = 500_000, block: int = 1024) -> DataFrame:
    """All captures below ``path``, columns of INDEX, globally ordered by URL key, timestamp and id:
    partitions are key ranges in order, each merged from its blocks of the runs."""
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = written(archives.mapInArrow(sorted_runs(run_rows), INDEX), "warc-runs")
    rows = runs.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // range_rows))
    blocks = runs.mapInArrow(cut(range_bounds(runs, rows, ranges), block), BLOCKS)
    dealt = blocks.repartitionById(ranges, F.col("range")).sortWithinPartitions("urlkey", "captured", "page_id")
    return dealt.select("page_id", "urlkey", "captured", "block").mapInArrow(_merge, INDEX)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS m FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND m <> page_id THEN m END AS refers_to
FROM g"""
}

QUERIES = {"op2_warc": op2_warc}
