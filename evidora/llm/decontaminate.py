"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A window is
``width`` consecutive words of an item; an item of fewer words, but not none, is one window. The
automaton holds all distinct windows as ' w1 w2 ... ' and reads each normalised text once; a
hit's place is mapped to words, and words to offsets in the original text.

The automaton is built in each worker from the windows, which are sent to it: ``block_windows`` distinct ones at most
(50,000 windows of ten words take about 160 MB there). A benchmark with more takes a pass over the texts for each
block of windows, one after another: a pass writes its hits to the shared folder before the next one
starts, so that a worker never holds more than one block and the driver two, however large the benchmark is.

Null and empty texts have no words, no hits and are clean; an empty benchmark leaves all clean. Items
with a null id are searched for, but cannot be named. Repeated rows and ids stay; other columns
are ignored by ``find_hits`` and kept by ``remove_contaminated``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm.shared import bitmap, giving_back, perhaps, written
from evidora.session import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLOCK = 50_000
HITS = "array<struct<item:long,a:int,b:int>>"
SPANS = "array<struct<item_id:long,start:int,end:int>>"
SCHEMA = f"id long, n_words long, n_hit long, items array<long>, spans {SPANS}"


def normalise(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER) if not (text or "").isascii() else (text or "").lower())


Windows = dict[str, set[int]]


def windows(items: Iterable[tuple[int | None, str | None]], width: int, most: int | None = None) -> Iterator[Windows]:
    """The distinct windows, with a space before and after each word, and the items that have them, ``most`` at a time; at
    least one block, which may be empty. A window met again in a later block is found by both."""
    found: Windows = {}
    for item, text in items:
        words = normalise(text)
        for at in range(max(1, len(words) - width + 1) if words else 0):
            if most is not None and len(found) == most:
                yield found
                found = {}
            found.setdefault(f" {' '.join(words[at : at + width])} ", set()).update([] if item is None else [item])
    yield found


class Scanner:
    """The automaton, built once in each Python worker."""

    _built: dict[str, Scanner] = {}

    def __init__(self, patterns: dict[str, set[int]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for pattern, items in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), pattern.count(" ") - 1, items))
        if patterns:
            self.automaton.make_automaton()
        self.any = bool(patterns)

    @classmethod
    def of(cls, patterns: dict[str, set[int]], key: str) -> Scanner:
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(patterns)
        return cls._built[key]

    def scan(self, words: list[str]) -> list[tuple[int, int, set[int]]]:
        """(first word, word after the last, items) of each occurrence of a window."""
        if not self.any or not words:
            return []
        text = f" {' '.join(words)} "
        hits = list(self.automaton.iter(text))
        if not hits:
            return []
        starts, at = [], 0
        for word in words:
            starts.append(at)
            at += len(word) + 1
        first = [bisect_right(starts, end - length + 1) - 1 for end, (length, _, _) in hits]
        return [(a, a + n, items) for a, (_, (_, n, items)) in zip(first, hits, strict=True)]


def covered(spans: list[tuple[int, int]]) -> int:
    """How many places lie in any of the spans."""
    n = end = 0
    for a, b in sorted(spans):
        n += max(0, b - max(a, end))
        end = max(end, b)
    return n


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, most: int) -> Iterator[Windows]:
    """The windows of all items, ``most`` at a time; the driver reads one partition of items at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return windows(((r.i, r.t) for r in rows.toLocalIterator()), width, most)


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10, block_windows: int = BLOCK) -> DataFrame:
    """One row per row of docs: (id, n_words, n_hit, items, spans), spans in code points of the
    original text, end exclusive, adjoining windows of an item merged."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text).alias("r1"), F.xxhash64(F.lit(1), id_col, text).alias("r2"), text.alias("text"))
    blocks = benchmark_blocks(benchmark, item_col, item_text, width, block_windows)
    block, after = next(blocks), next(blocks, None)
    if after is None:  # one pass gives the result
        return rows.select("id", "text", F.lit(None).cast(HITS).alias("hits")).mapInArrow(_result(block), SCHEMA)
    found = None
    while block is not None:
        own = written(rows.select("r1", "r2", "text").mapInArrow(_hits(block), f"r1 long, r2 long, hits {HITS}"), "hits")
        found = own if found is None else found.union(own)
        block, after = after, next(blocks, None)
    hits = written(found.groupBy("r1", "r2").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits")), "hits")
    dealt = perhaps(rows, bitmap(hits, "r1"), "r1")
    rest = dealt.filter("NOT perhaps").select("id", "text", F.lit(None).cast(HITS).alias("hits"))
    every = rest.union(dealt.filter("perhaps").join(hits, ["r1", "r2"], "left").select("id", "text", "hits"))
    return every.mapInArrow(_result({}), SCHEMA)


_HITS = pa.list_(pa.struct([("item", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))
_SPANS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))


def _key(patterns: Windows) -> str:
    return hashlib.sha256(repr(sorted((k, sorted(v)) for k, v in patterns.items())).encode()).hexdigest()


def _found(scanner: Scanner, words: list[str]) -> list[dict]:
    return [{"item": i, "a": a, "b": b} for a, b, items in scanner.scan(words) for i in sorted(items) or [None]]


def _hits(patterns: Windows):
    """(r1, r2, hits) of the rows in which a window occurs."""
    key = _key(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.of(patterns, key)
        for batch in batches:
            out = [_found(scanner, normalise(x.as_py())) for x in batch.column(2)]
            some = pa.array([bool(x) for x in out], pa.bool_())
            columns = [*batch.columns[:2], pa.array(out, _HITS)]
            yield pa.RecordBatch.from_arrays([c.filter(some) for c in columns], names=["r1", "r2", "hits"])

    return giving_back(run)


def _result(patterns: Windows):
    """The columns of SCHEMA, from the hits of ``patterns`` and those of earlier passes."""
    key = _key(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.of(patterns, key)
        for batch in batches:
            out = []
            for value, before in zip(batch.column(1), batch.column(2), strict=True):
                text = value.as_py() or ""
                words = normalise(text)
                out.append(_summary(text, len(words), (before.as_py() or []) + _found(scanner, words)))
            columns = zip(*out, strict=True) if out else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), _SPANS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "n_words", "n_hit", "items", "spans"])

    return giving_back(run)


def _summary(text: str, n_words: int, hits: list[dict]) -> tuple[int, int, list[int], list[dict]]:
    """(words, words hit, items, spans in the text)."""
    if not hits:
        return n_words, 0, [], []
    at = [m.span() for m in WORD.finditer(text.translate(UPPER))]
    merged: dict[int | None, list[list[int]]] = {}
    for h in sorted(hits, key=lambda h: h["a"]):
        own = merged.setdefault(h["item"], [])
        if own and h["a"] <= own[-1][1]:
            own[-1][1] = max(own[-1][1], h["b"])
        else:
            own.append([h["a"], h["b"]])
    spans = [{"item_id": i, "start": at[a][0], "end": at[b - 1][1]} for i in merged for a, b in merged[i]]
    return n_words, covered([(h["a"], h["b"]) for h in hits]), sorted(i for i in merged if i is not None), spans


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 10, block_windows: int = BLOCK) -> DataFrame:
    """The rows of docs in whose text no window occurs, with all their columns, without a shuffle. What a block of windows
    leaves is written before the next block."""
    from pyspark.sql import types as T

    kept = docs.select([F.col(f"`{f.name}`") for f in docs.schema])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    at = docs.columns.index(text_col)

    def clean(patterns: Windows):
        key = f"keep {_key(patterns)}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner.of(patterns, key)
            for batch in batches:
                yield batch.filter(pa.array([not scanner.scan(normalise(x.as_py())) for x in batch.column(at)], pa.bool_()))

        return giving_back(run)

    blocks = benchmark_blocks(benchmark, "item_id", "text", width, block_windows)
    block = next(blocks)
    while (after := next(blocks, None)) is not None:
        kept, block = written(kept.mapInArrow(clean(block), schema), "clean"), after
    return kept.mapInArrow(clean(block), schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op6_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""
}

QUERIES = {"op6_decontaminate": op6_decontaminate}
