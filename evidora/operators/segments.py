"""A stored BM25 index of immutable segments, updated in part.

A segment holds the postings of its documents in blocks: up to ``BLOCK`` postings of one term, documents ascending, as gaps, term counts and
document lengths, in files that are dealt and sorted by term, so that a reader's filter on terms skips row groups. Beside them it holds its
documents (ord, two hashes of the text, length). A hot term lies in several partitions and files, as (term, ord) are dealt by ranges.

An update compares the hashes of a snapshot with those of the live documents, without their texts. New and changed texts become a delta segment, and only
those are tokenised, and counted where they lie; documents that are gone or changed get tombstones in the segment that holds them. ``fanout`` segments of a tier (documents in powers of
``fanout``) are merged into one, without what is dead, so that a document is rewritten a logarithmic number of times. The manifest is written last: readers
see the state before or after an update, also if it fails on the way. Two writers at a time are not supported. ``vacuum`` deletes what the manifest no longer names.

Documents are (ord, text), each ord once; a null ord is left out. Searching gives what ``retrieve.bm25`` gives over the live documents.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.config import Retrieval
from evidora.functions import text as T
from evidora.operators import index, retrieve

BLOCK = 128
FILE_POSTINGS = 1 << 21  # postings a file, about
SAMPLE_DOCS, SAMPLE = 4096, 256  # documents, and postings a file, that show where to cut
PORTION = 1 << 22  # tokens that are counted together
STEP = BLOCK << 11  # postings that are cut into blocks at a time
HASHES = ["h1", "h2"]
BLOCKS = "term string, first long, last long, n int, gaps array<long>, tfs array<int>, lens array<int>"
DOCS = "ord long, h1 long, h2 long, doc_len int"
TOMBS = "segment string, ord long"
RUNS = "part int, terms array<string>, sizes binary, ords binary, tfs binary, lens binary"
RUN_SCHEMA = pa.schema([("part", pa.int32()), ("terms", pa.list_(pa.string())), *((x, pa.binary()) for x in ("sizes", "ords", "tfs", "lens"))])
MANIFEST = "turn int, kind string, name string, docs long, postings long"


@dataclass(frozen=True)
class Segment:
    name: str
    docs: int
    postings: int


def hashed(docs: DataFrame) -> DataFrame:
    """(ord, text, h1, h2); the hash tells a null from an empty text."""
    own = [F.col("text").isNull(), "text"]
    return docs.filter("ord IS NOT NULL").select(F.col("ord").cast("long").alias("ord"), "text", F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(1), *own).alias("h2"))


def _cut(rows: pa.Table, whole: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
    """The blocks of sorted rows (term, ord, tf, doc_len); unless ``whole``, without the last term's end, as more of it may be to come."""
    term = rows.column("term").combine_chunks()
    codes = np.asarray(term.dictionary_encode().indices if not isinstance(term, pa.ChunkedArray) else term.combine_chunks().dictionary_encode().indices)
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    end = len(codes) if whole else starts[-1] + (len(codes) - starts[-1]) // BLOCK * BLOCK
    rest = rows.slice(end) if end < len(codes) else None
    sizes = np.diff(np.append(starts[starts < end], end))
    lo = np.concatenate([np.arange(s, s + n, BLOCK) for s, n in zip(starts, sizes, strict=False)]) if len(sizes) else np.zeros(0, np.int64)
    ends = np.append(lo[1:], end).astype(np.int64) if len(lo) else lo
    docs = rows.column("ord").to_numpy()[:end]
    gaps = np.diff(docs, prepend=0)
    gaps[lo] = 0
    offsets = pa.array(np.append(lo, end).astype(np.int32) if len(lo) else np.zeros(1, np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (gaps, rows.column("tf").to_numpy()[:end].astype(np.int32), rows.column("doc_len").to_numpy()[:end].astype(np.int32))]
    own = [rows.column("term").take(pa.array(lo)).combine_chunks(), pa.array(docs[lo]), pa.array(docs[ends - 1]), pa.array((ends - lo).astype(np.int32)), *lists]
    return pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in own], names=["term", "first", "last", "n", "gaps", "tfs", "lens"]), rest


def packed(postings: DataFrame, files: int) -> DataFrame:
    """Rows of BLOCKS from (term, ord, tf, doc_len)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            made, held = _cut(rows, False)
            yield made
        if held is not None:
            yield _cut(held, True)[0]

    rows = postings.select("term", "ord", F.col("tf").cast("int").alias("tf"), F.col("doc_len").cast("int").alias("doc_len"))
    return rows.repartitionByRange(files, "term", "ord").sortWithinPartitions("term", "ord").mapInArrow(run, BLOCKS)


def bounds(tokens: DataFrame, files: int, n: int, size: int) -> list[tuple[str, int]]:
    """Where to cut the postings of ``n`` documents of ``size`` tokens into ``files`` ranges of (term, ord) of about one size: quantiles of
    some hundred postings a range, of some thousand documents. They decide where a posting lies, not which there are."""
    if files < 2:
        return []
    every = max(1, n // SAMPLE_DOCS)
    some = tokens.filter(F.pmod(F.xxhash64("ord"), F.lit(every)) == 0)
    thin = max(1, size // every // (SAMPLE * files))
    found = some.select("ord", F.explode(F.array_distinct("own")).alias("term")).filter(F.pmod(F.xxhash64("term", "ord"), F.lit(thin)) == 0)
    held = sorted((r.term, r.ord) for r in found.collect())
    return [held[len(held) * k // files] for k in range(1, files)] if held else []


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of documents cut after about ``PORTION`` tokens."""
    for batch in batches:
        starts = np.flatnonzero(np.diff(np.cumsum(batch.column("doc_len").to_numpy().astype(np.int64)) // PORTION, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)


def inverted(tokens: DataFrame, cuts: list[tuple[str, int]]) -> DataFrame:
    """Rows of BLOCKS from (ord, own, doc_len), each ord once. A task counts the tokens of many documents at a time and gives one row for
    each range of (term, ord) between ``cuts``, so that neither tokens nor single postings are shuffled; a range's rows are merged in one task."""
    cut_terms, cut_ords = pa.array([t for t, _ in cuts], pa.string()), np.array([o for _, o in cuts], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            n, ords, lens = batch.num_rows, batch.column("ord").to_numpy(), batch.column("doc_len").to_numpy()
            flat = batch.column("own").flatten().dictionary_encode()
            if not len(flat):
                continue
            by_ord, by_term = np.argsort(ords), np.asarray(pc.array_sort_indices(flat.dictionary))
            ords, names = ords[by_ord], flat.dictionary.take(pa.array(by_term))
            doc, term = np.argsort(by_ord), np.argsort(by_term)
            key, tf = np.unique(term[np.asarray(flat.indices)] * n + np.repeat(doc, lens), return_counts=True)
            lens = lens[by_ord]
            term, doc = np.divmod(key, n)
            # a cut's place: that of its term among the names, and where the term is there that of its ord
            place = np.searchsorted(names.to_numpy(zero_copy_only=False), cut_terms.to_numpy(zero_copy_only=False)) if len(cuts) else np.zeros(0, np.int64)
            known = np.asarray(pc.is_in(cut_terms, value_set=names), bool)
            ends = [0, *np.searchsorted(key, place * n + np.where(known, np.searchsorted(ords, cut_ords), 0)), len(key)]
            rows = []
            for part, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
                if lo < hi:
                    own, sizes = np.unique(term[lo:hi], return_counts=True)
                    at = doc[lo:hi]
                    rows.append((part, names.take(pa.array(own)), *(x.tobytes() for x in (sizes.astype(np.int32), ords[at], tf[lo:hi].astype(np.int32), lens[at].astype(np.int32)))))
            parts, terms, *numbers = zip(*rows, strict=True)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, terms)]), pa.int32()), pa.concat_arrays(terms))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), lists, *(pa.array(x, pa.binary()) for x in numbers)], names=["part", "terms", "sizes", "ords", "tfs", "lens"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=RUN_SCHEMA)
        if not held.num_rows:
            return
        sizes, ords, tfs, lens = (np.frombuffer(b"".join(held.column(c).to_pylist()), t) for c, t in (("sizes", np.int32), ("ords", np.int64), ("tfs", np.int32), ("lens", np.int32)))
        terms = pa.concat_arrays([c.flatten() for c in held.column("terms").chunks]).dictionary_encode()
        by_term = np.asarray(pc.array_sort_indices(terms.dictionary))
        term = np.repeat(np.argsort(by_term)[np.asarray(terms.indices)], sizes)
        order = np.lexsort((ords, term))
        names = terms.dictionary.take(pa.array(by_term))
        for lo in range(0, len(order), STEP):
            at = order[lo : lo + STEP]
            rows = pa.table({"term": names.take(pa.array(term[at])), "ord": ords[at], "tf": tfs[at], "doc_len": lens[at]})
            yield _cut(rows, True)[0]

    runs = tokens.select(F.col("ord").cast("long").alias("ord"), "own", "doc_len").mapInArrow(count, RUNS)
    return runs.repartitionById(len(cuts) + 1, "part").mapInArrow(merge, BLOCKS)


def unpacked(blocks: DataFrame, keys: str = "segment string, term string") -> DataFrame:
    """(segment, term, ord, tf, doc_len) of blocks, or ``keys`` in place of the first two; a block's numbers are expanded together."""
    names = [x.split()[0] for x in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            at = pa.array(np.repeat(np.arange(len(n)), n))
            gaps = batch.column("gaps").flatten().to_numpy()
            starts = np.cumsum(n) - n
            total = np.cumsum(gaps)
            ords = total - np.repeat(total[starts], n) + np.repeat(batch.column("first").to_numpy(), n) if len(n) else gaps
            columns = [*(batch.column(x).take(at) for x in names), pa.array(ords, pa.int64()), batch.column("tfs").flatten(), batch.column("lens").flatten()]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "ord", "tf", "doc_len"])

    return blocks.select(*names, "first", "n", "gaps", "tfs", "lens").mapInArrow(run, f"{keys}, ord long, tf int, doc_len int")


class SegmentedIndex:
    """The index in ``folder``, a path that all executors share; made on first use and opened afterwards."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 8):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.turn, self.segments, self.tombs = 0, [], []
        if self._exists("manifest"):
            rows = spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
            self.turn = rows.agg(F.max("turn")).first()[0] or 0
            for r in rows.filter(F.col("turn") == self.turn).orderBy("name").collect():
                if r.kind == "segment":
                    self.segments.append(Segment(r.name, r.docs, r.postings))
                elif r.kind == "tombs":
                    self.tombs.append(r.name)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, files = self._path(name)
        return files.exists(path)

    def _commit(self) -> None:
        self.turn += 1
        rows = [(self.turn, "segment", s.name, s.docs, s.postings) for s in self.segments] + [(self.turn, "tombs", t, 0, 0) for t in self.tombs]
        self.spark.createDataFrame(rows or [(self.turn, "none", "", 0, 0)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _read(self, what: str, schema: str, names: list[str]) -> DataFrame:
        """Rows of the named segments with ``segment``; folders are read by name, so that nothing is listed but them."""
        out = self.spark.createDataFrame([], f"{schema}, segment string")
        for name in names:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{what}").withColumn("segment", F.lit(name)))
        return out

    def _dead(self) -> DataFrame:
        return self.spark.read.schema(TOMBS).parquet(*(f"{self.folder}/{t}" for t in self.tombs)) if self.tombs else self.spark.createDataFrame([], TOMBS)

    def documents(self) -> DataFrame:
        """(segment, ord, h1, h2, doc_len) of the live documents."""
        return self._read("docs", DOCS, [s.name for s in self.segments]).join(self._dead(), ["segment", "ord"], "left_anti")

    def blocks(self) -> DataFrame:
        """Rows of BLOCKS with their segment, dead documents included."""
        return self._read("blocks", BLOCKS, [s.name for s in self.segments])

    def postings(self, blocks: DataFrame | None = None) -> DataFrame:
        """(segment, term, ord, tf, doc_len) of the live documents."""
        return unpacked(self.blocks() if blocks is None else blocks).join(self._dead(), ["segment", "ord"], "left_anti")

    def _write(self, docs: DataFrame, blocks: Callable[[int, int, int], DataFrame]) -> Segment | None:
        """A segment of documents (ord, h1, h2, doc_len) and the blocks of their postings, given the number of files, of documents and of tokens."""
        name = f"segment-{uuid.uuid4().hex}"
        docs.select("ord", *HASHES, F.col("doc_len").cast("int").alias("doc_len")).write.parquet(f"{self.folder}/{name}/docs")
        own = self.spark.read.schema(DOCS).parquet(f"{self.folder}/{name}/docs")
        n, size = own.agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
        if not n:
            return None
        blocks(max(1, -(-int(size) // FILE_POSTINGS)), n, int(size)).write.parquet(f"{self.folder}/{name}/blocks")
        count = self.spark.read.schema(BLOCKS).parquet(f"{self.folder}/{name}/blocks").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return Segment(name, n, int(count))

    def update(self, snapshot: DataFrame) -> tuple[int, int]:
        """Make the live documents those of ``snapshot`` (ord, text). Returns how many were added and how many were taken out."""
        snapshot = index.dealt(snapshot)
        new = hashed(snapshot)
        if not self.segments:
            return self._changed(new, None)
        # only keys are compared, and only what differs is stored; the texts of new keys are then fetched by their ord
        live = self.documents().select("segment", "ord", *HASHES)
        differs = new.select("ord", *HASHES, F.lit(True).alias("new")).join(live, ["ord", *HASHES], "full_outer").filter("new IS NULL OR segment IS NULL")
        name = f"changes-{uuid.uuid4().hex}"
        differs.select("segment", "ord").write.parquet(f"{self.folder}/{name}")
        changes = self.spark.read.schema(TOMBS).parquet(f"{self.folder}/{name}")
        known = changes.filter("segment IS NULL").select("ord")
        out = self._changed(new.join(known, "ord", "left_semi"), changes.filter("segment IS NOT NULL"))
        path, files = self._path(name)
        files.delete(path, True)
        return out

    def add(self, docs: DataFrame) -> tuple[int, int]:
        """Add documents, in the place of those of the same ord."""
        new = hashed(docs)
        live = self.documents().select("segment", "ord", *HASHES)
        fresh = new.join(live, ["ord", *HASHES], "left_anti")
        return self._changed(fresh, live.join(fresh.select("ord"), "ord", "left_semi").select("segment", "ord"))

    def delete(self, ords: DataFrame) -> int:
        """Take out the documents of ords (ord)."""
        gone = self.documents().join(ords.select("ord").distinct(), "ord", "left_semi").select("segment", "ord")
        return self._changed(None, gone)[1]

    def _changed(self, fresh: DataFrame | None, gone: DataFrame | None) -> tuple[int, int]:
        tombs, n_gone = f"tombs-{uuid.uuid4().hex}", 0
        if gone is not None:
            gone.write.parquet(f"{self.folder}/{tombs}")
            n_gone = self.spark.read.schema(TOMBS).parquet(f"{self.folder}/{tombs}").count()
        made = None
        if fresh is not None:
            lengths = fresh.select("ord", *HASHES, F.size(T.content(F.coalesce("text", F.lit("")))).alias("doc_len"))
            tokens = index.doc_tokens(fresh)
            made = self._write(lengths, lambda *size: inverted(tokens, bounds(tokens, *size)))
        if n_gone:
            self.tombs.append(tombs)
        if made:
            self.segments.append(made)
        if n_gone or made:
            self._merge()
            self._commit()
        return (made.docs if made else 0), n_gone

    def tier(self, segment: Segment) -> int:
        return int(math.log(max(segment.docs, 1), self.fanout))

    def _merge(self) -> None:
        """Merge tiers that hold ``fanout`` segments, from the lowest up."""
        tier = 0
        while any(self.tier(s) >= tier for s in self.segments):
            own = [s for s in self.segments if self.tier(s) == tier]
            if len(own) >= self.fanout:
                names = [s.name for s in own]
                docs = self.documents().filter(F.col("segment").isin(names))
                postings = self.postings(self._read("blocks", BLOCKS, names))
                merged = self._write(docs, lambda files, _n, _size, own=postings: packed(own, files))
                self.segments = [s for s in self.segments if s not in own] + ([merged] if merged else [])
            tier += 1

    def vacuum(self) -> None:
        """Delete folders that the manifest no longer names."""
        keep = {s.name for s in self.segments} | {*self.tombs, "manifest"}
        path, files = self._path("")
        for status in files.listStatus(path):
            if status.getPath().getName() not in keep:
                files.delete(status.getPath(), True)

    def _of_terms(self, wanted: DataFrame) -> DataFrame:
        """Rows of BLOCKS of the terms (term), with their other columns."""
        few = [r.term for r in wanted.select("term").limit(11).collect()]
        blocks = self.blocks().join(F.broadcast(wanted), "term")  # the queries' terms: a stated set
        # up to ten terms are pushed to the readers one by one
        return blocks.filter(F.col("term").isin(few)) if len(few) <= 10 else blocks

    def _stats(self) -> DataFrame:
        return self.documents().agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))

    def bm25(self, terms: DataFrame, own: Retrieval = Retrieval()) -> DataFrame:
        """(query_id, ord, score) of live documents that share a term with terms (query_id, term, times). Only the blocks of those terms are expanded."""
        blocks = self._of_terms(terms.select("term").distinct())
        return retrieve.scored(self.postings(blocks).drop("segment"), terms, self._stats(), own)

    def search(self, queries: DataFrame, k: int, own: Retrieval = Retrieval()) -> DataFrame:
        """The k best of each query (query_id, query), as ``retrieve.sparse``. Postings carry numbers in place of segments and terms, are dealt out by
        document, and only the k best of each query leave a task."""
        terms = retrieve.query_terms(queries)
        names = [s.name for s in self.segments]
        number = F.array_position(F.array(*map(F.lit, names)), F.col("segment")).alias("at") if names else F.lit(0).cast("long").alias("at")
        blocks = self._of_terms(terms.select("term").distinct().select("term", F.xxhash64("term").alias("number")))
        found = unpacked(blocks.select(number, "number", "first", "n", "gaps", "tfs", "lens"), "at long, number long")
        found = found.join(self._dead().select(number, "ord"), ["at", "ord"], "left_anti").select("ord", F.col("number").alias("term"), "tf", "doc_len")
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(s.postings for s in self.segments) // FILE_POSTINGS))
        numbered = terms.select("query_id", F.xxhash64("term").alias("term"), "times")
        return retrieve.best(found.repartition(parts, "ord"), numbered, self._stats(), k, own)
