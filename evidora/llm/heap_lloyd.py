"""Vector code compression: product quantisation whose codebooks are fitted by Lloyd's algorithm with heaps.

Components become the integers floor(4096 x); a vector is cut into ``PARTS`` equal consecutive parts. All arithmetic is on integers, so that codes,
errors and codebooks are the same however the rows are dealt.

Heap Lloyd: a block holds some thousand vectors. For each part position and each codebook entry it has a heap of the parts assigned to
the entry, keyed by lower bound (distance to the second nearest entry) less upper bound (distance to the own one), plus the
entry's drift so far. When entries move, an entry's cumulative drift grows by its own movement and the largest of any other entry. Parts whose key is above
the drift can't have changed their entry; only the others are popped, measured against all entries, and pushed to the heap of the nearest with
a new key. Keys are rounded down and a tie counts as violated, so that what isn't popped is surely right. A heap is an ascending array, which is a
heap whose violated members are a prefix; popping is cutting it off and pushing a batch is a merge.

Blocks and their heaps are tables in the shared folder, dealt to the same buckets by block, so that a round joins them without a
shuffle, writes the heaps anew (six bytes for each part), and survives the loss of any executor. A round's sums are those of the parts that moved,
added up by Spark to one number for each component of each entry.

Rows dropped: null vectors, those with null or non-finite components, and those whose length differs from that of the first vector kept (by id) or isn't a multiple
of ``PARTS``. Components beyond +-32768 are held there, so that squares fit 64 bits. A null id comes after all others; equal ids are ordered by vector.
Of fewer than ``ENTRIES`` kept rows each gives an entry. Repeated rows count each. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm.shared import bucketed, scratch_path
from evidora.session import table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 27
BLOCK = 4096  # places in a block fit 16 bits

Vectors = np.ndarray  # int32, (rows, width)
State = tuple[bytes, bytes, bytes]


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(SCALE x); the product is exact, as SCALE is a power of two."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int32)


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (parts, entries)."""
    if max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0)) < 1 << 21:  # every number below fits 53 bits
        p, e = parts.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)).astype(np.int64)
    return np.stack([((parts.astype(np.int64) - e) ** 2).sum(1) for e in entries], 1)


@dataclass
class Codebooks:
    """entries (part, entry, place); drift (part, entry) so far, an upper bound."""

    entries: np.ndarray
    drift: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.drift is None:
            self.drift = np.zeros(self.entries.shape[:2])

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> "Codebooks":
        """After a round: sums and counts are exact integers of any size."""
        after = self.entries.copy()
        for p, k in zip(*np.nonzero(counts), strict=True):
            after[p, k] = [int(s) // int(counts[p, k]) for s in sums[p, k]]
        step = np.sqrt(((after - self.entries).astype(np.float64) ** 2).sum(2)) * (1 + 1e-9)
        others = np.zeros_like(step)
        for k in range(step.shape[1]):
            others[:, k] = np.delete(step, k, 1).max(1, initial=0)
        return Codebooks(after, self.drift + (step + others) * (1 + 1e-9))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def keyed(squares: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, key rounded down) of parts from their squared distances."""
    nearest = squares.argmin(1)  # the first of equals
    rows = np.arange(len(squares))
    own = squares[rows, nearest]
    rest = squares.copy()
    rest[rows, nearest] = np.iinfo(np.int64).max
    second = rest.min(1) if squares.shape[1] > 1 else np.full(len(squares), np.iinfo(np.int64).max)
    slack = np.sqrt(second.astype(np.float64)) * (1 - 1e-12) - np.sqrt(own.astype(np.float64)) * (1 + 1e-12)
    key = (slack + drift[nearest]) * np.where(slack + drift[nearest] > 0, 1 - 1e-9, 1 + 1e-9)
    return nearest, np.nextafter(key.astype(np.float32), np.float32(-np.inf))


class Heaps:
    """Of one block and one part position: places ascending by key for each entry."""

    def __init__(self, places: list[np.ndarray], keys: list[np.ndarray]):
        self.places, self.keys = places, keys

    @classmethod
    def of(cls, nearest: np.ndarray, keys: np.ndarray, entries: int) -> "Heaps":
        order = np.lexsort((keys, nearest))
        cuts = np.searchsorted(nearest[order], np.arange(1, entries))
        return cls(np.split(order.astype(np.uint16), cuts), np.split(keys[order], cuts))

    def violated(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pop (places, entries they were assigned to) of the parts whose key isn't above the drift."""
        popped, was = [], []
        for k, keys in enumerate(self.keys):
            n = int(np.searchsorted(keys, drift[k], "right"))
            if n:
                popped.append(self.places[k][:n])
                was.append(np.full(n, k))
                self.places[k], self.keys[k] = self.places[k][n:], keys[n:]
        return (np.concatenate(popped), np.concatenate(was)) if popped else (np.zeros(0, np.uint16), np.zeros(0, np.int64))

    def push(self, places: np.ndarray, nearest: np.ndarray, keys: np.ndarray) -> None:
        for k in np.unique(nearest):
            own = nearest == k
            order = np.argsort(keys[own], kind="stable")
            more, at = keys[own][order], places[own][order]
            where = np.searchsorted(self.keys[k], more)
            self.keys[k], self.places[k] = np.insert(self.keys[k], where, more), np.insert(self.places[k], where, at)

    def nearest(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for k, places in enumerate(self.places):
            out[places] = k
        return out


def packed(heaps: list[Heaps]) -> State:
    return (
        np.concatenate([x for h in heaps for x in h.places]).astype(np.uint16).tobytes(),
        np.concatenate([x for h in heaps for x in h.keys]).astype(np.float32).tobytes(),
        np.array([len(x) for h in heaps for x in h.places], np.int32).tobytes(),
    )


def unpacked(state: State, entries: int) -> list[Heaps]:
    places, keys, sizes = (np.frombuffer(b, t) for b, t in zip(state, (np.uint16, np.float32, np.int32), strict=True))
    cuts = np.cumsum(sizes)[:-1]
    own_places, own_keys = np.split(places, cuts), np.split(keys, cuts)
    return [Heaps(own_places[p * entries : (p + 1) * entries], own_keys[p * entries : (p + 1) * entries]) for p in range(PARTS)]


def rescanned(vectors: Vectors, state: State | None, books: Codebooks) -> tuple[State, np.ndarray, int]:
    """(heaps, change of counts and sums by part and entry, how many parts were measured) of a block after the books moved."""
    parts = vectors.reshape(len(vectors), PARTS, -1)
    entries = books.entries.shape[1]
    change = np.zeros((PARTS, entries, 1 + parts.shape[2]), np.int64)
    heaps = unpacked(state, entries) if state else []
    measured = 0
    for p in range(PARTS):
        if state:
            places, was = heaps[p].violated(books.drift[p])
        else:
            places, was = np.arange(len(parts)), None
        measured += len(places)
        if not len(places):
            continue
        own = parts[places, p]
        nearest, keys = keyed(distances(own, books.entries[p]), books.drift[p])
        if state:
            heaps[p].push(places, nearest, keys)
        else:
            heaps.append(Heaps.of(nearest, keys, entries))
        full = np.concatenate([np.ones((len(own), 1), np.int64), own.astype(np.int64)], 1)
        moved = np.ones(len(own), bool) if was is None else was != nearest
        np.add.at(change[p], nearest[moved], full[moved])
        if was is not None:
            np.subtract.at(change[p], was[moved], full[moved])
    return packed(heaps), change, measured


BLOCKS = "block long, vectors binary, ids array<long>"
STATES = "block long, places binary, keys binary, sizes binary, change array<long>, measured long"
_STATES = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("change", pa.list_(pa.int64())), ("measured", pa.int64())])


def blocks(kept: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """(block, vectors, ids, labels) of rows (id, label, vector); every task cuts its own rows."""
    label = kept.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                there = sum(b.num_rows for b in held)
                piece = batch.slice(at, min(block - there, batch.num_rows - at))
                held.append(piece)
                at += piece.num_rows
                if there + piece.num_rows == block:
                    yield block_of(n, held)
                    n, held = n + 1, []
        if held:
            yield block_of(n, held)

    def block_of(name: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(held).combine_chunks()
        vectors = quantised(np.asarray(own["vector"].chunk(0).flatten())).reshape(-1, width)
        ends = pa.array([0, own.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, own[c].combine_chunks() if not isinstance(own[c], pa.ChunkedArray) else own[c].chunk(0)) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([vectors.tobytes()], pa.binary()), *lists], names=["block", "vectors", "ids", "labels"])

    return kept.mapInArrow(run, f"{BLOCKS}, labels array<{label}>")


def _read(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, Vectors, State | None]]:
    for row in batch.select([c for c in batch.schema.names if c not in ("ids", "labels")]).to_pylist():
        yield row["block"], np.frombuffer(row["vectors"], np.int32).reshape(-1, width), (row["places"], row["keys"], row["sizes"]) if "places" in row else None


@dataclass
class Fitted:
    """Codebooks after all rounds, the blocks and their heaps, and how many parts each pass measured."""

    books: Codebooks
    blocks: DataFrame
    heaps: DataFrame
    width: int
    measured: list[int]


def fit(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES, block: int = BLOCK) -> Fitted | None:
    """None without a row to keep."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    # a null component makes its comparison, and so forall, null
    finite = F.forall("vector", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    kept = rows.filter(F.col("vector").isNotNull() & finite & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0))
    order = (F.col("id").asc_nulls_last(), F.col("vector").asc())
    first = kept.orderBy(*order).select("vector").limit(1).collect()
    if not first:
        return None
    width = len(first[0].vector)
    kept = kept.filter(F.size("vector") == width)
    start = quantised(np.array([r.vector for r in kept.orderBy(*order).select("vector").limit(entries).collect()], np.float64))
    books = Codebooks(start.reshape(len(start), PARTS, -1).transpose(1, 0, 2).astype(np.int64))

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = bucketed(blocks(kept, width, block).repartition(buckets, "block"), scratch_path(spark, "vector-blocks"), buckets, ["block"])
    shape = (PARTS, len(start), 1 + width // PARTS)
    totals = np.zeros(shape, object)
    heaps: DataFrame | None = None
    measured = []
    for k in range(rounds + 1):
        own = books

        def run(batches: Iterator[pa.RecordBatch], own: Codebooks = own) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, vectors, state in _read(batch, width):
                    (places, keys, sizes), change, n = rescanned(vectors, state, own)
                    yield pa.RecordBatch.from_pylist([{"block": name, "places": places, "keys": keys, "sizes": sizes, "change": change.ravel(), "measured": n}], schema=_STATES)

        source = stored.select("block", "vectors")
        if heaps is not None:
            source = source.join(heaps.select("block", "places", "keys", "sizes"), "block")
        heaps = bucketed(source.mapInArrow(run, STATES), scratch_path(spark, "vector-heaps"), buckets, ["block"])
        measured.append(heaps.agg(F.sum("measured")).first()[0] or 0)
        if k == rounds:
            break
        change = heaps.select(F.posexplode("change").alias("at", "x")).filter("x <> 0").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        flat = totals.reshape(-1)
        for r in change.collect():  # one row for each count and component at most
            flat[r.at] += int(r.x)
        totals = flat.reshape(shape)
        books = books.moved(totals[:, :, 1:], totals[:, :, 0].astype(np.int64))
    return Fitted(books, stored, heaps, width, measured)


def encoded(found: Fitted) -> DataFrame:
    """(vec_id, label, code, error) of each vector kept."""
    label = found.blocks.schema["labels"].dataType.elementType
    width, books = found.width, found.books.entries
    schema = f"vec_id long, label {label.simpleString()}, code string, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (_, vectors, state) in enumerate(_read(batch, width)):
                heaps = unpacked(state, books.shape[1])
                codes = np.stack([h.nearest(len(vectors)) for h in heaps], 1).astype(np.uint8)
                parts = vectors.reshape(len(vectors), PARTS, -1).astype(np.int64)
                error = sum(((parts[:, p] - books[p][codes[:, p]]) ** 2).sum(1) for p in range(PARTS))
                digits = codes.tobytes().hex()
                size = 2 * PARTS
                text = pa.array([digits[i : i + size] for i in range(0, len(digits), size)], pa.string())
                ids, labels = (batch.column(c)[k].values for c in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, text, pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return found.blocks.join(found.heaps.select("block", "places", "keys", "sizes"), "block").mapInArrow(run, schema)


def compressed(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row kept."""
    found = fit(embeddings, id_col, vector_col, label_col, rounds, entries)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = encoded(found)
    # totals are held as decimals on the way and at the end of long's range at most
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(str((1 << 63) - 1)).cast("decimal(38,0)")).cast("long")
    by_label = rows.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(found.books.digest()).alias("codebooks_sha256"))


def op11_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Every round measures all parts against all entries."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, e := e)) AS best FROM (
  SELECT q.r, q.p, c.e, list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM q JOIN c{k} AS c USING (p)) GROUP BY r, p)""")
        if k < ROUNDS:
            steps.append(f"""
u{k} AS (SELECT p, e, list(x ORDER BY j) AS v FROM (
  SELECT a.p, a.best.e AS e, j, floor(sum(q.v[j]) / count(*))::BIGINT AS x FROM a{k} AS a JOIN q USING (r, p), range(1, len(q.v) + 1) AS t(j) GROUP BY ALL) GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(u.v, c.v) AS v FROM c{k} AS c LEFT JOIN u{k} AS u USING (p, e))""")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, p, w[p * (len(w) // {PARTS}) + 1 : (p + 1) * (len(w) // {PARTS})] AS v FROM k, range({PARTS}) AS t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM q WHERE r <= {ENTRIES}),{','.join(steps)},
s AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM s JOIN k USING (r), h"""


SQL = {"op11_heap_lloyd": _oracle()}
QUERIES = {"op11_heap_lloyd": op11_heap_lloyd}
