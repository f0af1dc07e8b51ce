"""The truncated SVD of a large table of term weights. Neither the driver nor a task holds terms x rank or documents x rank numbers.

Documents are cut into slices, which are dealt into groups; terms are dealt into parts. Counts are stored once, in a folder for each group and part.
A pass multiplies by the weights' transpose in a task for each part, which holds the counts of its terms and reads the documents' matrix slice
by slice, and then by the weights in a task for each group, which holds the counts of its documents and reads the terms' matrix part by part. Both
matrices lie below spark.checkpoint.dir, the last of each only: a pass shuffles nothing, so disk does not grow with passes or parts. A term of one document
adds to this document's own row alone, so the terms' matrix leaves such terms out. Only matrices of columns x columns reach the driver.
"""

from __future__ import annotations

import uuid
from collections import defaultdict, namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evidora.session import drop, scratch

DOCS, TOKENS = 1 << 13, 1 << 22  # of a slice, at most; but a document is never cut
PART = 1 << 25  # tokens of a part of the terms, and of a group of slices, about
ROWS = 1 << 10  # of the terms' matrix in a row of its table
SLICES = "s long, n long, ords binary, doc binary, code binary, tf binary, terms array<string>, dfs array<int>"
PLACES = "p int, s long, lo int, n int, rare int, at binary, codes binary, dfs binary, terms array<string>"
VOCABULARY = "lo int, n int, rare int, dfs binary, terms array<string>, p int"
WEIGHTS = "s long, n int, doc binary, code binary, tf binary, g int, p int"
READ = {"kind": "int", "p": "int", "s": "long", "lo": "int", "n": "int", "doc": "binary", "code": "binary", "tf": "binary"}
Row = namedtuple("Row", READ)  # kinds: 0 terms, 1 weights, 2 documents' matrix, 3 terms' matrix; doc has the matrix, or document counts
ASKED = "p int, code int, v array<double>"
TERMS, STATE = "p int, lo int, n int, y binary", "s long, ords binary, y binary, g int"
NONE = -1  # in place of a part: ords, norms and shares of single terms of a slice's documents; in place of a slice: terms, or sums of columns


def _packed(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, f"u{len(x) // n}").astype(np.int64)


def _idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1) / (df + 1)) + 1


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (ord, own), rows of SLICES: counts by places in the slice's own list of terms."""
    s = TaskContext.get().partitionId() << 32
    schema = pa.schema([("s", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("ords", "doc", "code", "tf")), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int32()))])
    for b in batches:
        ords, own = b.column(0).to_numpy(), b.column(1)
        size = own.value_lengths().fill_null(0).to_numpy()
        total = np.concatenate(([0], np.cumsum(size)))
        most, i = -(-len(size) // max(1, -(-len(size) // DOCS))), 0
        while i < len(size):
            j = max(i + 1, min(i + most, int(np.searchsorted(total, total[i] + TOKENS, "right")) - 1))
            names = own.slice(i, j - i).flatten().dictionary_encode()
            if len(names):
                m = len(names.dictionary)
                key, tf = np.unique(np.repeat(np.arange(j - i), size[i:j]) * m + names.indices.to_numpy(), return_counts=True)
                doc, code = np.divmod(key, m)
                used, doc = np.unique(doc, return_inverse=True)
                row = {"s": s, "n": len(key), "ords": ords[i:j][used].astype(np.int64).tobytes(), "doc": _packed(doc), "code": _packed(code), "tf": _packed(tf), "terms": names.dictionary, "dfs": np.bincount(code)}
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)
                s += 1
            i = j


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (p, s, at, term, df), all of a part in one task, rows of PLACES: terms get places by falling document count."""
    schema = pa.schema([(c, pa.int64() if c == "s" else pa.int32()) for c in ("p", "s", "lo", "n", "rare")] + [(c, pa.binary()) for c in ("at", "codes", "dfs")] + [("terms", pa.list_(pa.string()))])
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    every = table.column("p").to_numpy()
    for p in np.unique(every).tolist():
        part = table.filter(pa.array(every == p)).combine_chunks()
        own = part.column("term").combine_chunks().dictionary_encode()
        own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
        s, at, df, index = (*(part.column(c).to_numpy() for c in ("s", "at", "df")), own.indices.to_numpy())
        df = np.bincount(index, df).astype(np.int64)
        by_name = pc.sort_indices(own.dictionary).to_numpy()
        order = by_name[np.argsort(-df[by_name], kind="stable")]
        code = np.empty(len(order), np.int64)
        code[order] = np.arange(len(order))
        for lo in range(0, len(order), 1 << 16):
            here = order[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_pylist([{"p": p, "s": NONE, "lo": lo, "n": len(here), "rare": int((df[here] == 1).sum()), "dfs": df[here].tobytes(), "terms": own.dictionary.take(pa.array(here)).to_pylist()}], schema)
        by_slice = np.argsort(s, kind="stable")
        starts = np.flatnonzero(np.diff(s[by_slice], prepend=-1))
        for x in np.split(by_slice, starts[1:]):
            yield pa.RecordBatch.from_pylist([{"p": p, "s": int(s[x[0]]), "at": at[x].astype(np.int32).tobytes(), "codes": code[index[x]].astype(np.int32).tobytes(), "dfs": df[index[x]].tobytes()}], schema)


def _placed(n: int):
    def run(x) -> Iterator[tuple]:
        """Rows of WEIGHTS of a slice; ``n`` documents in all."""
        ords, doc, code, tf = np.frombuffer(x.ords, np.int64), *(_unpacked(c, x.n) for c in (x.doc, x.code, x.tf))
        part, place, df = np.full(code.max() + 1, NONE), np.zeros(code.max() + 1, np.int64), np.zeros(code.max() + 1, np.int64)
        for own in x.own:
            at = np.frombuffer(own.at, np.int32)
            part[at], place[at], df[at] = own.p, np.frombuffer(own.codes, np.int32), np.frombuffer(own.dfs, np.int64)
        stays = part[code] != NONE
        doc, code, tf = doc[stays], code[stays], tf[stays]
        used, doc = np.unique(doc, return_inverse=True)
        square = (np.log1p(tf) * _idf(df[code], n)) ** 2
        total, single = np.bincount(doc, square), np.bincount(doc, np.where(df[code] == 1, square, 0.0))
        yield x.s, len(used), ords[used].tobytes(), np.sqrt(total).tobytes(), (single / total).tobytes(), x.g, NONE
        order = np.argsort(part[code], kind="stable")
        for y in np.split(order, np.flatnonzero(np.diff(part[code[order]])) + 1):
            if len(y):
                yield x.s, len(y), _packed(doc[y]), _packed(place[code[y]]), _packed(tf[y]), x.g, int(part[code[y[0]]])

    return run


def _add(out: np.ndarray, to: np.ndarray, at: np.ndarray, w: np.ndarray, b: np.ndarray) -> None:
    """out[to] += w b[at]; ``to`` ascends. The first of each place are added at once, then the second, and so on."""
    i = 0
    while i < len(to):
        j = int(np.searchsorted(to, to[min(i + 8192, len(to)) - 1], "right"))
        first = np.flatnonzero(np.diff(to[i:j], prepend=-1))
        size = np.diff(first, append=j - i)
        order = np.argsort(-size, kind="stable")
        first, size = first[order] + i, size[order]
        sums = b[at[first]] * w[first, None]
        for k in range(1, int(size[0])):
            more = first[: np.searchsorted(-size, -k)] + k
            sums[: len(more)] += b[at[more]] * w[more, None]
        out[to[first]] += sums
        i = j


def _times(out: np.ndarray, b: np.ndarray, doc: np.ndarray, code: np.ndarray, tf: np.ndarray, down: bool) -> None:
    """Adds the product of a slice's counts (``doc`` ascends) with b, by documents, to out, by terms (``down``), or the other way round. Terms of one in 96 documents
    are multiplied as a full matrix."""
    w = np.log1p(tf).astype(np.float32)
    docs = len(b) if down else len(out)
    count = np.bincount(code)
    many = np.flatnonzero(count > max(8, docs / 96))
    slot = np.full(len(count), -1)
    slot[many] = np.arange(len(many))
    slot = slot[code]
    dense = slot >= 0
    if len(many):
        own, at, value = doc[dense], slot[dense], w[dense]
        for lo in range(0, docs, 2048):
            i, j = np.searchsorted(own, (lo, lo + 2048))
            full = np.zeros((min(2048, docs - lo), len(many)), np.float32)
            full[own[i:j] - lo, at[i:j]] = value[i:j]
            if down:
                out[many] += full.T @ b[lo : lo + 2048]
            else:
                out[lo : lo + 2048] += full @ b[many]
    doc, code, w = doc[~dense], code[~dense], w[~dense]
    if down:
        order = np.argsort(code, kind="stable")
        _add(out, code[order], doc[order], w[order], b)
    else:
        _add(out, doc, code, w, b)


def _matrix(x: pa.Buffer | bytes, columns: int) -> np.ndarray:
    return np.frombuffer(x, np.float32).reshape(-1, columns)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    """Rows of READ; numbers of a matrix are not copied."""
    for b in batches:
        numbers, kept = [c.to_pylist() for c in b.columns[:5]], b.columns[5:]
        for i, x in enumerate(zip(*numbers, strict=True)):
            yield Row(*x, *((c[i].as_py() if x[0] == 1 else c[i].as_buffer()) for c in kept))


def _made(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """A batch for each row, which may be large."""
    for x in rows:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(x, schema, strict=True)], schema=schema)


def _down(p: int, size: tuple, n: int, turn: np.ndarray, asked: list | None = None) -> Callable[[Iterator[Row]], Iterator[tuple]]:
    """The terms' matrix from the documents' one, times turn: rows of TERMS of a part. ``size``: its terms, those of several documents, its rows of weights. Of
    terms ``asked`` for, rows of ASKED instead."""

    def run(rows: Iterator[Row]) -> Iterator[tuple]:
        columns, (every, several, count) = len(turn), size
        df, held, early, done = np.zeros(every), {}, {}, 0
        place = np.full(every, -1)
        mine = np.arange(several) if asked is None else np.array(asked)
        place[mine] = np.arange(len(mine))
        own = np.zeros((len(mine), columns), np.float32)

        def use(x: Row, y: pa.Buffer) -> None:
            doc, code, tf = (_unpacked(c, x.n) for c in (x.doc, x.code, x.tf))
            code = place[code]
            here = code >= 0
            _times(own, _matrix(y, columns), doc[here], code[here], tf[here], True)

        for x in rows:
            if x.kind == 0:
                df[x.lo : x.lo + x.n] = np.frombuffer(x.doc, np.int64)
            elif x.kind == 1:
                held[x.s] = x
                if x.s in early:
                    use(held.pop(x.s), early.pop(x.s))
                    done += 1
            elif x.s in held:
                use(held.pop(x.s), x.doc)
                done += 1
            elif len(held) + done < count:  # weights are read before the matrix; should they not be, it waits
                early[x.s] = x.doc
        idf = _idf(df[mine], n)
        for lo in range(0, len(mine), ROWS):
            y = own[lo : lo + ROWS].astype(float) @ turn * idf[lo : lo + ROWS, None] ** 2
            if asked is None:
                yield p, lo, len(y), y.astype(np.float32).tobytes()
            else:
                yield from ((p, int(c), v) for c, v in zip(mine[lo : lo + ROWS], y.tolist(), strict=True))

    return run


def _up(g: int, count: int, sizes: dict, columns: int, turn: np.ndarray | None) -> Callable[[Iterator[Row]], Iterator[tuple]]:
    """The documents' matrix from the terms' one: rows of STATE of a group, which has ``count`` rows of weights, divided by norms once more, and a row of sums of columns:
    its square, and its product with the matrix before, which has been multiplied by turn."""

    def run(rows: Iterator[Row]) -> Iterator[tuple]:
        docs, weights, before, z, blocks, got, ready = {}, defaultdict(list), {}, {}, defaultdict(list), 0, []

        def use(p: int) -> None:
            terms = np.zeros((sizes[p][1], columns), np.float32)
            for lo, y in blocks.pop(p):
                terms[lo : lo + y.size // (4 * columns)] = _matrix(y, columns)
            for x in weights[p]:
                doc, code, tf = (_unpacked(c, x.n) for c in (x.doc, x.code, x.tf))
                here = code < len(terms)
                _times(z[x.s], terms, doc[here], code[here], tf[here], False)

        for x in rows:
            if x.kind == 1:
                got += 1
                if x.p == NONE:
                    docs[x.s] = (x.doc, np.frombuffer(x.code)[:, None], np.frombuffer(x.tf)[:, None])
                    z[x.s] = np.zeros((x.n, columns), np.float32)
                else:
                    weights[x.p].append(x)
            elif x.kind == 2:
                before[x.s] = x.doc
            else:
                blocks[x.p].append((x.lo, x.doc))
                if sum(y.size for _, y in blocks[x.p]) == 4 * columns * sizes[x.p][1]:
                    ready.append(x.p)
            while ready and got == count:
                use(ready.pop(0))
        square, product = np.zeros((columns, columns)), np.zeros((columns, columns))
        for s, (ords, norm, single) in sorted(docs.items()):
            own = z.pop(s) / norm
            if turn is None:
                own += np.sqrt(single) * np.random.default_rng((11, s)).standard_normal(own.shape)
            else:
                old = (_matrix(before.pop(s), len(turn)) * norm) @ turn
                own += single * old
                product += old.T @ own
            square += own.T @ own
            yield s, ords, (own / norm).astype(np.float32).tobytes(), g
        yield NONE, b"", np.stack((square, product)).tobytes(), g

    return run


class Latent:
    """The first k right singular vectors of the rows' weights log1p(tf) (ln((N+1)/(df+1)) + 1), rows of unit length, by block iteration in
    ``passes`` passes from a fixed start; tokens (ord, own), n of them, with ``size`` tokens and ``width`` distinct ones in all, all of them or those of
    ``vocabulary`` (term)."""

    def __init__(self, tokens: DataFrame, n: int, size: int, width: int, k: int, passes: int, vocabulary: DataFrame | None = None):
        self.spark, self.folder, self.n = tokens.sparkSession, scratch(tokens.sparkSession, "latent"), n
        parts = max(self.spark.sparkContext.defaultParallelism, -(-size // PART))
        slices = self._stored(tokens.select(F.col("ord").cast("long"), "own").mapInArrow(_sliced, SLICES), SLICES, "slices", "zstd")
        rows = slices.select("s", F.posexplode(F.arrays_zip("terms", "dfs")).alias("at", "x")).select("s", "at", F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
        rows = rows if vocabulary is None else rows.join(vocabulary, "term", "left_semi")
        rows = rows.select(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("p"), "s", "at", "term", "df")
        places = self._stored(rows.repartitionById(parts, "p").mapInArrow(_numbered, PLACES), PLACES, "places", "zstd")
        self.terms = self._stored(places.filter(F.col("s") == NONE).select("lo", "n", "rare", "dfs", "terms", "p"), VOCABULARY, "vocabulary", "zstd", "p")
        load, group = [0] * parts, []
        for r in sorted(slices.select("s", "n").collect(), key=lambda r: (-r.n, r.s)):
            g = load.index(min(load))
            load[g] += r.n
            group.append((r.s, g))
        own = places.filter(F.col("s") != NONE).groupBy("s").agg(F.collect_list(F.struct("p", "at", "codes", "dfs")).alias("own"))
        dealt = slices.drop("terms", "dfs").join(F.broadcast(self.spark.createDataFrame(group, "s long, g int")), "s").join(own, "s")
        made = self.spark.createDataFrame(dealt.rdd.flatMap(_placed(n)), WEIGHTS, verifySchema=False)
        self.weights = self._stored(made, WEIGHTS, "weights", "zstd", "g", "p")
        self._drop("slices")
        self._drop("places")
        of = {r.p: (r.every, r.several) for r in self.terms.groupBy("p").agg(F.sum("n").alias("every"), F.sum(F.col("n") - F.col("rare")).alias("several")).collect()}
        count = self.weights.groupBy("g", "p").agg(F.count("s").alias("n")).collect()
        self.sizes = {p: (*x, sum(r.n for r in count if r.p == p)) for p, x in of.items()}
        self.counts = {g: sum(r.n for r in count if r.g == g) for g in {r.g for r in count}}
        self.of_part = {p: self._read(self.terms.filter(f"p = {p}"), 0, "lo", "n", doc="dfs").union(self._read(self.weights.filter(f"p = {p}"), 1, "p", "s", "n", "doc", "code", "tf")) for p in self.sizes}
        self.of_group = {g: self._read(self.weights.filter(f"g = {g}"), 1, "p", "s", "n", "doc", "code", "tf") for g in self.counts}
        columns = min(width, n, k + 32)
        y, square, _ = self._documents("start", self._start(columns), columns)
        turn = self._unit(square)
        for i in range(passes):
            self.before = (y, turn)
            terms = self._of_terms(f"terms-{i}", TERMS)
            y, square, product = self._documents(f"pass-{i}", terms, turn.shape[1])
            self._drop(f"terms-{i}")
            if i < passes - 1:
                self._drop(f"pass-{i - 1}" if i else "start")
                turn = self._unit(square)
        values, vectors = np.linalg.eigh((product + product.T) / 2)
        best = [i for i in range(len(values) - 1, -1, -1) if values[i] > 1e-9 * values[-1]][:k]
        self.axes, self.last = vectors[:, best] / np.sqrt(values[best]), y

    def _stored(self, rows: DataFrame, schema: str, name: str, packed: str = "none", *folders: str) -> DataFrame:
        """Rows may be large: few of them make a row group."""
        options = {"compression": packed, "parquet.block.size": 1 << 25, "parquet.block.size.row.check.min": 4}
        rows.write.options(**options).parquet(f"{self.folder}/{name}", partitionBy=list(folders) or None)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _drop(self, name: str) -> None:
        drop(self.spark, f"{self.folder}/{name}")

    @staticmethod
    def _read(rows: DataFrame, kind: int, *same: str, **others: str) -> DataFrame:
        """The rows as tasks read them."""
        names = {"kind": str(kind), **{c: c for c in same}, **others}
        return rows.selectExpr(*(f"CAST({names.get(c, 'NULL')} AS {t}) AS {c}" for c, t in READ.items()))

    def _tasks(self, own: list[tuple[DataFrame, Callable]], schema: str, name: str, *folders: str) -> DataFrame:
        """Stored rows of a task each, which reads its own rows where they are stored, in this order."""
        every, kind = None, to_arrow_schema(StructType.fromDDL(schema))
        for rows, run in own:
            made = rows.coalesce(1).mapInArrow(lambda batches, run=run: _made(kind, run(_rows(batches))), schema)
            every = made if every is None else every.union(made)
        key = "spark.sql.unionOutputPartitioning"  # else a union of tables of one partition has one
        was = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "false")
        try:
            return self._stored(self.spark.createDataFrame([], schema) if every is None else every, schema, name, "none", *folders)
        finally:
            if was is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, was)

    def _of_terms(self, name: str, schema: str, asked: dict | None = None) -> DataFrame:
        """Rows of the parts' tasks, which read their terms, their weights and the documents' matrix."""
        y, turn = self.before
        y = self._read(y.filter(f"s <> {NONE}"), 2, "s", doc="y")
        return self._tasks([(self.of_part[p].union(y), _down(p, self.sizes[p], self.n, turn, asked and asked[p])) for p in (self.sizes if asked is None else asked)], schema, name)

    def _start(self, columns: int) -> DataFrame:
        """Random numbers of the terms."""
        n = self.n

        def drawn(x) -> Iterator[tuple]:
            df, draw = np.frombuffer(x.dfs, np.int64), np.random.default_rng((7, x.p, x.lo))
            df = df[df > 1]
            for lo in range(0, len(df), ROWS):
                own = df[lo : lo + ROWS]
                yield x.p, x.lo + lo, len(own), (draw.standard_normal((len(own), columns)) * _idf(own, n)[:, None]).astype(np.float32).tobytes()

        terms = self.terms.select("p", "lo", "dfs").rdd.flatMap(drawn)
        return self._stored(self.spark.createDataFrame(terms, TERMS, verifySchema=False), TERMS, "terms-start")

    def _documents(self, name: str, terms: DataFrame, columns: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """Rows of STATE from those of the terms' matrix, and the sums of columns."""
        turn = None if name == "start" else self.before[1]

        terms, own = self._read(terms, 3, "p", "lo", doc="y"), []
        for g, count in self.counts.items():
            before = None if turn is None else self._read(self.before[0].filter(f"g = {g} AND s <> {NONE}"), 2, "s", doc="y")
            own.append(((self.of_group[g] if before is None else self.of_group[g].union(before)).union(terms), _up(g, count, self.sizes, columns, turn)))
        y = self._tasks(own, STATE, name, "g")
        if name == "start":
            self._drop("terms-start")
        sums = y.filter(F.col("s") == NONE).select("g", "y").rdd.map(lambda r: np.frombuffer(r.y).reshape(2, columns, columns)).treeReduce(np.add)
        return y, *sums

    @staticmethod
    def _unit(square: np.ndarray) -> np.ndarray:
        """The matrix that makes columns orthonormal, those that depend on others left out."""
        values, vectors = np.linalg.eigh(square)
        good = values > 1e-9 * values[-1]
        return vectors[:, good] / np.sqrt(values[good])

    def vectors(self) -> DataFrame:
        """(ord, vector) of unit length of the documents themselves."""
        axes = self.axes

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ords, y in (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                ords, y = np.frombuffer(ords, np.int64), _matrix(y, len(axes))
                for lo in range(0, len(ords), 1024):
                    own = y[lo : lo + 1024] @ axes
                    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300)
                    ends = pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(ords[lo : lo + 1024]), pa.ListArray.from_arrays(ends, pa.array(own.ravel()))], names=["ord", "vector"])

        return self.last.filter(F.col("s") != NONE).select("ords", "y").mapInArrow(part, "ord long, vector array<double>")

    def project(self, counts: DataFrame) -> DataFrame:
        """(ord, vector) of unit length of other texts, (ord, term, tf): stated ones, whose distinct terms are sent to the tasks."""
        terms = self.terms.select("p", "lo", F.posexplode("terms").alias("at", "term")).select("p", (F.col("lo") + F.col("at")).alias("code"), "term")
        wanted = F.broadcast(counts.select("term").distinct())
        asked, numbers = defaultdict(list), []
        for r in terms.join(wanted, "term").orderBy("p", "code").collect():
            asked[r.p].append(r.code)
            numbers.append((r.term, r.p, r.code))
        rows = counts.join(F.broadcast(self.spark.createDataFrame(numbers, "term string, p int, code int")), "term")
        known = self._of_terms(f"asked-{uuid.uuid4().hex}", ASKED, dict(asked))
        sums = rows.join(known, ["p", "code"]).select("ord", F.log1p("tf").alias("w"), F.posexplode("v").alias("at", "x")).groupBy("ord", "at").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        axes = self.axes

        def turned(x) -> tuple:
            own = np.array([v for _, v in sorted(x.v)]) @ axes
            return x.ord, (own / max(np.linalg.norm(own), 1e-300)).tolist()

        return self.spark.createDataFrame(sums.groupBy("ord").agg(F.collect_list(F.struct("at", "x")).alias("v")).rdd.map(turned), "ord long, vector array<double>", verifySchema=False)
