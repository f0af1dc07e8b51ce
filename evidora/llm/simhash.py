"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: texts are lower-cased (A-Z only), cut at ASCII white space and turned into
word shingles, repeats included; a shingle's hash is XXH64 with seed 42 of its UTF-8 bytes and
a fingerprint bit is 1 if it is set in over half the hashes.

Linking: equal fingerprints are one class. Two fingerprints within ``budget`` differing bits
agree on at least one of ``budget + 1`` bit blocks, so each class goes to one bucket per block;
buckets above ``split_rows`` are dealt again by blocks of their other bits, which keeps
every link and breaks up hot buckets. A bucket is a sorted array, that is a binary trie in
which a node is a range. Pairs of nodes are walked together from the top bit, differing bits add
up, and a pair goes once they exceed the budget. Only a spanning forest of a bucket's links
leaves it (a dense group of n texts gives n - 1 rows, not n squared), so components are
exact without all pairs.

Nulls, empty texts and texts without words have fingerprint zero and are linked like any other.
A null id keeps its row and never names a component unless its whole component has no id.
Repeated rows stay. Columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm.shared import bitmap, giving_back, perhaps, written
from evidora.session import table

LEAF = 512  # pairs of leaves that are compared outright
CHUNK = 1 << 16  # pairs of leaves compared at once
NODES = 1 << 13  # node pairs expanded at once; the walk holds a few times as many on each of 64 levels
HELD = 1 << 20  # 64-bit words of fingerprints that are searched together
MARKS = [f"b{k}" for k in range(8)]
TABLES, NEAR = 4, 5  # tables of fingerprints for sets of shingles, and how many bits may differ in one of them


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of a text, in order and with repeats."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - width + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(width, len(found)) - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), "<u8", n)


def fingerprint(text: str | None, width: int = 4) -> np.ndarray:
    """The fingerprint of one text as an unsigned 64-bit number."""
    return majority(shingle_hashes(text, width))


def majority(base: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the hashes, as an unsigned 64-bit number."""
    n = len(base)
    set_in = np.zeros(64, np.int64)
    for lo in range(0, n, 255):  # 255 rows at most, so that their sums fit a byte
        part = base[lo : lo + 255]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        set_in += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(set_in * 2 > n, bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp0): the bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            bits = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=["id", "fp0"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(giving_back(run), "id long, fp0 long")


class Forest:
    """Union-find over 0..n-1 on arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.parent
        while len(a):
            for side in (a, b):
                while True:  # to the roots
                    up = parent[side]
                    if np.array_equal(up, side):
                        break
                    side[:] = up
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent


def trie_forest(group: np.ndarray, fps: np.ndarray, budget: int, prune: int, pairs: list | None = None, every: Callable | None = None, blocks: np.ndarray | None = None, parent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within groups; fps has a row of 64-bit words for each
    fingerprint, rows sorted by (group, first word). The trie is that of the first word, in which
    pairs of nodes with over ``prune`` differing bits go. Returns positions (child, root).

    pairs takes links (i, j) that hold the components together, each within the budget; with ``every``, all links between the components
    of ``parent`` for which every(i, j) holds, and no forest is grown. blocks: the block of bits of each row's bucket, if a link counts in the first one alone that its ends share."""
    n, top = len(fps), fps[:, 0]
    forest = Forest(n)
    if parent is not None:
        forest.parent = parent
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    lo, hi = cuts[:-1], cuts[1:]
    alone = hi - lo > 1
    lo, hi = lo[alone], hi[alone]
    ones: dict[int, np.ndarray] = {}
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, *pair = stack.pop()
        if len(pair[0]) > NODES:
            half = len(pair[0]) // 2
            stack += [(bit, *(x[:half] for x in pair)), (bit, *(x[half:] for x in pair))]
            continue
        root = forest.roots()
        turns = np.cumsum(np.concatenate(([0], root[1:] != root[:-1])))
        a, b, c, d, err = pair
        # all leaves of both nodes are one component already: nothing to find
        apart = (turns[b - 1] != turns[a]) | (turns[d - 1] != turns[c]) | (root[a] != root[c])
        a, b, c, d, err = (x[apart] for x in (a, b, c, d, err))
        leaf = ((b - a) * (d - c) <= LEAF) | (bit < 0)
        if leaf.any():
            compare(forest, fps, a[leaf], b[leaf], c[leaf], d[leaf], budget, pairs, every, blocks)
            a, b, c, d, err = (x[~leaf] for x in (a, b, c, d, err))
        if not len(a):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((top >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        count = ones[bit]
        m, k = b - (count[b] - count[a]), d - (count[d] - count[c])
        same = a == c
        children = [(a, m, c, k, err), (m, b, k, d, err), (a, m, k, d, err + 1), (m[~same], b[~same], c[~same], k[~same], err[~same] + 1)]
        joined = [np.concatenate(x) for x in zip(*children, strict=True)]
        keep = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= prune)
        keep &= (joined[0] != joined[2]) | (joined[1] - joined[0] > 1)
        if keep.any():
            stack.append((bit - 1, *(x[keep] for x in joined)))
    root = forest.roots()
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def compare(forest: Forest, fps: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, budget: int, pairs: list | None, every: Callable | None, blocks: np.ndarray | None) -> None:
    """Link the leaves of node pairs outright, CHUNK pairs of leaves at a time."""
    size = (b - a) * (d - c)
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1):
        count = size[part]
        at = np.repeat(part, count)
        rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        width = (d - c)[at]
        i, j = a[at] + rank // width, c[at] + rank % width
        root = forest.roots()
        apart = root[i] != root[j]  # also leaves out a leaf and itself
        i, j = i[apart], j[apart]
        near = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64) <= budget
        i, j = i[near], j[near]
        if blocks is not None and len(i):  # a pair counts in the bucket of the first block that it agrees in
            bits, block = fps[i, 0] ^ fps[j, 0], blocks[i]
            first = np.full(len(i), len(EDGES), np.int64)
            for k, (shift, width) in reversed(list(enumerate(EDGES))):
                first[(bits >> np.uint64(shift)) & np.uint64((1 << width) - 1) == 0] = k
            i, j = i[first == block], j[first == block]
        if every is not None:
            once = (i < j) & every(i, j)  # a node paired with itself gives both orders
            pairs.append((i[once], j[once]))
        elif pairs is None:
            forest.add(i, j)
        else:
            root = forest.roots()
            while len(i):
                own = np.unique(root[i], return_index=True)[1]  # one link for each component, so that n entries give 2 n links at most
                pairs.append((i[own], j[own]))
                forest.add(i[own], j[own])
                root = forest.roots()
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]


def _block(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of ``parts`` near-equal blocks of ``bits`` bits."""
    edges = [round(i * bits / parts) for i in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


EDGES = _blocks(64, NEAR + 1)


def exact_buckets(classes: DataFrame, budget: int, split_rows: int = 8192, tables: Column | None = None, others: list[str] | None = None) -> DataFrame:
    """Rows (key, sub, fp0) and ``others``: any two fp0 (of one of ``tables``, whose number is key >> 40) within ``budget`` bits share a bucket. Buckets are
    blocks of bits; those of over ``split_rows`` are dealt again by blocks of the other bits."""
    blocks = _blocks(64, budget + 1)
    above = F.shiftleft((F.lit(0) if tables is None else tables).cast("long"), 40)
    keys = [above.bitwiseOR(F.lit(k << 20)).bitwiseOR(_block(F.col("fp0"), *b)) for k, b in enumerate(blocks)]
    others = others or []
    dealt = classes.select("fp0", *others, F.explode(F.array(*keys)).alias("key"))
    # at most (budget + 1) * 2**13 keys at the default budget, however many rows there are
    large = F.broadcast(dealt.groupBy("key").count().filter(F.col("count") > split_rows).select("key", F.lit(True).alias("large")))
    sub = F.when(F.col("large").isNull(), F.array(F.lit(0).cast("long")))
    for k, (shift, width) in enumerate(blocks):
        # the other bits, moved together: those above the block come down over it
        low = F.col("fp0").bitwiseAND(F.lit((1 << shift) - 1))
        high = F.shiftrightunsigned(F.col("fp0"), shift + width) if shift + width < 64 else F.lit(0)
        rest = F.shiftleft(high, shift).bitwiseOR(low)
        inner = (F.lit((j + 1) << 20).bitwiseOR(_block(rest, s, w)) for j, (s, w) in enumerate(_blocks(64 - width, budget + 1)))
        sub = sub.when(F.shiftrightunsigned(F.col("key"), 20).bitwiseAND(F.lit((1 << 20) - 1)) == k, F.array(*(x.cast("long") for x in inner)))
    return dealt.join(large, "key", "left").select("key", F.explode(sub).alias("sub"), "fp0", *others)


def trie_links(bucketed: DataFrame, words: int, budget: int, prune: int, real: bool = False) -> DataFrame:
    """Links (a, b) between values of fp0 that hold the components of the fingerprints within
    ``budget`` differing bits of a shared bucket together. real: such links as are within the budget themselves, with their bucket's key and
    with a label for the component in it."""
    names = [f"fp{k}" for k in range(words)]

    def links(rows: pa.Table) -> pa.RecordBatch:
        fps, key, sub, group, order = in_trie_order(rows, names)
        pairs = [] if real else None
        child, root = trie_forest(group, fps, budget, prune, pairs, None, block_of(key) if real else None)
        if not real:
            return pa.RecordBatch.from_arrays([pa.array(fps[x, 0].view(np.int64)) for x in (child, root)], names=["a", "b"])
        top = np.arange(len(fps))
        top[child] = root
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        label = fps[top[i], 0].view(np.int64) ^ key[i] * 0x9E3779B1 ^ sub[i] * 0x85EBCA6B
        columns = [*(fps[x, 0].view(np.int64) for x in (i, j)), key[i], label]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["a", "b", "key", "label"])

    return by_bucket(bucketed, links, "a long, b long" + ", key long, label long" * real, HELD // words)


def block_of(key: np.ndarray) -> np.ndarray:
    return (key >> 20) & ((1 << 20) - 1)


def in_trie_order(rows: pa.Table, names: list[str]) -> tuple[np.ndarray, ...]:
    """(words, key, sub, group, order) of rows by bucket and first word."""
    fps = np.stack([rows.column(x).to_numpy().view(np.uint64) for x in names], axis=1)
    key, sub = rows.column("key").to_numpy(), rows.column("sub").to_numpy()
    group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]))))
    order = np.lexsort((fps[:, 0], group))
    return fps[order], key[order], sub[order], group[order], order


def by_bucket(bucketed: DataFrame, links: Callable[[pa.Table], pa.RecordBatch], schema: str, most: int) -> DataFrame:
    """links of whole buckets, about ``most`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most and batch.num_rows:
                key, sub = batch.column("key").to_numpy(), batch.column("sub").to_numpy()
                before = np.flatnonzero((key != key[-1]) | (sub != sub[-1]))
                last = held[-2] if len(held) > 1 and held[-2].num_rows else None
                # whole groups only; without an end of a group in this batch nothing is copied
                if len(before):
                    cut = before[-1] + 1
                elif last is not None and (last.column("key")[-1].as_py(), last.column("sub")[-1].as_py()) != (key[0], sub[0]):
                    cut = 0
                else:
                    continue
                yield links(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held, n = [batch.slice(cut)], batch.num_rows - cut
        if held:
            yield links(pa.Table.from_batches(held))

    return bucketed.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(giving_back(run), schema)


def by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, least, fresh, again) of rows sorted by a and b: least the smaller of a and its first b, fresh the first row of an a, again a
    repeated row. Nothing of an a is held but its last row, so that a node may have any number of links."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(k).to_numpy() for k in (0, 1))
        fresh = np.concatenate(([last is None or a[0] != last[0]], a[1:] != a[:-1]))
        again = ~fresh & np.concatenate(([last is not None and b[0] == last[1]], b[1:] == b[:-1]))
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), -1))
        least = np.where(at >= 0, np.minimum(a, b)[at], a[0] if last is None else last[2])
        last = a[-1], b[-1], least[-1]
        yield a, b, least, fresh, again


def large_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each node's links (a, b), both ways: its larger neighbours with the least of all and itself, and that least one with itself."""
    for a, b, least, _, again in by_node(batches):
        larger = (b > a) & ~again
        node, root = b[larger], least[larger]
        own = root[np.concatenate(([True], root[1:] != root[:-1]))] if len(root) else root
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((node, own), (root, own))], names=["a", "b"])


def small_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From what ``large_stars`` gives: each node and its smaller neighbours with the least of them. open: the node has several, or is itself the
    root of others; a table without such a row is one star for each component."""
    for a, b, least, fresh, again in by_node(batches):
        rows = ~again & (least < a)
        a, b, least, more = a[rows], b[rows], least[rows], ~fresh[rows]
        yield pa.RecordBatch.from_arrays([pa.array(np.where(more, b, a)), pa.array(least), pa.array(more)], names=["a", "b", "open"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node in links (a, b) but the roots; root is the component's least node. Large and
    small stars in turn, each round written to the shared folder. A round deals the links out twice and tells by itself if it is the last: the
    driver keeps something of every task and exchange, so few of them keep it small."""
    edges = links.filter("a <> b")
    for _ in range(rounds):
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = edges.select(F.explode(ways).alias("e")).select("e.a", "e.b")
        large = both.repartition("a").sortWithinPartitions("a", "b").mapInArrow(giving_back(large_stars), "a long, b long")
        small = large.repartition("a").sortWithinPartitions("a", "b").mapInArrow(giving_back(small_stars), "a long, b long, open boolean")
        edges = written(small, "links")
        if edges.filter("open").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def classed(prints: DataFrame, links: DataFrame, member: DataFrame | None = None) -> DataFrame:
    """(doc_id, fp0, component_id) of each row of prints (id, fp0), component_id the least id
    of the rows whose fp0 are linked. member: the components of links, if they are known."""
    classes = prints.groupBy("fp0").agg(F.min("id").alias("least"))
    member = (components(links) if member is None else member).withColumnRenamed("node", "fp0")
    named = classes.join(member, "fp0", "left").withColumn("root", F.coalesce("root", "fp0"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.select("fp0", "root").join(least, "root").select("fp0", "component_id")
    return prints.join(label, "fp0").select(F.col("id").alias("doc_id"), "fp0", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4) -> DataFrame:
    """Exact: fingerprints within ``budget`` differing bits are linked, none is missed. One row
    per row of docs: (doc_id, fp0, component_id)."""
    prints = written(fingerprints(docs, id_col, text_col, width), "prints")
    return classed(prints, trie_links(exact_buckets(prints.select("fp0").distinct(), budget), 1, budget, budget))


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th family of hashes made from one."""
    z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sketched(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, text_hash, fp0, size, b0 ... b7, words): fp0 a digest of the set of shingles of ``width`` words, the marks the parity of its shingles in 512 places, words a fingerprint for each of
    ``TABLES`` families of hashes, over the set of words: a changed word changes one of those, and five shingles of five words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n = batch.num_rows
            digests, sizes, words, marks = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros((n, TABLES), np.uint64), np.zeros((n, 8), np.uint64)
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                own = np.unique(shingle_hashes(text, width))
                digests[i], sizes[i] = xxhash.xxh64_intdigest(own.tobytes(), 42), len(own)
                single = np.unique(shingle_hashes(text, 1))
                for k in range(TABLES):
                    words[i, k] = majority(mixed(single, k))[0]
                places = np.bincount((own & np.uint64(511)).astype(np.int64), minlength=512) & 1
                marks[i] = np.packbits(places.astype(np.uint8), bitorder="little").view("<u8")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * TABLES), pa.array(words.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(digests.view(np.int64)), pa.array(sizes), *(pa.array(marks[:, k].copy().view(np.int64)) for k in range(8)), lists], names=["id", "text_hash", "fp0", "size", *MARKS, "words"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return source.mapInArrow(giving_back(run), f"id long, text_hash long, fp0 long, size long, {', '.join(f'{x} long' for x in MARKS)}, words array<long>")


def open_links(own: DataFrame, similarity: Fraction, most: int | None) -> DataFrame:
    """Candidates (a, b) in two components, from rows (t, word, fp0, root, size, marks): those that sizes and parities allow, the ``most`` nearest
    of each set in a bucket, or all. Only what is left of them leaves a task."""
    p, q = similarity.numerator, similarity.denominator
    others = ["own", "root", "size", *MARKS]

    def links(rows: pa.Table) -> pa.RecordBatch:
        fps, key, _, group, order = in_trie_order(rows, ["fp0"])
        name, root, size = (rows.column(c).to_numpy()[order] for c in others[:3])
        marks = np.stack([rows.column(c).to_numpy()[order] for c in MARKS], axis=1).view(np.uint64)
        _, first, inverse = np.unique(root, return_index=True, return_inverse=True)

        def differ(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Never more than the shingles in one set only."""
            return np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int64)

        def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            return (small * q >= large * p) & (differ(i, j) * (p + q) <= (small + large) * (q - p))

        pairs: list = []
        trie_forest(group, fps, NEAR, NEAR, pairs, allowed, block_of(key), first[inverse])
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        if most is not None and len(i):
            both, far = np.concatenate((i, j)), np.tile(differ(i, j), 2)
            at = np.lexsort((far, both))
            rank = np.arange(len(at)) - np.searchsorted(both[at], both[at])
            near = np.unique(at[rank < most] % len(i))
            i, j = i[near], j[near]
        return pa.RecordBatch.from_arrays([pa.array(name[x], pa.int64()) for x in (i, j)], names=["a", "b"])

    rows = own.select("t", F.col("word").alias("fp0"), F.col("fp0").alias("own"), *others[1:])
    return by_bucket(exact_buckets(rows, NEAR, tables=F.col("t"), others=others), links, "a long, b long", HELD // 10)


def rooted(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """pairs (a, b, ...) whose sides are in two components."""
    ra, rb = member.toDF("a", "ra"), member.toDF("b", "rb")
    return pairs.join(ra, "a", "left").join(rb, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")


def sized(pairs: DataFrame, classes: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity, each once and with a above b."""
    p, q = similarity.numerator, similarity.denominator
    once = pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    x, y = (classes.select("fp0", "size").toDF(c, f"size_{c}") for c in "ab")
    return once.join(x, "a").join(y, "b").filter(F.least("size_a", "size_b") * q >= F.greatest("size_a", "size_b") * p).select("a", "b")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, counted from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last, lead = None, None, np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            for a, b, salt, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                if (a, b, salt) == seen:  # a repeated row
                    continue
                seen = a, b, salt
                own = np.unique(shingle_hashes(text.as_py(), width))
                if a == b:
                    last, lead = (b, salt), own
                    continue
                assert last == (b, salt)
                both = len(np.intersect1d(own, lead, assume_unique=True))
                if both >= similarity * (len(own) + len(lead) - both):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(16)).alias("salt"))
    places = dealt.select(F.col("a").alias("fp0"), "b", "salt").union(dealt.select(F.col("b").alias("fp0"), "b", "salt").distinct())
    wanted = written(places.groupBy("fp0").agg(F.collect_list(F.struct("b", "salt")).alias("to")).join(classes.select("fp0", "id", "text_hash"), "fp0"), "wanted")
    source = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(id_col).cast("long").alias("own_id"), F.col(text_col).alias("text"))
    # texts that no pair needs stay where they are
    texts = perhaps(source, bitmap(wanted, "text_hash"), "text_hash").filter("perhaps").join(wanted, "text_hash").filter(F.col("own_id").eqNullSafe(F.col("id")))
    rows = texts.select("fp0", F.explode("to").alias("to"), "text").select(F.col("fp0").alias("a"), "to.b", "to.salt", "text")
    return rows.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a") != F.col("b"), "a").mapInArrow(giving_back(run), "a long, b long")


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts whose shingle sets have a Jaccard similarity of ``similarity`` or more: rows (id, text_hash,
    fp0), fp0 a digest of the set, links (a, b) between digests that hold all groups
    together, and their components. Every link is counted from the texts.

    Candidates are sets whose fingerprints in one of ``TABLES`` tables differ in ``NEAR`` bits at most; the trie join finds all of them. Of 1,531 pairs of
    different sets at 0.8 or more among 17,354 texts, 999 in 1,000 are candidates (measured with brute force). Equal fingerprints are one
    entry of a trie, with one of their sets for all, so that large groups of near copies stay small.

    Each set is first compared with one candidate, then along the links of the tries' spanning forests that still join two components; a group
    of n near copies costs about n comparisons. Where such a link is no real one, the nearest candidates of each set in its part of the tries are compared,
    and in the end all candidate pairs of two components that sizes and parities allow, so that none is left out."""
    least = Fraction(str(similarity))
    sets = written(sketched(docs, id_col, text_col, width), "sets")
    classes = written(sets.groupBy("fp0").agg(F.min(F.struct("text_hash", "id", "size", *MARKS, "words")).alias("r")).select("fp0", "r.*"), "classes")
    words = classes.select("fp0", F.posexplode("words").alias("t", "word"))
    entries = written(words.groupBy("t", "word").agg(F.min("fp0").alias("rep"), F.count("*").alias("n")), "entries")

    def reps(near: DataFrame) -> DataFrame:
        x, y = (entries.select("t", F.col("word").alias(f"w{c}"), F.col("rep").alias(c)) for c in "ab")
        return near.join(x, ["t", "wa"]).join(y, ["t", "wb"])

    same = words.join(entries.filter("n > 1"), ["t", "word"]).filter("fp0 <> rep").select("t", "word", F.col("fp0").alias("a"), F.col("rep").alias("b"))
    found = trie_links(exact_buckets(entries.select("t", F.col("word").alias("fp0")), NEAR, tables=F.col("t")), 1, NEAR, NEAR, True)
    near = written(reps(found.select(F.shiftrightunsigned("key", 40).cast("int").alias("t"), F.col("a").alias("wa"), F.col("b").alias("wb"), "label")), "near")
    edges = written(sized(same.select("a", "b").union(near.select("a", "b")), classes, least), "edges")
    tried = edges.groupBy("a").agg(F.min("b").alias("b"))
    links = written(confirmed(tried, classes, docs, id_col, text_col, width, least), "links")
    more = written(rooted(edges, components(links)).join(tried, ["a", "b"], "left_anti"), "more")
    links = written(links.union(confirmed(more, classes, docs, id_col, text_col, width, least)), "links")

    # parts of the tries in which some link joins two components yet
    member = components(links)
    split = rooted(same, member).select("t", "word").distinct()
    ends = near.select("t", F.col("wa").alias("word"), "label").union(near.select("t", F.col("wb").alias("word"), "label"))
    labels = rooted(near, member).select("label").union(ends.join(split, ["t", "word"]).select("label")).distinct()
    opened = written(ends.join(labels, "label").select("t", "word").union(split).distinct(), "opened")
    known = tried.union(more)
    for most in () if opened.isEmpty() else (4, None):
        own = words.join(opened, ["t", "word"]).join(member.toDF("fp0", "root"), "fp0", "left").join(classes.select("fp0", "size", *MARKS), "fp0")
        pairs = open_links(written(own.withColumn("root", F.coalesce("root", "fp0")), "own"), least, most)
        rest = written(sized(pairs, classes, least).join(known, ["a", "b"], "left_anti"), "rest")
        links = written(links.union(confirmed(rest, classes, docs, id_col, text_col, width, least)), "links")
        known = known.union(rest)
        member = components(links)
    return sets.select("id", "text_hash", "fp0"), links, member


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp0, component_id) of each row, by ``similar_links``."""
    sets, links, member = similar_links(docs, id_col, text_col, width, similarity)
    return classed(sets.select("id", "fp0"), links, member)


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of each group of similar texts that has the least id (of several texts with that id the one of
    the least hash). Rows equal in id and text count as one; rows of one id with texts of two groups stay both.
    Rows without an id stay. Texts of rows alone in their group are not shuffled."""
    sets, _, member = similar_links(docs, id_col, text_col)
    sets = sets.filter("id IS NOT NULL")
    own = sets.groupBy("fp0").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.count("*").alias("n"))
    named = written(own.join(member.withColumnRenamed("node", "fp0"), "fp0", "left").withColumn("root", F.coalesce("root", "fp0")), "groups")
    groups = named.groupBy("root").agg(F.min("first").alias("stays"), F.sum("n").alias("rows")).filter(F.col("rows") > 1).drop("rows")
    several = sets.join(named.join(groups, "root").select("fp0", "stays"), "fp0")
    stays = (F.col("id") == F.col("stays.id")) & (F.col("text_hash") == F.col("stays.text_hash"))
    several = written(several.select("id", "text_hash", F.xxhash64("id", "text_hash").alias("both"), stays.alias("stays")).distinct(), "several")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"))
    dealt = perhaps(rows.withColumn("both", F.xxhash64("id", "text_hash")), bitmap(several, "both"), "both")
    alone = dealt.filter("id IS NULL OR NOT perhaps").select("row")
    met = dealt.filter("id IS NOT NULL AND perhaps").drop("both", "perhaps").join(several.drop("both"), ["id", "text_hash"], "left")
    kept = met.filter("stays IS NULL OR stays").dropDuplicates(["id", "text_hash"]).select("row")
    return alone.union(kept).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
