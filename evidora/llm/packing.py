"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids and an end id; longer ones than a sequence are cut, so whole sequences
come out at once and the rest are *pieces* to pack. Pieces are dealt to islands of a bounded
size. An island evolves a few packings: crossover injects whole well-filled bins of one parent
into another, bins that hold any of their pieces are dissolved, and the displaced pieces
are put back best fit, longest first. It ends at the lower bound of bins or after a fixed number of
generations. Bins with at most ``slack`` free places are final. The pieces of all others
migrate to fewer islands for the next epoch, with an elite: the length patterns of full bins, which
islands inject where they have pieces of such lengths. The last epoch is one island, whose size is
bounded as each island before it leaves a few bins open.

Null and empty texts are a document of the end id alone. Repeated rows are packed each on its own. Null
ids stay null. Other columns are ignored.
"""

from __future__ import annotations

import json
import random
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm.shared import giving_back, written
from evidora.session import table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, row long, sequence_id long, offset long, free int"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteLetters(dict):
    """For str.translate: the letters that stand for a character's UTF-8 bytes in a byte-level vocabulary."""

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        self.level = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, code: int) -> str:
        self[code] = found = self.level.pre_tokenize_str(chr(code))[0][0]
        return found


class WordTokens:
    """Encodes as the tokenizer file says. If its rules work word by word, the ids of words and of
    the stretches between white space are kept as bytes, texts in Latin letters are put
    together from these, and new words go to the tokenizer's model alone; other texts go to the
    tokenizer whole. A stretch of letters alone is a word."""

    _loaded: dict[str, WordTokens] = {}
    MOST = 250_000

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path) as f:
            rules = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = ByteLetters()
        self.known: dict[str, bytes] = {}
        self.marks = [x["content"] for x in rules["added_tokens"]]
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        split = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and len(steps) == 2 and steps[1].get("use_regex") is False
        self.words = regex.compile(steps[0]["pattern"]["Regex"]).findall if split and normal == ["NFC", "Replace", "Lowercase"] and not rules.get("post_processor") else None
        # white space that libraries may disagree on, and letters that NFC or lower case may turn into several
        self.beyond = regex.compile("[^\\x00-\\x1b\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u024f]").search

    @classmethod
    def of(cls, path: str) -> WordTokens:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        plain = [self.words is not None and not self.beyond(x) and not any(m in x for m in self.marks) for x in texts]
        cut = [x.lower().split() if p else [] for x, p in zip(texts, plain, strict=True)]
        if len(self.known) > self.MOST:
            self.known.clear()
        self._learn(set().union(*cut).difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) if p else self.whole(x) for x, p, c in zip(texts, plain, cut, strict=True)]

    def _learn(self, stretches: set[str]) -> None:
        known, model, letters, pack_ids = self.known, self.tokenizer.model.tokenize, self.letters, struct.pack

        def word_ids(word: str) -> bytes:
            ids = [t.id for t in model(word.translate(letters))]
            known[word] = made = pack_ids(f"<{len(ids)}I", *ids)
            return made

        for stretch in stretches:
            if stretch.isalpha():
                word_ids(stretch)
            elif stretch[:-1].isalpha() and not stretch[-1].isalnum():  # a word and its full stop or comma
                head, tail = stretch[:-1], stretch[-1]
                known[stretch] = (known.get(head) or word_ids(head)) + (known.get(tail) or word_ids(tail))
            else:
                known[stretch] = b"".join([known.get(w) or word_ids(w) for w in self.words(stretch)])


def tokenise(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, columns of PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordTokens.of(path).encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for doc, found in zip(part.column(0).to_pylist(), encode([x.as_py() or "" for x in part.column(1)]), strict=True):
                    ids = found + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(giving_back(run), PIECES)


class Packing:
    """Bins as lists of piece numbers, with best fit by free places."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def open(self, members: list[int]) -> None:
        self.bins.append(members)
        self.free.append(self.capacity - sum(self.lengths[i] for i in members))

    def fit(self, pieces: list[int]) -> None:
        """Best fit in the order given: the bin with the fewest free places that are enough."""
        by_free: dict[int, list[int]] = defaultdict(list)
        mask = 0
        for b, room in enumerate(self.free):
            if room:
                by_free[room].append(b)
                mask |= 1 << room
        for i in pieces:
            need = self.lengths[i]
            if rest := mask >> need:
                room = need + (rest & -rest).bit_length() - 1
                b = by_free[room].pop()
                if not by_free[room]:
                    mask ^= 1 << room
                self.bins[b].append(i)
            else:
                room, b = self.capacity, len(self.bins)
                self.bins.append([i])
                self.free.append(room)
            self.free[b] = left = room - need
            if left:
                by_free[left].append(b)
                mask |= 1 << left

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then the more uneven filling, which leaves bins to dissolve."""
        return -len(self.bins), sum(((self.capacity - f) / self.capacity) ** 2 for f in self.free)


def crossover(a: Packing, b: Packing, slack: int, draw: random.Random) -> Packing:
    """Whole well-filled bins of b into a; a's bins that share pieces with them are dissolved."""
    good = [m for m, f in zip(b.bins, b.free, strict=True) if f <= slack]
    taken = draw.sample(good, (len(good) + 1) // 2)
    inside = {i for m in taken for i in m}
    child = Packing(a.lengths, a.capacity)
    for m in taken:
        child.open(list(m))
    displaced: list[int] = []
    for m in a.bins:
        if inside.isdisjoint(m):
            child.open(list(m))
        else:
            displaced += [i for i in m if i not in inside]
    worst = sorted(range(len(child.bins)), key=child.free.__getitem__, reverse=True)[: max(1, len(child.bins) // 50)]
    gone = {b for b in worst if child.free[b] > slack}  # mutation: the emptiest bins too
    displaced += [i for b in gone for i in child.bins[b]]
    child.bins = [m for b, m in enumerate(child.bins) if b not in gone]
    child.free = [f for b, f in enumerate(child.free) if b not in gone]
    child.fit(sorted(displaced, key=lambda i: -a.lengths[i]))
    return child


def from_elite(lengths: list[int], capacity: int, elite: list[tuple[int, ...]]) -> Packing:
    """A packing that starts with each elite pattern as often as there are pieces for it."""
    have: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        have[n].append(i)
    made = Packing(lengths, capacity)
    for pattern in elite:
        need = {n: pattern.count(n) for n in pattern}
        while all(len(have[n]) >= k for n, k in need.items()):
            made.open([have[n].pop() for n in pattern])
    made.fit(sorted((i for x in have.values() for i in x), key=lambda i: -lengths[i]))
    return made


def evolve(lengths: list[int], capacity: int, slack: int, elite: list[tuple[int, ...]], seed: int, generations: int = 12, population: int = 4) -> Packing:
    bound = -(-sum(lengths) // capacity)
    draw = random.Random(seed)
    group: list[Packing] = []
    for k in range(population):
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (1 + 0.1 * k * draw.random()))
        one = Packing(lengths, capacity)
        one.fit(order)
        group.append(one)
    if elite:
        group.append(from_elite(lengths, capacity, elite))

    def settled(p: Packing) -> int:
        return sum(f <= slack for f in p.free)

    for _ in range(generations):
        group.sort(key=Packing.fitness, reverse=True)
        if len(group[0].bins) <= bound and settled(group[0]) >= len(group[0].bins) - 1:
            break
        a, b = group[0], group[1 + draw.randrange(len(group) - 1)]
        if draw.random() < 0.5:
            a, b = b, a
        child = crossover(a, b, slack, draw)
        if child.fitness() > group[-1].fitness():
            group[-1] = child
    return max(group, key=Packing.fitness)


def island_packer(capacity: int, slack: int, epoch: int, elite: list[tuple[int, ...]]):
    """The function that packs one island's pieces."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].tolist()
        best = evolve(lengths, capacity, slack, elite, seed=int(key[0]))
        sequence, offset, free = (np.zeros(len(pdf), np.int64) for _ in range(3))
        for b, members in enumerate(best.bins):
            at = 0
            for i in members:
                sequence[i], offset[i], free[i] = (epoch << 56) + (int(key[0]) << 24) + b, at, best.free[b]
                at += lengths[i]
        return pdf.drop(columns="island").assign(sequence_id=sequence, offset=offset, free=free.astype("int32"))

    return run


def pack(pieces: DataFrame, capacity: int = 4096, island: int = 6000, slack: int = 4, elites: int = 128) -> DataFrame:
    """The pieces with sequence_id and offset. Islands are dealt by ``row``, a number of each piece
    that must be stored, so that pieces of one id or none spread like any others."""
    columns = pieces.columns
    if "row" not in columns:
        pieces = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = pieces.filter(F.col("length") == capacity)
    whole = whole.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    done, rest = [whole], pieces.filter(F.col("length") < capacity)
    n, epoch, elite = rest.count(), 0, []
    while n:
        islands = -(-n // island)
        last = islands == 1 or epoch >= 8
        dealt = rest.withColumn("island", F.pmod(F.xxhash64("row", F.lit(epoch)), F.lit(islands)))

        packed = written(dealt.groupBy("island").applyInPandas(island_packer(capacity, slack, epoch, elite), PACKED), "packed")
        if last:
            done.append(packed.drop("free"))
            break
        done.append(packed.filter(F.col("free") <= slack).drop("free"))
        full = packed.filter("free = 0").groupBy("sequence_id").agg(F.sort_array(F.collect_list("length"), asc=False).alias("p"))
        elite = [tuple(r.p) for r in full.groupBy("p").count().orderBy(F.desc("count"), "p").limit(elites).collect()]
        rest = packed.filter(F.col("free") > slack).select(*pieces.columns)
        left = rest.count()
        if left > 0.9 * n:  # hardly any bin can be filled: all that is left is final
            done[-1] = packed.drop("free")
            break
        n, epoch = left, epoch + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*(c for c in columns if c != "row"), "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    pieces = tokenise(docs, path or tokenizer_path(), capacity, 1, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return pack(written(pieces, "pieces"), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
