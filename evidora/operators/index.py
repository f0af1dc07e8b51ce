"""Index tables: postings, document, term, bigram and corpus statistics, character n-grams, LSA.

Texts come as (ord, text), ord the documents' order, which breaks ties in every ranking.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.functions import text as T
from evidora.operators.latent import Latent


def searchable(title: Column, heading: Column, body: Column) -> Column:
    return F.trim(F.concat_ws(" ", title, heading, body))


def doc_tokens(docs: DataFrame) -> DataFrame:
    """(ord, own, doc_len): content tokens; a document without any counts with length 0."""
    return docs.select("ord", T.content(F.coalesce("text", F.lit(""))).alias("own")).withColumn("doc_len", F.size("own"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row (n_docs, avg_len)."""
    return tokens.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def postings(tokens: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(ord, doc_len, term, tf), of all terms or of those in ``terms`` (term) only."""
    exploded = tokens.select("ord", "doc_len", F.explode("own").alias("term"))
    if terms is not None:
        exploded = exploded.join(terms, "term", "left_semi")
    return exploded.groupBy("ord", "doc_len", "term").agg(F.count("*").alias("tf"))


def term_stats(tokens: DataFrame) -> DataFrame:
    """(term, df, cf): distinct in the row first, so only counts are shuffled."""
    return tokens.select(F.explode("own").alias("term"), "ord").groupBy("term", "ord").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


def idf(df: Column, n_docs: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.log((n_docs - df + 0.5) / (df + 0.5) + 1.0))


def term_idf(tokens: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    counts = tokens.select(F.explode(F.array_distinct("own")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counts.crossJoin(corpus_stats(tokens)).select("term", "df", idf(F.col("df"), F.col("n_docs")).alias("idf"))


def bigram_stats(tokens: DataFrame, parts: int | None = None) -> DataFrame:
    """(bigram, df). With ``parts`` bigrams are dealt out first, so that a task counts those of its part alone."""
    rows = tokens.select(F.explode(F.array_distinct(T.bigrams(F.col("own")))).alias("bigram"))
    return (rows.repartition(parts, "bigram") if parts else rows).groupBy("bigram").agg(F.count("*").alias("df"))


def char_grams(word: str, low: int = 3, high: int = 5) -> list[str]:
    """Character n-grams of a word with a blank on both sides; one that is shorter than an n gives itself
    once, and then no longer n is taken."""
    padded = f" {word} "
    if len(padded) <= low:
        return [padded]
    return [padded[i : i + n] for n in range(low, min(high, len(padded)) + 1) for i in range(len(padded) - n + 1)]


class Spelt(dict):
    """Places of words met so far, and their n-grams by place. Many words are spelt at once: an n-gram is a number of 12 bits a letter, letters numbered as they
    are met, and only distinct numbers are looked up; words with later letters are spelt one by one."""

    def __init__(self) -> None:
        self.grams: dict[str, int] = {}
        self.numbers: dict[int, int] = {}
        self.letters, self.met = np.zeros(0x110000, np.int32), 0
        self.flat, self.ends = array("i"), array("q", [0])

    def __missing__(self, word: str) -> int:
        grams = self.grams
        self.flat.extend([grams.setdefault(g, len(grams)) for g in char_grams(word)])
        self.ends.append(len(self.flat))
        self[word] = place = len(self)
        return place

    def spell(self, words: list[str]) -> None:
        """Gives new words places."""
        text = "".join([f" {w} " for w in words])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(w) + 2 for w in words], np.int64)
        if (self.letters[codes] == 0).any():
            new = np.unique(codes[self.letters[codes] == 0])
            self.letters[new] = np.arange(self.met + 1, self.met + 1 + len(new))
            self.met += len(new)
        letter = self.letters[codes].astype(np.int64)
        if letter.max(initial=0) >= 1 << 12:
            late = set(np.repeat(np.arange(len(words)), size)[letter >= 1 << 12].tolist())
            for i in sorted(late):
                self[words[i]]
            if len(late) < len(words):
                self.spell([w for i, w in enumerate(words) if i not in late])
            return
        left = np.repeat(np.cumsum(size), size) - np.arange(len(letter))
        number, table = letter[:-1] << 12 | letter[1:], np.zeros((len(letter), 3), np.int64)
        for n in range(3, min(5, len(letter)) + 1):
            number = number[:-1] << 12 | letter[n - 1 :]
            table[: len(number), n - 3] = number
        valid = left[:, None] >= np.array([3, 4, 5])
        found, first, which = np.unique(table[valid], return_index=True, return_inverse=True)
        at, n = (x[first] for x in np.nonzero(valid))
        grams, numbers = self.grams, self.numbers
        places = np.array([numbers.get(x, -1) for x in found.tolist()], np.int64)
        for i in np.flatnonzero(places < 0).tolist():
            gram = text[at[i] : at[i] + n[i] + 3]
            places[i] = numbers[int(found[i])] = grams.setdefault(gram, len(grams))
        before = len(self.flat)
        self.flat.frombytes(places[which].astype(np.int32).tobytes())
        self.ends.frombytes((before + np.cumsum(np.maximum(size[:, None] - np.array([2, 3, 4]), 0).sum(1))).tobytes())
        self.update(zip(words, range(len(self), len(self) + len(words)), strict=True))

    def counted(self, texts: list[str], most: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's distinct n-grams: (row, place of the n-gram, times), in this order. A key has the row's, the n-gram's and the times' bits, and is sorted whole."""
        which, times, size = [], [], []
        counted = [Counter(text.split(" ")) for text in texts]
        new: dict[str, None] = {}
        for i, counts in enumerate(counted, 1):
            counts.pop("", None)
            new.update(dict.fromkeys(filterfalse(self.__contains__, counts)))
            if len(new) > most or i == len(counted):
                words = list(new)
                for start in range(0, len(words), most):  # bounds what is held
                    self.spell(words[start : start + most])
                new = {}
        for counts in counted:
            which += map(self.__getitem__, counts)
            times += counts.values()
            size.append(len(counts))
        which, flat, ends = np.array(which, np.int64), np.array(self.flat, np.int32), np.array(self.ends)
        n = ends[which + 1] - ends[which]
        head = (np.repeat(np.arange(len(texts)), size) << 54) + np.array(times, np.int64)
        key = np.repeat(head, n) + (flat[np.repeat(ends[which] - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64) << 30)
        key.sort()
        times = key & ((1 << 30) - 1)
        key >>= 30
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key = key[first]
        return key >> 24, key & ((1 << 24) - 1), np.add.reduceat(times, first) if len(first) else times


def gram_parts(batches: Iterator[pa.RecordBatch], size: int = 256, held: int = 1 << 20) -> Iterator[tuple]:
    """(first column, words spelt, row, place of the n-gram, tf) of ``size`` texts at a time; tf is 1 + ln of the count. Places hold for all parts with the same
    words spelt, which are given up beyond ``held`` n-grams, or eight times as many in all words: that and the size bound what is held."""
    spelt = Spelt()
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            if len(spelt.grams) > held or len(spelt.flat) > 8 * held:
                spelt = Spelt()
            row, gram, times = spelt.counted(part.column(1).to_pylist())
            yield part.column(0), spelt, row, gram, 1 + np.log(times)


def gram_texts(docs: DataFrame) -> DataFrame:
    """(ord, text) as n-grams are taken from: lower case, single blanks; nulls are empty."""
    plain = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    return dealt(docs.select(F.col("ord").cast("long").alias("ord"), plain.alias("text")))


def dealt(rows: DataFrame) -> DataFrame:
    """rows, dealt anew if they come in fewer partitions than there are cores."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(n)


def gram_weights(docs: DataFrame) -> DataFrame:
    """(ord, grams, tf) of each text: its distinct n-grams and 1 + ln of their counts; nulls and blank texts give empty arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ords, spelt, row, gram, tf in gram_parts(batches):
            ends, names = pa.array(np.searchsorted(row, np.arange(len(ords) + 1)), pa.int32()), pa.array(list(spelt.grams), pa.string())
            arrays = [pa.ListArray.from_arrays(ends, x) for x in (names.take(pa.array(gram)), pa.array(tf))]
            yield pa.RecordBatch.from_arrays([ords, *arrays], names=["ord", "grams", "tf"])

    return gram_texts(docs).mapInArrow(run, "ord long, grams array<string>, tf array<double>")


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, df): texts are counted where they lie, and only sums are shuffled, one for each n-gram that a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, df = None, np.zeros(0, np.int64)

        def sums() -> Iterator[pa.RecordBatch]:
            names = list(last.grams)
            for i in range(0, len(names), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + (1 << 16)], pa.string()), pa.array(df[i : i + (1 << 16)])], names=["gram", "n"])

        for _, spelt, _, gram, _ in gram_parts(batches):
            if last is not None and last is not spelt:
                yield from sums()
                df = np.zeros(0, np.int64)
            last, own = spelt, np.bincount(gram, minlength=len(spelt.grams))
            own[: len(df)] += df
            df = own
        if last is not None:
            yield from sums()

    return gram_texts(docs).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("df"))


def sections(chunks: DataFrame) -> DataFrame:
    """One row per citation: its chunks' texts in order, and the first chunk's id."""
    order = F.array_sort(F.collect_list(F.struct("chunk_ord", "chunk_id", "text")))
    made = chunks.groupBy("citation").agg(order.alias("c"))
    return made.select("citation", F.col("c")[0]["chunk_id"].alias("first_chunk_id"), F.array_join(F.transform("c", lambda c: c.text), " ").alias("text"))


class Lsa:
    """Latent semantic vectors: weights log1p(tf) (ln((N+1)/(df+1)) + 1), rows of unit length, and a truncated SVD.

    All terms count, or the ``vocabulary`` most frequent by document count. Up to ``dense`` of them, one distributed pass
    gives their Gram matrix, whose eigenvectors are the right singular vectors; more go through ``passes`` of block
    iteration over the rows, which hold terms x (rank + 32) numbers on the driver and in a task. Above ``held`` terms these numbers are dealt
    out by term as well (``latent``), and ``components`` is None."""

    def __init__(self, rank: int = 128, vocabulary: int | None = None, dense: int = 2048, passes: int = 10, held: int = 1 << 14):
        self.rank, self.vocabulary, self.dense, self.passes, self.held = rank, vocabulary, dense, passes, held
        self.latent: Latent | None = None

    @staticmethod
    def _counts(docs: DataFrame) -> DataFrame:
        return doc_tokens(docs).select("ord", F.explode("own").alias("term")).groupBy("ord", "term").agg(F.count("*").alias("tf"))

    def _weights(self, docs: DataFrame) -> DataFrame:
        tfidf = self._counts(docs).join(self.terms, "term").withColumn("w", F.log1p("tf") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
        rows = tfidf.groupBy("ord").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("at", "w")))).alias("m"), norm.alias("norm"))
        return rows.filter("norm > 0").select("ord", F.transform_values("m", lambda _, w: w / F.col("norm")).alias("m"))

    def fit(self, docs: DataFrame) -> Lsa:
        from pyspark.mllib.linalg import Vectors
        from pyspark.mllib.linalg.distributed import RowMatrix
        from pyspark.sql import Window

        tokens = doc_tokens(docs)
        n, size = tokens.agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
        common = tokens.select(F.explode(F.array_distinct("own")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        if self.vocabulary is not None:
            common = common.orderBy(F.desc("df"), "term").limit(self.vocabulary)
        width = common.count()
        k = max(1, min(self.rank, n - 1, width - 1))
        self.fitted, self.latent, self.components = docs, None, None
        if width > self.held:
            self.latent = Latent(doc_tokens(dealt(docs.select("ord", "text"))), n, size, width, k, self.passes, None if self.vocabulary is None else common)
            return self
        self.terms = common.select((F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).alias("at"), "term", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
        rows = self._weights(docs)
        if width > self.dense:
            self.components = self._iterated(rows, width, k)
            return self
        matrix = RowMatrix(rows.select("m").rdd.map(lambda r: Vectors.sparse(width, sorted(r.m.items()))))
        gram = matrix.computeGramianMatrix().toArray()  # bounded: dense x dense
        self.components = np.ascontiguousarray(np.linalg.eigh(gram)[1][:, ::-1][:, :k])
        return self

    def _iterated(self, rows: DataFrame, width: int, k: int) -> np.ndarray:
        """The first k right singular vectors of the rows by block iteration from a fixed start."""
        own = rows.select(F.map_keys("m").alias("at"), F.map_values("m").alias("w")).persist()

        def gram_times(q: np.ndarray) -> np.ndarray:
            shared = rows.sparkSession.sparkContext.broadcast(q)

            def part(it):
                total = np.zeros_like(shared.value)
                for r in it:
                    at, w = np.asarray(r.at, int), np.asarray(r.w)
                    total[at] += np.outer(w, w @ shared.value[at])
                yield total

            made = own.rdd.mapPartitions(part).treeReduce(np.add)
            shared.destroy()
            return made

        q = np.linalg.qr(np.random.default_rng(7).standard_normal((width, min(width, k + 32))))[0]
        for _ in range(self.passes):
            q = np.linalg.qr(gram_times(q))[0]
        vectors = np.linalg.eigh(q.T @ gram_times(q))[1]
        own.unpersist()
        return np.ascontiguousarray(q @ vectors[:, ::-1][:, :k])

    def transform(self, docs: DataFrame) -> DataFrame:
        """(ord, vector) of unit length; texts without a known term are left out."""
        if self.latent:
            return self.latent.vectors() if docs is self.fitted else self.latent.project(self._counts(docs))
        axes = docs.sparkSession.sparkContext.broadcast(self.components)

        @F.pandas_udf("array<double>")
        def project(at: pd.Series, weight: pd.Series) -> pd.Series:
            def one(i: np.ndarray, w: np.ndarray) -> np.ndarray:
                v = np.asarray(w) @ axes.value[np.asarray(i, int)]
                return v / (np.linalg.norm(v) or 1.0)

            return pd.Series([one(i, w) for i, w in zip(at, weight, strict=True)])

        rows = self._weights(docs)
        return rows.select("ord", project(F.map_keys("m"), F.map_values("m")).alias("vector"))
