"""Retrieval: channels, fusion, reranking, near-duplicate removal.

Queries are (query_id, query), documents (ord, chunk_id, text). Queries are a stated set; a channel gives
(query_id, ord, score, rank), rank from 1, ties by ord. Scores are rounded before ranking, so that
the order of a floating sum never decides a rank.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidora.config import Retrieval
from evidora.functions import text as T
from evidora.operators import index
from evidora.session import scratch

DIGITS = 6
DENSE = 4096  # n-grams of queries that are multiplied as a full matrix, at most
PARTS = 4  # parts of documents for each of the texts' own, so that a task's sums stay small


def top(scores: DataFrame, k: int, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The k best of each query: a window whose limit Spark applies before the shuffle."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), *order)
    return scores.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): a repeated term counts again."""
    return queries.select("query_id", F.explode(T.content(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def bm25(docs: DataFrame, terms: DataFrame, own: Retrieval = Retrieval()) -> DataFrame:
    """(query_id, ord, score) of documents that share a term; each ord once. Texts are tokenised once and dealt out by document, a row of tokens each.
    Document counts come from each row's distinct tokens, so that only sums are dealt out; the queries' terms are counted where the document lies,
    by a number in place of the term. Parts grow in number with the texts' own."""
    spark = terms.sparkSession
    rows = index.dealt(docs.select("ord", "text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS * rows.rdd.getNumPartitions())
    tokens = index.doc_tokens(rows).repartition(parts, "ord")
    wanted = terms.select("term").distinct().select("term", F.xxhash64("term").alias("number"))
    numbers = F.broadcast(wanted.union(spark.createDataFrame([("", 0)], "term string, number long")))  # '' stands for the document
    each = tokens.select("doc_len", F.explode_outer(F.concat(F.array(F.lit("")), F.array_distinct("own"))).alias("term"))
    counts = each.join(numbers, "term").groupBy("term", "number").agg(F.count("*").alias("df"), F.sum("doc_len").alias("size"))
    # conditions and no filters, and outer generators, which infer none: a filter would be pushed below the exchange and keep it from being used again
    of = lambda c: F.max(F.when(F.col("term") == "", F.col(c)))
    stats = counts.agg(of("df").alias("n_docs"), (of("size") / of("df")).alias("avg_len"))
    marked = tokens.select("ord", "doc_len", F.explode_outer("own").alias("term")).join(F.broadcast(wanted), "term")
    found = marked.groupBy("ord", "doc_len", F.col("number").alias("term")).agg(F.count("*").alias("tf"))
    numbered = terms.select("query_id", F.xxhash64("term").alias("term"), "times")
    return _weighed(found, counts.select(F.col("number").alias("term"), "df"), numbered, stats, own)


def scored(found: DataFrame, terms: DataFrame, stats: DataFrame, own: Retrieval = Retrieval()) -> DataFrame:
    """(query_id, ord, score) from the postings (ord, doc_len, term, tf) of all the queries' terms and the corpus statistics."""
    return _weighed(found, found.groupBy("term").agg(F.count("*").alias("df")), terms, stats, own)


def _gain(own: Retrieval) -> Column:
    length = F.coalesce(F.col("doc_len") / F.nullif(F.col("avg_len"), F.lit(0.0)), F.col("doc_len"))
    return F.col("idf") * F.col("tf") * (own.k1 + 1) / (F.col("tf") + own.k1 * (1 - own.b + own.b * length))


def _weights(df: DataFrame, stats: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(stats)).select("term", "avg_len", index.idf(F.col("df"), F.col("n_docs")).alias("idf"))


def _weighed(found: DataFrame, df: DataFrame, terms: DataFrame, stats: DataFrame, own: Retrieval) -> DataFrame:
    joined = found.join(F.broadcast(terms.join(_weights(df, stats), "term")), "term")  # the queries' terms: a stated set
    return joined.groupBy("query_id", "ord").agg(F.round(F.sum(F.col("times") * _gain(own)), DIGITS).alias("score"))


def best(found: DataFrame, terms: DataFrame, stats: DataFrame, k: int, own: Retrieval = Retrieval(), block: int = 1024) -> DataFrame:
    """The k best of each query, as ``top`` over the scores above 0 of ``scored``, from postings dealt out by ord, terms as numbers. A task adds up a
    document's postings for ``block`` queries at a time, and k a query leave it."""
    kind = terms.schema["query_id"].dataType
    # all columns count, so that the exchange of the postings is used again
    df = found.groupBy("term").agg(F.sum(F.when(F.col("tf") + F.col("doc_len") > 0, 1)).alias("df"))
    gains = found.join(F.broadcast(_weights(df, stats)), "term").select("ord", "term", _gain(own).cast("double").alias("gain"))
    asked = terms.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("times").alias("times"))
    part = lambda rows: gains.mapInArrow(_by_terms(rows, k, to_arrow_type(kind)), f"query_id {kind.simpleString()}, ord long, score double")
    return top(_in_blocks(asked, part, block, terms.sparkSession), k)


def _by_terms(asked: list, k: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of postings (ord, term, gain), all of a document in one task, the k best (query_id, ord, score) of each query row (query_id, terms, times)."""
    ids = pa.array([r.query_id for r in asked], kind)
    term = np.concatenate([np.array(r.terms, np.int64) for r in asked])
    order = np.argsort(term, kind="stable")
    who, times = np.repeat(np.arange(len(ids)), [len(r.terms) for r in asked])[order], np.concatenate([np.array(r.times, float) for r in asked])[order]
    known, starts = np.unique(term[order], return_index=True)
    starts = np.append(starts, len(term))
    step = max(1, (1 << 20) // len(ids))  # documents: a million scores at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not columns:
            return
        ords, term, gain = (np.concatenate(x) for x in zip(*columns, strict=True))
        at = np.minimum(np.searchsorted(known, term), len(known) - 1)
        here = np.flatnonzero(known[at] == term)
        here = here[np.lexsort((term[here], ords[here]))]  # a fixed order of sums
        ords, at, gain = ords[here], at[here], gain[here]
        docs, first = np.unique(ords, return_index=True)
        first = np.append(first, len(ords))
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        new, pairs, limit = [kept], 0, np.zeros(len(ids))
        for d in range(0, len(docs), step):
            own = docs[d : d + step]
            lo, hi = first[d], first[d + len(own)]
            size = starts[at[lo:hi] + 1] - starts[at[lo:hi]]
            slot = np.repeat(starts[at[lo:hi]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            row = np.repeat(np.arange(len(own)), np.diff(first[d : d + len(own) + 1]))
            scores = np.bincount(np.repeat(row, size) * len(ids) + who[slot], times[slot] * np.repeat(gain[lo:hi], size), len(own) * len(ids))
            scores = np.round(scores.reshape(len(own), -1), DIGITS)
            doc, q = np.nonzero((scores > 0) & (scores >= limit))
            new.append((q, own[doc], scores[doc, q]))
            pairs += len(q)
            if pairs > 1 << 18:
                kept, pairs = _best(new, k), 0
                new = [kept]
                full = np.flatnonzero(np.bincount(kept[0], minlength=len(ids)) == k)
                limit[full] = kept[2][np.searchsorted(kept[0], full, "right") - 1]
        q, found, score = _best(new, k)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(found), pa.array(score)], names=["query_id", "ord", "score"])

    return run


def sparse(docs: DataFrame, queries: DataFrame, k: int, own: Retrieval = Retrieval()) -> DataFrame:
    return top(bm25(docs, query_terms(queries), own).filter("score > 0"), k)


def feedback_terms(docs: DataFrame, queries: DataFrame, own: Retrieval = Retrieval(), n_docs: int = 3, n_terms: int = 5) -> DataFrame:
    """(query_id, term, times) of queries expanded by pseudo relevance feedback: their own terms twice, and the
    best new terms of the first documents, weighted by score, share and idf; ties by first place."""
    own_terms = query_terms(queries)
    first = top(bm25(docs, own_terms, own).filter("score > 0"), n_docs)
    tokens = index.doc_tokens(docs)
    # at most n_docs documents a query are exploded; their terms' document counts need one pass over all
    near = tokens.join(F.broadcast(first), "ord").select("query_id", "rank", "score", "doc_len", F.posexplode("own").alias("at", "term"))
    weighted = near.groupBy("query_id", "rank", "score", "doc_len", "term").agg(F.count("*").alias("c"), F.min("at").alias("at"))
    near_terms = F.broadcast(weighted.select("term").distinct())  # of n_docs documents a query
    df = tokens.select(F.explode(F.array_distinct("own")).alias("term")).join(near_terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(index.corpus_stats(tokens)).select("term", index.idf(F.col("df"), F.col("n_docs")).alias("idf"))
    gain = F.round(F.sum(F.col("score") * F.col("c") / F.col("doc_len") * F.col("idf")), DIGITS)
    new = weighted.join(own_terms, ["query_id", "term"], "left_anti").join(idf, "term")
    ranked = new.groupBy("query_id", "term").agg(gain.alias("score"), F.min(F.col("rank") * 1_000_000 + F.col("at")).alias("place"))
    best = top(ranked, n_terms, ("place", "term"))
    return own_terms.select("query_id", "term", (2 * F.col("times")).alias("times")).unionByName(best.select("query_id", "term", F.lit(1).cast("long").alias("times")))


def char_channel(docs: DataFrame, queries: DataFrame, k: int, block: int = 1024, common: int = 1 << 17) -> DataFrame:
    """Cosine of character n-gram weights, both of unit length; each ord once. Neither texts nor their n-grams are shuffled: document counts
    are stored, and the ``common`` n-grams in most documents are sent to the workers with their idf. A rarer one has an idf between two bounds,
    so a text's length lies between two as well, and a task gives only texts that may be among the k best of a query. The idf
    of their rare n-grams are then joined, and scores are exact. Queries are taken in blocks of a fixed size."""
    spark = docs.sparkSession
    path = scratch(spark, "grams")
    index.gram_counts(docs).write.parquet(path)
    counts = spark.read.schema("gram string, df long").parquet(path)
    n = docs.count()
    idf = counts.select("gram", "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    held = idf.orderBy(F.desc("df"), "gram").limit(common).collect()  # a fixed number
    bounds = (held[-1].idf if held else 1.0, math.log((1 + n) / 2) + 1)
    known = spark.sparkContext.broadcast({r.gram: r.idf for r in held})
    at = F.posexplode(F.arrays_zip("grams", "tf")).alias("at", "x")
    asked = index.gram_weights(queries.select(F.col("query_id").alias("ord"), F.col("query").alias("text")))
    by_query = asked.select("ord", at).select("ord", F.col("x.grams").alias("gram"), F.col("x.tf").alias("tf")).join(idf, "gram")
    own = by_query.groupBy("ord").agg(*(F.collect_list(c).alias(a) for c, a in (("gram", "grams"), ("idf", "idfs"), ("tf", "tfs"))))
    texts = index.gram_texts(docs)

    def part(held: list) -> DataFrame:
        found = texts.mapInArrow(_by_grams(held, k, known, bounds), "query_id long, ord long, dot double, square double, rare array<string>, tfs array<double>")
        key = ["query_id", "ord", "dot", "square"]
        rare = found.select(*key, F.explode_outer(F.arrays_zip("rare", "tfs")).alias("x")).select(*key, F.col("x.rare").alias("gram"), F.col("x.tfs").alias("tf"))
        whole = rare.join(idf.select("gram", "idf"), "gram", "left").groupBy(*key).agg(F.coalesce(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)), F.lit(0.0)).alias("more"))
        return whole.select("query_id", "ord", F.round(F.col("dot") / F.sqrt(F.col("square") + F.col("more")), DIGITS).alias("score")).filter("score > 0")

    return top(_in_blocks(own, part, block, spark), k)


def _by_grams(asked: list, k: int, known: Broadcast, bounds: tuple[float, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of texts (ord, text), those that may be among the k best of query rows (ord, grams, idfs, tfs): (query_id, ord, dot, square, rare, tfs), square
    without the n-grams ``rare``, which ``known`` lacks and whose idf lie within bounds."""
    ids = np.array([r.ord for r in asked])
    place: dict[str, int] = {}
    gram = np.array([place.setdefault(g, len(place)) for r in asked for g in r.grams])
    own = np.zeros(len(place))
    own[gram] = np.concatenate([r.idfs for r in asked])
    who = np.repeat(np.arange(len(asked)), [len(r.grams) for r in asked])
    weight = np.concatenate([(w := np.array(r.tfs) * r.idfs) / np.linalg.norm(w) for r in asked])
    order = np.argsort(gram, kind="stable")
    who, weight, starts = who[order], weight[order], np.searchsorted(gram[order], np.arange(len(place) + 1))

    def pruned(q: np.ndarray, ords: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of what may be among the k best: by the k-th best lower bound, and of scores known exactly the k best."""
        place_of = np.lexsort((-low, q))
        first = np.flatnonzero(np.diff(q[place_of], prepend=-1))
        nth = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
        limit = np.full(len(ids), -np.inf)
        limit[q[place_of[nth == k - 1]]] = low[place_of[nth == k - 1]]
        stays = high >= limit[q]
        exact = np.flatnonzero(stays & (low == high))
        best = exact[np.lexsort((ords[exact], -low[exact], q[exact]))]
        first = np.flatnonzero(np.diff(q[best], prepend=-1))
        best = best[np.arange(len(best)) - np.repeat(first, np.diff(first, append=len(best))) < k]
        return np.sort(np.concatenate((np.flatnonzero(stays & (low != high)), best)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []  # (q, ords, dots, squares, low, high, place of rare n-grams)
        lists: list[tuple] = []  # rare n-grams and tf of texts
        pairs, most = 0, 1 << 18

        def reduce() -> None:
            nonlocal kept, lists, pairs
            columns = [np.concatenate(x) for x in zip(*kept, strict=True)]
            stays = pruned(columns[0], columns[1], columns[4], columns[5])
            columns = [c[stays] for c in columns]
            used, columns[6] = np.unique(columns[6], return_inverse=True)
            lists, kept, pairs = [lists[i] for i in used], [tuple(columns)], len(stays)

        def rows() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(kept[0][0]), 4096):
                q, ords, dots, squares, _, _, at = (c[i : i + 4096] for c in kept[0])
                own_lists = [lists[j] for j in at]
                columns = [pa.array(ids[q]), pa.array(ords), pa.array(dots), pa.array(squares), pa.array([x for x, _ in own_lists], pa.list_(pa.string())), pa.array([x for _, x in own_lists], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "ord", "dot", "square", "rare", "tfs"])

        many = np.sort(np.argsort(-np.diff(starts), kind="stable")[:DENSE])  # n-grams of most queries: a full matrix
        many = many[np.diff(starts)[many] >= 8]
        slot_of, full = np.full(len(place) + 1, -1), np.zeros((len(many), len(ids)))
        slot_of[many] = np.arange(len(many))
        of = np.repeat(slot_of[:-1], np.diff(starts))
        full[of[of >= 0], who[of >= 0]] = weight[of >= 0]
        spelt, names, idf_of, place_of = None, [], np.zeros(0), np.zeros(0, np.int64)
        for column, now, row, gram, tf in index.gram_parts(batches):
            n, ords = len(column), column.to_numpy()
            if now is not spelt:
                spelt, names, idf_of, place_of = now, [], np.zeros(0), np.zeros(0, np.int64)
            new = list(islice(now.grams, len(names), None))
            names += new
            idf_of = np.concatenate((idf_of, np.array([known.value.get(g, np.nan) for g in new], float)))
            place_of = np.concatenate((place_of, np.array([place.get(g, -1) for g in new], np.int64)))
            idf = idf_of[gram]
            rare = np.isnan(idf)
            square = np.bincount(row, np.where(rare, 0.0, tf * idf) ** 2, n).astype(float)  # without entries it counts in integers
            more = np.bincount(row[rare], tf[rare] ** 2, n)
            found = place_of[gram]
            column_of = slot_of[found]
            here = column_of >= 0
            asked_for = np.zeros((n, len(many)))
            asked_for[row[here], column_of[here]] = tf[here] * own[found[here]]
            here = (found >= 0) & ~here
            at, mine = found[here], row[here]
            size = starts[at + 1] - starts[at]
            slot = np.repeat(starts[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
            dots = np.bincount(np.repeat(mine, size) * len(ids) + who[slot], weight[slot] * np.repeat(tf[here] * own[at], size), n * len(ids)).reshape(n, -1).astype(float) + asked_for @ full
            doc, q = np.nonzero(dots > 0)
            dot = dots[doc, q]
            least, greatest = (np.maximum(square + more * b * b, 1e-300)[doc] for b in bounds)
            exact = more[doc] == 0
            low, high = (np.round(dot / np.sqrt(x) * np.where(exact, 1.0, m), DIGITS) for x, m in ((greatest, 1 - 1e-9), (least, 1 + 1e-9)))
            high = np.where(exact, low, np.maximum(high, np.nextafter(low, 2.0)))  # so that equal bounds tell exact scores
            ends = np.searchsorted(row[rare], np.arange(n + 1))
            rare_gram, rare_tf = gram[rare], tf[rare]
            used, which = np.unique(doc, return_inverse=True)
            kept.append((q, ords[doc], dot, square[doc], low, high, which + len(lists)))
            lists += [([names[g] for g in rare_gram[ends[d] : ends[d + 1]]], rare_tf[ends[d] : ends[d + 1]].tolist()) for d in used]
            pairs += len(q)
            if pairs > most or len(lists) > 1 << 13:
                reduce()
                if pairs > most // 2 or len(lists) > 1 << 12:  # too many that may be: given on, which is exact too
                    yield from rows()
                    kept, lists, pairs = [], [], 0
        if kept:
            reduce()
            yield from rows()

    return run


def _best(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, ord, score) of each query; ties by ord."""
    q, ords, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ords, -score, q))
    first = np.flatnonzero(np.diff(q[order], prepend=-1))
    order = order[np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order))) < k]
    return q[order], ords[order], score[order]


def _in_blocks(queries: DataFrame, part: Callable[[list], DataFrame], block: int, spark: SparkSession) -> DataFrame:
    """The union of ``part`` over the stated queries, ``block`` rows of them at a time."""
    found, held = None, []
    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == block:
            found, held = part(held) if found is None else found.union(part(held)), []
    if held:
        found = part(held) if found is None else found.union(part(held))
    return spark.createDataFrame([], "query_id long, ord long, score double") if found is None else found


def cosine(vectors: DataFrame, queries: DataFrame, k: int, group: str | None = None, block: int = 4096) -> DataFrame:
    """The k nearest of (ord, vector[, group]) to each of the stated query vectors (query_id, vector[, group]), exactly, similarity
    above 0 only and with ``group`` among the query's group. Queries are taken in blocks of a fixed size, each a
    matrix that is sent to the workers; rows are multiplied in parts of a bounded product, and k a query leave the task."""
    names = ["query_id", "vector", *([group] if group else [])]

    def search(rows: list) -> DataFrame:
        ids = np.array([r.query_id for r in rows])
        asked = np.array([r.vector for r in rows], float)
        asked /= np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)
        groups = np.array([r[group] for r in rows]) if group else None
        step = max(1, (1 << 20) // len(ids))  # a product of a million scores at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            new, pairs, limit = [best], 0, np.zeros(len(ids))
            for part in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
                own = np.array(part.column(1).flatten(), float).reshape(part.num_rows, -1)
                own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300)
                ords = part.column(0).to_numpy()
                scores = np.round(asked @ own.T, DIGITS)
                if groups is not None:
                    scores[groups[:, None] != part.column(2).to_numpy(zero_copy_only=False)[None, :]] = -1
                q, at = np.nonzero((scores > 0) & (scores >= limit[:, None]))
                new.append((q, ords[at], scores[q, at]))
                pairs += len(q)
                if pairs > 1 << 18:
                    best, pairs = _best(new, k), 0
                    new = [best]
                    full = np.flatnonzero(np.bincount(best[0], minlength=len(ids)) == k)
                    limit[full] = best[2][np.searchsorted(best[0], full, "right") - 1]
            q, found, score = _best(new, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(found), pa.array(score)], names=["query_id", "ord", "score"])

        rows_in = vectors.filter(F.col("vector").isNotNull()).select("ord", F.col("vector").cast("array<double>"), *([group] if group else []))
        return rows_in.mapInArrow(run, "query_id long, ord long, score double")

    stated = queries.select(*names).filter(F.col("vector").isNotNull())
    return top(_in_blocks(stated, search, block, vectors.sparkSession), k)


def fuse(channels: dict[str, DataFrame], own: Retrieval = Retrieval()) -> DataFrame:
    """(query_id, ord, score, <channel>_rank): reciprocal ranks, channels added in a fixed order."""
    weights = {"sparse": own.sparse_weight, "dense": own.dense_weight, "char": own.char_weight}
    every = None
    for name, channel in channels.items():
        part = channel.select("query_id", "ord", F.lit(name).alias("channel"), "rank")
        every = part if every is None else every.union(part)
    ranks = [F.max(F.when(F.col("channel") == c, F.col("rank"))).alias(f"{c}_rank") for c in channels]
    wide = every.groupBy("query_id", "ord").agg(*ranks)
    total = F.lit(0.0)
    for c in channels:
        total = total + F.coalesce(F.lit(weights[c]) / (own.rrf_k + F.col(f"{c}_rank")), F.lit(0.0))
    return wide.withColumn("score", F.round(total, 9))


def normalised(fused: DataFrame) -> DataFrame:
    """Fused scores by the query's best."""
    return fused.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))


def rerank(fused: DataFrame, docs: DataFrame, queries: DataFrame, own: Retrieval = Retrieval(), scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(query_id, ord, chunk_id, text, score) and the channels' ranks. 'heuristic' adds coverage of the searched text, density of
    the chunk and a bonus for a definition; 'none' keeps fused scores; 'scorer' gives the first ``rerank_pool`` its own
    scores and puts the rest below them in fused order."""
    texts = docs.select("ord", "chunk_id", "text", (F.col("indexed") if "indexed" in docs.columns else F.col("text")).alias("indexed"))
    rows = texts.join(F.broadcast(fused), "ord").join(queries, "query_id")  # pools of a stated set of queries
    if own.reranker == "scorer" and scorer is not None:
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
        ranked = rows.withColumn("fused_rank", F.row_number().over(by))
        head = F.when(F.col("fused_rank") <= own.rerank_pool, scorer(F.col("query"), F.col("indexed")))
        floor = F.min("head").over(Window.partitionBy("query_id")) - 1
        return ranked.withColumn("head", head).withColumn("score", F.coalesce("head", floor)).withColumn("tail", F.when(F.col("head").isNull(), F.col("fused_rank")).otherwise(0)).drop("head", "fused_rank")
    rows = normalised(rows)
    if own.reranker == "none":
        return rows
    asked = T.content_set(F.col("query"))
    term = T.definitional_target(F.col("query"))
    bonus = F.when(term.isNotNull() & T.definitional_match(F.coalesce(term, F.lit("x")), F.col("indexed")), 0.8).otherwise(0.0)
    score = F.col("score") + 0.6 * T.coverage(asked, T.content_set(F.col("indexed"))) + 0.15 * T.factual_density(F.col("text")) + bonus
    return rows.withColumn("score", F.round(score, DIGITS))


def drop_near(ranked: DataFrame, k: int, threshold: float = 0.8) -> DataFrame:
    """The first k of each query of which none is near (Jaccard of content tokens) one kept before: a fold over
    the query's bounded pool of candidates, best first."""
    extra = [c for c in ranked.columns if c not in ("query_id", "score", "chunk_id", "query", "indexed", "text", "own", "tail")]
    tail = F.col("tail") if "tail" in ranked.columns else F.lit(0)
    item = F.struct((-F.col("score")).alias("order"), tail.alias("tail"), "chunk_id", "score", T.content_set(F.col("text")).alias("own"), *extra)
    pools = ranked.select("query_id", item.alias("item")).groupBy("query_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    empty = F.filter("items", lambda c: F.lit(False))
    kept = F.aggregate("items", empty, lambda acc, c: F.when(F.exists(acc, lambda a: T.jaccard(a.own, c.own) >= threshold), acc).otherwise(F.concat(acc, F.array(c))))
    return pools.select("query_id", F.posexplode(F.slice(kept, 1, k)).alias("at", "c")).select("query_id", (F.col("at") + 1).alias("rank"), "c.chunk_id", "c.score", *(f"c.{x}" for x in extra))


def search(docs: DataFrame, queries: DataFrame, own: Retrieval = Retrieval(), dense: DataFrame | None = None, scorer: Callable[[Column, Column], Column] | None = None, feedback: bool = False) -> DataFrame:
    """The whole chain over (ord, chunk_id, text[, indexed]): channels by mode, fusion, reranking, near-duplicate removal, and a
    low-confidence flag. ``dense`` is a ready channel (query_id, ord, rank)."""
    channels: dict[str, DataFrame] = {}
    body = docs.select("ord", (F.col("indexed") if "indexed" in docs.columns else F.col("text")).alias("text"))
    if own.mode in ("hybrid", "sparse"):
        terms = feedback_terms(body, queries, own) if feedback else query_terms(queries)
        channels["sparse"] = top(bm25(body, terms, own).filter("score > 0"), own.pool)
    if own.mode in ("hybrid", "dense") and dense is not None:
        channels["dense"] = dense
    if own.mode == "hybrid" and own.char_weight:
        channels["char"] = char_channel(body, queries, own.pool)
    found = drop_near(rerank(fuse(channels, own), docs, queries, own, scorer), own.k, own.dedup)
    return found.withColumn("low_confidence", low_confidence(F.max("score").over(Window.partitionBy("query_id")), own))


def low_confidence(best: Column, own: Retrieval = Retrieval()) -> Column:
    """Whether a query's best score is too low; a query without evidence (null) is."""
    limit = own.low_confidence_scorer if own.reranker == "scorer" else own.low_confidence
    return F.coalesce(best < limit, F.lit(True))
