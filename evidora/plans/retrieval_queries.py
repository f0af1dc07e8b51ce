"""Queries on index tables, retrieval channels, fusion, reranking and near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora import config as C
from evidora.config import Retrieval
from evidora.functions import stats
from evidora.functions import text as T
from evidora.operators import index, retrieve
from evidora.operators.segments import SegmentedIndex
from evidora.plans import sql as S
from evidora.session import scratch, table

OWN = Retrieval()
BIGRAM_CHARS = 1 << 23  # characters of text for each task that counts bigrams


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.col("doc_id").isNotNull())
    return d.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items that share tokens, by an equi-join on the token and not a cross join."""
    own = table(spark, sf_dir, "benchmark").select("item_id", T.content_set(F.col("text")).alias("t"))
    rows = own.select("item_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    a, b = rows.alias("a"), rows.alias("b")
    shared = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.item_id") < F.col("b.item_id")))
    counts = shared.groupBy(F.col("a.item_id").alias("item_a"), F.col("b.item_id").alias("item_b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count("*").alias("s"))
    return counts.select("item_a", "item_b", F.round(F.col("s") / (F.col("na") + F.col("nb") - F.col("s")), 6).alias("jaccard"))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_stats(index.doc_tokens(docs(spark, sf_dir)))


def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_idf(index.doc_tokens(docs(spark, sf_dir))).select("term", "df", F.round("idf", 6).alias("idf"))


def specific_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_idf(index.doc_tokens(docs(spark, sf_dir))).filter(F.round("idf", 9) >= OWN.min_idf).select("term", F.round("idf", 6).alias("idf"))


def bigram_low_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bigrams are in so few documents, by number of documents."""
    own = docs(spark, sf_dir)
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BIGRAM_CHARS + 1)
    return index.bigram_stats(index.doc_tokens(own), parts).filter(F.col("df") < OWN.low_bigram_df).groupBy("df").agg(F.count("*").alias("n_bigrams"), F.min("bigram").alias("first"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.sparse(docs(spark, sf_dir), items(spark, sf_dir), 10)
    return found.select(F.col("query_id").alias("item_id"), F.col("ord").alias("doc_id"), "score", "rank")


def bm25_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index: built over 98 in 100 documents, some of them in an older text, and then brought up to date."""
    every = docs(spark, sf_dir)
    part = F.pmod("ord", F.lit(100))
    older = every.filter(part != 7).withColumn("text", F.when(part == 8, F.concat(F.coalesce("text", F.lit("")), F.lit(" earlier edition"))).otherwise(F.col("text")))
    ords = F.when(part == 9, F.array(F.col("ord"), -F.col("ord") - 1)).otherwise(F.array("ord"))
    stored = SegmentedIndex(spark, scratch(spark, "segments"))
    stored.update(older.select(F.explode(ords).alias("ord"), "text"))
    stored.update(every)
    found = stored.search(items(spark, sf_dir), 10)
    return found.select(F.col("query_id").alias("item_id"), F.col("ord").alias("doc_id"), "score", "rank")


def prf_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.feedback_terms(docs(spark, sf_dir), items(spark, sf_dir))
    return found.select(F.col("query_id").alias("item_id"), "term", "times")


def char_ngram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.char_channel(docs(spark, sf_dir), items(spark, sf_dir), 10)
    return found.select(F.col("query_id").alias("item_id"), F.col("ord").alias("doc_id"), "score", "rank")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"), "label")


def asked(v: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return v.filter("ord % 50 = 0").withColumnRenamed("ord", "query_id")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return retrieve.cosine(v, asked(v), 10).select("query_id", F.col("ord").alias("vec_id"), "score", "rank")


def cosine_topk_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return retrieve.cosine(v, asked(v), 5, group="label").select("query_id", F.col("ord").alias("vec_id"), "score", "rank")


def recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the first other vector with the query's label, among the nearest eleven."""
    v = vectors(spark, sf_dir)
    near = retrieve.cosine(v, asked(v), 11).filter("query_id <> ord")
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    labels = v.select("ord", F.col("label").alias("found"))
    hits = ranked.join(labels, "ord").join(asked(v).select("query_id", F.col("label").alias("wanted")), "query_id").filter("found = wanted")
    gold = asked(v).select("query_id").join(hits.groupBy("query_id").agg(F.min("r").alias("gold")), "query_id", "left")
    g = F.coalesce("gold", F.lit(1_000_000))
    return gold.agg(F.count("*").alias("n"), F.round(stats.at_rank(g, 1), 6).alias("r1"), F.round(stats.at_rank(g, 5), 6).alias("r5"), F.round(stats.at_rank(g, 10), 6).alias("r10"), F.round(stats.mean_reciprocal_rank(g), 6).alias("mrr10"), F.round(stats.ndcg(g), 6).alias("ndcg10"))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and character channels fused with weights 0.5 each."""
    d, q = docs(spark, sf_dir), items(spark, sf_dir)
    own = Retrieval(char_weight=0.5)
    return retrieve.fuse({"sparse": retrieve.sparse(d, q, own.pool), "char": retrieve.char_channel(d, q, own.pool)}, own)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select(F.col("query_id").alias("item_id"), F.col("ord").alias("doc_id"), "sparse_rank", "char_rank", "score")


def heuristic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = docs(spark, sf_dir), items(spark, sf_dir)
    pool = retrieve.fuse({"sparse": retrieve.sparse(d, q, OWN.pool)})
    ranked = retrieve.rerank(pool, d, q)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.select(F.col("query_id").alias("item_id"), F.col("ord").alias("doc_id"), "score", retrieve.low_confidence(best).alias("low_confidence"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain with words and characters, near-duplicates dropped: evidence of each item."""
    d, q = docs(spark, sf_dir), items(spark, sf_dir)
    found = retrieve.search(d, q, Retrieval(char_weight=0.25))
    return found.select(F.col("query_id").alias("item_id"), "rank", "chunk_id", "score", "sparse_rank", "char_rank", "low_confidence")


def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's pool of BM25 candidates without near-duplicates of better ones."""
    d, q = docs(spark, sf_dir), items(spark, sf_dir)
    pool = d.join(F.broadcast(retrieve.sparse(d, q, OWN.pool)), "ord").drop("rank")
    return retrieve.drop_near(pool, OWN.pool).select(F.col("query_id").alias("item_id"), "rank", "chunk_id")


def lsa_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest documents in latent space; signs and rotations of an SVD have no SQL."""
    d = docs(spark, sf_dir)
    q = items(spark, sf_dir)
    lsa = index.Lsa().fit(d)
    near = retrieve.cosine(lsa.transform(d), lsa.transform(q.select(F.col("query_id").alias("ord"), F.col("query").alias("text"))).withColumnRenamed("ord", "query_id"), 10)
    return near.select(F.col("query_id").alias("item_id"), F.col("ord").alias("doc_id"), "rank")


QUERIES = {f.__name__: f for f in (
    jaccard_pairs, term_stats, bm25_idf, specific_vocab, bigram_low_df, bm25_topk, bm25_segments, prf_expand, char_ngram_topk, cosine_topk, cosine_topk_by_label,
    recall_mrr_ndcg, rrf_fusion, heuristic_rerank, hybrid_search, dedup_greedy, lsa_topk,
)}

BASE = f"""d AS (SELECT doc_id, coalesce(text, '') AS text, {S.content("coalesce(text, '')")} AS c FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT count(*) AS n, avg(len(c)) AS avg_len FROM d),
p AS (SELECT doc_id, len(c) AS len, term, count(*) AS tf FROM (SELECT doc_id, c, unnest(c) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term),
i AS (SELECT term, df, cf, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5) + 1)) AS idf FROM f, n),
q AS (SELECT item_id, text AS query, {S.content('text')} AS qc FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(qc) AS term FROM q) GROUP BY ALL)"""


def bm25_sql(name: str, terms: str) -> str:
    return f"""{name} AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT item_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM {terms} JOIN p USING (term) JOIN i USING (term), n GROUP BY item_id, doc_id) WHERE score > 0)"""


CHARS = r"""
w AS (SELECT kind, id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) || ' ' AS w FROM (SELECT 'd' AS kind, doc_id AS id, text FROM d UNION ALL SELECT 'q', item_id, query FROM q)),
g0 AS (SELECT kind, id, unnest(list_concat(
  CASE WHEN length(w) <= 3 THEN [w] ELSE list_transform(range(1, length(w) - 1), lambda k: substring(w, k, 3)) END,
  list_concat(CASE WHEN length(w) < 4 THEN [] ELSE list_transform(range(1, length(w) - 2), lambda k: substring(w, k, 4)) END,
  CASE WHEN length(w) < 5 THEN [] ELSE list_transform(range(1, length(w) - 3), lambda k: substring(w, k, 5)) END))) AS gram FROM w),
g1 AS (SELECT kind, id, gram, 1 + ln(count(*)) AS tf FROM g0 GROUP BY ALL),
gi AS (SELECT gram, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM g1 WHERE kind = 'd' GROUP BY gram),
g2 AS (SELECT kind, id, gram, tf * idf AS w FROM g1 JOIN gi USING (gram)),
gn AS (SELECT kind, id, sqrt(sum(w * w)) AS norm FROM g2 GROUP BY ALL),
ch AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT a.id AS item_id, b.id AS doc_id, round(sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)), 6) AS score
  FROM g2 a JOIN g2 b ON a.gram = b.gram AND a.kind = 'q' AND b.kind = 'd' JOIN gn x ON x.kind = 'q' AND x.id = a.id JOIN gn y ON y.kind = 'd' AND y.id = b.id GROUP BY ALL) WHERE score > 0)"""

PRF = f"""{bm25_sql('b1', 'qt')},
pw AS (SELECT item_id, term, round(sum(score * tf / len * idf), 6) AS weight, min(rank * 1000000 + list_position(c, term) - 1) AS place
  FROM (SELECT * FROM b1 WHERE rank <= 3) JOIN p USING (doc_id) JOIN d USING (doc_id) JOIN i USING (term)
  WHERE (item_id, term) NOT IN (SELECT item_id, term FROM qt) GROUP BY item_id, term)"""

COSINE = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, a.label AS wanted, b.label AS found, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0)"""


def _rerank_sql(fused: str) -> str:
    own = "list_distinct(qc)"
    target = f"regexp_extract(query, {S.quoted('(?i)' + C.DEFINITIONAL)}, 1)"
    return f"""(SELECT item_id, doc_id, sparse_rank, char_rank, round(score / max(score) OVER (PARTITION BY item_id) + 0.6 * {S.coverage(own, 'list_distinct(c)')} + 0.15 * {S.density('text', 'c')}
  + CASE WHEN {target} <> '' THEN NULL ELSE 0.0 END, 6) AS score, list_distinct(c) AS c FROM {fused} JOIN d USING (doc_id) JOIN q USING (item_id))"""


def _dedup_sql(ranked: str, k: int) -> str:
    """A fold over lists of candidates, best first; ``ranked`` has item_id, chunk_id, score, c."""
    near = S.jaccard("a.c", "x.c")
    return f"""l AS (SELECT item_id, list({{'chunk_id': chunk_id, 'score': score, 'c': c}} ORDER BY score DESC, chunk_id) AS r FROM {ranked} GROUP BY item_id),
k AS (SELECT item_id, list_reduce(list_transform(r, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda a: {near.replace('x.c', 'y[1].c')} >= 0.8)) > 0 THEN acc ELSE list_concat(acc, y) END)[1:{k}] AS r FROM l),
o AS (SELECT item_id, unnest(range(1, len(r) + 1)) AS rank, unnest(r) AS x FROM k)"""


ORACLES = {
    "jaccard_pairs": f"WITH b AS (SELECT item_id, list_distinct({S.content('text')}) AS t FROM benchmark) SELECT a.item_id AS item_a, b.item_id AS item_b, round({S.jaccard('a.t', 'b.t')}, 6) AS jaccard FROM b a JOIN b ON a.item_id < b.item_id WHERE len(list_intersect(a.t, b.t)) > 0",
    "term_stats": f"WITH {BASE} SELECT term, df, cf FROM f",
    "bm25_idf": f"WITH {BASE} SELECT term, df, round(idf, 6) AS idf FROM i",
    "specific_vocab": f"WITH {BASE} SELECT term, round(idf, 6) AS idf FROM i WHERE round(idf, 9) >= 2.5",
    "bigram_low_df": f"WITH {BASE}, g AS (SELECT bigram, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(c)), lambda k: c[k] || ' ' || c[k + 1])) AS bigram FROM d) GROUP BY bigram) SELECT df, count(*) AS n_bigrams, min(bigram) AS first FROM g WHERE df < 5 GROUP BY df",
    "bm25_topk": f"WITH {BASE}, {bm25_sql('b', 'qt')} SELECT item_id, doc_id, score, rank FROM b WHERE rank <= 10",
    "bm25_segments": f"WITH {BASE}, {bm25_sql('b', 'qt')} SELECT item_id, doc_id, score, rank FROM b WHERE rank <= 10",
    "prf_expand": f"WITH {BASE}, {PRF} SELECT item_id, term, 2 * times AS times FROM qt UNION ALL SELECT item_id, term, 1 FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, place, term) AS r FROM pw) WHERE r <= 5",
    "char_ngram_topk": f"WITH {BASE}, {CHARS} SELECT item_id, doc_id, score, rank FROM ch WHERE rank <= 10",
    "cosine_topk": f"WITH {COSINE} SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10",
    "cosine_topk_by_label": f"WITH {COSINE} SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0 AND wanted = found) WHERE rank <= 5",
    "recall_mrr_ndcg": f"""WITH {COSINE}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) WHERE rank <= 11),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM t WHERE query_id <> vec_id),
g AS (SELECT vec_id AS query_id, coalesce((SELECT min(r) FROM r WHERE r.query_id = v.vec_id AND wanted = found), 1000000) AS g FROM v WHERE vec_id % 50 = 0)
SELECT count(*) AS n, round(avg(CAST(g <= 1 AS INT)), 6) AS r1, round(avg(CAST(g <= 5 AS INT)), 6) AS r5, round(avg(CAST(g <= 10 AS INT)), 6) AS r10,
  round(avg(CASE WHEN g <= 10 THEN 1.0 / g ELSE 0 END), 6) AS mrr10, round(avg(CASE WHEN g <= 10 THEN 1.0 / log2(g + 1) ELSE 0 END), 6) AS ndcg10 FROM g""",
    "rrf_fusion": f"""WITH {BASE}, {bm25_sql('b', 'qt')}, {CHARS}
SELECT item_id, doc_id, b.rank AS sparse_rank, c.rank AS char_rank, round(coalesce(0.5 / (60 + b.rank), 0.0) + coalesce(0.5 / (60 + c.rank), 0.0), 9) AS score
FROM (SELECT * FROM b WHERE rank <= 32) b FULL JOIN (SELECT * FROM ch WHERE rank <= 32) c USING (item_id, doc_id)""",
    "heuristic_rerank": f"""WITH {BASE}, {bm25_sql('b', 'qt')}, z AS (SELECT item_id, doc_id, rank AS sparse_rank, NULL AS char_rank, round(0.5 / (60 + rank), 9) AS score FROM b WHERE rank <= 32)
SELECT item_id, doc_id, score, max(score) OVER (PARTITION BY item_id) < 0.15 AS low_confidence FROM {_rerank_sql('z')}""",
    "hybrid_search": f"""WITH {BASE}, {bm25_sql('b', 'qt')}, {CHARS},
z AS (SELECT item_id, doc_id, b.rank AS sparse_rank, c.rank AS char_rank, round(coalesce(0.5 / (60 + b.rank), 0.0) + coalesce(0.25 / (60 + c.rank), 0.0), 9) AS score
FROM (SELECT * FROM b WHERE rank <= 32) b FULL JOIN (SELECT * FROM ch WHERE rank <= 32) c USING (item_id, doc_id)),
y AS (SELECT *, CAST(doc_id AS VARCHAR) AS chunk_id FROM {_rerank_sql('z')}), {_dedup_sql('y', 8)}
SELECT o.item_id, o.rank, o.x.chunk_id AS chunk_id, y.score, sparse_rank, char_rank, max(y.score) OVER (PARTITION BY o.item_id) < 0.15 AS low_confidence FROM o JOIN y ON o.item_id = y.item_id AND o.x.chunk_id = y.chunk_id""",
    "dedup_greedy": f"""WITH {BASE}, {bm25_sql('b', 'qt')}, y AS (SELECT item_id, CAST(doc_id AS VARCHAR) AS chunk_id, score, list_distinct(c) AS c FROM b JOIN d USING (doc_id) WHERE rank <= 32), {_dedup_sql('y', 32)}
SELECT item_id, rank, x.chunk_id AS chunk_id FROM o""",
}
