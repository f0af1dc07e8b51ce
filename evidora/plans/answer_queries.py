"""Queries on claims, grounding and answer versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora import config as C
from evidora.functions import text as T
from evidora.operators import claims, retrieve
from evidora.plans import retrieval_queries as R
from evidora.plans import sql as S
from evidora.session import scratch, table


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = R.docs(spark, sf_dir), R.items(spark, sf_dir)
    near = d.join(F.broadcast(retrieve.sparse(d, q, 5)), "ord").join(q, "query_id")
    return near.select("query_id", "query", "rank", F.concat("chunk_id", F.lit(" §1")).alias("citation"), "text")


def stored_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, searched once and stored below spark.checkpoint.dir, for queries that read it more than once: five rows an item."""
    rows, path = evidence(spark, sf_dir), scratch(spark, "evidence")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def lexical_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = claims.claims(evidence(spark, sf_dir))
    return found.select(F.col("query_id").alias("item_id"), "rank", "citation", F.md5(F.col("claim").cast("binary")).alias("claim"))


def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = claims.best_sentences(evidence(spark, sf_dir))
    passes = claims.relevant(F.col("own"), T.content_set(F.col("sentence")))
    return found.select(F.col("query_id").alias("item_id"), "rank", F.round("covered", 6).alias("covered"), passes.alias("relevant"))


def anaphoric_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that open with a reference, with the sentence before, counted per document."""
    s = R.docs(spark, sf_dir).select(F.col("ord").alias("doc_id"), T.sentences(F.col("text")).alias("s"))
    rows = s.select("doc_id", "s", F.posexplode("s").alias("at", "x")).filter(T.needs_context(F.col("x")) & (F.col("at") > 0))
    return rows.select("doc_id", F.col("at").alias("pos"), F.md5(F.concat_ws(" ", F.get("s", F.col("at") - 1), "x").cast("binary")).alias("claim"))


def claimed(found: DataFrame) -> DataFrame:
    """A claim of each item with its evidence's citations and one that names no document."""
    rows = found.filter("rank <= 3")
    return rows.groupBy(F.col("query_id").alias("claim_id"), F.col("query").alias("claim")).agg(F.concat(F.array_sort(F.collect_list("citation")), F.array(F.concat(F.lit("none "), F.col("query_id").cast("string"), F.lit(" §9")))).alias("citations"))


def sections(spark: SparkSession, sf_dir: str, named: DataFrame) -> DataFrame:
    """The sections that claims name, found where they lie: other texts are not dealt out."""
    every = R.docs(spark, sf_dir).select(F.concat("chunk_id", F.lit(" §1")).alias("citation"), "text")
    return every.join(F.broadcast(named.select(F.explode("citations").alias("citation")).distinct()), "citation", "left_semi")


def verified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = claimed(stored_evidence(spark, sf_dir))
    return claims.verify(rows, sections(spark, sf_dir, rows))


def grounding_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = verified(spark, sf_dir)
    return kept.select("claim_id", F.array_join("citations", "|").alias("citations"), F.round("support", 6).alias("support"), "supported")


def fabricated_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir)[1]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers of a session, a claim for each line."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    made = turns.withColumn("claims", F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != ""), lambda x: F.struct(x.alias("text"), F.array(F.concat(F.lit("c"), F.length(x).cast("string"))).alias("citations"))))
    return made.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created"), "text", "claims")


def answer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.versions(answers(spark, sf_dir))
    cited = claims.union_citations(F.col("claims"), F.lit(None).cast("array<string>"))
    return rows.select("session_id", "created", "version", "parent_version", F.array_join(cited, "|").alias("citations"))


def merge_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer merged into the one before it. A greedy fold with its own state: checked in the tests."""
    from pyspark.sql import Window

    by = Window.partitionBy("session_id").orderBy("created")
    rows = answers(spark, sf_dir).withColumn("prior", F.lag("claims").over(by)).filter("prior IS NOT NULL")
    out = claims.merged(F.col("prior"), F.col("claims"))
    return rows.select("session_id", "created", F.size("prior").alias("n_prior"), F.size("claims").alias("n_new"), F.size(out).alias("n_merged"), F.array_join(claims.union_citations(out, F.flatten(F.transform("prior", lambda c: c.citations))), "|").alias("citations"))


INSTRUCTIONS = ["repeat that in two bullets", "give me the list", "say it in 1 sentence", "someone please rephrase", "shorter"]


def restructure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).select("session_id", "created", "claims", F.explode(F.array(*map(F.lit, INSTRUCTIONS))).alias("instruction"))
    return rows.select("session_id", "created", "instruction", F.md5(claims.reformat(F.col("claims"), F.col("instruction")).cast("binary")).alias("answer"))


def logistic_gate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic with stated weights over the features of each item's best evidence."""
    rows = evidence(spark, sf_dir).filter("rank = 1").select("query_id", T.content_set(F.col("query")).alias("q"), T.content_set(F.col("text")).alias("t"), T.factual_density(F.col("text")).alias("density"))
    p = claims.gate_probability([T.coverage(F.col("q"), F.col("t")), T.jaccard(F.col("q"), F.col("t")), F.col("density")], [0.5, 0.1, 0.0], [0.25, 0.1, 1.0], [1.5, 0.5, -0.2], 0.3)
    return rows.select(F.col("query_id").alias("item_id"), F.round(p, 6).alias("p"), (p >= 0.4).alias("asserted"))


QUERIES = {f.__name__: f for f in (lexical_claim, relevance_gate, anaphoric_context, grounding_verify, fabricated_citations, answer_versions, merge_claims, restructure, logistic_gate_score)}

_BASE = f"{R.BASE}, {R.bm25_sql('b', 'qt')}, e AS (SELECT item_id, query, list_distinct(qc) AS own, rank, doc_id || ' §1' AS citation, text, list_distinct(c) AS c FROM b JOIN d USING (doc_id) JOIN q USING (item_id) WHERE rank <= 5)"
_BEST = f"""{_BASE}, s0 AS (SELECT *, {S.sentences('text')} AS s FROM e), s1 AS (SELECT item_id, own, rank, citation, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS pos FROM s0),
s2 AS (SELECT *, list_distinct({S.content('x')}) AS xc FROM s1), s3 AS (SELECT *, CASE WHEN len(xc) = 0 THEN -1.0 ELSE {S.coverage('own', 'xc')} END AS covered FROM s2),
s4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, rank ORDER BY covered DESC, pos) AS r FROM s3) WHERE r = 1),
s5 AS (SELECT *, len(list_intersect(own, xc)) AS shared, len(own) AS n FROM s4),
s6 AS (SELECT *, n > 0 AND shared / n >= CASE WHEN n <= 3 THEN 0.2 ELSE greatest(0.12, 0.2 - 0.02 * (n - 3)) END AND shared >= least(2, n) AS relevant FROM s5)"""
_CLAIMS = f"{_BASE}, cl AS (SELECT claim_id, claim, list_concat(cs, ['none ' || claim_id || ' §9']) AS cs FROM (SELECT item_id AS claim_id, query AS claim, list(citation ORDER BY citation) AS cs FROM e WHERE rank <= 3 GROUP BY item_id, query)), ce AS (SELECT claim_id, claim, unnest(cs) AS citation FROM cl), se AS (SELECT doc_id || ' §1' AS citation, list_distinct(c) AS found FROM d)"
_ANSWERS = "a AS (SELECT conv_id AS session_id, turn AS created, list_filter(string_split(coalesce(min(text), ''), chr(10)), lambda x: x <> '') AS cl FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn)"
_SUPPORT = f"len(list_filter({S.content('claim')}, lambda x: list_contains(found, x))) / greatest(len({S.content('claim')}), 1)"

ORACLES = {
    "lexical_claim": f"WITH {_BEST} SELECT item_id, rank, citation, md5(x) AS claim FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS f FROM s6 WHERE relevant) WHERE f = 1",
    "relevance_gate": f"WITH {_BEST} SELECT item_id, rank, round(covered, 6) AS covered, relevant FROM s6",
    "anaphoric_context": f"WITH d AS (SELECT doc_id, {S.sentences(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS s FROM documents WHERE doc_id IS NOT NULL), x AS (SELECT doc_id, s, unnest(s) AS x, unnest(range(0, len(s))) AS pos FROM d) SELECT doc_id, pos, md5(s[pos] || ' ' || x) AS claim FROM x WHERE pos > 0 AND regexp_matches(ltrim(x), {S.quoted('(?i)' + C.NEEDS_CONTEXT)})",
    "grounding_verify": f"WITH {_CLAIMS} SELECT claim_id, string_agg(citation, '|' ORDER BY citation) AS citations, round(max({_SUPPORT}), 6) AS support, max({_SUPPORT}) >= 0.6 AS supported FROM ce JOIN se USING (citation) GROUP BY claim_id",
    "fabricated_citations": f"WITH {_CLAIMS} SELECT claim_id, citation FROM ce WHERE citation NOT IN (SELECT citation FROM se)",
    "answer_versions": f"WITH {_ANSWERS} SELECT session_id, created, row_number() OVER w AS version, nullif(row_number() OVER w - 1, 0) AS parent_version, array_to_string(list_sort(list_distinct(list_transform(cl, lambda x: 'c' || length(x)))), '|') AS citations FROM a WINDOW w AS (PARTITION BY session_id ORDER BY created)",
    "restructure": f"""WITH {_ANSWERS}, i AS (SELECT *, unnest({S.words(INSTRUCTIONS)}) AS instruction FROM a),
n AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(instruction, '\\b(\\d+)\\b', 1), '') AS INT), CASE WHEN contains(instruction, 'four') THEN 4 WHEN contains(instruction, 'three') THEN 3 WHEN contains(instruction, 'two') THEN 2 WHEN contains(instruction, 'single') OR contains(instruction, 'one') THEN 1 END, len(cl)) AS k FROM i)
SELECT session_id, created, instruction, md5(CASE WHEN regexp_matches(instruction, 'bullet|point|list') THEN array_to_string(list_transform(cl[1:k], lambda x: '• ' || x || ' [c' || length(x) || ']'), chr(10)) ELSE array_to_string(cl[1:k], ' ') END) AS answer FROM n""",
    "logistic_gate_score": f"""WITH {_BASE}, z AS (SELECT e.item_id, {S.coverage('own', 'e.c')} AS a, {S.jaccard('own', 'e.c')} AS b, {S.density('e.text', 'd.c')} AS f FROM e JOIN d ON e.citation = d.doc_id || ' §1' WHERE rank = 1),
pr AS (SELECT item_id, 1 / (1 + exp(-(0.3 + 1.5 * (a - 0.5) / 0.25 + 0.5 * (b - 0.1) / 0.1 + -0.2 * f))) AS p FROM z) SELECT item_id, round(p, 6) AS p, p >= 0.4 AS asserted FROM pr""",
}
