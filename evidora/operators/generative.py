"""Answers written by a model: parsing, checking and merging what it returns.

A model is any callable (prompt) -> text, applied on the executors. Nothing it says is trusted: claims must cite evidence
they were given, must not contradict its numbers, and must be supported by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from evidora.functions import text as T

CLAIMS = "struct<claims:array<struct<text:string,citations:array<string>>>>"
PLAN = "array<struct<claim_id:string,action:string,text:string>>"


def complete(prompts: DataFrame, model: Callable[[str], str], retries: int = 1) -> DataFrame:
    """prompts (.., prompt) with the model's reply; a call that fails after its retries gives null."""

    def ask(prompt: str) -> str | None:
        for _ in range(retries + 1):
            try:
                return model(prompt)
            except Exception:  # a model may fail in any way; the row says so
                continue
        return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(reply=pdf["prompt"].map(ask))

    return prompts.mapInPandas(run, Ty.StructType([*prompts.schema.fields, Ty.StructField("reply", Ty.StringType())]))


def prompt(question: Column, evidence: Column) -> Column:
    """evidence: array of (citation, text)."""
    lines = F.array_join(F.transform(evidence, lambda e: F.concat(F.lit("["), e.citation, F.lit("] "), e.text)), "\n")
    return F.concat(F.lit("Answer from the evidence only, as JSON {\"claims\": [{\"text\", \"citations\"}]}.\nQuestion: "), question, F.lit("\nEvidence:\n"), lines)


def parsed_claims(reply: Column, most: int = 8) -> Column:
    """Claims of a reply, at most ``most``; anything that isn't such JSON gives none."""
    found = F.from_json(T.first_json(reply), CLAIMS).claims
    good = F.filter(F.coalesce(found, F.array().cast("array<struct<text:string,citations:array<string>>>")), lambda c: F.trim(F.coalesce(c.text, F.lit(""))) != "")
    return F.slice(F.transform(good, lambda c: F.struct(F.trim(c.text).alias("text"), F.array_distinct(F.coalesce(c.citations, F.array().cast("array<string>"))).alias("citations"))), 1, most)


def ranked_evidence(rows: DataFrame, most: int = 12) -> DataFrame:
    """Evidence of several queries of a turn: each chunk once with its best score and all its queries, the best first."""
    best = rows.groupBy("turn_id", "citation").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("query_id")).alias("query_ids"), F.max_by("text", "score").alias("text"))
    by = Window.partitionBy("turn_id").orderBy(F.desc("score"), "citation")
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)


def verified(claims: DataFrame, evidence: DataFrame, support: float = 0.55) -> DataFrame:
    """claims (turn_id, claim_id, text, citations) with a verdict: unknown citations go, then a number conflict with all that is
    left, then too little support."""
    rows = claims.select("turn_id", "claim_id", "text", F.explode_outer("citations").alias("citation"))
    joined = rows.join(evidence.select("turn_id", "citation", F.col("text").alias("cited")), ["turn_id", "citation"], "left")
    each = joined.select("turn_id", "claim_id", "text", F.when(F.col("cited").isNotNull(), F.col("citation")).alias("citation"), T.number_conflict(F.col("text"), F.coalesce("cited", F.lit(""))).alias("conflict"), F.when(F.col("cited").isNotNull(), T.support(F.col("text"), F.col("cited"))).alias("s"))
    made = each.groupBy("turn_id", "claim_id", "text").agg(F.array_sort(F.collect_set("citation")).alias("citations"), F.min("conflict").alias("conflict"), F.max("s").alias("support"))
    verdict = F.when(F.size("citations") == 0, "fabricated").when(F.col("conflict"), "number_conflict").when(F.coalesce(F.col("support") < support, F.lit(True)), "unsupported").otherwise("kept")
    return made.withColumn("verdict", verdict)


def planned(prior: DataFrame, plan: DataFrame) -> DataFrame:
    """prior (claim_id, text) after a plan (claim_id, action keep | amend | retract, text): claims that it forgets stay."""
    joined = prior.join(plan.select("claim_id", "action", F.col("text").alias("new")), "claim_id", "left").filter("coalesce(action, 'keep') <> 'retract'")
    return joined.select("claim_id", F.when((F.col("action") == "amend") & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("text")).alias("text"), F.coalesce("action", F.lit("keep")).alias("action"))


def fallback_plan(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Without a model: a prior claim that shares words with a new one but none of its numbers is amended to it."""
    a = prior.select("claim_id", "text", F.explode(T.content_set(F.col("text"))).alias("t"))
    b = new.select(F.col("text").alias("new"), F.explode(T.content_set(F.col("text"))).alias("t"))
    shared = a.join(b, "t").groupBy("claim_id", "text", "new").agg(F.count("*").alias("n"))
    conflict = shared.filter((F.col("n") >= 2) & T.number_conflict(F.col("text"), F.col("new")) & (F.size(T.numbers_in(F.col("new"))) > 0))
    return conflict.groupBy("claim_id").agg(F.max_by("new", F.struct("n", "new")).alias("text")).withColumn("action", F.lit("amend"))


def covered_by_chain(queries: DataFrame, answered: DataFrame) -> DataFrame:
    """Queries (query_id, parent) that have an answered (query_id) one in their line of parents, themselves included."""
    spark = queries.sparkSession
    queries.createOrReplaceTempView("_chain_queries")
    answered.createOrReplaceTempView("_chain_answered")
    return spark.sql("""
        WITH RECURSIVE up(query_id, at) AS (
          SELECT query_id, query_id FROM _chain_queries
          UNION ALL
          SELECT up.query_id, q.parent FROM up JOIN _chain_queries q ON q.query_id = up.at WHERE q.parent IS NOT NULL)
        SELECT q.query_id, max(a.query_id IS NOT NULL) AS covered
        FROM _chain_queries q JOIN up ON up.query_id = q.query_id LEFT JOIN _chain_answered a ON a.query_id = up.at GROUP BY q.query_id""")


def rendered(claims: Column) -> Column:
    """Claims with their citations as markers."""
    return F.array_join(F.transform(claims, lambda c: F.concat(c.text, F.lit(" ["), F.array_join(c.citations, ", "), F.lit("]"))), " ")


def version_gaps(versions: DataFrame) -> DataFrame:
    """Versions that don't follow the one before them: the store is append-only and contiguous."""
    before = F.lag("version").over(Window.partitionBy("session_id").orderBy("version"))
    return versions.withColumn("before", before).filter(F.col("version") != F.coalesce("before", F.lit(0)) + 1)


def claim_queries(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(session_id, claim_id, query_id): the query that a claim answers, by its first citation among the session's evidence and the
    query that found that first. claims (session_id, claim_id, citations); evidence (session_id, query_id, citation, at). Claims
    without such a citation have no row."""
    first = evidence.groupBy("session_id", "citation").agg(F.min_by("query_id", F.struct("at", "query_id")).alias("query_id"))
    cited = claims.select("session_id", "claim_id", F.posexplode("citations").alias("place", "citation"))
    return cited.join(first, ["session_id", "citation"]).groupBy("session_id", "claim_id").agg(F.min_by("query_id", "place").alias("query_id"))
