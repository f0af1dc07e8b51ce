"""Extractive answers: claims from evidence, the relevance gate, grounding, merging, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora.config import Answers
from evidora.functions import text as T

NOTHING = "I could not find anything in the corpus that answers this."
NO_ANSWER = "There is no earlier answer in this session to reformat. Ask a question first."
DOUBT = "Could not be verified from the retrieved corpus: "


def least_relevance(n: Column, own: Answers = Answers()) -> Column:
    """The overlap that a query of n tokens needs: less for long ones, down to a floor."""
    return F.when(n <= 3, own.relevance).otherwise(F.greatest(F.lit(own.relevance_floor), own.relevance - own.relevance_step * (n - 3)))


def relevant(query: Column, sentence: Column, specific: Column | None = None, own: Answers = Answers()) -> Column:
    """query, sentence: token arrays without repeats; specific: the query's discriminative tokens. Enough of the query's
    tokens are shared, and at least two (or all), or all shared ones are discriminative."""
    shared = F.array_intersect(query, sentence)
    n = F.size(query)
    several = F.size(shared) >= F.least(F.lit(2), n)
    telling = (F.size(shared) > 0) & (F.size(F.array_except(shared, specific)) == 0) if specific is not None else F.lit(False)
    return (n > 0) & (T.ratio(F.size(shared), n) >= least_relevance(n, own)) & (several | telling)


def section_scope(evidence: DataFrame, sections: DataFrame) -> DataFrame:
    """Evidence whose text is that of the whole section that its citation names, where there is one: a long section is cut into several chunks,
    and the answer may stand in another than the one found. Of sections with one citation the first text counts."""
    whole = sections.filter("text IS NOT NULL").groupBy("citation").agg(F.min("text").alias("_whole"))
    return evidence.join(whole, "citation", "left").withColumn("text", F.coalesce("_whole", "text")).drop("_whole").select(*evidence.columns)


def continued(sentence: Column, following: Column, own: Answers) -> Column:
    """A claim's sentence with the next one behind it, if that refers back to it and the setting asks for it."""
    return F.when(T.continues(following), F.concat_ws(" ", sentence, following)).otherwise(sentence) if own.anaphoric_continuation else sentence


def best_sentences(evidence: DataFrame) -> DataFrame:
    """The sentence of each chunk that covers most of the query, the earlier of equals. evidence: (query_id, query, rank,
    citation, text[, specific])."""
    distinct = F.array_distinct(T.sentences(F.col("text")))
    rows = evidence.withColumn("own", T.content_set(F.col("query"))).withColumn("_all", distinct).select("*", F.posexplode("_all").alias("at", "sentence")).withColumn("following", F.get("_all", F.col("at") + 1))
    scored = rows.withColumn("covered", F.when(F.size(T.content_set(F.col("sentence"))) == 0, -1.0).otherwise(T.coverage(F.col("own"), T.content_set(F.col("sentence")))))
    first = F.max_by(F.struct("sentence", "at", "own", "covered", "following", *(["specific"] if "specific" in evidence.columns else [])), F.struct("covered", -F.col("at")))
    return scored.groupBy("query_id", "query", "rank", "citation").agg(first.alias("b")).select("query_id", "query", "rank", "citation", "b.*")


def claims(evidence: DataFrame, own: Answers = Answers()) -> DataFrame:
    """The claim of each query: the best sentence of the first chunk, in rank order, whose best sentence is relevant."""
    found = best_sentences(evidence)
    specific = F.col("specific") if "specific" in found.columns else None
    fit = found.filter(relevant(F.col("own"), T.content_set(F.col("sentence")), specific, own))
    fit = fit.withColumn("sentence", continued(F.col("sentence"), F.col("following"), own))
    first = fit.groupBy("query_id", "query").agg(F.min_by(F.struct("sentence", "citation", "rank"), "rank").alias("c"))
    return first.select("query_id", "query", F.col("c.sentence").alias("claim"), "c.citation", "c.rank")


def scored_claims(evidence: DataFrame, scorer, own: Answers = Answers(), top: int = 3) -> DataFrame:
    """As ``claims`` by a scorer of (query, title: sentence) pairs over the first chunks; below the threshold there is none."""
    rows = evidence.filter(F.col("rank") <= top).select("query_id", "query", "rank", "citation", "title", F.array_distinct(T.sentences(F.col("text"))).alias("_all"))
    rows = rows.select("*", F.posexplode("_all").alias("at", "sentence")).withColumn("following", F.get("_all", F.col("at") + 1))
    rows = rows.filter(F.size(T.content(F.col("sentence"))) > 0).withColumn("s", scorer(F.col("query"), F.when(F.col("title") == "", F.col("sentence")).otherwise(F.concat_ws(": ", "title", "sentence"))))
    best = rows.groupBy("query_id", "query").agg(F.max_by(F.struct("sentence", "following", "citation", "s"), F.struct("s", -F.col("rank"), -F.col("at"))).alias("c"))
    return best.filter(F.col("c.s") >= own.claim_threshold).select("query_id", "query", continued(F.col("c.sentence"), F.col("c.following"), own).alias("claim"), "c.citation", F.col("c.s").alias("score"))


def with_context(claims_: DataFrame, sections: DataFrame) -> DataFrame:
    """A claim that opens with a reference gets the sentence before it in its section put in front."""
    text = F.array_distinct(T.sentences(F.col("text")))
    joined = claims_.join(sections.select("citation", text.alias("ss")), "citation", "left")
    at = F.array_position("ss", F.col("claim"))
    before = F.get("ss", (at - 2).cast("int"))
    return joined.withColumn("claim", F.when(T.needs_context(F.col("claim")) & (at > 1), F.concat_ws(" ", before, "claim")).otherwise(F.col("claim"))).drop("ss")


def verify(claims_: DataFrame, sections: DataFrame, own: Answers = Answers()) -> tuple[DataFrame, DataFrame]:
    """(kept, fabricated): claims (claim_id, claim, citations) with real citations only and whether the best support is
    enough, claims without any being dropped; and the citations that name no section."""
    rows = claims_.select("claim_id", "claim", F.posexplode("citations").alias("at", "citation"))
    joined = rows.join(sections.select("citation", F.col("text").alias("cited")), "citation", "left")
    fabricated = joined.filter("cited IS NULL").select("claim_id", "citation")
    scored = joined.filter("cited IS NOT NULL").withColumn("s", T.support(F.col("claim"), F.col("cited")))
    order = F.transform(F.array_sort(F.collect_list(F.struct("at", "citation"))), lambda x: x.citation)
    kept = scored.groupBy("claim_id", "claim").agg(order.alias("citations"), F.max("s").alias("support"))
    return kept.withColumn("supported", F.col("support") >= own.support), fabricated


def merged(prior: Column, delta: Column, threshold: float = 0.45) -> Column:
    """Claims (text, citations) after a refinement: each new one replaces the prior one it is most like (once, the earlier
    of equals), others are added at the end. A fold over the new claims; its state is the prior ones still standing."""

    def add(standing: Column, d: Column) -> Column:
        own = T.content_set(d.text)
        likeness = F.transform(standing, lambda p: T.jaccard(own, T.content_set(p.text)))
        best = F.array_max(likeness)
        at = F.array_position(likeness, best)
        return F.when(F.coalesce(best, F.lit(0.0)) >= threshold, F.filter(standing, lambda _, i: i != at - 1)).otherwise(standing)

    return F.concat(F.aggregate(delta, prior, add), delta)


def union_citations(claims_: Column, carried: Column) -> Column:
    own = F.flatten(F.transform(claims_, lambda c: c.citations))
    return F.array_sort(F.array_distinct(F.concat(own, F.coalesce(carried, F.array().cast("array<string>")))))


def uncertainty(unsupported: Column) -> Column:
    return F.when(F.size(unsupported) > 0, F.concat(F.lit(DOUBT), F.array_join(F.array_distinct(unsupported), "; "), F.lit(".")))


def reformat(claims_: Column, instruction: Column) -> Column:
    """Bullets if asked for, and a limit: the last of the number words that occurs, or digits."""
    low = F.lower(instruction)
    limit = F.lit(None).cast("int")
    for word, n in (("one", 1), ("single", 1), ("two", 2), ("three", 3), ("four", 4)):
        limit = F.when(F.contains(low, F.lit(word)), n).otherwise(limit)
    limit = F.coalesce(F.nullif(F.regexp_extract(low, T.plain(r"\b(\d+)\b"), 1), F.lit("")).cast("int"), limit)
    chosen = F.when(limit > 0, F.slice(claims_, 1, F.greatest(limit, F.lit(1)))).otherwise(claims_)
    bullets = F.array_join(F.transform(chosen, lambda c: F.concat(F.lit("• "), c.text, F.lit(" ["), F.array_join(c.citations, ", "), F.lit("]"))), "\n")
    return F.when(low.rlike("bullet|point|list"), bullets).otherwise(F.array_join(F.transform(chosen, lambda c: c.text), " "))


def versions(answers: DataFrame) -> DataFrame:
    """Version and parent of each answer of a session, in the order of ``created``; append-only and without gaps."""
    by = Window.partitionBy("session_id").orderBy("created")
    n = F.row_number().over(by)
    return answers.withColumn("version", n).withColumn("parent_version", F.when(n > 1, n - 1))


def gate_probability(features: list[Column], means: list[float], scales: list[float], weights: list[float], intercept: float) -> Column:
    """A standardised logistic over given features."""
    z = F.lit(intercept)
    for x, mean, scale, w in zip(features, means, scales, weights, strict=True):
        z = z + w * (x - mean) / scale
    return 1 / (1 + F.exp(-z))
