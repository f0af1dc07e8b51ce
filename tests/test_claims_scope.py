"""Claims that go on with the next sentence, evidence of whole sections, and resampling by buckets."""

from dataclasses import replace

from pyspark.sql import functions as F

from evidora.config import Answers
from evidora.operators import claims, evaluate

OFF, ON = Answers(), replace(Answers(), anaphoric_continuation=True)


def evidence(spark, text):
    return spark.createDataFrame([(1, "refund window days", 1, "T §1", "T", text)], "query_id long, query string, rank int, citation string, title string, text string")


def test_a_claim_goes_on_with_a_sentence_that_refers_to_it(spark):
    rows = evidence(spark, "Shops vary. The refund window is 30 days. It starts on delivery. They say so.")
    assert claims.claims(rows, OFF).first().claim == "The refund window is 30 days."
    assert claims.claims(rows, ON).first().claim == "The refund window is 30 days. It starts on delivery."
    assert claims.claims(evidence(spark, "The refund window is 30 days. Items vary."), ON).first().claim == "The refund window is 30 days."
    assert claims.claims(evidence(spark, "This is it. The refund window is 30 days."), ON).first().claim == "The refund window is 30 days."

    def score(query, pair):
        return F.when(pair.contains("window"), 1.0).otherwise(0.0)

    assert claims.scored_claims(rows, score, OFF).first().claim == "The refund window is 30 days."
    assert claims.scored_claims(rows, score, ON).first().claim == "The refund window is 30 days. It starts on delivery."


def test_evidence_of_the_whole_section(spark):
    chunk = evidence(spark, "Shops vary.")
    sections = spark.createDataFrame([("T §1", "Shops vary. The refund window is 30 days."), ("T §2", "Other."), ("T §1", None)], "citation string, text string")
    assert claims.claims(chunk, OFF).count() == 0
    whole = claims.section_scope(chunk, sections)
    assert whole.columns == chunk.columns and claims.claims(whole, OFF).first().claim == "The refund window is 30 days."
    assert claims.section_scope(chunk, sections.filter("citation = 'T §2'")).first().text == "Shops vary."


def test_bootstrap_by_buckets_is_the_same_on_any_partitions_and_close_to_one_bucket(spark):
    rows = spark.createDataFrame([(f"c{k % 200}", float((k * 7) % 11), float(k % 5)) for k in range(2000)], "cluster string, a double, b double")
    many = [evaluate.bootstrap(rows.repartition(n), 600, per_bucket=9).first() for n in (1, 7)]
    assert many[0] == many[1]
    one = evaluate.bootstrap(rows, 600).first()
    assert abs(one.observed - many[0].observed) < 1e-12 and one.low < one.observed < one.high
    width = one.high - one.low
    assert abs(one.low - many[0].low) < 0.25 * width and abs(one.high - many[0].high) < 0.25 * width


def test_bootstrap_of_a_skewed_cluster_and_null(spark):
    rows = spark.createDataFrame([(None, 1.0, 0.0)] * 500 + [(f"c{k}", 0.0, 0.0) for k in range(20)], "cluster string, a double, b double")
    r = evaluate.bootstrap(rows, 300, per_bucket=4).first()
    assert r.low == 0.0 and 0.9 < r.observed < r.high < 1.0
