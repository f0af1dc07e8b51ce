"""BM25 and what is built on it: texts are tokenised once, dealt out as one row each, and evidence is searched once."""

import pytest

from evidora.operators import retrieve
from evidora.plans import answer_queries as A
from evidora.plans import catalog
from tests.conftest import SMALL


def test_bm25_deals_out_one_row_a_document(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, None), (3, "the cat"), (4, "bird")], "ord long, text string").repartition(8)
    asked = spark.createDataFrame([(1, "cat cat nowhere"), (2, "the"), (3, None)], "query_id long, query string")
    found = retrieve.bm25(docs, retrieve.query_terms(asked))
    got = {(r.query_id, r.ord): r.score for r in found.collect()}
    weigh = lambda tf, n: round(2 * 0.693147180559945 * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 1.25)), 6)
    assert got == {(1, 1): weigh(2, 3), (1, 3): weigh(1, 1)}
    dealt = [x for x in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Exchange hashpartitioning(ord" in x]
    assert dealt and all("REPARTITION" in x for x in dealt)
    size = found._jdf.queryExecution().optimizedPlan().toString()
    assert size.index("RepartitionByExpression") > size.index("Generate")  # rows of tokens are dealt out before they are exploded


@pytest.mark.parametrize("name", ["retrieval_ceilings", "claim_queries", "failure_buckets", "fabricated_citations", "grounding_verify", "wrong_claim_causes"])
def test_evidence_is_searched_once(spark, monkeypatch, name):
    own, seen = A.evidence, []
    monkeypatch.setattr(A, "evidence", lambda *a: seen.append(a) or own(*a))
    rows = catalog.QUERIES[name](spark, SMALL)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 1 and "RepartitionByExpression" not in plan


def test_only_named_sections_are_joined(spark):
    named = spark.createDataFrame([(1, "x", ["3 §1", "none 1 §9"])], "claim_id long, claim string, citations array<string>")
    assert [r.citation for r in A.sections(spark, SMALL, named).collect()] == ["3 §1"]
