"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from evidora.plans import catalog
from evidora.session import build_session

HEADLINE = (
    "tokenize_counts sentence_split chunk_sentences factual_density turn_classification term_stats bm25_idf bigram_low_df bm25_topk prf_expand char_ngram_topk rrf_fusion hybrid_search cosine_topk "
    "heuristic_rerank dedup_greedy lexical_claim grounding_verify engine_turns supersession trace_turns gate_coverage percentiles_linear threshold_sweep paired_bootstrap"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["bm25_topk"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
