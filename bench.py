"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: The reference's published set-oriented figures have a counterpart here each: catalogue match, distinct terms,
#: notification scoring, qualification, routing, code suggestion, exact vector search, hash reuse, retrieval.
HEADLINE = ["A4_province_rollup", "F1_facet_filter", "F6_free_text", "J3_prefix_theta", "J11_trigram_similarity", "A21_code_dictionary", "A22_matched_positions", "D1_score_tender", "D2_product_matches", "D5_text_match", "D6_catalog_match", "D7_notification_score", "D10_pricing_steps", "D12_stock_check", "D22_qualification", "D24_routing_upsert", "D26_code_suggestion", "D28_evidence_classifier", "D35_hybrid_retrieval", "D36_exact_within_key", "D38_reuse_by_hash", "X24_chunks", "R6_sessions", "V2_document_coverage"]


def main() -> None:
    from bidlake import catalog
    from bidlake.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, out = catalog.queries(), {}
    queries["F1_facet_filter"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the session's threads
    for name in HEADLINE:
        for _ in range(2):  # the second run counts: what it takes once code is compiled
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            out[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(sf.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
