"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "lexical_retrieval", "quote_verification", "text_chunks", "content_dedupe", "html_text", "link_discovery",
    "collection_plan", "document_admission", "corpus_digest", "version_history", "entity_resolution", "band_match",
    "search_entities", "cosine_knn", "hashed_tfidf", "context_selection", "edge_recommend", "pack_batches",
    "slot_verdicts", "run_summary", "cost_rollup", "session_reduce", "exclusion_by_intent", "stream_latency",
]


def main() -> None:
    from corpusloom.plans import QUERIES
    from corpusloom.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the Python workers' machinery before the clock runs.
    QUERIES["bounded_text"](spark, folder).write.format("noop").mode("overwrite").save()
    QUERIES["prose_clean"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in QUERIES if wanted == ["all"] else wanted:
        began = time.time()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        except Exception as error:
            print(f"{name}: {str(error)[:300]}", file=sys.stderr)
            continue
        seconds[name] = round(time.time() - began, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
