"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs twice from scratch (nothing cached); the faster run counts, building of the plan included.
"""

from __future__ import annotations

import importlib.util
import json
import os
import time

HEADLINE = [
    "hybrid_search", "vector_topk", "keyword_match", "notice_search", "prompt_input", "chat_history",
    "clean_text", "clean_block", "noise_lines", "section_gate", "document_scores", "heading_rules",
    "dedup_first", "dedup_exact", "dedup_containment", "chunk_build", "load_new", "change_detection",
    "page_titles", "page_anchors", "page_sections", "menu_links", "listing_stop", "stream_load",
    "prompt_messages", "corpus_build", "frontier", "site_documents",
    # training-data operators, if they are there
    "op1_toxicity", "op2_privacy", "op3_url_rules", "op4_contamination", "op5_repeated_substrings", "op6_nearest_vectors",
    "op7_minhash", "op8_mixing", "op9_token_counts", "op10_language",
    "op11_manifest", "op12_collocations", "op13_bpe",
]


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    spec = importlib.util.spec_from_file_location("entry_module", os.path.join(here, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    from gleaner.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = entry.queries(), {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(n for n in HEADLINE if n in queries)).split():
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "headline queries, total of the faster of two runs", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
