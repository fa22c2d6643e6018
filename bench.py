"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veilgate.plans import catalog
from veilgate.session import local_session

HEADLINE = (
    "pii_block_status",
    "pii_role_exempt",
    "prompt_guard",
    "response_guard",
    "pii_vault",
    "bm25_topk",
    "dense_topk",
    "rrf_search",
    "governed_search",
    "pit_features",
    "latest_features",
    "session_reconstruct",
    "pii_by_type",
    "lineage_depth",
    "stream_mask",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    catalog.QUERIES["prefilter_rls"](spark, sf_dir).count()  # start workers and class loading
    seconds = {}
    start = time.time()
    catalog.search_queries.T.term_index(spark, sf_dir)  # chunks, terms and posting blocks, stored once before searches
    seconds["ingest_corpus"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    texts = catalog.text_queries.T.texts(spark, sf_dir).count()
    asked = catalog.text_queries.T.queries(spark, sf_dir).count()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "texts_shielded_per_sec": round(texts / seconds["pii_block_status"], 1),
                "searches_per_sec": round(asked / seconds["rrf_search"], 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
