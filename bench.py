"""Time the headline queries: best of three after one warm-up, results forced with the noop sink."""

from __future__ import annotations

import json
import os
import time

from textpace.plans.catalog import QUERIES
from textpace.session import build_session

# Headline name -> registered query.
HEADLINES = {
    "reading_load_by_language": "reading_load_by_language",
    "search_20_queries": "q8_match_totals",
    "search_20_queries_hits": "q1_find_words",
    "tokenize": "t1_tokenize",
    "token_ranges": "t2_token_ranges",
    "reading_schedule": "p3_schedule",
    "page_blocks": "h4_page_blocks",
    "page_text": "h2_tag_strip",
    "conversation_outline": "b6_b7_outline_nesting",
    "markdown_paragraphs": "m13_paragraphs",
    "user_streaks": "a9_a10_streaks",
    "noise_removal": "l9_l10_l11_noise_removal",
    "cross_page_merge": "l13_cross_page_merge",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("textpace-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name, key in HEADLINES.items():
        best = None
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if i and (best is None or took < best):
                best = took
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": os.environ.get("BENCH_CPUS", "8"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
