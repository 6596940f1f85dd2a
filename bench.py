"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and written to the no-op sink, so every row and column is
computed but nothing is collected; the value is the median of the runs after one
warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "split_every_two", "paginate_wrapped", "split_by_outline", "page_labels", "merge_documents", "interleave",
    "reverse_pages", "find_text", "redact_matches", "text_similarity", "pair_pages", "word_diff",
    "detect_tables", "group_lines", "lines_to_markdown", "document_json", "sanitize_html", "html_text",
    "parse_emails", "validate_structure", "page_size_summary", "n_up_two", "booklet", "stitch_positions",
    "run_stats_by_workflow", "ranked_search", "stream_run_stats",
)


def main() -> None:
    from quirework.plans import load_all
    from quirework.plans.registry import QUERIES
    from quirework.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.log.level": "ERROR",
        },
    )
    load_all()
    times: dict[str, float] = {}
    for n in names:
        took = []
        for _ in range(runs + 1):
            t = time.time()
            QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - t)
        times[n] = round(statistics.median(took[1:]), 3)
        print(n, times[n], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
