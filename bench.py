"""Wall time of the main queries. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pagesieve.operators import dom  # noqa: E402
from pagesieve.plans import QUERIES  # noqa: E402
from pagesieve.plans.registry import pages  # noqa: E402
from pagesieve.session import build_session  # noqa: E402

HEADLINE = [
    "nav_links", "page_title_h1", "footer_text", "missing_field_fill", "joined_alternatives", "preview_nav",
    "template_by_domain", "template_tests", "template_pagination", "page_list", "existence_test", "nav_link_counts", "element_tag_counts", "induced_selectors", "induced_next_selectors",
    "example_failures", "login_or_challenge_flags", "page_chain_depth", "latest_status", "superseded_runs",
    "clean_text_documents", "csv_output", "streamed_records",
]
SMALLER = {"sf0.1": "sf0.01", "sf0.01": "sf0.001"}


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus)
    scale = folder.rsplit("/", 1)[-1]
    cold = seconds(lambda: drain(QUERIES["nav_links"](spark, folder)))
    times = {}
    for name in HEADLINE:
        drain(QUERIES[name](spark, folder))
        times[name] = seconds(lambda: drain(QUERIES[name](spark, folder)))
    source = pages(spark, folder)
    n_pages = source.count()
    rows = QUERIES["nav_links"](spark, folder).count()
    empty = dom.dom_nodes(source, elements=set(), texts_in=set(), path_attrs=(), columns=("pre",))
    tokenise = min(seconds(lambda: drain(empty)) for _ in range(2))
    details = {
        "pages": n_pages,
        "nav_links_cold_sec": cold,
        "nav_links_warm_sec": times["nav_links"],
        "pages_per_sec": round(n_pages / times["nav_links"], 1),
        "rows_per_sec": round(rows / times["nav_links"], 1),
        "tokeniser_share": round(min(1.0, tokenise / times["nav_links"]), 3),
        "node_table_sec": seconds(lambda: drain(dom.dom_nodes(source))),
        "stream_to_batch": round(times["streamed_records"] / times["nav_links"], 2),
    }
    smaller = folder.replace(scale, SMALLER.get(scale, scale))
    if smaller != folder and os.path.isdir(smaller):
        drain(QUERIES["nav_links"](spark, smaller))
        small = seconds(lambda: drain(QUERIES["nav_links"](spark, smaller)))
        details["time_ratio_to_tenth_of_pages"] = round(times["nav_links"] / small, 2)
    plan = QUERIES["nav_links"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    details["shuffles_after_tokenising"] = plan.split("MapInArrow")[0].count("Exchange")
    print(json.dumps({
        "metric": "sum of warm query times", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": scale, "details": details,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
