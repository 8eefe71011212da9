"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with wall seconds per query.

Each query runs once to warm up (class loading, code generation) and is then
timed once, from building the plan to the last row, into a no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from kinsight.operators import enrichment, search, semantic
from kinsight.plans.pipeline import Build
from kinsight.plans.queries import QUERIES, SEARCH_TEXT
from kinsight.session import build_session, run_folder
from kinsight.sources import tables
from kinsight.sources.testbed import RULES, SETTINGS, Testbed

HEADLINE = (
    "agg_customer_policy", "agg_customer_interaction", "customer_360_base", "interactions_enriched", "risk_signals",
    "risk_summary", "nba_recommendations", "customer_360_enriched", "search_index", "search_bm25", "key_phrases",
    "dq_fk_orphans", "incremental_agg", "incremental_fold",
)


def stored_products(spark, sf_dir: str) -> tuple[str, str, str]:
    """The serving table of profiles, a search index and word counts, written once; the reads are timed, not this."""
    build = Build(Testbed(spark, sf_dir), SETTINGS, workspace=run_folder(spark, "bench"))
    serving, index, words = (run_folder(spark, name) for name in ("bench-serving", "bench-index", "bench-words"))
    tables.write_serving(build.profile_with_timeline, serving, "customer_id")
    search.write_index(build.tables.raw("documents").selectExpr("doc_id", "lang", "text AS content"), index, ("lang",))
    enrichment.transcript_words(build.transcripts, RULES).write.parquet(words)
    return serving, index, words


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(
        "kinsight-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="5g",
        spark__ui__showConsoleProgress="false", spark__python__sql__dataFrameDebugging__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    serving, index, words = stored_products(spark, sf_dir)
    reads = {
        "profile_point_read": lambda: semantic.summary_card(tables.read_serving(spark, serving, "customer_id", [42])),
        "search_on_index": lambda: search.search(search.open_index(spark, index), SEARCH_TEXT),
        "phrases_on_words": lambda: enrichment.key_phrases(spark.read.parquet(words)),
    }
    for name, read in reads.items():
        for _ in range(2):
            start = time.perf_counter()
            read().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1],
    }))


if __name__ == "__main__":
    main()
