"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
The single-file test tables are first laid out as several files, as a cluster
would hold them (one-off, reported as ``layout_sec``, not part of a query).
Each query is a fresh DataFrame (no reuse of earlier shuffle output), forced
to completion with a no-op write (all columns computed) or a collect of its
small result; it runs once to warm up and then three times, of which the
median counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callsift.session import get_spark  # noqa: E402

RUNS = 3


def laid_out(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables the bench reads, ``documents`` in ``files`` files."""
    out = tempfile.mkdtemp(prefix="callsift-bench-")
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(files).write.parquet(f"{out}/documents.parquet")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus * 2)

    from callsift.plans import registry as REG
    from callsift.plans.classify import classify
    from callsift.sources import rules as R
    from callsift.sources import ruleset
    from callsift.sources import transcripts as TR

    t0 = time.perf_counter()
    data = laid_out(spark, sf_dir, cpus * 2)
    layout = round(time.perf_counter() - t0, 3)
    n_docs = TR.table(spark, data, "documents").count()
    big_rules = ruleset.large_keyword_rules(2000)
    # 2,000 rules over ~7,100 distinct keywords (a realistic rule base).
    wide_rules = ruleset.wide_keyword_rules(2000)

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    def generated(rules):
        return lambda: noop(classify(TR.from_documents(spark, data), R.keyword_rules(spark, rules),
                                     R.hierarchy(spark, ruleset.large_hierarchy(rules))))

    def collected(name):
        return lambda: REG.QUERIES[name](spark, data).collect()

    plan = {
        "classify_docs": lambda: noop(REG.classified_docs(spark, data)),
        "classify_docs_2000_rules": generated(big_rules),
        "classify_docs_2000_wide_rules": generated(wide_rules),
        "category_distribution": collected("category_distribution"),
        "agent_performance": collected("agent_performance"),
        "classification_stats": collected("classification_stats"),
        "prox_classify": lambda: noop(REG.QUERIES["prox_classify"](spark, data)),
        "pii_stats": collected("pii_stats"),
        "coaching_bundle": collected("coaching_bundle"),
    }
    times = {}
    for name, fn in plan.items():
        fn()
        runs = []
        for _ in range(RUNS):
            t0 = time.perf_counter()
            fn()
            runs.append(time.perf_counter() - t0)
        times[name] = round(median(runs), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "documents": n_docs, "layout_sec": layout, "runs": RUNS,
        "transcripts_per_sec_2000_rules": round(n_docs / times["classify_docs_2000_rules"], 1),
        "transcripts_per_sec_2000_wide_rules": round(n_docs / times["classify_docs_2000_wide_rules"], 1),
        "transcripts_per_sec_default_rules": round(n_docs / times["classify_docs"], 1),
    }))


if __name__ == "__main__":
    main()
