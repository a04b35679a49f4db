"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  Each query is run to completion through a no-op sink
(``write.format("noop")``) so that the whole result is computed without being
collected on the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from spanmask.operators.entities import DictionaryScorer  # noqa: E402
from spanmask.plans import queries as Q  # noqa: E402
from spanmask.plans.pipeline import redact  # noqa: E402
from spanmask.session import get_spark  # noqa: E402
from spanmask.sources.io import INPUT_PARTITIONS  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", cpus)
    # documents.parquet has one row group here: deal its rows to all cores
    spark.conf.set(INPUT_PARTITIONS, str(2 * cpus))
    docs_path = f"{sf_dir}/documents.parquet"
    n_docs = spark.read.parquet(docs_path).count()
    n_chars = spark.read.parquet(docs_path).select(F.sum(F.length("text"))).first()[0]
    reg = Q.registry(spark, sf_dir)
    scorer = DictionaryScorer(Q.entity_terms(spark, sf_dir))

    def regex_only():
        return redact(Q.documents(spark, sf_dir), "text", registry=reg, disable_model=True)

    def full():
        return redact(Q.documents(spark, sf_dir), "text", registry=reg, disable_model=False, scorer=scorer)

    runs = {
        "pipeline_regex_only": regex_only,
        "pipeline_full": full,
        "chunk_documents": lambda: Q.q_chunk_documents(spark, sf_dir),
        "resolved_spans": lambda: Q.q_resolved_spans(spark, sf_dir),
        "run_summary_notes": lambda: Q.q_run_summary(spark, sf_dir, "notes"),
    }
    # warm-up: JVM, Python scoring workers, codegen caches
    regex_only().limit(50).write.format("noop").mode("overwrite").save()
    full().limit(200).write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in runs.items():
        t0 = time.perf_counter()
        fn().write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    out = {
        "metric": "total_sec",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "docs": n_docs,
        "chars": n_chars,
        "docs_per_sec_regex_only": round(n_docs / times["pipeline_regex_only"], 1),
        "mb_per_sec_regex_only": round(n_chars / 1e6 / times["pipeline_regex_only"], 2),
        "docs_per_sec_full": round(n_docs / times["pipeline_full"], 1),
        "cpus": cpus,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
