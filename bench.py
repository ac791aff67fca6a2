"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line.  Every query is executed in
full through the ``noop`` sink (no driver collect); the reported time per
query is the median of ``$BENCH_REPEAT`` warm runs (default 3) after one
warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "corpus_v4_counts_by_lang",
    "article_clean",
    "dedupe_exact",
    "word_total",
    "seeded_order",
    "split_90_5_5",
    "relation_join",
    "token_annotate",
    "encode_ids",
    "mlm_examples",
    "metric_spans",
    "metric_masked_xent",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    os.environ.setdefault("SCRIPTORIUM_MASTER", f"local[{cpus}]")
    from scriptorium.plans import registry
    from scriptorium.session import get_spark
    from scriptorium.sources.tables import SPREAD_CONF

    spark = get_spark(master=f"local[{cpus}]", partitions=cpus)
    spark.conf.set(SPREAD_CONF, str(cpus))  # the file has one row group: its scan is one task
    qs = registry.queries()
    times = {}
    for name in HEADLINE:
        if name not in qs:
            continue
        runs = []
        for i in range(repeat + 1):
            t0 = time.time()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i > 0:
                runs.append(time.time() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "median_warm_seconds_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
