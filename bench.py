"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

(M4, with the blocks' checksums), pair counts for the proxy (L1), the inner products of one search step
(L12) and the search loop with 10 steps (L19).  Each query is fully computed
into Spark's no-op sink.  A warm-up pass on sf0.001 runs first so that the
timings measure the engine, not JVM start-up and code generation.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from blendwise.plans import catalog  # noqa: E402
from blendwise.plans.common import BLOCK  # noqa: E402
from blendwise.plans.loop_queries import lang_chunks, lang_mixture, lang_positioned, val_target, whole_corpus  # noqa: E402
from blendwise.plans.search import SearchConfig, search  # noqa: E402
from blendwise.session import get_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
WARM_DIR = "/root/testdata/sf0.001"

SEARCH10 = SearchConfig(n_iters=110, interval=10, micro_batch=16, mix_lr=0.01, order="unigram", vocab=1024,
                        run_id="bench", source="lang")


def search10(spark, sf):
    cfg = whole_corpus(spark, sf, SEARCH10, steps=10)  # every block of the train split is drawn once on average
    return search(spark, lang_positioned(spark, sf), lang_mixture(spark, sf), val_target(spark, sf), cfg,
                  chunk_rows=lang_chunks(spark, sf), block_size=BLOCK)


HEADLINE = {
    "p2_pack": catalog.QUERIES["p2_pack"],
    "m4_mix": catalog.QUERIES["m4_mix"],
    "l1_pair_counts": catalog.QUERIES["l1_pair_counts"],
    "l12_inner_products": catalog.QUERIES["l12_inner_products"],
    "l19_search_10_steps": search10,
}


def run(spark, fn, sf):
    fn(spark, sf).write.format("noop").mode("overwrite").save()


def main():
    spark = get_session(f"local[{CPUS}]", shuffle_partitions=max(2 * CPUS, 8))
    if os.path.isdir(WARM_DIR) and os.path.abspath(WARM_DIR) != os.path.abspath(SF_DIR):
        for fn in HEADLINE.values():
            run(spark, fn, WARM_DIR)
    times = {}
    for name, fn in HEADLINE.items():
        t0 = time.perf_counter()
        run(spark, fn, SF_DIR)
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", SF_DIR)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else None, "cpus": CPUS}
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
