"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from plumbline.plans import suite
from plumbline.session import build_session

HEADLINE = (
    "cat_profile",
    "cat_topk_text",
    "num_profile",
    "num_quantiles_slots",
    "tmp_volume",
    "profile_raw_orders",
    "profile_raw_lineitem",
    "prep_sample",
    "spa_profile",
    "spa_wkb",
    "concentration_report",
    "scale_robustness",
    "cell_counts",
    "ses_nodes",
    "ses_summary",
    "ses_ingest_stream",
    "txt_observations",
    "txt_turns",
    "cur_merge",
    "score_runs",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    suite.load()
    # One small job each for the JVM and the Python workers, so the first query does not pay for them.
    spark.range(1000).selectExpr("sum(id)").collect()
    suite.QUERIES["spa_wkb"](spark, folder).collect()
    names = os.environ.get("BENCH_QUERIES")
    times = {}
    for name in names.split(",") if names else HEADLINE:
        began = time.perf_counter()
        suite.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
