"""Times the headline queries: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from barline.plans import registry

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: The chain over five symbols, and its first half over a symbol per supplier, which grows with the tables.
HEADLINE = ["src_03_bars_supplier", "cln_01_clean", "fea_00_all", "sig_00_all", "gat_16_ensemble", "reg_01_rules", "bt_05_curve", "bt_07_trades", "met_00_all", "fac_01_hac_regressions", "fea_00_supplier"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    for name in HEADLINE:
        queries[name](spark, SF).write.format("noop").mode("overwrite").save()  # compiles and warms up
        began = time.time()
        queries[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
