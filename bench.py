"""Times the headline queries once warm, the bulk expressions over 20 million rows; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

from lemnia.operators.evaluate import evaluate  # noqa: E402
from lemnia.queries import QUERIES  # noqa: E402
from lemnia.sources import table  # noqa: E402

#: The published bulk expressions over three columns, in the table's names.
BULK = {
    "bulk_linear": "12*l_quantity+3*l_tax-4*l_discount+5*l_quantity-l_tax-4*l_discount+2*l_quantity+l_tax",
    "bulk_gaussian": "1/(l_quantity*sqrt(2*pi))*exp(-0.5*((l_tax-l_discount)/l_quantity)^2)",
    "bulk_exp_power": "((l_quantity^2+sin(l_quantity))/(1+cos(l_quantity^2)))*(exp(l_tax)/10)",
    "bulk_trig": "sin(l_quantity)+cos(l_tax)+tan(l_discount)+sin(l_quantity*l_tax)",
    "bulk_cubes": "l_quantity^3+l_tax^3+l_discount^3+(l_quantity+1)^3+(l_tax+1)^3+(l_discount+1)^3",
}
BULK_ROWS = 20_000_000
HEADLINE = ["flagship", "row_median", "agg_s_d", "agg_med", "series_alert", "integral_per_row", "ode_rk4", "mat_mul", "vec_softmax", "logical_filter"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "8m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lineitem = table(spark, sf_dir, "lineitem").repartition(int(cpus))
    columns = sorted({c for f in BULK.values() for c in ("l_quantity", "l_tax", "l_discount") if c in f})
    n = lineitem.count()
    # the bulk expressions over the table repeated to BULK_ROWS rows and to a quarter of that: the difference is the cost of a row
    repeated = lambda rows: lineitem.select(*columns, F.explode(F.sequence(F.lit(1), F.lit(max(1, rows // n)))).alias("copy")).drop("copy").cache()
    small, large = repeated(BULK_ROWS // 4), repeated(BULK_ROWS)
    n_small, n_large = small.count(), large.count()

    def timed(make) -> float:
        times = []
        for _ in range(4):
            t = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        return round(statistics.median(times[1:]), 4)

    took, per_row = {}, {}
    for name, f in BULK.items():
        quarter, took[name] = (timed(lambda df=df, f=f: evaluate(df, {"y": f}, keep=[])) for df in (small, large))
        per_row[name] = {"whole": round(took[name] / n_large * 1e9, 2), "slope": round((took[name] - quarter) / (n_large - n_small) * 1e9, 2)}
    small.unpersist()
    large.unpersist()
    for name in HEADLINE:
        took[name] = timed(lambda name=name: QUERIES[name](spark, sf_dir))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows": n, "bulk_rows": n_large, "bulk_ns_per_row": per_row, "rows_per_sec": {k: round(n_large / took[k]) for k in BULK}}))
    spark.stop()


if __name__ == "__main__":
    main()
