"""Command line: run the generated workloads and write their reports as CSV.

python -m tessera.operators.cli --dataset small --output /tmp/reports
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera.sources.csv import write_csv

from . import reports


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--dataset", choices=("small", "large"), default="small")
    p.add_argument("--output", help="folder for the CSV reports; without it they are only shown")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("workloads").getOrCreate()
    metrics = reports.pruning(reports.workload_metrics(spark, a.dataset == "large")).persist()
    parts = {"workloads": metrics, "aggregate": reports.aggregated(metrics), "selectivity": reports.by_selectivity(metrics), "low_selectivity_gap": reports.low_selectivity_gap(metrics)}
    for name, df in parts.items():
        df.show(100, False)
        if a.output:
            write_csv(reports.with_metadata(df, {"dataset": a.dataset, "leaf_rows": 8, "kd_leaf_rows": reports.KD_LEAF, "packed_leaf_rows": reports.PACK_LEAF, "report": name}), f"{a.output}/{name}")
    metrics.unpersist()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
