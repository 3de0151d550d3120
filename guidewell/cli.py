"""Command line of a run; prints the manifest as JSON."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from guidewell.plans.run import run


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="guidewell", description="Score perturbed cells against the effects of their perturbations.")
    for name in ("--dataset-path", "--output-dir", "--perturb-column", "--ctrl-name"):
        p.add_argument(name, required=True)
    p.add_argument("--mode", choices=("single", "multilabel"), default="single")
    p.add_argument("--layer")
    p.add_argument("--perturbation", action="append", dest="perturbations")
    p.add_argument("--target-mode", choices=("union_deg", "hvg"), default="union_deg")
    for name, kind, default in (("--target-gene-max", int, 500), ("--chunk-size", int, 8192), ("--lr-lambda", float, 0.01), ("--score-lambda", float, 0.0), ("--scale-factor", float, 3.0), ("--target-sum", float, 1e4), ("--logfc-threshold", float, None), ("--clip-quantile", float, None), ("--clip-bins", int, 2048)):
        p.add_argument(name, type=kind, default=default)
    p.add_argument("--background-cluster-column")
    p.add_argument("--rank-by-signed-t", action="store_false", dest="rank_by_abs_t")
    p.add_argument("--no-scale-score", action="store_false", dest="scale_score")
    p.add_argument("--progress", action="store_true", dest="show_progress")
    return p


def main(argv: list[str] | None = None) -> dict[str, Any]:
    """Do what the arguments say; the manifest of what was written."""
    from pyspark.sql import SparkSession

    given = vars(build_parser().parse_args(argv))
    batch = {"spark.sql.execution.arrow.maxRecordsPerBatch": given["chunk_size"]}
    return run(given.pop("dataset_path"), spark=SparkSession.builder.config(map=batch).getOrCreate(), **given)


def cli(argv: list[str] | None = None) -> None:
    json.dump(main(argv), sys.stdout, indent=2, sort_keys=True)
    sys.stdout.write("\n")


if __name__ == "__main__":
    cli()
