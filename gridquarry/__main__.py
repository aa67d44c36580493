"""Command line: python -m gridquarry --config run.json key=value ...

Settings are those of `batch.run`: defaults, then the file, then arguments.  Exits with 1 if a slide failed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gridquarry import batch, config
from gridquarry.session import ship_package


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridquarry", description=__doc__)
    parser.add_argument("--config", help="a JSON file of settings")
    parser.add_argument("settings", nargs="*", help="key=value, with dots for nested keys; values are JSON where they parse as such")
    told = parser.parse_args(arguments)
    settings = config.load(told.config, told.settings)
    if missing := [k for k in ("manifest", "out", "mask_size") if k not in settings]:
        parser.error(f"settings missing: {', '.join(missing)}")
    spark = spark or SparkSession.builder.appName("gridquarry").getOrCreate()
    ship_package(spark)
    return 1 if batch.run(spark, settings) else 0


if __name__ == "__main__":
    sys.exit(main())
