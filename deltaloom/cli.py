"""Command line: ``deltaloom run -c comparison.yaml``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from deltaloom.config import load_config
from deltaloom.errors import ConfigError
from deltaloom.plans.diff import DiffEngine
from deltaloom.sources.ingest import DataIngestor


def run(config_path: str) -> int:
    """0 if the tables match within the threshold, 1 if they don't or anything fails."""
    try:
        print(f"Reading {config_path} ...")
        config, source, target = load_config(config_path)
        spark = SparkSession.builder.appName("deltaloom").getOrCreate()
        print("Reading and aligning both sides ...")
        frames = DataIngestor(config, source, target, spark).get_dataframes()
        print("Comparing ...")
        summary = DiffEngine(config, *frames).run()
    except ConfigError as problem:
        print(f"\nThe comparison can't be set up:\n{problem}", file=sys.stderr)
        return 1
    except Exception as problem:  # the exit code reports every failure
        print(f"\nThe comparison broke off:\n{problem}", file=sys.stderr)
        return 1
    print(f"\n{summary.report_summary}")
    if config.output_path and not summary.is_match:
        print(f"The rows that differ are in {Path(config.output_path).absolute()}")
    return 0 if summary.is_match else 1


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="deltaloom", description="Compares two datasets by declared rules.")
    commands = parser.add_subparsers(dest="command", required=True)
    command = commands.add_parser("run", help="compare as a YAML file says")
    command.add_argument("-c", "--config", default="deltaloom.yaml", help="path of the YAML file")
    sys.exit(run(parser.parse_args(argv).config))


if __name__ == "__main__":
    main()
