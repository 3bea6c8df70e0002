"""``python -m maskmix FILE_BASE ELEC_NO [--option value ...]``; options are the configuration fields."""

from __future__ import annotations

import argparse
import dataclasses
import logging

from pyspark.sql import SparkSession

from maskmix.config import MixtureConfig
from maskmix.plans.program import cluster_files


def parse(argv: list[str] | None = None) -> tuple[MixtureConfig, str, str | None]:
    parser = argparse.ArgumentParser(prog="maskmix")
    parser.add_argument("file_base")
    parser.add_argument("elec_no", type=int)
    parser.add_argument("--start-labels", default="")
    parser.add_argument("--journal", default=None, help="folder of this fit's progress; goes on from what it holds")
    for f in dataclasses.fields(MixtureConfig):
        if f.name in ("file_base", "elec_no"):
            continue
        kind = type(f.default)
        read = (lambda v: v.lower() in ("1", "true", "yes")) if kind is bool else kind
        parser.add_argument("--" + f.name.replace("_", "-"), type=read, default=f.default)
    values = vars(parser.parse_args(argv))
    start, journal = values.pop("start_labels"), values.pop("journal")
    return MixtureConfig(**values), start, journal


def main() -> None:
    config, start, journal = parse()
    logging.basicConfig(level=logging.INFO if config.verbose else logging.WARNING)
    cluster_files(SparkSession.builder.appName("maskmix").getOrCreate(), config, start, journal)


if __name__ == "__main__":
    main()
