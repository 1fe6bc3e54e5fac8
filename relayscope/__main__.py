"""``python -m relayscope FILE_OR_FOLDER [--format text|json]``: analyse messages and print their reports."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="relayscope")
    parser.add_argument("path")
    parser.add_argument("--format", choices=("text", "json"), default="text")
    given = parser.parse_args(args)
    if not os.path.exists(given.path):
        print(f"no such file: {given.path}", file=sys.stderr)
        return 1
    from relayscope import pipeline
    from relayscope.operators.reports import json_reports, text_reports
    from relayscope.session import build_session, materialize
    from relayscope.sources import messages

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    found = messages.files(spark, given.path, "*")
    reports = pipeline.generate(materialize(messages.parse(found, "filename"), "parsed"), as_of=F.current_timestamp(), keep=True)
    whole = pipeline.whole_reports(reports)
    rows = (json_reports if given.format == "json" else text_reports)(whole)
    for row in rows.orderBy("msg_id").toLocalIterator():
        print(row["report"], end="\n\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
