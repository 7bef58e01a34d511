"""python -m xylem FILE PATH: the number of matches and the first ten.  Exit 1 if the document is malformed, 2 for a bad path."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .operators.validate import MalformedXmlError
from .plans.xpath_ast import XPathSyntaxError, parse_xpath


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="xylem", description=__doc__)
    parser.add_argument("file")
    parser.add_argument("path")
    parser.add_argument("--skip-misc", action="store_true", help="accept prolog, comments and DOCTYPE")
    args = parser.parse_args(argv)
    try:
        parse_xpath(args.path)
    except XPathSyntaxError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    try:
        docs = Engine(spark).load(args.file, skip_misc=args.skip_misc).valid(strict=True)
    except MalformedXmlError as e:
        print(f"Invalid XML: {e}", file=sys.stderr)
        return 1
    print(f"Matches found: {docs.count(args.path)}")
    for i, raw in enumerate(docs.preview(args.path), 1):
        print(f"Match {i}: {raw}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
