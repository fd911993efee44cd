"""python -m inkwell build [PATH | -] --out DIR: a site from a bundle of Markdown (standard input without a path)."""

from __future__ import annotations

import argparse
import sys
from pathlib import PurePath

from pyspark.sql import SparkSession

from inkwell.operators.hyphenation import read_patterns, us_english_patterns
from inkwell.plans.site import Identity, site_files
from inkwell.sources.markdown import posts, read_bundles
from inkwell.sources.sink import STYLE, copy_asset, favicon, timer, write_site


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["build"])
    p.add_argument("path", nargs="?", default="-")
    p.add_argument("--out", required=True)
    p.add_argument("--patterns", help="a file of hyphenation patterns, one a line")
    p.add_argument("--asset", action="append", default=[], help="a file that goes beside the pages as it is; style.css and favicon.png replace the built-in ones")
    p.add_argument("--documented", action="store_true", help="documented rules instead of compatible output")
    p.add_argument("--title", default=Identity.title)
    p.add_argument("--host", default=Identity.host)
    a = p.parse_args()
    spark = SparkSession.builder.appName("inkwell").getOrCreate()
    with timer("total"):
        with timer("Parser"):
            bundles = spark.createDataFrame([("-", sys.stdin.read())], "bundle string, value string") if a.path == "-" else read_bundles(spark, a.path)
            patterns = read_patterns(spark, a.patterns) if a.patterns else us_english_patterns(spark)
            found = posts(bundles, patterns, compat=not a.documented).persist()
            n = found.count()
        with timer("Render"):
            if n:
                write_site(spark, site_files(found, Identity(title=a.title, host=a.host)), a.out, {f"{Identity.root}/style.css": STYLE, f"{Identity.root}/favicon.png": favicon()})
                for asset in a.asset:
                    copy_asset(asset, f"{a.out}/{Identity.root}", PurePath(asset).name)


if __name__ == "__main__":
    main()
