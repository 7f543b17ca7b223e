"""python -m burstlake PATHS... -o FOLDER: CR2 files to JPEG, without decoding (survey O11, P11).

Exit codes: 0 all done, 1 some failed, 2 wrong arguments or nothing to do.
"""

from __future__ import annotations

import argparse
import os
import sys


def parsed(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("burstlake")
    p.add_argument("paths", nargs="+")
    p.add_argument("-o", "--out", required=True)
    p.add_argument("--suffix", default="")
    p.add_argument("--min-ratio", type=float, default=0.4)
    p.add_argument("--max-side", type=int, default=0)
    p.add_argument("--workers", type=int, default=0)
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--prefer-dpp", action="store_true")
    p.add_argument("--flat", action="store_true", help="don't look into folders of folders")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    # The ranges that arguments may have.
    for name, low, high in (("min_ratio", 0.0, 1.0), ("workers", 0, 64), ("max_side", 0, 1 << 20)):
        if not low <= getattr(a, name) <= high:
            p.error(f"--{name.replace('_', '-')} is from {low} to {high}")
    if 0 < a.max_side < 32:
        p.error("--max-side is 0 or at least 32")
    if any(c in '\\/:*?"<>|' or ord(c) < 32 for c in a.suffix) or a.suffix.strip(" .") not in ("", a.suffix):
        p.error("--suffix can't follow a name")
    if os.path.exists(a.out) and not os.path.isdir(a.out):
        p.error(f"{a.out} is no folder")
    return a


def main(argv: list[str] | None = None) -> int:
    a = parsed(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators.sinkplan import plan_names
    from .sources import convert, files

    builder = SparkSession.builder if not a.workers else SparkSession.builder.master(f"local[{a.workers}]")
    spark = builder.getOrCreate()
    found, problems = files.inputs(spark, a.paths, not a.flat, ("cr2",))
    for r in problems.collect():
        print(f"{r.path}: {r.problem}", file=sys.stderr)
    plan = found.select(F.lit(a.out).alias("out_dir"), F.concat("stem", F.lit(a.suffix)).alias("stem"), F.col("path").alias("src"), F.monotonically_increasing_id().alias("pos"))
    plan = plan_names(plan, policy="telling").where("dst_name is not null").select(F.col("src").alias("path"), "dst_name")

    @F.udf("binary")
    def read(path):  # a name may begin with an underscore, which Spark's own file sources leave out
        with open(path, "rb") as f:
            return f.read()

    options = convert.Options(prefer_dpp=a.prefer_dpp, max_side=a.max_side, min_share=a.min_ratio)
    made = convert.convert_files(plan.withColumn("content", read("path")), options)
    done = made.select("path", "ok", "message") if a.dry_run else convert.write_files(made, a.out, a.overwrite)
    rows = done.select("path", "ok", "message").orderBy("path").collect()
    for r in rows:
        print(f"{'ok    ' if r.ok else 'failed'} {r.path}{'' if r.ok else ': ' + r.message}")
    return 2 if not rows else int(not all(r.ok for r in rows))


if __name__ == "__main__":
    sys.exit(main())
