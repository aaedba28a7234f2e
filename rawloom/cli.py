"""Command line: compress, decompress and offload."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rawloom.functions.columns import human_bytes
from rawloom.functions.errors import FrameError
from rawloom.operators.compare import summary
from rawloom.plans import pipelines
from rawloom.session import local_session


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="rawloom", description="Lossless compression and verified copies of raw frames")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("compress", "decompress"):
        one = commands.add_parser(name)
        one.add_argument("input")
        one.add_argument("--out", required=True)
        if name == "compress":
            one.add_argument("--no-verify", action="store_true")
    one = commands.add_parser("offload")
    one.add_argument("source")
    one.add_argument("--to", action="append", required=True)
    return out


def report(stats: DataFrame) -> str:
    """One line about a run over frames."""
    total = summary(stats)
    row = total.select("frames", "ratio", human_bytes("input_bytes").alias("a"), human_bytes("output_bytes").alias("b")).first()
    return f"{row['frames']} frame(s): {row['a']} -> {row['b']} ({row['ratio'] * 100:.1f}%)"


def report_offload(copies: DataFrame) -> tuple[str, bool]:
    total = pipelines.offload_report(copies).withColumn("size", human_bytes("total_bytes")).first()
    lines = [f"{total['verified']} file(s) verified, {total['failed']} failed, {total['size']}"]
    for row in copies.where("error is not null or status != 'Verified'").select("relative", F.coalesce("error", "status_error", "status").alias("why")).collect():
        lines.append(f"  {row['relative']}: {row['why']}")
    return "\n".join(lines), total["all_verified"]


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    spark = local_session()
    try:
        if given.command == "offload":
            text, good = report_offload(pipelines.offload(spark, given.source, given.to))
            print(text)
            return 0 if good else 1
        if given.command == "compress":
            print(report(pipelines.compress(spark, given.input, given.out, pipelines.CompressOptions(not given.no_verify))))
        else:
            print(report(pipelines.decompress(spark, given.input, given.out)))
        return 0
    except FrameError as e:
        print(f"error: {e.message}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
