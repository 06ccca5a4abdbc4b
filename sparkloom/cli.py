"""Command line: tokenize or detokenize text files with Spark.

    python -m sparkloom.cli tokenize -i IN -o OUT --lc eng [-a ANNOTATION] [-f]

Without -i the driver reads STDIN, and without -o it prints the lines in order, both
meant for little text; files and folders are read and written by all executors.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import __version__, rules
from sparkloom.operators.cascade import tokenized
from sparkloom.operators.detok import detokenized
from sparkloom.sources import lines, sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sparkloom")
    out.add_argument("--version", action="version", version=__version__)
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("tokenize", "detokenize"):
        p = sub.add_parser(name)
        p.add_argument("-i", "--input", help="file or folder of text files (default: STDIN)")
        p.add_argument("-o", "--output", help="folder for the lines (default: STDOUT)")
        p.add_argument("-d", "--data-directory", "--data_directory", default=rules.HERE, help="folder of rule files")
        p.add_argument("--lc", default="", help="language code")
        p.add_argument("-f", "--first-token-is-line-id", "--first_token_is_line_id", action="store_true")
        p.add_argument("-v", "--verbose", action="store_true", help="rules that are wrong, and how many lines and tokens there are, to STDERR")
        p.add_argument("-pb", "--progress-bar", action="store_true", help="show the progress of stages")
        if name == "tokenize":
            p.add_argument("-a", "--annotation-file", "--annotation_file", help="folder for the annotation")
            p.add_argument("--annotation-format", "--annotation_format", default="json", help="json, or any other for double-colon")
            p.add_argument("-c", "--chart", action="store_true", help="annotate, even without a folder for it: to STDERR")
            p.add_argument("--simple", action="store_true", help="no marks for attachment")
    return out


def _text_lines(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    source = lines.read_text(spark, args.input) if args.input else lines.from_strings(spark, sys.stdin.buffer.read().removesuffix(b"\n").split(b"\n"))
    found = source.withColumn("lang", F.lit(args.lc))
    number = F.col("line_no").cast("string")
    if not args.first_token_is_line_id:
        return found.withColumn("line_id", number).withColumn("head", F.lit(""))
    own = lines.line_id(F.col("text"))  # a line without a sentence keeps its place, with no tokens
    return found.withColumn("line_id", F.coalesce(own, number)).withColumn("head", F.coalesce(F.concat(own, F.lit(" ")), F.lit(""))).withColumn("text", F.when(own.isNotNull(), lines.sentence(F.col("text"))).otherwise(""))


def _write(df: DataFrame, column, path: str | None, out=None) -> None:
    if path is None:
        for row in df.select("path", "line_no", column.alias("value")).orderBy("path", "line_no").toLocalIterator():
            print(row.value, file=out or sys.stdout)
        return
    df.repartitionByRange("path", "line_no").sortWithinPartitions("path", "line_no").select(column.alias("value")).write.mode("errorifexists").text(path)


def _report_rules(args: argparse.Namespace) -> None:
    """What is wrong with the rule files that are used."""
    for name in (args.lc, "eng-global", "base", "detok"):
        place = os.path.join(args.data_directory, f"{name}.txt")
        if name and os.path.exists(place):
            heads, slots = (rules.DETOK_HEADS, rules.DETOK_SLOTS) if name == "detok" else (rules.TOKEN_HEADS, rules.TOKEN_SLOTS)
            with open(place, encoding="utf-8") as f:
                for no, line, problem in rules.parse(f.read(), heads, slots)[1]:
                    print(f"{place}, line {no}: {problem}: {line}", file=sys.stderr)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparkloom").config("spark.ui.showConsoleProgress", str(args.progress_bar).lower()).getOrCreate()
    if args.verbose:
        _report_rules(args)
    source = _text_lines(spark, args)
    if args.command == "detokenize":
        made = detokenized(source.withColumnRenamed("text", "tokenized"), args.data_directory)
        _write(made, F.concat("head", "detokenized"), args.output)
        return
    made = tokenized(source, args.data_directory, args.simple)
    if args.verbose:
        n = made.select(F.count("*").alias("lines"), F.sum(F.size("tokens")).alias("tokens"), F.sum((F.col("snt") != F.col("text")).cast("int")).alias("changed")).first()
        print(f"{n['lines']} lines, {n['tokens'] or 0} tokens, {n['changed'] or 0} lines normalized", file=sys.stderr)
    _write(made, F.concat(F.col("head"), sinks.joined(F.col("tokens"))), args.output)
    if args.annotation_file or args.chart:
        form = sinks.annotation if args.annotation_format == "json" else sinks.double_colon
        _write(made, form(F.col("line_id"), F.col("snt"), F.col("tokens")), args.annotation_file, sys.stderr)


if __name__ == "__main__":
    main()
