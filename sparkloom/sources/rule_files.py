"""Rule files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import rules
from sparkloom.sources.lines import read_text


def slot(name: str):
    """The value of a slot of the column line, native."""
    return F.nullif(F.regexp_extract("line", rf"::{name}\s+([^\n]*?)(?=\s+::\S|\s*$)", 1), F.lit(""))


def rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, kind, head, and common slots) of entries in the long form."""
    lines = read_text(spark, path).select("path", "line_no", F.trim(F.regexp_replace("text", r"^\s*#.*$|(?<=\S)\s+#\s.*$", "")).alias("line"))
    entries = lines.where(F.col("line").startswith("::"))
    return entries.select("path", "line_no", F.regexp_extract("line", r"^::(\S+)", 1).alias("kind"), F.regexp_extract("line", r"^::\S+\s+([^\n]*?)(?=\s+::\S|\s*$)", 1).alias("head"), *(slot(s).alias(s.replace("-", "_")) for s in ("target", "lcode", "sem-class", "tag", "side", "char-split")))


def rule_table(spark: SparkSession, lang: str, folder: str = rules.HERE) -> DataFrame:
    """The expanded rules of a language: rule_no, kind, head, head_lc, target, sem_class, tag, side."""
    rows = [(r.no, r.kind, r.head, r.head.lower(), r.get("target") or None, r.get("sem-class") or None, r.get("tag") or None, r.get("side") or None) for r in rules.token_rules(lang, folder)]
    return spark.createDataFrame(rows, "rule_no int, kind string, head string, head_lc string, target string, sem_class string, tag string, side string")


def bad_lines(spark: SparkSession, text: str, detok: bool = False) -> DataFrame:
    """(line_no, line, problem) of a rule file's lines with problems."""
    heads, slots = (rules.DETOK_HEADS, rules.DETOK_SLOTS) if detok else (rules.TOKEN_HEADS, rules.TOKEN_SLOTS)
    return spark.createDataFrame(rules.parse(text, heads, slots)[1], "line_no int, line string, problem string")


def domain_table(spark: SparkSession, folder: str = rules.HERE) -> DataFrame:
    return spark.createDataFrame([(code, tier) for tier, codes in rules.domains(folder).items() for code in codes], "code string, reliability string")


def reverse_index(rules_: DataFrame) -> DataFrame:
    """the heads that stand for a target, by target."""
    return rules_.where("target is not null").groupBy("target").agg(F.sort_array(F.collect_set("head")).alias("heads"))
