"""From documents to token ids: language ID, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents.

Nulls, empty texts, repeated rows, empty tables and further columns are handled as
the operators' modules say: a text without letters is rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common, op3_jaccard, op6_decontaminate, op7_language, op9_sentencepiece, op10_lines

#: Lines may occur so often; lines beyond that are boilerplate. Near copies are no boilerplate,
#: however many they are: all but one of a group go before lines are counted.
LINE_COPIES = 5


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names (an operator's results) renamed, and their new names."""
    moved = {}
    for c in docs.columns:
        if c.lower() in names:
            moved[c] = common.unused(f"{c}_own", docs)
            docs = docs.withColumnRenamed(c, moved[c])
    return docs, moved


def _back(out: DataFrame, columns: list[str], moved: dict[str, str]) -> DataFrame:
    return out.select(*(F.col(moved[c]).alias(c) if c in moved else F.col(c) for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; prototypes are fitted on documents of the table."""
    labelled = common.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    own, moved = _aside(docs, "language", "cosine", "margin")
    return _back(op7_language.accepted(own, labelled), docs.columns, moved)


def _one_of_copies(docs: DataFrame) -> DataFrame:
    """docs with one of each group of near duplicates that hold lines of more than LINE_COPIES places."""
    name = common.unused("_held", docs)
    marked = common.stored(op10_lines.holding(docs, LINE_COPIES, name), "marked")
    some = op3_jaccard.dedup(marked.where(F.col(name)).drop(name))
    return some.unionByName(marked.where(~F.col(name)).drop(name))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document goes if nothing of it is left, and n_chars follows the text.

    Of near duplicates among the documents that hold repeated lines, judged by their whole
    texts, one stays; lines are counted over what is left, so that no copy survives as a
    fragment and the size of a group decides nothing."""
    own, moved = _aside(docs, "lines", "removed")
    own = _one_of_copies(own)
    out = op10_lines.dedup(own, LINE_COPIES).where("removed = 0 or lines > removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _back(out, docs.columns, moved)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return op3_jaccard.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op6_decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents left."""
    return op9_sentencepiece.encode(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard", near), ("decontamination", decontaminate), ("sentencepiece", encode)]

#: Hyperdimensional cosines and byte-pair merges are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = common.stored(docs, name)
    return docs
