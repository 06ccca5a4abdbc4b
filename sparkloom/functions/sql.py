"""Tokenization and helpers as SQL functions: vectorized ones for columns, and a table function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import rules
from sparkloom.operators.cascade import LANGUAGES, tokenizer
from sparkloom.operators.detok import detokenizer


def _code(lang: str | None) -> str:
    return LANGUAGES.get(lang or "", lang or "")


@F.pandas_udf(T.StringType())
def tokenize(text: pd.Series, lang: pd.Series) -> pd.Series:
    """Joined surfaces of the tokens of (text, lang), without normalization; a null text gives a null."""
    return pd.Series([None if t is None else tokenizer(_code(g), rules.HERE, False).string(t) for t, g in zip(text, lang)])


@F.pandas_udf(T.StringType())
def detokenize(text: pd.Series, lang: pd.Series) -> pd.Series:
    """The text that (tokens, lang) restore; a null gives a null."""
    return pd.Series([None if t is None else detokenizer(_code(g), rules.HERE).string(t) for t, g in zip(text, lang)])


@F.pandas_udf(T.StringType())
def strip_diacritics(text: pd.Series) -> pd.Series:
    """lower case without combining marks, a key to sort by."""
    return pd.Series([None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower() for t in text])


@F.udtf(returnType=T.StructType([T.StructField("tok_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("sem_class", T.StringType()), T.StructField("surf", T.StringType())]))
class TokenTable:
    """The tokens of (text, lang) as rows."""

    def eval(self, text: str, lang: str):
        for i, t in enumerate(tokenizer(_code(lang), rules.HERE, False).tokens(text or "")):
            yield i, t.start, t.end, t.type, t.sem_class, t.surf


def register(spark: SparkSession) -> None:
    """Makes tokenize, detokenize, strip_diacritics and the table function tokenize_table known to SQL."""
    spark.udf.register("tokenize", tokenize)
    spark.udf.register("detokenize", detokenize)
    spark.udf.register("strip_diacritics", strip_diacritics)
    spark.udtf.register("tokenize_table", TokenTable)


#: Names of slots and heads in the older rule format.
_OLD = {"lc": "lcode", "sem": "sem-class", "case": "case-sensitive", "left": "left-context", "right": "right-context"}


def current_rule(line: Column) -> Column:
    """an entry of the older rule format in the current one."""
    line = F.regexp_replace(line, r"^::token (?=\S*\.(?:\s|$))", "::abbrev ")
    line = F.regexp_replace(line, r"^::token ", "::lexical ")
    for old, new in _OLD.items():
        line = F.regexp_replace(line, rf"(?<=\s)::{old} ", f"::{new} ")
    return line
