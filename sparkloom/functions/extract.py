"""Recognisers as native expressions over single lines or words, without the cascade's contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+-]*@(?:[\p{L}\p{M}\p{N}-]+\.)+[\p{L}\p{M}]{2,}"
URL = r"(?:https?|ftps?)://[^\s<>\"]*[^\s<>\"'.,;:!?()\[\]{}]"
TAG = r"</?[A-Za-z][A-Za-z0-9_:.-]*(?:\s+[A-Za-z0-9_:.-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'))*\s*/?>"
HASHTAG = r"[#@][\p{L}\p{M}\p{N}_]+"
NUMBER = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+\.[0-9]+|[0-9]+"
FILENAME = r"[\p{L}\p{M}\p{N}_./-]*[\p{L}\p{M}\p{N}_-]\.(?:csv|docx?|gif|html?|jpe?g|json|md|pdf|png|py|txt|xml|zip)"
CLITIC = r"(?i)^([a-z]+)(['’](?:s|ve|re|ll|m|d|em))$"
PRODUCT = r"^\p{Lu}+-[\p{Lu}0-9]{1,3}s?$"
PERIODS = r"^(?:\p{L}{1,2}\.){2,}$"
SYMBOLS = r"[\x{2190}-\x{2BFF}\x{1F300}-\x{1F64F}]+"


def all_of(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def words(c: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(c, r"[ \t\r\f\x0B]+"), lambda w: w != "")


def basic_type(c: Column) -> Column:
    """letter, then number, symbol, punctuation, others."""
    return F.when(c.rlike(r"\p{L}"), "WORD-B").when(c.rlike(r"\p{N}"), "NUMBER-B").when(c.rlike(r"\p{S}"), "SYMBOL-B").when(c.rlike(r"\p{P}"), "PUNCT-B").otherwise("MISC-B")


def split_integer(c: Column) -> Column:
    """C20: an integer in front of letters or a slash is set apart."""
    return F.regexp_replace(c, r"^([0-9]+)([/\p{L}])", "$1 $2")


def split_hyphen(c: Column) -> Column:
    """A dash between letters becomes a marked token."""
    return F.regexp_replace(c, r"(\p{L}\p{L})-(?=\p{L}\p{L})", "$1 @-@ ")


def split_punct(c: Column) -> Column:
    """C19 for the most common marks at the end of a word."""
    return F.regexp_replace(c, r"^([^.,!?]*[^.,!?\s])([.,]|[!]+|[?]+)$", "$1 $2")


def adjusted(original: Column, target: Column) -> Column:
    """the original's capitals on the target."""
    return F.when(F.lower(original) == F.lower(target), original).when((F.length(original) > 1) & (original == F.upper(original)) & original.rlike(r"^\P{L}*\p{L}.*\p{L}"), F.upper(target)).when(original.rlike(r"^\P{L}*\p{Lu}"), F.concat(F.upper(F.substring(target, 1, 1)), F.substring(target, 2, 1 << 20))).otherwise(target)
