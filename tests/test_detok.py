import pytest
from pyspark.sql import functions as F

from sparkloom.operators.cascade import Tokenizer
from sparkloom.operators.detok import Detokenizer, detokenized, detokenizer, unmarked
from sparkloom.rules import HERE

ENG = Detokenizer("eng")


@pytest.mark.parametrize(
    ("tokens", "text"),
    [
        ("It is n't bad , is it ?", "It isn't bad, is it?"),
        ("( $ 15 ) !!!", "($15)!!!"),
        ("a well @-@ known case", "a well-known case"),
        ('"@ Yes , @" said Ann', '"Yes," said Ann'),
        ("WILL N'T go", "WON'T go"),
        ("the 20 th of May", "the 20th of May"),
        ("<b> bold </b> text", "<b>bold</b> text"),
        ("", ""),
    ],
)
def test_english(tokens, text):
    assert ENG.string(tokens) == text


def test_round_trip():
    tok = Tokenizer("eng")
    for text in ("We can't stay; she'll go, won't she?", "A co-worker paid $3.50 (or so) for it.", 'He said "no" twice.', "See <i>that</i> page!"):
        assert ENG.string(tok.string(text)) == text


def test_table(spark):
    rows = [(1, "I do n't", "en"), (2, None, "en"), (3, "l' eau", "fr"), (4, "x", None)]
    out = detokenized(spark.createDataFrame(rows, "id int, tokenized string, lang string"))
    assert {r.id: r.detokenized for r in out.collect()} == {1: "I don't", 2: "", 3: "l'eau", 4: "x"}


def test_native_markup(spark):
    df = spark.createDataFrame([("peace @-@ loving",), ("a @:@ b",), ("x @- y",), ("x -@ y",)], "t string")
    assert [r[0] for r in df.select(unmarked(F.col("t"))).collect()] == ["peace-loving", "a:b", "x- y", "x -y"]


def test_columns_that_clash(spark):
    rows = [(1, "a well @-@ known case .", "en", 7, "mine")]
    for names in ("_lang int, lang_code string", "lang_code int, _lang string"):
        out = detokenized(spark.createDataFrame(rows, f"id int, tokenized string, lang string, {names}")).collect()[0]
        assert out.detokenized == "a well-known case." and {out["_lang"], out.lang_code} == {7, "mine"}


def test_long_lines_in_proportion():
    import time

    fold = detokenizer("eng", HERE)

    def seconds(n):
        start = time.perf_counter()
        fold.string("<b> word </b> " * n)
        return time.perf_counter() - start

    seconds(50)
    assert seconds(8000) < 12 * max(seconds(2000), 0.01)


def test_folds_in_proportion():
    """Contractions are folded in one pass; what is folded may go on with what follows."""
    import time

    def seconds(n):
        start = time.perf_counter()
        assert ENG.string("I do n't . " * n) == "I don't. " * (n - 1) + "I don't."
        return time.perf_counter() - start

    seconds(50)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.01)
    assert ENG._folded(["Do", "n't", "you", "WILL", "N'T"]) == ["Don't", "you", "WON'T"]


def test_words_alone_are_told_once():
    """Words that no rule knows are not looked at again with each occurrence."""
    fold, asked = Detokenizer("eng"), []
    rules_of = fold._rules
    fold._rules = lambda by, token: asked.append(token) or rules_of(by, token)
    assert fold.string("word , " * 100) == "word, " * 99 + "word,"
    assert sorted(set(asked)) == [",", "word"] and len(asked) == 4
