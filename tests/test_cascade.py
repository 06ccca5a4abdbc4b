import os
import pathlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators.cascade import Known, Tokenizer, adjust_case, align, annotated, counted, exploded, joined_lines, pieces, tokenized
from sparkloom.plans import queries
from sparkloom.sources import sinks

ENG = Tokenizer("eng")


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("Mary isn't here.", "Mary is n't here ."),
        ("WON'T they?", "WILL N'T they ?"),
        ("They cannot, we'll see", "They can not , we 'll see"),
        ("Pay $1,250.50 now!!!", "Pay $ 1,250.50 now !!!"),
        ("a well-known case", "a well @-@ known case"),
        ("my T-shirts and father-in-law", "my T-shirts and father-in-law"),
        ("mail to ann.lee@mail.example.org, or see http://example.org/a?b=1.", "mail to ann.lee@mail.example.org , or see http://example.org/a?b=1 ."),
        ("visit example.com/path today", "visit example.com/path today"),
        ("#tag and @user: hi", "#tag and @user @: hi"),
        ('She said "hi" twice', 'She said "@ hi @" twice'),
        ("the F-16C flew 90km north", "the F-16C flew 90 km north"),
        ("K. L. Moss and K.L.Moss", "K. L. Moss and K. L. Moss"),
        ("open <b class=\"x\">bold</b> text", "open <b class=\"x\"> bold </b> text"),
        ("read /usr/local/bin and notes.txt", "read /usr/local/bin and notes.txt"),
        ("said /tɛst/ loudly", "said /tɛst/ loudly"),
        ("et al. went", "et al. went"),
        ("12weeks and 7/8", "12 weeks and 7 @/@ 8"),
        ("🎉🎉 yes", "🎉🎉 yes"),
        ("ca n't recieving", "can n't receiving"),
        ("-5 and 3-4", "-5 and 3 @-@ 4"),
        ("", ""),
        ("   ", ""),
        ("Frankfurt-am-Main is big", "Frankfurt-am-Main is big"),
    ],
)
def test_english(text, tokens):
    assert ENG.string(text) == tokens


def test_other_languages():
    assert Tokenizer("fra").string("l'eau du lac") == "l' eau de le lac"
    assert Tokenizer("spa").string("Vamos al mar.") == "Vamos a el mar ."
    assert Tokenizer("deu").string("z.B. das Haus") == "z.B. das Haus"
    assert Tokenizer("mal").string("൧,൨൩,൪൫൬ ആണ്.") == "൧,൨൩,൪൫൬ ആണ് ."
    assert Tokenizer("").string("dont") == "dont" and ENG.string("dont") == "do n't"


def test_simple_mode():
    assert Tokenizer("eng", simple=True).string('a "b" well-known') == 'a " b " well - known'


def test_types_and_spans():
    found = [(t.start, t.end, t.type, t.sem_class, t.surf) for t in ENG.tokens("Dr. Lee owes $20.")]
    assert found == [(0, 3, "ABBREV", "pre-name-title", "Dr."), (4, 7, "WORD-B", None, "Lee"), (8, 12, "WORD-B", None, "owes"), (13, 14, "PUNCT", "currency-unit", "$"), (14, 16, "NUMBER", None, "20"), (16, 17, "PUNCT-E", None, ".")]


def test_paths_agree():
    """Words looked up one by one give what the whole line gives."""
    for _, text in queries.LITERALS:
        assert ENG.tokens(text) == list(ENG._line(text))


def test_contexts_see_the_whole_line(tmp_path):
    (tmp_path / "eng.txt").write_text("::lexical big deal ::left-context ^see.{40,60} ::sem-class far\n::lexical small deal ::left-context-not (?:^|\\s)no\\s.{50,}\n")
    walk = Tokenizer("eng", str(tmp_path))
    classes = lambda text: [(t.surf, t.sem_class) for t in walk._line(text) if " " in t.surf]
    assert classes("see " + "x " * 24 + "big deal") == [("big deal", "far")]
    assert classes("see " + "x " * 80 + "big deal") == classes("sea " + "x " * 24 + "big deal") == []
    assert classes("yes " + "x " * 40 + "small deal") == [("small deal", None)] and classes("no " + "x " * 40 + "small deal") == []


def test_general_contexts(tmp_path):
    """What isn't cut off: letters in quotes, chains with ampersands, Hebrew words, and abbreviations before single letters."""
    (tmp_path / "eng.txt").write_text("::lexical c'\n::lexical AD\n::abbrev etc.\n::abbrev a.\n::lexical d'\n::lexical 한국\n::lexical mk ::right-context \\p{Nd}\n::punct-split \" ::side both\n::punct-split ' ::side both\n")
    walk = Tokenizer("eng", str(tmp_path))
    got = lambda text: walk.string(text)
    assert got("IA&AD AD") == "IA&AD AD" and [t.type for t in walk.tokens("IA&AD AD")] == ["WORD-B", "LEXICAL"]
    assert got("d's d'x") == "d 's d' x"
    assert got("צה\"ל ok\"x") == "צה\"ל ok \" x"
    assert [t.surf for t in walk.tokens("etc.x etc.xy") if t.type == "ABBREV"] == ["etc."] or got("etc.x") == "etc.x"
    assert got("mk5 ABC한국") == "mk 5 ABC 한국"


def test_phonetic_initials_before_a_space():
    mal = Tokenizer("mal")
    assert mal.tokens("എഫ്. ആണ്") == list(mal._line("എഫ്. ആണ്")) and mal.tokens("എഫ്. ആണ്")[0].type == "ABBREV-IP"


def test_long_lines_in_proportion():
    """Paired marks and contexts cost the same in a long line."""
    import time

    walk = Tokenizer("eng")

    def seconds(n):
        start = time.perf_counter()
        walk._line('a "b" well-known *c* ' * n)
        return time.perf_counter() - start

    seconds(50)
    few = min(seconds(500) for _ in range(3))
    assert min(seconds(2000) for _ in range(2)) < 10 * max(few, 0.02)


def test_columns_that_clash(spark):
    rows = [(1, "a well-known case.", "en", 7, "mine")]
    out = tokenized(spark.createDataFrame(rows, "id int, text string, lang string, lang_code int, __lang_code string")).collect()[0]
    assert (out.lang_code, out["__lang_code"], len(out.tokens)) == (7, "mine", 6)


def test_published_lines():
    """Inputs NAME.LANG.txt (with line ids) and their tokens, NAME.LANG.tok, of a folder that the environment names."""
    folder = os.environ.get("TOKEN_GOLDENS")
    if not folder:
        pytest.skip("TOKEN_GOLDENS isn't set")
    checked = 0
    for source in pathlib.Path(folder).rglob("*.txt"):
        for want in pathlib.Path(folder).rglob(f"{source.stem}.tok"):
            walk = Tokenizer(source.stem.rpartition(".")[2])
            for line, expected in zip(source.read_text().splitlines(), want.read_text().splitlines(), strict=True):
                name, _, text = line.partition(" ")
                assert f"{name} {walk.string(text)}" == expected
                checked += 1
    assert checked


def test_alignment():
    assert align("can't", ["can", "n't"]) == [(0, 2, "ca"), (2, 5, "n't")] or align("can't", ["can", "n't"])[1] == (2, 5, "n't")
    assert align("cannot", ["can", "not"], "3,3") == [(0, 3, "can"), (3, 6, "not")]
    assert [adjust_case(*x) for x in (("Du", "de"), ("DU", "de"), ("du", "de"), ("'Em", "them"))] == ["De", "DE", "de", "Them"]


def test_invariants(spark):
    lines = queries._cascade_input(spark, "/root/testdata/sf0.001")
    for r in tokenized(lines).collect():
        last = 0
        for t in r.tokens:
            assert t.start >= last and t.end > t.start and t.orig_surf == r.snt[t.start : t.end]
            last = t.end
        covered = "".join(t.orig_surf for t in r.tokens)
        assert "".join(covered.split()) == "".join(r.snt.split())


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "word " * 20_000, "xx"), (4, "a b", None)]
    out = tokenized(spark.createDataFrame(rows, "id int, text string, lang string"))
    assert out.columns == ["id", "text", "lang", "snt", "tokens"]
    assert sorted((r.id, len(r.tokens)) for r in out.collect()) == [(1, 0), (2, 0), (3, 20_000), (4, 2)]
    assert exploded(out, "id").count() == 20_002


def test_texts_without_tokens(spark):
    """Joined texts are those of the tokens, and no token goes through the plan."""
    rows = [(i, text, g) for i, (_, text) in enumerate(queries.LITERALS) for g in ("en", "fr", None)] + [(99, None, "en"), (98, "İst No. st. x", "de")]
    df = spark.createDataFrame(rows, "id int, text string, lang string")
    want = {(r.id, r.lang): (r.snt, " ".join(t.surf for t in r.tokens)) for r in tokenized(df).collect()}
    assert {(r.id, r.lang): (r.snt, r.tokenized) for r in joined_lines(df).collect()} == want
    for q in (queries.tokenize_full, queries.detokenize_roundtrip):
        assert "orig_surf" not in q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().treeString()


def test_known_words_are_bounded():
    asked = []
    known = Known(lambda x: asked.append(x) or x, most=3, longest=4)
    for x in "a b a long5 long5 c d a".split():
        assert known[x] == x and len(known) <= 3
    assert asked == ["a", "b", "long5", "long5", "c", "d", "a"]


def test_counts_without_tokens(spark):
    """Counts are those of the tokens, for null keys too, and no token goes through the plan."""
    rows = [(i % 3 or None, text, g) for i, (_, text) in enumerate(queries.LITERALS) for g in ("en", "fr", None)] + [(7, None, "en"), (8, "İst No. st. x", "de"), (1, "5 <b>kg</b>", "en")]
    df = spark.createDataFrame(rows, "id int, text string, lang string")
    want = exploded(tokenized(df), "id", "lang").groupBy("id", "lang", "type", "sem_class").count()
    assert sorted(map(repr, map(tuple, counted(df, "id", "lang").collect()))) == sorted(map(repr, map(tuple, want.collect())))
    for q in (queries.tokenize_pages, queries.token_chart_types):
        assert "orig_surf" not in q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().treeString()


def test_worker_holds_parts_of_a_batch():
    """What is made at a time follows the bytes of the lines, not their number."""
    batch = pa.record_batch({"snt": ["x" * 600] * 10 + ["", None, "y" * 5000], "k": list(range(13))})
    parts = list(pieces(batch, "snt", 1000))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(13))
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("snt").to_pylist()) <= 1000 for p in parts)


def test_annotations_without_tokens(spark):
    """The worker's annotations are the native ones, character by character."""
    rows = [(str(i), text, g) for i, (_, text) in enumerate(queries.LITERALS) for g in ("en", "fr")]
    rows += [(None, "no id", "en"), ("7", None, "en"), ("8", 'q "b" \\ c/d \t tab \r and \x7f \u2028 é 😀 <b>x</b>', "en"), ('9"', "", "de")]
    df = spark.createDataFrame(rows, "id string, text string, lang string")
    native = tokenized(df).select("id", "lang", sinks.annotation(F.col("id"), F.col("snt"), F.col("tokens")).alias("a")).withColumn("b", sinks.annotation_to_double_colon(F.col("a")))
    want = {(r.id, r.lang): (r.a, r.b) for r in native.collect()}
    assert {(r.id, r.lang): r.a for r in annotated(df, "a", sinks.JSON, "id").collect()} == {k: a for k, (a, _) in want.items()}
    assert {(r.id, r.lang): r.b for r in annotated(df, "b", sinks.DOUBLE_COLON, "id").collect()} == {k: b for k, (_, b) in want.items()}
    for q in (queries.annotation_json, queries.annotation_double_colon):
        assert "orig_surf" not in q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().treeString()
