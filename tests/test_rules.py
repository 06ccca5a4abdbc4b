from sparkloom import rules
from sparkloom.sources import rule_files


def test_parse_and_problems():
    text = "# note\n::abbrev Nr. ::lcode deu # why\n::contraction x'y\n::abbrev Z. ::odd 1 ::tag A ::tag B\nplain\n::lexical a::tag B"
    found, bad = rules.parse(text)
    assert [(r.kind, r.head, r.get("lcode")) for r in found][:2] == [("abbrev", "Nr.", "deu"), ("abbrev", "Z.", "")]
    problems = {(no, p) for no, _, p in bad}
    assert {(3, "missing slot target"), (4, "unknown slot odd"), (4, "repeated slot tag"), (5, "no head slot"), (6, "no space before ::")} <= problems


def test_short_form():
    found, bad = rules.parse("= contraction char-split=2,1 : ab -> a b | cd -> c d")
    assert not bad and [(r.head, r.get("target"), r.get("char-split")) for r in found] == [("ab", "a b", "2,1"), ("cd", "c d", "2,1")]


def heads(line):
    return {(r.kind, r.head, r.get("target")) for r in rules.expand(rules.parse(line)[0])}


def test_expansions():
    assert ("contraction", "it’s", "it ’s") in heads("::contraction it's ::target it 's")
    assert ("lexical", "co‑op", "") in heads("::lexical co-op")
    assert ("lexical", "mugs", "") in heads("::lexical mug ::plural +s")
    assert heads("::abbrev q.v.") >= {("abbrev", "q.v.", ""), ("repair", "q. v.", "q.v.")}
    assert {("repair", "hav", "have"), ("repair", "haved", "have")} & heads("::misspelling hav ::target have")
    assert {x for x in heads("::misspelling recomend ::target recommend ::suffix-variations s;ed")} == {("repair", "recomend", "recommend"), ("repair", "recomends", "recommends"), ("repair", "recomended", "recommended")}
    assert len(heads("::lexical no ::last-char-repeatable True")) == 128
    assert {("lexical", "colour", ""), ("lexical", "color", "")} <= heads("::lexical colour ::alt-spelling color")
    assert set(rules.spaced_abbreviations("a.b.c.")) == {"a. b.c.", "a.b. c.", "a. b. c."}


def test_shipped_rules_are_valid():
    import os

    for name in os.listdir(rules.HERE):
        if name != "tld.txt":
            args = (rules.DETOK_HEADS, rules.DETOK_SLOTS) if name == "detok.txt" else (rules.TOKEN_HEADS, rules.TOKEN_SLOTS)
            with open(os.path.join(rules.HERE, name), encoding="utf-8") as f:
                assert rules.parse(f.read(), *args)[1] == []


def test_languages_and_missing_files():
    assert rules.split_codes("spa, cat;fra") == ["spa", "cat", "fra"]
    assert rules.token_rules("zzz") == rules.token_rules("")
    assert rules.domains()["high"] == ("com", "edu", "net", "org")


def test_tables(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# c\n::abbrev Nr. ::lcode deu ::sem-class x\n\n::contraction du ::target de le # note\n", encoding="utf-8")
    got = [(r.line_no, r.kind, r.head, r.target, r.lcode, r.sem_class) for r in rule_files.rule_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [(2, "abbrev", "Nr.", None, "deu", "x"), (4, "contraction", "du", "de le", None, None)]
    assert rule_files.rule_table(spark, "eng").count() == len(rules.token_rules("eng"))
    assert rule_files.bad_lines(spark, "plain").first().problem == "no head slot"
