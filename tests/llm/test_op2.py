import re

from sparkloom.llm import op2_licenses as op

ROWS = "doc_id bigint, text string, license string, words int"


def as_regex(markup):
    """The template as a backtracking expression over words."""
    out, at = "", 0
    for m in [*op._MARK.finditer(markup), None]:
        out += "".join(re.escape(w) + " " for w in op.words(markup[at : m.start() if m else len(markup)]))
        if m is None:
            break
        at = m.end()
        out += "(?:" if m[1] == "beginOptional" else ")?" if m[1] == "endOptional" else "(?:[^ ]+ ){0,%s}" % m[2]
    return re.compile(out)


def brute(text, templates):
    out = []
    w = op.words(text or "")
    for name, markup in templates.items():
        r, at = as_regex(markup), 0
        while at < len(w):
            rest = " ".join(w[at:]) + " "
            m = r.match(rest)
            n = m.group().count(" ") if m else 0
            if n:
                out.append((name, at, n))
            at += max(1, n)
    return sorted(out)


def test_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *x) for r in docs for x in brute(r.text, op.TEMPLATES))
    assert len(want) > 2
    assert sorted(tuple(r) for r in op.query(spark, sf).collect()) == want


def test_templates_match_their_own_wording():
    plain = tuple(sorted(op.TEMPLATES.items()))
    for name, markup in op.TEMPLATES.items():
        full = re.sub(r"<<(?:begin|end)Optional>>", " ", re.sub(r"<<var;match=\d+>>", " ", markup))
        assert name in {x[0] for x in op.scan(f"Some words before. {full} And after.", plain)}
        bare = markup
        while "<<begin" in bare:
            bare = re.sub(r"<<beginOptional>>(?:(?!<<(?:begin|end)Optional>>).)*<<endOptional>>", " ", bare, flags=re.S)
        bare = re.sub(r"<<var;match=\d+>>", " ", bare)
        assert name in {x[0] for x in op.scan(bare, plain)}


def test_markup():
    t = {"x": "alpha beta <<beginOptional>>gamma <<beginOptional>>delta<<endOptional>><<endOptional>> omega <<var;match=2>> last"}
    key = tuple(t.items())
    good = ["alpha beta omega last", "Alpha, beta gamma omega one last", "alpha beta gamma delta omega one two last", "alpha beta omega last last"]
    bad = ["alpha omega last", "alpha beta delta omega last", "alpha beta omega one two three last", "alpha beta omega", "beta omega last"]
    assert all(op.scan(x, key) == brute(x, t) != [] for x in good)
    assert all(op.scan(x, key) == brute(x, t) == [] for x in bad)
    twice = "alpha beta omega last. alpha beta alpha beta omega last"
    assert op.scan(twice, key) == brute(twice, t) and len(op.scan(twice, key)) == 2


def test_odd_rows(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "Released under the MIT Licence.", "x", 1), (4, "word " * 100_000 + "CC0 1.0 Universal", "x", 1)]
    docs = spark.createDataFrame(rows + rows[2:3], ROWS)
    got = [tuple(r) for r in op.find(docs).collect()]
    assert sorted(got, key=str) == [(4, "CC0-notice", 100_000, 4), (None, "MIT-notice", 0, 5), (None, "MIT-notice", 0, 5)]
    assert op.find(docs.limit(0)).count() == 0


def full(markup):
    return re.sub(r"<<(?:begin|end)Optional>>|<<var;match=\d+>>", " ", markup)


def test_altered_wording_is_not_accepted():
    """A mandatory word that is changed, left out or doubled ends the match, wherever it is."""
    assert len(op.TEMPLATES) > 60
    changed = 0
    for name, markup in op.TEMPLATES.items():
        key = ((name, markup),)
        a = op.compiled(key)[0][name]
        at, kept = 0, []
        depth = 0
        for m in [*op._MARK.finditer(markup), None]:
            kept += [(w, depth == 0) for w in op.words(markup[at : m.start() if m else len(markup)])]
            if m is None:
                break
            at, depth = m.end(), depth + {"beginOptional": 1, "endOptional": -1}.get(m[1], 0)
        fixed = [i for i, (_, mandatory) in enumerate(kept) if mandatory]
        text = [w for w, _ in kept]
        assert op.scan(" ".join(text), key) == [(name, 0, len(text))] and {kept[i][0] for i in fixed} == a.mandatory
        for i in fixed[:: max(1, len(fixed) // 4)]:
            assert op.scan(" ".join([*text[:i], "otherwise", *text[i + 1 :]]), key) == brute(" ".join([*text[:i], "otherwise", *text[i + 1 :]]), {name: markup})
            if "<<var" not in markup:
                assert op.scan(" ".join([*text[:i], "otherwise", *text[i + 1 :]]), key) == []
                changed += 1
    assert changed > 40


def test_other_licenses_with_the_same_beginning():
    plain = tuple(sorted(op.TEMPLATES.items()))
    names = lambda text: {x[0] for x in op.scan(text, plain)}
    mit, json = full(op.TEMPLATES["MIT"]), full(op.TEMPLATES["JSON"])
    assert names(mit) == {"MIT"} and names(json) == {"JSON"}
    assert names(mit.split("THE SOFTWARE IS")[0]) == set() and names(mit.replace("AUTHORS", "X").replace("WITHOUT WARRANTY", "WITH WARRANTY")) == set()
    two, three = full(op.TEMPLATES["BSD-2-Clause"]), full(op.TEMPLATES["BSD-3-Clause"])
    assert names(two) == {"BSD-2-Clause"} and names(three) == {"BSD-3-Clause"}
    assert names(three.replace("prior written", "written")) == set()


def test_prefilter_passes_each_template():
    automata, _ = op.compiled(tuple(sorted(op.TEMPLATES.items())))
    words = op.telling(list(automata.values()))
    assert len(words) < 20 and all(any(a.mandatory.issuperset(w) for w in words) for a in automata.values())
    assert all(len(w) == 1 or "cc" in w for w in words)
