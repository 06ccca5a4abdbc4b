import itertools
import random
import re

import numpy as np
import pytest

from sparkloom.llm import op5_toxicity as op

SF = "/root/testdata/sf0.01"
ROWS = "doc_id bigint, text string, score string, words int"


@pytest.fixture(scope="module")
def parts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, op.fit(docs, labels), op.log_model(op.counts(docs))


def test_counts_are_exact(spark, parts):
    docs = parts[0]
    text = [r.text for r in docs.limit(40).collect()] + ["Élan über señor"]
    want = np.zeros((27,) * 4, int)
    symbols = [0, 0, 0] + [ord(op.bare(c)) - 96 if op.bare(c) in op._LETTERS else 0 for c in " ".join(text).lower() + " "]
    one = spark.createDataFrame([(" ".join(text),)], "text string")
    for x in zip(symbols, symbols[1:], symbols[2:], symbols[3:]):
        want[x] += 1
    assert (op.counts(one).reshape((27,) * 4) == want).all()


def test_held_out_labels(spark, parts):
    """Documents of all languages, outside the sample, get the labels that they have; few clean ones are flagged."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    lexicons = op.fit(docs, labels.where("doc_id % 2 = 0"))
    assert {"en", "de", "fr"} <= set(lexicons)
    scorer = op.Scorer(lexicons, parts[3])
    rows = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("text", "lang", "toxic").toArrow()
    langs, truth = rows.column("lang").to_pylist(), rows.column("toxic").to_pylist()
    found = scorer.scan(rows.column("text").combine_chunks(), langs)
    hit = [sum(found.get(i, ({}, 0))[0].values()) >= op.LEAST_SCORE for i in range(len(truth))]
    for lang in ("en", "de", "fr"):
        toxic = [h for h, t, x in zip(hit, truth, langs) if t and x == lang]
        clean = [h for h, t, x in zip(hit, truth, langs) if not t and x == lang]
        assert len(toxic) > 20 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean), lang


def test_copies_teach_no_words(spark):
    """A toxic document that is copied often adds none of its words but those that other documents have too."""
    named = lambda i: "x" + chr(97 + i // 26) + chr(97 + i % 26)
    rows = [(i, f"the {'same words of one copied text stand here for ever'} and vilé now") for i in range(40)]
    rows += [(100 + i, f"some {named(i)} vilé {named(i)} text") for i in range(40)] + [(200 + i, f"some {named(i)} good {named(i)} text") for i in range(80)]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in rows], "doc_id bigint, toxic int")
    assert set(op.fit(docs, labels)["xx"]) == {"vilé"}


def test_query_matches_brute_force(spark, parts):
    """Each word and piece of each document by itself, without skeletons or arrays."""
    docs, _, lexicons, model = parts
    got = {r.doc_id: (round(r.score, 6), r.words) for r in op.query(spark, SF).collect()}
    want = {}
    for r in docs.collect():
        lexicon = lexicons.get(r.lang) or {w: o for x in lexicons.values() for w, o in x.items()}
        low = r.text.lower()
        words = {w for w in re.findall(r"[^\W\d_]+", low) if w in lexicon}
        stands = {op.folded(w): w for w in sorted(lexicon, key=lexicon.get)}
        alike = "".join(c for c in op.LOOK_ALIKES if not c.isalpha())
        parts_ = []
        for pattern in (rf"(?:[^\W\d_]|[{re.escape(alike)}])+", r"(?:[^\W_]|[!-/:-@\[-`{-~])+"):
            for m in re.finditer(pattern, low):
                parts_ += {m.group(), m.group().strip("!-/:;<=>?[]^_`{}~\"#%&'()*,.\\@$|+")}
        letters = {op.skeleton(w) for w in lexicon}
        for piece in set(parts_):
            if re.search(r"[^\W\d_]", piece) and op.skeleton(re.sub(r"[!-/:-@\[-`{-~](?<![@$!|+])", "", piece)) in letters | {op.skeleton(re.sub(r"[!-/:-@\[-`{-~]", "", w)) for w in letters}:
                words |= {w for w in [stands.get(op.restore(piece, model))] if w and (any(c.isdigit() for c in piece) or op.accents(piece) == op.accents(w))}
        score = sum(lexicon[w] for w in words)
        if score >= op.LEAST_SCORE:
            want[r.doc_id] = (round(score, 6), sorted(words))
    assert len(want) > 20 and got == want


def test_hidden_words_are_restored(parts):
    _, _, lexicons, model = parts
    lexicon = lexicons["en"]
    finder = op.Finder(lexicon, model)
    r = random.Random(4)
    back = {"o": "0", "i": "1!", "l": "1|", "s": "5$", "a": "4@", "e": "3", "t": "7"}
    made, total = 0, 0
    import pyarrow as pa

    for w in sorted(lexicon):
        leet = "".join(r.choice(back[c]) if c in back and k != 1 else c for k, c in enumerate(w))
        one = next((w.replace(c, back[c][0], 1) for c in w if c in back), w)
        long = "".join(c * (3 if c == w[2] else 1) for c in w)
        for text in (leet, one, long, " ".join(w), ".".join(w), "-".join(w.upper()), leet + "!!", "**" + w[:2] + "*" + w[2:], " ".join(leet), w[:2] + " " + w[2:4] + " " + w[4:6] + " " + w[6:8] + " " + w[8:], " - ".join(w), " ".join(c * (1 + k % 2) for k, c in enumerate(w))):
            found = finder.scan(pa.array([f"The and that {text} for the with."]))
            total += 1
            made += w in found.get(0, ({}, 0))[0]
    assert made >= 0.9 * total


def test_viterbi_is_the_best_path(parts):
    """Against all letters that a piece may stand for."""
    model = parts[3]

    def cost(piece, letters):
        s = [0, 0, 0] + [ord(c) - 96 for c in letters] + [0]
        lm = -sum(float(model[tuple(s[k : k + 4])]) for k in range(len(s) - 3))
        return lm + sum(op.ALIKE for c in piece if c in op.LOOK_ALIKES)

    for piece in ("1d10t", "m0r0n", "5cum", "l05er", "cl0wn"):
        options = [c if c in op._LETTERS else op.LOOK_ALIKES[c] for c in piece]
        best = min(("".join(x) for x in itertools.product(*options)), key=lambda x: cost(piece, x))
        assert op.restore(piece, model) == best


def test_odd_rows(spark, parts):
    docs, labels, lexicons, _ = parts
    word = max(lexicons["en"], key=len)
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, f"the {' '.join(word)} and", "x", 1), (4, "the and " * 30_000 + word, "x", 1), (4, "the and " * 30_000 + word, "x", 1), (5, "a a a a a a a", "x", 1)]
    mine = spark.createDataFrame(rows, ROWS)
    both = docs.select("doc_id", "text", "lang").where("doc_id >= 6").unionByName(mine.selectExpr("doc_id", "text", "null as lang"))
    got = [r for r in op.flagged(both, labels, least=3.0).collect() if r.doc_id is None or r.doc_id < 6]
    assert sorted((str(r.doc_id), r.words) for r in got) == [("4", [word]), ("4", [word]), ("None", [word])]
    assert op.flagged(mine, labels.limit(0)).count() == 0
    assert op.flagged(mine.limit(0), labels).count() == 0


def test_accents(parts):
    """Accented words are found plainly, and without their accents where they are disguised; words of one language don't count in another."""
    import pyarrow as pa

    scorer = op.Scorer({"fr": {"vequée": 7.0}, "de": {"schlächt": 7.0}}, parts[3])
    texts = pa.array(["un vequée là", "un v3quee là", "un v e q u é e là", "un schlächt", "VEQUÉE", "vequéeuse", "vequee"])
    found = scorer.scan(texts, ["fr"] * 4 + [None, "fr", "fr"])
    assert sorted(found) == [0, 1, 2, 4] and all(set(w) == {"vequée"} for w, _ in found.values())
