import re

import pytest

from sparkloom.llm import ask, op3_jaccard as op

ROWS = "doc_id bigint, text string, lang string, key string, root int"


def gram_set(text, n=op.N):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(texts, threshold=op.THRESHOLD):
    """Groups of row numbers, by comparing all pairs."""
    sets = [gram_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j < i}:
            shared = len(s & sets[j])
            if shared >= threshold * len(s | sets[j]):
                root[find(i)] = find(j)
    found = {}
    for i, s in enumerate(sets):
        if s:
            found.setdefault(find(i), []).append(i)
    return {tuple(x) for x in found.values() if len(x) > 1}


def brute_links(texts, threshold=op.THRESHOLD):
    """Of each row in a group: the number of rows of its text, and of different texts that are similar."""
    out = {}
    for group in brute(texts, threshold):
        sets = {texts[i]: gram_set(texts[i]) for i in group}
        linked = {t: sum(u != t and len(s & z) >= threshold * len(s | z) for u, z in sets.items()) for t, s in sets.items()}
        out |= {i: (texts.count(texts[i]), linked[texts[i]]) for i in group}
    return out


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    texts = [r.text for r in rows]
    group = {i: g[0] for g in brute(texts) for i in g}
    found = brute_links(texts)
    expected = {(rows[i].doc_id, rows[g].doc_id, *found[i]) for i, g in group.items()}
    got = [tuple(r) for r in op.query(spark, "/root/testdata/sf0.01").collect()]
    assert len(expected) > 40 and any(x[3] > 1 for x in expected)
    assert len(got) == len(set(got)) and set(got) == expected


def near_copies():
    import random

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(120)]
    texts = []
    for _ in range(60):
        x = list(base)
        for i in r.sample(range(120), r.randint(0, 14)):
            x[i] = r.choice(vocabulary)
        texts.append(" ".join(x))
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 90))) for _ in range(60)]
    return texts + ["", None, "one", "one", "One two", "one  two!", texts[0], texts[0]]


@pytest.mark.parametrize(("threshold", "hot", "block"), [(0.5, op.HOT, op.BLOCK_BYTES), (0.8, 3, 4000), (0.5, 2, 9000)])
def test_many_near_copies_and_odd_rows(spark, threshold, hot, block):
    """Small limits split lists of grams and groups into cells; nothing changes."""
    texts = near_copies()
    rows = [(None if i % 17 == 3 else i // 2, t, None, "k", 1) for i, t in enumerate(texts)]
    docs = ask.steady(spark.createDataFrame(rows, ROWS).repartition(3))
    got = {}
    named = {}
    links = brute_links(texts, threshold)
    for r in op.groups(docs, threshold, hot=hot, block=block).collect():
        got.setdefault(r.root, []).append((r.doc_id is None, r.doc_id or 0))
        named[r.key] = r
    expected = brute(texts, threshold)
    assert sorted(map(sorted, got.values())) == sorted(sorted((rows[i][0] is None, rows[i][0] or 0) for i in g) for g in expected)
    place = {i: (rows[i][0], *links[i]) for g in expected for i in g}
    assert sorted(map(str, place.values())) == sorted(str((r.doc_id, r.copies, r.links)) for r in named.values())
    kept = op.dedup(docs, threshold)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - sum(len(g) - 1 for g in expected)


def test_empty_table(spark):
    docs = spark.createDataFrame([], ROWS)
    assert op.dedup(docs).count() == 0
    assert op.groups(ask.steady(docs)).count() == 0


def test_a_very_long_text(spark):
    long = " ".join(f"a{i * 7919 % 100_003}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long, "", "", 0), (2, long.replace("a5 ", "b5 "), "", "", 0), (3, "a1 a2 a3", "", "", 0)], ROWS)
    assert sorted((r.doc_id, r.copies, r.links) for r in op.groups(ask.steady(docs)).collect()) == [(1, 1, 1), (2, 1, 1)]
