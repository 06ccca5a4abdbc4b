import collections
import math
import random
import re

from sparkloom.llm import op6_decontaminate as op

ROWS = "doc_id bigint, text string, item_id bigint, similarity int"
ITEMS = "item_id bigint, text string"


def bag(w):
    return collections.Counter(zip(w, w[1:])) if len(w) > 1 else collections.Counter(w)


def brute(text, items, similarity=op.SIMILARITY):
    """The best similarity of each item that some window of the text reaches."""
    words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    bags = [(i, len(w), bag(w)) for i, t in items if (w := words(t))]
    has = collections.Counter(s for _, _, b in bags for s in b)
    weigh = lambda s: math.log1p(len(bags) / max(has[s], 1))
    w, out = words(text), {}
    every = set(zip(w, w[1:])) | set(w)
    for item, size, b in bags:
        if not every & set(b) or not w:
            continue
        for a in range(max(1, len(w) - size + 1)):
            c = bag(w[a : a + size])
            low = sum(min(c[s], b[s]) * weigh(s) for s in b)
            high = sum(n * weigh(s) for s, n in c.items()) + sum(n * weigh(s) for s, n in b.items()) - low
            if low / high >= similarity:
                out[item] = max(out.get(item, 0), low / high)
    return out


def test_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    r = random.Random(1)
    pool = docs[0][1].split()
    for k in range(80):
        w = r.choice(items)[1].split()
        for _ in range(r.randint(0, len(w) // 6)):
            w[r.randrange(len(w))] = r.choice(pool)
        docs.append((1000 + k, " ".join(r.choices(pool, k=r.randint(0, 40)) + w + r.choices(pool, k=r.randint(0, 40)))))
    docs = [(i, t) for i, t in docs if i >= 1000 or len(t) < 1500]
    want = {(i, item): s for i, t in docs for item, s in brute(t, items).items()}
    got = {(x.doc_id, x.item_id): x.similarity for x in op.find(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, ITEMS)).collect()}
    assert len(want) > 40
    assert set(got) <= set(want)
    assert len(got) >= 0.9 * len(want)  # the fingerprints' recall
    assert all(got[k] >= op.SIMILARITY - 1e-9 and abs(got[k] - want[k]) < 0.1 for k in got)


def test_parts_and_odd_rows(spark):
    item = "thatness whereof sundry elements combine to yield nine peculiar outcomes for all"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "word"), (None, item), (5, item + " and more")], ITEMS)
    rows = [(1, f"Before: {item}! After", 9, 9), (1, f"Before: {item}! After", 9, 9), (None, item.upper(), 9, 9), (2, None, 9, 9), (3, "", 9, 9), (4, "word", 9, 9), (5, "nothing of that kind", 9, 9), (6, "x " * 5000 + item, 9, 9)]
    docs = spark.createDataFrame(rows, ROWS)
    whole = sorted(map(str, op.find(docs, items).collect()))
    assert whole == sorted(map(str, op.find(docs, items, most=60).collect()))
    found = {(x.doc_id, x.item_id) for x in op.find(docs, items).collect()}
    assert {(1, 1), (None, 1), (1, None), (4, 4), (6, 1)} <= found
    left = op.clean(docs, items)
    assert left.columns == docs.columns
    assert sorted(x.doc_id for x in left.collect()) == [2, 3, 5]
    assert op.find(docs.limit(0), items).count() == 0
    assert op.clean(docs, items.limit(0)).count() == len(rows)
