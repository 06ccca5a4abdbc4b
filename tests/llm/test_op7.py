from sparkloom.llm import op7_language as op

SF = "/root/testdata/sf0.01"
ROWS = "doc_id bigint, text string, lang string, cosine string, extra int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fitted, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    got = op.accepted(rest, fitted).select("lang", "language").collect()
    assert len(got) > 0.97 * rest.count()
    assert sum(r.lang == r.language for r in got) >= 0.98 * len(got)


def test_bundles_are_sums_of_bound_vectors():
    import numpy as np
    import pyarrow as pa

    text = "Ab é"
    (block,) = op.bundles(pa.array([text]), 64)
    s = [0, ord("a"), ord("b"), 0, ord("é"), 0]
    want = sum(op.trigram_vector(*s[i : i + 3], 64) for i in range(len(s) - 2))
    assert np.allclose(block[0], want)


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, prototypes = op.fit(docs)
    assert names == ["de", "en", "es", "fr"]
    rows = [(1, None, None, "old", 1), (2, "", "en", "old", 1), (3, "123 !!", "en", "old", 1), (None, "the and that of " * 50, None, "old", 1), (None, "the and that of " * 50, None, "old", 1), (5, "une quelle " * 90_000, "fr", "old", 1)]
    mine = spark.createDataFrame(rows, ROWS)
    out = op.identify(mine, names, prototypes)
    assert out.columns == ["doc_id", "text", "lang", "extra", "language", "cosine", "margin"]
    got = sorted((str(r.doc_id), r.language) for r in out.collect())
    assert got == [("1", None), ("2", None), ("3", None), ("5", "fr"), ("None", "en"), ("None", "en")]
    assert op.accepted(mine, docs).count() == 3
    assert op.accepted(mine.limit(0), docs).count() == 0
    assert op.accepted(mine, docs.limit(0)).count() == 0


def test_short_clean_documents_stay(spark):
    """First words of documents outside the fit, by language; letters at random still go, long or short."""
    import random

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(3)
    texts = docs.where("doc_id % 2 = 1 and length(text) > 200").selectExpr("doc_id", "lang", "substring(text, 1, 30) as text")
    junk = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz    ", k=k)) for k in [30] * 100 + [2000] * 100]
    both = texts.unionByName(spark.createDataFrame([(None, None, x) for x in junk], texts.schema))
    kept = [x.lang for x in op.accepted(both, docs.where("doc_id % 2 = 0")).collect()]
    for lang, n in texts.groupBy("lang").count().collect():
        assert kept.count(lang) >= 0.9 * n
    assert kept.count(None) <= 0.1 * len(junk)
