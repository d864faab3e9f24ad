import pytest
from pyspark.sql import functions as F

from quillstone.functions import analysis as an
from quillstone.functions import text as tx

TEXTS = ["Larch 2.0: CAFÉ déjà-vu! β42", "The quick brown fox is in the yard.", "", None, "  a\tb\n", "Œuvre cœur Straße Łódź", "foo_bar x12 it's"]


@pytest.mark.parametrize("kind", ["standard", "simple", "stop", "whitespace", "keyword", "norm", "normalizer", "search", "edge_ngram"])
def test_columns_agree_with_the_host(spark, kind):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r["i"]: r["x"] for r in rows.select("i", an.tokens(F.col("t"), kind).alias("x")).collect()}
    assert got == {i: an.host_tokens(t or "", kind) for i, t in enumerate(TEXTS)}


def test_offsets_and_positions():
    got = [(t["token"], t["start_offset"], t["end_offset"]) for t in an.analyze("Larch 2.0: CAFÉ déjà-vu! β42", "simple")]
    assert got == [("larch", 0, 5), ("café", 11, 16), ("déjà", 17, 23), ("vu", 24, 26), ("β", 28, 30)]
    got = [(t["token"], t["position"]) for t in an.analyze("The quick brown fox is in the yard.", "stop")]
    assert got == [("quick", 1), ("brown", 2), ("fox", 3), ("yard", 7)]
    assert [t["start_offset"] for t in an.analyze(["é a", "b"])] == [0, 3, 4]
    with pytest.raises(ValueError):
        an.analyze("x", "norm")


@pytest.mark.parametrize("given, want", [("Œuvre cœur", "OEuvre coeur"), ("Straße", "Strasse"), ("Łódź", "Lodz"), ("Ærø", "AEro"), ("Þór Eð", "THor Ed"), ("Mỹ", "My"), (None, None)])
def test_folding(given, want):
    assert an.fold(given) == want


@pytest.mark.parametrize("a, b, n", [("kitten", "sitten", 1), ("larch", "lrach", 1), ("roam", "foam", 1), ("encyclopedia", "encyclopaedia", 1), ("ca", "abc", 3), ("", "ab", 2), ("same", "same", 0)])
def test_edit_distance(a, b, n):
    assert tx.osa(a, b, 3) == n == tx.osa(b, a, 3)


def test_near_terms_by_expression_equal_the_host(spark):
    words = ["larch", "lrach", "lach", "largh", "march", "launch", "Larch", "l", "alrhc", "larchab"]
    rows = spark.createDataFrame([(w, [w]) for w in words], "w string, t array<string>")
    for edits in (0, 1, 2):
        got = {r["w"] for r in rows.filter(tx.within_edits(F.col("t"), "larch", edits)).collect()}
        assert got == {w for w in words if tx.osa("larch", w) <= edits}
    terms = rows.select(F.col("w").alias("term"))
    assert [r["term"] for r in tx.expand_fuzzy(terms, "larch", 1, prefix=1, limit=3).collect()] == ["larch", "lach", "largh"]


def test_fuzziness():
    assert [tx.fuzziness("AUTO", n) for n in (2, 3, 5, 6)] == [0, 1, 1, 2]
    assert tx.fuzziness("AUTO:1,2", 1) == 1
    for bad in ("3", "x", True):
        with pytest.raises(ValueError):
            tx.fuzziness(bad, 3)


@pytest.mark.parametrize("n, df, tf, dl, mean, want", [(10, 2, 1, 100, 100, 1.4816045409242156), (10, 2, 3, 120, 100, 2.2325547876940237), (100, 10, 2, 50, 100, 3.6219924154844509), (1000, 500, 1, 80, 100, 0.7549127709068711)])
def test_bm25(spark, n, df, tf, dl, mean, want):
    got = spark.range(1).select(tx.bm25(F.lit(tf), F.lit(dl), tx.idf(n, df), float(mean)).alias("s")).first()["s"]
    assert got == pytest.approx(want, rel=1e-12)


def test_quantised_lengths(spark):
    got = [r["q"] for r in spark.range(0, 3000).select(tx.quantised_length(F.col("id").cast("int")).alias("q")).collect()]
    assert got == [tx.quantise(i) for i in range(3000)]
    assert got[:33] == [*range(33)] and all(a <= b for a, b in zip(got, got[1:]))
