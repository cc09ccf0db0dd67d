"""Language ID: held-out accuracy, rejection and odd rows."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from hustings.llm import language_id

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", language_id.held_out())
    model = language_id.fit(docs.filter("NOT held"))
    out = language_id.predict(docs.filter("held"), model)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert out.filter("rejected AND text RLIKE '[A-Za-z]'").count() == 0
    assert model.predict("Ωστόσο η γλώσσα αυτή είναι άγνωστη 语言 知识")[2]


ROWS = [(i, "the cat and the dog", "en", 1.0) for i in range(5)] + [(i, "der hund und die katze", "de", None) for i in range(5, 9)] + [(20, None, "en", 0.0), (21, "", "de", 0.0), (22, "123 !!", None, 0.0), (None, "the end of the day", None, 0.0), (23, "und die " * 20_000, None, 0.0)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, score double")
    out = language_id.predict(docs, language_id.fit(docs)).collect()
    assert len(out) == len(ROWS)
    for r in out:
        want = "und" if r.doc_id in (20, 21, 22) else "de" if "und" in r.text else "en"
        assert r.lang_pred == want and 0 <= r.score <= 1 and r.rejected == (want == "und")


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert [r.lang_pred for r in language_id.predict(docs, model).collect()] == ["und", "und"]
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_too_many_languages(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "'word' as text", "concat('l', id) as lang")
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(docs)


def test_counts_are_those_of_the_text_whole():
    a, b = language_id.counts("abc def"), language_id.counts("ABC   def!")
    assert np.array_equal(a, b) and a.sum() == 8 + 7 + 6


DUTCH = "Het was een mooie dag in de stad en de mensen liepen rustig door de straten terwijl de zon langzaam onderging achter de oude huizen"
FINNISH = "Kaupungin kaduilla kulki paljon ihmisiä jotka olivat matkalla töihin tai kouluun ja aurinko paistoi kirkkaasti vanhojen talojen yllä"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_gibberish_and_unlearned_languages_go(spark):
    rng = np.random.default_rng(1)
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    for size in (64, 300, 2000):
        for symbols in ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz     ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
            assert model.predict("".join(rng.choice(list(symbols), size)))[2]
    assert model.predict(DUTCH)[2] and model.predict(FINNISH)[2] and model.predict(DUTCH * 20)[2]
    for text in ("Von.", "That it.", "Pachque çaneux et.", "Des enberge die enver.", "Of anntre erthnd, thlyre to the."):
        assert not model.predict(text)[2]
    assert (model.limits > 0).all() and (np.linalg.norm(model.centroids, axis=0) > 0.99).all()


def plain_counts(text: str) -> dict[int, int]:
    """Hashed n-grams of 2 to 4 bytes, one by one."""
    kept = "".join(chr(c) if chr(c).isalpha() and c < 0x80 or c >= 0x80 else " " for c in text.lower().encode())
    raw = " " + " ".join(kept.split(" ")) + " "
    while "  " in raw:
        raw = raw.replace("  ", " ")
    out: dict[int, int] = {}
    for n in (2, 3, 4):
        for i in range(len(raw) - n + 1):
            h = ord(raw[i])
            for c in raw[i + 1 : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (ord(c) * 0x9E3779B1 & 0xFFFFFFFF)
            at = (h * 0x85EBCA6B & 0xFFFFFFFF) >> 18
            out[at] = out.get(at, 0) + 1
    return out


def unit(v: dict[int, float]) -> dict[int, float]:
    size = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / size for k, x in v.items()}


def dot(a: dict[int, float], b: dict[int, float]) -> float:
    return sum(x * b[k] for k, x in a.items() if k in b)


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_predictions_as_plain_centroids_give_them(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang IS NOT NULL AND length(text) BETWEEN 1 AND 3000 AND text RLIKE '[a-z]'")
    model = language_id.fit(docs, per_language=10_000)
    rows = docs.collect()
    assert len(rows) > 50
    seen = [plain_counts(r.text) for r in rows]
    held: dict[int, int] = {}
    for c in seen:
        for k in c:
            held[k] = held.get(k, 0) + 1
    idf = lambda k: math.log((1 + len(rows)) / (1 + held.get(k, 0))) + 1
    vectors = [unit({k: (1 + math.log(n)) * idf(k) for k, n in c.items()}) for c in seen]
    found = [({k: float(x) for k, x in enumerate(model.centroids[:, c]) if x}, lang) for c, lang in enumerate(model.languages)]
    for r, v in zip(language_id.predict(docs, model).collect(), vectors, strict=True):
        scores = [(dot(v, c), lang) for c, lang in found]
        best = max(s for s, _ in scores)
        assert abs(r.score - min(1.0, best)) < 1e-9
        assert r.lang_pred in {lang for s, lang in scores if s > best - 1e-9}
    for lang in set(model.languages):  # a centroid is the mean direction of the texts nearest to it
        own, near = [c for c, x in found if x == lang], {}
        for r, v in zip(rows, vectors, strict=True):
            if r.lang == lang:
                near.setdefault(max(range(len(own)), key=lambda i: dot(v, own[i])), []).append(v)
        for i, vs in near.items():
            mean: dict[int, float] = {}
            for v in vs:
                for k, x in v.items():
                    mean[k] = mean.get(k, 0.0) + x
            assert dot(unit(mean), own[i]) > 0.99


def test_a_null_id_is_not_held_out(spark):
    df = spark.createDataFrame([(None,), (1,), (4,)], "doc_id long")
    import zlib

    got = [r[0] for r in df.select(language_id.held_out()).collect()]
    assert got == [False, zlib.crc32(b"1") % 3 == 1, zlib.crc32(b"4") % 3 == 1]
