import math

import pytest
from pyspark.sql import functions as F

from termloom.functions import score as S


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first()["v"]


def test_tfidf(value):
    assert value(S.idf_tfidf(100, 10)) == pytest.approx(math.log(10) + 1)
    assert value(S.idf_tfidf(0, 0)) == 0 == value(S.idf_tfidf(10, 0))
    assert value(S.score_tfidf(0, 2.0)) == 0 and value(S.score_tfidf(1, 2.0)) == 2


def test_bm25(value):
    idf = lambda df: value(S.idf_bm25(1000, df))
    assert idf(5) > idf(900) > 0 == idf(0)
    sc = lambda tf, dl, b=0.75, avg=200.0: value(S.score_bm25(F.lit(tf), 1.0, F.lit(dl), avg, 1.2, b))
    assert sc(0, 100) == 0 and sc(10, 100) > sc(1, 100) and sc(3, 100) > sc(3, 500)
    assert sc(3, 100, b=0.0) == pytest.approx(sc(3, 500, b=0.0), abs=1e-9)
    assert sc(3, 100, avg=0.0) == pytest.approx(3 * 2.2 / (3 + 1.2 * (0.25 + 75)))
