import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import analyze as A
from termloom.functions.ids import fnv1a64, path_id

TEXTS = ["Machine learning is amazing!", " a\t b \n", "", "!?.", "café world", "BM25 k1=1.2 C++ ÉCOLE 😀x", None, "x" * 5000 + " y"]
WORDS = {
    "documents": "document", "studies": "study", "running": "run", "learning": "learn", "learned": "learn", "quickly": "quick", "processing": "proces",
    "process": "process", "seeing": "se", "databases": "databas", "king": "king", "string": "str", "dies": "die", "thes": "the", "images": "imag", "kindness": "kind",
    "movement": "move", "ss": "ss", "bus": "bus", "buss": "buss", "cats": "cat",
}


def test_tokens_match_their_python_twin(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", A.tokens(F.col("t")).alias("x"))
    for r in df.collect():
        assert r["x"] == A.py_tokens(r["t"] or "")
    assert A.py_tokens("café world") == ["café", "world"]
    assert len(A.py_tokens("Machine learning is amazing!")) == 4


def test_stemmer(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", A.stem(F.col("w")).alias("s"))
    for r in df.collect():
        assert r["s"] == WORDS[r["w"]] == A.py_stem(r["w"])


def test_stemmer_twins_agree(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.text("abeinsgmtdlyé", min_size=1, max_size=9), min_size=300, max_size=300))
    def agree(words):
        df = spark.createDataFrame([(w,) for w in words], "w string").select("w", A.stem(F.col("w")).alias("s"))
        assert [r["s"] for r in df.collect()] == [A.py_stem(w) for w in words]

    agree()


def test_normalize():
    assert [A.py_normalize(w) for w in ("MACHINE", "the", "is", "and", "École")] == ["machine", "", "", "", "École"]
    assert A.py_normalize("custom", ["custom"]) == "" and A.py_normalize("the", ["custom"]) == "the"
    assert A.py_terms("The running of the documents") == ["run", "document"]


def test_terms_columns(spark):
    df = spark.createDataFrame([(1, "The cats and the DOGS of École"), (2, None), (3, "the of")], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", A.terms(F.col("t")).alias("x")).collect()}
    assert got == {1: ["cat", "dog", "École"], 2: [], 3: []}
    rows = sorted(tuple(r) for r in A.explode_terms(df, "i", "t").collect())
    assert rows == [(1, 0, "cat"), (1, 1, "dog"), (1, 2, "École")]


@pytest.mark.parametrize(
    ("text", "want"),
    [("# Head\nx", "Head"), ("\n \t\r\n## Two ", "Two"), ("#NoSpace", "#NoSpace"), ("", "stem"), (None, "stem"), ("#", "#"), ("plain line\nb", "plain line"), ("#  two", " two")],
)
def test_titles(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(A.title(F.col("t"), F.lit("stem"))).first()[0] == want


def test_path_ids(spark):
    assert (fnv1a64(""), fnv1a64("a")) == ("cbf29ce484222325", "af63dc4c8601ec8c")
    df = spark.createDataFrame([("a",), ("",), (None,), ("é/ü",)], "p string")
    assert [r[0] for r in df.select(path_id(F.col("p"))).collect()] == [fnv1a64("a"), fnv1a64(""), None, fnv1a64("é/ü")]
