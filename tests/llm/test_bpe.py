import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.llm.bpe import PATTERN, TOKENIZERS, ByteBPE, RankQueue, token_count, token_ids

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    own = ByteBPE(PATH)
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("aeinst '\n0é日", max_size=300))
def test_same_ids_as_the_reference_encoder(pair, text):
    own, other = pair
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text) and own.decode(ids) == text


def test_known_texts(pair):
    own, other = pair
    for text in ("<|endoftext|> is text", "I'll we've DON'T", "  two  spaces \r\n\r\n", "a" * 3000, "日本語のテキスト" * 50, "\u200d👨\u200d👩\u200d👧", "".join(random.Random(1).choices("abcdeéñ日", k=5000))):
        assert own.encode(text) == other.encode_ordinary(text)
    assert own.encode("") == []


def test_the_other_library_agrees(pair):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("<|endoftext|> plain", "How 12 things  work…"):
        assert t.encode(text, add_special_tokens=False).ids == pair[0].encode(text)


def test_long_pretokens_take_time_in_proportion(pair):
    def seconds(n):
        text = "".join(random.Random(2).choices("abcdefgh", k=n))
        began = time.perf_counter()
        pair[0].encode(text)
        return time.perf_counter() - began

    seconds(20_000)
    assert seconds(200_000) < 40 * max(seconds(20_000), 0.01)


def test_rank_queue():
    q = RankQueue(300_000)
    assert q.first() == -1
    for rank in (70_000, 5, 299_999, 5, 64):
        q.push(rank, rank + 1)
    order = []
    while (r := q.first()) >= 0:
        order.append((r, q.take(r)))
    assert order == [(5, [6, 6]), (64, [65]), (70_000, [70_001]), (299_999, [300_000])]


def test_columns(spark, pair):
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "x" * 50000), (1, "hello world")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id int, text string, ids string")
    got = [(r["doc_id"], r["i"], r["n"]) for r in df.select("doc_id", token_ids(F.col("text")).alias("i"), token_count(F.col("text")).alias("n")).collect()]
    assert got == [(i, pair[0].encode(t or ""), len(pair[0].encode(t or ""))) for i, t in rows]
    assert df.limit(0).select(token_ids(F.col("text"))).count() == 0
