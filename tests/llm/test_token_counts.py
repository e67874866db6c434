import random

import pytest
from tokenizers import Tokenizer

from commitlens.llm import token_counts as C
from llm.conftest import SF, rows_of

LIBRARY = Tokenizer.from_file(C.tokenizer_path())
BITS = ["a", "b", " ", "  ", "\n", "'re", "'s", "'l", "!", "é", "日", "1", "23", "<|endoftext|>", "<|en", "\t", "\xa0", "==", "x'v", "don't", "\x1c", "²", "😀", "--------", "aaaa"]


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return C.TokenCounter(C.tokenizer_path())


def texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_query_matches_the_library(spark, documents):
    got = rows_of(C.op8_token_counts(spark, SF), "doc_id")
    for d in documents.collect():
        n = count(d.text or "")
        whole = d.text or ""
        cut = got[d.doc_id]["truncate_at"]
        assert cut == len(whole) if n <= 1024 else count(whole[:cut]) <= 1024 < count(whole[:cut + 1])
        assert (got[d.doc_id]["n_bytes"], got[d.doc_id]["n_tokens"], got[d.doc_id]["over_limit"]) == (len((d.text or "").encode()), n, n > 1024)


def test_random_texts_match_the_library(counter):
    for t in texts(3000, 14, 1):
        assert counter.count(t) == count(t), t


def test_every_prefix_matches_the_library(counter):
    for t in texts(400, 12, 2):
        assert counter.prefix_counts(t).tolist() == [count(t[:i]) for i in range(len(t) + 1)], t


def test_stored_counts(spark, counter):
    rows = [*texts(40, 30, 5), "", "a" * 3000, " " * 400 + "x" + "\n" * 300 + " y", "x " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")
    got = rows_of(C.with_prefix_counts(df).withColumn("all", C.prefix_array()), "id")
    for i, t in enumerate(rows):
        assert got[i]["all"] == counter.prefix_counts(t).tolist() and got[i]["all"][-1] == count(t)
    assert len(got[len(rows) - 1]["prefix_tokens"]) < len(rows[-1]) / 4
    far = [0, 500, -3, 5]
    assert C.counts_of(C.packed(__import__("numpy").array(far))).tolist() == far


def test_truncation(spark, counter):
    rows = texts(30, 40, 3) + ["", "plain words and more of them"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")
    cut = rows_of(C.truncate(C.with_prefix_counts(df), 5), "id")
    for i, t in enumerate(rows):
        assert cut[i]["text"] == max((t[:k] for k in range(len(t) + 1) if count(t[:k]) <= 5), key=len)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "word", None), (3, "word", None), (None, "x" * 50_000, "y"), (4, "ab cd " * 50_000, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, prefix_tokens string")
    got = [(r.doc_id, r.text, r.n) for r in df.withColumn("n", C.token_count_column()).collect()]
    assert len(got) == len(rows) and all(n == count(t or "") for _, t, n in got)
    assert C.with_prefix_counts(df.where("doc_id = 1")).select(C.prefix_array()).first()[0] == [0]
    assert C.with_prefix_counts(df.limit(0)).collect() == []


def test_only_lengths_of_tokens_that_end_so_are_tried(counter):
    assert all(len(token) in counter.ends[token[-3:]] for token in counter.parts if len(token) > 2)
    assert all(lengths == tuple(sorted(lengths, reverse=True)) for lengths in counter.ends.values())
    assert all(any(end[1:] in counter.parts if n == 2 else token_of(counter, end, n) for n in lengths) for end, lengths in list(counter.ends.items())[:200])
    for t in ["a", "ab", "zzzzqqqq", " thththat", "é" * 7, "\x00\x01\x02" * 5, "ing" * 20, "日本語" * 3]:
        assert counter.prefix_counts(t).tolist() == [count(t[:i]) for i in range(len(t) + 1)], t


def token_of(counter, end, n):
    return any(len(token) == n and token.endswith(end) for token in counter.parts)
