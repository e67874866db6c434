import random

import sentencepiece

from commitlens.llm import sentencepiece as S
from llm.conftest import SF, rows_of

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=S.model_path())


def test_query_matches_the_library(spark, documents):
    tokens = rows_of(S.encode(documents.select("doc_id", "text")), "doc_id")
    for d in documents.collect():
        assert tokens[d.doc_id]["tokens"] == LIBRARY.encode(d.text or "")
    got = rows_of(S.op1_sentencepiece(spark, SF), "doc_id")
    assert all(g["round_trip"] and g["n_tokens"] == len(tokens[i]["tokens"]) for i, g in got.items())


def test_odd_texts_match_the_library(spark):
    rng = random.Random(4)
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "日本", "😀", "​", "1", "23", "don't", ".", "...", "_", "▁", "https://x.y/z?a=b", "aaaa", "\r\n", "Straße"]
    texts = ["", " ", "\n", "   x", "x   ", " \n ", "▁▁", "a" * 3000, "ab" * 40 + " " + "é" * 100, " " * 70, "x\n\n\ny"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, tokens string")
    got = rows_of(S.decode(S.encode(df)), "id")
    for i, t in enumerate(texts):
        assert got[i]["tokens"] == LIBRARY.encode(t), t
        assert got[i]["decoded"] == t.replace("▁", " "), t


def test_units_are_the_marked_text():
    rng = random.Random(6)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "▁", "é"]) for _ in range(rng.randint(0, 12)))
        marked = (S.MARK + t.replace(" ", S.MARK)) if t else ""
        assert "".join(S.units(t)) == marked
        assert all(u == "\n" or "\n" not in u for u in S.units(t))


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "same text", "y"), (3, "same text", "y"), (None, "same text", None), (4, "word " * 100_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, batch string")
    out = S.encode(df)
    assert out.columns == [*df.columns, "tokens"]
    got = out.collect()
    assert len(got) == len(rows)
    assert all(list(r.tokens) == LIBRARY.encode(r.text or "") for r in got)
    assert S.encode(df.limit(0)).collect() == []
    ids = spark.createDataFrame([([1, 5, None, 99_999_999, -1],), (None,), ([],)], "tokens array<int>")
    assert [r.decoded for r in S.decode(ids).collect()] == ["\x02", None, ""]
