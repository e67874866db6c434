import math
import re
from collections import Counter

import numpy as np

from commitlens.llm import quality as Q
from llm.conftest import SF, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_base_measures_match_brute_force(spark, documents):
    got = rows_of(Q.op10_quality_rules(spark, SF), "doc_id")
    docs = documents.collect()
    assert len(got) == len(docs)
    for d in docs:
        g, want = got[d.doc_id], brute_base(d.text)
        assert tuple(g[c] for c in Q.BASE) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert g["base_failed"] == failed
        assert not (failed and g["kept"])


def test_distance_against_definition():
    p, q = np.array([3, 1, 0, 4]), np.array([0.1, 0.2, 0.3, 0.4])
    u = p / p.sum()
    m = (u + q) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    assert abs(Q.distances(p, q[None])[0] - math.sqrt((kl(u) + kl(q)) / 2)) < 1e-12
    assert Q.distances(np.array([1, 0]), np.array([[0.0, 1.0]]))[0] == 1


def test_odd_rows(spark):
    kind = "doc_id bigint, text string, lang string, quality string"
    prose = "the cat sat on the mat and it was of the house that he had seen " * 2
    rows = [(1, None, None, "x"), (2, "", "en", None), (3, " \t\n", "en", "x"), (4, prose, "en", "x"), (4, prose, "en", "x"),
            (5, "a b c " * 300, "xx", "x"), (6, "word " * 200_000, "en", "x"), (None, "é\x85ü \x1f", None, None)]
    df = spark.createDataFrame(rows, kind)
    got = Q.quality_rules(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "lang", "quality"}
    by_id = {r.doc_id: r.quality for r in got}
    assert by_id[1].n_words == 0 and by_id[1].base_failed and not by_id[1].kept
    assert by_id[5].n_repeat_words == 900 and by_id[6].n_repeat_words == 200_000
    assert by_id[None].n_words == 2 and by_id[None].word_chars == 4
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    assert Q.quality_rules(df.limit(0)).collect() == [] and Q.keep_good(df.limit(0)).collect() == []


def test_junk_goes_and_prose_stays(spark, documents):
    good = documents.where("lang = 'en'").collect()
    prose = [r for r in good if len((r.text or "").split()) > 150 and not re.search(r"[#*$%&|]", r.text)][:5]
    junk = " ".join(w + "$$$ %%%" for w in prose[0].text.split())
    df = documents.select("doc_id", "text", "lang").union(spark.createDataFrame([(-1, junk, "en")], "doc_id bigint, text string, lang string"))
    got = rows_of(Q.quality_rules(df), "doc_id")
    assert not got[-1]["quality"].kept
    assert all(got[r.doc_id]["quality"].class_distance < 0.2 for r in prose)


def test_labelled_rows(spark):
    """On labelled rows: no good text that passes the base rules is lost."""
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality")
    judged = Q.op10_quality_rules(spark, path).where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    counts = {(r.quality, r.kept): r["count"] for r in judged}
    assert counts.get((1, False), 0) == 0
    assert counts[(0, False)] > counts.get((0, True), 0)


def test_other_languages_have_references_of_their_own(spark, documents):
    """Clean texts of any script stay; junk among them goes."""
    rng = np.random.default_rng(3)
    rows = []
    for lang, first in (("ru", 0x430), ("el", 0x3B1), ("ar", 0x627), ("ko", 0xAC00)):
        vocabulary = ["".join(chr(first + int(k)) for k in rng.integers(0, 24, rng.integers(2, 9))) for _ in range(2000)]
        share = 1 / np.arange(1, 2001)
        for i in range(30):
            words = rng.choice(vocabulary, 300, p=share / share.sum())
            rows.append((len(rows), " ".join(words) + ".", lang))
        rows.append((len(rows), " ".join(f"{w}$$$ %%%#{k}" for k, w in enumerate(words)), f"{lang}"))
    rows.append((len(rows), rows[0][1], "uk"))
    df = documents.select("doc_id", "text", "lang").where("doc_id < 0").union(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    table = df.union(documents.selectExpr("doc_id + 1000000", "text", "lang"))
    got = {r.doc_id: r.quality for r in Q.quality_rules(table).where("doc_id < 1000000").collect()}
    for i, (_, text, _) in enumerate(rows):
        assert got[i].kept == ("$" not in text), (i, got[i])
    assert got[len(rows) - 1].class_distance is None and got[0].word_distance is not None
