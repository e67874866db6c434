"""Common-word counting against a brute-force Python count whose regex has
the same '.' / '$' semantics as the original filter."""

import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from commitlens import schemas as S
from commitlens.operators import text as TX

ALPHABET = "abcAB \n\r.,-|&=*+ÉéÇ😀"
WORD_RE = re.compile(r"^.{3,}$")


def brute_force(texts):
    out = Counter()
    for t in texts:
        for w in t.lower().split(" "):
            if w not in S.STOP_WORDS and WORD_RE.match(w):
                out[w] += 1
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=8))
def test_word_counts_match_brute_force(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "subject string")
    got = {r.word: r.word_count for r in TX.word_counts(df).collect()}
    assert got == dict(brute_force(texts))


def _python_lenient(v):
    try:
        return int(v)
    except (TypeError, ValueError):
        return 0


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="0123456789 +-", max_size=12)), min_size=1, max_size=20))
def test_lenient_int_matches_python_int(spark, values):
    from commitlens.functions import lenient_long

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.n for r in df.select("i", lenient_long("v").alias("n")).collect()}
    assert got == {i: _python_lenient(v) for i, v in enumerate(values)}
