"""Line classification against a standard JSON decoder."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from commitlens import schemas as S
from commitlens.sources import ndjson as J

NAMES = st.one_of(st.none(), st.sampled_from(["", "r", "o'k", "a b", "É", "12"]))


def record(repo, count, drop_repo, quote):
    obj = {} if drop_repo else {"repo_name": repo}
    if count is not None:
        obj["watch_count"] = count
    text = json.dumps(obj, ensure_ascii=False)
    return text.replace('"', "'") if quote else text


LINES = st.one_of(
    st.builds(record, NAMES, st.one_of(st.none(), st.sampled_from(["1", "x", "-3"])), st.booleans(), st.booleans()),
    st.sampled_from(["", "   ", "\t", "5", "[]", '[{"repo_name": "r"}]', "not json", '{"repo_name":', "null",
                     '{"repo_name": "r",}', "{'repo_name': 'r'}", '{"repo_name": "r"} ', '"text"']),
)


def expected(line):
    text = line.strip()
    if not text:
        return "blank"
    try:
        rec = json.loads(text)
    except json.JSONDecodeError:
        return "malformed"
    if not isinstance(rec, dict):
        return "malformed"  # the source application stops here; it is a reject
    return "accepted" if rec.get("repo_name") else "missing_key"


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LINES, min_size=1, max_size=25))
def test_classification_matches_json_decoder(spark, lines):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    got = {r.i: r._reason or "accepted" for r in J.classify_ndjson(df, S.RAW_REPO, ["repo_name"]).collect()}
    assert got == {i: expected(v) for i, v in enumerate(lines)}


def test_strict_json_cases(spark):
    lines = ["{'repo_name': 'r'}", '{"repo_name": "r",}', "null", '{"repo_name": "r", "watch_count": NaN}',
             '{"repo_name": "r"} ']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    got = [r._reason or "accepted" for r in J.classify_ndjson(df, S.RAW_REPO, ["repo_name"]).orderBy("i").collect()]
    assert got == [expected(v) for v in lines] == ["malformed", "malformed", "malformed", "accepted", "accepted"]
