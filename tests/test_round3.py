"""Round 3: lines are taken apart in one pass."""

import json

from commitlens import schemas as S
from commitlens.sources import ndjson as J


def test_all_fields_come_from_one_pass_over_the_object(spark):
    lines = spark.createDataFrame([('{"commit":"h","repo_name":"r"}',)], "value string")
    plan = J.classify_ndjson(lines, S.RAW_COMMIT, ["commit", "repo_name"])._jdf.queryExecution().optimizedPlan().toString()
    kinds = [f"{f.name}:" for f in S.RAW_COMMIT.fields]
    taken = [x for x in plan.split("try_variant_get(")[1:]]
    # one for the object, two for the end of the line; the others look at boxes that are missing and keys that read like a false value
    assert len(taken) <= 30 and sum("$[0]," in x[:40] for x in taken) == 1 and len(kinds) == 8


def test_boxes_keys_and_odd_lines(spark):
    cases = [({"commit": "h", "repo_name": "r", "author": {"name": 7, "x": 1}, "difference": [{"new_path": "p"}, {}]}, None, ("7", ["p", None])),
             ({"commit": "h", "repo_name": "r", "author": "", "difference": 0}, None, (None, None)),
             ({"commit": "h", "repo_name": "r", "author": "text"}, "malformed", None),
             ({"commit": "0", "repo_name": "false"}, None, (None, None)),
             ({"commit": 0, "repo_name": "r"}, "missing_key", None),
             ({"commit": "h", "repo_name": []}, "missing_key", None)]
    lines = [json.dumps(c) for c, _, _ in cases]
    twice = '{"commit":"a","commit":"b","repo_name":"r","author":{"name":"n"}}'
    more = [twice, '{"commit":"h","repo_name":"r"} x', '{"commit":"h","repo_name":"r","author":{"name":NaN}}', None]
    df = spark.createDataFrame(list(enumerate([*lines, *more])), "i int, value string")
    got = {r.i: r for r in J.classify_ndjson(df, S.RAW_COMMIT, ["commit", "repo_name"]).collect()}
    for i, (_, reason, kept) in enumerate(cases):
        assert got[i]._reason == reason
        if kept:
            paths = None if got[i].difference is None else [d.new_path for d in got[i].difference]
            assert (got[i].author and got[i].author.name, paths) == kept
    assert [got[len(cases) + k]._reason for k in range(4)] == [None, "malformed", None, "blank"] and got[len(cases)].commit == "b"
