import math
import re
from collections import Counter

from commitlens.llm import licenses as L
from llm.conftest import SF, rows_of

MIT, APACHE, GPL = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."


def brute_scores(notices):
    """Best template by TF-IDF cosine, over the distinct notices."""
    terms = lambda t: Counter(re.findall(L.TERM, t.lower()))
    own = {n: terms(n) for n in set(notices)}
    df = Counter(t for v in own.values() for t in v)
    idf = lambda t: math.log((1 + len(own)) / (1 + df[t])) + 1
    size = lambda v: math.sqrt(sum((c * idf(t)) ** 2 for t, c in v.items()))
    out = {}
    for n, v in own.items():
        best = max((round(sum(c * w[t] * idf(t) ** 2 for t, c in v.items() if t in w) / (size(v) * size(w)), 6) if v else 0, -i, name)
                   for i, (name, w) in enumerate((name, terms(t)) for name, t in L.TEMPLATES))
        if best[0] >= L.MIN_SCORE:
            out[n] = (best[2], best[0])
    return out


def test_scores_match_brute_force(spark):
    notices = [MIT, APACHE, GPL, "MIT License", "released under MIT terms", "Copyright 2020 the authors", "licensed under the Apache License 2.0", "Licensed under CC BY-NC 4.0.",
               "All rights reserved.", "unlicensed driver", "© License", MIT]
    got = {r.notice: (r.license, r.score) for r in L.score_notices(spark.createDataFrame([(n,) for n in notices], "notice string")).collect()}
    want = brute_scores(notices)
    assert set(got) == set(want)
    for n, (name, score) in want.items():
        assert got[n][0] == name and abs(got[n][1] - score) < 2e-6


def test_query_finds_the_license_lines(spark, documents):
    got = rows_of(L.op4_license_scan(spark, SF), "doc_id")
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", MIT: "MIT", GPL: "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    for d in documents.collect():
        want = {name for line, name in lines.items() if line in (d.text or "")}
        own = got[d.doc_id]["own_license"]
        assert own in want if want else own is None
        if own:
            assert got[d.doc_id]["license"] == own and got[d.doc_id]["inherited_from"] is None


def test_nearest_ancestor(spark):
    rows = [("a/LICENSE", MIT), ("a/b/COPYING.txt", GPL), ("a/x.py", "code"), ("a/b/c/d/y.py", "code"), ("a/b/z.py", f"head\n{APACHE}\n" + "code " * 100), ("q/w.py", "code"),
            ("a2/v.py", "code"), ("u.py", None), ("a/b/LICENSE-2", MIT), (None, MIT), ("a/x.py", "code")]
    df = spark.createDataFrame(rows, "path string, text string").selectExpr("*", "1 AS license")
    out = L.scan_licenses(df)
    assert len(out.columns) == 2 + 5
    got = {}
    for r in out.collect():
        got.setdefault(r.path, []).append((r.own_license, r.license_file, r.license, r.inherited_from))
    assert sum(map(len, got.values())) == len(rows)
    assert got["a/x.py"] == [(None, False, "MIT", "a/LICENSE")] * 2
    assert got["a/b/c/d/y.py"] == [(None, False, "GPL-3.0", "a/b/COPYING.txt")]
    assert got["a/b/z.py"] == [("Apache-2.0", False, "Apache-2.0", None)]
    assert got["q/w.py"] == got["a2/v.py"] == got["u.py"] == [(None, False, None, None)]
    assert got["a/LICENSE"] == [("MIT", True, "MIT", None)] and got[None][0][2] is None


def test_root_and_odd_rows(spark):
    rows = [("LICENSE", MIT), ("x/y/z.c", "code"), ("w.c", ""), ("v.c", "license " * 50_000), ("t.c", "\n" * 5)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r.license for r in L.scan_licenses(df).collect()}
    assert got["x/y/z.c"] == got["w.c"] == got["t.c"] == "MIT"
    assert L.scan_licenses(df.limit(0)).collect() == []


def test_whole_texts_and_wrapped_headers(spark):
    """License files as they are shipped, with other holders, wraps and case."""
    rows, want = [], {}
    for name, text in L.WHOLE_TEXTS:
        text = "My Project\nCopyright (c) 2024 Some Holder and others\n\n" + re.sub(r"(?m)^Copyright .*$", "", text)
        for i, shown in enumerate((text, " ".join(text.split()), "\n".join("  " + x.rstrip() for x in text.splitlines()))):
            want[f"{name}/{i}/LICENSE"] = want[f"{name}/{i}/x.py"] = name
            rows += [(f"{name}/{i}/LICENSE", shown), (f"{name}/{i}/x.py", "code")]
    words = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the "
             "License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License")
    gpl = ("This file is part of it. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
           "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
    wrap = lambda text, n: [" ".join(p.split()[i:i + n]) for p in text.split("\n\n") for i in range(0, len(p.split()), n)]
    code = "\nx = 1\n" * 200
    for n in (5, 8, 12):
        want |= {f"src/{n}/a.py": "Apache-2.0", f"src/{n}/b.c": "GPL-3.0", f"src/{n}/c.js": "MIT"}
        rows += [(f"src/{n}/a.py", "\n".join("# " + x for x in wrap(words, n)) + code), (f"src/{n}/b.c", "/*\n" + "\n".join(" * " + x for x in wrap(gpl, n)) + "\n */" + code),
                 (f"src/{n}/c.js", "/*\n" + "\n".join(wrap(dict(L.WHOLE_TEXTS)["MIT"], n)) + "\n*/" + code)]
    for tag, name in (("MIT", "MIT"), ("GPL-2.0-or-later", "GPL-2.0"), ("(Apache-2.0)", "Apache-2.0"), ("LicenseRef-Own", None)):
        want[f"{tag}/spdx.c"] = name
        rows.append((f"{tag}/spdx.c", f"// SPDX-License-Identifier: {tag}\nint main;"))
    prose = "It is the permission of the one and the other to go to the house of the people, and any of them may use it in the way that they have been told to. " * 60
    want["prose.txt"] = None
    rows.append(("prose.txt", prose))
    got = {r.path: r.license for r in L.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == want


def test_the_callers_own_column_names(spark):
    names = ["_dir", "_path", "dir_license", "own_dir", "dir", "key", "notice", "row", "named", "score"]
    df = spark.createDataFrame([("a/LICENSE", MIT), ("a/x.py", "code"), (None, "code")], "path string, text string").selectExpr("*", *[f"'mine' AS `{n}`" for n in names])
    out = L.scan_licenses(df)
    assert out.columns[:len(df.columns)] == df.columns
    got = {r["path"]: r for r in out.collect()}
    assert got["a/x.py"]["license"] == "MIT" and got["a/x.py"]["inherited_from"] == "a/LICENSE" and got[None]["license"] is None
    assert all(r[n] == "mine" for r in got.values() for n in names)
