"""License scans: TF-IDF cosine to templates, then inheritance by directory.

1. Notices. Of a text that speaks of a license, the notices are its whole text,
   its comment blocks and paragraphs (lines joined), its lines and sentences,
   and each SPDX identifier, those that speak of a license themselves; of a
   license file (LICENSE, COPYING, ...) the whole text is one in any case. Equal
   notices are looked at once, however many files carry them; they meet the other
   tables by their MD5, so a long text is not repeated for each of its terms.
2. Cosine. Notices and templates are sparse TF-IDF vectors: terms are exploded,
   document frequencies counted over all distinct notices, and the dot products
   come from an equi-join on the term with the templates (a fixed list, so a
   broadcast of known size). The best template at ``min_score`` or more wins;
   ties go to the smaller name. Whole license texts are told from prose, which
   shares their commonest words, by ``FULL_SCORE``; so are SPDX lines.
3. Files. A file's own license is that of its best notice, of a license file
   first that of its whole text. A file counts as license file by its name, or
   if its lines that speak of a license are ``min_share`` of its words.
4. Inheritance. The distinct directories are joined to the license files of
   all their ancestors on the path; the nearest one counts (in one directory,
   the smallest path). Files without a license of their own take it.

Hot notices and hot directories have one row on the small side of each join,
which is broadcast while it is small and otherwise a join that Spark splits.

Edge cases. Null or empty text: no own license, may inherit. Null path: no
directory, cannot inherit. Repeated paths are one file for inheritance and keep
their rows. Very long lines are whole notices. Other columns pass through; the
result columns replace older ones of the same name. An empty table gives no rows.
"""

from __future__ import annotations

import re
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import broadcast_if_small, materialise, table

# Public notices by SPDX id; texts of one id are alternatives.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                "Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. The Unlicense."),
    ("Proprietary", "All rights reserved. Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain "
                   "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
                   "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                   "specific language governing permissions and limitations under the License."),
    *[(f"{short}-{n}.0", f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
                         f"Foundation, either version {n} of the License, or (at your option) any later version.{rest}")
      for short, name, n, what in (("GPL", "General Public License", 2, "program"), ("GPL", "General Public License", 3, "program"),
                                   ("AGPL", "Affero General Public License", 3, "program"), ("LGPL", "Lesser General Public License", 3, "library"))
      for rest in ("", f" This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
                       f"or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}. "
                       "If not, see https://www.gnu.org/licenses/.")],
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
                 "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
                "obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
]
#: Section 13 of the Affero license, whose other text is that of GPL-3.0.
AGPL_13 = """
  13. Remote Network Interaction; Use with the GNU General Public License.

  Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely
through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the
Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software.

  Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General
Public License into a single combined work, and to convey the resulting work.

"""


def _whole_texts() -> list[tuple[str, str]]:
    """The license texts beside this file, by SPDX id."""
    out = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}
    affero = re.sub(r"  13\. Use with.*?(?=  14\. )", lambda m: AGPL_13.lstrip("\n"), out["GPL-3.0"], flags=re.S)
    head, rest = affero.split("  13. Remote", 1)
    out["AGPL-3.0"] = re.sub(r"(?i)(GNU)( General Public License)", r"\1 Affero\2", head) + "  13. Remote" + rest.replace("GNU General Public License, but", "GNU Affero General Public License, but")
    return list(out.items())


WHOLE_TEXTS = _whole_texts()
SPDX = [(name, f"SPDX-License-Identifier: {name}{end}") for name in sorted({n for n, _ in NOTICES + WHOLE_TEXTS} - {"Proprietary"})
        for end in (("", "-only", "-or-later", "+") if "GPL" in name or name.startswith("GFDL") else ("",))]
TEMPLATES = NOTICES + WHOLE_TEXTS + SPDX
MENTIONS = ("licens", "licenc", "copyright", "spdx", "public domain", "creative commons", "cc by", "cc0", "all rights reserved", "redistribut", "permission")
FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)(?:[.-][^/]*)?$"
#: Ends of lines, and of sentences before a capital.
NOTICE_END = r"\n|(?<=[.!?])[ \t]+(?=[A-Z])"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
MIN_SCORE, MIN_SHARE = 0.6, 0.2
#: Least score of templates of ``FULL_TERMS`` terms or more, and of SPDX lines.
FULL_SCORE, FULL_TERMS = 0.85, 100
COMMENTS = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))
LINE_COMMENT = re.compile(r"[ \t]*(?:#|//|--|;|%|\.\.|dnl\b|rem\b)", re.I)
#: Lines without a letter or digit end a paragraph.
PARAGRAPH_END = re.compile(r"\n[^A-Za-z0-9\n]*(?=\n)")
SPDX_TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]+)", re.I)
#: Most rows of a small side that are broadcast; beyond it Spark joins by a shuffle.
BROADCAST_ROWS = 200_000


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    found = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"))).alias("term"))
    return found.groupBy(key, "term").agg(F.count("*").alias("tf"))


def _mentions(text: str) -> bool:
    low = text.lower()
    return any(m in low for m in MENTIONS)


def comment_blocks(text: str) -> list[str]:
    """The comments of a text, consecutive comment lines as one."""
    out, run = [], []
    for opening, closing in COMMENTS:
        at = 0
        while (a := text.find(opening, at)) >= 0 and (b := text.find(closing, a + len(opening))) >= 0:
            at = b + len(closing)
            out.append(text[a:at])
    for x in [*text.split("\n"), ""]:
        if LINE_COMMENT.match(x):
            run.append(x)
        elif run:
            out.append("\n".join(run))
            run = []
    return out


def pieces(text: str, named: bool) -> list[tuple[str, bool, bool]]:
    """(notice, whether a line or sentence, whether the whole text of a
    license file) of a text."""
    lines = [x for x in re.split(NOTICE_END, text) if _mentions(x)]
    ids = [f"SPDX-License-Identifier: {x}" for m in SPDX_TAG.finditer(text) for x in re.findall(r"[A-Za-z0-9][A-Za-z0-9.-]*", m[1]) if x.upper() not in ("AND", "OR", "WITH")]
    blocks = {x.strip() for x in [text, *comment_blocks(text), *PARAGRAPH_END.split(text), *ids] if _mentions(x)} - {x.strip() for x in lines}
    own = [(text, False, True)] if named else []
    return [x for x in [*own, *((x, True, False) for x in lines), *((x, False, False) for x in sorted(blocks))] if x[0].strip()]


def _key(notice: str):
    return F.unhex(F.md5(F.col(notice).cast("binary")))


def score_notices(notices: DataFrame, templates: list[tuple[str, str]] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """(notice, license, score) for the distinct notices (column ``notice``)
    that resemble a template."""
    texts = notices.select("notice").distinct().withColumn("key", _key("notice"))
    return _scores(texts, templates, min_score).join(texts, "key").select("notice", "license", "score")


def _scores(texts: DataFrame, templates: list[tuple[str, str]] | None, min_score: float) -> DataFrame:
    """(key, license, score) for texts (columns ``key`` and ``notice``, one row
    per key) that resemble a template."""
    spark = texts.sparkSession
    long = lambda t: t.startswith("SPDX") or len(re.findall(TERM, t.lower())) >= FULL_TERMS
    known = spark.createDataFrame([(i, n, t, float(max(FULL_SCORE if long(t) else 0, min_score))) for i, (n, t) in enumerate(templates or TEMPLATES)],
                                  "template int, license string, text string, least double")
    own = materialise(_terms(texts, "key", "notice"), "notice-terms")
    fixed = _terms(known, "template", "text")
    n = F.lit(own.select("key").distinct().count())
    frequency = materialise(own.groupBy("term").agg(F.count("*").alias("df")), "frequency")
    of_templates = fixed.select("term").distinct().join(frequency, "term", "left")
    idf = F.log((1 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weights = of_templates.select("term", idf.alias("idf"))
    vectors = fixed.join(weights, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = vectors.groupBy("template").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("template_norm"))
    sparse = F.broadcast(vectors.join(norms, "template").select("template", "term", F.col("w").alias("template_w"), "template_norm"))
    weighted = own.join(broadcast_if_small(frequency, frequency.count(), BROADCAST_ROWS), "term").withColumn("w", F.col("tf") * idf)
    size = weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    dots = weighted.join(sparse, "term").groupBy("key", "template").agg(
        F.sum(F.col("w") * F.col("template_w")).alias("dot"), F.first("template_norm").alias("template_norm"))
    scored = dots.join(size, "key").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 6)) \
        .join(F.broadcast(known.select("template", "license", "least")), "template").where(F.col("score") >= F.col("least"))
    best = scored.groupBy("key").agg(F.max(F.struct("score", F.negative("template").alias("t"), "license")).alias("b"))
    return best.select("key", "b.license", "b.score")


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", min_score: float = MIN_SCORE, min_share: float = MIN_SHARE,
                  templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``files`` with ``own_license``, ``own_score``, ``license_file``, ``license``
    and ``inherited_from``. ``path_col`` names a file."""
    own_columns = ["own_license", "own_score", "license_file", "license", "inherited_from"]
    files = files.drop(*own_columns)
    text, path = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{path_col}`")
    named = F.coalesce(path.rlike(FILE_NAME), F.lit(False))
    low = F.lower(text)
    mentions = lambda c: F.greatest(*[F.contains(c, F.lit(m)) for m in MENTIONS])
    split = F.pandas_udf(lambda texts, nameds: pd.Series([[dict(zip(("notice", "line", "whole"), x)) for x in pieces(t, n)] for t, n in zip(texts, nameds)], dtype=object),
                         "array<struct<notice string, line boolean, whole boolean>>")
    notices = files.where((named | mentions(low)) & path.isNotNull()).select(
        path.alias("path"), named.alias("named"), F.size(F.split(F.trim(text), r"\s+")).alias("n_words"), F.explode(split(text, named)).alias("x")) \
        .select("path", "named", "n_words", F.trim("x.notice").alias("notice"), "x.line", "x.whole").withColumn("key", _key("notice"))
    notices = materialise(notices.withColumn("words", F.size(F.split("notice", r"\s+"))), "notices")
    scored = materialise(_scores(notices.select("key", "notice").dropDuplicates(["key"]), templates, min_score), "scored")
    of_file = notices.drop("notice").join(broadcast_if_small(scored, scored.count(), BROADCAST_ROWS), "key").groupBy("path").agg(
        F.max(F.struct("whole", "score", "license")).alias("b"), F.sum(F.when(F.col("line"), F.col("words")).otherwise(0)).alias("notice_words"),
        F.max("n_words").alias("n_words"), F.max("named").alias("named"))
    found = materialise(of_file.select("path", F.col("b.license").alias("own_license"), F.col("b.score").alias("own_score"),
                                       (F.col("named") | (F.col("notice_words") >= min_share * F.col("n_words"))).alias("license_file")), "licenses")
    parent = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    of_dir = found.where("license_file").groupBy(parent(F.col("path")).alias("dir")).agg(F.min(F.struct("path", "own_license")).alias("f")) \
        .select("dir", F.col("f.path").alias("inherited_from"), F.col("f.own_license").alias("dir_license"))
    of_dir = materialise(of_dir, "dirs")
    dirs = files.where(path.isNotNull()).select(parent(path).alias("own_dir")).distinct()
    up = dirs.select("own_dir", F.posexplode(F.expr("transform(sequence(size(split(own_dir, '/')), 0), n -> array_join(slice(split(own_dir, '/'), 1, n), '/'))")).alias("up", "dir"))
    near = up.join(broadcast_if_small(of_dir, of_dir.count(), BROADCAST_ROWS), "dir").groupBy("own_dir").agg(
        F.min(F.struct("up", "inherited_from", "dir_license")).alias("n")).select("own_dir", "n.inherited_from", "n.dir_license")
    near = materialise(near, "near")
    # the caller's columns in one struct, so that no name clashes
    out = files.select(F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("row"), path.alias("path"), parent(path).alias("own_dir")) \
        .join(broadcast_if_small(found, found.count(), BROADCAST_ROWS), "path", "left") \
        .join(broadcast_if_small(near, near.count(), BROADCAST_ROWS), "own_dir", "left")
    own = {"own_license": F.col("own_license"), "own_score": F.col("own_score"), "license_file": F.coalesce("license_file", F.lit(False)),
           "license": F.coalesce("own_license", "dir_license"), "inherited_from": F.when(F.col("own_license").isNull(), F.col("inherited_from"))}
    return out.select(*[F.col("row").getField(c).alias(c) for c in files.columns], *[own[c].alias(c) for c in own_columns])


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files: source, language and thousand are directories."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(
        "/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.expr("doc_id div 1000"), F.col("doc_id").cast("string")).alias("path"))
    return scan_licenses(docs).drop("text")
