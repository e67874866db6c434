import hashlib
import random
import re

from commitlens.llm import decontaminate as D
from llm.conftest import SF, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items, window=13):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        own = WORD.findall((t or "").translate(LOWER))
        size = min(window, len(own))
        windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if size else set()
        for s in range(len(words) - size + 1) if size else ():
            if tuple(words[s:s + size]) in windows:
                found.add(str(item))
                hit.update(range(s, s + size))
    ids = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_query_matches_brute_force(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows_of(D.op3_decontaminate(spark, SF), "doc_id")
    for d in documents.collect():
        g = got[d.doc_id]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == brute(d.text, items)


def test_search_against_brute_force_on_few_words():
    rng = random.Random(5)
    for _ in range(400):
        items = [(str(i), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))) for i in range(rng.randint(0, 4))]
        text = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        tables = D.build_tables([(i, t.encode()) for i, t in items], window=4)
        words = D.words_of(text.encode())
        ranges, found = D.search(words, tables)
        want = brute(text, items, 4)
        assert (len(words), sum(b - a for a, b in ranges), len(found)) == want[:3]


def test_odd_rows_and_shards(spark):
    bench = spark.createDataFrame([(1, "One two THREE four"), (2, None), (3, ""), (4, "..."), (1, "alpha beta"), (None, "gamma delta"), (5, "Straße ÉCOLE")], "item_id bigint, text string")
    rows = [(1, "x one, two; three four y", "a"), (1, "x one, two; three four y", "a"), (2, None, "b"), (3, "", None), (None, "alpha beta", "c"),
            (4, "gamma delta gamma", "d"), (5, "straße École", "e"), (6, "straße École éCOLE ÉCOLE", "f"), (7, "one two three four " * 50_000, "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, contamination string")
    one = D.find_contamination(docs, bench).collect()
    many = D.find_contamination(docs, bench, shard_words=2).collect()
    key = lambda r: (r.doc_id or -1, tuple(r.contamination[:3]), str(r.contamination.ranges))
    assert sorted(map(key, one)) == sorted(map(key, many)) and len(one) == len(rows)
    by_id = {r.doc_id: r.contamination for r in one}
    assert by_id[1].n_hit == 4 and by_id[1]["items"] == ["1"] and by_id[1].contaminated
    assert by_id[2].n_words == 0 and not by_id[2].contaminated
    assert by_id[4].n_hit == 2 and by_id[4].n_items == 0
    assert by_id[5].n_hit == 2 and by_id[6].n_hit == 2  # only A-Z are folded: not the accented capital
    assert by_id[7].n_hit == 200_000
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3}
    assert D.find_contamination(docs.limit(0), bench).count() == 0
    assert {r.contamination.n_hit for r in D.find_contamination(docs, bench.limit(0)).collect()} == {0}
