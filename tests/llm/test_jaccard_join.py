import random
import re

import numpy as np

from commitlens.llm import jaccard_join as J
from commitlens.llm.components import connected_components
from llm.conftest import SF, rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(sets, threshold=85):
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * rng.randint(1, 3)
    return words


def test_query_matches_brute_force(spark, documents):
    got = rows_of(J.op7_jaccard_join(spark, SF), "doc_id")
    sets = {d.doc_id: brute_set(d.text) for d in documents.collect()}
    want = brute_components(sets)
    assert {d: g["component_id"] for d, g in got.items()} == want
    assert all(got[d]["n_shingles"] == len(s) for d, s in sets.items())


def test_no_pair_is_lost_by_the_index():
    """Similar sets of any sizes share an entry, at the edge of the threshold."""
    rng = np.random.default_rng(1)
    for threshold in (80, 85):
        bands = J.Bands(threshold)
        for _ in range(1500):
            n = int(rng.integers(1, 90))
            base = rng.integers(0, 1 << 62, 2 * n + 4, dtype=np.uint64)
            most = (100 - threshold) * 2 * n // (100 + threshold)
            cut, add = int(rng.integers(0, most + 1)), 0
            add = int(rng.integers(0, max(1, most - cut + 1)))
            a, b = np.unique(base[:n]), np.unique(np.concatenate([base[cut:n], base[n:n + add]]))
            if len(b) and J.linked(len(np.intersect1d(a, b)), len(a), len(b), threshold):
                assert np.intersect1d(J.all_signatures(a, bands), J.all_signatures(b, bands)).size
            assert J.least_differences(np.frombuffer(J.parity_sketch(a).tobytes(), np.uint8), np.frombuffer(J.parity_sketch(b).tobytes(), np.uint8)) <= len(np.setxor1d(a, b))


def test_groups_with_blocks(spark):
    """A large group of near copies goes through the blocks."""
    rng = random.Random(3)
    base = [rng.choice(["la", "lo", "ti", "re", "mi", "so"]) + str(i % 9) for i in range(120)]
    texts = [" ".join(edited(rng, base, rng.randint(0, 6))) for _ in range(60)] + [" ".join(base)] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, body string")
    want = brute_components({i: brute_set(t) for i, t in enumerate(texts)})
    links = J.similarity_links(docs, "id", "body", small=4, block=8)
    got = {i: i for i in want} | {r.id: r.component for r in connected_components(links).collect()}
    texts_of = {}
    for i, t in enumerate(texts):
        texts_of.setdefault(t, []).append(i)
    assert got == want
    groups = {r.id: r.component for r in J.similar_groups(docs, "id", "body").collect()}
    assert {i: groups.get(i, i) for i in want} == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "A b", "x"), (5, "a B", "y"), (5, "a B", "y"), (6, "a b c d", "y"), (7, "a  b\tc d", None),
            (None, "a b", "z"), (8, long, "z"), (9, long + " tail", "z"), (10, "a b c", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    got = {r.id: r.component for r in J.similar_groups(docs).collect()}
    assert {i: got.get(i, i) for i in range(1, 11)} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10}
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 10]
    assert J.similar_groups(docs.limit(0)).collect() == [] and J.keep_one(docs.limit(0)).collect() == []


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
