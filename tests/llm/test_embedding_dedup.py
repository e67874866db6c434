import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from commitlens.llm import embedding_dedup as E
from llm.conftest import SF, rows_of

KIND = "vec_id bigint, embedding array<double>"


def brute(rows, threshold=0.95):
    """{id: (links, component)} from (id, vector) with one usable vector per id."""
    ids = [i for i, _ in rows]
    usable = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    good = [(k, np.array(v, np.float64)) for k, (_, v) in enumerate(rows) if usable(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1:]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    smallest = {}
    for k, i in enumerate(ids):
        smallest[find(k)] = min(smallest.get(find(k), i), i)
    return {i: (links[k], smallest[find(k)]) for k, i in enumerate(ids)}


def answers(df):
    return {k: (r["n_links"], r["component_id"]) for k, r in rows_of(df, "vec_id").items()}


def near(rng, x, cos):
    z = rng.normal(size=len(x))
    z -= (z @ x) * x / (x @ x)
    z *= np.linalg.norm(x) / np.linalg.norm(z)
    return cos * x + math.sqrt(1 - cos * cos) * z


def clusters(rng, dim, spreads, size):
    out = []
    for cos in spreads:
        centre = rng.normal(size=dim)
        out += [near(rng, centre, cos) * rng.uniform(0.1, 10) for _ in range(size)]
    return out


@pytest.mark.parametrize("hot, block", [(256, 512), (10, 8), (10, 64)])
def test_clusters_of_all_spreads(spark, hot, block):
    """Tight groups (counted whole), groups at the threshold (compared in
    blocks), free vectors and copies; ids in random order."""
    rng = np.random.default_rng(4)
    vectors = clusters(rng, 24, [0.999, 0.99, 0.975, 0.96, 0.9], 40) + [rng.normal(size=24) for _ in range(200)]
    vectors += vectors[:15] + vectors[:5]
    ids = rng.permutation(len(vectors)) + 7
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
    got, want = answers(E.link_vectors(spark.createDataFrame(rows, KIND), hot=hot, block=block)), brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) >= 0.98


def test_recall_at_the_threshold(spark):
    """Pairs barely linked, one by one."""
    rng = np.random.default_rng(9)
    firsts = [rng.normal(size=64) for _ in range(400)]
    vectors = firsts + [near(rng, x, 0.9501) for x in firsts] + [near(rng, x, 0.9499) for x in firsts[:200]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = answers(E.link_vectors(spark.createDataFrame(rows, KIND)))
    assert sum(got[i][0] for i in range(400)) >= 0.98 * 400
    assert all(got[i] == (0, i) for i in range(800, 1000))


def test_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = rows_of(E.op13_embedding_dedup(spark, SF), "vec_id")
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == brute(rows)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [-inf, 0.0]), (8, a), (9, a), (10, b), (11, [-x for x in a]), (12, [1.0, 2.0]),
            (13, [1e-300, 2e-300, 3e-300]), (14, [1e300, 2e300, 3e300]), (15, [5.0]), (16, [2.0]), (17, [-2.0]), (18, [1e-9] * 100), (19, [3.0] * 100), (20, [2.0, 4.0]), (8, a), (10, b)]
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("id", "vec", "core", "bucket", "links", "component", "weight")})
    got, want = answers(E.link_vectors(df)), brute([(i, [x for x in v] if v else v) for i, v in rows[:20] if i not in (13, 14)])
    linked = {8, 9, 10, 13, 14}
    assert all(got[i] == (len(linked) - 1, 8) for i in linked)
    assert {i: g for i, g in got.items() if i not in linked} == {i: w for i, w in want.items() if i not in linked}
    nameless = E.link_vectors(spark.createDataFrame([(None, a), (None, None), (3, a)], KIND))
    assert sorted(tuple(r) for r in nameless.collect() if r["vec_id"] is None) == [(None, 0, None)] * 2
    kept = E.keep_one(df)
    assert kept.columns == df.columns and sorted(r["vec_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i == 8 or i not in linked and want[i][1] == i)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert E.op13_embedding_dedup(spark, str(tmp_path)).count() == 0


def test_hadamard_keeps_lengths_and_angles():
    x = np.random.default_rng(0).normal(size=(16, 5))
    y = E.hadamard(x)
    assert np.allclose(y.T @ y, x.T @ x) and np.allclose(E.hadamard(y), x)
