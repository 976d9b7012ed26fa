import time

import numpy as np

from lodestone.llm import neighbours as N
from lodestone.llm import queries as Q

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, row string"


def brute(ids, x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return {i: set(ids[np.lexsort((ids, d[n]))[:k]].tolist()) for n, i in enumerate(ids)}


def test_recall_over_the_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    pdf = rows.toPandas()
    want = brute(pdf["vec_id"].to_numpy(), np.array(pdf["embedding"].tolist()), 10)
    for options in ({}, {"query_rows": 100, "data_rows": 200}):
        got = N.nearest(rows, 10, **options).toPandas()
        assert (got.groupby("vec_id").size() == 10).all() and got.groupby("vec_id")["rank"].max().eq(10).all()
        found = got.groupby("vec_id")["neighbour_id"].apply(set)
        assert np.mean([len(found[i] & want[i]) / 10 for i in want]) >= 0.9


def test_stated_queries_meet_all_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    pdf = rows.toPandas()
    want = brute(pdf["vec_id"].to_numpy(), np.array(pdf["embedding"].tolist()), 10)
    got = Q.op10_neighbours(spark, sf).toPandas()
    assert set(got["vec_id"]) == {i for i in want if i % 20 == 0} and (got.groupby("vec_id").size() == 10).all()
    assert np.mean([len(set(g["neighbour_id"]) & want[i]) / 10 for i, g in got.groupby("vec_id")]) >= 0.9
    strangers = spark.createDataFrame([(-1, list(map(float, pdf["embedding"][3])), 0)], "vec_id long, embedding array<double>, label int")
    near = N.nearest(rows, 3, queries=strangers).collect()
    assert [r.vec_id for r in near] == [-1] * 3 and near[0].neighbour_id == int(pdf["vec_id"][3]) and near[0].distance < 1e-5


def test_distances_are_exact(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = dict((r.vec_id, np.array(r.embedding)) for r in rows.collect())
    for r in N.nearest(rows, 3).collect():
        assert abs(np.linalg.norm(x[r.vec_id] - x[r.neighbour_id]) - r.distance) < 1e-5


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (3, [5.0, 5.0])]
    df = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], SCHEMA)
    got = sorted((r.vec_id, r.rank, r.neighbour_id) for r in N.nearest(df, 2).collect())
    assert [g for g in got if g[0] == 1] == [(1, 1, 2), (1, 2, 3)] and {g[0] for g in got} == {1, 2, 3}
    assert all(a != c for a, _, c in got) and len([g for g in got if g[0] == 3]) == 4
    assert N.nearest(df.limit(0)).count() == 0


def test_recall_whatever_the_density():
    g = np.random.default_rng(5)
    n, width, k = 3000, 64, 10
    x = g.standard_normal((n, width))
    group = np.arange(n) % 30
    tables = {
        "gaussian": x,
        "unequal density": 3 * g.standard_normal((30, width))[group] + x * np.geomspace(0.05, 3, 30)[group, None],
        "unequal length": x * np.exp(g.standard_normal((n, 1))),
    }
    asked = np.arange(0, n, 10)
    for name, points in tables.items():
        distance = np.linalg.norm(points[asked][:, None, :] - points[None, :, :], axis=2)
        distance[np.arange(len(asked)), asked] = np.inf
        want = np.argsort(distance, axis=1)[:, :k]
        q, rows, squared = N.Index(points).search(points[asked], asked, k, N.start_radius(points, k))
        got = [set(rows[q == i][np.argsort(squared[q == i], kind="stable")[:k]]) for i in range(len(asked))]
        assert np.mean([len(got[i] & set(want[i])) / k for i in range(len(asked))]) >= 0.93, name


def test_a_search_costs_less_than_plain_distances():
    g = np.random.default_rng(8)
    x, k = g.standard_normal((16_384, 64)), 10
    asked = np.arange(0, len(x), 256)
    index, radius = N.Index(x), N.start_radius(x, k)
    counts, gap, inside = np.zeros(len(x), np.uint8), np.empty((40, len(x)), np.uint8), np.empty((40, len(x)), bool)
    centre, half = x[5] @ index.lines.T, 4.0
    assert not index.count_windows(centre, half, counts, gap, inside)
    exact = (np.abs(index.placed - centre[:, None]) <= half).sum(axis=0)
    assert (counts >= exact).all() and counts.sum() < 1.2 * exact.sum()

    def plain():
        for q in asked:
            d = ((x - x[q]) ** 2).sum(axis=1)
            np.argpartition(d, k)[:k]

    def seconds(f):
        began = time.thread_time()
        f()
        return time.thread_time() - began

    took = min(seconds(lambda: index.search(x[asked], asked, k, radius)) for _ in range(2))
    assert took < min(seconds(plain) for _ in range(2))
