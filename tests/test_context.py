"""Scores within contexts."""

import duckdb

from lodestone.plans.engine import context_column, context_of


def test_scores_are_rounded_as_python_and_sql_do(spark):
    scores = [k / 1000 + 0.0005 for k in range(0, 30_000, 7)] + [0.0625, 0.1875, 12.3455, 1234.5675, 0.0, 99999.9995]
    hits = spark.createDataFrame([(i, 1, s, "x") for i, s in enumerate(scores)], "query_id int, rank int, score double, content string")
    got = {r.query_id: r.context for r in context_column(hits).collect()}
    sql = duckdb.sql(f"select printf('%.3f', unnest({scores}::double[]))").fetchall()
    assert [got[i].split(": ")[1].split("]")[0] for i in range(len(scores))] == [x for (x,) in sql]
    assert got == {i: context_of([{"score": s, "content": "x"}]) for i, s in enumerate(scores)}
