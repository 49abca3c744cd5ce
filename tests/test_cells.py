"""Pruned dense search against the plain one."""

import random

import pytest
from pyspark.sql import functions as F

from kgloom.operators import cells
from kgloom.operators import retrieval as R


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "doc", "score", "rank").collect()))


def clustered(seed, n, width, centres, spread):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize(("spread", "most"), [(0.05, 0.2), (5.0, 1.0)])
def test_cells_are_exact(spark, spread, most):
    rows = clustered(3, 1500, 8, 20, spread)
    points = spark.createDataFrame(rows, "doc long, vector array<double>").repartition(3)
    asked = points.where("doc % 40 = 0").select(F.col("doc").alias("query_id"), "vector")
    for k in (1, 7):
        index = cells.Cells(points, 20, 500)
        assert rows_of(index.search(asked, k)) == rows_of(R.dense_arm(asked, points, k))
        assert index.read <= most * index.pairs, (index.read, index.pairs)


def test_cells_in_query_blocks(spark):
    points = spark.createDataFrame(clustered(4, 300, 6, 5, 0.3), "doc long, vector array<double>")
    asked = points.where("doc % 10 = 0").select(F.col("doc").alias("query_id"), "vector")
    assert rows_of(cells.Cells(points, 6).search(asked, 3, block=16, query_bytes=300)) == rows_of(R.dense_arm(asked, points, 3))


def test_cells_of_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, 2.0, 3.0]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, []), (9, [-1.0, -2.0])]
    points = spark.createDataFrame(rows, "doc long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0]), (3, None), (4, [0.0, 0.0, 0.0, 5.0]), (5, [1.0, 2.0, 3.0, 4.0])], "query_id long, vector array<double>")
    for k in (2, 20):
        for sample in (1, 100):
            assert rows_of(cells.Cells(points, 3, sample).search(asked, k)) == rows_of(R.dense_arm(asked, points, k))
    nothing = points.limit(0)
    assert cells.Cells(nothing).search(asked, 3).count() == 0 == cells.Cells(points).search(asked.limit(0), 3).count()
