import numpy as np
from pyspark.sql import functions as F

from kinsight.operators.search import search_vector
from kinsight.operators.vectors import VectorIndex

DIM = 12


def clustered(n, seed, groups=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, DIM))
    return centres[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, DIM))


def frame(spark, rows, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")


def test_the_answer_is_the_full_scans_from_few_cells(spark, tmp_path):
    data = clustered(6000, 1)
    data[:2000] = data[7]  # a third of all vectors alike: ties go to the smaller key
    vectors = frame(spark, data).cache()
    index = VectorIndex(spark, str(tmp_path / "v"), per_file=500)
    index.add(vectors, DIM)
    cells = index.cells()
    assert sum(c.rows for c in cells) == 6000 and len(cells) > 10
    rng = np.random.default_rng(9)
    for query in (data[7], data[2500], -data[2500], rng.normal(size=DIM), 1000 * data[4000] + 3):
        query = [float(x) for x in query]
        for k in (1, 5, 40):
            assert index.search(query, k).collect() == search_vector(vectors, query, k).collect()
    _, near, _ = index.opened([float(x) for x in data[2500]], 5)
    assert sum(c.rows for c in near) < 1500 and len(near) < len(cells) / 3
    opened = {f.split("cell=")[1].split("/")[0] for f in index.search([float(x) for x in data[2500]], 5).inputFiles()}
    assert opened == {str(c.number) for c in near}
    plan = index.search([float(x) for x in data[2500]], 5)._jdf.queryExecution().toString()
    assert "to_centre" in plan.split("PushedFilters")[1].split("]")[0]
    vectors.unpersist()


def test_batches_add_up_and_replace_themselves(spark, tmp_path):
    first, second = frame(spark, clustered(800, 2)), frame(spark, clustered(300, 3), 5000)
    index, query = VectorIndex(spark, str(tmp_path / "v")), [float(x) for x in clustered(1, 3)[0]]
    index.add(first, DIM)
    index.add(second, DIM, batch=1)
    index.add(second, DIM, batch=1)
    assert index.search(query, 20).collect() == search_vector(first.union(second), query, 20).collect()
    index.add(second.limit(10), DIM, batch=1)
    assert sum(c.rows for c in index.cells()) == 810


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [1.0]), (6, [-1.0, 0.0]), (None, [0.5, 0.5]), (1, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x"))
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.add(vectors, 2)
    assert [(r.doc_id, float(r.score)) for r in index.search([2.0, 0.0], 9).collect()] == [(1, 1), (1, 1), (None, 0.70710678), (6, -1)]
    empty = VectorIndex(spark, str(tmp_path / "none"))
    empty.add(vectors.filter("false"), 2)
    assert empty.search([1.0, 0.0]).collect() == [] and VectorIndex(spark, str(tmp_path / "never")).search([1.0, 0.0]).collect() == []
