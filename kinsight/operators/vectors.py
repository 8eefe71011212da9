"""Nearest vectors from a stored index that opens only what can hold one of them; the answer is that of a full scan.

    path/centres               some of the first batch's vectors, as unit vectors
    path/batch/<n>/rows/cell=  the vectors of a batch by nearest centre, sorted by their distance from it
    path/batch/<n>/cells       rows, smallest and largest distance of each cell

On unit vectors the squared distance is 2 - 2 cosine, and distances obey the triangle inequality: a vector x of a cell
with centre c is at least |d(q, c) - d(x, c)| from the query q. Once k vectors are known, everything beyond the distance
of the k-th is out: whole cells by their smallest and largest distance, and the rest of a cell by row groups, as its
files are sorted by the distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinsight.operators.search import scored_vectors
from kinsight.sources.buckets import read_if_there

# Scores are rounded to 8 places, and distances come from floats: both errors lie far below this.
SLACK = 1e-6


@dataclass(frozen=True)
class Cell:
    batch: int
    number: int
    rows: int
    nearest: float
    farthest: float


def unit(vector: list[float]) -> np.ndarray:
    given = np.asarray(vector, float)
    return given / np.linalg.norm(given)


def usable(vectors: DataFrame, dimensions: int) -> DataFrame:
    """The vectors that have a direction: of the right length, without nulls and not of zeros alone."""
    e = F.col("embedding")
    return vectors.filter((F.size(e) == dimensions) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)) & F.exists(e, lambda x: x != 0))


class VectorIndex:
    """An index of (key, embedding) below ``path``, which all executors reach.

    There are about as many cells as a quarter of the square root of the first batch's rows, and at most ``most_cells``:
    the centres are known to the driver and to every task. Cells may grow without bound, for a cell's rows are
    dealt over as many tasks as they need, and queries skip row groups inside.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id", most_cells: int = 4096, per_file: int = 200_000):
        self.spark, self.path, self.key, self.most_cells, self.per_file = spark, path.rstrip("/"), key, most_cells, per_file

    # --- writing ---------------------------------------------------------------------------------------------------

    def centres(self) -> np.ndarray | None:
        found = read_if_there(self.spark, f"{self.path}/centres", "number int, centre array<double>")
        rows = [] if found is None else found.orderBy("number").collect()
        return np.array([r["centre"] for r in rows]) if rows else None

    def _choose(self, vectors: DataFrame, dimensions: int) -> np.ndarray:
        """Vectors with the smallest hashes of their keys; any choice gives right answers."""
        good = usable(vectors, dimensions)
        wanted = min(self.most_cells, max(1, math.isqrt(good.count()) // 4))
        order = [F.xxhash64(self.key), F.xxhash64("embedding")]
        rows = good.select(F.col("embedding").cast("array<double>").alias("e"), *order).orderBy(*order).limit(wanted).collect()
        centres = np.unique(np.array([unit(r["e"]) for r in rows]), axis=0) if rows else np.eye(1, dimensions)
        self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "number int, centre array<double>") \
            .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        return centres

    def add(self, vectors: DataFrame, dimensions: int, batch: int = 0) -> None:
        """Store a batch; one that is repeated replaces itself. The first batch chooses the centres. The cells of a
        batch are written last, and a batch without them is not seen."""
        centres = self.centres()
        if centres is None:
            centres = self._choose(vectors, dimensions)

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if not len(rows):
                    continue
                e = np.stack(rows["embedding"].to_numpy()).astype(float)
                e /= np.linalg.norm(e, axis=1, keepdims=True)
                cell = (e @ centres.T).argmax(axis=1)
                yield rows.assign(cell=cell.astype(np.int32), to_centre=np.linalg.norm(e - centres[cell], axis=1))

        root = f"{self.path}/batch/{batch}"
        slim = usable(vectors.select(self.key, "embedding"), dimensions)
        schema = T.StructType([*slim.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("to_centre", T.DoubleType())])
        slim.mapInPandas(nearest, schema).write.mode("overwrite").parquet(f"{root}/dealt")
        dealt = self.spark.read.schema(schema).parquet(f"{root}/dealt")
        counts = dealt.groupBy("cell").agg(F.count("*").alias("rows"), F.min("to_centre").alias("nearest"), F.max("to_centre").alias("farthest"))
        files = F.ceil(F.col("rows") / self.per_file)  # at most one row a cell: a small side of the join
        placed = dealt.join(counts.select("cell", files.alias("files")), "cell").withColumn("part", F.pmod(F.xxhash64(self.key), F.col("files")))
        placed.repartition("cell", "part").sortWithinPartitions("cell", "to_centre").drop("files", "part") \
            .write.mode("overwrite").partitionBy("cell").parquet(f"{root}/rows")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{root}/cells")
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/dealt")

    # --- reading ---------------------------------------------------------------------------------------------------

    def cells(self) -> list[Cell]:
        found = read_if_there(self.spark, f"{self.path}/batch/*/cells", "cell int, rows long, nearest double, farthest double")
        if found is None:
            return []
        batch = F.regexp_extract("_metadata.file_path", "/batch/([0-9]+)/cells/", 1).cast("int")
        rows = found.select(batch.alias("batch"), "cell", "rows", "nearest", "farthest").collect()
        return [Cell(r["batch"], r["cell"], r["rows"], r["nearest"], r["farthest"]) for r in rows]

    def _rows(self, cells: list[Cell]) -> DataFrame:
        paths = [f"{self.path}/batch/{c.batch}/rows/cell={c.number}" for c in cells]
        return self.spark.read.parquet(*paths)

    def opened(self, query: list[float], k: int) -> tuple[list[Cell], list[Cell], Column | None]:
        """(cells read to know k vectors, cells that may hold a better one, condition on their rows)."""
        centres, cells = self.centres(), self.cells()
        if not cells:
            return [], [], None
        away = np.linalg.norm(centres - unit(query), axis=1)
        cells = sorted(cells, key=lambda c: (away[c.number], c.number, c.batch))
        first, held = [], 0
        for cell in cells:
            first.append(cell)
            held += cell.rows
            if held >= k:
                break
        else:
            return first, first, None
        best = scored_vectors(self._rows(first), query, self.key).orderBy(F.desc("score"), "doc_id").limit(k).agg(F.min("score")).first()[0]
        reach = math.sqrt(max(0.0, 2 - 2 * float(best))) + SLACK
        # SLACK is in distances; near a distance of zero an error of the cosine is its square root
        reach = max(reach, math.sqrt(max(0.0, 2 - 2 * float(best)) + SLACK))
        near = [c for c in cells if c.nearest - reach <= away[c.number] <= c.farthest + reach]
        ring = F.lit(False)
        for number in {c.number for c in near}:
            d = float(away[number])
            ring = ring | ((F.col("cell") == number) & F.col("to_centre").between(d - reach, d + reach))
        return first, near, ring

    def search(self, query: list[float], k: int = 5) -> DataFrame:
        """(doc_id, score) of the k vectors with the largest cosine, ties to the smaller key; the query has a direction."""
        _, near, ring = self.opened(query, k)
        if not near:
            return self.spark.createDataFrame([], "doc_id long, score decimal(18,8)")
        rows = self._with_cells(near)
        rows = rows if ring is None else rows.filter(ring)
        return scored_vectors(rows, query, self.key).orderBy(F.desc("score"), "doc_id").limit(k)

    def _with_cells(self, cells: list[Cell]) -> DataFrame:
        """Rows of the cells, with the cell's number as a partition column."""
        out = None
        for batch in sorted({c.batch for c in cells}):
            root = f"{self.path}/batch/{batch}/rows"
            part = self.spark.read.option("basePath", root).parquet(*[f"{root}/cell={c.number}" for c in cells if c.batch == batch])
            out = part if out is None else out.unionByName(part)
        return out
