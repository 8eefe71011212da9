"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.session import run_folder


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application, as ``--py-files`` does: their Python
    workers import it, and keep what modules remember between tasks."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="kinsight-source-")) / "kinsight_source.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


_MEMORIES: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    """What this Python worker remembers for an operator from task to task. Workers serve all stages one after the other,
    so what other operators have left is dropped: else the memories of all stages add up."""
    others = [kept for other, kept in _MEMORIES.items() if other != operator and kept]
    if others:
        for kept in others:
            kept.clear()
        pa.default_memory_pool().release_unused()
    return _MEMORIES.setdefault(operator, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tasks_for(spark: SparkSession, rows: int, each: int = 100_000, small: int = 1) -> int:
    """How many tasks share ``rows`` when each takes about so many: all cores at least, and more as rows grow, but no
    more than one for each ``small`` rows begun."""
    return max(1, min(-(-rows // small), max(spark.sparkContext.defaultParallelism, -(-rows // each))))


def stored(df: DataFrame, purpose: str, drop_shuffles: bool = False, tasks: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: later steps, and tasks that are run again after an executor is
    lost, see one fixed version of the rows. ``drop_shuffles`` gives back the space of the shuffles behind the table
    once it is written. ``tasks`` bounds the number of files, each task taking several of the partitions behind them:
    on file systems of the local kind Hadoop starts a process or two for every file."""
    spark = df.sparkSession
    df = df if tasks is None else df.coalesce(tasks)
    folder, setting = run_folder(spark, purpose), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    if drop_shuffles:
        spark.conf.set(setting, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        if drop_shuffles:
            spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(folder)


def emptied(df: DataFrame) -> None:
    """Give back the space of a table made by ``stored`` that nothing reads any more: its files are replaced by none.
    ``df`` is the frame that ``stored`` returned, before any change."""
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(folder)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_of(name: str, folds: int) -> Column:
    """crc32 of the identifier written as text, modulo ``folds``; a null identifier counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def hash_bound(most: int, total: int) -> int:
    """A signed 64-bit bound below which ``most`` of ``total`` hashes fall on average; it tells shares apart down to
    one in 2^64, so a sample of a large table is never empty by rounding."""
    return -(1 << 63) + (most << 64) // total


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int = 17) -> DataFrame:
    """About ``most`` rows, chosen by a hash of ``key``; everything when there are fewer. Only classifiers are
    fitted on such a sample; the rows that are judged are never sampled."""
    total = rows.count()
    if total <= most:
        return rows
    return rows.filter(F.xxhash64(F.col(key), F.lit(seed)) < hash_bound(most, total))
