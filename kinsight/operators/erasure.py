"""Erasure of data subjects from a product and everything derived from it.

A product graph says how each product hangs on another: by the subject's own identifier, or by the key of the product
it was made from. An erase list is walked along it, so that rows which carry no subject identifier go as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsight.sources.buckets import Buckets


@dataclass(frozen=True)
class Product:
    """``key`` is the column that leads to the subject: the subject's identifier itself, or ``parent_key`` of the
    product ``parent``."""

    name: str
    key: str
    parent: str | None = None
    parent_key: str | None = None


def in_order(graph: list[Product]) -> list[Product]:
    """Parents before what hangs on them; an unknown parent or a circle is an error."""
    known, done, left = {p.name for p in graph}, [], list(graph)
    if len(known) < len(graph):
        raise ValueError("a product is named twice")
    while left:
        ready = [p for p in left if p.parent is None or p.parent in {d.name for d in done}]
        if not ready:
            lost = ", ".join(f"{p.name} ({'no product' if p.parent not in known else 'a circle at'} {p.parent})" for p in left)
            raise ValueError(f"products lead to no subject: {lost}")
        done += ready
        left = [p for p in left if p not in ready]
    return done


def keys_to_erase(graph: list[Product], tables: dict[str, DataFrame], subjects: DataFrame, subject: str = "customer_id") -> dict[str, DataFrame]:
    """For each product the distinct values of its key that lead to a subject of the erase list."""
    found: dict[str, DataFrame] = {}
    listed = subjects.select(F.col(subject).alias("_key")).filter("_key is not null").distinct()
    by_name = {p.name: p for p in graph}
    for product in in_order(graph):
        if product.parent is None:
            found[product.name] = listed.withColumnRenamed("_key", product.key)
            continue
        parent = by_name[product.parent]
        gone = tables[parent.name].join(found[parent.name], parent.key, "left_semi")
        found[product.name] = gone.select(F.col(product.parent_key).alias(product.key)).filter(F.col(product.key).isNotNull()).distinct()
    return found


def erase(graph: list[Product], tables: dict[str, DataFrame], subjects: DataFrame, subject: str = "customer_id") -> dict[str, DataFrame]:
    """Every product without the subjects' rows. A row whose key is null belongs to no subject and stays."""
    keys = keys_to_erase(graph, tables, subjects, subject)
    return {p.name: tables[p.name].join(keys[p.name], p.key, "left_anti") for p in graph}


def report(graph: list[Product], rows_before: dict[str, int], keys: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(product, rows_before, rows_removed, rows_kept, rows_left): ``rows_left`` are rows of a listed subject that are
    still there. ``keys`` are those that led to a subject before anything was erased, stored: afterwards the links
    from a row to its subject are gone."""
    out = None
    for p in graph:
        found = after[p.name].join(keys[p.name].withColumn("_gone", F.lit(True)), p.key, "left")
        row = found.agg(F.count("*").alias("rows_kept"), F.count("_gone").alias("rows_left")).select(
            F.lit(p.name).alias("product"), F.lit(rows_before[p.name]).cast("long").alias("rows_before"),
            (F.lit(rows_before[p.name]) - F.col("rows_kept")).alias("rows_removed"), "rows_kept", "rows_left")
        out = row if out is None else out.unionByName(row)
    return out


def erase_stored(graph: list[Product], stores: dict[str, Buckets], keys: dict[str, DataFrame], version: int) -> dict[str, list[int]]:
    """Erase from maintained tables whose buckets are by the product's key, and empty the folders that the erased rows
    lay in. Only buckets that hold such rows are written again. ``keys`` come from ``keys_to_erase``; they may be lazy,
    for what hangs on a product is erased before it. Hence also a run that was cut short can be repeated: products it
    had finished stay as they are. Returns the versions that were emptied in part."""
    emptied = {}
    for product in reversed(in_order(graph)):
        store = stores[product.name]
        if store.key != product.key:
            raise ValueError(f"{product.name} has its buckets by {store.key}, not by {product.key}")
        store.delete(version, keys[product.name])
        emptied[product.name] = store.scrub()
    return emptied
