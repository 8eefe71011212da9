from pathlib import Path

import pytest

from kinsight.operators import erasure
from kinsight.operators.erasure import Product
from kinsight.plans.pipeline import Build
from kinsight.sources.buckets import Buckets
from scenarios import SETTINGS, Scenarios

GRAPH = [
    Product("postings", "doc_id", "texts", "doc_id"), Product("texts", "contact_id", "contacts", "contact_id"),
    Product("contacts", "customer_id"), Product("profiles", "customer_id"),
]


def products(spark):
    return {
        "profiles": spark.range(40).selectExpr("id as customer_id", "concat('secret-', id) as name"),
        "contacts": spark.range(200).selectExpr("id as contact_id", "if(id % 50 = 49, null, id % 40) as customer_id"),
        "texts": spark.range(300).selectExpr("id + 1000 as doc_id", "if(id < 290, id % 200, null) as contact_id", "'t' as text"),
        "postings": spark.range(900).selectExpr("id % 300 + 1000 as doc_id", "id as place"),
    }


def listed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "customer_id long")


def test_an_erase_list_is_walked_along_the_graph(spark):
    before = products(spark)
    after = erasure.erase(GRAPH, before, listed(spark, 3, 3, None, 999))
    gone = {r.contact_id for r in before["contacts"].collect() if r.customer_id == 3}
    docs = {r.doc_id for r in before["texts"].collect() if r.contact_id in gone}
    assert {r.customer_id for r in after["profiles"].collect()} == set(range(40)) - {3}
    assert {r.contact_id for r in after["contacts"].collect()} == set(range(200)) - gone
    assert {r.doc_id for r in after["texts"].collect()} == set(range(1000, 1300)) - docs and len(docs) > 3
    assert sorted(r.place for r in after["postings"].collect()) == [i for i in range(900) if i % 300 + 1000 not in docs]
    same = erasure.erase(GRAPH, before, listed(spark))
    assert all(same[p.name].count() == before[p.name].count() for p in GRAPH)


def test_nothing_of_an_erased_subject_stays_on_disk(spark, tmp_path):
    before, subjects = products(spark), listed(spark, 3, 17)
    stores = {p.name: Buckets(spark, str(tmp_path / p.name), p.key, per_bucket=10) for p in GRAPH}
    for name, store in stores.items():
        store.replace(before[name], 0)
    stores["profiles"].upsert(1, spark.createDataFrame([(3, "secret-3 again"), (5, "other")], "customer_id long, name string"))
    rows = {n: sum(s.pointer().rows.values()) for n, s in stores.items()}
    keys = {n: spark.createDataFrame(k.collect(), k.schema) for n, k in
            erasure.keys_to_erase(GRAPH, {n: s.read() for n, s in stores.items()}, subjects).items()}
    erasure.erase_stored(GRAPH, stores, keys, 2)
    for name, store in stores.items():
        on_disk = spark.read.parquet(*[str(f) for f in Path(store.root, "data").glob("v=*/b=*")])
        assert on_disk.join(keys[name], on_disk.columns[on_disk.columns.index(store.key)], "left_semi").count() == 0, name
    want = erasure.erase(GRAPH, before, subjects)
    assert all(stores[n].read().count() == want[n].count() for n in stores)
    found = {r["product"]: r for r in erasure.report(GRAPH, rows, keys, {n: s.read() for n, s in stores.items()}).collect()}
    assert all(r.rows_left == 0 and r.rows_before - r.rows_removed == r.rows_kept for r in found.values())
    assert found["profiles"].rows_removed == 2 and found["postings"].rows_removed > 20
    assert {r.name for r in stores["profiles"].lookup([5]).collect()} == {"other"}
    # untouched buckets stay where they were, and a repeated run changes nothing
    assert 0 in stores["texts"].pointer().holders.values()
    state = {n: sorted(map(str, s.read().collect())) for n, s in stores.items()}
    erasure.erase_stored(GRAPH, stores, keys, 2)
    stores["profiles"].upsert(1, spark.createDataFrame([(3, "secret-3 again")], "customer_id long, name string"))
    assert {n: sorted(map(str, s.read().collect())) for n, s in stores.items()} == state
    assert all(s.scrub() == [] for s in stores.values())


def test_a_released_build_holds_no_rows(spark, tmp_path):
    build = Build(Scenarios(spark), SETTINGS, workspace=str(tmp_path))
    kept = build.recommendations.collect()
    folders = [str(f) for f in tmp_path.iterdir()]
    assert len(folders) == 3 and all(spark.read.parquet(f).count() > 0 for f in folders) and kept
    build.release()
    assert all(spark.read.parquet(f).count() == 0 for f in folders)


@pytest.mark.parametrize("graph", [
    [Product("a", "k", "b", "k"), Product("b", "k", "a", "k")], [Product("a", "k", "nowhere", "k")], [Product("a", "k"), Product("a", "k")]])
def test_a_product_that_leads_nowhere_is_an_error(graph):
    with pytest.raises(ValueError):
        erasure.in_order(graph)
