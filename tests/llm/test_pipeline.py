from pyspark.sql import functions as F

import corpus_pipeline
from kinsight.llm import language, toxicity
from kinsight.llm.bagminhash import components
from kinsight.llm.common import remembered, tasks_for
from kinsight.llm.encoding import encoder, vocabulary_path
from tests.llm.cases import ROWS, SCHEMA
from tests.llm.test_duplicates import classes_by_hand, owners_by_hand

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.score(docs, labels).filter("predicted = 1").collect()}
    left = docs.filter(~F.col("doc_id").isin(list(toxic) or [-1]))
    unknown = {r.doc_id for r in language.identify(left).filter("lang_pred = 'und' or score < 0.02").collect()}
    rows = [(i, t) for i, t in texts.items() if i not in toxic | unknown]
    kept = {o[0] for o in owners_by_hand(rows) if o[3]}
    kept = {c[1] for c in classes_by_hand([(i, t) for i, t in sorted(rows) if i in kept])}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == kept
    by_document = {}
    for p in pieces:
        by_document[p.doc_id] = by_document.get(p.doc_id, 0) + p.length
    assert all(by_document[p.doc_id] == p.doc_tokens for p in pieces)


def test_stages_keep_columns_and_take_awkward_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for rows in (docs, docs.filter("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, rows, SF)
            assert kept.columns == docs.columns
            assert kept.exceptAll(rows).count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() >= rows.count()


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0")
    clean = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF).select("doc_id")
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.03 * clean.count()
    assert corpus_pipeline.STAGES[1][1](spark, docs, SF).count() == docs.count()


def test_small_tables_are_few_files(spark):
    """Each file costs a process or two on local file systems, whatever the number of shuffle partitions."""
    settings = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    links = spark.range(2000).selectExpr("id a", "id + id % 2 b").filter("a <> b")
    docs = spark.createDataFrame([(i, f"text number {i} of a few", "en", "a", 0) for i in range(500)], SCHEMA)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        roots = components(links)
        assert len(roots.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert {(r.node, r.root) for r in roots.collect()} == {(n, n - (n + 1) % 2) for n in range(1, 2001)}
        most = 4 * spark.sparkContext.defaultParallelism
        assert corpus_pipeline.STAGES[2][1](spark, docs, SF).rdd.getNumPartitions() <= most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tables_of_few_rows_are_one_file(spark):
    """However many cores there are; those of many rows are dealt out."""
    links = spark.range(0, 2000, 1, 7).selectExpr("id a", "id + id % 2 b").filter("a <> b")
    roots = components(links)
    assert len([f for f in roots.inputFiles()]) == 1 and roots.count() == 2000
    cores = spark.sparkContext.defaultParallelism
    assert tasks_for(spark, 10**9, small=10_000) == max(cores, 10**4)
    assert tasks_for(spark, 0, small=10_000) == 1 and tasks_for(spark, 10**5) == cores


def test_a_worker_drops_what_other_stages_remember():
    first = encoder(vocabulary_path("byte_bpe_50k.json"), True)
    assert encoder(vocabulary_path("byte_bpe_50k.json"), True) is first
    space = language.letter_space(64, 3, 5)
    assert language.letter_space(64, 3, 5) is space
    assert encoder(vocabulary_path("byte_bpe_50k.json"), True) is not first
    assert remembered("near_dedup") == {} and language.letter_space(64, 3, 5) is not space
