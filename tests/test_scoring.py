import pytest
from pyspark.sql import functions as F

from kinsight.operators import enrichment, scoring
from kinsight.sources.testbed import SETTINGS

RULES = SETTINGS.rules


def model_that_fails_on(word):
    def factory():
        def model(texts):
            if any(word in t for t in texts):
                raise RuntimeError("cannot read " + "x" * 500)
            return [(0.5, '{"summary":"' + t[:3000] + '","topic":"claims"}') for t in texts]

        return model

    return factory


def contacts(spark, texts):
    rows = [(i, 7, i, t, "FALSE" if t == "refused" else "TRUE") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "interaction_id long, customer_id long, transcript_id long, raw_text string, recording_consent_flag string")
    interactions = df.select("interaction_id", "customer_id").withColumns({
        "channel": F.lit("phone"), "direction": F.lit("inbound"), "disposition": F.lit("resolved"),
        "interaction_date": F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), "duration_seconds": F.lit(5), "representative_id": F.lit(1)})
    return interactions, df.withColumns({"content_type": F.lit("call"), "word_count": F.lit(1)})


def test_one_failing_text_loses_no_other(spark):
    texts = [f"text {i}" for i in range(2000)]
    texts[777], texts[5], texts[6] = "a bad one", "refused", None
    out = enrichment.enrich(*contacts(spark, texts), RULES, scoring.batched_scorer(model_that_fails_on("bad"), max_rows=100)).cache()
    by_status = {r.enrichment_status: r["count"] for r in out.groupBy("enrichment_status").count().collect()}
    assert by_status == {"completed": 1997, "failed": 2, "consent_withheld": 1}
    failed = {r.interaction_id: r.enrichment_error for r in out.filter("enrichment_status = 'failed'").collect()}
    assert failed == {777: "scorer raised: RuntimeError: cannot read " + "x" * 500, 6: "sentiment scorer returned invalid: NULL"}
    cut = enrichment.shown(out).filter("interaction_id = 777").first()
    assert cut.enrichment_error == ("scorer raised: " + "RuntimeError: cannot read " + "x" * 500)[:215]
    assert enrichment.shown(out, error=None).filter("interaction_id = 777").first().enrichment_error == failed[777]
    out.unpersist()


def test_stored_products_are_whole(spark):
    out = enrichment.enrich(*contacts(spark, ["y" * 3000]), RULES, scoring.batched_scorer(model_that_fails_on("bad")))
    row, page = out.first(), enrichment.shown(out).first()
    assert len(row.summary) == 3000 and len(row.extraction_raw) > 3000
    assert (len(page.summary), len(page.extraction_raw)) == (500, 2000)
    assert enrichment.shown(out, None, None, None).first() == row


@pytest.mark.parametrize(("sizes", "want"), [
    ([], []), ([5], [(0, 1)]), ([4, 4, 4], [(0, 2), (2, 3)]), ([50, 1, 1, 1, 1], [(0, 1), (1, 4), (4, 5)]), ([1, 50, 1], [(0, 1), (1, 2), (2, 3)])])
def test_batches_are_bounded(sizes, want):
    assert list(scoring.in_bounds(["z" * n for n in sizes], max_rows=3, max_bytes=10)) == want


def test_halving_calls_a_model_seldom():
    calls = []

    def model(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise KeyError("bad")
        return [(0.1, t) for t in texts]

    texts = [str(i) for i in range(256)]
    texts[100] = "bad"
    out = scoring.isolated(model, texts)
    assert [r[1] for r in out] == [None if t == "bad" else t for t in texts] and len(calls) <= 17
    assert [r[2] for r in scoring.isolated(lambda t: [], ["a", "b"])] == ["ValueError: 0 results for 1 texts"] * 2
