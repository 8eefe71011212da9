"""Text enrichment: consent gate, pluggable scorer, validated output, derived flags.

The text is scored where it lies: all text work is a narrow projection of the
transcript table, and only the small derived columns travel to the join with
the interactions. Raw text is never shuffled.

A scorer is any function DataFrame -> DataFrame that adds two columns to the
rows it is given: ``sentiment_raw`` (number in [-1, 1] or NULL) and
``extraction_raw`` (JSON text with summary, intent, urgency and topic). It reads
``scorable_text``, which is NULL wherever consent is refused, so refused text
cannot reach a scorer, built-in or plugged in. A scorer may add ``scorer_error``,
why a text has no result (``scoring.batched_scorer`` does). Products keep summaries,
raw output and errors whole; ``shown`` cuts them for display.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsight.config import DEFAULT_INTENT, DEFAULT_TOPIC, INTENTS, TOPICS, URGENCIES, URGENCY_ORDER, TextRules
from kinsight.functions import text as tx
from kinsight.functions.numeric import count_if, ordinal, ratio
from kinsight.operators.search import word_counts

Scorer = Callable[[DataFrame], DataFrame]

RAW_SCORE = "decimal(20,10)"
SCORE = "decimal(5,4)"


def eligibility(transcript_id: Column, consent: Column) -> Column:
    return (
        F.when(transcript_id.isNull(), "not_applicable")
        .when(consent == "FALSE", "consent_withheld")
        .otherwise("eligible")
    )


def enrichment_eligibility(interactions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """interaction ⟕ transcript → not_applicable / consent_withheld / eligible."""
    gate = transcripts.select("interaction_id", "transcript_id", "recording_consent_flag")
    return interactions.select("interaction_id", "customer_id").join(gate, "interaction_id", "left").withColumn(
        "eligibility", eligibility(F.col("transcript_id"), F.col("recording_consent_flag"))
    )


def lexicon_scorer(rules: TextRules) -> Scorer:
    """(positive - negative) / (positive + negative) over the whole text, plus keyword extraction.

    A text without any lexicon word has no score (NULL), which makes its
    enrichment fail rather than read as neutral.
    """
    keywords = [k for group in (rules.topics, rules.intents, rules.urgencies) for _, words in group for k in words]
    vocabulary = [*rules.positive, *rules.negative, *keywords]

    def score(df: DataFrame) -> DataFrame:
        text, hits = F.col("scorable_text"), F.col("_hits")
        # one pass reduces the text to the words that matter; everything else looks at those
        counted = df.withColumn("_hits", tx.only(tx.tokens(text), vocabulary)).withColumns({
            "_pos": tx.count_in(hits, rules.positive), "_neg": tx.count_in(hits, rules.negative)})
        extraction = F.to_json(F.struct(
            tx.first_sentence(text).alias("summary"),
            tx.first_rule(hits, rules.intents, DEFAULT_INTENT).alias("intent"),
            tx.first_rule(hits, rules.urgencies, rules.default_urgency).alias("urgency"),
            tx.first_rule(hits, rules.topics, DEFAULT_TOPIC).alias("topic"),
        ))
        return counted.withColumns({
            "sentiment_raw": ratio(F.col("_pos") - F.col("_neg"), F.col("_pos") + F.col("_neg")).cast(RAW_SCORE),
            "extraction_raw": F.when(text.isNotNull(), extraction),
        }).drop("_hits", "_pos", "_neg")

    return score


def score_transcripts(transcripts: DataFrame, rules: TextRules, scorer: Scorer | None = None) -> DataFrame:
    """Narrow text pass: gate, score, scan for escalation wording, then drop the text."""
    refused = F.col("recording_consent_flag").eqNullSafe("FALSE")
    gated = transcripts.select(
        "transcript_id", "interaction_id", "content_type", "word_count", "recording_consent_flag",
        F.coalesce(tx.like_any(F.lower("raw_text"), rules.escalation_patterns), F.lit(False)).alias("text_escalates"),
        F.when(~refused, F.col("raw_text")).alias("scorable_text"),
    )
    scored = (scorer or lexicon_scorer(rules))(gated).drop("scorable_text")
    return scored if "scorer_error" in scored.columns else scored.withColumn("scorer_error", F.lit(None).cast("string"))


IN_RANGE = "coalesce(sentiment_raw BETWEEN -1 AND 1, false)"


def _closed(name: str, allowed: tuple[str, ...], default: str) -> str:
    """Lower-cased field of the parsed output if it is in its closed set, else the default."""
    value, members = f"lower(try_variant_get(_json, '$.{name}', 'string'))", ", ".join(f"'{v}'" for v in allowed)
    return f"CASE WHEN extraction_raw IS NOT NULL THEN CASE WHEN {value} IN ({members}) THEN {value} ELSE {default} END END"


def validated(scored: DataFrame) -> DataFrame:
    """Check the scorer's output: range, closed enumerations, safe defaults.

    The JSON is parsed once into a variant; every field is read from it with a
    try-cast, so malformed or adversarial output can only become a default.
    """
    kept = [c for c in scored.columns if c not in ("sentiment_raw", "extraction_raw")]
    return scored.withColumns({
        "sentiment_raw": F.expr(f"try_cast(sentiment_raw AS {RAW_SCORE})"),
        "_json": F.expr("try_parse_json(trim(extraction_raw))"),
    }).selectExpr(
        *kept, "sentiment_raw",
        f"CAST(CASE WHEN {IN_RANGE} THEN round(sentiment_raw, 4) END AS {SCORE}) AS sentiment_score",
        "CASE WHEN sentiment_raw < -0.2 THEN 'negative' WHEN sentiment_raw > 0.2 THEN 'positive' "
        "WHEN sentiment_raw IS NOT NULL THEN 'neutral' END AS sentiment_label",
        "try_variant_get(_json, '$.summary', 'string') AS summary",
        _closed("topic", TOPICS, f"'{DEFAULT_TOPIC}'") + " AS primary_topic",
        _closed("intent", INTENTS, f"'{DEFAULT_INTENT}'") + " AS primary_intent",
        _closed("urgency", URGENCIES, "NULL") + " AS extracted_urgency",
        "extraction_raw",
        "_json IS NOT NULL AS json_ok",
    )


# Structural override, then the extracted value, then a fallback from score and disposition.
URGENCY = (
    "CASE WHEN sentiment_raw < -0.5 AND (disposition = 'complaint' OR primary_intent = 'escalation') THEN 'critical' "
    "WHEN extracted_urgency IS NOT NULL THEN extracted_urgency "
    "WHEN sentiment_raw < -0.2 THEN 'high' WHEN disposition = 'complaint' THEN 'high' "
    "WHEN sentiment_raw BETWEEN -0.2 AND 0.2 THEN 'medium' ELSE 'low' END"
)


NOT_JSON, RAISED = "extraction returned non-JSON: ", "scorer raised: "


def shown(enriched: DataFrame, summary: int | None = 500, raw: int | None = 2000, error: int | None = 200) -> DataFrame:
    """The product as a page shows it: summary, raw output and what an error quotes cut to so many characters; None
    keeps all. What is stored is never cut."""

    def cut(name: str, limit: int | None) -> Column:
        return F.col(name) if limit is None else F.left(name, F.lit(limit))

    quoting = [F.col("enrichment_error").startswith(start) for start in (NOT_JSON, RAISED)]
    message = F.col("enrichment_error")
    if error is not None:
        message = F.when(quoting[0], F.left(message, F.lit(len(NOT_JSON) + error))).when(
            quoting[1], F.left(message, F.lit(len(RAISED) + error))).otherwise(message)
    return enriched.withColumns({
        "summary": cut("summary", summary), "extraction_raw": cut("extraction_raw", raw), "enrichment_error": message})


def scored_once(scored: DataFrame) -> DataFrame:
    """Same rows, behind a generator that conditions on the scores cannot be pushed through.

    A filter such as "status = completed" would otherwise be pushed below the
    join and down to the scan, where it scores every text a second time just to
    evaluate itself.
    """
    return scored.selectExpr(f"inline_outer(array(struct({', '.join(scored.columns)})))")


def enrich(
    interactions: DataFrame, transcripts: DataFrame, rules: TextRules, scorer: Scorer | None = None
) -> DataFrame:
    """One row per interaction with validated text signals, flags, status and provenance."""
    scored = scored_once(validated(score_transcripts(transcripts, rules, scorer)))
    contact = interactions.select(
        "interaction_id", "customer_id", "channel", "direction", "disposition", "interaction_date",
        "duration_seconds", "representative_id",
    )
    joined = contact.join(scored, "interaction_id", "left").withColumn(
        "_gate", eligibility(F.col("transcript_id"), F.col("recording_consent_flag")))
    return joined.selectExpr(
        *contact.columns, "transcript_id", "content_type", "word_count",
        "sentiment_score", "sentiment_label", "summary", "primary_topic", "primary_intent",
        f"{URGENCY} AS urgency_level",
        "extraction_raw",
        "coalesce(disposition = 'complaint', false) OR coalesce(primary_intent = 'complaint', false) "
        "OR coalesce(sentiment_raw < -0.5, false) AS is_complaint",
        "coalesce(primary_intent = 'escalation', false) OR coalesce(text_escalates, false) AS is_escalation",
        f"CASE WHEN _gate != 'eligible' THEN _gate WHEN scorer_error IS NULL AND {IN_RANGE} AND json_ok THEN 'completed' ELSE 'failed' END "
        "AS enrichment_status",
        f"CASE WHEN _gate = 'eligible' THEN '{rules.model_name}' END AS enrichment_model",
        f"CASE WHEN _gate != 'eligible' THEN NULL WHEN scorer_error IS NOT NULL THEN concat('{RAISED}', scorer_error) "
        f"WHEN NOT {IN_RANGE} THEN concat('sentiment scorer returned invalid: ', "
        "coalesce(CAST(CAST(sentiment_raw AS DOUBLE) AS STRING), 'NULL')) "
        "WHEN extraction_raw IS NULL THEN 'extraction returned NULL' "
        f"WHEN NOT json_ok THEN concat('{NOT_JSON}', extraction_raw) END "
        "AS enrichment_error",
        "interaction_id AS _source_event_id",
    )


def enrich_new(
    existing: DataFrame, interactions: DataFrame, transcripts: DataFrame, rules: TextRules,
    scorer: Scorer | None = None,
) -> DataFrame:
    """Enrich only interactions that are not in ``existing`` yet; re-deliveries change nothing.

    Known ids are removed from both inputs before any text is scored.
    """
    known = existing.select("interaction_id")
    fresh = interactions.dropDuplicates(["interaction_id"]).join(known, "interaction_id", "left_anti")
    fresh_text = transcripts.join(known, "interaction_id", "left_anti")
    return enrich(fresh, fresh_text, rules, scorer)


# --- reports ---------------------------------------------------------------------------------------------------


def _completed(enriched: DataFrame) -> DataFrame:
    return enriched.filter(F.col("enrichment_status") == "completed")


def report_status(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("enrichment_status").agg(F.count("*").alias("cnt")).orderBy("enrichment_status")


def report_sentiment(enriched: DataFrame) -> DataFrame:
    return _completed(enriched).groupBy("sentiment_label").agg(
        F.count("*").alias("cnt"),
        F.round(F.avg("sentiment_score"), 3).alias("avg_score"),
        F.round(F.min("sentiment_score"), 3).alias("min_score"),
        F.round(F.max("sentiment_score"), 3).alias("max_score"),
    ).orderBy("avg_score", "sentiment_label")


def report_topic_intent(enriched: DataFrame) -> DataFrame:
    return _completed(enriched).groupBy("primary_topic", "primary_intent").agg(F.count("*").alias("cnt")).orderBy(
        F.desc("cnt"), "primary_topic", "primary_intent"
    )


def report_urgency(enriched: DataFrame) -> DataFrame:
    return _completed(enriched).groupBy("urgency_level").agg(F.count("*").alias("cnt")).orderBy(
        ordinal(F.col("urgency_level"), URGENCY_ORDER)
    )


def report_most_negative(enriched: DataFrame, k: int = 10) -> DataFrame:
    return _completed(enriched).select(
        "interaction_id", "sentiment_label", "sentiment_score", "urgency_level", "primary_intent", "summary"
    ).orderBy("sentiment_score", "interaction_id").limit(k)


def failure_rate(enriched: DataFrame) -> DataFrame:
    """Share of consented transcripts whose enrichment failed."""
    return enriched.agg(
        count_if(F.col("enrichment_status") == "failed").alias("failed"),
        count_if(F.col("enrichment_status").isin("failed", "completed")).alias("attempted"),
    ).withColumn("failure_rate", ratio(F.col("failed"), F.col("attempted"), 6))


def extracted_topics(words: Column, rules: TextRules, limit: int | None = 5) -> Column:
    """All topics with a keyword in the text, in rule order, at most ``limit``; else ['general']."""
    hits = F.array_compact(F.array(*[F.when(tx.has_any(words, keys), F.lit(name)) for name, keys in rules.topics]))
    return F.when(F.size(hits) == 0, F.array(F.lit(DEFAULT_TOPIC))).otherwise(hits if limit is None else F.slice(hits, 1, limit))


def transcript_words(transcripts: DataFrame, rules: TextRules, topics: int | None = 5) -> DataFrame:
    """(doc_id, extracted_topics, doc_length, words) of each consented text: all that phrases need, in one pass."""
    spoken = transcripts.filter(~F.col("recording_consent_flag").eqNullSafe("FALSE"))
    found = spoken.select(F.col("transcript_id").alias("doc_id"), F.col("raw_text").alias("content"))
    counted = word_counts(found)
    return counted.withColumn("extracted_topics", extracted_topics(F.col("words.term"), rules, topics))


def key_phrases(words: DataFrame, phrases: int | None = 10, max_chars: int | None = 50) -> DataFrame:
    """Most distinctive words of each text: tf x (texts / texts with the word), with its topics.

    ``words`` is a stored ``transcript_words``, so the texts themselves are not read here. Counts per word are one
    grouping, joined back on the word; a word that occurs in a third of all texts is spread by the skew-join
    handling. The top phrases are cut per text before the final gather, which therefore holds at most ``phrases``
    rows per key; None keeps all.
    """
    tf = words.select(F.col("doc_id").alias("transcript_id"), F.explode("words").alias("x")).select(
        "transcript_id", F.col("x.term").alias("word"), "x.tf")
    if max_chars is not None:
        tf = tf.filter(F.length("word") <= max_chars)
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    weighed = tf.join(df, "word").withColumn("_weight", F.col("tf").cast("double") / F.col("df"))
    best = Window.partitionBy("transcript_id").orderBy(F.desc("_weight"), "word")
    top = weighed.withColumn("_rank", F.row_number().over(best))
    if phrases is not None:
        top = top.filter(F.col("_rank") <= phrases)
    gathered = top.groupBy("transcript_id").agg(
        F.sort_array(F.collect_list(F.struct("_rank", "word"))).alias("_top")
    ).select("transcript_id", F.col("_top.word").alias("key_phrases"))
    return words.select(F.col("doc_id").alias("transcript_id"), "extracted_topics").join(
        gathered, "transcript_id", "left"
    ).withColumn("key_phrases", F.coalesce("key_phrases", F.array().cast("array<string>")))
