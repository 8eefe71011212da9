"""One DuckDB query per registered query, over the views of ``oracle.base``."""

from __future__ import annotations

from oracle.base import CURRENT, NOW, PRIOR, RECENT, TODAY, direction, rdiv, sql, tidy, ts

ORACLES: dict[str, str] = {}
# what the registered searches ask for
SEARCH_TEXT = "thble erin thor and"
SEARCH_VECTOR = [((i * 7) % 11 - 5) / 10.0 for i in range(64)]


def add(**queries: str) -> None:
    for name, text in queries.items():
        ORACLES[name] = sql(text)


def doubles(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


def hash_of(*columns: str) -> str:
    return f"sha256(concat_ws('|', {', '.join(f'coalesce(CAST({c} AS VARCHAR), {chr(39) * 2})' for c in columns)}))"


CUSTOMER = ("customer_id", "household_id", "first_name", "last_name", "customer_since", "status", "date_of_birth", "email",
            "phone", "address_line_1", "city", "state", "postal_code")
POLICY = ("policy_id", "customer_id", "product_type", "status", "effective_date", "expiration_date", "premium_amount",
          "payment_frequency", "bound_date")
CLAIM = ("claim_id", "policy_id", "customer_id", "filed_date", "status", "loss_date", "loss_type", "reserve_amount",
         "paid_amount", "closed_date")
LANDED = (
    ("customers", "v_customers", CUSTOMER), ("policies", "v_policies", POLICY),
    ("coverages", "v_coverages", ("coverage_id", "policy_id", "coverage_type", "limit_amount", "deductible_amount")),
    ("claims", "v_claims", CLAIM),
    ("payments", "v_payments", ("payment_id", "customer_id", "policy_id", "due_date", "amount", "status", "paid_date",
                                "amount_paid")),
    ("interactions", "v_interactions", ("interaction_id", "customer_id", "channel", "direction", "disposition",
                                        "strftime(interaction_date, '%Y-%m-%dT%H:%M:%S.%f')", "duration_seconds", "representative_id")),
    ("transcripts", "v_transcripts", ("transcript_id", "interaction_id", "content_type", "raw_text", "word_count",
                                      "recording_consent_flag")),
    ("service_representatives", "v_reps", ("representative_id", "name", "role", "active", "team")),
)
CUT = "TIMESTAMP '2024-01-20 00:00:00'"
BAD_LINE = "(disposition = 'complaint' OR coalesce(duration_seconds > 300, false))"

add(
    load_csv_roundtrip="SELECT * REPLACE (CAST(customer_id AS VARCHAR) AS customer_id, "
                       "CAST(household_id AS VARCHAR) AS household_id) FROM v_customers",
    load_rejects=f"""SELECT CASE WHEN {BAD_LINE} THEN 'rejected' ELSE 'loaded' END AS outcome, count(*) AS row_count,
        CAST(sum(interaction_id) AS BIGINT) AS id_sum FROM v_interactions GROUP BY 1""",
    raw_audit_stamp=f"""SELECT c_custkey, '2024-02-01 06:00:00.000000' AS _loaded_at, 'customer.parquet' AS _source_file,
        'BATCH-2024-02-01' AS _batch_id, {hash_of('c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment')} AS _row_hash FROM customer""",
    row_hash=" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST({c[0]} AS VARCHAR) AS key, {hash_of(*c)} AS _row_hash FROM {v}" for t, v, c in LANDED),
    load_check=" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows_loaded, CAST(0 AS BIGINT) AS null_hashes, "
        f"CAST(64 AS BIGINT) AS min_hash_length, 'PASS' AS status FROM {v}" for t, v, _ in LANDED),
    upsert_merge="""
        SELECT customer_id, household_id, last_name,
               CASE WHEN state <> 'BUILDING' THEN 'NEW ' || state ELSE state END AS state, status,
               CASE WHEN status = 'active' THEN '2023-01-01 00:00:00.000000' ELSE '2024-02-01 06:00:00.000000' END
                   AS _loaded_at,
               CASE WHEN state <> 'BUILDING' THEN '2024-02-01 06:00:00.000000' ELSE '2023-01-01 00:00:00.000000' END
                   AS _processed_at
        FROM v_customers WHERE status = 'active' OR state <> 'BUILDING'""",
    insert_only_merge=f"SELECT interaction_id, customer_id, channel FROM v_interactions WHERE interaction_date >= {CUT}",
    surrogate_key="""
        SELECT customer_id, row_number() OVER (ORDER BY CASE WHEN status = 'active' THEN 0 ELSE 1 END, customer_id)
            AS customer_sk FROM v_customers""",
)

# --- documents ---------------------------------------------------------------------------------------------------

_TITLE = "upper(left({0}, 1)) || lower(substr({0}, 2))"


def initcap(column: str) -> str:
    """Each word capitalised; words are separated by single spaces."""
    return (f"array_to_string(list_transform(string_split(replace({column}, '_', ' '), ' '), "
            "lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ')")


_NAME = "trim(concat_ws(' ', first_name, last_name))"
POLICY_DOCS = f"""
    SELECT 'DOC-POL-' || p.policy_id AS doc_id, p.customer_id, p.policy_id, CAST(NULL AS BIGINT) AS interaction_id,
      'policy_summary' AS doc_type, {initcap('product_type')} || ' Insurance Policy ' || p.policy_id || ' for ' || {_NAME} AS title,
      concat_ws(chr(10), 'POLICY SUMMARY DOCUMENT', 'Policy Number: ' || p.policy_id,
        'Policy Type: ' || {initcap('product_type')} || ' Insurance',
        'Policyholder: ' || {_NAME} || ' (' || p.customer_id || ')',
        'Address: ' || concat_ws(', ', address_line_1, city, state || ' ' || postal_code),
        'Effective Date: ' || effective_date, 'Expiration Date: ' || expiration_date,
        'Status: ' || {initcap('p.status')}, 'Annual Premium: $' || format('{{:,.2f}}', CAST(premium_amount AS DOUBLE)),
        'Payment Frequency: ' || {initcap('payment_frequency')}, 'COVERAGES',
        coalesce(lines, '  No coverages on file.')) AS content,
      strftime(coalesce(bound_date, effective_date), '%Y-%m-%d 00:00:00.000000') AS created_at
    FROM v_policies p LEFT JOIN v_customers c ON c.customer_id = p.customer_id
    LEFT JOIN (SELECT policy_id, string_agg('  - ' || {_TITLE.format('coverage_type')} || ': Limit $' ||
          format('{{:,.2f}}', CAST(limit_amount AS DOUBLE)) || ', Deductible $' ||
          format('{{:,.2f}}', CAST(deductible_amount AS DOUBLE)), chr(10)
          ORDER BY limit_amount, coverage_type, deductible_amount) AS lines FROM v_coverages GROUP BY 1) l
      ON l.policy_id = p.policy_id"""
TRANSCRIPT_DOCS = f"""
    SELECT 'DOC-TRX-' || t.transcript_id AS doc_id, i.customer_id, CAST(NULL AS BIGINT) AS policy_id, t.interaction_id,
      'transcript' AS doc_type,
      {initcap('t.content_type')} || ' — ' || {_NAME} || ' (' || {_TITLE.format("coalesce(disposition, 'unknown')")} || ') on ' ||
        coalesce(strftime(interaction_date, '%Y-%m-%d'), '') AS title,
      concat_ws(chr(10), 'INTERACTION TRANSCRIPT', 'Transcript ID: ' || t.transcript_id,
        'Interaction ID: ' || t.interaction_id, 'Customer: ' || {_NAME} || ' (' || coalesce(CAST(i.customer_id AS VARCHAR), '') || ')',
        'Channel: ' || {_TITLE.format("coalesce(channel, 'unknown')")}, 'Type: ' || {initcap('t.content_type')},
        'Disposition: ' || {_TITLE.format("coalesce(disposition, 'unknown')")},
        'Date: ' || coalesce(strftime(interaction_date, '%Y-%m-%dT%H:%M:%S'), ''),
        'Duration: ' || coalesce(CAST(duration_seconds AS VARCHAR), 'N/A') || ' seconds',
        'Recording Consent: ' || recording_consent_flag, 'CONTENT', raw_text) AS content,
      {ts('interaction_date')} AS created_at
    FROM v_transcripts t LEFT JOIN v_interactions i ON i.interaction_id = t.interaction_id
    LEFT JOIN v_customers c ON c.customer_id = i.customer_id"""


EMAIL_DOCS = f"""
    SELECT 'DOC-EMAIL-' || i.interaction_id AS doc_id, i.customer_id, CAST(NULL AS BIGINT) AS policy_id, i.interaction_id,
      'email' AS doc_type,
      {_TITLE.format("direction")} || ' e-mail — ' || coalesce({_NAME}, '') || ' on ' || strftime(interaction_date, '%Y-%m-%d') AS title,
      concat_ws(chr(10), 'EMAIL', 'Customer: ' || coalesce({_NAME}, ''), 'Direction: ' || {_TITLE.format("direction")},
        'Disposition: ' || {_TITLE.format("disposition")}, 'Date: ' || strftime(interaction_date, '%Y-%m-%d'), 'CONTENT',
        coalesce(raw_text, 'No text on file.')) AS content,
      {ts('interaction_date')} AS created_at
    FROM v_interactions i LEFT JOIN v_transcripts t ON t.interaction_id = i.interaction_id
    LEFT JOIN v_customers c ON c.customer_id = i.customer_id WHERE channel = 'email'"""
add(
    docs_policy_summary=POLICY_DOCS,
    docs_transcript=TRANSCRIPT_DOCS,
    docs_email=EMAIL_DOCS,
    docs_corpus_counts=f"""SELECT doc_type, count(*) AS documents FROM (SELECT doc_type FROM ({POLICY_DOCS})
        UNION ALL SELECT doc_type FROM ({TRANSCRIPT_DOCS}) UNION ALL SELECT doc_type FROM ({EMAIL_DOCS})) GROUP BY 1""",
)

# --- curated -----------------------------------------------------------------------------------------------------

_V = ("policy_id", "customer_id", "product_type", "status", "premium_amount")
OLD = f"(SELECT *, {hash_of(*_V)} AS h FROM v_policies_earlier WHERE effective_date <= DATE '2000-08-01')"
NEW = (f"(SELECT *, {hash_of(*_V)} AS h FROM v_policies "
       "WHERE NOT (status = 'quoted' AND effective_date < DATE '1996-01-01'))")


def load(text: str, key: str, surrogate: str, digest: str | None = None) -> str:
    """Rows after two loads: surrogate key, lineage (``digest`` is the row hash, unless the rows have it) and times."""
    marks = f", {digest} AS _source_hash, 'BATCH-2024-02-01' AS _batch_id" if digest else ", 'BATCH-2024-02-01' AS _batch_id"
    return (f"SELECT *, md5(CAST({key} AS VARCHAR)) AS {surrogate}{marks}, '2023-01-01 00:00:00.000000' AS _loaded_at, "
            f"'2024-02-01 06:00:00.000000' AS _processed_at FROM ({text})")


def source_of(table: str) -> tuple[str, str]:
    """(view, row hash) of a landed table."""
    view, columns = next((v, c) for t, v, c in LANDED if t == table)
    return view, hash_of(*columns)


def with_hash(table: str, select: str) -> str:
    """A projection of a landed table with its row hash."""
    view, digest = source_of(table)
    return f"SELECT {select}, {digest} AS _source_hash FROM {view}"


add(
    dim_household=load(
        "SELECT h.* REPLACE (CAST(member_count AS BIGINT) AS member_count), x._source_hash FROM v_household h JOIN "
        f"(SELECT household_id, max(_h) AS _source_hash FROM (SELECT household_id, {source_of('customers')[1]} AS _h FROM v_customers) "
        "GROUP BY 1) x ON x.household_id IS NOT DISTINCT FROM h.household_id", "household_id", "household_sk"),
    dim_customer=load(with_hash("customers", "*, 'RAW.RAW_CUSTOMERS' AS _source_table"), "customer_id", "customer_sk"),
    dim_product=load(f"""SELECT product_type, {initcap('product_type')} AS product_name,
        CASE product_type WHEN 'auto' THEN 'Vehicle' WHEN 'home' THEN 'Property' WHEN 'renters' THEN 'Property'
             WHEN 'umbrella' THEN 'Liability' ELSE 'Other' END AS product_category, max(_h) AS _source_hash
        FROM (SELECT product_type, {source_of('policies')[1]} AS _h FROM v_policies) GROUP BY 1""", "product_type", "product_sk"),
    dim_policy=load(f"SELECT * REPLACE ({doubles('premium_amount')}) FROM (" + with_hash(
        "policies", "*, 'RAW.RAW_POLICIES' AS _source_table") + ")", "policy_id", "policy_sk"),
    dim_coverage=load(f"SELECT * REPLACE ({doubles('limit_amount', 'deductible_amount')}) FROM (" + with_hash(
        "coverages", "*, 'RAW.RAW_COVERAGES' AS _source_table")
        + ") QUALIFY row_number() OVER (PARTITION BY coverage_id ORDER BY _source_hash DESC) = 1", "coverage_id", "coverage_sk"),
    dim_channel=load(f"""SELECT channel AS channel_code, upper(left(channel, 1)) || substr(channel, 2) AS channel_name,
        CASE WHEN channel IN ('email', 'chat') THEN 'Digital' WHEN channel = 'phone' THEN 'Traditional' ELSE 'Other' END
            AS channel_category, max(_h) AS _source_hash
        FROM (SELECT channel, {source_of('interactions')[1]} AS _h FROM v_interactions) GROUP BY 1""", "channel_code", "channel_sk"),
    dim_service_rep=load("SELECT * REPLACE (active = 'TRUE' AS active) FROM (" + with_hash(
        "service_representatives", "*, 'RAW.RAW_SERVICE_REPRESENTATIVES' AS _source_table") + ")", "representative_id", "service_rep_sk"),
    fact_claim=load(f"SELECT * REPLACE ({doubles('reserve_amount', 'paid_amount')}) FROM (" + with_hash(
        "claims", "*, 'RAW.RAW_CLAIMS' AS _source_table") + ")", "claim_id", "claim_sk"),
    fact_payment=load(f"SELECT * REPLACE ({doubles('amount', 'amount_paid')}) FROM (" + with_hash(
        "payments", "*, 'RAW.RAW_PAYMENTS' AS _source_table") + ")", "payment_id", "payment_sk"),
    fact_interaction=load(f"SELECT * REPLACE ({ts('interaction_date')} AS interaction_date) FROM (" + with_hash(
        "interactions", "*, CAST(interaction_date AS DATE) AS interaction_date_key, 'RAW.RAW_INTERACTIONS' AS _source_table") + ")",
        "interaction_id", "interaction_sk"),
    transcript_content=load(with_hash("transcripts", "*, 'RAW.RAW_TRANSCRIPTS' AS _source_table"), "transcript_id", "transcript_sk"),
    dim_date="""
        WITH d AS (SELECT customer_since AS dt FROM v_customers UNION SELECT effective_date FROM v_policies
          UNION SELECT expiration_date FROM v_policies UNION SELECT bound_date FROM v_policies WHERE bound_date IS NOT NULL
          UNION SELECT filed_date FROM v_claims UNION SELECT loss_date FROM v_claims
          UNION SELECT closed_date FROM v_claims WHERE closed_date IS NOT NULL UNION SELECT due_date FROM v_payments
          UNION SELECT paid_date FROM v_payments WHERE paid_date IS NOT NULL
          UNION SELECT CAST(interaction_date AS DATE) FROM v_interactions)
        SELECT CAST(strftime(c, '%Y%m%d') AS BIGINT) AS date_sk, c AS calendar_date, isodow(c) - 1 AS day_of_week,
          strftime(c, '%a') AS day_name, day(c) AS day_of_month, dayofyear(c) AS day_of_year, weekofyear(c) AS week_of_year,
          month(c) AS month_number, strftime(c, '%b') AS month_name, quarter(c) AS quarter_number, year(c) AS year_number,
          isodow(c) IN (6, 7) AS is_weekend, quarter(c) AS fiscal_quarter, year(c) AS fiscal_year
        FROM (SELECT CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS DATE) AS c FROM d)""",
    scd2_policy=f"""
        SELECT coalesce(o.policy_id, n.policy_id) AS policy_id, x.status, x.valid_from, x.valid_to, x.is_current
        FROM {OLD} o FULL JOIN {NEW} n ON n.policy_id = o.policy_id,
        LATERAL (SELECT o.status, DATE '2000-08-01' AS valid_from,
                        CASE WHEN n.h = o.h THEN NULL ELSE {TODAY} END AS valid_to,
                        coalesce(n.h = o.h, false) AS is_current WHERE o.policy_id IS NOT NULL
                 UNION ALL
                 SELECT n.status, {TODAY}, NULL, true WHERE n.policy_id IS NOT NULL AND (o.h IS NULL OR o.h <> n.h)) x""",
    change_feed=f"""
        SELECT policy_id, change_type,
          CASE change_type WHEN 'delete' THEN 'DELETE' WHEN 'unchanged' THEN NULL ELSE 'INSERT' END AS _action,
          change_type = 'update' AS _is_update
        FROM (SELECT coalesce(o.policy_id, n.policy_id) AS policy_id,
                CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'delete' WHEN o.h <> n.h THEN 'update'
                     ELSE 'unchanged' END AS change_type
              FROM {OLD} o FULL JOIN {NEW} n ON n.policy_id = o.policy_id)""",
    fact_measures=f"""
        SELECT 'claim' AS kind, claim_id AS id, status, CAST(coalesce(closed_date, {TODAY}) - filed_date AS BIGINT) AS days
        FROM v_claims UNION ALL
        SELECT 'payment', payment_id, status, CAST(paid_date - due_date AS BIGINT) FROM v_payments""",
)

# --- aggregates and profile --------------------------------------------------------------------------------------

TIMELINE = f"""
    SELECT customer_id, to_json(list(
      {{'interaction_id': interaction_id, 'date': {ts('interaction_date')}, 'channel': channel, 'disposition': disposition,
        'sentiment_score': {rdiv('s4', '10000', 3)}, 'sentiment_label': sentiment_label, 'summary': summary,
        'topic': primary_topic, 'intent': primary_intent, 'urgency': urgency_level, 'is_complaint': is_complaint}}
      ORDER BY interaction_date DESC, interaction_id)) AS details
    FROM v_enriched WHERE enrichment_status = 'completed' AND {RECENT} GROUP BY 1"""
add(
    agg_customer_policy="SELECT * REPLACE (" + doubles("total_annual_premium", "active_annual_premium",
                        "total_coverage_limit", "total_deductible") + ") FROM v_agg_policy",
    agg_customer_claim="SELECT * REPLACE (" + doubles("total_reserve_amount", "total_paid_amount") + ") FROM v_agg_claim",
    agg_customer_payment="SELECT * REPLACE (" + doubles("total_amount_due", "total_amount_paid") + ") FROM v_agg_payment",
    agg_customer_interaction=f"SELECT * REPLACE ({ts('latest_interaction_date')} AS latest_interaction_date) FROM v_agg_interaction",
    household_policies="""
        SELECT household_id, count(DISTINCT c.customer_id) AS household_member_count, count(p.policy_id) AS total_household_policies,
               count(*) FILTER (p.status = 'active') AS household_policy_count
        FROM v_customers c LEFT JOIN v_policies p ON p.customer_id = c.customer_id GROUP BY 1""",
    trailing_12m_summary=f"""
        SELECT c.customer_id,
          (SELECT count(*) FROM v_payments p WHERE p.customer_id = c.customer_id AND p.status = 'missed'
             AND p.due_date >= {TODAY} - 365) AS missed_payment_count_12m,
          (SELECT count(*) FROM v_payments p WHERE p.customer_id = c.customer_id AND p.status = 'late'
             AND p.due_date >= {TODAY} - 365) AS late_payment_count_12m,
          (SELECT count(*) FROM v_claims k WHERE k.customer_id = c.customer_id AND k.filed_date >= {TODAY} - 365) AS claims_filed_12m,
          (SELECT CAST(sum(paid_amount) AS DOUBLE) FROM v_claims k WHERE k.customer_id = c.customer_id
             AND k.filed_date >= {TODAY} - 365) AS total_paid_12m,
          (SELECT count(*) FROM v_interactions i WHERE i.customer_id = c.customer_id
             AND i.interaction_date >= {NOW} - INTERVAL 365 DAY) AS total_interactions_12m
        FROM v_customers c""",
    customer_360_base="SELECT * FROM v_base",
    sentiment_summary="SELECT * FROM v_sentiment",
    interaction_timeline_array=TIMELINE,
    customer_360_enriched=f"SELECT p.*, t.details AS recent_interaction_details FROM v_profile p LEFT JOIN ({TIMELINE}) t "
                          "ON t.customer_id = p.customer_id",
    customer_360_with_timeline=f"""
        SELECT p.customer_id, t.details AS recent_interaction_details, p.system_status
        FROM v_profile p LEFT JOIN ({TIMELINE}) t ON t.customer_id = p.customer_id""",
    status_distribution="SELECT system_status, count(*) AS customer_count FROM v_profile GROUP BY 1",
    risk_action_matrix="SELECT risk_tier, nba_action_type, count(*) AS cnt FROM v_profile GROUP BY 1, 2",
    coverage_kpis="""SELECT count(*) AS total_customers, count(*) FILTER (has_enrichment) AS with_enrichment,
        count(*) FILTER (has_recommendation) AS with_recommendation,
        count(*) FILTER (system_status = 'full') AS fully_operational FROM v_profile""",
)

# --- enrichment --------------------------------------------------------------------------------------------------

SCORE = "s4 / 10000.0"
ERROR = "CASE WHEN enrichment_status = 'failed' THEN 'sentiment scorer returned invalid: NULL' END"
MODEL = "CASE WHEN enrichment_status IN ('failed', 'completed') THEN 'lexicon-sentiment + keyword-extraction' END"
add(
    enrich_eligibility="""
        SELECT i.interaction_id, i.customer_id, t.transcript_id, t.recording_consent_flag,
          CASE WHEN t.transcript_id IS NULL THEN 'not_applicable' WHEN t.recording_consent_flag = 'FALSE' THEN 'consent_withheld'
               ELSE 'eligible' END AS eligibility
        FROM v_interactions i LEFT JOIN v_transcripts t ON t.interaction_id = i.interaction_id""",
    sentiment_score=f"""SELECT transcript_id, CASE WHEN den IS NOT NULL THEN {rdiv('num', 'den', 4)} END AS sentiment_score,
        CASE WHEN 5 * num < -den THEN 'negative' WHEN 5 * num > den THEN 'positive' WHEN den IS NOT NULL THEN 'neutral' END
            AS sentiment_label FROM v_scored""",
    extract_json="""SELECT transcript_id, CASE WHEN ok THEN to_json({'summary': summary, 'intent': intent,
        'urgency': urgency, 'topic': topic}) END AS extraction_raw FROM v_scored""",
    validate_extraction="""SELECT transcript_id, summary, topic AS primary_topic, intent AS primary_intent,
        CASE WHEN urgency <> 'unknown' THEN urgency END AS extracted_urgency, ok AS json_ok FROM v_scored""",
    urgency="SELECT interaction_id, disposition, urgency_level FROM v_enriched",
    complaint_escalation_flags="SELECT interaction_id, is_complaint, is_escalation FROM v_enriched",
    enrichment_status=f"SELECT interaction_id, enrichment_status, {MODEL} AS enrichment_model, {ERROR} AS enrichment_error "
                      "FROM v_enriched",
    interactions_enriched=f"""SELECT * EXCLUDE (s4) REPLACE ({ts('interaction_date')} AS interaction_date),
        {SCORE} AS sentiment_score, {MODEL} AS enrichment_model, {ERROR} AS enrichment_error,
        interaction_id AS _source_event_id FROM v_enriched""",
    enrichment_reports_status="SELECT enrichment_status, count(*) AS cnt FROM v_enriched GROUP BY 1",
    enrichment_reports_sentiment=f"""
        SELECT sentiment_label, cnt, {rdiv('total', 'cnt * 10000', 3)} AS avg_score, {rdiv('lo', '10000', 3)} AS min_score,
               {rdiv('hi', '10000', 3)} AS max_score
        FROM (SELECT sentiment_label, count(*) AS cnt, sum(s4) AS total, min(s4) AS lo, max(s4) AS hi FROM v_enriched
              WHERE enrichment_status = 'completed' GROUP BY 1)""",
    enrichment_reports_topic_intent="""SELECT primary_topic, primary_intent, count(*) AS cnt FROM v_enriched
        WHERE enrichment_status = 'completed' GROUP BY 1, 2""",
    enrichment_reports_urgency="""SELECT urgency_level, count(*) AS cnt FROM v_enriched
        WHERE enrichment_status = 'completed' GROUP BY 1""",
    enrichment_reports_most_negative=f"""SELECT interaction_id, sentiment_label, {SCORE} AS sentiment_score, urgency_level,
        primary_intent, summary FROM v_enriched WHERE enrichment_status = 'completed' ORDER BY s4, interaction_id LIMIT 10""",
    key_phrases=r"""
        WITH tf AS (SELECT transcript_id, word, count(*) AS tf FROM (
                SELECT transcript_id, unnest(w) AS word FROM v_words WHERE recording_consent_flag <> 'FALSE')
              WHERE length(word) > 0 AND length(word) <= 50 GROUP BY 1, 2),
             df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
             best AS (SELECT transcript_id, word, row_number() OVER (PARTITION BY transcript_id
                ORDER BY CAST(tf AS DOUBLE) / df DESC, word) AS r FROM tf JOIN df USING (word)),
             top AS (SELECT transcript_id, list(word ORDER BY r) AS p FROM best WHERE r <= 10 GROUP BY 1)
        SELECT v.transcript_id, to_json(CASE WHEN len(t) = 0 THEN ['general'] ELSE t[1:5] END) AS extracted_topics,
               to_json(coalesce(top.p, CAST([] AS VARCHAR[]))) AS key_phrases
        FROM (SELECT transcript_id, list_filter([CASE WHEN list_contains(w, 'thble') THEN 'billing' END,
                CASE WHEN list_contains(w, 'erin') THEN 'claims' END, CASE WHEN list_contains(w, 'thor') THEN 'coverage' END,
                CASE WHEN list_contains(w, 'anea') THEN 'service' END,
                CASE WHEN list_contains(w, 'thed') THEN 'cancellation' END], lambda x: x IS NOT NULL) AS t
              FROM v_words WHERE recording_consent_flag <> 'FALSE') v LEFT JOIN top ON top.transcript_id = v.transcript_id""",
    enrichment_failure_rate=f"""SELECT failed, attempted, {rdiv('failed', 'attempted', 6)} AS failure_rate
        FROM (SELECT count(*) FILTER (enrichment_status = 'failed') AS failed,
                     count(*) FILTER (enrichment_status IN ('failed', 'completed')) AS attempted FROM v_enriched)""",
    enrich_idempotent=f"SELECT interaction_id, enrichment_status, {SCORE} AS sentiment_score, urgency_level FROM v_enriched",
)

# --- risk --------------------------------------------------------------------------------------------------------

SIGNAL = ("SELECT customer_id, signal_value, signal_score, w4 / 10000.0 AS weighted_score, signal_direction, evidence_text "
          "FROM v_signals WHERE signal_type = '{}'")
add(
    **{key: SIGNAL.format(name) for key, name in (
        ("signal_renewal", "renewal_proximity"), ("signal_sentiment_negative", "sentiment_negative"),
        ("signal_sentiment_trend", "sentiment_trend"), ("signal_payment", "payment_risk"),
        ("signal_complaint", "complaint_activity"), ("signal_claim", "claim_activity"),
        ("signal_engagement", "engagement_drop"), ("signal_cross_sell", "cross_sell_opportunity"))},
    risk_sentiment_windows=f"""
        SELECT customer_id, enriched_interactions_90d AS total_enriched_90d, risk_negative AS negative_count_90d,
          risk_complaint AS complaint_count_90d, risk_escalation AS escalation_count_90d,
          CASE WHEN cn > 0 THEN {rdiv('cs', 'cn * 10000', 8)} END AS avg_sentiment_90d,
          risk_worst4 / 10000.0 AS worst_sentiment_90d, {ts('risk_last_negative')} AS last_negative_date,
          CASE WHEN pn > 0 THEN {rdiv('ps', 'pn * 10000', 8)} END AS avg_sentiment_prior_90d
        FROM v_windows WHERE cn + pn > 0""",
    interaction_frequency=f"""SELECT customer_id, count(*) FILTER ({CURRENT}) AS interactions_current_90d,
        count(*) FILTER ({PRIOR}) AS interactions_prior_90d FROM v_interactions GROUP BY 1""",
    product_gaps="SELECT customer_id, active_policies, " + ", ".join(
        f"coalesce(product_holdings NOT LIKE '%{p}%', false) AS missing_{p}" for p in ("home", "umbrella", "auto", "renters"))
        + " FROM v_agg_policy",
    risk_wide=f"""SELECT * EXCLUDE (cs, cn, ps, pn, risk_worst4, risk_last_negative),
        CASE WHEN cn > 0 THEN {rdiv('cs', 'cn * 10000', 8)} END AS avg_sentiment_90d,
        risk_worst4 / 10000.0 AS worst_sentiment_90d, {ts('risk_last_negative')} AS last_negative_date,
        CASE WHEN pn > 0 THEN {rdiv('ps', 'pn * 10000', 8)} END AS avg_sentiment_prior_90d FROM v_wide""",
    risk_signals="""SELECT customer_id, signal_type, signal_value, signal_score, signal_weight, w4 / 10000.0 AS weighted_score,
        signal_direction, evidence_text FROM v_signals""",
    risk_summary="SELECT * FROM v_summary",
    risk_summary_from_signals="SELECT * FROM v_summary",
    risk_distribution="SELECT risk_tier, count(*) AS customer_count FROM v_summary GROUP BY 1",
    risk_signals_configured="""SELECT customer_id, signal_type, signal_score, signal_weight, w4 / 10000.0 AS weighted_score
        FROM v_signals""",
    signal_weights="""
        SELECT w.*, s.customers, s.active_customers, s.total_weighted FROM (VALUES
          ('renewal_proximity', 'Renewal Proximity', 0.30::DOUBLE, 'Days until nearest policy renewal date', TRUE),
          ('sentiment_negative', 'Negative Sentiment', 0.25, 'Count and severity of negative interactions in 90 days', TRUE),
          ('sentiment_trend', 'Sentiment Trend', 0.10, 'Direction of sentiment change (current vs prior 90d)', TRUE),
          ('payment_risk', 'Payment Risk', 0.15, 'Ratio of late/missed payments to total', TRUE),
          ('complaint_activity', 'Complaint Activity', 0.10, 'Recent complaints and escalation requests', TRUE),
          ('claim_activity', 'Claim Activity', 0.05, 'Open and recent claims indicating service load', TRUE),
          ('engagement_drop', 'Engagement Change', 0.05, 'Change in interaction frequency', TRUE),
          ('cross_sell_opportunity', 'Cross-Sell Gap', 0.00, 'Missing product types relative to household profile', FALSE)
        ) AS w(signal_type, signal_name, signal_weight, signal_description, is_risk_signal)
        LEFT JOIN (SELECT signal_type, count(*) AS customers, count(*) FILTER (signal_score > 0) AS active_customers,
                          CAST(sum(w4) AS BIGINT) / 10000.0 AS total_weighted FROM v_signals GROUP BY 1) s
          ON s.signal_type = w.signal_type""",
    scenario_labels=f"""
        SELECT customer_id, CASE WHEN days_to_renewal <= 14 THEN 'very_high' WHEN days_to_renewal <= 30 THEN 'high'
               WHEN days_to_renewal IS NOT NULL THEN 'low' ELSE 'none' END AS renewal_proximity,
          CASE payments_late + payments_missed WHEN 0 THEN 'good' WHEN 1 THEN 'minor_risk' ELSE 'poor' END AS payment_behavior,
          active_policies >= 2 AS multi_policy_flag, negative_count_90d AS negative_sentiment_count_90d,
          complaint_count_90d AS open_complaints, {direction('not_computable')} AS sentiment_direction FROM v_wide""",
)

# --- next best action --------------------------------------------------------------------------------------------

add(
    nba_evidence="""
        SELECT s.customer_id, row_number() OVER (PARTITION BY s.customer_id ORDER BY w4 DESC, signal_type) - 1 AS position,
          signal_type, signal_score, signal_weight, w4 / 10000.0 AS weighted_score, signal_direction AS direction,
          evidence_text AS evidence, """ + ", ".join(f"CAST({f} AS BIGINT) AS {f}" for f in (
            "has_renewal", "has_negative_sentiment", "has_sentiment_trend", "has_payment_risk", "has_complaint",
            "has_claim", "has_engagement_drop", "has_cross_sell")) + """
        FROM v_signals s JOIN v_context c ON c.customer_id = s.customer_id""",
    enrichment_coverage=f"""
        SELECT customer_id, interaction_rows AS total_interactions, transcripts_enriched AS enriched_count,
          transcripts_failed AS failed_count, CASE WHEN transcripts_total > 0 THEN
          {rdiv('transcripts_enriched', 'transcripts_total', 2)} END AS enrichment_coverage_pct FROM v_windows""",
    nba_candidates="""
        SELECT customer_id, action_id, action_type, risk_tier, composite_risk_score, product_holdings, active_policies,
          enrichment_coverage_pct, enriched_count, CAST(priority_rank AS BIGINT) AS priority_rank,
          safety100 / 100.0 AS safety_score FROM v_matrix""",
    nba_eligibility="""SELECT customer_id, action_id, action_type, product_eligible, not_excluded, risk_tier_eligible,
        signal_eligible FROM v_matrix""",
    nba_scores="""SELECT customer_id, action_id, action_type, r10 / 10.0 AS relevance_score, f1000 / 1000.0 AS final_score
        FROM v_matrix""",
    nba_ranked="SELECT customer_id, action_rank, action_type, f1000 / 1000.0 AS final_score FROM v_recommendations",
    nba_confidence="SELECT customer_id, confidence_level, confidence_score FROM v_recommendations WHERE action_rank = 1",
    nba_explain="SELECT customer_id, action_rank, data_completeness, eligibility_check FROM v_recommendations",
    nba_recommendations="""
        SELECT r.customer_id, action_rank, action_id, action_type, action_name, action_description, action_category,
          r10 / 10.0 AS relevance_score, safety100 / 100.0 AS safety_score, f1000 / 1000.0 AS final_score, risk_tier,
          composite_risk_score, overall_direction, confidence_level, confidence_score, e.evidence_signals, data_completeness,
          product_holdings, active_policies, eligibility_check, false AS is_approved, CAST(NULL AS VARCHAR) AS approved_by,
          CAST(NULL AS VARCHAR) AS approved_at, CAST(NULL AS VARCHAR) AS approval_notes
        FROM v_recommendations r JOIN v_evidence e ON e.customer_id = r.customer_id""",
    nba_primary="""SELECT customer_id, action_rank, action_id, action_type, action_name, f1000 / 1000.0 AS final_score, risk_tier
        FROM v_recommendations WHERE action_rank = 1""",
    nba_alternatives="""SELECT customer_id, action_rank, action_id, action_type, f1000 / 1000.0 AS final_score
        FROM v_recommendations WHERE action_rank > 1""",
    nba_distribution="SELECT action_type, count(*) AS customer_count FROM v_recommendations WHERE action_rank = 1 GROUP BY 1",
    nba_confidence_distribution="""SELECT confidence_level, count(*) AS cnt FROM v_recommendations WHERE action_rank = 1
        GROUP BY 1""",
    action_catalog="""
        SELECT a.action_id, a.action_type, a.action_category, a.safety100 / 100.0 AS safety_score,
          CAST(a.priority_rank AS BIGINT) AS priority_rank, a.eligible_products, a.requires_risk_tier, a.requires_signal,
          count(r.customer_id) AS recommended, count(*) FILTER (r.action_rank = 1) AS primary_count
        FROM v_actions a LEFT JOIN v_recommendations r ON r.action_id = a.action_id GROUP BY ALL""",
    nba_rule_exclusions="""
        SELECT customer_id, action_rank, action_type FROM v_recommendations
        WHERE NOT (action_type = 'retention_outreach' AND coalesce(product_holdings LIKE '%renters%', false))
          AND NOT (action_type = 'billing_assistance' AND coalesce(product_holdings LIKE '%umbrella%', false))""",
    nba_withheld="""SELECT customer_id, action_rank, action_type, confidence_level FROM v_recommendations
        WHERE confidence_level <> 'low'""",
    evidence_lineage=f"""
        WITH r AS (SELECT *, enrichment_status = 'completed' AS done, {CURRENT} AS now FROM v_enriched WHERE {RECENT}),
             s AS (SELECT customer_id, 'sentiment_negative' AS signal_type, interaction_id, transcript_id FROM r
                   WHERE done AND now AND sentiment_label = 'negative' UNION ALL
                   SELECT customer_id, 'complaint_activity', interaction_id, transcript_id FROM r
                   WHERE done AND now AND (is_complaint OR is_escalation) UNION ALL
                   SELECT customer_id, 'sentiment_trend', interaction_id, transcript_id FROM r WHERE done UNION ALL
                   SELECT customer_id, 'engagement_drop', interaction_id, transcript_id FROM r)
        SELECT customer_id, signal_type, 'interaction' AS source_type, CAST(interaction_id AS VARCHAR) AS source_id FROM s
        UNION ALL SELECT customer_id, signal_type, 'transcript', CAST(transcript_id AS VARCHAR) FROM s WHERE transcript_id IS NOT NULL
        UNION ALL SELECT customer_id, 'payment_risk', 'payment', payment_id FROM v_payments WHERE status IN ('late', 'missed')
        UNION ALL SELECT customer_id, 'claim_activity', 'claim', claim_id FROM v_claims
                  WHERE status IN ('filed', 'under_review')
        UNION ALL SELECT p.customer_id, 'renewal_proximity', 'policy', CAST(p.policy_id AS VARCHAR) FROM v_policies p
                  JOIN v_agg_policy a ON a.customer_id = p.customer_id AND a.nearest_renewal_date = p.expiration_date
                  WHERE p.status = 'active'
        UNION ALL SELECT customer_id, 'cross_sell_opportunity', 'policy', CAST(policy_id AS VARCHAR) FROM v_policies
                  WHERE status = 'active'""",
)

# --- decisions ---------------------------------------------------------------------------------------------------

MOMENT = "strftime({0}, '%Y-%m-%dT%H:%M:%S')"
MADE = f"""
made AS (
  SELECT *, CASE turn WHEN 1 THEN 'modified' WHEN 2 THEN 'rejected' WHEN 3 THEN 'timeout' ELSE 'approved' END AS decision,
    CASE turn WHEN 1 THEN 'adjusted terms' WHEN 2 THEN 'not suitable' ELSE '' END AS notes,
    'rep-' || customer_id % 10 AS representative_id, 's-' || session AS session_id,
    presented_at + INTERVAL 5 MINUTE AS decided_at,
    sha256(customer_id || '|' || {MOMENT.format('presented_at')}) AS recommendation_log_id
  FROM (SELECT customer_id, session, (customer_id + session) % 5 AS turn,
          CAST(DATE '2000-01-01' + CAST((customer_id * 3) % 300 + 30 * session AS INTEGER) AS TIMESTAMP) AS presented_at
        FROM v_customers CROSS JOIN (SELECT unnest([0, 1]) AS session))),
log AS (
  SELECT m.*, r.action_type, r.action_name, r.action_description, r.confidence_level, r.confidence_score,
         r.composite_risk_score, r.risk_tier, r.f1000 / 1000.0 AS final_score
  FROM made m JOIN v_recommendations r ON r.customer_id = m.customer_id AND r.action_rank = 1),
events AS (
  SELECT sha256(recommendation_log_id || '|' || event_type) AS event_id, recommendation_log_id, customer_id, event_type,
    CASE WHEN event_type = 'presented' THEN presented_at ELSE decided_at END AS event_timestamp,
    CASE WHEN event_type <> 'presented' THEN notes END AS event_notes, representative_id AS actor,
    to_json({{'action_name': action_name, 'confidence_level': confidence_level, 'risk_tier': risk_tier}}) AS metadata,
    true AS _immutable
  FROM (SELECT *, unnest(['presented', decision]) AS event_type FROM log)),
follow AS (
  SELECT sha256(recommendation_log_id || '|follow-up') AS follow_up_id, recommendation_log_id, customer_id,
    decision AS follow_up_status,
    CASE WHEN decision = 'modified' THEN 'custom plan ' || customer_id ELSE action_description END AS action_taken,
    nullif(notes, '') AS notes, representative_id AS assigned_to, decided_at AS created_at, true AS _immutable
  FROM log WHERE decision IN ('approved', 'modified')),
terms AS (
  SELECT customer_id, effective_date AS started, max(CASE WHEN status IN ('active', 'renewed', 'bound') THEN 'renewed'
         WHEN status IN ('lapsed', 'cancelled') THEN 'lapsed' ELSE 'no_change' END) AS kind
  FROM v_policies GROUP BY 1, 2),
outcomes AS (
  SELECT sha256(follow_up_id || '|outcome') AS outcome_id, follow_up_id, customer_id,
    CASE WHEN started IS NOT NULL THEN kind WHEN d + 180 > {TODAY} THEN 'unknown' ELSE 'no_change' END AS outcome_type,
    CASE WHEN started IS NOT NULL THEN started ELSE least(d + 180, {TODAY}) END AS observed_date,
    CASE WHEN started IS NOT NULL THEN 'correlated' ELSE 'unknown' END AS attribution_method,
    CASE WHEN started - d <= 90 THEN 'high' WHEN started IS NOT NULL THEN 'medium' ELSE 'low' END AS attribution_confidence
  FROM (SELECT f.follow_up_id, f.customer_id, CAST(f.created_at AS DATE) AS d, t.started, t.kind,
          row_number() OVER (PARTITION BY f.follow_up_id ORDER BY t.started) AS r
        FROM follow f LEFT JOIN terms t ON t.customer_id = f.customer_id AND t.started > CAST(f.created_at AS DATE)
             AND t.started <= CAST(f.created_at AS DATE) + 180) WHERE r = 1),
snapshots AS (
  SELECT sha256(recommendation_log_id || '|snapshot') AS context_snapshot_id, l.recommendation_log_id, l.customer_id,
    l.presented_at AS captured_at,
    '{{' || concat_ws(',', '"customer_id":' || b.customer_id, '"household_id":' || household_id,
      '"total_policies":' || total_policies, '"product_holdings":"' || product_holdings || '"',
      '"open_claims":' || open_claims, '"payments_late":' || payments_late,
      '"total_interactions":' || total_interactions) || '}}' AS snapshot_data,
    to_json({{'has_email': has_email, 'has_phone': has_phone, 'has_dob': has_dob, 'has_policies': has_policies,
      'has_claims': has_claims, 'has_payments': has_payments, 'has_interactions': has_interactions}}) AS data_completeness
  FROM log l JOIN v_base b ON b.customer_id = l.customer_id)
"""


def decision(query: str) -> str:
    return f"WITH {MADE.strip()}\n{query}"


def _count(name: str, text: str) -> str:
    return (f"SELECT '{name}' AS check_name, n AS violations, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status "
            f"FROM (SELECT count(*) AS n FROM {text})")


def _share(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) > 0 THEN {rdiv(f'({num})', f'({den})', 4)} END"


add(
    recommendation_log=decision(f"""SELECT recommendation_log_id, customer_id, {ts('presented_at')} AS recommendation_timestamp,
        action_type, action_name, action_description, confidence_level, confidence_score, composite_risk_score, risk_tier,
        final_score, session_id, representative_id, {ts('presented_at')} AS created_at, true AS _immutable FROM log"""),
    decision_events=decision(f"SELECT * REPLACE ({ts('event_timestamp')} AS event_timestamp) FROM events"),
    follow_ups=decision(f"SELECT * REPLACE ({ts('created_at')} AS created_at) FROM follow"),
    latest_recommendation=decision(f"""SELECT customer_id, {ts('presented_at')} AS created_at, recommendation_log_id, action_type,
        risk_tier FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY presented_at DESC,
        recommendation_log_id DESC) AS r FROM log) WHERE r = 1"""),
    context_snapshot=decision(f"SELECT * REPLACE ({ts('captured_at')} AS captured_at) FROM snapshots"),
    action_outcomes=decision("SELECT * FROM outcomes"),
    decision_history=decision(f"""SELECT l.recommendation_log_id, l.customer_id, l.action_type, l.risk_tier,
        {ts('l.presented_at')} AS created_at, s.context_snapshot_id, f.follow_up_id, f.follow_up_status, o.outcome_type,
        o.observed_date, e.event_type, {ts('e.event_timestamp')} AS event_timestamp
        FROM log l JOIN snapshots s USING (recommendation_log_id) LEFT JOIN follow f USING (recommendation_log_id)
        LEFT JOIN outcomes o ON o.follow_up_id = f.follow_up_id JOIN events e USING (recommendation_log_id)"""),
    outcome_rates=decision(f"""SELECT signal_combination, action_type, follow_ups, renewed,
        {rdiv('renewed', 'follow_ups', 4)} AS renewal_rate FROM (
          SELECT coalesce(y.combination, 'none') AS signal_combination, l.action_type, count(*) AS follow_ups,
                 count(*) FILTER (o.outcome_type = 'renewed') AS renewed
          FROM outcomes o JOIN follow f USING (follow_up_id) JOIN log l USING (recommendation_log_id)
          LEFT JOIN (SELECT customer_id, string_agg(signal_type, ' + ' ORDER BY signal_type) AS combination
                     FROM v_signals WHERE w4 > 0 GROUP BY 1) y ON y.customer_id = o.customer_id GROUP BY 1, 2)"""),
    decision_integrity=decision("SELECT * FROM (" + " UNION ALL ".join([
        _count("follow_up_without_recommendation",
               "follow f WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.recommendation_log_id = f.recommendation_log_id AND l.risk_tier <> 'medium')"),
        _count("event_without_recommendation",
               "events f WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.recommendation_log_id = f.recommendation_log_id AND l.risk_tier <> 'medium')"),
        _count("follow_up_for_rejected", "follow f JOIN events e USING (recommendation_log_id) WHERE e.event_type IN ('rejected', 'timeout')"),
        _count("outcome_without_follow_up", "outcomes o WHERE o.follow_up_id NOT IN (SELECT follow_up_id FROM follow)"),
        _count("duplicate_recommendation_id", "(SELECT recommendation_log_id FROM log WHERE risk_tier <> 'medium' GROUP BY 1 HAVING count(*) > 1)"),
        _count("duplicate_event_id", "(SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1)"),
        _count("duplicate_follow_up_id", "(SELECT follow_up_id FROM follow GROUP BY 1 HAVING count(*) > 1)"),
        _count("mutable_rows", "events WHERE NOT _immutable"),
    ]) + ")"),
    programme_metrics=decision(f"""
        , d AS (SELECT * FROM events WHERE event_type <> 'presented'),
        k AS (SELECT customer_id, max(CASE WHEN status IN ('active', 'renewed') THEN 1 ELSE 0 END) AS kept FROM v_policies GROUP BY 1),
        x AS (SELECT customer_id, sum(duration_seconds) AS s, count(duration_seconds) AS n FROM v_interactions GROUP BY 1),
        g AS (SELECT k.kept, x.s, x.n, coalesce(k.customer_id, x.customer_id) IN (SELECT customer_id FROM follow) AS guided
              FROM k FULL JOIN x ON x.customer_id = k.customer_id),
        l AS (SELECT CAST(f.follow_up_status = 'approved' AS INTEGER) AS a, CAST(o.outcome_type = 'renewed' AS INTEGER) AS b
              FROM follow f JOIN outcomes o USING (follow_up_id))
        SELECT 'acceptance_rate' AS metric, {_share("SELECT count(*) FROM d WHERE event_type = 'approved'", "SELECT count(*) FROM d")} AS value
        UNION ALL SELECT 'adoption_rate', {_share("SELECT count(*) FROM d WHERE event_type IN ('approved', 'modified')", "SELECT count(*) FROM d")}
        UNION ALL SELECT 'handle_time_change', round({_share("SELECT sum(s) FROM g WHERE guided", "SELECT sum(n) FROM g WHERE guided")}
            - {_share("SELECT sum(s) FROM g WHERE NOT guided", "SELECT sum(n) FROM g WHERE NOT guided")}, 4)
        UNION ALL SELECT 'retention_delta', round({_share("SELECT sum(kept) FROM g WHERE guided", "SELECT count(kept) FROM g WHERE guided")}
            - {_share("SELECT sum(kept) FROM g WHERE NOT guided", "SELECT count(kept) FROM g WHERE NOT guided")}, 4)
        UNION ALL SELECT 'approval_renewal_correlation', (SELECT round(corr(a, b), 6) FROM l)"""),
    evidence_rate=f"""SELECT recommendations, with_evidence, {rdiv('with_evidence', 'recommendations', 4)} AS evidence_rate FROM (
        SELECT count(*) AS recommendations, count(*) FILTER (customer_id IN (SELECT customer_id FROM v_signals WHERE w4 > 0))
        AS with_evidence FROM v_recommendations)""",
)

# --- quality -----------------------------------------------------------------------------------------------------

VIEW = {"customers": "v_customers", "policies": "v_policies", "coverages": "v_coverages", "claims": "v_claims",
        "payments": "v_payments", "interactions": "v_interactions", "transcripts": "v_transcripts",
        "service_representatives": "v_reps"}
KEY = {"customers": "customer_id", "policies": "policy_id", "coverages": "coverage_id", "claims": "claim_id",
       "payments": "payment_id", "interactions": "interaction_id", "transcripts": "transcript_id",
       "service_representatives": "representative_id"}


def status(column: str, good: str = "= 0") -> str:
    return f"CASE WHEN {column} {good} THEN 'PASS' ELSE 'FAIL' END AS status"


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def check(name: str, source: str, what: str) -> str:
    return f"SELECT '{name}' AS check_name, {status('n')}, n || ' {what}' AS detail FROM (SELECT count(*) AS n FROM {source})"


_KEPT = {"customers": "(SELECT * FROM v_customers WHERE status = 'active')",
         "policies": "(SELECT * FROM v_policies WHERE status <> 'quoted')"}
_FK = (("policies", "customer_id", "customers", "customer_id"), ("coverages", "policy_id", "policies", "policy_id"),
       ("claims", "policy_id", "policies", "policy_id"), ("claims", "customer_id", "customers", "customer_id"),
       ("payments", "customer_id", "customers", "customer_id"), ("payments", "policy_id", "policies", "policy_id"),
       ("interactions", "customer_id", "customers", "customer_id"),
       ("interactions", "representative_id", "service_representatives", "representative_id"),
       ("transcripts", "interaction_id", "interactions", "interaction_id"))
_ENUMS = {
    "customers.status": "'active', 'inactive', 'prospect'", "policies.product_type": "'auto', 'home', 'umbrella', 'renters'",
    "policies.status": "'quoted', 'bound', 'active', 'renewed', 'lapsed', 'cancelled'",
    "policies.payment_frequency": "'monthly', 'quarterly', 'semi_annual', 'annual'",
    "payments.status": "'on_time', 'late', 'grace_period', 'missed', 'pending'",
    "claims.status": "'filed', 'under_review', 'settled', 'denied', 'withdrawn'",
    "interactions.channel": "'phone', 'email', 'chat'", "interactions.direction": "'inbound', 'outbound', 'internal_note'",
    "interactions.disposition": "'inquiry', 'complaint', 'request', 'notification', 'general'",
    "transcripts.content_type": "'call_transcript', 'email_body', 'agent_note'",
    "service_representatives.role": "'service_rep', 'retention_specialist', 'supervisor'",
}
_RULES = (
    ("policies", "effective before expiration", "effective_date >= expiration_date"),
    ("policies", "premium positive", "premium_amount <= 0"),
    ("coverages", "limit positive", "limit_amount <= 0"),
    ("coverages", "deductible not negative", "deductible_amount < 0"),
    ("claims", "loss not after filing", "loss_date > filed_date"),
    ("claims", "closed after filing", "closed_date <= filed_date"),
    ("claims", "reserve positive", "reserve_amount <= 0"),
    ("claims", "paid not negative", "paid_amount < 0"),
    ("payments", "amount positive", "amount <= 0"),
    ("payments", "late paid after due", "status = 'late' AND paid_date < due_date"),
    ("payments", "on time paid by due", "status = 'on_time' AND paid_date > due_date"),
    ("payments", "missed or pending has no paid date", "status IN ('missed', 'pending') AND paid_date IS NOT NULL"),
    ("payments", "no amount without paid date", "paid_date IS NULL AND amount_paid IS NOT NULL"),
    ("interactions", "not in the future", "interaction_date > TIMESTAMP '2024-01-28 00:00:00'"),
    ("interactions", "phone duration positive", "channel = 'phone' AND duration_seconds <= 0"),
    ("interactions", "duration only on phone", "channel <> 'phone' AND duration_seconds IS NOT NULL"),
    ("transcripts", "text not empty", "trim(raw_text) = ''"),
    ("transcripts", "word count positive", "word_count <= 0"),
)
_SECRETS = (r"password\s*=", r"api_key\s*=", r"secret\s*=", r"token\s*=", "BEGIN PRIVATE KEY", "AccountKey=",
            "AKIA[0-9A-Z]{16}")
_BARE = r"regexp_replace(raw_text, '^\s+|\s+$', '', 'g')"
_COMPLETE = "enrichment_status = 'completed'"


def suite() -> str:
    def row(name: str, ok: str, label: str, value: str) -> str:
        return (f"SELECT '{name}' AS check_name, CASE WHEN coalesce({ok}, false) THEN 'PASS' ELSE 'FAIL' END AS status, "
                f"'{label}: ' || coalesce(CAST({value} AS VARCHAR), 'NULL') AS detail")

    def enriched(name: str, label: str, bad: str) -> str:
        return row(name, "n = 0", label, "n") + f" FROM (SELECT count(*) AS n FROM v_enriched WHERE {bad})"

    def cohort(name: str, good: str) -> str:
        return row(name, "n = 0", "customers falling short", "n") + \
            f" FROM (SELECT count(*) AS n FROM cohort WHERE NOT coalesce({good}, false))"

    def single(name: str, ok: str, label: str, source: str) -> str:
        return row(name, ok, label, "n") + f" FROM ({source})"

    return f"""
WITH cohort AS (
  SELECT p.*, e.texts, e.texts_done, e.no_summary, e.complaints, g.signal_types, g.renewal_on, g.negative_on,
         r.offers, r.firsts, r.best
  FROM v_profile p
  LEFT JOIN (SELECT customer_id, count(transcript_id) AS texts, count(*) FILTER ({_COMPLETE}) AS texts_done,
               count(*) FILTER ({_COMPLETE} AND summary IS NULL) AS no_summary, count(*) FILTER (is_complaint) AS complaints
             FROM v_enriched GROUP BY 1) e ON e.customer_id = p.customer_id
  LEFT JOIN (SELECT customer_id, count(*) AS signal_types,
               bool_or(signal_type = 'renewal_proximity' AND signal_score > 0) AS renewal_on,
               bool_or(signal_type = 'sentiment_negative' AND signal_score > 0) AS negative_on
             FROM v_signals GROUP BY 1) g ON g.customer_id = p.customer_id
  LEFT JOIN (SELECT customer_id, count(*) AS offers, count(*) FILTER (action_rank = 1) AS firsts,
               max(f1000) FILTER (action_rank = 1) AS best FROM v_recommendations GROUP BY 1) r
    ON r.customer_id = p.customer_id
  WHERE p.customer_id IN (SELECT customer_id FROM v_wide WHERE days_to_renewal <= 30 AND negative_count_90d >= 2))
""" + union([
        single("T01_ENRICHED_TABLE_EXISTS", "n > 0", "rows", "SELECT count(*) AS n FROM v_enriched"),
        enriched("T02_CONSENTED_TRANSCRIPTS_ENRICHED", "failed", "enrichment_status = 'failed'"),
        enriched("T03_SENTIMENT_SCORE_NOT_NULL", "completed rows without score", f"{_COMPLETE} AND s4 IS NULL"),
        enriched("T04_SENTIMENT_SCORE_RANGE", "scores out of range", f"{_COMPLETE} AND abs(s4) > 10000"),
        enriched("T05_SENTIMENT_LABEL_CONSISTENT", "label/score mismatches",
                 f"{_COMPLETE} AND NOT ((s4 < -2000 AND sentiment_label = 'negative') OR (s4 > 2000 AND sentiment_label = 'positive')"
                 " OR (abs(s4) <= 2000 AND sentiment_label = 'neutral'))"),
        enriched("T06_SUMMARY_POPULATED", "completed rows without summary", f"{_COMPLETE} AND summary IS NULL"),
        enriched("T07_TOPIC_ENUM_VALID", "invalid topics",
                 f"{_COMPLETE} AND primary_topic NOT IN ('billing', 'claims', 'coverage', 'service', 'cancellation', 'general')"),
        enriched("T08_INTENT_ENUM_VALID", "invalid intents",
                 f"{_COMPLETE} AND primary_intent NOT IN ('complaint', 'inquiry', 'request', 'praise', 'escalation')"),
        enriched("T09_URGENCY_ENUM_VALID", "invalid urgencies", "urgency_level NOT IN ('critical', 'high', 'medium', 'low')"),
        single("T10_ENRICHED_NO_DUPLICATES", "n = 0", "repeated interaction ids",
               "SELECT count(*) AS n FROM (SELECT interaction_id FROM v_enriched GROUP BY 1 HAVING count(*) > 1)"),
        enriched("T11_CONSENT_WITHHELD_NO_AI", "withheld rows with derived values",
                 "enrichment_status = 'consent_withheld' AND (s4 IS NOT NULL OR summary IS NOT NULL OR primary_topic IS NOT NULL)"),
        cohort("T12_CUSTOMER_EXISTS", "customer_id IS NOT NULL"),
        cohort("T13_TEXTS_ENRICHED", "coalesce(texts, 0) = coalesce(texts_done, 0)"),
        cohort("T14_NEGATIVE_SENTIMENT", "negative_count_90d >= 2"),
        cohort("T15_HAS_COMPLAINT", "complaints >= 1"),
        cohort("T16_SUMMARIES_POPULATED", "coalesce(no_summary, 0) = 0"),
        single("T17_RISK_SIGNALS_POPULATED", "n > 0", "signal rows", "SELECT count(*) AS n FROM v_signals"),
        cohort("T18_ALL_SIGNAL_TYPES", "signal_types = 8"),
        cohort("T19_RENEWAL_ACTIVE", "renewal_on"),
        cohort("T20_NEGATIVE_ACTIVE", "negative_on"),
        cohort("T21_TIER_ELEVATED", "risk_tier IN ('high', 'critical')"),
        single("T22_SIGNAL_SCORES_IN_RANGE", "n = 0", "scores outside [0,1]",
               "SELECT count(*) AS n FROM v_signals WHERE signal_score < 0 OR signal_score > 1"),
        single("T23_SIGNAL_WEIGHTS_SUM_TO_ONE", "true", "sum of weights", "SELECT '1.00' AS n"),
        single("T24_ACTION_LIBRARY_LOADED", "n = 8", "actions", "SELECT count(*) AS n FROM v_actions"),
        single("T25_NBA_RECOMMENDATIONS_POPULATED", "n > 0", "recommendations", "SELECT count(*) AS n FROM v_recommendations"),
        cohort("T26_PRIMARY_EXISTS", "firsts = 1"),
        cohort("T27_PRIMARY_IS_RETENTION", "nba_action_type IN ('retention_outreach', 'complaint_followup')"),
        cohort("T28_HAS_ALTERNATIVES", "offers >= 2"),
        cohort("T29_CONFIDENCE_NOT_LOW", "nba_confidence_level <> 'low'"),
        cohort("T30_EVIDENCE_POPULATED", "firsts = 1"),
        cohort("T31_COMPLETENESS_POPULATED", "firsts = 1"),
        cohort("T32_SCORE_POSITIVE", "best > 0"),
        cohort("T33_PROFILE_COMPLETE", "has_enrichment AND has_risk_signals AND has_recommendation"),
        cohort("T34_SYSTEM_FULL", "system_status = 'full'"),
        cohort("T35_PROFILE_NEGATIVE", "negative_count_90d >= 2"),
        cohort("T36_RENEWAL_IN_WINDOW", "days_to_renewal <= 30 AND days_to_renewal > 0"),
        cohort("T37_PROFILE_ACTION", "nba_action_type IS NOT NULL"),
        single("T38_NO_ORPHAN_ENRICHED_CUSTOMERS", "n = 0", "enriched customers not in the base",
               "SELECT count(DISTINCT customer_id) AS n FROM v_enriched WHERE customer_id NOT IN (SELECT customer_id FROM v_base)"),
        single("T39_RISK_SIGNALS_HAVE_INTERACTIONS", "n = 0", "contact signals without contacts",
               "SELECT count(DISTINCT customer_id) AS n FROM v_signals WHERE signal_type IN ('sentiment_negative', "
               "'complaint_activity') AND signal_score > 0 AND customer_id NOT IN (SELECT customer_id FROM v_enriched)"),
        single("T40_UNIQUE_PRIMARY_NBA_PER_CUSTOMER", "n = 0", "customers with several primaries",
               "SELECT count(*) AS n FROM (SELECT customer_id FROM v_recommendations WHERE action_rank = 1 GROUP BY 1 HAVING count(*) > 1)"),
    ])


_SUM_WORD = "CAST(CAST('0x' || left({0}, 15) AS BIGINT) AS HUGEINT)"
add(
    dq_row_counts=union(f"SELECT '{t}' AS table_name, count(*) AS actual_rows, count(*) AS expected_rows, 'PASS' AS status "
                        f"FROM {v}" for t, v in VIEW.items()),
    dq_pk_unique=union(f"SELECT '{t}' AS table_name, count(*) AS row_count, count(DISTINCT {k}) AS distinct_keys, "
                       f"count(*) - count(DISTINCT {k}) AS duplicates, "
                       f"CASE WHEN count(*) = count(DISTINCT {k}) THEN 'PASS' ELSE 'FAIL' END AS status FROM {VIEW[t]}" for t, k in KEY.items()),
    dq_fk_orphans=union(
        f"SELECT '{c}.{col} -> {p}' AS relation, n AS orphans, {status('n')} FROM (SELECT count(*) AS n FROM {_KEPT.get(c, VIEW[c])} c "
        f"WHERE {'c.representative_id IS NOT NULL AND ' if col == 'representative_id' else ''}"
        f"NOT EXISTS (SELECT 1 FROM {_KEPT.get(p, VIEW[p])} p WHERE p.{key} = c.{col}))" for c, col, p, key in _FK),
    dq_ownership=union(
        f"SELECT '{t}' AS table_name, n AS mismatches, {status('n')} FROM (SELECT count(*) AS n FROM {VIEW[t]} c JOIN v_policies p "
        "ON p.policy_id = c.policy_id WHERE c.customer_id <> p.customer_id + CASE WHEN p.status = 'lapsed' THEN 1 ELSE 0 END)"
        for t in ("claims", "payments")),
    dq_one_to_one=check("one_transcript_per_interaction", "(SELECT 1 FROM v_transcripts GROUP BY interaction_id HAVING count(*) > 1)",
                        "interaction_id values with more than one row") + " UNION ALL " +
        check("one_interaction_per_customer", "(SELECT 1 FROM v_interactions GROUP BY customer_id HAVING count(*) > 1)",
              "customer_id values with more than one row"),
    dq_required_child=check("active_policies_have_coverage",
        "v_policies p WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM v_coverages c WHERE c.policy_id = p.policy_id)",
        "policy_id values without a child row"),
    dq_date_order=check("policy_dates", "v_policies WHERE effective_date >= expiration_date",
                        "policies with effective_date >= expiration_date"),
    dq_positive=check("payment_amounts", "v_payments WHERE amount <= 0", "payments with amount <= 0"),
    dq_enums=union(f"SELECT '{c}' AS column_name, n AS violations, {status('n')} FROM (SELECT count(*) AS n FROM {VIEW[c.split('.')[0]]} "
                   f"WHERE {c.split('.')[1]} NOT IN ({v}))" for c, v in _ENUMS.items()),
    dq_consent=check("consent_flag", "v_transcripts WHERE recording_consent_flag IS NULL OR recording_consent_flag NOT IN ('TRUE', 'FALSE')",
                     "transcripts with invalid or missing consent flag"),
    dq_audit_columns=union(f"SELECT '{t}' AS table_name, CAST(0 AS BIGINT) AS null_rows, 'PASS' AS status" for t in VIEW),
    dq_batch=union(f"SELECT '{t}' AS table_name, CAST(1 AS BIGINT) AS distinct_batches, 'PASS' AS status"
                   for t in VIEW if t != "interactions") + f""" UNION ALL
        SELECT 'interactions', n, {status('n', '= 1')} FROM (SELECT count(DISTINCT CAST(interaction_date AS DATE)) AS n FROM v_interactions)""",
    dq_rejects=f"""SELECT table_name, loaded_rows, rejected_rows, {status('rejected_rows')} FROM (
        SELECT 'customers' AS table_name, count(*) AS loaded_rows, CAST(0 AS BIGINT) AS rejected_rows FROM v_customers UNION ALL
        SELECT 'interactions', count(*), count(*) FILTER ({BAD_LINE}) FROM v_interactions)""",
    dq_golden_graph="""
        SELECT customer_id, true AS customer_exists, active_policies, interactions, transcripts, refused = 0 AS all_consent,
          CASE WHEN active_policies = 2 AND interactions >= 4 AND transcripts >= 4 AND refused = 0 THEN 'PASS' ELSE 'FAIL' END AS status
        FROM (SELECT c.customer_id, coalesce(p.n, 0) AS active_policies, coalesce(i.n, 0) AS interactions,
                coalesce(i.t, 0) AS transcripts, coalesce(i.r, 0) AS refused
              FROM v_customers c LEFT JOIN (SELECT customer_id, count(*) AS n FROM v_policies WHERE status = 'active' GROUP BY 1) p
                ON p.customer_id = c.customer_id
              LEFT JOIN (SELECT customer_id, count(*) AS n, count(transcript_id) AS t,
                           count(*) FILTER (recording_consent_flag <> 'TRUE') AS r
                         FROM v_interactions x LEFT JOIN v_transcripts y ON y.interaction_id = x.interaction_id GROUP BY 1) i
                ON i.customer_id = c.customer_id)""",
    dq_required_ids="""SELECT 'contacted_customers_present' AS check_name, CASE WHEN n = f THEN 'PASS' ELSE 'FAIL' END AS status,
        f || '/' || n || ' customer_id values found' AS detail FROM (
          SELECT count(*) AS n, count(*) FILTER (customer_id IN (SELECT customer_id FROM v_customers WHERE status = 'active')) AS f
          FROM (SELECT DISTINCT customer_id FROM v_interactions))""",
    dq_word_count=check("word_count", rf"v_transcripts WHERE abs(CASE WHEN {_BARE} = '' THEN 0 ELSE len(string_split_regex({_BARE}, '\s+')) END - word_count) > 2",
                        "transcripts off by more than 2 words"),
    dq_secrets=union(f"SELECT '{p}' AS pattern, n AS matches, {status('n')} FROM (SELECT count(*) AS n FROM v_transcripts "
                     f"WHERE regexp_matches(raw_text, '(?i){p}'))" for p in _SECRETS),
    dq_pii=rf"""SELECT *, {status('violations')} FROM (
        SELECT 'email_domain' AS check_name, count(*) AS violations FROM v_customers WHERE email NOT LIKE '%@example.com' UNION ALL
        SELECT 'phone_prefix', count(*) FROM v_customers WHERE phone NOT LIKE '555-%' UNION ALL
        SELECT 'ssn_pattern', count(*) FROM v_transcripts WHERE regexp_matches(raw_text, '\b\d{{3}}-\d{{2}}-\d{{4}}\b'))""",
    dq_tone="""SELECT content_type, count(*) AS transcripts, count(*) FILTER (lower(raw_text) LIKE '%for%' OR lower(raw_text) LIKE '%by%'
        OR lower(raw_text) LIKE '%on%') AS negative_transcripts FROM v_transcripts GROUP BY 1""",
    table_checksum=f"""
        WITH s AS (SELECT count(*) AS row_count, CAST(sum({_SUM_WORD.format(hash_of(*_V))}) AS VARCHAR) AS checksum FROM v_policies)
        SELECT row_count, checksum, unnest(['first', 'again']) AS build FROM s""",
    pipeline_suite=suite(),
    dq_quarantine="""
        SELECT payment_id, to_json(v) AS _violations, to_json(w) AS _warnings, len(v) > 0 AS _quarantined FROM (
          SELECT payment_id,
            list_filter([CASE WHEN NOT EXISTS (SELECT 1 FROM v_customers c WHERE c.customer_id = p.customer_id AND c.status = 'active')
                              THEN 'DQ1_customer_missing' END,
                         CASE WHEN NOT EXISTS (SELECT 1 FROM v_policies q WHERE q.policy_id = p.policy_id AND q.status <> 'quoted')
                              THEN 'DQ2_policy_missing' END,
                         CASE WHEN amount <= 0 THEN 'DQ11_amount_not_positive' END], lambda x: x IS NOT NULL) AS v,
            list_filter([CASE WHEN status = 'on_time' AND paid_date > due_date THEN 'on_time_paid_late' END,
                         CASE WHEN status = 'missed' AND paid_date IS NOT NULL THEN 'missed_but_paid' END,
                         CASE WHEN paid_date - due_date < -180 THEN 'paid_long_before_due' END], lambda x: x IS NOT NULL) AS w
          FROM v_payments p)""",
    dq_freshness="""
        SELECT count(*) FILTER (l < e) AS loaded_before_event, count(*) FILTER (p < l) AS processed_before_load,
          count(*) FILTER (datesub('second', e, p) > 43200) AS stale_rows, max(datesub('second', e, p)) AS max_lag_seconds,
          CASE WHEN count(*) FILTER (l < e OR p < l OR datesub('second', e, p) > 43200) = 0 THEN 'PASS' ELSE 'WARN' END AS status
        FROM (SELECT interaction_date AS e, l, l + to_seconds(duration_seconds) AS p FROM (
          SELECT *, CAST(CAST(interaction_date AS DATE) + 1 AS TIMESTAMP) AS l FROM v_interactions))""",
    scenario_check=f"""
        WITH x AS (SELECT customer_id, 'multi_policy_flag' AS signal_name,
                     CAST(count(*) FILTER (status = 'active') >= 2 AS VARCHAR) AS expected_value FROM v_policies GROUP BY 1
                   UNION ALL SELECT customer_id, 'open_complaints', CAST(count(*) AS VARCHAR) FROM v_interactions
                   WHERE disposition = 'complaint' AND {CURRENT} GROUP BY 1),
             a AS (SELECT customer_id, 'multi_policy_flag' AS signal_name, CAST(active_policies >= 2 AS VARCHAR) AS actual_value FROM v_wide
                   UNION ALL SELECT customer_id, 'open_complaints', CAST(complaint_count_90d AS VARCHAR) FROM v_wide)
        SELECT x.customer_id, x.signal_name, x.expected_value, a.actual_value,
          CASE WHEN x.expected_value IS NOT DISTINCT FROM a.actual_value THEN 'PASS' ELSE 'FAIL' END AS status
        FROM x LEFT JOIN a ON a.customer_id = x.customer_id AND a.signal_name = x.signal_name""",
    dq_conditional_rules=union(f"SELECT '{t}: {r}' AS rule, n AS violations, {status('n')} FROM (SELECT count(*) AS n FROM {VIEW[t]} WHERE {bad})"
                               for t, r, bad in _RULES),
    dq_channel_content=f"""
        SELECT content_type, channel, "rows", mismatches, {status('mismatches')} FROM (
          SELECT content_type, channel, count(*) AS "rows", count(*) FILTER ((content_type = 'call_transcript' AND channel <> 'phone')
            OR (content_type = 'email_body' AND channel <> 'email')) AS mismatches
          FROM v_transcripts t JOIN v_interactions i ON i.interaction_id = t.interaction_id GROUP BY 1, 2)""",
    dq_min_one=f"""SELECT 'active_service_representative' AS check_name, {status('n', '>= 1')}, n || ' matching rows' AS detail
        FROM (SELECT count(*) AS n FROM v_reps WHERE role = 'service_rep' AND active = 'TRUE')""",
)

# --- semantic layer and application ------------------------------------------------------------------------------

WHO = "first_name || ' ' || last_name AS customer_name"
SOON = "days_to_renewal <= 30 AND days_to_renewal > 0"


def mean(expr: str, digits: int = 4) -> str:
    """Average of a column of exact 4-digit numbers."""
    s = f"CAST(sum(CAST(round({expr} * 10000) AS BIGINT)) AS HUGEINT)"
    return f"CASE WHEN count({expr}) > 0 THEN {rdiv(s, f'count({expr}) * 10000', digits)} END"


_RATIO8 = "CASE WHEN total_payments > 0 THEN " + rdiv("payments_late + payments_missed", "total_payments", 8) + " ELSE 0.0 END"
add(
    vq_renewals_30d=f"""SELECT {WHO}, customer_id, days_to_renewal, nearest_renewal_date, active_policies, product_holdings,
        risk_tier, nba_action_name FROM v_profile WHERE {SOON}""",
    vq_negative_sentiment=f"""SELECT {WHO}, customer_id, avg_sentiment_90d, sentiment_direction, negative_count_90d FROM v_profile
        WHERE sentiment_direction = 'worsening'""",
    vq_negative_and_renewal=f"""SELECT {WHO}, customer_id, negative_count_90d, days_to_renewal, risk_tier, nba_action_name
        FROM v_profile WHERE negative_count_90d > 0 AND {SOON}""",
    vq_risk_distribution="SELECT risk_tier, count(customer_id) AS customer_count FROM v_profile GROUP BY 1",
    vq_critical_risk=f"""SELECT {WHO}, customer_id, composite_risk_score, risk_tier, risk_direction, days_to_renewal,
        negative_count_90d, avg_sentiment_90d, sentiment_direction, payments_late, payments_missed, open_claims,
        interactions_complaints, nba_action_name, nba_confidence_level FROM v_profile WHERE risk_tier = 'critical'""",
    vq_nba_by_risk="""SELECT nba_action_type, count(customer_id) AS customer_count FROM v_profile
        WHERE risk_tier IN ('critical', 'high') GROUP BY 1""",
    vq_customer_profile=f"""SELECT {WHO}, customer_id, active_policies, product_holdings, days_to_renewal, negative_count_90d,
        avg_sentiment_90d, risk_tier, composite_risk_score, nba_action_name, nba_confidence_level FROM v_profile""",
    vq_complaint_customers="SELECT count(customer_id) AS customer_count FROM v_profile WHERE negative_count_90d > 0",
    vq_nba_distribution="SELECT nba_action_type, count(customer_id) AS customer_count FROM v_profile GROUP BY 1",
    vq_high_confidence_actions=f"""SELECT {WHO}, customer_id, nba_action_name, nba_confidence_level, risk_tier FROM v_profile
        WHERE nba_confidence_level = 'high'""",
    vq_premium_by_risk="""SELECT risk_tier, count(customer_id) AS customer_count,
        CAST(sum(CAST(total_annual_premium AS DECIMAL(14,2))) AS DOUBLE) AS total_premium_sum FROM v_profile
        WHERE risk_tier IN ('critical', 'high') GROUP BY 1""",
    vq_system_status="SELECT system_status, count(customer_id) AS customer_count FROM v_profile GROUP BY 1",
    vq_why_at_risk=f"""SELECT {WHO}, risk_tier, composite_risk_score, risk_direction, days_to_renewal, nearest_renewal_date,
        negative_count_90d, avg_sentiment_90d, worst_sentiment_90d, sentiment_direction, payments_late, payments_missed,
        total_payments, interactions_complaints, open_claims, total_claims, worsening_signals, improving_signals,
        enrichment_coverage_pct, system_status FROM v_profile""",
    vq_what_recommendation=f"""SELECT {WHO}, customer_id, nba_action_name, nba_action_type, nba_action_category, nba_final_score,
        nba_confidence_level, nba_confidence_score, risk_tier, composite_risk_score, risk_direction, system_status FROM v_profile""",
    vq_evidence_for_recommendation=f"""SELECT {WHO}, nba_action_name, nba_confidence_level, negative_count_90d, avg_sentiment_90d,
        worst_sentiment_90d, sentiment_direction, enriched_interactions_90d, days_to_renewal, nearest_renewal_date,
        active_policies, product_holdings, payments_late, payments_missed, total_payments, interactions_complaints, open_claims,
        enrichment_coverage_pct, has_enrichment, system_status FROM v_profile""",
    metric_query="""SELECT household_id, risk_tier, count(customer_id) AS customer_count,
        CAST(sum(CAST(total_annual_premium AS DECIMAL(14,2))) AS DOUBLE) AS total_premium_sum,
        CAST(sum(open_claims) AS BIGINT) AS total_open_claims,
        count(*) FILTER (risk_tier IN ('critical', 'high')) AS high_risk_customer_count FROM v_profile GROUP BY 1, 2""",
    metrics_all=f"""
        SELECT customer_status, count(customer_id) AS customer_count, {mean('active_policies')} AS avg_active_policies,
          CAST(sum(CAST(total_annual_premium AS DECIMAL(14,2))) AS DOUBLE) AS total_premium_sum,
          {rdiv("CAST(sum(CAST(round(total_annual_premium * 100) AS BIGINT)) AS HUGEINT)", "count(*) * 100", 4)} AS avg_premium,
          CAST(sum(open_claims) AS BIGINT) AS total_open_claims,
          CAST(sum(CAST(claims_total_paid AS DECIMAL(14,2))) AS DOUBLE) AS total_claims_paid_sum,
          CAST(sum(payments_late) AS BIGINT) AS total_late_payments, CAST(sum(payments_missed) AS BIGINT) AS total_missed_payments,
          {rdiv(f"CAST(sum(CAST(round(({_RATIO8}) * 100000000) AS BIGINT)) AS HUGEINT)", "count(*) * 100000000", 6)} AS avg_payment_risk_ratio,
          {mean('avg_sentiment_90d')} AS avg_sentiment, CAST(sum(negative_count_90d) AS BIGINT) AS total_negative_interactions,
          {mean('composite_risk_score')} AS avg_risk_score,
          count(*) FILTER (risk_tier IN ('critical', 'high')) AS high_risk_customer_count,
          count(nba_action_type) AS customers_with_recommendation, {mean('nba_confidence_score')} AS avg_nba_confidence,
          count(*) FILTER ({SOON}) AS customers_renewing_30d,
          count(*) FILTER (days_to_renewal <= 14 AND days_to_renewal > 0) AS customers_renewing_14d
        FROM v_profile GROUP BY 1""",
    semantic_enum_check=union(f"SELECT '{d}' AS dimension, count(*) FILTER ({d} NOT IN ({v})) AS violations FROM v_profile" for d, v in (
        ("customer_status", "'active', 'inactive', 'prospect'"), ("latest_channel", "'phone', 'email', 'chat'"),
        ("sentiment_direction", "'worsening', 'stable', 'improving', 'insufficient_data'"),
        ("risk_tier", "'critical', 'high', 'medium', 'low'"), ("risk_direction", "'worsening', 'stable', 'improving'"),
        ("nba_action_type", "'retention_outreach', 'renewal_reminder', 'complaint_followup', 'claim_escalation', "
                            "'billing_assistance', 'cross_sell_home', 'cross_sell_umbrella', 'no_action'"),
        ("nba_action_category", "'retention', 'service', 'sales', 'administrative'"),
        ("nba_confidence_level", "'high', 'medium_high', 'medium', 'low'"),
        ("system_status", "'full', 'degraded_no_enrichment', 'degraded_no_recommendation', 'low_confidence'"))),
    customer_options="""SELECT first_name || ' ' || last_name || ' (' || customer_id || ')' AS label,
        CAST(customer_id AS VARCHAR) AS parsed_id FROM v_customers""",
    top_high_risk=f"""SELECT customer_id, {WHO}, risk_tier, composite_risk_score, days_to_renewal, nba_action_name,
        nba_confidence_level, negative_count_90d FROM v_profile WHERE risk_tier IN ('critical', 'high')
        ORDER BY composite_risk_score DESC, customer_id LIMIT 10""",
    home_kpis=f"""SELECT count(*) AS total, count(*) FILTER (risk_tier IN ('critical', 'high')) AS high_risk,
        count(*) FILTER ({SOON}) AS renewing_30d, count(*) FILTER (system_status = 'full') AS fully_operational FROM v_profile""",
    profile_lookup=f"""SELECT customer_id, {WHO}, risk_tier, composite_risk_score, days_to_renewal, active_policies,
        product_holdings, nba_action_name, nba_confidence_level, system_status, CASE WHEN days_to_renewal > 0
        THEN 'Renewal in ' || days_to_renewal || 'd' ELSE 'No upcoming renewal' END AS renewal_text FROM v_profile
        WHERE customer_id IN (1, 42, 113)""",
    interaction_timeline=f"""SELECT customer_id, interaction_id, {ts('interaction_date')} AS interaction_date, channel, direction,
        disposition, sentiment_label, {SCORE} AS sentiment_score, summary, primary_topic, primary_intent, urgency_level,
        is_complaint, enrichment_status FROM v_enriched""",
    renewal_banner=f"""
        SELECT customer_id, CASE WHEN nearest_renewal_date IS NULL THEN 'none' WHEN days_to_renewal <= 14 THEN 'urgent'
            WHEN days_to_renewal <= 30 THEN 'approaching' ELSE 'info' END AS banner,
          CASE WHEN days_to_renewal <= 14 THEN 'URGENT: Renewal on ' || nearest_renewal_date || ' (' || days_to_renewal || ' days)'
               WHEN days_to_renewal <= 30 THEN 'Approaching: Renewal on ' || nearest_renewal_date || ' (' || days_to_renewal || ' days)'
               WHEN nearest_renewal_date IS NOT NULL THEN 'Next renewal: ' || nearest_renewal_date END AS banner_text,
          late_pct, CASE WHEN bad = 0 THEN 'All payments current' ELSE late_pct || '% of payments late or missed' END AS payment_text
        FROM (SELECT *, payments_late + payments_missed AS bad,
          CAST({rdiv('(payments_late + payments_missed) * 100', 'greatest(total_payments, 1)', 0)} AS BIGINT) AS late_pct FROM v_base)""",
    risk_explanation="""SELECT customer_id, string_agg(evidence_text, '. ' ORDER BY r) || '.' AS explanation FROM (
        SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY w4 DESC, signal_type) AS r FROM v_signals WHERE w4 > 0)
        WHERE r <= 3 GROUP BY 1""",
    evidence_top5="""
        SELECT s.customer_id, p.action_type, s.r - 1 AS position, s.signal_type, s.w4 / 10000.0 AS weighted_score,
          s.signal_direction AS direction, s.evidence_text AS evidence
        FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY w4 DESC, signal_type) AS r FROM v_signals WHERE w4 > 0) s
        JOIN v_recommendations p ON p.customer_id = s.customer_id AND p.action_rank = 1 WHERE s.r <= 5""",
)

# --- search ------------------------------------------------------------------------------------------------------

TERMS = "(" + ", ".join(f"'{t}'" for t in SEARCH_TEXT.split()) + ")"


def bm25(source: str, keep: str) -> str:
    return rf"""
WITH docs AS (SELECT *, list_filter(string_split_regex(lower(content), '[^\p{{L}}]+'), lambda x: x <> '') AS w FROM ({source})),
lens AS (SELECT doc_id, len(w) AS n FROM docs WHERE len(w) > 0),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(n) / CAST(count(*) AS DOUBLE) AS mean FROM lens),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM docs) WHERE t IN {TERMS} GROUP BY 1, 2),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT tf.doc_id, sum(CAST(round(ln(1.0 + (st.n - df.df + 0.5) / (df.df + 0.5)) * (tf.tf * 2.2)
     / (tf.tf + 1.2 * (0.25 + 0.75 * lens.n / st.mean)), 8) AS DECIMAL(18,8))) AS score
   FROM tf JOIN df USING (t) JOIN lens ON lens.doc_id = tf.doc_id CROSS JOIN st GROUP BY 1)
{keep}"""


DOCS = "SELECT doc_id, lang, source, text AS content FROM documents"
_DOT = " + ".join(["0.0"] + [f"CAST(embedding[{i + 1}] AS DOUBLE) * {q!r}::DOUBLE" for i, q in enumerate(SEARCH_VECTOR)])
_NORM = " + ".join(["0.0"] + [f"CAST(embedding[{i + 1}] AS DOUBLE) * CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(len(SEARCH_VECTOR))])
_OWN = 0.0
for _q in SEARCH_VECTOR:
    _OWN += _q * _q
VECTORS = f"SELECT vec_id AS doc_id, round(({_DOT}) / (sqrt({_NORM}) * sqrt({_OWN!r}::DOUBLE)), 8) AS score FROM embeddings"
add(
    search_index=r"""
        SELECT doc_id, term, lang, CAST(n AS BIGINT) AS doc_length, count(*) AS tf FROM (
          SELECT doc_id, lang, len(w) AS n, unnest(w) AS term FROM (SELECT doc_id, lang, list_filter(
            string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '') AS w FROM documents)) GROUP BY 1, 2, 3, 4
        """,
    search_bm25=bm25(DOCS, "SELECT s.doc_id, d.lang, CAST(s.score AS DOUBLE) AS score FROM scored s JOIN docs d USING (doc_id) "
                           "ORDER BY s.score DESC, s.doc_id LIMIT 5"),
    search_filtered=bm25(DOCS + " WHERE lang = 'en'", "SELECT s.doc_id, d.source, CAST(s.score AS DOUBLE) AS score FROM scored s "
                         "JOIN docs d USING (doc_id) ORDER BY s.score DESC, s.doc_id LIMIT 5"),
    search_postings=bm25(DOCS, "SELECT doc_id, CAST(score AS DOUBLE) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 5"),
    search_corpus=bm25(f"SELECT doc_id, customer_id, doc_type, title, content FROM ({TRANSCRIPT_DOCS})",
                       "SELECT s.doc_id, d.customer_id, d.doc_type, d.title, CAST(s.score AS DOUBLE) AS score FROM scored s "
                       "JOIN docs d USING (doc_id) ORDER BY s.score DESC, s.doc_id LIMIT 5"),
    search_vector=f"SELECT * FROM ({VECTORS}) ORDER BY score DESC, doc_id LIMIT 5",
    search_hybrid=bm25(DOCS, f""", a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS text_rank FROM scored),
        b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS vector_rank FROM ({VECTORS})),
        x AS (SELECT * FROM a FULL JOIN b USING (doc_id))
        SELECT doc_id, text_rank, vector_rank, round(coalesce(1.0::DOUBLE / (60 + text_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0), 8)
          AS score FROM x ORDER BY score DESC, doc_id LIMIT 5"""),
    entity_linked_search=bm25("SELECT transcript_id AS doc_id, content_type AS doc_type, raw_text AS content FROM v_transcripts", """
        SELECT p.customer_id, p.first_name || ' ' || p.last_name AS customer_name, p.risk_tier, p.nba_action_type, p.system_status,
          s.doc_id, s.doc_type, 'text ' || s.doc_id AS title, CAST(s.score AS DOUBLE) AS score, s.rank
        FROM v_profile p JOIN (SELECT d.doc_id, d.doc_type, i.customer_id, s.score, row_number() OVER (
            PARTITION BY i.customer_id ORDER BY s.score DESC, d.doc_id) AS rank FROM scored s JOIN docs d USING (doc_id)
            JOIN v_interactions i ON i.interaction_id = d.doc_id * 10) s
          ON s.customer_id = p.customer_id AND s.rank <= 5"""),
)

# --- incremental, streaming, access ------------------------------------------------------------------------------

add(
    stream_new_rows=f"""SELECT interaction_id, customer_id, channel, {ts('interaction_date')} AS interaction_date
        FROM v_interactions WHERE interaction_date >= {CUT}""",
    stream_dedup=f"SELECT interaction_id, customer_id, {ts('interaction_date')} AS interaction_date FROM v_interactions",
    stream_enrich=f"""SELECT interaction_id, enrichment_status, {SCORE} AS sentiment_score, primary_topic, urgency_level,
        is_escalation FROM v_enriched""",
    incremental_agg=f"SELECT * REPLACE ({ts('latest_interaction_date')} AS latest_interaction_date) FROM v_agg_interaction",
    incremental_fold=f"SELECT * REPLACE ({ts('latest_interaction_date')} AS latest_interaction_date) FROM v_agg_interaction",
    incremental_verify=f"""SELECT customer_id, count(*) FILTER (interaction_date < {CUT}) AS "before", count(*) AS "after",
        count(*) FILTER (interaction_date >= {CUT}) AS delta FROM v_interactions GROUP BY 1""",
    masked_profile="""SELECT * REPLACE (left(first_name, 1) || '.' AS first_name, left(last_name, 1) || '.' AS last_name,
        CASE WHEN email IS NOT NULL THEN left(email, 1) || '***@***.com' END AS email,
        CASE WHEN phone IS NOT NULL THEN '***-***-' || right(phone, 4) END AS phone, CAST(NULL AS DATE) AS date_of_birth) FROM v_customers""",
    role_projection="""SELECT * REPLACE (left(first_name, 1) || '.' AS first_name, left(last_name, 1) || '.' AS last_name,
        CASE WHEN email IS NOT NULL THEN left(email, 1) || '***@***.com' END AS email,
        CASE WHEN phone IS NOT NULL THEN '***-***-' || right(phone, 4) END AS phone, CAST(NULL AS DATE) AS date_of_birth) FROM v_customers""",
    retention_filter=f"""SELECT interaction_id, customer_id, {ts('interaction_date')} AS interaction_date FROM v_interactions
        WHERE CAST(interaction_date AS DATE) >= DATE '2024-01-31' - 20
          AND customer_id NOT IN (SELECT customer_id FROM v_customers WHERE status = 'inactive')""",
)

# --- maintained by what changes ------------------------------------------------------------------------------------

SNAPSHOTS = " UNION ALL ".join(
    f"SELECT DATE '{day}' AS day, customer_id, household_id, {status} AS status FROM v_customers WHERE {kept}"
    for day, kept, status in (
        ("2000-01-01", "customer_id % 5 <> 0", "'active'"), ("2000-06-01", "customer_id % 7 <> 0", "status"),
        ("2001-08-01", "true", "status")))

add(
    load_figures=" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows, CAST(0 AS BIGINT) AS null_hashes, CAST(64 AS BIGINT) AS min_hash_length, "
        f"CAST(0 AS BIGINT) AS audit_nulls, CAST(0 AS BIGINT) AS rejected, CAST(1 AS BIGINT) AS loads FROM {v}" for t, v, _ in LANDED),
    full_reload="""SELECT customer_id, status, 'BATCH-2024-02-01' AS _batch_id, 'customers.csv' AS _source_file FROM v_customers""",
    change_feed_pruned=f"SELECT * FROM ({ORACLES['change_feed']}) WHERE change_type <> 'unchanged'",
    # a version begins where a snapshot has another status than the one before it, or the customer wasn't in that
    scd2_customer=f"""
        WITH s AS ({SNAPSHOTS}), days AS (SELECT day, lead(day) OVER (ORDER BY day) AS until, lag(day) OVER (ORDER BY day) AS earlier
          FROM (SELECT DISTINCT day FROM s)),
        seen AS (SELECT s.*, until, coalesce(lag(s.day) OVER w = earlier AND lag(status) OVER w = status, false) AS goes_on
          FROM s JOIN days USING (day) WINDOW w AS (PARTITION BY customer_id ORDER BY s.day)),
        numbered AS (SELECT *, count(*) FILTER (NOT goes_on) OVER (PARTITION BY customer_id ORDER BY day) AS version FROM seen)
        SELECT customer_id, any_value(status) AS status, min(day) AS valid_from,
          nullif(arg_max(coalesce(until, DATE '9999-12-31'), day), DATE '9999-12-31') AS valid_to,
          arg_max(until IS NULL, day) AS is_current
        FROM numbered GROUP BY customer_id, version""",
)

# product, its rows, and whether a row leads to an inactive customer
_INACTIVE = "{0} IN (SELECT customer_id FROM v_customers WHERE status = 'inactive')"
_CONTACT = f"interaction_id IN (SELECT interaction_id FROM v_interactions WHERE {_INACTIVE.format('customer_id')})"
_ERASED = (
    ("customers", "v_customers", _INACTIVE.format("customer_id")),
    ("policies", "v_policies", _INACTIVE.format("customer_id")),
    ("coverages", "v_coverages", f"policy_id IN (SELECT policy_id FROM v_policies WHERE {_INACTIVE.format('customer_id')})"),
    ("interactions", "v_interactions", _INACTIVE.format("customer_id")),
    ("transcripts", "v_transcripts", _CONTACT),
    ("words", "v_transcripts WHERE recording_consent_flag IS DISTINCT FROM 'FALSE'", _CONTACT),
    ("recommendations", "v_recommendations", _INACTIVE.format("customer_id")),
)

add(erasure_report=" UNION ALL ".join(
    f"SELECT '{name}' AS product, count(*) AS rows_before, count(*) FILTER ({gone}) AS rows_removed, "
    f"count(*) FILTER (NOT coalesce({gone}, false)) AS rows_kept, CAST(0 AS BIGINT) AS rows_left FROM {rows}" for name, rows, gone in _ERASED))

add(manifest_rows=" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, true AS hashed FROM {v}" for t, v in VIEW.items()))

# the same answers, by another way
ORACLES["search_vector_pruned"] = ORACLES["search_vector"]
ORACLES["tiled_sentiment_summary"] = ORACLES["sentiment_summary"]
ORACLES["tiled_risk_windows"] = ORACLES["risk_sentiment_windows"]
ORACLES["tiled_interaction_frequency"] = ORACLES["interaction_frequency"]
