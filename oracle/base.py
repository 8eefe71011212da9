"""Shared SQL views of the oracle: the logical model over the test tables, in plain SQL.

``sql(query)`` prefixes a query with exactly the views it mentions. Everything
here is written independently of the Spark code; money is DECIMAL, scores are
exact integers (ten-thousandths), rounding is half away from zero.
"""

from __future__ import annotations

import re

from kinsight.config import ACTIONS

VIEWS: dict[str, str] = {}


def view(name: str, text: str) -> None:
    VIEWS[name] = text.strip()


def _mentioned(text: str) -> list[str]:
    words = set(re.findall(r"\bv_\w+\b", text))
    return [n for n in VIEWS if n in words]


def sql(query: str) -> str:
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in _mentioned(text):
            if name not in needed:
                visit(VIEWS[name])
                needed[name] = None

    visit(query)
    if not needed:
        return query.strip()
    # MATERIALIZED: several views are used more than once
    ctes = ",\n".join(f"{n} AS MATERIALIZED (\n{VIEWS[n]}\n)" for n in needed)
    body = query.strip()
    return f"WITH {ctes},\n{body[4:]}" if body.startswith("WITH") else f"WITH {ctes}\n{body}"


def rdiv(num: str, den: str, digits: int) -> str:
    """num / den rounded half away from zero to ``digits``, as DOUBLE, from exact integers (den > 0)."""
    f = 10 ** digits
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    return (f"(CAST(sign({n}) AS BIGINT) * CAST((2 * abs({n}) * {f} + {d}) // (2 * {d}) AS DOUBLE) / {f}.0)")


def ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def tidy(num: str, den: str) -> str:
    """num / den (integers) as text with two decimals, trailing zeros removed."""
    return (f"regexp_replace(printf('%.2f', {rdiv(num, den, 2)} + 0.0), '\\.?0+$', '')")


NOW = "TIMESTAMP '2024-01-31 00:00:00'"
CURRENT = "(interaction_date >= TIMESTAMP '2024-01-16 00:00:00')"
RECENT = "(interaction_date >= TIMESTAMP '2024-01-01 00:00:00')"
PRIOR = f"({RECENT} AND interaction_date < TIMESTAMP '2024-01-16 00:00:00')"
TODAY = "DATE '2001-08-01'"

view("v_customers", """
SELECT c_custkey AS customer_id, CAST(c_nationkey AS BIGINT) AS household_id,
       split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
       DATE '1990-01-01' + CAST(c_custkey % 1800 AS INTEGER) AS customer_since,
       CASE WHEN c_acctbal >= 0 THEN 'active' ELSE 'inactive' END AS status,
       CASE WHEN c_acctbal >= 0 THEN DATE '1950-01-01' + CAST(c_custkey % 18000 AS INTEGER) END AS date_of_birth,
       CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'c' || split_part(c_name, '#', 2) || '@example.com' END AS email,
       CASE WHEN c_acctbal >= 0 THEN '555-' || split_part(c_name, '#', 2) END AS phone,
       c_name AS address_line_1, 'CITY ' || c_nationkey AS city, c_mktsegment AS state,
       split_part(c_name, '#', 2) AS postal_code
FROM customer
""")

_POLICIES = """
SELECT o_orderkey AS policy_id, o_custkey AS customer_id,
       CASE left(o_orderpriority, 1) WHEN '1' THEN 'auto' WHEN '2' THEN 'home' WHEN '3' THEN 'umbrella'
            WHEN '4' THEN 'renters' ELSE 'other' END AS product_type,
       CASE WHEN o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) >= {today} - 365 THEN 'active'
            WHEN o_orderstatus = 'O' THEN 'renewed' WHEN o_orderstatus = 'F' THEN 'lapsed' ELSE 'quoted' END AS status,
       CAST(o_orderdate AS DATE) AS effective_date, CAST(o_orderdate AS DATE) + 365 AS expiration_date,
       CAST(o_totalprice AS DECIMAL(12,2)) AS premium_amount,
       CASE o_orderkey % 4 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' WHEN 2 THEN 'semi_annual' ELSE 'annual' END
           AS payment_frequency,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) - 7 END AS bound_date
FROM orders
"""
view("v_policies", _POLICIES.format(today=TODAY))
view("v_policies_earlier", _POLICIES.format(today="DATE '2000-08-01'"))

view("v_coverages", """
SELECT l_orderkey || '-' || l_linenumber AS coverage_id, l_orderkey AS policy_id,
       l_returnflag || l_linestatus AS coverage_type, CAST(l_extendedprice AS DECIMAL(12,2)) AS limit_amount,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(12,2))
           AS deductible_amount
FROM lineitem
""")

view("v_lines", """
SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'),
                     CAST(l_extendedprice AS DECIMAL(12,2)))) AS line_id,
       l_orderkey AS policy_id, o_custkey AS customer_id, l_returnflag AS flag, l_linestatus AS state,
       CAST(l_shipdate AS DATE) AS shipped, CAST(o_orderdate AS DATE) AS ordered,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS discount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")

view("v_claims", """
SELECT line_id AS claim_id, policy_id, customer_id, shipped AS filed_date,
       CASE WHEN flag = 'A' THEN 'denied' WHEN state = 'F' THEN 'settled' ELSE 'filed' END AS status,
       shipped - 10 AS loss_date, 'loss_' || lower(state) AS loss_type,
       CASE WHEN flag = 'A' OR state <> 'F' THEN price END AS reserve_amount,
       CASE WHEN flag = 'R' AND state = 'F' THEN CAST(price * (1 - discount) AS DECIMAL(12,2)) END AS paid_amount,
       CASE WHEN flag = 'A' OR state = 'F' THEN shipped + 30 END AS closed_date
FROM v_lines WHERE flag IN ('R', 'A')
""")

view("v_payments", """
SELECT payment_id, customer_id, policy_id, due_date, amount, status,
       CASE WHEN status <> 'missed' THEN shipped END AS paid_date,
       CASE WHEN status <> 'missed' THEN amount END AS amount_paid
FROM (
  SELECT line_id AS payment_id, customer_id, policy_id, ordered + 30 AS due_date, price AS amount, shipped,
         CASE WHEN state = 'O' AND shipped - (ordered + 30) > 365 THEN 'missed'
              WHEN shipped - (ordered + 30) <= 0 THEN 'on_time'
              WHEN shipped - (ordered + 30) <= 30 THEN 'grace_period' ELSE 'late' END AS status
  FROM v_lines WHERE flag = 'N')
""")

view("v_interactions", """
SELECT event_id AS interaction_id, user_id AS customer_id,
       CASE WHEN event_type IN ('click', 'view') THEN 'chat' WHEN event_type = 'signup' THEN 'email' ELSE 'phone' END
           AS channel,
       CASE WHEN event_type = 'view' THEN 'outbound' ELSE 'inbound' END AS direction,
       CASE event_type WHEN 'error' THEN 'complaint' WHEN 'click' THEN 'inquiry' WHEN 'signup' THEN 'request'
            WHEN 'view' THEN 'notification' ELSE 'general' END AS disposition,
       CAST(ts AS TIMESTAMP) AS interaction_date, CAST(floor(value) AS BIGINT) AS duration_seconds,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS representative_id
FROM events
""")

view("v_transcripts", """
SELECT doc_id AS transcript_id, doc_id * 10 AS interaction_id,
       CASE lang WHEN 'en' THEN 'call_transcript' WHEN 'fr' THEN 'email_body' ELSE 'agent_note' END AS content_type,
       text AS raw_text, CAST(n_chars // 6 AS BIGINT) AS word_count,
       CASE WHEN source = 'src7' THEN 'FALSE' ELSE 'TRUE' END AS recording_consent_flag
FROM documents
""")

view("v_reps", """
SELECT s_suppkey AS representative_id, s_name AS name,
       CASE WHEN s_suppkey % 10 = 0 THEN 'supervisor' WHEN s_suppkey % 10 < 3 THEN 'retention_specialist'
            ELSE 'service_rep' END AS role,
       CASE WHEN s_acctbal >= 0 THEN 'TRUE' ELSE 'FALSE' END AS active,
       CASE WHEN s_nationkey % 5 <> 0 THEN 'team ' || s_nationkey END AS team
FROM supplier
""")

# --- curated, aggregates, base -----------------------------------------------------------------------------------

view("v_household", """
WITH votes AS (SELECT household_id, state, count(*) AS n FROM v_customers GROUP BY 1, 2),
     best AS (SELECT household_id, state, row_number() OVER (PARTITION BY household_id ORDER BY n DESC, state) AS r
              FROM votes)
SELECT c.household_id, count(*) AS member_count, any_value(b.state) AS primary_state, min(c.city) AS primary_city,
       CASE WHEN bool_or(c.status = 'active') THEN 'active' ELSE 'inactive' END AS household_status,
       min(c.customer_since) AS earliest_since
FROM v_customers c JOIN best b ON b.household_id = c.household_id AND b.r = 1 GROUP BY 1
""")

view("v_agg_policy", """
WITH p AS (
  SELECT customer_id, count(*) AS total_policies, count(*) FILTER (status = 'active') AS active_policies,
         count(DISTINCT product_type) AS distinct_product_count,
         string_agg(DISTINCT product_type, ', ' ORDER BY product_type) AS product_holdings,
         min(expiration_date) FILTER (status = 'active') AS nearest_renewal_date,
         CAST(sum(premium_amount) AS DECIMAL(14,2)) AS total_annual_premium,
         CAST(coalesce(sum(premium_amount) FILTER (status = 'active'), 0) AS DECIMAL(14,2)) AS active_annual_premium
  FROM v_policies GROUP BY 1),
 c AS (
  SELECT customer_id, CAST(sum(limit_amount) AS DECIMAL(14,2)) AS total_coverage_limit,
         CAST(sum(deductible_amount) AS DECIMAL(14,2)) AS total_deductible
  FROM v_coverages JOIN v_policies USING (policy_id) GROUP BY 1)
SELECT p.*, c.total_coverage_limit, c.total_deductible FROM p LEFT JOIN c USING (customer_id)
""")

view("v_agg_claim", """
SELECT customer_id, count(*) AS total_claims, count(*) FILTER (status IN ('filed', 'under_review')) AS open_claims,
       count(*) FILTER (status = 'settled') AS settled_claims, count(*) FILTER (status = 'denied') AS denied_claims,
       CAST(sum(reserve_amount) AS DECIMAL(14,2)) AS total_reserve_amount,
       CAST(sum(paid_amount) AS DECIMAL(14,2)) AS total_paid_amount,
       min(filed_date) AS earliest_filed_date, max(filed_date) AS latest_filed_date
FROM v_claims GROUP BY 1
""")

view("v_agg_payment", """
SELECT customer_id, count(*) AS total_payments, count(*) FILTER (status = 'on_time') AS on_time_count,
       count(*) FILTER (status = 'late') AS late_count, count(*) FILTER (status = 'missed') AS missed_count,
       count(*) FILTER (status = 'grace_period') AS grace_period_count,
       count(*) FILTER (status = 'pending') AS pending_count, max(paid_date) AS latest_paid_date,
       CAST(sum(amount) AS DECIMAL(14,2)) AS total_amount_due,
       CAST(sum(amount_paid) AS DECIMAL(14,2)) AS total_amount_paid
FROM v_payments GROUP BY 1
""")

view("v_agg_interaction", """
SELECT customer_id, count(*) AS total_interactions, count(*) FILTER (direction = 'inbound') AS inbound_count,
       count(*) FILTER (direction = 'outbound') AS outbound_count, max(interaction_date) AS latest_interaction_date,
       (list(channel ORDER BY interaction_date DESC, channel DESC))[1] AS latest_channel,
       count(*) FILTER (disposition = 'complaint') AS complaint_count,
       count(*) FILTER (disposition = 'inquiry') AS inquiry_count,
       count(*) FILTER (disposition = 'request') AS request_count
FROM v_interactions GROUP BY 1
""")

view("v_base", f"""
SELECT c.customer_id, c.first_name, c.last_name, c.date_of_birth, c.email, c.phone, c.address_line_1, c.city, c.state,
       c.postal_code, c.customer_since, c.status AS customer_status, c.household_id,
       h.member_count AS household_member_count, h.primary_state AS household_primary_state, h.household_status,
       h.earliest_since AS household_earliest_since,
       coalesce(p.total_policies, 0) AS total_policies, coalesce(p.active_policies, 0) AS active_policies,
       coalesce(p.distinct_product_count, 0) AS distinct_product_count, p.product_holdings, p.nearest_renewal_date,
       CAST(p.nearest_renewal_date - {TODAY} AS BIGINT) AS days_to_renewal,
       CAST(coalesce(p.total_annual_premium, 0) AS DOUBLE) AS total_annual_premium,
       CAST(coalesce(p.active_annual_premium, 0) AS DOUBLE) AS active_annual_premium,
       CAST(p.total_coverage_limit AS DOUBLE) AS total_coverage_limit, CAST(p.total_deductible AS DOUBLE) AS total_deductible,
       coalesce(cl.total_claims, 0) AS total_claims, coalesce(cl.open_claims, 0) AS open_claims,
       coalesce(cl.settled_claims, 0) AS settled_claims, coalesce(cl.denied_claims, 0) AS denied_claims,
       CAST(cl.total_reserve_amount AS DOUBLE) AS total_reserve_amount,
       CAST(cl.total_paid_amount AS DOUBLE) AS claims_total_paid, cl.earliest_filed_date, cl.latest_filed_date,
       coalesce(py.total_payments, 0) AS total_payments, coalesce(py.on_time_count, 0) AS payments_on_time,
       coalesce(py.late_count, 0) AS payments_late, coalesce(py.missed_count, 0) AS payments_missed,
       coalesce(py.grace_period_count, 0) AS payments_grace_period, coalesce(py.pending_count, 0) AS payments_pending,
       py.latest_paid_date, CAST(coalesce(py.total_amount_due, 0) AS DOUBLE) AS total_amount_due,
       CAST(py.total_amount_paid AS DOUBLE) AS payments_total_paid,
       coalesce(i.total_interactions, 0) AS total_interactions, coalesce(i.inbound_count, 0) AS interactions_inbound,
       coalesce(i.outbound_count, 0) AS interactions_outbound, {ts('i.latest_interaction_date')} AS latest_interaction_date,
       i.latest_channel, coalesce(i.complaint_count, 0) AS interactions_complaints,
       coalesce(i.inquiry_count, 0) AS interactions_inquiries, coalesce(i.request_count, 0) AS interactions_requests,
       c.email IS NOT NULL AS has_email, c.phone IS NOT NULL AS has_phone, c.date_of_birth IS NOT NULL AS has_dob,
       p.customer_id IS NOT NULL AS has_policies, cl.customer_id IS NOT NULL AS has_claims,
       py.customer_id IS NOT NULL AS has_payments, i.customer_id IS NOT NULL AS has_interactions
FROM v_customers c LEFT JOIN v_household h ON h.household_id = c.household_id
LEFT JOIN v_agg_policy p ON p.customer_id = c.customer_id LEFT JOIN v_agg_claim cl ON cl.customer_id = c.customer_id
LEFT JOIN v_agg_payment py ON py.customer_id = c.customer_id
LEFT JOIN v_agg_interaction i ON i.customer_id = c.customer_id
""")

# --- enrichment --------------------------------------------------------------------------------------------------


def _rule(rules: list[tuple[str, list[str]]], default: str) -> str:
    whens = " ".join(f"WHEN list_has_any(w, {words}) THEN '{value}'" for value, words in rules)
    return f"CASE {whens} ELSE '{default}' END"


view("v_words", r"""
SELECT *, string_split_regex(lower(raw_text), '[^\p{L}]+') AS w FROM v_transcripts
""")

view("v_scored", f"""
SELECT transcript_id, interaction_id, content_type, word_count, recording_consent_flag, raw_text,
       lower(raw_text) LIKE '%eratsh%' OR lower(raw_text) LIKE '%thon%erin%thble%' AS text_escalates,
       CASE WHEN ok THEN pos - neg END AS num, CASE WHEN ok AND pos + neg > 0 THEN pos + neg END AS den,
       CASE WHEN ok THEN array_to_string(string_split_regex(sentence, '\\s+')[1:20], ' ') END AS summary,
       CASE WHEN ok THEN intent END AS intent, CASE WHEN ok THEN urgency END AS urgency, CASE WHEN ok THEN topic END AS topic,
       ok
FROM (
  SELECT *, recording_consent_flag <> 'FALSE' AS ok,
         len(list_filter(w, lambda x: x IN ('is', 'was', 'with'))) AS pos,
         len(list_filter(w, lambda x: x IN ('for', 'by', 'on'))) AS neg,
         regexp_replace(regexp_extract(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g'), '^[^.!?]*[.!?]?'),
                        '^\\s+|\\s+$', '', 'g') AS sentence,
         {_rule([('escalation', ['thnt']), ('complaint', ['thha']), ('praise', ['thhe']), ('request', ['thes', 'thre'])], 'inquiry')} AS intent,
         {_rule([('critical', ['thon']), ('high', ['ther']), ('medium', ['than'])], 'unknown')} AS urgency,
         {_rule([('billing', ['thble']), ('claims', ['erin']), ('coverage', ['thor']), ('service', ['anea']), ('cancellation', ['thed'])], 'general')} AS topic
  FROM v_words)
""")

# s4 is the score in ten-thousandths; comparisons use the exact fraction num / den
view("v_enriched", """
SELECT i.*, t.transcript_id, t.content_type, t.word_count,
       CAST(sign(t.num) AS BIGINT) * CAST((2 * abs(t.num) * 10000 + t.den) // (2 * t.den) AS BIGINT) AS s4,
       CASE WHEN 5 * t.num < -t.den THEN 'negative' WHEN 5 * t.num > t.den THEN 'positive'
            WHEN t.den IS NOT NULL THEN 'neutral' END AS sentiment_label,
       t.summary, t.topic AS primary_topic, t.intent AS primary_intent,
       CASE WHEN 2 * t.num < -t.den AND (i.disposition = 'complaint' OR t.intent = 'escalation') THEN 'critical'
            WHEN t.urgency <> 'unknown' THEN t.urgency
            WHEN 5 * t.num < -t.den THEN 'high' WHEN i.disposition = 'complaint' THEN 'high'
            WHEN 5 * abs(t.num) <= t.den THEN 'medium' ELSE 'low' END AS urgency_level,
       CASE WHEN t.ok THEN to_json({'summary': t.summary, 'intent': t.intent, 'urgency': t.urgency, 'topic': t.topic})
       END AS extraction_raw,
       i.disposition = 'complaint' OR coalesce(t.intent = 'complaint', false) OR coalesce(2 * t.num < -t.den, false)
           AS is_complaint,
       coalesce(t.intent = 'escalation', false) OR coalesce(t.text_escalates, false) AS is_escalation,
       CASE WHEN t.transcript_id IS NULL THEN 'not_applicable' WHEN NOT t.ok THEN 'consent_withheld'
            WHEN t.den IS NOT NULL THEN 'completed' ELSE 'failed' END AS enrichment_status
FROM v_interactions i LEFT JOIN v_scored t ON t.interaction_id = i.interaction_id
""")

view("v_windows", f"""
SELECT customer_id,
  count(*) FILTER (enrichment_status = 'completed' AND {CURRENT}) AS enriched_interactions_90d,
  count(*) FILTER (sentiment_label = 'negative' AND {CURRENT}) AS negative_count_90d,
  count(*) FILTER (sentiment_label = 'positive' AND {CURRENT}) AS positive_count_90d,
  sum(s4) FILTER (enrichment_status = 'completed' AND {CURRENT}) AS cs,
  count(s4) FILTER (enrichment_status = 'completed' AND {CURRENT}) AS cn,
  sum(s4) FILTER (enrichment_status = 'completed' AND {PRIOR}) AS ps,
  count(s4) FILTER (enrichment_status = 'completed' AND {PRIOR}) AS pn,
  min(s4) FILTER ({CURRENT}) AS worst4,
  count(*) AS interaction_rows, count(transcript_id) AS transcripts_total,
  count(*) FILTER (enrichment_status = 'completed') AS transcripts_enriched,
  count(*) FILTER (enrichment_status = 'failed') AS transcripts_failed,
  count(*) FILTER (enrichment_status = 'completed' AND {CURRENT} AND sentiment_label = 'negative') AS risk_negative,
  count(*) FILTER (enrichment_status = 'completed' AND {CURRENT} AND is_complaint) AS risk_complaint,
  count(*) FILTER (enrichment_status = 'completed' AND {CURRENT} AND is_escalation) AS risk_escalation,
  min(s4) FILTER (enrichment_status = 'completed' AND {CURRENT}) AS risk_worst4,
  max(interaction_date) FILTER (enrichment_status = 'completed' AND {CURRENT} AND sentiment_label = 'negative')
      AS risk_last_negative,
  count(*) FILTER ({CURRENT}) AS interactions_current, count(*) FILTER ({PRIOR}) AS interactions_prior
FROM v_enriched GROUP BY 1
""")


def direction(missing: str) -> str:
    """Exact comparison of cs/cn with ps/pn, a step of 0.1 being 1000 ten-thousandths."""
    return (f"CASE WHEN coalesce(cn, 0) = 0 OR coalesce(pn, 0) = 0 THEN '{missing}' "
            f"WHEN cs * pn < ps * cn - 1000 * cn * pn THEN 'worsening' "
            f"WHEN cs * pn > ps * cn + 1000 * cn * pn THEN 'improving' ELSE 'stable' END")


view("v_sentiment", f"""
SELECT customer_id, enriched_interactions_90d, negative_count_90d, positive_count_90d,
       CASE WHEN cn > 0 THEN {rdiv('cs', 'cn * 10000', 3)} END AS avg_sentiment_90d,
       worst4 / 10000.0 AS worst_sentiment_90d,
       CASE WHEN pn > 0 THEN {rdiv('ps', 'pn * 10000', 3)} END AS avg_sentiment_prior_90d,
       {direction('insufficient_data')} AS sentiment_direction, transcripts_total, transcripts_enriched,
       CASE WHEN transcripts_total > 0 THEN {rdiv('transcripts_enriched', 'transcripts_total', 2)} END
           AS enrichment_coverage_pct
FROM v_windows
""")

# --- risk --------------------------------------------------------------------------------------------------------

view("v_wide", """
SELECT b.customer_id, b.first_name, b.last_name, b.nearest_renewal_date, b.days_to_renewal,
       coalesce(w.risk_negative, 0) AS negative_count_90d, coalesce(w.risk_complaint, 0) AS complaint_count_90d,
       coalesce(w.risk_escalation, 0) AS escalation_count_90d, w.cs, coalesce(w.cn, 0) AS cn, w.ps,
       coalesce(w.pn, 0) AS pn, w.risk_worst4, w.risk_last_negative,
       b.payments_late, b.payments_missed, b.total_payments, b.open_claims, b.total_claims,
       coalesce(w.interactions_current, 0) AS interactions_current_90d,
       coalesce(w.interactions_prior, 0) AS interactions_prior_90d, b.active_policies,
       CASE WHEN b.has_policies THEN coalesce(b.product_holdings NOT LIKE '%home%', false) ELSE true END AS missing_home,
       CASE WHEN b.has_policies THEN coalesce(b.product_holdings NOT LIKE '%umbrella%', false) ELSE true END
           AS missing_umbrella,
       b.product_holdings, b.has_policies, coalesce(w.transcripts_total, 0) AS transcripts_total,
       coalesce(w.transcripts_enriched, 0) AS transcripts_enriched, coalesce(w.transcripts_failed, 0) AS transcripts_failed,
       coalesce(w.interaction_rows, 0) AS interaction_rows
FROM v_base b LEFT JOIN v_windows w ON w.customer_id = b.customer_id
""")

# score and weighted_score as exact text-free numbers: sc (double, 3 digits), w4 (ten-thousandths)
_DIR = direction("stable")
view("v_signals", f"""
SELECT customer_id, 'renewal_proximity' AS signal_type, CAST(days_to_renewal AS DOUBLE) AS signal_value,
       CASE WHEN days_to_renewal >= 60 THEN 0.0 WHEN days_to_renewal <= 0 THEN 1.0
            ELSE {rdiv('60 - days_to_renewal', '60', 3)} END AS signal_score, 0.30::DOUBLE AS signal_weight,
       CASE WHEN days_to_renewal >= 60 THEN 0 WHEN days_to_renewal <= 0 THEN 3000 ELSE 50 * (60 - days_to_renewal) END AS w4,
       'stable' AS signal_direction,
       'Nearest renewal in ' || days_to_renewal || ' days' || CASE WHEN days_to_renewal <= 14 THEN ' — URGENT'
            WHEN days_to_renewal <= 30 THEN ' — approaching' ELSE '' END AS evidence_text
FROM v_wide WHERE nearest_renewal_date IS NOT NULL
UNION ALL
SELECT customer_id, 'sentiment_negative', CAST(negative_count_90d AS DOUBLE),
       CASE negative_count_90d WHEN 0 THEN 0.0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.7 ELSE 1.0 END, 0.25,
       CASE negative_count_90d WHEN 0 THEN 0 WHEN 1 THEN 1000 WHEN 2 THEN 1750 ELSE 2500 END, {_DIR},
       negative_count_90d || ' negative interaction(s) in last 90 days' ||
       CASE WHEN risk_worst4 IS NOT NULL THEN ' (worst score: ' || {tidy('risk_worst4', '10000')} || ')' ELSE '' END
FROM v_wide
UNION ALL
SELECT customer_id, 'sentiment_trend', CASE WHEN cn > 0 THEN {rdiv('cs', 'cn * 10000', 8)} ELSE 0.0 END,
       sc, 0.10, CAST(round(sc * 1000) AS BIGINT), {_DIR},
       'Sentiment trend: ' || CASE WHEN cn = 0 THEN 'insufficient data' ELSE 'avg ' || {tidy('cs', 'cn * 10000')} ||
       ' (prior: ' || CASE WHEN pn > 0 THEN {tidy('ps', 'pn * 10000')} ELSE '0' END || ')' END
FROM (SELECT *, CASE WHEN cn = 0 OR pn = 0 THEN 0.0 WHEN cs * pn < ps * cn - 3000 * cn * pn THEN 0.9
                     WHEN cs * pn < ps * cn - 1000 * cn * pn THEN 0.5 ELSE 0.1 END AS sc FROM v_wide)
UNION ALL
SELECT customer_id, 'payment_risk', CAST(bad AS DOUBLE),
       CASE WHEN total_payments = 0 THEN 0.0 WHEN 25 * bad >= 10 * total_payments THEN 1.0
            ELSE {rdiv('bad * 25', 'total_payments * 10', 3)} END, 0.15,
       CASE WHEN total_payments = 0 THEN 0 WHEN 25 * bad >= 10 * total_payments THEN 1500
            ELSE (2 * bad * 3750 + total_payments) // (2 * total_payments) END, 'stable',
       CASE WHEN bad = 0 THEN 'All payments on time' ELSE bad || ' late/missed of ' || total_payments || ' total payments' END
FROM (SELECT *, payments_late + payments_missed AS bad FROM v_wide)
UNION ALL
SELECT customer_id, 'complaint_activity', CAST(complaint_count_90d + escalation_count_90d AS DOUBLE), sc, 0.10,
       CAST(round(sc * 1000) AS BIGINT), CASE WHEN escalation_count_90d > 0 THEN 'worsening' ELSE 'stable' END,
       CASE WHEN complaint_count_90d + escalation_count_90d = 0 THEN 'No complaints or escalations in 90 days'
            ELSE complaint_count_90d || ' complaint(s), ' || escalation_count_90d || ' escalation(s) in 90 days' END
FROM (SELECT *, CASE WHEN escalation_count_90d > 0 THEN 1.0 WHEN complaint_count_90d >= 2 THEN 0.8
                     WHEN complaint_count_90d = 1 THEN 0.5 ELSE 0.0 END AS sc FROM v_wide)
UNION ALL
SELECT customer_id, 'claim_activity', CAST(open_claims AS DOUBLE),
       CASE open_claims WHEN 0 THEN 0.0 WHEN 1 THEN 0.4 ELSE 0.8 END, 0.05,
       CASE open_claims WHEN 0 THEN 0 WHEN 1 THEN 200 ELSE 400 END, 'stable',
       CASE WHEN open_claims = 0 THEN 'No open claims' ELSE open_claims || ' open claim(s) — active service load' END
FROM v_wide
UNION ALL
SELECT customer_id, 'engagement_drop', CAST(interactions_current_90d AS DOUBLE), sc, 0.05,
       CAST(round(sc * 500) AS BIGINT),
       CASE WHEN interactions_current_90d > interactions_prior_90d + 1 THEN 'worsening'
            WHEN interactions_current_90d < interactions_prior_90d - 1 THEN 'improving' ELSE 'stable' END,
       interactions_current_90d || ' interactions in last 90d vs ' || interactions_prior_90d || ' in prior 90d'
FROM (SELECT *, CASE WHEN interactions_current_90d > interactions_prior_90d + 2 THEN 0.7
                     WHEN interactions_current_90d > interactions_prior_90d THEN 0.3 ELSE 0.0 END AS sc FROM v_wide)
UNION ALL
SELECT customer_id, 'cross_sell_opportunity', CAST(missing_home AS INTEGER) + CAST(missing_umbrella AS INTEGER),
       CASE WHEN active_policies >= 2 AND missing_home THEN 0.7 WHEN active_policies >= 2 AND missing_umbrella THEN 0.6
            WHEN active_policies = 1 THEN 0.4 ELSE 0.0 END, 0.00, 0, 'stable',
       CASE WHEN NOT missing_home AND NOT missing_umbrella THEN 'Full product suite — no cross-sell gap'
            ELSE 'Missing: ' || CASE WHEN missing_home THEN 'home ' ELSE '' END ||
                 CASE WHEN missing_umbrella THEN 'umbrella ' ELSE '' END || '(' || active_policies || ' active policies)' END
FROM v_wide
""")

view("v_summary", """
SELECT customer_id, CAST((sum(w4) + 5) // 10 AS DOUBLE) / 1000.0 AS composite_risk_score,
       CASE WHEN sum(w4) >= 4000 THEN 'critical' WHEN sum(w4) >= 2500 THEN 'high' WHEN sum(w4) >= 1000 THEN 'medium'
            ELSE 'low' END AS risk_tier,
       count(*) FILTER (signal_direction = 'worsening') AS worsening_signals,
       count(*) FILTER (signal_direction = 'improving') AS improving_signals,
       max(signal_type) FILTER (signal_weight > 0) AS top_signal_type,
       (list(signal_type ORDER BY w4 DESC, signal_type DESC) FILTER (signal_weight > 0))[1] AS top_signal_by_score,
       CASE WHEN count(*) FILTER (signal_direction = 'worsening') >= 2 THEN 'worsening'
            WHEN count(*) FILTER (signal_direction = 'worsening') >= 1
                 AND count(*) FILTER (signal_direction = 'improving') = 0 THEN 'worsening'
            WHEN count(*) FILTER (signal_direction = 'improving') >= 2 THEN 'improving' ELSE 'stable' END
           AS overall_direction,
       count(*) AS signal_count
FROM v_signals GROUP BY 1
""")

# --- next best action --------------------------------------------------------------------------------------------

_TEXTS = ", ".join(
    "('{}', '{}')".format(a.action_id, a.action_description.replace("'", "''")) for a in ACTIONS)
view("v_actions", f"""
SELECT t.*, d.action_description FROM (VALUES
 ('ACT-001', 'retention_outreach', 'Retention Outreach', 'retention', 95, 1, 'ALL', 'critical,high', 'sentiment_negative'),
 ('ACT-002', 'renewal_reminder', 'Proactive Renewal Reminder', 'retention', 90, 2, 'ALL', NULL, 'renewal_proximity'),
 ('ACT-003', 'complaint_followup', 'Complaint Follow-Up', 'service', 85, 3, 'ALL', 'critical,high,medium', 'complaint_activity'),
 ('ACT-004', 'claim_escalation', 'Claim Process Escalation', 'service', 70, 4, 'ALL', 'critical,high', 'claim_activity'),
 ('ACT-005', 'billing_assistance', 'Billing Assistance', 'service', 80, 5, 'ALL', NULL, 'payment_risk'),
 ('ACT-006', 'cross_sell_home', 'Cross-Sell: Home Insurance', 'sales', 60, 6, 'auto', 'low,medium', 'cross_sell_opportunity'),
 ('ACT-007', 'cross_sell_umbrella', 'Cross-Sell: Umbrella Policy', 'sales', 55, 7, 'auto,home', 'low,medium', 'cross_sell_opportunity'),
 ('ACT-008', 'no_action', 'No Proactive Action Required', 'administrative', 100, 8, 'ALL', 'low', NULL)
) AS t(action_id, action_type, action_name, action_category, safety100, priority_rank, eligible_products,
       requires_risk_tier, requires_signal)
JOIN (VALUES {_TEXTS}) AS d(action_id, action_description) USING (action_id)
""")

view("v_evidence", """
SELECT customer_id, to_json(list({'signal_type': signal_type, 'signal_score': signal_score, 'signal_weight': signal_weight,
       'weighted_score': w4 / 10000.0, 'direction': signal_direction, 'evidence': evidence_text}
       ORDER BY w4 DESC, signal_type)) AS evidence_signals
FROM v_signals GROUP BY 1
""")

view("v_context", f"""
SELECT s.customer_id, s.composite_risk_score, s.risk_tier, s.overall_direction, w.product_holdings,
       CASE WHEN w.has_policies THEN w.active_policies END AS active_policies,
       f.* EXCLUDE (customer_id),
       CASE WHEN w.transcripts_total > 0 THEN {rdiv('w.transcripts_enriched', 'w.transcripts_total', 2)} ELSE 0.0 END
           AS enrichment_coverage_pct,
       w.transcripts_enriched AS enriched_count, s.signal_count
FROM v_summary s JOIN v_wide w USING (customer_id) JOIN (
  SELECT customer_id,
    CAST(bool_or(signal_type = 'renewal_proximity' AND signal_score > 0) AS INTEGER) AS has_renewal,
    CAST(bool_or(signal_type = 'sentiment_negative' AND signal_score > 0) AS INTEGER) AS has_negative_sentiment,
    CAST(bool_or(signal_type = 'sentiment_trend' AND signal_score > 0.1) AS INTEGER) AS has_sentiment_trend,
    CAST(bool_or(signal_type = 'payment_risk' AND signal_score > 0) AS INTEGER) AS has_payment_risk,
    CAST(bool_or(signal_type = 'complaint_activity' AND signal_score > 0) AS INTEGER) AS has_complaint,
    CAST(bool_or(signal_type = 'claim_activity' AND signal_score > 0) AS INTEGER) AS has_claim,
    CAST(bool_or(signal_type = 'engagement_drop' AND signal_score > 0) AS INTEGER) AS has_engagement_drop,
    CAST(bool_or(signal_type = 'cross_sell_opportunity' AND signal_score > 0) AS INTEGER) AS has_cross_sell
  FROM v_signals GROUP BY 1) f USING (customer_id)
""")

# relevance in tenths (r10), final score in thousandths (f1000 = r10 * safety100)
view("v_matrix", """
SELECT *, r10 * safety100 AS f1000 FROM (
SELECT c.*, a.*,
  CASE WHEN a.eligible_products = 'ALL' THEN true
       WHEN a.eligible_products = 'auto' THEN coalesce(c.product_holdings LIKE '%auto%', false)
       ELSE coalesce(c.product_holdings LIKE '%auto%' OR c.product_holdings LIKE '%home%', false) END AS product_eligible,
  true AS not_excluded,
  a.requires_risk_tier IS NULL OR list_contains(string_split(a.requires_risk_tier, ','), c.risk_tier) AS risk_tier_eligible,
  CASE a.requires_signal WHEN 'sentiment_negative' THEN has_negative_sentiment = 1 WHEN 'renewal_proximity' THEN has_renewal = 1
       WHEN 'complaint_activity' THEN has_complaint = 1 WHEN 'claim_activity' THEN has_claim = 1
       WHEN 'payment_risk' THEN has_payment_risk = 1 WHEN 'cross_sell_opportunity' THEN has_cross_sell = 1
       ELSE true END AS signal_eligible,
  CASE a.action_type
    WHEN 'retention_outreach' THEN 4 * has_negative_sentiment + 3 * has_renewal + 2 * has_sentiment_trend + has_complaint
    WHEN 'renewal_reminder' THEN 6 * has_renewal + 2 * has_negative_sentiment
         + CASE WHEN c.risk_tier IN ('low', 'medium') THEN 2 ELSE 0 END
    WHEN 'complaint_followup' THEN 5 * has_complaint + 3 * has_negative_sentiment + 2 * has_engagement_drop
    WHEN 'claim_escalation' THEN 6 * has_claim + 2 * has_complaint + 2 * has_negative_sentiment
    WHEN 'billing_assistance' THEN 7 * has_payment_risk + 2 * has_negative_sentiment + has_complaint
    WHEN 'cross_sell_home' THEN 5 * has_cross_sell + CASE WHEN c.risk_tier = 'low' THEN 3 ELSE 0 END + 2 * has_renewal
    WHEN 'cross_sell_umbrella' THEN 5 * has_cross_sell + CASE WHEN c.risk_tier = 'low' THEN 3 ELSE 0 END
         + CASE WHEN c.active_policies >= 2 THEN 2 ELSE 0 END
    ELSE CASE WHEN c.risk_tier = 'low' THEN 8 ELSE 1 END END AS r10
FROM v_context c CROSS JOIN v_actions a)
""")

view("v_recommendations", f"""
SELECT *, CASE WHEN enrichment_coverage_pct >= 0.8 AND enriched_count >= 2 THEN 'high'
               WHEN enrichment_coverage_pct >= 0.5 AND enriched_count >= 1 THEN 'medium_high'
               WHEN enriched_count >= 1 THEN 'medium' ELSE 'low' END AS confidence_level,
  least(1.0, {rdiv('CAST(round(enrichment_coverage_pct * 100) AS BIGINT) * 4 + least(3, enriched_count) * 100 + CASE WHEN composite_risk_score > 0 THEN 300 ELSE 150 END', '1000', 2)})
    AS confidence_score,
  to_json({{'enrichment_coverage_pct': enrichment_coverage_pct, 'enriched_interactions': enriched_count,
           'risk_signals_computed': signal_count, 'has_sentiment_data': has_negative_sentiment = 1 OR enriched_count > 0}})
    AS data_completeness,
  to_json({{'product_eligible': product_eligible, 'not_excluded': not_excluded, 'risk_tier_eligible': risk_tier_eligible,
           'signal_eligible': signal_eligible}}) AS eligibility_check
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY f1000 DESC, priority_rank) AS action_rank
      FROM v_matrix WHERE product_eligible AND not_excluded AND risk_tier_eligible AND signal_eligible)
WHERE action_rank <= 4
""")

view("v_profile", """
SELECT b.* EXCLUDE (household_primary_state, household_status, household_earliest_since, total_coverage_limit,
                    total_deductible, earliest_filed_date, latest_filed_date, total_amount_due, payments_total_paid,
                    interactions_inquiries, interactions_requests),
       coalesce(s.enriched_interactions_90d, 0) AS enriched_interactions_90d,
       coalesce(s.negative_count_90d, 0) AS negative_count_90d, coalesce(s.positive_count_90d, 0) AS positive_count_90d,
       s.avg_sentiment_90d, s.worst_sentiment_90d, s.avg_sentiment_prior_90d,
       coalesce(s.sentiment_direction, 'insufficient_data') AS sentiment_direction,
       coalesce(s.enrichment_coverage_pct, 0.0) AS enrichment_coverage_pct,
       coalesce(r.composite_risk_score, 0.0) AS composite_risk_score, coalesce(r.risk_tier, 'low') AS risk_tier,
       r.worsening_signals, r.improving_signals, coalesce(r.overall_direction, 'stable') AS risk_direction,
       n.action_id AS nba_action_id, n.action_type AS nba_action_type, n.action_name AS nba_action_name,
       n.action_description AS nba_action_description, n.action_category AS nba_action_category,
       CASE WHEN n.action_id IS NOT NULL THEN e.evidence_signals END AS nba_evidence_signals,
       n.data_completeness AS nba_data_completeness, n.eligibility_check AS nba_eligibility_check,
       coalesce(n.f1000 / 1000.0, 0.0) AS nba_final_score, coalesce(n.confidence_level, 'low') AS nba_confidence_level,
       coalesce(n.confidence_score, 0.0) AS nba_confidence_score,
       coalesce(s.enriched_interactions_90d, 0) > 0 AS has_enrichment, r.customer_id IS NOT NULL AS has_risk_signals,
       n.action_id IS NOT NULL AS has_recommendation,
       CASE WHEN coalesce(s.enriched_interactions_90d, 0) = 0 AND b.has_interactions THEN 'degraded_no_enrichment'
            WHEN n.action_id IS NULL THEN 'degraded_no_recommendation' WHEN n.confidence_level = 'low' THEN 'low_confidence'
            ELSE 'full' END AS system_status,
       CASE WHEN coalesce(s.enriched_interactions_90d, 0) = 0 AND b.has_interactions
                 THEN 'AI enrichment unavailable — showing structured data only. Recommendation withheld.'
            WHEN n.action_id IS NULL THEN 'Insufficient signals for a recommendation. Please review available context.'
            WHEN n.confidence_level = 'low'
                 THEN 'Low confidence — limited enrichment data. Review evidence carefully.' END AS system_message
FROM v_base b LEFT JOIN v_sentiment s USING (customer_id) LEFT JOIN v_summary r USING (customer_id)
LEFT JOIN (SELECT * FROM v_recommendations WHERE action_rank = 1) n USING (customer_id)
LEFT JOIN v_evidence e USING (customer_id)
""")
