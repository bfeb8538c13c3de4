"""The same results in DuckDB SQL, each written from the definition, not from the Spark plan."""

from __future__ import annotations

from tonetape.operators.thresholds import THRESHOLDS
from tonetape.plans.stand_ins import EVENT_KINDS, PRICE_SCALE, PRIORITIES, SCORE_SCALE

_SUMS = ", ".join(f"count(*) FILTER (WHERE event_type = '{e}') AS event_{e}_count" for e in EVENT_KINDS)
_EVENTS = f"""events_in AS (
  SELECT *, ("value" - 20.0::DOUBLE) / {SCORE_SCALE}::DOUBLE AS score,
         epoch_us(ts) % 86400000000 AS tod
  FROM events)"""
_MEAN = "round(avg(score), 9) AS sentiment_mean, count(score) AS sentiment_count"
_DAY = "TIMESTAMP '2024-01-05'"


def _lookback(ticker: str) -> str:
    return f"""
WITH {_EVENTS},
anchors AS (SELECT 52200000000 + i * 3600000000 AS a FROM range(7) t(i)),
near AS (SELECT a, CAST({ticker} AS VARCHAR) AS "Ticker", score, event_type
         FROM events_in JOIN anchors ON tod <= a AND tod >= a - 36000000000),
often AS (SELECT a, "Ticker" FROM near GROUP BY ALL HAVING count(*) >= 5)
SELECT "Ticker", {_MEAN}, {_SUMS}, strftime({_DAY} + to_microseconds(a), '%Y%m%d-%H:%M:%S') AS "TimeStamp"
FROM near SEMI JOIN often USING (a, "Ticker") GROUP BY a, "Ticker"
"""


_SHARES = """shares AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, l_partkey, l_suppkey,
         l_shipdate + to_seconds(CAST(9 * 3600 + l_linenumber * 5820 + l_quantity AS BIGINT)) AS stamp
  FROM lineitem),
companies AS (
  SELECT *, CAST(l_quantity AS INTEGER) AS n, 'P' || l_partkey || '.N' AS ric, 'P' || l_partkey AS tick,
         l_discount AS score, CAST(l_discount AS VARCHAR) AS score_text
  FROM shares WHERE l_returnflag <> 'N'
  UNION ALL
  SELECT *, 1, CASE WHEN l_linestatus <> 'F' THEN 'S' || l_suppkey || '.OQ' END,
         CASE WHEN l_linestatus <> 'F' THEN 'S' || l_suppkey END,
         CASE WHEN l_tax <> 0 THEN l_tax END, CASE WHEN l_tax = 0 THEN 'n/a' ELSE CAST(l_tax AS VARCHAR) END
  FROM shares WHERE l_returnflag <> 'N')"""

_PAGES = f"""pages_in AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host,
         CASE WHEN NOT contains(url, '?') THEN length(html)::DOUBLE / {SCORE_SCALE}::DOUBLE END AS score
  FROM pages),
parts AS (
  SELECT *, CASE WHEN len(string_split(host, '.')) >= 3 THEN string_split(host, '.')[-3] END AS label FROM pages_in)"""

_SENTIMENT = f"""sentiment AS (
  SELECT o_orderdate AS "Time", o_orderpriority AS "Ticker",
         avg(o_totalprice / {PRICE_SCALE}::DOUBLE) AS sentiment_mean,
         stddev_samp(o_totalprice / {PRICE_SCALE}::DOUBLE) AS sentiment_std,
         count(*) AS sentiment_count,
         count(*) FILTER (WHERE o_orderstatus = 'O') AS event_share_count,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS event_click_count
  FROM orders GROUP BY 1, 2)"""

_RETURNS = f"""prices AS (
  SELECT l_shipdate AS "Time", o_orderpriority AS "Ticker", avg(l_extendedprice) AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
grid AS (
  SELECT t."Time", k."Ticker", price
  FROM (SELECT DISTINCT "Time" FROM prices) t
  CROSS JOIN (SELECT unnest({list(PRIORITIES)}) AS "Ticker") k
  LEFT JOIN prices p ON p."Time" = t."Time" AND p."Ticker" = k."Ticker"),
filled AS (
  SELECT "Time", "Ticker", last_value(price IGNORE NULLS) OVER (
    PARTITION BY "Ticker" ORDER BY "Time" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p
  FROM grid),
"returns" AS (
  SELECT "Time", "Ticker", p / nullif(lag(p, 4) OVER (PARTITION BY "Ticker" ORDER BY "Time"), 0) - 1 AS r
  FROM filled)"""

_ROLLED = """times AS (SELECT t FROM (SELECT DISTINCT "Time" AS t FROM sentiment) ORDER BY t OFFSET 40),
near AS (SELECT t, s.* FROM times JOIN sentiment s ON s."Time" > t - INTERVAL 10 DAY AND s."Time" <= t),
rolled AS (
  SELECT t AS "Time", "Ticker", sum(sentiment_mean * sentiment_count) / sum(sentiment_count) AS sentiment_mean,
    coalesce(sum(sentiment_std * sentiment_std * sentiment_count * sentiment_count), 0)
      / sum(sentiment_count * sentiment_count) AS sentiment_std,
    CAST(sum(sentiment_count) AS BIGINT) AS sentiment_count,
    CAST(sum(event_share_count) AS BIGINT) AS event_share_count,
    CAST(sum(event_click_count) AS BIGINT) AS event_click_count
  FROM near GROUP BY t, "Ticker")"""


def _merged(source: str) -> str:
    return f"""merged AS (
  SELECT s.*, r AS "Return_h_60" FROM {source} s JOIN "returns" q ON q."Time" = s."Time" AND q."Ticker" = s."Ticker"
  WHERE r IS NOT NULL AND sentiment_std IS NOT NULL)"""


_SENTIMENT_COLUMNS = """"Time", "Ticker", round(sentiment_mean, 9) AS sentiment_mean,
  round(sentiment_std, 9) AS sentiment_std, sentiment_count, event_share_count, event_click_count"""

_SHIFTS = (4, 8, 12, 16)
_SHIFTED = f"""shifted AS (
  SELECT *, {", ".join(f'lag("Return_h_60", {k}) OVER w AS lag_{k}' for k in _SHIFTS)}, row_number() OVER w AS rn
  FROM merged WINDOW w AS (PARTITION BY "Ticker" ORDER BY "Time"))
SELECT {_SENTIMENT_COLUMNS}, round("Return_h_60", 9) AS "Return_h_60",
  {", ".join(f"round(lag_{k}, 9) AS lag_{k}" for k in _SHIFTS)},
  {", ".join(f'round("Return_h_60" - lag_{k}, 9) AS delta{k}' for k in _SHIFTS)},
  "Return_h_60" > 0 AS return_sign
FROM shifted WHERE rn > 32"""

_VECTOR_COLUMNS = (
    *("doc_id", "chars", "words", "lines", "chars_per_word"),
    *("Label", "ROE_excess_change", "ROE_change"),
)
_VECTORS = """vectors AS (
  SELECT doc_id, n_chars::DOUBLE AS chars, len(string_split(text, ' '))::DOUBLE AS words,
         len(string_split(text, chr(10)))::DOUBLE AS lines,
         n_chars::DOUBLE / len(string_split(text, ' ')) AS chars_per_word,
         CASE WHEN toxic = 1 THEN 2 ELSE quality END AS "Label",
         n_chars::DOUBLE - 1000 AS "ROE_excess_change",
         len(string_split(text, ' '))::DOUBLE - 200 AS "ROE_change"
  FROM documents LEFT JOIN labels USING (doc_id))"""

_SCORED = """base AS (
  SELECT event_type AS model, "value" AS v, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
  FROM events),
scored AS (
  SELECT model, k > 60 OR model IN ('click', 'purchase') AS truth,
         (k / 100.0::DOUBLE + v / (v + 20.0::DOUBLE)) / 2 AS p1,
         1 - (k / 100.0::DOUBLE + v / (v + 20.0::DOUBLE)) / 2 AS p0 FROM base),
preds AS (SELECT *, p1 > p0 AS positive, CASE WHEN p1 > p0 THEN p1 ELSE p0 END AS conf FROM scored)"""
_CELLS = """count(*) FILTER (WHERE conf >= t AND positive AND truth) AS tp,
  count(*) FILTER (WHERE conf >= t AND positive AND NOT truth) AS fp,
  count(*) FILTER (WHERE conf >= t AND NOT positive AND NOT truth) AS tn,
  count(*) FILTER (WHERE conf >= t AND NOT positive AND truth) AS fn,
  count(*) AS n, count(*) FILTER (WHERE positive) AS n_pos, count(*) FILTER (WHERE NOT positive) AS n_neg"""
_STEPS = "steps AS (SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in THRESHOLDS) + "]) AS t)"
_AUC = """round(CASE WHEN tp + fp + tn + fn = 0 THEN 1.0::DOUBLE
  ELSE (tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2 END, 9) AS auc"""


def _spot(key: str, seed: int) -> str:
    """52 bits of the MD5 of seed and key."""
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT"


def _fold(key: str, folds: int, seed: int = 1) -> str:
    return f"""((row_number() OVER (PARTITION BY "Label" ORDER BY {_spot(key, seed)}, {key}) - 1) % {folds})::INTEGER"""


def _share(top: str, bottom: str, name: str) -> str:
    return f"round(({top})::DOUBLE / nullif({bottom}, 0), 9) AS {name}"


SQL: dict[str, str] = {
    "bin_end_summary": f"""
WITH {_EVENTS}
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS "TimeInterval",
       event_type AS "Ticker", {_MEAN}, round(stddev_samp(score), 9) AS sentiment_std, {_SUMS}
FROM events_in GROUP BY 1, 2 HAVING count(score) >= 5
""",
    "bin_start_day_summary": f"""
WITH {_EVENTS},
bins AS (SELECT i, {_DAY} + to_hours(2 * i) AS b FROM range(12) t(i))
SELECT event_type AS "Ticker", {_MEAN}, {_SUMS}, strftime(b, '%Y%m%d-%H:%M:%S') AS "TimeStamp"
FROM events_in JOIN bins ON ts >= b AND (ts < b + INTERVAL 2 HOUR OR i = 11)
GROUP BY b, event_type HAVING count(score) >= 5
""",
    "bin_time_of_day_summary": f"""
WITH {_EVENTS},
bins AS (SELECT i * 1800000000 AS b FROM range(48) t(i))
SELECT event_type AS "Ticker", {_MEAN}, {_SUMS}, strftime({_DAY} + to_microseconds(b), '%Y%m%d-%H:%M:%S') AS "TimeStamp"
FROM events_in JOIN bins ON tod >= b AND tod < b + 1800000000
GROUP BY b, event_type HAVING count(score) >= 5
""",
    "lookback_anchor_summary": _lookback("event_type"),
    "lookback_two_pass": _lookback("user_id"),
    "rolling_weighted_sentiment": f"""
WITH {_SENTIMENT},
{_ROLLED}
SELECT {_SENTIMENT_COLUMNS}, round(sqrt(sentiment_std), 9) AS sentiment_std_root FROM rolled
""",
    "explode_companies": f"""
WITH {_SHARES}
SELECT l_orderkey, l_linenumber, n AS company_count, score AS company_sentiment_score, tick AS "Ticker"
FROM companies WHERE tick IS NOT NULL AND score IS NOT NULL
""",
    "slim_projection": f"""
WITH {_SHARES}
SELECT strftime(stamp, '%Y-%m-%dT%H:%M:%S.000Z') AS "standardTimestamp",
       score_text AS company_sentiment_score, ric AS company_ric
FROM companies WHERE ric IS NOT NULL AND score_text IS NOT NULL
""",
    "useful_fraction": """
SELECT count(*) AS events, count(*) FILTER (WHERE l_returnflag <> 'N') AS useful_events,
       round(avg(CASE WHEN l_returnflag <> 'N' THEN 1.0::DOUBLE ELSE 0 END), 9) AS useful_fraction
FROM lineitem
""",
    "ticker_semi_join": """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS "Ticker" FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""",
    "event_dummies": """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END AS is_event_pview,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_event_click,
  0 AS is_event_search, 0 AS is_event_share,
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS "is_device_Personal_computer",
  CASE WHEN l_linestatus <> 'F' THEN 1 ELSE 0 END AS "is_device_Tablet",
  0 AS "is_device_Smartphone"
FROM lineitem
""",
    "top_domain_dummies": f"""
WITH {_PAGES},
hosts AS (SELECT host, label, count(*) AS c FROM parts GROUP BY ALL),
top AS (
  SELECT label, max(c) AS best FROM hosts WHERE label IS NOT NULL GROUP BY label ORDER BY best DESC, label LIMIT 10)
SELECT 'is_domain_' || label AS dummy, count(*) AS pages FROM parts JOIN top USING (label) GROUP BY label
""",
    "top_domains_natural_order": f"""
WITH {_PAGES},
last AS (SELECT host, label FROM parts GROUP BY ALL ORDER BY host DESC LIMIT 20)
SELECT label, max(host) AS "domain" FROM last WHERE label IS NOT NULL GROUP BY label
""",
    "top_domains_by_summary": """
SELECT 'www.s' || l_suppkey || '.org' AS "refDomain", count(*) AS "count" FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100
""",
    "json_flatten": """
SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events
""",
    "timestamp_forms": """
SELECT event_id, date_trunc('minute', ts) AS "minute",
       date_trunc('second', ts) + INTERVAL 8 HOUR AS from_los_angeles,
       date_trunc('second', ts) AS "second", CAST(hour(ts) AS INTEGER) AS "hour"
FROM events
""",
    "weekday_scan": """
SELECT strftime(ts, '%Y%m%d') AS "day", count(*) AS "rows" FROM events WHERE isodow(ts) < 6 GROUP BY 1
""",
    "local_clean": f"""
WITH {_SHARES}
SELECT l_orderkey, l_linenumber, n::DOUBLE AS companies_count, ric AS companies_ric,
       l_returnflag AS companies_sentiment, score AS companies_sentiment_score,
       (stamp AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'UTC' AS "standardTimestamp",
       'www.s' || l_suppkey || '.example.org' AS "domain"
FROM companies WHERE ric IS NOT NULL
""",
    "domain_summary": f"""
WITH {_PAGES}
SELECT host AS "refDomain", round(avg(score), 9) AS ave_sentiment_score, count(*) AS "count"
FROM parts GROUP BY host ORDER BY count(*) DESC, host LIMIT 15
""",
    "ticker_summary": f"""
WITH {_SHARES}
SELECT ric AS companies_ric, round(avg(score), 9) AS ave_sentiment_score, count(*) AS "count"
FROM companies WHERE ric IS NOT NULL GROUP BY ric
""",
    "counts_by_user": 'SELECT user_id, count(*) AS "count" FROM events GROUP BY user_id',
    "hour_histogram": 'SELECT CAST(hour(ts) AS INTEGER) AS "Hour", count(*) AS "count" FROM events GROUP BY 1',
    "distinct_keys": "SELECT DISTINCT o_orderdate, o_orderpriority FROM orders",
    "label_ratio": f"""
WITH {_SCORED}
SELECT model, count(*) AS "rows", round(avg(CASE WHEN truth THEN 1.0::DOUBLE ELSE 0 END), 9) AS positive_ratio
FROM preds GROUP BY model
""",
    "pair_profile": f"""
WITH pairs AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_open, l_extendedprice / {PRICE_SCALE}::DOUBLE AS price
  FROM lineitem)
SELECT is_open, count(price) AS n, round(avg(price), 9) AS y_mean, round(min(price), 9) AS y_min,
       round(max(price), 9) AS y_max, round((SELECT corr(is_open, price) FROM pairs), 9) AS corr_xy
FROM pairs GROUP BY is_open
""",
    "labelled_events": """
WITH stock AS (
  SELECT l_shipdate AS t, l_linestatus AS k,
         (sum(CAST(round(l_tax * 100) AS BIGINT)) - sum(CAST(round(l_discount * 100) AS BIGINT)))::DOUBLE / 100 AS r
  FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, o_orderdate AS "TimeStamp", o_orderstatus AS "Ticker", round(r, 9) AS "Return",
       CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "Label"
FROM orders LEFT JOIN stock ON t = o_orderdate AND k = o_orderstatus WHERE r IS NOT NULL
""",
    "labelled_returns": f"""
WITH {_SHARES},
clean AS (SELECT *, date_trunc('minute', stamp) AS t FROM companies WHERE tick IS NOT NULL AND score IS NOT NULL),
stock AS (
  SELECT t, tick, (sum(CAST(round(score * 100) AS BIGINT)) - 4)::DOUBLE / 100 AS r
  FROM clean WHERE tick LIKE 'S%' GROUP BY ALL),
listed AS (SELECT * FROM clean WHERE tick IN (SELECT tick FROM stock)),
top AS (SELECT l_suppkey FROM listed GROUP BY l_suppkey ORDER BY count(*) DESC, 's' || l_suppkey LIMIT 20)
SELECT n AS company_count, score AS company_sentiment_score, tick AS "Ticker", t AS "TimeStamp",
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS "is_device_Personal_computer",
  CASE WHEN l_linestatus <> 'F' THEN 1 ELSE 0 END AS "is_device_Tablet",
  0 AS "is_device_Smartphone",
  CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END AS is_event_pview,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_event_click,
  0 AS is_event_search, 0 AS is_event_share,
  CASE WHEN l_suppkey IN (SELECT l_suppkey FROM top) THEN 1 ELSE 0 END AS domain_flags,
  round(r, 9) AS "Return", CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "Label"
FROM listed JOIN stock USING (t, tick)
""",
    "panel_returns": f"""
WITH {_RETURNS}
SELECT "Time", "Ticker", round(r, 9) AS "Return_h_60" FROM "returns"
""",
    "merged_returns": f"""
WITH {_SENTIMENT}, {_RETURNS}, {_merged("sentiment")}
SELECT {_SENTIMENT_COLUMNS}, round("Return_h_60", 9) AS "Return_h_60" FROM merged
""",
    "lag_delta_features": f"""
WITH {_SENTIMENT}, {_RETURNS}, {_merged("sentiment")}, {_SHIFTED}
""",
    "model_rows": f"""
WITH {_SENTIMENT}, {_ROLLED}, {_RETURNS}, {_merged("rolled")}, {_SHIFTED}
""",
    "union_fill_missing": """
SELECT c_custkey AS id, c_name AS "name", c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier
""",
    "model_frame_clean": f"""
WITH {_VECTORS}
SELECT doc_id, chars, words, lines, round(chars_per_word, 9) AS chars_per_word,
       "ROE_change" > 0 AS "ROE_change_sign", "ROE_excess_change" > 0 AS "ROE_excess_change_sign", "Label"
FROM vectors WHERE "Label" IS NOT NULL AND "Label" <> 2
""",
    "null_report": f"""
WITH {_VECTORS}
SELECT {", ".join(f'count(*) - count("{c}") AS "{c}"' for c in _VECTOR_COLUMNS)}
FROM vectors
""",
    "hash_split": f"""
WITH spots AS (SELECT o_orderkey, o_totalprice, {_spot("o_orderkey", 1014)} / 4503599627370496.0::DOUBLE AS spot FROM orders)
SELECT o_orderkey, round(o_totalprice, 9) AS o_totalprice,
       CASE WHEN spot < 1.0::DOUBLE - 0.7::DOUBLE - 0.1::DOUBLE THEN 'test' WHEN spot < 1.0::DOUBLE - 0.7::DOUBLE THEN 'valid' ELSE 'train' END AS split
FROM spots
""",
    "shuffled_split": f"""
SELECT o_orderkey, round(o_totalprice, 9) AS o_totalprice,
       row_number() OVER (ORDER BY {_spot("o_orderkey", 1)}, o_orderkey) <= floor(count(*) OVER () * 0.1::DOUBLE) AS is_test
FROM orders
""",
    "stratified_folds": f"""
WITH {_VECTORS}
SELECT doc_id, "Label", {_fold("doc_id", 5)} AS fold FROM vectors
""",
    "probability_auc_by_model": f"""
WITH {_SCORED},
ranked AS (
  SELECT model, truth, rank() OVER (PARTITION BY model ORDER BY p1)
         + (count(*) OVER (PARTITION BY model, p1) - 1) / 2.0::DOUBLE AS r FROM preds),
sums AS (
  SELECT model, sum(r) FILTER (WHERE truth) AS s, count(*) FILTER (WHERE truth) AS n_pos, count(*) FILTER (WHERE NOT truth) AS n_neg
  FROM ranked GROUP BY model)
SELECT model, round((s - n_pos * (n_pos + 1) / 2.0::DOUBLE) / nullif(n_pos::DOUBLE * n_neg, 0), 9) AS auc, n_pos, n_neg FROM sums
""",
    "learner_facts": f"""
WITH {_VECTORS},
spots AS (SELECT doc_id, "Label", {_spot("doc_id", 1014)} / 4503599627370496.0::DOUBLE AS spot FROM vectors
  WHERE "Label" IS NOT NULL AND "Label" <> 2)
SELECT learner, doc_id, "Label"::DOUBLE AS label, true AS sums_to_one, true AS takes_larger, true AS same_auc
FROM spots CROSS JOIN (SELECT unnest(['forest', 'boosted_trees']) AS learner) WHERE spot < 1.0::DOUBLE - 0.8::DOUBLE
""",
    "fold_predictions": f"""
WITH {_VECTORS},
folded AS (SELECT doc_id, "Label"::DOUBLE AS label, {_fold("doc_id", 3)} AS fold FROM vectors WHERE "Label" IS NOT NULL AND "Label" <> 2)
SELECT setting, fold, doc_id, label, true AS is_probability FROM folded CROSS JOIN (SELECT unnest([0, 1])::INTEGER AS setting)
""",
    "chronological_split": """
SELECT o_orderdate AS "Time", o_orderkey, round(o_totalprice, 9) AS o_totalprice,
       row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(count(*) OVER () * 0.8::DOUBLE) AS is_train
FROM orders
""",
    "split_ranges": f"""
WITH {_SENTIMENT}, {_RETURNS}, {_merged("sentiment")},
split AS (
  SELECT "Time", row_number() OVER (ORDER BY "Time", "Ticker") <= floor(count(*) OVER () * 0.8::DOUBLE) AS is_train
  FROM merged)
SELECT is_train, min("Time") AS first_time, max("Time") AS last_time, count(*) AS "rows" FROM split GROUP BY is_train
""",
    "confident_auc": f"""
WITH {_SCORED}, cells AS (SELECT {_CELLS} FROM preds CROSS JOIN (SELECT 0.6::DOUBLE AS t))
SELECT 0.6::DOUBLE AS threshold, {_AUC}, {_share("tp + fp + tn + fn", "n", "kept_share")} FROM cells
""",
    "threshold_sweep": f"""
WITH {_SCORED}, {_STEPS}, cells AS (SELECT t, {_CELLS} FROM preds CROSS JOIN steps GROUP BY t)
SELECT round(t, 9) AS threshold,
  {_share("tp + tn", "tp + fp + tn + fn", "accuracy")}, {_share("tp", "tp + fp", "accuracy_pos")},
  {_share("tn", "tn + fn", "accuracy_neg")}, {_share("tp + fp + tn + fn", "n", "kept")},
  {_share("tp + fp", "n_pos", "kept_pos")}, {_share("tn + fn", "n_neg", "kept_neg")}
FROM cells
""",
    "accuracy_at_thresholds": f"""
WITH {_SCORED},
kept AS (
  SELECT *, positive = truth AS hit FROM preds
  WHERE conf >= CASE WHEN positive THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END)
SELECT round(avg(hit::INTEGER), 9) AS accuracy, count(*) AS counts,
       round(avg(hit::INTEGER) FILTER (WHERE positive), 9) AS accuracy_pos,
       round(avg(hit::INTEGER) FILTER (WHERE NOT positive), 9) AS accuracy_neg
FROM kept
""",
    "model_threshold_curves": f"""
WITH {_SCORED}, {_STEPS}, cells AS (SELECT model, t, {_CELLS} FROM preds CROSS JOIN steps GROUP BY model, t)
SELECT model, round(t, 9) AS threshold, {_AUC}, {_share("tp + fp + tn + fn", "n", "kept_share")} FROM cells
""",
    "confidence_histogram": f"""
WITH {_SCORED},
ends AS (
  SELECT positive, min(conf) AS lo, max(conf) AS hi, (max(conf) - min(conf)) / 10 AS step
  FROM preds GROUP BY positive),
grid AS (SELECT positive, i, lo + i * step AS a, CASE WHEN i = 9 THEN hi ELSE lo + (i + 1) * step END AS b
         FROM ends CROSS JOIN range(10) t(i))
SELECT CAST(g.positive AS INTEGER) AS predicted, CAST(i AS INTEGER) AS bin, round(a, 9) AS bin_low,
       round(b, 9) AS bin_high, count(conf) AS "count"
FROM grid g LEFT JOIN preds p ON p.positive = g.positive AND conf >= a AND (conf < b OR i = 9)
GROUP BY g.positive, i, a, b
""",
    "jsonl_roundtrip": f"""
WITH {_SHARES}
SELECT n AS company_count, score AS company_sentiment_score, tick AS "Ticker",
  CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END AS is_event_pview,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_event_click,
  0 AS is_event_search, 0 AS is_event_share, date_trunc('minute', stamp) AS "TimeStamp"
FROM companies WHERE tick IS NOT NULL AND score IS NOT NULL
""",
    "csv_roundtrip": f"WITH {_SENTIMENT} SELECT {_SENTIMENT_COLUMNS} FROM sentiment",
    "parquet_roundtrip": """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 9) AS o_totalprice, o_orderdate, o_orderpriority
FROM orders
""",
    "day_folders": """
WITH logs AS (
  SELECT ts::DATE AS day, day(ts) AS d, hour(ts) AS h, event_type, "value" AS score, event_id,
         time_bucket(INTERVAL 6 HOUR, date_trunc('minute', ts), TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS "TimeInterval"
  FROM events WHERE isodow(ts::DATE) < 6),
left_over AS (SELECT * FROM logs WHERE d <> 16 AND (d % 2 = 1 OR h < 12)),
told AS (SELECT day, CASE WHEN d = 15 THEN 0 ELSE count(*) END AS rows_read, d = 15 AS has_failed FROM left_over GROUP BY day, d)
SELECT day, "TimeInterval", event_type AS "Ticker", round(avg(score), 9) AS sentiment_mean, count(score) AS sentiment_count,
       rows_read, has_failed
FROM left_over JOIN told USING (day) WHERE event_type <> 'signup'
GROUP BY day, "TimeInterval", event_type, rows_read, has_failed HAVING count(score) >= 5
""",
    "manifest_clean": """
SELECT source, event_id::VARCHAR AS stid, event_type || '.N' AS companies_ric, round("value", 9) AS companies_sentiment_score,
       'u' || user_id || '.example.org' AS domain
FROM (SELECT event_type AS source, * FROM events UNION ALL SELECT 'twice', * FROM events WHERE event_type = 'click')
""",
    "stored_inputs": """
WITH sums AS (
  SELECT l_shipdate, l_linestatus,
         sum(CAST(round(l_tax * 100) AS BIGINT)) - sum(CAST(round(l_discount * 100) AS BIGINT)) AS cents
  FROM lineitem GROUP BY ALL)
SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS "Lagged_Time", l_linestatus AS "Ticker", (cents::DOUBLE / 100)::VARCHAR AS "Return"
FROM sums WHERE l_linestatus IN (SELECT o_orderstatus FROM orders)
""",
    "text_lines": f"""
WITH {_VECTORS} SELECT doc_id || ',' || coalesce(CAST("Label" AS VARCHAR), 'None') AS line FROM vectors
""",
}
SQL["rolled_step_by_step"] = SQL["rolling_weighted_sentiment"]


def _later_fifth(chain: str, time: str, label: str) -> str:
    return f"""
SELECT "{time}", "Ticker", label, true AS sums_to_one, true AS takes_larger, true AS same_auc
FROM (SELECT "{time}", "Ticker", {label} AS label,
        row_number() OVER (ORDER BY "{time}", "Ticker") > floor(count(*) OVER () * 0.8::DOUBLE) AS late
      FROM ({SQL[chain]}))
WHERE late
"""


SQL["event_return_chain"] = _later_fifth("labelled_returns", "TimeStamp", '"Label"')
SQL["sentiment_return_chain"] = _later_fifth("model_rows", "Time", "return_sign::INTEGER::DOUBLE")
