"""DuckDB SQL for every registered query that SQL can express, over the whole tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

DAY = "86400000000.0"


def days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / {DAY}) AS BIGINT)"


def r(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) AS {name or expression}"


CTE = {
    "demo": """
        SELECT CAST(c_custkey AS VARCHAR) AS CustomerID, c_mktsegment, r_name,
               CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 3000 THEN 'Low'
                    WHEN c_acctbal < 7000 THEN 'Medium' ELSE 'High' END AS IncomeLevel
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "tx": """
        SELECT CAST(o_custkey AS VARCHAR) AS CustomerID, o_orderkey AS TransactionID, o_orderdate AS TransactionDate,
               o_totalprice AS AmountSpent, o_orderstatus AS ProductCategory
        FROM orders WHERE o_orderdate < TIMESTAMP '2001-02-02'""",
    "svc": """
        SELECT CAST(o_custkey AS VARCHAR) AS CustomerID, concat(l_orderkey, '-', l_linenumber) AS InteractionID,
               l_shipdate AS InteractionDate,
               CASE l_returnflag WHEN 'R' THEN 'Complaint' WHEN 'A' THEN 'Inquiry' WHEN 'N' THEN 'Feedback' END AS InteractionType,
               CASE WHEN l_linestatus = 'F' THEN 'Resolved' WHEN l_quantity > 45 THEN NULL ELSE 'Unresolved' END AS ResolutionStatus
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < TIMESTAMP '2001-02-02'""",
    "online": """
        SELECT CAST(user_id AS VARCHAR) AS CustomerID,
               max(ts) - to_days(CAST(8398 + 15 * (user_id % 12) AS INTEGER)) AS LastLoginDate,
               CAST(count(*) AS DOUBLE) AS LoginFrequency, arg_max(event_type, (ts, event_id)) AS ServiceUsage
        FROM events GROUP BY user_id""",
    "churn": """
        SELECT CAST(c_custkey AS VARCHAR) AS CustomerID,
               CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-02-02')
                    THEN 0 ELSE 1 END AS ChurnStatus
        FROM customer""",
    "snap": """
        SELECT greatest((SELECT max(TransactionDate) FROM tx), (SELECT max(InteractionDate) FROM svc),
                        (SELECT max(LastLoginDate) FROM online)) AS snapshot_ts""",
    "tx_gaps": f"""
        SELECT CustomerID, {days("TransactionDate", "lag(TransactionDate) OVER (PARTITION BY CustomerID ORDER BY TransactionDate)")} AS gap
        FROM tx""",
    "tx_agg": f"""
        SELECT CustomerID, count(TransactionID) AS txn_count, coalesce(sum(AmountSpent), 0.0) AS amount_sum,
               avg(AmountSpent) AS amount_mean, stddev_samp(AmountSpent) AS amount_std,
               min(TransactionDate) AS first_txn_dt, max(TransactionDate) AS last_txn_dt,
               count(DISTINCT ProductCategory) AS product_cat_nunique,
               {days("(SELECT snapshot_ts FROM snap)", "max(TransactionDate)")} AS tx_recency_days,
               (SELECT avg(gap) FROM tx_gaps g WHERE g.CustomerID = tx.CustomerID) AS tx_avg_gap_days,
               count(DISTINCT date_trunc('month', TransactionDate)) AS active_months
        FROM tx GROUP BY CustomerID""",
    "svc_agg": f"""
        SELECT CustomerID, count(InteractionID) AS cs_count, count(DISTINCT InteractionType) AS cs_types_nunique,
               max(InteractionDate) AS last_cs_dt,
               count(*) FILTER (WHERE lower(ResolutionStatus) IS DISTINCT FROM 'resolved') AS unresolved_count,
               count(*) FILTER (WHERE lower(InteractionType) = 'complaint') AS complaint_count,
               {days("(SELECT snapshot_ts FROM snap)", "max(InteractionDate)")} AS cs_recency_days
        FROM svc GROUP BY CustomerID""",
    "joined": f"""
        SELECT d.CustomerID, c_mktsegment, r_name, IncomeLevel, ChurnStatus, LastLoginDate, LoginFrequency, ServiceUsage,
               {days("(SELECT snapshot_ts FROM snap)", "LastLoginDate")} AS lastlogin_recency_days,
               t.* EXCLUDE (CustomerID), s.* EXCLUDE (CustomerID)
        FROM demo d JOIN churn c ON d.CustomerID = c.CustomerID LEFT JOIN online o ON d.CustomerID = o.CustomerID
             LEFT JOIN tx_agg t ON d.CustomerID = t.CustomerID LEFT JOIN svc_agg s ON d.CustomerID = s.CustomerID""",
    "features": """
        SELECT CustomerID, c_mktsegment, r_name, IncomeLevel, ChurnStatus, LastLoginDate, LoginFrequency, ServiceUsage,
               coalesce(lastlogin_recency_days, (SELECT max(lastlogin_recency_days) + 1 FROM joined)) AS lastlogin_recency_days,
               coalesce(txn_count, 0) AS txn_count, amount_sum, amount_mean, amount_std, first_txn_dt, last_txn_dt,
               coalesce(product_cat_nunique, 0) AS product_cat_nunique,
               coalesce(tx_recency_days, (SELECT max(tx_recency_days) + 1 FROM joined)) AS tx_recency_days,
               tx_avg_gap_days, coalesce(active_months, 0) AS active_months, coalesce(cs_count, 0) AS cs_count,
               coalesce(cs_types_nunique, 0) AS cs_types_nunique, last_cs_dt,
               coalesce(unresolved_count, 0) AS unresolved_count, coalesce(complaint_count, 0) AS complaint_count,
               coalesce(cs_recency_days, (SELECT max(cs_recency_days) + 1 FROM joined)) AS cs_recency_days,
               CASE WHEN txn_count IS NULL THEN 0 ELSE 1 END AS had_tx,
               CASE WHEN cs_count IS NULL THEN 0 ELSE 1 END AS had_service
        FROM joined""",
    "tx_windows": """
        SELECT CustomerID,
               count(*) FILTER (WHERE TransactionDate >= (SELECT snapshot_ts FROM snap) - INTERVAL 30 DAY) AS tx_30,
               count(*) FILTER (WHERE TransactionDate >= (SELECT snapshot_ts FROM snap) - INTERVAL 60 DAY) AS tx_60,
               count(*) AS tx_90,
               coalesce(sum(AmountSpent) FILTER (WHERE TransactionDate >= (SELECT snapshot_ts FROM snap) - INTERVAL 30 DAY), 0.0) AS amt_30,
               coalesce(sum(AmountSpent), 0.0) AS amt_90
        FROM (SELECT DISTINCT * FROM tx) u WHERE TransactionDate >= (SELECT snapshot_ts FROM snap) - INTERVAL 90 DAY
        GROUP BY CustomerID""",
    "svc_windows": """
        SELECT CustomerID, count(*) FILTER (WHERE lower(InteractionType) = 'complaint') AS complaints_90d,
               count(*) FILTER (WHERE lower(ResolutionStatus) IS DISTINCT FROM 'resolved') AS unresolved_90d
        FROM (SELECT DISTINCT * FROM svc) u WHERE InteractionDate >= (SELECT snapshot_ts FROM snap) - INTERVAL 90 DAY
        GROUP BY CustomerID""",
    "caps": """
        SELECT quantile_cont(amount_sum, 0.99) AS q_sum, quantile_cont(amount_mean, 0.99) AS q_mean,
               quantile_cont(amount_std, 0.99) AS q_std, quantile_cont(tx_avg_gap_days, 0.5) AS med_gap
        FROM joined""",
    "capped": """
        SELECT CustomerID, CASE WHEN amount_sum > q_sum THEN q_sum ELSE amount_sum END AS amount_sum,
               CASE WHEN amount_mean > q_mean THEN q_mean ELSE amount_mean END AS amount_mean,
               CASE WHEN amount_std > q_std THEN q_std ELSE amount_std END AS amount_std,
               coalesce(tx_avg_gap_days, med_gap) AS tx_avg_gap_days
        FROM joined CROSS JOIN caps""",
    "scored": """
        SELECT CustomerID, ChurnStatus AS label,
               (CAST(tx_recency_days AS DOUBLE) + 1) / (CAST(tx_recency_days AS DOUBLE) + 10 * cs_count + 1) AS score
        FROM features""",
    "points": """
        SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
        FROM scored GROUP BY score""",
    "curve": """
        SELECT threshold, pos, neg, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
               sum(pos) OVER () AS p_all, sum(neg) OVER () AS n_all
        FROM points""",
    "pr": """
        SELECT threshold, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision, CAST(tp AS DOUBLE) / CAST(p_all AS DOUBLE) AS recall
        FROM curve""",
}


def _needed(sql: str) -> list[str]:
    import re

    found: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTE[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def check(name: str, sql: str) -> None:
    parts = [f"{c} AS ({CTE[c].strip()}\n)" for c in _needed(sql)]
    ORACLE[name] = (f"WITH {', '.join(parts)}\n" if parts else "") + sql.strip()


PROFILE = ["txn_count", "product_cat_nunique", "active_months"]
FEATURES = [
    "CustomerID", "c_mktsegment", "r_name", "IncomeLevel", "ChurnStatus", "LastLoginDate", "LoginFrequency", "ServiceUsage",
    "lastlogin_recency_days", "txn_count", r("amount_sum"), r("amount_mean"), r("amount_std"), "first_txn_dt", "last_txn_dt",
    "product_cat_nunique", "tx_recency_days", r("tx_avg_gap_days"), "active_months", "cs_count", "cs_types_nunique",
    "last_cs_dt", "unresolved_count", "complaint_count", "cs_recency_days", "had_tx", "had_service",
]
NUMERIC = [
    "ChurnStatus", "LoginFrequency", "lastlogin_recency_days", "txn_count", "amount_sum", "amount_mean", "amount_std",
    "product_cat_nunique", "tx_recency_days", "tx_avg_gap_days", "active_months", "cs_count", "cs_types_nunique",
    "unresolved_count", "complaint_count", "cs_recency_days", "had_tx", "had_service",
]
JOINED = [f.split(" AS ")[-1] for f in FEATURES[:-2]]
CHANNELS = ["click", "error", "purchase", "signup", "view"]


def flags_of(prefix: str, column: str, levels: list[str]) -> list[str]:
    out = [f"CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS \"{prefix}_{v}\"" for v in levels]
    return [*out, f"CASE WHEN {column} IS NULL THEN 1 ELSE 0 END AS \"{prefix}_nan\""]


def missing(column: str, suffix: str = "_was_missing", source: str = "") -> str:
    return f"CASE WHEN {source}{column} IS NULL THEN 1 ELSE 0 END AS {column}{suffix}"


check("typed_tables", f"""
    SELECT 'orders' AS table_name, CAST(o_custkey AS VARCHAR) AS key, {r("o_totalprice", "number")}, o_orderdate AS event_time FROM orders
    UNION ALL
    SELECT 'customer', CAST(c_custkey AS VARCHAR), TRY_CAST(c_name AS DOUBLE), NULL FROM customer""")
check("coerced_text", f"""
    SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN round(o_totalprice, 6) END AS amount_text,
           CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END AS date_text FROM orders""")
check("written_features", f"SELECT {', '.join(FEATURES)} FROM features")
check("range_filter", f"""
    SELECT CustomerID, TransactionID, TransactionDate, {r("AmountSpent", "amount")} FROM tx
    WHERE TransactionDate >= (SELECT snapshot_ts FROM snap) - INTERVAL 1 YEAR""")
check("complete_rows", """
    SELECT CustomerID, IncomeLevel, ServiceUsage, txn_count, LoginFrequency FROM joined
    WHERE IncomeLevel IS NOT NULL AND ServiceUsage IS NOT NULL""")
check("status_flags", """
    SELECT InteractionType, ResolutionStatus, count(*) FILTER (WHERE lower(InteractionType) = 'complaint') AS n_complaints,
           count(*) FILTER (WHERE lower(ResolutionStatus) IS DISTINCT FROM 'resolved') AS n_unresolved, count(*) AS n
    FROM svc GROUP BY InteractionType, ResolutionStatus""")
check("numeric_columns", """
    SELECT ChurnStatus, count(*) AS n, sum(LoginFrequency) AS logins, CAST(sum(cs_count) AS BIGINT) AS contacts
    FROM joined GROUP BY ChurnStatus""")
check("collapsed_columns", "SELECT CustomerID, txn_count, greatest(cs_count, txn_count) AS events FROM joined")
check("scalar_functions", f"""
    SELECT TransactionID, lower(ProductCategory) AS category, {days("snapshot_ts", "TransactionDate")} AS age_days,
           {days("TransactionDate", "snapshot_ts")} AS age_days_back, CAST(date_trunc('month', TransactionDate) AS TIMESTAMP) AS month,
           CAST(date_trunc('week', TransactionDate) AS TIMESTAMP) AS week, TransactionDate - INTERVAL 30 DAY AS month_before,
           round(ln(1 + greatest(AmountSpent, 0)), 6) AS log_amount,
           round(least(greatest(AmountSpent, 1000), 100000), 6) AS clipped,
           CASE WHEN ProductCategory = 'P' THEN 1 ELSE 0 END AS no_category,
           CASE WHEN ProductCategory = 'F' THEN 0.0 ELSE round(AmountSpent / 4, 6) END AS ratio,
           CASE WHEN AmountSpent > 200000 THEN 1 ELSE 0 END AS large, round_even(AmountSpent, 0) AS whole_amount,
           round(abs(150000 - AmountSpent), 6) AS distance
    FROM tx CROSS JOIN snap""")
check("customer_base", """
    SELECT d.CustomerID, c_mktsegment, r_name, IncomeLevel, ChurnStatus, LastLoginDate, LoginFrequency, ServiceUsage
    FROM demo d JOIN churn c ON d.CustomerID = c.CustomerID LEFT JOIN online o ON d.CustomerID = o.CustomerID""")
check("global_scalars", """
    SELECT CustomerID, round(amount_sum / (SELECT max(amount_sum) FROM joined), 6) AS share_of_top,
           round(cs_count - (SELECT avg(cs_count) FROM joined), 6) AS over_mean FROM joined""")
check("snapshot_time", "SELECT snapshot_ts AS snapshot FROM snap")
check("tx_profile", f"""
    SELECT CustomerID, txn_count, {r("amount_sum")}, {r("amount_mean")}, {r("amount_std")}, first_txn_dt, last_txn_dt,
           product_cat_nunique, tx_recency_days, {r("tx_avg_gap_days")}, active_months FROM tx_agg""")
check("svc_profile", """
    SELECT CustomerID, cs_count, cs_types_nunique, last_cs_dt, unresolved_count, complaint_count, cs_recency_days FROM svc_agg""")
check("recency", "SELECT CustomerID, tx_recency_days, cs_recency_days, lastlogin_recency_days FROM joined")
check("active_months", """
    SELECT CustomerID, count(DISTINCT date_trunc('month', InteractionDate)) AS active_months FROM svc GROUP BY CustomerID""")
check("event_gaps", f"""
    SELECT CustomerID, InteractionDate, n_events,
           {days("InteractionDate", "lag(InteractionDate) OVER (PARTITION BY CustomerID ORDER BY InteractionDate)")} AS gap_days
    FROM (SELECT CustomerID, InteractionDate, count(*) AS n_events FROM svc GROUP BY CustomerID, InteractionDate) u""")
check("online_event_gaps", f"""
    SELECT CustomerID, ts, n_events, {days("ts", "lag(ts) OVER (PARTITION BY CustomerID ORDER BY ts)")} AS gap_days
    FROM (SELECT CAST(user_id AS VARCHAR) AS CustomerID, ts, count(*) AS n_events FROM events GROUP BY user_id, ts) u""")
check("event_number", """
    SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY InteractionDate NULLS LAST, InteractionID NULLS LAST,
           InteractionType NULLS LAST, ResolutionStatus NULLS LAST) AS event_no FROM (SELECT DISTINCT * FROM svc) u""")
check("tx_event_number", """
    SELECT CustomerID, TransactionID, TransactionDate, round(AmountSpent, 6) AS AmountSpent, ProductCategory,
           row_number() OVER (PARTITION BY CustomerID ORDER BY TransactionDate NULLS LAST, TransactionID) AS event_no
    FROM (SELECT DISTINCT * FROM tx) u""")
check("trailing_windows", """
    SELECT CustomerID, tx_30, tx_60, tx_90, round(amt_30, 6) AS amt_30, round(amt_90, 6) AS amt_90, complaints_90d, unresolved_90d
    FROM tx_windows FULL JOIN svc_windows USING (CustomerID)""")
for query, table, ts in (("weekly_transactions", "tx", "TransactionDate"), ("weekly_interactions", "svc", "InteractionDate")):
    check(query, f"""
        SELECT week, n_events, CASE WHEN row_number() OVER (ORDER BY week) >= 4
               THEN round(avg(n_events) OVER (ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) END AS moving_mean
        FROM (SELECT CAST(date_trunc('week', {ts}) AS TIMESTAMP) AS week, count(*) AS n_events
              FROM (SELECT DISTINCT * FROM {table}) u GROUP BY 1) w""")
check("customer_features", f"SELECT {', '.join(FEATURES)} FROM features")
check("integrity", """
    SELECT 'one_row_per_customer' AS check_name, count(DISTINCT CustomerID) AS expected, count(*) AS actual,
           count(DISTINCT CustomerID) = count(*) AS ok FROM joined
    UNION ALL
    SELECT 'transactions_conserved', (SELECT count(*) FROM tx), CAST(sum(txn_count) AS BIGINT), (SELECT count(*) FROM tx) = sum(txn_count) FROM joined
    UNION ALL
    SELECT 'interactions_conserved', (SELECT count(*) FROM svc), CAST(sum(cs_count) AS BIGINT), (SELECT count(*) FROM svc) = sum(cs_count) FROM joined""")
check("dedupe", " UNION ALL ".join(f"""
    SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS rows_before, count(*) AS rows_after,
           (SELECT count(*) FROM {t}) - count(*) AS rows_removed FROM (SELECT DISTINCT * FROM {t}) u""" for t in ("tx", "svc")))
check("duplicate_ids", " UNION ALL ".join(f"""
    SELECT '{keys}' AS key_columns, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates
    FROM (SELECT count(*) AS n FROM {t} GROUP BY {keys}) u""" for t, keys in (
    ("tx", "TransactionID"), ("svc", "InteractionID"), ("tx", "CustomerID,TransactionID"), ("svc", "CustomerID,InteractionID"))))
MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share FROM joined" for c in JOINED)
check("missing_share", MISSING)
check("missing_share_top", f"SELECT * FROM ({MISSING}) u ORDER BY missing_share DESC, column_name LIMIT 8")
check("ranked_shares", f"""
    SELECT column_name AS feature, missing_share AS importance,
           CAST(row_number() OVER (ORDER BY missing_share DESC, column_name) AS INTEGER) AS rank
    FROM ({MISSING}) u QUALIFY rank <= 10""")
check("table_report", " UNION ALL ".join(f"""
    SELECT '{t}' AS table_name, count(*) AS n_rows, CAST({width} AS INTEGER) AS n_columns, count(DISTINCT CustomerID) AS n_keys,
           CAST({amount} AS BIGINT) AS n_nonpositive, CAST({future} AS BIGINT) AS n_future FROM {t}""" for t, width, amount, future in (
    ("demo", 4, "NULL", "NULL"),
    ("tx", 5, "count(*) FILTER (WHERE AmountSpent <= 0)", "count(*) FILTER (WHERE TransactionDate > TIMESTAMP '2001-01-15')"),
    ("svc", 5, "NULL", "count(*) FILTER (WHERE InteractionDate > TIMESTAMP '2001-01-15')"),
    ("online", 4, "NULL", "NULL"),
    ("churn", 2, "NULL", "NULL"))))
check("coverage", "SELECT had_tx, had_service, count(*) AS n FROM features GROUP BY had_tx, had_service")
check("value_counts", "SELECT InteractionType, ResolutionStatus, count(*) AS n FROM svc GROUP BY InteractionType, ResolutionStatus")
check("income_counts", "SELECT IncomeLevel, count(*) AS n FROM demo GROUP BY IncomeLevel")
check("fan_out", """
    SELECT round(avg(n), 6) AS mean_rows, max(n) AS max_rows FROM (SELECT count(*) AS n FROM svc GROUP BY CustomerID) u""")
check("valid_counts", "SELECT ChurnStatus, count(amount_std) AS n_valid FROM joined GROUP BY ChurnStatus")
check("global_stats", """
    SELECT CAST(round_even(avg(ChurnStatus), 3) AS DOUBLE) AS ChurnStatus_mean, CAST(sum(txn_count) AS BIGINT) AS txn_count_sum,
           CAST(sum(cs_count) AS BIGINT) AS cs_count_sum, max(cs_count) AS cs_count_max FROM features""")
check("exact_quantiles", """
    SELECT l_returnflag, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.01), 6) AS q01,
           round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.99), 6) AS q99
    FROM lineitem GROUP BY l_returnflag""")


def histogram(name: str, values: str, bins: int = 50) -> None:
    """``values`` gives x and its weight w."""
    check(name, f"""
    SELECT bin, round(lo + bin * step, 6) AS bin_start, round(lo + (bin + 1) * step, 6) AS bin_end, CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM (SELECT CAST(range AS BIGINT) AS bin FROM range({bins})) b
    CROSS JOIN (SELECT min(x) AS lo, (max(x) - min(x)) / {bins} AS step FROM ({values}) v) e
    LEFT JOIN (
        SELECT CASE WHEN x < lo + i * step THEN i - 1 WHEN x >= lo + (i + 1) * step AND i < {bins - 1} THEN i + 1 ELSE i END AS bin_of, sum(w) AS n
        FROM (SELECT x, w, lo, (hi - lo) / {bins} AS step, least(CAST(floor((x - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS i
              FROM ({values}) v CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM ({values}) v) e) g
        GROUP BY 1) c ON c.bin_of = b.bin""")


histogram("amount_histogram", "SELECT AmountSpent AS x, 1 AS w FROM (SELECT DISTINCT * FROM tx) u")
histogram("log_amount_histogram", "SELECT round(ln(1 + greatest(AmountSpent, 0)), 9) AS x, 1 AS w FROM (SELECT DISTINCT * FROM tx) u")
histogram("gap_histogram", f"""SELECT CAST(gap AS DOUBLE) AS x, 1 AS w FROM (
    SELECT {days("TransactionDate", "lag(TransactionDate) OVER (PARTITION BY CustomerID ORDER BY TransactionDate)")} AS gap
    FROM (SELECT DISTINCT * FROM tx) u) t WHERE gap IS NOT NULL""")

BOX = [
    "txn_count", "amount_sum", "amount_mean", "tx_recency_days", "active_months", "product_cat_nunique",
    "cs_count", "complaint_count", "unresolved_count", "cs_recency_days", "LoginFrequency", "lastlogin_recency_days",
]
LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, ChurnStatus, CAST({c} AS DOUBLE) AS value FROM features" for c in BOX)
check("box_summary", f"""
    SELECT feature, ChurnStatus, count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3,
           round(min(value) FILTER (WHERE inside), 6) AS whisker_low, round(max(value) FILTER (WHERE inside), 6) AS whisker_high,
           count(*) FILTER (WHERE NOT inside) AS n_outliers
    FROM (SELECT l.feature, l.ChurnStatus, value, q1, med, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
          FROM ({LONG}) l JOIN (
              SELECT feature, ChurnStatus, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3
              FROM ({LONG}) k WHERE value IS NOT NULL GROUP BY feature, ChurnStatus) q
          ON l.feature = q.feature AND l.ChurnStatus = q.ChurnStatus WHERE value IS NOT NULL) u
    GROUP BY feature, ChurnStatus""")
check("crosstab_share", """
    SELECT ServiceUsage, round(count(*) FILTER (WHERE ChurnStatus = 0) / count(*), 6) AS share_0,
           round(count(*) FILTER (WHERE ChurnStatus = 1) / count(*), 6) AS share_1
    FROM joined WHERE ServiceUsage IS NOT NULL GROUP BY ServiceUsage""")
check("top_customers", f"""
    SELECT CustomerID, {r("amount_sum")} FROM features WHERE amount_sum IS NOT NULL ORDER BY features.amount_sum DESC, CustomerID LIMIT 15""")
COUNTS = ["txn_count", "product_cat_nunique", "cs_count", "cs_types_nunique", "complaint_count", "unresolved_count", "active_months"]
check("fill_counts", f"SELECT CustomerID, {', '.join(COUNTS)} FROM features")
check("fill_recency", "SELECT CustomerID, tx_recency_days, cs_recency_days, lastlogin_recency_days FROM features")
check("missing_flags", f"SELECT CustomerID, {', '.join(missing(c) for c in NUMERIC)} FROM features")
check("winsorize", """
    SELECT CustomerID, round(amount_sum, 6) AS amount_sum, round(amount_mean, 6) AS amount_mean, round(amount_std, 6) AS amount_std,
           round(ln(1 + c.amount_sum), 6) AS log1p_amount_sum, round(ln(1 + c.amount_mean), 6) AS log1p_amount_mean
    FROM capped c""")
check("one_hot", f"""
    SELECT CustomerID, {', '.join(flags_of("channel", "ServiceUsage", CHANNELS))},
           {', '.join(flags_of("IncomeLevel", "IncomeLevel", ["High", "Low", "Medium"]))} FROM joined""")
check("fill_median", f"""
    SELECT c.CustomerID, round(c.tx_avg_gap_days, 6) AS tx_avg_gap_days, round(coalesce(j.amount_std, 0), 6) AS amount_std
    FROM capped c JOIN joined j ON c.CustomerID = j.CustomerID""")
WINDOWS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("tx_30", "tx_60", "tx_90", "complaints_90d", "unresolved_90d")) + (
    ", round(coalesce(amt_30, 0), 6) AS amt_30, round(coalesce(amt_90, 0), 6) AS amt_90")
ACTIVITY = """CASE WHEN coalesce(tx_90, 0) = 0 THEN 1 ELSE 0 END AS no_tx_90d,
    CASE WHEN lastlogin_recency_days > 90 THEN 1 ELSE 0 END AS no_login_90d,
    CASE WHEN coalesce(complaints_90d, 0) > 0 THEN 1 ELSE 0 END AS complained_90d"""
check("activity_flags", f"""
    SELECT f.CustomerID, {WINDOWS}, {ACTIVITY}, round(coalesce(f.amount_sum / nullif(f.txn_count, 0), 0), 6) AS avg_spend_per_tx
    FROM features f LEFT JOIN tx_windows t ON f.CustomerID = t.CustomerID LEFT JOIN svc_windows s ON f.CustomerID = s.CustomerID""")
check("standardize", "SELECT CustomerID, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM features)) / (SELECT stddev_pop({c}) FROM features), 6) AS {c}"
    for c in ("cs_count", "txn_count", "cs_recency_days")) + " FROM features")
MODEL = f"""
    SELECT f.CustomerID, c_mktsegment, r_name, IncomeLevel, ChurnStatus, LastLoginDate, LoginFrequency, ServiceUsage,
           lastlogin_recency_days, txn_count, round(c.amount_sum, 6) AS amount_sum, round(c.amount_mean, 6) AS amount_mean,
           round(coalesce(c.amount_std, 0), 6) AS amount_std, first_txn_dt, last_txn_dt, product_cat_nunique, tx_recency_days,
           round(c.tx_avg_gap_days, 6) AS tx_avg_gap_days, active_months, cs_count, cs_types_nunique, last_cs_dt,
           unresolved_count, complaint_count, cs_recency_days, had_tx, had_service,
           {', '.join(missing(c, source="f.") for c in NUMERIC)},
           round(ln(1 + c.amount_sum), 6) AS log1p_amount_sum, round(ln(1 + c.amount_mean), 6) AS log1p_amount_mean,
           {', '.join(flags_of("channel", "ServiceUsage", CHANNELS))},
           {missing("tx_avg_gap_days", "_missing", "f.")}, {missing("amount_std", "_missing", "f.")},
           {WINDOWS}, {ACTIVITY}, round(coalesce(c.amount_sum / nullif(txn_count, 0), 0), 6) AS avg_spend_per_tx
    FROM features f JOIN capped c ON f.CustomerID = c.CustomerID LEFT JOIN tx_windows t ON f.CustomerID = t.CustomerID
         LEFT JOIN svc_windows s ON f.CustomerID = s.CustomerID"""
check("model_frame", MODEL)
check("feature_preview", f"{MODEL} ORDER BY f.CustomerID LIMIT 5")
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
MATRIX_NUMBERS = [c for c in NUMERIC if c not in ("ChurnStatus", "amount_sum", "amount_mean", "amount_std", "tx_avg_gap_days")]
check("forest_matrix", f"""
    SELECT CustomerID, ChurnStatus, {', '.join(f"coalesce({c}, 0) AS {c}" for c in MATRIX_NUMBERS)},
           {', '.join(f"coalesce({c}, 0) AS {c}" for c in ("amount_sum", "amount_mean", "amount_std", "tx_avg_gap_days", "log1p_amount_sum", "log1p_amount_mean"))},
           {', '.join(f"{c}_was_missing" for c in NUMERIC)}, tx_avg_gap_days_missing, amount_std_missing,
           tx_30, tx_60, tx_90, amt_30, amt_90, complaints_90d, unresolved_90d, no_tx_90d, no_login_90d, complained_90d, avg_spend_per_tx,
           {', '.join(flags_of("c_mktsegment", "c_mktsegment", SEGMENTS))}, {', '.join(flags_of("r_name", "r_name", REGIONS))},
           {', '.join(flags_of("IncomeLevel", "IncomeLevel", ["High", "Low", "Medium"]))},
           {', '.join(f"channel_{c}" for c in (*CHANNELS, "nan"))}
    FROM ({MODEL}) m""")
check("class_weights", " UNION ALL ".join(f"""
    SELECT CAST({v} AS INTEGER) AS ChurnStatus, count(*) FILTER (WHERE ChurnStatus = {v}) AS n,
           round(count(*) / (2.0 * count(*) FILTER (WHERE ChurnStatus = {v})), 6) AS weight_balanced,
           round({ratio}, 6) AS weight_ratio FROM features""" for v, ratio in (
    (0, "CAST(1 AS DOUBLE)"), (1, "count(*) FILTER (WHERE ChurnStatus = 0) / CAST(count(*) FILTER (WHERE ChurnStatus = 1) AS DOUBLE)"))))
check("roc_auc", "SELECT round(CAST(sum(pos * ((n_all - fp) + neg / 2.0)) AS DOUBLE) / CAST(max(p_all) * max(n_all) AS DOUBLE), 6) AS roc_auc FROM curve")
check("roc_auc_by_segment", """
    SELECT c_mktsegment, round(CAST(sum(CASE WHEN a > b THEN 1.0 WHEN a = b THEN 0.5 ELSE 0.0 END) AS DOUBLE) / count(*), 6) AS roc_auc
    FROM (SELECT p.score AS a, n.score AS b, d.c_mktsegment FROM scored p JOIN demo d ON p.CustomerID = d.CustomerID
          JOIN (SELECT s.score, e.c_mktsegment FROM scored s JOIN demo e ON s.CustomerID = e.CustomerID WHERE s.label = 0) n
          ON n.c_mktsegment = d.c_mktsegment WHERE p.label = 1) u
    GROUP BY c_mktsegment""")
check("average_precision", """
    SELECT round(sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) / max(CAST(p_all AS DOUBLE)), 6) AS average_precision FROM curve""")
check("pr_curve", "SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr")
check("best_threshold", """
    SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
           round(2 * precision * recall / (precision + recall + 1e-9), 6) AS f1
    FROM pr ORDER BY 2 * pr.precision * pr.recall / (pr.precision + pr.recall + 1e-9) DESC, pr.threshold LIMIT 1""")
check("classification_report", """
    SELECT u.class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
    FROM (SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 1)::DOUBLE AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0)::DOUBLE AS fp,
                 count(*) FILTER (WHERE score < 0.5 AND label = 1)::DOUBLE AS fn, count(*) FILTER (WHERE score < 0.5 AND label = 0)::DOUBLE AS tn,
                 count(*) AS n, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM scored) c,
    LATERAL (
        SELECT '0' AS class, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, 2 * tn / (2 * tn + fn + fp) AS f1, n0 AS support
        UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), n1
        UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / n, n
        UNION ALL SELECT 'macro avg', (tn / (tn + fn) + tp / (tp + fp)) / 2, (tn / (tn + fp) + tp / (tp + fn)) / 2,
                         (2 * tn / (2 * tn + fn + fp) + 2 * tp / (2 * tp + fp + fn)) / 2, n
        UNION ALL SELECT 'weighted avg', (n0 * tn / (tn + fn) + n1 * tp / (tp + fp)) / n, (n0 * tn / (tn + fp) + n1 * tp / (tp + fn)) / n,
                         (n0 * 2 * tn / (2 * tn + fn + fp) + n1 * 2 * tp / (2 * tp + fp + fn)) / n, n) u""")


def drawn(salt: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{salt}', CustomerID, ChurnStatus, 42)), 1, 15) AS BIGINT)"


def nth(salt: str) -> str:
    return f"row_number() OVER (PARTITION BY ChurnStatus ORDER BY {drawn(salt)}, CustomerID)"


# The k rows of a class with the smallest hashes are its test rows; folds are cut at equal shares of the ranks.
SIDES = f"""
    SELECT CustomerID, ChurnStatus, CASE WHEN {nth('split')} <= floor(0.25 * n + 0.5) THEN 'test' ELSE 'train' END AS split,
           CAST((SELECT count(*) FROM range(1, 5) j(k) WHERE place > j.k * n // 5) AS INTEGER) AS fold
    FROM (SELECT CustomerID, ChurnStatus, count(*) OVER (PARTITION BY ChurnStatus) AS n, {nth('fold')} AS place FROM features) u"""
check("split_rows", SIDES)
check("split_shares", f"SELECT split, ChurnStatus, count(*) AS n FROM ({SIDES}) s GROUP BY 1, 2")
check("fold_shares", f"SELECT fold, ChurnStatus, count(*) AS n FROM ({SIDES}) s GROUP BY 1, 2")

# Levels by falling frequency, then name; missing ones come after all.
TEXTS = ("c_mktsegment", "r_name", "IncomeLevel", "ServiceUsage")
check("indexed_categories", "SELECT CustomerID, " + ", ".join(f"""{c}, coalesce(
        (SELECT count(*) FROM (SELECT {c} AS v, count(*) AS n FROM features WHERE {c} IS NOT NULL GROUP BY {c}) o
         WHERE o.n > own_{c}.n OR (o.n = own_{c}.n AND o.v < own_{c}.v)),
        0) + CASE WHEN own_{c}.v IS NULL THEN (SELECT count(DISTINCT {c}) FROM features) ELSE 0 END + 0.0 AS {c}_index""" for c in TEXTS)
      + " FROM features f" + "".join(f"""
    LEFT JOIN (SELECT {c} AS v, count(*) AS n FROM features WHERE {c} IS NOT NULL GROUP BY {c}) own_{c} ON f.{c} = own_{c}.v""" for c in TEXTS))

check("assembled_vectors", "SELECT f.CustomerID, f.ChurnStatus, 54 AS width, CAST(f.cs_count AS DOUBLE) AS cs_count, CAST(coalesce(t.tx_90, 0) AS DOUBLE) AS tx_90, " + ", ".join(f"""
        coalesce(own_{c}.number, (SELECT count(DISTINCT {c}) FROM features)) + 0.0 AS {c}_at""" for c in TEXTS)
      + " FROM features f LEFT JOIN tx_windows t ON f.CustomerID = t.CustomerID" + "".join(f"""
    LEFT JOIN (SELECT v, row_number() OVER (ORDER BY n DESC, v) - 1 AS number
               FROM (SELECT {c} AS v, count(*) AS n FROM features WHERE {c} IS NOT NULL GROUP BY {c}) u) own_{c} ON f.{c} = own_{c}.v""" for c in TEXTS))
check("level_numbers", " UNION ALL ".join(f"""
    SELECT '{t}' AS table_name, '{c}' AS "column", {c} AS level, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS number
    FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}""" for t, c in (
    ("customer", "c_name"), ("customer", "c_mktsegment"), ("part", "p_name"), ("part", "p_type"), ("events", "props"), ("events", "event_type"))))
check("numbered_parts", """
    SELECT CAST(p_partkey AS VARCHAR) AS CustomerID, p_name, p_type, dense_rank() OVER (ORDER BY p_name) - 1.0 AS p_name_index,
           dense_rank() OVER (ORDER BY p_type) - 1.0 AS p_type_index FROM part""")
MEAN_TEXTS = ("c_mktsegment", "IncomeLevel", "ServiceUsage", "c_name")
check("target_means", f"""
    SELECT s.CustomerID, split, fold, {', '.join(f"round((p_{c} + 20 * prior) / (n_{c} + 20), 6) AS {c}_mean" for c in MEAN_TEXTS)}
    FROM (SELECT s.CustomerID, s.split, s.fold,
                 (SELECT avg(t.ChurnStatus) FROM ({SIDES}) t WHERE t.split = 'train' AND (s.split = 'test' OR t.fold <> s.fold)) AS prior
          FROM ({SIDES}) s) s
    JOIN (SELECT a.CustomerID, {', '.join(f"count(*) FILTER (WHERE a.{c} = b.{c}) AS n_{c}, count(*) FILTER (WHERE a.{c} = b.{c} AND b.ChurnStatus = 1) AS p_{c}" for c in MEAN_TEXTS)}
          FROM (SELECT f.CustomerID, c_name, f.c_mktsegment, IncomeLevel, ServiceUsage, split, fold FROM features f JOIN ({SIDES}) x ON f.CustomerID = x.CustomerID
                JOIN customer k ON f.CustomerID = CAST(k.c_custkey AS VARCHAR)) a
          LEFT JOIN (SELECT f.CustomerID, f.ChurnStatus, c_name, f.c_mktsegment, IncomeLevel, ServiceUsage, split, fold FROM features f JOIN ({SIDES}) x ON f.CustomerID = x.CustomerID
                JOIN customer k ON f.CustomerID = CAST(k.c_custkey AS VARCHAR)) b
          ON b.split = 'train' AND (a.split = 'test' OR a.fold <> b.fold) GROUP BY a.CustomerID) m ON m.CustomerID = s.CustomerID""")
check("features_without_events", f"""
    SELECT d.CustomerID, 0 AS txn_count, 0 AS cs_count, 0 AS active_months, 0 AS had_tx, 0 AS had_service, NULL AS tx_recency_days, NULL AS amount_sum, 0 AS amount_std,
           0 AS tx_30, 0 AS tx_90, 0 AS amt_90, 0 AS complaints_90d, 1 AS no_tx_90d, 0 AS complained_90d, 0 AS avg_spend_per_tx
    FROM demo d JOIN churn c ON d.CustomerID = c.CustomerID""")
check("sketched_quantiles", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{q}' AS probability, count({c}) AS n, true AS close FROM lineitem"
      for c in ("l_extendedprice", "l_quantity", "l_discount") for q in ("q01", "median", "q99")))
