"""Independent SQL for every query with an exact relational meaning, run by the checker on the same parquet tables.

The statements restate each result from the source tables with plain joins, filters and aggregates; nothing here is
generated from the Spark plans. Money is summed as whole ticks of 0.0001, dates and timestamps are compared as text.
"""

from __future__ import annotations

AS_OF = "2000-06-01"
PANEL_END = "2000-12-01"
INTERACTIONS_FROM = "1998-01-01"
INTERACTIONS_TO = "2000-12-31"

# name -> (names it reads, body)
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": (
        (),
        """
        SELECT CAST(o.o_orderkey AS VARCHAR) AS invoice_id, CAST(l.l_partkey AS VARCHAR) AS item_id,
               p.p_name AS item_description,
               CASE l.l_returnflag WHEN 'R' THEN -l.l_quantity ELSE l.l_quantity END AS quantity,
               o.o_orderdate AS event_ts,
               FLOOR(l.l_extendedprice / l.l_quantity * 10000 + 0.5) / 10000 AS unit_price,
               CAST(c.c_custkey AS VARCHAR) AS user_id, n.n_name AS country
        FROM lineitem l, orders o, customer c, nation n, part p
        WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey
          AND c.c_nationkey = n.n_nationkey AND l.l_partkey = p.p_partkey""",
    ),
    "uniq": (("lines",), "SELECT DISTINCT * FROM lines"),
    "silver": (
        ("uniq",),
        """
        SELECT invoice_id, item_id, max(item_description) AS item_description,
               CAST(sum(quantity) AS INTEGER) AS quantity, event_ts, CAST(event_ts AS DATE) AS event_date,
               round(avg(unit_price), 4) AS unit_price, round(sum(quantity * unit_price), 4) AS line_revenue,
               max(user_id) AS user_id, max(country) AS country
        FROM uniq WHERE quantity <> 0 AND unit_price >= 0
        GROUP BY invoice_id, item_id, event_ts HAVING CAST(sum(quantity) AS INTEGER) <> 0""",
    ),
    "snap": ((), f"SELECT DATE '{AS_OF}' AS as_of_date"),
    "panel_dates": (
        (),
        f"SELECT CAST(DATE '{PANEL_END}' - to_months(CAST(b AS INTEGER)) AS DATE) AS as_of_date FROM range(12) r(b)",
    ),
    "money": (
        ("silver",),
        "SELECT *, CAST(round(line_revenue * 10000) AS BIGINT) AS ticks FROM silver WHERE user_id <> ''",
    ),
    "events_to": (
        ("money", "snap"),
        "SELECT s.as_of_date, m.*, s.as_of_date - m.event_date AS age FROM money m JOIN snap s ON m.event_date <= s.as_of_date",
    ),
    "bought": (("events_to",), "SELECT * FROM events_to WHERE quantity > 0"),
    "known": (("events_to",), "SELECT DISTINCT user_id, as_of_date FROM events_to"),
    "latest": (
        ("bought",),
        """
        SELECT DISTINCT ON (user_id, as_of_date) user_id, as_of_date, event_ts AS last_event_ts, country
        FROM bought ORDER BY user_id, as_of_date, event_ts DESC, country DESC""",
    ),
    "invoice_windows": (
        ("bought",),
        """
        SELECT user_id, as_of_date, invoice_id, w AS lookback_window_days, sum(ticks) AS ticks
        FROM bought, (VALUES (60), (90), (120)) v(w) WHERE age < w GROUP BY ALL""",
    ),
    "baskets": (
        ("invoice_windows",),
        """
        SELECT user_id, as_of_date,
               round(avg(ticks) FILTER (lookback_window_days = 60)) / 10000 AS avg_basket_value_60d,
               round(avg(ticks) FILTER (lookback_window_days = 90)) / 10000 AS avg_basket_value_90d,
               round(avg(ticks) FILTER (lookback_window_days = 120)) / 10000 AS avg_basket_value_120d
        FROM invoice_windows GROUP BY user_id, as_of_date""",
    ),
    "rollups": (
        ("bought",),
        "SELECT user_id, as_of_date, "
        + ", ".join(
            f"count(DISTINCT invoice_id) FILTER (age < {w}) AS frequency_{w}d, "
            f"CAST(coalesce(sum(ticks) FILTER (age < {w}), 0) AS DOUBLE) / 10000 AS monetary_{w}d"
            for w in (30, 60, 90, 120)
        )
        + " FROM bought GROUP BY user_id, as_of_date",
    ),
    "features": (
        ("known", "latest", "rollups", "baskets"),
        """
        SELECT user_id, as_of_date,
               coalesce(CAST(as_of_date - CAST(last_event_ts AS DATE) AS BIGINT), 9999) AS recency_days, """
        + ", ".join(f"coalesce(frequency_{w}d, 0) AS frequency_{w}d" for w in (30, 60, 90, 120))
        + ", "
        + ", ".join(f"coalesce(monetary_{w}d, 0.0::DOUBLE) AS monetary_{w}d" for w in (30, 60, 90, 120))
        + ", "
        + ", ".join(f"coalesce(avg_basket_value_{w}d, 0.0::DOUBLE) AS avg_basket_value_{w}d" for w in (60, 90, 120))
        + """, coalesce(country, 'UNKNOWN') AS country
        FROM known LEFT JOIN latest USING (user_id, as_of_date) LEFT JOIN rollups USING (user_id, as_of_date)
             LEFT JOIN baskets USING (user_id, as_of_date)""",
    ),
    "outcomes": (
        ("money", "snap"),
        """
        SELECT user_id, as_of_date, h AS window_days, CAST(sum(ticks) AS DOUBLE) / 10000 AS net_revenue,
               1.0::DOUBLE AS purchase_flag
        FROM money JOIN snap ON event_date > as_of_date, (VALUES (30), (60), (90)) v(h)
        WHERE quantity > 0 AND event_date - as_of_date <= h GROUP BY ALL""",
    ),
    "labels": (
        ("known", "outcomes"),
        """
        SELECT k.user_id, k.as_of_date, m || '_' || h || 'd' AS label_name, h AS window_days,
               coalesce(CASE m WHEN 'purchase' THEN o.purchase_flag ELSE o.net_revenue END, 0.0::DOUBLE) AS label_value
        FROM known k, (VALUES (30), (60), (90)) v(h), (VALUES ('net_revenue'), ('purchase')) t(m)
        LEFT JOIN outcomes o ON o.user_id = k.user_id AND o.as_of_date = k.as_of_date AND o.window_days = h""",
    ),
    "labels_wide": (
        ("labels",),
        "SELECT user_id, as_of_date, "
        + ", ".join(
            f"max(label_value) FILTER (label_name = '{m}_{h}d') AS label_{m}_{h}d"
            for h in (30, 60, 90)
            for m in ("net_revenue", "purchase")
        )
        + " FROM labels GROUP BY user_id, as_of_date",
    ),
    "train_table": (("features", "labels_wide"), "SELECT * FROM features LEFT JOIN labels_wide USING (user_id, as_of_date)"),
    "interactions": (
        ("silver",),
        f"""
        SELECT user_id, item_id, invoice_id, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts,
               CAST(event_date AS VARCHAR) AS event_date, quantity AS weight
        FROM silver WHERE quantity > 0 AND user_id <> ''
          AND event_date BETWEEN DATE '{INTERACTIONS_FROM}' AND DATE '{INTERACTIONS_TO}'""",
    ),
    "ranked_moments": (
        ("interactions",),
        """
        SELECT user_id, invoice_id, event_ts,
               rank() OVER (PARTITION BY user_id ORDER BY event_ts DESC, invoice_id DESC) AS recency_rank
        FROM (SELECT DISTINCT user_id, invoice_id, event_ts FROM interactions)""",
    ),
    "splits": (
        ("interactions", "ranked_moments"),
        """
        SELECT i.user_id, i.item_id, i.invoice_id, i.event_ts, i.event_date,
               coalesce(['test', 'val'][recency_rank], 'train') AS split
        FROM interactions i JOIN ranked_moments USING (user_id, invoice_id, event_ts)""",
    ),
    "users": (
        ("splits",),
        "SELECT user_id, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS BIGINT) AS user_idx FROM splits GROUP BY user_id",
    ),
    "items": (
        ("splits",),
        """
        SELECT item_id, CAST(dense_rank() OVER (ORDER BY item_id) - 1 AS BIGINT) AS item_idx
        FROM splits WHERE split = 'train' GROUP BY item_id""",
    ),
}


def statement(select: str, *reads: str, **overrides: str) -> str:
    """``WITH`` the parts that ``select`` needs, each once and in order. ``overrides`` replaces a part's body."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dependency in () if name in overrides or name not in _PARTS else _PARTS[name][0]:
            visit(dependency)
        ordered.append(name)

    for name in (*overrides, *reads):
        visit(name)
    parts = ",\n".join(f"{name} AS ({overrides.get(name, _PARTS[name][1] if name in _PARTS else '')})" for name in ordered)
    return f"WITH {parts}\n{select}" if ordered else select


def on_panel(select: str, *reads: str) -> str:
    """The same statement over the twelve snapshots instead of the single one."""
    return statement(select, *reads, snap=_PARTS["panel_dates"][1])


_SILVER_OUT = (
    "SELECT invoice_id, item_id, item_description, quantity, CAST(event_ts AS VARCHAR) AS event_ts, "
    "CAST(event_date AS VARCHAR) AS event_date, unit_price, line_revenue, user_id, country FROM silver"
)
_TYPED_OUT = (
    "SELECT invoice_id, item_id, item_description, quantity, CAST(event_ts AS VARCHAR) AS event_ts, unit_price, "
    "{user} AS user_id, country FROM lines"
)
_FEATURES_OUT = "SELECT * REPLACE (CAST(as_of_date AS VARCHAR) AS as_of_date) FROM "


def gold_statements() -> dict[str, str]:
    """Sources, silver, propensity gold and recommender gold."""
    d: dict[str, str] = {}
    d["parquet_source"] = statement(_SILVER_OUT, "silver")
    d["snapshot_panel_source"] = on_panel(
        _FEATURES_OUT + "train_table WHERE as_of_date >= DATE '2000-07-01'", "train_table"
    )
    d["snapshot_sink"] = d["snapshot_panel_source"]
    d["run_manifest"] = on_panel(
        """SELECT 'gold_labels' AS artifact, CAST(as_of_date AS VARCHAR) AS as_of_date, count(*) AS rows FROM labels GROUP BY 2
        UNION ALL SELECT 'gold_propensity_train_dataset', CAST(as_of_date AS VARCHAR), count(*) FROM train_table GROUP BY 2
        UNION ALL SELECT 'silver_transactions_line_items', NULL, count(*) FROM silver""",
        "labels",
        "train_table",
        "silver",
    )
    raw = (
        'SELECT invoice_id AS "Invoice", item_id AS "StockCode", item_description AS "Description", {quantity} AS "Quantity", '
        '{stamp} AS "InvoiceDate", {price} AS "Price", user_id || \'.0\' AS "Customer ID", country AS "Country" FROM lines'
    )
    d["raw_csv_source"] = statement(
        raw.format(quantity="CAST(quantity AS VARCHAR)", stamp="strftime(event_ts, '%Y-%m-%d %H:%M:%S')", price="CAST(unit_price AS VARCHAR)"),
        "lines",
    )
    d["parquet_sink"] = statement("SELECT 'silver_transactions_line_items' AS artifact, count(*) AS rows FROM silver", "silver")
    d["parquet_to_csv_export"] = statement(
        "SELECT * REPLACE (CAST(quantity AS VARCHAR) AS quantity, CAST(unit_price AS VARCHAR) AS unit_price, "
        f"CAST(line_revenue AS VARCHAR) AS line_revenue) FROM ({_SILVER_OUT})",
        "silver",
    )
    d["raw_dedup"] = statement(
        """SELECT invoice_id AS "Invoice", item_id AS "StockCode", item_description AS "Description", quantity AS "Quantity",
        CAST(event_ts AS VARCHAR) AS "InvoiceDate", unit_price AS "Price", user_id AS "Customer ID", country AS "Country"
        FROM uniq""",
        "uniq",
    )
    d["typed_lines"] = statement(_TYPED_OUT.format(user="user_id || '.0'"), "lines")
    d["normalize_user_id"] = statement(
        "SELECT user_id || '.0' AS raw_user_id, user_id, count(*) AS line_count FROM lines GROUP BY user_id", "lines"
    )
    d["valid_lines"] = statement(
        _TYPED_OUT.format(user="user_id") + " WHERE quantity <> 0 AND unit_price >= 0", "lines"
    )
    grain = (
        "SELECT invoice_id, item_id, CAST(event_ts AS VARCHAR) AS event_ts, max(item_description) AS item_description, "
        "CAST(sum(quantity) AS INTEGER) AS quantity, round(avg(unit_price), 4) AS unit_price, "
        "round(sum(quantity * unit_price), 4) AS line_revenue, max(user_id) AS user_id, max(country) AS country "
        "FROM lines WHERE quantity <> 0 AND unit_price >= 0 GROUP BY invoice_id, item_id, lines.event_ts"
    )
    d["silver_grain_agg"] = statement(grain, "lines")
    d["silver_transactions"] = statement(_SILVER_OUT, "silver")
    d["silver_event_bounds"] = statement(
        "SELECT CAST(min(event_date) AS VARCHAR) AS min_event_date, CAST(max(event_date) AS VARCHAR) AS max_event_date FROM silver",
        "silver",
    )

    d["snapshot_dates"] = statement(
        """SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, as_of_date BETWEEN a AND b AS in_bounds
        FROM panel_dates, (SELECT min(event_date) AS a, max(event_date) AS b FROM silver)""",
        "panel_dates",
        "silver",
    )
    event_out = (
        "SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, user_id, invoice_id, CAST(event_ts AS VARCHAR) AS event_ts, "
        "CAST(event_date AS VARCHAR) AS event_date, line_revenue, country, quantity FROM "
    )
    d["asof_events"] = statement(event_out + "events_to", "events_to")
    d["positive_events"] = statement(event_out + "bought", "bought")
    d["asof_users"] = statement(_FEATURES_OUT + "known", "known")
    d["latest_event_per_user"] = statement(
        "SELECT user_id, CAST(as_of_date AS VARCHAR) AS as_of_date, CAST(last_event_ts AS VARCHAR) AS last_event_ts, country FROM latest",
        "latest",
    )
    for kind in ("frequency", "monetary"):
        columns = ", ".join(f"{kind}_{w}d" for w in (30, 60, 90, 120))
        d[f"lookback_{kind}"] = statement(
            f"SELECT user_id, CAST(as_of_date AS VARCHAR) AS as_of_date, {columns} FROM rollups", "rollups"
        )
    d["invoice_totals_windowed"] = statement(
        "SELECT user_id, CAST(as_of_date AS VARCHAR) AS as_of_date, invoice_id, lookback_window_days, "
        "CAST(ticks AS DOUBLE) / 10000 AS invoice_revenue FROM invoice_windows",
        "invoice_windows",
    )
    d["avg_basket_value"] = statement(_FEATURES_OUT + "baskets", "baskets")
    d["user_features_asof"] = on_panel(_FEATURES_OUT + "features", "features")
    d["future_outcomes"] = on_panel(_FEATURES_OUT + "outcomes", "outcomes")
    d["labels_long"] = statement(_FEATURES_OUT + "labels", "labels")
    d["labels_pivot"] = statement(_FEATURES_OUT + "labels_wide", "labels_wide")
    d["propensity_train_dataset"] = statement(_FEATURES_OUT + "train_table", "train_table")
    d["propensity_panel"] = on_panel(_FEATURES_OUT + "train_table", "train_table")

    d["interaction_events"] = statement("SELECT * FROM interactions", "interactions")
    d["invoice_moments"] = statement("SELECT user_id, invoice_id, event_ts FROM ranked_moments", "ranked_moments")
    d["invoice_recency_rank"] = statement("SELECT * FROM ranked_moments", "ranked_moments")
    d["user_item_splits"] = statement("SELECT * FROM splits", "splits")
    d["user_index"] = statement("SELECT * FROM users", "users")
    d["item_index"] = statement("SELECT * FROM items", "items")
    return d


def _verdict(check_id: str, failing: str) -> str:
    return f"SELECT '{check_id}' AS check_id, CAST(({failing}) AS BIGINT) AS failing_rows, ({failing}) = 0 AS passed"


_REPEATED = "SELECT count(*) FROM (SELECT 1 FROM {table} GROUP BY {keys} HAVING count(*) > 1)"
_CHRONOLOGY = """SELECT count(*) FROM (
    SELECT max(event_ts) FILTER (split = 'train') AS a, min(event_ts) FILTER (split = 'val') AS b,
           max(event_ts) FILTER (split = 'val') AS c, min(event_ts) FILTER (split = 'test') AS d
    FROM splits GROUP BY user_id) WHERE {broken}"""


def dq_statements() -> dict[str, str]:
    """Data-quality checks, each against the table that the Spark query checks."""
    failing = {
        "dq_silver_duplicates": (
            "DQ_SILVER_001",
            _REPEATED.format(table="silver", keys="invoice_id, item_id, event_ts"),
            ("silver",),
        ),
        "dq_feature_duplicates": ("DQ_GOLD_001", _REPEATED.format(table="features", keys="user_id, as_of_date"), ("features",)),
        "dq_invalid_labels": (
            "DQ_GOLD_003",
            """SELECT count(*) FROM labels WHERE (label_name, window_days) NOT IN (
                SELECT (m || '_' || h || 'd', h) FROM (VALUES (30), (60), (90)) v(h), (VALUES ('net_revenue'), ('purchase')) t(m))""",
            ("labels",),
        ),
        "dq_invalid_split": (
            "DQ_GOLD_005",
            "SELECT count(*) FROM splits WHERE NOT list_contains(['train', 'val', 'test'], split)",
            ("splits",),
        ),
        "dq_split_chronology": ("DQ_GOLD_006", _CHRONOLOGY.format(broken="a > b OR b > d"), ("splits",)),
        "dq_split_chronology_strict": (
            "SPLIT_CHRONOLOGY_STRICT",
            _CHRONOLOGY.format(broken="a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL AND (a > b OR c > d)"),
            ("splits",),
        ),
        "dq_train_duplicates": (
            "DQ_GOLD_009",
            _REPEATED.format(table="train_table", keys="user_id, as_of_date"),
            ("train_table",),
        ),
        "dq_index_contiguity": (
            "INDEX_user_idx",
            """SELECT count(*) - count(DISTINCT user_id) + count(*) - count(DISTINCT user_idx)
                + CASE WHEN max(user_idx) = count(*) - 1 THEN 0 ELSE 1 END FROM users""",
            ("users",),
        ),
        "dq_window_in_bounds": (
            "WINDOW_IN_BOUNDS",
            f"""SELECT CASE WHEN min(event_date) <= DATE '{INTERACTIONS_FROM}' AND max(event_date) >= DATE '{INTERACTIONS_TO}'
                THEN 0 ELSE 1 END FROM silver""",
            ("silver",),
        ),
    }
    on_twelve = {"dq_feature_duplicates", "dq_train_duplicates"}
    d = {
        key: (on_panel if key in on_twelve else statement)(_verdict(check_id, rows), *reads)
        for key, (check_id, rows, reads) in failing.items()
    }
    d["dq_bad_timestamp_ratio"] = statement(
        """SELECT count(*) AS total_rows, count(*) - count(event_ts) AS bad_timestamp_rows,
        1.0::DOUBLE - CAST(count(event_ts) AS DOUBLE) / count(*) AS bad_timestamp_ratio,
        1.0 - count(event_ts) / count(*) <= 0.01 AS passed FROM lines""",
        "lines",
    )
    d["dq_required_columns"] = " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, true AS present, count({name}) AS filled_rows FROM lineitem"
        for name in ("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    )
    of_items = failing["dq_index_contiguity"][1].replace("user_i", "item_i").replace("FROM users", "FROM items")
    verdicts = [(check_id, rows) for check_id, rows, _ in failing.values()]
    verdicts.append(("INDEX_item_idx", of_items))
    verdicts.append(
        ("LABEL_HORIZON_TRUNCATED", "SELECT count(*) FROM panel_dates WHERE as_of_date + 90 > (SELECT max(event_date) FROM silver)")
    )
    reads = [name for _, _, names in failing.values() for name in names]
    report = " UNION ALL ".join(_verdict(*verdict) for verdict in verdicts)
    d["dq_report"] = on_panel(report, *dict.fromkeys([*reads, "items", "panel_dates"]))
    return d


_SCORED = """
    SELECT *, round(1.0::DOUBLE / (1.0::DOUBLE + recency_days / 30.0::DOUBLE), 6) AS propensity_score,
           avg_basket_value_90d AS predicted_conditional_revenue_30d,
           CAST(CAST('0x' || substr(sha256(user_id || '|' || CAST(as_of_date AS VARCHAR) || '|policy_random'), 1, 16) AS UBIGINT) AS DOUBLE)
             / 18446744073709551615.0::DOUBLE AS random_policy_score,
           1.0::DOUBLE / (1.0::DOUBLE + recency_days) + 0.5::DOUBLE * frequency_90d + 0.01::DOUBLE * monetary_90d AS rfm_policy_score,
           CASE WHEN as_of_date = DATE '2000-12-01' THEN 'test' WHEN as_of_date = DATE '2000-11-01' THEN 'validation'
                ELSE 'train' END AS slice
    FROM train_table"""
_PARTS["scored0"] = (("train_table",), _SCORED)
_PARTS["scored"] = (
    ("scored0",),
    "SELECT *, propensity_score * predicted_conditional_revenue_30d AS expected_value_score FROM scored0",
)
_PARTS["cap"] = (
    ("scored",),
    "SELECT quantile_cont(monetary_90d, 0.99) AS spend_cap_value FROM scored WHERE slice = 'train'",
)
_PARTS["gaps"] = (
    ("silver",),
    """
    SELECT user_id, event_date, gap_days FROM (
        SELECT user_id, event_date, event_date - lag(event_date) OVER (PARTITION BY user_id ORDER BY event_date) AS gap_days
        FROM silver WHERE quantity > 0 AND user_id <> '') WHERE gap_days > 0""",
)
for _name, _score in (("ml", "expected_value_score"), ("random", "random_policy_score"), ("rfm", "rfm_policy_score")):
    _PARTS[f"best_{_name}"] = (
        ("scored",),
        f"SELECT * FROM scored WHERE slice = 'test' ORDER BY round({_score}, 6) DESC, user_id LIMIT 200",
    )
_POLICY = """
    SELECT '{policy}' AS policy, count(*) AS targeted_users, round(count(*) * 5.0::DOUBLE, 6) AS budget_spend,
           round(avg(label_purchase_30d), 6) AS actual_purchase_rate, round(sum(label_net_revenue_30d), 6) AS actual_revenue_total,
           round(sum(label_net_revenue_30d) / count(*), 6) AS actual_revenue_per_targeted_user
    FROM {table}"""
_PARTS["policies"] = (
    ("best_ml", "best_random", "best_rfm"),
    " UNION ALL ".join(
        _POLICY.format(policy=policy, table=table)
        for policy, table in (
            ("ml_top_expected_value", "best_ml"),
            ("random_baseline", "best_random"),
            ("rfm_heuristic", "best_rfm"),
        )
    ),
)
_KEY = "user_id, CAST(as_of_date AS VARCHAR) AS as_of_date"
_INPUTS = "recency_days, frequency_30d, monetary_30d, frequency_90d, monetary_90d, avg_basket_value_90d"
_THRESHOLDS = """
    SELECT g, propensity_score, n, p, sum(p) OVER w AS hits, sum(n) OVER w AS taken, sum(p) OVER (PARTITION BY g) AS positives
    FROM (SELECT g, propensity_score, count(*) AS n, sum(label) AS p FROM {source} GROUP BY g, propensity_score)
    WINDOW w AS (PARTITION BY g ORDER BY propensity_score DESC)"""


def propensity_statements() -> dict[str, str]:
    """Modelling preparation, metrics, policies and gap diagnostics, over deterministic stand-in scores."""
    d: dict[str, str] = {}
    inputs = ", ".join(f"CAST({name} AS DOUBLE) AS {name}" for name in _INPUTS.split(", "))
    d["training_rows"] = on_panel(
        f"SELECT {_KEY}, country, {inputs}, label_purchase_30d AS purchase_label, label_net_revenue_30d AS revenue_label FROM scored",
        "scored",
    )
    d["split_10_1_1"] = on_panel(
        f"""SELECT {_KEY}, CASE WHEN r <= 10 THEN 'train' WHEN r = 11 THEN 'validation' ELSE 'test' END AS slice
        FROM (SELECT *, dense_rank() OVER (ORDER BY as_of_date) AS r FROM train_table)""",
        "train_table",
    )
    d["label_class_check"] = on_panel(
        """SELECT count(DISTINCT label_purchase_30d) AS class_count, count(DISTINCT label_purchase_30d) >= 2 AS passed
        FROM scored WHERE slice = 'train'""",
        "scored",
    )
    d["spend_cap_value"] = on_panel("SELECT round(spend_cap_value, 6) AS spend_cap_value FROM cap", "cap")
    d["apply_spend_cap"] = on_panel(
        f"SELECT {_KEY}, round(least(monetary_90d, (SELECT spend_cap_value FROM cap)), 6) AS monetary_90d FROM scored", "cap"
    )
    flags = ", ".join(f"CAST(country = 'NATION_{i}' AS INTEGER)::DOUBLE AS \"country_NATION_{i}\"" for i in range(25))
    d["country_one_hot"] = on_panel(f"SELECT {_KEY}, {flags} FROM train_table", "train_table")
    d["country_vectors"] = on_panel(
        f"""SELECT {_KEY}, slot, (SELECT count(DISTINCT country) FROM scored WHERE slice = 'train') AS slots, CAST(slot IS NOT NULL AS INTEGER)::DOUBLE AS flags_set
        FROM train_table LEFT JOIN (SELECT country, row_number() OVER (ORDER BY country) - 1 AS slot FROM
        (SELECT DISTINCT country FROM scored WHERE slice = 'train' AND country IS NOT NULL)) AS vocabulary USING (country)""",
        "scored",
    )
    d["spend_cap_sketch"] = on_panel(
        "SELECT count(monetary_90d) AS train_rows, true AS within_bound FROM scored WHERE slice = 'train'", "scored"
    )
    d["revenue_fallback_mean"] = on_panel(
        """SELECT round(avg(label_net_revenue_30d), 6) AS revenue_fallback_value
        FROM scored WHERE slice = 'train' AND label_purchase_30d = 1""",
        "scored",
    )

    pairs = "SELECT 1 AS g, propensity_score, CAST(label_purchase_30d AS BIGINT) AS label FROM scored"
    d["roc_auc"] = on_panel(
        f"""SELECT round((sum(place) FILTER (label = 1) - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)), 6) AS roc_auc FROM (
            SELECT label, sum(label) OVER () AS p, count(*) OVER () AS n,
                   rank() OVER (ORDER BY propensity_score) + (count(*) OVER (PARTITION BY propensity_score) - 1) / 2.0::DOUBLE AS place
            FROM ({pairs})) GROUP BY p, n""",
        "scored",
    )
    thresholds = _THRESHOLDS.format(source=f"({pairs})")
    d["average_precision"] = on_panel(
        f"SELECT round(sum(p::DOUBLE / positives * hits / taken), 6) AS average_precision FROM ({thresholds})", "scored"
    )
    d["top_decile_lift"] = on_panel(
        """SELECT round(b, 6) AS base_positive_rate, round(t, 6) AS top_decile_positive_rate, round(t / b, 6) AS top_decile_lift FROM (
            SELECT avg(label_purchase_30d) AS b, avg(label_purchase_30d) FILTER (r <= greatest(1, n // 10)) AS t
            FROM (SELECT label_purchase_30d, count(*) OVER () AS n,
                         row_number() OVER (ORDER BY propensity_score DESC, user_id, as_of_date) AS r FROM scored))""",
        "scored",
    )
    d["brier_score"] = on_panel(
        "SELECT round(avg((propensity_score - label_purchase_30d) ** 2), 6) AS brier_score FROM scored", "scored"
    )
    reached = "(SELECT count(*) FROM range(10) e(i) WHERE i * 0.1::DOUBLE <= propensity_score)"
    d["ece_10_bin"] = on_panel(
        f"""SELECT round(sum(abs(s - y) * n) / sum(n), 6) AS ece_10_bin FROM (
            SELECT avg(propensity_score) AS s, avg(label_purchase_30d) AS y, count(*) AS n FROM scored
            GROUP BY {reached})""",
        "scored",
    )
    miss = "abs(label_net_revenue_30d - predicted_conditional_revenue_30d)"
    d["revenue_errors"] = on_panel(
        f"""SELECT count(*) AS row_count, round(sqrt(avg({miss} ** 2)), 6) AS rmse, round(avg({miss}), 6) AS mae,
        round(avg({miss} / label_net_revenue_30d) FILTER (label_net_revenue_30d <> 0), 6) AS mape
        FROM scored WHERE label_purchase_30d = 1""",
        "scored",
    )

    for score in ("expected_value_score", "random_policy_score", "rfm_policy_score"):
        d[score] = on_panel(f"SELECT {_KEY}, round({score}, 6) AS {score} FROM scored", "scored")
    d["budget_top_k"] = on_panel(
        f"SELECT {_KEY}, round(rfm_policy_score, 6) AS rfm_policy_score FROM best_rfm", "best_rfm"
    )
    d["policy_comparison"] = on_panel("SELECT * FROM policies", "policies")
    revenue_of = "max(actual_revenue_per_targeted_user) FILTER (policy = '{}')"
    ml, rnd, rfm = (revenue_of.format(p) for p in ("ml_top_expected_value", "random_baseline", "rfm_heuristic"))
    d["policy_deltas"] = on_panel(
        f"""SELECT round({ml} - {rnd}, 6) AS ml_vs_random_revenue_per_user_delta,
        round({ml} - {rfm}, 6) AS ml_vs_rfm_revenue_per_user_delta FROM policies""",
        "policies",
    )
    cycle = """
        SELECT '{policy}' AS policy, round(avg(label_net_revenue_30d), 6) AS v FROM (
            SELECT label_net_revenue_30d FROM scored WHERE slice = '{slice}' ORDER BY round({score}, 6) DESC, user_id LIMIT 200)"""
    names = (
        ("ml_top_expected_value", "expected_value_score"),
        ("random_baseline", "random_policy_score"),
        ("rfm_heuristic", "rfm_policy_score"),
    )
    initial, retrain = (
        " UNION ALL ".join(cycle.format(policy=p, score=s, slice=part) for p, s in names) for part in ("validation", "test")
    )
    d["policy_cycle_comparison"] = on_panel(
        f"SELECT policy, a.v AS initial, b.v AS retrain FROM ({initial}) a JOIN ({retrain}) b USING (policy)", "scored"
    )
    d["predictions_csv_sink"] = on_panel(
        f"""SELECT {_KEY}, CAST(label_purchase_30d AS INTEGER) AS label_purchase_30d, """
        + ", ".join(
            f"round({c}, 6) AS {c}"
            for c in (
                "label_net_revenue_30d",
                "propensity_score",
                "predicted_conditional_revenue_30d",
                "expected_value_score",
                "random_policy_score",
                "rfm_policy_score",
            )
        )
        + " FROM scored WHERE slice = 'test'",
        "scored",
    )

    served = ", ".join(f"round({c}, 6) AS {c}" for c in ("propensity_score", "predicted_conditional_revenue_30d", "expected_value_score"))
    d["serving_scores_csv_sink"] = on_panel(f"SELECT {_KEY}, {served} FROM scored WHERE slice = 'test'", "scored")

    d["inter_purchase_gaps"] = statement(
        "SELECT user_id, CAST(event_date AS VARCHAR) AS event_date, CAST(gap_days AS INTEGER) AS gap_days FROM gaps", "gaps"
    )
    d["gap_distribution"] = statement(
        """SELECT count(*) AS gap_observation_count, CAST(list_sort(list(gap_days))[count(*) // 2 + 1] AS INTEGER) AS median_gap_days,
        round(avg(gap_days), 6) AS mean_gap_days FROM gaps""",
        "gaps",
    )
    d["gap_coverage"] = statement(
        """SELECT w AS window_days, round(avg(CAST(gap_days <= w AS INTEGER)), 6) AS inter_purchase_gap_coverage
        FROM gaps, (VALUES (30), (60), (90)) v(w) GROUP BY w""",
        "gaps",
    )

    trials = " UNION ALL ".join(
        f"""SELECT '{kind}|{w}|{m}|{name}' AS g, CAST(label_purchase_{h}d AS BIGINT) AS label, {score} AS propensity_score
            FROM scored WHERE slice = 'validation'"""
        for kind, w, h, b in [
            *(("horizon", h, h, 90) for h in (30, 60, 90)),
            *(("lookback", b, 30, b) for b in (60, 90, 120)),
        ]
        for m, (name, score) in enumerate(
            (
                ("logistic_regression", "1.0::DOUBLE / (1.0::DOUBLE + recency_days / 30.0::DOUBLE)"),
                ("boosted_trees", f"frequency_{b}d / (1.0::DOUBLE + frequency_{b}d)"),
            )
        )
    )
    d["freeze_decision"] = on_panel(
        f"""
        SELECT h.w AS selected_prediction_window_days, b.w AS selected_feature_lookback_days,
               b.name AS selected_propensity_model_name, h.name AS prediction_window_model, h.ap AS prediction_window_average_precision,
               b.name AS lookback_model, b.ap AS lookback_average_precision
        FROM (SELECT * FROM results WHERE kind = 'horizon' ORDER BY ap DESC, w, m LIMIT 1) h,
             (SELECT * FROM results WHERE kind = 'lookback' ORDER BY ap DESC, w, m LIMIT 1) b""",
        "scored",
        "results",
    )
    results = f"""
        SELECT split_part(g, '|', 1) AS kind, CAST(split_part(g, '|', 2) AS INTEGER) AS w, CAST(split_part(g, '|', 3) AS INTEGER) AS m,
               split_part(g, '|', 4) AS name, round(sum(p::DOUBLE / positives * hits / taken), 6) AS ap
        FROM ({_THRESHOLDS.format(source=f'({trials})')}) GROUP BY g"""
    d["freeze_decision"] = d["freeze_decision"].replace("results AS ()", f"results AS ({results})")
    return d


_PARTS.update(
    {
        "pairs": (
            ("splits", "users", "items"),
            """
            SELECT DISTINCT user_idx, item_idx FROM splits JOIN users USING (user_id) JOIN items USING (item_id)
            WHERE split = 'train'""",
        ),
        "pop": (
            ("splits", "items"),
            """
            SELECT item_id, item_idx, count(*) AS interactions, count(DISTINCT user_id) AS buyers
            FROM splits JOIN items USING (item_id) WHERE split = 'train' GROUP BY ALL""",
        ),
        "pop_scores": (
            ("pop",),
            "SELECT *, ln(1 + interactions) / (SELECT ln(1 + max(interactions)) FROM pop) AS score FROM pop",
        ),
        "truth": (
            ("splits", "users", "items"),
            """
            SELECT DISTINCT CASE split WHEN 'val' THEN 'validation' ELSE split END AS split, user_idx, item_idx
            FROM splits JOIN users USING (user_id) JOIN items USING (item_id) WHERE split <> 'train'""",
        ),
        "lists": (
            ("pop_scores", "users", "pairs"),
            """
            SELECT model_name, user_idx, item_idx, score,
                   row_number() OVER (PARTITION BY model_name, user_idx ORDER BY weight DESC, item_idx) AS rank
            FROM users, (SELECT 'popularity' AS model_name, item_idx, interactions AS weight, score FROM pop_scores
                         UNION ALL SELECT 'popularity_users', item_idx, buyers, score FROM pop_scores) p
            WHERE (user_idx, p.item_idx) NOT IN (SELECT (user_idx, item_idx) FROM pairs)
            QUALIFY rank <= 20""",
        ),
        "judged": (
            ("lists", "truth"),
            """
            SELECT model_name, split, user_idx, hits / relevant AS recall, CAST(hits > 0 AS INTEGER)::DOUBLE AS hit_rate,
                   dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 21) r(i) WHERE i <= least(relevant, depth)) AS ndcg
            FROM (SELECT l.model_name, w.split, l.user_idx, count(t.item_idx) AS hits, count(*) AS depth,
                         any_value(w.relevant) AS relevant,
                         coalesce(sum(1 / log2(l.rank + 1)) FILTER (t.item_idx IS NOT NULL), 0) AS dcg
                  FROM lists l JOIN (SELECT split, user_idx, count(*) AS relevant FROM truth GROUP BY ALL) w USING (user_idx)
                  LEFT JOIN truth t ON t.split = w.split AND t.user_idx = l.user_idx AND t.item_idx = l.item_idx
                  GROUP BY l.model_name, w.split, l.user_idx)""",
        ),
        "model_rows": (
            ("judged", "pairs"),
            """
            SELECT model_name, split, count(*) AS eligible_users, round(avg(recall), 6) AS recall_at_20,
                   round(avg(ndcg), 6) AS ndcg_at_20, round(avg(hit_rate), 6) AS hit_rate_at_20
            FROM judged WHERE user_idx IN (SELECT user_idx FROM pairs) GROUP BY model_name, split""",
        ),
    }
)


def recommender_statements() -> dict[str, str]:
    """Interactions, popularity, exact vector search and ranking metrics, by brute force over all pairs."""
    d: dict[str, str] = {}
    d["split_interactions"] = statement("SELECT DISTINCT user_id, split, item_id FROM splits", "splits")
    d["positive_pairs"] = statement("SELECT * FROM pairs", "pairs")
    d["popularity_scores"] = statement(
        "SELECT item_id, item_idx, interactions, round(score, 6) AS score FROM pop_scores", "pop_scores"
    )
    d["tfidf_interactions"] = statement(
        """SELECT user_idx, item_idx, round(idf / sqrt(sum(idf * idf) OVER (PARTITION BY user_idx)), 6) AS weight FROM (
            SELECT user_idx, item_idx, ln(1 + (SELECT count(*) FROM users) / count(*) OVER (PARTITION BY item_idx)) AS idf FROM pairs)""",
        "pairs",
        "users",
    )
    d["candidate_items"] = statement(
        """SELECT user_idx, count(p.item_idx) AS seen_items, (SELECT count(*) FROM items) - count(p.item_idx) AS candidate_items
        FROM users LEFT JOIN pairs p USING (user_idx) GROUP BY user_idx""",
        "users",
        "items",
        "pairs",
    )
    d["popularity_top_k"] = statement(
        "SELECT user_idx, rank, item_idx, round(score, 6) AS score FROM lists WHERE model_name = 'popularity'", "lists"
    )
    vectors = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
    d["l2_normalize_rows"] = f"""
        SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, round(v[pos] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS value
        FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS pos FROM {vectors})"""
    d["dot_product_scores"] = f"""
        SELECT a.vec_id AS user_idx, b.vec_id AS item_idx, round(list_dot_product(a.v, b.v), 6) AS score
        FROM {vectors} a JOIN {vectors} b ON b.vec_id = a.vec_id + 1"""
    d["embedding_top_k"] = f"""
        SELECT user_idx, rank, item_idx, round(s, 6) AS score FROM (
            SELECT user_idx, item_idx, s, row_number() OVER (PARTITION BY user_idx ORDER BY s DESC, item_idx) AS rank FROM (
                SELECT a.vec_id AS user_idx, b.vec_id AS item_idx, list_dot_product(a.v, b.v) AS s
                FROM {vectors} a JOIN {vectors} b ON a.vec_id <> b.vec_id))
        WHERE rank <= 10"""
    d["held_out_truth"] = statement("SELECT user_idx, item_idx FROM truth WHERE split = 'validation'", "truth")
    d["eligible_users"] = statement(
        "SELECT DISTINCT user_idx FROM truth WHERE split = 'validation' AND user_idx IN (SELECT user_idx FROM pairs)",
        "truth",
        "pairs",
    )
    d["rank_candidates"] = statement(
        """SELECT user_idx, item_idx, rank, round(score, 6) AS score FROM (
            SELECT user_idx, item_idx, score, row_number() OVER (PARTITION BY user_idx ORDER BY buyers DESC, item_idx) AS rank FROM (
                SELECT user_idx, p.item_idx, buyers, ln(1 + buyers) / (SELECT ln(1 + max(buyers)) FROM pop) AS score
                FROM users, pop_scores p WHERE (user_idx, p.item_idx) NOT IN (SELECT (user_idx, item_idx) FROM pairs))) WHERE rank <= 20""",
        "users",
        "pairs",
        "pop_scores",
    )
    for metric in ("recall", "hit_rate", "ndcg"):
        d[f"{metric}_at_k"] = statement(
            f"SELECT user_idx, round({metric}, 6) AS {metric} FROM judged WHERE model_name = 'popularity' AND split = 'validation'",
            "judged",
        )
    d["model_metrics"] = statement("SELECT * FROM model_rows", "model_rows")
    d["select_best_model"] = statement(
        """SELECT model_name AS selected_model_name, recall_at_20 FROM model_rows WHERE split = 'validation'
        ORDER BY recall_at_20 DESC, model_name = 'popularity_users' LIMIT 1""",
        "model_rows",
    )
    d["recall_comparison"] = statement(
        """SELECT model_name, v.recall_at_20 AS validation_recall_at_20, t.recall_at_20 AS test_recall_at_20
        FROM model_rows v JOIN model_rows t USING (model_name) WHERE v.split = 'validation' AND t.split = 'test'""",
        "model_rows",
    )
    anchor = "(20 / (SELECT count(*) FROM items))"
    d["random_recall_anchor"] = statement(
        f"""SELECT model_name, split, recall_at_20, round({anchor}, 6) AS random_recall_anchor, round(recall_at_20 / {anchor}, 6) AS lift
        FROM model_rows""",
        "model_rows",
        "items",
    )
    # Both reports: the propensity half is that of the validation and test slices of the stand-in scores.
    val = "(SELECT * FROM scored WHERE slice = 'validation')"
    pairs = f"SELECT 1 AS g, propensity_score, CAST(label_purchase_30d AS BIGINT) AS label FROM {val}"
    reached = "(SELECT count(*) FROM range(10) e(i) WHERE i * 0.1::DOUBLE <= propensity_score)"
    quality = {
        "roc_auc": f"""SELECT (sum(place) FILTER (label = 1) - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)) FROM (
            SELECT label, sum(label) OVER () AS p, count(*) OVER () AS n,
                   rank() OVER (ORDER BY propensity_score) + (count(*) OVER (PARTITION BY propensity_score) - 1) / 2.0::DOUBLE AS place
            FROM ({pairs})) GROUP BY p, n""",
        "average_precision": f"SELECT sum(p::DOUBLE / positives * hits / taken) FROM ({_THRESHOLDS.format(source=f'({pairs})')})",
        "top_decile_lift": f"""SELECT avg(label_purchase_30d) FILTER (r <= greatest(1, n // 10)) / avg(label_purchase_30d)
            FROM (SELECT label_purchase_30d, count(*) OVER () AS n,
                         row_number() OVER (ORDER BY propensity_score DESC, user_id, as_of_date) AS r FROM {val})""",
        "brier_score": f"SELECT avg((propensity_score - label_purchase_30d) ** 2) FROM {val}",
        "ece_10_bin": f"""SELECT sum(abs(s - y) * n) / sum(n) FROM (
            SELECT avg(propensity_score) AS s, avg(label_purchase_30d) AS y, count(*) AS n FROM {val} GROUP BY {reached})""",
    }
    halves = [f"SELECT 'propensity' AS report, 'model' AS area, '{name}' AS kpi, round(({value}), 6) AS value" for name, value in quality.items()]
    for part in ("validation", "test"):
        for policy, score in (("ml_top_expected_value", "expected_value_score"), ("random_baseline", "random_policy_score"), ("rfm_heuristic", "rfm_policy_score")):
            halves.append(
                f"""SELECT 'propensity', 'policy_{part}', '{policy}_revenue_per_user', round(sum(label_net_revenue_30d) / count(*), 6) FROM (
                SELECT * FROM scored WHERE slice = '{part}' ORDER BY round({score}, 6) DESC, user_id LIMIT 200)"""
            )
    halves += [
        "SELECT 'recommender', split, model_name || '_recall_at_20', recall_at_20 FROM model_rows",
        f"SELECT 'recommender', split, model_name || '_lift_over_random', round(recall_at_20 / {anchor}, 6) FROM model_rows",
    ]
    d["interpretation_kpis"] = on_panel(" UNION ALL ".join(halves), "scored", "model_rows", "items")
    return d


def all_statements() -> dict[str, str]:
    return {**gold_statements(), **dq_statements(), **propensity_statements(), **recommender_statements()}
