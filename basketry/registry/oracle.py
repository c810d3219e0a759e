"""The same results as SQL for an independent engine, over the same tables."""

from __future__ import annotations

from basketry.operators.joins import MERGED_COLUMNS, PREPARED_COLUMNS
from basketry.operators.oversample import (
    GAP_DIGITS,
    RANK_DIGITS,
    SCATTER_FACTORS,
    SCATTER_RANGE,
    SPLIT_FACTOR,
)
from basketry.registry.queries import SAMPLE_CENTROIDS, SAMPLE_POINTS, SMOTE_FEATURES
from basketry.registry.tpch import ORACLE_ROLES


def money_sum(x: str, scale: int = 2) -> str:
    return f"coalesce(CAST(sum(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE), 0.0)"


def mean(x: str, scale: int = 4) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE) / count({x})"


def elapsed(end: str, start: str) -> str:
    return f"CAST(floor(date_diff('second', {start}, {end}) / 86400.0) AS BIGINT)"


def quantile(x: str, p: float) -> str:
    """Interpolated quantile spelt out: the built-in one differs in the last bit."""
    values, rank = f"list_sort(list({x}::DOUBLE))", f"{p}::DOUBLE * (count({x}) - 1)"
    low = f"list_extract({values}, CAST(floor({rank}) AS BIGINT) + 1)"
    high = f"list_extract({values}, CAST(ceil({rank}) AS BIGINT) + 1)"
    share = f"({rank} - floor({rank}))"
    return (
        f"CASE WHEN {share} < 0.5 THEN {low} + ({high} - {low}) * {share}"
        f" ELSE {high} - ({high} - {low}) * (1 - {share}) END"
    )


ORDERS = "count(DISTINCT order_id)"
BOUGHT, DELIVERED, ESTIMATED = (
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)

MERGED = f"""
, merged AS (
  SELECT order_id, customer_id, order_status, order_purchase_timestamp, order_approved_at,
         order_delivered_carrier_date, CASE WHEN order_status <> 'P' THEN shipped_item_at END AS {DELIVERED},
         * EXCLUDE (order_id, customer_id, order_status, order_purchase_timestamp, order_approved_at,
                    order_delivered_carrier_date)
  FROM role_orders JOIN role_items USING (order_id) JOIN role_payments USING (order_id)
  JOIN role_reviews USING (order_id) JOIN role_products USING (product_id)
  JOIN role_customers USING (customer_id) JOIN role_sellers USING (seller_id)
)"""

CUSTOMERS = f"""
, customers AS (
  SELECT customer_unique_id, {ORDERS} AS order_count, min({BOUGHT}) AS first_order, max({BOUGHT}) AS last_order
  FROM fact GROUP BY customer_unique_id
)"""

RFM = f"""
, rfm AS (
  SELECT customer_unique_id, {elapsed(f"(SELECT max({BOUGHT}) FROM fact)", f"max({BOUGHT})")} AS recency,
         {ORDERS} AS frequency, {money_sum("price")} AS monetary, {mean("review_score")} AS satisfaction
  FROM fact GROUP BY customer_unique_id
)"""

_CENTRES = ", ".join(f"({i}, {', '.join(str(v) for v in c)})" for i, c in enumerate(SAMPLE_CENTROIDS))
SEGMENTS = f"""{RFM}
, centres(c, a, b, d, e) AS (VALUES {_CENTRES})
, distances AS (
  SELECT rfm.*, c, (recency-a)*(recency-a) + (frequency-b)*(frequency-b)
         + (monetary/100000.0-d)*(monetary/100000.0-d) + (satisfaction-e)*(satisfaction-e) AS dist
  FROM rfm CROSS JOIN centres
)
, segments AS (
  SELECT customer_unique_id, recency, frequency, monetary, satisfaction, CAST(c AS INTEGER) AS cluster
  FROM distances QUALIFY row_number() OVER (PARTITION BY customer_unique_id ORDER BY dist, c) = 1
)"""


def histogram(rows: str, x: str, bins: int) -> str:
    """CTEs ``bars`` over the column x of ``rows``; the column must not be constant."""
    return f"""
, ext AS (SELECT min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi FROM {rows})
, counted AS (
  SELECT CAST(least(floor(({x} - lo) * {bins} / (hi - lo)), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
  FROM {rows} CROSS JOIN ext WHERE {x} IS NOT NULL GROUP BY 1
)
, bars AS (
  SELECT CAST(r.i AS INTEGER) AS bin, lo + r.i * (hi - lo) / {bins} AS low, lo + (r.i + 1) * (hi - lo) / {bins} AS high,
         coalesce(n, 0) AS row_count
  FROM range({bins}) r(i) CROSS JOIN ext LEFT JOIN counted ON counted.bin = r.i
)"""


def density(rows: str, x: str, bins: int, points: int = 200) -> str:
    return f"""
, weighted AS (SELECT {x}::DOUBLE AS v, count(*) AS w FROM {rows} WHERE {x} IS NOT NULL GROUP BY 1)
, dstats AS (
  SELECT count({x}) AS n, min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi,
         stddev_samp({x}::DOUBLE) * pow(count({x}), -0.2) AS bw FROM {rows}
)
, line AS (
  SELECT CAST(g.i AS INTEGER) AS point, lo + g.i * (hi - lo) / {points - 1} AS position,
         sum(w * exp(-0.5 * pow((lo + g.i * (hi - lo) / {points - 1} - v) / bw, 2)))
           * ((hi - lo) / {bins}) / (bw * sqrt(2 * pi())) AS density
  FROM range({points}) g(i) CROSS JOIN dstats CROSS JOIN weighted GROUP BY g.i, lo, hi, bw
)"""


def binned_density(rows: str, x: str, bins: int, points: int = 200, tolerance: float = 1e-5) -> str:
    """Every value shared by the two grid positions around it, then a kernel per grid position."""
    return f"""
, dstats AS (
  SELECT min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi, stddev_samp({x}::DOUBLE) * pow(count({x}), -0.2) AS bw FROM {rows}
)
, placed AS (SELECT ({x} - lo) / (bw * sqrt(8 * {tolerance!r}::DOUBLE)) AS a FROM {rows} CROSS JOIN dstats WHERE {x} IS NOT NULL)
, cells AS (
  SELECT c, sum(share) AS w FROM (
    SELECT floor(a) AS c, 1 - (a - floor(a)) AS share FROM placed UNION ALL SELECT floor(a) + 1, a - floor(a) FROM placed
  ) GROUP BY c
)
, line AS (
  SELECT CAST(g.i AS INTEGER) AS point, lo + g.i * (hi - lo) / {points - 1} AS position,
         sum(w * exp(-0.5 * pow((g.i * (hi - lo) / {points - 1} - c * bw * sqrt(8 * {tolerance!r}::DOUBLE)) / bw, 2)))
           * ((hi - lo) / {bins}) / (bw * sqrt(2 * pi())) AS density
  FROM range({points}) g(i) CROSS JOIN dstats CROSS JOIN cells GROUP BY g.i, lo, hi, bw
)"""


def _quartiles(question: str, group: str, by: str = "") -> str:
    values = ("delivery_time", "freight_value", "price")
    parts = ", ".join(f"{quantile(v, 0.25 * i)} AS {v}_q{i}" for v in values for i in (1, 2, 3))
    tail = f" WHERE {by} IS NOT NULL GROUP BY {by}" if by else ""
    return f"SELECT '{question}' AS question, {group} AS group_key, {parts} FROM fact{tail}"


def distribution(rows: str, x: str, bins: int) -> str:
    return (
        histogram(rows, x, bins)
        + density(rows, x, bins)
        + """
SELECT 'bar' AS part, bin AS position, round(low, 6) AS x, CAST(row_count AS DOUBLE) AS y FROM bars
UNION ALL SELECT 'line', point, round(position, 6), round(density, 6) FROM line"""
    )


def box(rows: str, x: str, by: str) -> str:
    return f"""
, quart AS (
  SELECT {by}, {quantile(x, 0.25)} AS q1, {quantile(x, 0.5)} AS med, {quantile(x, 0.75)} AS q3
  FROM {rows} WHERE {x} IS NOT NULL AND {by} IS NOT NULL GROUP BY {by}
)
, fenced AS (
  SELECT quart.*, {x}::DOUBLE AS v, {x} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM {rows} JOIN quart USING ({by}) WHERE {x} IS NOT NULL
)"""


def box_stats(rows: str, x: str, by: str) -> str:
    return (
        box(rows, x, by)
        + f"""
SELECT {by}, q1, med AS median, q3, least(min(v) FILTER (inside), q1) AS whisker_low,
       greatest(max(v) FILTER (inside), q3) AS whisker_high, count(*) FILTER (NOT inside) AS outliers,
       count(*) AS row_count
FROM fenced GROUP BY {by}, q1, med, q3"""
    )


STATE_PAIRS = f"""
, pairs AS (
  SELECT customer_state, seller_state, {mean("freight_value")} AS mean_freight, {mean("price")} AS mean_price,
         customer_state = seller_state AS is_same_state
  FROM fact GROUP BY customer_state, seller_state
)"""

STATE_SALES = f"""
, state_sales AS (
  SELECT customer_state, {ORDERS} AS order_count, {money_sum("price")} AS total_price,
         {mean("freight_value")} AS mean_freight, {mean("review_score")} AS mean_score, any_value(region) AS region
  FROM fact LEFT JOIN role_regions ON customer_state = state GROUP BY customer_state
)"""

STATE_TABLE = """
SELECT *, concat('R$ ', format('{:,.2f}', total_price)) AS total_price_text,
       concat('R$ ', format('{:,.2f}', mean_freight)) AS mean_freight_text,
       format('{:.2f}', mean_score) AS mean_score_text
FROM state_sales"""

SCORES = """
, scores AS (
  SELECT price AS score, CAST(sum(is_late) AS BIGINT) AS pos, CAST(sum(1 - is_late) AS BIGINT) AS neg, count(*) AS n
  FROM fact GROUP BY price
)
, running AS (
  SELECT *, CAST(sum(pos) OVER falling AS BIGINT) AS tp, CAST(sum(neg) OVER falling AS BIGINT) AS fp,
         CAST(sum(n) OVER rising AS BIGINT) AS upto, sum(pos) OVER () AS p_all, sum(neg) OVER () AS n_all,
         lead(pos) OVER falling AS next_pos, lead(neg) OVER falling AS next_neg, row_number() OVER falling AS place
  FROM scores WINDOW falling AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING),
                     rising AS (ORDER BY score ROWS UNBOUNDED PRECEDING)
)"""

RULE_MATRIX = """
, rule AS (SELECT is_late AS label, CAST(price > 50000 AS INTEGER) AS prediction FROM fact)"""


def _per_class() -> str:
    rows = []
    for c in (0, 1):
        hits = f"count(*) FILTER (label = {c} AND prediction = {c})"
        called, support = f"count(*) FILTER (prediction = {c})", f"count(*) FILTER (label = {c})"
        rows.append(
            f"SELECT '{c}' AS class, {hits} / {called}::DOUBLE AS precision, {hits} / {support}::DOUBLE AS recall,"
            f" 2.0 * {hits} / ({called} + {support}) AS f1, {support} AS support FROM rule"
        )
    return ", classes AS (" + " UNION ALL ".join(rows) + ")"


def _report() -> str:
    measures = ("precision", "recall", "f1")
    macro = ", ".join(f"avg({m})" for m in measures)
    weighted = ", ".join(f"sum({m} * support) / sum(support)" for m in measures)
    rounded = ", ".join(f"round({m}, 9) AS {m}" for m in measures)
    return f"""{RULE_MATRIX}{_per_class()}
, report AS (
  SELECT * FROM classes
  UNION ALL SELECT 'accuracy', avg((label = prediction)::INTEGER), avg((label = prediction)::INTEGER),
                   avg((label = prediction)::INTEGER), count(*) FROM rule
  UNION ALL SELECT 'macro avg', {macro}, CAST(sum(support) AS BIGINT) FROM classes
  UNION ALL SELECT 'weighted avg', {weighted}, CAST(sum(support) AS BIGINT) FROM classes
)
SELECT class, {rounded}, support FROM report"""


def _iqr_chain() -> str:
    text, source = RFM, "rfm"
    for i, m in enumerate(("recency", "frequency", "monetary", "satisfaction"), start=1):
        text += f"""
, fence{i} AS (SELECT quantile_cont({m}::DOUBLE, 0.25) AS q1, quantile_cont({m}::DOUBLE, 0.75) AS q3 FROM {source})
, kept{i} AS (SELECT {source}.* FROM {source} CROSS JOIN fence{i}
              WHERE {m} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""
        source = f"kept{i}"
    return f"{text} SELECT * FROM {source}"


VERY_LATE = f"delivery_time > (SELECT {quantile('delivery_time', 0.95)} FROM fact)"


def _neighbours() -> str:
    """Five nearest very late rows by brute force within a band of prices.

    A row whose fifth distance lies inside its band is settled; the others are compared with all.
    """
    d2 = "(q.a-p.a)*(q.a-p.a) + (q.b-p.b)*(q.b-p.b) + (q.c-p.c)*(q.c-p.c)"
    best = "QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY distance2, p.a, p.b, p.c) <= 5"
    columns = f"q.id, q.a, q.b, q.c, p.a AS na, p.b AS nb, p.c AS nc, {d2} AS distance2"
    return f"""
, late AS MATERIALIZED (
  SELECT row_number() OVER () AS id, price AS a, freight_value AS b, CAST(delivery_time AS DOUBLE) AS c
  FROM fact WHERE {VERY_LATE}
)
, banded AS MATERIALIZED (
  SELECT {columns} FROM late q JOIN late p ON p.a BETWEEN q.a - 1000 AND q.a + 1000 AND p.id <> q.id {best}
)
, settled AS MATERIALIZED (
  SELECT id FROM banded GROUP BY id HAVING count(*) = 5 AND max(distance2) < 1000.0 * 1000.0
)
, rest AS (
  SELECT {columns} FROM (SELECT * FROM late WHERE id NOT IN (SELECT id FROM settled)) q
  JOIN late p ON p.id <> q.id {best}
)
, found AS (
  SELECT * FROM rest UNION ALL SELECT banded.* FROM banded WHERE id IN (SELECT id FROM settled)
)
SELECT a AS price, b AS freight_value, c AS delivery_time,
       CAST(row_number() OVER (PARTITION BY id ORDER BY distance2, na, nb, nc) AS INTEGER) AS neighbour_rank,
       na AS neighbour_price, nb AS neighbour_freight_value, nc AS neighbour_delivery_time, distance2
FROM found"""


def _hex(text: str, start: int, digits: int) -> str:
    return f"('0x' || substr({text}, {start}, {digits}))::BIGINT"


def _oversampled(label: str, value: str, key: str = "0") -> str:
    """CTE ``balanced``: the rows of the fact and the synthetic ones of the smaller class, with the number of the draw."""
    scatter = " + ".join(
        f"CAST(floor({f} * 10000 + 0.5) AS HUGEINT) * {SCATTER_FACTORS[i]}" for i, f in enumerate(SMOTE_FEATURES)
    )
    f = ", ".join(SMOTE_FEATURES)
    gap = f"{_hex('h', *GAP_DIGITS)} / {float(16 ** GAP_DIGITS[1])}::DOUBLE"
    made = ", ".join(f"q.{x} + {gap} * (p.{x} - q.{x}) AS {x}" for x in SMOTE_FEATURES)
    d2 = " + ".join(f"(q.{x} - p.{x}) * (q.{x} - p.{x})" for x in SMOTE_FEATURES)
    order = ", ".join(f"p.{x}" for x in SMOTE_FEATURES)
    return f"""
, feats AS MATERIALIZED (SELECT price, freight_value, CAST(delivery_time AS DOUBLE) AS delivery_time,
  {value} AS {label}, {key} AS row_key FROM fact)
, sizes AS (SELECT {label}, count(*) AS n FROM feats GROUP BY {label})
, small AS (SELECT {label}, n FROM sizes ORDER BY n, {label} LIMIT 1)
, keyed AS (
  SELECT feats.*, {scatter} AS raw FROM feats WHERE {label} = (SELECT {label} FROM small)
)
, minority AS MATERIALIZED (
  SELECT {f}, row_number() OVER (ORDER BY ((raw % {SCATTER_RANGE}) + {SCATTER_RANGE}) % {SCATTER_RANGE}, {f}) - 1 AS id
  FROM keyed
)
, draws AS (
  SELECT draw, id, h, {_hex('h', *RANK_DIGITS)} % 5 + 1 AS wanted
  FROM (SELECT i AS draw, i % n AS id, md5(concat(i % n, ':', i // n)) AS h
        FROM range((SELECT max(n) - min(n) FROM sizes)) r(i) CROSS JOIN small)
)
, bases AS MATERIALIZED (SELECT * FROM minority WHERE id IN (SELECT id FROM draws))
, ranked AS (
  SELECT q.id, {", ".join(f"p.{x}" for x in SMOTE_FEATURES)},
         row_number() OVER (PARTITION BY q.id ORDER BY {d2}, {order}) AS place
  FROM bases q JOIN minority p ON p.id <> q.id QUALIFY place <= 5
)
, balanced AS (
  SELECT {f}, {label}, false AS synthetic, row_key FROM feats
  UNION ALL
  SELECT {made}, (SELECT {label} FROM small), true, {_key("concat('synthetic:', draw)")}
  FROM draws JOIN bases q USING (id) JOIN ranked p ON p.id = draws.id AND p.place = draws.wanted
)"""


def _key(text: str) -> str:
    return _hex(f"md5({text})", 1, 13)


def _smote() -> str:
    rows = _oversampled("is_very_late", f"CAST({VERY_LATE} AS INTEGER)")
    return f"{rows} SELECT {', '.join(SMOTE_FEATURES)}, is_very_late, synthetic FROM balanced"


def _test_rows() -> str:
    parts = ["order_id", "customer_unique_id", "seller_id"]
    parts += [f"CAST(floor({f}::DOUBLE * 10000 + 0.5) AS BIGINT)" for f in SMOTE_FEATURES]
    rows = _oversampled("is_late", "is_late", _key(f"concat_ws(':', {', '.join(parts)})"))
    return f"{rows}, tests AS (SELECT * FROM balanced WHERE (row_key % 1000 * {SPLIT_FACTOR}) % 1000 >= 700)"


ROLES = {
    "orders": "role_orders",
    "order_items": "role_items",
    "products": "role_products",
    "customers": "role_customers",
    "sellers": "role_sellers",
    "order_reviews": "role_reviews",
    "payments": "role_payments",
}
# The columns of the given tables by type; all others are strings.
TYPED = {
    "bigint": "order_id customer_id customer_unique_id product_id seller_id review_id",
    "int": "order_item_id payment_sequential payment_installments review_score product_name_length product_description_lenght product_photos_qty",
    "double": "price freight_value payment_value product_weight_g product_length_cm product_height_cm product_width_cm",
    "timestamp_ntz": "order_purchase_timestamp order_approved_at order_delivered_carrier_date order_estimated_delivery_date shipping_limit_date review_creation_date review_answer_timestamp",
}
# The first table that has a column.
OWNERS = {
    "orders": "order_id customer_id order_status order_purchase_timestamp order_approved_at order_delivered_carrier_date order_estimated_delivery_date",
    "order_items": "order_item_id product_id seller_id shipping_limit_date price freight_value",
    "payments": "payment_sequential payment_type payment_installments payment_value",
    "order_reviews": "review_id review_score review_comment_title review_comment_message review_creation_date review_answer_timestamp",
    "products": "product_category_name product_name_length product_description_lenght product_photos_qty product_weight_g product_length_cm product_height_cm product_width_cm",
    "customers": "customer_unique_id customer_zip_code_prefix customer_city customer_state",
    "sellers": "seller_zip_code_prefix seller_city seller_state",
}


def _schema() -> str:
    kind = {c: t for t, names in TYPED.items() for c in names.split()}
    owner = {c: t for t, names in OWNERS.items() for c in names.split()}
    names = [c for c in MERGED_COLUMNS if c != DELIVERED]
    rows = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, '{owner[c]}' AS table_name, '{kind.get(c, 'string')}' AS type,"
        f" count({c}) AS filled FROM {ROLES[owner[c]]}"
        for i, c in enumerate(names, start=1)
    )
    return rows


def _counts() -> str:
    views = ROLES | {"geolocation": "nation", "category_translation": "(SELECT DISTINCT p_type FROM part)"}
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {role}" for name, role in views.items()
    )


_SCALE = ", ".join(
    f"round(({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER (), 6) AS {m}_z"
    for m in ("recency", "frequency", "monetary", "satisfaction")
)
_MEASURES = ("recency", "frequency", "monetary", "satisfaction")
_KEPT = _iqr_chain().removesuffix(" SELECT * FROM kept4")



def _three_rounds() -> str:
    """Three iterations of k-means from fixed centres, for both restarts at once."""
    from basketry.registry.queries import START_CENTRES

    axes = [f"{m}_z" for m in _MEASURES]
    values = ", ".join(
        f"({r}, {c}, {', '.join(f'{x}::DOUBLE' for x in centre)})"
        for r, centres in enumerate(START_CENTRES)
        for c, centre in enumerate(centres)
    )
    gap = " + ".join(f"(z.{a} - c.{a}) * (z.{a} - c.{a})" for a in axes)
    steps = [f"z AS (SELECT customer_unique_id, {_SCALE} FROM rfm), c0 AS (SELECT * FROM (VALUES {values}) t(restart, cluster, {', '.join(axes)}))"]
    for i in range(4):
        steps.append(
            f"a{i} AS (SELECT z.*, c.restart, c.cluster FROM z, c{i} c QUALIFY row_number() OVER (PARTITION BY customer_unique_id, restart ORDER BY {gap}, cluster) = 1)"
        )
        means = ", ".join(f"coalesce(avg(a.{x}), any_value(c.{x})) AS {x}" for x in axes)
        steps.append(
            f"c{i + 1} AS (SELECT c.restart, c.cluster, {means} FROM c{i} c LEFT JOIN a{i} a ON c.restart = a.restart AND c.cluster = a.cluster GROUP BY c.restart, c.cluster)"
        )
    rounded = ", ".join(f"round(c.{a}, 6) AS {a}" for a in axes)
    return (
        f"{RFM}, {', '.join(steps)} SELECT c.restart, c.cluster, (SELECT count(*) FROM a3 a WHERE a.restart = c.restart AND a.cluster = c.cluster) AS customers, {rounded} FROM c3 c"
    )


def _inferred() -> str:
    """The type of every column of the nine exported tables, from the tables themselves."""
    views = ROLES | {
        "geolocation": "(SELECT n_nationkey AS geolocation_zip_code_prefix, n_name AS geolocation_state FROM nation)",
        "category_translation": "(SELECT p_type AS product_category_name, lower(p_type) AS product_category_name_english FROM part)",
    }
    kind = "CASE kind WHEN 'BIGINT' THEN 'int' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'string' END"
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, column_name, {kind} AS type FROM (UNPIVOT (SELECT typeof(COLUMNS(*)) FROM {view} LIMIT 1) ON COLUMNS(*) INTO NAME column_name VALUE kind)"
        for name, view in views.items()
    )


# fmt: off
QUERIES: dict[str, str] = {
    "scan_csv": "SELECT * FROM role_orders",
    "scan_csv_inferred": _inferred(),
    "load_catalog": _counts(),
    "rename_on_load": "SELECT product_id, product_name_length, product_description_lenght FROM role_products",
    "table_sink_replace": "SELECT * EXCLUDE (shipped_item_at) FROM role_items",
    "import_row_counts": _counts(),
    "sql_view": f"{MERGED} SELECT order_status, count(*) AS merged_rows, {ORDERS} AS order_count, CAST(sum(payment_installments) AS BIGINT) AS installments FROM merged GROUP BY order_status",
    "sql_scan": "SELECT order_id, price, freight_value, product_category_name, customer_state, seller_state, review_score FROM prepared",
    "table_schema": _schema(),
    "report_sink": STATE_SALES + STATE_TABLE,
    "project_merged": f"{MERGED} SELECT {', '.join(MERGED_COLUMNS)} FROM merged",
    "project_prepared": f"SELECT {', '.join(PREPARED_COLUMNS)} FROM prepared",
    "drop_missing_dates": f"SELECT order_id, {DELIVERED}, {BOUGHT} FROM prepared WHERE {DELIVERED} IS NOT NULL AND {BOUGHT} IS NOT NULL",
    "filter_price_positive": "SELECT order_id, price FROM prepared WHERE price > 0",
    "filter_freight_nonneg": "SELECT order_id, freight_value FROM prepared WHERE freight_value >= 0",
    "fill_median": "SELECT order_id, price, review_score FROM fact",
    "drop_missing_features": f", aged AS (SELECT *, {elapsed(DELIVERED, BOUGHT)} AS delivery_time FROM prepared) SELECT order_id, price, freight_value, delivery_time, product_weight_g FROM aged WHERE price IS NOT NULL AND freight_value IS NOT NULL AND delivery_time IS NOT NULL AND product_weight_g IS NOT NULL",
    "filter_recurring": f"{CUSTOMERS} SELECT customer_unique_id, order_count FROM customers WHERE order_count > 1",
    "filter_state_known": "SELECT order_id, customer_state, product_category_name FROM prepared WHERE customer_state IS NOT NULL AND product_category_name IS NOT NULL",
    "filter_iqr": f"{RFM}, f AS (SELECT quantile_cont(monetary, 0.25) AS q1, quantile_cont(monetary, 0.75) AS q3 FROM rfm) SELECT customer_unique_id, monetary FROM rfm CROSS JOIN f WHERE monetary BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)",
    "filter_cluster": f"{SEGMENTS} SELECT customer_unique_id, recency, monetary, cluster FROM segments WHERE cluster = 1",
    "rename_columns": f"{CUSTOMERS} SELECT * FROM customers",
    "flag_same_state": "SELECT order_id, customer_state, seller_state, customer_state = seller_state AS is_same_state FROM prepared",
    "merged_view": f"{MERGED} SELECT order_id, count(*) AS merged_rows, CAST(sum(payment_installments) AS BIGINT) AS installments, {money_sum('payment_value', 4)} AS paid, CAST(sum(review_score) AS BIGINT) AS score_sum FROM merged GROUP BY order_id",
    "merged_totals_by_order": f"{MERGED} SELECT order_id, count(*) AS merged_rows, CAST(sum(payment_installments) AS BIGINT) AS installments, {money_sum('payment_value', 4)} AS paid, CAST(sum(review_score) AS BIGINT) AS score_sum FROM merged GROUP BY order_id",
    "merged_totals_by_status": f"{MERGED} SELECT order_status, count(*) AS merged_rows, {ORDERS} AS order_count, CAST(sum(payment_installments) AS BIGINT) AS installments FROM merged GROUP BY order_status",
    "prepared_join": f"SELECT order_id, count(*) AS item_rows, count(review_score) AS scored_rows, {money_sum('price')} AS total_price FROM prepared GROUP BY order_id",
    "left_join_reviews": "SELECT order_id, order_status, review_id, review_score FROM role_orders LEFT JOIN role_reviews USING (order_id)",
    "lookup_state_region": "SELECT customer_state, count(*) AS customers, any_value(region) AS region FROM role_customers LEFT JOIN role_regions ON customer_state = state GROUP BY customer_state",
    "scalar_broadcast": f"SELECT customer_unique_id, max({BOUGHT}) AS last_order, (SELECT max({BOUGHT}) FROM fact) AS latest, (SELECT median(review_score) FROM fact) AS median_score FROM fact GROUP BY customer_unique_id",
    "knn_self_join": _neighbours(),
    "nearest_centroid": f"{SEGMENTS} SELECT customer_unique_id, cluster FROM segments",
    "agg_count_distinct": f"SELECT seller_id, {ORDERS} AS order_count FROM fact GROUP BY seller_id",
    "agg_sum": f"SELECT seller_id, {money_sum('price')} AS total_price FROM fact GROUP BY seller_id",
    "agg_mean": f"SELECT customer_state, {mean('freight_value')} AS mean_freight, {mean('price')} AS mean_price, {mean('review_score')} AS mean_score, {mean('delivery_time', 0)} AS mean_delivery_time FROM fact GROUP BY customer_state",
    "agg_median": "SELECT customer_state, median(price) AS price, median(freight_value) AS freight, median(delivery_time::DOUBLE) AS delivery_time FROM fact GROUP BY customer_state",
    "agg_stddev_samp": "SELECT review_score, round(stddev_samp(delivery_time), 6) AS delivery_time_std, round(stddev_samp(price), 6) AS price_std FROM fact GROUP BY review_score",
    "agg_count_rows": "SELECT product_category_name, count(review_score) AS row_count FROM prepared WHERE product_category_name IS NOT NULL GROUP BY product_category_name",
    "agg_min_max": f"SELECT customer_unique_id, min({BOUGHT}) AS first_order, max({BOUGHT}) AS last_order FROM fact GROUP BY customer_unique_id",
    "agg_global": f"{CUSTOMERS} SELECT (SELECT max({BOUGHT}) FROM fact) AS latest, (SELECT count(*) FROM fact) AS row_count, count(*) AS customers, count(*) FILTER (order_count > 1) AS recurring_customers, count(*) FILTER (order_count > 1) / count(*)::DOUBLE AS recurring_share, (SELECT median(review_score) FROM fact) AS median_score FROM customers",
    "agg_multi_key": f"{STATE_PAIRS} SELECT customer_state, seller_state, mean_freight, mean_price FROM pairs",
    "agg_two_level": ", totals AS (SELECT order_id, customer_state, sum(CAST(price AS DECIMAL(18,2))) AS t FROM fact GROUP BY order_id, customer_state) SELECT customer_state, CAST(sum(t) AS DOUBLE) / count(t) AS mean_order_value FROM totals GROUP BY customer_state",
    "quantile_exact": "SELECT " + ", ".join(f"{quantile(c, p)} AS {c}_q{round(p * 100)}" for c in SMOTE_FEATURES for p in (0.25, 0.75)) + " FROM fact",
    "quantiles_from_summary": " UNION ALL ".join((_quartiles("state", "customer_state", "customer_state"), _quartiles("score", "CAST(CAST(review_score AS INTEGER) AS VARCHAR)", "review_score"), _quartiles("all", "''"))),
    "value_counts": f"{SEGMENTS} SELECT cluster, frequency, count(*) AS row_count FROM segments GROUP BY cluster, frequency",
    "agg_last_custom": f"SELECT customer_unique_id, {elapsed(f'(SELECT max({BOUGHT}) FROM fact)', f'max({BOUGHT})')} AS recency FROM fact GROUP BY customer_unique_id",
    "cumulative_rates": f"{SCORES} SELECT score AS threshold, tp AS true_positives, fp AS false_positives, fp::DOUBLE / n_all::DOUBLE AS fpr, tp::DOUBLE / p_all::DOUBLE AS tpr FROM running",
    "rank_average": f"{SCORES} SELECT score, pos AS positives, neg AS negatives, n AS row_count, upto - (n - 1) / 2.0::DOUBLE AS average_rank FROM running",
    "sort_desc": f"SELECT customer_state, {money_sum('price')} AS total_price FROM fact GROUP BY customer_state ORDER BY total_price DESC, customer_state",
    "sort_index": f"SELECT order_month, {money_sum('price')} AS total_price FROM fact GROUP BY order_month ORDER BY order_month",
    "top_k": f"SELECT seller_id, {money_sum('price')} AS total_price FROM fact GROUP BY seller_id ORDER BY total_price DESC, seller_id LIMIT 10",
    "append_rows": "SELECT order_id, price, freight_value FROM fact UNION ALL SELECT order_id, price, freight_value FROM fact WHERE is_late = 0",
    "train_test_split": f"SELECT order_id, price, (order_id % 1000 * {SPLIT_FACTOR}) % 1000 < 700 AS is_train FROM fact",
    "parse_timestamp": f"SELECT order_id, {BOUGHT} AS strict, CASE WHEN order_id % 7 <> 0 THEN {BOUGHT} END AS lenient FROM role_orders",
    "elapsed_days_floor": f"SELECT order_id, {elapsed(DELIVERED, BOUGHT)} AS days, {elapsed(BOUGHT, DELIVERED)} AS days_back FROM fact",
    "late_flag": f"SELECT order_id, {DELIVERED}, coalesce(CAST({DELIVERED} > {ESTIMATED} AS INTEGER), 0) AS is_late FROM prepared",
    "month_key": f"SELECT order_id, strftime({DELIVERED}, '%Y-%m') AS month FROM fact",
    "day_of_week": f"SELECT order_id, CAST(isodow({DELIVERED}) AS INTEGER) AS day FROM fact",
    "bool_to_int": "SELECT order_id, CAST(price > 50000 AS INTEGER) AS dear FROM fact",
    "format_currency": "SELECT order_id, concat('R$ ', format('{:,.2f}', price)) AS text FROM fact",
    "format_fixed": "SELECT order_id, format('{:.2f}', freight_value) AS text FROM fact",
    "format_percent": "SELECT order_id, concat(format('{:.2f}', delivery_time / 1000.0::DOUBLE * 100), '%') AS text FROM fact",
    "abbreviate_id": "SELECT order_id, concat(substring(concat('seller-', seller_id), 1, 6), '...') AS text FROM fact",
    "round_digits": "SELECT order_id, round_even(price / 7, 6) AS rounded FROM fact",
    "add_subtract_interval": f"SELECT order_id, {ESTIMATED} + to_seconds(date_diff('second', {BOUGHT}, {DELIVERED})) AS moved FROM fact",
    "divide_ratio": "SELECT product_category_name, customer_state, CAST(sum(is_late) AS DOUBLE) / count(*) AS share, CAST(NULL AS DOUBLE) AS undefined FROM fact WHERE product_category_name IS NOT NULL GROUP BY product_category_name, customer_state",
    "histogram_equal_width": histogram("fact", "price", 30) + " SELECT bin, round(low, 6) AS low, round(high, 6) AS high, row_count FROM bars",
    "kde_gaussian": density("fact", "delivery_time", 30) + " SELECT point, round(position, 6) AS position, round(density, 6) AS density FROM line",
    "kde_binned": binned_density("fact", "price", 30) + " SELECT point, round(position, 6) AS position, round(density, 6) AS density FROM line",
    "kde_binned_check": "SELECT CAST(i AS INTEGER) AS point, true AS within_bound FROM range(200) g(i) WHERE (SELECT count(DISTINCT price) FROM fact) > 1",
    "box_stats": box_stats("fact", "freight_value", "customer_state"),
    "box_outliers": box("fact", "freight_value", "customer_state") + " SELECT customer_state, v AS freight_value FROM fenced WHERE NOT inside",
    "count_by_category": "SELECT review_score, count(*) AS row_count FROM fact GROUP BY review_score",
    "scatter_points": "SELECT price AS x, freight_value AS y, review_score FROM fact",
    "scatter_sample": f"SELECT price AS x, freight_value AS y, review_score FROM fact ORDER BY md5(concat(':', order_id, ':', seller_id)), x NULLS FIRST, y NULLS FIRST, review_score NULLS FIRST LIMIT {SAMPLE_POINTS}",
    "heat_row": f"{STATE_SALES} SELECT customer_state, region, total_price FROM state_sales",
    "standard_scale": f"{RFM} SELECT customer_unique_id, {_SCALE} FROM rfm",
    "cluster_summary": f"{SEGMENTS} SELECT cluster, " + ", ".join(f"round_even(avg({m}), 6) AS {m}_mean, round_even(median({m}::DOUBLE), 6) AS {m}_median" for m in _MEASURES) + ", count(*) AS customers FROM segments GROUP BY cluster",
    "cluster_profile": f"{SEGMENTS} SELECT cluster, count(*) AS customers, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean" for m in _MEASURES) + " FROM segments GROUP BY cluster",
    "smote_oversample": _smote(),
    "confusion_matrix": f"{RULE_MATRIX} SELECT label, prediction, count(*) AS row_count FROM rule GROUP BY label, prediction",
    "classification_report": _report(),
    "roc_auc": f"{SCORES} SELECT round((CAST(sum((2 * upto - n + 1) * pos) AS DOUBLE) / 2 - CAST(sum(pos) AS DOUBLE) * (sum(pos) + 1) / 2) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 9) AS auc FROM running",
    "roc_curve": f"{SCORES} SELECT score AS threshold, fp::DOUBLE / n_all::DOUBLE AS fpr, tp::DOUBLE / p_all::DOUBLE AS tpr FROM running WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg UNION ALL SELECT 'infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE",
    "feature_matrix": "SELECT price, freight_value, delivery_time::DOUBLE AS delivery_time, is_late::DOUBLE AS label FROM fact",
    "prepared_fact": "SELECT * EXCLUDE (product_weight_g) FROM fact",
    "monthly_orders": f"SELECT order_month, {ORDERS} AS order_count FROM fact GROUP BY order_month ORDER BY order_month",
    "delivery_time_distribution": distribution("fact", "delivery_time", 30),
    "freight_by_state_pair": f"{STATE_PAIRS} SELECT * FROM pairs",
    "freight_same_state_box": STATE_PAIRS + box_stats("pairs", "mean_freight", "is_same_state"),
    "freight_vs_price_points": f"{STATE_PAIRS} SELECT mean_price AS x, mean_freight AS y FROM pairs",
    "top_categories_revenue": f"SELECT product_category_name, {money_sum('price')} AS total_price FROM fact WHERE product_category_name IS NOT NULL GROUP BY product_category_name ORDER BY total_price DESC, product_category_name LIMIT 10",
    "top_states_avg_order_value": ", totals AS (SELECT order_id, customer_state, sum(CAST(price AS DECIMAL(18,2))) AS t FROM fact GROUP BY order_id, customer_state) SELECT customer_state, CAST(sum(t) AS DOUBLE) / count(t) AS mean_order_value FROM totals GROUP BY customer_state ORDER BY mean_order_value DESC, customer_state LIMIT 10",
    "customer_retention": f"{CUSTOMERS}, r AS (SELECT count(*) AS customers, count(*) FILTER (order_count > 1) AS recurring_customers FROM customers) SELECT *, recurring_customers / customers::DOUBLE AS recurring_share, concat(format('{{:.2f}}', recurring_customers / customers::DOUBLE * 100), '%') AS recurring_percent FROM r",
    "orders_per_customer_distribution": CUSTOMERS + distribution("customers", "order_count", 20),
    "days_first_to_last_order": f"{CUSTOMERS} SELECT *, {elapsed('last_order', 'first_order')} AS days_between_orders FROM customers WHERE order_count > 1",
    "days_first_to_last_distribution": f"{CUSTOMERS}, gaps AS (SELECT {elapsed('last_order', 'first_order')} AS days FROM customers WHERE order_count > 1)" + distribution("gaps", "days", 30),
    "state_sales_table": STATE_SALES + STATE_TABLE + " ORDER BY total_price DESC, customer_state",
    "sales_heatmap": f"{STATE_SALES} SELECT customer_state, region, total_price FROM state_sales ORDER BY total_price DESC, customer_state",
    "monthly_sales": f"SELECT order_month, {ORDERS} AS order_count, {money_sum('price')} AS total_price FROM fact GROUP BY order_month ORDER BY order_month",
    "top_categories_dashboard": f"SELECT product_category_name, {ORDERS} AS order_count, {money_sum('price')} AS total_price FROM fact WHERE product_category_name IS NOT NULL GROUP BY product_category_name ORDER BY total_price DESC, product_category_name LIMIT 10",
    "monthly_delivery_time": f"SELECT order_month, {mean('delivery_time', 0)} AS mean_delivery_time FROM fact GROUP BY order_month ORDER BY order_month",
    "top_sellers": f"SELECT seller_id, {ORDERS} AS order_count, {money_sum('price')} AS total_price, {mean('review_score')} AS mean_score, concat(substring(CAST(seller_id AS VARCHAR), 1, 6), '...') AS seller_label FROM fact GROUP BY seller_id ORDER BY total_price DESC, seller_id LIMIT 10",
    "top_states_sales": f"{STATE_SALES} SELECT * FROM state_sales ORDER BY total_price DESC, customer_state LIMIT 10",
    "rfm_scores": f"{RFM} SELECT * FROM rfm",
    "rfm_without_outliers": _iqr_chain(),
    "satisfaction_vs_delivery_box": box_stats("fact", "delivery_time", "review_score"),
    "satisfaction_vs_price_box": box_stats("fact", "price", "review_score"),
    "satisfaction_stats": "SELECT review_score, " + ", ".join(f"round_even({mean(c, s)}, 6) AS {c}_mean, round_even(median({c}::DOUBLE), 6) AS {c}_median, round_even(stddev_samp({c}), 6) AS {c}_std" for c, s in (("delivery_time", 0), ("price", 4))) + ", count(order_id) AS order_rows FROM fact GROUP BY review_score ORDER BY review_score",
    "score_distribution": "SELECT review_score, count(*) AS row_count FROM fact GROUP BY review_score ORDER BY review_score",
    "kmeans_segments_check": f"{_KEPT} SELECT customer_unique_id, {_SCALE}, true AS own_is_nearest, true AS cluster_known FROM kept4",
    "kmeans_three_rounds": _three_rounds(),
    "delay_cells_check": f"{_test_rows()} SELECT CAST(count(*) AS BIGINT) AS train_rows, true AS cells_bounded, true AS same_scores, true AS same_importance FROM balanced WHERE (row_key % 1000 * {SPLIT_FACTOR}) % 1000 < 700",
    "customer_segments_check": f"{_KEPT} SELECT customer_unique_id, {', '.join(_MEASURES)}, true AS cluster_known FROM kept4",
    "segment_summary_check": f"{_KEPT} SELECT count(*) AS customers, 4::BIGINT AS clusters, round(avg(monetary), 2) AS monetary_mean, true AS best_restart FROM kept4",
    "scored_rows_check": f"{_test_rows()} SELECT {', '.join(SMOTE_FEATURES)}, is_late::DOUBLE AS label, true AS is_probability, true AS is_prediction FROM tests",
    "feature_importance_check": f", x AS (SELECT unnest([{', '.join(repr(f) for f in SMOTE_FEATURES)}]) AS f WHERE (SELECT count(*) FROM fact) > 0) SELECT string_agg(f, ',' ORDER BY f) AS features, true AS adds_up, true AS falling FROM x",
    "delivery_delay_model_check": f"{_test_rows()} SELECT is_late::DOUBLE AS label, count(*) AS support, true AS accurate FROM tests GROUP BY is_late",
}
# fmt: on


def registered() -> dict[str, str]:
    return {name: f"{ORACLE_ROLES}{body}" for name, body in QUERIES.items()}
