"""Every operator and report, bound to the given test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketry import functions as fn
from basketry.operators import aggregates as agg
from basketry.operators import distributions as dist
from basketry.operators import cells, clustering, factorised, filters, joins, metrics, neighbours, oversample, scaling, summaries
from basketry.operators.quantiles import exact_quantiles, quantile_values
from basketry.operators.sizing import in_parts
from basketry.plans import dashboard, delay, exploration, retention, satisfaction, segments
from basketry.plans.prepare import add_features, clean_rows, prepared_fact
from basketry.registry import tpch
from basketry.session import cut_lineage, scratch_path, tune
from basketry.sources import readers, sinks
from basketry.sources.schemas import CATALOG

# Centres that stand in for fitted ones where the result must be reproducible.
SAMPLE_CENTROIDS = ((100.0, 5.0, 8.0, 2.5), (100.0, 9.0, 20.0, 3.0), (500.0, 6.0, 12.0, 3.0), (200.0, 7.0, 14.0, 4.0))
# Where the restarts of the three-iteration query begin, in scaled units.
START_CENTRES = (
    ((-1.0, -1.0, -1.0, 0.0), (0.0, 1.0, 1.0, 0.0), (1.0, -1.0, 0.0, 1.0), (0.0, 0.0, 0.0, -1.0)),
    ((0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0), (-1.0, -1.0, -1.0, -1.0), (90.0, 0.0, -2.0, 0.0)),
)
SAMPLE_POINTS = 1000
SAMPLE_SPACE = ("recency", "frequency", "monetary_100k", "satisfaction")
SMOTE_FEATURES = ("price", "freight_value", "delivery_time")


class Fixture:
    """The tables of one folder and the frames that several queries share, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir
        self.name = sf_dir.strip("/").replace("/", "-")

    def path(self, *parts: str) -> str:
        return scratch_path(self.spark, self.name, *parts)

    @cached_property
    def tables(self) -> joins.SalesTables:
        return tpch.sales_tables(self.spark, self.sf_dir)

    @cached_property
    def csv_catalog(self) -> str:
        return tpch.write_csv_catalog(self.spark, self.sf_dir, self.path("export"))

    @cached_property
    def regions(self) -> DataFrame:
        return tpch.regions(self.spark, self.sf_dir)

    @cached_property
    def prepared(self) -> DataFrame:
        return joins.prepared_join(self.tables)

    @cached_property
    def fact(self) -> DataFrame:
        return prepared_fact(self.tables, path=self.path("fact"))

    @cached_property
    def very_late(self) -> DataFrame:
        """The fact with a rare class: deliveries later than 95 in 100."""
        limit = quantile_values(self.fact, "delivery_time", [0.95])[0]
        return self.fact.withColumn("is_very_late", (F.col("delivery_time") > F.lit(limit)).cast("int"))

    @cached_property
    def rfm(self) -> DataFrame:
        return cut_lineage(segments.rfm_scores(self.fact))

    @cached_property
    def sample_segments(self) -> DataFrame:
        rows = self.rfm.withColumn("monetary_100k", F.col("monetary") / 100000.0)
        return scaling.nearest_centroid(rows, SAMPLE_SPACE, SAMPLE_CENTROIDS)

    @cached_property
    def segmentation(self) -> segments.Segmentation:
        return segments.customer_segments(self.rfm)

    @cached_property
    def delay_model(self) -> delay.DelayModel:
        return delay.delivery_delay_model(self.fact)

    @cached_property
    def dashboard(self) -> dict[str, DataFrame]:
        return dashboard.dashboard_reports(self.fact, self.regions)

    @cached_property
    def rule(self) -> DataFrame:
        """A predictor by rule: dear items are called late."""
        called = (F.col("price") > 50000).cast("int").alias("prediction")
        return self.fact.select(F.col("is_late").alias("label"), called)


_FIXTURES: dict[tuple[str, str], Fixture] = {}


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FIXTURES:
        _FIXTURES[key] = Fixture(spark, sf_dir)
    return _FIXTURES[key]


def two_parts(histogram: DataFrame, density: DataFrame) -> DataFrame:
    """Histogram bars and density points of one column in one table."""
    bars = histogram.select(
        F.lit("bar").alias("part"),
        F.col("bin").alias("position"),
        F.round("low", 6).alias("x"),
        F.col("row_count").cast("double").alias("y"),
    )
    line = density.select(
        F.lit("line").alias("part"),
        F.col("point").alias("position"),
        F.round("position", 6).alias("x"),
        F.round("density", 6).alias("y"),
    )
    return bars.unionByName(line)


# -- sources and sinks ---------------------------------------------------------------------


def scan_csv(fx: Fixture) -> DataFrame:
    orders = fx.tables.orders
    path = fx.path("csv", "orders")
    sinks.write_report(orders, path, "csv")
    return readers.read_csv(fx.spark, path, dict(orders.dtypes))


def scan_csv_inferred(fx: Fixture) -> DataFrame:
    """The types that the values of all nine files lead to."""
    entries = [
        (spec.name, *column)
        for spec in CATALOG
        for column in readers.read_table(fx.spark, fx.csv_catalog, spec, infer=True).dtypes
    ]
    return fx.spark.createDataFrame(entries, "table_name string, column_name string, type string")


def load_catalog(fx: Fixture) -> DataFrame:
    tables = readers.load_catalog(fx.spark, fx.csv_catalog)
    return readers.row_counts({name: fx.spark.table(name) for name in tables})


def rename_on_load(fx: Fixture) -> DataFrame:
    raw = fx.tables.products.withColumnRenamed("product_name_length", "product_name_lenght")
    renamed = readers.rename_columns_if_present(raw, {"product_name_lenght": "product_name_length", "absent": "x"})
    return renamed.select("product_id", "product_name_length", "product_description_lenght")


def table_sink_replace(fx: Fixture) -> DataFrame:
    path = fx.path("table", "order_items")
    sinks.replace_table(fx.tables.sellers, path)
    return sinks.replace_table(fx.tables.order_items.drop("shipped_item_at"), path)


def import_row_counts(fx: Fixture) -> DataFrame:
    return sinks.import_tables(readers.load_catalog(fx.spark, fx.csv_catalog), fx.path("import"))


def sql_view(fx: Fixture) -> DataFrame:
    readers.register_views({"merged_data": joins.merged_view(fx.tables)})
    return readers.sql_scan(
        fx.spark,
        """SELECT order_status, count(*) AS merged_rows, count(DISTINCT order_id) AS order_count,
                  sum(payment_installments) AS installments
           FROM merged_data GROUP BY order_status""",
    )


def sql_scan(fx: Fixture) -> DataFrame:
    wanted = ("product_category_name", "customer_state", "seller_state")
    readers.register_views(joins.with_dimensions(fx.tables, wanted).as_views())
    return readers.sql_scan(
        fx.spark,
        """SELECT order_id, price, freight_value, product_category_name, customer_state, seller_state,
                  CAST(review_score AS double) AS review_score
           FROM order_items JOIN sellers USING (seller_id) JOIN products USING (product_id)
           JOIN orders USING (order_id) JOIN customers USING (customer_id)
           LEFT JOIN order_reviews USING (order_id)""",
    )


def table_schema(fx: Fixture) -> DataFrame:
    tables = fx.tables.as_views()
    return readers.view_schema(tables, [c for c in joins.MERGED_COLUMNS if c not in fx.tables.derived])


def report_sink(fx: Fixture) -> DataFrame:
    report = dashboard.state_sales_table(fx.fact, fx.regions)
    for fmt in ("parquet", "json", "csv"):
        sinks.write_reports({"state_sales": report}, fx.path("reports", fmt), fmt)
    return readers.read_csv(fx.spark, fx.path("reports", "csv", "state_sales"), dict(report.dtypes))


# -- projections and filters ---------------------------------------------------------------


def model_rows(fx: Fixture) -> DataFrame:
    """Rows before cleaning, so that undelivered ones lack a delivery time."""
    return add_features(joins.prepared_join(fx.tables, extra=["product_weight_g"]))


def drop_missing_features(fx: Fixture) -> DataFrame:
    rows = model_rows(fx)
    kept = filters.drop_missing_features(rows, delay.FEATURES)
    return kept.select("order_id", *filters.available(rows, delay.FEATURES))


def rename_columns(fx: Fixture) -> DataFrame:
    ts = "order_purchase_timestamp"
    counted = fx.fact.groupBy("customer_unique_id").agg(F.count_distinct("order_id"), F.min(ts), F.max(ts))
    return counted.toDF("customer_unique_id", "order_count", "first_order", "last_order")


# -- joins ---------------------------------------------------------------------------------


def merged_by_order(fx: Fixture) -> DataFrame:
    return agg.group(
        joins.merged_view(fx.tables),
        ["order_id"],
        merged_rows=F.count(F.lit(1)),
        installments=F.sum("payment_installments"),
        paid=fn.exact_sum("payment_value", 4),
        score_sum=F.sum("review_score"),
    )


def merged_totals_by_order(fx: Fixture) -> DataFrame:
    """The totals of ``merged_by_order`` without the rows of the wide view."""
    totals = factorised.merged_totals(fx.tables, ["order_id"], MERGED_SUMS)
    return totals.withColumn("paid", F.coalesce(F.col("paid").cast("double"), F.lit(0.0)))


def merged_totals_by_status(fx: Fixture) -> DataFrame:
    """The totals of ``sql_view`` without the rows of the wide view."""
    return factorised.merged_totals(fx.tables, ["order_status"], {"installments": MERGED_SUMS["installments"]})


def prepared_by_order(fx: Fixture) -> DataFrame:
    return agg.group(
        fx.prepared,
        ["order_id"],
        item_rows=F.count(F.lit(1)),
        scored_rows=F.count("review_score"),
        total_price=fn.money_sum("price"),
    )


def left_join_reviews(fx: Fixture) -> DataFrame:
    reviews = fx.tables.order_reviews.select("order_id", "review_id", "review_score")
    return joins.left_join_reviews(fx.tables.orders.select("order_id", "order_status"), reviews)


def lookup_state_region(fx: Fixture) -> DataFrame:
    states = agg.group(fx.tables.customers, ["customer_state"], customers=F.count(F.lit(1)))
    return joins.with_region(states, fx.regions)


def scalar_broadcast(fx: Fixture) -> DataFrame:
    last = agg.first_and_last_order(fx.fact).select("customer_unique_id", "last_order")
    return last.withColumns(
        {
            "latest": agg.latest_purchase(fx.fact),
            "median_score": filters.small_domain_median(fx.fact, "review_score"),
        }
    )


def knn_self_join(fx: Fixture) -> DataFrame:
    return neighbours.neighbour_rows(fx.very_late.where("is_very_late = 1"), SMOTE_FEATURES)


def nearest_centroid(fx: Fixture) -> DataFrame:
    return fx.sample_segments.select("customer_unique_id", "cluster")


# -- aggregates ----------------------------------------------------------------------------


def agg_global(fx: Fixture) -> DataFrame:
    shares = agg.share_of_recurring(agg.customer_orders(fx.fact))
    whole = fx.fact.agg(
        F.max("order_purchase_timestamp").alias("latest"), F.count(F.lit(1)).alias("row_count")
    )
    median = filters.small_domain_median(fx.fact, "review_score").alias("median_score")
    both = F.struct(*(F.col(c) for c in shares.columns))
    return whole.withColumn("s", shares.select(both).scalar()).select("latest", "row_count", "s.*", median)


def agg_stddev(fx: Fixture) -> DataFrame:
    found = agg.standard_deviations(
        fx.fact, ["review_score"], {"delivery_time_std": "delivery_time", "price_std": "price"}
    )
    return found.select("review_score", *(F.round(c, 6).alias(c) for c in ("delivery_time_std", "price_std")))


def quantile_exact(fx: Fixture) -> DataFrame:
    columns = ("price", "freight_value", "delivery_time")
    return exact_quantiles(
        fx.fact, {f"{c}_q{round(p * 100)}": (c, p) for c in columns for p in (0.25, 0.75)}
    )


# -- set operations and windows ------------------------------------------------------------


def append_rows(fx: Fixture) -> DataFrame:
    columns = ("order_id", "price", "freight_value")
    return oversample.append_rows(fx.fact.select(*columns), fx.fact.where("is_late = 0").select(*columns))


def train_test_split(fx: Fixture) -> DataFrame:
    return oversample.with_split(fx.fact, "order_id").select("order_id", "price", "is_train")


# -- scalars -------------------------------------------------------------------------------


def parse_timestamp(fx: Fixture) -> DataFrame:
    text = F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss")
    spoilt = F.when(F.col("order_id") % 7 == 0, F.lit("bad")).otherwise(text)
    return fx.tables.orders.select(
        "order_id",
        fn.parse_timestamp(text).alias("strict"),
        fn.parse_timestamp(spoilt, strict=False).alias("lenient"),
    )


def scalar(fx: Fixture, *columns: Column) -> DataFrame:
    """A projection of the fact's rows."""
    return fx.fact.select("order_id", *columns)


def late_flag(fx: Fixture) -> DataFrame:
    flag = fn.late_flag("order_delivered_customer_date", "order_estimated_delivery_date")
    return fx.prepared.select("order_id", "order_delivered_customer_date", flag.alias("is_late"))


def divide_ratio(fx: Fixture) -> DataFrame:
    late = agg.group(
        fx.fact, ["product_category_name", "customer_state"], late=F.sum("is_late"), row_count=F.count(F.lit(1))
    )
    return late.select(
        "product_category_name",
        "customer_state",
        fn.ratio("late", "row_count").alias("share"),
        fn.ratio("row_count", F.col("late") * 0).alias("undefined"),
    )


# -- machine learning ----------------------------------------------------------------------


def standard_scale(fx: Fixture) -> DataFrame:
    scaled = segments.scaled_rfm(fx.rfm)
    return scaled.select("customer_unique_id", *(F.round(c, 6).alias(c) for c in segments.SCALED))


def smote_oversample(fx: Fixture) -> DataFrame:
    rows = fx.very_late.select(*SMOTE_FEATURES, "is_very_late")
    return oversample.smote_oversample(rows, SMOTE_FEATURES, "is_very_late")


def cluster_profile(fx: Fixture) -> DataFrame:
    found = segments.cluster_profile(fx.sample_segments)
    return found.select("cluster", "customers", *(F.round(f"{m}_mean", 6).alias(f"{m}_mean") for m in segments.MEASURES))


def feature_matrix(fx: Fixture) -> DataFrame:
    rows = delay.feature_rows(fx.fact)
    features = [c for c in rows.columns if c not in ("is_late", "row_key")]
    vectors = delay.feature_vectors(rows, features)
    values = vector_to_array("features")
    return vectors.select(*(values[i].alias(f) for i, f in enumerate(features)), "label")


def confusion(fx: Fixture) -> DataFrame:
    return metrics.confusion_matrix(fx.rule)


def classification_report(fx: Fixture) -> DataFrame:
    report = metrics.classification_report(confusion(fx))
    return report.select("class", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


def delay_report(fx: Fixture) -> DataFrame:
    report = fx.delay_model.report()
    area = fx.delay_model.auc().select(
        F.lit("roc auc").alias("class"),
        *(F.col("auc").alias(c) for c in ("precision", "recall", "f1")),
        F.lit(None).cast("bigint").alias("support"),
    )
    return report.unionByName(area)



def quantiles_from_summary(fx: Fixture) -> DataFrame:
    """Quartiles by state, by score and of all rows, exact, from one summary by state and score."""
    values = ("delivery_time", "freight_value", "price")
    path = scratch_path(fx.spark, f"summary-{uuid.uuid4().hex}")
    summary = sinks.replace_table(summaries.quantile_summary(fx.fact, values, ("customer_state", "review_score")), path)
    targets = {f"{v}_q{i}": (v, 0.25 * i) for v in values for i in (1, 2, 3)}

    def answered(question: str, *by: str) -> DataFrame:
        found = exact_quantiles(fx.fact, targets, by, summary=summary)
        group = F.col(by[0]).cast("int").cast("string") if by == ("review_score",) else F.col(by[0]) if by else F.lit("")
        return found.select(F.lit(question).alias("question"), group.alias("group_key"), *targets)

    by_state, by_score = answered("state", "customer_state"), answered("score", "review_score")
    return by_state.union(by_score).union(answered("all"))


def kde_binned_check(fx: Fixture) -> DataFrame:
    """The curve from the grid against the one from every single price: each point must lie within the stated bound."""
    exact = dist.density(fx.fact, "price", 30).select("point", F.col("density").alias("exact"))
    gap = F.abs(F.col("density") - F.col("exact"))
    return dist.binned_density(fx.fact, "price", 30).join(exact, "point").select("point", (gap <= F.col("bound")).alias("within_bound"))


def kmeans_check(fx: Fixture) -> DataFrame:
    """What must hold for any fit: scaled values, and every customer in the cluster of the nearest centroid."""
    found = fx.segmentation
    nearest = scaling.nearest_centroid(found.customers.withColumnRenamed("cluster", "given"), segments.SCALED, found.centroids)
    return nearest.select(
        "customer_unique_id",
        *(F.round(c, 6).alias(c) for c in segments.SCALED),
        (F.col("cluster") == F.col("given")).alias("own_is_nearest"),
        F.col("given").between(0, 3).alias("cluster_known"),
    )


def kmeans_three_rounds(fx: Fixture) -> DataFrame:
    """Centres of two restarts after three iterations from fixed ones."""
    scaled = segments.scaled_rfm(fx.rfm).select(*(F.round(c, 6).alias(c) for c in segments.SCALED))
    points = clustering.weighted_points(scaled, segments.SCALED)
    found = clustering.lloyd(points, segments.SCALED, START_CENTRES, max_iter=3, tol=0.0)
    rows = [
        (r, c, int(found.sizes[r, c]), *map(float, found.centres[r, c]))
        for r in range(len(START_CENTRES))
        for c in range(len(START_CENTRES[r]))
    ]
    frame = fx.spark.createDataFrame(rows, "restart int, cluster int, customers bigint, " + ", ".join(f"{c} double" for c in segments.SCALED))
    return frame.withColumns({c: F.round(c, 6) for c in segments.SCALED})


def delay_cells_check(fx: Fixture) -> DataFrame:
    """Trees on weighted cells against trees on the binned rows one by one: importances and scores must agree."""
    rows = delay.feature_rows(fx.fact)
    features = [c for c in rows.columns if c not in ("is_late", "row_key")]
    balanced = cut_lineage(oversample.smote_oversample(rows, features, "is_late"))
    train, _ = oversample.train_test_split(balanced)
    binned = cut_lineage(cells.in_cells(train, cells.cell_cuts(train, features, 8)).select(*features, "is_late"))
    counted = cut_lineage(cells.cell_counts(binned, features, "is_late"))
    options = {"trees": 3, "rate": 0.1, "depth": 4, "seed": 42, "bins": 32}
    by_cell = delay.fit_cells(counted, features, **options)
    by_row = delay.fit_cells(in_parts(binned).withColumn("row_count", F.lit(1.0)), features, **options)
    vectors = delay.feature_vectors(counted.select(*features, "is_late"), features)

    def scores(model, name: str) -> DataFrame:
        late = vector_to_array("probability")[1].alias(name)
        return model.transform(vectors).select(*features, "is_late", late)

    both = scores(by_cell, "a").join(scores(by_row, "b"), [*features, "is_late"])
    gap = both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
    shares = abs(by_cell.featureImportances.toArray() - by_row.featureImportances.toArray()).max()
    return counted.agg(F.sum("row_count").cast("bigint").alias("train_rows")).withColumns(
        {
            "cells_bounded": F.lit(counted.count() <= 2 * 8 ** len(features)),
            "same_scores": F.lit(bool(gap < 1e-9)),
            "same_importance": F.lit(bool(shares < 1e-9)),
        }
    )


def customer_segments_check(fx: Fixture) -> DataFrame:
    customers = fx.segmentation.customers
    return customers.select("customer_unique_id", *segments.MEASURES, F.col("cluster").between(0, 3).alias("cluster_known"))


def segment_summary_check(fx: Fixture) -> DataFrame:
    """All clusters together: sizes add up, weighted means are the mean of all, and the best restart was kept."""
    found = fx.segmentation
    summary = segments.cluster_summary(found.customers)
    best = F.lit(found.cost == min(found.restart_costs) and len(found.restart_costs) == 10)
    spend = F.sum(F.col("monetary_mean") * F.col("customers")) / F.sum("customers")
    return summary.agg(
        F.sum("customers").alias("customers"), F.count("*").alias("clusters"), F.round(spend, 2).alias("monetary_mean")
    ).withColumn("best_restart", best)


def scored_rows_check(fx: Fixture) -> DataFrame:
    """The test rows of the delay model, and that scores and predictions are what they must be."""
    model = fx.delay_model
    return model.scored.select(
        *model.features,
        "label",
        F.col("probability").between(0, 1).alias("is_probability"),
        (F.col("prediction") == (F.col("probability") > 0.5).cast("double")).alias("is_prediction"),
    )


def feature_importance_check(fx: Fixture) -> DataFrame:
    rows = fx.delay_model.feature_importance().collect()
    shares = [r.importance for r in rows]
    names = ",".join(sorted(r.feature for r in rows))
    row = (names, abs(sum(shares) - 1) < 1e-5, shares == sorted(shares, reverse=True))
    return fx.spark.createDataFrame([row], "features string, adds_up boolean, falling boolean")


def delay_model_check(fx: Fixture) -> DataFrame:
    """Support per class, and that the model is far better than chance."""
    scored = fx.delay_model.scored
    good = fx.delay_model.auc().first()["auc"] > 0.9
    hits = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    accuracy = scored.agg(hits.alias("a")).first()["a"]
    return scored.groupBy("label").agg(F.count("*").alias("support")).withColumn("accurate", F.lit(accuracy > 0.8 and good))


def segment_summary(fx: Fixture) -> DataFrame:
    customers = fx.segmentation.customers
    profile = segments.cluster_frequencies(customers).groupBy("cluster").agg(
        F.max_by("frequency", "row_count").alias("commonest_frequency")
    )
    return segments.cluster_summary(customers).join(profile, "cluster")


MERGED_SUMS = {
    "installments": ("payment_installments", "bigint"),
    "paid": ("payment_value", "decimal(18,4)"),
    "score_sum": ("review_score", "bigint"),
}
DELIVERED_BOUGHT = ("order_delivered_customer_date", "order_purchase_timestamp")
MEDIAN_COLUMNS = {"price": "price", "freight": "freight_value", "delivery_time": "delivery_time"}

# fmt: off
QUERIES: dict[str, Callable[[Fixture], DataFrame]] = {
    # sources and sinks
    "scan_csv": scan_csv,
    "scan_csv_inferred": scan_csv_inferred,
    "load_catalog": load_catalog,
    "rename_on_load": rename_on_load,
    "table_sink_replace": table_sink_replace,
    "import_row_counts": import_row_counts,
    "sql_view": sql_view,
    "sql_scan": sql_scan,
    "table_schema": table_schema,
    "report_sink": report_sink,
    # projections and filters
    "project_merged": lambda fx: joins.merged_view(fx.tables),
    "project_prepared": lambda fx: fx.prepared,
    "drop_missing_dates": lambda fx: filters.drop_missing_dates(fx.prepared).select("order_id", *DELIVERED_BOUGHT),
    "filter_price_positive": lambda fx: filters.price_positive(fx.prepared).select("order_id", "price"),
    "filter_freight_nonneg": lambda fx: filters.freight_not_negative(fx.prepared).select("order_id", "freight_value"),
    "fill_median": lambda fx: filters.fill_median(clean_rows(fx.prepared), "review_score").select("order_id", "price", "review_score"),
    "drop_missing_features": drop_missing_features,
    "filter_recurring": lambda fx: agg.recurring(agg.customer_orders(fx.fact)).select("customer_unique_id", "order_count"),
    "filter_state_known": lambda fx: filters.known(fx.prepared, "customer_state", "product_category_name").select("order_id", "customer_state", "product_category_name"),
    "filter_iqr": lambda fx: filters.filter_iqr(fx.rfm, "monetary").select("customer_unique_id", "monetary"),
    "filter_cluster": lambda fx: segments.cluster_members(fx.sample_segments, 1).select("customer_unique_id", "recency", "monetary", "cluster"),
    "rename_columns": rename_columns,
    "flag_same_state": lambda fx: fx.prepared.select("order_id", "customer_state", "seller_state", filters.same_state().alias("is_same_state")),
    # joins
    "merged_view": merged_by_order,
    "merged_totals_by_order": merged_totals_by_order,
    "merged_totals_by_status": merged_totals_by_status,
    "prepared_join": prepared_by_order,
    "left_join_reviews": left_join_reviews,
    "lookup_state_region": lookup_state_region,
    "scalar_broadcast": scalar_broadcast,
    "knn_self_join": knn_self_join,
    "nearest_centroid": nearest_centroid,
    # aggregates
    "agg_count_distinct": lambda fx: agg.count_distinct_orders(fx.fact, "seller_id"),
    "agg_sum": lambda fx: agg.sum_price(fx.fact, "seller_id"),
    "agg_mean": lambda fx: agg.means(fx.fact, "customer_state"),
    "agg_median": lambda fx: agg.medians(fx.fact, ["customer_state"], MEDIAN_COLUMNS),
    "agg_stddev_samp": agg_stddev,
    "agg_count_rows": lambda fx: agg.count_rows(fx.prepared, "review_score", "product_category_name"),
    "agg_min_max": lambda fx: agg.first_and_last_order(fx.fact),
    "agg_global": agg_global,
    "agg_multi_key": lambda fx: agg.by_state_pair(fx.fact),
    "agg_two_level": lambda fx: agg.mean_order_total(fx.fact, "customer_state"),
    "quantile_exact": quantile_exact,
    "quantiles_from_summary": quantiles_from_summary,
    "value_counts": lambda fx: agg.value_counts(fx.sample_segments, ["cluster"], "frequency"),
    "agg_last_custom": lambda fx: agg.recency(fx.fact),
    # windows, sorts, set operations
    "cumulative_rates": lambda fx: metrics.cumulative_rates(fx.fact, "price", "is_late"),
    "rank_average": lambda fx: metrics.average_ranks(fx.fact, "price", "is_late"),
    "sort_desc": lambda fx: agg.sort_desc(agg.sum_price(fx.fact, "customer_state"), "total_price", "customer_state"),
    "sort_index": lambda fx: agg.sum_price(fx.fact, "order_month").orderBy("order_month"),
    "top_k": lambda fx: agg.top_k(agg.sum_price(fx.fact, "seller_id"), "total_price", "seller_id"),
    "append_rows": append_rows,
    "train_test_split": train_test_split,
    # scalars
    "parse_timestamp": parse_timestamp,
    "elapsed_days_floor": lambda fx: scalar(fx, fn.elapsed_days(*DELIVERED_BOUGHT).alias("days"), fn.elapsed_days(*DELIVERED_BOUGHT[::-1]).alias("days_back")),
    "late_flag": late_flag,
    "month_key": lambda fx: scalar(fx, fn.month_key(DELIVERED_BOUGHT[0]).alias("month")),
    "day_of_week": lambda fx: scalar(fx, fn.day_of_week(DELIVERED_BOUGHT[0]).alias("day")),
    "bool_to_int": lambda fx: scalar(fx, (F.col("price") > 50000).cast("int").alias("dear")),
    "format_currency": lambda fx: scalar(fx, fn.format_currency("price").alias("text")),
    "format_fixed": lambda fx: scalar(fx, fn.format_fixed("freight_value").alias("text")),
    "format_percent": lambda fx: scalar(fx, fn.format_percent(F.col("delivery_time") / 1000.0).alias("text")),
    "abbreviate_id": lambda fx: scalar(fx, fn.abbreviate_id(F.concat(F.lit("seller-"), F.col("seller_id").cast("string"))).alias("text")),
    "round_digits": lambda fx: scalar(fx, fn.round_digits(F.col("price") / 7).alias("rounded")),
    "add_subtract_interval": lambda fx: scalar(fx, (F.col("order_estimated_delivery_date") + fn.subtract(*DELIVERED_BOUGHT)).alias("moved")),
    "divide_ratio": divide_ratio,
    # distributions
    "histogram_equal_width": lambda fx: dist.histogram(fx.fact, "price", 30).select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "row_count"),
    "kde_gaussian": lambda fx: dist.density(fx.fact, "delivery_time", 30).select("point", F.round("position", 6).alias("position"), F.round("density", 6).alias("density")),
    "kde_binned": lambda fx: dist.binned_density(fx.fact, "price", 30).select("point", F.round("position", 6).alias("position"), F.round("density", 6).alias("density")),
    "kde_binned_check": kde_binned_check,
    "box_stats": lambda fx: dist.box_stats(fx.fact, "freight_value", "customer_state"),
    "box_outliers": lambda fx: dist.box_outliers(fx.fact, "freight_value", "customer_state"),
    "count_by_category": lambda fx: agg.count_by(fx.fact, "review_score"),
    "scatter_points": lambda fx: dist.scatter(fx.fact, "price", "freight_value", {"review_score": F.col("review_score")}),
    "scatter_sample": lambda fx: dist.scatter(fx.fact, "price", "freight_value", {"review_score": F.col("review_score")}, SAMPLE_POINTS, ["order_id", "seller_id"]),
    "heat_row": lambda fx: dashboard.state_sales(fx.fact, fx.regions).select("customer_state", "region", "total_price"),
    # machine learning
    "standard_scale": standard_scale,
    "kmeans_segments": lambda fx: fx.segmentation.customers.select("customer_unique_id", *segments.SCALED, "cluster"),
    "cluster_summary": lambda fx: segments.cluster_summary(fx.sample_segments),
    "cluster_profile": cluster_profile,
    "smote_oversample": smote_oversample,
    "gbt_classifier": lambda fx: fx.delay_model.scored.select("label", "prediction", "probability"),
    "feature_importance": lambda fx: fx.delay_model.feature_importance(),
    "confusion_matrix": confusion,
    "classification_report": classification_report,
    "roc_auc": lambda fx: metrics.roc_auc(fx.fact, "price", "is_late").select(F.round("auc", 9).alias("auc")),
    "roc_curve": lambda fx: metrics.roc_curve(fx.fact, "price", "is_late"),
    "probability_column": lambda fx: fx.delay_model.scored.select(*fx.delay_model.features, "probability"),
    "feature_matrix": feature_matrix,
    # reports
    "prepared_fact": lambda fx: fx.fact,
    "monthly_orders": lambda fx: exploration.monthly_orders(fx.fact),
    "delivery_time_distribution": lambda fx: two_parts(*exploration.delivery_time_distribution(fx.fact)),
    "freight_by_state_pair": lambda fx: exploration.freight_by_state_pair(fx.fact),
    "freight_same_state_box": lambda fx: exploration.freight_same_state_box(fx.fact),
    "freight_vs_price_points": lambda fx: exploration.freight_vs_price_points(fx.fact),
    "top_categories_revenue": lambda fx: exploration.top_categories_revenue(fx.fact),
    "top_states_avg_order_value": lambda fx: exploration.top_states_avg_order_value(fx.fact),
    "customer_retention": lambda fx: retention.customer_retention(fx.fact),
    "orders_per_customer_distribution": lambda fx: two_parts(*retention.orders_per_customer_distribution(fx.fact)),
    "days_first_to_last_order": lambda fx: retention.days_first_to_last_order(fx.fact),
    "days_first_to_last_distribution": lambda fx: two_parts(*retention.days_between_distribution(fx.fact)),
    "state_sales_table": lambda fx: fx.dashboard["state_sales_table"],
    "sales_heatmap": lambda fx: fx.dashboard["sales_heatmap"],
    "monthly_sales": lambda fx: fx.dashboard["monthly_sales"],
    "top_categories_dashboard": lambda fx: fx.dashboard["top_categories"],
    "monthly_delivery_time": lambda fx: fx.dashboard["monthly_delivery_time"],
    "top_sellers": lambda fx: fx.dashboard["top_sellers"],
    "top_states_sales": lambda fx: fx.dashboard["top_states_sales"],
    "rfm_scores": lambda fx: fx.rfm,
    "rfm_without_outliers": lambda fx: segments.rfm_without_outliers(fx.rfm),
    "customer_segments": lambda fx: fx.segmentation.customers.select("customer_unique_id", *segments.MEASURES, "cluster"),
    "segment_summary": segment_summary,
    "satisfaction_vs_delivery_box": lambda fx: satisfaction.satisfaction_vs_delivery_box(fx.fact),
    "satisfaction_vs_price_box": lambda fx: satisfaction.satisfaction_vs_price_box(fx.fact),
    "satisfaction_stats": lambda fx: satisfaction.satisfaction_stats(fx.fact),
    "score_distribution": lambda fx: satisfaction.score_distribution(fx.fact),
    "delivery_delay_model": delay_report,
    # what must hold for any fit, beside the fitted results
    "kmeans_segments_check": kmeans_check,
    "kmeans_three_rounds": kmeans_three_rounds,
    "delay_cells_check": delay_cells_check,
    "customer_segments_check": customer_segments_check,
    "segment_summary_check": segment_summary_check,
    "scored_rows_check": scored_rows_check,
    "feature_importance_check": feature_importance_check,
    "delivery_delay_model_check": delay_model_check,
}
# fmt: on


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Callable[[Fixture], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(fixture(spark, sf_dir))

    return {name: bind(build) for name, build in QUERIES.items()}
