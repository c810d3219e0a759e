"""Exact nearest neighbours within one table.

Comparing every pair does not scale, so three steps narrow the pairs down and lose none:

1. Equal rows are collapsed to one point with a number of copies, so a crowd of copies costs as
   much as a single row.
2. Points are put on a space-filling curve. The points next to a point on the curve give an upper
   bound on the distance to its k-th neighbour. The curve only affects speed, never the result.
3. Each point looks into the grid cells that its bound touches. The grid has one level per power
   of two and a point uses the level whose cells are just larger than its reach, so it looks into
   at most two cells per dimension, in dense and sparse regions alike. At most three dimensions
   are divided, so a lookup visits at most eight cells however many features there are. A point is listed at a level
   only where lookups of that level are near, so its copies do not grow with the number of levels. Only pairs within the bound
   leave the join, and only the k best per point and task enter the exchange after it.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.operators.ordered import BUCKETS, ROWS_PER_BUCKET, cut_points, with_bucket
from basketry.operators.sizing import dimension, small_side
from basketry.session import cut_lineage

LEVELS = 40
MAX_CURVE_DIMENSIONS = 5
# The grid divides the widest features only; the bound is checked on all of them.
GRID_DIMENSIONS = 3
CURVE_REACH = 2
CELL_REACHES = 2
# A grid cell with more points than this is split over several join keys.
CELL_ROWS = 50_000
# Cells, or blocks of cells, that tell the tasks where lookups of a level are, 64 bits each.
ASKED_BLOCKS = 1_000_000
# Lookups and listed points that a task of the join has, about.
ASKS_PER_TASK = 20_000
POINTS_PER_TASK = 100_000


def distinct_points(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per different point with its number of copies."""
    rows = df.select(*(F.col(f).cast("double").alias(f) for f in features)).dropna()
    return rows.groupBy(*features).agg(F.count(F.lit(1)).alias("copies"))


def _squared_distance(features: Sequence[str], a: str, b: str) -> Column:
    gaps = [F.col(f"{a}.{f}") - F.col(f"{b}.{f}") for f in features]
    return reduce(lambda x, y: x + y, [g * g for g in gaps])


def _curve(points: DataFrame, features: Sequence[str], sides: dict[str, tuple[float, float]]) -> DataFrame:
    """Add ``_curve``: scaled coordinates with interleaved bits. Near positions are mostly near in space.

    The binary digits of a coordinate, read as digits of base 2^d, have d − 1 zeros between them.
    """
    widest = sorted(features, key=lambda f: sides[f][0] - sides[f][1])[:MAX_CURVE_DIMENSIONS]
    side = max(high - low for low, high in sides.values()) or 1.0
    base = 2 ** len(widest)
    top = (1 << 52 // len(widest)) - 1
    cells = {
        f"_g{d}": F.least(F.greatest(F.floor((F.col(f) - sides[f][0]) / side * top), F.lit(0)), F.lit(top))
        for d, f in enumerate(widest)
    }
    terms = [
        F.shiftleft(F.conv(F.bin(F.col(c).cast("bigint")), base, 10).cast("bigint"), d) for d, c in enumerate(cells)
    ]
    placed = points.withColumns(cells)
    return placed.withColumn("_curve", reduce(lambda x, y: x + y, terms).cast("double")).drop(*cells)


def _with_bound(points: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """Add ``bound``: a squared distance within which each point has k other points or copies."""
    n = points.count()
    edges = points.approxQuantile(list(features), [0.01, 0.99], 0.002)
    placed = _curve(points, features, {f: tuple(e) for f, e in zip(features, edges)})
    buckets = max(1, min(BUCKETS, n // ROWS_PER_BUCKET))
    placed = with_bucket(placed, "_curve", cut_points(placed, "_curve", buckets) if buckets > 1 else [])
    along = Window.partitionBy("_bucket").orderBy("_curve", *features)
    here, reach = F.struct(*features), CURVE_REACH * k

    def gap(other: Column) -> Column:
        gaps = [F.col(f) - other[f] for f in features]
        return reduce(lambda x, y: x + y, [g * g for g in gaps])

    # the point itself is among them, at distance 0
    around = F.collect_list(here).over(along.rowsBetween(-reach, reach))
    near = placed.withColumn("_around", around).withColumn("_near", F.sort_array(F.transform("_around", gap)))
    bound = F.when(F.col("copies") > k, F.lit(0.0)).otherwise(F.get("_near", F.lit(k)))
    return near.select(*features, "copies", bound.alias("bound"))


def _extent(points: DataFrame, features: Sequence[str]) -> tuple[dict[str, float], float]:
    """Lower ends of the widest features, widest first, and the extent of the widest."""
    row = points.agg(*(f(c) for c in features for f in (F.min, F.max))).first()
    lows, highs = dict(zip(features, row[0::2])), dict(zip(features, row[1::2]))
    if row[0] is None:
        return {f: 0.0 for f in list(features)[:GRID_DIMENSIONS]}, 1.0
    widest = sorted(features, key=lambda f: lows[f] - highs[f])[:GRID_DIMENSIONS]
    return {f: lows[f] for f in widest}, (highs[widest[0]] - lows[widest[0]]) or 1.0


def _cell(x: Column, low: float, side: float, at_level: Column) -> Column:
    """Grid cell of a coordinate; what lies outside the extent belongs to the outermost cell."""
    cells = F.pow(F.lit(2.0), at_level)
    place = F.floor((x - F.lit(low)) / F.lit(side) * cells)
    return F.greatest(F.least(place, cells - 1), F.lit(0.0)).cast("bigint")


def asked_cells(asked: DataFrame, lows: dict[str, float], side: float) -> DataFrame:
    """A row per point and cell that its reach touches: at most two per divided feature."""
    for d, (f, low) in enumerate(lows.items()):
        ends = (_cell(F.col(f) + s * F.col("_reach"), low, side, F.col("_level")) for s in (-1, 1))
        asked = asked.withColumn(f"_cell{d}", F.explode(F.sequence(*ends)))
    return asked


def _block(cells: list[str], shift: int) -> Column:
    """64 bits of a level and a block of its cells; equal ones of two blocks only list more points."""
    return F.xxhash64("_level", *(F.shiftright(c, shift) for c in cells))


def _asked_blocks(asks: DataFrame, cells: list[str]) -> tuple[DataFrame, int]:
    """Hashes of the different blocks of 2^shift cells a side that lookups visit, by level, and the shift; at most ASKED_BLOCKS."""
    for shift in range(LEVELS + 1):
        blocks = asks.select(_block(cells, shift).alias("_block")).distinct()
        rows = blocks.limit(ASKED_BLOCKS + 1).count()
        if rows <= ASKED_BLOCKS:
            break
    return cut_lineage(blocks), shift


def _split_crowded_cells(
    asks: DataFrame, listed: DataFrame, keys: list[str], n: int
) -> tuple[DataFrame, DataFrame]:
    """Add a salt to both sides: points of a crowded cell scatter over its salts, lookups visit all."""
    if n <= CELL_ROWS:
        return asks.withColumn("_salt", F.lit(0)), listed.withColumn("_salt", F.lit(0))
    crowded = small_side(
        listed.groupBy(*keys)
        .agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("_parts"))
        .where("_parts > 1")
    )
    parts = F.coalesce("_parts", F.lit(1))
    return (
        asks.join(crowded, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts"),
        listed.join(crowded, keys, "left").withColumn("_salt", F.pmod("_hash", parts).cast("int")).drop("_parts"),
    )


def nearest_neighbours(
    points: DataFrame, features: Sequence[str], k: int = 5, queries: DataFrame | None = None
) -> DataFrame:
    """The k nearest other rows of every different point, by Euclidean distance.

    ``points`` is read several times, so hand in a checkpointed frame of ``distinct_points``.
    Output: the point, its number of ``copies``, and for every neighbour a row with the struct
    ``neighbour``, ``distance2`` and the ranks ``rank_from`` … ``rank_to`` that this neighbour and
    its copies fill, counted from 1. Equally distant points are ordered by their features. With
    ``queries``, a frame of points, only those are looked up.
    """
    features = list(features)
    # the bound is read by both sides of the join
    points = cut_lineage(_with_bound(points, features, k))
    lows, side = _extent(points, features)
    asked = points if queries is None else points.join(dimension(queries.select(*features)), features, "left_semi")

    # a bucket with few points may give no bound; the whole extent is one
    widest = float(len(features)) * side * side
    reach2 = F.coalesce("bound", F.lit(widest))
    reach = F.sqrt(reach2) * (1 + 1e-9)
    # cells of level l have sides of side / 2^l and must be at least twice the reach wide
    level = F.when(reach <= 0, F.lit(LEVELS)).otherwise(
        F.greatest(F.least(F.floor(F.log2(F.lit(side) / (CELL_REACHES * reach))), F.lit(LEVELS)), F.lit(0))
    )
    asked = asked.withColumns({"bound": reach2, "_reach": reach, "_level": level.cast("int")})

    asks = asked_cells(asked, lows, side)
    cells = [f"_cell{d}" for d in range(len(lows))]

    # points are listed once per level that some query uses, at most LEVELS + 1
    used = sorted(r["_level"] for r in asked.select("_level").distinct().collect())
    listed = points.select(
        F.struct(*features).alias("p"),
        F.col("copies").alias("p_copies"),
        F.explode(F.array(*(F.lit(x) for x in used))).alias("_level"),
        F.xxhash64(*features).alias("_hash"),
    )
    listed = listed.withColumns(
        {f"_cell{d}": _cell(F.col(f"p.{f}"), low, side, F.col("_level")) for d, (f, low) in enumerate(lows.items())}
    )
    asks = asks.select(F.struct(*features).alias("q"), "copies", "bound", "_level", *cells)
    blocks, shift = _asked_blocks(asks, cells)
    listed = listed.withColumn("_block", _block(cells, shift)).join(F.broadcast(blocks), "_block", "left_semi").drop("_block")
    n = points.count()
    asks, listed = _split_crowded_cells(asks, listed, ["_level", *cells], n)

    # tasks are cut by rows: parts of so many bytes grow with the pairs that come of them
    keys = ["_level", "_salt", *cells]
    tasks = max(asks.count() // ASKS_PER_TASK, n // POINTS_PER_TASK)
    if tasks > int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        asks, listed = asks.repartition(tasks, *keys), listed.repartition(tasks, *keys)
    pairs = asks.join(listed, keys).withColumn("distance2", _squared_distance(features, "q", "p"))
    # a point is its own neighbour only through its other copies
    others = F.when(F.col("q") == F.col("p"), F.col("p_copies") - 1).otherwise(F.col("p_copies"))
    pairs = pairs.where(F.col("distance2") <= F.col("bound")).withColumn("p_copies", others)
    nearest = Window.partitionBy("q").orderBy("distance2", "p")
    best = (
        pairs.where("p_copies > 0")
        .select("q", "copies", "p", "p_copies", "distance2")
        .withColumn("_r", F.row_number().over(nearest))
        .where(F.col("_r") <= k)
    )
    filled = F.sum("p_copies").over(nearest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        best.withColumn("_filled", filled)
        .withColumn("rank_from", F.col("_filled") - F.col("p_copies") + 1)
        .where(F.col("rank_from") <= k)
        .select(
            "q.*",
            "copies",
            F.col("p").alias("neighbour"),
            "distance2",
            F.col("rank_from").cast("int").alias("rank_from"),
            F.least("_filled", F.lit(k)).cast("int").alias("rank_to"),
        )
    )


def neighbour_rows(df: DataFrame, features: Sequence[str], k: int = 5) -> DataFrame:
    """One row per row of the frame and rank 1 … k: the row, its neighbour and their distance."""
    found = nearest_neighbours(cut_lineage(distinct_points(df, features)), features, k)
    return found.withColumn(
        "neighbour_rank", F.explode(F.sequence("rank_from", "rank_to"))
    ).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(
        *features,
        "neighbour_rank",
        *(F.col(f"neighbour.{f}").alias(f"neighbour_{f}") for f in features),
        "distance2",
    )
