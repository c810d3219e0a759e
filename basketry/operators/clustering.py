"""k-means with all restarts in one pass: one job per iteration advances every restart that still moves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# First centres are drawn from this many different points at most, taken by hash.
START_POINTS = 20_000
WEIGHT = "point_weight"
POINTS_PER_TASK = 50_000
# With more tasks than this their totals are added up by Spark before they reach the driver.
TASKS_TO_DRIVER = 64
# Points whose distances are worked out at a time.
BLOCK = 4096


@dataclass(frozen=True)
class Restarts:
    """Per restart its centres (restarts x k x dimensions), what they cost, and the iterations they took."""

    centres: np.ndarray
    sizes: np.ndarray
    costs: list[float]
    iterations: list[int]


def weighted_points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Different points with the number of rows of each; rows with a missing coordinate take no part."""
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    points = df.select(*doubles).na.drop().groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT))
    return points


def first_centres(points: DataFrame, columns: Sequence[str], k: int, seeds: Sequence[int]) -> np.ndarray:
    """k-means++ draws per seed: each next centre with a chance in proportion to its squared distance and weight.

    Drawn among at most START_POINTS points, so that the draws are the same however the points are stored.
    """
    mark = F.xxhash64(*columns)
    sample = points.orderBy(mark, *columns).limit(START_POINTS).select(*columns, WEIGHT).toArrow()
    at = np.column_stack([sample.column(c).to_numpy() for c in columns])
    weight = sample.column(WEIGHT).to_numpy()
    if not len(at):
        return np.zeros((len(seeds), k, len(columns)))
    starts = []
    for seed in seeds:
        draw = np.random.default_rng(seed)
        centres = [at[draw.choice(len(at), p=weight / weight.sum())]]
        gap = ((at - centres[0]) ** 2).sum(1)
        while len(centres) < k:
            chance = gap * weight
            # fewer different points than centres: the rest repeat the first
            pick = draw.choice(len(at), p=chance / chance.sum()) if chance.sum() > 0 else 0
            centres.append(at[pick])
            gap = np.minimum(gap, ((at - at[pick]) ** 2).sum(1))
        starts.append(centres)
    return np.array(starts)


def _totals(
    points: DataFrame, tasks: int, columns: Sequence[str], centres: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, sums, costs) per restart and centre, in one pass over the points."""
    restarts, k, width = centres.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((restarts * k, width + 2))
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for a in range(0, len(values), BLOCK):
                at, weight = values[a : a + BLOCK, :width], values[a : a + BLOCK, width]
                for r in range(restarts):
                    gap = ((at[:, None, :] - centres[r][None]) ** 2).sum(2)
                    own = gap.argmin(1)  # of equal distances the lower number
                    terms = np.column_stack((weight, at * weight[:, None], gap[np.arange(len(own)), own] * weight))
                    for j in range(width + 2):
                        total[r * k : (r + 1) * k, j] += np.bincount(own, terms[:, j], k)
        numbers = np.flatnonzero(total[:, 0])
        arrays = [pa.array(numbers, pa.int32()), *(pa.array(total[numbers, j]) for j in range(width + 2))]
        yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["slot"] + [f"t{j}" for j in range(width + 2)]
    schema = "slot int, " + ", ".join(f"{n} double" for n in names[1:])
    rows = points.mapInArrow(part, schema)
    if tasks > TASKS_TO_DRIVER:
        rows = rows.groupBy("slot").agg(*(F.sum(n).alias(n) for n in names[1:]))
    found = np.zeros((restarts * k, width + 2))
    for row in rows.collect():  # at most restarts x k rows from each of TASKS_TO_DRIVER tasks
        found[row.slot] += row[1:]
    found = found.reshape(restarts, k, width + 2)
    return found[:, :, 0], found[:, :, 1:-1], found[:, :, -1].sum(1)


def lloyd(points: DataFrame, columns: Sequence[str], centres: np.ndarray, max_iter: int = 300, tol: float = 1e-4) -> Restarts:
    """Move the centres of all restarts until none moves farther than ``tol``, or ``max_iter`` times.

    ``points`` are those of ``weighted_points``; they are read once per iteration, so hand in a persisted frame. A centre
    without points stays where it is. Restarts that have settled are left out of later passes.
    """
    centres = np.array(centres, float)
    tasks = max(1, -(-points.count() // POINTS_PER_TASK))
    points = points.select(*columns, WEIGHT).coalesce(tasks)
    iterations = [0] * len(centres)
    moving = list(range(len(centres)))
    for _ in range(max_iter):
        if not moving:
            break
        weights, sums, _ = _totals(points, tasks, columns, centres[moving])
        still = []
        for r, weight, total in zip(moving, weights, sums):
            filled = weight > 0
            moved = np.where(filled[:, None], total / np.where(filled, weight, 1)[:, None], centres[r])
            if ((moved - centres[r]) ** 2).sum(1).max() > tol**2:
                still.append(r)
            centres[r] = moved
            iterations[r] += 1
        moving = still
    sizes, _, costs = _totals(points, tasks, columns, centres)
    return Restarts(centres, sizes, costs.tolist(), iterations)
