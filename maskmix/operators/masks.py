"""Distinct masks, and start classes chosen from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskmix.config import MixtureConfig
from maskmix.functions.arrays import HASH_OFFSET, HASH_PRIME, binary_mask, portable_uniform, random_integer
from maskmix.functions.kernels import list_column, matrix
from maskmix.functions.runtime import map_arrow


def with_mask(points: DataFrame) -> DataFrame:
    return points.withColumn("mask", binary_mask(F.col("w")))


def distinct_masks(masked: DataFrame) -> DataFrame:
    """One row per distinct mask with its size and smallest point; summed before the shuffle."""
    return masked.groupBy("mask").agg(F.count("*").alias("n"), F.min("point_id").alias("first_point"))


def change_flags(masked: DataFrame) -> DataFrame:
    """1 on the first point of each mask in (mask, point) order.

    Joined on the point, not on the mask, so a mask shared by many points makes no hot key.
    """
    firsts = distinct_masks(masked).select(F.col("first_point").alias("point_id"), F.lit(1).alias("changed"))
    return masked.join(firsts, "point_id", "left").withColumn("changed", F.coalesce("changed", F.lit(0)))


def sample_masks(masks: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` distinct masks drawn without replacement, each with chance proportional to its size.

    Every mask gets an exponential arrival time with rate ``n``; the first ``k`` arrivals in time
    order are the draw.  Spark keeps only the top ``k`` per task.
    """
    arrival = -F.ln(portable_uniform(F.col("first_point"), seed)) / F.col("n")
    return masks.withColumn("arrival", arrival).orderBy("arrival", "first_point").limit(k)


def mask_words(masks: np.ndarray) -> np.ndarray:
    """Rows of zeros and ones as 64-bit words, padded with zeros."""
    packed = np.packbits(masks.astype(bool), axis=1)
    width = -(-packed.shape[1] // 8) * 8
    out = np.zeros((len(packed), width), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def differing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Differing positions of every row of ``one`` and every row of ``two``: one popcount per pair and word."""
    out = np.zeros((len(one), len(two)), np.int32)
    for w in range(one.shape[1]):
        out += np.bitwise_count(one[:, w, None] ^ two[None, :, w])
    return out


def nearest_words(words, ids, targets, first_wins: bool, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and distance of the closest target; ties go to the first, or to a seeded choice by point."""
    distance = differing(words, targets)
    best = distance.min(axis=1)
    if first_wins:
        return distance.argmin(axis=1), best
    tied = distance == best[:, None]
    mixed = (ids % HASH_PRIME * 16807 + seed) % HASH_PRIME
    pick = (mixed * mixed + HASH_OFFSET) % HASH_PRIME % tied.sum(axis=1)
    return (np.cumsum(tied, axis=1) > pick[:, None]).argmax(axis=1), best


def nearest_mask(masked: DataFrame, chosen: list[list[int]], first_wins: bool = True, seed: int = 1) -> DataFrame:
    """Class ``1 + index`` of the closest chosen mask by differing positions, with the distance.

    ``chosen`` has at most ``max_possible_clusters`` masks.  An exact match has distance zero, so it
    needs no separate rule.  Ties go to the mask drawn first, or to a seeded choice.
    """
    targets = mask_words(np.asarray(chosen))

    def step(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            words, ids = mask_words(matrix(batch.column("mask"))), batch.column("point_id").to_numpy()
            at, best = nearest_words(words, ids, targets, first_wins, seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("point_id"), pa.array((at + 1).astype(np.int32)), pa.array(best.astype(np.int32))],
                names=["point_id", "class", "distance"],
            )

    return map_arrow(masked.select("point_id", "mask"), step, "point_id BIGINT, class INT, distance INT")


def start_classes(points: DataFrame, starting_clusters: int, config: MixtureConfig, seed: int) -> tuple[DataFrame, int]:
    """Start class of every point and the number of classes, noise included.

    With fewer distinct masks than asked for, every mask starts a class.  Where starts do not come from
    masks, every point gets a seeded random class other than noise.
    """
    if starting_clusters > config.max_possible_clusters:
        raise ValueError(f"{starting_clusters} start classes; max_possible_clusters is {config.max_possible_clusters}")
    if starting_clusters <= 1:
        return points.select("point_id", F.lit(0).alias("class")), 1
    if not config.starts_from_masks:
        drawn = random_integer(F.col("point_id"), seed, 1, starting_clusters - 1)
        return points.select("point_id", drawn.cast("int").alias("class")), starting_clusters
    masked = with_mask(points.select("point_id", "w"))
    chosen = sample_masks(distinct_masks(masked), starting_clusters - 1, seed).select("mask").collect()
    first_wins = config.mask_starts > 0 or config.assign_to_first_closest_mask
    labels = nearest_mask(masked, [list(r["mask"]) for r in chosen], first_wins, seed)
    return labels.select("point_id", "class"), len(chosen) + 1


def start_arrays(points: DataFrame, starts: list[tuple[int, int]], config: MixtureConfig) -> tuple[DataFrame, list[int]]:
    """Start classes for several ``(start clusters, seed)`` at once: ``point_id, class`` with an array in the order
    of ``starts``, and the number of classes of each.  The same classes as ``start_classes`` one by one."""
    if max(k for k, _ in starts) > config.max_possible_clusters:
        raise ValueError(f"more start classes than max_possible_clusters, which is {config.max_possible_clusters}")
    if not config.starts_from_masks:
        drawn = [
            random_integer(F.col("point_id"), seed, 1, k - 1).cast("int") if k > 1 else F.lit(0) for k, seed in starts
        ]
        return points.select("point_id", F.array(*drawn).alias("class")), [max(k, 1) for k, _ in starts]
    masked = with_mask(points.select("point_id", "w"))
    kinds = distinct_masks(masked)
    targets = []
    for k, seed in starts:
        chosen = sample_masks(kinds, k - 1, seed).select("mask").collect() if k > 1 else []
        targets.append(mask_words(np.asarray([list(r["mask"]) for r in chosen])) if chosen else None)
    first_wins = config.mask_starts > 0 or config.assign_to_first_closest_mask
    seeds = [seed for _, seed in starts]

    def step(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            words, ids = mask_words(matrix(batch.column("mask"))), batch.column("point_id").to_numpy()
            found = np.zeros((len(ids), len(targets)), np.int32)
            for r, (target, seed) in enumerate(zip(targets, seeds)):
                if target is not None:
                    found[:, r] = nearest_words(words, ids, target, first_wins, seed)[0] + 1
            yield pa.RecordBatch.from_arrays([batch.column("point_id"), list_column(found)], names=["point_id", "class"])

    labels = map_arrow(masked.select("point_id", "mask"), step, "point_id BIGINT, class ARRAY<INT>")
    return labels, [1 if t is None else len(t) + 1 for t in targets]
