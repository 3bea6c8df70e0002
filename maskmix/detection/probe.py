"""Channel graph of a probe."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from maskmix.functions.arrays import portable_hash


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """Each undirected edge in both directions, once."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").union(back).where("src <> dst").distinct()


def adjacency_list(edges: DataFrame) -> DataFrame:
    """``(channel, neighbours)``; a list is at most as long as the probe has channels."""
    pairs = neighbour_pairs(edges)
    return pairs.groupBy(F.col("src").alias("channel")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


#: Neighbours in a block of a node's list, on average, where one block does not hold them all.
BLOCK_NEIGHBOURS = 100_000


def adjacency_blocks(edges: DataFrame, block_neighbours: int = BLOCK_NEIGHBOURS, seed: int = 1) -> DataFrame:
    """``(channel, degree, block, neighbours)``: lists cut into blocks, so that a hub has many lists of bounded size.

    A node with more neighbours than a block holds spreads them over its blocks by a hash.  Only such hubs are
    joined back to the links; they are at most as many as links divided by the size of a block."""
    pairs = neighbour_pairs(edges).select(F.col("src").alias("channel"), F.col("dst").alias("neighbour"))
    degrees = pairs.groupBy("channel").agg(F.count("*").alias("degree"))
    blocks = F.ceil(F.col("degree") / block_neighbours).cast("long")
    hubs = degrees.where(F.col("degree") > block_neighbours).select("channel", blocks.alias("blocks"))
    placed = pairs.join(hubs, "channel", "left").select(
        "channel", "neighbour",
        F.coalesce(portable_hash(F.col("neighbour"), seed) % F.col("blocks"), F.lit(0)).cast("long").alias("block"),
    )
    lists = placed.groupBy("channel", "block").agg(F.sort_array(F.collect_list("neighbour")).alias("neighbours"))
    return lists.join(degrees, "channel").select("channel", "degree", "block", "neighbours")


def drop_dead_channels(edges: DataFrame, dead: DataFrame) -> DataFrame:
    """Edges whose two ends are both alive; ``dead`` has a column ``channel``."""
    gone = dead.select("channel").distinct()
    left = edges.join(gone, edges["src"] == gone["channel"], "left_anti")
    return left.join(gone, left["dst"] == gone["channel"], "left_anti")
