"""Connected components of a graph that is only known as edges in a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskmix.functions.runtime import map_arrow
from maskmix.workspace import Workspace

#: Edges a task contracts at a time.
CHUNK_EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) with the same components as the edges (a, b)."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])


def _contract(batches):
    """Replaces the edges of a task, a bounded number at a time, by those of a spanning forest."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) >= CHUNK_EDGES:
            a, b = forest(a, b)
            if len(a) >= CHUNK_EDGES // 2:
                yield edge_batch(a, b)
                a = b = np.zeros(0, np.int64)
    if len(a):
        yield edge_batch(*forest(a, b))


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(F.shiftrightunsigned(h, 20)), F.bit_xor(h)).first()
    return tuple(row)


def components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """``node, root`` (the smallest node of its component) for every node of the edges ``u, v``.

    Alternating stars: a node's larger neighbours, then its smaller ones, are tied to the least
    neighbour.  Only that minimum is gathered per node, before any move; the join that hands it out
    can be split where a node has very many edges.  Ends when a round changes nothing.
    """
    edges = workspace.save(map_arrow(edges.select("u", "v"), _contract, "u long, v long"), "edges-0")
    known, turn = None, 0
    while (digest := _digest(edges)) != known:
        known, turn = digest, turn + 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = workspace.save(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"large-{turn}")
        tied = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = workspace.save(tied.where("u <> v").distinct(), f"edges-{turn}-a")
        least = workspace.save(edges.groupBy("u").agg(F.min("v").alias("m")), f"small-{turn}")
        tied = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = least.select("u", F.col("m").alias("v"))
        edges = workspace.save(tied.union(stars).distinct(), f"edges-{turn}")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
