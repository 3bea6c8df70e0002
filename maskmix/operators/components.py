"""Connected components of links in a table, by alternating stars.

Tasks first replace the links they hold by a spanning forest, which leaves at most one link per node they have
seen.  Then large stars tie a node's larger neighbours to its least one and small stars its smaller ones, until
a round changes nothing.  Least neighbours are summed up before anything moves; the join that hands them out is
between two tables, so adaptive execution can split a node that has most of the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskmix.functions.runtime import map_arrow
from maskmix.workspace import Workspace

#: Links a task reduces at a time.
LINKS_AT_ONCE = 1_000_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, ascending, and for each the least node it is connected to."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lower = np.minimum(label[one], label[two])
        after = label.copy()
        np.minimum.at(after, label[one], lower)
        np.minimum.at(after, label[two], lower)
        after = after[after]
        if (after == label).all():
            return nodes, nodes[label]
        label = after


def _reduce(batches):
    a = b = np.zeros(0, np.int64)

    def stars():
        nodes, least = least_reachable(a, b)
        leaf = nodes != least
        return nodes[leaf], least[leaf]

    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) >= LINKS_AT_ONCE:
            a, b = stars()
            if len(a) >= LINKS_AT_ONCE // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                a = b = np.zeros(0, np.int64)
    if len(a):
        a, b = stars()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def component_roots(links: DataFrame, workspace: Workspace) -> DataFrame:
    """``node, component`` for every node that is linked and is not the least of its component.

    ``links`` have whole-number columns ``a`` and ``b``, in one direction or both."""
    near = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    near = near.repartitionByRange("a")  # nodes that lie close are likely connected
    stars = workspace.save(map_arrow(near, _reduce, "a long, b long"), "links-start")
    before, turn = None, 0
    while True:
        h = F.xxhash64("a", "b")
        digest = tuple(stars.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 24))).first())
        if digest == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, turn = digest, turn + 1
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = workspace.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), f"least-{turn % 2}")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = workspace.save(large.where("a <> b").distinct(), f"large-{turn % 2}")
        lower = workspace.save(large.groupBy("a").agg(F.min("b").alias("m")), f"lower-{turn % 2}")
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = lower.select("a", F.col("m").alias("b"))
        stars = workspace.save(small.union(own).distinct(), f"links-{turn % 2}")
