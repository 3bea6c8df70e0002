"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

A 64-bit fingerprint is cut into segments.  Two fingerprints at distance four or less agree in some
segment up to a small radius (pigeonhole).  Per segment, every distinct fingerprint is entered under
the keys that come from switching on at most that many of its zero bits; two fingerprints meet under
the union of their bits.  Meetings are verified on all 64 bits inside the task that holds the bucket,
and only a spanning forest of the links leaves it.

A bucket of more than ``BUCKET`` entries is dealt out as pairs of blocks; one for which that would be
more copies than a fingerprint has neighbours at distance two is left to balls of radius two over the
whole fingerprint: fingerprints at distance four share such a neighbour, and no neighbour has more
than 2081 of them.  No link is lost in either way.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from maskmix.functions.runtime import map_arrow
from maskmix.llm.common import append, free_name, texts_of
from maskmix.llm.components import CHUNK_EDGES, components, edge_batch, forest
from maskmix.workspace import Workspace

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Entries of a bucket that one task compares; block pairs hold about twice as many.
BUCKET = 1024
_BALL = 2081  # fingerprints within two bits of one
_SHINGLES_AT_ONCE = 100_000


def shingle_hashes(text: str | None, width: int, seed: int = SEED):
    """Hashes of all word shingles of a whole text, repeats included, a bounded number at a time; a text of
    fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    size = np.array([len(w) for w in words], dtype=np.int64)
    stop = np.cumsum(size + 1) - 1
    width = min(width, len(words))
    starts = (stop - size)[: len(words) - width + 1].tolist()
    stops = stop[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        some = zip(starts[at : at + _SHINGLES_AT_ONCE], stops[at : at + _SHINGLES_AT_ONCE])
        yield np.array([digest(joined[a:b], seed) for a, b in some], dtype="<u8")


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of a whole text over word shingles, repeats included; no words: zero."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, width, seed):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(text: str, width: int):
    return lambda batch: [pa.array([fingerprint(t, width) for t in texts_of(batch, text)], pa.int64())]


def with_fingerprints(docs: DataFrame, text_col: str, name: str, width: int = SHINGLE) -> DataFrame:
    return append(docs, text_col, [(name, "long")], partial(_fingerprints, text_col, width))


def segment_plan(fingerprints: int, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, radius) per segment, such that a random bucket stays small; the links found
    are the same for every plan."""
    m = next((m for m in (4, 3) if fingerprints >> (64 // m) <= 64), 2)
    least, more = divmod(distance, m)
    widths = [64 // m + (k < 64 % m) for k in range(m)]
    return [(sum(widths[:k]), w, least if k <= more else least - 1) for k, w in enumerate(widths)]


def _entries(batches, plan):
    """``segment, key, flips, fp`` of every fingerprint in every segment."""
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for segment, (low, bits, radius) in enumerate(plan):
            part = (fp >> np.uint64(low)) & np.uint64((1 << bits) - 1)
            for flips in range(radius + 1):
                for chosen in combinations(range(bits), flips):
                    mask = np.uint64(sum(1 << b for b in chosen))
                    free = (part & mask) == 0
                    n = int(free.sum())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, segment, np.int8)),
                            pa.array((part[free] | mask).astype(np.int64)),
                            pa.array(np.full(n, flips, np.int8)),
                            pa.array(fp[free].view(np.int64)),
                        ],
                        names=["segment", "key", "flips", "fp"],
                    )


def _verified(columns: list[np.ndarray], radius: np.ndarray, distance: int):
    """Links between rows of one group; groups are consecutive and ordered by flips."""
    group, flips, fp = columns
    at = np.arange(len(fp))
    lag = 0
    while len(at):
        lag += 1
        at = at[at + lag < len(fp)]
        at = at[group[at] == group[at + lag]]
        at = at[flips[at] + flips[at + lag] <= radius[at]]  # later rows of the group have no fewer flips
        near = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= distance]
        if len(near):
            yield fp[near].view(np.int64), fp[near + lag].view(np.int64)


def _links(batches, plan, distance: int):
    """Spanning forests of the links inside sorted groups; keeps one group and the forest so far."""
    radii = np.array([r for _, _, r in plan])
    keys = ["segment", "key", "b1", "b2"]
    rest: pa.Table | None = None
    u = v = np.zeros(0, np.int64)

    def complete(table: pa.Table):
        nonlocal u, v
        cells = [table.column(k).to_numpy() for k in keys]
        new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cells], axis=0)])
        columns = [np.cumsum(new), table.column("flips").to_numpy(), table.column("fp").to_numpy().view(np.uint64)]
        for a, b in _verified(columns, radii[cells[0]], distance):
            apart = a != b
            u, v = np.concatenate([u, a[apart]]), np.concatenate([v, b[apart]])
            if len(u) >= CHUNK_EDGES:
                u, v = forest(u, v)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        cells = [table.column(k).to_numpy() for k in keys]
        same = np.all([c == c[-1] for c in cells], axis=0)
        cut = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            complete(table.slice(0, cut).combine_chunks())
        rest = table.slice(cut)
        if len(u) >= CHUNK_EDGES // 2:
            u, v = forest(u, v)
            yield edge_batch(u, v)
            u = v = np.zeros(0, np.int64)
    if rest is not None and rest.num_rows:
        complete(rest.combine_chunks())
    if len(u):
        yield edge_batch(*forest(u, v))


def _balls(batches):
    """Every fingerprint with all its neighbours at distance two or less."""
    masks = [sum(1 << b for b in c) for n in range(3) for c in combinations(range(64), n)]
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for mask in masks:
            yield pa.RecordBatch.from_arrays(
                [pa.array((fp ^ np.uint64(mask)).view(np.int64)), pa.array(fp.view(np.int64))], names=["z", "fp"]
            )


def near_links(distinct: DataFrame, workspace: Workspace, distance: int = DISTANCE, bucket: int = BUCKET,
               most_blocks: int = _BALL) -> DataFrame:
    """Edges ``u, v`` that connect exactly what links at ``distance`` or less connect.

    ``distinct`` is a stored table of distinct fingerprints ``fp``."""
    plan = segment_plan(distinct.count(), distance)
    entries = map_arrow(distinct.select("fp"), partial(_entries, plan=plan), "segment byte, key long, flips byte, fp long")
    crowded = entries.groupBy("segment", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
    crowded = workspace.save(crowded.withColumn("blocks", F.ceil(F.col("n") / bucket).cast("int")), "crowded")
    n_crowded = crowded.count()
    zero = F.lit(0)
    if not n_crowded:
        placed = entries.withColumn("b1", zero).withColumn("b2", zero)
        return _within(placed, plan, distance)
    few = F.broadcast(crowded) if n_crowded <= 100_000 else crowded
    known = entries.join(few, ["segment", "key"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    block = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    known = known.withColumn("blocks", blocks).withColumn("b", block)
    others = F.when(F.col("blocks") <= most_blocks, F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array(zero))
    placed = known.where(F.col("blocks") <= most_blocks).withColumn("o", F.explode(others))
    placed = placed.withColumn("b1", F.least("b", "o")).withColumn("b2", F.greatest("b", "o"))
    links = _within(placed.select("segment", "key", "flips", "fp", "b1", "b2"), plan, distance)
    if crowded.where(F.col("blocks") > most_blocks).isEmpty():
        return links
    members = known.where(F.col("blocks") > most_blocks).select("fp").distinct()
    least = F.min("fp").over(Window.partitionBy("z"))  # at most 2081 rows per z
    balls = map_arrow(members, _balls, "z long, fp long").withColumn("m", least)
    return links.union(balls.where("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v")).distinct())


def _within(placed: DataFrame, plan, distance: int) -> DataFrame:
    keys = ["segment", "key", "b1", "b2"]
    dealt = placed.select(*keys, "flips", "fp").repartition(*keys).sortWithinPartitions(*keys, "flips")
    return map_arrow(dealt, partial(_links, plan=plan, distance=distance), "u long, v long")


def _named(stored: DataFrame, id_col: str, distance: int, workspace: Workspace) -> DataFrame:
    """``fp, root, component`` per distinct fingerprint of a stored table: the smallest fingerprint and
    the smallest id of its component."""
    distinct = workspace.save(stored.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    links = workspace.save(near_links(distinct, workspace, distance), "links")
    roots = components(links, workspace).select(F.col("node").alias("fp"), "root")
    known = workspace.save(
        distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "known"
    )
    names = workspace.save(known.groupBy("root").agg(F.min("first").alias("component")), "names")
    return workspace.save(known.select("fp", "root").join(names, "root"), "named")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = DISTANCE,
    width: int = SHINGLE,
    workspace: Workspace | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, fp, component``, the smallest id that links can reach.

    A missing or empty text has fingerprint zero and links like any other.  Missing ids count after
    all others: a component of rows without ids has a missing name.  Repeated rows stay.
    """
    workspace = workspace or Workspace(docs.sparkSession, "simhash")
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    stored = workspace.save(with_fingerprints(narrow, "__text", "fp", width).drop("__text"), "fingerprints")
    named = _named(stored, "__id", distance, workspace).select("fp", "component")
    return stored.join(named, "fp").select(F.col("__id").alias(id_col), "fp", "component")


def keep_first(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = DISTANCE,
    width: int = SHINGLE,
    workspace: Workspace | None = None,
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of every component the row with the smallest id.

    Rows without an id come last, and among rows that share the smallest id one stays.
    """
    workspace = workspace or Workspace(docs.sparkSession, "simhash")
    own, row, fp = list(docs.columns), free_name(docs, "__row"), free_name(docs, "__fp")
    marked = with_fingerprints(docs, text_col, fp, width).withColumn(row, F.monotonically_increasing_id())
    stored = workspace.save(marked, "marked")
    narrow = stored.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(fp).alias("fp"))
    named = _named(narrow, "id", distance, workspace)
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    first = narrow.groupBy("fp").agg(F.min(place).alias("place"))  # copies are summed up before they meet their root
    kept = first.join(named, "fp").groupBy("root").agg(F.min("place").alias("place")).select(F.col("place.row").alias(row))
    kept = workspace.save(kept, "kept").hint("merge")  # as many rows as texts: alike at every size
    return stored.join(kept, row, "left_semi").select(*own)


def fingerprint_hex(fp: str):
    """A fingerprint column as sixteen hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
