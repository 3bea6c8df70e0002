"""Near-duplicate documents by the exact Jaccard similarity of their sets of word shingles.

Texts at similarity 0.8 differ in about 10 of 64 SimHash bits, which no segment of a fingerprint
survives often enough to index.  A text is therefore indexed by the segments of a longer signature:
``BANDS`` keys of ``ROWS`` least hashes each, one of which two texts at 0.8 share but for one pair in
300,000.  Texts that share a key are candidates; the candidates of a connected group meet once, with
their whole sets of shingle hashes, and only similarities of at least 0.8 become links.

With ``fingerprints`` texts are also linked as ``simhash`` links them: by SimHash fingerprints, found by
multi-index hashing, at its distance.  Both kinds of links make the components.

A group of more than ``MEMBERS`` texts or ``SHINGLES`` shingles is dealt out as pairs of blocks, so a
task compares a bounded number of texts and no pair of a group is left out.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from maskmix.functions.runtime import map_arrow
from maskmix.llm.common import append, free_name, texts_of
from maskmix.llm.components import CHUNK_EDGES, components, edge_batch, forest
from maskmix.llm.simhash import fingerprint, near_links, shingle_hashes
from maskmix.workspace import Workspace

SHINGLE = 5
#: Links have at least this similarity, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS = 24
ROWS = 4
#: Texts and shingles of a block; a task compares two blocks at a time.
MEMBERS = 1024
SHINGLES = 1_000_000
_SEED = 42
_AT_ONCE = 2048
_DEALT = ["root", "b1", "b2"]


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of a text in order; empty for a text without words."""
    parts = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    factor, shift = rng.integers(0, 2**64, (2, 1, BANDS * ROWS), dtype=np.uint64)
    return factor | np.uint64(1), shift


def signature_keys(shingles: np.ndarray, permutations: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One key per band, the band mixed in; a text without words has none."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    factor, shift = permutations
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), _AT_ONCE):
        np.minimum(least, (shingles[at : at + _AT_ONCE, None] * factor + shift).min(axis=0), out=least)
    bands = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64)


def _marks(text: str, width: int, fingerprints: bool):
    permutations = _permutations()

    def run(batch: pa.RecordBatch):
        sets, sizes, keys, prints = [], [], [], []
        for t in texts_of(batch, text):
            s = shingle_set(t, width)
            sets.append(xxhash.xxh64_intdigest(s.tobytes(), _SEED))
            sizes.append(len(s))
            keys.append(signature_keys(s, permutations))
            if fingerprints:
                prints.append(fingerprint(t))
        columns = [
            pa.array(np.array(sets, np.uint64).view(np.int64)),
            pa.array(sizes, pa.int64()),
            pa.array(keys, pa.list_(pa.int64())),
        ]
        return columns + [pa.array(prints, pa.int64())] * fingerprints

    return run


def _sets(text: str, width: int):
    return lambda batch: [
        pa.array([shingle_set(t, width).view(np.int64) for t in texts_of(batch, text)], pa.list_(pa.int64()))
    ]


def set_links(fps: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what pairs of at least the least similarity connect; ``across``: pairs within
    a block are compared elsewhere.  Texts that are connected already are not compared again."""
    n = len(fps)
    size = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    shingles, at = np.unique(np.concatenate(sets), return_inverse=True)
    label, inside = np.arange(n), np.zeros(len(shingles), bool)
    up, down = LEAST
    for i in range(n - 1):
        later = size[i + 1 :]
        open_ = (label[i + 1 :] != label[i]) & (down * np.minimum(later, size[i]) >= up * np.maximum(later, size[i]))
        if across:
            open_ &= blocks[i + 1 :] != blocks[i]
        if not open_.any():
            continue
        own = at[start[i] : start[i + 1]]
        inside[own] = True
        common = np.add.reduceat(inside[at[start[i + 1] :]], start[i + 1 : -1] - start[i + 1], dtype=np.int64)
        inside[own] = False
        near = open_ & (down * common >= up * (size[i] + later - common))
        if near.any():
            met = np.unique(np.concatenate([label[i + 1 :][near], label[i : i + 1]]))
            label[np.isin(label, met)] = met[0]
    tied = label != np.arange(n)
    return fps[tied], fps[label[tied]]


def _links(batches):
    """Forests of the links inside sorted groups; keeps one group and the links so far."""
    rest: pa.Table | None = None
    u = v = np.zeros(0, np.int64)

    def complete(table: pa.Table):
        nonlocal u, v
        cells = [table.column(k).to_numpy() for k in _DEALT]
        fp, block = table.column("fp").to_numpy(), table.column("b").to_numpy()
        sets = table.column("shingles").combine_chunks()
        offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
        new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cells], axis=0)])
        ends = np.append(np.flatnonzero(new), len(new))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            some = [values[offsets[k] : offsets[k + 1]] for k in range(a, b)]
            x, y = set_links(fp[a:b], block[a:b], some, cells[1][a] != cells[2][a])
            u, v = np.concatenate([u, x]), np.concatenate([v, y])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        cells = [table.column(k).to_numpy() for k in _DEALT]
        same = np.all([c == c[-1] for c in cells], axis=0)
        cut = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            complete(table.slice(0, cut).combine_chunks())
        rest = table.slice(cut)
        if len(u) >= CHUNK_EDGES // 2:
            yield edge_batch(*forest(u, v))
            u = v = np.zeros(0, np.int64)
    if rest is not None and rest.num_rows:
        complete(rest.combine_chunks())
    if len(u):
        yield edge_batch(*forest(u, v))


def similar_links(stored: DataFrame, distinct: DataFrame, text_col: str, row: str, width: int, members: int,
                  workspace: Workspace) -> DataFrame:
    """Edges ``u, v`` between sets of shingles that connect what similarities of at least 0.8 connect.

    ``stored`` has every text with its ``fp`` and ``keys``, ``distinct`` one ``place.row`` per ``fp``."""
    entries = workspace.save(stored.select("fp", F.explode("keys").alias("key")).distinct(), "entries")
    shared = entries.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    shared = workspace.save(shared.select("key", "low"), "shared")
    stars = entries.join(shared, "key").where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v"))
    groups = components(workspace.save(stars.distinct(), "stars"), workspace)
    groups = workspace.save(groups.select(F.col("node").alias("fp"), "root"), "groups")
    mine = workspace.save(distinct.join(groups, "fp").select("fp", "root", "size", F.col("place.row").alias(row)), "members")
    wide = F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("size") / SHINGLES)).cast("int")
    mine = mine.join(mine.groupBy("root").agg(wide.alias("blocks")), "root").select(row, "fp", "root", "blocks")
    mine = mine.hint("merge")  # alike at every size
    texts = stored.select(row, F.col(text_col).alias("__text")).join(mine, row).select("fp", "root", "blocks", "__text")
    sets = append(texts, "__text", [("shingles", "array<long>")], partial(_sets, "__text", width)).drop("__text")
    sets = workspace.save(sets.withColumn("b", F.pmod(F.xxhash64("fp"), "blocks").cast("int")), "sets")
    zero = F.lit(0)
    dealt = sets.withColumn("o", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "fp", "b", "shingles")
    dealt = dealt.repartition(*_DEALT).sortWithinPartitions(*_DEALT)
    return map_arrow(dealt, _links, "u long, v long")


def fingerprint_links(stored: DataFrame, workspace: Workspace) -> DataFrame:
    """Edges ``u, v`` between sets of shingles ``fp`` that connect what SimHash fingerprints ``sim`` connect.

    Sets under one fingerprint are tied to the least of them, which also stands for the fingerprint in its links."""
    pairs = workspace.save(stored.select("fp", "sim").distinct(), "prints")
    first = workspace.save(pairs.groupBy("sim").agg(F.min("fp").alias("low"), F.max("fp").alias("high")), "firsts")
    links = workspace.save(near_links(first.select(F.col("sim").alias("fp")), workspace), "print-links")
    shared = first.where("low < high").select("sim", "low")
    alike = pairs.join(shared, "sim").where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v"))
    low = lambda print_, name: first.select(F.col("sim").alias(print_), F.col("low").alias(name))
    near = links.withColumnsRenamed({"u": "a", "v": "b"}).join(low("a", "u"), "a").join(low("b", "v"), "b")
    return alike.union(near.where("u <> v").select("u", "v"))


def keep_first_similar(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    members: int = MEMBERS,
    workspace: Workspace | None = None,
    fingerprints: bool = False,
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of every component the row with the smallest id.
    With ``fingerprints`` close SimHash fingerprints link texts beside similar sets of shingles.

    Texts without words are copies of each other.  Rows without an id come last, and among rows that
    share the smallest id one stays.
    """
    workspace = workspace or Workspace(docs.sparkSession, "similar")
    own = list(docs.columns)
    row, fp, size, keys, sim = (free_name(docs, n) for n in ("__row", "__fp", "__size", "__keys", "__sim"))
    added = [(fp, "long"), (size, "long"), (keys, "array<long>")] + [(sim, "long")] * fingerprints
    marked = append(docs, text_col, added, partial(_marks, text_col, width, fingerprints))
    stored = workspace.save(marked.withColumn(row, F.monotonically_increasing_id()), "marked")
    narrow = stored.select(F.col(fp).alias("fp"), F.col(size).alias("size"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    distinct = narrow.groupBy("fp").agg(F.min(place).alias("place"), F.max("size").alias("size"))
    distinct = workspace.save(distinct, "distinct")
    texts = stored.select(F.col(row).alias("__row"), F.col(text_col).alias("__body"), F.col(fp).alias("fp"), F.col(keys).alias("keys"))
    links = similar_links(texts, distinct, "__body", "__row", width, members, workspace)
    if fingerprints:
        links = links.union(fingerprint_links(stored.select(F.col(fp).alias("fp"), F.col(sim).alias("sim")), workspace))
    links = workspace.save(links, "links")
    roots = components(links, workspace).select(F.col("node").alias("fp"), "root")
    known = distinct.join(roots, "fp", "left").select("place", F.coalesce("root", "fp").alias("root"))
    kept = known.groupBy("root").agg(F.min("place").alias("place")).select(F.col("place.row").alias(row))
    kept = workspace.save(kept, "kept").hint("merge")  # as many rows as texts: alike at every size
    return stored.join(kept, row, "left_semi").select(*own)
