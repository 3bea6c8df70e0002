"""Ranked lexical search by dense blocked matrix products: item tiles times document tiles, exact in float64.

Texts are read once per slice of items: a document keeps its length and, of the slice's vocabulary, the
terms it holds with their counts.  Document frequencies are summed from that table.  Scoring goes over it in
tiles: a block of items has a compact vocabulary, its weights form a dense matrix, the impacts of a tile of
documents another, and their product is one BLAS call.  Weights and impacts are whole numbers; a product sums
over at most ``VOCABULARY_TILE`` terms, so every partial sum is below 2^53 and exact in any order, and tiles are
added as 64-bit integers.  A task keeps the best rows of each item, ties by the smaller id, and hands on no more.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from maskmix.functions.runtime import map_arrow
from maskmix.llm.common import regroup
from maskmix.workspace import Workspace

#: Bytes of item ids and texts that are searched in one pass over the documents.
SLICE_BYTES = 4_000_000
ITEM_TILE, DOCUMENT_TILE = 256, 512
#: Terms of one product.  A weight is below 1000 * ln(2^65) < 45,100 and an impact below 10^6, so that a sum
#: over so many terms stays below 1.9e14 < 2^53.
VOCABULARY_TILE = 4096
#: Scoring tasks per core; each hands on at most ``k`` rows an item.
TASKS_PER_CORE = 4

#: Bytes of a term in lower case; every other byte is a gap.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order: runs of ASCII letters and digits and of all other characters from U+0080 on."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def weight(n_documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * frequency + 1)))


class ItemTile:
    """Some items with their compact vocabulary, cut into tiles of terms."""

    def __init__(self, first: int, vocabularies: list[np.ndarray], weights: np.ndarray):
        self.first, self.n_items = first, len(vocabularies)
        known = np.unique(np.concatenate(vocabularies)) if vocabularies else np.zeros(0, np.int64)
        self.pieces = []
        for at in range(0, len(known), VOCABULARY_TILE):
            ids = known[at : at + VOCABULARY_TILE]
            dense = np.zeros((self.n_items, len(ids)))
            for row, own in enumerate(vocabularies):
                place = np.searchsorted(ids, own)
                place = place[(place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == own)]
                dense[row, place] = weights[ids[place]]
            assert dense.sum(axis=1).max(initial=0) * 1e6 < 2**53
            local = np.full(len(weights), -1, np.int32)
            local[ids] = np.arange(len(ids))
            self.pieces.append((local, dense))

    def scores(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        total = np.zeros((self.n_items, n_docs), np.int64)
        for local, dense in self.pieces:
            place = local[term]
            held = place >= 0
            tile = np.zeros((dense.shape[1], n_docs))
            tile[place[held], doc[held]] = impact[held]
            total += (dense @ tile).astype(np.int64)
        return total


class Best:
    """The best ``k`` documents of every item so far: by score, then smaller id, a missing id before all others."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.zeros(n_items, np.int64)  # score that a full item's last row has
        self.item = self.score = self.id = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        item, doc = np.nonzero((scores > 0) & (scores >= self.least[first : first + len(scores), None]))
        if not len(item):
            return
        item_all = np.concatenate([self.item, item + first])
        score = np.concatenate([self.score, scores[item, doc]])
        key, has = np.concatenate([self.id, ids[doc]]), np.concatenate([self.known, known[doc]])
        order = np.lexsort((key, has, -score, item_all))
        item_all, score, key, has = item_all[order], score[order], key[order], has[order]
        start = np.flatnonzero(np.concatenate([[True], item_all[1:] != item_all[:-1]]))
        rank = np.arange(len(item_all)) - np.repeat(start, np.diff(np.concatenate([start, [len(item_all)]])))
        last = rank == self.k - 1
        self.least[item_all[last]] = score[last]
        keep = rank < self.k
        self.item, self.score, self.id, self.known = item_all[keep], score[keep], key[keep], has[keep]


def _hits(batches, vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    get = vocabulary.get
    for batch in regroup(batches, "__text"):
        sizes, held, found, counts = [], [], [], []
        texts = batch.column(batch.schema.get_field_index("__text")).to_pylist()
        for text in texts:
            own = terms(text)
            sizes.append(len(own))
            counter = Counter(filter(None, map(get, own)))
            held.append(len(counter))
            found.extend(counter.keys())
            counts.extend(counter.values())
        offsets = pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((found, pa.int32()), (counts, pa.int64()))]
        ids = batch.column(batch.schema.get_field_index("__id"))
        made = pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *lists], names=["__id", "n", "terms", "counts"])
        yield made.filter(pa.array(np.array(sizes) > 0))


def _best_rows(batches, owners: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    tiles = [ItemTile(at, owners[at : at + ITEM_TILE], weights) for at in range(0, len(owners), ITEM_TILE)]
    best = Best(len(owners), k)
    for batch in batches:
        for at in range(0, batch.num_rows, DOCUMENT_TILE):
            some = batch.slice(at, DOCUMENT_TILE)
            column = lambda name: some.column(some.schema.get_field_index(name))  # noqa: E731,B023
            lists = column("terms")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            term = lists.flatten().to_numpy(zero_copy_only=False)
            tf = column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            spread = np.array([50 + 50 * n * n_docs // n_terms for n in column("n").to_pylist()], np.int64)
            doc = np.repeat(np.arange(some.num_rows), sizes)
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * spread[doc])
            known = column("__id").is_valid().to_numpy(zero_copy_only=False)
            ids = column("__id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for tile in tiles:
                best.add(tile.first, tile.scores(term, doc, impact, some.num_rows), ids, known)
    yield pa.RecordBatch.from_arrays(
        [pa.array(best.item, pa.int32()), pa.array(best.id, pa.int64(), mask=~best.known), pa.array(best.score, pa.int64())],
        names=["__item", "__id", "score"],
    )


def _item_slices(items: DataFrame, id_col: str, text_col: str, slice_bytes: int) -> Iterator[tuple[list, list[set[bytes]]]]:
    """Ids and term sets of the items, about ``slice_bytes`` of them at a time; rows that share an id are one item."""
    one = items.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = one.agg(F.sum(F.octet_length("t") + F.lit(16)).alias("n")).first()["n"] or 0
    slices = max(1, -(-size // slice_bytes))
    for s in range(slices):
        part = one.where(F.pmod(F.xxhash64("i"), F.lit(slices)) == s) if slices > 1 else one
        found: dict = {}
        for r in part.collect():
            found.setdefault(r["i"], set()).update(terms(r["t"]))
        yield list(found), list(found.values())


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    slice_bytes: int = SLICE_BYTES,
    workspace: Workspace | None = None,
) -> DataFrame:
    """``item_id_col, rank, id_col, score``: the ``k`` best documents of every item with a score above 0.

    A document without terms counts nowhere.  Equal scores follow each other by ascending id, a missing id
    first; repeated rows are documents of their own.  Rows of items that share an id, also a missing one, are
    one item; items without terms, and empty tables, find nothing.  Ids of documents are whole numbers.  Other
    columns are not read, so their names do not matter.
    """
    spark = docs.sparkSession
    workspace = workspace or Workspace(spark, "lexical")
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    item_kind = items.schema[item_id_col].dataType.simpleString()
    by_item = Window.partitionBy("__item").orderBy(F.desc("score"), F.asc_nulls_first("__id"))
    passes = []
    for s, (ids, sets) in enumerate(_item_slices(items, item_id_col, item_text_col, slice_bytes)):
        vocabulary = {t: n for n, t in enumerate(sorted(set().union(*sets)), start=1)}
        hits = map_arrow(texts, partial(_hits, vocabulary=vocabulary), "__id long, n long, terms array<int>, counts array<long>")
        hits = workspace.save(hits, f"hits-{s}")
        whole = hits.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not whole["docs"] or not vocabulary:
            continue
        weights = np.zeros(len(vocabulary) + 1)
        frequencies = hits.select(F.explode("terms").alias("term")).groupBy("term").count()
        for r in frequencies.collect():  # at most the slice's vocabulary
            weights[r["term"]] = weight(whole["docs"], r["count"])
        owners = [np.array(sorted(vocabulary[t] for t in own), np.int64) for own in sets]
        step = partial(_best_rows, owners=owners, weights=weights, n_docs=whole["docs"], n_terms=whole["terms"], k=k)
        tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
        best = map_arrow(hits.coalesce(tasks), step, "__item int, __id long, score long")
        ranked = best.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"__item int, __name {item_kind}")
        named = ranked.join(F.broadcast(names), "__item").select("__name", "rank", "__id", "score")
        passes.append(workspace.save(named, f"ranked-{s}"))
    empty = spark.createDataFrame([], f"__name {item_kind}, rank int, __id long, score long")
    out = passes[0] if passes else empty
    for more in passes[1:]:
        out = out.unionByName(more)
    return out.withColumnsRenamed({"__name": item_id_col, "__id": id_col})
