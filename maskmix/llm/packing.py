"""Packing documents into sequences of bounded length by exact complements, then best fit.

The plan needs only how many pieces each length has, at most ``capacity`` numbers, so it is the same
work at any corpus size.  Lengths are taken from the longest down.  For the gap that a length leaves,
an index of single lengths, pair sums and triple sums names combinations that fill it exactly; a
combination is used as often as its counts allow, which uses up at least one length.  What has no
exact complement is packed by best fit, again many equal sequences at a time.

Pieces get their place without moving: a task numbers its pieces per length, the numbers of tasks are
summed up per length, and the plan says for every length which numbers go to which sequences.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from maskmix.functions.runtime import map_arrow
from maskmix.llm.common import regroup, texts_of
from maskmix.llm.tokens import encoder
from maskmix.workspace import Workspace

CAPACITY = 1024


class SumIndex:
    """Available lengths, indexed by the sums of one, two and three of them."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()

    def times(self, combination: tuple[int, ...]) -> int:
        """How often the counts allow the combination."""
        return min(int(self.left[x]) // n for x, n in Counter(combination).items())

    def fill(self, length: int, gap: int, most: int = 3) -> tuple[int, ...] | None:
        """Up to ``most`` lengths that exactly fill ``gap`` beside ``length``, larger ones first."""
        found = self._single(length, gap)
        if not found and most > 1:
            found = self._pair((length,), gap)
        if not found and most > 2:
            found = self._triple(length, gap)
        return found

    def _single(self, length: int, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.times((length, gap)) else None

    def _pair(self, beside: tuple[int, ...], gap: int) -> tuple[int, ...] | None:
        there = self.left > 0
        larger = np.arange(gap - 1, (gap - 1) // 2, -1)
        for a in larger[there[larger] & there[gap - larger]]:
            if self.times((*beside, int(a), gap - int(a))):
                return int(a), gap - int(a)
        return None

    def _triple(self, length: int, gap: int) -> tuple[int, ...] | None:
        there = (self.left > 0).astype(np.int64)
        pair_sums = np.convolve(there[:gap], there[:gap])
        largest = np.arange(gap - 2, 0, -1)
        for a in largest[(there[largest] > 0) & (pair_sums[gap - largest] > 0)]:
            pair = self._pair((length, int(a)), gap - int(a)) if self.times((length, int(a))) else None
            if pair:
                return int(a), *pair
        return None

    def use(self, combination: tuple[int, ...], times: int) -> None:
        for x in combination:
            self.left[x] -= times


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in them, how many such sequences); ``counts[n]`` pieces have length n.

    Exact combinations use up short pieces that best fit could have put into gaps without an exact
    complement.  So plans are made with combinations of up to three, two and one lengths beside the
    longest, and with shorter pieces kept back; the one with the fewest sequences is taken.
    """
    best = None
    for others in (3, 2, 1):
        for shortest in (1, capacity // 16, capacity // 8, capacity // 4):
            made = _exact_then_best_fit(counts, capacity, others, shortest)
            if best is None or sum(n for _, n in made) < sum(n for _, n in best):
                best = made
    return best


def _exact_then_best_fit(counts: np.ndarray, capacity: int, others: int, shortest: int):
    long_enough = np.arange(len(counts)) >= shortest
    index, out = SumIndex(np.where(long_enough, counts, 0)), []
    if index.left[capacity]:
        out.append(((capacity,), int(index.left[capacity])))
        index.left[capacity] = 0
    for length in range(capacity - 1, shortest - 1, -1):
        while index.left[length] and (beside := index.fill(length, capacity - length, others)):
            combination = (length, *beside)
            times = index.times(combination)
            index.use(combination, times)
            out.append((combination, times))
    return out + _best_fit(np.where(long_enough, index.left, counts), capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for all pieces of a length at once."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in open_ if g >= length), default=capacity)
            inside, bins = open_[gap].pop() if gap in open_ else ((), n)
            if gap in open_ and not open_[gap]:
                del open_[gap]
            each = min(gap // length, n)
            filled = min(bins, n // each)
            n -= filled * each
            if inside and bins > filled:
                open_.setdefault(gap, []).append((inside, bins - filled))
            open_.setdefault(gap - each * length, []).append((inside + (length,) * each, filled))
    return [group for groups in open_.values() for group in groups]


def slots(sequences: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first piece number of each run, the sequence of that piece, its place there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for lengths, times in sequences:
        place = 0
        for n in lengths:
            runs.setdefault(n, []).append((used[n], base, place))
            used[n] += times
            place += n
        base += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for n, r in runs.items()}


def _cut(batches, tokenizer_path: str, end_id: int, capacity: int):
    tokens = encoder(tokenizer_path)
    end = np.array([end_id], dtype="<u4").tobytes()
    seen: Counter = Counter()
    for batch in regroup(batches, "__text"):
        rows, pieces, starts, lengths, crcs, numbers = [], [], [], [], [], []
        for row, raw in enumerate(tokens.encode(texts_of(batch, "__text"))):
            raw = memoryview(raw + end)
            n = len(raw) // 4
            start, stop, piece = 0, n % capacity or capacity, 0
            stop = min(stop, n)
            while start < n:
                rows.append(row)
                pieces.append(piece)
                starts.append(start)
                lengths.append(stop - start)
                crcs.append(zlib.crc32(raw[4 * start : 4 * stop]))
                numbers.append(seen[stop - start])
                seen[stop - start] += 1
                start, stop, piece = stop, stop + capacity, piece + 1
        take = pa.array(rows, pa.int64())
        part = batch.column(batch.schema.get_field_index("__part"))
        ids = batch.column(batch.schema.get_field_index("__id"))
        yield pa.RecordBatch.from_arrays(
            [ids.take(take), part.take(take), pa.array(pieces, pa.int32())]
            + [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, numbers)],
            names=["__id", "__part", "piece", "start", "length", "ids_crc32", "__number"],
        )


def _place(batches, runs):
    for batch in batches:
        length, number = (
            batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "__rank")
        )
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            first, base, place = runs[int(n)]
            run = np.searchsorted(first, number[at], side="right") - 1
            sequence[at] = base[run] + number[at] - first[run]
            offset[at] = place[run]
        keep = [i for i, n in enumerate(batch.schema.names) if n != "__rank"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in keep], pa.array(sequence), pa.array(offset)],
            names=[*[batch.schema.names[i] for i in keep], "sequence_id", "offset"],
        )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    capacity: int = CAPACITY,
    workspace: Workspace | None = None,
) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut into full pieces after a
    first that takes the rest.  A missing text is empty (one piece, the end id); rows that share an
    id are documents of their own; an empty table gives no rows.
    """
    workspace = workspace or Workspace(docs.sparkSession, "packing")
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = source.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, __part int, piece int, start long, length long, ids_crc32 long, __number long"
    step = partial(_cut, tokenizer_path=tokenizer_path, end_id=end_id, capacity=capacity)
    cut = map_arrow(source.withColumn("__part", F.spark_partition_id()), step, schema)
    stored = workspace.save(cut, "pieces")
    in_part = stored.groupBy("__part", "length").agg(F.count("*").alias("__n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in in_part.groupBy("length").agg(F.sum("__n").alias("n")).collect():  # one row per length
        counts[r["length"]] = r["n"]
    runs = slots(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = in_part.select("__part", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = stored.join(bases, ["__part", "length"]).select(
        "__id", "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("__number")).alias("__rank")
    )
    out = f"__id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_arrow(ranked, partial(_place, runs=runs), out).withColumnRenamed("__id", id_col)
