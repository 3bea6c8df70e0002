"""Finding passages of benchmark items in documents with an FM-index per shard of texts.

A task joins texts to shards of bounded size, indexes every word of a shard, searches all windows of
the items backward through wavelet-matrix ranks, locates the occurrences by sampled suffix places and
merges them to spans.  Words that no item has share one symbol.  Items reach the tasks in slices of
bounded size, one slice per pass.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from maskmix.llm.common import append, free_name, texts_of
from maskmix.llm.fm_index import FMIndex
from maskmix.workspace import Workspace

WINDOW = 13
#: Bytes of item text that one pass searches for.
SLICE_BYTES = 8_000_000
#: Words in a shard's index; a longer text is cut into overlapping parts.
SHARD_WORDS = 1_000_000
_CHUNK = 4_000_000

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Phrases:
    """The distinct windows of a slice of items, as numbers of the slice's vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in items})
        number = {i: n for n, i in enumerate(self.ids)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for at in range(max(1, len(symbols) - window + 1) if symbols else 0):
                owners.setdefault(tuple(symbols[at : at + window]), set()).add(number[item])
        self.owners = [sorted(o) for o in owners.values()]
        self.lengths = np.array([len(p) for p in owners], dtype=np.int64)
        self.patterns = np.zeros((len(owners), window), dtype=np.int32)
        for row, p in enumerate(owners):
            self.patterns[row, window - len(p) :] = p

    def numbers(self, text: str | None) -> np.ndarray:
        """A text's words as numbers; words of no item get the number after the last."""
        data = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
        other, get, out, at = len(self.vocabulary) + 1, self.vocabulary.get, [], 0
        while at < len(data):
            end = len(data) if len(data) - at <= _CHUNK else max(data.rfind(b" ", at, at + _CHUNK), at)
            if end == at:  # one word longer than a chunk
                end = data.find(b" ", at + 1) if data.find(b" ", at + 1) > 0 else len(data)
            out.append(np.array([get(w, other) for w in data[at:end].split()], dtype=np.int32))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def occurrences(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, pattern) of every occurrence of every pattern."""
        found = []
        for shard in self._shards(texts):
            symbols = np.concatenate([np.append(texts[t][a:b], 0) for t, a, b in shard])
            size = np.array([b - a + 1 for _, a, b in shard], dtype=np.int64)
            starts = np.cumsum(size) - size
            index = FMIndex(symbols, starts)
            low, high = index.search(self.patterns, self.lengths)
            many = high - low
            if not many.sum():
                continue
            pattern = np.repeat(np.arange(len(many)), many)
            rows = np.arange(len(pattern)) - np.repeat(np.cumsum(many) - many, many) + low[pattern]
            place = index.locate(rows)
            part = np.searchsorted(starts, place, side="right") - 1
            text, begin = (np.array(x, dtype=np.int64) for x in list(zip(*shard))[:2])
            found.append((text[part], begin[part] + place - starts[part], pattern))
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (empty, empty, empty)

    def _shards(self, texts: list[np.ndarray]):
        held, size = [], 0
        shortest = int(self.lengths.min(initial=self.window + 1))
        for t, numbers in enumerate(texts):
            for a in range(0, len(numbers), SHARD_WORDS):
                b = min(len(numbers), a + SHARD_WORDS + self.window - 1)
                if b - a < shortest:
                    continue
                held.append((t, a, b))
                size += b - a + 1
                if size >= SHARD_WORDS:
                    yield held
                    held, size = [], 0
        if held:
            yield held


def _spans(sizes: np.ndarray, text: np.ndarray, first: np.ndarray, length: np.ndarray):
    """Merged (text, start, stop) of ranges of words."""
    base = np.cumsum(sizes + 1) - sizes - 1  # one empty place between texts
    change = np.zeros(int((sizes + 1).sum()) + 1, dtype=np.int64)
    np.add.at(change, base[text] + first, 1)
    np.add.at(change, base[text] + first + length, -1)
    inside = (np.cumsum(change) > 0).astype(np.int8)
    edge = np.diff(np.concatenate([[0], inside]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(base, start, side="right") - 1
    return owner, start - base[owner], stop - base[owner]


def _find(phrases: Phrases, text: str):
    def run(batch: pa.RecordBatch):
        texts = [phrases.numbers(t) for t in texts_of(batch, text)]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        where, first, pattern = phrases.occurrences(texts) if len(phrases.lengths) else (np.zeros(0, np.int64),) * 3
        spans: list[list] = [[] for _ in texts]
        items: list[list[str]] = [[] for _ in texts]
        if len(where):
            for t, a, b in zip(*(x.tolist() for x in _spans(sizes, where, first, phrases.lengths[pattern]))):
                spans[t].append({"start": a, "stop": b})
            pairs = np.unique(where * len(phrases.lengths) + pattern)
            owners: dict[int, set[int]] = {}
            for t, p in zip(*(x.tolist() for x in np.divmod(pairs, len(phrases.lengths)))):
                owners.setdefault(t, set()).update(phrases.owners[p])
            for t, numbers in owners.items():
                items[t] = [phrases.ids[n] for n in sorted(numbers)]
        kind = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        return [
            pa.array(sizes, pa.int64()),
            pa.array(spans, pa.list_(kind)),
            pa.array(items, pa.list_(pa.string())),
        ]

    return run


def _covered(spans: Column) -> Column:
    """Words that a list of spans covers."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(a["upto"], s["start"]))).alias("n"),
        F.greatest(a["upto"], s["stop"]).alias("upto"),
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["n"])


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
    workspace: Workspace | None = None,
) -> DataFrame:
    """``docs`` with one more column, whose name is its last: a struct of ``n_words, n_hit, spans``
    (start and stop in words, merged within a slice of items), ``items`` (sorted ids as text) and
    ``contaminated`` (hit words are at least a twentieth of all).

    No words: nothing is hit.  Items without words have no window.  Rows of items that share an id are
    one item; a missing item id is the empty one.
    """
    spark = docs.sparkSession
    one = items.select(
        F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("i"),
        F.coalesce(F.col(item_text_col), F.lit("")).alias("t"),
    )
    size = one.agg(F.sum(F.octet_length("t") + F.octet_length("i")).alias("n")).first()["n"] or 0
    slices = max(1, -(-size // slice_bytes))
    slot = F.pmod(F.xxhash64("i", "t"), F.lit(slices))
    name = free_name(docs, "passages")
    own = list(docs.columns)
    passes = []
    for k in range(slices):
        part = one.where(slot == k) if slices > 1 else one
        phrases = Phrases([(r["i"], r["t"]) for r in part.collect()], window)  # at most about slice_bytes
        n, spans, ids = (free_name(docs, f"{x}_{k}") for x in ("n_words", "spans", "items"))
        added = [(n, "long"), (spans, "array<struct<start:long,stop:long>>"), (ids, "array<string>")]
        docs = append(docs, text_col, added, partial(_find, phrases, text_col), most=6_000_000)
        if slices > 1:  # a stage holds one slice
            workspace = workspace or Workspace(spark, "passages")
            docs = workspace.save(docs, f"pass-{k}")
        passes.append((n, spans, ids))
    all_spans = F.concat(*[F.col(s) for _, s, _ in passes])
    all_items = F.sort_array(F.array_distinct(F.concat(*[F.col(i) for _, _, i in passes])))
    n_words, hit = F.col(passes[0][0]), _covered(all_spans)
    whole = docs.select(*own, n_words.alias("__n"), hit.alias("__hit"), all_spans.alias("__s"), all_items.alias("__i"))
    verdict = (F.col("__hit") > 0) & (20 * F.col("__hit") >= F.col("__n"))
    fields = [
        F.col("__n").alias("n_words"), F.col("__hit").alias("n_hit"), F.col("__s").alias("spans"),
        F.col("__i").alias("items"), verdict.alias("contaminated"),
    ]
    return whole.select(*own, F.struct(*fields).alias(name))
