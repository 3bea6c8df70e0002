"""Spelling variants by finite-state composition: vocabulary acceptor, one-edit transducer, acceptor again.

Words of a corpus are counted inside tasks and summed once.  Two words that differ by one edit share their
first or their last half, so they meet in a partition of words that start (or, read backwards, start) alike.
A task takes whole partitions, some ``CHUNK_WORDS`` words at a time: their rests become one minimal acceptor whose
initial states are the partitions, and the composition with the one-edit transducer is walked breadth first over
arrays of state pairs.  Every path carries the number of its word in the sorted list (an acceptor with counts
numbers its words), so an accepted pair is a pair of words, and each pair is accepted once: the edit lies where
the two words first differ.

A partition that may hold more than ``HOT_WORDS`` words is not one task's work: its words are dealt out once per
place of the edit, with all that is equal before and behind it as key.  Such a partition has one free place for
words of the shorter length and two for those of the longer, so it is bounded by the alphabet.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskmix.functions.runtime import map_arrow
from maskmix.llm.common import regroup, texts_of
from maskmix.workspace import Workspace

#: Fixed values of the contract.
LEAST_LENGTH, LEAST_COUNT, DROP_ONE_IN, FORM_TIMES = 7, 2, 31, 10

CHUNK_WORDS = 20_000
#: Cells of a chunk's letter matrix at most, so that very long words make small chunks.
CHUNK_CELLS = 4_000_000
HOT_WORDS = 20_000
#: Distinct words a counting task holds before it hands them on.
HELD_WORDS = 300_000

#: Letters in lower case (A-Z only) as single bytes; every other byte is a gap.
_LETTER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def words_of(doc_id, text: str | None) -> Counter:
    """Words of a text with the contract's deletions, in Latin-1 bytes, counted."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    runs = (text or "").encode("latin-1", "replace").translate(_LETTER_BYTES).split()
    for run, n in Counter(r for r in runs if len(r) >= LEAST_LENGTH).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % DROP_ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def _count(batches) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    batch_of = lambda: pa.RecordBatch.from_arrays(
        [pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
    )
    for batch in regroup(batches, "__text"):
        ids = batch.column(batch.schema.get_field_index("__id")).to_pylist()
        for doc_id, text in zip(ids, texts_of(batch, "__text")):
            held.update(words_of(doc_id, text))
            if len(held) >= HELD_WORDS:
                yield batch_of()
                held.clear()
    if held:
        yield batch_of()


class Acceptor:
    """Minimal deterministic acceptor of the rows of a sorted matrix of letters, all rows of a root equally long.

    ``roots`` are the numbers of the rows with which a new root begins.  Rows are distinct within a root."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, roots: np.ndarray):
        n, width = letters.shape
        changed = letters[1:] != letters[:-1]
        differ = np.concatenate([[-1], np.where(changed.any(axis=1), changed.argmax(axis=1), width)])
        differ[roots] = -1
        levels = [np.flatnonzero((lengths >= d) & (differ < d)) for d in range(int(lengths.max(initial=0)) + 1)]
        start = np.concatenate([[0], np.cumsum([len(x) for x in levels])])
        total = int(start[-1])
        symbol, parent = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for d in range(1, len(levels)):
            symbol[start[d] : start[d + 1]] = letters[levels[d], d - 1]
            parent[start[d] : start[d + 1]] = start[d - 1] + np.searchsorted(levels[d - 1], levels[d], side="right") - 1
        final = np.zeros(total, bool)
        for d, rows in enumerate(levels):
            final[start[d] : start[d + 1]] = lengths[rows] == d
        children = np.bincount(parent[start[1] :], minlength=total) if total > start[1] else np.zeros(total, np.int64)
        first_child = np.concatenate([[0], np.cumsum(children)])[:-1] + start[1]
        state = self._classes(symbol, parent, final, start, children, first_child)

        count = final.astype(np.int64)
        for d in range(len(levels) - 1, 0, -1):
            np.add.at(count, parent[start[d] : start[d + 1]], count[start[d] : start[d + 1]])
        _, chosen = np.unique(state, return_index=True)
        self.final = final[chosen]
        self.degree = children[chosen]
        self.first = np.concatenate([[0], np.cumsum(self.degree)])
        edges = np.repeat(first_child[chosen], self.degree) + _within(self.degree)
        self.symbol, self.target = symbol[edges], state[edges]
        below = np.cumsum(count[edges]) - count[edges]
        owner = np.repeat(np.arange(len(chosen)), self.degree)
        begin = below[np.minimum(self.first[:-1], max(len(edges) - 1, 0))] if len(edges) else np.zeros(len(chosen), np.int64)
        self.before = below - begin[owner] + self.final[owner]
        self.key = owner * 256 + self.symbol  # ascending: children are in the order of their symbols
        self.root = state[: start[1]]

    @staticmethod
    def _classes(symbol, parent, final, start, children, first_child) -> np.ndarray:
        """Nodes with the same right language get the same number; a hash proposes, a comparison decides."""
        for seed in range(1, 9):
            mix = _mix(symbol.astype(np.uint64) + np.uint64(seed << 32))
            value = final.astype(np.uint64)
            for d in range(len(start) - 2, 0, -1):
                some = slice(start[d], start[d + 1])
                np.add.at(value, parent[some], _mix(value[some] ^ mix[some]))
            _, chosen, state = np.unique(value, return_index=True, return_inverse=True)
            like = chosen[state]
            if (children == children[like]).all() and (final == final[like]).all():
                own = np.repeat(first_child, children) + _within(children)
                other = np.repeat(first_child[like], children) + _within(children)
                if (symbol[own] == symbol[other]).all() and (state[own] == state[other]).all():
                    return state
        raise ArithmeticError("no collision-free numbering of states")

    def step(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges of some states: (place in ``state``, edge)."""
        degree = self.degree[state]
        return np.repeat(np.arange(len(state)), degree), np.repeat(self.first[state], degree) + _within(degree)

    def common(self, one: np.ndarray, two: np.ndarray, barred: np.ndarray | None = None):
        """Edges of pairs of states with the same symbol, other than ``barred``: (place, edge of one, edge of two)."""
        if not len(self.key):
            return (np.zeros(0, np.int64),) * 3
        place, edge = self.step(one)
        wanted = two[place] * 256 + self.symbol[edge]
        other = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        good = self.key[other] == wanted
        if barred is not None:
            good &= self.symbol[edge] != barred[place]
        return place[good], edge[good], other[good]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of consecutive runs."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def one_edit_pairs(
    acceptor: Acceptor, short: np.ndarray, short_row: np.ndarray, both: np.ndarray, both_row: np.ndarray,
    long: np.ndarray, long_row: np.ndarray, rest: int, first_only: bool,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers one edit apart, each once.

    ``short`` are roots whose words have ``rest`` letters left: pairs by replacing a letter.  ``both`` and ``long``
    go together, the latter with one letter more: pairs by inserting a letter.  With ``first_only`` the edit is
    at the first letter, else anywhere."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    none = np.zeros(0, np.int64)
    e1, r1, e2, r2, bar = none, none, none, none, none  # one edit behind them: states, rows, symbol barred next
    s, sr, x, xr, y, yr = short, short_row, both, both_row, long, long_row
    a = acceptor
    for left in range(rest, -1, -1):
        place, edge = a.step(y)  # the longer word takes a letter more
        e1, r1 = np.concatenate([e1, x[place]]), np.concatenate([r1, xr[place]])
        e2, r2 = np.concatenate([e2, a.target[edge]]), np.concatenate([r2, yr[place] + a.before[edge]])
        bar = np.concatenate([bar, a.symbol[edge]])
        if left == 0:
            found.append((r1, r2))
            break
        place, one, two = a.common(e1, e2, bar)
        e1, r1, e2, r2 = a.target[one], r1[place] + a.before[one], a.target[two], r2[place] + a.before[two]
        place, edge = a.step(s)  # two different letters at the same place
        later = a.first[s[place] + 1] - edge - 1
        i, j = np.repeat(edge, later), np.repeat(edge + 1, later) + _within(later)
        base = np.repeat(sr[place], later)
        e1, r1 = np.concatenate([e1, a.target[i]]), np.concatenate([r1, base + a.before[i]])
        e2, r2 = np.concatenate([e2, a.target[j]]), np.concatenate([r2, base + a.before[j]])
        bar = np.zeros(len(e1), np.int64)
        if first_only:
            s, sr, x, xr, y, yr = (none,) * 6
            continue
        s, sr = a.target[edge], sr[place] + a.before[edge]
        place, one, two = a.common(x, y)
        x, xr, y, yr = a.target[one], xr[place] + a.before[one], a.target[two], yr[place] + a.before[two]
    return found[0]


def near_in_chunk(words: list[bytes], n: np.ndarray, m: int, side: int, cut: int, forced: bool):
    """Per word: how many words of its partition are near it, and which of them is the most frequent.

    Words have ``m`` or ``m + 1`` letters.  Partitions are words that agree on their first ``cut`` letters, backwards
    on ``side`` 1; if ``forced``, also on the ``m - cut - 1`` last ones, and they differ right behind the cut."""
    seen = words if side == 0 else [w[::-1] for w in words]
    cells = np.array(seen, dtype=f"S{m + 1}")
    size = np.array([len(w) for w in seen], np.int64)
    tail = max(m - cut - 1, 0)
    ends = np.array([w[len(w) - tail :] if forced and tail else b"" for w in seen], dtype=f"S{max(tail, 1)}")
    heads = np.array([w[:cut] for w in seen], dtype=f"S{max(cut, 1)}")
    order = np.lexsort((cells, size, ends, heads))
    letters = cells[order].view(np.uint8).reshape(len(seen), m + 1)
    size, ends, heads = size[order], ends[order], heads[order]
    new_key = np.concatenate([[True], (heads[1:] != heads[:-1]) | (ends[1:] != ends[:-1])])
    new_root = new_key | np.concatenate([[True], size[1:] != size[:-1]])
    roots = np.flatnonzero(new_root)
    acceptor = Acceptor(letters[:, cut:], size - cut, roots)
    key_of = np.cumsum(new_key)[roots]
    is_short = size[roots] == m
    short, long = np.flatnonzero(is_short), np.flatnonzero(~is_short)
    _, i, j = np.intersect1d(key_of[short], key_of[long], assume_unique=True, return_indices=True)
    both, more = short[i], long[j]
    state = acceptor.root
    u, v = one_edit_pairs(
        acceptor, state[short], roots[short], state[both], roots[both], state[more], roots[more], m - cut, forced
    )
    u, v = order[u], order[v]
    if side == 1:  # those that also agree on the first half were met on side 0
        half = np.array([w[: m // 2] for w in words], dtype=f"S{m // 2}")
        other = half[u] != half[v]
        u, v = u[other], v[other]
    plain = np.array(words, dtype=f"S{m + 1}")
    best_first = np.lexsort((plain, -n))
    rank = np.empty(len(words), np.int64)
    rank[best_first] = np.arange(len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, u, rank[v])
    np.minimum.at(best, v, rank[u])
    near = np.bincount(u, minlength=len(words)) + np.bincount(v, minlength=len(words))
    held = np.flatnonzero(near)
    return held, near[held], best_first[best[held]]


def _near(batches, chunk_words: int) -> Iterator[pa.RecordBatch]:
    """Rows come with whole partitions side by side, ordered by what a chunk must agree on."""
    words: list[bytes] = []
    counts: list[int] = []
    shape, key = None, None

    def close():
        held, near, best = near_in_chunk(words, np.array(counts, np.int64), *shape)
        columns = [
            pa.array([words[i] for i in held], pa.binary()),
            pa.array(near, pa.int64()),
            pa.array([counts[i] for i in best], pa.int64()),
            pa.array([words[i] for i in best], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["word", "near", "best_n", "best"])

    for batch in batches:
        names = ("m", "side", "cut", "forced", "key", "word", "n")
        for m, side, cut, forced, k, word, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
            full = len(words) >= chunk_words or len(words) * (m + 1) >= CHUNK_CELLS
            if words and ((m, side, cut, forced) != shape or (full and k != key)):
                if len(words) > 1:
                    yield close()
                words, counts = [], []
            shape, key = (m, side, cut, forced), k
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        yield close()


def _near_words(words: DataFrame, workspace: Workspace, chunk_words: int, hot_words: int) -> DataFrame:
    """``word, n_near, best`` for every word that has a near one."""
    size = F.length("word")
    met = words.select(
        "word", "n", size.alias("size"),
        F.explode(F.when(size > LEAST_LENGTH, F.array(size, size - 1)).otherwise(F.array(size))).alias("m"),
    )
    met = met.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    half = F.expr("CASE WHEN side = 0 THEN m DIV 2 ELSE m - m DIV 2 END").cast("int")
    met = met.withColumn("cut", half)
    head = F.expr("CASE WHEN side = 0 THEN substring(word, 1, cut) ELSE substring(word, size - cut + 1, cut) END")
    total = words.count()
    slots = 1 << max(10, (32 * total // max(hot_words, 1)).bit_length())
    slot = F.pmod(F.xxhash64("m", "side", head), F.lit(slots)).alias("slot")
    # Words per hash slot first, which is a small table; partitions are then counted in the full slots only.
    met = met.withColumn("slot", slot)
    full = met.groupBy("slot").count().where(F.col("count") > hot_words).select("slot")
    full = workspace.save(full, "full")
    if full.head(1):
        inside = met.join(full, "slot").groupBy("m", "side", head.alias("head")).count()
        hot = workspace.save(inside.where(F.col("count") > hot_words).select("m", "side", "head", F.lit(True).alias("hot")), "hot")
        met = met.withColumn("head", head).join(hot, ["m", "side", "head"], "left")
        forced = F.coalesce(F.col("hot"), F.lit(False))
    else:
        forced = F.lit(False)
    places = F.when(forced, F.sequence("cut", "m")).otherwise(F.array("cut"))
    met = met.withColumn("forced", forced).withColumn("cut", F.explode(places))
    tail = F.expr(
        "CASE WHEN NOT forced OR m - cut - 1 <= 0 THEN X'' WHEN side = 0 "
        "THEN substring(word, size - (m - cut - 1) + 1, m - cut - 1) ELSE substring(word, 1, m - cut - 1) END"
    )
    met = met.withColumn("key", F.xxhash64(head, tail))  # orders rows; equal partitions are equal here
    shape = ["m", "side", "cut", "forced", "key"]
    dealt = met.select(*shape, "word", "n").repartition(*shape).sortWithinPartitions(*shape)
    near = map_arrow(dealt, partial(_near, chunk_words=chunk_words), "word binary, near long, best_n long, best binary")
    least = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best")))
    return near.groupBy("word").agg(F.sum("near").alias("n_near"), least.alias("least"))


def _roots(forms: DataFrame, workspace: Workspace) -> DataFrame:
    """``word, root`` by pointer jumping: a form is ten times as frequent, so a chain has at most 18 links."""
    known = workspace.save(forms.select("word", F.col("form").alias("root")), "root-0")
    turn = 0
    while True:
        turn += 1
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = known.join(onward, "root", "left")
        jumped = workspace.save(
            jumped.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            f"root-{turn}",
        )
        known = jumped.select("word", "root")
        if not jumped.where("moved").head(1):
            return known


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    workspace: Workspace | None = None,
    chunk_words: int = CHUNK_WORDS,
    hot_words: int = HOT_WORDS,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word of at least seven letters that occurs twice, how many
    words are one edit away, the most frequent of them (ties: the smallest) if it is ten times as frequent, and
    the end of the chain of forms.

    A missing text has no words and a missing id is written as nothing; repeated rows count each.  An empty
    table has no words.  Other columns are not read, so their names do not matter.  Words of any length are
    whole; a chunk of very long ones is small.
    """
    workspace = workspace or Workspace(docs.sparkSession, "variants")
    texts = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__text"))
    counted = map_arrow(texts, _count, "word binary, n long")
    words = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    words = workspace.save(words, "words")
    near = _near_words(words, workspace, chunk_words, hot_words)
    is_form = -F.col("least")["m"] >= FORM_TIMES * F.col("n")
    joined = workspace.save(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("least")["best"]).alias("form"), F.when(is_form, -F.col("least")["m"]).alias("form_n"),
        ),
        "near",
    )
    roots = _roots(joined.where(F.col("form").isNotNull()), workspace)
    text = lambda c: F.decode(c, "ISO-8859-1")
    return joined.join(roots, "word", "left").select(
        text(F.col("word")).alias("word"), text(F.col("form")).alias("form"),
        text(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n",
    )
