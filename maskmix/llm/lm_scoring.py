"""Scoring whole texts by a recurrent language model and by smoothed word counts.

Counts, the recurrent network and the scores see every text.  Words are counted by Spark.  The most
frequent ones (at most ``HEAD_WORDS``, since each is more than one in so many tokens) go to the tasks;
the others meet their counts in a join.  The training texts are dealt into units of about as many tokens
each, however the input is split; every unit trains a copy of the network, and the copies are averaged
by their tokens, a group at a time.  Every word has an output of the network, a leaf: the most frequent
ones each, all others that of their last two bytes, where a word has the share of its count.  The network
predicts the class of the next leaf and the leaf in its class.  Texts are turned into leaves once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from maskmix.functions.runtime import map_arrow
from maskmix.llm.common import regroup
from maskmix.llm.recurrent import Network, Trainer, Vocabulary, Weights, score
from maskmix.workspace import Workspace

SMOOTHING = 0.1
#: Words that tasks keep: those more frequent than one in this many tokens, hence at most as many.
HEAD_WORDS = 150_000
#: Words with a leaf of their own, endings with one, leaves that all rarer endings share.
OWN_WORDS = 1022
OWN_ENDINGS = 448
SHARED = 64
#: Bytes of an ending.
ENDING = 2
#: Classes of leaves, size of the state, rate of learning.
CLASSES = 32
HIDDEN = 16
RATE = 0.2
#: Tokens a task lays out in lanes at a time; a longer text is laid out alone.
LANE_TOKENS = 2_000_000
#: Tokens of a unit of training, which has a copy of the network of its own.
UNIT_TOKENS = 4_000_000
#: Copies that are added up at a time.
COPIES = 64
_DISTINCT = 400_000


def words_of(batch: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts one behind the other, and how many each text has."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found = cut.flatten()
    whole = pc.greater(pc.binary_length(found), 0)  # white space at either end of a text leaves an empty word there
    sizes = np.bincount(pc.list_parent_indices(cut).filter(whole), minlength=len(texts))
    return found.filter(whole).cast(pa.binary()), sizes


def _count(batches):
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        counts = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return counts.rename_columns(["word", "n"])

    for batch in regroup(batches, "text"):
        counts = words_of(batch, "text")[0].value_counts()
        held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
        if sum(h.num_rows for h in held) >= 2 * _DISTINCT:
            held = [merged()]
            if held[0].num_rows >= _DISTINCT:
                yield from held[0].to_batches()
                held = []
    if held:
        yield from merged().to_batches()


class _Leaves(dict):
    """Leaves by ending; endings without one of their own share some by their hash."""

    def __init__(self, own: dict[bytes, int], shared: list[int]):
        super().__init__(own)
        self.shared = shared

    def __missing__(self, ending: bytes) -> int:
        return self.shared[crc32(ending) % len(self.shared)]


@dataclass
class Lexicon:
    """Head words in falling order of their counts, the totals of the training texts, and the endings of all
    words with their tokens and kinds.  ``leaves`` is by number of a head word, ``by_ending`` for words without a
    leaf of their own; ``norms`` has the log10 of a leaf's mass: its tokens and kinds, and one kind for all words
    that training never met."""

    words: list[bytes]
    counts: np.ndarray
    texts: int
    tokens: int  # with one end per text
    distinct: int  # with the end
    endings: list[tuple[bytes, int, int]]
    leaves: np.ndarray = field(init=False)
    norms: np.ndarray = field(init=False)

    def __post_init__(self):
        self.own = min(OWN_WORDS, len(self.words))
        self.known_texts = self.texts > 0
        left = {e: [n, kinds] for e, n, kinds in self.endings}
        for word, n in zip(self.words[: self.own], self.counts.tolist()):
            left[word[-ENDING:]][0] -= n
            left[word[-ENDING:]][1] -= 1
        found = sorted((-n, e, kinds) for e, (n, kinds) in left.items() if kinds)
        rest = found[OWN_ENDINGS:]
        sums = np.zeros((min(len(found), OWN_ENDINGS) + (SHARED if rest else 1), 2))
        first = len(sums) - (SHARED if rest else 1)
        sums[:first] = [(-n, kinds) for n, _, kinds in found[:first]] if first else 0
        for n, ending, kinds in rest:
            sums[first + crc32(ending) % SHARED] += (-n, kinds)
        masses = sums[:, 0] + SMOOTHING * (sums[:, 1] + 1)
        counts = np.concatenate([self.counts[: self.own], masses])
        order = np.argsort(-counts, kind="stable")
        self.leaf_counts = counts[order]
        leaf = np.empty(len(order), np.int64)
        leaf[order] = np.arange(len(order))
        self.norms = np.zeros(len(order))
        self.norms[leaf[self.own :]] = np.log10(masses)
        own = {ending: int(leaf[self.own + k]) for k, (_, ending, _) in enumerate(found[:first])}
        self.by_ending = own, leaf[self.own + first :].tolist()
        others = _Leaves(*self.by_ending)
        self.leaves = np.array([*leaf[: self.own], *(others[w[-ENDING:]] for w in self.words[self.own :])], np.int16)
        self.end = len(order) + 1  # behind the place for words without a leaf, of which there are none

    def vocabulary(self) -> Vocabulary:
        return Vocabulary.build(self.leaf_counts, 0, self.texts + 1, CLASSES)

    def log_norm(self) -> float:
        return math.log10(self.tokens + SMOOTHING * (self.distinct + 1))

    def log_shares(self) -> np.ndarray:
        """Log10 share of every head word in its leaf."""
        shares = np.log10(self.counts + SMOOTHING) - self.norms[self.leaves]
        shares[: self.own] = 0.0
        return shares


_ENCODED = (
    "row long, __id {id}, held_out boolean, n_tokens long, head_known long, head_log double, share_log double, "
    "ids binary, rare array<binary>, times array<long>"
)


def _encode(batches, lexicon: Lexicon):
    """Leaves of every text, what its head words add to both scores, and its other words with their numbers."""
    heads, others = pa.array(lexicon.words, pa.binary()), _Leaves(*lexicon.by_ending)
    last = len(lexicon.words)  # the end; behind it, hence at -1, what words beyond the head add
    logs = np.append(np.log10(np.append(lexicon.counts, lexicon.texts) + SMOOTHING), 0.0)
    shares, norms = np.append(lexicon.log_shares(), [0.0, 0.0]), lexicon.norms
    leaves = np.append(lexicon.leaves, np.array([lexicon.end, 0], np.int16))
    for batch in regroup(batches, "text"):
        found, sizes = words_of(batch, "text")
        coded = found.dictionary_encode()
        kinds = coded.dictionary
        number = pc.fill_null(pc.index_in(kinds, value_set=heads), -1).to_numpy(zero_copy_only=False)
        number = np.append(number, last)
        beyond = number < 0
        leaf, share = leaves[number], shares[number]
        endings = pc.binary_slice(kinds.filter(pa.array(beyond[:-1])), -ENDING).dictionary_encode()
        leaf[beyond] = np.array([others[e] for e in endings.dictionary.to_pylist()], np.int16)[endings.indices.to_numpy()]
        share[beyond] = -norms[leaf[beyond]]
        stops = np.cumsum(sizes + 1)
        starts = stops - sizes - 1
        kind = np.full(stops[-1], len(kinds), np.int32)  # an end behind every text
        inside = np.ones(len(kind), bool)
        inside[stops - 1] = False
        kind[inside] = coded.indices.to_numpy()
        rare = np.flatnonzero(beyond[kind])
        pairs, times = np.unique(np.searchsorted(stops, rare, "right") * len(beyond) + kind[rare], return_counts=True)
        text, word = np.divmod(pairs, len(beyond))
        offsets = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32())
        ids = leaf[kind].tobytes()
        added = [
            pa.array(sizes + 1, pa.int64()),
            pa.array(np.add.reduceat((~beyond)[kind].astype(np.int64), starts) - 1 + int(lexicon.known_texts)),
            pa.array(np.add.reduceat(logs[number][kind], starts)),
            pa.array(np.add.reduceat(share[kind], starts)),
            pa.array([ids[2 * a : 2 * b] for a, b in zip(starts.tolist(), stops.tolist())], pa.binary()),
            pa.ListArray.from_arrays(offsets, kinds.take(pa.array(word))),
            pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
        ]
        keys = [batch.column(batch.schema.get_field_index(n)) for n in ("row", "__id", "held_out")]
        yield pa.RecordBatch.from_arrays(keys + added, names=[f.split()[0] for f in _ENCODED.split(", ")])


def _leaves_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(raw, np.int16) for raw in batch.column(batch.schema.get_field_index("ids")).to_pylist()]


def _train(batches, vocabulary: Vocabulary, end: int, start: np.ndarray):
    trainer = Trainer(Network(vocabulary, Weights.start(vocabulary, HIDDEN).filled(start)), RATE)
    held: list[np.ndarray] = []
    size = 0
    for batch in regroup(batches, "ids"):
        for ids in _leaves_of(batch):
            held.append(ids)
            size += len(ids)
            if size >= LANE_TOKENS:
                trainer.learn(held, end)
                held, size = [], 0
    if held:
        trainer.learn(held, end)
    if trainer.tokens:
        yield _weights_row(trainer.mean * trainer.tokens, trainer.tokens, trainer.loss)


def _weights_row(total: np.ndarray, tokens: int, loss: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([total.tobytes()], pa.binary()), pa.array([tokens], pa.int64()), pa.array([loss], pa.float64())],
        names=["total", "tokens", "loss"],
    )


def _sum_weights(batches):
    total, tokens, loss = None, 0, 0.0
    for batch in batches:
        for raw, n, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
            one = np.frombuffer(raw, np.float64)
            total = one.copy() if total is None else total + one
            tokens, loss = tokens + n, loss + part
    if total is not None:
        yield _weights_row(total, tokens, loss)


_WEIGHTS = "total binary, tokens long, loss double"


def train_network(texts: DataFrame, lexicon: Lexicon, workspace: Workspace) -> Weights:
    """One pass over the leaves ``ids`` of all texts, a copy per unit, averaged by tokens.  Texts go round the units, so
    that copies of one text or rows of one id do not meet in one, and are in the order of a hash there."""
    vocabulary = lexicon.vocabulary()
    begin = Weights.start(vocabulary, HIDDEN)
    step = partial(_train, vocabulary=vocabulary, end=lexicon.end, start=begin.flat())
    units = max(1, math.ceil(lexicon.tokens / UNIT_TOKENS))
    dealt = texts.select("ids").repartition(units).sortWithinPartitions(F.xxhash64("ids"), "ids")
    copies, level = workspace.save(map_arrow(dealt, step, _WEIGHTS), "copies"), units
    while level > COPIES:
        level = math.ceil(level / COPIES)
        copies = workspace.save(map_arrow(copies.repartition(level), _sum_weights, _WEIGHTS), f"copies-{level}")
    rows = map_arrow(copies.coalesce(1), _sum_weights, _WEIGHTS).collect()  # one row
    tokens = sum(r["tokens"] for r in rows)
    if not tokens:
        return begin
    return begin.filled(sum(np.frombuffer(r["total"], np.float64) for r in rows) / tokens)


_SCORED = "row long, __id {id}, held_out boolean, n_tokens long, head_known long, head_log double, share_log double, network double"


def _score(batches, vocabulary: Vocabulary, end: int, weights: np.ndarray):
    """The columns before ``ids`` and the network's log10 probability of them."""
    network = Network(vocabulary, Weights.start(vocabulary, HIDDEN).filled(weights))
    kept: list[pa.RecordBatch] = []
    texts: list[np.ndarray] = []
    size = 0

    def rows():
        table = pa.Table.from_batches(kept)
        natural = pa.array(score(network, texts, end) / math.log(10), pa.float64())
        return table.append_column("network", natural).combine_chunks().to_batches()

    for batch in regroup(batches, "ids"):
        found = _leaves_of(batch)
        kept.append(batch.select([n for n in batch.schema.names if n != "ids"]))
        texts += found
        size += sum(map(len, found))
        if size >= LANE_TOKENS:
            yield from rows()
            kept, texts, size = [], [], 0
    if texts:
        yield from rows()


def learn_lexicon(texts: DataFrame, workspace: Workspace) -> tuple[Lexicon, DataFrame]:
    """Counts of all words of all texts, and the head of them."""
    counted = map_arrow(texts.select("text"), _count, "word binary, n long")
    counts = workspace.save(counted.groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    documents = texts.count()
    tokens = (total["n"] or 0) + documents
    often = counts.where(F.col("n") * HEAD_WORDS > tokens).collect()  # fewer than HEAD_WORDS rows
    often.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    ending = F.expr(f"substring(word, greatest(1, length(word) - {ENDING - 1}), {ENDING})")
    endings = counts.groupBy(ending.alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # at most 256 + 65,536
    lexicon = Lexicon(
        [bytes(r["word"]) for r in often],
        np.array([r["n"] for r in often], np.int64),
        documents,
        tokens,
        total["v"] + int(documents > 0),
        sorted((bytes(r["e"]), r["n"], r["v"]) for r in endings),
    )
    return lexicon, counts


def score_texts(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", workspace: Workspace | None = None
) -> DataFrame:
    """One row per text: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` is the sum of log10((c + 0.1) / (N + 0.1 * (V + 1))) over the tokens, ``score`` the
    model's log10 probability of the text; an end follows every text.  Texts with ``held_out`` teach
    nothing.  A missing text is empty: its only token is the end.  Repeated rows are scored each.
    """
    workspace = workspace or Workspace(docs.sparkSession, "lm")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("__id"),
        held_out.alias("held_out"), F.col(text_col).alias("text"),
    )
    teach = rows.where(~F.col("held_out"))
    lexicon, counts = learn_lexicon(teach, workspace)
    id_type = docs.schema[id_col].dataType.simpleString()
    encoded = workspace.save(map_arrow(rows, partial(_encode, lexicon=lexicon), _ENCODED.format(id=id_type)), "encoded")
    weights = train_network(encoded.where(~F.col("held_out")), lexicon, workspace)
    step = partial(_score, vocabulary=lexicon.vocabulary(), end=lexicon.end, weights=weights.flat())
    stored = workspace.save(map_arrow(encoded.drop("rare", "times"), step, _SCORED.format(id=id_type)), "scored")
    rare = encoded.where(F.size("rare") > 0).select("row", F.inline(F.arrays_zip("rare", "times"))).toDF("row", "word", "times")
    tail = counts.where(F.col("n") * HEAD_WORDS <= lexicon.tokens)
    met = rare.join(tail.hint("shuffle_hash"), "word", "left")  # words meet a table of distinct words: no sort
    log_count = F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING) * F.col("times")
    looked_up = met.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"), F.sum(log_count).alias("rare_log")
    )
    none = F.lit(0)
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    base = F.col("head_log") + rare_log - F.col("n_tokens") * F.lit(lexicon.log_norm())
    model = F.col("network") + F.col("share_log") + rare_log
    return stored.join(looked_up, "row", "left").select(
        F.col("__id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", none)).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        model.alias("score"),
    )
