"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairs of features interact through low-rank factors; the sum over all pairs of a text is half of
(square of sums minus sum of squares) per factor, so a score takes time linear in the distinct words.
It is fitted in one task on a bounded sample of labelled rows and scores every text where it lies.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from maskmix.functions.runtime import map_arrow
from maskmix.llm.common import append, texts_of

#: Labelled rows the model is fitted on at most, the first in hash order of their ids.
SAMPLE_ROWS = 8_000
WORD_BITS = 14
FACTORS = 8

_CLEAN = re.compile(rb"[^a-z\x80-\xff]+")
_MARKS = b".,;:!?'\"()-"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_STATISTICS = 18


def statistics(text: str, data: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure of a text: sizes, shares of kinds of characters, repetition, lines."""
    n, m = max(1, len(data)), max(1, len(words))
    share = lambda kept: (n - len(data.translate(None, kept))) / n
    lines = [x for x in data.split(b"\n") if x]
    letters = share(_LETTERS)
    upper = share(bytes(range(65, 91)))
    white = share(b" \t\n\r\x0b\x0c")
    digits = share(b"0123456789")
    marks = share(_MARKS)
    same_as_before = sum(map(bytes.__eq__, words, words[1:])) / m
    ends = sum(x[-1:] in b".!?" for x in lines) / max(1, len(lines))
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        min(20.0, len(data) / m),
        upper / max(letters, 1e-9),
        letters,
        white,
        digits,
        marks,
        1 - letters - white - digits - marks,
        share(b"!"),
        share(b"|#$%&*"),
        len(counts) / m,
        max(counts.values(), default=0) / m,
        same_as_before,
        np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        ends,
        np.log1p(m / max(1, len(lines))),
    ]


class Features:
    """Word buckets with weights and statistics of texts; word numbers are kept per worker."""

    def __init__(self, bits: int = WORD_BITS):
        self.bits, self.known = bits, {}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.lower().split()
        counts = Counter(words)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        mask = (1 << self.bits) - 1
        buckets = []
        for w in counts:
            b = known.get(w)
            if b is None:
                b = known[w] = xxhash.xxh32_intdigest(_CLEAN.sub(b"", w) or w) & mask
            buckets.append(b)
        tf = np.bincount(np.array(buckets, np.int64), np.fromiter(counts.values(), np.float64, len(counts)), 1 << self.bits)
        index = np.flatnonzero(tf)
        value = np.log1p(tf[index])
        value /= np.sqrt((value * value).sum()) or 1.0
        return index, value, statistics(text or "", data, words, counts)


@dataclass
class Machine:
    """Weights ``w``, factors ``v`` (feature by factor) and the scale of the dense features."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bits: int

    def dense(self, values: np.ndarray) -> np.ndarray:
        return np.clip((np.nan_to_num(values) - self.mean) / self.scale, -4, 4) / np.sqrt(len(self.mean))

    def raw(self, index: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Score before the logistic function, and the factor sums, per row."""
        part = self.v[index] * value[:, None]
        sums = np.zeros((rows, self.v.shape[1]))
        squares = np.zeros(rows)
        np.add.at(sums, row, part)
        np.add.at(squares, row, (part * part).sum(axis=1))
        linear = np.bincount(row, self.w[index] * value, rows)
        return self.w0 + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def pack(self) -> bytes:
        import io

        out = io.BytesIO()
        np.savez(out, w0=self.w0, w=self.w, v=self.v, mean=self.mean, scale=self.scale, bits=self.bits)
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Machine:
        import io

        z = np.load(io.BytesIO(data))
        return Machine(float(z["w0"]), z["w"], z["v"], z["mean"], z["scale"], int(z["bits"]))


def _rows(machine: Machine, index: list[np.ndarray], value: list[np.ndarray], dense: np.ndarray):
    """Sparse entries of a batch: word buckets, then the scaled dense features behind them."""
    d = machine.dense(dense)
    row = np.repeat(np.arange(len(index)), [len(i) for i in index])
    at = np.tile(np.arange(d.shape[1]) + (1 << machine.bits), len(index))
    return (
        np.concatenate([*index, at]).astype(np.int64),
        np.concatenate([*value, d.reshape(-1)]),
        np.concatenate([row, np.repeat(np.arange(len(index)), d.shape[1])]),
    )


def fit(index, value, dense: np.ndarray, label: np.ndarray, bits: int, factors=FACTORS, epochs=12, seed=7) -> Machine:
    """AdaGrad on the logistic loss, both classes weighted alike up to a factor of four."""
    rng = np.random.default_rng(seed)
    size = (1 << bits) + dense.shape[1]
    scale = dense.std(axis=0)
    model = Machine(
        0.0, np.zeros(size), rng.normal(0, 0.05, (size, factors)), dense.mean(axis=0), np.where(scale > 0, scale, 1.0), bits
    )
    positive = max(1, int(label.sum()))
    weight = np.where(label == 1, 1.0, np.clip(positive / max(1, len(label) - positive), 1, 4))
    g0, gw, gv = 1e-2, np.full(size, 1e-2), np.full((size, factors), 1e-2)
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            i, x, r = _rows(model, [index[s] for s in some], [value[s] for s in some], dense[some])
            raw, sums = model.raw(i, x, r, len(some))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[some]) * weight[some] / len(some)
            used, place = np.unique(i, return_inverse=True)
            e = error[r]
            dw = np.bincount(place, e * x) + 1e-6 * model.w[used]
            local = (e * x)[:, None] * (sums[r] - model.v[i] * x[:, None])
            dv = np.zeros((len(used), factors))
            np.add.at(dv, place, local)
            dv += 1e-6 * model.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += error.sum() ** 2
            model.w[used] -= 0.3 * dw / np.sqrt(gw[used])
            model.v[used] -= 0.1 * dv / np.sqrt(gv[used])
            model.w0 -= 0.3 * error.sum() / np.sqrt(g0)
    return model


_ROW_COLUMNS = "bucket array<int>, value array<double>, dense array<double>"


def _metadata(batch: pa.RecordBatch, names: list[str]) -> list[list[float]]:
    columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
    return [[np.log1p(max(0.0, float(v))) if v is not None else 0.0 for v in row] for row in zip(*columns)]


def _features(text: str, metadata: list[str], bits: int):
    made = Features(bits)

    def run(batch: pa.RecordBatch):
        rows = [made.of(t) for t in texts_of(batch, text)]
        extra = _metadata(batch, metadata) if metadata else [[] for _ in rows]
        kinds = (pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))
        cells = ([i.tolist() for i, _, _ in rows], [v.tolist() for _, v, _ in rows], [s + e for (_, _, s), e in zip(rows, extra)])
        return [pa.array(c, k) for c, k in zip(cells, kinds)]

    return run


def _fit_rows(batches, bits: int):
    """Rows are put in hash order of their ids, so that the same sample gives the same model."""
    group = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if group is None:
        return
    group = group.sort_by("__order")
    index = [np.array(i, np.int64) for i in group.column("bucket").to_pylist()]
    value = [np.array(v) for v in group.column("value").to_pylist()]
    dense = np.array(group.column("dense").to_pylist(), dtype=np.float64)
    label = group.column("__label").to_numpy().astype(np.int64)
    machine = fit(index, value, dense, label, bits)
    yield pa.RecordBatch.from_arrays([pa.array([machine.pack()], pa.binary())], names=["model"])


def train(
    labelled: DataFrame, text_col: str, label_col: str, order_col: str, metadata: list[str], bits: int = WORD_BITS
) -> Machine | None:
    """A machine fitted on ``labelled``, which holds at most a bounded sample; None without rows."""
    kept = labelled.select(
        F.col(text_col).alias("__text"), F.col(label_col).cast("int").alias("__label"),
        F.col(order_col).alias("__order"), *[F.col(m) for m in metadata],
    )
    added = [tuple(c.split(" ")) for c in _ROW_COLUMNS.split(", ")]
    rows = append(kept, "__text", added, partial(_features, "__text", metadata, bits)).drop("__text", *metadata)
    fitted = map_arrow(rows.repartition(1), partial(_fit_rows, bits=bits), "model binary").collect()
    return Machine.unpack(fitted[0]["model"]) if fitted else None


def _score(machine: Machine | None, text: str, metadata: list[str]):
    made = Features(machine.bits if machine else WORD_BITS)

    def run(batch: pa.RecordBatch):
        if machine is None:
            return [pa.array([0.5] * batch.num_rows, pa.float64())]
        rows = [made.of(t) for t in texts_of(batch, text)]
        extra = _metadata(batch, metadata) if metadata else [[] for _ in rows]
        dense = np.array([s + e for (_, _, s), e in zip(rows, extra)], dtype=np.float64)
        i, x, r = _rows(machine, [i for i, _, _ in rows], [v for _, v, _ in rows], dense)
        raw, _ = machine.raw(i, x, r, len(rows))
        return [pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))), pa.float64())]

    return run


def with_quality(docs: DataFrame, machine: Machine | None, text_col: str, metadata: list[str], name: str) -> DataFrame:
    """``docs`` with a score from 0 to 1; an empty or missing text is scored by its statistics, and
    every text gets 0.5 where no label was there to learn from."""
    return append(docs, text_col, [(name, "double")], partial(_score, machine, text_col, metadata))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Documents of the first ``rows`` labelled ids in hash order, with ``__label`` and ``__order``.

    Ids with labels that contradict each other, and missing labels, teach nothing."""
    order = F.xxhash64(id_col)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(id_col).agg(F.min(label_col).alias("__label"), F.max(label_col).alias("__high"))
    known = known.where("__label = __high").select(id_col, "__label", order.alias("__order"))
    chosen = known.orderBy("__order", id_col).limit(rows)
    return docs.join(F.broadcast(chosen), id_col)
