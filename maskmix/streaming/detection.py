"""Spike detection on a stream: filter and crossings go on from one micro-batch to the next.

Samples of one group of connected channels (a shank of one recording) meet in one task.  Its state is the
filter's, the samples that the watermark has not passed yet, the crossings that a coming one can still touch,
and sums of the components that are open.  So it is bounded by the lateness, the size of a micro-batch and the
number of channels, however long a component or a recording becomes.  Samples are used in their order once the
watermark has passed them; the result depends neither on the trigger nor on restarts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskmix.detection.config import DetectionConfig
from maskmix.detection.probe import neighbour_pairs
from maskmix.detection.traces import band_pass_coefficients, filter_from
from maskmix.functions.runtime import ship_package

#: Samples that wait for the watermark.
WAITING = np.dtype([("ms", "i8"), ("sample", "i8"), ("channel", "i4"), ("v", "f8")])
#: Crossings that a coming one can touch, with the place of their component among the open ones.
EDGE = np.dtype([("sample", "i8"), ("channel", "i4"), ("place", "i8")])
#: Sums of an open component; ``first`` is its smallest node, ``top`` and ``channel`` its highest crossing.
OPEN = np.dtype(
    [("first", "i8"), ("last", "i8"), ("strong", "i8"), ("weight", "f8"), ("moment", "f8"), ("top", "f8"),
     ("channel", "i4"), ("n", "i8")]
)

STATE = "filter binary, waiting binary, edge binary, open binary"
FOUND = "kind string, sample long, channel int, v double, height double, strong int, component long, n long"


@dataclass(frozen=True)
class Probe:
    """What every task needs: coefficients, thresholds per channel, and each channel's reach padded by -1."""

    b: np.ndarray
    a: np.ndarray
    weak: np.ndarray
    strong: np.ndarray
    reach: np.ndarray
    sign: int
    power: int
    join_size: int

    @property
    def channels(self) -> int:
        return len(self.weak)


def probe_of(edges: DataFrame, limits: DataFrame, config: DetectionConfig, rate: float, channels: int) -> Probe:
    """``edges`` and ``limits`` are as large as the probe, which ``channels`` bounds."""
    reach: list[list[int]] = [[c] for c in range(channels)]
    for src, dst in neighbour_pairs(edges).where(F.col("src").between(0, channels - 1) & F.col("dst").between(0, channels - 1)).collect():
        reach[src].append(dst)
    width = max(map(len, reach))
    b, a = band_pass_coefficients(config.filter_low, config.filter_high_factor * rate, config.filter_butter_order, rate)
    weak, strong = np.full(channels, np.inf), np.full(channels, np.inf)
    for row in limits.limit(channels).collect():
        at = slice(None) if config.use_single_threshold else row["channel"]
        weak[at], strong[at] = row["weak"], row["strong"]
    padded = np.array([r + [-1] * (width - len(r)) for r in reach], np.int64)
    return Probe(b, a, weak, strong, padded, config.detect_spikes_symbol, config.weight_power, config.connected_component_join_size)


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place in the component of every place."""
    parent = np.arange(size)
    while True:
        one, two = parent[a], parent[b]
        apart = one != two
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _touching(sample: np.ndarray, channel: np.ndarray, probe: Probe) -> tuple[np.ndarray, np.ndarray]:
    """Places of crossings close in time on the same or on neighbouring channels."""
    code = sample * probe.channels + channel
    order = np.argsort(code, kind="stable")
    held, found = code[order], []
    for step in range(probe.join_size + 1):
        for other in probe.reach[channel].T:
            wanted = (sample + step) * probe.channels + other
            at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
            met = np.flatnonzero((held[at] == wanted) & (other >= 0))
            found.append((met, order[at[met]]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _merge(parts: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``parts`` by ``root``, and the new place of every part."""
    _, place = np.unique(root, return_inverse=True)
    size = int(place.max(initial=-1)) + 1
    out = np.zeros(size, OPEN)
    out["first"], out["last"], out["top"] = np.iinfo(np.int64).max, -1, -np.inf
    np.minimum.at(out["first"], place, parts["first"])
    for field in ("last", "strong"):
        np.maximum.at(out[field], place, parts[field])
    for field in ("weight", "moment", "n"):
        np.add.at(out[field], place, parts[field])
    order = np.lexsort((-parts["channel"], parts["top"], place))  # the last of a place is its highest, smallest channel
    ends = np.flatnonzero(np.diff(place[order], append=size))
    out["top"], out["channel"] = parts["top"][order][ends], parts["channel"][order][ends]
    return out, place


def _advance(ready: np.ndarray, kept: tuple, probe: Probe) -> tuple[list[pd.DataFrame], tuple]:
    """Filter ``ready`` samples, find their crossings, and close the components they leave behind."""
    state, edge, opened = kept
    samples, at = np.unique(ready["sample"], return_inverse=True)
    grid = np.zeros((len(samples), probe.channels))
    grid[at, ready["channel"]] = ready["v"]
    filtered, state = filter_from(grid, probe.b, probe.a, state)
    v, channel, sample = filtered[at, ready["channel"]], ready["channel"].astype(np.int64), ready["sample"]
    height = np.abs(v) if probe.sign == 0 else probe.sign * v
    hit = height > probe.weak[channel]
    v, channel, sample, height = v[hit], channel[hit], sample[hit], height[hit]
    strong = (height > probe.strong[channel]).astype(np.int64)
    new = np.zeros(len(sample), OPEN)
    new["first"], new["last"], new["strong"], new["n"] = sample * probe.channels + channel, sample, strong, 1
    new["weight"] = height**probe.power
    new["moment"], new["top"], new["channel"] = new["weight"] * sample, height, channel
    out = [pd.DataFrame({"kind": "crossing", "sample": sample, "channel": channel, "v": v, "height": height, "strong": strong})]
    parts = np.concatenate([opened, new])
    if len(parts):
        places = np.concatenate([edge["place"], len(opened) + np.arange(len(new))])
        when, where = np.concatenate([edge["sample"], sample]), np.concatenate([edge["channel"].astype(np.int64), channel])
        a, b = _touching(when, where, probe) if len(when) else (np.zeros(0, np.int64),) * 2
        merged, place = _merge(parts, _roots(len(parts), places[a], places[b]))
        still = merged["last"] + probe.join_size > samples[-1]
        spikes = merged[~still & (merged["strong"] > 0)]
        centre = np.floor(spikes["moment"] / spikes["weight"] + 0.5).astype(np.int64)
        out.append(
            pd.DataFrame({"kind": "spike", "sample": centre, "channel": spikes["channel"], "height": spikes["top"],
                          "strong": spikes["strong"], "component": spikes["first"], "n": spikes["n"]})
        )
        reachable = when + probe.join_size > samples[-1]
        edge = np.zeros(int(reachable.sum()), EDGE)
        edge["sample"], edge["channel"] = when[reachable], where[reachable]
        edge["place"] = (np.cumsum(still) - 1)[place[places[reachable]]]
        opened = merged[still]
    return out, (state, edge, opened)


def _found(rows: pd.DataFrame, key: tuple, names: list[str]) -> pd.DataFrame:
    full = rows.reindex(columns=[f.split()[0] for f in FOUND.split(", ")])
    for column, kind in (("sample", "int64"), ("channel", "int32"), ("strong", "int32"), ("component", "Int64"), ("n", "Int64")):
        full[column] = full[column].astype(kind)
    for at, (name, value) in enumerate(zip(names, key)):
        full.insert(at, name, [value] * len(full))
    return full


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, probe: Probe, names: list[str]) -> Iterator[pd.DataFrame]:
    order = len(probe.b) - 1
    if state.exists:
        raw = state.get
        kept = (
            np.frombuffer(raw[0], np.float64).reshape(order, probe.channels),
            np.frombuffer(raw[2], EDGE),
            np.frombuffer(raw[3], OPEN),
        )
        waiting = [np.frombuffer(raw[1], WAITING)]
    else:
        kept = (np.zeros((order, probe.channels)), np.zeros(0, EDGE), np.zeros(0, OPEN))
        waiting = [np.zeros(0, WAITING)]
    for rows in batches:
        more = np.zeros(len(rows), WAITING)
        for field in WAITING.names:
            more[field] = rows[field].to_numpy()
        waiting.append(more)
    rows = np.concatenate(waiting)
    passed = state.getCurrentWatermarkMs()
    ready, rows = rows[rows["ms"] < passed], rows[rows["ms"] >= passed]
    if len(ready):
        found, kept = _advance(ready, kept, probe)
        for some in found:
            if len(some):
                yield _found(some, key, names)
    state.update((kept[0].tobytes(), rows.tobytes(), kept[1].tobytes(), kept[2].tobytes()))
    if len(rows):
        state.setTimeoutTimestamp(max(int(rows["ms"].min()), passed + 1))


def detect_stream(
    stream: DataFrame, keys: list[str], edges: DataFrame, limits: DataFrame, config: DetectionConfig, rate: float,
    channels: int, lateness: str,
) -> DataFrame:
    """Crossings and spikes of a stream of ``keys, ts, sample, channel, v``, with ``kind`` telling which a row is.

    ``keys`` name what is filtered and joined on its own, say a recording and a shank; ``ts`` grows with
    ``sample`` from after the epoch on, and a sample that comes more than ``lateness`` behind the latest is left out.  ``limits`` are
    fixed thresholds, as :func:`maskmix.detection.traces.thresholds` gives.  A crossing appears once the watermark
    has passed its sample, a spike (component with a strong crossing: centre in time, highest channel, smallest
    node ``sample * channels + channel``, size) once no later sample can join it.  Rows without a sample, a time, a
    value or a channel of the probe are left out; of a sample that comes twice one row's value counts."""
    ship_package(stream.sparkSession)
    probe = probe_of(edges, limits, config, rate, channels)
    sound = F.col("channel").between(0, channels - 1) & F.col("sample").isNotNull() & F.col("v").isNotNull()
    rows = stream.where(sound & F.col("ts").isNotNull()).withWatermark("ts", lateness)
    rows = rows.select(*keys, "ts", F.unix_millis("ts").alias("ms"), F.col("sample").cast("long").alias("sample"),
                       F.col("channel").cast("int").alias("channel"), F.col("v").cast("double").alias("v"))
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    step = partial(_step, probe=probe, names=keys)
    return rows.groupBy(*keys).applyInPandasWithState(
        step, f"{kinds}, {FOUND}", STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
