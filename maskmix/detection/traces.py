"""From voltage traces ``(sample, channel, v)`` to spikes, waveforms and features.

The published program declares the parameters of these steps without their bodies; the steps follow
the public description of masked spike detection.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskmix.detection.config import DetectionConfig
from maskmix.detection.probe import neighbour_pairs
from maskmix.functions.arrays import double, portable_hash
from maskmix.functions.runtime import apply_arrow, map_arrow
from maskmix.sources.rows import join_small
from maskmix.operators.components import component_roots
from maskmix.workspace import Workspace


def chunk_rows(traces: DataFrame, config: DetectionConfig, rate: float) -> DataFrame:
    """Each row with every chunk that holds it; ``keep`` marks the one chunk that owns the row."""
    size, overlap = config.chunk_samples(rate)
    step = size - overlap
    last = F.floor(F.col("sample") / step)
    first = F.greatest(F.lit(0), F.floor((F.col("sample") - size) / step) + 1)
    owner = F.greatest(F.lit(0), F.floor((F.col("sample") - overlap // 2) / step))
    rows = traces.select("*", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("chunk"))
    return rows.withColumn("keep", F.when(F.col("chunk") == owner, 1).otherwise(0))


def band_pass_coefficients(low: float, high: float, order: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth band-pass of ``2 * order`` poles."""
    warped = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    width, centre2 = warped[1] - warped[0], warped[0] * warped[1]
    angles = np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)
    half = np.exp(1j * angles) * width / 2
    root = np.sqrt(half**2 - centre2)
    analog = np.concatenate([half + root, half - root])
    poles = (2 * rate + analog) / (2 * rate - analog)
    zeros = np.concatenate([np.ones(order), -np.ones(order)])
    gain = np.real((2 * rate * width) ** order / np.prod(2 * rate - analog))
    return gain * np.real(np.poly(zeros)), np.real(np.poly(poles))


FILTER_BLOCK = 64


def filter_columns(values: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The recursion down the rows from rest, all columns at once."""
    return filter_from(values, b, a, np.zeros((len(b) - 1, values.shape[1])))[0]


def filter_from(values: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The recursion down the rows from ``state`` (order by columns), a block of rows per product, and the state after it.

    In state form a block's output is its impulse responses times the block plus what the state at its
    begin still gives, so two products per block replace one step per row.
    """
    order = len(b) - 1
    step = np.zeros((order, order))
    step[:-1, 1:] = np.eye(order - 1)
    step[:, 0] -= a[1:]
    enter = b[1:] - a[1:] * b[0]
    powers = [np.eye(order)]
    for _ in range(FILTER_BLOCK):
        powers.append(powers[-1] @ step)
    response = np.array([b[0], *[(powers[k] @ enter)[0] for k in range(FILTER_BLOCK - 1)]])
    lag = np.arange(FILTER_BLOCK)[:, None] - np.arange(FILTER_BLOCK)
    through = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    left = np.array([powers[k][0] for k in range(FILTER_BLOCK)])  # output from the state at the begin
    into = np.array([powers[k] @ enter for k in range(FILTER_BLOCK)])
    out = np.empty_like(values)
    for at in range(0, len(values), FILTER_BLOCK):
        part = values[at : at + FILTER_BLOCK]
        n = len(part)
        out[at : at + n] = through[:n, :n] @ part + left[:n] @ state
        state = powers[n] @ state + into[:n][::-1].T @ part
    return out, state


def settling_samples(a: np.ndarray) -> int:
    """Rows after which a state has decayed below double precision, from the slowest pole."""
    slowest = np.abs(np.roots(a)).max()
    if slowest >= 1:
        raise ValueError("the filter is not stable")
    return int(np.ceil(np.log(1e-18) / np.log(slowest))) + len(a)


def band_pass(traces: DataFrame, config: DetectionConfig, rate: float) -> DataFrame:
    """Filtered traces, the same for every chunk length.

    A group is one chunk of all channels with as many samples before it as the filter needs to forget
    where it began; its size is fixed by the parameters."""
    b, a = band_pass_coefficients(
        config.filter_low, config.filter_high_factor * rate, config.filter_butter_order, rate
    )
    size, before = config.chunk_samples(rate)[0], settling_samples(a)

    def run(table: pa.Table) -> pa.Table:
        sample, channel = table.column("sample").to_numpy(), table.column("channel").to_numpy()
        samples, at = np.unique(sample, return_inverse=True)
        channels, col = np.unique(channel, return_inverse=True)
        grid = np.zeros((len(samples), len(channels)))
        grid[at, col] = table.column("v").to_numpy()
        kept = table.column("keep").to_numpy() == 1
        filtered = filter_columns(grid, b, a)[at, col]
        return pa.table({"sample": sample[kept], "channel": channel[kept], "v": filtered[kept]})

    own = F.floor(F.col("sample") / size)
    chunks = F.sequence(own.cast("long"), F.floor((F.col("sample") + before) / size).cast("long"))
    rows = traces.select("sample", "channel", "v", F.explode(chunks).alias("chunk"))
    rows = rows.withColumn("keep", F.when(F.col("chunk") == own, 1).otherwise(0))
    return apply_arrow(rows, ["chunk"], run, "sample BIGINT, channel INT, v DOUBLE")


def thresholds(filtered: DataFrame, config: DetectionConfig, rate: float, excerpts: bool = False) -> DataFrame:
    """Weak and strong threshold, one row in all or one per channel.

    All samples count; with ``excerpts`` only those of ``n_excerpts`` seeded excerpts do."""
    sampled = filtered
    if excerpts:
        length = max(1, round(config.excerpt_size_seconds * rate))
        rows = filtered.withColumn("excerpt", F.floor(F.col("sample") / length))
        chosen = rows.select("excerpt").distinct()
        chosen = chosen.orderBy(portable_hash(F.col("excerpt"), config.random_seed), "excerpt").limit(config.n_excerpts)
        sampled = rows.join(F.broadcast(chosen), "excerpt", "left_semi")
    keys = [] if config.use_single_threshold else ["channel"]
    spread = F.stddev_pop("v")
    return sampled.groupBy(*keys).agg(
        (spread * config.threshold_weak_std_factor).alias("weak"),
        (spread * config.threshold_strong_std_factor).alias("strong"),
    )


def crossings(filtered: DataFrame, limits: DataFrame, config: DetectionConfig) -> DataFrame:
    """Rows past the weak threshold, with ``strong`` = 1 past the strong one and the signed height."""
    v = F.col("v")
    height = {1: v, 0: F.abs(v), -1: -v}[config.detect_spikes_symbol]
    if config.use_single_threshold:
        row = limits.first()
        joined = filtered.withColumn("weak", double(row["weak"])).withColumn("strong_limit", double(row["strong"]))
    else:
        joined = join_small(filtered, limits.withColumnRenamed("strong", "strong_limit"), "channel")
    out = joined.withColumn("height", height).where(F.col("height") > F.col("weak"))
    strong = F.when(F.col("height") > F.col("strong_limit"), 1).otherwise(0)
    return out.select("sample", "channel", "v", "height", strong.alias("strong"))


def crossing_edges(nodes: DataFrame, edges: DataFrame, join_size: int) -> DataFrame:
    """Pairs of crossings close in time on the same or on neighbouring channels.

    A node only looks up its possible neighbours by equality, so the work per node is bounded by the
    probe's degree and the join size.
    """
    pairs = neighbour_pairs(edges)
    same = nodes.select("channel").distinct().select(F.col("channel").alias("src"), F.col("channel").alias("dst"))
    reach = pairs.union(same).select(F.col("src").alias("channel"), F.col("dst").alias("other"))
    steps = F.explode(F.array(*[F.lit(s) for s in range(join_size + 1)]))
    wanted = join_small(nodes.select("node", "sample", "channel"), reach, "channel").select(
        F.col("node").alias("a"), F.col("sample"), F.col("other"), steps.alias("step")
    )
    wanted = wanted.select("a", (F.col("sample") + F.col("step")).alias("sample"), F.col("other").alias("channel"))
    found = wanted.join(nodes.select(F.col("node").alias("b"), "sample", "channel"), ["sample", "channel"])
    return found.where("a <> b").select("a", "b").union(
        found.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))
    ).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, workspace: Workspace) -> DataFrame:
    """``(node, component)`` with the smallest node id as component; joined by node, never by component."""
    found = component_roots(edges, workspace)
    return nodes.select("node").join(found, "node", "left").select(
        "node", F.coalesce("component", F.col("node")).alias("component")
    )


def label_crossings(weak: DataFrame, edges: DataFrame, config: DetectionConfig, channels: int, workspace: Workspace) -> DataFrame:
    """Crossings with the component they belong to."""
    nodes = weak.withColumn("node", F.col("sample") * channels + F.col("channel"))
    nodes = workspace.save(nodes, "nodes")
    links = crossing_edges(nodes, edges, config.connected_component_join_size)
    return nodes.join(connected_components(nodes, links, workspace), "node")


def spikes(labelled: DataFrame, config: DetectionConfig) -> DataFrame:
    """One row per component with a strong crossing: weighted centre in time and highest channel."""
    weight = F.pow("height", F.lit(config.weight_power))
    rows = labelled.groupBy("component").agg(
        F.max("strong").alias("strong"),
        F.round(F.sum(weight * F.col("sample")) / F.sum(weight)).cast("long").alias("sample"),
        F.max_by("channel", F.struct("height", -F.col("channel"))).alias("channel"),
        F.count("*").alias("n"),
    )
    return rows.where("strong = 1").drop("strong")


def snippets(filtered: DataFrame, found: DataFrame, config: DetectionConfig) -> DataFrame:
    """Waveforms around each spike on its channel, by equality on (sample, channel)."""
    offsets = F.sequence(F.lit(-config.extract_s_before), F.lit(config.extract_s_after - 1))
    wanted = found.select("component", "channel", "sample", F.explode(offsets).alias("offset")).select(
        "component", "channel", "offset", (F.col("sample") + F.col("offset")).alias("sample")
    )
    return wanted.join(filtered, ["sample", "channel"]).select("component", "channel", "offset", "v")


def waveforms(pieces: DataFrame, config: DetectionConfig) -> DataFrame:
    """One array per spike; an array has at most before + after values.

    Where samples are missing, at either end of the trace or in a gap, the value of the nearest sample before
    counts, or of the first one there is.  A spike without a single sample is not among the pieces."""
    length = config.extract_s_before + config.extract_s_after
    rows = pieces.groupBy("component", "channel").agg(
        F.sort_array(F.collect_list(F.struct("offset", "v"))).alias("parts")
    )
    offsets = F.sequence(F.lit(-config.extract_s_before), F.lit(config.extract_s_after - 1))
    first = F.get("parts", F.lit(0))["v"]
    held = lambda o: F.try_element_at(F.filter("parts", lambda p: p["offset"] <= o), F.lit(-1))["v"]
    reached = lambda o: F.get("parts", F.lit(0))["offset"] <= o
    padded = F.transform(offsets, lambda o: F.when(reached(o), held(o)).otherwise(first))
    wave = F.when(F.size("parts") == length, F.transform("parts", lambda p: p["v"])).otherwise(padded)
    return rows.select("component", "channel", wave.alias("wave"))


def principal_axes(waves: DataFrame, config: DetectionConfig) -> DataFrame:
    """Leading axes per channel from all waveforms of the channel.

    Sums and products are added up per task and then by Spark; a group holds one small matrix.
    """
    length = config.extract_s_before + config.extract_s_after

    def partial(batches):
        sums = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            channel = batch.column("channel").to_numpy()
            wave = batch.column("wave").flatten().to_numpy().reshape(len(channel), length)
            extended = np.concatenate([np.ones((len(channel), 1)), wave], axis=1)
            for c in np.unique(channel).tolist():
                part = extended[channel == c]
                sums[c] = sums.get(c, 0.0) + part.T @ part
        a, b = np.triu_indices(length + 1)
        for c, gram in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), c, dtype=np.int32)), pa.array(a.astype(np.int32)),
                 pa.array(b.astype(np.int32)), pa.array(gram[a, b])],
                names=["channel", "i", "j", "v"],
            )

    cells = map_arrow(waves.select("channel", "wave"), partial, "channel INT, i INT, j INT, v DOUBLE")
    cells = cells.groupBy("channel", "i", "j").agg(F.sum("v").alias("v"))
    keep = config.n_features_per_channel

    def axes(table: pa.Table) -> pa.Table:
        i, j, v = (table.column(c).to_numpy() for c in ("i", "j", "v"))
        gram = np.zeros((length + 1, length + 1))
        gram[i, j] = v
        gram[j, i] = v
        n = gram[0, 0]
        mean = gram[0, 1:] / n
        _, vectors = np.linalg.eigh(gram[1:, 1:] / n - np.outer(mean, mean))
        top = vectors[:, ::-1][:, :keep].T
        signs = np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])
        return pa.table(
            {
                "channel": pa.array([table.column("channel")[0].as_py()], pa.int32()),
                "centre": pa.array([mean.tolist()], pa.list_(pa.float64())),
                "axes": pa.array([(top * signs[:, None]).ravel().tolist()], pa.list_(pa.float64())),
            }
        )

    return apply_arrow(cells, ["channel"], axes, "channel INT, centre ARRAY<DOUBLE>, axes ARRAY<DOUBLE>")


def waveform_features(waves: DataFrame, axes: DataFrame, config: DetectionConfig) -> DataFrame:
    """Projection of every waveform on its channel's axes."""
    length = config.extract_s_before + config.extract_s_after
    joined = join_small(waves, axes, "channel")
    centred = F.zip_with("wave", "centre", lambda w, m: w - m)

    def project(k: int):
        axis = F.slice("axes", k * length + 1, length)
        return F.aggregate(F.zip_with(centred, axis, lambda w, a: w * a), double(0), lambda s, v: s + v)

    features = F.array(*[project(k) for k in range(config.n_features_per_channel)])
    return joined.select("component", "channel", features.alias("features"))


def detect(traces: DataFrame, edges: DataFrame, config: DetectionConfig, rate: float, channels: int, workspace: Workspace):
    """Filter, thresholds and crossings in one go: the declared entry of the detection program."""
    filtered = workspace.save(band_pass(traces, config, rate), "filtered")
    weak = crossings(filtered, thresholds(filtered, config, rate), config)
    return filtered, label_crossings(weak, edges, config, channels, workspace)
