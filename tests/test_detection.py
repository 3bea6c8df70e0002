import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmix.detection import traces as T
from maskmix.detection.config import DetectionConfig
from maskmix.detection.probe import adjacency_list, drop_dead_channels
from maskmix.workspace import Workspace


def frame(spark, grid, parts=3):
    rows = [(s, c, float(grid[s, c])) for s in range(grid.shape[0]) for c in range(grid.shape[1])]
    return spark.createDataFrame(rows, "sample long, channel int, v double").repartition(parts)


def line_of(spark, channels):
    return spark.createDataFrame([(c, c + 1) for c in range(channels - 1)], "src int, dst int")


def test_band_pass_keeps_the_band_and_drops_the_rest(spark):
    rate, n = 20000.0, 6000
    t = np.arange(n) / rate
    grid = np.stack([np.sin(2 * np.pi * 2000 * t), np.sin(2 * np.pi * 20 * t)], axis=1)
    config = DetectionConfig(chunk_size_seconds=0.1)
    out = T.band_pass(frame(spark, grid), config, rate).toPandas()
    assert len(out) == 2 * n and not out.duplicated(["sample", "channel"]).any()
    wide = out.pivot(index="sample", columns="channel", values="v").to_numpy()[500:]
    assert np.abs(wide[:, 0]).max() == pytest.approx(1.0, abs=0.02)
    assert np.abs(wide[:, 1]).max() < 0.01
    b, a = T.band_pass_coefficients(500, 0.475 * rate, 3, rate)
    whole = T.filter_columns(grid, b, a)
    np.testing.assert_allclose(wide, whole[500:], atol=1e-9)
    other = T.band_pass(frame(spark, grid), DetectionConfig(chunk_size_seconds=0.037), rate).toPandas()
    same = other.pivot(index="sample", columns="channel", values="v").to_numpy()[500:]
    np.testing.assert_allclose(wide, same, atol=1e-9)


def test_block_filter_equals_recursion():
    b, a = T.band_pass_coefficients(500, 4000, 3, 20000.0)
    x = np.random.default_rng(3).normal(size=(203, 2))
    want = np.zeros_like(x)
    for t in range(len(x)):
        for k in range(len(b)):
            if t >= k:
                want[t] += b[k] * x[t - k] - (a[k] * want[t - k] if k else 0)
    np.testing.assert_allclose(T.filter_columns(x, b, a), want, atol=1e-10)


def test_filter_gain_is_one_inside_and_half_power_at_the_edges():
    rate = 20000.0
    b, a = T.band_pass_coefficients(500, 4000, 3, rate)

    def gain(f):
        z = np.exp(-2j * np.pi * f / rate * np.arange(len(b)))
        return abs((b @ z) / (a @ z))

    assert gain(1500) == pytest.approx(1, abs=0.01)
    assert gain(500) == pytest.approx(np.sqrt(0.5), abs=1e-6) and gain(4000) == pytest.approx(np.sqrt(0.5), abs=1e-6)
    assert gain(0) < 1e-6 and gain(9999) < 1e-6


def test_every_sample_is_kept_once(spark):
    config = DetectionConfig(chunk_size_seconds=1, chunk_overlap_seconds=0.2)
    rows = T.chunk_rows(spark.range(500).select(F.col("id").alias("sample")), config, 50.0)
    kept = rows.groupBy("sample").agg(F.sum("keep").alias("k"), F.count("*").alias("n")).collect()
    assert len(kept) == 500 and {r["k"] for r in kept} == {1} and {r["n"] for r in kept} == {1, 2}


def test_thresholds_and_polarity(spark):
    rng = np.random.default_rng(0)
    grid = rng.normal(size=(400, 3)) * [1, 2, 3]
    traces = frame(spark, grid)
    one = T.thresholds(traces, DetectionConfig(), 100.0).first()
    assert one["weak"] == pytest.approx(2 * grid.std()) and one["strong"] == pytest.approx(4.5 * grid.std())
    config = DetectionConfig(use_single_threshold=False)
    each = {r["channel"]: r["weak"] for r in T.thresholds(traces, config, 100.0).collect()}
    assert each[2] == pytest.approx(2 * grid[:, 2].std())
    for symbol, sign in ((-1, -grid), (0, np.abs(grid)), (1, grid)):
        config = DetectionConfig(detect_spikes_symbol=symbol)
        assert T.crossings(traces, T.thresholds(traces, config, 100.0), config).count() == (sign > one["weak"]).sum()
    few = T.thresholds(traces, DetectionConfig(n_excerpts=1), 100.0, excerpts=True).first()
    assert any(few["weak"] == pytest.approx(2 * grid[k : k + 100].std()) for k in range(0, 400, 100))


def test_components_equal_flood_fill(spark):
    rng = np.random.default_rng(1)
    hit = rng.random((150, 6)) < 0.3
    hit[40:90, 2] = True  # one long component
    rows = [(int(s), int(c), 1.0, 1.0, 0) for s, c in np.argwhere(hit)]
    weak = spark.createDataFrame(rows, "sample long, channel int, v double, height double, strong int")
    got = T.label_crossings(weak, line_of(spark, 6), DetectionConfig(), 6, Workspace(spark)).collect()
    label = {}
    for s, c in np.argwhere(hit):
        if (s, c) in label:
            continue
        todo, label[(s, c)] = [(s, c)], s * 6 + c
        while todo:
            a, b = todo.pop()
            for i in (a - 1, a, a + 1):
                for j in (b - 1, b, b + 1):
                    if 0 <= i < 150 and 0 <= j < 6 and hit[i, j] and (i, j) not in label:
                        label[(i, j)] = s * 6 + c
                        todo.append((i, j))
    least = {}
    for (s, c), k in label.items():
        least[k] = min(least.get(k, 10**9), s * 6 + c)
    assert {(r["sample"], r["channel"]): r["component"] for r in got} == {p: least[k] for p, k in label.items()}


def test_waveforms_and_principal_features(spark):
    rng = np.random.default_rng(2)
    config = DetectionConfig(extract_s_before=4, extract_s_after=4, n_features_per_channel=2)
    waves = rng.normal(size=(40, 8)) @ rng.normal(size=(8, 8))
    rows = [(i, i % 2, [float(v) for v in waves[i]]) for i in range(40)]
    table = spark.createDataFrame(rows, "component long, channel int, wave array<double>")
    got = T.waveform_features(table, T.principal_axes(table, config), config).collect()
    for c in (0, 1):
        mine = waves[c::2]
        centred = mine - mine.mean(axis=0)
        want = np.abs(centred @ np.linalg.svd(centred)[2][:2].T)
        have = np.array([r["features"] for r in sorted(got, key=lambda r: r["component"]) if r["channel"] == c])
        np.testing.assert_allclose(np.abs(have), want, rtol=1e-6, atol=1e-8)
    limited = T.principal_axes(table, DetectionConfig(extract_s_before=4, extract_s_after=4, pca_n_waveforms_max=5))
    assert limited.count() == 2


def test_spikes_near_the_ends_and_gaps_keep_their_waveform(spark):
    config = DetectionConfig(extract_s_before=3, extract_s_after=3, n_features_per_channel=2)
    values = {s: float(s * s) for s in range(20) if s not in (9, 10)}
    trace = spark.createDataFrame([(s, 0, v) for s, v in values.items()], "sample long, channel int, v double")
    at = [0, 1, 8, 11, 19]
    found = spark.createDataFrame([(k, s, 0) for k, s in enumerate(at)], "component long, sample long, channel int")
    waves = T.waveforms(T.snippets(trace, found, config), config)
    for r in waves.collect():
        known = [s for s in range(at[r.component] - 3, at[r.component] + 3) if s in values]
        want = [values[max([k for k in known if k <= s], default=known[0])] for s in range(at[r.component] - 3, at[r.component] + 3)]
        assert r.wave == want
    features = T.waveform_features(waves, T.principal_axes(waves, config), config)
    assert features.where("size(features) = 2").count() == len(at)


def test_detect_finds_a_planted_spike(spark):
    rate, n = 20000.0, 3000
    rng = np.random.default_rng(3)
    grid = rng.normal(size=(n, 4)) * 0.05
    grid[1500:1504, 2] -= 3.0
    config = DetectionConfig(chunk_size_seconds=0.05)
    ws = Workspace(spark)
    filtered, labelled = T.detect(frame(spark, grid), line_of(spark, 4), config, rate, 4, ws)
    found = T.spikes(labelled, config).collect()
    assert any(abs(r["sample"] - 1501) < 8 and r["channel"] == 2 for r in found)
    waves = T.waveforms(T.snippets(filtered, T.spikes(labelled, config), config), config)
    assert {len(r["wave"]) for r in waves.collect()} == {32}


def test_probe(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, 3)], "src int, dst int")
    lists = {r["channel"]: r["neighbours"] for r in adjacency_list(edges).collect()}
    assert lists == {0: [1], 1: [0, 2], 2: [1]}
    dead = spark.createDataFrame([(2,)], "channel int")
    assert [tuple(r) for r in drop_dead_channels(edges, dead).orderBy("src").collect()] == [(0, 1), (3, 3)]


def test_parameter_defaults():
    c = DetectionConfig()
    assert (c.filter_low, c.filter_high_factor, c.filter_butter_order) == (500.0, 0.475, 3)
    assert c.chunk_samples(20000.0) == (20000, 300)
