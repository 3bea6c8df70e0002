"""Detection steps on event values read as 32-channel traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskmix.detection import traces as T
from maskmix.detection.config import DetectionConfig
from maskmix.detection.probe import adjacency_blocks, drop_dead_channels
from maskmix.functions.arrays import portable_hash_sql
from maskmix.queries import frames as Q, sql as S
from maskmix.queries.registry import query

CHANNELS = 32
RATE = 100.0
CONFIG = DetectionConfig(chunk_overlap_seconds=0.1, detect_spikes_symbol=1, threshold_strong_std_factor=3.0)

TRACES = "traces AS (SELECT event_id // 32 AS sample, CAST(event_id % 32 AS INTEGER) AS channel, value - 50 AS v FROM events)"
LIMITS = "limits AS (SELECT 2 * stddev_pop(v) AS weak, 3 * stddev_pop(v) AS strong FROM traces)"
CROSSINGS = """crossings AS (
  SELECT sample, channel, v, CASE WHEN v > strong THEN 1 ELSE 0 END AS strong, sample * 32 + channel AS node
  FROM traces, limits WHERE v > weak)"""
LINKS = """links AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM crossings a JOIN crossings b
  ON b.sample BETWEEN a.sample - 1 AND a.sample + 1 AND b.channel BETWEEN a.channel - 1 AND a.channel + 1 AND a.node <> b.node)"""
REACH = """reach(root, node) AS (
  SELECT node, node FROM crossings UNION SELECT reach.root, links.b FROM reach JOIN links ON links.a = reach.node)"""
COMPONENTS = "components AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"
SPIKES = """spikes AS (
  SELECT component, CAST(round(sum(v * v * sample) / sum(v * v)) AS BIGINT) AS sample,
         arg_max(channel, struct_pack(v := v, c := -channel)) AS channel, count(*) AS n
  FROM crossings JOIN components ON crossings.node = components.node GROUP BY component HAVING max(strong) = 1)"""
FOUND = (TRACES, LIMITS, CROSSINGS, LINKS, REACH, COMPONENTS)


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _traces(spark, sf):
    events = Q.table(spark, sf, "events")
    return events.select(
        F.floor(F.col("event_id") / CHANNELS).alias("sample"),
        (F.col("event_id") % CHANNELS).cast("int").alias("channel"),
        (F.col("value") - 50).alias("v"),
    )


def _edges(spark, sf):
    """A row of channels, each next to the following one."""
    channels = _traces(spark, sf).select("channel").distinct()
    following = channels.select((F.col("channel") - 1).alias("src"), F.col("channel").alias("dst"))
    return following.where("src >= 0")


def _labelled(spark, sf, ws):
    traces = _traces(spark, sf)
    weak = T.crossings(traces, T.thresholds(traces, CONFIG, RATE), CONFIG)
    return T.label_crossings(weak, _edges(spark, sf), CONFIG, CHANNELS, ws)


def filter_sql(rate: float) -> str:
    """The filter as a recursion over samples: the state of the transposed direct form per channel."""
    config = DetectionConfig()
    b, a = T.band_pass_coefficients(config.filter_low, config.filter_high_factor * rate, config.filter_butter_order, rate)
    n = len(b) - 1
    number = lambda x: f"CAST({float(x)!r} AS DOUBLE)"
    y = f"({number(b[0])} * t.v + r.s0)"
    new = [
        (f"r.s{k + 1} + " if k + 1 < n else "") + f"{number(b[k + 1])} * t.v - {number(a[k + 1])} * {y} AS s{k}" for k in range(n)
    ]
    zero = ", ".join(f"CAST(0 AS DOUBLE) AS s{k}" for k in range(n))
    return f"""filtered(sample, channel, v, {", ".join(f"s{k}" for k in range(n))}) AS (
  SELECT CAST(-1 AS BIGINT), channel, CAST(0 AS DOUBLE), {zero} FROM (SELECT DISTINCT channel FROM traces) c
  UNION ALL SELECT t.sample, t.channel, {y}, {", ".join(new)}
  FROM filtered r JOIN traces t ON t.sample = r.sample + 1 AND t.channel = r.channel)"""


@query(
    "xt1_band_pass",
    recursive(TRACES, filter_sql(2000.0)) + f"SELECT sample, channel, {S.r6('v')} AS v FROM filtered WHERE sample >= 0",
)
def band_pass(spark, sf):
    """Event values as traces at 2 kHz through the default band."""
    filtered = T.band_pass(_traces(spark, sf), DetectionConfig(chunk_size_seconds=0.05), 2000.0)
    return filtered.select("sample", "channel", Q.r6(F.col("v")).alias("v"))


@query(
    "xt2_overlapping_chunks",
    S.with_(TRACES)
    + """SELECT chunk, count(*) AS n, count(CASE WHEN chunk = greatest(0, CAST(floor((sample - 5) / 90) AS BIGINT)) THEN 1 END) AS kept
  FROM traces, (SELECT unnest(range(0, (SELECT max(sample) // 90 + 1 FROM traces))) AS chunk) c
  WHERE sample >= chunk * 90 AND sample < chunk * 90 + 100 GROUP BY chunk""",
)
def overlapping_chunks(spark, sf):
    """Chunks of 100 samples that overlap by 10; every sample is kept by one chunk."""
    rows = T.chunk_rows(_traces(spark, sf), CONFIG, RATE)
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("keep").alias("kept"))


@query("xt3_thresholds", S.with_(TRACES, LIMITS) + f"SELECT {S.r6('weak')} AS weak, {S.r6('strong')} AS strong FROM limits")
def threshold_levels(spark, sf):
    limits = T.thresholds(_traces(spark, sf), CONFIG, RATE)
    return limits.select(Q.r6(F.col("weak")).alias("weak"), Q.r6(F.col("strong")).alias("strong"))


@query(
    "xt4_connected_components",
    recursive(*FOUND) + "SELECT node, component FROM components",
)
def components(spark, sf):
    return _labelled(spark, sf, Q.workspace(spark, "components")).select("node", "component")


@query(
    "xt5_snippets",
    recursive(*FOUND, SPIKES)
    + f"""SELECT component, s.channel, CAST(o AS INTEGER) AS "offset", {S.r6('v')} AS v FROM spikes s, (SELECT unnest(range(-16, 16)) AS o) f
  JOIN traces t ON t.sample = s.sample + o AND t.channel = s.channel""",
)
def snippet_rows(spark, sf):
    found = T.spikes(_labelled(spark, sf, Q.workspace(spark, "snippets")), CONFIG)
    rows = T.snippets(_traces(spark, sf), found, CONFIG)
    return rows.select("component", "channel", "offset", Q.r6(F.col("v")).alias("v"))


@query("xt6_waveform_features", None)
def features(spark, sf):
    ws = Q.workspace(spark, "features")
    found = T.spikes(_labelled(spark, sf, ws), CONFIG)
    waves = ws.save(T.waveforms(T.snippets(_traces(spark, sf), found, CONFIG), CONFIG), "waves")
    rows = T.waveform_features(waves, T.principal_axes(waves, CONFIG), CONFIG)
    return rows.select("component", "channel", F.posexplode("features").alias("k", "v")).select(
        "component", "channel", "k", Q.r6(F.col("v")).alias("v")
    )


# Users of consecutive events stand for connected channels.
GRAPH = """edges AS (
  SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM events a JOIN events b ON b.event_id = a.event_id + 1)"""
PAIRS = "pairs AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)"


def _graph(spark, sf):
    events = Q.table(spark, sf, "events").select("event_id", "user_id")
    following = events.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst"))
    return events.join(following, "event_id").select(F.col("user_id").alias("src"), "dst").distinct()


LIST_BLOCK = 8


@query(
    "xt7_adjacency",
    S.with_(GRAPH, PAIRS, "degrees AS (SELECT src, count(*) AS degree FROM pairs GROUP BY src)")
    + f"""SELECT channel, degree, block, count(*) AS n, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM (
    SELECT pairs.src AS channel, degree, dst, CAST(CASE WHEN degree > {LIST_BLOCK} THEN {portable_hash_sql('dst', 1)}
      % CAST(ceil(degree / {LIST_BLOCK}) AS BIGINT) ELSE 0 END AS BIGINT) AS block
    FROM pairs JOIN degrees ON pairs.src = degrees.src) p GROUP BY channel, degree, block""",
)
def adjacency(spark, sf):
    """Neighbours of every user in blocks of about eight."""
    lists = adjacency_blocks(_graph(spark, sf), LIST_BLOCK)
    text = F.array_join(F.transform("neighbours", lambda c: c.cast("string")), ",")
    return lists.select("channel", "degree", "block", F.size("neighbours").cast("long").alias("n"), text.alias("neighbours"))


@query(
    "xt8_dead_channels",
    S.with_(
        GRAPH,
        "dead AS (SELECT user_id FROM events GROUP BY user_id HAVING max(value) < 300)",
    )
    + "SELECT src, dst FROM edges WHERE src NOT IN (SELECT user_id FROM dead) AND dst NOT IN (SELECT user_id FROM dead)",
)
def dead_channels(spark, sf):
    """Users whose values never reach 300 count as dead."""
    quiet = Q.table(spark, sf, "events").groupBy(F.col("user_id").alias("channel")).agg(F.max("value").alias("top"))
    return drop_dead_channels(_graph(spark, sf), quiet.where("top < 300"))


FILTERED_FOUND = (
    TRACES,
    filter_sql(2000.0),
    "held AS MATERIALIZED (SELECT sample, channel, v, abs(v) AS height FROM filtered WHERE sample >= 0)",
    "limits AS (SELECT 2 * stddev_pop(v) AS weak, 4.5 * stddev_pop(v) AS strong FROM held)",
    """crossings AS MATERIALIZED (
  SELECT sample, channel, height, CASE WHEN height > strong THEN 1 ELSE 0 END AS strong, sample * 32 + channel AS node
  FROM held, limits WHERE height > weak)""",
    LINKS,
    REACH,
    COMPONENTS,
)


@query(
    "xt10_filter_and_cross",
    recursive(*FILTERED_FOUND)
    + f"""SELECT sample, channel, strong, component, {S.r6('height')} AS height
  FROM crossings JOIN components ON crossings.node = components.node""",
)
def filter_and_cross(spark, sf):
    """Band-pass, thresholds and crossings together."""
    config = DetectionConfig(chunk_size_seconds=0.05, detect_spikes_symbol=0)
    ws = Q.workspace(spark, "detect")
    _, labelled = T.detect(_traces(spark, sf), _edges(spark, sf), config, 2000.0, CHANNELS, ws)
    return labelled.select("sample", "channel", "strong", "component", Q.r6(F.col("height")).alias("height"))
