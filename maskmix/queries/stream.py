"""Structured Streaming over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskmix.config import MixtureConfig
from maskmix.detection.config import DetectionConfig
from maskmix.detection.traces import thresholds
from maskmix.queries import frames as Q, sql as S
from maskmix.queries.detection import CHANNELS, COMPONENTS, REACH, filter_sql, recursive
from maskmix.queries.functions import D, LINES
from maskmix.queries.registry import query
from maskmix.streaming.chunks import chunk_totals
from maskmix.streaming.detection import detect_stream
from maskmix.streaming.learning import StreamedModel, learn
from maskmix.streaming.scoring import score_stream


def _stream(spark, sf, name):
    """A table as a stream of files, whether it is one file or a folder of them.

    The last letter is a pattern: a stream takes its path for a folder unless it holds one, and a filter of
    names below ``sf`` would meet the files of a folder, not the folder."""
    schema = Q.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _drain(stream, ws, mode="append"):
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", ws.path("out"))
        .option("checkpointLocation", ws.path("progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return ws.load("out", stream.schema)


@query(
    "st1_stream_scoring",
    S.with_(*S.STEP) + f"SELECT point_id, CAST(class AS INTEGER) AS class, {S.r6('nlp')} AS nlp FROM assigned",
)
def stream_scoring(spark, sf):
    """The embeddings arrive as a stream and are classed by a model fitted on the table."""
    points, noise = Q.embedding_prepared(spark, sf)
    model = Q.fitted(points, noise, Q.DIAGONAL)
    arriving = _stream(spark, sf, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("x")
    )
    arriving = arriving.withColumn("w", Q.soft_mask(F.col("x"), 5.0))
    scored = _drain(score_stream(arriving, model, noise, Q.DIAGONAL), Q.workspace(spark, "stream"))
    return scored.select("point_id", "class", Q.r6(F.col("nlp")).alias("nlp"))


@query(
    "st2_stream_chunks",
    f"""SELECT w * 82800 AS start_second, event_type, count(*) AS n, {S.r6('sum(value)', 4)} AS total
  FROM (SELECT event_type, value, epoch_us(ts) AS t, (SELECT max(epoch_us(ts)) FROM events) AS latest FROM events) e,
    (SELECT unnest(range((SELECT min(epoch_us(ts)) // 82800000000 - 1 FROM events), (SELECT max(epoch_us(ts)) // 82800000000 + 1 FROM events))) AS w) c
  WHERE t >= w * 82800000000 AND t < w * 82800000000 + 86400000000
    AND w * 82800000000 + 86400000000 <= latest - 600000000 GROUP BY w, event_type""",
)
def stream_chunks(spark, sf):
    """Day-long chunks that overlap by an hour, as far as the watermark has closed them."""
    zone = spark.conf.get("spark.sql.session.timeZone")  # the table's times carry no zone; read them as UTC
    ts = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    events = _stream(spark, sf, "events").select(ts.alias("ts"), "event_type", "value")
    totals = chunk_totals(events, "24 hours", "23 hours", "10 minutes")
    flat = totals.select(F.unix_seconds("chunk.start").alias("start_second"), "event_type", "n", "total")
    closed = _drain(flat, Q.workspace(spark, "stream"))
    return closed.select("start_second", "event_type", "n", Q.r6(F.col("total"), 4).alias("total"))


@query(
    "st3_stream_model",
    S.with_(*LINES)
    + "SELECT class, CAST(n AS BIGINT) AS n, "
    + ", ".join(f"{S.r6(f'm{i}')} AS mean{i}" for i in D)
    + f", {S.r6('log_root_det')} AS log_root_det FROM model WHERE class <> 0",
)
def stream_model(spark, sf):
    """The model that all line items have built, arriving as a stream with their line number as class."""
    _, noise = Q.lineitem_prepared(spark, sf)
    ranges = Q.lineitem_ranges(spark, sf)
    arriving = Q.lineitem_points(_stream(spark, sf, "lineitem"), ranges).select("class", "x", "w")
    ws = Q.workspace(spark, "learning")
    kept = StreamedModel(spark, ws.path("model"), noise, MixtureConfig())
    learn(arriving, kept, ws.path("progress"), availableNow=True).awaitTermination()
    means = [Q.r6(F.get("mean", F.lit(i))).alias(f"mean{i}") for i in D]
    table = kept.table().where("cluster_id <> 0")
    return table.select(F.col("cluster_id").alias("class"), "n", *means, Q.r6(F.col("log_root_det")).alias("log_root_det"))


# Event values as recordings of 100 samples at 2 kHz, each with four shanks of eight channels.
RECORDING, SHANK, STREAM_RATE = 100, 8, 2000.0
BEGIN = 1_000_000_000_000_000  # microseconds; a stream's first watermark is the epoch, so samples come after it
SPIKING = DetectionConfig(detect_spikes_symbol=0, threshold_weak_std_factor=0.8, threshold_strong_std_factor=1.5)
ARRIVED = (
    f"""traces AS (
  SELECT event_id // {CHANNELS} % {RECORDING} AS sample, value - 50 AS v,
    CAST(event_id // {CHANNELS * RECORDING} * {CHANNELS} + event_id % {CHANNELS} AS INTEGER) AS channel FROM events)""",
    filter_sql(STREAM_RATE),
    "passed AS (SELECT max(sample) // 2 - 5 AS ms FROM traces)",
    "held AS MATERIALIZED (SELECT sample, channel, v, abs(v) AS height FROM filtered, passed WHERE sample >= 0 AND sample // 2 < ms)",
    "limits AS (SELECT 0.8 * stddev_pop(v) AS weak, 1.5 * stddev_pop(v) AS strong FROM traces)",
    f"""crossings AS MATERIALIZED (
  SELECT sample, channel, height, v, CASE WHEN height > strong THEN 1 ELSE 0 END AS strong, channel // {SHANK} AS place,
    (channel // {CHANNELS} * {RECORDING} + sample) * {CHANNELS} + channel % {CHANNELS} AS node
  FROM held, limits WHERE height > weak)""",
)
GROUP = f"CAST(place // {CHANNELS // SHANK} AS BIGINT) AS recording, CAST(place % {CHANNELS // SHANK} AS INTEGER) AS shank"


def _detected(spark, sf):
    place = F.floor(F.col("event_id") / CHANNELS)
    channel = (F.col("event_id") % CHANNELS).cast("int")

    def traces(events):
        sample = place % RECORDING
        return events.select(
            F.floor(place / RECORDING).alias("recording"), F.floor(channel / SHANK).cast("int").alias("shank"), sample.alias("sample"),
            F.timestamp_micros(sample * int(1e6 / STREAM_RATE) + BEGIN).alias("ts"), channel.alias("channel"), (F.col("value") - 50).alias("v"),
        )

    known = traces(Q.table(spark, sf, "events"))
    following = known.select("channel").distinct().select((F.col("channel") - 1).alias("src"), F.col("channel").alias("dst"))
    found = detect_stream(
        traces(_stream(spark, sf, "events")), ["recording", "shank"], following.where("src >= 0"),
        thresholds(known, SPIKING, STREAM_RATE), SPIKING, STREAM_RATE, CHANNELS, "5 milliseconds",
    )
    return _drain(found, Q.workspace(spark, "stream"))


@query(
    "st4_stream_crossings",
    recursive(*ARRIVED)
    + f"""SELECT {GROUP}, sample, channel % {CHANNELS} AS channel, strong, {S.r6('v')} AS v FROM crossings""",
)
def stream_crossings(spark, sf):
    """Crossings of the filtered values, as far as the watermark has passed."""
    found = _detected(spark, sf).where("kind = 'crossing'")
    return found.select("recording", "shank", "sample", "channel", "strong", Q.r6(F.col("v")).alias("v"))


@query(
    "st5_stream_spikes",
    recursive(
        *ARRIVED,
        """links AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM crossings a JOIN crossings b ON a.place = b.place AND a.node <> b.node
  AND b.sample BETWEEN a.sample - 1 AND a.sample + 1 AND b.channel BETWEEN a.channel - 1 AND a.channel + 1)""",
        REACH,
        COMPONENTS,
        f"latest AS (SELECT channel // {SHANK} AS place, max(sample) AS sample FROM held GROUP BY ALL)",
    )
    + f"""SELECT {GROUP}, component % {CHANNELS * RECORDING} AS component, CAST(round(sum(height * height * c.sample)
      / sum(height * height)) AS BIGINT) AS sample,
    arg_max(channel, struct_pack(h := height, c := -channel)) % {CHANNELS} AS channel, count(*) AS n
  FROM crossings c JOIN components USING (node) JOIN latest USING (place) GROUP BY place, component
  HAVING max(strong) = 1 AND max(c.sample) + 1 <= max(latest.sample)""",
)
def stream_spikes(spark, sf):
    """Spikes whose components no later sample can join."""
    found = _detected(spark, sf).where("kind = 'spike'")
    return found.select("recording", "shank", "component", "sample", "channel", "n")
