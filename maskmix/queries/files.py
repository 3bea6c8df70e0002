"""Sources and sinks: the given tables go through the text formats and come back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from maskmix.config import MixtureConfig
from maskmix.functions.arrays import mask_text
from maskmix.operators.dimensions import explode_dims
from maskmix.operators.masks import start_classes
from maskmix.operators.moments import m_step
from maskmix.operators.scoring import score_matrix
from maskmix.plans.fit import resume
from maskmix.queries import frames as Q, sql as S
from maskmix.queries.joins import ARRIVALS, CHOSEN_MASKS, NEAREST, STARTS
from maskmix.queries.registry import query
from maskmix.sources import sinks, text


def _width(points) -> int:
    return len(points.select("x").first()["x"])


def _write_points(spark, sf, masks: bool = False) -> MixtureConfig:
    ws = Q.workspace(spark, "files")
    config = MixtureConfig(file_base=ws.path("embedding"))
    points = Q.embedding_points(spark, sf)
    width = _width(points)
    sinks.write_matrix(points, "x", width, f"{config.file_base}.fet.1")
    if masks:
        sinks.write_matrix(points, "w", width, f"{config.file_base}.fmask.1")
    return config


@query("src1_feature_reader", S.with_(S.CELLS) + f"SELECT point_id, dim, {S.r6('x')} AS x FROM cells")
def feature_reader(spark, sf):
    features = text.read_features(spark, _write_points(spark, sf))
    return explode_dims(features, "x").select("point_id", "dim", Q.r6(F.col("x")).alias("x"))


@query("src2_mask_reader", S.with_(S.CELLS) + f"SELECT point_id, dim, {S.r6('x')} AS x, {S.r6('w')} AS w FROM cells")
def mask_reader(spark, sf):
    points = text.read_points(spark, _write_points(spark, sf, masks=True))
    cells = explode_dims(points, "x", "w")
    return cells.select("point_id", "dim", Q.r6(F.col("x")).alias("x"), Q.r6(F.col("w")).alias("w"))


@query("src3_binary_mask", S.with_(S.CELLS, S.MASKS) + "SELECT point_id, mask FROM masks")
def binary_mask_reader(spark, sf):
    masks = text.read_binary_masks(spark, _write_points(spark, sf, masks=True))
    return masks.select("point_id", mask_text(F.col("mask")).alias("mask"))


@query("src4_label_reader", "SELECT vec_id AS point_id, label AS class FROM embeddings")
def label_reader(spark, sf):
    path = Q.workspace(spark, "labels").path("embedding.clu.1")
    points = Q.embedding_points(spark, sf)
    count = points.agg(F.max("class")).first()[0] + 1
    sinks.write_lines(points, "point_id", (F.col("class") + 1).cast("string"), str(count), path)
    classes, _ = text.read_labels(spark, path)
    return classes


@query(
    "src5_trace_reader",
    "SELECT event_id // 32 AS sample, CAST(event_id % 32 AS INTEGER) AS channel, value AS v FROM events",
)
def trace_reader(spark, sf):
    path = Q.workspace(spark, "traces").path("traces.txt")
    events = Q.table(spark, sf, "events")
    events.orderBy("event_id").select(F.col("value").cast("string")).write.mode("overwrite").text(path)
    return text.read_traces(spark, path, 32)


@query("src6_sequence", "SELECT event_id AS i, 0.5 * (event_id + 1) AS v FROM events")
def sequence(spark, sf):
    """One value per event instead of a fixed length."""
    count = Q.table(spark, sf, "events").count()
    return spark.range(count).select(F.col("id").alias("i"), (F.lit(0.5) * (F.col("id") + 1)).alias("v"))


@query("src7_open_checked", "SELECT count(*) + 1 AS n_lines, 64 AS width FROM embeddings")
def open_checked(spark, sf):
    path = f"{_write_points(spark, sf).file_base}.fet.1"
    lines = text.open_lines(spark, path).agg(F.count("*").alias("n_lines"))
    return lines.withColumn("width", F.lit(int(text.first_line(spark, path))))


# Labels with gaps, so that the dense relabelling has work to do.
GAPPED = "gapped AS (SELECT vec_id AS point_id, label * 3 AS class FROM embeddings)"
RELABELLED = """relabelled AS (
  SELECT point_id, CAST(CASE WHEN class = 0 THEN 1 ELSE dense_rank() OVER (ORDER BY class) -
    (SELECT max(CASE WHEN class = 0 THEN 1 ELSE 0 END) FROM gapped) + 1 END AS INTEGER) AS label FROM gapped)"""


def _gapped(spark, sf):
    return Q.embedding_points(spark, sf).select("point_id", (F.col("class") * 3).alias("class"))


@query(
    "snk1_save_labels",
    S.with_(GAPPED, RELABELLED)
    + "SELECT point_id, label, (SELECT CAST(count(DISTINCT CASE WHEN class <> 0 THEN class END) AS INTEGER) + 1 FROM gapped)"
    + " AS n_labels FROM relabelled",
)
def save_labels(spark, sf):
    path = Q.workspace(spark, "labels").path("embedding.clu.1")
    sinks.write_labels(_gapped(spark, sf), path)
    classes, count = text.read_labels(spark, path)
    return classes.select("point_id", (F.col("class") + 1).alias("label"), F.lit(count).alias("n_labels"))


@query(
    "snk2_save_temp_labels",
    S.with_(*S.DELETION)
    + """SELECT a.point_id, CAST(CASE WHEN a.class = 0 THEN 1 ELSE d.label END AS INTEGER) AS label FROM after a
  LEFT JOIN (SELECT class, row_number() OVER (ORDER BY class) + 1 AS label FROM after WHERE class <> 0 GROUP BY class) d
  ON d.class = a.class""",
)
def save_temp_labels(spark, sf):
    from maskmix.operators.selection import apply_deletion, conclude

    ws = Q.workspace(spark, "temp")
    assigned, model, n = Q.diagonal_assignment(spark, sf)
    assigned = ws.save(assigned, "assigned")
    outcome = conclude(assigned, set(model.counts), n, Q.DIAGONAL)
    sinks.write_temp_labels(apply_deletion(assigned, outcome.deleted), ws.path("embedding"), 1)
    classes, _ = text.read_labels(spark, ws.path("embedding.temp.clu.1"))
    return classes.select("point_id", (F.col("class") + 1).alias("label"))


@query(
    "snk3_cluster_means",
    S.with_(*S.PREPARED) + f"SELECT class, dim, count(*) AS n, {S.r6('avg(y)')} AS mean FROM expected GROUP BY class, dim",
)
def cluster_means(spark, sf):
    path = Q.workspace(spark, "model").path("means")
    points, noise = Q.embedding_prepared(spark, sf)
    sinks.write_means(m_step(points, noise, MixtureConfig()), path)
    saved = spark.read.parquet(path)
    return saved.select(F.col("cluster_id").alias("class"), "n", F.posexplode("mean").alias("dim", "mean")).select(
        "class", "dim", "n", Q.r6(F.col("mean")).alias("mean")
    )


@query(
    "snk4_sorted_data",
    S.with_(S.CELLS, S.MASKS)
    + f"""SELECT r.rank, c.dim, {S.r6('c.x')} AS x, CASE WHEN c.w = 1 THEN 1 ELSE 0 END AS mask
  FROM cells c JOIN (SELECT point_id, row_number() OVER (ORDER BY mask, point_id) - 1 AS rank FROM masks) r
  ON r.point_id = c.point_id""",
)
def sorted_data(spark, sf):
    ws = Q.workspace(spark, "sorted")
    points = Q.embedding_points(spark, sf)
    sinks.write_sorted_points(points, _width(points), ws.path("embedding"), 1, ws)
    x, _ = text.read_matrix(spark, ws.path("embedding.sorted.fet.1"))
    m, _ = text.read_matrix(spark, ws.path("embedding.sorted.mask.1"))
    both = x.join(m.select("point_id", F.col("x").alias("mask")), "point_id").withColumnRenamed("point_id", "rank")
    return explode_dims(both, "x", "mask").select(
        "rank", "dim", Q.r6(F.col("x")).alias("x"), F.col("mask").cast("int").alias("mask")
    )


@query(
    "snk5_sorted_labels",
    S.with_(S.CELLS, S.MASKS, GAPPED, RELABELLED)
    + """SELECT row_number() OVER (ORDER BY mask, m.point_id) - 1 AS rank, label
  FROM masks m JOIN relabelled r ON r.point_id = m.point_id""",
)
def sorted_labels(spark, sf):
    ws = Q.workspace(spark, "sorted")
    ranked = sinks.mask_order(Q.embedding_points(spark, sf), ws)
    sinks.write_sorted_labels(ranked, _gapped(spark, sf), ws.path("embedding"), 1)
    classes, _ = text.read_labels(spark, ws.path("embedding.sorted.clu.1"))
    return classes.select(F.col("point_id").alias("rank"), (F.col("class") + 1).alias("label"))


@query(
    "snk6_start_class_dump",
    S.with_(S.CELLS, S.MASKS, ARRIVALS, CHOSEN_MASKS, NEAREST)
    + "SELECT point_id, CAST(place + 1 AS INTEGER) AS class, (SELECT CAST(count(*) AS INTEGER) + 1 FROM chosen_masks) AS n_classes FROM nearest",
)
def start_class_dump(spark, sf):
    """Start classes written zero-based under their count, and read back."""
    ws = Q.workspace(spark, "start")
    labels, count = start_classes(Q.embedding_points(spark, sf), STARTS + 1, MixtureConfig(), seed=1)
    sinks.write_start_classes(labels, count, ws.path("embedding"), 1)
    classes, header = text.read_labels(spark, ws.path(f"embedding.initialclusters.{count}.clu.1"))
    return classes.select("point_id", (F.col("class") + 1).alias("class"), F.lit(header).alias("n_classes"))


@query("snk7_run_log", None)
def run_log(spark, sf):
    """Per-iteration metrics of a fit that starts from the given labels."""
    ws = Q.workspace(spark, "log")
    points = Q.embedding_points(spark, sf)
    result = resume(points, points.select("point_id", "class"), MixtureConfig(), ws)
    sinks.write_metrics(spark, result.metrics_frame(spark), ws.path("metrics"))
    columns = ["iteration", "step", "alive", "deleted", "deleted_points", "changed"]
    return spark.read.parquet(ws.path("metrics")).select(
        *columns, *[Q.r6(F.col(c), 4).alias(c) for c in ("raw", "penalty", "score")]
    )


@query(
    "snk7_run_log_diagonal",
    S.with_(*S.diagonal_loop(S.LOOP_STEPS), S.loop_log(S.LOOP_STEPS))
    + f"""SELECT CAST(iteration AS INTEGER) AS iteration, CASE WHEN full_step THEN 'F' ELSE 'Q' END AS step, CAST(alive AS INTEGER) AS alive,
    CAST(gone AS INTEGER) AS deleted, deleted_points, changed,
    {S.r6('raw', 4)} AS raw, {S.r6('penalty', 4)} AS penalty, {S.r6('score', 4)} AS score FROM metrics""",
)
def run_log_diagonal(spark, sf):
    """The run log of the loop with diagonal covariances; -1 where no class was deleted."""
    ws = Q.workspace(spark, "log")
    points = Q.embedding_points(spark, sf)
    result = resume(points, points.select("point_id", "class"), replace(Q.DIAGONAL, normalise=False), ws)
    sinks.write_metrics(spark, result.metrics_frame(spark), ws.path("metrics"))
    columns = ["iteration", "step", "alive", F.coalesce("deleted", F.lit(-1)).alias("deleted"), "deleted_points", "changed"]
    return spark.read.parquet(ws.path("metrics")).select(
        *columns, *[Q.r6(F.col(c), 4).alias(c) for c in ("raw", "penalty", "score")]
    )


@query(
    "snk8_score_dump",
    S.with_(*S.PREPARED, S.WEIGHTS, S.DIAGONAL, S.SCORES)
    + f"SELECT point_id, CAST(cluster_id AS INTEGER) AS cluster_id, {S.r6('nlp')} AS nlp FROM scores",
)
def score_dump(spark, sf):
    path = Q.workspace(spark, "dump").path("scores")
    points, noise = Q.embedding_prepared(spark, sf)
    sinks.write_scores(score_matrix(points, Q.fitted(points, noise, Q.DIAGONAL), noise, Q.DIAGONAL), path)
    return spark.read.parquet(path).select("point_id", "cluster_id", Q.r6(F.col("nlp")).alias("nlp"))


@query(
    "snk9_matrix_print",
    "SELECT vec_id AS point_id, array_to_string(list_transform(embedding, lambda v: printf('%.5g', CAST(v AS DOUBLE))), ' ')"
    " || ' ' AS line FROM embeddings",
)
def matrix_print(spark, sf):
    return sinks.printed_rows(Q.embedding_points(spark, sf), "point_id", "x")
