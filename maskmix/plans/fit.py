"""The hard-assignment EM loop, warm starts, subset fitting and the search over starts."""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskmix.config import MixtureConfig
from maskmix.functions.arrays import random_integer
from maskmix.operators.dimensions import DimensionModel, point_model
from maskmix.operators.masks import start_classes
from maskmix.operators.bounds import assign_bounded, can_bound, model_drift, with_unknown_bound
from maskmix.operators.moments import model_of_cells, moved_cells, needs_products, packed_cells, summed
from maskmix.operators.scoring import MixtureModel, assign, read_model, read_summed
from maskmix.operators.selection import StepOutcome, apply_deletion, conclude
from maskmix.plans.journal import Journal
from maskmix.sources.rows import number_sorted, spread
from maskmix.workspace import Workspace

log = logging.getLogger("maskmix")

LEAST_POINTS_PER_TASK = 1024
PARTITIONS_PER_MOMENT_TASK = 16
#: Runs whose scores differ by less, in proportion, have found the same solution; the sums of one are not in a fixed order.
TIE = 1e-9

METRICS_SCHEMA = (
    "run INT, iteration INT, step STRING, alive INT, deleted INT, deleted_points BIGINT, changed BIGINT, "
    "raw DOUBLE, penalty DOUBLE, score DOUBLE, did_split INT, seconds DOUBLE, d2n DOUBLE, d3n DOUBLE, "
    "moment_points BIGINT, scored BIGINT"
)


@dataclass
class PreparedPoints:
    """Points laid out for the loop: partitioned by point and kept on executors."""

    frame: DataFrame
    noise: DimensionModel
    n_points: int
    parts: int

    @property
    def moment_tasks(self) -> int:
        """Tasks of an M-step: enough for all cores, else one for several partitions, since every
        task hands on up to d*d/2 sums per class."""
        cores = self.frame.sparkSession.sparkContext.defaultParallelism
        return max(2 * cores, math.ceil(self.parts / PARTITIONS_PER_MOMENT_TASK))

    def release(self):
        self.frame.unpersist()


@dataclass
class FitResult:
    """Final classes (``point_id, class``), total score, last model and per-iteration metrics."""

    classes: DataFrame
    score: float
    model: MixtureModel | None
    alive: int
    start_clusters: int
    metrics: list[dict] = field(default_factory=list)

    def metrics_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(m.values()) for m in self.metrics], METRICS_SCHEMA)


def lay_out(points: DataFrame, noise: DimensionModel, n_points: int, parts: int) -> PreparedPoints:
    """Partition by point once; later joins with class tables then move only the class tables.

    A task hands on up to d*d/2 sums per class, so it should not get fewer points than that is worth.
    The planner trusts the partitioning of a kept table only once it is filled (and has two
    partitions or more), hence the count.
    """
    parts = max(2, min(parts, math.ceil(n_points / LEAST_POINTS_PER_TASK)))
    frame = points.repartition(parts, "point_id").persist(StorageLevel.MEMORY_AND_DISK)
    return PreparedPoints(frame, noise, frame.count(), parts)


def prepare_points(points: DataFrame, config: MixtureConfig) -> PreparedPoints:
    """Dimension statistics and layout of ``(point_id, x, w)``, best given as a table scan.

    The number of partitions follows the scan, hence the data volume.  Points stay raw: the model
    steps scale and mask them on the fly, so no wider copy is shuffled or kept.
    """
    weights = F.col("w") if config.use_masks else F.transform("x", lambda v: F.lit(1.0))
    points, parts = spread(points.select("point_id", "x", weights.alias("w")), "point_id")
    noise = point_model(points, config.normalise)
    return lay_out(points, noise, noise.n_points, parts)


def with_class(points: PreparedPoints, classes: DataFrame) -> DataFrame:
    """Points with the columns of a class table; the hash join builds on that narrow table and needs no sort."""
    return points.frame.join(classes.hint("shuffle_hash"), "point_id")


class MomentKeeper:
    """Packed moment cells of the current classes, from all points or from those that moved.

    Cells of the last step plus signed cells of the moved points are the cells of this step.  A full count
    follows every ``recount_every`` steps, so that rounding cannot add up, after splits, and where so many
    points moved that differences would read more.  Differences need the cells to be stored, which "auto"
    does only where they are fewer than the points."""

    def __init__(self, points: PreparedPoints, config: MixtureConfig, workspace: Workspace, name: str):
        self.points, self.config, self.workspace, self.name = points, config, workspace, name
        self.cells: DataFrame | None = None
        self.age = self.turn = 0

    def _worth_keeping(self, alive: int) -> bool:
        if self.config.differences != "auto":
            return self.config.differences == "always"
        dims = self.points.noise.dims
        return alive * (dims * (dims + 1) // 2 + 3 * dims + 1) <= self.points.n_points

    def step(self, current: DataFrame, moved: int, alive: int) -> tuple[DataFrame, int]:
        """Cells of the classes in ``current`` and the number of points they were counted from."""
        products = needs_products(self.config)
        everything = lambda: packed_cells(
            with_class(self.points, current.select("point_id", "class")), self.points.noise,
            tasks=self.points.moment_tasks, products=products,
        )
        if not self._worth_keeping(alive):
            self.cells = None
            return everything(), self.points.n_points
        few = self.config.differences == "always" or 4 * moved <= self.points.n_points
        if self.cells is None or not few or self.age >= self.config.recount_every:
            found = everything()
            self.age, count = 0, self.points.n_points
        else:
            went = current.where("old_class <> class").select("point_id", "old_class", "class")
            found = summed(self.cells.unionByName(moved_cells(self.points.frame.join(went, "point_id"), self.points.noise, products)))
            self.age, count = self.age + 1, moved
        self.turn += 1
        self.cells = self.workspace.save(found, f"cells-{self.name}-{self.turn % 2}")
        return self.cells, count

    def forget(self) -> None:
        self.cells = None


def is_full_step(changed: int, n_points: int, iteration: int, score: float, old_score: float, config) -> bool:
    return (
        changed > config.changed_thresh * n_points
        or changed == 0
        or iteration % config.full_step_every == 0
        or score > old_score
    )


def wants_split(iteration: int, changed: int, last_full: bool, config: MixtureConfig) -> bool:
    if config.split == "off" or config.split_every <= 0:
        return False
    since = iteration - config.split_first
    return since == 0 or (since >= 1 and since % config.split_every == config.split_every - 1) or (
        changed == 0 and last_full
    )


def metric_row(
    points: PreparedPoints, run: int, iteration: int, step: str, outcome: StepOutcome, did_split: int,
    seconds: float, moment_points: int, clusters: int,
) -> dict:
    """One iteration in the order of ``METRICS_SCHEMA``."""
    n, dims = points.n_points, float(points.noise.dims)
    return {
        "run": run, "iteration": iteration, "step": step, "alive": outcome.alive, "deleted": outcome.deleted,
        "deleted_points": outcome.deleted_points, "changed": outcome.changed, "raw": outcome.raw,
        "penalty": outcome.penalty, "score": outcome.score, "did_split": did_split, "seconds": seconds,
        "d2n": dims**2 * n, "d3n": dims**3 * n, "moment_points": moment_points, "scored": outcome.scored or n * clusters,
    }


def expectation_maximisation(
    points: PreparedPoints,
    start: DataFrame,
    config: MixtureConfig,
    workspace: Workspace,
    start_clusters: int = 0,
    run: int = 0,
    recurse: bool = True,
    allow_noise: bool = True,
    on_better: Callable[[DataFrame], None] | None = None,
    journal: Journal | None = None,
) -> FitResult:
    """Repeat model, scores, assignment, deletion and optional splitting until nothing changes.

    Where the scoring pass has no more tasks than an M-step, it also counts the moments of the classes it finds:
    one small job then reads the totals of this step and the next model, unless a deletion or split comes between.

    Each iteration writes its assignment table, so lineage stays one step long and a lost executor
    costs at most that step.  Two slots take turns; the step being read is never overwritten.  With a
    journal the loop goes on after the last iteration recorded there.
    """
    from maskmix.plans.split import try_splits  # the split plan runs this module's steps

    n, dims = points.n_points, points.noise.dims
    score, full, iteration, metrics = 0.0, True, 0, []
    if journal is None or journal.last(run) is None:
        start = workspace.save(start.select("point_id", F.col("class").cast("int")), f"start-{run}")
        current = with_unknown_bound(start)
    moments = MomentKeeper(points, config, workspace, str(run))
    before, ahead, moved, alive = None, None, n, start_clusters or config.max_possible_clusters
    if journal is not None and (known := journal.last(run)) is not None:
        score, full, iteration, metrics = known["score"], known["full"], known["iteration"], known["metrics"]
        moved, alive = known["moved"], known["alive"]
        current = workspace.load(known["table"])
        if "cell" in current.columns:
            current = current.where("cell IS NULL").drop("cell", "v")
        current = with_unknown_bound(current) if known["split"] else apply_deletion(current, known["deleted"])
    while True:
        began = time.perf_counter()
        if ahead is not None:  # counted in the pass that scored the points
            model, moment_points = ahead, n
            moments.forget()  # cells of an earlier step are not one step behind any more
        else:
            cells, moment_points = moments.step(current, moved, alive)
            fitted = model_of_cells(cells, points.noise, config)
            model = read_model(fitted, dims, config, workspace, f"model-{run}-{iteration}")
        for c in model.singular:
            log.info("class %d (%d points): covariance is singular, left out", c, model.counts[c])
        if can_bound(model, config):
            drift = None if before is None else model_drift(before, model, points.noise.noise_mean)
            labelled = with_class(points, current.select("point_id", "class", "class2", "bound"))
            count = points.parts <= points.moment_tasks and config.differences != "always"
            scored = assign_bounded(labelled, model, drift, points.noise, config, allow_noise, count)
        else:
            labelled = with_class(points, current.select("point_id", "class"))
            scored = assign(labelled, model, points.noise, config, allow_noise, workspace, f"slices-{run}")
            scored = scored.withColumn("bound", F.lit(-math.inf))
        assigned = workspace.save(scored, f"assigned-{run}-{iteration % 2}")
        before = model if can_bound(model, config) else None
        model.release()
        alive_now, ahead = set(model.clusters) | {0}, None
        if "cell" in assigned.columns:
            sums = summed(assigned.where("cell IS NOT NULL").select("cell", "v"))
            assigned = assigned.where("cell IS NULL").drop("cell", "v")
            ahead, rows = read_summed(model_of_cells(sums, points.noise, config, sums=True), config)
            outcome = conclude(assigned, alive_now, n, config, delete=recurse, rows=rows)
            if outcome.deleted is not None:
                ahead = None
        else:
            outcome = conclude(assigned, alive_now, n, config, delete=recurse)
        current = apply_deletion(assigned, outcome.deleted)
        moved, alive = outcome.changed, outcome.alive
        if outcome.deleted is not None:
            log.info("deleting class %d (%d points)", outcome.deleted, outcome.deleted_points)
        old_score, score = score, outcome.score
        step = "F" if full else "Q"
        iteration += 1
        last_full = full
        full = is_full_step(outcome.changed, n, iteration, score, old_score, config)
        over = iteration > config.max_iter
        did_split = 0
        if not over and recurse and wants_split(iteration, outcome.changed, last_full, config):
            splits = try_splits(points, current, score, outcome, config, workspace)
            if splits is not None:
                did_split = 1
                current = with_unknown_bound(workspace.save(splits, f"split-{run}-{iteration % 2}"))
                ahead = None
                moments.forget()
        metrics.append(metric_row(points, run, iteration - 1, step, outcome, did_split, time.perf_counter() - began, moment_points, len(model.clusters)))
        log.info(
            "iteration %d%s: %d clusters, raw %f + penalty %f = %f, changed %d",
            iteration - 1, step, outcome.alive, outcome.raw, outcome.penalty, score, outcome.changed,
        )
        if on_better is not None and recurse and not over and old_score > score:
            on_better(current.select("point_id", "class"))
        if over:
            log.warning("stopped after max_iter = %d iterations without convergence", config.max_iter)
            break
        if outcome.changed == 0 and last_full and not did_split:
            break
        if journal is not None:
            journal.commit(run, iteration, {
                "score": score, "full": full, "iteration": iteration, "moved": moved, "alive": alive,
                "deleted": outcome.deleted, "split": bool(did_split), "metric": metrics[-1],
                "start_clusters": start_clusters,
                "table": f"{'split' if did_split else 'assigned'}-{run}-{iteration % 2 if did_split else (iteration - 1) % 2}",
            })
    classes = workspace.save(current.select("point_id", "class"), f"classes-{run}")
    return FitResult(classes, score, model, outcome.alive, start_clusters, metrics)


def choose_subset(points: DataFrame, stride: int, seed: int, workspace: Workspace) -> DataFrame:
    """One seeded point from each full run of ``stride`` consecutive points."""
    numbered = number_sorted(points.select("point_id"), ["point_id"], "row_number", workspace)
    total = numbered.count() // stride * stride
    group = F.floor(F.col("row_number") / stride)
    chosen = F.col("row_number") == group * stride + random_integer(group, seed, 0, stride - 1)
    return numbered.where((F.col("row_number") < total) & chosen).select("point_id")


@dataclass
class Hooks:
    """Optional outputs of a running fit."""

    on_start: Callable[[DataFrame, int], None] | None = None
    on_better: Callable[[DataFrame], None] | None = None


def fit_on_subset(
    points: PreparedPoints, starting_clusters: int, config: MixtureConfig, workspace: Workspace, run: int,
    seed: int, hooks: Hooks, journal: Journal | None = None,
) -> FitResult:
    """Fit on every ``subset``-th point, then score and assign all points with that model.

    The subset keeps the noise model and the corrections of the full data.  The final score includes
    the penalties of the full assignment.
    """
    ids = choose_subset(points.frame, config.subset, seed, workspace)
    cores = points.frame.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, math.ceil(points.parts / config.subset))
    n_points = points.n_points // config.subset
    part = lay_out(points.frame.join(ids, "point_id", "left_semi"), points.noise, n_points, parts)
    start, k = start_classes(part.frame, starting_clusters, config, seed)
    fitted = expectation_maximisation(part, start, config, workspace, k, run, on_better=hooks.on_better, journal=journal)
    part.release()
    everything = points.frame.withColumn("class", F.lit(0))
    found = assign(everything, fitted.model, points.noise, config, True, workspace, f"full-slices-{run}")
    assigned = workspace.save(found, f"full-{run}")
    outcome = conclude(assigned, set(fitted.model.clusters) | {0}, points.n_points, config, delete=False)
    classes = assigned.select("point_id", "class")
    return FitResult(classes, outcome.score, fitted.model, outcome.alive, k, fitted.metrics)


def fit_once(
    points: PreparedPoints, starting_clusters: int, config: MixtureConfig, workspace: Workspace, run: int = 0,
    hooks: Hooks = Hooks(), journal: Journal | None = None,
) -> FitResult:
    seed = config.random_seed + run
    if config.subset > 1:
        return fit_on_subset(points, starting_clusters, config, workspace, run, seed, hooks, journal)
    known = journal.last(run) if journal is not None else None
    if known is not None:
        start, k = None, known["start_clusters"]
    else:
        start, k = start_classes(points.frame, starting_clusters, config, seed)
    if hooks.on_start is not None and start is not None:
        start = workspace.save(start, f"first-{run}")
        hooks.on_start(start, k)
    return expectation_maximisation(points, start, config, workspace, k, run, on_better=hooks.on_better, journal=journal)


def fits_together(points: PreparedPoints, config: MixtureConfig, workspace: Workspace, hooks: Hooks) -> dict[int, FitResult]:
    """Results of the search's runs where they can share their passes; none otherwise."""
    from maskmix.plans.many import fit_many  # that plan builds on this module

    starts = [(k, config.random_seed) for k in config.starting_clusters() for _ in range(config.n_starts)]
    starts = [(k, seed + run) for run, (k, seed) in enumerate(starts)]
    alone = config.split != "off" or config.subset > 1 or not config.together or len(starts) < 2
    return {} if alone else fit_many(points, starts, config, workspace, hooks)


def journaled(journal: Journal | None, workspace: Workspace, run: int, fit_it: Callable[[], FitResult]) -> FitResult:
    """The result of a run that an earlier driver finished, or a new one, which is recorded."""
    if journal is None:
        return fit_it()
    known = journal.finished.get(run)
    if known is not None:
        classes = workspace.load(f"result-{run}")
        return FitResult(classes, known["score"], None, known["alive"], known["start_clusters"], known["metrics"])
    result = fit_it()
    result.classes = workspace.save(result.classes, f"result-{run}")
    journal.finish(run, {
        "score": result.score, "alive": result.alive, "start_clusters": result.start_clusters, "metrics": result.metrics,
    })
    return result


def fit(
    points: DataFrame, config: MixtureConfig = MixtureConfig(), workspace: Workspace | None = None,
    hooks: Hooks = Hooks(), journal: str | None = None,
) -> FitResult:
    """Search over start counts and repeats; the lowest score wins, the earlier run on a tie.

    ``journal`` names a folder of the fit's own: a fit that lost its driver is called again with the same
    points, configuration and folder, and goes on with the iteration it was in."""
    workspace = workspace or Workspace(points.sparkSession, "fit")
    prepared = prepare_points(points, config)
    kept = None
    if journal is not None:
        kept = Journal(points.sparkSession, journal, config, prepared.n_points)
        workspace = kept.workspace
    best, metrics, run = None, [], 0
    ready = fits_together(prepared, config, workspace, hooks) if kept is None else {}
    for k in config.starting_clusters():
        for _ in range(config.n_starts):
            result = ready[run] if run in ready else journaled(kept, workspace, run, lambda: fit_once(prepared, k, config, workspace, run, hooks, kept))  # noqa: B023
            metrics += result.metrics
            log.info("%d -> %d clusters: score %f", result.start_clusters, result.alive, result.score)
            if best is None or result.score < best.score - TIE * abs(best.score):
                best = result
            run += 1
    prepared.release()
    best.metrics = metrics
    return best


def check_labels(points: PreparedPoints, classes: DataFrame, config: MixtureConfig) -> None:
    """Every point has exactly one label, and there are no more classes than the configuration allows."""
    met = points.frame.select("point_id").join(classes, "point_id", "left").agg(
        F.count("*").alias("rows"), F.count("class").alias("labelled"), F.countDistinct("class").alias("classes"),
        F.min("class").alias("least"),
    ).first()
    if met["labelled"] != points.n_points or met["rows"] != points.n_points:
        raise ValueError(f"{met['labelled']} labels for {points.n_points} points; every point needs one")
    if met["classes"] > config.max_possible_clusters:
        raise ValueError(f"{met['classes']} classes; max_possible_clusters is {config.max_possible_clusters}")
    if met["least"] is not None and met["least"] < 0:
        raise ValueError("labels start at the noise class, 0")


def resume(
    points: DataFrame, classes: DataFrame, config: MixtureConfig = MixtureConfig(), workspace: Workspace | None = None,
    hooks: Hooks = Hooks(), journal: str | None = None,
) -> FitResult:
    """Continue from known classes, for instance labels read from a file; ``journal`` as for ``fit``."""
    workspace = workspace or Workspace(points.sparkSession, "resume")
    prepared = prepare_points(points, config)
    kept = None
    if journal is not None:
        kept = Journal(points.sparkSession, journal, config, prepared.n_points)
        workspace = kept.workspace

    def loop() -> FitResult:
        start = None
        if kept is None or kept.last(0) is None:
            start = workspace.save(classes.select("point_id", F.col("class").cast("int")), "given")
            check_labels(prepared, start, config)
        return expectation_maximisation(prepared, start, config, workspace, on_better=hooks.on_better, journal=kept)

    result = journaled(kept, workspace, 0, loop)
    prepared.release()
    return result
