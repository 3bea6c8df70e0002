"""Credentials in texts, told from copied examples by who owns them across the corpus.

Only DataFrame functions.  Candidates of a text are key assignments, access keys, long hexadecimal runs
and bare tokens that mix letters and digits.  Their values are hashed and counted over the corpus by
distinct owners and distinct repositories.  A value that several owners have is a copied example; one
that looks random and belongs to few owners is live.  A bare token becomes a span only when its value
is live as an assignment, access key or hexadecimal run elsewhere: a leak without its label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from maskmix.llm.common import free_name
from maskmix.workspace import Workspace

#: From so many distinct owners on, a value is a copied example.
EXAMPLE_OWNERS = 3
#: Repositories of one owner from which on a value that does not look random is an example.
EXAMPLE_REPOSITORIES = 3

# Fixed patterns: kind, expression, group of the value, least characters of the value.  Hexadecimal runs
# and access keys are maximal, so their least length can be part of the expression.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    (
        "bare",
        r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+",
        0,
        12,
    ),
]
BASE = 3  # the first kinds are spans whatever their owners

_CANDIDATES = "array<struct<rank:int,start:long,stop:long,value:string>>"


def _found(text: Column, rank: int) -> Column:
    """Candidates of one kind.  A text is what lies between its matches and the matches in turn, so
    the lengths of both add up to the places."""
    _, pattern, group, least = KINDS[rank]
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    empty = F.array().cast(_CANDIDATES)
    zero = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")

    def step(acc, part):
        gap, whole, value = part["gap"], part["whole"], part["value"]
        start = acc["at"] + size(gap)
        one = F.struct(
            F.lit(rank).alias("rank"), start.alias("start"), (start + size(whole)).alias("stop"), value.alias("value")
        )
        kept = F.when(F.length(value) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct((start + size(whole)).alias("at"), kept.alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(parts, zero, step, lambda acc: acc["out"])).otherwise(empty)


def candidates(text: Column) -> Column:
    """All candidates of a text, kind by kind, in code points; none for a missing text."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_found(text, rank) for rank in range(len(KINDS))])


def looks_random(value: Column) -> Column:
    """At least twelve characters, eight of them different, letters and digits among them."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= 12) & (different >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def ownership(found: DataFrame) -> DataFrame:
    """Per hash: distinct owners and repositories, whether a base kind has it, whether it looks random.

    Counted in two steps, so that a value half the corpus copies is summed up before it moves."""
    base = (F.col("rank") < BASE).cast("int")
    pairs = found.groupBy("hash", "owner").agg(F.max(base).alias("base"), F.max("random").alias("random"))
    owners = pairs.groupBy("hash").agg(
        F.count("*").alias("owners"), F.max("base").alias("base"), F.max("random").alias("random")
    )
    repositories = found.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    return owners.join(repositories, "hash")


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    one = lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string")
    )
    return F.concat_ws(",", F.transform(spans, one))


def find_secrets(
    docs: DataFrame,
    text_col: str = "text",
    owner: Column | str = "source",
    repository: Column | str = "doc_id",
    example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int = EXAMPLE_REPOSITORIES,
    keep: list[str] | None = None,
    workspace: Workspace | None = None,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) and one more, the last: an array of spans by start and kind, each a struct of
    ``start, rank, stop`` (code points; rank of the kind), ``live``, ``owners`` and ``repositories``.

    A value that looks random is live until ``example_owners`` owners have it, one that a base kind marks also
    if it does not, as long as one owner has it in fewer than ``example_repositories`` repositories.  Unmarked
    values that look random are spans where the same value is live under a mark elsewhere.

    A missing text has no spans; an empty table gives none.  Repeated rows have their spans each and count as
    one repository.  Missing owners or repositories count as one owner or repository.
    """
    workspace = workspace or Workspace(docs.sparkSession, "secrets")
    own, name = list(docs.columns) if keep is None else keep, free_name(docs, "spans")
    row, found_col, owner_col, repo_col = (free_name(docs, f"__{c}") for c in ("row", "found", "owner", "repo"))
    as_text = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    stored = workspace.save(
        docs.select(
            *own,
            F.monotonically_increasing_id().alias(row),
            candidates(F.col(text_col)).alias(found_col),
            as_text(owner).alias(owner_col),
            as_text(repository).alias(repo_col),
        ),
        "candidates",
    )
    rows = stored.where(F.size(found_col) > 0)
    found = rows.select(
        F.col(row).alias("row"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repository"), F.inline(found_col)
    ).select(
        "row", "owner", "repository", "rank", "start", "stop",
        F.sha2("value", 256).alias("hash"), looks_random(F.col("value")).alias("random"),
    )
    # a labelled value may be a plain word, but then one owner alone has it, and in few repositories
    own_word = (F.col("base") == 1) & (F.col("owners") == 1) & (F.col("repositories") < example_repositories)
    live = (F.col("owners") < example_owners) & (F.col("random") | own_word)
    verdicts = ownership(found).select("hash", "owners", "repositories", live.alias("live"), "base", "random")
    verdicts = workspace.save(verdicts, "verdicts")
    judged = found.select("row", "rank", "start", "stop", "hash").join(verdicts, "hash")
    judged = judged.where((F.col("rank") < BASE) | (F.col("live") & F.col("random") & (F.col("base") == 1)))
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(1, Window.unboundedFollowing)
    is_base = F.col("rank") < BASE
    apart = (F.coalesce(F.max(F.when(is_base, F.col("stop"))).over(before), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.min(F.when(is_base, F.col("start"))).over(after), F.col("stop")) >= F.col("stop")
    )
    kept = judged.withColumn("apart", apart).where(is_base | F.col("apart"))
    span = F.struct("start", "rank", "stop", "live", "owners", "repositories")
    spans = kept.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias(name))
    spans = spans.withColumnRenamed("row", row)
    none = F.array().cast(spans.schema[name].dataType).alias(name)
    without = stored.where(F.size(found_col) == 0).select(*own, none)
    with_some = rows.join(spans, row, "left").select(*own, F.coalesce(F.col(name), none).alias(name))
    return without.unionByName(with_some)


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["rank"] < BASE)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return _text_of(spans)


def count_kind(spans: Column, kind: str) -> Column:
    rank = [k for k, *_ in KINDS].index(kind)
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every live span replaced; overlapping ones by one mark."""
    live = F.filter(spans, lambda s: s["live"])
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, (acc["upto"] + 1).cast("int"), F.greatest(s["start"] - acc["upto"], F.lit(0)).cast("int"))
        add = F.when(s["start"] >= acc["upto"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["upto"], s["stop"]).alias("upto"), add.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["upto"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(live) > 0, F.aggregate(live, zero, step, rest)).otherwise(text)
