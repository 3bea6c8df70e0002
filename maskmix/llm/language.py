"""Language identification by fusing evidence in one posterior.

Four kinds of evidence meet per text: the likelihood of its byte trigrams under every language, the
language its markup or table declares, the suffix of its address, and how often its host, the host's
domain and the whole corpus have each language.  How far a declaration or a suffix can be trusted is
counted, not assumed.  Host counts are aggregates over the corpus, smoothed from the whole down to
the host; a text's own vote is taken out of them.  Where declarations are wrong for a text, the other
evidence outvotes them.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from maskmix.functions.runtime import map_arrow
from maskmix.llm.common import append, free_name, regroup, texts_of
from maskmix.workspace import Workspace

BUCKET_BITS = 12
#: Most declared labels that get a trigram model, the most frequent first, and the texts that each needs.  Texts
#: of any other declared language keep it unless a language with a model explains them.
MOST_LANGUAGES = 200
LEAST_TEXTS = 5
#: Trigrams that a text's likelihood counts as, at most; a longer text is as sure, not surer.
TRUSTED_GRAMS = 200
#: Pseudo-counts of the smoothing from corpus to domain and from domain to host.
SMOOTHING = 20.0
LEAST_PROBABILITY = 0.5
#: Share of the even distribution mixed into every language, and the nats per trigram by which a text
#: must be less likely than even under every language to be none of them.
EVEN_SHARE = 0.1
NONE_MARGIN = 1.2
NONE = "und"

_SPACE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CHUNK = 1_000_000


def gram_counts(text: str | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """Counts of hashed byte trigrams of the letters, with one space between words and at both ends."""
    out = np.zeros(1 << bits, dtype=np.int64)
    text = text or ""
    for at in range(0, len(text), _CHUNK):
        words = text[at : at + _CHUNK].lower().encode("utf-8", "surrogatepass").translate(_SPACE).split()
        if not words:
            continue
        a = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
        code = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)
        out += np.bincount(code >> np.uint32(32 - bits), minlength=1 << bits)
    return out


def _count(batches, languages: list[str]):
    """Trigram counts per declared language over a task."""
    total: dict[str, np.ndarray] = {}
    known = set(languages)
    for batch in regroup(batches, "t"):
        for label, text in zip(batch.column(1).to_pylist(), texts_of(batch, "t")):
            if label in known:
                counts = gram_counts(text)
                total[label] = total[label] + counts if label in total else counts
    for label, counts in total.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([label] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())],
            names=["label", "bucket", "n"],
        )


def trigram_model(docs: DataFrame, text: Column, declared: Column, languages: list[str]) -> np.ndarray:
    """Log probabilities, language by bucket, from every text whose label is one of ``languages``."""
    rows = docs.select(text.alias("t"), declared.alias("d")).where(F.col("d").isNotNull())
    counted = map_arrow(rows, partial(_count, languages=languages), "label string, bucket int, n long")
    counts = np.full((len(languages), 1 << BUCKET_BITS), 0.05)
    for r in counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect():  # languages times buckets
        counts[languages.index(r["label"]), r["bucket"]] += r["n"]
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log((1 - EVEN_SHARE) * shares + EVEN_SHARE / counts.shape[1])


def _likelihood(text: str, model: np.ndarray):
    none = -np.log(model.shape[1]) - NONE_MARGIN

    def run(batch: pa.RecordBatch):
        counts = np.array([gram_counts(t) for t in texts_of(batch, text)])
        n = counts.sum(axis=1)
        per_gram = counts @ model.T / np.maximum(n, 1)[:, None]
        # the last entry is no language at all: trigrams less likely than if all were alike
        per_gram = np.concatenate([per_gram, np.where(n > 0, none, 0.0)[:, None]], axis=1)
        evidence = per_gram * np.minimum(n, TRUSTED_GRAMS)[:, None]
        offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * evidence.shape[1])
        return [pa.ListArray.from_arrays(offsets, pa.array(evidence.reshape(-1)))]

    return run


def _argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)) - 1


def identify(
    docs: DataFrame,
    text_col: str,
    declared: Column,
    suffix: Column,
    host: Column,
    domain: Column,
    train: Column | None = None,
    keep: list[str] | None = None,
    workspace: Workspace | None = None,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) and one more, the last: a struct of ``language``, ``probability``,
    ``text_language`` (by the text alone) and ``accepted``.

    ``train`` marks the rows whose text and declared language teach the trigram model (all by
    default).  A text without letters, or unlike every language, is ``und`` and not accepted, nor is
    one whose best language stays below a probability of one half.  Where such a text declares a language
    that is too rare for a model, it has that language and is accepted.  Missing evidence is neutral.  Equal
    evidence goes to the first language in order of names.  Repeated rows each count and each get a row.
    Without any language that has a model, and for an empty table, there is nothing to learn from: texts with
    letters have the language they declare, all others are ``und``.
    """
    workspace = workspace or Workspace(docs.sparkSession, "language")
    own, name = list(docs.columns), free_name(docs, "language")
    keep = own if keep is None else keep
    d, s, h, m, t, e = (free_name(docs, f"__{c}") for c in ("declared", "suffix", "host", "domain", "label", "evidence"))
    clean = lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))
    base = docs.select(*own, clean(declared).alias(d), clean(suffix).alias(s), clean(host).alias(h), clean(domain).alias(m))
    teach = base if train is None else base.where(train)
    frequent = teach.where(F.col(d).isNotNull()).groupBy(d).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    languages = sorted(r[d] for r in frequent.orderBy(F.desc("n"), d).limit(MOST_LANGUAGES).collect())
    kind = "struct<language:string,probability:double,text_language:string,accepted:boolean>"
    if not languages:
        rare = F.col(d).isNotNull() & F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")
        alone = F.struct(
            F.when(rare, F.col(d)).otherwise(NONE).alias("language"), F.when(rare, LEAST_PROBABILITY).otherwise(0.0).alias("probability"),
            F.lit(NONE).alias("text_language"), rare.alias("accepted"),
        )
        return base.select(*keep, alone.cast(kind).alias(name))
    model = trigram_model(teach, F.col(text_col), F.col(d), languages)
    size = len(languages) + 1
    voted = append(base, text_col, [(e, "array<double>")], partial(_likelihood, text_col, model))
    voted = workspace.save(voted.select(*keep, d, s, h, m, e, _argmax(F.col(e)).cast("int").alias(t)), "votes")
    narrow = voted.select(d, s, h, m, t)

    everything = np.zeros(size)
    for r in narrow.groupBy(t).agg(F.count("*").alias("n")).collect():  # one row per language
        everything[r[t]] = r["n"]
    everything = (everything + 1) / (everything.sum() + size)
    arrays = lambda x: F.array(*[F.lit(float(v)) for v in x])

    def per_place(column: str) -> DataFrame:
        """Texts of each label per host, domain, declared value or suffix, as an array; summed up before it moves."""
        counts = narrow.where(F.col(column).isNotNull()).groupBy(column, t).agg(F.count("*").alias("n"))
        cells = [F.sum(F.when(F.col(t) == k, F.col("n")).otherwise(0)).cast("double") for k in range(size)]
        return counts.groupBy(column).agg(F.array(*cells).alias("n"))

    places = voted
    for key, extra in ((h, "__nh"), (m, "__nm"), (d, "__nd"), (s, "__ns")):
        table = workspace.save(per_place(key).withColumnRenamed("n", extra), extra.strip("_"))
        few = table.count() <= 20_000  # a few MB at most; otherwise a join that can be split
        places = places.join(F.broadcast(table) if few else table, key, "left")
    zeros = arrays(np.zeros(size))
    own_vote = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k == F.col(t), 1.0).otherwise(0.0))

    def others(counts: str) -> Column:
        counted = F.coalesce(F.col(counts), zeros)
        return F.zip_with(counted, own_vote, lambda n, mine: F.greatest(n - mine, F.lit(0.0)))

    def smoothed(counts: Column, prior: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, prior, lambda n, p: (n + SMOOTHING * p) / (total + SMOOTHING))

    def trust(counts: str, share: float) -> Column:
        """log P(value | language) up to a constant, from how often texts of each label have the value.

        By Bayes it is P(language | value) / P(language); ``share`` softens it towards no information."""
        shares = smoothed(F.col(counts), arrays(everything))
        known = F.zip_with(shares, arrays(everything), lambda v, p: F.log((1 - share) * v / p + share))
        return F.coalesce(known, zeros)

    added = [trust("__nd", 0.02), trust("__ns", 0.2)]
    prior = places.withColumn("__pm", smoothed(others("__nm"), arrays(everything)))
    prior = prior.withColumn("__ph", smoothed(others("__nh"), F.col("__pm")))
    fused = F.zip_with(F.col(e), F.col("__ph"), lambda a, p: a + F.log(p))
    for more in added:
        fused = F.zip_with(fused, more, lambda a, x: a + x)
    scored = prior.withColumn("__fused", fused).withColumn("__best", F.array_max("__fused"))
    total = F.aggregate(F.col("__fused"), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__best")))
    names = F.array(*[F.lit(x) for x in [*languages, NONE]])
    empty = F.array_max(F.transform(F.col(e), F.abs)) == 0
    winner = F.when(empty, F.lit(size)).otherwise(_argmax(F.col("__fused")) + 1).cast("int")
    by_text = F.when(empty, F.lit(size)).otherwise(F.col(t) + 1).cast("int")
    scored = scored.withColumn("__winner", F.element_at(names, winner)).withColumn("__p", 1 / total)
    unsure = (F.col("__winner") == NONE) | (F.col("__p") < LEAST_PROBABILITY)
    rare = unsure & ~empty & F.col(d).isNotNull() & ~F.array_contains(names, F.col(d))
    scored = scored.withColumn("__rare", F.coalesce(rare, F.lit(False)))
    scored = scored.withColumn("__winner", F.when(F.col("__rare"), F.col(d)).otherwise(F.col("__winner")))
    scored = scored.withColumn("__p", F.when(F.col("__rare"), F.lit(LEAST_PROBABILITY)).otherwise(F.col("__p")))
    verdict = F.struct(
        F.col("__winner").alias("language"),
        F.col("__p").alias("probability"),
        F.element_at(names, by_text).alias("text_language"),
        ((F.col("__winner") != NONE) & (F.col("__p") >= LEAST_PROBABILITY)).alias("accepted"),
    )
    return scored.select(*keep, verdict.alias(name))


def identify_documents(docs: DataFrame, text_col: str = "text", train: Column | None = None, keep=None, workspace=None) -> DataFrame:
    """Documents declare their language in ``lang``; their source is the host; they have no address."""
    none = F.lit(None).cast("string")
    return identify(docs, text_col, F.col("lang"), none, F.col("source"), none, train, keep, workspace)


def identify_pages(pages: DataFrame, html_col: str = "html", url_col: str = "url", keep=None, workspace=None) -> DataFrame:
    """Pages declare it as the ``lang`` of their markup; the address has a suffix (a language in its path
    or the last label of the host), a host and the host's domain.  The text is what stands between tags."""
    page = F.coalesce(F.col(html_col), F.lit(""))
    text = F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    host = F.regexp_extract(F.col(url_col), r"^[a-zA-Z]+://([^/:?#]+)", 1)
    in_path = F.regexp_extract(F.col(url_col), r"^[a-zA-Z]+://[^/]+/([a-z]{2})(?:[/?#]|$)", 1)
    suffix = F.when(in_path != "", F.concat(F.lit("/"), in_path)).otherwise(F.regexp_extract(host, r"([^.]+)$", 1))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+|[^.]+\.[^.]+)$", 1)
    declared = F.regexp_extract(page, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)
    name = free_name(pages, "page_text")
    return identify(pages.withColumn(name, text), name, declared, suffix, host, domain, None, keep or list(pages.columns), workspace)
