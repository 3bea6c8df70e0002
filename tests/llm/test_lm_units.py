"""The recurrent model does not depend on how its input is split, and each unit trains a copy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmix.llm import lm_scoring


def corpus(spark, copies=0):
    rng = np.random.default_rng(5)
    kinds = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join(kinds[int(k)] for k in np.minimum(rng.zipf(1.5, 60), 80) - 1)) for i in range(150)]
    rows += [(999, rows[0][1])] * copies + [(1000, None), (1001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def scores(df):
    out = lm_scoring.score_texts(df, F.col("doc_id") % 10 == 0)
    return sorted((r["doc_id"], round(r["score"], 6)) for r in out.select("doc_id", "score").collect())


def test_scores_do_not_depend_on_the_splits(spark):
    docs = corpus(spark)
    assert scores(docs.coalesce(1)) == scores(docs.repartition(5, "doc_id"))


@pytest.mark.parametrize("unit", [100, 2500])
def test_copies_of_many_units_are_averaged(spark, monkeypatch, unit):
    monkeypatch.setattr(lm_scoring, "UNIT_TOKENS", unit)
    monkeypatch.setattr(lm_scoring, "COPIES", 3)
    got = scores(corpus(spark, copies=60))
    assert len(got) == 212 and all(np.isfinite(s) and s < 0 for _, s in got)
