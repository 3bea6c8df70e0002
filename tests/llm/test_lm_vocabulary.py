"""The network predicts every word, also those without an output of their own."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmix.llm import lm_scoring
from maskmix.llm.lm_scoring import Lexicon, score_texts


def test_rare_words_depend_on_the_context(spark):
    rng = np.random.default_rng(3)
    tongues = [[f"{k}{end}" for k in range(3000) for end in ends] for ends in (("la", "mo"), ("xt", "rk"))]
    rows = [(i, " ".join(rng.choice(tongues[i % 2], 2000))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = score_texts(docs, F.col("doc_id") % 10 < 2).where("held_out").collect()
    # knowing the language halves the choice: 0.30 a token; 512 of 12,000 words alone tell next to nothing
    gains = [(r.score - r.base_score) / r.n_tokens for r in got]
    assert len(gains) == 16 and min(gains) > 0.2


@pytest.mark.parametrize("own, endings", [(3, 2), (3, 400), (0, 1), (100, 5)])
def test_shares_of_every_leaf_add_up_to_one(monkeypatch, own, endings):
    monkeypatch.setattr(lm_scoring, "OWN_WORDS", own)
    monkeypatch.setattr(lm_scoring, "OWN_ENDINGS", endings)
    count = {f"{a}{b}".encode(): 1 + 7 * i + 3 * j for i, a in enumerate("abcdef") for j, b in enumerate(["", "x", "yz", "ä"])}
    words = sorted(count, key=lambda w: (-count[w], w))
    tokens, kinds = Counter(), Counter()
    for w in words:
        tokens[w[-2:]] += count[w]
        kinds[w[-2:]] += 1
    found = [(e, tokens[e], kinds[e]) for e in sorted(tokens)]
    lexicon = Lexicon(words, np.array([count[w] for w in words]), 9, sum(count.values()) + 9, len(words) + 1, found)
    share = Counter()
    for leaf, log in zip(lexicon.leaves.tolist(), lexicon.log_shares().tolist()):
        share[leaf] += 10**log
    singles = set(lexicon.leaves[: lexicon.own].tolist())
    assert len(singles) == min(own, len(words))
    for leaf in range(lexicon.end - 1):
        unknown = 0 if leaf in singles else 0.1 / 10 ** lexicon.norms[leaf]
        assert share[leaf] + unknown == pytest.approx(1)
    assert sum(lexicon.leaf_counts) == pytest.approx(sum(count.values()) + 0.1 * (len(words) - lexicon.own + lexicon.end - 1 - lexicon.own))
