"""The pipeline's near_dedup links by SimHash fingerprints and by similar sets of shingles."""

from itertools import combinations

import numpy as np

import corpus_pipeline
from maskmix.llm.similar import shingle_set
from maskmix.llm.simhash import fingerprint


def jaccard(a, b):
    x, y = (set(shingle_set(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def bits(a, b):
    return ((fingerprint(a) ^ fingerprint(b)) & (2**64 - 1)).bit_count()


def test_near_dedup_links_in_both_ways(spark):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**6, n))
    chorus, song = word(41), word(200)
    texts = {
        10: " ".join([chorus] * 40 + [word(60)]),  # repeats count in a fingerprint, not in a set of shingles
        11: " ".join([chorus] * 40 + [word(60)]),
        20: song,
        21: song.replace(" ", " x ", 3),  # similar sets, fingerprints may be further apart
        30: song,
        40: word(50),
        41: "",
        42: None,
    }
    links = [(a, b) for a, b in combinations(texts, 2) if bits(texts[a], texts[b]) <= 4 or jaccard(texts[a], texts[b]) >= 0.8]
    assert jaccard(texts[10], texts[11]) < 0.8 and bits(texts[10], texts[11]) <= 4 and (20, 21) in links
    root = {d: d for d in texts}
    for _ in texts:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == {d for d in texts if root[d] == d}
