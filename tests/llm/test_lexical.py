"""Lexical ranking against a direct computation with whole numbers."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from maskmix.llm import lexical
from maskmix.llm.lexical import Best, search, terms, weight

WORDS = ["alpha", "Beta", "gamma", "été", "x1", "日本", "the", "THE", "of", "rare"]


def plain_terms(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def expected(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    union: dict = {}
    for i, t in items:
        union.setdefault(i, set()).update(plain_terms(t))
    out = set()
    for item, wanted in union.items():
        scored = []
        for i, c, n in held:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        for rank, (score, has, i) in enumerate(sorted(scored)[:k], start=1):
            out.add((item, rank, i if has else None, -score))
    return out


def tables(seed, n=300):
    rng = np.random.default_rng(seed)
    text = lambda most: "".join(WORDS[w] + [" ", ", ", "\n", "--"][rng.integers(4)] for w in np.minimum(rng.geometric(0.25, rng.integers(0, most)) - 1, 9))
    docs = [(int(i), text(40)) for i in range(n)] + [(None, "rare the"), (3, "rare"), (3, "rare"), (8, None), (9, ""), (10, "!?"), (11, " ".join(["gamma"] * 50_000))]
    items = [(i, text(8)) for i in range(12)] + [(50, None), (51, "unheard of"), (None, "rare"), (1, "rare alpha"), (1, "rare alpha")]
    return docs, items


@pytest.mark.parametrize("seed,k,slice_bytes,tile", [(0, 50, 4_000_000, 512), (1, 3, 4_000_000, 7), (2, 5, 100, 64), (3, 1000, 300, 512)])
def test_search(spark, monkeypatch, seed, k, slice_bytes, tile):
    docs, items = tables(seed)
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, score int").repartition(4)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int")
    got = search(frame, asked, k, slice_bytes=slice_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set((r[0], r[1]) for r in rows))
    assert set(rows) == expected(docs, items, k)


def test_tiles_of_any_size_agree():
    rng = np.random.default_rng(5)
    weights = np.concatenate([[0], rng.integers(0, 45_000, 40)]).astype(float)
    owners = [np.unique(rng.integers(1, 41, rng.integers(1, 30))) for _ in range(9)]
    term, doc = (x.ravel() for x in np.meshgrid(np.arange(1, 41), np.arange(20)))
    impact = rng.integers(0, 1_000_000, len(term))
    want = np.array([[sum(int(weights[t]) * int(i) for t, d, i in zip(term, doc, impact) if d == k and t in set(own)) for k in range(20)] for own in owners])
    for size in (1, 3, 4096):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(lexical, "VOCABULARY_TILE", size)
            assert (lexical.ItemTile(0, owners, weights).scores(term, doc, impact, 20) == want).all()


def test_ties_across_tiles_keep_the_smaller_ids():
    best = Best(2, 3)
    for ids in ([9, 8, 7], [1, 6, 5], [2]):
        scores = np.array([[5] * len(ids), [0] * len(ids)], np.int64)
        best.add(0, scores, np.array(ids), np.ones(len(ids), bool))
    assert best.id.tolist() == [1, 2, 5] and best.item.tolist() == [0, 0, 0]


def test_terms_and_weights():
    for text in ["Don't STOPÉß 1x_y", None, "", "İ\x7f\x80a", "a\x00b　c"]:
        assert [t.decode() for t in terms(text)] == plain_terms(text)
    assert weight(10, 10) == 46 and weight(10**12, 10**12) == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert search(docs.limit(0), items).count() == 0
    assert search(docs, items.limit(0)).count() == 0
    assert search(docs, items).schema["item_id"].dataType.simpleString() == "int"
