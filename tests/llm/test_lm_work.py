"""Texts are counted and turned into leaves a batch at a time; the weights are learnt in place."""

import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from maskmix.llm import lm_scoring
from maskmix.llm.recurrent import Network, Trainer, Vocabulary, Weights

ODD = ["", None, "\t\n", "  A b\x0bc\x0c\x1cd\x1d  e f É", "z\x00\x85w \r\n", " THE tHe the", "x" * 5000, " Ünal ünal 漢字"]


def batch(texts):
    keys = [pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array([False] * len(texts))]
    return pa.RecordBatch.from_arrays([*keys, pa.array(texts, pa.string())], names=["row", "__id", "held_out", "text"])


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", low)]


def lexicon(count, texts):
    words = sorted(count, key=lambda w: (-count[w], w))
    tokens, kinds = Counter(), Counter()
    for w in words:
        tokens[w[-2:]] += count[w]
        kinds[w[-2:]] += 1
    head = words[: len(words) // 2]
    endings = [(e, tokens[e], kinds[e]) for e in sorted(tokens)]
    numbers = np.array([count[w] for w in head], np.int64)
    return lm_scoring.Lexicon(head, numbers, texts, sum(count.values()) + texts, len(words) + 1, endings)


@pytest.mark.parametrize("distinct", [2, 400_000])
def test_words_of_odd_texts(monkeypatch, distinct):
    monkeypatch.setattr(lm_scoring, "_DISTINCT", distinct)
    texts = ODD * 3 + [f"n{i % 7} n{i}" for i in range(5000)]
    got = Counter()
    for rows in lm_scoring._count(iter([batch(texts), batch([]), batch([None])])):
        for word, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            got[word] += n
    assert got == Counter(w for t in texts for w in plain(t))


def test_leaves_of_odd_texts():
    texts = ODD + ["the b " * 3, "other words here"]
    known = lexicon(Counter(w for t in texts[:-1] for w in plain(t)), len(texts))
    number, others = {w: i for i, w in enumerate(known.words)}, lm_scoring._Leaves(*known.by_ending)
    (rows,) = lm_scoring._encode(iter([batch(texts)]), known)
    logs, shares = np.log10(known.counts + lm_scoring.SMOOTHING), known.log_shares()
    for text, row in zip(texts, rows.to_pylist()):
        words = plain(text)
        leaves = [known.leaves[number[w]] if w in number else others[w[-2:]] for w in words]
        rare = [(w, leaf) for w, leaf in zip(words, leaves) if w not in number]
        assert np.frombuffer(row["ids"], np.int16).tolist() == [*leaves, known.end]
        assert (row["n_tokens"], row["head_known"]) == (len(words) + 1, len(words) - len(rare) + 1)
        assert dict(zip(row["rare"], row["times"])) == Counter(w for w, _ in rare)
        heads = [number[w] for w in words if w in number]
        assert row["head_log"] == pytest.approx(logs[heads].sum() + np.log10(len(texts) + lm_scoring.SMOOTHING))
        assert row["share_log"] == pytest.approx(shares[heads].sum() - sum(known.norms[leaf] for _, leaf in rare))


def test_no_python_call_per_word():
    texts = [" ".join(f"w{(i * k) % 300}" for k in range(500)) for i in range(1, 200)]
    known = lexicon(Counter(w for t in texts for w in plain(t)), len(texts))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    given = batch(texts)
    sys.setprofile(count)
    try:
        made = [*lm_scoring._encode(iter([given]), known), *lm_scoring._count(iter([given]))]
    finally:
        sys.setprofile(None)
    assert len(made) == 2 and calls < 10_000  # 99,500 words


def test_updates_of_the_weights():
    """What the trainer does in place is AdaGrad, and the mean that of the weights along the way."""
    rng = np.random.default_rng(2)
    v = Vocabulary.build(np.arange(30.0, 0, -1), 0, 9, 4)
    texts = [np.append(rng.integers(0, 30, n), 31).astype(np.int16) for n in rng.integers(1, 40, 300)]
    trainer = Trainer(Network(v, Weights.start(v, 6)), 0.2)
    steps, plainly = [], trainer.network.gradients

    def watched(*given):
        before = trainer.network.weights.flat()
        got = plainly(*given)
        steps.append((before, np.concatenate([g.reshape(-1) for g in got[0]]), got[3]))
        return got

    trainer.network.gradients = watched
    trainer.learn(texts, 31)
    after = [s[0] for s in steps[1:]] + [trainer.network.weights.flat()]
    squares, seen, shares, total = 1e-6, 0, 0.0, 0.0
    for (before, g, n), weights in zip(steps, after):
        g = np.clip(g, -1, 1)
        squares = squares + g * g
        assert np.allclose(weights, before - 0.2 * g / np.sqrt(squares), atol=1e-5)
        seen += n
        shares, total = shares + n * seen, total + n * seen * weights.astype(np.float64)
    assert len(steps) > 2 and trainer.tokens == seen == sum(map(len, texts))
    assert np.allclose(trainer.mean, total / shares)
