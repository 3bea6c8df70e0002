"""Spelling variants against direct comparison of all words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from maskmix.llm.variants import Acceptor, near_in_chunk, spelling_variants, words_of


def plain_words(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def expected(docs):
    count = plain_words(docs)
    form, n_near = {}, {}
    for w, n in count.items():
        others = [v for v in count if near(w, v)]
        n_near[w] = len(others)
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 10 * n else None
    out = set()
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, n_near[w], count[form[w]] if form[w] else None))
    return out


def corpus(seed, n=60, long=4000):
    rng = np.random.default_rng(seed)
    base = ["abcdefg", "aaaaaaa", "aaaaaaaa", "letters", "lettres", "étudiants", "À×÷ÿabcà", "internationally"]
    shared = ["abcab" + "".join(x) for x in rng.choice(list("abé"), (40, 3))]
    docs = []
    for i in range(n):
        out = []
        for _ in range(60):
            w = list((base + shared)[min(int(rng.geometric(0.12)) - 1, 47)])
            if rng.random() < 0.3:
                at = int(rng.integers(0, len(w)))
                kind = rng.integers(3)
                w[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice(list("abxzé"))]
            w = "".join(w)
            out.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, " ".join(out)))
    docs += [(None, "abcdefg letters letters"), (7, docs[7][1]), (8, None), (9, ""), (10, "abcdefg1letters_Āabſcdefg"), (11, "q" * long + " " + "q" * (long + 1)), (12, "q" * long + " " + "q" * (long + 1))]
    docs += [(k, "standsalone") for k in range(200, 203)]
    docs += [(100 + k, "abcdefg " * 9 * k) for k in range(40)]
    return docs


@pytest.mark.parametrize("seed,chunk,hot", [(0, 20_000, 20_000), (1, 30, 20_000), (2, 20_000, 3), (3, 25, 8), (4, 1, 1)])
def test_variants(spark, seed, chunk, hot):
    docs = corpus(seed, long=4000 if hot > 8 else 30)
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string").repartition(4)
    got = spelling_variants(frame, chunk_words=chunk, hot_words=hot)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    want = expected(docs)
    assert len(rows) == len(want) and set(rows) == want
    assert any(r[1] for r in rows) and any(r[4] == 0 for r in rows)


def test_chains_of_forms(spark):
    words = ["aaabbbccc", "aaabbbccd", "aaabbbcdd", "aaabbddd", "aaabbbddd"]
    docs = [(1000 + k, (w + " ") * 2 * 10**k) for k, w in enumerate(words)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in spelling_variants(frame).collect()} == expected(docs)


def test_words_of_any_text():
    for text in ["Naïvetés café́ssss İstanbul", "×÷ÀÿÀÿÀ", None, "a" * 20]:
        for doc_id in range(200):
            got = {w.decode("latin-1"): n for w, n in words_of(doc_id, text).items()}
            want = Counter()
            for w, n in plain_words([(doc_id, text), (doc_id, text)]).items():
                want[w] += n // 2
            assert got == {w: n for w, n in want.items() if n}


def test_acceptor_is_minimal_and_numbers_words():
    words = sorted({bytes(w) for w in np.random.default_rng(1).choice(np.frombuffer(b"abc", np.uint8), (60, 4)).tolist()})
    letters = np.array(words, "S4").view(np.uint8).reshape(-1, 4)
    a = Acceptor(letters, np.full(len(words), 4), np.array([0]))
    rights = {frozenset(v[k:] for v in words if v[:k] == w[:k]) for w in words for k in range(5)}
    assert len(a.final) == len(rights)
    for n, w in enumerate(words):
        state, number = a.root[0], 0
        for c in w:
            edge = int(np.searchsorted(a.key, state * 256 + c))
            number += a.before[edge]
            state = a.target[edge]
        assert number == n and a.final[state]


def test_pairs_of_dense_sets_are_met_once():
    import itertools

    words = [bytes(w) for k in (7, 8) for w in itertools.product(b"ab", repeat=k)]
    n = np.arange(1, len(words) + 1)
    total = Counter()
    for side in (0, 1):
        by_cut = 3 if side == 0 else 4
        held, count, _ = near_in_chunk(words, n, 7, side, by_cut, False)
        for i, c in zip(held, count):
            total[i] += c
    want = Counter()
    for i, j in itertools.combinations(range(len(words)), 2):
        u, v = words[i].decode(), words[j].decode()
        if min(len(u), len(v)) == 7 and near(u, v):
            want[i] += 1
            want[j] += 1
    assert total == want


def test_empty_table(spark):
    frame = spark.createDataFrame([(1, "abcdefg abcdefg")], "doc_id long, text string")
    assert spelling_variants(frame.limit(0)).count() == 0
    assert [tuple(r) for r in spelling_variants(frame).collect()] == list(expected([(1, "abcdefg abcdefg")]))
