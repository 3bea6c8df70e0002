"""A gated recurrent language model in numpy with a class-factored softmax.

Texts run in lanes: a lane is a row of texts one behind the other, every step takes one token of each
lane, and a lane's state is cleared where a text begins.  States pass from window to window, so a
text is scored as a whole; gradients stop at the window's begin.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

LANES = 512
WINDOW = 16
#: Tokens of a window from which on its gradient counts fully.
FULL_TOKENS = 4096


@dataclass
class Vocabulary:
    """Head words sorted into classes of about equal use; then one class for all other words and one
    for the end.  ``class_of`` and ``place`` are per token; the two last tokens are other and end."""

    class_of: np.ndarray
    place: np.ndarray
    log_class: np.ndarray
    log_word: np.ndarray  # class by place; -inf beyond a class

    @staticmethod
    def build(head_counts: np.ndarray, other: float, end: float, classes: int) -> Vocabulary:
        """``head_counts`` in falling order."""
        n = len(head_counts)
        # between even numbers of words and of tokens; rare ones count for more, or all would be in the last class
        weight = np.sqrt(np.maximum(head_counts, max(1e-9, head_counts.sum() / max(1, 16 * n))))
        share = np.cumsum(weight) - weight
        word_class = np.minimum((share / max(weight.sum(), 1e-9) * classes).astype(np.int64), classes - 1)
        class_of = np.concatenate([word_class, [classes, classes + 1]]).astype(np.int16)  # short numbers sort by radix
        first = np.searchsorted(word_class, np.arange(classes))
        place = np.concatenate([np.arange(n) - first[word_class], [0, 0]]).astype(np.int64)
        size = np.bincount(word_class, minlength=classes)
        total = np.bincount(word_class, head_counts, classes)
        log_word = np.full((classes, max(1, int(size.max(initial=1)))), -np.inf)
        if n:
            log_word[word_class, place[:n]] = np.log(head_counts) - np.log(total[word_class])
        mass = np.concatenate([total, [other, end]]) + 1e-3
        return Vocabulary(class_of, place, np.log(mass / mass.sum()), log_word)


@dataclass
class Weights:
    x: np.ndarray  # token by 3 gates: what the last token adds
    u: np.ndarray  # state by 3 gates
    b: np.ndarray  # 3 gates
    c: np.ndarray  # state by class
    cb: np.ndarray
    w: np.ndarray  # class by state by place
    wb: np.ndarray

    @staticmethod
    def start(vocabulary: Vocabulary, hidden: int, seed: int = 11) -> Weights:
        rng = np.random.default_rng(seed)
        normal = lambda *s: rng.normal(0, 0.3 / np.sqrt(s[-2]), s).astype(np.float32)
        tokens, classes = len(vocabulary.class_of), len(vocabulary.log_class)
        gates = rng.normal(0, 0.3, (tokens, 3 * hidden)).astype(np.float32)
        return Weights(
            gates, normal(hidden, 3 * hidden), np.zeros(3 * hidden, np.float32), 0.1 * normal(hidden, classes),
            vocabulary.log_class.astype(np.float32), 0.1 * normal(len(vocabulary.log_word), hidden, vocabulary.log_word.shape[1]),
            np.maximum(vocabulary.log_word, -30).astype(np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.reshape(-1) for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Weights:
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32, copy=False))
            at += a.size
        return Weights(*out)

    def bounded(self) -> bool:
        """Whether no input of a softmax can leave [-60, 60], as states are within [-1, 1]."""
        inner = np.abs(self.w).sum(axis=1) + np.abs(self.wb)
        outer = np.abs(self.c).sum(axis=0) + np.abs(self.cb)
        return bool(max(inner.max(initial=0), outer.max(initial=0)) < 60)


def lanes_of(lengths: np.ndarray, lanes: int = LANES) -> tuple[list[np.ndarray], int]:
    """Texts dealt to lanes, longest first to the shortest lane, so that lanes end together."""
    import heapq

    order = np.argsort(-lengths, kind="stable")
    count = max(1, min(lanes, len(lengths)))
    heap = [(0, lane) for lane in range(count)]
    out: list[list[int]] = [[] for _ in range(count)]
    for t in order.tolist():
        size, lane = heapq.heappop(heap)
        out[lane].append(t)
        heapq.heappush(heap, (size + int(lengths[t]), lane))
    return [np.array(x, np.int64) for x in out], max(s for s, _ in heap)


def lay_out(texts: list[np.ndarray], end: int, lanes: int = LANES):
    """(steps, lanes) arrays: input token, output token (-1 behind a lane's end), begin flags; and the texts of each lane."""
    lengths = np.array([len(t) for t in texts], np.int64)
    dealt, steps = lanes_of(lengths, lanes)
    dealt.sort(key=lambda x: -int(lengths[x].sum()))
    target = np.full((steps, len(dealt)), -1, np.int16)
    source = np.full((steps, len(dealt)), end, np.int16)
    begin = np.zeros((steps, len(dealt)), bool)
    for lane, some in enumerate(dealt):
        if not len(some):
            continue
        row = np.concatenate([texts[t] for t in some])
        target[: len(row), lane] = row
        source[1 : len(row), lane] = row[:-1]
        starts = np.cumsum(lengths[some]) - lengths[some]
        begin[starts, lane] = True
        source[starts, lane] = end
    return source, target, begin, dealt


def _product(w: np.ndarray, x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """``w @ x`` with every column rounded alike, whatever columns stand beside it, which BLAS does not promise;
    as fast for so few rows of ``x``.  One column alone would be added up in another order."""
    if x.shape[1] == 1:
        one = _product(w, np.repeat(x, 2, axis=1))[:, :1]
        if out is None:
            return one
        out[...] = one
        return out
    return np.einsum("ij,jk->ik", w, x, out=out)


def _log_softmax(x: np.ndarray, goal: np.ndarray, bounded: bool) -> np.ndarray:
    """Log probability of each column's ``goal``.  A bound on the inputs stands in for subtracting the maximum."""
    if not bounded:
        np.clip(x, -60, 60, out=x)
    at = x[goal, np.arange(x.shape[1])]
    return at - np.log(np.exp(x, out=x).sum(axis=0))


@dataclass
class _Saved:
    """What the backward pass needs of every step: state before, gates with the candidate's recurrent part, candidate."""

    h: np.ndarray
    rzs: np.ndarray
    n: np.ndarray


def rows_of(steps: np.ndarray) -> np.ndarray:
    """(steps, values, lanes) as one row of values per step and lane."""
    return np.ascontiguousarray(steps.transpose(0, 2, 1)).reshape(-1, steps.shape[1])


class Network:
    def __init__(self, vocabulary: Vocabulary, weights: Weights):
        # Freeing one large block tells the C allocator to keep freed memory of up to twice its size.  Else
        # it hands the arrays of every window back, and touching new pages costs as much as the arithmetic.
        np.empty(31 << 20, np.uint8)
        self.vocabulary, self.weights = vocabulary, weights
        self.hidden = weights.u.shape[0]
        self.classes = len(vocabulary.log_word)
        self.size = (vocabulary.log_word > -np.inf).sum(axis=1).tolist()

    def forward(self, source: np.ndarray, begin: np.ndarray, h: np.ndarray, keep: bool):
        """States after each step as (steps, state, lanes); with ``keep`` also what the backward pass needs.

        Lanes are the last axis everywhere in the loop, so that every gate is one contiguous block."""
        k, w = self.hidden, self.weights
        steps, lanes = source.shape
        states = np.empty((steps, k, lanes), np.float32)
        saved = _Saved(*(np.empty((steps, m, lanes), np.float32) for m in (k, 3 * k, k))) if keep else None
        gates = w.x + w.b
        gates[:, : 2 * k] *= 0.5
        given = np.empty((steps, 3 * k, lanes), gates.dtype)  # rows are gathered whole, then turned
        np.copyto(given, np.take(gates, source, axis=0, mode="clip").transpose(0, 2, 1))
        half = np.ascontiguousarray(w.u.T)
        half[: 2 * k] *= 0.5  # a logistic function is a hyperbolic tangent of half its argument
        starts, stay = begin.any(axis=1), (~begin).astype(np.float32)
        s, n = np.empty((3 * k, lanes), half.dtype), np.empty((k, lanes), np.float32)
        for t in range(steps):
            if keep:
                s, n = saved.rzs[t], saved.n[t]
                h = np.multiply(h, stay[t], out=saved.h[t])
                np.matmul(half, h, out=s)
            else:
                if starts[t]:
                    h = h * stay[t]
                _product(half, h, s)
            a, rz = given[t], s[: 2 * k]
            rz += a[: 2 * k]
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            np.multiply(rz[:k], s[2 * k :], out=n)
            n += a[2 * k :]
            np.tanh(n, out=n)
            h = np.subtract(h, n, out=states[t])
            h *= rz[k:]
            h += n
        return states, saved, states[-1].copy() if steps else h

    def _groups(self, kind: np.ndarray):
        """Head classes with the places of their rows, which are sorted by class."""
        ends = np.searchsorted(kind, np.arange(self.classes + 1, dtype=kind.dtype)).tolist()
        for c in range(self.classes):
            if ends[c + 1] > ends[c]:
                yield c, slice(ends[c], ends[c + 1])

    def log_probability(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of every target's class, and of the word within a head class."""
        v, w = self.vocabulary, self.weights
        kind, bounded = v.class_of[target], w.bounded()
        order = np.argsort(kind, kind="stable")
        columns, kind, place = np.ascontiguousarray(np.take(states, order, axis=0).T), kind[order], v.place[target[order]]
        inputs = _product(w.c.T, columns)
        inputs += w.cb[:, None]
        logs = _log_softmax(inputs, kind, bounded)
        for c, some in self._groups(kind):
            n = self.size[c]
            if n > 1:
                inputs = _product(w.w[c, :, :n].T, columns[:, some])
                inputs += w.wb[c, :n, None]
                logs[some] += _log_softmax(inputs, place[some], bounded)
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def gradients(self, source, target, begin, h) -> tuple[list[np.ndarray], np.ndarray, float, int]:
        v, w, k = self.vocabulary, self.weights, self.hidden
        states, saved, last = self.forward(source, begin, h, keep=True)
        steps, lanes = source.shape
        goal = target.reshape(-1)
        kind = np.where(goal >= 0, v.class_of[goal], len(v.log_class)).astype(np.int16)
        by_class = np.argsort(kind, kind="stable")[: int((goal >= 0).sum())]  # without the places behind a lane's end
        goal, kind = goal[by_class], kind[by_class]
        place, count = v.place[goal], len(goal)
        weight = max(count, FULL_TOKENS)  # the last texts of the longest lanes must not outweigh the rest
        # a one behind every state: the offsets are one more row of the weights
        flat = np.ones((steps * lanes, k + 1), w.c.dtype)
        flat[:, :k].reshape(steps, lanes, k)[...] = states.transpose(0, 2, 1)
        flat = np.take(flat, by_class, axis=0)
        outer, inner = np.vstack([w.c, w.cb]), np.concatenate([w.w, w.wb[:, None]], axis=1)
        bounded, picked = w.bounded(), np.empty(count, w.c.dtype)

        def slope(rows, weights, at):
            """Probabilities of the goals by ``weight``, and the derivative of the loss by the inputs of a softmax.  Rows are
            short, so a product with ones adds them up faster than a reduction."""
            p = rows @ weights
            if not bounded:
                np.clip(p, -60, 60, out=p)
            np.exp(p, out=p)
            total = p @ np.ones((p.shape[1], 1), p.dtype)
            total *= weight
            p /= total
            cells, at = p.reshape(-1), at + np.arange(0, p.size, p.shape[1])
            chosen = cells[at]
            cells[at] = chosen - 1 / weight
            return chosen, p

        chosen, d = slope(flat, outer, kind)
        loss = -float(np.log(np.maximum(chosen, 1e-40) * weight).sum())
        douter, found = flat.T @ d, d @ w.c.T
        dinner = np.zeros_like(inner)
        picked[:] = 1 / weight
        for c, some in self._groups(kind):
            n = self.size[c]
            if n > 1:
                x = flat[some]
                picked[some], d = slope(x, inner[c, :, :n], place[some])
                np.matmul(x.T, d, out=dinner[c, :, :n])
                found[some] += d @ w.w[c, :, :n].T
        loss -= float(np.log(np.maximum(picked, 1e-40) * weight).sum())
        dstate = np.zeros((steps * lanes, k), np.float32)
        dstate[by_class] = found
        dstate = np.ascontiguousarray(dstate.reshape(steps, lanes, k).transpose(0, 2, 1))
        # by row of gates, then step and lane: what the last token adds, and the recurrent part of the candidate
        da = np.empty((3 * k, steps, lanes), np.float32)
        ds = np.empty((k, steps, lanes), np.float32)
        r, z, n = saved.rzs[:, :k], saved.rzs[:, k : 2 * k], saved.n
        to_n = 1 - n * n
        left = 1 - z
        to_n *= left
        left *= z
        to_z = saved.h - n
        to_z *= left
        to_r = 1 - r
        to_r *= r
        to_r *= saved.rzs[:, 2 * k :]
        dh = np.zeros((k, lanes), np.float32)
        one = np.empty((3 * k, lanes), np.float32)
        starts, stay = begin.any(axis=1), (~begin).astype(np.float32)
        for t in range(steps - 1, -1, -1):
            dh += dstate[t]
            dn = np.multiply(dh, to_n[t], out=da[2 * k :, t])
            np.multiply(dn, to_r[t], out=one[:k])
            np.multiply(dh, to_z[t], out=one[k : 2 * k])
            np.multiply(dn, r[t], out=one[2 * k :])
            da[: 2 * k, t], ds[:, t] = one[: 2 * k], one[2 * k :]
            dh *= z[t]
            dh += w.u @ one
            if starts[t]:
                dh *= stay[t]
        da, ds = da.reshape(3 * k, -1), ds.reshape(k, -1)
        h = np.ascontiguousarray(saved.h.transpose(1, 0, 2)).reshape(k, -1)
        du = np.hstack([h @ da[: 2 * k].T, h @ ds.T])
        dx = np.zeros_like(w.x)
        token = source.reshape(-1)
        order = np.argsort(token, kind="stable")
        token = token[order]
        starts = np.flatnonzero(np.diff(token, prepend=-1))
        dx[token[starts]] = np.add.reduceat(np.take(da, order, axis=1), starts, axis=1).T
        return [dx, du, da.sum(axis=1), douter[:k], douter[k], dinner[:, :k], dinner[:, k]], last, loss, count


class Trainer:
    """Truncated backpropagation with AdaGrad; the result is the mean of the weights along the way, later
    ones counting more, so that the last few long texts do not decide it."""

    def __init__(self, network: Network, rate: float = 0.05):
        self.network, self.rate = network, rate
        self.flat = network.weights.flat().astype(np.float32)  # the network's weights are views of it
        network.weights = network.weights.filled(self.flat)
        self.squares = np.full_like(self.flat, 1e-6)
        self.total = np.zeros(len(self.flat))
        self.share, self.tokens, self.loss = 0.0, 0, 0.0

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.share if self.share else self.flat.astype(np.float64)

    def learn(self, texts: list[np.ndarray], end: int) -> None:
        """One pass over whole texts."""
        source, target, begin, _ = lay_out(texts, end)
        network, at = self.network, 0
        h = np.zeros((network.hidden, source.shape[1]), np.float32)
        held, wide = np.empty_like(self.flat), np.empty_like(self.total)
        while at < len(source):
            live = int((target[at] >= 0).sum())  # lanes are sorted, longest first
            some = slice(at, at + max(WINDOW, WINDOW * LANES // (8 * max(1, live))))
            h = np.ascontiguousarray(h[:, :live])
            got, h, loss, count = network.gradients(source[some, :live], target[some, :live], begin[some, :live], h)
            g = np.concatenate([a.reshape(-1) for a in got])
            np.clip(g, -1, 1, out=g)
            self.squares += np.multiply(g, g, out=held)
            g *= self.rate
            g /= np.sqrt(self.squares, out=held)
            self.flat -= g
            self.loss, self.tokens, at = self.loss + loss, self.tokens + count, some.stop
            weight = count * float(self.tokens)
            self.share += weight
            self.total += np.multiply(self.flat, weight, out=wide, dtype=np.float64)


def score(network: Network, texts: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log probability of every whole text."""
    source, target, begin, dealt = lay_out(texts, end)
    laid = np.concatenate(dealt)
    ends = np.cumsum([len(texts[t]) for t in laid.tolist()])
    first = np.array([sum(len(texts[t]) for t in some.tolist()) for some in dealt], np.int64)
    first = np.cumsum(first) - first  # of each lane among all tokens
    found = np.zeros(int(ends[-1]))
    h = np.zeros((network.hidden, source.shape[1]), np.float32)
    at = 0
    while at < len(source):
        live = int((target[at] >= 0).sum())
        some = slice(at, at + max(WINDOW, WINDOW * LANES // max(1, live)))
        states, _, h = network.forward(source[some, :live], begin[some, :live], np.ascontiguousarray(h[:, :live]), keep=False)
        goal = target[some, :live].reshape(-1)
        real = goal >= 0
        logs = network.log_probability(rows_of(states)[real], goal[real])
        found[(first[:live] + np.arange(at, at + len(states))[:, None]).reshape(-1)[real]] = logs
        at = some.stop
    out = np.empty(len(texts))
    out[laid] = np.add.reduceat(found, np.append(0, ends[:-1]))
    return out
