"""A direct dense version of the model on small matrices, for comparison only."""

import math

import numpy as np


class Dense:
    def __init__(self, x, w, config):
        x, self.w, self.config = np.array(x, float), np.array(w, float), config
        if config.normalise:
            span = np.ptp(x, axis=0)
            x = np.where(span > 0, (x - x.min(axis=0)) / np.where(span > 0, span, 1), 0.0)
        hidden = self.w != 1
        count = hidden.sum(axis=0)
        safe = np.maximum(count, 1)
        self.nu = np.where(hidden, x, 0).sum(axis=0) / safe
        self.s2 = np.where(hidden, (x - self.nu) ** 2, 0).sum(axis=0) / safe
        self.y = self.w * x + (1 - self.w) * self.nu
        self.corr = self.w * x**2 + (1 - self.w) * (self.nu**2 + self.s2) - self.y**2
        q = self.w.sum(axis=1)
        self.params = q * (q + 1) / 2 + q + 1
        self.n, self.d = x.shape

    def covariance(self, members):
        y, prior = self.y[members], self.config.prior_point
        mean = y.mean(axis=0)
        free = self.w[members].sum(axis=0) >= self.config.points_for_cluster_mask
        full = (y - mean).T @ (y - mean)
        full[~free, :] = 0
        full[:, ~free] = 0
        full += np.diag(self.corr[members].sum(axis=0) + prior * self.s2)
        return mean, full / (members.sum() + prior - 1)

    def models(self, classes):
        alive = sorted(set(classes.tolist()) | {0})
        total = self.n + self.config.noise_point + self.config.prior_point * (len(alive) - 1)
        out = {}
        for c in alive:
            members = classes == c
            if c == 0:
                out[0] = ((members.sum() + self.config.noise_point) / total, None, None)
                continue
            mean, cov = self.covariance(members)
            if np.linalg.eigvalsh(cov).min() > 1e-300 and np.linalg.matrix_rank(cov) == self.d:
                out[c] = ((members.sum() + self.config.prior_point) / total, mean, cov)
        return out

    def score(self, model):
        weight, mean, cov = model
        if mean is None:
            return np.full(self.n, -math.log(weight))
        inverse = np.linalg.inv(cov)
        r = self.y - mean
        square = np.einsum("ni,ij,nj->n", r, inverse, r) + self.corr @ np.diag(inverse)
        return square / 2 + np.linalg.slogdet(cov)[1] / 2 - math.log(weight) + self.d * math.log(2 * math.pi) / 2

    def penalty(self, classes):
        out = {}
        for c in set(classes.tolist()):
            mean = self.params[classes == c].mean()
            out[c] = self.config.penalty_k * 2 * mean + self.config.penalty_k_log_n * mean * math.log(self.n) / 2
        return out

    def step(self, classes, delete=True):
        """New classes, deleted class, raw score, penalty."""
        models = self.models(classes)
        ids = sorted(models)
        scores = np.stack([self.score(models[c]) for c in ids], axis=1)
        order = np.argsort(scores, axis=1, kind="stable")
        ids = np.array(ids)
        new = ids[order[:, 0]]
        rows = np.arange(self.n)
        best = scores[rows, order[:, 0]]
        if scores.shape[1] > 1:
            second, runner = ids[order[:, 1]], scores[rows, order[:, 1]]
        else:
            second, runner = np.zeros(self.n, int), scores[:, 0]
        gone = None
        if delete:
            penalty = self.penalty(new)
            loss = {c: (runner - best)[new == c].sum() - penalty.get(c, 0) for c in ids if c}
            if loss:
                c = min(loss, key=lambda k: (loss[k], k))
                if loss[c] < 0:
                    gone = c
                    moved = new == c
                    new = np.where(moved, second, new)
                    best = np.where(moved, runner, best)
        return new, gone, best.sum(), sum(self.penalty(new).values())

    def run(self, classes, most=100):
        classes, log, score, full, iteration = np.array(classes), [], 0.0, True, 0
        while True:
            new, gone, raw, penalty = self.step(classes)
            changed, old = int((new != classes).sum()), score
            score, classes, iteration = raw + penalty, new, iteration + 1
            log.append((gone, changed, raw, penalty))
            last = full
            full = (
                changed > self.config.changed_thresh * self.n or changed == 0
                or iteration % self.config.full_step_every == 0 or score > old
            )
            if (changed == 0 and last) or iteration > most:
                return classes, log
