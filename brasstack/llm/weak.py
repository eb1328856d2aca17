"""Small numpy models shared by the weakly supervised classifiers: they see bounded inputs only."""

from __future__ import annotations

import numpy as np

#: Correlation within a class from which two voters share their evidence.
CORRELATED = 0.5
#: How much oftener a voter is taken to fire on label 1 before anything is estimated.
START = 100.0


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class Sparse:
    """Rows of (index, value) pairs, as three arrays."""

    def __init__(self, rows: list[list[int]], width: int, values: list[list[float]] | None = None):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([i for r in rows for i in r], np.int64)
        self.val = np.ones(len(self.col)) if values is None else np.array([v for r in values for v in r], float)

    def dot(self, w):
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def tdot(self, r):
        return np.bincount(self.col, self.val * r[self.row], self.width)


def logistic(x: Sparse, soft: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, l1: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels: accelerated proximal gradient, deterministic."""
    k = np.ones(x.n) if weight is None else weight
    k = k / max(k.sum(), 1e-9)
    w = v = np.zeros(x.width)
    b = c = 0.0
    size = np.bincount(x.row, np.abs(x.val), x.n) + 1.0  # of each row with its bias
    own = Sparse.__new__(Sparse)
    own.n, own.width, own.row, own.col, own.val = x.n, x.width, x.row, x.col, np.abs(x.val)
    rate = 1.0 / (0.25 * own.tdot(k * size) + l2 + 1e-6)  # bounds the curvature along each weight
    rate_b = 1.0 / (0.25 * (k * size).sum() + 1e-6)
    for t in range(steps):
        r = k * (sigmoid(x.dot(v) + c) - soft)
        w2, b2 = v - rate * (x.tdot(r) + l2 * v), c - rate_b * r.sum()
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * l1, 0)
        m = t / (t + 3)
        v, c, w, b = w2 + m * (w2 - w), b2 + m * (b2 - b), w2, b2
    return w, b


def unlike(votes: np.ndarray, most: int, limit: float = 0.8) -> list[int]:
    """Columns of a 0/1 matrix, in order, each correlated under limit with all before it; at most `most`."""
    sd = votes.std(0).clip(1e-9)
    r = (votes - votes.mean(0)) / sd / np.sqrt(max(len(votes), 1))
    out: list[int] = []
    for j in range(votes.shape[1]):
        if len(out) < most and (not out or (r[:, out].T @ r[:, j]).max() < limit):
            out.append(j)
    return out


def label_model(votes: np.ndarray, prior: float, rounds: int = 40) -> tuple[np.ndarray, dict]:
    """Posterior of label 1 from 0/1 votes (rows by voters) alone, with the model's figures.

    A generative model by expectation-maximisation: voters fire at a rate for each class (their accuracies), rows on
    which none fires are a vote of their own, a voter that doesn't fire abstains. Correlations that remain between two
    voters within a class are estimated from the posterior; a voter's evidence is divided by its correlated mass, so that
    near-copies of one voter count once. prior is the share of label 1. It starts from voters that are all taken to
    fire START times as often on label 1, those that fire together counted as one; no label of a row is given to it.
    """
    votes = np.column_stack([votes, votes.sum(1) == 0]).astype(float)
    n, m = votes.shape
    both = votes.T @ votes
    alike = both / np.sqrt(np.outer(np.diag(both), np.diag(both))).clip(1e-9)
    share = 1 / np.where(alike > CORRELATED, alike, 0).sum(1).clip(1.0)
    lean = np.full(m, np.log(START))
    lean[-1] = -lean[-1]
    post = sigmoid(np.log(prior / (1 - prior)) + votes @ (share * lean))
    corr = np.eye(m)
    on = off = np.full(m, 0.5)
    for t in range(rounds):
        a, b = post.sum() + 1e-9, (1 - post).sum() + 1e-9
        on, off = (votes.T @ post + 0.5) / (a + 1), (votes.T @ (1 - post) + 0.05) / (b + 1)
        on = np.maximum(on, 1.2 * off)  # voters are known to lean to label 1,
        on[-1] = min(on[-1], 0.8 * off[-1])  # silence to label 0
        if t % 5 == 0:
            corr = np.zeros((m, m))
            for weight, rate in ((post, on), (1 - post, off)):
                r = (votes - rate) * np.sqrt(weight / weight.sum().clip(1e-9))[:, None]
                cov = r.T @ r
                sd = np.sqrt(np.diag(cov).clip(1e-12))
                corr = np.maximum(corr, cov / sd[:, None] / sd[None, :])
            np.fill_diagonal(corr, 1.0)
            corr[-1, :-1] = corr[:-1, -1] = 0.0  # silence excludes the others; it repeats none
            share = 1 / np.where(corr > CORRELATED, corr, 0).sum(1).clip(1.0)
        post = sigmoid(np.log(prior / (1 - prior)) + votes @ (share * np.log(on / off)))
    return post, {"fires_on": on, "fires_off": off, "correlations": corr, "share": share}


def dawid_skene(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of class 1 for each vote pattern (values 0 against, 1 for, 2 abstains), accuracies, prior.

    Expectation-maximisation over pattern counts, so its input is bounded however many documents there are.
    It starts from the majority of each pattern, with a mild pull to labellers that beat chance.
    """
    n = counts.astype(float)
    up, down = (patterns == 1), (patterns == 0)
    post = sigmoid(1.5 * (up.sum(1) - 3.0 * down.sum(1)))
    prior, m = 0.8, patterns.shape[1]
    rates = np.full((2, m, 3), 1 / 3)
    for _ in range(rounds):
        for k, w in ((1, post * n), (0, (1 - post) * n)):
            for j in range(m):
                c = np.array([w[patterns[:, j] == v].sum() for v in range(3)]) + (np.array([1.0, 4.0, 4.0]) if k else np.array([4.0, 1.0, 4.0]))
                rates[k, j] = c / c.sum()
        prior = float(np.clip((post * n).sum() / max(n.sum(), 1e-9), 0.01, 0.99))
        s = np.full(len(n), np.log(prior / (1 - prior)))
        for j in range(m):
            s += np.log(rates[1, j][patterns[:, j]]) - np.log(rates[0, j][patterns[:, j]])
        post = sigmoid(s)
    return post, rates, prior
