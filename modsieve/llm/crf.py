"""A two-state linear chain over words: fitting and exact inference on whole arrays.

State 1 is toxic, state 0 clean.  A word has a weight for state 1, the sum of the weights of its features; two
neighbouring states have one of four transition weights.  Before the first word the state is 0.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Features are hashed into so many weights.
WIDTH = 1 << 18
#: Words of a block; blocks of all texts are worked on side by side.
BLOCK = 64
#: Features of every word; unused places hold feature 0, whose weight stays 0.
FEATURES = 10


def word_features(word: str) -> list[int]:
    """Hashes of the word, its beginnings and its ends."""
    names = ["b", f"w{word}"]
    names += [f"p{word[:k]}" for k in range(3, 7) if len(word) >= k]
    names += [f"s{word[-k:]}" for k in range(2, 5) if len(word) > k]
    names += [f"l{min(len(word), 12)}"]
    return [1 + zlib.crc32(n.encode("utf-8", "surrogatepass")) % (WIDTH - 1) for n in names]


def feature_rows(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), FEATURES), np.int64)
    for k, word in enumerate(words):
        found = word_features(word)
        out[k, : len(found)] = found
    return out


class Chains:
    """Exact sums over all state sequences of many texts at once.

    A text is cut into blocks for the arithmetic alone: the product of the transfer matrices of a block is
    computed for all blocks side by side, the blocks of a text are then chained, and the states inside a block follow
    from what the chain brings to its two ends.  The result is that of one long forward-backward pass.
    """

    def __init__(self, scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray):
        self.sizes = sizes = np.asarray(sizes, np.int64)
        blocks = -(-sizes // BLOCK)
        self.first = np.cumsum(blocks) - blocks
        self.blocks = blocks
        n = int(blocks.sum())
        # place of every word in the table of blocks
        starts = np.cumsum(sizes) - sizes
        inside = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
        self.place = np.repeat(self.first * BLOCK, sizes) + inside
        table = np.zeros(n * BLOCK)
        table[self.place] = scores
        self.real = np.zeros(n * BLOCK, bool)
        self.real[self.place] = True
        self.energy, self.real = np.exp(np.clip(table, -50, 50)).reshape(n, BLOCK), self.real.reshape(n, BLOCK)
        self.step = np.exp(transitions)
        self._products()
        self._chain()

    def _products(self) -> None:
        """Transfer matrix of every block, scaled to a largest entry of one, and the logarithm of the scale."""
        n, a = len(self.energy), self.step
        m = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
        scale = np.zeros(n)
        for t in range(BLOCK):
            live = self.real[:, t]
            if not live.any():
                break
            new = m @ a
            new[:, :, 1] *= self.energy[:, t, None]
            top = new.max(axis=(1, 2))
            scale += np.where(live, np.log(top), 0)
            m = np.where(live[:, None, None], new / top[:, None, None], m)
        self.product, self.scale = m, scale

    def _chain(self) -> None:
        """What reaches the left and the right end of every block, and the log of each text's total."""
        n, docs = len(self.energy), len(self.sizes)
        self.left, self.right = np.zeros((n, 2)), np.ones((n, 2))
        alpha = np.tile([1.0, 0.0], (docs, 1))
        self.total = np.zeros(docs)
        order = np.argsort(-self.blocks, kind="stable")
        counts = self.blocks[order]
        for k in range(int(self.blocks.max(initial=0))):
            live = order[: np.searchsorted(-counts, -k, side="left")]
            at = self.first[live] + k
            self.left[at] = alpha[live]
            new = np.einsum("di,dij->dj", alpha[live], self.product[at])
            size = new.sum(1)
            self.total[live] += np.log(size) + self.scale[at]
            alpha[live] = new / size[:, None]
        beta = np.ones((docs, 2))
        for k in range(int(self.blocks.max(initial=0)) - 1, -1, -1):
            live = order[: np.searchsorted(-counts, -k, side="left")]
            at = self.first[live] + k
            self.right[at] = beta[live]
            new = np.einsum("dij,dj->di", self.product[at], beta[live])
            beta[live] = new / new.sum(1)[:, None]

    def _forward(self) -> np.ndarray:
        n, a = len(self.energy), self.step
        out = np.zeros((n, BLOCK, 2))
        alpha = self.left
        for t in range(BLOCK):
            new = alpha @ a
            new[:, 1] *= self.energy[:, t]
            alpha = np.where(self.real[:, t, None], new / new.sum(1, keepdims=True), alpha)
            out[:, t] = alpha
        return out

    def _backward(self) -> np.ndarray:
        n, a = len(self.energy), self.step
        out = np.zeros((n, BLOCK, 2))
        beta = self.right
        for t in range(BLOCK - 1, -1, -1):
            out[:, t] = beta
            weighted = beta.copy()
            weighted[:, 1] *= self.energy[:, t]
            new = weighted @ a.T
            beta = np.where(self.real[:, t, None], new / new.sum(1, keepdims=True), beta)
        return out

    def marginals(self) -> np.ndarray:
        """Probability of state 1 for every word."""
        both = self._forward() * self._backward()
        return (both[:, :, 1] / np.maximum(both.sum(2), 1e-300)).reshape(-1)[self.place]

    def clean_log_probability(self) -> np.ndarray:
        """Log probability that all words of a text are in state 0."""
        return np.minimum(self.sizes * np.log(self.step[0, 0]) - self.total, 0.0)

    def pair_sums(self) -> np.ndarray:
        """Expected number of each transition over all texts, the one into the first word included."""
        forward, backward = self._forward(), self._backward()
        before = np.concatenate([self.left[:, None], forward[:, :-1]], axis=1)
        after = backward.copy()
        after[:, :, 1] *= self.energy
        joint = before[..., :, None] * self.step * after[..., None, :]
        joint /= np.maximum(joint.sum((2, 3), keepdims=True), 1e-300)
        return joint[self.real].sum(0)


def fit(features: np.ndarray, sizes: np.ndarray, labels: np.ndarray, steps: int = 80, rate: float = 0.25, decay: float = 1e-4):
    """Weights and transitions that make the labelled states likely; ``features`` has a row per word of all texts.

    Gradients are expected minus seen counts; steps are scaled per weight by its past gradients.
    """
    weights, transitions = np.zeros(WIDTH), np.zeros((2, 2))
    step_squares = np.zeros((2, 2))
    if not len(labels):
        return weights.astype(np.float32), transitions
    used = np.unique(features)
    compact = np.searchsorted(used, features)
    first = np.cumsum(sizes) - sizes
    previous = np.concatenate([[0], labels[:-1]])
    previous[first[sizes > 0]] = 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (previous, labels), 1)
    small, grad2 = np.zeros(len(used)), np.zeros(len(used))
    for _ in range(steps):
        chains = Chains(small[compact].sum(1), sizes, transitions)
        wrong = chains.marginals() - labels
        gradient = np.bincount(compact.ravel(), np.repeat(wrong, features.shape[1]), len(used)) + decay * len(labels) * small
        if used[0] == 0:
            gradient[0] = 0
        grad2 += gradient**2
        small -= rate * gradient / np.sqrt(grad2 + 1e-8)
        turn = chains.pair_sums() - seen + decay * len(labels) * transitions
        step_squares += turn**2
        transitions = transitions - rate * turn / np.sqrt(step_squares + 1e-8)
    weights[used] = small
    return weights.astype(np.float32), transitions


def fit_logistic(inputs: np.ndarray, labels: np.ndarray, steps: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Weights, the constant last, of a ridge logistic regression by Newton steps; both classes weigh alike."""
    x = np.column_stack([inputs, np.ones(len(inputs))])
    w = np.zeros(x.shape[1])
    if not len(labels):
        return w
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (balance * p * (1 - p))[:, None]).T @ x + penalty
        move = np.linalg.solve(curve, x.T @ (balance * (p - labels)) + penalty @ w)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w
