"""A linear-chain conditional random field in numpy: sparse indicator features, batched inference.

A sequence is an integer array (steps, slots) of feature numbers; equal slots hold one kind of feature each and
`n_features` stands for "none". Training maximises the penalised log likelihood by Adam on the whole table;
decoding is Viterbi over a padded batch of sequences, one numpy step per position.
"""

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def pad(sequences: list[np.ndarray], none: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences])
    slots = sequences[0].shape[1]
    out = np.full((len(sequences), max(int(lengths.max()), 1), slots), none, np.int32)
    for k, s in enumerate(sequences):
        out[k, : len(s)] = s
    return out, lengths


class Chain:
    def __init__(self, n_features: int, n_labels: int):
        self.n = n_features
        self.emit = np.zeros((n_features + 1, n_labels))
        self.move = np.zeros((n_labels, n_labels))
        self.first = np.zeros(n_labels)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.emit[x].sum(2)

    def decode(self, sequences: list[np.ndarray], batch: int = 512) -> list[np.ndarray]:
        """The best labels of each sequence. Sequences of like length go together, so that padding stays small."""
        out: list = [np.zeros(0, np.int8)] * len(sequences)
        order = sorted((k for k in range(len(sequences)) if len(sequences[k])), key=lambda k: len(sequences[k]))
        start = 0
        while start < len(order):
            stop = min(start + batch, len(order))
            while stop > start + 1 and len(sequences[order[stop - 1]]) * (stop - start) > 200_000:
                stop = start + max(1, (stop - start) // 2)
            group = order[start:stop]
            start = stop
            x, lengths = pad([sequences[k] for k in group], self.n)
            s = self.scores(x)
            b, t, y = s.shape
            best = self.first + s[:, 0]
            back = np.zeros((t, b, y), np.int8)
            tail = np.where((lengths == 1)[:, None], best, 0)
            for i in range(1, t):
                via = best[:, :, None] + self.move
                back[i] = via.argmax(1)
                best = via.max(1) + s[:, i]
                tail = np.where((lengths == i + 1)[:, None], best, tail)
            path = np.zeros((b, t), np.int8)
            now = tail.argmax(1)
            rows = np.arange(b)
            for i in range(t - 1, -1, -1):
                ends = lengths == i + 1
                now = np.where(ends, tail.argmax(1), now)
                path[:, i] = now
                if i:
                    now = np.where(i < lengths, back[i, rows, now], now)
            for r, k in enumerate(group):
                out[k] = path[r, : lengths[r]]
        return out

    def decode_blocks(self, blocks, n: int) -> np.ndarray:
        """The best labels of one sequence of n steps that comes in blocks; holds one byte a label and step."""
        back, best, i = np.zeros((n, len(self.first)), np.int8), None, 0
        labels = np.arange(len(self.first))
        for block in blocks:
            for s in self.scores(block[None])[0]:
                if best is None:
                    best = self.first + s
                else:
                    via = best[:, None] + self.move
                    back[i] = via.argmax(0)
                    best = via[back[i], labels] + s
                i += 1
        path = np.zeros(n, np.int8)
        now = int(best.argmax()) if n else 0
        for i in range(n - 1, -1, -1):
            path[i] = now
            now = back[i, now]
        return path

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = 120, rate: float = 0.15, penalty: float = 0.02):
        x, lengths = pad(sequences, self.n)
        b, t, slots = x.shape
        y = self.move.shape[0]
        gold = np.zeros((b, t), np.int64)
        for k, g in enumerate(labels):
            gold[k, : len(g)] = g
        on = np.arange(t)[None] < lengths[:, None]
        one = np.eye(y)[gold] * on[..., None]
        pairs = np.einsum("bti,btj->ij", one[:, :-1], one[:, 1:])
        flat = x.reshape(-1)
        theta = [self.emit, self.move, self.first]
        m = [np.zeros_like(p) for p in theta]
        v = [np.zeros_like(p) for p in theta]
        for step in range(1, steps + 1):
            s = self.scores(x)
            a = np.zeros((b, t, y))
            z = np.zeros((b, t, y))
            a[:, 0] = self.first + s[:, 0]
            for i in range(1, t):
                a[:, i] = np.where(on[:, i, None], _lse(a[:, i - 1, :, None] + self.move, 1) + s[:, i], a[:, i - 1])
            for i in range(t - 2, -1, -1):
                z[:, i] = np.where(on[:, i + 1, None], _lse(self.move + (s[:, i + 1] + z[:, i + 1])[:, None, :], 2), 0)
            total = _lse(a[:, -1], 1)
            p = np.exp(a + z - total[:, None, None]) * on[..., None]
            moved = np.zeros((y, y))
            for i in range(1, t):
                both = a[:, i - 1, :, None] + self.move + (s[:, i] + z[:, i])[:, None, :] - total[:, None, None]
                moved += (np.exp(both) * on[:, i, None, None]).sum(0)
            diff = (one - p).reshape(-1, y)
            up = np.stack([np.bincount(flat, np.repeat(diff[:, j], slots), self.n + 1) for j in range(y)], 1)
            up[-1] = 0
            for q, g, mm, vv in zip(theta, (up, pairs - moved, (one - p)[:, 0].sum(0)), m, v, strict=True):
                g = g - penalty * q
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                q += rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
        return self


class Index:
    """Feature strings to numbers; grows while fitting, then unknown strings count as none."""

    def __init__(self):
        self.of: dict[str, int] = {}
        self.open = True

    def __call__(self, name: str) -> int:
        if self.open:
            return self.of.setdefault(name, len(self.of))
        return self.of.get(name, len(self.of))

    def rows(self, steps: list[list[str]]) -> np.ndarray:
        if not steps:
            return np.zeros((0, 1), np.int32)
        return np.array([[self(f) for f in fs] for fs in steps], np.int32)
