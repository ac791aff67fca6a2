"""A linear-chain conditional random field over three tags, in numpy.

A token's score for a tag is a sum of table entries, one for each feature; tag
``OUT`` scores 0.  Transition weights are finite for every pair of tags, and
the tag before the first and after the last token is ``OUT``.  Training
maximises the log-likelihood of padded windows by forward-backward and Adagrad.
"""

from __future__ import annotations

import numpy as np

OUT, BEGIN, IN = 0, 1, 2


class Crf:
    """``sizes``: entries of the table of each feature."""

    def __init__(self, sizes: list[int]):
        self.tables = [np.zeros((n, 2), np.float32) for n in sizes]  # BEGIN, IN
        self.moves = np.zeros((3, 3))

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        """(tokens, 2): scores of BEGIN and IN."""
        total = self.tables[0][features[0]]
        for t, f in zip(self.tables[1:], features[1:], strict=True):
            total += t[f]
        return total

    def slack(self) -> float:
        """The most that a path can gain by its transitions when one of its tokens is not OUT."""
        m = self.moves
        return max(m[a, x] + m[x, b] - m[a, OUT] - m[OUT, b] for a in range(3) for b in range(3) for x in (BEGIN, IN))

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """Best tags of a sequence of (BEGIN, IN) scores."""
        m = self.moves.tolist()
        best, back = [0.0, -1e30, -1e30], []
        for b, i in scores.tolist():
            step, new = [], []
            for tag, own in ((OUT, 0.0), (BEGIN, b), (IN, i)):
                values = [best[a] + m[a][tag] for a in range(3)]
                a = max(range(3), key=values.__getitem__)
                step.append(a)
                new.append(values[a] + own)
            back.append(step)
            best = new
        tag = max(range(3), key=lambda t: best[t] + m[t][OUT])
        tags = []
        for step in reversed(back):
            tags.append(tag)
            tag = step[tag]
        return tags[::-1]

    def decode(self, features: list[np.ndarray], ends: np.ndarray) -> list[tuple[int, int]]:
        """(first, last token + 1) of the tagged spans of sequences that end before the tokens ``ends``.

        A token whose best score stays below zero by more than ``slack`` is OUT on
        every best path.  It parts the sequence exactly, so only the tokens
        between such ones go through the dynamic programme.
        """
        scores = self.scores(features)
        open_ = np.flatnonzero(scores.max(axis=1) + self.slack() >= 0)
        if not len(open_):
            return []
        sequence = np.searchsorted(ends, open_, "right")
        cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(sequence) > 0)) + 1
        spans = []
        for part in np.split(open_, cut):
            first = int(part[0])
            begun = None
            for k, tag in enumerate(self.viterbi(scores[part])):
                if begun is not None and tag != IN:
                    spans.append((begun, first + k))
                    begun = None
                if tag == BEGIN or tag == IN and begun is None:
                    begun = first + k
            if begun is not None:
                spans.append((begun, int(part[-1]) + 1))
        return spans

    def fit(self, features: np.ndarray, tags: np.ndarray, real: np.ndarray, rounds: int = 60, rate: float = 0.3, decay: float = 2e-5) -> float:
        """``features`` (windows, tokens, tables), ``tags`` and ``real`` (windows, tokens); returns the mean loss of a token."""
        n, length, _ = features.shape
        flat = [features[real][:, j] for j in range(features.shape[2])]
        gold = tags[real]
        tables = [t.astype(np.float64) for t in self.tables]
        seen = [np.full_like(t, 1e-6) for t in tables]
        moves, seen_moves = self.moves.copy(), np.full((3, 3), 1e-6)
        before = np.concatenate([np.zeros((n, 1), tags.dtype), tags[:, :-1]], axis=1)
        last = tags[np.arange(n), real.sum(axis=1) - 1]
        gold_moves = np.zeros((3, 3))
        np.add.at(gold_moves, (before[real], gold), 1)
        np.add.at(gold_moves, (last, np.full(n, OUT)), 1)
        size, loss = int(real.sum()), 0.0
        for _ in range(rounds):
            own = np.zeros((n, length, 3))
            own[real, 1:] = sum(t[f] for t, f in zip(tables, flat, strict=True))
            gain, step = np.exp(own - own.max(axis=2, keepdims=True)), np.exp(moves)
            alpha, scale = np.zeros((n, length, 3)), np.ones((n, length))
            at = np.tile(np.array([1.0, 0, 0]), (n, 1))
            for t in range(length):
                new = (at @ step) * gain[:, t]
                total = new.sum(axis=1)
                live = real[:, t]
                scale[live, t] = total[live]
                at = np.where(live[:, None], new / total[:, None], at)
                alpha[:, t] = at
            close = at @ step[:, OUT]
            beta = step[:, OUT][None, :] / close[:, None]
            tag_p, move_p = np.zeros((n, length, 3)), np.zeros((3, 3))
            final = at * beta
            move_p[:, OUT] += final.sum(axis=0)
            for t in range(length - 1, -1, -1):
                live = real[:, t]
                tag_p[live, t] = (alpha[:, t] * beta)[live]
                prev = alpha[:, t - 1] if t else np.tile(np.array([1.0, 0, 0]), (n, 1))
                right = gain[:, t] * beta / scale[:, t][:, None]
                move_p += (prev[live].T @ right[live]) * step
                beta = np.where(live[:, None], right @ step.T, beta)
            own_max = own.max(axis=2)
            gold_score = np.take_along_axis(own, tags[:, :, None], axis=2)[:, :, 0][real].sum() + (gold_moves * moves).sum()
            loss = (np.log(scale).sum() + own_max[real].sum() + np.log(close).sum() - gold_score) / size
            off = tag_p[real][:, 1:] - np.stack([gold == BEGIN, gold == IN], axis=1)
            for t, s, f in zip(tables, seen, flat, strict=True):
                g = np.stack([np.bincount(f, off[:, k], len(t)) for k in (0, 1)], axis=1) / size + decay * t
                s += g * g
                t -= rate * g / np.sqrt(s)
            g = (move_p - gold_moves) / size + decay * moves
            seen_moves += g * g
            moves -= rate * g / np.sqrt(seen_moves)
        self.tables, self.moves = [t.astype(np.float32) for t in tables], moves
        return float(loss)
