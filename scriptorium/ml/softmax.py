"""Multinomial logistic regression over ``tokens.token_groups``: the model that Spark ML's ``LogisticRegression`` fits, step for step.

A pass over the tokens is numpy on pieces that stay in a core's cache: each word of a group is
looked up once among the weights, each word of a piece once among those of the group.  The sums of a pass
meet by blocks of features, as in ``linear``; the driver takes the steps of Breeze's L-BFGS.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .linear import BLOCK, _added
from .tokens import BETWEEN, PIECE, ROLES, pieces_of

_SUMS = "block int, sums binary"
#: Bytes of weights up to which the files of all passes may stay.
_SMALL = 1 << 20


@dataclass
class Model:
    """``weights`` (features, classes) and ``intercepts``; the last class stands for an unknown label."""

    weights: np.ndarray
    intercepts: np.ndarray
    history: list[float]


@dataclass
class _Counts:
    """By feature: occurrences with each class and sum of squares; by class: tokens."""

    by_class: np.ndarray
    squares: np.ndarray
    tokens: np.ndarray


def _blocks(first: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    """``first`` by blocks of rows, those without a number left out; ``rest`` is block -1."""
    found = [(b // BLOCK, first[b : b + BLOCK].tobytes()) for b in range(0, len(first), BLOCK) if first[b : b + BLOCK].any()]
    found.append((-1, rest.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([s for _, s in found], pa.binary())], ["block", "sums"])


def _met(parts: DataFrame, features: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    total, rest = np.zeros((features, width)), np.zeros(0)
    for r in parts.groupBy("block").applyInArrow(_added, _SUMS).collect():
        sums = np.frombuffer(bytes(r["sums"]))
        if r["block"] < 0:
            rest = sums
        else:
            part = sums.reshape(-1, width)
            total[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return total, rest


def _counter(place: dict, classes: int, features: int):
    def run(batches):
        sums, tokens = np.zeros((features, classes + 1)), np.zeros(classes)
        some = False
        for batch in batches:
            for i in range(batch.num_rows):
                some = True
                words = np.frombuffer(batch.column("words")[i].as_buffer(), np.int32).reshape(-1, len(ROLES))
                tags = np.frombuffer(batch.column("tags")[i].as_buffer(), np.int16)
                number = np.array([*(place.get(t, classes - 1) for t in batch.column("names")[i].as_py()), classes - 1], np.int64)
                done = 1
                counts = np.zeros((len(words) * len(ROLES), classes))
                for own, line in pieces_of(batch, i):
                    n = len(line) - 2
                    inside = np.flatnonzero(tags[done : done + n] >= 0)
                    y, at = number[tags[done : done + n][inside]], own[line].astype(np.int64)
                    done += n
                    tokens += np.bincount(y, minlength=classes)
                    at = [at[inside + 1] * 3, at[inside] * 3 + 1, at[inside + 2] * 3 + 2]
                    for a in at:
                        np.add.at(counts.reshape(-1), a * classes + y, 1.0)
                    f = [words.reshape(-1)[a] for a in at]
                    for a, b in ((0, 1), (0, 2), (1, 2)):  # two features of a token that meet in one place
                        np.add.at(sums[:, classes], f[a][f[a] == f[b]], 2.0)
                for k in range(classes):
                    sums[:, k] += np.bincount(words.ravel(), counts[:, k], features)
        if some:
            yield _blocks(sums, tokens)

    return run


def counted(groups: DataFrame, labels: list[str], features: int) -> _Counts:
    classes = len(labels) + 1
    columns = groups.select("words", "line", "own", "sizes", "tags", "names")
    sums, tokens = _met(columns.mapInArrow(_counter({t: k for k, t in enumerate(labels)}, classes, features), _SUMS), features, classes + 1)
    by_class = sums[:, :classes].copy()
    return _Counts(by_class, by_class.sum(axis=1) + sums[:, classes], tokens if len(tokens) else np.zeros(classes))


def _exps(margins: np.ndarray, into: np.ndarray, top: np.ndarray) -> np.ndarray:
    """exp(margin - largest one) by class in ``into``, the largest ones in ``top``; returns the sums."""
    into[:] = margins.T
    np.max(into, axis=0, out=top)
    into -= top
    np.exp(into, out=into)
    return into.sum(axis=0)


def margins(own: np.ndarray, at: np.ndarray, into: np.ndarray, more: np.ndarray) -> None:
    """Adds up the rows of ``own`` (words x roles, classes) of each token: its word's, the one's before and the one's after; ``at`` are the words' first rows."""
    np.take(own, at[1:-1], axis=0, out=into, mode="clip")
    for r, side in ((1, at[:-2]), (2, at[2:])):
        np.take(own, side + r, axis=0, out=more, mode="clip")
        into += more


def _expected(sent, features: int):
    """Sums, by feature and class but the last, of the probabilities of the tokens it occurs in, and the sum of the log normalisers."""

    def run(batches):
        weights, intercepts = sent.value
        classes, roles = weights.shape[1], len(ROLES)
        free = classes - 1  # those of the last class are what the others leave
        total, loss, some = np.zeros((features, free)), 0.0, False
        # made once, as new memory for each piece costs more than the sums
        into, more, by_class, top = np.empty((PIECE, classes)), np.empty((PIECE, classes)), np.empty((classes, PIECE)), np.empty(PIECE)
        near, part, sum_ = np.empty((PIECE + 2, roles * classes)), np.empty((PIECE + 2, roles * free)), np.empty((PIECE + 2, roles * free))
        rows, p = np.empty(roles * PIECE, np.intp), np.empty(roles * PIECE)
        for batch in batches:
            for i in range(batch.num_rows):
                some = True
                words = np.frombuffer(batch.column("words")[i].as_buffer(), np.int32).reshape(-1, roles)
                table = np.take(weights, words.ravel(), axis=0).reshape(len(words), -1)
                table[:, :classes] += intercepts
                sums = np.zeros((len(words), roles * free))
                for own, line in pieces_of(batch, i):
                    n, found, own = len(line) - 2, len(own), own.astype(np.intp)
                    at = line.astype(np.intp) * roles
                    np.take(table, own, axis=0, out=near[:found], mode="clip")
                    margins(near[:found].reshape(-1, classes), at, into[:n], more[:n])
                    e, t = by_class[:, :n], top[:n]
                    size = _exps(into[:n], e, t)
                    t += np.log(size)
                    np.divide(1.0, size, out=size)
                    if own[0] == BETWEEN:
                        between = np.flatnonzero(line[1:-1] == 0)
                        t[between] = size[between] = 0.0
                    loss += t.sum()
                    rows[:n] = at[1:-1]
                    np.add(at[:-2], 1, out=rows[n : 2 * n])
                    np.add(at[2:], 2, out=rows[2 * n : 3 * n])
                    each = part[:found].reshape(-1, free)
                    for k in range(free):
                        np.multiply(e[k], size, out=p[:n])
                        p[n : 2 * n] = p[2 * n : 3 * n] = p[:n]
                        each[:, k] = np.bincount(rows[: 3 * n], p[: 3 * n], len(each))
                    np.take(sums, own, axis=0, out=sum_[:found], mode="clip")
                    sum_[:found] += part[:found]
                    sums[own] = sum_[:found]
                sums = sums.reshape(-1, free)
                for k in range(free):
                    total[:, k] += np.bincount(words.ravel(), sums[:, k], features)
        if some:
            yield _blocks(total, np.array([loss]))

    return run


class _Objective:
    """Mean log loss + reg / 2 |w|^2 of scaled, centred features and its gradient; (features + 1, classes), the last row the intercepts."""

    def __init__(self, groups: DataFrame, counts: _Counts, reg: float):
        spark = groups.sparkSession
        self.rows = groups.select("words", "line", "own", "sizes").coalesce(2 * spark.sparkContext.defaultParallelism)  # a few tasks make sums as wide as the weights, however many groups there are
        self.spark, self.counts, self.reg = spark, counts, reg
        self.n = counts.tokens.sum()
        self.each = each = counts.by_class.sum(axis=1)
        mean = each / self.n
        spread = np.sqrt(np.maximum((counts.squares - each * mean) / (self.n - 1), 0)) if self.n > 1 else np.zeros(len(each))
        self.scale = np.divide(1, spread, out=np.zeros(len(each)), where=spread > 0)[:, None]
        self.centre = mean[:, None] * self.scale
        self.seen = None, None

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and intercepts for features as they are."""
        return x[:-1] * self.scale, x[-1] - self.centre[:, 0] @ x[:-1]

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        if self.seen[0] is not None and np.array_equal(self.seen[0], x):
            return self.seen[1]
        weights, intercepts = self.raw(x)
        sent = self.spark.sparkContext.broadcast((weights, intercepts))
        expected, loss = _met(self.rows.mapInArrow(_expected(sent, len(weights)), _SUMS), len(weights), weights.shape[1] - 1)
        sent.destroy()
        if x.nbytes > _SMALL:
            gc.collect()
            self.spark._jvm.System.gc()  # Spark drops the files of a shuffle when the driver forgets it; each pass leaves as many as the tasks' sums
        counts, gradient = self.counts, np.empty_like(x)
        off = gradient[:-1]  # in place: a copy is as large as the weights
        off[:, :-1] = expected
        off[:, -1] = self.each - expected.sum(axis=1)
        del sent, expected
        off -= counts.by_class
        tokens = off.sum(axis=0) / len(ROLES)
        value = (loss[0] - np.einsum("ij,ij->", counts.by_class, weights) - counts.tokens @ intercepts) / self.n
        del weights
        off *= self.scale
        off -= self.centre * tokens
        off /= self.n
        off += self.reg * x[:-1]
        gradient[-1] = tokens / self.n
        self.seen = x, (value + self.reg / 2 * float(np.vdot(x[:-1], x[:-1])), gradient)
        return self.seen[1]


class _Failed(Exception):
    pass


def _between(a: tuple, b: tuple) -> float:
    """Least point of the cubic through two points of a line search, not too near either."""
    (x, f, d), (y, g, e) = (a, b) if a[0] <= b[0] else (b, a)
    d1 = d + e - 3 * (f - g) / (x - y)
    d2 = np.sqrt(d1 * d1 - d * e)
    t = y - (y - x) * (e + d2 - d1) / (e - d + 2 * d2)
    low, high = x + 0.1 * (y - x), x + 0.9 * (y - x)
    return low if t < low else high if t > high else t


def _line_search(phi, t: float, c1: float = 1e-4, c2: float = 0.9, most: int = 10) -> float:
    """A step that meets the strong Wolfe conditions (Nocedal and Wright, as Breeze has it); ``phi(t)`` is (t, value, slope)."""
    start = low = phi(0.0)
    _, value, slope = start
    if slope > 0:
        raise _Failed

    def zoom(low, high):
        for _ in range(most):
            c = phi(_between(low, high))
            if c[1] > value + c1 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= c2 * abs(slope):
                    return c[0]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Failed

    for i in range(most):
        c = phi(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + c1 * t * slope or (c[1] >= low[1] and i):
            return zoom(low, c)
        if abs(c[2]) <= c2 * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _Failed


def _direction(gradient: np.ndarray, steps: list) -> np.ndarray:
    d, used = gradient.copy(), []
    for s, y, sy in steps:
        a = np.vdot(s, d) / sy
        d -= a * y
        used.append(a)
    if steps:
        s, y, sy = steps[0]
        if not sy >= 0:
            raise _Failed
        d *= sy / np.vdot(y, y)
    for (s, y, sy), a in zip(reversed(steps), reversed(used), strict=True):
        d += (a - np.vdot(y, d) / sy) * s
    if np.isnan(d).any():
        raise _Failed
    return -d


def minimise(f, x: np.ndarray, iterations: int, tolerance: float, memory: int = 10, window: int = 20) -> tuple[np.ndarray, list[float]]:
    """Breeze's L-BFGS with Spark ML's stopping rules; returns the point and the value after every step."""
    value, gradient = f(x)
    history, recent, steps, failed = [value], [np.inf], [], False
    kept = [np.empty((2, *x.shape)) for _ in range(memory)]  # steps and changes of the gradient, the latest first
    while len(history) <= iterations:
        if len(recent) > 1 and abs(value - max(recent)) <= tolerance * history[0]:
            break
        if np.linalg.norm(gradient) < max(tolerance * value, 1e-8):
            break
        try:
            d = _direction(gradient, steps)

            def phi(t: float, x=x, d=d) -> tuple[float, float, float]:
                v, g = f(x + t * d)
                return t, v, float(np.vdot(g, d))

            t = _line_search(phi, 1.0 if len(history) > 1 else 1 / np.linalg.norm(d))
            if t * np.linalg.norm(gradient) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                break
            steps, failed = [], True
            continue
        failed = False
        new = x + t * d
        value, g = f(new)
        kept.insert(0, kept.pop())
        s, y = kept[0]
        np.subtract(new, x, out=s)
        np.subtract(g, gradient, out=y)
        steps = [(s, y, np.vdot(s, y)), *steps[: memory - 1]]
        x, gradient = new, g
        del new, g, d, phi
        history.append(value)
        recent = [*recent, value][-window:]
    return x, history


def fit(groups: DataFrame, labels: list[str], features: int, reg: float = 0.01, iterations: int = 30, tolerance: float = 1e-6) -> Model:
    """``LogisticRegression(family="multinomial", maxIter=iterations, regParam=reg)`` on the hashed features of the tokens."""
    counts = counted(groups, labels, features)
    found = np.flatnonzero(counts.tokens)
    if not len(found):
        raise ValueError("no token to learn from")
    if len(found) == 1:  # one class only: it is certain
        return Model(np.zeros((features, len(labels) + 1)), np.where(np.arange(len(labels) + 1) == found[0], np.inf, 0.0), [0.0])
    f = _Objective(groups, counts, reg)
    x = np.zeros((features + 1, len(labels) + 1))
    seen = np.log1p(counts.tokens[: found[-1] + 1])  # classes after the last one that occurs begin at 0
    x[-1, : len(seen)] = seen - seen.mean()
    x, history = minimise(f, x, iterations, tolerance)
    weights, intercepts = f.raw(x)
    return Model(weights, intercepts - intercepts.mean(), history)


def probabilities(model_margins: np.ndarray) -> np.ndarray:
    """Softmax of (tokens, classes) margins; an infinite one is certain."""
    sure = np.isposinf(model_margins)
    top = model_margins.max(axis=1, keepdims=True)
    e = np.where(sure.any(axis=1, keepdims=True), sure, np.exp(model_margins - np.where(np.isfinite(top), top, 0.0)))
    return e / e.sum(axis=1, keepdims=True)
