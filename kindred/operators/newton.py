"""Logistic regression by Newton's method over a table of packed rows.

Rows are packed once: a block is the features of some thousand rows of one part, column by
column, compressed, in a scratch table. A step sums loss, gradient and Hessian over all blocks
of all models at once; only these sums reach the driver. The sums of a spread share of the rows
give where to begin, never where to end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Scratch

#: Rows of a block; every SPREAD-th row of a block may be one to begin with, START of them about.
ROWS, SPREAD, START = 8192, 32, 40_000
_BLOCK = "part int, n long, positive long, x binary, y binary, spread binary, spread_y binary"
Label = Callable[[np.ndarray], np.ndarray]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column of doubles."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<f8", (int(ends[-1]) - int(ends[0])) // 8, int(ends[0])).reshape(len(column), width)


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x.T), codec="lz4", asbytes=True)


def _unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    """(width + 1, n): a block's features and a row of ones."""
    out = np.ones((width + 1, n))
    out[:-1] = np.frombuffer(pa.decompress(data, decompressed_size=n * width * 8, codec="lz4"), np.float64).reshape(width, n)
    return out


def _block(part: int, x: np.ndarray, y: np.ndarray) -> tuple:
    return part, len(y), int(y.sum()), _packed(x), y.tobytes(), _packed(x[::SPREAD]), y[::SPREAD].tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    names = ["part", "n", "positive", "x", "y", "spread", "spread_y"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class Blocks:
    """rows(features... or x, their doubles as bytes; label; part) packed. label(x) stands for a column."""

    def __init__(self, rows: DataFrame, features: tuple[str, ...], label: Label | None = None):
        self.scratch, self.width = Scratch(rows.sparkSession), len(features)
        width, whole = self.width, "x" in rows.columns and "x" not in features
        columns = ["x"] if whole else [F.col(f).cast("double").alias(f) for f in features]
        columns += [] if label else [F.col("label").cast("int").alias("label")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("x"), width) if whole else np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
                y = (label(x) if label else batch.column("label").to_numpy(zero_copy_only=False) == 1).astype(np.uint8)
                part = batch.column("part").to_numpy(zero_copy_only=False)
                for p in np.unique(part).tolist():
                    own = part == p
                    held.setdefault(p, []).append((x[own], y[own]))
                    if sum(len(b) for _, b in held[p]) >= ROWS:
                        some = held.pop(p)
                        yield _batch([_block(p, np.concatenate([a for a, _ in some]), np.concatenate([b for _, b in some]))])
            for p, some in held.items():
                yield _batch([_block(p, np.concatenate([a for a, _ in some]), np.concatenate([b for _, b in some]))])

        self.table, _ = self.scratch.put(rows.select(*columns, F.col("part").cast("int").alias("part")).mapInArrow(run, _BLOCK), "blocks")
        self.counts = {r["part"]: (r["n"], r["positive"]) for r in self.table.groupBy("part").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).collect()}

    def size(self, parts: set[int]) -> tuple[int, int]:
        """Rows, and those of label 1."""
        own = [self.counts[p] for p in parts if p in self.counts]
        return sum(n for n, _ in own), sum(k for _, k in own)

    def spread(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(part, features with a row of ones, labels) of some START rows from all over the table."""
        every = max(1, sum(n for n, _ in self.counts.values()) // SPREAD // START)
        some = self.table.where(F.pmod(F.xxhash64("y", "x"), F.lit(every)) == 0).select("part", "spread", "spread_y")
        return [(r["part"], _unpacked(bytes(r["spread"]), len(r["spread_y"]), self.width), np.frombuffer(bytes(r["spread_y"]), np.uint8)) for r in some.toLocalIterator()]

    def sums(self, models: list[set[int]], of: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
        """of(i, x, y) summed over the blocks of the parts of model i."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, n, data, y in zip(*(batch.column(c) for c in ("part", "n", "x", "y"))):
                    using = [i for i, parts in enumerate(models) if part.as_py() in parts]
                    if using:
                        x, t = _unpacked(data.as_buffer(), n.as_py(), width), np.frombuffer(y.as_buffer(), np.uint8)
                        for i in using:
                            made = of(i, x, t)
                            found[i] = found[i] + made if i in found else made
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.astype(np.float64).tobytes() for v in found.values()], pa.binary())], ["model", "sums"])

        wanted = F.col("part").isin(sorted(set().union(*models)))
        out: list = [None] * len(models)
        for r in self.table.where(wanted).select("part", "n", "x", "y").mapInArrow(run, "model int, sums binary").collect():
            made = np.frombuffer(bytes(r["sums"]), np.float64)
            out[r["model"]] = made if out[r["model"]] is None else out[r["model"]] + made
        return out

    def clear(self) -> None:
        self.scratch.clear()


@dataclass
class Problem:
    """Mean weighted loss over parts plus penalty / 2 times the squared weights, without the intercept."""

    parts: set[int]
    n: int
    weights: tuple[float, float]  # of labels 0 and 1
    penalty: float


def _terms(beta: np.ndarray, weights: tuple[float, float], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of weights, loss, gradient and Hessian in one row."""
    z = beta @ x
    c = np.where(y == 1, weights[1], weights[0])
    p = 0.5 + 0.5 * np.tanh(0.5 * z)
    loss = np.maximum(z, 0) - y * z + np.log1p(np.exp(-np.abs(z)))
    return np.concatenate([[c.sum(), c @ loss], x @ (c * (p - y)), ((x * (c * p * (1 - p))) @ x.T).ravel()])


def _at(problem: Problem, beta: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Objective, gradient and Hessian out of sums."""
    k = len(beta)
    own = np.full(k, problem.penalty)
    own[-1] = 0.0
    total, loss, slope, bend = sums[0], sums[1], sums[2 : 2 + k], sums[2 + k :].reshape(k, k)
    return loss / total + (own * beta**2).sum() / 2, slope / total + own * beta, bend / total + np.diag(own)


def _descend(problems: list[Problem], evaluate: Callable[[list[int], list[np.ndarray]], list[np.ndarray]], start: list[np.ndarray], tol: float, max_iter: int) -> tuple[list[np.ndarray], list[int], list[bool]]:
    """(weights, steps, converged) of each problem: Newton's steps, halved until the objective falls enough."""
    at: list = [None] * len(problems)
    tried, share = list(start), [1.0] * len(problems)
    steps, done = [0] * len(problems), [False] * len(problems)
    beta = list(start)
    for _ in range(max_iter + 1):
        going = [i for i in range(len(problems)) if not done[i]]
        if not going:
            break
        for i, sums in zip(going, evaluate(going, [tried[i] for i in going])):
            new = _at(problems[i], tried[i], sums)
            if at[i] is None or new[0] <= at[i][0] - 1e-4 * share[i] * at[i][3]:
                move = np.linalg.lstsq(new[2], new[1], rcond=1e-15)[0]
                at[i], beta[i], share[i] = (*new[:2], move, float(new[1] @ move)), tried[i], 1.0
            else:
                share[i] /= 2
            steps[i] += 1
            value, _, move, gain = at[i]
            # the objective can't fall by more than rounding, or than tol squared of itself
            if gain / 2 <= max(tol * tol * abs(value), 1e-18) or share[i] < 1e-6:
                done[i] = True
                beta[i] = beta[i] - move if share[i] == 1.0 else beta[i]
            else:
                tried[i] = beta[i] - share[i] * move
    return beta, steps, done


def fit(blocks: Blocks, problems: list[Problem], tol: float, max_iter: int) -> tuple[list[np.ndarray], list[int], list[bool]]:
    """Weights with the intercept at the end, steps over all rows and whether they converged, of each problem."""
    some, width = blocks.spread(), blocks.width

    def nearby(going: list[int], betas: list[np.ndarray]) -> list[np.ndarray]:
        return [sum(_terms(b, problems[i].weights, x, y) for part, x, y in some if part in problems[i].parts) for i, b in zip(going, betas)]

    def over_all(going: list[int], betas: list[np.ndarray]) -> list[np.ndarray]:
        weights = [problems[i].weights for i in going]
        return blocks.sums([problems[i].parts for i in going], lambda i, x, y: _terms(betas[i], weights[i], x, y))

    zero = np.zeros(width + 1)
    start = []
    for p in problems:
        labels = [y for part, _, y in some if part in p.parts]
        both = any((y == 0).any() for y in labels) and any((y == 1).any() for y in labels)
        start += _descend([p], lambda _, b, p=p: nearby([problems.index(p)], b), [zero], tol, 100)[0] if both else [zero]
    return _descend(problems, over_all, start, tol, max_iter)
