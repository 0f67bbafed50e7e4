"""Many starts of k-means and of Gaussian mixtures fitted together: one pass over packed rows is one step of all of them.

A pass yields sums of fixed size, whatever the rows: each task adds up its blocks, and where the tasks' sums are many they are added by
key before the driver takes them. Rows never leave their blocks. Start i of a seed is the start of seed + i alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle
from ..sources.shipping import ship

ROWS = 4096
#: Bytes of sums that the driver takes from all tasks before they are added by key.
DIRECT = 1 << 26


class Blocks:
    """Rows packed into matrices of about `rows`, written once; points() of a block are read in every pass."""

    def __init__(self, df: DataFrame, vector: str, rows: int = ROWS):
        self.spark = df.sparkSession
        ship(self.spark)
        self.tasks = self.spark.sparkContext.defaultParallelism

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, i, held = TaskContext.get().partitionId(), 0, []

            def out(x: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([part * (1 << 32) + i], pa.int64()), pa.array([len(x)], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "n", "points"])

            for b in batches:
                column = b.column(0)
                if len(column):
                    held.append(np.asarray(column.flatten()).astype("<f8").reshape(len(column), -1))
                while sum(map(len, held)) >= rows:
                    whole = np.concatenate(held)
                    yield out(whole[:rows])
                    i, held = i + 1, [whole[rows:]]
            if sum(map(len, held)):
                yield out(np.concatenate(held))

        dealt = df.select(F.col(vector).cast("array<double>").alias("v")).repartition(self.tasks)
        self.frame = settle(dealt.mapInArrow(run, "block bigint, n int, points binary"), "fit-blocks").repartition(self.tasks, "block").cache()

    def total(self, kernel: Callable, shared) -> dict[int, np.ndarray]:
        """Sums over all blocks of kernel(block, points, shared) -> {key: array}."""
        sent = self.spark.sparkContext.broadcast(shared)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for block, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    x = np.frombuffer(raw.as_py(), "<f8").reshape(n, -1)
                    for key, value in kernel(block, x, sent.value).items():
                        sums[key] = sums[key] + value if key in sums else value
            if sums:
                size = sum(v.nbytes for v in sums.values())
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<f8").tobytes() for v in sums.values()], pa.binary()), pa.array([size] * len(sums), pa.int64())], ["key", "sums", "size"])

        def add(table: pa.Table) -> pa.Table:
            s = sum(np.frombuffer(x.as_py(), "<f8") for x in table.column("sums"))
            return pa.table({"key": table.column("key")[:1], "sums": pa.array([s.tobytes()], pa.binary())})

        rows = self.frame.mapInArrow(run, "key int, sums binary, size bigint")
        if self.tasks * getattr(self, "last", 0) > DIRECT:
            rows = rows.groupBy("key").applyInArrow(add, "key int, sums binary")
        out: dict[int, np.ndarray] = {}
        for r in rows.collect():
            value = np.frombuffer(bytes(r["sums"]), "<f8")
            out[r["key"]] = out[r["key"]] + value if r["key"] in out else value
        self.last = sum(v.nbytes for v in out.values())
        sent.destroy()
        return out

    def drop(self) -> None:
        self.frame.unpersist()


def chance(block: int, n: int, salt: int) -> np.ndarray:
    """A uniform number for each row of a block."""
    return np.random.default_rng([salt & 0xFFFFFFFF, block >> 32, block & 0xFFFFFFFF]).random(n)


def draw(blocks: Blocks, wanted: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each (salt, m): m rows drawn without return, all if there are fewer."""
    sent = blocks.spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for block, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = np.frombuffer(raw.as_py(), "<f8").reshape(n, -1)
                for i, (salt, m) in enumerate(sent.value):
                    u = chance(block, n, salt)
                    at = np.argsort(u, kind="stable")[:m]
                    u, v = u[at], x[at]
                    if i in best:
                        u, v = np.concatenate([best[i][0], u]), np.concatenate([best[i][1], v])
                        at = np.argsort(u, kind="stable")[:m]
                        u, v = u[at], v[at]
                    best[i] = (u, v)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([u.tobytes() for u, _ in best.values()], pa.binary()), pa.array([v.tobytes() for _, v in best.values()], pa.binary())], ["key", "u", "v"])

    found: dict[int, list] = {i: [] for i in range(len(wanted))}
    for r in blocks.frame.mapInArrow(run, "key int, u binary, v binary").collect():  # m rows a start and task at most
        u = np.frombuffer(bytes(r["u"]), "<f8")
        found[r["key"]].append((u, np.frombuffer(bytes(r["v"]), "<f8").reshape(len(u), -1)))
    out = []
    for i, (_, m) in enumerate(wanted):
        u, v = np.concatenate([u for u, _ in found[i]]), np.concatenate([v for _, v in found[i]])
        out.append(v[np.argsort(u, kind="stable")[:m]])
    return out


# Centroids


def _nearest(x: np.ndarray, centers: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each set of centers: the nearest one of each row and its squared distance."""
    every = np.concatenate(centers)
    d = x @ (-2 * every.T)
    d += np.einsum("ij,ij->i", every, every)
    own, far, at, square = [], [], 0, np.einsum("ij,ij->i", x, x)
    for c in centers:
        part = d[:, at : at + len(c)]
        a = part.argmin(1)
        own.append(a)
        far.append(np.maximum(part[np.arange(len(x)), a] + square, 0.0))
        at += len(c)
    return own, far


def _seeded(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of few weighted points by k-means++, then moved by at most 30 rounds of Lloyd's."""
    rng, chosen = np.random.default_rng(seed), []
    near = np.full(len(points), np.inf)
    for i in range(min(k, len(points))):
        mass = weight * near if i else weight
        if not mass.sum() > 0:
            break
        chosen.append(int(rng.choice(len(points), p=mass / mass.sum())))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    centers = points[chosen].copy()
    for _ in range(30):
        own = _nearest(points, [centers])[0][0]
        moved = centers.copy()
        for j in range(len(centers)):
            w = weight * (own == j)
            if w.sum() > 0:
                moved[j] = w @ points / w.sum()
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers


def kmeans(blocks: Blocks, counts: list[int], seeds: list[int], iterations: int = 50, tol: float = 1e-4) -> dict[int, tuple[float, np.ndarray]]:
    """k -> (inertia, centers) of the best start: k-means|| of two rounds, then Lloyd's steps, all starts of all counts in one pass."""
    starts = [(k, s) for k in counts for s in seeds]
    held = draw(blocks, [(s * 1009 + k, 1) for k, s in starts])

    def cost(block, x, sets):
        return {0: np.array([d.sum() for d in _nearest(x, sets)[1]])}

    for step in range(2):
        total = blocks.total(cost, held)[0]
        asked = [(k, s * 1009 + k + 500_000_003 * (step + 1), t) for (k, s), t in zip(starts, total)]

        def more(block, x, shared):
            sets, asked = shared
            out = {}
            for i, (d, (k, salt, t)) in enumerate(zip(_nearest(x, sets)[1], asked)):
                got = x[chance(block, len(x), salt) * t < 2 * k * d]
                if len(got):
                    out[i] = got
            return out

        for i, rows in _gather(blocks, more, (held, asked)).items():
            held[i] = np.concatenate([held[i], rows])

    def weigh(block, x, sets):
        return {i: np.bincount(a, minlength=len(c)).astype(float) for i, (a, c) in enumerate(zip(_nearest(x, sets)[0], sets))}

    weight = blocks.total(weigh, held)
    centers = [_seeded(c, weight[i], k, s) for i, ((k, s), c) in enumerate(zip(starts, held))]

    def lloyd(block, x, shared):
        out = {}
        for i, c, a in zip(shared[0], shared[1], _nearest(x, shared[1])[0]):
            one = np.zeros((len(x), len(c)))
            one[np.arange(len(x)), a] = 1.0
            out[i] = np.column_stack([one.sum(0), one.T @ x]).ravel()
        return out

    moving = list(range(len(starts)))
    for _ in range(iterations):
        if not moving:
            break
        sums = blocks.total(lloyd, (moving, [centers[i] for i in moving]))
        still = []
        for i in moving:
            s = sums[i].reshape(len(centers[i]), -1)
            new = np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1), centers[i])
            if ((new - centers[i]) ** 2).sum(1).max() > tol * tol:
                still.append(i)
            centers[i] = new
        moving = still
    inertia = blocks.total(cost, centers)[0]
    best: dict[int, tuple[float, np.ndarray]] = {}
    for (k, _), c, t in zip(starts, centers, inertia):
        if k not in best or t < best[k][0]:
            best[k] = (float(t), c)
    return best


def _gather(blocks: Blocks, kernel: Callable, shared) -> dict[int, np.ndarray]:
    """Rows that kernel(block, points, shared) -> {key: rows} picks, some 2 k a start, by block."""
    sent = blocks.spark.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                got = kernel(block, np.frombuffer(raw.as_py(), "<f8").reshape(n, -1), sent.value)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([block] * len(got), pa.int64()), pa.array([len(v) for v in got.values()], pa.int32()), pa.array([np.ascontiguousarray(v).tobytes() for v in got.values()], pa.binary())], ["key", "block", "n", "rows"])

    out: dict[int, list] = {}
    for r in sorted(blocks.frame.mapInArrow(run, "key int, block bigint, n int, rows binary").collect(), key=lambda r: r["block"]):
        out.setdefault(r["key"], []).append(np.frombuffer(bytes(r["rows"]), "<f8").reshape(r["n"], -1))
    return {k: np.concatenate(v) for k, v in out.items()}


def validity(blocks: Blocks, centers: list[np.ndarray]) -> list[tuple[float, float, float] | None]:
    """(silhouette, Davies-Bouldin, Calinski-Harabasz) of the cells of each set of centers; None below two cells.

    Distances of all pairs of rows are met once for all sets: every pair of blocks is a group of its own and yields a sum for each row and cell.
    """

    def sums(block, x, sets):
        out = {}
        for i, (c, a) in enumerate(zip(sets, _nearest(x, sets)[0])):
            one = np.zeros((len(x), len(c)))
            one[np.arange(len(x)), a] = 1.0
            out[i] = np.column_stack([one.sum(0), one.T @ x]).ravel()
        return out

    got = [v.reshape(len(c), -1) for (_, v), c in zip(sorted(blocks.total(sums, centers).items()), centers)]
    counts = [g[:, 0] for g in got]
    means = [g[:, 1:] / np.maximum(g[:, :1], 1) for g in got]

    def spread(block, x, shared):
        sets, means = shared
        out = {}
        for i, (a, m) in enumerate(zip(_nearest(x, sets)[0], means)):
            square = ((x - m[a]) ** 2).sum(1)
            out[i] = np.concatenate([np.bincount(a, np.sqrt(square), len(m)), np.bincount(a, square, len(m))])
        return out

    around = blocks.total(spread, (centers, means))
    shared = blocks.spark.sparkContext.broadcast((centers, counts))
    places = [r["block"] for r in blocks.frame.select("block").collect()]  # a number for each block
    listed = F.array(*[F.lit(p) for p in places])
    left = blocks.frame.withColumn("other", F.explode(listed))
    right = blocks.frame.select(F.explode(listed).alias("to"), F.col("block").alias("at"), F.col("n").alias("m"), F.col("points").alias("met"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        x = np.frombuffer(a.column("points")[0].as_py(), "<f8").reshape(a.column("n")[0].as_py(), -1)
        y = np.frombuffer(b.column("met")[0].as_py(), "<f8").reshape(b.column("m")[0].as_py(), -1)
        sets, out, yy = shared.value[0], [], np.einsum("ij,ij->i", y, y)
        one = np.zeros((len(y), sum(map(len, sets))))
        at = 0
        for c, own in zip(sets, _nearest(y, sets)[0]):
            one[np.arange(len(y)), at + own] = 1.0
            at += len(c)
        for s in range(0, len(x), 256):
            z = x[s : s + 256]
            scale = np.einsum("ij,ij->i", z, z)[:, None] + yy
            d = z @ (-2 * y.T)
            d += scale
            r, c = np.nonzero(d < 1e-4 * scale)  # products tell such distances badly
            d = np.sqrt(np.maximum(d, 0.0))
            for f in range(0, len(r), 1 << 15):
                p, q = r[f : f + (1 << 15)], c[f : f + (1 << 15)]
                d[p, q] = np.sqrt(((z[p] - y[q]) ** 2).sum(1))
            out.append(d @ one)
        return pa.table({"block": a.column("block"), "n": a.column("n"), "points": a.column("points"), "sums": pa.array([np.concatenate(out).tobytes()], pa.binary())})

    def score(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        x = np.frombuffer(table.column("points")[0].as_py(), "<f8").reshape(n, -1)
        sums = sum(np.frombuffer(v.as_py(), "<f8").reshape(n, -1) for v in table.column("sums"))
        sets, counts = shared.value
        out, at, row = [], 0, np.arange(n)
        for c, m, own in zip(sets, counts, _nearest(x, sets)[0]):
            part = sums[:, at : at + len(c)]
            at += len(c)
            a = part[row, own] / np.maximum(m[own] - 1, 1)
            others = np.where(m > 0, part / np.maximum(m, 1), np.inf)
            others[row, own] = np.inf
            b = others.min(1)
            top = np.maximum(a, b)
            out.append(float(np.where((m[own] > 1) & (top > 0) & np.isfinite(b), (b - a) / np.where(top > 0, top, 1), 0.0).sum()))
        return pa.table({"s": pa.array([out], pa.list_(pa.float64()))})

    cells = left.groupBy("block", "other").cogroup(right.groupBy("to", "at")).applyInArrow(meet, "block bigint, n int, points binary, sums binary")
    rows = cells.groupBy("block").applyInArrow(score, "s array<double>").collect()
    silhouette = np.sum([r["s"] for r in rows], axis=0)
    done = []
    for i, (n, m) in enumerate(zip(counts, means)):
        some = n > 0
        k, total = int(some.sum()), n.sum()
        if k < 2:
            done.append(None)
            continue
        n, m, away = n[some], m[some], around[i].reshape(2, -1)[:, some]
        gap, s = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)), away[0] / n
        ratio = np.where(gap > 0, (s[:, None] + s) / np.where(gap > 0, gap, 1), -np.inf)
        worst = ratio.max(1)
        between, within = (n * ((m - n @ m / total) ** 2).sum(1)).sum(), away[1].sum()
        done.append((float(silhouette[i] / total), float(worst[np.isfinite(worst)].mean()), float((between / (k - 1)) / (within / (total - k))) if total > k and within > 0 else None))
    return done


# Mixtures

#: Logarithm of what is added to every component's density at every row, as pyspark.ml does: no component loses all rows.
FLOOR = float(np.log(2.0**-52))


def _normal(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(mean, root of the inverse, logarithm of the height); by the pseudo-inverse where a covariance is singular, None where it is nothing."""
    if not np.isfinite(cov).all():
        return None
    try:
        low = np.linalg.cholesky(cov)
        scale = np.diag(low)
        if scale.min() > 1e-5 * scale.max():
            return mean, np.ascontiguousarray(np.linalg.inv(low).T), -0.5 * len(cov) * np.log(2 * np.pi) - np.log(scale).sum()
    except np.linalg.LinAlgError:
        pass
    e, v = np.linalg.eigh(cov)
    some = e > np.finfo(float).eps * max(e.max(), 0.0) * len(e)
    if not some.any():
        return None
    root = v[:, some] / np.sqrt(e[some])
    return mean, root, -0.5 * (len(e) * np.log(2 * np.pi) + np.log(e[some]).sum())


def mixtures(blocks: Blocks, counts: list[int], seeds: list[int], iterations: int, tol: float = 0.01) -> dict[int, float]:
    """k -> log-likelihood of the best start: full covariances, all starts of all counts in one pass a step.

    A start has the mean and the variances of five drawn rows for each component, and ends when its likelihood moves by less than `tol`
    or after `iterations` steps. One whose covariances break down counts for nothing; a k without any is absent.
    """
    starts = [(k, s) for k in counts for s in seeds]
    models: dict[int, tuple[np.ndarray, list]] = {}
    for i, ((k, _), x) in enumerate(zip(starts, draw(blocks, [(s * 1009 + k, 5 * k) for k, s in starts]))):
        parts = [x[j * len(x) // k : (j + 1) * len(x) // k] for j in range(k)]
        normals = [_normal(p.mean(0), np.diag(p.var(0))) if len(p) else None for p in parts]
        if all(n is not None for n in normals):
            models[i] = (np.full(k, 1 / k), normals)

    def step(block, x, models):
        out = {}
        for i, (weights, normals) in models.items():
            logs = np.empty((len(x), len(weights)))
            for j, (mean, root, height) in enumerate(normals):
                z = (x - mean) @ root
                logs[:, j] = np.log(weights[j]) + height - 0.5 * np.einsum("ij,ij->i", z, z)
            logs = np.logaddexp(FLOOR, logs)
            top = logs.max(1, keepdims=True)
            share = np.exp(logs - top)
            whole = share.sum(1, keepdims=True)
            share /= whole
            parts = [np.array([float((top + np.log(whole)).sum())])]
            for j, (mean, _, _) in enumerate(normals):
                y = x - mean  # about the former mean: nothing cancels
                r = share[:, j : j + 1] * y
                parts += [share[:, j].sum()[None], r.sum(0), (r.T @ y).ravel()]
            out[i] = np.concatenate(parts)
        return out

    likelihood: dict[int, float] = {}
    before = dict.fromkeys(models, -np.inf)
    n = float(sum(r["n"] for r in blocks.frame.select("n").collect()))  # a number for each block
    for turn in range(iterations + 1):
        if not models:
            break
        sums, after = blocks.total(step, models), {}
        for i, (weights, normals) in models.items():
            ll, d = float(sums[i][0]), len(normals[0][0])
            if not np.isfinite(ll):
                continue
            if turn == iterations or turn and abs(ll - before[i]) <= tol:
                likelihood[i] = ll
                continue
            before[i], at, new, mass = ll, 1, [], []
            for mean, _, _ in normals:
                w, first, second = sums[i][at], sums[i][at + 1 : at + 1 + d], sums[i][at + 1 + d : at + 1 + d + d * d].reshape(d, d)
                at += 1 + d + d * d
                mass.append(w / n)
                shift = first / w if w > 0 else np.full(d, np.nan)
                new.append(_normal(mean + shift, second / w - np.outer(shift, shift)) if w > 0 else None)
            if all(x is not None for x in new):
                after[i] = (np.array(mass), new)
        models = after
    best: dict[int, float] = {}
    for i, ll in likelihood.items():
        k = starts[i][0]
        best[k] = max(best.get(k, -np.inf), ll)
    return best
