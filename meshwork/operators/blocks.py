"""Products of subjects' edges with many runs, by blocks of edges and runs.

Samples times edges times runs is what permutation tests cost; as rows that would be shuffled, as matrix products within tasks it is
not.  A block is EDGES_A_BLOCK edges and up to RUNS_A_BLOCK runs; its samples are dealt to tasks by SAMPLES_A_TASK.  A task holds the sums of
one block at a time, an array for each fold, and passes those on; blocks of several tasks are added up as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import CLAMP, LEAST_VARIANCE, TINY

EDGES_A_BLOCK, RUNS_A_BLOCK, SAMPLES_A_TASK = 512, 128, 8192
_KEYS = ["edge_block", "run_block", "fold"]


def _names(covariates: list[str]) -> tuple[list[str], list[str]]:
    """The names of sums by run and edge, and of the others: by edge, by run and of covariates alone."""
    by_edge = ["n", "s_x", "s_x_x", *[f"s_x_{c}" for c in covariates]]
    by_run = ["s_y", "s_y_y", *[f"s_y_{c}" for c in covariates]]
    alone = [f"s_{c}" for c in covariates] + [f"s_{c}_{d}" for i, c in enumerate(covariates) for d in covariates[i:]]
    return ["s_x_y"], [*by_edge, *by_run, *alone]


def sliced(subjects: DataFrame, column: str = "x") -> DataFrame:
    """(sample_id, edge_block, xs): each sample's edges in blocks."""
    n = F.size(column)
    block = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / EDGES_A_BLOCK).cast("int")))
    rows = subjects.where(n > 0).select("sample_id", F.col(column).alias("_x"), block.alias("edge_block"))
    return rows.select("sample_id", "edge_block", F.slice("_x", F.col("edge_block") * EDGES_A_BLOCK + 1, F.lit(EDGES_A_BLOCK)).alias("xs"))


def targets(samples: DataFrame, covariates: list[str]) -> DataFrame:
    """(sample_id, fold, run_block, covariates, ys): each sample's targets in a block of runs, in their order."""
    block = F.floor(F.col("run_id") / RUNS_A_BLOCK).cast("int")
    rows = samples.groupBy("sample_id", F.col("sample_fold").alias("fold"), block.alias("run_block"), *covariates)
    return rows.agg(F.sort_array(F.collect_list(F.struct("run_id", "y"))).alias("_r")).select("sample_id", "fold", "run_block", *covariates, F.col("_r.y").alias("ys"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _runs(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Where rows of equal keys begin and end."""
    cut = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
    ends = np.concatenate(([0], cut, [len(keys[0])]))
    yield from zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)


def _held(add, out, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows that are sorted by _KEYS, one key at a time: add(rows) gives a key's arrays, out(key, arrays) a batch."""
    key, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in _KEYS]
        for lo, hi in _runs(keys):
            now, more = tuple(int(k[lo]) for k in keys), add(batch.slice(lo, hi - lo))
            if now == key:
                held = [a + b for a, b in zip(held, more, strict=True)]
                continue
            if key is not None:
                yield out(key, held)
            key, held = now, more
    if key is not None:
        yield out(key, held)


def moments(subjects: DataFrame, samples: DataFrame, covariates: list[str]) -> DataFrame:
    """(edge_block, run_block, fold) with each task's sums as arrays: those by run and edge have a run's edges one after another.

    samples: run_id (0, 1, ...), sample_id, sample_fold, y, covariates; every run has the same samples.
    """
    full, other = _names(covariates)
    names = [*full, *other]
    tasks = F.pmod(F.xxhash64("sample_id"), F.lit(1 + subjects.count() // SAMPLES_A_TASK))
    rows = sliced(subjects).join(targets(samples, covariates), "sample_id").withColumn("_task", tasks)
    rows = rows.select(*_KEYS, "_task", "xs", "ys", *covariates).repartition("edge_block", "run_block", "_task").sortWithinPartitions("_task", *_KEYS)

    def add(part: pa.RecordBatch) -> list[np.ndarray]:
        x, y = _matrix(part.column("xs")), _matrix(part.column("ys"))
        c = [part.column(v).to_numpy(zero_copy_only=False) for v in covariates]
        by_edge = [np.full(x.shape[1], float(len(x))), x.sum(0), (x * x).sum(0), *[v @ x for v in c]]
        by_run = [y.sum(0), (y * y).sum(0), *[v @ y for v in c]]
        alone = [np.array([v.sum()]) for v in c] + [np.array([v @ w]) for i, v in enumerate(c) for w in c[i:]]
        return [(y.T @ x).ravel(), *by_edge, *by_run, *alone]

    def out(key: tuple[int, ...], arrays: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], *[pa.array([a], pa.list_(pa.float64())) for a in arrays]], [*_KEYS, *names])

    schema = ", ".join(f"{k} int" for k in _KEYS) + ", " + ", ".join(f"{c} array<double>" for c in names)
    return rows.drop("_task").mapInArrow(lambda batches: _held(add, out, batches), schema)


def _whole(parts: DataFrame) -> DataFrame:
    """Sums of different tasks next to each other, all folds of a block in one task."""
    return parts.repartition("edge_block", "run_block").sortWithinPartitions(*_KEYS)


def _added(names: list[str]):
    return lambda part: [_matrix(part.column(c)).sum(0) for c in names]


def statistics(parts: DataFrame, covariates: list[str], least_z: float | None = None, trained: bool = False, controlled: int | None = None) -> DataFrame:
    """(run_id, edge_id, fold, n, r, z) over each fold's training part, of moments(): all, or those with |z| above least_z.

    The same as edges.statistics(edges.train_moments(...)), on a block's arrays.  trained: a fold's sums are those of its training part already.
    controlled: edges are what the covariates leave of them, and the test controls for all covariates (their number) or none (0).
    """
    full, other = _names(covariates)
    names = [*full, *other]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, folds = None, {}
        for key, arrays in _held(_added(names), lambda key, arrays: (key, arrays), batches):
            if key[:2] != block and folds:
                yield from _tested(block, folds, names, covariates, least_z, trained, controlled)
                folds = {}
            block = key[:2]
            folds[key[2]] = arrays
        if folds:
            yield from _tested(block, folds, names, covariates, least_z, trained, controlled)

    return _whole(parts).mapInArrow(of, "run_id int, edge_id int, fold int, n long, r double, z double")


def _tested(block: tuple[int, int], folds: dict[int, list[np.ndarray]], names: list[str], covariates: list[str], least_z: float | None, trained: bool, controlled: int | None) -> Iterator[pa.RecordBatch]:
    whole = [sum(a) for a in zip(*folds.values(), strict=True)]
    left = ["x", "y", *covariates]
    pairs = [(a, b) for i, a in enumerate(left) for b in left[i:]]
    for fold, own in folds.items():
        s = dict(zip(names, own, strict=True)) if trained else {c: a - b for c, a, b in zip(names, whole, own, strict=True)}
        edges, runs = len(s["n"]), len(s["s_y"])
        shape = lambda c: (runs, edges) if c == "s_x_y" else (1, edges) if c == "n" or c == "s_x" or c.startswith("s_x_") else (runs, 1) if c == "s_y" or c.startswith("s_y_") else (1, 1)  # noqa: E731, B023
        s = {c: a.reshape(shape(c)) for c, a in s.items()}
        n = s["n"]
        v = {(a, b): s[f"s_{a}_{b}"] - s[f"s_{a}"] * s[f"s_{b}"] / n for a, b in pairs}
        all_x, all_y, all_c, rest = v["x", "x"], v["y", "y"], {c: v[c, c] for c in covariates}, list(left)
        with np.errstate(divide="ignore", invalid="ignore"):
            for c in covariates:  # swept out one after another; one that those before explain adds nothing
                rest.remove(c)
                of = lambda a, b: v[a, b] if (a, b) in v else v[b, a]  # noqa: E731, B023
                ok = v[c, c] > all_c[c] * 1e-10
                v |= {(a, b): v[a, b] - np.where(ok, of(a, c) * of(b, c) / v[c, c], 0.0) for i, a in enumerate(rest) for b in rest[i:]}
            related = lambda yy: np.clip(v["x", "y"] / (np.sqrt(np.maximum(v["x", "x"] * yy, 0.0)) + TINY), -CLAMP, CLAMP)  # noqa: E731, B023
            varies = (all_x if controlled is None else v["x", "x"]) / (n - 1) > LEAST_VARIANCE
            partial = related(all_y if controlled == 0 else v["y", "y"])
            free = n - 2 - (len(covariates) if controlled is None else controlled)
            z = np.where(varies, partial * np.sqrt(free / (1 - partial**2)) / np.sqrt(free / (free + 1)), 0.0)
            r = np.where(varies, related(all_y), 0.0)
        run, edge = np.nonzero(np.ones_like(z) if least_z is None else np.abs(z) > least_z)
        keys = (run + block[1] * RUNS_A_BLOCK, edge + block[0] * EDGES_A_BLOCK, np.full(len(run), fold))
        count = np.broadcast_to(n, z.shape)[run, edge].astype(np.int64)
        yield pa.RecordBatch.from_arrays([*[pa.array(k.astype(np.int32)) for k in keys], pa.array(count), pa.array(r[run, edge]), pa.array(z[run, edge])], ["run_id", "edge_id", "fold", "n", "r", "z"])


def unpacked(parts: DataFrame, covariates: list[str]) -> DataFrame:
    """Rows (run_id, edge_id, sample_fold, n, sums) of moments()."""
    variables = ["x", "y", *covariates]
    by_edge, by_run = {"n", "s_x", "s_x_x", *[f"s_x_{c}" for c in covariates]}, {"s_y", "s_y_y", *[f"s_y_{c}" for c in covariates]}
    names = ["n", *[f"s_{v}" for v in variables], *[f"s_{a}_{b}" for i, a in enumerate(variables) for b in variables[i:]]]

    def spread(name: str, a: np.ndarray, edges: int, runs: int) -> np.ndarray:
        if name == "s_x_y":
            return a
        return np.tile(a, runs) if name in by_edge else np.repeat(a, edges) if name in by_run else np.repeat(a, edges * runs)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c).slice(i, 1).flatten().to_numpy() for c in batch.schema.names if c not in _KEYS}
                edge, run, fold = (batch.column(k)[i].as_py() for k in _KEYS)
                edges, runs = len(row["n"]), len(row["s_y"])
                keys = [np.repeat(np.arange(runs) + run * RUNS_A_BLOCK, edges), np.tile(np.arange(edges) + edge * EDGES_A_BLOCK, runs), np.full(edges * runs, fold)]
                values = [pa.array(spread(c, row[c], edges, runs).astype(np.int64 if c == "n" else float)) for c in names]
                yield pa.RecordBatch.from_arrays([*[pa.array(k.astype(np.int32)) for k in keys], *values], ["run_id", "edge_id", "sample_fold", *names])

    rows = parts.mapInArrow(of, "run_id int, edge_id int, sample_fold int, n long, " + ", ".join(f"{c} double" for c in names[1:]))
    return rows.groupBy("run_id", "edge_id", "sample_fold").agg(*[F.sum(c).alias(c) for c in names])



def strengths(subjects: DataFrame, mask: DataFrame) -> DataFrame:
    """(run_id, fold, sample_id, pos, neg): sums of each sample's edges in each mask (run_id, fold, edge_id, network), as products with the
    masks' matrices; a missing value counts as 0.  A group is one block of edges with its masks and SAMPLES_A_TASK samples at most, about.
    """
    tasks = 1 + subjects.count() // SAMPLES_A_TASK
    kind = subjects.schema["sample_id"].dataType.simpleString()
    slices = sliced(subjects).withColumn("_task", F.pmod(F.xxhash64("sample_id"), F.lit(tasks)).cast("int"))
    block, place = F.floor(F.col("edge_id") / EDGES_A_BLOCK).cast("int"), (F.col("edge_id") % EDGES_A_BLOCK).cast("int")
    masks = mask.select("run_id", "fold", place.alias("place"), (F.col("network") == "positive").alias("up"), block.alias("edge_block"), F.explode(F.sequence(F.lit(0), F.lit(int(tasks) - 1))).alias("_task"))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("run_id", pa.int32()), ("fold", pa.int32()), ("sample_id", left.schema.field("sample_id").type), ("pos", pa.float64()), ("neg", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left = left.combine_chunks()
        x = np.nan_to_num(np.vstack([_matrix(c) for c in left.column("xs").chunks]))
        run, fold, place, up = (right.column(c).to_numpy() for c in ("run_id", "fold", "place", "up"))
        folds = int(fold.max()) + 1
        group, at = np.unique(run.astype(np.int64) * folds + fold, return_inverse=True)
        parts = []
        for lo in range(0, len(group), 1024):
            own = (at >= lo) & (at < lo + 1024)
            sums = []
            for sign in (True, False):
                m = np.zeros((x.shape[1], min(1024, len(group) - lo)))
                m[place[own & (up == sign)], at[own & (up == sign)] - lo] = 1
                sums.append((x @ m).T.ravel())
            which = np.repeat(group[lo : lo + 1024], len(x))
            ids = left.column("sample_id").take(pa.array(np.tile(np.arange(len(x)), len(which) // len(x))))
            parts.append(pa.Table.from_arrays([pa.array((which // folds).astype(np.int32)), pa.array((which % folds).astype(np.int32)), ids, *map(pa.array, sums)], schema=schema))
        return pa.concat_tables(parts)

    both = slices.groupBy("edge_block", "_task").cogroup(masks.groupBy("edge_block", "_task"))
    parts = both.applyInArrow(product, f"run_id int, fold int, sample_id {kind}, pos double, neg double")
    return parts.groupBy("run_id", "fold", "sample_id").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
