"""Gradient boosting by histogram aggregation (I2, I5): one model for several classes (softmax) or a number.

Features are cut into at most ``BINS`` bins at approximate quantiles of the training rows, and the binned
rows are packed into blocks that are written once.  A round grows one tree per class, level by level.
For each level every task adds up, for its blocks, gradients, hessians and rows per (class, node,
feature, bin); one DataFrame aggregate sums the tasks, running sums along the bins give both sides of
every cut, and the best cut of each node (a few rows) comes back to the driver.  Only sums and trees,
bounded by the parameters, leave the tasks.

Gradients are summed as whole numbers (2^-``SCALE`` units), so a fit does not depend on the order of rows
or tasks.  Ties take the lower feature, then the lower bin.  Columns are drawn once a tree, rows once a
round by a hash of block and place.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wingwatch.session import checkpoint_dir, delete_path

BINS, SCALE = 32, 24
BLOCK_ROWS = 20_000
MIN_GAIN, MIN_HESSIAN = 1e-6, 1e-3

_HIST = "k int, node int, feature int, bin int, g long, h long, n long"


def cut_points(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Cuts of each feature; a value belongs to the bin of the cuts below it (x > cut goes right)."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, F.lit(10_000)).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(row[f"q{i}"] or [], dtype=float)) for i in range(len(features))]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(rows, features) bins; NaN is in the lowest."""
    out = np.zeros(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, np.nan_to_num(x[:, j], nan=-np.inf), side="left")
    return out


def gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(g, h) as whole numbers; ``n_classes`` 0 is a squared error."""
    if n_classes == 0:
        g, h = (margin[:, 0] - y)[:, None] * w[:, None], np.repeat(w[:, None], 1, axis=1)
    else:
        p = softmax(margin)
        g, h = p.copy(), p * (1 - p)
        g[np.arange(len(y)), y.astype(np.int64)] -= 1
        g, h = g * w[:, None], h * w[:, None]
    return np.rint(g * 2.0 ** SCALE).astype(np.int64), np.rint(h * 2.0 ** SCALE).astype(np.int64)


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def leaves(tree: dict, bins: np.ndarray) -> np.ndarray:
    """Node that each binned row ends in."""
    at = np.zeros(len(bins), np.int64)
    for _ in range(tree["depth"]):
        f = tree["feature"][at]
        inner = f >= 0
        if not inner.any():
            break
        right = bins[np.arange(len(bins)), np.maximum(f, 0)] > tree["bin"][at]
        at = np.where(inner, np.where(right, tree["right"][at], tree["left"][at]), at)
    return at


def drawn(block: int, rnd: int, n: int, share: float, seed: int) -> np.ndarray:
    """Rows of a block that round ``rnd`` learns from."""
    if share >= 1:
        return np.ones(n, bool)
    return np.random.default_rng([seed, rnd, block]).random(n) < share


class _Blocks:
    """Packed training rows: (block, n, bins, y, w, margin), replaced by a new copy after each round."""

    def __init__(self, df: DataFrame):
        self.spark, self.folder, self.last = df.sparkSession, os.path.join(checkpoint_dir(df.sparkSession), f"boost-{uuid.uuid4().hex}"), 0
        self._write(df)

    def _write(self, df: DataFrame) -> None:
        path = os.path.join(self.folder, str(self.last))
        df.write.parquet(path)
        self.df = self.spark.read.schema(df.schema).parquet(path)

    def replace(self, df: DataFrame) -> None:
        old = os.path.join(self.folder, str(self.last))
        self.last += 1
        self._write(df)
        delete_path(self.spark, old)

    def close(self) -> None:
        delete_path(self.spark, self.folder)


_BLOCK = "block long, n int, bins binary, y binary, w binary, margin binary"
_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("bins", pa.binary()), ("y", pa.binary()), ("w", pa.binary()), ("margin", pa.binary())])


def _unpack(r: dict, n_features: int, outputs: int):
    get = lambda c, kind: np.frombuffer(r[c], kind)
    return get("bins", np.uint8).reshape(-1, n_features), get("y", float), get("w", float), get("margin", float).reshape(-1, outputs)


def _pack(features: list[str], label: str, weight: str | None, cuts, start: np.ndarray):
    def run(batches):
        for i, b in enumerate(batches):
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
            y = b.column(label).to_numpy(zero_copy_only=False).astype(float)
            w = b.column(weight).to_numpy(zero_copy_only=False).astype(float) if weight else np.ones(len(y))
            for a in range(0, len(y), BLOCK_ROWS):
                s = slice(a, a + BLOCK_ROWS)
                # the block's name depends on its rows alone, not on the task that packs it
                bins = binned(x[s], cuts)
                name = int(np.random.SeedSequence([int(bins.astype(np.int64).sum()), len(y[s]), int(abs(y[s]).sum() * 1000)]).generate_state(1, np.uint64)[0] >> np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                    (name, len(y[s]), bins.tobytes(), y[s].tobytes(), w[s].tobytes(), np.tile(start, (len(y[s]), 1)).tobytes()), _ARROW)], schema=_ARROW)

    return run


def _histograms(trees: list[dict], columns: list[np.ndarray], level: list[np.ndarray], shape: tuple, rnd: int, share: float, seed: int, n_classes: int):
    """Sums per (class, open node, feature, bin) of a task's blocks."""
    n_features, outputs = shape

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                bins, y, w, margin = _unpack(r, n_features, outputs)
                keep = drawn(r["block"], rnd, len(y), share, seed)
                bins, g, h = bins[keep], *(v[keep] for v in gradients(margin, y, w, n_classes))
                for k in range(outputs):
                    at = leaves(trees[k], bins)
                    for node in level[k]:
                        rows = np.flatnonzero(at == node)
                        if not len(rows):
                            continue
                        sums = total.setdefault((k, int(node)), np.zeros((3, len(columns[k]), BINS), np.int64))
                        for i, j in enumerate(columns[k]):
                            c = bins[rows, j]
                            for m, v in enumerate((g[rows, k], h[rows, k], 1)):
                                np.add.at(sums[m, i], c, v)
        out = []
        for (k, node), sums in total.items():
            i, bin_ = np.nonzero(sums[2])
            out.append(pa.table({"k": pa.array(np.full(len(i), k), pa.int32()), "node": pa.array(np.full(len(i), node), pa.int32()),
                                 "feature": pa.array(columns[k][i], pa.int32()), "bin": pa.array(bin_, pa.int32()),
                                 **{c: pa.array(sums[m][i, bin_], pa.int64()) for m, c in enumerate("ghn")}}))
        if out:
            yield from pa.concat_tables(out).to_batches()

    return run


def best_cuts(hist: DataFrame, ridge: float) -> DataFrame:
    """The best cut of each (class, node): rows with bin <= ``bin`` go left."""
    unit = float(2 ** SCALE)
    hist = hist.repartition("k", "node")  # every step below groups by these, so rows move once
    summed = hist.groupBy("k", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
    along = Window.partitionBy("k", "node", "feature").orderBy("bin")
    whole = Window.partitionBy("k", "node", "feature")
    sides = summed.select("k", "node", "feature", "bin", *[F.sum(c).over(along).alias(f"{c}l") for c in "ghn"],
                          *[F.sum(c).over(whole).alias(f"{c}a") for c in "ghn"])
    gl, hl, ga, ha = (F.col(c) / unit for c in ("gl", "hl", "ga", "ha"))
    part = lambda g, h: g * g / (h + ridge)
    gain = part(gl, hl) + part(ga - gl, ha - hl) - part(ga, ha)
    fits = (F.col("nl") < F.col("na")) & (hl >= MIN_HESSIAN) & (ha - hl >= MIN_HESSIAN)
    scored = sides.withColumn("gain", F.when(fits, gain).otherwise(F.lit(-1.0)))
    best = F.max_by(F.struct("gain", "feature", "bin", "gl", "hl", "nl"), F.struct("gain", -F.col("feature"), -F.col("bin")))
    return scored.groupBy("k", "node").agg(best.alias("b"), F.first("ga").alias("ga"), F.first("ha").alias("ha"), F.first("na").alias("na")).select(
        "k", "node", "b.*", "ga", "ha", "na")


def _new_tree() -> dict:
    return dict(depth=0, feature=np.array([-1]), bin=np.array([0]), left=np.array([-1]), right=np.array([-1]), g=np.array([0]), h=np.array([0]),
                n=np.array([0]), gain=np.array([0.0]))


def _grow(tree: dict, cuts: list) -> list[int]:
    """Applies the best cuts of a level; returns the new nodes."""
    t = {k: list(v) if k != "depth" else v for k, v in tree.items()}
    made = []
    for r in sorted(cuts, key=lambda r: r["node"]):
        i = r["node"]
        t["g"][i], t["h"][i], t["n"][i] = r["ga"], r["ha"], r["na"]
        if r["gain"] <= MIN_GAIN:
            continue
        t["feature"][i], t["bin"][i], t["gain"][i] = r["feature"], r["bin"], r["gain"]
        t["left"][i], t["right"][i] = len(t["g"]), len(t["g"]) + 1
        for g, h, n in ((r["gl"], r["hl"], r["nl"]), (r["ga"] - r["gl"], r["ha"] - r["hl"], r["na"] - r["nl"])):
            made.append(len(t["g"]))
            for c, v in (("feature", -1), ("bin", 0), ("left", -1), ("right", -1), ("g", g), ("h", h), ("n", n), ("gain", 0.0)):
                t[c].append(v)
    if made:
        t["depth"] += 1
    tree.update({k: np.array(v) if k != "depth" else v for k, v in t.items()})
    return made


def fit(df: DataFrame, features: list[str], label: str, n_classes: int = 0, weight: str | None = None, rounds: int = 30,
        depth: int = 6, rate: float = 0.3, ridge: float = 1.0, row_share: float = 1.0, column_share: float = 1.0, seed: int = 42) -> dict:
    """Boosted trees on rows with a label: softmax over ``n_classes`` classes 0, 1, ..., or a squared error (0).

    Rows without a label are left out; an empty table gives a model without trees.  Training ends early when no tree of a
    round finds a cut.  The result is a plain dictionary whose size depends on the parameters alone.
    """
    df = df.filter(F.col(label).isNotNull()).select(*features, label, *([weight] if weight else []))
    cuts = cut_points(df, features)
    outputs = max(n_classes, 1)
    start = np.zeros(outputs)
    if n_classes == 0:
        w = F.col(weight) if weight else F.lit(1.0)
        mean = df.agg((F.sum((F.col(label) * w).cast("decimal(38,12)")) / F.sum(w.cast("decimal(38,12)"))).alias("m")).first()["m"]
        start[0] = float(mean or 0.0)
    shape = (len(features), outputs)
    blocks = _Blocks(df.mapInArrow(_pack(features, label, weight, cuts, start), _BLOCK))
    model = dict(features=list(features), cuts=cuts, start=start, n_classes=n_classes, rounds=[])
    rng = np.random.default_rng(seed)
    n_columns = max(1, round(column_share * len(features)))
    try:
        for rnd in range(rounds):
            columns = [np.sort(rng.choice(len(features), n_columns, replace=False)) for _ in range(outputs)]
            trees, level = [_new_tree() for _ in range(outputs)], [np.array([0])] * outputs
            for _ in range(depth):
                run = _histograms(trees, columns, level, shape, rnd, row_share, seed, n_classes)
                found = best_cuts(blocks.df.mapInArrow(run, _HIST), ridge).collect()  # a row for each open node
                level = [np.array(_grow(trees[k], [r for r in found if r["k"] == k]), dtype=np.int64) for k in range(outputs)]
                if not any(len(x) for x in level):
                    break
            if not any(t["n"][0] for t in trees):  # no rows
                break
            for t in trees:
                t["value"] = -rate * (t["g"] / 2.0 ** SCALE) / (t["h"] / 2.0 ** SCALE + ridge)
            model["rounds"].append(trees)
            if all(t["depth"] == 0 for t in trees):
                break
            if rnd + 1 < rounds:
                blocks.replace(blocks.df.mapInArrow(_moved(trees, shape), _BLOCK))
    finally:
        blocks.close()
    return model


def _moved(trees: list[dict], shape: tuple):
    """Blocks with the margins after the trees of a round."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                bins, _, _, margin = _unpack(r, *shape)
                r["margin"] = (margin + np.stack([t["value"][leaves(t, bins)] for t in trees], axis=1)).tobytes()
                yield pa.RecordBatch.from_pylist([r], schema=_ARROW)

    return run


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    """(rows, outputs) margins of raw feature values."""
    bins = binned(x, model["cuts"])
    out = np.tile(model["start"], (len(x), 1))
    for trees in model["rounds"]:
        out += np.stack([t["value"][leaves(t, bins)] for t in trees], axis=1)
    return out


def predict(df: DataFrame, model: dict, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``carry`` and, for classes, ``probabilities`` (they add up to 1 by themselves) and ``class``; otherwise ``prediction``."""
    features, held = model["features"], df.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *carry))

    def run(batches):
        m = held.value
        for b in batches:
            x = np.stack([b.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], axis=1)
            out = margins(m, x) if len(x) else np.zeros((0, len(m["start"])))
            kept = [b.column(c) for c in (key, *carry)]
            if m["n_classes"]:
                p = softmax(out) if len(out) else out
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                extra, names = [lists, pa.array(p.argmax(axis=1) if len(p) else [], pa.int32())], ["probabilities", "class"]
            else:
                extra, names = [pa.array(out[:, 0])], ["prediction"]
            yield pa.RecordBatch.from_arrays([*kept, *extra], [key, *carry, *names])

    told = "probabilities array<double>, class int" if model["n_classes"] else "prediction double"
    return df.select(key, *carry, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]).mapInArrow(run, f"{kinds}, {told}")


def importance(model: dict) -> list[tuple[str, float, int]]:
    """Share of the total gain of each feature, ranked."""
    total = np.zeros(len(model["features"]))
    for trees in model["rounds"]:
        for t in trees:
            np.add.at(total, t["feature"][t["feature"] >= 0], t["gain"][t["feature"] >= 0])
    total = total / (total.sum() or 1.0)
    return [(model["features"][i], float(total[i]), r + 1) for r, i in enumerate(np.argsort(-total, kind="stable"))]
