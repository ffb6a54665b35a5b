"""One-vs-rest gradient boosting for the severity classes (I5): the trees of ``pyspark.ml``'s GBTClassifier, all classes at once.

The rules are those of the library: residuals 4y / (1 + exp(2yF)) of the logistic loss, regression trees by
variance reduction, the first tree with weight 1 and the others with ``rate``, ties to the lower feature, then the
lower cut.  At most ``BINS`` bins a feature; their cuts are midpoints between all distinct values, or between those
next to equal shares of the weight.  The library draws the values from a sample of about 10,000 rows; here they
are those of all rows.

A row is binned once.  A block (the rows of a task) holds bins, classes, weights and margins as arrays; blocks stay
cached between the jobs, get new margins after each round and are checkpointed every ``CHECKPOINT_ROUNDS``.  A level of
the trees of all classes is one job: each block adds up weights, residuals and their squares per (class, node, feature,
bin), and the sums of a node are added in the order of the blocks, so a fit does not depend on the cluster.  Above
``DRIVER_MB`` of them only the best cut of each node comes back to the driver.
"""

from __future__ import annotations

import math
import os
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wingwatch.session import checkpoint_dir, delete_path

BINS = 32
#: rows of a block at most
BLOCK_ROWS = 250_000
#: rounds after which the margins are written, so that a lost block is not computed again from the first round
CHECKPOINT_ROUNDS = 10
#: sums of a level that the driver adds up itself, and those that a task adds up
DRIVER_MB, TASK_MB = 2, 8
#: rows that go down a tree together, so that they stay in cache
WALK_ROWS = 16384
EPS = 2.0 ** -52

_BLOCK = "part int, block int, n int, bins binary, y binary, w binary"
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("bins", pa.binary()), ("y", pa.binary()), ("w", pa.binary())])


def _cuts_of(bins: int, total: float):
    """Cuts (j, x) of rows (j, v, w) that come by feature j and in the order of their values v, which are distinct."""
    stride = total / bins

    def run(batches):
        states: dict[int, dict] = {}
        for b in batches:
            js, vs, ws = (b.column(c).to_numpy(zero_copy_only=False) for c in ("j", "v", "w"))
            edges = np.flatnonzero(np.diff(js)) + 1
            for a, z in zip(np.append(0, edges), np.append(edges, len(js))):
                if a == z:
                    continue
                s = states.setdefault(int(js[a]), dict(first=np.zeros(0), n=0, v=np.zeros(0), cum=np.zeros(0), target=stride, cuts=[]))
                v, cum = np.append(s["v"], vs[a:z]), np.cumsum(np.append(s["cum"], ws[a:z]))
                # a cut lies before the value that takes the running weight further from the target than it was
                sums, at = cum[:-1] + cum[1:], 0
                while (i := max(at, int(np.searchsorted(sums, 2 * s["target"], side="right")))) < len(sums):
                    s["cuts"].append((v[i] + v[i + 1]) / 2)
                    s["target"] += stride
                    at = i + 1
                s["first"] = np.append(s["first"], vs[a:z])[:bins]
                s["n"] += z - a
                s["v"], s["cum"] = v[-1:], cum[-1:]
        for j, s in states.items():
            x = (s["first"][:-1] + s["first"][1:]) / 2 if s["n"] <= bins else np.array(s["cuts"], dtype=float)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), j, np.int32)), pa.array(x)], names=["j", "x"])

    return run


def cut_points(df: DataFrame, features: list[str], weight: str | None, bins: int = BINS) -> list[np.ndarray]:
    """Cuts of each feature over all rows; a value belongs to the bin of the cuts below it (x > cut goes right)."""
    w = (F.col(f"`{weight}`") if weight else F.lit(1)).cast("decimal(38,12)")
    rows = df.select(w.alias("w"), *[(F.col(f"`{c}`").cast("double") + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)])
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("w").cast("double").alias("w")).first()
    if not seen["n"]:
        return [np.zeros(0) for _ in features]
    values = rows.select("w", F.inline(F.array(*[F.struct(F.lit(i).alias("j"), F.col(f"x{i}").alias("v")) for i in range(len(features))])))
    counted = values.groupBy("j", "v").agg(F.sum("w").cast("double").alias("w"))
    placed = counted.repartition("j").sortWithinPartitions("j", "v").mapInArrow(_cuts_of(min(bins, seen["n"]), seen["w"]), "j int, x double").collect()
    return [np.array(sorted(r["x"] for r in placed if r["j"] == i), dtype=float) for i in range(len(features))]


def _pack(features: list[str], cuts: list[np.ndarray]):
    def block(part, number, x, y, w):
        bins = np.stack([np.searchsorted(c, x[j], side="left").astype(np.uint8) for j, c in enumerate(cuts)])
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
            (part, number, len(y), bins.tobytes(), y.astype(np.uint8).tobytes(), w.tobytes()), _ARROW)], schema=_ARROW)

    def run(batches):
        from pyspark import TaskContext

        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            x = np.stack([b.column(f"_x{j}").to_numpy(zero_copy_only=False).astype(float) for j in range(len(features))])
            if not np.isfinite(x).all():
                raise ValueError("features of a fit must not be missing, NaN or infinite")
            y = b.column("_y").to_numpy(zero_copy_only=False)
            w = b.column("_w").to_numpy(zero_copy_only=False).astype(float)
            for a in range(0, len(y), BLOCK_ROWS):
                z = a + BLOCK_ROWS
                held.append((x[:, a:z], y[a:z], w[a:z]))
                n += len(y[a:z])
                if n >= BLOCK_ROWS:
                    yield block(part, number, *(np.concatenate(v, axis=-1) for v in zip(*held)))
                    held, n, number = [], 0, number + 1
        if n:
            yield block(part, number, *(np.concatenate(v, axis=-1) for v in zip(*held)))

    return run


def _started(n_features: int, outputs: int):
    """(task, number, bins, classes, weights, margins) of a stored block."""
    def run(r):
        return (r["part"], r["block"], np.frombuffer(r["bins"], np.uint8).reshape(n_features, -1), np.frombuffer(r["y"], np.uint8),
                np.frombuffer(r["w"]), np.zeros((outputs, r["n"])))

    return run


def walked(tree: dict, bins: np.ndarray) -> np.ndarray:
    """Node that each row of ``bins`` (features, rows) ends in."""
    n = bins.shape[1]
    out = np.zeros(n, np.intp)
    if not tree["depth"]:
        return out
    inner = tree["feature"] >= 0
    feature, cut = np.where(inner, tree["feature"], 0).astype(np.intp), np.where(inner, tree["cut"], 255).astype(np.uint8)
    left = np.where(inner, tree["left"], np.arange(len(inner)))  # the right child is the next node; leaves are their own children
    for a in range(0, n, WALK_ROWS):
        piece = np.ascontiguousarray(bins[:, a:a + WALK_ROWS])
        m = piece.shape[1]
        flat, rows, at, first = piece.ravel(), np.arange(m), np.zeros(m, np.intp), feature * m
        for _ in range(tree["depth"]):
            cell = first.take(at, mode="clip")
            cell += rows
            right = flat.take(cell, mode="clip") > cut.take(at, mode="clip")
            at = left.take(at, mode="clip")
            at += right
        out[a:a + m] = at
    return out


def residuals(margin: np.ndarray, y: np.ndarray, first: bool) -> np.ndarray:
    """What a tree learns: the labels -1 and 1 at first, then the steepest descent of the logistic loss."""
    return y if first else 4.0 * y / (1.0 + np.exp(2.0 * y * margin))


def _sums(trees: list[dict], level: list[np.ndarray], n_bins: np.ndarray, first: bool):
    """((class, open node), (task, number, sums (weight, residual, square; bins of the features one after the other))) of the blocks."""
    ends = np.cumsum(n_bins)

    def run(blocks):
        for part, block, bins, y, w, margin in blocks:
            for k, nodes in enumerate(level):
                if not len(nodes):
                    continue
                slot = np.full(len(trees[k]["feature"]), -1, np.intp)
                slot[nodes] = np.arange(len(nodes))
                at = slot.take(walked(trees[k], bins))
                rows = np.flatnonzero(at >= 0)
                whole = len(rows) == len(at)
                at, wk, yk, fk = (v if whole else v[rows] for v in (at, w, y, margin[k]))
                r = residuals(fk, np.where(yk == k, 1.0, -1.0), first)
                wr = wk * r
                kinds = wk, wr, wr * r
                sums = np.empty((len(nodes), 3, ends[-1]))
                for j, n in enumerate(n_bins):
                    cell = at * n
                    cell += bins[j] if whole else bins[j].take(rows)
                    for m, v in enumerate(kinds):
                        sums[:, m, ends[j] - n:ends[j]] = np.bincount(cell, v, len(nodes) * n).reshape(-1, n)
                for i in np.flatnonzero(np.bincount(at, minlength=len(nodes))):
                    yield (k, int(nodes[i])), (part, block, sums[i])

    return run


def _spread_of(w, s, q):
    """Variance of weighted values from their sums."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w == 0, 0.0, (q - s * s / w) / w)


def best_cut(sums: np.ndarray, n_bins: np.ndarray, known: tuple | None) -> tuple:
    """(gain, feature, cut, sums of the node, left and right) of a node; gain -inf where no cut is fit.

    ``sums`` has the bins of the features one after the other; ``known`` are the sums of the node by the cut that made it."""
    held = np.arange(n_bins.max()) < n_bins[:, None]
    wide = np.zeros((3, *held.shape))
    wide[:, held] = sums
    left = np.cumsum(wide, axis=2)
    right = left[:, :, -1:] - left
    if known is None:
        with_cuts = np.flatnonzero(n_bins > 1)
        known = tuple(left[:, with_cuts[0], 0] + right[:, with_cuts[0], 0]) if len(with_cuts) else tuple(left[:, 0, -1])
    with np.errstate(divide="ignore", invalid="ignore"):
        both = left[0] + right[0]
        gain = _spread_of(*known) - left[0] / both * _spread_of(*left) - right[0] / both * _spread_of(*right)
        fit = (np.arange(held.shape[1]) < n_bins[:, None] - 1) & (left[0] > 0) & (right[0] > 0) & (gain >= 0)
    gain = np.where(fit, gain, -np.inf)
    j, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[j, c]), int(j), int(c), [float(v) for v in (*known, *left[:, j, c], *right[:, j, c])]


def _best(n_bins: np.ndarray, known: dict):
    """Adds up the sums of each (class, node) in the order of its blocks and finds its best cut."""
    def run(rows):
        found = defaultdict(list)
        for key, value in rows:
            found[key].append(value)
        for key, parts in found.items():
            parts.sort(key=lambda p: p[:2])
            total = parts[0][2].copy()
            for _, _, sums in parts[1:]:
                total += sums
            yield key, best_cut(total, n_bins, known.get(key))

    return run


def _new_tree() -> dict:
    return dict(depth=0, feature=[-1], cut=[0], left=[-1], stats=[None])


def _grow(tree: dict, found: list, depth: int, last: bool) -> list[int]:
    """Applies the best cuts (node, cut) of a level; returns the nodes that the next level cuts."""
    open_ = []
    for i, (gain, feature, cut, stats) in sorted(found):
        tree["stats"][i] = tuple(stats[:3])
        if not gain > 0:
            continue
        tree["depth"] = depth + 1
        tree["feature"][i], tree["cut"][i] = feature, cut
        tree["left"][i] = len(tree["feature"])
        for side in (tuple(stats[3:6]), tuple(stats[6:])):
            if not last and abs(float(_spread_of(*side))) >= EPS:
                open_.append(len(tree["feature"]))
            for c, v in (("feature", -1), ("cut", 0), ("left", -1), ("stats", side)):
                tree[c].append(v)
    return open_


def _arrays(tree: dict) -> dict:
    return {c: np.array(tree[c]) if c != "depth" else tree[c] for c in ("depth", "feature", "cut", "left")}


def _moved(trees: list[dict], share: float):
    """A block with its margins after a round."""
    def run(b):
        part, block, bins, y, w, margin = b
        return part, block, bins, y, w, margin + np.stack([t["value"].take(walked(t, bins)) for t in trees]) * share

    return run


def _level(blocks: RDD, trees: list[dict], level: list[list[int]], n_bins: np.ndarray, first: bool) -> list:
    """((class, node), best cut) of each open node."""
    known = {(k, i): trees[k]["stats"][i] for k, nodes in enumerate(level) for i in nodes if trees[k]["stats"][i]}
    sums = blocks.mapPartitions(_sums([_arrays(t) for t in trees], [np.array(x, np.intp) for x in level], n_bins, first))
    mb = sum(map(len, level)) * blocks.getNumPartitions() * n_bins.sum() * 24 / 1e6
    if mb <= DRIVER_MB:
        return [*_best(n_bins, known)(sums.collect())]
    return sums.partitionBy(math.ceil(mb / TASK_MB), lambda key: key[0] * 1_000_003 + key[1]).mapPartitions(_best(n_bins, known)).collect()


def fit(df: DataFrame, features: list[str], label: str, weight: str | None = None, rounds: int = 100, depth: int = 8, rate: float = 0.1) -> dict:
    """Boosted trees for each class 0, 1, ... up to the highest one against the rest, from all rows.

    The result is a plain dictionary whose size depends on the parameters alone; ``rounds`` holds a tree for each round and class.
    """
    spark, path = df.sparkSession, os.path.join(checkpoint_dir(df.sparkSession), f"boost-{uuid.uuid4().hex}")
    outputs = int(df.agg(F.max(f"`{label}`").alias("m")).first()["m"]) + 1
    cuts = cut_points(df, features, weight)
    n_bins = np.array([len(c) + 1 for c in cuts])
    model = dict(features=list(features), cuts=cuts, weights=[1.0] + [rate] * (rounds - 1), rounds=[], outputs=outputs)
    rows = df.select(F.col(f"`{label}`").cast("int").alias("_y"), (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("_w"),
                     *[F.col(f"`{c}`").cast("double").alias(f"_x{j}") for j, c in enumerate(features)])
    rows.mapInArrow(_pack(features, cuts), _BLOCK).write.parquet(path)
    blocks = spark.read.schema(_BLOCK).parquet(path).rdd.map(_started(len(features), outputs)).persist(StorageLevel.MEMORY_AND_DISK)
    before, written = None, []
    try:
        for rnd in range(rounds):
            trees, level = [_new_tree() for _ in range(outputs)], [[0] for _ in range(outputs)]
            for d in range(depth):
                found = _level(blocks, trees, level, n_bins, rnd == 0)
                if before is not None:  # the first job of a round has made its blocks
                    before.unpersist()
                    before = None
                    if blocks.is_checkpointed:
                        written.append(blocks.getCheckpointFile())
                        for old in written[:-1]:
                            delete_path(spark, old)
                        written = written[-1:]
                level = [_grow(trees[k], [(i, cut) for (c, i), cut in found if c == k], d, d + 1 == depth) for k in range(outputs)]
                if not any(level):
                    break
            model["rounds"].append([dict(_arrays(t), value=np.array([s[1] / s[0] if s and s[0] else 0.0 for s in t["stats"]])) for t in trees])
            if rnd + 1 < rounds:
                before, blocks = blocks, blocks.map(_moved(model["rounds"][-1], model["weights"][rnd])).persist(StorageLevel.MEMORY_AND_DISK)
                if (rnd + 1) % CHECKPOINT_ROUNDS == 0:
                    blocks.checkpoint()
    finally:
        for kept in (before, blocks):
            if kept is not None:
                kept.unpersist()
        for old in (path, *written):
            delete_path(spark, old)
    return model


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    """(classes, rows) margins of raw feature values (features, rows); NaN goes right."""
    bins = np.stack([np.where(np.isnan(x[j]), 255, np.searchsorted(c, x[j], side="left")).astype(np.uint8) for j, c in enumerate(model["cuts"])])
    out = np.zeros((model["outputs"], x.shape[1]))
    for trees, share in zip(model["rounds"], model["weights"]):
        for k, t in enumerate(trees):
            out[k] += t["value"].take(walked(t, bins)) * share
    return out


def transform(model: dict, df: DataFrame, key: str) -> DataFrame:
    """``key``, ``rawPrediction`` (a margin for each class) and ``prediction`` (the first class of the highest margin)."""
    held = df.sparkSession.sparkContext.broadcast(model)
    n = len(model["features"])

    def run(batches):
        m = held.value
        for b in batches:
            if not b.num_rows:
                continue
            raw = margins(m, np.stack([b.column(f"_x{j}").to_numpy(zero_copy_only=False).astype(float) for j in range(n)]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(raw.shape[1] + 1) * raw.shape[0], pa.int32()), pa.array(raw.T.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(raw.argmax(axis=0).astype(float))], names=["_key", "rawPrediction", "prediction"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias("_key"), *[F.col(f"`{c}`").cast("double").alias(f"_x{j}") for j, c in enumerate(model["features"])]).mapInArrow(
        run, f"_key {kind}, rawPrediction array<double>, prediction double").withColumnRenamed("_key", key)
