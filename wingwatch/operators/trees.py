"""Tree ensembles as arrays: prediction and exact Shapley values.

A fitted ``pyspark.ml`` tree ensemble is saved to the shared checkpoint
folder; its node table (``data/``: treeID, nodeData{id, prediction, rawCount,
leftChild, rightChild, split}) is read back as a DataFrame.  The node table's
size is bounded by the model parameters (trees x 2^(depth+1) nodes), not by
the data, so it is collected and broadcast to a ``mapInPandas`` or ``mapInArrow`` stage that
walks every tree for a whole Arrow batch at once.

Shapley values use the path-dependent expectation of Lundberg et al. (2020), leaf by leaf.  The path to
a leaf has at most ``depth`` distinct features; for feature j let z_j be the share of the training cover
that its splits let through, and o_j whether the row passes them.  A leaf of value v adds
``v (o_j - z_j) * integral over t in [0, 1] of prod over i != j of (z_i (1 - t) + o_i t)`` to feature j:
the integral of t^k (1 - t)^(M - 1 - k) is the Shapley weight k! (M - 1 - k)! / M!.  The integrand is a
polynomial of degree M - 1, so Gauss-Legendre points integrate it exactly.  A leaf needs a table of 2^M
patterns of o with M <= depth, whatever the number of features; rows only look their pattern up.
"""

from __future__ import annotations

import itertools
import math
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wingwatch.session import checkpoint_dir


def ensemble_arrays(spark: SparkSession, model, n_features: int, cuts: list[np.ndarray] | None = None) -> dict:
    """Node arrays per tree plus tree weights for a GBT/RF model.  ``cuts``: those of each feature if the model learned from the
    places among them; thresholds are then cuts."""
    path = os.path.join(checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    nodes = (spark.read.parquet(os.path.join(path, "data"))
             .select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount",
                     "nodeData.leftChild", "nodeData.rightChild",
                     F.col("nodeData.split.featureIndex").alias("feature"),
                     F.col("nodeData.split.leftCategoriesOrThreshold").alias("thr"))
             .collect())
    by_tree: dict[int, list] = {}
    for r in nodes:
        by_tree.setdefault(r["treeID"], []).append(r)
    trees = []
    for tid in sorted(by_tree):
        rows = sorted(by_tree[tid], key=lambda r: r["id"])
        n = len(rows)
        feat = np.full(n, -1, dtype=np.int64)
        thr = np.zeros(n)
        left = np.full(n, -1, dtype=np.int64)
        right = np.full(n, -1, dtype=np.int64)
        value = np.zeros(n)
        cover = np.zeros(n)
        for r in rows:
            i = r["id"]
            value[i] = r["prediction"]
            cover[i] = max(float(r["rawCount"]), 1e-12)
            if r["leftChild"] >= 0:
                feat[i] = r["feature"]
                thr[i] = r["thr"][0] if cuts is None else cuts[feat[i]][int(r["thr"][0])]
                left[i] = r["leftChild"]
                right[i] = r["rightChild"]
        trees.append(dict(feat=feat, thr=thr, left=left, right=right, value=value, cover=cover))
    weights = list(getattr(model, "treeWeights", [1.0] * len(trees)))
    return dict(trees=trees, weights=weights, n_features=n_features)


def predict_arrays(ens: dict, X: np.ndarray) -> np.ndarray:
    """Ensemble prediction for a batch (``x <= threshold`` goes left)."""
    out = np.zeros(X.shape[0])
    rows = np.arange(X.shape[0])
    for t, w in zip(ens["trees"], ens["weights"]):
        idx = np.zeros(X.shape[0], dtype=np.int64)
        while True:
            f = t["feat"][idx]
            internal = f >= 0
            if not internal.any():
                break
            go_left = X[rows, np.maximum(f, 0)] <= t["thr"][idx]
            nxt = np.where(go_left, t["left"][idx], t["right"][idx])
            idx = np.where(internal, nxt, idx)
        out += w * t["value"][idx]
    return out


def _leaf_paths(t: dict):
    """(leaf, {feature: (share of the cover, highest "greater than", lowest "at most")}) of each leaf."""
    stack = [(0, {})]
    while stack:
        node, path = stack.pop()
        f = int(t["feat"][node])
        if f < 0:
            yield node, path
            continue
        l, r = int(t["left"][node]), int(t["right"][node])
        share = t["cover"][l] / (t["cover"][l] + t["cover"][r])
        z, above, atmost = path.get(f, (1.0, -np.inf, np.inf))
        thr = t["thr"][node]
        stack.append((l, path | {f: (z * share, above, min(atmost, thr))}))
        stack.append((r, path | {f: (z * (1.0 - share), max(above, thr), atmost)}))


def _pattern_table(z: np.ndarray) -> np.ndarray:
    """2^M x M: what a leaf of value 1 adds to each feature for every pattern of passed features."""
    m = len(z)
    o = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float)
    points, weights = np.polynomial.legendre.leggauss(m // 2 + 1)
    total = np.zeros_like(o)
    for t, w in zip((points + 1) / 2, weights / 2):
        factor = z * (1 - t) + o * t
        ahead = np.hstack([np.ones((len(o), 1)), np.cumprod(factor, axis=1)[:, :-1]])
        behind = np.hstack([np.cumprod(factor[:, ::-1], axis=1)[:, ::-1][:, 1:], np.ones((len(o), 1))])
        total += w * ahead * behind
    return (o - z) * total


def leaf_tables(ens: dict) -> tuple[list, float]:
    """([(features, above, at most, table)] per leaf, base value) of an ensemble."""
    leaves, base = [], 0.0
    for t, wt in zip(ens["trees"], ens["weights"]):
        for leaf, path in _leaf_paths(t):
            value = wt * t["value"][leaf]
            z = np.array([p[0] for p in path.values()])
            base += value * z.prod()
            if len(z) and value:
                leaves.append((np.array(list(path)), np.array([p[1] for p in path.values()]),
                               np.array([p[2] for p in path.values()]), value * _pattern_table(z)))
    return leaves, float(base)


def shap_arrays(ens: dict, X: np.ndarray, tables: tuple | None = None) -> tuple[np.ndarray, float]:
    """Exact path-dependent Shapley values (rows x features) and base value."""
    leaves, base = tables or leaf_tables(ens)
    phi = np.zeros(X.shape)
    for feats, above, atmost, table in leaves:
        x = X[:, feats]
        # "at most" sends the rest right, missing values too
        passed = ~(x <= above) & ((x <= atmost) | np.isinf(atmost))
        phi[:, feats] += table[passed @ (1 << np.arange(len(feats)))]
    return phi, base


def _batches(ens_b, feature_cols, key, fn):
    def run(it):
        ens = ens_b.value
        for pdf in it:
            X = pdf[feature_cols].to_numpy(dtype=float)
            yield fn(ens, pdf[[key]], X)
    return run


def predict_frame(df: DataFrame, ens: dict, feature_cols: list[str], key: str,
                  out_col: str = "prediction") -> DataFrame:
    """Tree-ensemble prediction as a ``mapInPandas`` stage (Arrow batches)."""
    ens_b = df.sparkSession.sparkContext.broadcast(ens)
    key_type = df.schema[key].dataType.simpleString()

    def fn(ens, keys, X):
        keys = keys.copy()
        keys[out_col] = predict_arrays(ens, X)
        return keys

    return df.select(key, *feature_cols).mapInPandas(
        _batches(ens_b, feature_cols, key, fn), f"{key} {key_type}, {out_col} double")


#: Arrow batches that are solved together, and cells whose values a worker remembers
BATCHES_A_GROUP = 32
KNOWN_CELLS = 50_000


def cell_ids(ens: dict, X: np.ndarray) -> np.ndarray:
    """The cell of each row: its places among the thresholds of each feature, as one number (as bytes where that is too
    small).  Rows of a cell take the same way through every tree."""
    if "cuts" not in ens:
        ens["cuts"] = [np.unique(np.concatenate([t["thr"][t["feat"] == f] for t in ens["trees"]])) for f in range(X.shape[1])]
    # "at most" goes left; missing values go right everywhere
    places = [np.searchsorted(cuts, X[:, f], side="left") for f, cuts in enumerate(ens["cuts"])]
    if math.prod(len(cuts) + 1 for cuts in ens["cuts"]) >= 1 << 62:
        return np.column_stack(places).astype(">i4").view(f"V{4 * len(places)}").ravel()
    ids = np.zeros(len(X), dtype=np.int64)
    for place, cuts in zip(places, ens["cuts"]):
        ids = ids * (len(cuts) + 1) + place
    return ids


def solved(ens: dict, X: np.ndarray) -> np.ndarray:
    """Shapley values and prediction (last column) of each row.  A cell is solved once and remembered in ``ens``."""
    if "tables" not in ens:
        ens["tables"] = leaf_tables(ens)
    cells, first, inverse = np.unique(cell_ids(ens, X), return_index=True, return_inverse=True)
    cells = cells.tolist()
    known, values = ens.get("known", ({}, np.zeros((0, X.shape[1] + 1))))
    if len(known) + len(cells) > KNOWN_CELLS:
        known, values = {}, values[:0]
    new = [i for i, c in enumerate(cells) if c not in known]
    if new:
        x = X[first[new]]
        known |= {cells[i]: len(values) + k for k, i in enumerate(new)}
        values = np.vstack([values, np.column_stack([shap_arrays(ens, x, ens["tables"])[0], predict_arrays(ens, x)])])
    ens["known"] = known, values
    return values[np.array([known[c] for c in cells], dtype=np.int64)][inverse.reshape(-1)]


def shap_frame(df: DataFrame, ens: dict, feature_cols: list[str], key: str) -> DataFrame:
    """Per-row Shapley values ``shap_<feature>``, base value and prediction."""
    ens_b = df.sparkSession.sparkContext.broadcast(ens)
    key_type = df.schema[key].dataType.simpleString()
    names = [key, *[f"shap_{c}" for c in feature_cols], "base_value", "prediction"]

    def run(it):
        ens = ens_b.value
        while group := list(itertools.islice(it, BATCHES_A_GROUP)):
            rows = pa.Table.from_batches(group)
            if not rows.num_rows:
                continue
            X = np.column_stack([rows.column(i + 1).to_numpy() for i in range(len(feature_cols))]).astype(float, copy=False)
            values = solved(ens, X)
            base = np.full(len(X), ens["tables"][1])
            yield from pa.table([rows.column(0), *[pa.array(values[:, i]) for i in range(len(feature_cols))], pa.array(base),
                                 pa.array(values[:, -1])], names=names).to_batches()

    schema = ", ".join([f"{key} {key_type}"] + [f"{nm} double" for nm in names[1:]])
    return df.select(key, *feature_cols).mapInArrow(run, schema)


def what_if_frame(df: DataFrame, ens: dict, feature_cols: list[str], key: str,
                  scenarios: list[dict]) -> DataFrame:
    """I16 (model): base and scenario predictions per row in one map stage
    (no explode/regroup shuffle), clamped 0-100; optimal scenario and max
    reduction per row."""
    ens_b = df.sparkSession.sparkContext.broadcast(ens)
    key_type = df.schema[key].dataType.simpleString()
    col_idx = {c: i for i, c in enumerate(feature_cols)}

    def fn(ens, keys, X):
        base = np.clip(predict_arrays(ens, X), 0, 100)
        preds = []
        for mods in scenarios:
            Xs = X.copy()
            for k, v in mods.items():
                if k in col_idx:
                    Xs[:, col_idx[k]] = v
            preds.append(np.clip(predict_arrays(ens, Xs), 0, 100))
        P = np.vstack(preds) if preds else np.zeros((0, X.shape[0]))
        best = P.argmin(axis=0)
        best_risk = P[best, np.arange(X.shape[0])]
        out = keys.copy()
        out["base_risk"] = base
        out["optimal_scenario"] = [f"Scenario {b + 1}" for b in best]
        out["optimal_risk"] = best_risk
        out["risk_change_percent"] = np.where(base > 0, (best_risk - base) / np.where(base > 0, base, 1) * 100, 0.0)
        out["max_risk_reduction"] = base - best_risk
        return out

    schema = (f"{key} {key_type}, base_risk double, optimal_scenario string, optimal_risk double, "
              "risk_change_percent double, max_risk_reduction double")
    return df.select(key, *feature_cols).mapInPandas(_batches(ens_b, feature_cols, key, fn), schema)


__all__ = ["ensemble_arrays", "predict_arrays", "shap_arrays", "predict_frame", "shap_frame",
           "what_if_frame"]
