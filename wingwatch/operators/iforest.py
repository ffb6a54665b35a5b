"""Isolation forest (Liu, Ting & Zhou 2008) as Spark stages.

Training never looks at more than a bounded sample per tree:
* one hash per row, taken as a point in [0, 1), decides by itself which tree, if any, the row is
  a candidate of: tree t owns an interval as wide as 2 * psi / N, so most rows of a large table
  belong to no tree and stop there, and every tree sees about 2 * psi rows whatever N is.  Where
  the trees' intervals do not fit side by side (N < 2 * T * psi) they are laid out in several
  turns, each with a hash of its own;
* the psi lowest points of each tree are its sample (without replacement).  This bottom-k merges:
  every task keeps psi rows a tree before the shuffle (a row-number limit), and
  ``groupBy(tree).applyInPandas`` grows one isolation tree from them to height ceil(log2 psi)
  with seeded random splits;
* the node table (trees x < 2 * psi nodes, bounded by the parameters) is
  collected and broadcast; a ``mapInArrow`` stage computes the mean path
  length of every row with the c(n) leaf correction.

Scores follow scikit-learn's conventions: ``score = -2^(-E[h] / c(psi))``,
``offset`` = the ``contamination`` quantile of the training scores (exact,
distributed), ``decision = score - offset``, anomaly when ``decision < 0``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wingwatch.session import keep

from wingwatch.operators import quantiles as Q

EULER = 0.5772156649


def c_factor(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(X: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One isolation tree: rows of (node, feature, threshold, left, right, size)."""
    nodes: list[list] = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(idx)])
        if depth >= limit or len(idx) <= 1:
            return me
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return me
        q = int(rng.choice(usable))
        p = float(rng.uniform(lo[q], hi[q]))
        go_left = sub[:, q] < p
        nodes[me][1], nodes[me][2] = q, p
        nodes[me][3] = build(idx[go_left], depth + 1)
        nodes[me][4] = build(idx[~go_left], depth + 1)
        return me

    build(np.arange(X.shape[0]), 0)
    return [tuple(n) for n in nodes]


NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int"


def draws(df: DataFrame, key: str, n: int, psi: int, n_trees: int = 100, seed: int = 42) -> DataFrame:
    """``df`` with ``tree`` and ``point`` for the rows that trees draw: the ``psi`` lowest points of each tree.

    One row is drawn at most once by a tree, and by one tree a turn; with n >= 2 * n_trees * psi there
    is one turn and one hash a row.  Rows that repeat a key share its point; the limit keeps psi of them.
    """
    width = min(1.0, 2.0 * psi / max(n, 1))  # of a tree's interval
    a_turn = max(1, min(n_trees, int(1.0 / width)))
    turns = math.ceil(n_trees / a_turn)
    rows = df.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))) if turns > 1 else F.lit(0))
    point = F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.col("_turn")), F.lit(1 << 52)) / float(1 << 52)
    tree = (F.col("_turn") * a_turn + F.floor(F.col("point") / width)).cast("int")
    rows = (rows.withColumn("point", point).filter(F.col("point") < width * a_turn)
            .withColumn("tree", tree).filter(F.col("tree") < n_trees).drop("_turn"))
    lowest = Window.partitionBy("tree").orderBy("point", key)
    return rows.withColumn("_place", F.row_number().over(lowest)).filter(F.col("_place") <= psi).drop("_place")


def fit(df: DataFrame, features: list[str], key: str, n_trees: int = 100, max_samples: int = 256,
        seed: int = 42) -> dict:
    """Grow the forest; returns the broadcastable model (node arrays + psi)."""
    n = df.count()
    psi = int(min(max_samples, n))
    limit = int(math.ceil(math.log2(max(psi, 2))))
    cand = draws(df.select(key, *features), key, n, psi, n_trees, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["point", key])
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        rows = _grow(pdf[features].to_numpy(dtype=float), rng, limit)
        return pd.DataFrame([(tree, *r) for r in rows],
                            columns=["tree", "node", "feature", "threshold", "left", "right", "size"])

    nodes = cand.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).collect()
    trees: dict[int, list] = {}
    for r in nodes:
        trees.setdefault(r["tree"], []).append(r)
    arrays = []
    for t in sorted(trees):
        rows = sorted(trees[t], key=lambda r: r["node"])
        arrays.append(dict(
            feat=np.array([r["feature"] for r in rows], dtype=np.int64),
            thr=np.array([r["threshold"] for r in rows]),
            left=np.array([r["left"] for r in rows], dtype=np.int64),
            right=np.array([r["right"] for r in rows], dtype=np.int64),
            size=np.array([r["size"] for r in rows], dtype=float)))
    return dict(trees=arrays, psi=psi, features=list(features))


PATH_ROWS = 4096
#: inner nodes of the trees that are looked up together; their tables take at most the square of it in bits
GROUP_NODES = 16_384


def _tree_masks(tree: dict, cuts: list) -> tuple:
    """A tree for looking up: ([(feature, words of leaf bits by place among the feature's cuts)], path length by leaf bit).

    Leaves are numbered from left to right, so the leaves under a node are a run.  At each place of a feature the bits of
    the leaves stay that its splits let through; the bits that stay for all features are those of one leaf.
    """
    feat, left, right, leaf = tree["feat"], tree["left"], tree["right"], tree["feat"] < 0
    first, under, depth = np.cumsum(leaf) - leaf, leaf.astype(np.int64), np.zeros(len(feat))
    inner = np.flatnonzero(~leaf)
    for i in inner:  # a child comes after its parent, the left subtree before the right
        depth[left[i]] = depth[right[i]] = depth[i] + 1
    for i in inner[::-1]:
        under[i] = under[left[i]] + under[right[i]]
    n, words = int(leaf.sum()), -(-int(leaf.sum()) // 64)
    masks = []
    for f in np.unique(feat[inner]):
        stays = np.zeros((len(cuts[f]) + 1, 64 * words), dtype=bool)
        stays[:, :n] = True
        for i in np.flatnonzero(feat == f):
            place = int(np.searchsorted(cuts[f], tree["thr"][i])) + 1
            stays[:place, first[right[i]]:first[right[i]] + under[right[i]]] = False
            stays[place:, first[left[i]]:first[left[i]] + under[left[i]]] = False
        masks.append((int(f), np.packbits(stays, axis=1, bitorder="little").view("<u8")))
    return masks, (depth + c_factor(tree["size"]))[leaf]


def path_tables(model: dict, n_features: int) -> list:
    """[(sorted cuts per feature, trees)] for ``path_lengths``, the trees in groups."""
    groups: list[list] = [[]]
    nodes = 0
    for t in model["trees"]:
        nodes += len(t["feat"]) // 2
        if nodes > GROUP_NODES and groups[-1]:
            groups.append([])
            nodes = len(t["feat"]) // 2
        groups[-1].append(t)
    out = []
    for trees in groups:
        cuts = [np.unique(np.concatenate([t["thr"][t["feat"] == f] for t in trees])) for f in range(n_features)]
        out.append((cuts, [_tree_masks(t, cuts) for t in trees]))
    return out


def path_lengths(model: dict, X: np.ndarray, tables: list | None = None) -> np.ndarray:
    """Mean path length of each row.  A row's place among the cuts of each feature is found once for a group of trees;
    each tree then takes one look-up a feature, in pieces of rows that stay in the processor's cache."""
    tables = path_tables(model, X.shape[1]) if tables is None else tables
    total = np.zeros(X.shape[0])
    for a in range(0, X.shape[0], PATH_ROWS):
        x = X[a:a + PATH_ROWS]
        for cuts, trees in tables:
            # below a cut goes left, the rest right, missing values too
            place = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
            for masks, length in trees:
                if not masks:
                    total[a:a + PATH_ROWS] += length[0]
                    continue
                stays = masks[0][1].take(place[masks[0][0]], axis=0)
                for f, words in masks[1:]:
                    np.bitwise_and(stays, words.take(place[f], axis=0), out=stays)
                bit, at = stays[:, 0], 0
                for w in range(1, stays.shape[1]):
                    bit, at = bit | stays[:, w], at + 64 * w * (stays[:, w] != 0)
                # the exponent of a power of two as a double
                total[a:a + PATH_ROWS] += length.take((bit.astype(np.float64).view(np.int64) >> 52) - 1023 + at)
    return total / len(model["trees"])


def score_samples(df: DataFrame, model: dict, key: str) -> DataFrame:
    """``score = -2^(-E[h]/c(psi))`` per row via ``mapInArrow``."""
    feats = model["features"]
    mb = df.sparkSession.sparkContext.broadcast(model)
    key_type = df.schema[key].dataType.simpleString()
    denom = float(c_factor(np.array([model["psi"]]))[0]) or 1.0

    def run(it):
        m = mb.value
        if "tables" not in m:
            m["tables"] = path_tables(m, len(feats))  # once a worker
        for batch in it:
            X = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(feats))]).astype(float, copy=False)
            score = -np.power(2.0, -path_lengths(m, X, m["tables"]) / denom)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=[key, "score"])

    return df.select(key, *feats).mapInArrow(run, f"{key} {key_type}, score double")


def detect(df: DataFrame, model: dict, key: str, contamination: float = 0.05) -> DataFrame:
    """Decision score and anomaly flag with the contamination offset."""
    # written once to the shared checkpoint folder: the quantile passes and the
    # final projection read it instead of re-running the Python scorer
    scored = keep(score_samples(df, model, key))
    offset = Q.exact_quantiles(scored, "score", [contamination])[contamination]
    return scored.select(key, F.col("score").alias("score_sample"),
                         (F.col("score") - F.lit(offset)).alias("anomaly_score"),
                         ((F.col("score") - F.lit(offset)) < 0).alias("is_anomaly"))
