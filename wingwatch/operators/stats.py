"""Model-side statistics that are plain aggregates.

They run on any (key, label, prediction, feature) table, so they are checked
on deterministic inputs and reused unchanged on model output.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wingwatch.operators import quantiles as Q
from wingwatch.operators.analytics import mean6
from wingwatch.session import materialize

R6 = 6


def r6(c: Column) -> Column:
    return F.round(c, R6)


# ---- I1 split -------------------------------------------------------------------

SPLIT_BINS = 4096


def split_hash(key: Column, seed: int = 42) -> Column:
    """Portable number below 2^31 from an integer key (LCG step; no overflow for any bigint key
    because the key is reduced mod 2^31 first)."""
    m = 2147483648
    return (F.pmod(key.cast("bigint"), F.lit(m)) * 1103515245 + 12345 + seed) % m


def split_bucket(key: Column, seed: int = 42) -> Column:
    """Portable 0..99 bucket from an integer key (LCG step; no overflow for
    any bigint key because the key is reduced mod 2^31 first)."""
    return (F.floor(split_hash(key, seed) / 65536) % 100).cast("int")


def hash_split(df: DataFrame, key: str, seed: int = 42, train_pct: int = 80) -> DataFrame:
    """Deterministic 80/20 split, stable under repartitioning and retries
    (unlike ``randomSplit``, which depends on partition layout)."""
    return df.withColumn("split", F.when(split_bucket(F.col(key), seed) < train_pct, "train")
                         .otherwise("test"))


def stratified_split(df: DataFrame, key: str, label: str, seed: int = 42, train_pct: int = 80) -> DataFrame:
    """Exact 80/20 split within every class, deterministic.

    Rows of a class are ordered by a hash of the key.  Counts per (class, hash bin) show the bin in
    which the class reaches its share; all bins before it train, all after it test, and only the rows
    of that bin (one in ``SPLIT_BINS``) are ranked, so no class is gathered in a task.  Rows without
    key have a bin of their own, the first.
    """
    rows = df.withColumn("_h", F.coalesce(split_hash(F.col(key), seed), F.lit(-1))).withColumn("_bin", F.floor(F.col("_h") / (2147483648 // SPLIT_BINS)))
    counts = rows.groupBy(label, "_bin").agg(F.count(F.lit(1)).alias("n"))
    by_bin = Window.partitionBy(label).orderBy("_bin")  # at most SPLIT_BINS rows a class
    upto = counts.withColumn("upto", F.sum("n").over(by_bin)).withColumn(
        "want", F.floor((F.sum("n").over(Window.partitionBy(label)) * train_pct + 50) / 100))
    edge = (upto.filter(F.col("upto") >= F.col("want")).groupBy(label)
            .agg(F.min_by(F.struct("_bin", (F.col("want") - F.col("upto") + F.col("n")).alias("take")), "_bin").alias("e"))
            .select(F.col(label).alias("_label"), F.col("e._bin").alias("_edge"), F.col("e.take").alias("_take")))
    # one row per class
    placed = rows.join(F.broadcast(edge), F.col(label).eqNullSafe(F.col("_label")))
    within = F.row_number().over(Window.partitionBy(label, "_bin").orderBy("_h", key))
    at_edge = (placed.filter("_bin = _edge").withColumn("split", F.when(within <= F.col("_take"), "train").otherwise("test")))
    others = placed.filter("_bin <> _edge").withColumn("split", F.when(F.col("_bin") < F.col("_edge"), "train").otherwise("test"))
    return others.unionByName(at_edge).select(*df.columns, "split")


# ---- I3 regression metrics ----------------------------------------------------------

def regression_metrics(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    """N, RMSE, MAE, R^2 and the quality band, in one aggregate."""
    e = F.col(y_hat) - F.col(y)
    agg = df.filter(F.col(y).isNotNull() & F.col(y_hat).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("ss_res"), F.var_pop(y).alias("var_y"))
    ss_tot = F.col("var_y") * F.col("n")
    r2 = F.when(ss_tot > 0, 1 - F.col("ss_res") / ss_tot)
    band = (F.when(r2 > 0.8, "excellent").when(r2 > 0.6, "good").when(r2 > 0.4, "moderate")
            .otherwise("poor"))
    return agg.select("n", r6(F.sqrt("mse")).alias("rmse"), r6(F.col("mae")).alias("mae"),
                      r6(r2).alias("r2"), band.alias("quality"))


# ---- I6 / I7 classification ------------------------------------------------------------

def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_c) per class (k = classes present)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return counts.select(label, "n_c",
                         r6(F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))
                         .alias("weight"))


def with_class_weight(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Attach I6 weights to every row (the per-class table is tiny: broadcast)."""
    return df.join(F.broadcast(class_weights(df, label).select(label, F.col("weight").alias(weight_col))),
                   label)


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts per (actual, predicted)."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per-class precision/recall/F1/support, plus accuracy, macro and
    weighted averages (sklearn ``classification_report`` layout)."""
    cm = confusion_matrix(df, actual, predicted)
    labels = cm.select(F.col("actual").alias("label")).union(cm.select("predicted")).distinct()
    tp = cm.filter(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("label"),
                                                                F.col("count").alias("tp"))
    sup = cm.groupBy(F.col("actual").alias("label")).agg(F.sum("count").alias("support"))
    pred = cm.groupBy(F.col("predicted").alias("label")).agg(F.sum("count").alias("predicted_n"))
    per = (labels.join(tp, "label", "left").join(sup, "label", "left").join(pred, "label", "left")
           .na.fill(0, ["tp", "support", "predicted_n"]))
    prec = F.when(F.col("predicted_n") > 0, F.col("tp") / F.col("predicted_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select(F.col("label").cast("string").alias("label"), prec.alias("precision"),
                     rec.alias("recall"), "support", "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    summary = tot.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("label"), (F.col("tp") / F.col("n")).alias("precision"),
                 (F.col("tp") / F.col("n")).alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                 F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support")))))
    out = per.select("label", "precision", "recall", "f1", "support").unionByName(summary)
    return out.select("label", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                      r6(F.col("f1")).alias("f1"), F.col("support").cast("bigint").alias("support"))


# ---- I8 standardisation, E20 imputation ---------------------------------------------------

def standardize(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """I8: (x - mean) / population std (std 0 -> 1).  One aggregate pass
    yields two numbers per feature; they enter the projection as literals."""
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in features],
                *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()

    def z(c):
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        if m is None:
            return F.lit(None).cast("double")
        return (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0)

    return df.select(*keep, *[z(c).alias(c) for c in features])


def median_impute(df: DataFrame, features: list[str], **kw) -> tuple[DataFrame, dict]:
    """Exact per-feature medians, then ``fillna``."""
    med = Q.medians(df, features, **kw)
    fills = {c: v for c, v in med.items() if v is not None}
    return df.na.fill(fills), med


# ---- E17 -------------------------------------------------------------------------------------

def anomaly_vs_normal(df: DataFrame, flag: str, features: list[str]) -> DataFrame:
    """Mean per feature for anomalous vs normal rows (one conditional
    aggregate), difference %, and band (>50 high, >20 medium, else low)."""
    a = F.col(flag)
    row = df.agg(*[mean6(F.when(a, F.col(c))).alias(f"a{i}") for i, c in enumerate(features)],
                 *[mean6(F.when(~a, F.col(c))).alias(f"n{i}") for i, c in enumerate(features)])
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("anomaly_mean"),
                        F.col(f"n{i}").alias("normal_mean")) for i, c in enumerate(features)]
    long = row.select(F.inline(F.array(*entries)))
    diff = F.when(F.col("normal_mean") != 0,
                  (F.col("anomaly_mean") - F.col("normal_mean")) / F.col("normal_mean") * 100.0
                  ).otherwise(F.lit(0.0))
    return long.select("feature", r6(F.col("anomaly_mean")).alias("anomaly_mean"),
                       r6(F.col("normal_mean")).alias("normal_mean"), r6(diff).alias("diff_pct"),
                       F.when(F.abs(diff) > 50, "high").when(F.abs(diff) > 20, "medium")
                       .otherwise("low").alias("band"))


# ---- G4, G6-G9 ----------------------------------------------------------------------------

def most_anomalous(df: DataFrame, score: str, key: str, k: int = 10) -> DataFrame:
    """K lowest scores (ties by key) with position band 3/2/1 as in the
    reference (first three, next three, rest)."""
    top = df.orderBy(F.asc(score), F.asc(key)).limit(k)
    pos = F.row_number().over(Window.orderBy(F.asc(score), F.asc(key))) - 1
    return top.select(key, score, pos.alias("position")).withColumn(
        "severity_level", F.when(F.col("position") < 3, 3).when(F.col("position") < 6, 2).otherwise(1))


def top_abs_contributions(df: DataFrame, key: str, contrib_cols: list[str], k: int) -> DataFrame:
    """Per row, the k contributions largest in absolute value (ties by
    feature name), long form; a per-row array sort, no shuffle."""
    arr = F.array(*[F.struct((-F.abs(F.col(c))).alias("neg_abs"), F.lit(c).alias("feature"),
                             F.col(c).alias("contribution")) for c in contrib_cols])
    top = F.slice(F.array_sort(F.filter(arr, lambda s: s["contribution"].isNotNull())), 1, k)
    return df.select(key, F.posexplode(top).alias("pos", "s")).select(
        key, (F.col("pos") + 1).alias("rank"), F.col("s.feature").alias("feature"),
        F.col("s.contribution").alias("contribution"))


def extreme_rows(df: DataFrame, score: str, key: str) -> DataFrame:
    """Arg-max and arg-min rows (ties to the smallest key), one aggregate."""
    s, k = F.col(score), F.col(key)
    row = df.filter(s.isNotNull()).agg(
        F.min_by(k, F.struct(-s, k)).alias("hi_key"), F.max(s).alias("hi"),
        F.min_by(k, F.struct(s, k)).alias("lo_key"), F.min(s).alias("lo"))
    return row.select(F.inline(F.array(
        F.struct(F.lit("highest").alias("which"), F.col("hi_key").alias(key), F.col("hi").alias(score)),
        F.struct(F.lit("lowest").alias("which"), F.col("lo_key").alias(key), F.col("lo").alias(score)))))


def percentile_bucket(df: DataFrame, score: str, key: str, **kw) -> DataFrame:
    """Percent rank 0..99 of each row against the exact 1..99 percentile
    grid (99 numbers, broadcast as a literal array); no global window."""
    probs = [i / 100 for i in range(1, 100)]
    grid = Q.exact_quantiles(df, score, probs, **kw)
    arr = F.array(*[F.lit(float(grid[p])) for p in probs])
    return df.select(key, score, F.size(F.filter(arr, lambda g: g <= F.col(score))).alias("percentile_bucket"))


def exact_percent_rank(df: DataFrame, score: str, key: str) -> DataFrame:
    """Percent rank (rank - 1) / (rows - 1) of each row, ties equal, as ``percent_rank()`` over the whole table.

    Equal scores are counted first.  The distinct ones are range-partitioned and sorted, each partition
    adds up its counts in order, and the partitions' sums (one row each) give the offsets; no task
    sees more than a partition.  A single row has rank 0; NULL and NaN scores have no rank.
    """
    spark = df.sparkSession
    kind = df.schema[score].dataType.simpleString()
    ranked = F.col(score).isNotNull() & (~F.isnan(score) if kind in ("double", "float") else F.lit(True))
    counts = df.filter(ranked).groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(parts, "_s").sortWithinPartitions("_s").withColumn("_part", F.spark_partition_id())

    def running(batches):
        total = 0
        for b in batches:
            n = b.column("_n").to_numpy()
            before = total + n.cumsum() - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int64())], [*b.schema.names, "_before"])

    placed = materialize(dealt.mapInArrow(running, f"_s {kind}, _n long, _part int, _before long"))
    sums = sorted((r["_part"], r["here"]) for r in placed.groupBy("_part").agg(F.sum("_n").alias("here")).collect())  # a row a partition
    total = sum(n for _, n in sums)
    offsets, before = [], 0
    for part, n in sums:
        offsets.append((part, before))
        before += n
    places = spark.createDataFrame(offsets, "_part int, _offset long")
    ranks = placed.join(F.broadcast(places), "_part").select(
        "_s", ((F.col("_offset") + F.col("_before")) / float(max(total - 1, 1))).alias("percent_rank"))
    return df.select(key, score).join(ranks, F.col(score) == F.col("_s"), "left").select(key, score, "percent_rank")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows by a seeded, portable hash of the key: the same rows on every run, partitioning
    and engine (``sample()`` is not stable under repartitioning)."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)).limit(n)


# ---- I14-I16 ---------------------------------------------------------------------------------

def mean_abs_importance(contrib: DataFrame, contrib_cols: list[str]) -> DataFrame:
    """Mean |contribution| per feature, ranked."""
    row = contrib.agg(*[mean6(F.abs(F.col(c))).alias(f"m{i}") for i, c in enumerate(contrib_cols)])
    long = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean_abs"))
                                         for i, c in enumerate(contrib_cols)])))
    rank = F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature"))
    return long.select("feature", r6(F.col("mean_abs")).alias("mean_abs_shap"), rank.alias("rank"))


def what_if(df: DataFrame, key: str, base: dict[str, Column], scenarios: list[dict],
            score_fn) -> DataFrame:
    """I16: score a base record and N override scenarios per row in ONE
    projection (no cross join): change, change %, optimal scenario, max
    reduction.  ``score_fn(values: dict[str, Column]) -> Column``."""
    base_score = score_fn(base)
    items = []
    for i, mods in enumerate(scenarios):
        vals = dict(base)
        vals.update({k: F.lit(float(v)) for k, v in mods.items() if k in base})
        items.append(F.struct(score_fn(vals).alias("risk"), F.lit(i + 1).alias("scenario")))
    arr = F.array_sort(F.array(*items))
    best = F.element_at(arr, 1)
    change = best["risk"] - base_score
    return df.select(
        key, r6(base_score).alias("base_risk"),
        F.concat(F.lit("Scenario "), best["scenario"].cast("string")).alias("optimal_scenario"),
        r6(best["risk"]).alias("optimal_risk"),
        r6(F.when(base_score > 0, change / base_score * 100.0).otherwise(0.0)).alias("risk_change_percent"),
        r6(base_score - best["risk"]).alias("max_risk_reduction"))
