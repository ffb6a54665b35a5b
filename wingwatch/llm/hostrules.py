"""Host-level quality rules (native).

Base figures of each document come from array functions inside its row; no text is shuffled.  A
document fails the base rules by length or by repeated 8-word windows.  Rule failures are then
aggregated by host (the ``source``), each host's rate is shrunk toward a beta prior fitted to all
hosts by the method of moments, and hosts whose shrunk rate reaches ``HOST_LIMIT`` are rejected;
the verdict is joined back to their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingwatch.llm.common import GAP, let, saved, text_of, words

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PCT = 20, 30
#: a host is rejected when, after shrinkage, at least half of its documents are expected to fail
HOST_LIMIT = 0.5
SYMBOLS = "[#*$%&|<>]"


def _repeated(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more.  Windows are sorted by (hash,
    place); those equal to a neighbour are repeated; in order of place each covers up to the
    next one's start, the last one covers ``WINDOW`` words."""
    def union_length(places: Column) -> Column:
        covered = F.transform(places, lambda p, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(places, i + 1), p + WINDOW) - p))
        return F.aggregate(covered, F.lit(0).cast("long"), lambda a, c: a + c)

    def among(sorted_windows: Column) -> Column:
        twice = F.filter(sorted_windows, lambda w, i: (
            F.coalesce(F.get(sorted_windows, i - 1)["h"] == w["h"], F.lit(False))
            | F.coalesce(F.get(sorted_windows, i + 1)["h"] == w["h"], F.lit(False))))
        return let(F.sort_array(F.transform(twice, lambda w: w["i"])), union_length)

    tagged = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = let(F.array_sort(tagged), among)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(repeats)


def base_figures(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text_of()
    with_words = docs.select(*carry, text.alias("t_"), words(text).alias("w_"))

    def windows(w: Column) -> Column:
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        return let(hashed, lambda hs: F.when(F.size(hs) > WINDOW, F.transform(
            F.sequence(F.lit(1), F.size(hs) - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(hs, i, WINDOW)))))

    figures = let(F.col("w_"), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.coalesce(let(windows(w), _repeated), F.lit(0).cast("long")).alias("n_repeat_words")))
    lines = F.filter(F.split("t_", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return with_words.select(
        *carry, figures.alias("f_"),
        F.length(F.regexp_replace("t_", GAP, "")).cast("long").alias("word_chars"),
        (F.length("t_") - F.length(F.regexp_replace("t_", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(*carry, "f_.n_words", "word_chars", "n_symbols", "n_dup_lines", "f_.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def host_verdicts(flags: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, failures, rate (shrunk), host_failed from (host, failed) rows.

    The prior's mean is the share of failures over all documents; its strength comes from the
    variance of the hosts' rates beyond what binomial noise explains (method of moments, weighted
    by documents).  Without such extra variance the hosts do not differ, and each gets the mean.
    """
    hosts = flags.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures"))
    one = hosts.agg(
        F.sum("n").cast("double").alias("n_all"), F.sum("failures").cast("double").alias("failures_all"),
        F.count(F.lit(1)).cast("double").alias("hosts_all"),
        F.sum(F.col("n").cast("decimal(38,0)") * F.col("n")).cast("double").alias("sum_n2"),
        F.sum(F.round((F.col("failures").cast("double") * F.col("failures")) / F.col("n"), 6).cast("decimal(38,6)"))
        .cast("double").alias("sum_f2_n"))
    mean = F.col("failures_all") / F.col("n_all")
    between = F.col("sum_f2_n") - F.col("failures_all") * mean
    noise = mean * (1 - mean)
    spread = F.col("n_all") - F.col("sum_n2") / F.col("n_all")
    variance = (between - (F.col("hosts_all") - 1) * noise) / F.nullif(spread, F.lit(0.0))
    strength = noise / F.nullif(F.greatest(variance, F.lit(0.0)), F.lit(0.0)) - 1
    prior = one.select(mean.alias("mean"), F.when(variance > 0, F.greatest(strength, F.lit(0.0))).alias("strength"))
    rate = F.when(F.col("strength").isNull(), F.col("mean")).otherwise(
        (F.col("failures") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength")))
    # one row of totals joined to one row per host
    return (hosts.crossJoin(F.broadcast(prior)).withColumn("rate", rate)
            .select("host", "n", "failures", "rate", (F.col("rate") >= limit).alias("host_failed")))


def op6_host_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    host_failed for every row of ``docs``.

    A null or empty text has no words and fails.  All documents without a source form one host.
    Repeated rows are kept apart; each counts for its host.  A rate equal to the limit fails the host.
    A very long text costs its row's task time and memory in proportion to its words.
    """
    figures = saved(base_figures(
        docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("host")),
        ["doc_id", "host"])).withColumn("base_failed", base_failed())
    verdicts = host_verdicts(figures.select("host", F.col("base_failed").alias("failed")))
    return figures.join(verdicts.select("host", "host_failed"), "host").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_failed")


OP6_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('0' || source, '1') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w
  FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range({WINDOW}) AS k(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^ \\x09-\\x0D]') GROUP BY r),
f AS (
  SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[ \\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM f),
h AS (SELECT host, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE base_failed))::DOUBLE AS x FROM b GROUP BY host),
o AS (SELECT sum(n) AS na, sum(x) AS xa, count(*)::DOUBLE AS ha, sum(n * n) AS n2, sum(x * x / n) AS x2 FROM h),
v AS (SELECT *, xa / na AS m, (x2 - xa * xa / na - (ha - 1) * (xa / na) * (1 - xa / na))
             / nullif(na - n2 / na, 0) AS var FROM o),
p AS (SELECT m, CASE WHEN var > 0 THEN greatest(m * (1 - m) / var - 1, 0) END AS k FROM v),
z AS (SELECT host, CASE WHEN k IS NULL THEN m ELSE (x + k * m) / (n + k) END >= {HOST_LIMIT} AS host_failed FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept, host_failed
FROM b JOIN z USING (host)
"""
