"""Secret scan with multipart credential linking (native).

Every part kind is found by a regular expression, leftmost and non-overlapping.  A match's place is
the running sum of the lengths of the pieces between matches and of the matches, in code points.
Strong kinds (``BASE``) are reported as they are.  A weak kind (a random-looking token, a short
password, user:password in an endpoint, a user or key name, an endpoint) means little alone: it is reported only where a complementary part lies in
its scope, that is within ``SCOPE`` code points.  The linking is an interval join: parts are put
into bins of ``BIN`` code points, each weak part's widened interval meets the parts of its bins, and
a left-semi join keeps the weak part once however many partners it has.

Rows with the same doc_id and text are scanned once.  Documents never meet each other, and the
bins keep one long document from being one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wingwatch.llm.common import fresh, let, saved, text_of

SCOPE, BIN = 200, 512

#: kind, pattern, group that is measured, least length of it, character classes that group must mix
KINDS = (
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, ()),
    ("access", "AKIA[A-Z0-9]+", 0, 18, ()),
    ("hex", "[0-9a-f]{16,}", 0, 16, ()),  # the runs of [0-9a-f]+ that have 16 characters or more
    ("token", "[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20, ("[0-9]", "[a-z]", "[A-Z]")),
    ("name", "(?i:user(?:name|_?id)?|login|account|client_?id|access_?key(?:_?id)?|key_?id)"
             "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9@._-]+)", 1, 3, ()),
    ("endpoint", "(?i:https?|ftp|wss?|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\\x20\\x09-\\x0D\"'<>]+"
                 "|(?<![0-9.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])", 0, 7, ()),
    # an assigned value that is too short for "assign" or has other characters
    ("short", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([^\\x20\\x09-\\x0D\"'<>]+?)"
              "(?=[\\x20\\x09-\\x0D\"'<>]|[,;&](?:[\\x20\\x09-\\x0D]|\\z|[A-Za-z_]+[=:])|\\z)", 2, 3, ()),
    # user:password before the @ of an endpoint; a port is no password
    ("inline", "(?<=://)[^\\x20\\x09-\\x0D\"'<>/@:\\[]*:(?![0-9]{1,5}(?:[/?#]|\\z))([^\\x20\\x09-\\x0D\"'<>]+)(?=@)", 1, 1, ()),
)
BASE = 3  # the first kinds are strong
#: weak kind -> kinds that complete it
COMPLEMENTS = {"token": ("access", "name", "endpoint"),
               "name": ("assign", "hex", "token", "short", "inline"),
               "endpoint": ("assign", "access", "hex", "token", "short", "inline"),
               "short": ("access", "name", "endpoint"),
               "inline": ("access", "name", "endpoint")}
#: weak kinds that are secrets themselves
HIDDEN = ("token", "short", "inline")
NAMES = [k[0] for k in KINDS]


def _pieces(text: Column, k: int) -> Column:
    """array<struct<kind, pos, gap, len, ok>> of one kind's matches; null where there is none."""
    _, pattern, group, least, mixed = KINDS[k]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def build(gaps: Column, found: Column, values: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            value = F.get(values, i)
            ok = F.length(value) >= least
            for c in mixed:
                ok = ok & value.rlike(c)
            return F.struct(F.lit(k).alias("kind"), i.alias("pos"), F.length(F.get(gaps, i)).alias("gap"),
                            F.length(m).alias("len"), ok.alias("ok"))

        return F.transform(found, one)

    listed = let(F.split(text, pattern, -1), lambda g: let(whole, lambda f: (
        build(g, f, f) if group == 0 else let(measured, lambda v: build(g, f, v)))))
    return F.when(text.rlike(pattern), listed)


def scan_key() -> Column:
    """Identity of a scanned text: doc_id and text; null ids are told apart from the text 'null'."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), text_of()))


def parts(docs: DataFrame) -> DataFrame:
    """(key, kind, start, end) of all parts, strong and weak; kind is an index into ``KINDS``.
    A weak part that starts inside a strong one is left out."""
    text = text_of()
    rows = docs.select(scan_key().alias("key"),
                       F.explode(F.concat(*[F.coalesce(_pieces(text, k), F.array()) for k in range(len(KINDS))]))
                       .alias("p")).select("key", "p.*")
    rows = rows.groupBy("key", "kind", "pos").agg(F.first("gap").alias("gap"), F.first("len").alias("len"),
                                                  F.first("ok").alias("ok"))
    before = (Window.partitionBy("key", "kind").orderBy("pos")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
              .filter("ok").select("key", "kind", (F.col("end") - F.col("len")).alias("start"), "end"))
    upto = (Window.partitionBy("key").orderBy("start", "kind")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    strong_end = F.max(F.when(F.col("kind") < BASE, F.col("end"))).over(upto)
    return (placed.withColumn("strong_end", strong_end)
            .filter((F.col("kind") < BASE) | F.col("strong_end").isNull() | (F.col("strong_end") <= F.col("start")))
            .drop("strong_end"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Strong parts, and the weak parts that have a complementary part within ``scope``."""
    def binned(rows: DataFrame, reach: int) -> DataFrame:
        first, last = (F.floor((F.col("start") - reach) / BIN), F.floor((F.col("end") + reach) / BIN))
        return rows.withColumn("bin", F.explode(F.sequence(first, last)))

    needs = F.create_map(*[x for weak, kinds in COMPLEMENTS.items() for x in (
        F.lit(NAMES.index(weak)), F.array(*[F.lit(NAMES.index(k)) for k in kinds]))])
    weak = binned(found.filter(F.col("kind") >= BASE), scope).alias("w")
    near = binned(found, 0).alias("n")
    meets = ((F.col("w.key") == F.col("n.key")) & (F.col("w.bin") == F.col("n.bin"))
             & (F.col("n.start") < F.col("w.end") + scope) & (F.col("w.start") < F.col("n.end") + scope)
             & F.array_contains(needs[F.col("w.kind")], F.col("n.kind")))
    held = weak.join(near, meets, "left_semi").select("key", "kind", "start", "end").distinct()
    return found.filter(F.col("kind") < BASE).unionByName(held)


def op9_find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (and n_linked) for every row of ``docs``.

    A null or empty text has no spans (base_sha256 is then that of the empty string).  Spans are
    ``kind:start:end`` in code points, end exclusive, ordered by start, then kind.  Repeated rows
    each get their result; a row with null doc_id is scanned like any other.  The parts of a very long text
    are rows of their own, linked within bins of ``BIN`` code points.
    """
    spans = linked(saved(parts(docs)))
    entry = F.struct(F.col("start"), F.col("kind"), F.col("end"))
    per = spans.groupBy("key").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{NAMES[k]}") for k in range(BASE)],
        F.array_sort(F.collect_list(entry)).alias("all"))
    names = F.array(*[F.lit(n) for n in NAMES])
    told = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    per = per.select("key", *[f"n_{NAMES[k]}" for k in range(BASE)],
                     told(F.filter("all", lambda s: s["kind"] < BASE)).alias("base"), told(F.col("all")).alias("spans"),
                     F.size("all").alias("n_all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = docs.select("doc_id", scan_key().alias("key")).join(per, "key", "left")
    return out.select(
        "doc_id", *[zero(f"n_{NAMES[k]}") for k in range(BASE)],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        (F.coalesce(F.col("n_all"), F.lit(0)) - sum(F.coalesce(F.col(f"n_{NAMES[k]}"), F.lit(0))
                                                    for k in range(BASE))).cast("long").alias("n_linked"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every strong span, and every linked ``HIDDEN`` one, replaced by ``mark``; overlapping
    spans are replaced as one.  n_chars, where the column is there, follows the new text.  Other
    columns and all rows stay; a null text stays null."""
    cut = linked(saved(parts(docs))).filter(F.col("kind").isin([*range(BASE), *map(NAMES.index, HIDDEN)]))
    order = Window.partitionBy("key").orderBy("start", "end")
    earlier = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(earlier.isNull() | (earlier < F.col("start")), 1).otherwise(0)
    islands = (cut.withColumn("opens", opens)
               .withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
               .groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    key, cut_key, listed = (fresh(docs, n) for n in ("scan_key", "cut_key", "cuts"))
    per = saved(islands.groupBy(F.col("key").alias(cut_key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(listed)))
    text, cuts = F.col("text"), F.col(listed)
    kept = F.transform(cuts, lambda s, i: F.substring(
        text, F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0)).cast("int") + 1,
        (s["start"] - F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0))).cast("int")))
    tail = F.substring(text, F.element_at(cuts, -1)["end"].cast("int") + 1, F.length(text))
    clean = F.concat(F.array_join(F.transform(kept, lambda s: F.concat(s, F.lit(mark))), ""), tail)
    joined = docs.withColumn(key, scan_key()).join(per, F.col(key) == F.col(cut_key), "left")
    new_text = F.when(cuts.isNull(), text).otherwise(clean)
    out = {"text": new_text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(cuts.isNull(), F.col("n_chars")).otherwise(F.length(clean).cast(docs.schema["n_chars"].dataType))
    return joined.withColumns(out).select(*docs.columns)
