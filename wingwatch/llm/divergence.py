"""Source divergence audit: how far the word use of each source stands from the other sources of its language.

The group-term count matrix of a language is cut into strips of terms, and each strip into k2-trees
(K = 2): a quadrant without any count is one clear bit, all others are cut into four.  The trees of a
strip are traversed jointly for all pairs of groups.  Where both quadrants are clear, every cell
costs the same, so the quadrant is priced by its number of columns; only cells that at least one of
the two groups fills are looked at.

1. Terms are counted per (language, source) over chunks of text inside the tasks, then summed.
2. A language keeps the terms of at least ``MIN_DOCS`` of its documents.
3. Its kept cells are dealt to strips by a hash of the term, and to pairs of row blocks of ``ROWS``
   groups; every strip and pair of row blocks is one group of about ``STRIP_CELLS`` cells.
4. The strips' partial sums per pair of groups are added up; the leading terms of each strip are ranked.

Work grows with the filled cells and with the pairs of groups, which are the result.
All figures are whole numbers: with p = 1 + floor(SCALE (n + 1) / (N + V)) for a count n of N over V
kept terms, a cell costs floor((p - q)^2 / q).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wingwatch.llm.common import _LOWER, row_chunks, saved, text_buffer

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
ROWS, STRIP_CELLS = 64, 100_000
CHUNK = 12 << 20  # bytes of text that are counted at once
FRONTIER = 1 << 18  # pairs of quadrants that are split at once

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


# --- counting ------------------------------------------------------------------------------

def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each term, the terms, row of each term) of the rows of ``data``."""
    inside = _TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = inside[edge]  # a term ends with its row
    at = np.flatnonzero(first)
    row = np.searchsorted(offsets, at, side="right") - 1
    kept = _LOWER[data[inside]]
    ends = np.append(np.flatnonzero(first[inside]), len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, row


def _summed(group: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.Table:
    """(g, term, n, docs) of some rows."""
    code, terms, row = _tokens(data, offsets)
    size = max(len(terms), 1)
    pair, n = np.unique(row * size + code, return_counts=True)
    key = group[pair // size] * size + pair % size
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else np.zeros(0, np.int64)
    key = key[order][head]
    total = np.add.reduceat(n[order], head) if len(head) else head
    docs = np.diff(np.append(head, len(order)))
    return pa.table({"g": pa.array(key // size, pa.int64()), "term": terms.take(pa.array(key % size)),
                     "n": pa.array(total, pa.int64()), "docs": pa.array(docs, pa.int64())})


def _long(group: int, data: np.ndarray) -> pa.Table:
    """The same of one long row, in segments that do not cut a term."""
    parts, at = [], 0
    while at < len(data):
        to = min(at + CHUNK, len(data))
        while to < len(data) and _TERM[data[to]]:
            gap = np.flatnonzero(~_TERM[data[to:to + CHUNK]])
            to = to + int(gap[0]) if len(gap) else min(to + CHUNK, len(data))
        parts.append(_summed(np.array([group]), data[at:to], np.array([0, to - at])).drop_columns(["docs"]))
        at = to
    out = pa.concat_tables(parts).group_by(["g", "term"]).aggregate([("n", "sum")]).rename_columns(["g", "term", "n"])
    return out.append_column("docs", pa.array(np.ones(out.num_rows, np.int64)))


def _count(batches):
    """(lang, source, term, n, docs) of about ``CHUNK`` bytes of text at a time."""
    held, size = [], 0

    def flush():
        table = pa.Table.from_batches(held)
        names = [table.column(c).combine_chunks() for c in ("lang", "source")]
        l, s = (x.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in names)
        _, first, group = np.unique(l * (s.max() + 1) + s, return_index=True, return_inverse=True)
        lang, source = (x.take(pa.array(first)) for x in names)
        data, offsets = text_buffer(table.column("text"))
        for a, b in row_chunks(offsets, CHUNK):
            lo, hi = offsets[a], offsets[b]
            if b - a == 1 and hi - lo > CHUNK:
                found = _long(int(group[a]), data[lo:hi])
            else:
                found = _summed(group[a:b], data[lo:hi], offsets[a:b + 1] - lo)
            g = found.column("g")
            out = pa.table({"lang": lang.take(g), "source": source.take(g), **{c: found.column(c) for c in ("term", "n", "docs")}})
            yield from out.to_batches(max_chunksize=100_000)

    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= CHUNK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def cells(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that hold it."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- exact figures -------------------------------------------------------------------------

def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (n + 1) / total) in whole numbers, for totals below 2^53 (long division by
    thousands, as SCALE (n + 1) itself may not fit)."""
    whole, rest = np.divmod(np.asarray(n, np.int64) + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def cost(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


# --- k2-trees ------------------------------------------------------------------------------

class K2Tree:
    """Quadtree over the filled cells (row, col) of a square of side 2^height.  ``child[l][4 i + 2 r + c]`` is the
    place, within the next level, of the quadrant in row half r and column half c of node i, or -1
    where it is clear; on the last level it is the place of a cell in ``order``."""

    def __init__(self, row: np.ndarray, col: np.ndarray, height: int):
        code = np.zeros(len(row), np.int64)
        for i in range(height):
            code |= ((row >> i & 1) << (2 * i + 1)) | ((col >> i & 1) << (2 * i))
        self.height, self.order = height, np.argsort(code, kind="stable")
        code, self.child = code[self.order], []
        nodes = np.unique(code >> (2 * height))
        self.empty = not len(nodes)
        for level in range(height):
            below = np.unique(code >> (2 * (height - level - 1)))
            at = np.full(4 * len(nodes), -1, np.int64)
            at[4 * np.searchsorted(nodes, below >> 2) + (below & 3)] = np.arange(len(below))
            self.child.append(at)
            nodes = below


def traverse(a: K2Tree, b: K2Tree, rows: tuple[int, int], cols: int, fill, price) -> None:
    """Joint traversal of all pairs (row of ``a``, row of ``b``) over the same columns.  ``fill(i, j, x, y)`` gets
    the pairs of cells of which one is filled: rows and places in the trees' orders, -1 where clear;
    ``price(level side, i, j, n)`` gets clear pairs of row blocks and the number of their columns.  With ``a is b``
    only pairs i < j count, and blocks with i <= j are visited."""
    same, height = a is b, a.height
    root = np.zeros(1, np.int64)
    stack = [(0, *(root - 1 if t.empty else root for t in (a, b)), root, root, root)]
    if a.empty and b.empty:
        price(height, root, root, np.array([cols]))
        return
    while stack:
        level, x, y, i, j, c = stack.pop()
        if level == height:
            fill(i, j, x, y)
            continue
        if len(x) > FRONTIER:
            stack += [(level, *(v[k:k + FRONTIER] for v in (x, y, i, j, c))) for k in range(0, len(x), FRONTIER)]
            continue
        side, kept = height - level - 1, []
        for half in range(8):
            di, dj, dc = half >> 2, half >> 1 & 1, half & 1
            ni, nj, nc = 2 * i + di, 2 * j + dj, 2 * c + dc
            ok = (ni << side < rows[0]) & (nj << side < rows[1]) & (nc << side < cols)
            if same:
                ok &= ni <= nj if side else ni < nj
            ok = np.flatnonzero(ok)
            if not len(ok):
                continue
            ni, nj, nc = ni[ok], nj[ok], nc[ok]
            nx = np.where(x[ok] >= 0, a.child[level][4 * x[ok] + 2 * di + dc], -1)
            ny = np.where(y[ok] >= 0, b.child[level][4 * y[ok] + 2 * dj + dc], -1)
            clear = (nx < 0) & (ny < 0)
            if clear.any():
                first = nc[clear] << side
                price(side, ni[clear], nj[clear], np.minimum(cols - first, 1 << side))
            kept.append([v[~clear] for v in (nx, ny, ni, nj, nc)])
        if kept:
            stack.append((level + 1, *(np.concatenate(v) for v in zip(*kept))))


def pair_sums(row_a, col_a, p_a, zero_a, row_b, col_b, p_b, zero_b, cols: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sum over all columns of cost(p of i, p of j) for each row i of a and j of b, the same with the parts
    exchanged).  ``zero`` is a row's p where its count is 0."""
    ra, rb = len(zero_a), len(zero_b)
    there, back = np.zeros((ra, rb), np.int64), np.zeros((ra, rb), np.int64)
    if not cols or not ra or not rb:
        return there, back
    height = max(int(max(ra, rb, cols) - 1).bit_length(), 1)
    a = K2Tree(row_a, col_a, height)
    b = a if same else K2Tree(row_b, col_b, height)
    va, vb = np.append(p_a[a.order], 0), np.append((p_a if same else p_b)[b.order], 0)
    clear: dict[int, np.ndarray] = {}

    def fill(i, j, x, y):
        p, q = np.where(x >= 0, va[x], zero_a[i]), np.where(y >= 0, vb[y], zero_b[j])
        square = (p - q) * (p - q)
        np.add.at(there, (i, j), square // q)
        np.add.at(back, (i, j), square // p)

    def price(side, i, j, n):
        if side not in clear:
            clear[side] = np.zeros((((ra - 1) >> side) + 1, ((rb - 1) >> side) + 1), np.int64)
        np.add.at(clear[side], (i, j), n)

    traverse(a, b, (ra, rb), cols, fill, price)
    i, j = np.meshgrid(np.arange(ra), np.arange(rb), indexing="ij")
    free = sum((n[i >> side, j >> side] for side, n in clear.items()), np.zeros((ra, rb), np.int64))
    p, q = zero_a[i], zero_b[j]
    return there + free * cost(p, q), back + free * cost(q, p)


# --- strips --------------------------------------------------------------------------------

STRIP = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("term", pa.string()), ("value", pa.int64())])


def _strip(table: pa.Table) -> pa.Table:
    """Partial sums of the pairs of groups of one strip and two row blocks, and the strip's leading terms.
    Rows without a term are groups: n is their N, total the language's N, v its number of terms and
    cols those of them in the strip; columns that neither row block fills are clear quadrants."""
    lang, x, y = (table.column(c)[0].as_py() for c in ("lang", "x", "y"))
    is_group = pc.is_null(table.column("term"))
    groups, filled = table.filter(is_group), table.filter(pc.invert(is_group))
    number = lambda t, c: t.column(c).to_numpy()
    gid, size = number(groups, "gid"), number(groups, "n")
    order = np.argsort(gid)
    gid, size = gid[order], size[order]
    v, all_n = groups.column("v")[0].as_py(), groups.column("total")[0].as_py()
    whole = size + v
    block = gid // ROWS
    zero = share(np.zeros(len(gid), np.int64), np.maximum(whole, 1))
    cell = np.searchsorted(gid, number(filled, "gid")) if filled.num_rows else np.zeros(0, np.int64)
    coded = filled.column("term").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cols = groups.column("cols")[0].as_py()
    p = share(number(filled, "n"), whole[cell]) if filled.num_rows else cell
    # columns that the same groups fill stand together, so that clear quadrants are large
    held = np.zeros(len(terms), np.uint64)
    np.bitwise_or.at(held, code, np.uint64(1) << (cell % 64).astype(np.uint64))
    place = np.empty(len(terms), np.int64)
    place[np.argsort(held, kind="stable")] = np.arange(len(terms))
    col = place[code]
    one, two = np.flatnonzero(block == x), np.flatnonzero(block == y)
    in_one, in_two = (np.isin(cell, z) for z in (one, two))
    there, back = pair_sums(cell[in_one] - one[0], col[in_one], p[in_one], zero[one], cell[in_two] - two[0], col[in_two], p[in_two],
                            zero[two], cols, x == y)
    i, j = np.meshgrid(gid[one], gid[two], indexing="ij")
    use = i < j
    n = int(use.sum())
    a, b = np.concatenate([i[use], j[use]]), np.concatenate([j[use], i[use]])
    value = np.concatenate([there[use], back[use]])
    out = [pa.table([pa.array([lang] * (2 * n), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                     pa.nulls(2 * n, pa.string()), pa.array(value, pa.int64())], schema=STRIP)]
    if x == y and filled.num_rows:
        q = share(number(filled, "total"), np.int64(all_n + v))
        more = np.flatnonzero(p > q)
        worth = cost(p[more], q[more])
        rank = np.empty(len(terms), np.int64)
        rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))  # by UTF-8 bytes
        by = np.lexsort((rank[code[more]], -worth, cell[more]))
        who = cell[more][by]
        start = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else who
        lead = by[np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who)))) < TOP] if len(who) else by
        out.append(pa.table([pa.array([lang] * len(lead), pa.string()), pa.array(gid[cell[more][lead]], pa.int32()),
                             pa.nulls(len(lead), pa.int32()), terms.take(pa.array(code[more][lead])),
                             pa.array(worth[lead], pa.int64())], schema=STRIP))
    return pa.concat_tables(out)


def strips(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups: lang, source, gid; partial results of all strips)."""
    found = saved(cells(docs))
    kept = saved(found.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("d"), F.count(F.lit(1)).alias("cells"))
                 .filter(F.col("d") >= MIN_DOCS).drop("d"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"), F.sum("cells").alias("cells"))
    filled = saved(found.drop("docs").join(kept.drop("cells"), ["lang", "term"]))
    sizes = filled.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    by_source = Window.partitionBy("lang").orderBy("source")  # a row a source
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = saved(groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0).select(
        "lang", "source", (F.row_number().over(by_source) - 1).alias("gid"), F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("groups"),
        "size", "v", "lang_n", (F.floor(F.col("cells") / STRIP_CELLS) + 1).cast("int").alias("n_strips")))
    blocks = F.floor((F.col("groups") - 1) / ROWS)
    mine = F.floor(F.col("gid") / ROWS)

    def paired(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks)))
        return rows.select("lang", "strip", F.least(mine, "other").alias("x"), F.greatest(mine, "other").alias("y"), "gid", "term", "n", "total", "v", "cols")

    none, strip = F.lit(0).cast("long"), F.pmod(F.xxhash64("term"), F.col("n_strips")).cast("int")
    held = paired(filled.join(groups.drop("v"), ["lang", "source"]).withColumn("v", none).withColumn("cols", none).withColumn("strip", strip))
    per_lang = groups.select("lang", "n_strips").distinct()
    widths = kept.join(per_lang, "lang").groupBy("lang", strip.alias("strip")).agg(F.count(F.lit(1)).alias("cols"))
    marks = paired(groups.withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("n_strips") - 1)))
                   .join(widths, ["lang", "strip"], "left").na.fill(0, ["cols"])
                   .select("*", F.lit(None).cast("string").alias("term"), F.col("size").alias("n"), F.col("lang_n").alias("total")))
    parts = held.unionByName(marks).groupBy("lang", "strip", "x", "y").applyInArrow(
        lambda t: _strip(t), "lang string, a int, b int, term string, value long")
    return groups.select("lang", "source", "gid"), saved(parts)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: each source against the others of its language (part ``pair``)
    and its leading terms against the language (part ``term``, ``TOP`` ranks).

    Null text, lang and source are empty ones.  A repeated row counts each time.  Equal values are
    ranked by the items' UTF-8 bytes.  A language without kept terms has pairs of value 0.  A very
    long text is counted in segments.  An empty table has no rows.
    """
    groups, parts = strips(docs)
    pairs = parts.filter("term IS NULL").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("b"))
    mine = groups.withColumnRenamed("gid", "a")
    pairs = pairs.join(mine, ["lang", "a"]).join(other, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = parts.filter("term IS NOT NULL").select("lang", "a", F.col("term").alias("item"), "value")
    best = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TOP).join(mine, ["lang", "a"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # a row a source
    return (pairs.withColumn("rank", F.row_number().over(order))
            .unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")))


def op13_source_divergence(docs: DataFrame) -> DataFrame:
    return audit(docs)


OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM t GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY lang, term HAVING sum(docs) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
kc AS (SELECT c.* FROM c JOIN k USING (lang, term)),
s AS (SELECT lang, source, sum(n) AS size FROM kc GROUP BY lang, source),
g AS (SELECT lang, source, coalesce(size, 0) AS size, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(kc.n, 0) AS n,
       1 + (CAST({SCALE} AS HUGEINT) * (coalesce(kc.n, 0) + 1)) // CAST(g.size + g.v AS HUGEINT) AS p,
       1 + (CAST({SCALE} AS HUGEINT) * (k.total + 1)) // CAST(v.lang_n + v.v AS HUGEINT) AS lang_p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang
  LEFT JOIN kc ON kc.lang = g.lang AND kc.source = g.source AND kc.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sums.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - lang_p) * (p - lang_p) // lang_p AS BIGINT) FROM p WHERE n > 0 AND p > lang_p),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM every)
SELECT * FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
