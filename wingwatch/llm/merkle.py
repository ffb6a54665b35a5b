"""Merkle manifest of a dataset: a SHA midstate tree.

Every document is a leaf.  The leaves of a language ascend by doc_id; runs of ``FAN`` nodes become one
parent until one node, the subroot, remains, and the subroots ordered by language give the root in
the same way.  A parent keeps, for every child slot, the state of its hash before that child was fed.
A check of one changed leaf ("folding") resumes that state, feeds the replacement and the siblings
to its right, and goes on one level up; nothing to the left is hashed again.

1. Leaves are hashed next to the scan.  A range partition by (language, doc_id), the rows of each
   partition numbered in order, and the partitions' sums give every leaf its place.
2. ``BLOCK`` leaves (``DEPTH`` levels) are one row of the manifest: node digests and midstates.  The
   blocks' tops are the nodes of the next round, so a tree of any size takes few rounds.
3. From the top down every block gets its path: per level above it its slot, the midstate before
   that slot and the digests of its run.  All leaves of a block share the path.
4. Each block folds its leaves through its own levels, then along its path.

No step holds more than one block a task, and a language with most of the rows is many blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wingwatch.llm import sha
from wingwatch.llm.common import saved

FAN, DEPTH = 8, 4
BLOCK = FAN ** DEPTH
LANES = 8192  # leaves that are folded together
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- leaves --------------------------------------------------------------------------------

def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a row: every field as its UTF-8 length, a colon and its value, or ``-`` where null."""
    def told(value: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    values = [F.col(c).cast("string") for c in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return F.unhex(F.sha2(F.concat(*[told(v) for v in values]), 256))


def tampered() -> Column:
    """Whether the audit changes the row: 3 divides crc32 of the decimal doc_id (never for a null one)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))


def tree_of(lang: str = "lang") -> Column:
    """Text that orders languages bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit(""))


# --- places --------------------------------------------------------------------------------

def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with idx, the place in its ``tree`` by ``order``, and n, the size of the tree.
    Rows that are equal in ``order`` take neighbouring places in any order."""
    spark, kinds = rows.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal rows have to be dealt to several partitions too
    spread = rows.withColumn("salt", F.monotonically_increasing_id())
    dealt = (spread.repartitionByRange(parts, "tree", *order, "salt").sortWithinPartitions("tree", *order, "salt")
             .drop("salt").withColumn("part", F.spark_partition_id()))
    numbered = saved(dealt.mapInArrow(_number, f"{kinds}, part int, place long"))
    sums = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("here"))
    tree = Window.partitionBy("tree")  # a row for each partition that holds some of the tree
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("tree", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"),
                       F.sum("here").over(tree).alias("n"))
    return (numbered.join(sums, ["tree", "part"]).withColumn("idx", F.col("offset") + F.col("place"))
            .drop("part", "place", "offset"))


def _number(batches):
    """Places within (partition, tree); the rows come in order."""
    last, at = None, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        tree = b.column("tree").to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = tree[1:] != tree[:-1]
        new[0] = tree[0] != last
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        place = np.where(start >= 0, np.arange(n) - start, np.arange(n) + at)
        last, at = tree[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], [*b.schema.names, "place"])


# --- blocks --------------------------------------------------------------------------------

def depth(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _above(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parents of (8, m) ``nodes``, the midstate before each node in its parent)."""
    m = nodes.shape[1]
    sizes = np.minimum(FAN, m - np.arange(0, m, FAN))
    state, mid, text = sha.begin(len(sizes)), np.empty_like(nodes), sha.hex_block(nodes)
    for slot in range(FAN):
        held = len(sizes) - int(sizes[-1] <= slot)  # only the last run may be short
        if not held:
            break
        at = np.arange(held) * FAN + slot
        mid[:, at] = state[:, :held]
        state[:, :held] = sha.feed(state[:, :held], text[:, at])
    return sha.feed(state, sha.closing(sizes)), mid


def _block_kind(doc_id: str) -> str:
    return f"tree string, n long, block long, levels int, nodes binary, mids binary, top binary, probes binary, ids array<{doc_id}>"


def _builder(rnd: int, schema: pa.Schema):
    """Manifest row of one block: its nodes level by level, and the midstate before each of them."""
    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("idx").to_numpy())
        table = table.take(pa.array(order))
        n = table.column("n")[0].as_py()
        nodes = sha.from_bytes(b"".join(table.column("digest").to_pylist()))
        levels = min(max(depth(n) - rnd * DEPTH, 0), DEPTH)
        all_nodes, mids = [nodes], []
        for _ in range(levels):
            nodes, mid = _above(nodes)
            all_nodes.append(nodes)
            mids.append(mid)
        row = [table.column("tree")[0].as_py(), n, table.column("block")[0].as_py(), levels,
               sha.to_bytes(np.concatenate(all_nodes, axis=1)), b"".join(sha.to_bytes(m) for m in mids), sha.to_bytes(nodes),
               b"".join(table.column("probe").to_pylist()) if rnd == 0 else b"", table.column("doc_id").to_pylist() if rnd == 0 else []]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return build


def rounds(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Manifest blocks of all trees over ``nodes`` (tree, n, idx, digest, probe, doc_id), round by round:
    the tops of a round's blocks are the nodes of the next.  A tree of n leaves ends in the first
    round r with n <= BLOCK^(r+1)."""
    kind = _block_kind(nodes.schema["doc_id"].dataType.simpleString())
    arrow = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("levels", pa.int32()), ("nodes", pa.binary()),
                       ("mids", pa.binary()), ("top", pa.binary()), ("probes", pa.binary()), ("ids", pa.list_(_arrow_kind(nodes, "doc_id")))])
    made: list[DataFrame] = []
    while True:
        build = _builder(len(made), arrow)
        rows = nodes.select("tree", F.col("n").cast("long").alias("n"), "idx", "digest", "probe", "doc_id",
                            F.floor(F.col("idx") / BLOCK).cast("long").alias("block"))
        made.append(saved(rows.groupBy("tree", "n", "block").applyInArrow(build, kind)))
        if largest <= BLOCK ** len(made):
            return made
        nodes = made[-1].filter(F.col("n") > BLOCK ** len(made)).select(
            "tree", "n", F.col("block").alias("idx"), F.col("top").alias("digest"), F.col("top").alias("probe"),
            F.lit(None).cast(nodes.schema["doc_id"].dataType).alias("doc_id"))


def _arrow_kind(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _ends(made: list[DataFrame], r: int) -> Column:
    return (F.col("n") <= BLOCK ** (r + 1)) & (F.lit(True) if r == 0 else F.col("n") > BLOCK ** r)


def tops(made: list[DataFrame]) -> DataFrame:
    """(tree, top): the one node that remains of each tree."""
    out = None
    for r, blocks in enumerate(made):
        ended = blocks.filter(_ends(made, r)).select("tree", "top")
        out = ended if out is None else out.unionByName(ended)
    return out


# --- paths ---------------------------------------------------------------------------------

_STEP = 2 + 32 + 32 * FAN  # run's size, slot, midstate, the run's digests (padded)


def _levels(nodes: bytes, mids: bytes, levels: int):
    """[(nodes of the level, midstates before them)] of a manifest row, lowest first."""
    every, states, at, out = sha.from_bytes(nodes), sha.from_bytes(mids), 0, []
    size = every.shape[1]
    # the number of leaves is the one whose levels add up to all nodes
    leaves = _leaves(size, levels)
    for _ in range(levels):
        out.append((every[:, at:at + leaves], states[:, at:at + leaves]))
        at, leaves = at + leaves, -(-leaves // FAN)
    return out, every[:, :_leaves(size, levels)]


def _leaves(total: int, levels: int) -> int:
    low, high = 1, total
    while low < high:
        mid = (low + high + 1) // 2
        size, n = mid, mid
        for _ in range(levels):
            n = -(-n // FAN)
            size += n
        low, high = (mid, high) if size <= total else (low, mid - 1)
    return low


def _child_paths(batches):
    """Rows (tree, block, nodes, mids, levels, path, subroot, root) to one row per child: its place,
    its digest and its path, which begins with the levels inside the block."""
    for b in batches:
        for r in b.to_pylist():
            steps, own = _levels(r["nodes"], r["mids"], r["levels"])
            tails = [r["path"]]  # of the node at the top
            for nodes, mid in reversed(steps):
                raw, states, m = sha.to_bytes(nodes), sha.to_bytes(mid), nodes.shape[1]
                below = []
                for i in range(m):
                    first = i - i % FAN
                    size = min(FAN, m - first)
                    run = raw[32 * first:32 * (first + size)].ljust(32 * FAN, b"\0")
                    below.append(bytes((size, i % FAN)) + states[32 * i:32 * i + 32] + run + tails[i // FAN])
                tails = below
            raw = sha.to_bytes(own)
            n = len(tails)
            yield pa.RecordBatch.from_arrays([
                pa.array([r["tree"]] * n), pa.array(np.arange(n) + r["block"] * BLOCK, pa.int64()),
                pa.array([raw[32 * i:32 * i + 32] for i in range(n)], pa.binary()), pa.array(tails, pa.binary()),
                pa.array([r["subroot"]] * n, pa.binary()), pa.array([r["root"]] * n, pa.binary())],
                ["tree", "idx", "digest", "path", "subroot", "root"])


def with_paths(made: list[DataFrame], top_paths: DataFrame) -> DataFrame:
    """The blocks of round 0 with path, subroot and root; ``top_paths`` (tree, path, subroot, root) has
    those of whole trees."""
    kids = None
    for r in reversed(range(len(made))):
        held = made[r].filter(_ends(made, r)).join(top_paths, "tree")
        if kids is not None:
            inner = kids.select("tree", F.col("idx").alias("block"), "path", "subroot", "root")
            held = held.unionByName(made[r].filter(F.col("n") > BLOCK ** (r + 1)).join(inner, ["tree", "block"]))
        if r == 0:
            return held
        kids = child_paths(held)


def child_paths(held: DataFrame) -> DataFrame:
    rows = held.select("tree", "block", "nodes", "mids", "levels", "path", "subroot", "root")
    return saved(rows.mapInArrow(_child_paths, "tree string, idx long, digest binary, path binary, subroot binary, root binary"))


# --- folding -------------------------------------------------------------------------------

def resume(state: np.ndarray, own: np.ndarray, slot: np.ndarray, size: np.ndarray, run: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Parents of the lanes ``own`` (8, n): each goes on from the midstate before its ``slot`` with itself and
    the siblings to its right.  ``run`` (16, runs, FAN) holds the hex blocks of runs, ``row`` each lane's."""
    state, mine = state.copy(), sha.hex_block(own)
    for p in range(FAN):
        lanes = np.flatnonzero((slot <= p) & (p < size))
        if len(lanes):
            block = np.where(slot[lanes] == p, mine[:, lanes], run[:, row[lanes], p])
            state[:, lanes] = sha.feed(state[:, lanes], block)
    return sha.feed(state, sha.closing(size))


def _runs(nodes: np.ndarray) -> np.ndarray:
    """(16, runs, FAN) hex blocks of the runs of (8, m) nodes."""
    m = nodes.shape[1]
    out = np.zeros((16, -(-m // FAN) * FAN), np.uint32)
    out[:, :m] = sha.hex_block(nodes)
    return out.reshape(16, -1, FAN)


def _fold(rows: list[dict]) -> tuple[list, list, list]:
    """(leaf digests, proofs, folded roots) of the leaves of some blocks, folded side by side."""
    inner = [_levels(r["nodes"], r["mids"], r["levels"]) for r in rows]
    paths = [[r["path"][i:i + _STEP] for i in range(0, len(r["path"]), _STEP)] for r in rows]
    counts = np.array([own.shape[1] for _, own in inner])
    block = np.repeat(np.arange(len(rows)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    held = sha.from_bytes(b"".join(r["probes"] for r in rows))
    for k in range(DEPTH):  # the levels inside the blocks
        lanes = np.flatnonzero(np.array([r["levels"] for r in rows])[block] > k)
        if not len(lanes):
            break
        used = [i for i, r in enumerate(rows) if r["levels"] > k]
        width = {i: inner[i][0][k][0].shape[1] for i in used}
        base, total = np.zeros(len(rows), np.int64), 0
        for i in used:
            base[i], total = total, total + -(-width[i] // FAN)
        run = np.concatenate([_runs(inner[i][0][k][0]) for i in used], axis=1)
        mids = np.concatenate([inner[i][0][k][1] for i in used], axis=1)
        first = np.zeros(len(rows), np.int64)
        first[used] = np.cumsum([width[i] for i in used]) - [width[i] for i in used]
        at, b = place[lanes] // FAN ** k, block[lanes]
        size = np.minimum(FAN, np.array([width.get(i, 0) for i in range(len(rows))])[b] - at // FAN * FAN)
        held[:, lanes] = resume(mids[:, first[b] + at], held[:, lanes], at % FAN, size, run, base[b] + at // FAN)
    for k in range(max(map(len, paths))):  # those above, shared by the leaves of a block
        lanes = np.flatnonzero(np.array([len(p) for p in paths])[block] > k)
        used = [i for i, p in enumerate(paths) if len(p) > k]
        number = np.zeros(len(rows), np.int64)
        number[used] = np.arange(len(used))
        row = number[block[lanes]]
        raw = [paths[i][k] for i in used]
        size, slot = (np.array([x[j] for x in raw])[row] for j in (0, 1))
        mids = sha.from_bytes(b"".join(x[2:34] for x in raw))[:, row]
        run = sha.hex_block(sha.from_bytes(b"".join(x[34:] for x in raw))).reshape(16, -1, FAN)
        held[:, lanes] = resume(mids, held[:, lanes], slot, size, run, row)
    leaves, proofs = [], []
    for (steps, own), path in zip(inner, paths):
        leaves += _hexes(own)
        proofs += _proofs(steps, own.shape[1], path)
    return leaves, proofs, _hexes(held)


def _hexes(digests: np.ndarray) -> list[str]:
    text = sha.to_bytes(digests).hex()
    return [text[i:i + 64] for i in range(0, len(text), 64)]


def _proofs(steps, n_leaves: int, path: list[bytes]) -> list[str]:
    """SHA-256 of the siblings of each leaf, level by level."""
    shared = b"".join(b"".join(x[34 + 32 * i:66 + 32 * i].hex().encode() for i in range(x[0]) if i != x[1]) for x in path)
    tails = [shared]
    for k in reversed(range(len(steps))):
        text = sha.to_bytes(steps[k][0]).hex().encode()
        below = []
        for i in range(steps[k][0].shape[1]):
            a = i - i % FAN
            below.append(text[64 * a:64 * i] + text[64 * (i + 1):64 * (a + FAN)] + tails[i // FAN])
        tails = below
    return [hashlib.sha256(x).hexdigest() for x in tails]


def _folder(kind: pa.DataType):
    def run(batches):
        def out(rows):
            leaves, proofs, folded = _fold(rows)
            counts = [len(r["ids"]) for r in rows]
            ids = [d for r in rows for d in r["ids"]]
            spread = lambda c: [x for r, k in zip(rows, counts) for x in [r[c].hex()] * k]
            root = spread("root")
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array(leaves), pa.array(spread("subroot")), pa.array(root), pa.array(proofs), pa.array(folded),
                 pa.array([a == b for a, b in zip(folded, root)])],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

        rows, lanes = [], 0
        for b in batches:
            for i in range(b.num_rows):
                rows += b.slice(i, 1).to_pylist()
                lanes += len(rows[-1]["ids"])
                if lanes >= LANES:
                    yield out(rows)
                    rows, lanes = [], 0
        if rows:
            yield out(rows)

    return run


# --- the operator --------------------------------------------------------------------------

def manifest(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """(rounds of the languages' trees, rounds of the tree over them, languages with their place in it).

    A repeated row is a leaf each time; rows with one doc_id stand in the order of their digests.
    A null doc_id comes first.  Columns other than ``FIELDS`` are not part of the manifest."""
    changed = F.translate("text", UPPER, LOWER)
    leaves = saved(docs.select("doc_id", tree_of().alias("tree"), leaf_digest().alias("digest"),
                               F.when(tampered() & F.col("text").rlike("[A-Z]"), leaf_digest(changed)).alias("probe")))
    leaves = leaves.withColumn("probe", F.coalesce("probe", "digest"))
    placed = saved(ranked(leaves, ["doc_id", "digest"]))
    largest = placed.agg(F.max("n")).first()[0] or 1  # one number
    langs = rounds(placed, largest)
    subroots = tops(langs)
    order = saved(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("doc_id"), F.col("top").alias("digest"),
                                         F.col("top").alias("probe")), ["doc_id"]))
    return langs, rounds(order, order.count() or 1), order.select(F.col("doc_id").alias("lang_tree"), "idx")


def audit(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its leaf, subroot, root and proof, and the root that its changed leaf
    (``tampered``) folds to along the unchanged siblings.

    Null fields are told apart from empty ones.  A very long text is one string for the leaf's hash
    and costs its length once.  An empty table has no rows; a lone leaf is its subroot.
    """
    langs, over, order = manifest(docs)
    whole = over[-1].select("tree", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("top").alias("root"))
    kids = child_paths(with_paths(over, whole))
    top_paths = kids.join(order, "idx").select(F.col("lang_tree").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    held = with_paths(langs, top_paths)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(_folder(_arrow_kind(docs, "doc_id")), (
        f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"))


def op11_merkle_manifest(docs: DataFrame) -> DataFrame:
    return audit(docs)


def _sql(levels: int = 12) -> str:
    """DuckDB SQL of ``op11_merkle_manifest``; ``levels`` levels hold 8^levels leaves a tree."""
    def told(value: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(told(c) for c in (*FIELDS[:-1], text)) + ")"

    step = "c"
    for _ in range(8):
        step = f"list_transform([{step}], lambda x: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)[1]"
    crc = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), "
           f"lambda a, b: list_transform([xor(a, b)], lambda c: {step})[1]), 4294967295)")
    parts = [f"""
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS digest,
         CASE WHEN coalesce({crc} % 3 = 0, false) THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {leaf('text')} END AS probe
  FROM documents),
t0 AS (
  SELECT doc_id, tree, digest, probe, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM leaves),
n0 AS (SELECT tree, idx, digest FROM t0),
f0 AS (SELECT doc_id, tree, idx, digest AS leaf, probe AS held, '' AS proof FROM t0)"""]

    def climb(prefix: str, k: int, by: str) -> str:
        a, b = f"{prefix}{k}", f"{prefix}{k + 1}"
        return f"""
{a}r AS (SELECT {by}idx // {FAN} AS parent, list(digest ORDER BY idx) AS run, count(*) OVER ({'PARTITION BY tree' if by else ''}) AS parents
  FROM {a} GROUP BY {by}idx // {FAN}),
{a}m AS (SELECT {by}max(idx) + 1 AS width FROM {a} {'GROUP BY tree' if by else ''}),
{b} AS (SELECT {by}parent AS idx, CASE WHEN width > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest
  FROM {a}r {'JOIN ' + a + 'm USING (tree)' if by else 'CROSS JOIN ' + a + 'm'})"""

    def follow(prefix: str, k: int, rows: str, by: str, key: str) -> str:
        a = f"{prefix}{k}"
        slot = f"CAST({key} % {FAN} AS BIGINT)"
        return f"""
{rows}{k + 1} AS (SELECT doc_id, tree, {'idx // ' + str(FAN) + ' AS idx' if by else f'{key} // {FAN} AS {key}, subroot'}, leaf,
  CASE WHEN width > 1 THEN sha256(array_to_string(run[1:{slot}], '') || held || array_to_string(run[{slot} + 2:], '')) ELSE held END AS held,
  proof || CASE WHEN width > 1 THEN array_to_string(run[1:{slot}], '') || array_to_string(run[{slot} + 2:], '') ELSE '' END AS proof
  FROM {rows}{k} {f'JOIN {a}r USING (tree)' if by else f'CROSS JOIN {a}m JOIN {a}r ON true'} {f'JOIN {a}m USING (tree)' if by else ''}
  WHERE {a}r.parent = {rows}{k}.{key} // {FAN})"""

    for k in range(levels):
        parts += [climb("n", k, "tree, "), follow("n", k, "f", "tree", "idx")]
    parts.append(f"""
s0 AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx FROM n{levels}),
g0 AS (SELECT doc_id, tree, s0.idx AS place, s0.digest AS subroot, leaf, held, proof FROM f{levels} JOIN s0 USING (tree))""")
    for k in range(levels):
        parts += [climb("s", k, ""), follow("s", k, "g", "", "place")]
    return "WITH" + ",".join(parts) + f"""
SELECT doc_id, leaf, subroot, s{levels}.digest AS root, sha256(proof) AS proof_sha256, held AS folded_root, held = s{levels}.digest AS verified
FROM g{levels} CROSS JOIN s{levels}"""


OP11_SQL = _sql()
