"""Removal of repeated byte strings by a distributed, sampled suffix array.

A byte of a document goes when a string of ``WIDTH`` bytes that covers it also starts in a document
with a smaller doc_id.  Sorting every suffix would shuffle ``WIDTH`` bytes for each byte of text;
instead the suffixes at *anchors* are sorted.  The anchor of a string of ``WIDTH`` bytes is the place
of its ``GRAM``-byte piece with the least hash (a minimizer): it depends on the string alone, so equal
strings have their anchors at equal places, and all strings with one anchor form a *stretch* of text
around it.

1. Documents are dealt into blocks; every later step on texts works block by block.
   A text that equals one of a smaller doc_id (by length and SHA-256) goes as a whole and takes no
   further part.
2. Each block reports its anchors' hashes, once each, as packed bytes by hash range; hashes that
   occur in two blocks, or in two documents of a block, come back to the blocks.  Anchors that
   nobody shares can have no repeated string and drop out.
3. Stretches at the remaining anchors that are equal within a block collapse to the smallest
   doc_id's (the others are repeats).  Suffixes of the collapsed stretches, read from the anchor on,
   are dealt to buckets by sampled splitters: a few coarse ones that every block knows, then those of
   each coarse range, which are joined to its rows.  Samples grow with the number of buckets.
4. A bucket sorts its suffixes by multikey quicksort (eight bytes at a time; only runs that are still
   equal are sorted further), and the bytes before the anchors, read backwards, likewise.  Two
   strings of ``WIDTH`` bytes with r bytes before their anchors are equal where the sorted suffixes
   have a common prefix of WIDTH - r bytes and the sorted backward parts one of r bytes, so every r
   is one pass over pairs of class numbers.  Equal ones are compared by their smallest doc_id.
5. Strings of the first and last run of suffixes with one leading gram of each bucket may go on in
   the neighbouring bucket: their holders are compared across the boundaries by one aggregation.
6. Blocks join the spans found and cut them out.

Hashes only choose candidates; steps 3 to 5 compare the bytes themselves.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wingwatch.llm.common import _BYTES, mix64, row_chunks, saved, text_buffer, text_of

WIDTH, GRAM = 50, 16
SPAN = WIDTH - GRAM + 1  # grams in a string
LEFT = WIDTH - GRAM  # most bytes of a stretch before its anchor
BLOCK_BYTES = 4 << 20  # text of a block
HASH_BYTES = 24 << 20  # text whose anchors' hashes make one hash bucket
SUFFIXES = 150_000  # of a bucket
DRAWN, DRAWN_BLOCKS = 64, 1 / 32  # sample suffixes a bucket; share of the blocks they come from
BODY = f"S{WIDTH + LEFT}"  # a suffix as it is sorted: the bytes from the anchor on, then those before it
_LOW32 = np.uint64((1 << 32) - 1)
_AGAIN = np.uint64(0x9E3779B97F4A7C15)


# --- anchors -------------------------------------------------------------------------------

def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on, by doubling."""
    h, size = _BYTES[data], 1
    while size < GRAM:
        factor = np.uint64(pow(0x9E3779B97F4A7C15, size, 2**64))
        h = h[:-size] * factor + h[size:] if len(h) > size else h[:0]
        size *= 2
    return mix64(h)


def stretches(data: np.ndarray, offsets: np.ndarray):
    """(row, first string's start, last string's start, anchor, hash) of all stretches of the rows of
    ``data``; places are relative to the row."""
    n = len(data)
    if n < WIDTH:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    h = gram_hashes(data)
    least = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    size = 1
    while size * 2 <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < SPAN:
        least = np.minimum(least[:-(SPAN - size)], least[SPAN - size:])
    anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    change = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= WIDTH
    np.add.at(change, offsets[:-1][long], 1)
    np.add.at(change, offsets[1:][long] - WIDTH + 1, -1)
    place = np.flatnonzero(np.cumsum(change[:len(anchor)]) > 0)
    at = anchor[place]
    new = np.ones(len(place), bool)
    new[1:] = (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1 if len(first) else first
    row = np.searchsorted(offsets, place[first], side="right") - 1
    base = offsets[row]
    # the least of many hashes is small: mixed again, they fill their range evenly
    return [row, place[first] - base, place[last] - base, at[first] - base, mix64(h[at[first]] ^ _AGAIN)]


def all_stretches(data: np.ndarray, offsets: np.ndarray, segment: int = 1 << 20):
    """The same over any number of rows, in chunks; a long row is cut into overlapping segments."""
    found = []
    for a, b in row_chunks(offsets, segment):
        lo, hi = offsets[a], offsets[b]
        if b - a > 1 or hi - lo <= 2 * segment:
            row, *rest = stretches(data[lo:hi], offsets[a:b + 1] - lo)
            found.append([row + a, *rest])
            continue
        for at in range(lo, hi - WIDTH + 1, segment):
            part = data[at:min(at + segment + WIDTH - 1, hi)]
            row, s, e, anchor, h = stretches(part, np.array([0, len(part)]))
            found.append([row + a, s + (at - lo), e + (at - lo), anchor + (at - lo), h])
    if not found:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    return [np.concatenate(x) for x in zip(*found)]


def _bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


# --- packing -------------------------------------------------------------------------------

def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _expand(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _low(h: np.ndarray) -> bytes:
    """The low 32 bits of each hash; with the bucket they tell apart what a bucket's size needs."""
    return (h & _LOW32).astype(np.uint32).tobytes()


def _unlow(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32).astype(np.uint64)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


# --- sorting -------------------------------------------------------------------------------

def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a big-endian uint64 matrix, and the first column at which each row
    (in that order) differs from the one before (the number of columns where it is equal).
    Quicksort on multi-byte characters: after a column only the runs that are still equal go on."""
    n, width = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    sorted0 = words[order, 0]
    differs = np.full(n, width, np.int64)
    new = np.ones(n, bool)
    new[1:] = sorted0[1:] != sorted0[:-1]
    differs[new] = 0
    for j in range(1, width):
        alone = new & np.append(new[1:], True)
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            break
        run = np.cumsum(new)[open_at]
        sub = order[open_at]
        inner = np.lexsort((words[sub, j], run))
        order[open_at] = sub[inner]
        value = words[order[open_at], j]
        fresh = np.zeros(len(open_at), bool)
        fresh[1:] = (value[1:] != value[:-1]) & (run[1:] == run[:-1])
        differs[open_at[fresh]] = j
        new[open_at[fresh]] = True
    return order, differs


def as_words(matrix: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words, so that comparing words compares bytes."""
    pad = -matrix.shape[1] % 8
    if pad:
        matrix = np.hstack([matrix, np.zeros((len(matrix), pad), np.uint8)])
    return np.ascontiguousarray(matrix).view(">u8").astype(np.uint64)


def cut_out(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, out: np.ndarray) -> None:
    """Fills ``out`` with ``width`` bytes from each start; what lies beyond ``length`` is 0."""
    col = np.arange(width, dtype=np.int64)
    for at in range(0, len(start), 16384):
        x = slice(at, at + 16384)
        inside = col[None, :] < length[x, None]
        place = np.where(inside, start[x, None] + col[None, :], 0)
        out[x] = np.where(inside, data[place], np.uint8(0))


def _body(data: np.ndarray, offsets: np.ndarray, row, s, e, anchor) -> tuple[np.ndarray, np.ndarray]:
    """(bytes from the anchor on and bytes before it, padded; their numbers) of each stretch."""
    body = np.zeros((len(row), WIDTH + LEFT), np.uint8)
    base, right, left = offsets[row], e + WIDTH - anchor, anchor - s
    cut_out(data, base + anchor, right, WIDTH, body[:, :WIDTH])
    cut_out(data, base + s, left, LEFT, body[:, WIDTH:])
    return body, np.stack([right, left], axis=1).astype(np.uint8)


def _key_words(body: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.hstack([as_words(body[:, :WIDTH]), as_words(body[:, WIDTH:]), as_words(sizes)])


def by_class(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in sorted order; the first column at which each differs from the one before; and the
    smallest doc among the rows equal to each."""
    order, differs = multikey_order(words)
    if not len(order):
        return order, differs, order
    first = np.flatnonzero(differs < words.shape[1])
    low = np.minimum.reduceat(doc[order], first)
    return order, differs, np.repeat(low, np.diff(np.append(first, len(order))))


def repeats(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that a smaller doc has too, the others: every row of a class's smallest doc)."""
    order, _, low = by_class(words, doc)
    again = doc[order] > low
    return order[again], order[~again]


# --- the steps -----------------------------------------------------------------------------

PACKED = pa.schema([("block", pa.int32()), ("docs", pa.binary()), ("tags", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())])
MARKS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("many", pa.binary())])
FLAGS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary())])
COPIES = -1  # bucket of the rows that list a block's copies, as (doc_id, tag) pairs
PARTS = pa.schema([("bucket", pa.int64()), ("block", pa.int32()), ("docs", pa.binary()), ("tags", pa.binary()),
                   ("row", pa.binary()), ("start", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())])
SPANS = pa.schema([("block", pa.int32()), ("docs", pa.binary()), ("tags", pa.binary()), ("start", pa.binary()),
                   ("end", pa.binary()), ("doc", pa.int64()), ("tag", pa.int64()), ("place", pa.int64()), ("string", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                    ("kept_sha256", pa.string()), ("text", pa.binary())])


def _sql(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _pack(batches):
    """Step 1: the documents of a batch that go to one block as one compressed row."""
    for b in batches:
        doc, tag, block = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag", "block"))
        data, offsets = text_buffer(b.column("text"))
        order, rows = np.argsort(block, kind="stable"), []
        edges = np.append(np.flatnonzero(np.diff(block[order])) + 1, len(order))
        a = 0
        for z in edges:
            x = order[a:z]
            if len(x):
                body = b"".join([data[offsets[i]:offsets[i + 1]].tobytes() for i in x])
                rows.append((int(block[x[0]]), _squeeze(doc[x]), _squeeze(tag[x]), _squeeze(offsets[x + 1] - offsets[x]),
                             zstandard.ZstdCompressor(level=3).compress(body)))
            a = z
        yield from _batch(rows, PACKED).to_batches()


def _unpack(table: pa.Table):
    """(doc_ids, tags, bytes, offsets) of a block."""
    doc, tag, size, body = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for d, t, n, z in zip(*(table.column(c).to_pylist() for c in ("docs", "tags", "sizes", "body"))):
        doc.append(_expand(d, np.int64))
        tag.append(_expand(t, np.int64))
        size.append(_expand(n, np.int64))
        body.append(zstandard.ZstdDecompressor().decompress(z))
    offsets = np.append(0, np.cumsum(np.concatenate(size)))
    return np.concatenate(doc), np.concatenate(tag), np.frombuffer(b"".join(body), np.uint8), offsets


def _without(doc: np.ndarray, tag: np.ndarray, data: np.ndarray, offsets: np.ndarray, copies: set):
    """The block without its copies."""
    if not copies:
        return doc, tag, data, offsets
    keep = np.array([(d, t) not in copies for d, t in zip(doc.tolist(), tag.tolist())], bool)
    size = np.diff(offsets)
    return doc[keep], tag[keep], data[np.repeat(keep, size)], np.append(0, np.cumsum(size[keep]))


def _copies(packed) -> set:
    return {tuple(x) for raw in packed for x in np.frombuffer(raw, np.int64).reshape(-1, 2).tolist()}


def _listed(batches):
    """(doc_id, tag) pairs of each batch, by block."""
    for b in batches:
        block, doc, tag = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "doc_id", "tag"))
        rows = [(int(k), COPIES, np.stack([doc[block == k], tag[block == k]], axis=1).astype(np.int64).tobytes()) for k in np.unique(block)]
        yield from _batch(rows, FLAGS).to_batches()


def _marks(table: pa.Table, copies: pa.Table, n_buckets: int) -> pa.Table:
    """Step 2, a block's side: its distinct anchor hashes, and which of them two documents share."""
    if not table.num_rows:
        return _batch([], MARKS)
    block = table.column("block")[0].as_py()
    doc, _, data, offsets = _without(*_unpack(table), _copies(copies.column("hashes").to_pylist()))
    row, s, e, anchor, h = all_stretches(data, offsets)
    order = np.lexsort((doc[row], h))
    hs, ds = h[order], doc[row][order]
    head = np.ones(len(hs), bool)
    head[1:] = hs[1:] != hs[:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(hs)) - 1 if len(first) else first
    many, hs = ds[first] != ds[last], hs[first]
    bucket = _bucket_of(hs, n_buckets)
    edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
    rows = [(k, block, _low(hs[a:b]), np.packbits(many[a:b]).tobytes())
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
    return _batch(rows, MARKS)


def _flags(key, table: pa.Table) -> pa.Table:
    """Step 2, a bucket's side: the hashes of each block that others have too."""
    block = _column(table, "block")
    parts = [_unlow(x.as_py()) for x in table.column("hashes")]
    many = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8))[:len(p)] for m, p in zip(table.column("many"), parts)])
    sizes, all_h = np.array([len(p) for p in parts]), np.concatenate(parts)
    _, inverse, count = np.unique(all_h, return_inverse=True, return_counts=True)
    shared = (count > 1) | (np.bincount(inverse, many, len(count)) > 0)
    keep, ends = shared[inverse], np.cumsum(sizes)
    rows = [(int(b), int(key[0].as_py()), _low(all_h[e - n:e][keep[e - n:e]])) for b, n, e in zip(block, sizes, ends) if keep[e - n:e].any()]
    return _batch(rows, FLAGS)


def _shared(texts: pa.Table, flags: pa.Table, n_hash_buckets: int):
    """Step 3: (docs, tags, row, first string's start, last string's start, bodies, sizes, repeats, others) of
    the block's stretches at shared anchors; None where there is none."""
    if not texts.num_rows or not flags.num_rows:
        return None
    flagged = list(zip(flags.column("bucket").to_pylist(), flags.column("hashes").to_pylist()))
    doc, tag, data, offsets = _without(*_unpack(texts), _copies([x for k, x in flagged if k == COPIES]))
    flagged = [(k, x) for k, x in flagged if k != COPIES]
    if not flagged:
        return None
    row, s, e, anchor, h = all_stretches(data, offsets)
    mark = (_bucket_of(h, n_hash_buckets).astype(np.uint64) << np.uint64(32)) | (h & _LOW32)
    del h
    wanted = np.concatenate([_unlow(x) | (np.uint64(k) << np.uint64(32)) for k, x in flagged])
    keep = np.flatnonzero(np.isin(mark, wanted))
    row, s, e, anchor = row[keep], s[keep], e[keep], anchor[keep]
    body, sizes = _body(data, offsets, row, s, e, anchor)
    again, heads = repeats(_key_words(body, sizes), doc[row])
    return doc, tag, row, s, e, body, sizes, again, heads


def _drawn(texts: pa.Table, flags: pa.Table, n_hash_buckets: int, share: float) -> pa.Table:
    """Some of the suffixes that the block will deal to buckets."""
    found = _shared(texts, flags, n_hash_buckets)
    if found is None:
        return pa.table({"bodies": pa.array([], pa.binary())})
    body, heads = found[5], found[8]
    rng = np.random.default_rng(texts.column("block")[0].as_py())
    return pa.table({"bodies": pa.array([body[heads[rng.random(len(heads)) < share]].tobytes()], pa.binary())})


def _dealt(block: int, bucket: np.ndarray, doc, tag, row, s, sizes, body) -> list[tuple]:
    """Rows of ``PARTS``, one for each bucket; docs and tags once each."""
    order, rows = np.argsort(bucket, kind="stable"), []
    edges = np.append(np.flatnonzero(np.diff(bucket[order])) + 1, len(order))
    a = 0
    for z in edges:
        x = order[a:z]
        if len(x):
            used, number = np.unique(row[x], return_inverse=True)
            rows.append((int(bucket[x[0]]), block, _squeeze(doc[used]), _squeeze(tag[used]), _squeeze(number.astype(np.int32)),
                         _squeeze(s[x]), _squeeze(sizes[x]), _squeeze(body[x])))
        a = z
    return rows


def _suffix_keys(body: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(body).view(BODY).ravel()


def _collapse(texts: pa.Table, flags: pa.Table, n_hash_buckets: int, coarse: np.ndarray) -> pa.Table:
    """Step 3: collapsed stretches by coarse range.  Rows without a body hold spans that repeat within the block."""
    found = _shared(texts, flags, n_hash_buckets)
    if found is None:
        return _batch([], PARTS)
    doc, tag, row, s, e, body, sizes, again, heads = found
    block, rows = texts.column("block")[0].as_py(), []
    if len(again):
        rows.append((block % (len(coarse) + 1), block, _squeeze(doc[row[again]]), _squeeze(tag[row[again]]), b"", _squeeze(s[again]),
                     _squeeze(e[again] + WIDTH), None))
    at = np.searchsorted(coarse, _suffix_keys(body[heads]), side="right") if len(coarse) else np.zeros(len(heads), np.int64)
    return _batch(rows + _dealt(block, at, doc, tag, row[heads], s[heads], sizes[heads], body[heads]), PARTS)


FINE = 24  # bits of a bucket's number within its coarse range


def _refine(batches):
    """Step 3: rows of a coarse range cut by the range's own splitters."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            if r["body"] is None:
                rows.append((r["bucket"] << FINE, *[r[f.name] for f in PARTS][1:]))
                continue
            number = _expand(r["row"], np.int32)
            body = _expand(r["body"], np.uint8).reshape(-1, WIDTH + LEFT)
            fine = np.frombuffer(r["splitters"] or b"", BODY)
            at = np.searchsorted(fine, _suffix_keys(body), side="right") if len(fine) else np.zeros(len(body), np.int64)
            rows += _dealt(r["block"], (r["bucket"] << FINE) + at, _expand(r["docs"], np.int64), _expand(r["tags"], np.int64), number,
                           _expand(r["start"], np.int64), _expand(r["sizes"], np.uint8).reshape(-1, 2), body)
        yield from _batch(rows, PARTS).to_batches()


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """Step 4.  Rows with a string are holders that step 5 compares across buckets; the spans of
    step 3 are passed on."""
    docs, tags, starts, sizes, bodies, blocks, rows = [], [], [], [], [], [], []
    for r in table.to_batches():
        for block, d, t, n, s, z, b in zip(*(r.column(c).to_pylist() for c in ("block", "docs", "tags", "row", "start", "sizes", "body"))):
            if b is None:
                rows.append((block, d, t, s, z, None, None, None, None))
                continue
            number = _expand(n, np.int32)
            docs.append(_expand(d, np.int64)[number])
            tags.append(_expand(t, np.int64)[number])
            starts.append(_expand(s, np.int64))
            sizes.append(_expand(z, np.uint8).reshape(-1, 2))
            bodies.append(_expand(b, np.uint8).reshape(-1, WIDTH + LEFT))
            blocks.append(np.full(len(number), block, np.int32))
    if not docs:
        return _batch(rows, SPANS)
    doc, tag, start, size, body, block = (np.concatenate(x) for x in (docs, tags, starts, sizes, bodies, blocks))
    del docs, tags, starts, sizes, bodies, blocks
    order, differs, low = by_class(_key_words(body, size), doc)
    run = np.cumsum(differs < GRAM // 8) - 1  # suffixes with the same leading gram
    later = doc[order] > low
    again = order[later]
    found = [(again, start[again], start[again] + size[again, 1] + size[again, 0].astype(np.int64))]
    # the stretches of one run that are left may share some of their strings
    distinct, its_run = order[~later], run[~later]
    edge = (its_run == 0) | (its_run == its_run[-1])
    look = np.flatnonzero((np.bincount(its_run)[its_run] > 1) | edge)
    border = []
    if len(look):
        x = distinct[look]
        repeated = np.zeros((len(x), SPAN), bool)
        for r, at, first in _equal_strings(body[x], size[x], doc[x]):
            repeated[at[~first], r] = True
            out = at[first & edge[look][at]]
            if len(out):
                border.append(_held(body[x[out]], size[x[out], 1], r, block[x[out]], doc[x[out]], tag[x[out]], start[x[out]]))
        # strings with r to q bytes before the anchor are one span
        edges = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (who, r), (_, q) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        base = start[x[who]] + size[x[who], 1]
        found.append((x[who], base - (q - 1), base - r + WIDTH))
    who, s, e = (np.concatenate(x) for x in zip(*found))
    by = np.argsort(block[who], kind="stable")
    who, s, e = who[by], s[by], e[by]
    cuts = np.flatnonzero(np.diff(block[who])) + 1
    for w, a, b in zip(np.split(who, cuts), np.split(s, cuts), np.split(e, cuts)):
        if len(w):
            rows.append((int(block[w[0]]), _squeeze(doc[w]), _squeeze(tag[w]), _squeeze(a), _squeeze(b), None, None, None, None))
    return pa.concat_tables([_batch(rows, SPANS), *border])


def _classes(words: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows, common prefix in bytes of each row, in that order, with the one before)."""
    order, _ = multikey_order(words)
    common = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 16384):
        x = order[at:at + 16384]
        differs = raw[x] != raw[order[at - 1:at - 1 + len(x)]]
        common[at:at + len(x)] = np.where(differs.any(axis=1), differs.argmax(axis=1), raw.shape[1])
    return order, common


def _equal_strings(body: np.ndarray, size: np.ndarray, doc: np.ndarray):
    """For every number r of bytes before the anchor: (r, rows that have a string with r such bytes, whether
    no equal string has a smaller doc)."""
    right, left = size[:, 0].astype(np.int64), size[:, 1].astype(np.int64)
    back = np.zeros((len(body), LEFT), np.uint8)  # the bytes before the anchor, read backwards
    col = np.arange(LEFT)
    for at in range(0, len(body), 16384):
        x = slice(at, at + 16384)
        inside = col[None, :] < left[x, None]
        back[x] = np.where(inside, np.take_along_axis(body[x], np.where(inside, WIDTH + left[x, None] - 1 - col[None, :], 0), axis=1), np.uint8(0))
    ahead = np.ascontiguousarray(body[:, :WIDTH])
    ahead_order, ahead_common = _classes(as_words(ahead), ahead)
    back_order, back_common = _classes(as_words(back), back)
    ahead_class, back_class = np.empty(len(body), np.int64), np.empty(len(body), np.int64)
    for r in range(SPAN):
        at = np.flatnonzero((left >= r) & (right >= WIDTH - r))
        if not len(at):
            continue
        ahead_class[ahead_order] = np.cumsum(ahead_common < WIDTH - r)
        back_class[back_order] = np.cumsum(back_common < r) if r else 0
        key = ahead_class[at] * (len(body) + 1) + back_class[at]
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        low = np.empty(len(at), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(doc[at][order], head), np.diff(np.append(head, len(order))))
        yield r, at, doc[at] == low


def _held(body, left, r: int, block, doc, tag, start) -> pa.Table:
    """Rows of ``SPANS`` for holders of strings with r bytes before the anchor."""
    left = left.astype(np.int64)
    place = np.hstack([WIDTH + left[:, None] - r + np.arange(r)[None, :], np.broadcast_to(np.arange(WIDTH - r), (len(body), WIDTH - r))])
    string = np.ascontiguousarray(np.take_along_axis(body, place, axis=1))
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(body), [None, pa.py_buffer(string)])
    none = pa.nulls(len(body), pa.binary())
    return pa.table([pa.array(block, pa.int32()), none, none, none, none, pa.array(doc), pa.array(tag), pa.array(start + left - r),
                     fixed.cast(pa.binary())], schema=SPANS)


def _cut(texts: pa.Table, spans: pa.Table, with_text: bool) -> pa.Table:
    """Step 6: a block's documents without their repeated bytes."""
    doc, tag, data, offsets = _unpack(texts)
    per: dict[tuple[int, int], list] = {}
    copies = _copies([x for x, e in zip(spans.column("docs").to_pylist(), spans.column("end").to_pylist()) if e is None])
    for d, t, s, e in zip(*(spans.column(c).to_pylist() for c in ("docs", "tags", "start", "end"))):
        if e is None:
            continue
        d, t, s, e = (_expand(x, np.int64) for x in (d, t, s, e))
        by = np.lexsort((t, d))
        d, t, s, e = d[by], t[by], s[by], e[by]
        cuts = np.flatnonzero((np.diff(d) != 0) | (np.diff(t) != 0)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(d))):
            per.setdefault((int(d[a]), int(t[a])), []).append((s[a:b], e[a:b]))
    rows = []
    for i in range(len(doc)):
        text = data[offsets[i]:offsets[i + 1]]
        removed = runs = 0
        if (int(doc[i]), int(tag[i])) in copies:
            n, removed, runs, text = len(text), len(text), 1, text[:0]
        elif found := per.get((int(doc[i]), int(tag[i]))):
            change = np.zeros(len(text) + 1, np.int32)
            for s, e in found:
                np.add.at(change, s, 1)
                np.add.at(change, e, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed, runs = int(gone.sum()), int((np.diff(np.append(0, gone.astype(np.int8))) == 1).sum())
            n, text = len(text), text[~gone]
        else:
            n = len(text)
        kept = text.tobytes()
        rows.append((int(doc[i]), n, removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
    return _batch(rows, RESULT)


def _placed(batches):
    """Spans of single strings, packed by block."""
    for b in batches:
        block, doc, tag, place = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "doc", "tag", "place"))
        rows = []
        for k in np.unique(block):
            x = block == k
            rows.append((int(k), *[_squeeze(v[x].astype(np.int64)) for v in (doc, tag, place, place + WIDTH)], None, None, None, None))
        yield from _batch(rows, SPANS).to_batches()


def _splitters(leading: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket bounds from sorted sample suffixes.  A bound is cut back to the leading gram, so that a
    run of suffixes with one gram stays in one bucket; only a run that fills a bucket is split."""
    if not len(leading):
        return leading
    bounds = leading[np.linspace(0, len(leading), n_buckets + 1)[1:-1].astype(int)]
    out = []
    for x in bounds:
        gram = bytes(x).ljust(WIDTH + LEFT, b"\0")[:GRAM]
        out.append(bytes(x) if out and out[-1].ljust(GRAM, b"\0")[:GRAM] == gram else gram)
    return np.unique(np.array(out, dtype=leading.dtype)) if out else leading[:0]


def _cuts(blocks: DataFrame, flags: DataFrame, n_hash: int, n_blocks: int, n_suffixes: int) -> tuple[np.ndarray, DataFrame]:
    """(coarse splitters; table of the splitters within each coarse range) from samples of about ``DRAWN``
    suffixes a bucket.  The coarse ones are as many as the square root of the buckets, and so is each
    range's share of the others."""
    n_buckets = max(1, math.ceil(n_suffixes / SUFFIXES))
    n_coarse = math.isqrt(n_buckets - 1) + 1
    of_blocks = min(1.0, max(DRAWN_BLOCKS, 8 / n_blocks))
    share = min(1.0, DRAWN * n_buckets / max(1, of_blocks * n_suffixes))
    picked = lambda df: df.filter(F.pmod(F.xxhash64("block", F.lit(2)), F.lit(1 << 20)) < math.ceil(of_blocks * (1 << 20)))
    drawn = saved(picked(blocks).groupBy("block").cogroup(picked(flags).groupBy("block"))
                  .applyInArrow(lambda t, f: _drawn(t, f, n_hash, share), "bodies binary"))
    every = math.ceil(n_buckets / n_coarse)  # the driver sees about DRAWN suffixes a coarse range

    def thinned(batches):
        for b in batches:
            keep = [_suffix_keys(np.frombuffer(x, np.uint8).reshape(-1, WIDTH + LEFT))[::every].tobytes() for x in b.column(0).to_pylist() if x]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(keep)], pa.binary())], ["bodies"])

    few = b"".join(bytes(r[0]) for r in drawn.mapInArrow(thinned, "bodies binary").collect())
    coarse = _splitters(np.sort(np.frombuffer(few, BODY)), n_coarse)

    def ranged(batches):
        for b in batches:
            keys = np.frombuffer(b"".join(x for x in b.column(0).to_pylist() if x), BODY)
            at = np.searchsorted(coarse, keys, side="right") if len(coarse) else np.zeros(len(keys), np.int64)
            used = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([keys[at == k].tobytes() for k in used], pa.binary())], ["bucket", "bodies"])

    def split(table: pa.Table) -> pa.Table:
        keys = np.sort(np.frombuffer(b"".join(table.column("bodies").to_pylist()), BODY))
        cuts = _splitters(keys, max(1, round(len(keys) / DRAWN)))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "splitters": pa.array([cuts.tobytes()], pa.binary())})

    fine = drawn.mapInArrow(ranged, "bucket long, bodies binary").groupBy("bucket").applyInArrow(split, "bucket long, splitters binary")
    return coarse, saved(fine)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, where asked for, the bytes that stay.

    A null or empty text has no bytes.  Rows without doc_id come before or after no other document:
    nothing is taken from them or because of them.  Rows that repeat a doc_id do not count against
    each other; equal rows get equal results.
    """
    spark = docs.sparkSession
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    n_blocks, n_hash = max(1, math.ceil(total / BLOCK_BYTES)), max(1, math.ceil(total / HASH_BYTES))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = rows.filter("doc_id IS NOT NULL")
    known = known.withColumn("block", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(n_blocks)).cast("int"))
    blocks = known.mapInArrow(_pack, _sql(PACKED)).repartition(parts, "block").persist(StorageLevel.DISK_ONLY)
    # texts that a smaller doc_id has too, by SHA-256 and length
    ids = saved(known.select("doc_id", "tag", "block", F.octet_length("text").alias("n"), F.unhex(F.sha2("text", 256)).alias("digest"))
                .filter(F.col("n") >= WIDTH))
    least = ids.groupBy("n", "digest").agg(F.min("doc_id").alias("low"))
    copies = saved(ids.join(least, ["n", "digest"]).filter("doc_id > low").select("block", "doc_id", "tag")
                   .mapInArrow(_listed, _sql(FLAGS)))
    try:
        marks = (blocks.groupBy("block").cogroup(copies.groupBy("block"))
                 .applyInArrow(lambda t, c: _marks(t, c, n_hash), _sql(MARKS)))
        flags = saved(marks.groupBy("bucket").applyInArrow(lambda k, t: _flags(k, t), _sql(FLAGS)).unionByName(copies))
        shared = flags.filter(F.col("bucket") != COPIES).agg(F.sum(F.octet_length("hashes"))).first()[0] or 0  # one number
        coarse, fine = _cuts(blocks, flags, n_hash, n_blocks, shared // 4)
        stretched = (blocks.groupBy("block").cogroup(flags.groupBy("block"))
                     .applyInArrow(lambda t, f: _collapse(t, f, n_hash, coarse), _sql(PARTS)))
        cut = stretched.join(fine, "bucket", "left").mapInArrow(_refine, _sql(PARTS))
        found = saved(cut.groupBy("bucket").applyInArrow(lambda t: _sorted_bucket(t), _sql(SPANS)))
        held = found.filter("string IS NOT NULL")
        least = held.groupBy("string").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
        across = (held.join(least, "string").filter("doc > low").select("block", "doc", "tag", "place")
                  .mapInArrow(_placed, _sql(SPANS)))
        whole = copies.select("block", F.col("hashes").alias("docs"), *[F.lit(None).cast("binary").alias(c) for c in ("tags", "start", "end")])
        spans = (found.filter("string IS NULL").select("block", "docs", "tags", "start", "end")
                 .unionByName(across.select("block", "docs", "tags", "start", "end")).unionByName(whole))
        done = saved(blocks.groupBy("block").cogroup(spans.groupBy("block"))
                     .applyInArrow(lambda t, s: _cut(t, s, with_text), _sql(RESULT)))
    finally:
        blocks.unpersist()
    apart = rows.filter("doc_id IS NULL").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"),
        (F.col("text").cast("binary") if with_text else F.lit(None).cast("binary")).alias("text"))
    out = done.unionByName(apart)
    return out if with_text else out.drop("text")


def op10_remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    return remove_repeats(docs)
