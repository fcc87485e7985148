"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Documents are dealt into blocks by ranges of doc_id, so all documents of an earlier block have smaller ids.  A block's
index is the sorted list of its distinct ``least``-word windows.  A document is parsed from left to right: where its
window is in the index of an earlier block, or starts in a smaller document of its own block, a factor begins, which
points at the first block that has the window and at the window's entry in that block's index; it grows greedily word by
word as long as the next window points at the same block.  Where it does not, the next factor begins: the windows that straddle
the boundary are looked up like all others, so none is lost between two factors.  A factor is at least ``least`` words
long, the words of all factors are duplicates, and windows are judged on the input.

Scale: block indexes are compared by ranges of hashes ("bins").  A block sends each bin one packed array with its own
distinct windows as steps of six bytes, so a passage in a third of all documents costs one entry a block, not one a copy;
the bin answers a block with one bit for each entry and a pointer of eight bytes for each that an earlier block has.  Blocks hold a bounded number of bytes
(a longer document is a block of its own), bins a bounded number of entries.  Nothing is collected to the driver.  Two
shuffles carry the texts once (both readers share one exchange) and six bytes for each distinct window of a block.
A window's identity is its 64-bit hash: over n distinct windows n * n / 2**65 wrong matches are expected, 0.03 for 1e9.

Edge cases: null or blank text has no words; ids that occur more than once are in the same block and are not smaller
than each other; a null doc_id is never smaller, and never duplicated; an empty table gives no rows; further columns of
the input are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import read
from .wordhash import buffers, hashed, ngrams, word_bounds

LEAST = 13
MOST_BLOCKS = 1 << 16
RESULT = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept string, "
    "factors array<struct<start:int,length:int,block:int,entry:int>>"
)
INDEX = "bin int, block int, first int, windows binary"


def windows_of(raw: np.ndarray, offsets: np.ndarray, least: int):
    """(word starts, word ends, first word of each document, window hashes, first word of each window)."""
    starts, ends, first = word_bounds(raw, offsets)
    found, at = ngrams(hashed(raw, starts, ends), first, least)
    return starts, ends, first, found, at


def by_id(table: pa.Table) -> pa.Table:
    """Ascending doc_id, nulls last."""
    return table.take(pa.compute.sort_indices(table["doc_id"], null_placement="at_end"))


def pack_windows(windows: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as steps: 16 and 32 bits each where all but the first fit, else as they are."""
    steps = np.diff(windows)
    if len(steps) and int(steps.max()) >> 48:
        return b"\0" + windows.tobytes()
    low, high = steps.astype("<u4"), (steps >> np.uint64(32)).astype("<u2")
    return b"\1" + windows[:1].tobytes() + low.tobytes() + high.tobytes()


def unpack_windows(data: bytes) -> np.ndarray:
    if data[:1] == b"\0":
        return np.frombuffer(data, np.uint64, offset=1)
    n = (len(data) - 9) // 6
    low, high = np.frombuffer(data, "<u4", n, 9), np.frombuffer(data, "<u2", n, 9 + 4 * n)
    steps = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1, 1), steps]), dtype=np.uint64)


def index_block(table: pa.Table, least: int, bins: int) -> pa.Table:
    """Rows (bin, block, first, windows): the distinct windows of the block's documents with an id, dealt by their top
    bits; ``first`` is the number of windows before them."""
    known = table.filter(pa.compute.is_valid(table["doc_id"]))
    *_, found, _ = windows_of(*buffers(known["text"]), least)
    found = np.unique(found)
    cuts = np.searchsorted(found, bin_edges(bins))
    rows = [(b, lo, pack_windows(found[lo:hi])) for b, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(found)])) if lo < hi]
    block = table["block"][0].as_py()
    return pa.table({
        "bin": pa.array([b for b, *_ in rows], pa.int32()),
        "block": pa.array([block] * len(rows), pa.int32()),
        "first": pa.array([lo for _, lo, _ in rows], pa.int32()),
        "windows": pa.array([w for *_, w in rows], pa.binary()),
    })


def bin_edges(bins: int) -> np.ndarray:
    return np.array([(b << 64) // bins for b in range(bins)], np.uint64)


def seen_earlier(table: pa.Table) -> pa.Table:
    """Of one bin: for each block, a bit for each of its windows, set if an earlier block has that window, and for each
    set bit the first such block and the window's entry in its index."""
    table = table.sort_by("block")
    parts = [unpack_windows(w) for w in table["windows"].to_pylist()]
    sizes = np.array([len(p) for p in parts])
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")  # equal windows stay in the blocks' order
    ranked = every[order]
    fresh = np.ones(len(every), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    again, source = np.zeros(len(every), bool), np.empty(len(every), np.int64)
    again[order] = ~fresh
    source[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(every)), 0))]
    del ranked, order, fresh
    cuts = np.cumsum(sizes) - sizes
    blocks, firsts = table["block"].to_numpy(), table["first"].to_numpy()
    out = []
    for k, (lo, n) in enumerate(zip(cuts.tolist(), sizes.tolist())):
        flags = again[lo : lo + n]
        if flags.any():
            at = source[lo : lo + n][flags]
            cell = np.searchsorted(cuts, at, "right") - 1
            entry = at - cuts[cell] + firsts[cell]
            out.append((k, np.packbits(flags).tobytes(), blocks[cell].astype("<i4").tobytes() + entry.astype("<i4").tobytes()))
    kept = pa.array([k for k, *_ in out], pa.int64())
    return pa.table({
        "block": table["block"].take(kept).cast(pa.int32()), "bin": table["bin"].take(kept).cast(pa.int32()),
        "seen": pa.array([x for _, x, _ in out], pa.binary()), "sources": pa.array([x for *_, x in out], pa.binary()),
    })


def factor_block(docs: pa.Table, answers: pa.Table, least: int, bins: int) -> pa.Table:
    """Parses the block's documents against all smaller ones."""
    docs = by_id(docs)
    raw, offsets = buffers(docs["text"])
    starts, ends, first, found, at = windows_of(raw, offsets, least)
    ids = docs["doc_id"].to_pylist()
    has_id = np.array([i is not None for i in ids], bool)
    # equal ids share a rank; documents are in ascending order of it
    rank = np.cumsum([i > 0 and ids[i] != ids[i - 1] for i in range(len(ids))]) if ids else np.zeros(0, int)
    doc = np.searchsorted(first[1:], at, "right")
    counted = has_id[doc]
    own, head, place = np.unique(found[counted], return_index=True, return_inverse=True)
    seen = np.zeros(len(own), bool)
    # where each window of the block's index was first: an earlier block's entry, else its own
    source, entry = np.full(len(own), docs["block"][0].as_py(), np.int32), np.arange(len(own), dtype=np.int32)
    cuts = np.searchsorted(own, bin_edges(bins)).tolist() + [len(own)]
    for b, bits, where in zip(*(answers[c].to_pylist() for c in ("bin", "seen", "sources"))):
        lo, hi = cuts[b], cuts[b + 1]
        seen[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        source[lo:hi][seen[lo:hi]], entry[lo:hi][seen[lo:hi]] = np.frombuffer(where, "<i4").reshape(2, -1)
    ranks = rank[doc[counted]]
    repeat = np.zeros(len(at), bool)
    repeat[counted] = seen[place] | (ranks[head][place] < ranks)
    # greedy factors: runs of windows word by word in one document that point at one block
    hit = np.flatnonzero(repeat)
    where = np.zeros(len(at), np.int64)
    where[counted] = place
    where = where[hit]
    goes_on = np.zeros(len(hit), bool)
    goes_on[1:] = (at[hit[1:]] == at[hit[:-1]] + 1) & (doc[hit[1:]] == doc[hit[:-1]]) & (source[where[1:]] == source[where[:-1]])
    opens = np.flatnonzero(~goes_on)
    windows = np.diff(np.append(opens, len(hit)))
    factor_doc = doc[hit[opens]]
    factors = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(factor_doc, np.arange(len(ids) + 1)).astype(np.int32)),
        pa.StructArray.from_arrays(
            [
                pa.array((at[hit[opens]] - first[factor_doc]).astype(np.int32)), pa.array((windows + least - 1).astype(np.int32)),
                pa.array(source[where[opens]]), pa.array(entry[where[opens]]),
            ],
            ["start", "length", "block", "entry"],
        ),
    )
    # words of a factor: depth of factors that are open at each word
    opened = np.bincount(at[hit[opens]], minlength=len(starts) + 1)
    closed = np.bincount(at[hit[opens]] + windows + least - 1, minlength=len(starts) + 1)
    gone = np.cumsum(opened - closed)[: len(starts)] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "spans", "kept")}
    data = raw.tobytes()
    lows, highs = edge[::2], edge[1::2]
    for d in range(len(ids)):
        a, b = int(first[d]), int(first[d + 1])
        ws, keep = data[offsets[d] : offsets[d + 1]].split(), ~gone[a:b]
        kept = b" ".join(compress(ws, keep.tolist()))
        i, j = np.searchsorted(highs, a, "right"), np.searchsorted(lows, b, "left")
        spans = [{"start": max(int(lo), a) - a, "end": min(int(hi), b) - a} for lo, hi in zip(lows[i:j], highs[i:j])]
        for k, v in zip(out, (b - a, int(b - a - keep.sum()), hashlib.sha256(kept).hexdigest(), spans, kept.decode())):
            out[k].append(v)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({
        "doc_id": docs["doc_id"].cast(pa.int64()),
        "n_words": pa.array(out["n_words"], pa.int64()),
        "n_removed": pa.array(out["n_removed"], pa.int64()),
        "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
        "spans": pa.array(out["spans"], span),
        "kept": pa.array(out["kept"], pa.string()),
        "factors": factors,
    })


def block_edges(docs: DataFrame, block_bytes: int) -> tuple[list[int], int]:
    """Ids at which a new block begins, and the total of bytes: one narrow pass, a few numbers a block to the driver."""
    sized = docs.select("doc_id", F.length(F.encode("text", "UTF-8")).alias("b"))
    total, n = sized.agg(F.coalesce(F.sum("b"), F.lit(0)), F.count("doc_id")).first()
    blocks = min(MOST_BLOCKS, max(1, -(-total // block_bytes)))
    if blocks == 1 or not n:
        return [], total
    shares = [k / blocks for k in range(1, blocks)]
    accuracy = max(10_000, 20 * blocks)
    cuts = sized.agg(F.percentile_approx("doc_id", shares, accuracy)).first()[0]
    return sorted(set(cuts)), total


def position_of(edges: list[int]):
    """Number of edges at or under the id (a null id: null), by binary search in a literal array."""
    if not edges:
        return F.when(F.col("doc_id").isNotNull(), F.lit(0))
    table, n = F.array(*[F.lit(e).cast("long") for e in edges]), len(edges)
    strides = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])

    def step(at, stride):
        further = (at + stride <= n) & (F.get(table, at + stride - 1) <= F.col("doc_id"))
        return F.when(further, at + stride).otherwise(at)

    return F.when(F.col("doc_id").isNotNull(), F.aggregate(strides, F.lit(0), step))


def dedup_substrings(docs: DataFrame, least: int = LEAST, block_bytes: int = 8 << 20, bin_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: counts, digest of the kept words, the removed spans (in words), the kept words, and the factors
    (start, length, reference block, entry of the first window in that block's index).

    Blocks grow beyond ``block_bytes`` only where there would be more than MOST_BLOCKS of them.
    """
    edges, total = block_edges(docs, block_bytes)
    blocks = len(edges) + 1
    bins = min(MOST_BLOCKS, max(1, -(-2 * total // bin_bytes)))  # about 1.4 bytes of hashes for each byte of text
    found = F.coalesce(position_of(edges), F.lit(blocks - 1)).cast("int")
    dealt = docs.select("doc_id", "text", found.alias("block")).repartition(blocks, "block")
    index = dealt.groupBy("block").applyInArrow(lambda t: index_block(t, least, bins), INDEX)
    answers = index.repartition(bins, "bin").groupBy("bin").applyInArrow(seen_earlier, "block int, bin int, seen binary, sources binary")
    answers = answers.repartition(blocks, "block")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda d, a: factor_block(d, a, least, bins) if d.num_rows else empty_result(), RESULT
    )


def empty_result() -> pa.Table:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    factor = pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "length", "block", "entry")]))
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": span, "kept": pa.string(), "factors": factor}
    return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})


def op3_substring_dedup(spark, sf_dir):
    """The contract's columns for every document."""
    found = dedup_substrings(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
