"""N-gram Jaccard self-join by MinHash banding.

Documents are the rows of the table: sets of hashed 5-word shingles (a text of one to four words is one shingle; a blank
text has none and no links).  Texts with equal sets form one copy class and are compared once.  ``bands`` of ``rows``
minima each give every class its band hashes; band and row counts are chosen for the target recall at the threshold.
Classes that share a band hash are joined to the smallest class with that hash: a star, never all pairs.  The stars'
connected components are the candidate groups.  In a group of at most ``tile`` classes every pair is verified once on the
full shingle sets.  A larger group, which may be a chain of unlike texts, is verified bucket by bucket: classes with a
common band hash, large buckets in tiles of bounded size, and each pair in the first band that it shares.  A tile returns each
class's number of links and a spanning forest of the links, not the links.  The forests' components are the classes of
the result.

Result: doc_id, class_id (smallest doc_id of its linked documents, its own if none), n_links (other documents with
Jaccard similarity of the threshold or more, copies included).

Scale: shuffles carry a row for each document and for each class and band, a row for each star edge, and the texts of
classes in candidate groups (once in a small group; once for each shared band hash and chunk in a large one).  Whole rows
are sifted by a filter of the wanted keys before a join, so that those of other documents are not shuffled.  Nothing but
counts and that filter (at most 16 MB) reaches the driver.  Stars through a hot hash are pre-aggregated minima; components come from the alternating
star algorithm whose tables are written to the shared folder, and deleted when the next ones are there.  Counting the
links of g different, similar texts takes g * g / 2 verifications (up to once a shared band in a large group), spread over
tiles; copies are free.

Edge cases: null text is blank; rows with equal doc_id are separate documents, and so are rows with a null one (their
class_id is the smallest id among their links, null if there is none); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, read, sieve, written
from .wordhash import buffers, hashed, mix, ngrams, slices, word_bounds

SHINGLE, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.999, 6
#: Classes of a group that are compared with as many others in one tile.
TILE = 2048
#: Shingles in at most so many classes of a tile are counted pair by pair, the others in panels of so many columns.
FEW, PANEL = 8, 2048


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` rows that find a pair at the threshold with the target recall."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def shingle_sets(column: pa.Array | pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, sorted in each document; index of each document's first hash, one more at the end)."""
    raw, offsets = buffers(column)
    starts, ends, first = word_bounds(raw, offsets)
    words = hashed(raw, starts, ends)
    found, at = ngrams(words, first, n)
    doc = np.searchsorted(first[1:], at, "right")
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):  # a short text is one shingle of all its words
        whole = np.array([whole_hash(words[first[d] : first[d + 1]]) for d in short], np.uint64)
        found, doc = np.concatenate([found, whole]), np.concatenate([doc, short])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[fresh], doc[fresh]
    return found, np.searchsorted(doc, np.arange(len(offsets)))


def whole_hash(words: np.ndarray) -> int:
    total = 0
    for w in words.tolist():
        total = (total * 0x9E3779B97F4A7C15 + w) % (1 << 64)
    return int(mix(np.array([total], np.uint64))[0])


def signatures(found: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes, documents by bands; documents without shingles must have been left out."""
    low = (mix(found.copy()) >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    adds = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    docs = len(first) - 1
    out = np.zeros((docs, bands), np.uint64)
    at = 0
    while at < docs:  # slices that stay in the processor's cache
        stop = max(at + 1, int(np.searchsorted(first, first[at] + 32_768, "right")) - 1)
        x, cuts = low[first[at] : first[stop]], first[at:stop] - first[at]
        for k in range(bands * rows):
            y = x * factors[k] + adds[k]
            y ^= y >> np.uint32(15)
            least = np.minimum.reduceat(y, cuts)
            out[at:stop, k // rows] = mix(out[at:stop, k // rows] * np.uint64(0x100000001B3) + least)
        at = stop
    return out


SIGNED = "doc_id long, digest binary, copy binary, bands array<long>"


def sign(batches, bands: int, rows: int, n: int):
    """Of each document: its text's digest, the identity of its shingle set, its band hashes (both null without shingles)."""
    for batch in (part for whole in batches for part in slices(whole, "text")):
        found, first = shingle_sets(batch.column("text"), n)
        sizes = np.diff(first)
        has = sizes > 0
        cuts = first[:-1][has]
        total, twist = np.zeros((2, len(sizes)), np.uint64)
        if has.any():
            total[has], twist[has] = np.add.reduceat(found, cuts), np.add.reduceat(mix(found ^ np.uint64(0x5851F42D4C957F2D)), cuts)
        table = signatures(found, np.concatenate([cuts, first[-1:]]), bands, rows).view(np.int64)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)), pa.array(table.ravel())
        )
        both = np.stack([total, twist], 1)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                batch.column("digest").cast(pa.binary()),
                pa.array([b.tobytes() if h else None for b, h in zip(both, has)], pa.binary()),
                lists,
            ],
            names=["doc_id", "digest", "copy", "bands"],
        )


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of the edges' (a, b) connected components, root the smallest node: alternating large and small stars.

    The minima are written before they are joined back, so that both sides of the join are plain exchanges and a hub's
    rows can be split.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    before = None
    while True:
        # large star: a node's larger neighbours go to its smallest one
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = written(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        forget(e, least)
        # small star: a node and its smaller neighbours go to the smallest of them
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        rest = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        e = written(rest.union(least.select("a", F.col("m").alias("b"))).distinct(), name)
        forget(large, least)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def common_counts(left: np.ndarray, right: np.ndarray, column: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Shared shingles of each pair of a left and a right row; (row, column) are the ones of a 0-1 matrix."""
    spread = np.bincount(column)[column] > 1  # a shingle of one class only is never shared
    column, row = np.unique(column[spread], return_inverse=True)[1], row[spread]
    common = np.zeros((len(left), len(right)), np.float32)
    if not len(column):
        return common
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    size = np.bincount(column)
    begin = np.cumsum(size) - size
    at_left, at_right = np.full(rows, -1), np.full(rows, -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    few = np.flatnonzero(size <= FEW)
    for c in np.unique(size[few]):  # rare shingles: their few pairs one by one
        group = row[begin[few[size[few] == c]][:, None] + np.arange(c)]
        for p in range(c):
            for q in range(c):
                if p != q or left is right:
                    x, y = at_left[group[:, p]], at_right[group[:, q]]
                    ok = (x >= 0) & (y >= 0)
                    np.add.at(common, (x[ok], y[ok]), 1)
    many = np.flatnonzero(size > FEW)
    for lo in range(0, len(many), PANEL):  # frequent shingles: panels of a dense matrix product
        cols = many[lo : lo + PANEL]
        spans = [np.arange(begin[c], begin[c] + size[c]) for c in cols]
        panel = np.zeros((rows, len(cols)), np.float32)
        panel[row[np.concatenate(spans)], np.repeat(np.arange(len(cols)), size[cols])] = 1
        common += panel[left] @ panel[right].T
    return common


def verify_group(node, weight, side, found, first, similarity: float, earlier: np.ndarray | None = None):
    """(links of each class, spanning forest) of one group, or of one chunk of it against another.

    ``earlier`` has the classes' hashes of bands before that of the group: pairs that share one are counted there.
    """
    sizes = np.diff(first)
    column = np.unique(found, return_inverse=True)[1]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left  # else a chunk with itself
    common = common_counts(left, right, column, np.repeat(np.arange(len(sizes)), sizes), len(sizes)).astype(np.int64)
    share = round(100 * similarity)  # common / (union) >= share / 100, in whole numbers
    hit = (100 + share) * common >= share * (sizes[left][:, None] + sizes[right][None, :])
    hit &= node[left][:, None] != node[right][None, :]
    for band in earlier if earlier is not None else ():
        hit &= band[left][:, None] != band[right][None, :]
    links = np.zeros(len(node), np.int64)
    links[left] += hit @ weight[right]
    if right is not left:
        links[right] += hit.T @ weight[left]
    label, forest = np.arange(len(node)), []
    for x, at in zip(left, hit):
        linked = right[at]
        for group, first_at in zip(*np.unique(label[linked], return_index=True)):
            if group != label[x]:
                forest.append((int(node[x]), int(node[linked[first_at]])))
                label[label == group] = label[x]
    return links, forest


CHECKED = "a long, b long, links long"


def verify(table: pa.Table, similarity: float, n: int) -> pa.Table:
    """Rows (class, null, links) and (class, class, 0) of several small groups, or of one tile of a large bucket."""
    table = table.sort_by([("root", "ascending"), ("band", "ascending"), ("side", "ascending"), ("node", "ascending")])
    root, node, band = table["root"].to_numpy(), table["node"].to_numpy(), table["band"].to_numpy()
    weight, side = table["weight"].to_numpy(), table["side"].to_numpy()
    found, first = shingle_sets(table["text"], n)
    fresh = (root[1:] != root[:-1]) | (band[1:] != band[:-1])
    begin = np.flatnonzero(np.concatenate([[True], fresh])) if len(root) else []
    a, b, links = [], [], []
    for lo, hi in zip(begin, [*begin[1:], len(root)]):
        own = found[first[lo] : first[hi]]
        earlier = np.array(table["bands"][lo:hi].to_pylist(), np.int64).T[: band[lo]] if band[lo] > 0 else None
        got, forest = verify_group(node[lo:hi], weight[lo:hi], side[lo:hi], own, first[lo : hi + 1] - first[lo], similarity, earlier)
        some = np.flatnonzero(got)
        a += [*node[lo:hi][some].tolist(), *(x for x, _ in forest)]
        b += [*[None] * len(some), *(y for _, y in forest)]
        links += [*got[some].tolist(), *[0] * len(forest)]
    return pa.table({k: pa.array(v, pa.int64()) for k, v in (("a", a), ("b", b), ("links", links))})


def digest(text: Column) -> Column:
    """16 bytes that tell texts apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("digest")


def row_hash(doc_id: str, digest: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), digest)


def classify(
    docs: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE, recall: float = RECALL, rows: int = ROWS, tile: int = TILE
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, copy) of the documents, and for each copy class its result: copy, root, class_id, n_links and
    the row that stands for the class (keep_id, keep_digest)."""
    bands = bands_for(similarity, recall, rows)
    texts = docs.select("doc_id", "text", digest(F.col("text")))
    signed = written(texts.mapInArrow(lambda it: sign(it, bands, rows, n), SIGNED), "ngram-signed")
    # a copy class: the row with its smallest id stands for it, rows without id come last
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best")
    classes = signed.filter("copy is not null").groupBy("copy").agg(best, F.count("*").alias("weight"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    banded = classes.select("node", F.posexplode("bands").alias("band", "hash"))
    hub = banded.groupBy("band", "hash").agg(F.min("node").alias("b"), F.max("node").alias("top"), F.count("*").alias("size"))
    hub = written(hub.filter("b < top").drop("top"), "ngram-hubs")
    stars = banded.join(hub, ["band", "hash"]).filter("node <> b").select(F.col("node").alias("a"), "b")
    groups = components(stars, "ngram-groups")
    groups = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())
    sizes = written(groups.groupBy("root").agg(F.count("*").alias("size")), "ngram-sizes")
    dealt = groups.join(sizes, "root").join(classes.select("node", "weight", "best", "bands"), "node")
    dealt = written(dealt, "ngram-dealt")
    small, large = dealt.filter(F.col("size") <= tile), dealt.filter(F.col("size") > tile)
    packs = max(1, -(-dealt.count() // tile))
    none = F.lit(0)
    small = small.select(
        "best", F.pmod(F.xxhash64("root"), F.lit(packs)).alias("pack"), F.lit(-1).alias("tile"), "root", F.lit(-1).alias("band"),
        "node", "weight", none.alias("side"), F.lit(None).cast("array<long>").alias("bands"),
    )
    # a large group's buckets: chunks of about ``tile`` classes, every two of them a tile; small buckets share one
    bucket = large.select("node", "weight", "best", "bands", F.posexplode("bands").alias("band", "hash"))
    bucket = bucket.join(hub.select("band", "hash", "size"), ["band", "hash"])
    bucket = bucket.withColumn("chunks", F.ceil(F.col("size") / tile).cast("int"))
    bucket = bucket.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    bucket = bucket.withColumn("other", F.explode(F.sequence(none, F.col("chunks") - 1)))
    alone, i, j = F.col("chunks") == 1, F.least("chunk", "other"), F.greatest("chunk", "other")
    bucket = bucket.select(
        "best", F.when(alone, F.pmod(F.xxhash64("hash", "band"), F.lit(packs))).otherwise(F.xxhash64("hash", "band")).alias("pack"),
        F.when(alone, -2 - F.col("band")).otherwise((F.col("band") * F.col("chunks") + i) * F.col("chunks") + j).alias("tile"),
        F.col("hash").alias("root"), "band", "node", "weight", (F.col("chunk") > F.col("other")).cast("int").alias("side"), "bands",
    )
    # one text for each class: rows that are equal in id and text are one here
    asked = dealt.select("node", F.col("best.doc_id").alias("own"), F.col("best.digest").alias("digest"))
    texts, _ = sieve(asked.select(row_hash("own", "digest").alias("h")))(texts, row_hash("doc_id", "digest"))
    body = texts.join(asked, (texts["doc_id"].eqNullSafe(asked["own"])) & (texts["digest"] == asked["digest"])).select("node", "text")
    body = written(body.groupBy("node").agg(F.min("text").alias("text")), "ngram-texts")
    placed = small.drop("best").unionByName(bucket.drop("best")).join(body, "node")
    checked = placed.groupBy("pack", "tile").applyInArrow(lambda t: verify(t, similarity, n), CHECKED)
    checked = written(checked, "ngram-checked")
    links = checked.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = components(checked.filter("b is not null").select("a", "b"), "ngram-linked")
    linked = written(linked.union(linked.select(F.col("root").alias("node"), "root").distinct()), "ngram-roots")
    heads = classes.join(linked, "node").groupBy("root").agg(F.min("best").alias("head"))
    found = linked.join(heads, "root").join(links, "node", "left")
    result = classes.select("copy", "node", "weight", "best").join(written(found, "ngram-found"), "node", "left")
    head = F.coalesce("head", "best")
    return signed.select("doc_id", "digest", "copy"), written(result.select(
        "copy", F.coalesce("root", "node").alias("root"), head["doc_id"].alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        head["doc_id"].alias("keep_id"), head["digest"].alias("keep_digest"),
    ), "ngram-result")


def ngram_join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links: one row per input row."""
    rows, result = classify(docs, **options)
    found = rows.filter("copy is not null").join(result, "copy").select("doc_id", "class_id", "n_links")
    rest = rows.filter("copy is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.union(rest)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with the columns it came with: that with the smallest id (null ids last),
    then the smallest digest; of rows equal in id and text any one. Blank texts have no copies and stay."""
    rows, result = classify(docs)
    judged = rows.filter("copy is not null").join(result, "copy")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest"))
    keys = judged.groupBy("doc_id", "digest").agg(F.first(stays).alias("stays"), F.count("*").alias("times"))
    keys = written(keys.filter("not stays or times > 1").select(F.col("doc_id").alias("own"), F.col("digest").alias("d"), "stays"), "ngram-gone")
    tagged = docs.withColumn("__digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    judge = sieve(keys.select(row_hash("own", "d").alias("h")))
    some, none = judge(tagged, row_hash("doc_id", "__digest"))
    # of the rows that the filter holds back, those that stay are found by their keys, so that no text of the others is moved
    held, _ = judge(rows.select("doc_id", "digest"), row_hash("doc_id", "digest"))
    gone = keys.filter("not stays")
    held = held.join(gone, held["doc_id"].eqNullSafe(gone["own"]) & (held["digest"] == gone["d"]), "left_anti")
    some, _ = sieve(written(held.select(row_hash("doc_id", "digest").alias("h")), "ngram-held"))(some, row_hash("doc_id", "__digest"))
    same = some["doc_id"].eqNullSafe(keys["own"]) & (some["__digest"] == keys["d"])
    once = some.join(keys, same, "left_anti")
    again = some.join(keys.filter("stays"), same, "left_semi").dropDuplicates(["doc_id", "__digest"])
    return none.union(once).union(again).drop("__digest")


def op10_ngram_join(spark, sf_dir):
    """Class and number of links of every document."""
    return ngram_join(read(spark, sf_dir, "documents"))
