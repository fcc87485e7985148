"""Substring dedup and the n-gram join against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylvan.llm import ngram_join, shared, substring_dedup

from .conftest import EN, prose, shingles, words


def removed(rows, least):
    seen = {}
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - least + 1):
            key = tuple(w[k : k + least])
            if i is not None:
                seen[key] = min(seen.get(key, i), i)
    out = []
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - least + 1):
            if i is not None and seen[tuple(w[k : k + least])] < i:
                gone[k : k + least] = [True] * least
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("least,block,bin_", [(13, 8 << 20, 16 << 20), (13, 2000, 4000), (5, 3000, 1 << 20)])
def test_substrings_against_brute_force(docs, rows, least, block, bin_):
    found = substring_dedup.dedup_substrings(docs, least, block, bin_).collect()
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in found), key=key)
    assert got == sorted(removed(rows, least), key=key)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in found)


def test_factors_point_at_earlier_windows(docs, rows):
    """Every factor's windows start in smaller documents; its entry is its first window; together they cover what is removed."""
    least, block = 5, 3000
    found = substring_dedup.dedup_substrings(docs, least, block, 1 << 20).collect()
    edges, _ = substring_dedup.block_edges(docs, block)
    place = lambda i: sum(e <= i for e in edges)
    starts = {}
    for i, t, *_ in rows:
        for k in range(len(words(t)) - least + 1) if i is not None else ():
            starts.setdefault(tuple(words(t)[k : k + least]), set()).add(i)
    hashes = lambda grams: {g: int(substring_dedup.windows_of(*substring_dedup.buffers(pa.array([" ".join(g)])), least)[3][0]) for g in grams}
    index = {b: sorted(hashes({g for g, ids in starts.items() if any(place(i) == b for i in ids)}).values()) for b in range(len(edges) + 1)}
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(words(t))
    assert sum(len(r.factors) for r in found) > 5 and any(f.block < place(r.doc_id) for r in found for f in r.factors)
    for r in found:
        w = next(x for x in texts[r.doc_id] if len(x) == r.n_words)
        gone = {k for f in r.factors for k in range(f.start, f.start + f.length)}
        assert len(gone) == r.n_removed and all(f.length >= least for f in r.factors)
        for f in r.factors:
            grams = [tuple(w[k : k + least]) for k in range(f.start, f.start + f.length - least + 1)]
            assert all(min(starts[g]) < r.doc_id and place(min(starts[g])) == f.block for g in grams)
            assert index[f.block][f.entry] == hashes(grams[:1])[grams[0]]


def test_windows_pack():
    rng = np.random.default_rng(8)
    for n, top in ((1, 2**63), (2, 2**63), (5000, 2**63), (5000, 2**50), (3, 2**64 - 1)):
        x = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert (substring_dedup.unpack_windows(substring_dedup.pack_windows(x)) == x).all()


def test_query_of_substrings(tmp_path, docs, rows, spark):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = substring_dedup.op3_substring_dedup(spark, str(tmp_path)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str)
    assert got == sorted(((r[0], r[1], r[2], r[3]) for r in removed(rows, 13)), key=str)


def test_substrings_of_nothing(empty):
    assert substring_dedup.dedup_substrings(empty).collect() == []


def grouped(rows):
    """(number, id, links, group) of each row."""
    rows = [(k, i, shingles(t)) for k, (i, t, *_) in enumerate(rows)]
    links, parent = {k: 0 for k, *_ in rows}, {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, (k, i, s) in enumerate(rows):
        for m, j, t in rows[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                links[k] += 1
                links[m] += 1
                parent[top(k)] = top(m)
    return [(k, i, links[k], top(k)) for k, i, _ in rows]


def linked(rows):
    found = grouped(rows)
    least = {g: min((i for _, i, _, h in found if h == g and i is not None), default=None) for *_, g in found}
    return sorted(((i, least[g], n) for _, i, n, g in found), key=str)


@pytest.mark.parametrize("tile", [2048, 2])
def test_join_against_brute_force(docs, rows, tile):
    found = ngram_join.ngram_join(docs, tile=tile).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in found), key=str) == linked(rows)


def test_join_of_many_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (2048, 16):
        found = ngram_join.ngram_join(df, tile=tile).collect()
        assert sorted(((r.doc_id, r.class_id, r.n_links) for r in found), key=str) == linked(rows)


def test_join_of_nothing(empty):
    assert ngram_join.ngram_join(empty).collect() == []


def test_rows_of_equal_ids_keep_their_links(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " z"), (3, text("b") + " z"), (5, text("a")), (5, text("a")), (None, text("b")), (None, text("c"))]
    found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in found), key=str)
    assert got == linked(rows)
    assert (2, 1, 3) in got and (3, 1, 2) in got and (None, None, 0) in got and (None, 1, 2) in got


def test_a_chain_of_unlike_texts(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(4 * k, 4 * k + 50))) for k in range(30)]
    for tile in (2048, 8, 3):
        found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()
        assert sorted(((r.doc_id, r.class_id, r.n_links) for r in found), key=str) == linked(rows)


def test_one_of_each_group_stays(docs, rows):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    found = grouped(rows)
    first = {}
    for k, i, _, g in sorted(found, key=lambda r: (r[1] is None, r[1] or 0)):
        first.setdefault(g, k)  # blank texts are groups of their own
    want = sorted((str(rows[k][0]), str(rows[k][1])) for k in first.values())
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == want


def test_one_of_equal_rows_stays(spark, empty):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text, "x"), (5, text, "y"), (None, text, "x"), (None, text, "y"), (7, "", "x"), (7, "", "x"), (None, None, "x")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, bands string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == [("5", text)]
    assert len(kept) == 4  # blank ones have no copies
    nulls = ngram_join.keep_one(spark.createDataFrame(rows[2:4], "doc_id long, text string, bands string")).collect()
    assert len(nulls) == 1
    assert ngram_join.keep_one(empty).collect() == []


def test_rows_are_sifted(spark):
    rows = spark.range(20000).select("id", F.xxhash64("id").alias("h"))
    keys = rows.filter("id % 50 < 5").select("h")
    for most, spare in ((shared.MOST_WORDS, 0.04), (4, 1)):  # a filter that is too small lets rows through, but loses none
        some, none = shared.sieve(keys, most)(rows, F.col("h"))
        got, rest = [{r.id for r in part.collect()} for part in (some, none)]
        assert not got & rest and len(got) + len(rest) == 20000 and some.columns == rows.columns
        assert {k for k in range(20000) if k % 50 < 5} <= got and len(got) <= 2000 + 18000 * spare
    some, none = shared.sieve(keys.filter("false"))(rows, F.col("h"))
    assert some.count() == 0 and none.count() == 20000


def test_few_rows_are_shuffled_for_one_of_each_group(spark, tmp_path):
    """Keys beyond the size of a broadcast: texts without copies don't come to an exchange."""
    rng = random.Random(3)
    texts = [prose(rng, EN, 40) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts + texts[:20])]
    rows += rows[30:35]  # equal rows, of which one stays
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan's nodes keep their counts
        kept = ngram_join.keep_one(spark.read.parquet(f"{tmp_path}/docs"))
        plan = kept._jdf.queryExecution().executedPlan()
        assert sorted(r.doc_id for r in kept.collect()) == list(range(400))
        moved, todo = [], [plan]
        while todo:
            node = todo.pop()
            todo += [node.children().apply(k) for k in range(node.children().size())]
            names = [node.output().apply(k).name() for k in range(node.output().size())]
            if node.nodeName() == "Exchange" and "text" in names:
                moved.append(node.metrics().apply("shuffleRecordsWritten").value())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert moved and max(moved) < 20


def test_query_of_the_join(tmp_path, docs, rows, spark):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = ngram_join.op10_ngram_join(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in found), key=str) == linked(rows)


def test_bands_reach_the_recall():
    for s, recall, rows in ((0.8, 0.999, 6), (0.9, 0.99, 8)):
        bands = ngram_join.bands_for(s, recall, rows)
        assert 1 - (1 - s**rows) ** bands >= recall > 1 - (1 - s**rows) ** (bands - 1)


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(300, 330)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    found = ngram_join.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    got = {r.node: r.root for r in found}
    assert got == {n: top(n) for n in {x for e in edges for x in e} if top(n) != n}
