"""Quality rules by robust multivariate outliers (native: DataFrame functions only).

Base counts come from array expressions on each text, without exploding it.  A document that the base rules keep gets a
vector of five transformed statistics (length, word length, shares of symbols, repeated words and capitals).  For each
group of language and source a minimum-covariance-determinant estimate is fitted from three starts: medians with
median-absolute-deviation units, mean and covariance of all, and those of the half nearest to the medians.  From each start go
concentration steps (distance of all, keep the nearest share ``h``, its mean and covariance) until the determinant
falls no more; of the starts' estimates the one with the least determinant stays (ties: the first start).  A document goes
when its squared Mahalanobis distance under that estimate exceeds ``cut``.

Exactness and scale: features are integers (1/1024 units) and moments are integer sums, so the fit is the same however
rows are partitioned.  Quantiles are exact over integers from a bounded range, so their buffers are bounded too, and all
group statistics pre-aggregate in each task: a source with a third of all rows costs one row per task.  The text is read
once; concentration steps read the narrow statistics that were written to the shared folder, for all starts that still
fall at once.  Model tables have one row for each group and start; they are counted, broadcast up to BROADCAST_ROWS rows,
and joined by shuffle beyond, where AQE splits hot groups.

Edge cases: null text counts as empty (no words: base rules fail it); null language or source forms a group of its own;
groups under ``min_group`` documents are pooled by language, then overall; with fewer documents than that the method
keeps all; equal rows get equal verdicts; an empty table gives no rows; the input's other columns never clash, because
rows travel inside one struct.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WS, let, read, words, written

#: Of the transformed statistics: names and the variance floor (in squared 1/1024 units) that keeps a fit regular.
FEATURES = ("f_len", "f_word", "f_symbol", "f_repeat", "f_upper")
FLOORS = (410**2, 103**2, 80**2, 103**2, 61**2)
UNIT = 1024.0
#: Squared distances are cut off here and kept in 1/64 units: quantile buffers are bounded by their product.
D2_MOST, D2_UNIT = 4096.0, 64.0
#: The 1 - 1e-6 quantile of chi-square with five degrees of freedom.
CUT = 35.9
#: A step that lowers the determinant's logarithm by no more than this is the last; rows of a broadcast table.
TOLERANCE, BROADCAST_ROWS = 1e-4, 50_000
CONSISTENCY = 1.45  # covariance of all against that of the nearest 75 %, for five normal dimensions


def repeated_words(ws: Column) -> Column:
    """Words covered by 5-word windows that are found twice or more in the array, the first of them included."""
    n = F.size(ws)
    hashes = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(ws, i, 5))))

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            own = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            at = F.array_sort(F.transform(own, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
            step = lambda a, i: F.struct(
                (i + 5).alias("end"), (a["sum"] + i + 5 - F.greatest(i, a["end"])).alias("sum")
            )
            return F.aggregate(at, start, step, lambda a: a["sum"])

        return let(ranked, again)

    zero = F.lit(0).cast("long")
    return F.coalesce(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h))), zero)


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(rf"[^{WS}]"))
    return let(words(text), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(ws).alias("n_repeat_words"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    ))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame, keep_rows: bool) -> DataFrame:
    """Written table: the row in struct ``doc`` (whole, or only its id), group columns, counts, base verdict, features."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep_rows else F.struct("doc_id")
    d = docs.select(row.alias("doc"), F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.col("text").alias("_t"))
    # a struct of several fields is used more than once, so the optimiser keeps it as one column
    d = d.select("doc", "g_lang", "g_source", base_counts(F.col("_t")).alias("_c")).select("doc", "g_lang", "g_source", "_c.*")
    n = F.col("n_words")
    d = d.withColumn("base_failed", (n < 10) | (100 * F.col("n_repeat_words") > 20 * n))
    unit = lambda c: F.rint(c * UNIT).cast("long")
    d = d.withColumns({
        "f_len": unit(F.log1p(n.cast("double"))),
        "f_word": unit(F.log1p(F.try_divide(F.col("word_chars") + 0.0, n + 0.0))),
        "f_symbol": unit(F.sqrt(F.try_divide(F.col("n_symbols") + 0.0, n + 0.0))),
        "f_repeat": unit(F.sqrt(F.try_divide(F.col("n_repeat_words") + 0.0, n + 0.0))),
        "f_upper": unit(F.sqrt(F.try_divide(F.col("n_upper") + 0.0, F.col("word_chars") + 0.0))),
    })
    return written(d, "quality")


def pair(i: int, j: int) -> str:
    return f"c{min(i, j)}{max(i, j)}"


def factored(model: DataFrame) -> DataFrame:
    """Adds the Cholesky factor of the covariance to the model, a row a group, so that documents only do the solving."""
    d = len(FEATURES)
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(pair(i, j))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            model = model.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    return model


def solved_distance() -> Column:
    """Squared distance with the factor's columns l**; the solution is bound step by step."""
    d = len(FEATURES)
    ys: list[Column] = []
    for i in range(d):
        y = F.col(FEATURES[i]) - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * ys[k]
        ys.append(y / F.col(f"l{i}{i}"))
    return sum((y * y for y in ys[1:]), ys[0] * ys[0]) / F.lit(CONSISTENCY)


def counted(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has at most BROADCAST_ROWS rows (of some hundred bytes each)."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def distance_units() -> Column:
    return F.floor(F.least(solved_distance(), F.lit(D2_MOST)) * D2_UNIT).cast("long")


def moments(inside: DataFrame) -> DataFrame:
    """Factored mean and covariance of weighted vectors by key and start, with the logarithm of the determinant."""
    d = len(FEATURES)
    wide = lambda c: F.sum(c.cast("decimal(38,0)")).cast("double")
    sums = [F.sum("w").cast("double").alias("n")]
    sums += [wide(F.col(f) * F.col("w")).alias(f"t{i}") for i, f in enumerate(FEATURES)]
    both = list(combinations_with_replacement(range(d), 2))
    sums += [wide(F.col(FEATURES[i]) * F.col(FEATURES[j]) * F.col("w")).alias(f"q{i}{j}") for i, j in both]
    model = inside.groupBy("key", "start").agg(*sums)
    model = model.withColumns({f"m{i}": F.col(f"t{i}") / F.col("n") for i in range(d)})
    for i, j in both:
        cov = F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
        model = model.withColumn(pair(i, j), F.greatest(cov, F.lit(0.0)) + FLOORS[i] if i == j else cov)
    return with_determinant(factored(model)).select("key", "start", "n", "logdet", *PARAMETERS)


#: Columns of a model that a distance needs.
PARAMETERS = [f"m{i}" for i in range(len(FEATURES))] + [f"l{i}{j}" for i in range(len(FEATURES)) for j in range(i + 1)]


def with_determinant(model: DataFrame) -> DataFrame:
    return model.withColumn("logdet", 2 * sum((F.log(f"l{i}{i}") for i in range(1, len(FEATURES))), F.log("l00")))


def nearest(x: DataFrame, model: DataFrame, share: float) -> DataFrame:
    """The vectors of each key and start up to the quantile ``share`` of their distances."""
    near = x.join(counted(model), "key").withColumn("d2", distance_units())
    limit = near.groupBy("key", "start").agg(F.expr(f"percentile(d2, {share}, w)").alias("limit"))
    limit = written(limit, "quality-limit")
    return near.join(counted(limit), ["key", "start"]).filter(F.col("d2") <= F.col("limit"))


def fit(stats: DataFrame, share: float = 0.75, min_group: int = 60) -> tuple[DataFrame, DataFrame]:
    """(group key of each language and source, model a key): the minimum-covariance-determinant estimates."""
    good = stats.filter(~F.col("base_failed"))
    count = good.groupBy("g_lang", "g_source").agg(F.count("*").alias("n"))
    by_lang = count.groupBy("g_lang").agg(F.sum("n").alias("n_lang"))
    same = F.col("a.g_lang").eqNullSafe(F.col("b.g_lang"))
    keys = count.alias("a").join(by_lang.alias("b"), same).select("a.g_lang", "a.g_source", "n", "n_lang")
    own = F.to_json(F.array(F.coalesce("g_lang", F.lit("\0")), F.coalesce("g_source", F.lit("\0"))))
    lang = F.to_json(F.array(F.coalesce("g_lang", F.lit("\0"))))
    key = F.when(F.col("n") >= min_group, own).when(F.col("n_lang") >= min_group, lang).otherwise(F.lit("[]"))
    keys = written(keys.select("g_lang", "g_source", key.alias("key")), "quality-keys")
    x = with_key(good.select("g_lang", "g_source", *FEATURES), keys).select("key", *FEATURES)
    # whole vectors that occur more than once travel as one row with a weight
    x = written(x.groupBy("key", *FEATURES).agg(F.count("*").alias("w")), "quality-vectors")
    model = estimate(x, share)
    return keys, written(model.filter(F.col("n") >= F.lit(share * min_group)), "quality-model")


def estimate(x: DataFrame, share: float) -> DataFrame:
    """The model of each key: of three starts, the estimate with the least determinant."""
    d = len(FEATURES)
    middle = x.groupBy("key").agg(*[F.expr(f"percentile({f}, 0.5, w)").alias(f"m{i}") for i, f in enumerate(FEATURES)])
    middle = written(middle, "quality-middle")
    off = x.join(counted(middle), "key")
    spread = off.groupBy("key").agg(
        *[F.expr(f"percentile(cast(abs({f} - m{i}) as bigint), 0.5, w)").alias(f"s{i}") for i, f in enumerate(FEATURES)]
    )
    first = middle.join(spread, "key")
    for i, j in combinations_with_replacement(range(d), 2):
        variance = F.greatest(1.4826 * 1.4826 * F.col(f"s{i}") * F.col(f"s{i}"), F.lit(float(FLOORS[i])))
        first = first.withColumn(pair(i, j), variance if i == j else F.lit(0.0))
    endless = F.lit(float("inf"))
    columns = ("key", "start", "n", "logdet", *PARAMETERS)
    first = factored(first).withColumns({"start": F.lit(0), "n": F.lit(0.0), "logdet": endless}).select(*columns)
    first = written(first, "quality-start")
    half = moments(nearest(x, first, 0.5)).withColumns({"start": F.lit(2), "logdet": endless})
    every = moments(x.withColumn("start", F.lit(1))).withColumn("logdet", endless)
    falling = written(first.unionByName(every).unionByName(half), "quality-falling")
    ended = None
    while not falling.isEmpty():
        now = written(moments(nearest(x, falling, share)), "quality-step")
        before = falling.select("key", "start", F.struct("n", "logdet", *PARAMETERS).alias("old"))
        both = now.join(before, ["key", "start"])
        falls = F.col("logdet") < F.col("old.logdet") - TOLERANCE
        last = both.filter(~falls).withColumn("new", F.struct("n", "logdet", *PARAMETERS))
        last = last.select("key", "start", F.when(F.col("logdet") < F.col("old.logdet"), F.col("new")).otherwise(F.col("old")).alias("m"))
        last = last.select("key", "start", "m.*")
        ended = last if ended is None else ended.unionByName(last)
        falling = written(both.filter(falls).select(*columns), "quality-falling")
    if ended is None:
        return first
    least = ended.groupBy("key").agg(F.min(F.struct("logdet", "start", "n", *PARAMETERS)).alias("m"))
    return least.select("key", "m.*")


def with_key(stats: DataFrame, keys: DataFrame) -> DataFrame:
    """Null-safe left join of the groups' keys."""
    k = keys.withColumnsRenamed({"g_lang": "k_lang", "g_source": "k_source"})
    on = stats["g_lang"].eqNullSafe(k["k_lang"]) & stats["g_source"].eqNullSafe(k["k_source"])
    return stats.join(counted(k), on, "left").drop("k_lang", "k_source")


def judge(docs: DataFrame, cut: float = CUT, keep_rows: bool = False) -> DataFrame:
    """doc (struct), the counts, base_failed, kept, distance2 (null where no model applies): one row per input row."""
    stats = with_statistics(docs, keep_rows)
    keys, model = fit(stats)
    out = with_key(stats, keys).join(counted(model), "key", "left")
    d2 = F.when(~F.col("base_failed"), solved_distance())
    kept = ~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= cut)
    return out.select("doc", *COUNTS, "base_failed", kept.alias("kept"), d2.alias("distance2"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    return judge(docs, keep_rows=True).filter("kept").select("doc.*")


def op9_quality_rules(spark, sf_dir):
    """The contract's columns for every document."""
    return judge(read(spark, sf_dir, "documents")).select("doc.doc_id", *COUNTS, "base_failed", "kept")
