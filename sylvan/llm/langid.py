"""Language identification with word-first backoff.

A known word scores its log frequency in each language.  An unseen word backs off to character n-grams of the word
with its ends marked: the longest n of which any n-gram is known decides, each step down costing a fixed discount.  The
document's score is the posterior of its summed word scores under equal priors.

Training reads the text and non-null language of at most ``sample`` training documents (those with the smallest hashes
of text and doc_id; production bound: SAMPLE) and keeps at most ``words`` words and ``grams`` n-grams of each length for
each language, those of the highest counts (equal counts stay or go together); so the model has a proven size bound and
does not depend on how rows are partitioned.  None for either keeps all that the sample has.  It is broadcast once.  The prediction is one pass over whole texts in Arrow batches, without a shuffle:
word vectors are gathered from one matrix, unseen words of a batch are scored together and kept in a bounded memo.

Letters are the Unicode categories L*, in training and prediction alike: numerals such as ½, ² or Ⅷ are none.

Edge cases: null text or text without a letter gives ``und`` and score 0; equal scores go to the first language by name; with nothing to learn from, every document is
``und``; a null doc_id counts as not held out and not for training; repeated rows each get their result; an empty table
gives no rows; other columns, lang and source included, are no input of a prediction.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import read, written
from .wordhash import slices

SAMPLE, WORDS, GRAMS, LONGEST = 20_000, 20_000, 8_000, 5
DISCOUNT = 0.7
MEMO = 300_000


LETTERS = re.compile(r"[^\W\d_]+")


@cache
def numerals() -> frozenset[str]:
    """Word characters that are neither letters nor decimal digits, such as one half or a Roman numeral sign."""
    every = (chr(c) for c in range(0x110000))
    return frozenset(c for c in every if c.isalnum() and not c.isdecimal() and not unicodedata.category(c).startswith("L"))


def parted(word: str) -> list[str]:
    """The runs of letters of a word that has numerals."""
    return "".join(" " if c in numerals() else c for c in word).split()


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, words: int | None = WORDS, grams: int | None = GRAMS) -> dict:
    """Languages, and for words (n = 0) and n-grams their row in a matrix of log frequencies by language."""
    usable = docs.filter((remainder(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64("text", "doc_id")
    bound = usable.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if bound is None:
        return {"langs": [], "rows": {}, "matrix": np.zeros((0, 0), np.float32), "floor": None}
    chosen = usable.filter(order <= bound).select("lang", "text")
    found = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    found = written(found.groupBy("lang", "w").agg(F.count("*").alias("n")), "langid-words")
    marked = F.concat(F.lit("^"), "w", F.lit("$"))
    parts = found.select("lang", "n", marked.alias("m"), F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("k"))
    parts = parts.filter(F.length("m") >= F.col("k")).select(
        "lang", "n", "k", F.explode(F.transform(F.sequence(F.lit(1), F.length("m") - F.col("k") + 1), lambda i: F.substring("m", i, F.col("k")))).alias("w")
    )
    parts = parts.groupBy("lang", "k", "w").agg(F.sum("n").alias("n"))
    every = found.select("lang", F.lit(0).alias("k"), "w", "n").union(parts.select("lang", "k", "w", "n"))
    every = written(every, "langid-counts")
    total = every.groupBy("lang", "k").agg(F.sum("n").alias("total"))
    # the most frequent of each language and length: how many reach each count decides the least count that is kept
    steps = every.groupBy("lang", "k", "n").agg(F.count("*").alias("c"))
    above = F.sum("c").over(Window.partitionBy("lang", "k").orderBy(F.desc("n")))
    endless = 1 << 62
    most = F.when(F.col("k") == 0, words or endless).otherwise(grams or endless)
    least = steps.withColumn("above", above).filter(F.col("above") <= most).groupBy("lang", "k").agg(F.min("n").alias("least"))
    kept = every.join(least, ["lang", "k"]).filter("n >= least").join(total, ["lang", "k"])
    kept = kept.select("lang", "k", "w", F.log(F.col("n") / F.col("total")).alias("log")).collect()
    langs = sorted({r.lang for r in kept})
    sizes = {(r.lang, r.k): float(np.log(0.5 / r.total)) for r in total.collect() if r.lang in langs}
    number = {name: k for k, name in enumerate(langs)}
    keys = sorted({(r.k, r.w) for r in kept})
    rows = {key: i for i, key in enumerate(keys)}
    floor = np.array([[sizes.get((name, k), -20.0) for name in langs] for k in range(LONGEST + 1)], np.float32)
    matrix = floor[[k for k, _ in keys]] if keys else np.zeros((0, len(langs)), np.float32)
    for r in kept:
        matrix[rows[r.k, r.w], number[r.lang]] = r.log
    return {"langs": langs, "rows": [{w: rows[k, w] for kk, w in keys if kk == k} for k in range(LONGEST + 1)], "matrix": matrix, "floor": floor}


class Scorer:
    """Word vectors of one worker, with a bounded memo of unseen words."""

    def __init__(self, model: dict) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.row = dict(self.model["rows"][0])
        self.vectors = self.model["matrix"]

    def learn(self, unseen: list[str]) -> None:
        """Adds the vectors of unseen words: mean of the known n-grams of the longest length that has any."""
        grams = self.model["rows"]
        flat, counts, cost = [], [], []
        for w in unseen:
            m, found = f"^{w}$", []
            for k in range(min(LONGEST, len(m)), 0, -1):
                known = grams[k]
                found = [r for i in range(len(m) - k + 1) if (r := known.get(m[i : i + k])) is not None]
                if found:
                    break
            flat += found
            counts.append(len(found))
            cost.append(DISCOUNT ** (LONGEST + 1 - k))
        counts = np.array(counts)
        new = np.zeros((len(unseen), self.vectors.shape[1]), np.float32)
        some = counts > 0
        if some.any():
            sums = np.add.reduceat(self.model["matrix"][flat], (np.cumsum(counts) - counts)[some])
            new[some] = sums / counts[some][:, None] * np.array(cost, np.float32)[some][:, None]
        at = len(self.vectors)
        self.vectors = np.concatenate([self.vectors, new])
        self.row.update(zip(unseen, range(at, at + len(unseen))))

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(summed scores, number of words) of each text."""
        if len(self.row) > MEMO:
            self.reset()
        split = [LETTERS.findall(t.lower()) for t in texts]
        row = self.row
        unseen = list(dict.fromkeys(w for s in split for w in s if w not in row))
        odd = {w: parted(w) for w in unseen if not numerals().isdisjoint(w)}
        if odd:
            split = [[p for w in s for p in odd.get(w, (w,))] for s in split]
            unseen = list(dict.fromkeys(w for s in split for w in s if w not in row))
        counts = np.array([len(s) for s in split])
        if unseen:
            self.learn(unseen)
        at = np.fromiter((row[w] for s in split for w in s), np.int64, int(counts.sum()))
        out = np.zeros((len(texts), self.vectors.shape[1]))
        some = counts > 0
        if some.any():
            out[some] = np.add.reduceat(self.vectors[at], (np.cumsum(counts) - counts)[some], dtype=np.float64)
        return out, counts


RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        scorer = Scorer(own) if own["langs"] else None
        for batch in (part for whole in batches for part in slices(whole, "text", 1 << 20)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            best, share = ["und"] * len(texts), np.zeros(len(texts))
            if scorer:
                sums, counts = scorer.sums(texts)
                top = sums.argmax(1)
                share = 1 / np.exp(sums - sums[np.arange(len(texts)), top][:, None]).sum(1)
                best = [own["langs"][k] if n else "und" for k, n in zip(top, counts)]
                share = np.where(counts > 0, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held"), pa.array(best, pa.string()), pa.array(share)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), "text").mapInArrow(run, RESULT)


def op2_language_id(spark, sf_dir):
    """The contract's columns for every document."""
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs))
