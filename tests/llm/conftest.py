"""A small corpus with everything that a document table may hold."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, block int, items string"
EN = "the of and in that with stone river under light walks quiet morning paper garden window".split()
DE = "der die das und nicht mit stein fluss unter licht geht ruhig morgen papier garten fenster".split()


def prose(rng, words, n):
    pick = [rng.choice(words) + rng.choice(["", "", "", "s", "en", "ly"]) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else "") for w in pick)


def corpus():
    rng = random.Random(7)
    texts = [prose(rng, EN if k % 2 else DE, rng.randint(30, 120)) for k in range(60)]
    passage = prose(rng, EN, 20)
    texts += [texts[0], texts[0], texts[1] + " tail", "x " + texts[2], texts[3] + " " + passage, passage + " " + texts[5]]
    texts += ["", " \n ", None, "one two", "one two", "a  b\t\tc", prose(rng, EN, 4000), "same line\n" * 30, "wort " * 50, "é ü 日本 " * 10]
    rows = [(k, t, ("en" if k % 2 else "de"), f"s{k % 3}" if k % 7 else "hot") for k, t in enumerate(texts)]
    rows += [(4, texts[4], "de", "s1"), (None, texts[6], None, None), (None, None, "en", "s2")]
    return [(i, t, la, s, None if t is None else len(t), True, 1, "x") for i, t, la, s in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, n=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])
