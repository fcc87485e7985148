"""SentencePiece, token files and page text: the library's own results, exact round trips, brute force."""

import random
import zlib

import numpy as np
import pytest

from sylvan.llm import html_text, pieces, token_files

tokenizers_dir = pytest.importorskip("public_tokenizers")


def test_pieces_equal_the_library(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers_dir.path(pieces.MODEL))
    found = pieces.encode(docs, pieces.default_vocabulary(), block_bytes=5000).collect()
    want = [(i, sp.encode(t or "")) for i, t, *_ in rows]
    assert sorted((str(r.doc_id), r.ids) for r in found) == sorted((str(i), e) for i, e in want)
    assert all(r.text_back and r.n_pieces == len(r.ids) for r in found)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes()) for r in found)


def test_long_units_and_spaces(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers_dir.path(pieces.MODEL))
    texts = ["▁ ▁x▁▁y", " ", "  ", "a\u2581 b", "\0 x \0", "�", "a" * 500, "=" * 130, "   lead and  double   ", "\n\n\t x", "日本語 und ß 𝒳", "x" * 61 + " " + "y" * 60]
    found = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces.default_vocabulary())
    assert {r.doc_id: r.ids for r in found.collect()} == {k: sp.encode(t) for k, t in enumerate(texts)}


def test_viterbi_against_brute_force(spark):
    rng = random.Random(4)
    score = {p: (k, -rng.random() * 5 - 0.1) for k, p in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "aa", "▁", "▁a", "cab"])}
    v = pieces.Vocabulary(score, [p.replace("▁", " ").encode() for p in score], None, 0, True)
    units = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["▁aabc", "axb"]
    lowest = min(s for _, s in score.values()) - 10.0

    def best(u):
        if not u:
            return 0.0
        tails = [(score[u[:k]][1] + best(u[k:])) for k in range(1, 4) if u[:k] in score]
        return max([*tails, lowest + best(u[1:])] if u[0] not in score else tails)

    names = list(score)
    found = pieces.encode_units(spark.createDataFrame([(u,) for u in sorted(set(units))], "unit string"), v).collect()
    for r in found:
        assert r.ids == pieces.encode_unit(r.unit, v)
        if "x" not in r.unit:
            assert sum(score[names[i]][1] for i in r.ids) == pytest.approx(best(r.unit)) and "".join(names[i] for i in r.ids) == r.unit


def test_very_long_units_take_no_quadratic_time():
    import time

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers_dir.path(pieces.MODEL))
    v, rng = pieces.default_vocabulary(), random.Random(3)
    for text in ["".join(rng.choice("aeinrst") for _ in range(3000)), "ab" * 700, "aaa", "e"]:
        assert pieces.encode_unit(pieces.normal(text), v) == sp.encode(text)
    start = time.process_time()
    assert len(pieces.encode_unit("a" * 200_000, v)) > 0
    assert time.process_time() - start < 20


def test_query_of_pieces(tmp_path, docs, rows, spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers_dir.path(pieces.MODEL))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = pieces.op5_sentencepiece(spark, str(tmp_path)).collect()
    want = [(str(i), len(e), zlib.crc32(np.array(e, "<i4").tobytes()), True) for i, e in ((r[0], sp.encode(r[1] or "")) for r in rows)]
    assert sorted((str(r.doc_id), r.n_pieces, r.ids_crc32, r.text_back) for r in found) == sorted(want)


def test_pieces_of_nothing(empty):
    assert pieces.encode(empty, pieces.default_vocabulary()).collect() == []


@pytest.mark.parametrize("top", [1, 2, 2**7, 2**16, 2**40, 2**60, 2**63])
def test_packing_round_trip(top):
    rng = np.random.default_rng(top % 1000)
    for n in (0, 1, 59, 60, 61, 1023, 1024, 1025, 3000):
        ids = rng.integers(0, top, n, dtype=np.uint64)
        ids[::3] = 0
        words, offsets, escapes = token_files.pack(ids)
        assert (token_files.unpack(words, offsets, escapes, n) == ids).all()
        data = token_files.encode_segment(np.array([7]), np.array([n % 2 == 0]), np.array([n]), ids)
        stop, names, valid, counts, back = token_files.decode_segment(b"x" * 8 + data, 8)
        assert stop == len(data) + 8 and names.tolist() == [7] and valid.tolist() == [n % 2 == 0]
        assert counts.tolist() == [n] and (back == ids).all()


def test_small_ids_take_few_words():
    assert len(token_files.pack(np.zeros(1020, np.uint64))[0]) == 17


def plain_ids(path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, token_files.END]


def test_token_files(docs, rows, spark, monkeypatch):
    path = tokenizers_dir.path(token_files.VOCABULARY)
    encode = plain_ids(path)
    found = token_files.read_tokens(spark, *token_files.write_tokens(docs, path, shards=3)).collect()
    want, start = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = encode(t)
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want


def test_small_files_and_segments(docs, rows, spark, monkeypatch):
    path = tokenizers_dir.path(token_files.VOCABULARY)
    whole = sorted(map(tuple, token_files.read_tokens(spark, *token_files.write_tokens(docs, path)).collect()), key=str)
    for name, value in (("SEGMENT_IDS", 500), ("FILE_BYTES", 2000), ("TEXT_BYTES", 1000)):
        monkeypatch.setitem(token_files.write_tokens.__globals__, name, value)
    folder, index = token_files.write_tokens(docs, path, shards=2)
    assert index.count() > 4  # values travel with the task's function
    assert sorted(map(tuple, token_files.read_tokens(spark, folder, index).collect()), key=str) == whole


def test_query_of_token_files(tmp_path, docs, rows, spark):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    encode = plain_ids(tokenizers_dir.path(token_files.VOCABULARY))
    found = token_files.op6_token_files(spark, str(tmp_path)).collect()
    want = [(str(i), len(encode(t)), zlib.crc32(np.array(encode(t), "<u4").tobytes())) for i, t, *_ in rows]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted(want)


def test_ids_are_those_of_the_plain_call():
    import pyarrow as pa

    path = tokenizers_dir.path(token_files.VOCABULARY)
    enc, encode, rng = token_files.Encoder(path, 2), plain_ids(path), random.Random(1)
    parts = ["a", "b'", "'s", "é", "ß", "×", "\n", " ", "  ", ".", "!?", "1", "½", "\u00a0", "\u3000", "\x1c", "\0", "<|endoftext|>", "日本", "it's",
             "Ġ", "İ", "\t", "\r\n", "x.y", ";", " z", " word", " the"]
    texts = [None, "", "a <|endoftext|> b"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for some in (texts, texts[:1], []):
        ids, counts = enc.encode(pa.array(some, pa.string()))
        ends = np.cumsum(counts)
        assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == [encode(t) for t in some]
    ids, _ = token_files.Encoder(path, 2, special_as_text=True).encode(pa.array(["a <|endoftext|> b"]))
    assert 50256 not in ids and 50256 in encode("a <|endoftext|> b")


def test_tokens_of_nothing(empty, spark):
    path = tokenizers_dir.path(token_files.VOCABULARY)
    assert token_files.read_tokens(spark, *token_files.write_tokens(empty, path)).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="menu-open"><header>H</header><nav><ul><li>n</ul></nav>
<div class="cookie-notice">c</div><article><header><h1>Ti&amp;tle</h1></header><p>One <b>two<br>three<p>caf&eacute;&nbsp;x <!-- no --> y
<aside>s</aside><div class="ad"><p>buy</div><ul><li>a<li>b</ul><section id="comments"><p>hi</section><script>var t="</p>";</script></article>
<form>f</form><footer>&copy;</footer></body></html>"""


def test_article_lines():
    texts, kinds = html_text.lines_of(PAGE)
    assert [t for t, k in zip(texts, kinds) if k == html_text.ARTICLE] == ["Ti&tle", "One two three", "café x y", "a", "b"]
    for broken in ("", "<", "<p", "<!--", "<article><p>x", "</div></p>", "<script>", "a<b", "<p class='x>y</p>"):
        html_text.lines_of(broken)


def test_longest_common_subsequence_against_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = html_text.shared_lines(a, b)
        assert len(got) == table[-1][-1] and got == sorted(set(got))
        rest = iter(b)
        assert all(any(a[k] == y for y in rest) for k in got)


def test_pages(spark):
    body = lambda x: f"<body><div>Our Site</div><p>{x}</p><div>Terms and so on</div></body>"
    rows = [(1, "http://h.com/a/1", body("first text")), (2, "http://h.com/a/2", body("second text")), (3, "http://other.com/a/2", body("alone")),
            (4, None, PAGE), (5, "http://h.com/z", None), (6, "http://g.com/1", PAGE), (7, "http://g.com/2", PAGE), (1, "http://h.com/a/1", ""), (None, "x", "<p>long " + "word " * 20000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, shard int")
    found = html_text.extract(pages).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    text = {(r.page_id, r.n_chars > 0): r.text for r in found}
    assert text[1, True] == "first text" and text[2, True] == "second text" and text[3, True] == "Our Site\nalone\nTerms and so on"
    article = "Ti&tle\nOne two three\ncafé x y\na\nb"
    assert text[4, True] == text[6, True] == text[7, True] == article and text[5, False] == ""
    assert html_text.extract(pages.filter("page_id = 99")).collect() == []


def test_loose_lines_of_an_article_and_copies(spark):
    page = lambda x: f"<main><h1>{x}</h1><p>Common passage.</p><div>Sign up here</div><p>{x} text</p><p><a href='#'>Back to top</a></p></main>"
    rows = [(1, "http://h.com/a/1", page("A")), (2, "http://h.com/a/2", page("B")), (3, "http://h.com/a/2", page("B")), (4, "http://c.com/x", page("C")),
            (5, "http://c.com/y", page("C")), (6, "http://alone.com/x", page("D"))]
    found = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    short = lambda x: f"{x}\nCommon passage.\n{x} text"
    whole = lambda x: f"{x}\nCommon passage.\nSign up here\n{x} text\nBack to top"
    assert [found[k].text for k in (1, 2, 3)] == [short("A"), short("B"), short("B")] and found[1].n_shared == 2
    assert [found[k].text for k in (4, 5, 6)] == [whole("C"), whole("C"), whole("D")]


def test_common_prose_of_a_host_is_template_text(spark):
    page = lambda x, k: f"<article><h1>{x}</h1><p>{x} {k} says much more than this.</p><p>{'Quoted.' if k < 2 else x}</p><p>Read all our news.</p></article>"
    rows = [(k, f"http://h.com/a/{k}", page("ABCDEFG"[k], k)) for k in range(7)]
    near = "<article><p>One long passage that all copies have.</p><p>Another long one that they have.</p><p>{}</p></article>"
    rows += [(10 + k, f"http://copies.com/{k}", near.format(k)) for k in range(7)]
    rows += [(20 + k, f"http://few.com/{k}", page("ABCD"[k], k)) for k in range(4)]
    found = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    body = lambda x, k: f"{x}\n{x} {k} says much more than this.\n{'Quoted.' if k < 2 else x}"
    assert [(found[k].text, found[k].n_shared) for k in range(7)] == [(body("ABCDEFG"[k], k), 1) for k in range(7)]
    assert all(found[10 + k].n_shared == 0 and found[10 + k].text.endswith(f"they have.\n{k}") for k in range(7))
    assert all(found[20 + k].text == body("ABCD"[k], k) + "\nRead all our news." for k in range(4))


def test_pages_that_differ_by_query_alone(spark):
    page = lambda x: f"<body><div>Menu line</div><p>{x}</p><div>Bottom line</div></body>"
    rows = [(k, f"http://q.com/index.php?id={k}", page(f"text {k // 2}")) for k in range(8)]
    rows += [(9, "http://one.com/p?ref=a", page("same")), (10, "http://one.com/p?ref=b", page("same"))]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[k] for k in range(8)] == [f"text {k // 2}" for k in range(8)]
    assert found[9] == found[10] == "Menu line\nsame\nBottom line"


def test_nearest_tie_and_host():
    own = ("h", "/b/5", 1)
    assert html_text.nearest(own, ("h", "/b/4", 2), ("h", "/b/6", 3)) == 2  # a tie: the one before
    assert html_text.nearest(own, ("h", "/a", 2), ("h", "/b/6", 3)) == 3
    assert html_text.nearest(own, ("g", "/b/4", 2), None) is None


def test_given_pages_hold_given_documents(spark):
    """Every given page carries one given document: its text, behind the heading, is that document's whole text."""
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no given tables")
    texts = {" ".join((r.text or "").split()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = html_text.op1_html_extraction(spark, folder).collect()
    assert found and all(" ".join(r.text.split("\n")[1:]) in texts for r in found)
