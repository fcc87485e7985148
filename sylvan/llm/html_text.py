"""Main text of web pages by nearest-URL page differencing, with markup rules.

A page becomes lines: one for each block of text, with white space runs as one space and character references decoded,
each marked as page furniture (by element, role and class), body text, prose of a marked article, or loose text there
(outside paragraphs, headings, items, cells and quotes, or nothing but links).  Pages of a host are put in order of their
path; a page is compared with the neighbour of another path that has the longest common prefix with its own (ties: the
one before).  Where a host has one path only, the neighbours are its queries instead, of those whose lines differ.
Lines of all pages are aligned with those of that page by longest common subsequence.  Shared lines are deleted as
template text, from the body of a page that marks no article and from the loose lines of one that does; a page with the very
lines of its neighbour is a copy and keeps them.  Prose of a marked article may also be a passage that two articles share,
which is their text: a shared line of prose is template text if SUPPORT different pages of the host and over half of them
have it, and the article is a near copy, which keeps its prose, if over half of its characters would go that way.

Scale: pages are parsed once, in Arrow batches, into a written table of what can be output and of line hashes.
Differencing moves hashes only.  Each path is represented by one page (the smallest page_id and row), so a path with a
third of all pages is one row; lines of a host are counted by (host, line) with partial sums; a range shuffle of paths by (host, path) splits a hot host over many tasks, and paths at a
range's ends see the next range's end, of which the driver hands round two keys a range.  Texts are shuffled only for pages
of which a line can be deleted.

Edge cases: null html gives empty text; a null url or one without host is paired among those; repeated page ids and urls
are separate rows; broken or cut-off markup ends open elements; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import os.path
import re
from bisect import bisect_left
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import let, read, scan_partitions, written
from .url_filter import host_of, path_of
from .wordhash import slices

#: Element names, roles and class words with their meaning.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
RAW = set("script style textarea title iframe noembed noframes xmp plaintext".split())
FURNITURE = set(
    "head nav footer aside form script style noscript template iframe object svg math canvas button select dialog menu audio "
    "video map datalist search textarea title noembed noframes xmp".split()
)
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar status".split())
FURNITURE_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr "
    "notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar sidebars aside comment "
    "comments commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe "
    "subscription popup modal overlay login signup widget widgets pager pagination toolbar".split()
)
CLOSES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
PROSE = set("p h1 h2 h3 h4 h5 h6 li dd dt td th caption blockquote pre figcaption summary".split())
OTHER, BODY, ARTICLE, LOOSE = 0, 1, 2, 3
#: Different pages of a host that must have a line of prose before it can be template text.
SUPPORT = 5


def meaning(name: str, attributes: str, inside: int) -> int:
    """What the text inside an element is, given what the text around it is."""
    if inside == OTHER or name in FURNITURE or (name == "header" and inside != ARTICLE):
        return OTHER
    kind = ARTICLE if name in ("article", "main") else inside
    if attributes:
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
        words = {w for key in ("class", "id") if key in found for w in re.split(r"[^a-z0-9]+", found[key])}
        role = found.get("role", "")
        furniture = role in FURNITURE_ROLES or words & FURNITURE_WORDS or found.get("aria-hidden") == "true"
        if name not in ("html", "body") and (furniture or re.search(r"(?:^|\s)hidden(?=[\s=/]|$)", attributes)):
            return OTHER
        if role in ("main", "article"):
            return ARTICLE
    return kind


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """Text and kind of each block, in page order."""
    texts, kinds, run = [], [], []
    stack: list[tuple[str, int]] = []
    kind = BODY
    links, plain = 0, False  # open links; whether the block has text outside them

    def flush() -> None:
        nonlocal plain
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            texts.append(text)
            prose = plain and any(name in PROSE for name, _ in stack)
            kinds.append(LOOSE if kind == ARTICLE and not prose else kind)
        run.clear()
        plain = False

    at = 0
    while True:
        m = TAG.search(page, at)
        run.append(page[at : m.start() if m else len(page)])
        plain = plain or not links and not run[-1].isspace() and run[-1] != ""
        if m is None:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                run.append(m[0][9:].removesuffix("]]>"))
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name == "br" or (name not in BLOCK and name in VOID):
            run.append(" " if name in ("br", "wbr") else "")
            continue
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is None:
                continue
            if name in BLOCK or stack[depth][1] != kind or any(s[0] in BLOCK for s in stack[depth:]):
                flush()
            del stack[depth:]
            links = sum(s[0] == "a" for s in stack)
            kind = stack[-1][1] if stack else BODY
            continue
        if name in BLOCK:
            flush()
            # a new block ends an open paragraph, an item ends the item before it
            for k in range(len(stack) - 1, -1, -1):
                own = stack[k][0]
                if own == "p" or own == name and name in CLOSES or {own, name} in ({"dd", "dt"}, {"td", "th"}):
                    del stack[k:]
                    kind = stack[-1][1] if stack else BODY
                    links = sum(s[0] == "a" for s in stack)
                    break
                if own in BLOCK and (name not in CLOSES or own in CLOSES[name]):
                    break
        if name in VOID:
            continue
        inner = meaning(name, attributes, kind)
        if name in RAW:  # nothing inside is markup; none of it is text of the page
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if inner != kind:
            flush()
        if not attributes.rstrip().endswith("/") or name in BLOCK:
            stack.append((name, inner))
            kind = inner
            links += name == "a"
    flush()
    return texts, kinds


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Places in ``own`` of a longest common subsequence with ``other`` (Hunt and Szymanski)."""
    places: dict[int, list[int]] = {}
    for j in range(len(other) - 1, -1, -1):
        places.setdefault(other[j], []).append(j)  # from the back, so that one line is used once
    ends: list[int] = []
    chain: list[tuple] = []
    for i, line in enumerate(own):
        for j in places.get(line, ()):
            k = bisect_left(ends, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k], chain[k] = j, link
    out, at = [], chain[-1] if chain else None
    while at:
        out.append(at[0])
        at = at[1]
    return out[::-1]


LINES = "page_id long, url string, host string, path string, query string, lines array<string>, kinds array<int>"


def parse(pages: DataFrame) -> DataFrame:
    """Written table of parsed pages, each with a row id: lines that can be output, which of them are prose, hashes of all."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "html")):
            rows = [lines_of(h) if h else ([], []) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id").cast(pa.int64()), *(batch.column(c) for c in ("url", "host", "path", "query")),
                    pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                ],
                names=["page_id", "url", "host", "path", "query", "lines", "kinds"],
            )

    url = F.col("url")
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    parsed = pages.select(
        "page_id", "url", "html", host_of(url).alias("host"), path_of(url).alias("path"), query.alias("query")
    ).mapInArrow(run, LINES)
    marked = F.exists("kinds", lambda k: (k == ARTICLE) | (k == LOOSE))
    own = F.when(marked, F.array(F.lit(ARTICLE), F.lit(LOOSE))).otherwise(F.array(F.lit(BODY)))
    # sure: all that can be output is prose of a marked article
    sure = marked & ~F.exists("kinds", lambda k: k == LOOSE)
    found = parsed.select(
        "page_id", "url", "host", "path", "query", F.monotonically_increasing_id().alias("row"), sure.alias("sure"),
        F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
        F.when(~sure & marked, F.transform("kinds", lambda k: k.isin(ARTICLE))).alias("prose"),
        let(own, lambda o: F.transform("lines", lambda x, i: F.when(F.array_contains(o, F.get("kinds", i)), x))).alias("lines"),
    )
    return written(found, "pages-parsed")


def nearest(own: tuple, before: tuple | None, after: tuple | None) -> int | None:
    """Of the neighbours (group, place, row) in the same group, the row of the one whose place has more in common."""
    near = [x for x in (before, after) if x is not None and x[0] == own[0]]
    return max(near, key=lambda x: len(os.path.commonprefix([own[1], x[1]])), default=(None, None, None))[2]


def neighbours(places: DataFrame, parts: int) -> DataFrame:
    """(grp, place, near) of distinct (grp, place, row): the row of the neighbour in the group, null if there is none."""
    order = ["grp", "place"]
    ranged = places.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("shard", F.spark_partition_id()), "pages-ordered")
    key = F.struct(*order, "row")
    found = ranged.groupBy("shard").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()
    ends = {r.shard: [tuple(x) for x in (r.first, r.last)] for r in found}
    before = {b: ends[a][1] for a, b in pairwise(sorted(ends))}
    after = {a: ends[b][0] for a, b in pairwise(sorted(ends))}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        shard = table["shard"][0].as_py()
        rows = list(zip(*(table[c].to_pylist() for c in (*order, "row"))))
        near = [nearest(own, a, b) for a, own, b in zip([before.get(shard), *rows], rows, [*rows[1:], after.get(shard)])]
        return pa.table({"grp": table["grp"], "place": table["place"], "near": pa.array(near, pa.int64())})

    return ranged.groupBy("shard").applyInArrow(run, "grp string, place string, near long")


def partners(parsed: DataFrame) -> DataFrame:
    """(host, path, lines, other): line hashes of the nearest page, by path; by path and lines where a host has one path."""
    parts = scan_partitions(parsed.sparkSession, parsed)
    one = F.min(F.struct("page_id", "row"))["row"].alias("row")
    paths = parsed.groupBy(F.col("host").alias("grp"), F.col("path").alias("place")).agg(one)
    by_path = written(neighbours(paths, parts), "pages-neighbours")
    lonely = by_path.filter("near is null").select(F.col("grp").alias("host"), F.col("place").alias("path"))
    # of a lonely path: its different pages, in order of their queries
    rest = parsed.join(lonely, ["host", "path"], "left_semi").select(
        F.to_json(F.struct("host", "path")).alias("grp"), "host", "path", "lines_hash", "query", "page_id", "row"
    )
    rest = rest.groupBy("grp", "host", "path", "lines_hash").agg(F.min(F.struct("query", "page_id", "row")).alias("m"))
    rest = written(rest.select("grp", "host", "path", "lines_hash", F.concat_ws(" ", "m.query", F.hex("lines_hash")).alias("place"), "m.row"), "pages-lonely")
    by_query = rest.join(neighbours(rest.select("grp", "place", "row"), parts), ["grp", "place"])
    found = by_path.filter("near is not null").select(
        F.col("grp").alias("host"), F.col("place").alias("path"), F.lit(None).cast("long").alias("lines_hash"), "near"
    ).union(by_query.filter("near is not null").select("host", "path", "lines_hash", "near"))
    hashes = parsed.select(F.col("row").alias("near"), F.col("hashes").alias("other"))
    return found.join(hashes, "near").drop("near")


def host_lines(lines: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(host, common): hashes of the lines that ``support`` different pages and over half of those of a host have."""
    pages = written(lines.groupBy("host", "lines_hash").agg(F.first("hashes").alias("hashes")), "pages-different")
    n = pages.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    seen = pages.select(F.col("host").alias("own"), F.explode(F.array_distinct("hashes")).alias("line"))
    seen = seen.groupBy("own", "line").agg(F.count("*").alias("times")).filter(F.col("times") >= support)
    often = seen.join(n, F.col("own") == F.col("host")).filter(2 * F.col("times") > F.col("n"))
    return written(often.groupBy("host").agg(F.collect_list("line").alias("common")), "pages-common")


def difference(parsed: DataFrame) -> DataFrame:
    """(row, shared, common): numbers of the lines that a page shares with the page of its nearest url, and those of them
    that are common on its host. Pages that can't lose a line for that are left out."""
    lines = parsed.select("page_id", "row", "host", "path", "query", "sure", "hashes", F.xxhash64("hashes").alias("lines_hash"))
    other = written(partners(lines), "pages-partners")
    often = host_lines(lines)

    def run(batches):
        for batch in batches:
            found = {"row": [], "shared": [], "common": []}
            for row, sure, own, near, often in zip(*(batch.column(c).to_pylist() for c in ("row", "sure", "hashes", "other", "common"))):
                shared = shared_lines(own, near) if near and own != near else []
                often = set(often or ())
                common = [k for k in shared if own[k] in often]
                if common or (shared and not sure):
                    for name, value in zip(found, (row, shared, common)):
                        found[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found["row"], pa.int64()), *(pa.array(found[c], pa.list_(pa.int32())) for c in ("shared", "common"))], names=list(found)
            )

    asked = lines.select("row", "host", "path", "sure", "hashes", "lines_hash")
    by_path = asked.join(other.filter("lines_hash is null").drop("lines_hash"), ["host", "path"])
    by_lines = asked.join(other.filter("lines_hash is not null"), ["host", "path", "lines_hash"])
    both = by_path.select("row", "host", "sure", "hashes", "other").union(by_lines.select("row", "host", "sure", "hashes", "other"))
    both = both.join(often, "host", "left").select("row", "sure", "hashes", "other", "common")
    return written(both.mapInArrow(run, "row long, shared array<int>, common array<int>"), "pages-shared")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines deleted as shared): one row per input row."""
    parsed = parse(pages)
    out = parsed.select("row", "page_id", "url", "lines", "prose", "sure").join(difference(parsed), "row", "left")
    has = lambda places, i: F.coalesce(F.array_contains(places, i), F.lit(False))
    prose = lambda i: F.col("sure") | F.coalesce(F.get("prose", i), F.lit(False))
    size = lambda which: F.aggregate(F.transform("lines", lambda x, i: F.when(x.isNotNull() & which(i), F.length(x)).otherwise(0)), F.lit(0), lambda a, b: a + b)
    copy = let(F.size("common"), lambda n: (n > 0) & (2 * size(lambda i: prose(i) & has("common", i)) > size(prose)))
    gone = lambda i: F.when(prose(i), has("common", i) & ~F.col("copy")).otherwise(has("shared", i))
    out = out.withColumn("copy", F.when(F.col("shared").isNotNull(), copy).otherwise(False))
    before = F.filter("lines", lambda x: x.isNotNull())
    kept = F.when(F.col("shared").isNull(), before).otherwise(F.filter("lines", lambda x, i: x.isNotNull() & ~gone(i)))
    out = out.select("page_id", "url", F.array_join(kept, "\n").alias("text"), (F.size(before) - F.size(kept)).alias("n_shared"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


def op1_html_extraction(spark, sf_dir):
    """The contract's columns for every page."""
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
