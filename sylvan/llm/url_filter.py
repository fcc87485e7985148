"""URL filter by a path-template tree (native: DataFrame functions only).

Every url becomes a path in a tree whose root is above all hosts, whose first level are hosts and whose further levels are
path segments, all of them.  Variable segments (numbers, hashes, dates, long ids) generalise to typed wildcards, file
suffixes stay.  A node's evidence is the number of allowed and blocked urls under it, where a url's label is the verdict
of the explicit rules.  The tree is built from the root down.  Of a node's branches, put in order of their share of
blocked urls, neighbours that differ by no more than ``z`` standard errors are merged, their subtrees too.  A merged branch
whose evidence does not differ from its parent's share by more than ``z`` standard errors passes that on; else it is a template
with a smoothed share of its own.  Nodes whose evidence is all of one kind, or none, need no further level.  A template
is rejected when its share reaches ``reject_at``; without any labelled url on its way up, the prior decides (allow).

Scale: urls are counted by host and generalised path first.  A level costs one pre-aggregating ``groupBy`` over (node,
branch) of the rows that are still open, so a host with a third of all urls sends one row per task and branch.  Branches
of one node with equal evidence are one row before they are put in order, so a sort holds a node's different pairs of
counts, not its branches.  The verdicts go back by a join on host and path; node tables are broadcast by Spark only below
its own measured threshold, and AQE splits a hot host's side of a sort-merge join.

Edge cases: a null url, or one without ``://``, has empty host and path, is under the root only and so gets the root's
verdict; page_id may be null or repeated, each input row gives one output row; an empty table gives no rows; further
columns of the input are ignored, whatever they are called.  Of rules of equal length that fit, the last in the list wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import read, written

#: The explicit rules (verdict, host, path) that the query's contract lists.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, ASCII_UPPER, ASCII_UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, or nulls. The list is short, so it is one CASE, not a join."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def wildcard(segment: Column) -> Column:
    """Generalises a variable path segment to a typed wildcard; a file suffix stays."""
    return (
        F.when(segment.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("{date}"))
        .when(segment.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(segment.rlike(r"^[0-9]+\.[a-z]+$"), F.concat(F.lit("{n}"), F.regexp_extract(segment, r"(\.[a-z]+)$", 1)))
        .when(segment.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("{hash}"))
        .when(segment.rlike(r"[0-9]") | (F.length(segment) > 24), F.lit("{id}"))
        .otherwise(segment)
    )


def templates(path: Column) -> Column:
    """The path's segments, generalised."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), wildcard)


def tree(leaf: DataFrame, prior_weight: int, z: float) -> DataFrame:
    """(key, share, template) of each generalised url of ``leaf`` (key, host, parts, n, b)."""
    n, b = leaf.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    rows = leaf.withColumns({
        "node": F.lit(""), "label": F.lit(""), "template": F.lit(""), "share": F.lit(float(b)) / F.lit(float(max(n, 1)))
    })
    answer = ("key", "share", "template")
    if not 0 < b < n:
        return rows.select(*answer)
    done, level = [], 0
    while True:
        rows = rows.withColumn("child", F.col("host") if level == 0 else F.get("parts", F.lit(level - 1)))
        done.append(rows.filter("child is null").select(*answer))
        rows = rows.filter("child is not null")
        own = written(rows.groupBy("node", "child").agg(F.sum("n").alias("cn"), F.sum("b").alias("cb")).filter("cn > 0"), "url-branches")
        pairs = own.groupBy("node", "cn", "cb").agg(F.count("*").alias("k"), F.min("child").alias("first"))
        # neighbours in the order of shares that are alike belong together
        order = Window.partitionBy("node").orderBy((F.col("cb") + 0.0) / F.col("cn"), "cn")
        n1, b1 = F.lag("cn").over(order), F.lag("cb").over(order)
        pooled = (F.col("cb") + b1 + 0.0) / (F.col("cn") + n1)
        error = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / F.col("cn") + F.lit(1.0) / n1))
        apart = F.abs((F.col("cb") + 0.0) / F.col("cn") - (b1 + 0.0) / n1) > z * error
        pairs = pairs.withColumn("cut", F.coalesce(apart, F.lit(False)).cast("int"))
        pairs = pairs.withColumn("g", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        groups = pairs.groupBy("node", "g").agg(
            F.sum(F.col("cn") * F.col("k")).alias("gn"), F.sum(F.col("cb") * F.col("k")).alias("gb"), F.sum("k").alias("k"), F.min("first").alias("first")
        )
        branch = own.join(pairs.select("node", "cn", "cb", "g"), ["node", "cn", "cb"]).join(groups, ["node", "g"])
        found = rows.join(branch.drop("cn", "cb"), ["node", "child"], "left")
        differs = F.abs(F.col("gb") - F.col("gn") * F.col("share")) > z * F.sqrt(F.col("gn") * F.col("share") * (1 - F.col("share")))
        more = F.when(F.col("k") > 1, F.concat(F.lit("|+"), (F.col("k") - 1).cast("string"))).otherwise("")
        label = F.concat("label", F.when(F.col("node") == "", "").otherwise("/"), "first", more)
        keep = F.coalesce(differs, F.lit(False))
        found = found.withColumns({
            "share": F.when(keep, (F.col("gb") + F.col("share") * prior_weight) / (F.col("gn") + prior_weight)).otherwise(F.col("share")),
            "template": F.when(keep, label).otherwise(F.col("template")), "label": label,
            "node": F.concat("node", F.lit("/"), F.col("g").cast("string")),
            "mixed": F.coalesce((F.col("gb") > 0) & (F.col("gb") < F.col("gn")), F.lit(False)),
        })
        found = written(found.select("key", "host", "parts", "n", "b", "node", "label", "template", "share", "mixed"), "url-level")
        done.append(found.filter("not mixed").select(*answer))
        rows, level = found.filter("mixed").drop("mixed"), level + 1
        if rows.isEmpty():
            return reduce(DataFrame.union, done)


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    prior_weight: int = 4,
    z: float = 2.0,
    reject_at: float = 0.5,
) -> DataFrame:
    """page_id, host, path, rule, verdict and the template that decided, one row per input row."""
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    parts = templates(F.col("path"))
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("label"), parts.alias("parts"))
    # a host has no slash and a segment none, so the key is unambiguous
    base = base.withColumn("key", F.concat_ws("/", "host", F.concat_ws("/", "parts")))
    labelled = F.col("label").isNotNull().cast("long")
    blocked = F.coalesce((F.col("label") == "block").cast("long"), F.lit(0))
    leaf = base.groupBy("key", "host", "parts").agg(F.sum(labelled).alias("n"), F.sum(blocked).alias("b"))
    judged = written(tree(written(leaf, "url-templates"), prior_weight, z), "url-verdicts")
    out = base.join(judged, "key", "left")
    method = F.when(F.col("share") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("label", method).alias("verdict"), "template", "share"
    )


def op4_url_filter(spark, sf_dir):
    """The contract's columns, and the template that decided, for every page."""
    return filter_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


ORACLE = """
WITH RECURSIVE u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE
      WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$') THEN '{date}'
      WHEN regexp_matches(s, '^[0-9]+$') THEN '{n}'
      WHEN regexp_matches(s, '^[0-9]+\\.[a-z]+$') THEN '{n}' || regexp_extract(s, '(\\.[a-z]+)$', 1)
      WHEN regexp_matches(s, '^[0-9a-fA-F-]{16,}$') THEN '{hash}'
      WHEN regexp_matches(s, '[0-9]') OR length(s) > 24 THEN '{id}' ELSE s END) AS parts
  FROM h
), n AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN 1 ELSE 0 END AS l,
    CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 1 ELSE 0 END AS b FROM r
), leaf AS (
  SELECT host, parts, sum(l)::BIGINT AS n, sum(b)::BIGINT AS b FROM n GROUP BY ALL
), t AS (
  SELECT host, parts, n, b, '' AS node, '' AS label, '' AS template, s AS share, 0 AS level, tb > 0 AND tb < tn AS mixed
  FROM leaf, (SELECT sum(n) AS tn, sum(b) AS tb, sum(b)::DOUBLE / greatest(sum(n), 1) AS s FROM leaf)
  UNION ALL
  SELECT host, parts, n, b, node || '/' || g, label2, CASE WHEN keep THEN label2 ELSE template END,
    CASE WHEN keep THEN (gb + share * 4) / (gn + 4) ELSE share END, level + 1, coalesce(gb > 0 AND gb < gn, false)
  FROM (
    SELECT *, coalesce(abs(gb - gn * share) > 2.0::DOUBLE * sqrt(gn * share * (1 - share)), false) AS keep,
      label || CASE WHEN node = '' THEN '' ELSE '/' END || first || CASE WHEN k > 1 THEN '|+' || (k - 1) ELSE '' END AS label2
    FROM (
      SELECT *, CASE WHEN cn > 0 THEN (sum(n) OVER w)::BIGINT END AS gn, CASE WHEN cn > 0 THEN (sum(b) OVER w)::BIGINT END AS gb,
        min(child) OVER w AS first, count(DISTINCT child) OVER w AS k
      FROM (
        SELECT *, sum(cut) OVER (PARTITION BY node, cn > 0 ORDER BY sh, cn, child, host, parts ROWS UNBOUNDED PRECEDING) AS g
        FROM (
          SELECT *, CASE WHEN abs(sh - lag(sh) OVER v) > 2.0::DOUBLE * sqrt(pooled * (1 - pooled) * (1.0::DOUBLE / cn + 1.0::DOUBLE / lag(cn) OVER v)) THEN 1 ELSE 0 END AS cut
          FROM (
            SELECT *, (cb + lag(cb) OVER v)::DOUBLE / (cn + lag(cn) OVER v) AS pooled
            FROM (
              SELECT *, cb::DOUBLE / nullif(cn, 0) AS sh FROM (
                SELECT *, sum(n) OVER (PARTITION BY node, child) AS cn, sum(b) OVER (PARTITION BY node, child) AS cb
                FROM (SELECT *, CASE WHEN level = 0 THEN host ELSE parts[level] END AS child FROM t WHERE mixed)
                WHERE child IS NOT NULL
              )
            ) WINDOW v AS (PARTITION BY node, cn > 0 ORDER BY sh, cn, child, host, parts)
          ) WINDOW v AS (PARTITION BY node, cn > 0 ORDER BY sh, cn, child, host, parts)
        )
      ) WINDOW w AS (PARTITION BY node, cn > 0, g)
    )
  )
), d AS (
  SELECT host, parts, arg_max(share, level) AS share, arg_max(template, level) AS template FROM t GROUP BY ALL
)
SELECT page_id, n.host, path, rule,
  CASE WHEN rule IS NOT NULL THEN CASE WHEN n.b = 1 THEN 'block' ELSE 'allow' END
       WHEN share >= 0.5 THEN 'block' ELSE 'allow' END AS verdict, template
FROM n JOIN d ON n.host = d.host AND n.parts = d.parts
"""
