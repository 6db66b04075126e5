"""URL filter: fixed rules first, then a path-template tree per host.

Path segments that look variable (a digit, or very long) become wildcards at once, so pages reduce to
few masked paths per host. The tree is then built level by level: under a node, a segment keeps a
branch of its own if enough pages take it and the share of bad pages among its labelled ones differs
significantly from that of the node; the others are rare or statistically alike, and merge into one
wildcard branch. The path of branches is a page's template, which is rejected if its share of bad
pages, smoothed by a prior, is too high.

The tree covers whole paths. Below the first levels only nodes are followed in which a branch can still
be told apart; the wildcards at the end of a template, below those levels, are written as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

# The rules (verdict, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Levels that are written out; below them, wildcards at the end of a template are one.
DEPTH = 4
#: A segment of more characters is variable.
LONG = 40
#: Pages, and labelled pages, that a branch of its own needs.
SUPPORT = LABELLED = 5
#: Squared standard errors by which a branch must differ from its node.
DIFFERS = 4.0
#: Bad and good pages that every template is given beforehand, and the share from which it is bad.
PRIOR_BAD, PRIOR_GOOD, BAD = 1, 4, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(tail, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(tail, F.length(host) + 1), "^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def masked_segments(path: Column) -> Column:
    """The segments below the first slash, variable ones as ``*`` with their extension."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(segments, lambda s: F.when(
        F.regexp_like(s, F.lit("[0-9]")) | (F.length(s) > LONG),
        F.concat(F.lit("*"), F.regexp_extract(s, "\\.[A-Za-z]{1,5}$", 0))).otherwise(s))


def _chosen(out: DataFrame, keys: list[str], d: int) -> DataFrame:
    """The rows of level ``d``, whose segment is s<d>, with their branch t<d>."""
    taken = out.groupBy(*keys, f"s{d}").agg(*(F.sum(c).alias(c) for c in ("pages", "labelled", "bad")))
    # Nulls (shorter paths) are an end, not a branch, but they count in the node.
    node = taken.groupBy(*keys).agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    lab, bad, all_lab, all_bad = (F.col(c).cast("double") for c in ("labelled", "bad", "all_labelled", "all_bad"))
    gap = bad * all_lab - all_bad * lab
    own = (F.col("pages") >= SUPPORT) & (F.col("labelled") >= LABELLED) & (
        gap * gap > DIFFERS * all_bad * (all_lab - all_bad) * lab)
    branch = F.when(F.col(f"s{d}").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("/"), F.when(own, F.col(f"s{d}")).otherwise(F.lit("*"))))
    chosen = taken.join(node, keys).select(
        *(F.col(k).alias(f"__{k}") for k in keys), F.col(f"s{d}").alias("__s"), branch.alias(f"t{d}"))
    same = F.col(f"s{d}").eqNullSafe(F.col("__s"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return out.join(chosen, same).drop("__s", *(f"__{k}" for k in keys))


def templates(paths: DataFrame) -> DataFrame:
    """host, masked, template for aggregated rows (host, masked, pages, labelled, bad)."""
    parts = F.split("masked", "/")
    keys = ["host"]
    out = paths
    for d in range(DEPTH):
        # Each level reads the last one several times, so its few rows are written once.
        out = stored(out.withColumn(f"s{d}", F.get(parts, d)), f"paths-{d}")
        out = _chosen(out, keys, d)
        keys = [*keys, f"t{d}"]
    columns = ["host", "masked", "pages", "labelled", "bad"]
    out = out.select(*columns, F.concat(*keys[1:]).alias("top"), F.lit("").alias("below"))
    node, done, d = ["host", "top", "below"], None, DEPTH
    while True:
        # A node without both kinds of labelled pages, or too few, has no branch of its own at any depth.
        out = stored(out, f"paths-{d}")
        longer = out.groupBy(*node).agg(
            F.sum("labelled").alias("n"), F.sum("bad").alias("m"), F.max(F.size(parts)).alias("deepest")).where(
                (F.col("n") >= LABELLED) & (F.col("m") > 0) & (F.col("m") < F.col("n")) & (F.col("deepest") > d))
        open_nodes = stored(longer.select(*node), "open-nodes")
        more = open_nodes.limit(1).count() > 0
        closed = out.join(open_nodes, node, "left_anti") if more else out
        done = closed if done is None else done.unionByName(closed)
        if not more:
            break
        out = _chosen(out.join(open_nodes, node, "left_semi").withColumn(f"s{d}", F.get(parts, d)), node, d)
        # Where the path goes on, levels without a branch of their own are wildcards until one follows.
        out = out.select(*columns, "top", F.concat("below", f"t{d}").alias("below"))
        d += 1
    # Wildcards at the end are one; a path that was left while it went on ends in it too.
    ended = F.regexp_replace("below", "(/\\*)+$", "")
    levels = F.size(F.split("below", "/")) - 1
    open_end = (F.size(parts) - DEPTH > levels) | (ended != F.col("below"))
    return done.select(*columns, F.concat("top", ended, F.when(open_end, F.lit("/**")).otherwise(F.lit(""))).alias("template"))


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, template, purity (smoothed share of bad pages); one row per row.

    ``labels`` has (page's key as ``page_key``, bad). Null urls and such without ``://`` have an empty
    host and path and are judged by the template of those. Repeated rows count each; a page with
    several labels is bad if one is. Without labels every template is allowed. An empty frame gives
    an empty frame. Other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(key, host.alias("host"), path.alias("path"))
    segments = masked_segments(F.col("path"))
    rows = rows.withColumn("masked", F.array_join(segments, "/"))
    known = labels.groupBy("page_key").agg(F.max("bad").alias("bad"))
    counted = rows.join(known, rows[key] == known.page_key, "left").groupBy("host", "masked").agg(
        F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    found = stored(templates(counted), "templates")
    purity = (F.sum("bad") + PRIOR_BAD) / (F.sum("labelled") + PRIOR_BAD + PRIOR_GOOD)
    judged = found.groupBy("host", "template").agg(purity.alias("purity"))
    by_path = found.select("host", "masked", "template").join(judged, ["host", "template"])
    rule = rule_of(F.col("host"), F.col("path"))
    own = F.when(F.col("purity") >= BAD, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(by_path, ["host", "masked"]).withColumn("__rule", rule).select(
        key, "host", "path", F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), own).alias("verdict"), "template", "purity")


def article_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_key, bad: labels of the document that a page shows, named by the last number in its path."""
    _, path = host_and_path(F.col("url"))
    number = F.regexp_extract(path, "([0-9]{1,18})[^0-9]*$", 1)
    shown = pages.withColumn("__n", number).select(
        F.col("page_id").alias("page_key"), F.expr("try_cast(__n AS bigint)").alias("doc_id"))
    bad = F.greatest(1 - F.coalesce("quality", F.lit(1)), F.coalesce("toxic", F.lit(0)))
    return shown.join(labels.select("doc_id", bad.cast("long").alias("bad")), "doc_id").select("page_key", "bad")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, article_labels(pages, table(spark, sf_dir, "labels")))


def _sql() -> str:
    lowered = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    levels, keys = [], ["host"]
    for d in range(DEPTH):
        before, on = ", ".join(keys), " AND ".join(f"o.{k} = c.{k}" for k in keys)
        levels.append(f"""
taken{d} AS (SELECT {before}, s{d}, sum(pages) AS pages, sum(labelled)::DOUBLE AS labelled, sum(bad)::DOUBLE AS bad
  FROM level{d} GROUP BY ALL),
node{d} AS (SELECT {before}, sum(labelled) AS all_labelled, sum(bad) AS all_bad FROM taken{d} GROUP BY ALL),
chosen{d} AS (SELECT {before}, s{d}, CASE WHEN s{d} IS NULL THEN '' ELSE '/' || CASE
    WHEN pages >= {SUPPORT} AND labelled >= {LABELLED}
     AND (bad * all_labelled - all_bad * labelled) * (bad * all_labelled - all_bad * labelled)
         > {DIFFERS} * all_bad * (all_labelled - all_bad) * labelled THEN s{d} ELSE '*' END END AS t{d}
  FROM taken{d} JOIN node{d} USING ({before})),
level{d + 1} AS (SELECT o.*, c.t{d} FROM level{d} o JOIN chosen{d} c
  ON o.s{d} IS NOT DISTINCT FROM c.s{d} AND {on})""")
        keys.append(f"t{d}")
    fits = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        own, _, rest = rule.partition("/")
        fits.append((f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}')", rule, verdict))
    rules, verdicts = (" ".join(f"{f[0]} THEN '{f[i]}'" for f in fits) for i in (1, 2))
    cells = ", ".join(f"string_split(masked, '/')[{d + 1}] AS s{d}" for d in range(DEPTH))
    return f"""
WITH tails AS (SELECT row_number() OVER () AS r, page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
cut AS (SELECT r, page_id, regexp_extract(tail, '^[^/?#]*') AS raw, tail FROM tails),
split AS (SELECT r, page_id, {lowered.format('raw')} AS host,
    regexp_extract(substr(tail, length(raw) + 1), '^[^?#]*') AS path FROM cut),
urls AS (SELECT *, array_to_string(list_transform(string_split(regexp_replace(path, '^/', ''), '/'),
    lambda s: CASE WHEN regexp_matches(s, '[0-9]') OR length(s) > {LONG}
         THEN '*' || regexp_extract(s, '\\.[A-Za-z]{{1,5}}$') ELSE s END), '/') AS masked FROM split),
known AS (SELECT page_id AS page_key, max(greatest(1 - coalesce(quality, 1), coalesce(toxic, 0))) AS bad
  FROM urls JOIN labels ON labels.doc_id = try_cast(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT)
  GROUP BY 1),
counted AS (SELECT host, masked, count(*) AS pages, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad
  FROM urls LEFT JOIN known ON page_id = page_key GROUP BY ALL),
level0 AS (SELECT *, {cells}, len(string_split(masked, '/')) > {DEPTH} AS deeper FROM counted),
{','.join(levels)},
found AS (SELECT *, {' || '.join(keys[1:])} || CASE WHEN deeper THEN '/**' ELSE '' END AS template FROM level{DEPTH}),
judged AS (SELECT host, template,
    (sum(bad) + {PRIOR_BAD})::DOUBLE / (sum(labelled) + {PRIOR_BAD + PRIOR_GOOD})::DOUBLE AS purity FROM found GROUP BY ALL)
SELECT page_id, host, path, CASE {rules} END AS rule,
  CASE {verdicts} WHEN purity >= {BAD} THEN 'block' ELSE 'allow' END AS verdict, template, purity
FROM urls JOIN found USING (host, masked) JOIN judged USING (host, template)
"""


ORACLE = _sql()
