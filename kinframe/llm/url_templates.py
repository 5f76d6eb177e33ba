"""URL filter: fixed host/path rules, then a path-template tree judged by labelled purity.

Per host the paths form a tree of segments. Segments of a variable shape (numbers, hexadecimal ids) are
wildcards from the start, which leaves few distinct paths per host. Level by level, a child becomes part
of the wildcard branch ``*`` if its labelled share of bad pages does not differ significantly
(two-proportion test) from that of its siblings, however rare it is among them. What all paths of a branch
share is passed over in one step, so the rounds are as many as the branchings along a path, at any depth of
paths. The templates that remain
are judged by their share of bad pages, smoothed towards the host's share, which is smoothed towards the
share of all pages; bad shares above ``threshold`` are blocked.

Only (host, path) counts are grouped, with partial sums before each shuffle, so a host with a third of
all pages is no hot group; shaped paths of many pages (at most 500) are broadcast to them.

Defined cases: a null url or one without ``://`` has empty host and path and is judged like any other
host; empty segments (double or trailing slashes) don't count; repeated pages each get their row and count as often as they occur; repeated labels of
a page count once, as bad if any of them is; without labels nothing is blocked by the method; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.llm.common import stored

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))

#: A shaped path with more than this part (1 / 500) of all pages is joined by a broadcast.
HOT_PATHS = 500

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NUMBER = r"^[0-9]+(\.[A-Za-z]{2,5})?$"
_HEX = r"^[0-9A-Fa-f][0-9A-Fa-f-]{14,}[0-9A-Fa-f]$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    cut = F.locate("://", url)
    rest = F.when(cut > 0, F.substring(url, cut + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The text of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def _shapes(path: Column) -> Column:
    """Segments with variable shapes as wildcards."""
    return F.transform(F.array_remove(F.split(path, "/"), ""), lambda s: F.when(s.rlike(_NUMBER), "{n}")
                       .when(s.rlike(_HEX), "{x}").otherwise(s))


def _shared(tree: DataFrame) -> DataFrame:
    """``host, template, skip``: the number of segments that the rest of all paths of a branch begins with."""
    ends = tree.groupBy("host", "template").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    differ = F.array_position(F.zip_with(F.col("lo"), F.slice("hi", 1, F.greatest(F.size("lo"), F.lit(1))), lambda a, b: a.eqNullSafe(b)), False)
    return ends.select("host", "template", F.when(F.size("lo") == 0, 0).when(differ > 0, differ - 1).otherwise(F.size("lo")).cast("int").alias("skip"))


def _decided(tree: DataFrame, z: float) -> DataFrame:
    """``host, template, child, token``: what each child of each branch becomes."""
    child = tree.groupBy("host", "template", "child").agg(*[F.sum(c).alias(c) for c in ("labelled", "bad")])
    whole = child.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("children"), *[F.sum(c).alias(f"all_{c}") for c in ("labelled", "bad")])
    rest, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
    share = F.col("all_bad") / F.col("all_labelled")
    error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / rest))
    differs = F.coalesce((F.col("labelled") > 0) & (rest > 0) & (error > 0)
                         & (F.abs(F.col("bad") / F.col("labelled") - rest_bad / rest) > z * error), F.lit(False))
    token = (F.when(F.col("child").rlike(r"^(\{n\}|\{x\})$") | (F.col("children") == 1), F.col("child"))
             .when(~differs, "*").otherwise(F.col("child")))
    return child.join(whole, ["host", "template"]).select("host", "template", "child", token.alias("token"))


def path_templates(pages: DataFrame, labels: DataFrame, z: float = 2.58, strength: float = 10.0) -> DataFrame:
    """``host, shape, pages, template, labelled, bad, bad_share`` for every distinct (host, shaped path).

    ``pages``: ``page_id, host, path``; ``labels``: ``page_id, bad`` (0 or 1).
    """
    bad = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    shaped = pages.select("page_id", "host", _shapes(F.col("path")).alias("shape"))
    counted = shaped.join(bad, "page_id", "left").groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    open_rows = stored(counted.withColumn("template", F.lit("")).withColumn("rest", F.col("shape")), "paths")
    done = [open_rows.filter(F.size("rest") == 0)]
    open_rows = open_rows.filter(F.size("rest") > 0)
    step = lambda n: F.concat("template", F.when(n > 0, F.concat(F.lit("/"), F.array_join(F.slice("rest", 1, n), "/"))).otherwise(""))
    while not open_rows.isEmpty():
        # paths that end at a branch stay in it until its shared segments are known
        branch = open_rows.join(_shared(open_rows), ["host", "template"])
        skip = F.col("skip")
        here = branch.select("host", "shape", "pages", "labelled", "bad", step(skip).alias("template"),
                             F.slice("rest", skip + 1, F.greatest(F.size("rest") - skip, F.lit(0))).alias("rest"))
        here = stored(here.withColumn("child", F.get("rest", F.lit(0))), "branches")
        token = _decided(here.filter("child IS NOT NULL"), z)
        moved = here.filter("child IS NOT NULL").join(token, ["host", "template", "child"]).select(
            "host", "shape", "pages", "labelled", "bad", F.concat("template", F.lit("/"), "token").alias("template"),
            F.slice("rest", 2, F.size("rest")).alias("rest"))
        moved = stored(moved, "paths")
        done += [here.filter("child IS NULL").drop("child"), moved.filter(F.size("rest") == 0)]
        open_rows = moved.filter(F.size("rest") > 0)
    tree = reduce(DataFrame.unionByName, done).drop("rest")
    sums = [F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    all_labelled, all_bad = tree.agg(*sums).first()
    base = (all_bad or 0) / all_labelled if all_labelled else 0.0
    by_host = tree.groupBy("host").agg(*sums).select(
        "host", ((F.col("bad") + strength * base) / (F.col("labelled") + strength)).alias("host_share"))
    by_template = tree.groupBy("host", "template").agg(*sums).join(by_host, "host").withColumn(
        "bad_share", (F.col("bad") + strength * F.col("host_share")) / (F.col("labelled") + strength))
    return tree.select("host", "shape", "pages", "template").join(by_template.drop("host_share"), ["host", "template"])


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
          threshold: float = 0.5) -> DataFrame:
    """``id_col, host, path, rule, template, bad_share, verdict`` per page."""
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    templates = stored(path_templates(parsed, labels), "templates")
    verdicts = {h + p: v for v, h, p in rules}
    by_rule = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == rule, verdict).otherwise(by_rule)
    by_template = F.when(F.col("bad_share") > threshold, "block").otherwise("allow")
    total = templates.agg(F.sum("pages")).first()[0] or 0
    known = templates.select("host", "shape", "template", "bad_share")
    many = F.col("pages") * HOT_PATHS > total  # fewer than HOT_PATHS rows can have so large a part
    hot = F.broadcast(known.where(many))
    shaped = parsed.withColumn("shape", _shapes(F.col("path")))
    found = shaped.join(hot, ["host", "shape"]).unionByName(
        shaped.join(hot.select("host", "shape"), ["host", "shape"], "left_anti").join(known.where(~many), ["host", "shape"], "left"))
    return (found.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
            .select(F.col("page_id").alias(id_col), "host", "path", "rule", "template", "bad_share",
                    F.coalesce(by_rule, by_template).alias("verdict")))
