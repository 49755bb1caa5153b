"""robots.txt at crawl scale.

Files are parsed one row each. Rules are indexed by the literal prefix that all paths they cover share, and a page looks up
the prefixes of its own path, of the lengths that its origin's rules have: an equi join on (origin, prefix) brings the few
rules worth trying, so a file of ten thousand rules costs a page no more than one of ten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T, urls as U
from ..sources.tables import newest
from .skew import lookup_join, staged

DEFAULT_AGENT = "googlebot"
# Crawler agents of the access matrix.
CRAWLERS = ["googlebot", "bingbot", "gptbot", "claudebot", "perplexitybot"]


def robots_lines(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(origin, line_no, key, value, line) of every directive line."""
    body = F.col("body") if max_chars is None else F.left("body", F.lit(max_chars))
    field = r"(?s)^([A-Za-z-]+)\s*:\s*(.*)$"
    lines = files.select("origin", F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("line_no", "raw"))
    lines = lines.withColumn("line", T.strip(F.regexp_replace("raw", "#.*", ""))).where(F.col("line").rlike(field))
    return lines.select(
        "origin", "line_no", F.lower(F.regexp_extract("line", field, 1)).alias("key"),
        T.strip(F.regexp_extract("line", field, 2)).alias("value"), "line",
    )


def robots_rules(files: DataFrame) -> DataFrame:
    """(origin, group_no, agent, rule_no, type, path, line).

    A group starts at an agent line whose previous non-sitemap line is not one;
    rules before any agent belong to no group. Groups without rules keep one row
    with a NULL rule, because naming an agent is enough to choose its group.
    """
    w = W.partitionBy("origin").orderBy("line_no")
    lines = robots_lines(files).where(F.col("key") != "sitemap")
    is_agent = F.col("key") == "user-agent"
    starts = is_agent & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    lines = lines.withColumn("_start", starts.cast("int"))
    lines = lines.withColumn("group_no", F.sum("_start").over(w)).where("group_no > 0")
    agents = lines.where(is_agent).select("origin", "group_no", F.lower("value").alias("agent")).distinct()
    rules = lines.where(F.col("key").isin("allow", "disallow")).select(
        "origin", "group_no", F.col("line_no").alias("rule_no"), F.col("key").alias("type"), F.col("value").alias("path"), "line"
    )
    return agents.join(rules, ["origin", "group_no"], "left").select(
        "origin", "group_no", "agent", "rule_no", "type", "path", "line"
    )


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """(origin, line_no, sitemap) wherever they stand in the file (R2)."""
    s = robots_lines(files).where((F.col("key") == "sitemap") & (F.col("value") != ""))
    return s.select("origin", "line_no", F.col("value").alias("sitemap"))


def _encoded(pattern: Column) -> Column:
    """Rule path with non-ASCII characters percent-encoded, as URL paths are."""
    runs = F.regexp_extract_all(pattern, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]+"), F.lit(0))
    coded = F.transform(runs, lambda r: F.when(r.rlike(r"^[\x00-\x7F]"), r).otherwise(F.url_encode(r)))
    return F.when(pattern.rlike(r"[^\x00-\x7F]"), F.array_join(coded, "")).otherwise(pattern)


def rule_regex(pattern: Column) -> Column:
    """Regex of a rule path: * is any run, a final $ anchors, the rest is literal."""

    def build(p: Column) -> Column:
        anchored = F.endswith(p, F.lit("$"))
        body = F.when(anchored, F.regexp_replace(p, r"\$\z", "")).otherwise(p)
        escaped = F.regexp_replace(body, r"[.+?^${}()|\[\]\\]", r"\\$0")
        return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.when(anchored, r"\z").otherwise(""))

    return T.let(_encoded(pattern), build)


def rule_prefix(pattern: Column) -> Column:
    """Literal start every covered path shares: the cheap test before the regex."""
    return F.regexp_extract(_encoded(pattern), r"^[^*$]*", 0)


def matches_rule(pattern: Column, path: Column) -> Column:
    """Whether a rule path covers a URL path with query."""
    return F.regexp_like(path, rule_regex(pattern))


def agent_rules(rules: DataFrame, agents: list[str]) -> DataFrame:
    """(origin, agent, group, rule_no, type, path, line): the rules that hold for each agent.

    All groups that name the agent merge; only an agent nobody names falls back to ``*``. A group without rules keeps one
    row without a path.
    """
    names = sorted({a.lower() for a in agents})
    specific = rules.where(F.col("agent").isin(names)).withColumn("group", F.col("agent"))
    stars = rules.where("agent = '*'").withColumn("group", F.lit("*")).withColumn("agent", F.explode(F.array(*map(F.lit, names))))
    stars = stars.join(specific.select("origin", "agent").distinct(), ["origin", "agent"], "left_anti")
    return specific.unionByName(stars).select("origin", "agent", "group", "rule_no", "type", "path", "line")


def rule_index(rules: DataFrame) -> DataFrame:
    """(origin, prefix, rules): the rules of :func:`agent_rules` that share a literal prefix, best first; empty paths say nothing.

    The longest path is best, then Allow, then the first in the file.
    """
    rule = F.struct(
        (-F.length("path")).alias("rank"), (F.col("type") != "allow").alias("block"), F.col("rule_no").alias("no"), "line", "agent", rule_regex(F.col("path")).alias("regex"),
    )
    usable = rules.where("path is not null and path <> ''")
    return usable.groupBy("origin", rule_prefix(F.col("path")).alias("prefix")).agg(F.array_sort(F.collect_list(rule)).alias("rules"))


def check_urls(pages: DataFrame, files: DataFrame, agents: list[str] = (DEFAULT_AGENT,)) -> DataFrame:
    """robots.txt verdict per page and agent.

    The longest matching path wins and Allow wins ties; ``/robots.txt`` is always
    allowed. A status of 500 or more blocks, any other failure status allows, and
    a missing file or a network error leaves ``allowed`` NULL (unknown).
    """
    names = sorted({x.lower() for x in agents})
    files = newest(files, "origin")
    rules = staged(agent_rules(robots_rules(files.where(_ok())), names))
    lengths = F.array_sort(F.collect_set(F.when(F.col("path") != "", F.length(rule_prefix(F.col("path"))))))
    groups = rules.groupBy("origin").agg(F.collect_set(F.struct("agent", "group")).alias("groups"), lengths.alias("lengths"))
    status = files.select("origin", F.col("status").alias("robots_status"), F.col("error").alias("robots_error")).join(groups, "origin", "left")
    urls = pages.select("page_id", "url", U.origin_of(F.col("url")).alias("origin"), U.path_and_query(F.col("url")).alias("path"))
    known = lookup_join(urls, status, ["origin"])
    own = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.left("path", n))
    looked = staged(known.select("page_id", "url", "origin", "path", "robots_status", "robots_error", "groups", F.explode_outer(own).alias("prefix")))
    met = lookup_join(looked, rule_index(rules), ["origin", "prefix"])
    # One pass over the few candidates for each agent; an aggregate takes the best of a page's prefixes.
    first = lambda agent: F.get(F.filter("rules", lambda r: (r["agent"] == agent) & F.regexp_like(F.col("path"), r["regex"])), F.lit(0))
    met = met.withColumn("found", F.array(*[first(a) for a in names]))
    best = [F.min(F.get("found", F.lit(i))).alias(f"best{i}") for i in range(len(names))]
    one = met.groupBy("page_id", "url").agg(*[F.first(c).alias(c) for c in ("path", "robots_status", "robots_error", "groups")], *best)
    agent = F.explode(F.array(*[F.struct(F.lit(a).alias("agent"), F.col(f"best{i}").alias("best")) for i, a in enumerate(names)]))
    df = one.select("page_id", "path", "robots_status", "robots_error", "groups", agent.alias("a")).select("*", "a.*")
    group = F.get(F.filter("groups", lambda g: g["agent"] == F.col("agent")), F.lit(0))["group"]
    is_file = F.regexp_replace("path", r"\?.*", "") == "/robots.txt"
    ok = (F.col("robots_status") >= 200) & (F.col("robots_status") < 300)
    return df.select(
        "page_id", "agent", "robots_status",
        F.when(F.col("robots_error").isNotNull() | F.col("robots_status").isNull(), F.lit(None).cast("boolean"))
        .when(F.col("robots_status") >= 500, False)
        .when(~ok | is_file | F.col("best").isNull(), True)
        .otherwise(~F.col("best.block")).alias("allowed"),
        F.coalesce(F.col("robots_status") >= 500, F.lit(False)).alias("server_error"),
        F.when(ok & ~is_file, F.col("best.line")).alias("rule"),
        F.when(ok & ~is_file, group).alias("group"),
    )


def _ok() -> Column:
    return (F.col("status") >= 200) & (F.col("status") < 300) & F.col("error").isNull()
