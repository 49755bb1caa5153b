"""Latest-version answers: reading, caching, lookup lists and update status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import versions as V
from .skew import lookup_join, staged

TTL_HOURS = 12
_LISTED = r"^[a-z0-9-]+\z"
_ANSWER = "struct<version:string,name:string,error:string,offers:array<struct<version:string>>>"
_NO_STATUS = "struct<status:string,latest:string,branch:string>"


def read_answers(raw: DataFrame) -> DataFrame:
    """(key, kind, name, status, text, error, capped, fetched_at) to the latest table."""
    j = F.from_json("text", _ANSWER)
    offers = F.array_distinct(F.filter(F.transform("_j.offers", lambda o: o["version"]), lambda v: F.coalesce(v.rlike(r"^\d+\.\d+(?:\.\d+)?\z"), F.lit(False))))
    is_json = F.col("text").rlike(r"(?s)^\s*\{.*\}\s*\z") & F.col("_j").isNotNull()
    core = F.col("kind") == "wp-core"
    df = raw.withColumn("_j", j).withColumn("_offers", F.when(core, offers))
    unlisted = (F.col("error").isNotNull() & F.coalesce(F.col("status") == 404, F.lit(False))) | (
        F.col("error").isNull() & is_json & ~core & F.col("_j.error").isNotNull()
    )
    unlisted = F.coalesce(unlisted, F.lit(False))
    has_version = F.col("_j.version").isNotNull()
    error = (
        F.when(unlisted, None).when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.coalesce(is_json, F.lit(False)), F.when(F.coalesce("capped", F.lit(False)), "Answer too large").otherwise("Not JSON"))
        .when(core & (F.coalesce(F.size("_offers"), F.lit(0)) < 1), "No offers").when(~core & ~F.coalesce(has_version, F.lit(False)), "No version")
    )
    df = df.withColumns({"_err": error, "_unlisted": unlisted})
    ok = F.col("_err").isNull() & ~F.col("_unlisted")
    return df.select(
        "key", "kind", "name", F.when(ok & ~core, F.col("_j.version")).alias("version"), F.when(ok & core, F.col("_offers")).alias("offers"),
        F.col("_unlisted").alias("unlisted"), F.when(ok & (F.col("kind") == "wp-theme"), F.col("_j.name")).alias("theme_name"),
        F.col("_err").alias("error"), "fetched_at",
    )


def split_cache(targets: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(fresh answers, targets to fetch): answers live twelve hours, errors never count."""
    live = cache.where(F.col("error").isNull() & (F.col("fetched_at") > now - F.expr(f"interval {TTL_HOURS} hours")))
    fresh = latest_answers(live).join(targets.select("key").distinct(), "key", "left_semi")
    return fresh, targets.join(live.select("key").distinct(), "key", "left_anti")


def latest_answers(answers: DataFrame) -> DataFrame:
    """Newest usable answer per key; also the upsert of a cache."""
    cols = [c for c in answers.columns if c != "key"]
    latest = F.max(F.struct("fetched_at", F.struct(*cols).alias("a"))).alias("m")  # ties by the answer itself
    best = answers.where(F.col("error").isNull()).groupBy("key").agg(latest).select("key", F.col("m.a").alias("a"))
    return best.select("key", *[F.col(f"a.{c}").alias(c) for c in cols])


def lookup_targets(tech: DataFrame, plugins: DataFrame, themes: DataFrame, max_plugins: int | None = None, max_themes: int | None = None) -> DataFrame:
    """(page_id, key, kind, name): core, plugins, themes and exact framework versions.

    Keys are distinct per page; ``max_plugins`` and ``max_themes`` limit the first rows of a page that are looked up.
    """
    row = lambda df, kind, name, key: df.select("page_id", key.alias("key"), F.lit(kind).alias("kind"), name.cast("string").alias("name"))
    nothing = F.lit(None)
    core = row(tech.where("tech = 'wordpress' and version is not null"), "wp-core", nothing, F.lit("wp-core"))
    npm = row(tech.where(F.col("npm").isNotNull() & V.is_exact(F.col("version"))), "npm", F.col("npm"), F.concat(F.lit("npm:"), "npm"))
    listed = plugins.where(F.col("wporg").rlike(_LISTED))
    if max_plugins is not None:
        w = W.partitionBy("page_id").orderBy("row_no")
        listed = listed.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_plugins)
    own = themes.where(F.col("wporg").rlike(_LISTED))
    own = own if max_themes is None else own.where(F.col("row_no") <= max_themes)
    plug = row(listed, "wp-plugin", F.col("wporg"), F.concat(F.lit("wp-plugin:"), "wporg"))
    theme = row(own, "wp-theme", F.col("wporg"), F.concat(F.lit("wp-theme:"), "wporg"))
    return core.unionByName(npm).unionByName(plug).unionByName(theme).distinct()


def with_latest(tech: DataFrame, plugins: DataFrame, themes: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add ``update`` to technologies, plugins and themes.

    All rows go through one lookup; popular keys (core above all) are hot, and the join salts them.
    """
    ans = latest_answers(answers).select("key", F.col("version").alias("a_version"), "offers", "unlisted", "theme_name")
    none = F.lit(None).cast(_NO_STATUS)
    status = lambda s, latest: F.struct(F.lit(s).alias("status"), latest.cast("string").alias("latest"), F.lit(None).cast("string").alias("branch"))
    key = F.when(F.col("tech") == "wordpress", "wp-core").when(V.is_exact(F.col("version")), F.concat(F.lit("npm:"), "npm"))
    asking = lambda df, tag, key: df.select(F.lit(tag).alias("tag"), key.alias("key"), F.struct(*df.columns).alias(tag))
    asked = asking(tech, "tech", key)
    for df, tag in ((plugins, "plugin"), (themes, "theme")):
        asked = asked.unionByName(asking(df, tag, F.concat(F.lit(f"wp-{tag}:"), "wporg")), allowMissingColumns=True)
    told = staged(lookup_join(staged(asked), ans, ["key"]))  # counted and joined: read twice
    answered = lambda tag: told.where(F.col("tag") == tag).select(f"{tag}.*", "a_version", "offers", "unlisted", "theme_name")
    update = (
        F.when((F.col("tech") == "wordpress") & F.col("version").isNotNull(), V.core_status(F.col("version"), F.col("offers")))
        .when(F.col("a_version").isNotNull(), V.latest_status(F.col("version"), F.col("a_version"))).otherwise(none)
    )
    drop = ["a_version", "offers", "unlisted", "theme_name"]
    squash = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")

    def cms(tag: str, columns: list[str]) -> DataFrame:
        foreign = F.lit(False)
        if "header_name" in columns:
            foreign = F.coalesce(squash(F.col("theme_name")) != squash(F.col("header_name")), F.lit(False))
        u = (
            F.when(F.col("wporg").isNull() | F.col("unlisted"), status("unlisted", F.lit(None)))
            .when(F.col("a_version").isNull(), none)
            .when(foreign, status("unlisted", F.lit(None)))
            .when(F.col("version").isNull(), status("unknown", F.col("a_version")))
            .otherwise(V.latest_status(F.col("version"), F.col("a_version")))
        )
        return answered(tag).withColumn("update", u).drop(*drop)

    return answered("tech").withColumn("update", update).drop(*drop), cms("plugin", plugins.columns), cms("theme", themes.columns)
