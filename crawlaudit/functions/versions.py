"""Version scalars (V1-V7): an order-preserving key replaces a comparator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, strip

_VERSION = r"^v?(\d+(?:\.\d+){0,3})(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\z"
_ID = "struct<kind:int,num:decimal(38,0),txt:string>"
_KEY = f"struct<nums:array<decimal(38,0)>,release:int,pre:array<{_ID}>>"


def parse_version(v: Column) -> Column:
    """struct(nums, pre) or NULL when it is not a version (V1)."""
    num = lambda x: x.try_cast("decimal(38,0)")

    def parse(s: Column) -> Column:
        pre = F.regexp_extract(s, _VERSION, 2)
        return F.when(
            s.rlike(_VERSION),
            F.struct(
                F.transform(F.split(F.regexp_extract(s, _VERSION, 1), r"\."), num).alias("nums"),
                F.when(pre != "", F.split(pre, r"\.")).otherwise(F.array().cast("array<string>")).alias("pre"),
            ),
        )

    return let(strip(v), parse)


def clean_version(v: Column) -> Column:
    """Version as shown: no leading v, no build metadata (V2)."""
    shown = lambda s: F.when(s.rlike(_VERSION), F.regexp_replace(s, r"^v|\+.*$", "")).otherwise(s)
    return let(strip(F.coalesce(v, F.lit(""))), shown)


def is_version(v: Column) -> Column:
    return F.coalesce(strip(v).rlike(_VERSION), F.lit(False))


def is_exact(v: Column) -> Column:
    """At least three numbers (V2)."""
    return F.coalesce(F.size(parse_version(v)["nums"]) >= 3, F.lit(False))


def is_prerelease(v: Column) -> Column:
    return F.coalesce(F.size(parse_version(v)["pre"]) > 0, F.lit(False))


def version_key(v: Column) -> Column:
    """Sortable key (V3): four padded numbers, prerelease before release, then
    prerelease identifiers, numeric before text and shorter before longer.

    Native ``<``, ``max`` and ``ORDER BY`` follow version order on it.
    """

    def ident(p: Column) -> Column:
        n = p.rlike(r"^\d+\z")
        return F.struct(
            F.when(n, 0).otherwise(1).alias("kind"),
            F.when(n, p.try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("num"),
            F.when(n, "").otherwise(p).alias("txt"),
        )

    def key(p: Column) -> Column:
        zeros = F.array_repeat(F.lit(0).cast("decimal(38,0)"), 4)
        return F.when(
            p.isNotNull(),
            F.struct(
                F.slice(F.concat(p["nums"], zeros), 1, 4).alias("nums"),
                F.when(F.size(p["pre"]) > 0, 0).otherwise(1).alias("release"),
                F.transform(p["pre"], ident).alias("pre"),
            ).cast(_KEY),
        )

    return let(parse_version(v), key)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; unparsable versions compare equal (V3)."""
    pair = F.struct(version_key(a).alias("a"), version_key(b).alias("b"))
    return let(pair, lambda p: F.when(p["a"] < p["b"], -1).when(p["a"] > p["b"], 1).otherwise(0))


def branch_of(v: Column) -> Column:
    """First two numbers, '' when unparsable (V4)."""
    nums = lambda p: F.array_join(F.transform(F.slice(p["nums"], 1, 2), lambda n: n.cast("string")), ".")
    return F.coalesce(let(parse_version(v), nums), F.lit(""))


def newest(versions: Column) -> Column:
    """First newest version of an array (V4)."""
    keyed = lambda v, i: F.struct(version_key(v).alias("k"), (-i).alias("i"), v.alias("v"))
    return F.array_max(F.transform(F.filter(versions, is_version), keyed))["v"]


_STATUS = "struct<status:string,latest:string,branch:string>"


def _status(status: str, latest: Column, branch: Column | None = None) -> Column:
    branch = F.lit(None) if branch is None else branch
    return F.struct(F.lit(status).alias("status"), latest.alias("latest"), branch.alias("branch")).cast(_STATUS)


def core_status(version: Column, offers: Column) -> Column:
    """Core release against its offers: latest, patched, update, unsupported (V6)."""
    listed = F.filter(offers, is_version)

    def decide(x: Column) -> Column:
        k = version_key(version)
        return (
            F.when(~is_version(version) | x["latest"].isNull(), F.lit(None).cast(_STATUS))
            .when(k >= version_key(x["latest"]), _status("latest", x["latest"]))
            .when(x["top"].isNull(), _status("unsupported", x["latest"]))
            .when(k >= version_key(x["top"]), _status("patched", x["latest"], x["top"]))
            .otherwise(_status("update", x["latest"], x["top"]))
        )

    tops = F.struct(
        newest(listed).alias("latest"),
        newest(F.filter(listed, lambda v: branch_of(v) == branch_of(version))).alias("top"),
    )
    return let(tops, decide)


def latest_status(version: Column, latest: Column) -> Column:
    """Anything else against its latest release: behind, prerelease, latest (V7)."""

    def decide(c: Column) -> Column:
        return (
            F.when(~is_version(version) | ~is_version(latest), F.lit(None).cast(_STATUS))
            .when(c < 0, _status("behind", latest))
            .when((c > 0) & is_prerelease(version), _status("prerelease", latest))
            .otherwise(_status("latest", latest))
        )

    return let(compare_versions(version, latest), decide)
