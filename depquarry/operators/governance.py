"""Governance of projects: directives, debug settings, vendored trees and FIPS findings held against policies."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depquarry.functions import classify

#: Outcomes from the mildest to the one that blocks.
OUTCOMES = ("allow", "notify", "warn")

# The categories of each area.
CATEGORIES = {
    "directive": ("local_path_replace", "module_path_replace", "version_replace", "exclude_newer", "exclude_older"),
    "godebug": ("red", "amber", "green"),
    "vendor": ("drift", "inconsistency"),
    "fips": ("compliant", "deviation", "unknown"),
}
AREAS = tuple(CATEGORIES)

Policies = Mapping[str, Mapping[str, str]]


def checked(policies: Policies) -> Policies:
    """``policies`` (area: category: outcome); areas, categories and outcomes that nothing knows are refused."""
    for area, of in policies.items():
        if area not in CATEGORIES:
            raise ValueError(f"no area {area!r}; areas are {', '.join(AREAS)}")
        for name, outcome in of.items():
            if name not in (*CATEGORIES[area], "default", "required"):
                raise ValueError(f"no category {area}.{name}")
            if name != "required" and outcome not in OUTCOMES:
                raise ValueError(f"{area}.{name}: {outcome!r} is none of {', '.join(OUTCOMES)}")
    return policies


def _outcomes(area: str, policy: Mapping[str, str]) -> tuple[dict[str, str], str]:
    """The outcome of each category of an area and that of all others, which is never milder than what is known."""
    stated = {c: policy.get(c) for c in CATEGORIES[area]}
    if area == "fips":
        if not policy.get("required"):
            return dict.fromkeys(stated, "allow"), "allow"
        return {"compliant": "allow", "deviation": policy.get("deviation", "warn"), "unknown": "warn"}, "warn"
    missing = policy.get("default", "allow") if area == "directive" else "allow"
    known = {c: o or missing for c, o in stated.items()}
    if area == "directive":
        return known, missing
    if area == "godebug":
        return known, policy.get("red", "warn")
    return known, max((o or "warn" for o in stated.values()), key=OUTCOMES.index)


def outcome(area: Column, category: Column, policies: Policies) -> Column:
    """allow, notify or warn for a finding; a category that its area doesn't name has the area's fallback, a null one too."""
    checked(policies)
    out = F.lit(None).cast("string")
    for name in AREAS:
        known, other = _outcomes(name, policies.get(name, {}))
        table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        out = F.when(area == name, F.coalesce(F.try_element_at(table, category), F.lit(other))).otherwise(out)
    return out


def directive_category(kind: Column, is_local: Column, new_path: Column, old_path: Column, old_version: Column, resolved: Column) -> Column:
    """What a replacement or exclusion does; an exclusion that can't be compared counts as of a newer version, other kinds have none."""
    replace = F.when(is_local, "local_path_replace").when((new_path != "") & (new_path != old_path), "module_path_replace").otherwise("version_replace")
    older = classify.directive_risk(kind, is_local, new_path, old_path, old_version, resolved) == "low"
    return F.when(kind == "replace", replace).when(kind == "exclude", F.when(older, "exclude_older").otherwise("exclude_newer"))


def judged(findings: DataFrame, policies: Policies) -> DataFrame:
    """``findings`` (area, category, any others) with ``outcome`` and ``blocking``."""
    o = outcome(F.col("area"), F.col("category"), policies)
    return findings.withColumn("outcome", o).withColumn("blocking", F.coalesce(F.col("outcome") == OUTCOMES[-1], F.lit(False)))


def report(projects: DataFrame, measured: DataFrame, findings: DataFrame, keys: list[str], policies: Policies) -> DataFrame:
    """A row for each project (``keys``): for each area struct(status, findings, notify, blocking), then ``blocking`` over all and ``passes``.

    An area is ``not_measured`` unless ``measured`` (keys, area) or a finding of the project names it: a project
    without a vendored tree hasn't a clean one. ``passes`` is null where an area isn't measured and nothing blocks.
    Findings of projects that ``projects`` doesn't name are left out. Repeated projects count once, repeated
    findings as often as they stand there.
    """
    f = judged(findings.select(*keys, "area", "category"), policies)
    seen = measured.select(*keys, "area").distinct()
    rows = f.select(*keys, "area", F.lit(1).alias("n"), F.when(F.col("outcome") == "notify", 1).otherwise(0).alias("m"), F.col("blocking").cast("int").alias("b"))
    rows = rows.unionByName(seen.select(*keys, "area", *[F.lit(0).alias(c) for c in ("n", "m", "b")]))
    of = lambda area, c: F.sum(F.when(F.col("area") == area, F.col(c)))
    sums = rows.groupBy(*keys).agg(*[of(a, c).alias(f"_{a}_{c}") for a in AREAS for c in "nmb"])
    x = projects.select(*keys).distinct().join(sums, keys, "left")
    some = lambda a, c: F.coalesce(F.col(f"_{a}_{c}"), F.lit(0)).cast("long")

    def section(a: str) -> Column:
        status = F.when(F.col(f"_{a}_n").isNull(), "not_measured").when(F.col(f"_{a}_n") > 0, "findings").otherwise("clean")
        return F.struct(status.alias("status"), some(a, "n").alias("findings"), some(a, "m").alias("notify"), some(a, "b").alias("blocking")).alias(a)

    blocking, whole = sum((some(a, "b") for a in AREAS), F.lit(0)).cast("long"), F.lit(True)
    for a in AREAS:
        whole = whole & F.col(f"_{a}_n").isNotNull()
    return x.select(*keys, *[section(a) for a in AREAS], blocking.alias("blocking"), F.when(blocking > 0, False).when(whole, True).alias("passes"))
