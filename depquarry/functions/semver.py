"""Semantic versions as column expressions: a sortable key, and what is read off it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUM = r"(?:0|[1-9][0-9]*)"
_PRE_ID = rf"(?:{_NUM}|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
#: ``vX``, ``vX.Y`` or ``vX.Y.Z[-pre][+build]``; numbers without leading zeros.
VALID = rf"^v({_NUM})(?:\.({_NUM})(?:\.({_NUM})(?:-({_PRE_ID}(?:\.{_PRE_ID})*))?(?:\+([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?)?)?$"


def _part(v: Column, group: int) -> Column:
    return F.regexp_extract(v, VALID, group)


def is_valid(v: Column) -> Column:
    return F.coalesce(v.rlike(VALID), F.lit(False))


def _number(text: Column) -> Column:
    """Digits of any length in order: by length, then as text; none reads as 0."""
    text = F.when(text == "", "0").otherwise(text)
    return F.struct(F.length(text).alias("l"), text.alias("t"))


def key(v: Column) -> Column:
    """A struct that orders as the versions do; null for what is no version. Build metadata doesn't order."""
    pre = F.transform(
        F.filter(F.split(_part(v, 4), r"\."), lambda x: x != ""),
        lambda x: F.struct(F.when(x.rlike("^[0-9]+$"), 0).otherwise(1).alias("k"), F.when(x.rlike("^[0-9]+$"), F.length(x)).otherwise(0).alias("l"), x.alias("t")),
    )
    k = F.struct(_number(_part(v, 1)).alias("major"), _number(_part(v, 2)).alias("minor"), _number(_part(v, 3)).alias("patch"), F.when(_part(v, 4) == "", 1).otherwise(0).alias("release"), pre.alias("pre"))
    return F.when(is_valid(v), k)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; an invalid version is below every valid one and equal to another."""
    ka, kb = key(a), key(b)
    return (
        F.when(ka.isNull() & kb.isNull(), 0).when(ka.isNull(), -1).when(kb.isNull(), 1)
        .when(ka < kb, -1).when(ka > kb, 1).otherwise(0)
    )


def major(v: Column) -> Column:
    return F.when(is_valid(v), F.concat(F.lit("v"), _part(v, 1)))


def prerelease(v: Column) -> Column:
    return F.when(is_valid(v) & (_part(v, 4) != ""), F.concat(F.lit("-"), _part(v, 4))).otherwise("")


def build(v: Column) -> Column:
    return F.when(is_valid(v) & (_part(v, 5) != ""), F.concat(F.lit("+"), _part(v, 5))).otherwise("")


def v_prefixed(v: Column) -> Column:
    """With a leading v, unless it has one or is empty."""
    return F.when((v == "") | v.startswith("v"), v).otherwise(F.concat(F.lit("v"), v))


def before_pruning(go_version: Column) -> Column:
    """Whether a manifest's language version is from before graph pruning (1.17); unknown ones count as before."""
    v = F.concat(F.lit("v"), go_version)
    return F.when(go_version.isNull() | ~is_valid(v), True).otherwise(key(v) < key(F.lit("v1.17")))


def compare_pin(pinned: Column, latest: Column) -> Column:
    """level, behind or ahead; two unequal strings of which one is no version: behind."""
    c = compare(pinned, latest)
    return F.when(pinned == latest, "level").when(~is_valid(pinned) | ~is_valid(latest), "behind").when(c < 0, "behind").when(c > 0, "ahead").otherwise("level")


def can_sort_above_tag(v: Column) -> Column:
    """Whether a pin may stand above the newest tag: a prerelease, +incompatible, or unreadable; never an empty one."""
    p = v_prefixed(v)
    return F.when(v == "", False).when(~is_valid(p), True).otherwise((prerelease(p) != "") | (build(p) == "+incompatible"))


def affected_text(introduced: Column, fixed: Column) -> Column:
    """``>= a, < b``; a bound that is empty or null is left out."""
    return F.concat_ws(", ", F.when(introduced != "", F.concat(F.lit(">= "), introduced)), F.when(fixed != "", F.concat(F.lit("< "), fixed)))
