"""String functions over module paths, coordinates, symbols and licence texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A timestamp and a commit prefix at a version's end mark a pseudo-version.
PSEUDO = r"^v[0-9]+\.(?:0\.0-|[0-9]+\.[0-9]+-(?:[^+]*\.)?0\.)[0-9]{14}-[A-Za-z0-9]+(?:\+[0-9A-Za-z-.]+)?$"


def coordinate(path: Column, version: Column) -> Column:
    return F.concat(path, F.lit("@"), version)


def coordinate_path(text: Column) -> Column:
    """What stands before the last @; null without one."""
    return F.when(F.instr(text, "@") > 0, F.regexp_extract(text, "^(.*)@[^@]*$", 1))


def coordinate_version(text: Column) -> Column:
    return F.when(F.instr(text, "@") > 0, F.regexp_extract(text, "@([^@]*)$", 1))


def is_pseudo(version: Column) -> Column:
    return F.coalesce(version.rlike(PSEUDO), F.lit(False))


def commit_prefix(version: Column) -> Column:
    """The commit of a pseudo-version, else empty."""
    return F.when(is_pseudo(version), F.regexp_extract(version, r"-([A-Za-z0-9]+)(?:\+[^+]*)?$", 1)).otherwise("")


def family(path: Column) -> Column:
    """struct(stem, separator, major): the major of a ``/vN`` path, or of ``.vN`` under gopkg.in; 0 without one."""
    slash = F.regexp_extract(path, r"^(.*)/v([0-9]+)$", 2)
    dotted = F.when(path.startswith("gopkg.in/"), F.regexp_extract(path, r"^(.*)\.v([0-9]+)$", 2)).otherwise("")
    big = lambda d: F.coalesce(d.try_cast("int") >= 2, F.lit(False))
    stem = F.when(big(slash), F.regexp_extract(path, r"^(.*)/v[0-9]+$", 1)).when(big(dotted), F.regexp_extract(path, r"^(.*)\.v[0-9]+$", 1)).otherwise(path)
    major = F.when(big(slash), slash.try_cast("int")).when(big(dotted), dotted.try_cast("int")).otherwise(0)
    sep = F.when(~big(slash) & path.startswith("gopkg.in/"), ".v").otherwise("/v")
    return F.struct(stem.alias("stem"), sep.alias("separator"), major.alias("major"))


def path_for_major(fam: Column, n: Column) -> Column:
    return F.when(n < 2, fam.stem).otherwise(F.concat(fam.stem, fam.separator, n.cast("string")))


def strip_major(path: Column) -> Column:
    return F.regexp_replace(path, r"/v[0-9]+$", "")


def is_major_pair(a: Column, b: Column) -> Column:
    """Two unequal paths that differ by their major suffix alone."""
    return (a != b) & (strip_major(a) == strip_major(b))


def relative_package(package: Column, module: Column) -> Column:
    """A package's path inside its module; the module's own is empty, another's stays."""
    return F.when(package == module, "").when(package.startswith(F.concat(module, F.lit("/"))), F.substring(package, F.length(module) + 2, F.length(package))).otherwise(package)


def method_name(symbol: Column) -> Column:
    """What stands after a symbol's last dot."""
    return F.substring_index(symbol, ".", -1)


def bare_signature(signature: Column) -> Column:
    """A declaration without the line comments that lead it and the white space around; block comments stay."""
    return F.regexp_replace(F.regexp_replace(signature, r"^(?:[^\S\n]*//[^\n]*(?:\n|\z))+", ""), r"^\s+|\s+\z", "")


def has_segment(path: Column, *names: str) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def is_importable(package: Column) -> Column:
    return ~has_segment(package, "internal", "testdata")


def is_unbuilt(path: Column) -> Column:
    """Whether a segment is ``testdata`` or starts with _ or . (but the current folder's)."""
    return F.exists(F.split(path, "/"), lambda s: (s == "testdata") | s.startswith("_") | (s.startswith(".") & (s != ".")))


def package_url(path: Column, version: Column) -> Column:
    """``pkg:golang/path@version`` with every segment encoded."""
    parts = F.array_join(F.transform(F.split(path, "/"), F.url_encode), "/")
    return F.concat(F.lit("pkg:golang/"), parts, F.when(version != "", F.concat(F.lit("@"), F.url_encode(version))).otherwise(""))


def canonical_hash(row: Column) -> Column:
    """``sha256:`` and the digest of a struct's JSON text; its fields in the order given."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256))


def age_days(then: Column, now: Column) -> Column:
    """Whole days between two times; a later one has the age 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400)).cast("long")


def is_fresh(looked_up: Column, now: Column, ttl_seconds: int) -> Column:
    """Looked up less than a positive ttl ago, to the microsecond."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.coalesce(F.lit(ttl_seconds > 0) & (micros(now) - micros(looked_up) < round(ttl_seconds * 1_000_000)), F.lit(False))


# How licence texts name copyright and ways to contribute.
COPYRIGHT_LINE = r"(?i)^\s*(?:[#*/;]+\s*)?copyright\s+(?:\(c\)|©)?\s*(.*)$"
YEARS = r"((?:19|20)[0-9]{2}(?:\s*[-–,]\s*(?:(?:19|20)[0-9]{2}|present))*)"
SIGNALS = {
    "cla": r"(?i)contributor licen[cs]e agreement|\bCLA\b",
    "dco": r"(?i)developer certificate of origin|signed-off-by|\bDCO\b",
    "inbound_outbound": r"(?i)licensed under the same (?:terms|licen[cs]e)|inbound\s*=\s*outbound",
}


def copyright_lines(text: Column) -> Column:
    """array<struct<verbatim, years, holder>> of the lines that state a copyright with a year or a holder."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(COPYRIGHT_LINE))

    def read(x: Column) -> Column:
        rest = F.regexp_extract(x, COPYRIGHT_LINE, 1)
        years = F.regexp_extract(rest, YEARS, 1)
        holder = F.trim(F.regexp_replace(F.regexp_replace(rest, YEARS, ""), r"(?i)all rights reserved\.?|^[\s,.]+|[\s,.]+$", ""))
        return F.struct(F.trim(x).alias("verbatim"), years.alias("years"), holder.alias("holder"))

    return F.filter(F.transform(lines, read), lambda c: (c.years != "") | (c.holder != ""))


def contribution_signals(text: Column) -> Column:
    """The kinds of contribution terms that a text names, sorted."""
    return F.array_sort(F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SIGNALS.items()]), lambda x: x.isNotNull()))


def signal_confidence(signals: Column) -> Column:
    return F.when(F.size(signals) == 0, "none").when(F.array_contains(signals, "cla") | F.array_contains(signals, "dco"), "high").otherwise("medium")


def route_summary(names: Column, arrow: str = " -> ") -> Column:
    """A route in words: whole up to six names, else the first five, how many are left out, and the last."""
    n = F.size(names)
    long = F.concat_ws(arrow, F.slice(names, 1, 5), F.concat(F.lit("… ("), (n - 6).cast("string"), F.lit(" more)")), F.element_at(names, -1))
    return F.when(n == 0, "").when(n <= 6, F.array_join(names, arrow)).otherwise(long)


def spdx_header(source: Column) -> Column:
    """The first identifier that an ``SPDX-License-Identifier:`` line states, comment marks dropped; else empty."""
    return F.trim(F.regexp_replace(F.regexp_extract(source, r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", 1), r"\s*(?:\*/|-->)\s*$", ""))


def is_trusted_host(url: Column, hosts: list[str]) -> Column:
    """Whether a URL's host is one of a list, or below one of them."""
    host = F.lower(F.regexp_extract(url, r"^[a-z+]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h) | host.endswith("." + h)
    return out


def holder_names_owner(holder: Column, path: Column) -> Column:
    """Whether a word of five letters or more in a copyright holder's name contains, or lies in, an element of a path behind its host."""
    words = F.filter(F.split(F.lower(holder), "[^a-z0-9]+"), lambda w: F.length(w) >= 5)
    parts = F.split(F.lower(path), "/")
    owners = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda o: o != "")
    return F.exists(words, lambda w: F.exists(owners, lambda o: F.contains(o, w) | F.contains(w, o)))


def base_names_overlap(a: Column, b: Column) -> Column:
    """Whether the last elements of two paths, of three letters or more without a major suffix, contain one another."""
    base = lambda p: F.lower(F.substring_index(strip_major(p), "/", -1))
    x, y = base(a), base(b)
    return (F.length(x) >= 3) & (F.length(y) >= 3) & (F.contains(x, y) | F.contains(y, x))


def rfc3339(at: Column) -> Column:
    """A time in UTC as text, to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_rfc3339(text: Column) -> Column:
    """The time that such a text names, with any offset and an optional fraction; null for other texts."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]X"))


def json_field(document: Column, path: str, kind: str = "string") -> Column:
    """A field of a JSON text by its path, as a type; null where there is none or it doesn't fit."""
    return F.get_json_object(document, path).try_cast(kind)
