"""Module manifests: block-structured text to rows of directives, with faults by line.

A directive stands on a line of its own or, with others of its kind, in a block that a line with its name
and an opening parenthesis starts and a closing one ends. The state of the blocks is carried over the
lines of a manifest by a window; each entry is then read by its kind's pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depquarry.functions import semver

#: The directives that a manifest may hold, and those that stand in it once and in no block.
DIRECTIVES = ("module", "go", "toolchain", "godebug", "require", "exclude", "replace", "retract", "tool", "ignore")
SINGLE = ("module", "go", "toolchain")

WORD = r'("(?:[^"\\]|\\.)*"|`[^`]*`|[^\s"`()\[\],]+)'
PATTERNS = {
    "module": rf"^{WORD}$", "go": r"^([0-9]+(?:\.[0-9]+)*(?:(?:rc|beta|alpha)[0-9]+)?)$", "toolchain": rf"^{WORD}$", "godebug": r"^([^\s=]+=[^\s]+)$", "tool": rf"^{WORD}$", "ignore": rf"^{WORD}$",
    "require": rf"^{WORD}\s+{WORD}$", "exclude": rf"^{WORD}\s+{WORD}$", "replace": rf"^{WORD}(?:\s+{WORD})?\s+=>\s+{WORD}(?:\s+{WORD})?$", "retract": rf"^(?:\[\s*{WORD}\s*,\s*{WORD}\s*\]|{WORD})$",
}
LOCAL = r"^(\.{1,2}(/.*)?|/.*)$"


def _bare(word: Column) -> Column:
    return F.when(word.rlike('^["`].*["`]$'), F.substring(word, F.lit(2), F.char_length(word) - 2)).otherwise(word)


def parse(manifests: DataFrame, id: str, text: str) -> DataFrame:
    """(id, line, kind, path, version, new_path, new_version, indirect, local, comment, fault): a row per directive or fault.

    Lines count from 1. require, exclude, tool and ignore fill path (and version); module its path; go and
    toolchain their version; godebug path; replace the old coordinate, version null for any, and the new one,
    whose version is null where none is stated; retract version (the low end) and new_version (the high end,
    the same for a single version). indirect: the comment marks the requirement so. local: the replacement is a
    folder. comment: what follows ``//`` on the line.

    fault is null or why the line can't be read: ``unknown directive``, ``malformed``, ``nested block``,
    ``no open block``, ``block not closed`` (of the opening line), ``repeated`` (a second module, go or
    toolchain), ``version is none``, ``replacement without version``. A null text is a manifest without
    lines. Repeated ids are read apart only if their rows are: their lines are one manifest's.
    """
    lines = manifests.select(F.col(id).alias("id"), F.posexplode(F.split(text, r"\r?\n")).alias("line", "raw")).withColumn("line", F.col("line") + 1)
    at = F.instr("raw", "//")
    said = F.when(at > 0, F.substring("raw", F.lit(1), at - 1)).otherwise(F.col("raw"))
    comment = F.when(at > 0, F.rtrim(F.substring("raw", at + 2, F.char_length("raw")), F.lit("\r"))).otherwise("")
    x = lines.select("id", "line", F.trim(F.translate(said, "\t", " ")).alias("code"), F.trim(comment).alias("comment")).where("code <> ''")
    bracket = F.contains("code", F.lit("("))
    x = x.withColumn("_opener", F.when(bracket, F.regexp_extract("code", r"^(\w+)\s*\(\s*\)?$", 1)).otherwise("")).withColumn("_empty", bracket & F.col("code").rlike(r"^\w+\s*\(\s*\)$"))
    opener = F.col("_opener")
    x = x.withColumn("_open", F.when((opener != "") & ~F.col("_empty"), opener)).withColumn("_close", F.col("code") == ")")
    # what opens or closes a block; the one before a line and the one after it are each found in one pass over the manifest
    x = x.withColumn("_turn", F.coalesce("_open", F.when(F.col("_close"), "")))
    turn = lambda side: F.expr(f"{side}(_turn) IGNORE NULLS OVER (PARTITION BY id ORDER BY line)")
    x = x.select("*", F.coalesce(turn("lag"), F.lit("")).alias("_in"), turn("lead").alias("_next"))
    inside, first = F.col("_in") != "", F.regexp_extract("code", r"^(\S+)", 1)
    kind = F.when(F.col("_open").isNotNull(), F.col("_open")).when(F.col("_empty"), opener).when(inside, F.col("_in")).otherwise(first)
    x = x.withColumn("kind", kind).withColumn("_body", F.when(inside, F.col("code")).otherwise(F.trim(F.regexp_replace("code", r"^\S+", ""))))
    x = x.where(~(F.col("_close") & inside) & ~(F.col("_empty") & ~inside & F.col("kind").isin(*DIRECTIVES)))

    # the words of an entry, each read once, by the pattern of its kind
    words = F.coalesce(*[F.when(F.col("kind") == k, F.array(*[F.regexp_extract("_body", p, i + 1) for i in range(re.compile(p).groups)])) for k, p in PATTERNS.items()])
    x = x.withColumn("_words", F.transform(words, lambda w: F.nullif(_bare(w), F.lit(""))))
    group = lambda i: F.get("_words", F.lit(i - 1))
    of = lambda **by: F.coalesce(*[F.when(F.col("kind") == k, c) for k, c in by.items()])
    path = F.when(F.col("kind").isin("module", "require", "exclude", "replace", "tool", "ignore", "godebug"), group(1))
    version = of(go=group(1), toolchain=group(1), require=group(2), exclude=group(2), replace=group(2), retract=F.coalesce(group(1), group(3)))
    new_path, new_version = of(replace=group(3)), of(replace=group(4), retract=F.coalesce(group(2), group(3)))
    x = x.withColumn("path", path).withColumn("version", version).withColumn("new_path", new_path).withColumn("new_version", new_version)
    x = x.withColumn("local", F.when(F.col("kind") == "replace", F.col("new_path").rlike(LOCAL))).withColumn("indirect", F.when(F.col("kind") == "require", F.col("comment").rlike(r"^indirect(;|$)")))

    fits = F.coalesce(*[F.when(F.col("kind") == k, F.col("_body").rlike(p)) for k, p in PATTERNS.items()])
    bad = lambda c: F.col(c).isNotNull() & ~semver.is_valid(F.col(c))
    x = x.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_bad", bad("version") | bad("new_version"))
    versioned = F.col("kind").isin("require", "exclude", "retract") | ((F.col("kind") == "replace") & ~F.coalesce("local", F.lit(False)))
    opened = F.col("_open").isNotNull()
    again = F.row_number().over(Window.partitionBy("id", "kind", opened).orderBy("line")) > 1
    fault = (
        F.when(opened & inside, "nested block").when(F.col("_close"), "no open block").when(~F.coalesce(F.col("kind").isin(*DIRECTIVES), F.lit(False)), "unknown directive")
        .when(opened & F.col("kind").isin(*SINGLE), "malformed").when(opened & F.coalesce(F.col("_next") != "", F.lit(True)), "block not closed").when(~opened & ~F.col("_fits"), "malformed")
        .when(F.col("kind").isin(*SINGLE) & again, "repeated").when(versioned & F.col("_bad"), "version is none")
        .when((F.col("kind") == "replace") & ~F.col("local") & F.col("new_version").isNull(), "replacement without version")
    )
    x = x.withColumn("fault", fault).where(~opened | F.col("fault").isNotNull())
    whole = F.col("fault").isNull()
    kept = [F.when(whole, F.col(c)).alias(c) for c in ("path", "version", "new_path", "new_version", "indirect", "local")]
    return x.select("id", "line", "kind", *kept, "comment", "fault")


def faultless(rows: DataFrame) -> DataFrame:
    """The rows of manifests in which no line is a fault: one that has one states nothing."""
    return rows.join(rows.where("fault is not null").select("id").distinct(), "id", "left_anti")


def requirements(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """What version selection reads, from the rows of faultless manifests: (path, version, req_path, req_version, go_version).

    ``versions`` (id, version): the version that each manifest is of; its path is what it declares.
    """
    of = rows.groupBy("id").agg(F.max(F.when(F.col("kind") == "module", F.col("path"))).alias("path"), F.max(F.when(F.col("kind") == "go", F.col("version"))).alias("go_version"))
    r = rows.where("kind = 'require'").select("id", F.col("path").alias("req_path"), F.col("version").alias("req_version"))
    return of.join(versions.select("id", "version"), "id").join(r, "id").select("path", "version", "req_path", "req_version", "go_version")


def replacements(rows: DataFrame, id: Column) -> DataFrame:
    """The main manifest's replacements: (old_path, old_version — empty for any, new_path, new_version, local)."""
    r = rows.where((F.col("kind") == "replace") & (F.col("id") == id))
    return r.select(F.col("path").alias("old_path"), F.coalesce("version", F.lit("")).alias("old_version"), "new_path", F.coalesce("new_version", F.lit("")).alias("new_version"), "local")
