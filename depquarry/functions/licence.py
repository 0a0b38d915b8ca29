"""Licence algebra: aliases, expressions, copyleft strength, compatibility, policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SPDX identifiers by copyleft strength. 0 none, 1 weak, 2 strong, 3 network.
PERMISSIVE = ["Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "0BSD", "Unlicense", "CC0-1.0", "BlueOak-1.0.0", "BSD-4-Clause", "BSL-1.0", "Python-2.0", "WTFPL", "BSD-2-Clause-Views"]
WEAK = ["MPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "CDDL-1.0"]
STRONG = ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "EUPL-1.1", "BUSL-1.1", "SSPL-1.0", "Elastic-2.0"]
NETWORK = ["AGPL-3.0-only", "AGPL-3.0-or-later", "OSL-3.0"]
PERMISSIVE_TARGETS = ["Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD"]
# Deprecated identifiers and what they mean.
ALIASES = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.0": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}


def canonical(spdx: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(ALIASES), spdx), spdx)


def _map(entries: dict[str, str | int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def strength(spdx: Column) -> Column:
    """0 to 3; null for an identifier that isn't modelled."""
    # looked up, as tests of each name by itself multiply where this stands in other expressions
    rungs = {n: k for k, names in reversed(list(enumerate((PERMISSIVE, WEAK, STRONG, NETWORK)))) for n in names}
    return F.try_element_at(_map(rungs), canonical(spdx))


def compatibility(dep: Column, target: Column) -> Column:
    """compatible, incompatible or unknown_pair: what isn't modelled is never called compatible."""
    d = strength(dep)
    return (
        F.when(d.isNull() | strength(target).isNull(), "unknown_pair")
        .when(d <= 1, "compatible")
        .when(target.isin(*PERMISSIVE_TARGETS), "incompatible")
        .when(dep == target, "compatible")
        .when(target.isin("GPL-3.0-only", "GPL-3.0-or-later") & (dep == "GPL-2.0-or-later"), "compatible")
        .otherwise("unknown_pair")
    )


def arms(expression: Column, word: str) -> Column:
    """The distinct sorted arms of a pure OR or AND expression of at least two; null for others, and with WITH."""
    other = {"OR": "AND", "AND": "OR"}[word]
    bare = F.regexp_replace(expression, r"[()]", "")
    got = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(bare, rf"\s+{word}\s+"), F.trim), lambda x: x != "")))
    return F.when(~F.coalesce(bare.rlike(rf"\s(?:{other}|WITH)\s"), F.lit(True)) & (F.size(got) >= 2), got)


def sole_identifier(expression: Column) -> Column:
    return F.when(~expression.rlike(r"\s") & (expression != ""), expression)


def election(elective: Column, target: Column) -> Column:
    """compatible, electable, unknown_pair or incompatible for a choice of arms."""
    verdicts = F.transform(elective, lambda a: compatibility(a, target))
    all_ok = F.forall(verdicts, lambda v: v == "compatible")
    return F.when(all_ok, "compatible").when(F.array_contains(verdicts, "compatible"), "electable").when(F.array_contains(verdicts, "unknown_pair"), "unknown_pair").otherwise("incompatible")


def conflict_kind(dep: Column) -> Column:
    s = strength(dep)
    return F.when(s == 3, "network_trigger").when(s == 2, "copyleft_propagation").otherwise("pair_incompatible")


def derived_expression(roots: Column, dual: Column) -> Column:
    """One root licence is itself; several are joined by OR where files are named for a choice, else by AND."""
    ids = F.array_sort(F.array_distinct(roots))
    return F.when(F.size(ids) == 0, "").when(F.size(ids) == 1, ids[0]).when(dual, F.array_join(ids, " OR ")).otherwise(F.array_join(ids, " AND "))


#: Policy outcomes from the least to the most restrictive; unknown isn't ranked.
POLICY = ("allow", "notice", "review", "deny")


def policy(categories: Column, any_of: Column) -> Column:
    """Of a choice the least restrictive known arm; of a conjunction the most restrictive, unknown if any arm is."""
    order = F.array(*[F.lit(x) for x in POLICY])
    ranks = F.transform(categories, lambda c: F.coalesce(F.array_position(order, c), F.lit(0)).cast("int"))
    known = F.filter(ranks, lambda r: r > 0)
    least = F.when(F.size(known) > 0, F.element_at(order, F.array_min(known)))
    most = F.when((F.size(ranks) > 0) & (F.array_min(ranks) > 0), F.element_at(order, F.array_max(ranks)))
    return F.coalesce(F.when(any_of, least).otherwise(most), F.lit("unknown"))


#: File names that hold a licence.
LICENCE_FILE = r"(?i)^(?:(?:licen[cs]e|copying|unlicense)(?:[-.].*)?|.+-licen[cs]e(?:\.[^.]*)?)$"


def is_licence_file(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return name.rlike(LICENCE_FILE) & ~F.lower(name).endswith(".go")


def is_root_level(path: Column) -> Column:
    return ~path.contains("/")


def is_vendored(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), "vendor")


def module_status(files: Column) -> Column:
    """None, Unclassified, PerFile, Ambiguous, Multiple or Detected of root files (array of struct spdx, confidence, is_per_file, close_alternative)."""
    spdx = F.array_distinct(F.transform(files, lambda f: f.spdx))
    top = F.array_max(F.transform(files, lambda f: F.struct(f.confidence.alias("c"), f.spdx.alias("s")))).s
    return (
        F.when(files.isNull() | (F.size(files) == 0), "None")
        .when(F.coalesce(top, F.lit("")) == "", "Unclassified")
        .when(F.forall(files, lambda f: f.is_per_file), "PerFile")
        .when((F.size(files) == 1) & F.exists(files, lambda f: f.close_alternative), "Ambiguous")
        .when(F.size(spdx) > 1, "Multiple")
        .otherwise("Detected")
    )


def snippets(content: Column) -> Column:
    """array<struct<spdx, copyright, origin, error>> of a source's attribution blocks; a block that isn't whole states its error.

    Blocks are line comments from ``SPDX-SnippetBegin`` to ``SPDX-SnippetEnd``; each needs one identifier, a copyright
    and a comment that names path@version.
    """
    tags = F.filter(F.transform(F.filter(F.split(content, "\n"), lambda x: x.rlike(r"^\s*//")), lambda x: F.trim(F.regexp_replace(x, r"^\s*//", ""))), lambda x: x != "")
    parts = F.split(F.array_join(tags, "\n"), r"(?m)^SPDX-SnippetBegin$")
    blocks = F.slice(parts, F.lit(2), F.size(parts))

    def read(b: Column) -> Column:
        body = F.regexp_extract(b, r"(?s)^(.*?)(?:^|\n)SPDX-SnippetEnd(?:\n|$)", 1)
        field = lambda name: F.trim(F.regexp_extract(body, rf"(?m)^{name}:\s*(.*)$", 1))
        spdx, who, why = field("SPDX-License-Identifier"), field("SPDX-SnippetCopyrightText"), field("SPDX-SnippetComment")
        origin = F.regexp_extract(why, r"[A-Za-z0-9._~/-]+@v[0-9][A-Za-z0-9.+\-]*", 0)
        error = (
            F.when(~b.rlike(r"(?m)^SPDX-SnippetEnd$"), "unterminated").when(spdx == "", "no identifier").when(spdx.rlike(r"[()]|\s(?:AND|OR|WITH)\s"), "compound expression")
            .when(who == "", "no copyright").when(why == "", "no comment").when(origin == "", "no origin")
        )
        return F.struct(spdx.alias("spdx"), who.alias("copyright"), origin.alias("origin"), error.alias("error"))

    return F.transform(blocks, read)


def escalation(before: Column, after: Column) -> Column:
    """Whether a licence moves from no copyleft to some; both must be modelled."""
    return F.coalesce((strength(before) == 0) & (strength(after) > 0), F.lit(False))


# The obligations of each licence. notice, text (of the licence), changes (stated), source
# (disclosed), network (use counts as distribution), marks (no use of trademarks), patent (express grant).
OBLIGATIONS = {
    "MIT": "notice text",
    "ISC": "notice text",
    "BSD-2-Clause": "notice text",
    "BSD-3-Clause": "notice text marks",
    "BSD-4-Clause": "notice text",
    "BSD-2-Clause-Views": "notice text",
    "Apache-2.0": "notice text changes marks patent",
    "Zlib": "notice changes",
    "BlueOak-1.0.0": "notice text patent",
    "0BSD": "",
    "Unlicense": "",
    "CC0-1.0": "",
    "CC-BY-4.0": "notice text changes marks",
    "CC-BY-SA-3.0": "notice text changes marks",
    "OFL-1.1": "notice text marks",
    "MPL-2.0": "notice text changes source patent",
    "LGPL-2.0-only": "notice text changes source",
    "LGPL-2.0-or-later": "notice text changes source",
    "LGPL-2.1-only": "notice text changes source",
    "LGPL-2.1-or-later": "notice text changes source",
    "LGPL-3.0-only": "notice text changes source patent",
    "LGPL-3.0-or-later": "notice text changes source patent",
    "EPL-1.0": "notice text changes source patent",
    "EPL-2.0": "notice text changes source patent",
    "EUPL-1.2": "notice text changes source marks",
    "CDDL-1.0": "notice text changes source patent",
    "GPL-2.0-only": "notice text changes source",
    "GPL-2.0-or-later": "notice text changes source",
    "GPL-3.0-only": "notice text changes source patent",
    "GPL-3.0-or-later": "notice text changes source patent",
    "EUPL-1.1": "notice text changes source marks",
    "BUSL-1.1": "notice text changes",
    "SSPL-1.0": "notice text changes source",
    "Elastic-2.0": "notice text marks",
    "AGPL-3.0-only": "notice text changes source network patent",
    "AGPL-3.0-or-later": "notice text changes source network patent",
    "OSL-3.0": "notice text changes source network patent",
}


def obligations(spdx: Column) -> Column:
    """The obligations of a licence as a sorted array; null for one that isn't in the catalogue, which is not the same as none."""
    table = F.create_map(*[F.lit(x) for k, v in OBLIGATIONS.items() for x in (k, v)])
    got = F.try_element_at(table, canonical(spdx))
    return F.when(got.isNotNull(), F.array_sort(F.filter(F.split(got, " "), lambda x: x != "")))


# Phrases by which a licence file of several grants says how they relate, and where each licence's text starts.
ELECTION_PHRASES = ["under the terms of either", "at your option", "either license", "either licence", "dual-licensed", "dual licensed", "you may choose either", "choice of either"]
SPLIT_PHRASES = [
    "covered by two different licenses", "covered by two different licences", "the following files", "all the remaining", "remain licensed under",
    "are licensed under", "is licensed under", "the remaining files", "remaining project files",
]
TEXT_ANCHORS = {
    "MIT": "permission is hereby granted, free of charge",
    "Apache-2.0": "terms and conditions for use, reproduction, and distribution",
    "BSD-3-Clause": "redistribution and use in source and binary forms",
    "BSD-2-Clause": "redistribution and use in source and binary forms",
    "ISC": "permission to use, copy, modify, and/or distribute this software",
    "Unlicense": "free and unencumbered software released into the public domain",
    "MPL-2.0": "mozilla public license",
    "CC-BY-4.0": "creative commons attribution 4.0",
    "CC-BY-SA-4.0": "creative commons attribution-sharealike 4.0",
    "CC-BY-SA-3.0": "creative commons attribution-sharealike 3.0",
    "OFL-1.1": "sil open font license",
    "Zlib": "this software is provided 'as-is', without any express",
    "BSL-1.0": "boost software license",
    "GPL-2.0": "gnu general public license",
    "GPL-3.0": "gnu general public license",
    "AGPL-3.0": "gnu affero general public license",
    "LGPL-3.0": "gnu lesser general public license",
    "Python-2.0": "python software foundation license",
    "BSD-3-Clause-New": "redistribution and use in source and binary forms",
}
#: How far before a grant its notice may stand.
#: Fixed value: characters of a text's head in which a notice counts.
NOTICE_WINDOW = 600


def first_phrase(low: Column, phrases: list[str]) -> Column:
    """The phrase that stands earliest in a lower-case text; null for none."""
    found = F.filter(F.array(*[F.struct(F.instr(low, F.lit(p)).alias("at"), F.lit(p).alias("p")) for p in phrases]), lambda x: x["at"] > 0)
    return F.when(F.size(found) > 0, F.array_min(found).p)


def compound_reading(text: Column, ids: Column) -> Column:
    """struct(shape, own, bundled) of a file that grants several licences.

    election: a header names a choice, or a phrase does; split: a phrase deals files out; bundled: every
    later grant follows a copyright line with a year or a files stanza of its own, and the earliest owns the file;
    else unstated. A file of one identifier is unstated.
    """
    low, own = F.lower(text), F.array_sort(F.array_distinct(ids))
    header = F.regexp_extract(low, r"spdx-license-identifier:([^\n]*)", 1)
    chosen = header.contains(" or ") | first_phrase(low, ELECTION_PHRASES).isNotNull()
    anchors = F.create_map(*[F.lit(x) for k, v in TEXT_ANCHORS.items() for x in (k, v)])
    at = F.array_sort(F.transform(own, lambda i: F.struct(F.coalesce(F.instr(low, F.try_element_at(anchors, i)), F.lit(0)).alias("at"), i.alias("id"))))
    placed = F.forall(at, lambda x: x["at"] > 0) & (F.size(F.array_distinct(F.transform(at, lambda x: x["at"]))) == F.size(at))
    window = lambda x: F.substring(low, F.greatest(x["at"] - NOTICE_WINDOW, F.lit(1)), F.least(x["at"] - 1, F.lit(NOTICE_WINDOW)))
    introduced = lambda x: window(x).rlike(r"copyright(?! \[yyyy\])[^\n]*\d{4}") | window(x).rlike(r"\nfiles:[^\S\n]*\S")
    later = F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0)))
    bundled = placed & F.forall(later, introduced)
    none = F.array().cast("array<string>")
    shape = F.when(F.size(own) < 2, "unstated").when(chosen, "election").when(first_phrase(low, SPLIT_PHRASES).isNotNull(), "split").when(bundled, "bundled").otherwise("unstated")
    return F.struct(
        shape.alias("shape"), F.when(shape == "bundled", F.slice(F.transform(at, lambda x: x["id"]), 1, 1)).otherwise(own).alias("own"),
        F.when(shape == "bundled", F.array_sort(F.transform(later, lambda x: x["id"]))).otherwise(none).alias("bundled"),
    )


def holder_contains(text: Column, part: str) -> Column:
    """Whether a text names a holder by a part of its name, in any case; null texts and an empty part name none."""
    return F.coalesce(F.lit(part != "") & F.lower(text).contains(part.lower()), F.lit(False))
