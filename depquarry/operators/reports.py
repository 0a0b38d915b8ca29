"""Reports over a user's tables: a project's audit, the sections of a module's context, licence closures, verification coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depquarry.functions import classify, licence, semver
from depquarry.operators import compose, frames
from depquarry.operators.dealing import dealt

# ---- licence closure ---------------------------------------------------------------------------------

#: Identifiers that the dataset leaves out on purpose, and why.
DELIBERATE = {
    "CC-BY-4.0": "Creative Commons attribution licence for content, not code; its obligations attach to the covered material (docs, data, media), not to a linked Go package",
    "CC-BY-SA-3.0": "Creative Commons share-alike for content; the reciprocity arm has no settled reading against software redistribution, so the pair is a legal question rather than a dataset entry",
    "CC-BY-SA-4.0": "Creative Commons share-alike for content; same reasoning as CC-BY-SA-3.0. Commonly seen on a module's LICENSE.docs alongside a permissive code licence",
    "OFL-1.1": "SIL Open Font Licence; its reciprocity applies to the font files, not to software that merely ships them",
}


def closure_conflicts(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """The open items of a closure against its target: (keys, path, version, target, dep, verdict, kind, electable, measurement).

    ``inputs`` (keys, path, version, spdx, arms array<string>, measurement, target) has a row for each identifier that a
    module must be taken under, or one with the arms of a choice. A row without an identifier is an open item too:
    nothing was measured that could be called compatible. A choice of which all arms fit is none; of which some do, it
    is electable by those; else the verdict is that of its arms, and its kind that of the first. ``keys`` tell closures apart.
    """
    c = _conflict()
    return _judged(inputs).where("_verdict <> 'compatible'").select(*keys, "path", "version", "target", *[c[n].alias(n) for n in ("dep", "verdict", "kind", "electable", "measurement")])


def _choice() -> Column:
    return F.coalesce(F.size("arms"), F.lit(0)) >= 2


def _judged(inputs: DataFrame) -> DataFrame:
    """``inputs`` with ``_verdict``; the verdict is worked out once a row."""
    spdx = F.coalesce("spdx", F.lit(""))
    verdict = F.when(_choice(), licence.election(F.col("arms"), F.col("target"))).when(spdx == "", "unknown_pair").otherwise(licence.compatibility(licence.canonical(spdx), F.col("target")))
    # behind an array, so that it isn't put into each place that names it
    return inputs.withColumn("_verdict", F.explode(F.array(verdict)))


def _conflict() -> dict[str, Column]:
    """The columns of an open item, over :func:`_judged` rows."""
    choice, spdx, verdict = _choice(), F.coalesce("spdx", F.lit("")), F.col("_verdict")
    dep = F.when(choice, F.array_join("arms", " OR ")).otherwise(spdx)
    first = F.when(choice, F.col("arms")[0]).otherwise(spdx)
    kind = F.when(verdict == "electable", "election_required").when(verdict == "unknown_pair", "unknown_pair").otherwise(licence.conflict_kind(licence.canonical(first)))
    able = F.when(verdict == "electable", F.filter("arms", lambda a: licence.compatibility(licence.canonical(a), F.col("target")) == "compatible"))
    measured = F.when(choice | (spdx != ""), "classified").otherwise(F.col("measurement"))
    return {"dep": dep, "verdict": verdict, "kind": kind, "electable": able, "measurement": measured}


def _identifiers() -> Column:
    """The identifiers that a row of a closure bears."""
    return F.when(_choice(), F.col("arms")).when(F.coalesce("spdx", F.lit("")) != "", F.array("spdx")).otherwise(F.array().cast("array<string>"))


def coverage_holes(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spdx, modules, deliberate, reason): identifiers that no dataset models, by how many modules of the closure bear them.

    Arms of a choice count each; a module without an identifier is no hole, as nothing was read.
    """
    x = inputs.select(*keys, "path", "version", F.explode(_identifiers()).alias("spdx")).where(licence.strength(licence.canonical(F.col("spdx"))).isNull())
    g = x.groupBy(*keys, "spdx").agg(F.count_distinct(F.struct(F.coalesce("path", F.lit("")), F.coalesce("version", F.lit("")))).alias("modules"))
    why = F.coalesce(*[F.when(licence.canonical(F.col("spdx")) == k, v) for k, v in DELIBERATE.items()])
    return g.withColumn("deliberate", why.isNotNull()).withColumn("reason", F.coalesce(why, F.lit("")))


def closure_report(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target, modelled, clean, conflicts, holes) per closure: conflicts and holes as sorted arrays.

    Conflicts are in the order of path, version and identifier, holes in that of the identifier. clean: no conflict.
    """
    # one pass: a closure's open items and unmodelled identifiers meet in one aggregation
    x = _judged(inputs)
    item = F.when(F.col("_verdict") != "compatible", F.struct("path", "version", *[c.alias(n) for n, c in _conflict().items()]))
    hole = F.transform(F.filter(_identifiers(), lambda i: licence.strength(licence.canonical(i)).isNull()), lambda i: F.struct(i.alias("spdx"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("version", F.lit("")).alias("version")))
    g = x.select(*keys, "target", item.alias("_item"), hole.alias("_holes")).groupBy(*keys)
    out = g.agg(F.max("target").alias("target"), F.sort_array(F.collect_list("_item")).alias("_items"), F.array_distinct(F.flatten(F.collect_list("_holes"))).alias("_of"))
    ids = F.array_sort(F.array_distinct(F.transform("_of", lambda o: o["spdx"])))
    why = lambda i: F.coalesce(*[F.when(licence.canonical(i) == k, v) for k, v in DELIBERATE.items()])
    entry = lambda i: F.struct(i.alias("spdx"), F.size(F.filter("_of", lambda o: o["spdx"] == i)).cast("long").alias("modules"), why(i).isNotNull().alias("deliberate"), F.coalesce(why(i), F.lit("")).alias("reason"))
    some = lambda c: F.when(F.size(c) > 0, c)
    out = out.withColumn("conflicts", some(F.col("_items"))).withColumn("holes", some(F.transform(ids, entry)))
    size = F.coalesce(F.size("conflicts"), F.lit(0))
    return out.select(*keys, "target", licence.strength(F.col("target")).isNotNull().alias("modelled"), (size <= 0).alias("clean"), "conflicts", "holes")


# ---- verification ------------------------------------------------------------------------------------

#: The class of each verification status.
BUCKETS = {
    "Verified": "cross_verified", "VerifiedBySumDBOnly": "checksum_db", "VerifiedByGoSum": "go_sum", "LocalSource": "local_source",
    "UnverifiedNoSumDB": "unverified", "UnverifiedMissingOrigin": "unverified", "UnverifiedHashMismatch": "unverified", "UnverifiedGoModInconsistent": "unverified", "UnverifiedNoVCS": "unverified", "UnverifiedVCSToolMissing": "unverified",
}
CLASSES = ("cross_verified", "checksum_db", "go_sum", "unverified", "local_source", "unrecognised", "unrecorded")
EVIDENCE = ("rechecked", "inherited", "never", "not_measured")


def verification_class(status: Column) -> Column:
    """The class of a status; null is ``unrecorded``, an unknown one ``unrecognised``, so every module is in one."""
    return F.when(status.isNull(), "unrecorded").otherwise(F.coalesce(*[F.when(status == k, v) for k, v in BUCKETS.items()], F.lit("unrecognised")))


def vcs_evidence(legs: Column) -> Column:
    """What a record's validation legs (array of struct kind, provenance) say of the check against version control.

    No legs at all can't speak of it (not_measured); legs without one of kind ``vcs`` are a check that never was. Of
    several, the first that says something decides.
    """
    said = F.transform(F.filter(legs, lambda l: (l["kind"] == "vcs") & l["provenance"].isin("rechecked", "inherited", "absent")), lambda l: F.when(l["provenance"] == "absent", "never").otherwise(l["provenance"]))
    return F.when(F.coalesce(F.size(legs), F.lit(0)) <= 0, "not_measured").otherwise(F.coalesce(F.get(said, F.lit(0)), F.lit("never")))


def verification_report(modules: DataFrame, keys: list[str], status: str, legs: str) -> DataFrame:
    """(keys, total, a count for each class, recorded, cross_verifiable, collapsed, a count for each kind of evidence).

    The classes part the total. recorded: with a status; cross_verifiable: those that are no local source, which has
    nothing remote to check against; collapsed: there is something to cross-verify and none of it was. The evidence
    is counted over the cross-verifiable only and parts them.
    """
    x = modules.withColumn("_c", verification_class(F.col(status))).withColumn("_e", F.when(~F.col("_c").isin("unrecorded", "local_source"), vcs_evidence(F.col(legs))))
    counts = [F.count_if(F.col("_c") == c).alias(c) for c in CLASSES] + [F.count_if(F.col("_e") == e).alias(f"vcs_{e}") for e in EVIDENCE]
    g = x.groupBy(*keys).agg(F.count("*").alias("total"), *counts)
    g = g.withColumn("recorded", F.col("total") - F.col("unrecorded")).withColumn("cross_verifiable", F.col("recorded") - F.col("local_source"))
    return g.withColumn("collapsed", (F.col("cross_verifiable") > 0) & (F.col("cross_verified") == 0))


# ---- selection ---------------------------------------------------------------------------------------


def use_selection(nodes: DataFrame, targets: DataFrame, recursive: bool) -> DataFrame:
    """(walk, path, version, source, copied): the modules that are to be copied of each walk.

    ``nodes`` (walk, path, version, source), ``targets`` (walk, path, version). Recursive: every node. Else the target
    alone, with the source that the walk has for it, or ``target`` where the walk doesn't name it, which then is
    looked for and may be missed. copied: the source has an artefact; the others are listed, but are no failures.
    """
    if recursive:
        x = nodes.select("walk", "path", "version", "source").distinct()
    else:
        of = nodes.groupBy("walk", "path", "version").agg(F.min("source").alias("source"))
        x = targets.select("walk", "path", "version").distinct().join(of, ["walk", "path", "version"], "left").withColumn("source", F.coalesce("source", F.lit("target")))
    return x.withColumn("copied", classify.has_fetched_artefact(F.col("source")))


# ---- context -----------------------------------------------------------------------------------------


def context(modules: DataFrame, keys: list[str], sections: dict[str, tuple[DataFrame, Sequence[Column]]], served: dict[str, Column] | None = None) -> DataFrame:
    """A row per module with a struct for each section: status, generations, and the served record's other columns.

    ``sections`` gives each section's generations (keys, status, others) and their ranking; ``served``, a condition
    that a generation must meet to be answered from. A module without a generation is ``not_run``, with some that none
    is served of ``superseded``; else the status is the record's own. ``measured``: how many sections have a record.
    """
    names, served = list(sections), served or {}
    n = modules.count() + sum(table.count() for table, _ in sections.values())
    out = dealt(modules.select(*keys), keys, n).distinct()
    for name, (table, ranking) in sections.items():
        others = [c for c in table.columns if c not in (*keys, "status")]
        ok = F.coalesce(served.get(name, F.lit(True)), F.lit(False))
        w = Window.partitionBy(*keys)
        x = dealt(table, keys, n).withColumn("_ok", ok).withColumn("_all", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.col("_ok").desc(), *ranking))).where("_n = 1")
        one = F.struct(F.when(F.col("_ok"), F.col("status")).otherwise("superseded").alias("status"), F.col("_all").alias("generations"), *[F.when(F.col("_ok"), F.col(c)).alias(c) for c in others])
        x = x.select(*keys, one.alias(name))
        empty = F.struct(F.lit("not_run").alias("status"), F.lit(0).cast("long").alias("generations"), *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in others])
        out = out.join(x, keys, "left").withColumn(name, F.coalesce(name, empty))
    measured = sum((F.when(F.col(f"{n}.status").isin("not_run", "superseded"), 0).otherwise(1) for n in names), F.lit(0))
    return out.withColumn("measured", measured)


def project_context(context_: DataFrame, nodes: DataFrame, keys: list[str], walk: str, sections: list[str]) -> DataFrame:
    """(walk, modules, a count per section of the modules that it is measured for, complete): the context of a walk's nodes in sum."""
    n = nodes.count()
    have = {s: ~F.col(f"{s}.status").isin("not_run", "superseded") for s in sections}
    known = dealt(context_.select(*keys, *[c.alias(s) for s, c in have.items()]), keys, n)
    # dealt by module, told apart there, then dealt by walk: counting ahead of that would hold a row for nearly every node
    x = dealt(nodes.select(walk, *keys), keys, n).distinct().join(known, keys, "left").select(walk, *[F.coalesce(s, F.lit(False)).alias(s) for s in sections])
    g = dealt(x, [walk], n).groupBy(walk).agg(F.count("*").alias("modules"), *[F.count_if(s).alias(s) for s in sections])
    return g.withColumn("complete", F.least(*[F.col(s) for s in sections]) == F.col("modules") if len(sections) > 1 else F.col(sections[0]) == F.col("modules"))


# ---- audit -------------------------------------------------------------------------------------------


def audit(nodes: DataFrame, fetches: DataFrame, licences: DataFrame, vulnerabilities: DataFrame, overrides: DataFrame, latest: DataFrame, rankings: dict[str, Sequence[Column]], rooting: Column | None = None, denied: Sequence[str] = ()) -> DataFrame:
    """One row per dependency: what each stage knows of it, and whether it blocks.

    ``nodes`` (path, version, root, direct); the root is no dependency. ``fetches`` (path, version, status, others),
    ``licences`` (path, version, expression, others), ``vulnerabilities`` (path, version, findings, rooting, others) are
    generations, of which ``rankings`` (by fetch, licence, vulnerability) serve one each; vulnerabilities are served for
    a consumer, or at ``rooting`` where one is given. ``overrides`` (path, version, spdx; an empty version is any)
    replace a licence, that of the version before that of the path. ``latest`` (path, version).

    (path, version, direct, verification, licence, licence_source, vulnerability, declined, latest, pin, blocking): what
    no stage measured is ``(not fetched)`` or ``(not run)``, never clean. declined: the findings of an isolated record
    that was not answered from. blocking: a finding that stands, or a licence all of whose choices are denied.
    """
    key = ["path", "version"]
    x = nodes.where(~F.coalesce("root", F.lit(False))).groupBy(*key).agg(F.max("direct").alias("direct"))
    f = compose.served(fetches, key, rankings["fetch"]).select(*key, F.col("status").alias("verification"))
    l = compose.served(licences, key, rankings["licence"]).select(*key, F.coalesce("expression", F.lit("")).alias("_l"))
    own = F.concat("path", F.lit("@"), "version")
    if rooting is None:
        v = frames.for_consumer(vulnerabilities, key, "rooting", own, rankings["vulnerability"]).select(*key, F.col("findings").alias("vulnerability"), F.col("aside.findings").alias("declined"))
    else:
        v = frames.at_rooting(vulnerabilities, key, "rooting", rooting, rankings["vulnerability"]).select(*key, F.col("findings").alias("vulnerability"), F.lit(None).cast("string").alias("declined"))
    o = overrides.groupBy("path", F.coalesce("version", F.lit("")).alias("version")).agg(F.min("spdx").alias("spdx"))
    exact = o.where("version <> ''").select(*key, F.col("spdx").alias("_oe"))
    wild = o.where("version = ''").select("path", F.col("spdx").alias("_ow"))
    top = latest.groupBy("path").agg(F.max_by("version", F.struct(semver.key(F.col("version")).alias("k"), "version")).alias("latest"))
    x = x.join(f, key, "left").join(l, key, "left").join(v, key, "left").join(exact, key, "left").join(wild, "path", "left").join(top, "path", "left")
    over = F.coalesce("_oe", "_ow")
    name = F.coalesce(over, F.when(F.col("_l") == "", "(unclassified)").otherwise(F.col("_l")), F.lit("(not run)"))
    source = F.when(over.isNotNull(), "override").when(F.col("_l").isNull(), "none").otherwise("record")
    arms = F.coalesce(licence.arms(name, "OR"), F.array(name))
    no = F.forall(arms, lambda a: a.isin(*denied)) if denied else F.lit(False)
    blocking = (F.coalesce("vulnerability", F.lit("")) == "Affected") | no
    return x.select(
        *key, "direct", F.coalesce("verification", F.lit("(not fetched)")).alias("verification"), name.alias("licence"), source.alias("licence_source"), F.coalesce("vulnerability", F.lit("(not run)")).alias("vulnerability"), "declined",
        "latest", F.when(F.col("latest").isNotNull(), semver.compare_pin(F.col("version"), F.col("latest"))).alias("pin"), blocking.alias("blocking"),
    )


# ---- scan history ------------------------------------------------------------------------------------


def scan_history(runs: DataFrame, results: DataFrame, records: DataFrame, findings: DataFrame, walks: DataFrame, pipeline: str) -> DataFrame:
    """Every scan run of every walk in its order, what stands behind its verdicts, and what changed against the run before.

    ``runs`` (walk, run, at, snapshot), ``results`` (run, module, status; one row a module), ``records`` (run, module,
    pipeline), ``findings`` (run, module, finding), ``walks`` (walk): those that are still there.

    (walk, run, ordinal, at, snapshot, run_status, total, failed, gaps, affected, missing, superseded, new, resolved,
    resolvable). ordinal counts from 1 by time, then name. missing: modules with a verdict that no record backs;
    superseded: those with records of other pipelines alone. new: findings that the run before did not have, all of the
    first run; resolved: those that it had and this one has not, of modules that this run measured, as a failed scan
    resolves nothing. resolvable: the walk is there. A run without results has failed.
    """
    from depquarry.operators import rollup

    # results are about as many as the records behind them, and are not counted, as they may come from an aggregation
    n = runs.count() + records.count() + findings.count()
    by_run = lambda df: dealt(df, ["run"], n)
    there = dealt(walks.select("walk"), ["walk"], n).distinct().withColumn("_there", F.lit(True))
    r = dealt(runs, ["walk"], n).withColumn("ordinal", F.row_number().over(Window.partitionBy("walk").orderBy("at", "run"))).join(there, "walk", "left")
    status = rollup.run_status(by_run(results.select("run", "status").unionByName(runs.select("run"), allowMissingColumns=True)), ["run"], "status")
    # tables meet in groups, as joins on more than the run would deal them again; a null is like no other
    verdicts = results.select("run", "module", F.lit(1).alias("_v"))
    b = verdicts.unionByName(records.where("module is not null").select("run", "module", F.lit(0).alias("_v"), (F.col("pipeline") == pipeline).alias("current")), allowMissingColumns=True)
    b = by_run(b).groupBy("run", "module").agg(F.sum("_v").alias("_v"), F.max("current").alias("current"))
    of = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0))
    b = b.groupBy("run").agg(of(F.col("current").isNull(), "_v").alias("missing"), of(~F.col("current"), "_v").alias("superseded"))

    place = by_run(r.select("run", "walk", "ordinal"))
    measured = by_run(results.where(~F.col("status").isin("Failed", "Unscannable")).select("run", "module")).distinct().join(place, "run")
    now = by_run(findings.select("run", "module", "finding")).distinct().join(place, "run").select("walk", "ordinal", "module", "finding", F.lit(1).alias("_now"))
    prior = now.select("walk", (F.col("ordinal") + 1).alias("ordinal"), "module", "finding", F.lit(1).alias("_before"))
    x = now.unionByName(prior, allowMissingColumns=True).unionByName(measured.select("walk", "ordinal", "module", F.lit(True).alias("_m")), allowMissingColumns=True)
    key, run = ["walk", "ordinal", "module", "finding"], ["walk", "ordinal"]
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    x = dealt(x, run, n).groupBy(*key).agg(count("_now"), count("_before"), F.max("_m").alias("_m"))
    alone = F.col("module").isNull() | F.col("finding").isNull()
    x = x.groupBy(*key[:3]).agg(of(alone | (F.col("_before") == 0), "_now").alias("new"), of(alone | (F.col("_now") == 0), "_before").alias("gone"), F.max("_m").alias("_m"))
    change = x.groupBy(*run).agg(F.sum("new").alias("new"), of(F.col("_m") & F.col("module").isNotNull(), "gone").alias("resolved"))
    out = dealt(by_run(r).join(status, "run", "left").join(b, "run", "left"), run, n).join(change, run, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("walk", "run", "ordinal", "at", "snapshot", "run_status", "total", "failed", "gaps", "affected", *[zero(c) for c in ("missing", "superseded", "new", "resolved")], F.col("_there").isNotNull().alias("resolvable"))
