"""Classification ladders. A negative answer is confident only where everything was measured."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depquarry.functions import catalogues, semver


def directive_risk(kind: Column, is_local: Column, new_path: Column, old_path: Column, old_version: Column, resolved: Column) -> Column:
    """high, medium, low or unknown of a manifest directive; what can't be compared is high."""
    older = semver.compare(old_version, resolved) <= 0
    exclude = F.when(F.coalesce(resolved == "", F.lit(True)) | ~semver.is_valid(old_version) | ~semver.is_valid(resolved), "high").when(older, "low").otherwise("high")
    replace = F.when(is_local, "high").when((new_path != "") & (new_path != old_path), "high").otherwise("medium")
    return F.when(kind == "replace", replace).when(kind == "exclude", exclude).otherwise("unknown")


def directive_target(kind: Column, is_local: Column, local_path: Column, new_path: Column, old_path: Column) -> Column:
    """What is compiled for a replacement; empty for others."""
    return F.when(kind != "replace", "").when(is_local, local_path).when(new_path != "", new_path).otherwise(old_path)


def overall_status(coverage: Column, findings: Column) -> Column:
    """A record's status from its coverage and findings: findings count whatever the coverage, a clean answer needs analysis."""
    return F.when(findings == "Affected", "Affected").when(findings == "Withdrawn", "Withdrawn").when(coverage == "Analysed", "Clean").when(coverage == "Failed", "Failed").otherwise("Unscannable")


def reachability(is_reachable: Column) -> Column:
    """A nullable flag in words: null is not a no."""
    return F.when(is_reachable.isNull(), "not measured").when(is_reachable, "reachable").otherwise("not reachable")


def route_root(is_test: Column, is_entry: Column, is_exported: Column, known: Column) -> Column:
    return F.when(~known, "unrooted").when(is_test, "test").when(is_entry, "ingress").when(is_exported, "exported").otherwise("internal")


def is_test_entry(symbol: Column, is_test: Column, receiver: Column) -> Column:
    """A function that a test harness calls: its caller is real and in no graph."""
    return is_test & (F.coalesce(receiver, F.lit("")) == "") & symbol.rlike(r"^(?:TestMain|(?:Test|Benchmark|Fuzz|Example)(?:[^a-z].*)?)$")


def negative_verdict(sinks: Column) -> Column:
    """RESOLVED-ABSENT without a sink (array<struct<kind, site>>), UNRESOLVED with one."""
    return F.when(F.size(sinks) == 0, "RESOLVED-ABSENT").otherwise("UNRESOLVED")


def sinks(node_id: Column, unsafe: Column, assembly: Column, plugin: Column, below_bodies: Column, tests_measured: Column, references_measured: Column, test_entry: Column) -> Column:
    """What makes an empty answer about a node unproven, distinct and sorted by kind and site."""
    of = lambda cond, kind: F.when(cond, F.struct(F.lit(kind).alias("kind"), node_id.alias("site")))
    found = F.array(
        of(below_bodies, "type-only-callee"), of(unsafe, "unsafe-pointer-leaf"), of(assembly, "assembly-or-linkname-leaf"), of(plugin, "plugin-leaf"),
        of(~tests_measured, "test-scope-unmeasured"), of(~references_measured, "reference-scope-unmeasured"), of(test_entry, "test-harness-entry"),
    )
    return F.array_sort(F.array_distinct(F.filter(found, lambda s: s.isNotNull())))


def scan_failure(text: Column) -> Column:
    """The reason of a failed scan from its message; null for an empty one."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for reason, patterns in reversed(catalogues.SCAN_FAILURES):
        found = F.lit(True)
        for p in patterns:
            found = found & low.rlike(p)
        out = F.when(found, reason).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) != "", out)


def is_build_failure(text: Column) -> Column:
    """Whether a failed scan's message is of a module that can't be loaded or built."""
    return F.coalesce(F.lower(text).rlike(catalogues.BUILD_FAILURES), F.lit(False))


def unresolved_coordinate(text: Column) -> Column:
    """struct(path, version) that the first line of a refused lookup names last before it; null if none does.

    Positions in source files, whose paths are absolute or whose "versions" hold slashes and colons, are no coordinates.
    """

    def named(line: Column) -> Column:
        before = F.regexp_replace(F.regexp_extract(line, r"(?i)^(.*?)module lookup disabled by goproxy=off", 1), r":?\s*$", "")
        token = F.regexp_replace(F.regexp_extract(before, r"(\S+)\s*$", 1), ":$", "")
        path, version = (F.regexp_extract(token, "^([^/].*)@(v[^@/:]+)$", i) for i in (1, 2))
        return F.when((path != "") & semver.is_valid(version), F.struct(path.alias("path"), version.alias("version")))

    return F.get(F.filter(F.transform(F.split(text, "\n"), named), lambda c: c.isNotNull()), 0)


def offline_reason(has_build_list: Column, recovered: Column, known: Column) -> Column:
    """The reason of a refused lookup: without a version to hold against the build list, nothing is proven; a known one is the cache's fault."""
    return (
        F.when(~has_build_list, "version-not-in-toolchain").when(~recovered, "version-not-in-toolchain-unverified")
        .when(known, "incomplete-scan-cache").otherwise("version-not-in-toolchain")
    )


def _looked_up(table: dict[str, str], name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), name)


def capability(package: Column, receiver: Column, symbol: Column) -> Column:
    """The capability of a function: its own if the catalogue names it, else its package's, else null. Pointer receivers count as their types."""
    kind = F.regexp_replace(F.coalesce(receiver, F.lit("")), r"^\*", "")
    name = F.concat(package, F.lit("."), F.when(kind == "", symbol).otherwise(F.concat(kind, F.lit("."), symbol)))
    return F.coalesce(_looked_up(catalogues.FUNCTION_CAPABILITIES, name), _looked_up(catalogues.PACKAGE_CAPABILITIES, package))


def node_capabilities(package: Column, receiver: Column, symbol: Column, unsafe: Column, assembly: Column) -> Column:
    """All capabilities of a call node: its name's, and what its body uses; each once."""
    own = F.array(capability(package, receiver, symbol), F.when(unsafe, "UNSAFE_POINTER"), F.when(assembly, "ARBITRARY_EXECUTION"))
    return F.array_distinct(F.array_compact(own))


def exit_code(status: Column) -> Column:
    """The exit code of each outcome."""
    codes = {"ok": 0, "error": 1, "usage": 2, "not found": 3, "findings": 4, "partial": 5, "blocked": 10, "internal": 20}
    return F.try_element_at(F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))]), status)


#: How sound a negative answer is, the soundest last.
SOUNDNESS = ("NotStated", "Disputed", "Unsearchable", "Unconfirmed", "Inferred", "Confirmed")


def negative_soundness(is_reachable: Column, names_no_symbols: Column, analyser: Column, fidelity: Column, path_found: Column, in_frame: Column) -> Column:
    """The rung of a negative: only a search over a graph with bodies confirms one, and a path found in its own frame disputes it.

    ``path_found`` is null where no search ran when the record was read.
    """
    derived = (
        F.when((analyser == "callgraph") & (fidelity == "BuiltWithBodies"), "Confirmed").when(analyser == "callgraph", "Unconfirmed")
        .when((analyser == "scanner") & (fidelity == "source"), "Inferred").when(analyser == "scanner", "Unconfirmed").otherwise("NotStated")
    )
    searched = F.when(fidelity == "BuiltWithBodies", "Confirmed").otherwise("Unconfirmed")
    return (
        F.when(is_reachable.isNull() | is_reachable, "NotStated").when(names_no_symbols, "Unsearchable")
        .when(path_found & in_frame, "Disputed").when(path_found, derived).when(path_found.isNotNull(), searched).otherwise(derived)
    )


def soundness_rank(rung: Column) -> Column:
    return F.greatest(F.coalesce(F.array_position(F.array(*[F.lit(x) for x in SOUNDNESS]), rung), F.lit(1)).cast("int") - 1, F.lit(0))


def completeness_parity(level_a: Column, algorithm_a: Column, level_b: Column, algorithm_b: Column) -> Column:
    """Why two graphs can't be compared, or null if they can."""
    return F.when(level_a != level_b, F.concat(F.lit("completeness level differs: before="), level_a, F.lit(" after="), level_b)).when(algorithm_a != algorithm_b, F.concat(F.lit("algorithm/devirt tier differs: before="), algorithm_a, F.lit(" after="), algorithm_b))


def completeness_caveat(level: Column, phase: str = "") -> Column:
    """What to bear in mind of a graph that is below full fidelity; empty for one with bodies. Phases: coding, inclusion, diff, or none."""
    # fixed values: the texts
    texts = {
        "coding": "run `go generate ./...` and `go build ./...`, then re-analyse; verdicts over this module may be incomplete",
        "inclusion": "generators are not run on untrusted code, so this verdict is degraded and may be incomplete",
        "diff": "a before/after verdict over this module is unresolved unless both sides match",
    }
    why = texts.get(phase, "verdicts over this module may be incomplete")
    return F.when(level.isin("BuiltWithBodies", "BUILT_WITH_BODIES"), "").otherwise(F.concat(F.lit("call graph is "), level, F.lit(f", not built with bodies — {why}")))


def attested(path: Column, version: Column, replacement_path: Column, replacement_version: Column) -> Column:
    """struct(path, version) whose published checksum stands for a vendored module's bytes; null for a folder that replaces it: nothing is published."""
    other, at = F.coalesce(replacement_path, F.lit("")), F.coalesce(replacement_version, F.lit(""))
    return F.when(other == "", F.struct(path.alias("path"), version.alias("version"))).when(at != "", F.struct(other.alias("path"), at.alias("version")))


def vendor_category(kind: Column) -> Column:
    """The policy's category of a vendored tree's finding: drift stands alone, all else disagrees."""
    return F.when(kind == "drift", "drift").otherwise("inconsistency")


def fips_category(kind: Column, toolchain_capable: Column) -> Column:
    return F.when(kind == "toolchain", F.when(toolchain_capable, "compliant").otherwise("deviation")).when(kind == "algorithm", "deviation").when(kind == "direct-random", "compliant").otherwise("unknown")


def example_symbol(function: Column) -> Column:
    """struct(symbol, suffix) of an example function's name: its leading upper-case parts, and all parts from the first lower-case one on."""
    after = F.regexp_extract(function, "^Example(.*)$", 1)
    parts = F.filter(F.split(after, "_"), lambda p: p != "")
    lower = F.array_position(F.transform(parts, lambda p: ~p.rlike(r"^\p{Lu}")), True)
    n = F.when(lower > 0, lower - 1).otherwise(F.size(parts)).cast("int")
    own = (after == "") | ~function.startswith("Example")
    symbol = F.when(own, function).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "."))
    return F.struct(symbol.alias("symbol"), F.when(own, "").otherwise(F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), "_")).alias("suffix"))


def has_fetched_artefact(source: Column) -> Column:
    """Resolution sources that own no artefact; unknown ones count as owning one."""
    return ~F.coalesce(source.isin("main_module", "local_replace", "stdlib", "workspace"), F.lit(False))


def is_cacheable(lookup: Column) -> Column:
    """A fact whose checksum lookup didn't fail."""
    return F.coalesce(lookup != "failed", F.lit(True))


def licence_clause(expression: Column, primary: Column) -> Column:
    """What a bill of materials states: the expression, else the primary licence, else NOASSERTION."""
    said = lambda c: F.when(c != "", c)
    return F.coalesce(said(expression), said(primary), F.lit("NOASSERTION"))


def audit_cell(findings: Column, coverage: Column, n: Column) -> Column:
    """A vulnerability cell of the audit: a count, a word for a measured absence, a word for a gap."""
    return F.when(findings.isNull(), "not scanned").when(findings == "Affected", F.concat(n.cast("string"), F.lit(" affected"))).when(findings == "Withdrawn", "withdrawn only").when(coverage == "Analysed", "clean").otherwise(F.concat(F.lit("gap: "), F.lower(coverage)))


def godebug_tier(setting: Column, tiers: dict[str, str] | None = None) -> Column:
    return F.coalesce(_looked_up(tiers or catalogues.GODEBUG_TIERS, setting), F.lit("unknown"))


def fips_variant(toolchain: Column, go_version: Column, fips140: Column) -> Column:
    """Which FIPS-capable build a toolchain is: one that its name marks, or a stock one new enough whose setting asks for it; else empty."""
    out, v = F.lit(""), F.concat(F.lit("v"), go_version)
    asked = ~F.coalesce(fips140, F.lit("")).isin("", "off")
    out = F.when(asked & (semver.key(v) >= semver.key(F.lit("v" + catalogues.FIPS_NATIVE_SINCE))), catalogues.FIPS_NATIVE).otherwise(out)
    for name, part in reversed(catalogues.FIPS_TOOLCHAINS.items()):
        out = F.when(toolchain.contains(part), name).otherwise(out)
    return out


def is_non_fips_package(package: Column) -> Column:
    return F.coalesce(package.isin(*catalogues.NON_FIPS_PACKAGES), F.lit(False))


def fips_assessment(variant: Column, go_version: Column, fips140: Column, packages: Column, modules: Column) -> Column:
    """One line on eligibility, from the variant, sorted packages of algorithms outside FIPS and sorted modules with C cryptography."""
    v, said = F.concat(F.lit("v"), go_version), lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    native, floor = semver.key(v) >= semver.key(F.lit("v" + catalogues.FIPS_NATIVE_SINCE)), catalogues.FIPS_NATIVE_SINCE
    state = F.when(fips140 == "off", "is set to off").otherwise("is not set")
    # fixed values: the texts
    off = said("not enabled: toolchain go", go_version, " ships native FIPS 140-3 but the fips140 directive ", state, "; set //go:debug fips140=on (or GODEBUG=fips140=on) to enable")
    old = said("not eligible: toolchain go", go_version, f" predates native FIPS 140-3 (requires go{floor} or newer)")
    none = "not eligible: toolchain does not provide native FIPS 140-3 and no FIPS-capable distribution was recognised"
    algorithms = said("not eligible: toolchain ", variant, " recognised but non-FIPS algorithm in use: ", F.array_join(packages, ", "))
    foreign = said("limited: toolchain ", variant, " recognised but cgo crypto dependency(ies) ", F.array_join(modules, ", "), " require separate cgo analysis")
    return (
        F.when((variant == "") & native, off).when((variant == "") & semver.is_valid(v), old).when(variant == "", none)
        .when(F.size(packages) > 0, algorithms).when(F.size(modules) > 0, foreign)
        .otherwise(said("eligible: toolchain ", variant, " recognised, no non-FIPS algorithm imports detected"))
    )


def tag_position(pin: Column, latest: Column, tag: Column) -> Column:
    """What a pin is placed against: the tag, if the pin may sort above it and does, else the latest version."""
    from depquarry.functions import semver

    return F.when(semver.can_sort_above_tag(pin) & (semver.compare(pin, tag) > 0), tag).otherwise(latest)


def walk_frame(goos: Column, goarch: Column, has_published_target: Column) -> Column:
    """struct(text, basis): the platform of a walk, or why it has none."""
    named = (F.coalesce(goos, F.lit("")) != "") | (F.coalesce(goarch, F.lit("")) != "")
    text = F.when(named, F.concat(F.coalesce(goos, F.lit("")), F.lit("/"), F.coalesce(goarch, F.lit("")))).when(has_published_target, "not-platform-scoped").otherwise("unrecorded")
    return F.struct(text.alias("text"), F.when(named, "platform").otherwise(text).alias("basis"))


def pinned_analysis_supersedes(offered_source: Column, recorded_source: Column, synthesised_requires: Column, is_failure: Column) -> Column:
    """Whether an analysis with a build list is worth repeating: the record used another list, or failed without one."""
    has = F.coalesce(offered_source != "", F.lit(False))
    return has & (F.coalesce(recorded_source, F.lit("")) != offered_source) & ((synthesised_requires > 0) | ((F.coalesce(recorded_source, F.lit("")) == "") & is_failure))
