"""What audits ask of records: narrowing, records of runs and walks, one row a module with all facts on it, counters and verdicts.

Tables may hold more columns than an operator names. Keys are lists of columns that both sides have; null
keys meet nothing, so they are never members and always beyond a set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depquarry.functions import classify

# ---- narrowing ---------------------------------------------------------------------------------------


def narrowed(df: DataFrame, equal: dict[str, object] | None = None, at: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows that meet every argument given; an argument of None asks nothing. Both ends of the time count."""
    for column, value in (equal or {}).items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    kind = df.schema[at].dataType if at else None
    if since is not None:
        df = df.where(F.col(at) >= F.lit(since).cast(kind))
    if until is not None:
        df = df.where(F.col(at) <= F.lit(until).cast(kind))
    return df


def members(df: DataFrame, scope: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows whose keys are in the scope; no scope lets all pass, an empty one none."""
    return df if scope is None else df.join(scope.select(*keys), keys, "left_semi")


def beyond(df: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in the other table: exclusions, what is uncovered, references to what is gone."""
    return df.join(covered.select(*keys), keys, "left_anti")


def context_nodes(nodes: DataFrame, keys: list[str], direct: Column | None = None, allow: DataFrame | None = None, affected: DataFrame | None = None) -> DataFrame:
    """Nodes that are direct, on the list of those allowed, and affected, as far as each is asked."""
    asked = nodes if direct is None else nodes.where(direct)
    return members(members(asked, allow, keys), affected, keys)


def edges_asked(edges: DataFrame, is_test: Column, exclude_tests: bool = True) -> DataFrame:
    """Edges, without those of tests if asked; an edge that doesn't say counts as no test."""
    return edges.where(~F.coalesce(is_test, F.lit(False))) if exclude_tests else edges


def projected_symbols(symbols: DataFrame, package: str, kind: str, name: str, kinds: list[str]) -> DataFrame:
    """(package, names): each package's distinct symbols of the kinds, sorted; packages without one are left out."""
    of = symbols.where(F.col(kind).isin(*kinds))
    return of.groupBy(F.col(package).alias("package")).agg(F.array_sort(F.collect_set(name)).alias("names"))


# ---- records of runs and walks -------------------------------------------------------------------------


def with_finding(records: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct records whose keys the index of findings has."""
    return records.join(index.select(*keys), keys, "left_semi").distinct()


def of_walks(records: DataFrame, run_modules: DataFrame, runs: DataFrame, keys: list[str], run: str, walk: str, of: object = None) -> DataFrame:
    """Distinct (walk, the record's columns): records of the modules of each walk's runs; of one walk if it is named."""
    asked = runs.select(run, walk)
    if of is not None:
        asked = asked.where(F.col(walk) == F.lit(of))
    named = run_modules.select(run, *keys).join(asked, run).select(walk, *keys).distinct()
    return named.join(records, keys).select(walk, *records.columns).distinct()


def inherited(rows: DataFrame, records: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with columns of the record that they belong to; rows without a record are left out."""
    return rows.join(records.select(*keys, *columns), keys)


def audit_rows(nodes: DataFrame, facts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Nodes beside each table of facts in turn, joined on its keys, of which it has one row each.

    ``<fact>_recorded`` says whether there was one, so null values of a record and no record stay apart.
    A later fact may be keyed by a column of an earlier one.
    """
    for name, (table, keys) in facts.items():
        flag = f"{name}_recorded"
        nodes = nodes.join(table.withColumn(flag, F.lit(True)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return nodes


def symbol_context(symbols: DataFrame, docs: DataFrame, examples: DataFrame, keys: list[str], example: str) -> DataFrame:
    """Symbols with the columns of their documentation and the number of their distinct ``examples``."""
    n = examples.groupBy(*keys).agg(F.count_distinct(F.col(example)).alias("examples"))
    return symbols.join(docs, keys, "left").join(n, keys, "left").fillna(0, ["examples"])


def symbols_in_binary(symbols: DataFrame, table: DataFrame, module: str, symbol: str) -> DataFrame:
    """(module, present): each module's symbols that the binary's table has, sorted; modules without one are left out."""
    return members(symbols, table, [symbol]).groupBy(F.col(module).alias("module")).agg(F.array_sort(F.collect_set(symbol)).alias("present"))


def walk_context(walks: DataFrame, targets: DataFrame, modules: DataFrame, walk: str, target: str, module: str, affected: Column) -> DataFrame:
    """Walks with their targets' columns and the numbers of their distinct modules and of those affected."""
    n = modules.groupBy(walk).agg(F.count_distinct(F.col(module)).alias("modules"), F.count_distinct(F.when(affected, F.col(module))).alias("affected"))
    return walks.join(targets, target).join(n, walk, "left").fillna(0, ["modules", "affected"])


def context_size(records: DataFrame, module: str, columns: list[str]) -> DataFrame:
    """(module, records, bytes): the size of each module's records as JSON."""
    size = F.octet_length(F.to_json(F.struct(*columns)))
    return records.groupBy(F.col(module).alias("module")).agg(F.count("*").alias("records"), F.sum(size).alias("bytes"))


def named_like(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose column contains the text in any case; an empty text asks nothing."""
    return df.where(F.lower(column).contains(part.lower())) if part else df


# ---- build lists -----------------------------------------------------------------------------------------


def versions_of_walk(nodes: DataFrame) -> DataFrame:
    """(path, version, selected): every version that nodes (path, version, source, original_path, original_version) name.

    Versions that replacements stand for are known; selected are those of nodes that own an artefact.
    """
    own = nodes.select("path", "version", classify.has_fetched_artefact(F.col("source")).alias("selected"))
    was = nodes.where("original_path IS NOT NULL").select(F.col("original_path").alias("path"), F.col("original_version").alias("version"), F.lit(False).alias("selected"))
    return own.union(was).groupBy("path", "version").agg(F.bool_or("selected").alias("selected"))


def shallow_resolve(requires: DataFrame, path: object, version: object) -> DataFrame:
    """The distinct (path, version) that one module's manifest asks for, from rows (src_path, src_version, path, version)."""
    own = requires.where((F.col("src_path") == F.lit(path)) & (F.col("src_version") == F.lit(version)))
    return own.select("path", "version").distinct()


#: Names in a module graph that are no modules.
PSEUDO_NODES = ("go", "toolchain")


def from_build_list(modules: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a toolchain's build list (path, version, main, replace_path, replace_version) and its graph (src, dst, asked).

    A module replaced by another is a node under the other's name; one replaced by a folder (no
    replace_version) keeps its own. Main modules are no nodes, but ends of edges. Edges between equal
    ends are one, which keeps the least version asked for.
    """
    other = F.col("replace_version").isNotNull()
    named = modules.select(
        F.col("path").alias("own"), "main", F.when(other, F.col("replace_path")).otherwise(F.col("path")).alias("path"),
        F.when(other, F.col("replace_version")).otherwise(F.col("version")).alias("version"),
        F.when(F.col("main"), "main_module").when(F.col("replace_path").isNotNull() & ~other, "local_replace").otherwise("proxy").alias("source"),
    )
    end = lambda side: named.select(F.col("own").alias(side), F.col("path").alias(f"{side}_path"), F.col("version").alias(f"{side}_version"))
    real = edges.where(~F.col("src").isin(*PSEUDO_NODES) & ~F.col("dst").isin(*PSEUDO_NODES))
    both = real.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    both = both.select(
        F.coalesce("src_path", "src").alias("src_path"), "src_version",
        F.coalesce("dst_path", "dst").alias("dst_path"), F.coalesce("dst_version", F.when(F.col("dst_path").isNull(), F.col("asked"))).alias("dst_version"), "asked",
    )
    mapped = both.groupBy("src_path", "src_version", "dst_path", "dst_version").agg(F.min("asked").alias("asked"))
    return named.where("NOT main").select("path", "version", "source"), mapped


# ---- roll-ups ------------------------------------------------------------------------------------------


def generation_groups(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, generations, newest, composed), the newest first: one generation is served as it is, several are composed."""
    g = df.groupBy(*keys).agg(F.count("*").alias("generations"), F.max(at).alias("newest"))
    return g.withColumn("composed", F.col("generations") > 1).orderBy(F.col("newest").desc(), *keys)


def measurements(df: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """(keys, lo, hi, n, last): the range and number of a leg's measurements, and its last ``at``; null values aren't measured."""
    return df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"), F.max(at).alias("last"))


def undetermined(records: DataFrame, expression: str) -> DataFrame:
    """Records whose licence nobody determined: none, or an empty one."""
    return records.where(F.coalesce(F.col(expression), F.lit("")) == "")


def snippet_paths(snippets: DataFrame, keys: list[str], path: str, text: str) -> DataFrame:
    """(keys, paths, conflict): where each snippet stands, and whether its occurrences disagree."""
    return snippets.groupBy(*keys).agg(F.array_sort(F.collect_set(path)).alias("paths"), (F.count_distinct(F.col(text)) > 1).alias("conflict"))


def probe_counters(queries: DataFrame, keys: list[str], covered: Column, finding: Column, reason: Column) -> DataFrame:
    """(keys, queried, covered, with_findings, uncovered): how much a probe covers, and the distinct reasons where it doesn't."""
    why = F.array_sort(F.collect_set(F.when(~covered, reason)))
    return queries.groupBy(*keys).agg(F.count("*").alias("queried"), F.count_if(covered).alias("covered"), F.count_if(finding).alias("with_findings"), why.alias("uncovered"))


def governance_status(packages: DataFrame, keys: list[str], package: str, finding: Column) -> DataFrame:
    """(keys, status, packages): findings or clean, with the distinct packages that were looked at."""
    status = F.when(F.bool_or(F.coalesce(finding, F.lit(False))), "findings").otherwise("clean")
    return packages.groupBy(*keys).agg(status.alias("status"), F.array_sort(F.collect_set(package)).alias("packages"))


def fips_assessments(projects: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, variant, assessment) of projects (toolchain, go_version, fips140) with their findings (kind, package, module).

    Each project is a row; one without findings has none. Kinds: algorithm and cgo-crypto count here.
    """
    of = lambda kind, column: F.array_sort(F.collect_set(F.when((F.col("kind") == kind) & (F.col(column) != ""), F.col(column))))
    g = findings.groupBy(*keys).agg(of("algorithm", "package").alias("_packages"), of("cgo-crypto", "module").alias("_modules"))
    p = projects.withColumn("variant", classify.fips_variant(F.coalesce("toolchain", F.lit("")), F.col("go_version"), F.col("fips140"))).join(g, keys, "left")
    none = F.array().cast("array<string>")
    line = classify.fips_assessment(F.col("variant"), F.col("go_version"), F.col("fips140"), F.coalesce("_packages", none), F.coalesce("_modules", none))
    return p.select(*keys, "variant", line.alias("assessment"))


def extraction_status(results: DataFrame, keys: list[str], cancelled: Column, failed: Column) -> DataFrame:
    """(keys, status): cancelled before partial before succeeded."""
    some = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    return results.groupBy(*keys).agg(F.when(some(cancelled), "cancelled").when(some(failed), "partial").otherwise("succeeded").alias("status"))


def flattened(df: DataFrame, keys: list[str], symbols: str) -> DataFrame:
    """(keys, symbols): the distinct members of a group's lists, sorted; a group whose lists are empty has an empty one."""
    one = df.select(*keys, F.explode_outer(symbols).alias(symbols))
    return one.groupBy(*keys).agg(F.array_sort(F.collect_set(symbols)).alias(symbols))


def offline_failures(failures: DataFrame, known: DataFrame | None, message: str) -> DataFrame:
    """Failed scans with ``reason`` and the missing ``path`` and ``version``, held against the build list's (path, version).

    Refused lookups are judged by whether the list knows what they miss; without a list, and for other failures, the message alone counts.
    """
    f = failures.withColumn("reason", classify.scan_failure(F.col(message))).withColumn("_c", classify.unresolved_coordinate(F.col(message)))
    f = f.withColumn("path", F.col("_c.path")).withColumn("version", F.col("_c.version")).drop("_c")
    if known is None:
        return f
    x = f.join(known.select("path", "version", F.lit(True).alias("_known")).distinct(), ["path", "version"], "left")
    judged = classify.offline_reason(F.lit(True), F.col("path").isNotNull(), F.coalesce("_known", F.lit(False)))
    return x.withColumn("reason", F.when(F.col("reason") == "version-not-in-toolchain", judged).otherwise(F.col("reason"))).drop("_known")
