"""Output of a vulnerability scanner: a stream of JSON messages, read into findings by module, in batch and as a stream.

A scan is a file of messages one after the other, each printed over many lines or on one. A message is an
advisory (``osv``), a finding, or one of the kinds that are only counted here (config, progress, SBOM).
A finding says at one of three levels that a module is hit: its trace starts at a function (symbol), has
nothing but package initialisers (init), or names a module or package alone (module). Advisories may come
after the findings that name them, and the levels of one advisory come in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = "struct<module:string,version:string,package:string,function:string,receiver:string>"
OSV = "struct<id:string,aliases:array<string>,summary:string,withdrawn:string,affected:array<struct<package:struct<name:string>,ecosystem_specific:struct<imports:array<struct<symbols:array<string>>>>>>>"
MESSAGE = f"config string, progress string, SBOM string, osv {OSV}, finding struct<osv:string,fixed_version:string,trace:array<{FRAME}>>, _broken string"

#: The pseudo-module of the standard library, and what the compiler names a package's initialisers.
STDLIB = "stdlib"
INITIALISER = r"^init([#.][0-9]+)?$"


def framed(lines: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """(keys, seq, raw): the messages of each scan, from its lines in the order of ``order``.

    A message starts at a line whose first character is an opening brace; what stands before the first is a
    message of its own, so that it is seen to be none. Blank lines outside messages don't matter.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    x = lines.where(F.trim(line) != "").withColumn("seq", F.count_if(F.col(line).startswith("{")).over(w))
    raw = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda r: r[line]), "\n")
    return x.groupBy(*keys, "seq").agg(raw.alias("raw"))


def read_messages(messages: DataFrame) -> DataFrame:
    """``messages`` (keys, seq, raw) with kind (osv, finding, other; fault for what is no whole message), osv and finding."""
    m = F.from_json("raw", MESSAGE, {"columnNameOfCorruptRecord": "_broken"})
    x = messages.withColumn("_m", m)
    broken = F.col("_m").isNull() | F.col("_m._broken").isNotNull()
    kind = F.when(broken, "fault").when(F.col("_m.finding").isNotNull(), "finding").when(F.col("_m.osv").isNotNull(), "osv").otherwise("other")
    return x.select(*messages.columns, kind.alias("kind"), F.when(kind == "osv", F.col("_m.osv")).alias("osv"), F.when(kind == "finding", F.col("_m.finding")).alias("finding"))


def gathered(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, osv, reports): all that a scan says of each advisory; one aggregation, in batch as in a stream.

    reports are the findings' usable messages in order; those without an advisory's id or a trace aren't.
    """
    f = F.col("finding")
    usable = (F.col("kind") == "finding") & (F.coalesce(f["osv"], F.lit("")) != "") & (F.coalesce(F.size(f["trace"]), F.lit(0)) > 0)
    named = messages.where(usable | ((F.col("kind") == "osv") & F.col("osv.id").isNotNull()))
    report = F.when(F.col("kind") == "finding", F.struct("seq", "finding"))
    last = F.max_by("osv", F.when(F.col("kind") == "osv", F.col("seq")))
    return named.groupBy(*keys, F.coalesce("finding.osv", "osv.id").alias("id")).agg(last.alias("osv"), F.sort_array(F.collect_list(report)).alias("reports"))


def _first_said(reports: Column) -> Column:
    stated = F.filter(F.transform(reports, lambda r: r["finding"]["fixed_version"]), lambda v: v != "")
    return F.get(stated, F.lit(0))


def settled(gathered_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, module, version, id, fixed_in, reachable, confidence, symbols, names_no_symbols, routes, summary, aliases, withdrawn).

    A row for each module that owns a vulnerable frame of an advisory. Standard-library frames of any version
    are one module without one; frames that name no module or no version are left out. reachable: a trace
    reached a symbol. confidence: High for that, and where a module-level report stands and none of package
    initialisers alone; else Unknown. symbols: those reached, in order; where none was, the advisory's own for
    this module. names_no_symbols: the advisory names the module without any. routes run from the entry point.
    An advisory whose message never came leaves its facts null. Each row is settled from its own arrays, so a
    stream can do it behind its aggregation.
    """
    owner = lambda r: r["finding"]["trace"][0]
    module = lambda r: F.struct(F.coalesce(owner(r)["module"], F.lit("")).alias("module"), F.when(owner(r)["module"] == STDLIB, "").otherwise(F.coalesce(owner(r)["version"], F.lit(""))).alias("version"))
    usable = lambda m: (m["module"] == STDLIB) | ((m["module"] != "") & (m["version"] != ""))
    x = gathered_.withColumn("_of", F.explode(F.array_distinct(F.filter(F.transform("reports", module), usable))))
    x = x.withColumn("_r", F.filter("reports", lambda r: module(r) == F.col("_of")))
    symbolic = lambda r: F.coalesce(owner(r)["function"], F.lit("")) != ""
    init = lambda r: symbolic(r) & F.forall(r["finding"]["trace"], lambda f: F.coalesce(f["function"], F.lit("")).rlike(INITIALISER))
    reached = F.filter("_r", lambda r: symbolic(r) & ~init(r))
    x = x.withColumn("_reached", reached)
    high = (F.size("_reached") > 0) | (F.exists("_r", lambda r: ~symbolic(r)) & ~F.exists("_r", init))
    symbol = lambda r: F.when(F.coalesce(owner(r)["receiver"], F.lit("")) != "", F.concat(owner(r)["receiver"], F.lit("."), owner(r)["function"])).otherwise(owner(r)["function"])
    about = F.filter("osv.affected", lambda a: a["package"]["name"] == F.col("_of.module"))
    named = F.flatten(F.transform(about, lambda a: F.flatten(F.transform(F.coalesce(a["ecosystem_specific"]["imports"], F.array()), lambda i: F.coalesce(i["symbols"], F.array().cast("array<string>"))))))
    x = x.withColumn("_named", F.array_sort(F.array_distinct(named))).withColumn("_about", F.coalesce(F.size(about), F.lit(0)) > 0)
    own = F.array_distinct(F.transform("_reached", symbol))
    symbols = F.when(F.size(own) > 0, own).when(F.col("_about"), F.col("_named")).otherwise(F.array().cast("array<string>"))
    return x.select(
        *keys, "_of.module", "_of.version", "id", _first_said(F.col("_r")).alias("fixed_in"), (F.size("_reached") > 0).alias("reachable"), F.when(high, "High").otherwise("Unknown").alias("confidence"),
        symbols.alias("symbols"), (F.col("_about") & (F.size("_named") == 0)).alias("names_no_symbols"), F.transform("_reached", lambda r: F.reverse(r["finding"]["trace"])).alias("routes"),
        "osv.summary", "osv.aliases", "osv.withdrawn",
    )


def findings(messages: DataFrame, keys: list[str]) -> DataFrame:
    """The settled findings of read messages, with ``complete``: false for a scan in which a message is a fault.

    A scan that was cut short has seen less than there is, so its findings are no clean verdict on the rest.
    """
    faults = messages.where("kind = 'fault'").select(*keys).distinct().withColumn("_cut", F.lit(True))
    return settled(gathered(messages, keys), keys).join(faults, keys, "left").withColumn("complete", F.col("_cut").isNull()).drop("_cut")


def of_module(findings_: DataFrame, module: str) -> DataFrame:
    """What belongs to the scanned module's own record: its findings and those of the standard library."""
    return findings_.where(F.col("module").isin(module, STDLIB))


def scan_verdicts(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, messages, advisories, reports, faults) of every scan, findings or none."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return messages.groupBy(*keys).agg(F.count("*").alias("messages"), n("osv").alias("advisories"), n("finding").alias("reports"), n("fault").alias("faults"))
