"""Conversation structure repair: the cheapest edits that give turns of user and assistant, by a backward DP and a forward walk.

A conversation's role initials shall read ``(s?(ua)+)?``. Edits: Keep costs 0, Rerole to user or assistant
1, Delete 2, Insert an empty turn of user or assistant 5; a truncated row that isn't deleted costs 5 more,
blank and duplicate rows have to go. The states of the grammar are 0 (nothing yet), 1 (after the system
turn), 2 (after user) and 3 (after assistant); a conversation may end in 0 and 3. Going backward, every
row gets the cost to go from each state. Going forward, the first in the alphabet of the edits by which
the cost to go is met is taken; state and letter name the edit's role, so the letters are the repair.

Only a skeleton of the rows goes through this: role, 32-byte names of row and content, and a letter. It is
cut into ranges of conversation and turn, so a long conversation is many segments. For those that meet in
one conversation, each segment's costs between its four states (a min-plus matrix) are put together to what
follows each, then the states in which each segment is left to those in which it is entered. The texts are
joined to the edits by the rows' names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depquarry.llm.common import checkpoint_root, shuffle_partitions, sliced, written

#: Rows of a range, about.
RANGE_ROWS = 50_000

NEVER = 1 << 40
STATES = range(4)
#: What a turn of this initial leads to from each state.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: What a turn of user or assistant leads to, whichever the state asks for.
FREE = STEPS["u"] | STEPS["a"]
NAMES = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
#: The cost to go behind the last row.
END = [0, 10, 5, 0]

ROW = "struct<turn:bigint,role:string,content:binary,kind:string,n:bigint,rid:binary>"


def blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def truncated(text: Column) -> Column:
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def sized(text: Column) -> Column:
    """The text with its length before it, so that no two lists of them read alike."""
    return F.concat(F.char_length(text).cast("string"), F.lit(":"), text)


def named_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, content, rid): content names role and text within the conversation, rid the whole row."""
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    c = c.withColumn("content", F.unhex(F.sha2(F.concat(sized(F.col("role")), "text"), 256)))
    of = F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.coalesce(F.col("turn").cast("string"), F.lit("-")))
    return c.withColumn("rid", F.unhex(F.sha2(F.concat(sized(of).cast("binary"), "content"), 256)))


def skeleton(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content, rid, n, kind): equal rows once, with their number and the first one's fault.

    kind is b (blank), d (duplicate: role and text stand in an earlier row), t (truncated) or k.
    """
    fault = F.when(blank(F.col("text")), "b").when(truncated(F.col("text")), "t").otherwise("k")
    of = rows.select("conv_id", "turn", "role", "content", "rid", fault.alias("kind"))
    once = of.groupBy("rid").agg(*[F.first(c).alias(c) for c in ("conv_id", "turn", "role", "content", "kind")], F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = of.groupBy("conv_id", "content").agg(F.min(place).alias("first"))
    both = once.alias("o").join(firsts.alias("f"), F.col("o.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("o.content") == F.col("f.content")))
    later = ~F.col("f.first.turn").eqNullSafe(F.col("o.turn"))
    kind = F.when((F.col("o.kind") != "b") & later, "d").otherwise(F.col("o.kind"))
    return both.select("o.conv_id", "o.turn", "o.role", "o.content", "o.rid", "o.n", kind.alias("kind"))


def moves(row: dict) -> list[tuple[str, int, dict[int, int] | None]]:
    """(edit, cost, where it leads) of a row's first copy, in the order of the edits' letters; None: the state stays."""
    if row["kind"] in "bd":
        return [("D", 2, None)]
    more = 5 * (row["kind"] == "t")
    return [("D", 2, None), ("K", more, STEPS.get(row["role"][:1], {})), ("R", 1 + more, FREE)]


def with_inserts(costs: list[int]) -> list[int]:
    """Costs to go when turns may be inserted first."""
    out = list(costs)
    for _ in range(2):
        out = [min(v, 5 + out[FREE[s]]) for s, v in enumerate(out)]
    return out


def to_go(rows: list[dict], end: list[int]) -> list[list[int]]:
    """The cost to go before each row, and behind the last, from each state."""
    out = [end]
    for row in reversed(rows):
        after, options = out[-1], moves(row)
        best = [min(c + (after[s] if to is None else after[to[s]] if s in to else NEVER) for _, c, to in options) for s in STATES]
        again = 2 * (row["n"] - 1)  # its other copies go
        out.append(with_inserts([v + again for v in best]))
    return out[::-1]


def walk(rows: list[dict], costs: list[list[int]], state: int, last: bool) -> tuple[list[tuple[str, str | None, bytes | None]], int, int]:
    """([(edit, role, rid)], cost, the state it is left in), entered in ``state``; ``last``: the conversation ends here."""
    out, cost = [], 0

    def insert() -> None:
        nonlocal state, cost
        state, cost = FREE[state], cost + 5
        out.append(("I", NAMES[state], None))

    for row, here, after in zip(rows, costs, costs[1:], strict=False):
        again = 2 * (row["n"] - 1)
        options = [("I", 5, None), *moves(row)]
        options.sort(key=lambda x: x[0])
        while True:
            for edit, c, to in options:
                if edit == "I":
                    tight = here[state] == 5 + here[FREE[state]]
                else:
                    tight = (to is None or state in to) and here[state] == c + again + after[state if to is None else to[state]]
                if tight:
                    break
            else:
                raise AssertionError("no edit meets the cost to go")
            if edit != "I":
                break
            insert()
        if to is not None:
            state = to[state]
        out.append((edit, NAMES[state] if edit == "R" else row["role"], row["rid"]))
        out += [("D", row["role"], row["rid"])] * (row["n"] - 1)
        cost += c + again
    while last and END[state]:
        insert()
    return out, cost, state


def per_segment(frame: DataFrame, schema: str, work) -> DataFrame:
    """``work`` of each row of ``frame``, as a dict, gives a dict of what ``schema`` names."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in sliced(batches, 100):
            made = [work(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[n] for m in made], t) for n, t in zip(names, kinds, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    empty = frame.sparkSession.createDataFrame([], schema)
    kinds = [to_arrow_type(f.dataType) for f in empty.schema]
    return frame.mapInArrow(run, schema)


def ends_of(rows: DataFrame, conv: str) -> DataFrame:
    """(conv_id, seg, end, before, last) of the segments (conv_id, seg, rows) of each conversation that has several.

    end: the costs to go behind a segment; before: the last initial before it.
    """

    def matrix(r):
        cols = [to_go(r["rows"], [0 if s == t else NEVER for s in STATES])[0] for t in STATES]
        return {"conv_id": r["conv_id"], "seg": r["seg"], "costs": [cols[t][s] for s in STATES for t in STATES], "final": r["rows"][-1]["role"][:1]}

    def chained(r):
        out, end, parts = [], END, r["parts"]
        for i in range(len(parts) - 1, -1, -1):
            out.append({"seg": parts[i]["seg"], "end": end, "before": parts[i - 1]["final"] if i else None, "last": i == len(parts) - 1})
            m = parts[i]["costs"]
            end = [min(m[4 * s + t] + end[t] for t in STATES) for s in STATES]
        return {"conv_id": r["conv_id"], "out": out}

    parts = per_segment(rows, f"conv_id {conv}, seg int, costs array<bigint>, final string", matrix)
    parts = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "costs", "final"))).alias("parts"))
    out = per_segment(parts, f"conv_id {conv}, out array<struct<seg:int,end:array<bigint>,before:string,last:boolean>>", chained)
    return out.select("conv_id", F.inline("out"))


def entries_of(rows: DataFrame, conv: str) -> DataFrame:
    """(conv_id, seg, entry): the state in which each of the segments (conv_id, seg, rows, end, last) is entered."""

    def exits(r):
        costs = to_go(r["rows"], r["end"])
        return {"conv_id": r["conv_id"], "seg": r["seg"], "exits": [walk(r["rows"], costs, s, r["last"])[2] for s in STATES]}

    def chained(r):
        out, state = [], 0
        for x in r["parts"]:
            out.append({"seg": x["seg"], "entry": state})
            state = x["exits"][state]
        return {"conv_id": r["conv_id"], "out": out}

    parts = per_segment(rows, f"conv_id {conv}, seg int, exits array<int>", exits)
    parts = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "exits"))).alias("parts"))
    return per_segment(parts, f"conv_id {conv}, out array<struct<seg:int,entry:int>>", chained).select("conv_id", F.inline("out"))


SOLVED = "seg int, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits array<struct<edit:string,role:string,rid:binary>>"


def solved_segment(r: dict) -> dict:
    rows, before = r["rows"], r["before"]
    costs = to_go(rows, r["end"])
    edits, cost, _ = walk(rows, costs, r["entry"], r["last"])
    count = lambda k: sum(x["n"] for x in rows if x["kind"] == k)
    again = sum(x["n"] - 1 for x in rows if x["kind"] in "kt")
    initials = [x["role"][:1] for x in rows]
    pairs = zip([before] * (before is not None) + initials, initials[before is None :], strict=False)
    illegal = sum(a + b not in LEGAL for a, b in pairs) + sum(x["n"] - 1 for x in rows)
    return {"conv_id": r["conv_id"], "seg": r["seg"], "blank": count("b"), "duplicate": count("d") + again, "truncated": sum(x["kind"] == "t" for x in rows), "illegal": illegal, "cost": cost,
            "audit": "".join(e for e, _, _ in edits), "edits": [{"edit": e, "role": role, "rid": rid} for e, role, rid in edits]}


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong in ``conversations`` (conv_id, turn, role, text, any others), and its repair.

    Returns two tables. A row per conversation: conv_id, gaps (turns missing between the least and the greatest),
    blank, duplicate, truncated (rows whose first fault this is), illegal (neighbours whose initials are not su,
    ua or au), cost, audit (the edits' letters). A row per edit: conv_id, seg, pos (in this order), edit, role,
    text; deleted rows with what they said, inserted ones with an empty text.

    Rows are taken by turn, nulls first, those of one turn by role, then by the SHA-256 of role and text; repeated
    rows are duplicates. Null roles and texts count as one space. Rows of a null conv_id are one conversation. Other
    columns are not read, and an empty table gives empty ones. A long conversation is repaired by segments.
    """
    spark = conversations.sparkSession
    checkpoint_root(spark)
    conv = conversations.schema["conv_id"].dataType.simpleString()
    rows = named_rows(conversations)
    bones = written(skeleton(rows), "repair-skeleton")
    ranges = max(shuffle_partitions(spark), bones.count() // RANGE_ROWS + 1)
    cut = bones.repartitionByRange(ranges, "conv_id", "turn", "role", "content").withColumn("seg", F.spark_partition_id())
    row = F.struct("turn", "role", "content", "kind", "n", "rid")
    segments = written(cut.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(row)).alias("rows")), "repair-segments")

    many = segments.groupBy("conv_id").agg(F.count("*").alias("segs")).where("segs > 1")
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    here = lambda a, b: same(a, b) & (F.col(f"{a}.seg") == F.col(f"{b}.seg"))
    split = segments.alias("x").join(many.alias("y"), same("x", "y"), "left_semi")
    ends = written(ends_of(split, conv), "repair-ends")
    entries = entries_of(segments.alias("x").join(ends.alias("y"), here("x", "y")).select("x.*", "y.end", "y.last"), conv)
    known = written(ends.alias("x").join(entries.alias("y"), here("x", "y")).select("x.*", "y.entry"), "repair-entries")
    alone = [F.coalesce("y.end", F.array(*[F.lit(v).cast("long") for v in END])).alias("end"), F.col("y.before").alias("before"), F.coalesce("y.last", F.lit(True)).alias("last"), F.coalesce("y.entry", F.lit(0)).alias("entry")]
    whole = segments.alias("x").join(known.alias("y"), here("x", "y"), "left").select("x.*", *alone)
    solved = written(per_segment(whole, f"conv_id {conv}, {SOLVED}", solved_segment), "repair-solved")

    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda x: x.audit), "")
    told = solved.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts], audit.alias("audit"))
    gaps = bones.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    report = told.alias("x").join(gaps.alias("y"), same("x", "y")).select("x.conv_id", "y.gaps", *counts, "audit")

    texts = rows.groupBy("rid").agg(F.first("text").alias("text"))
    edits = solved.select("conv_id", "seg", F.posexplode("edits").alias("pos", "e")).select("conv_id", "seg", "pos", "e.edit", "e.role", "e.rid")
    turns = edits.where("rid is not null").join(texts, "rid").drop("rid").unionByName(edits.where("rid is null").drop("rid").withColumn("text", F.lit("")))
    return report, turns


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by the crc32 of ``conv_id:turn``: rows dropped, emptied, cut off, repeated, given to the user.

    Nulls count as one space, in the sum as in role and text; turn and conv_id stay null.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    c = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), fault.alias("fault")).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return c.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("col")


def digest(conversations: DataFrame, report: DataFrame, turns: DataFrame) -> DataFrame:
    """``report`` with a row for every conv_id of ``conversations`` and the SHA-256 of the repaired ``role:text`` lines."""
    kept = turns.where("edit != 'D'").select("conv_id", F.struct("seg", "pos", F.concat("role", F.lit(":"), "text").alias("line")).alias("at"))
    lines = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("at"))
    lines = lines.select("conv_id", F.sha2(F.array_join(F.transform("at", lambda x: x.line), "\n").cast("binary"), 256).alias("sha"))
    ids = conversations.select("conv_id").distinct()
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    out = ids.alias("i").join(report.alias("r"), same("i", "r"), "left").join(lines.alias("l"), same("i", "l"), "left")
    zeros = [F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("i.conv_id", *zeros, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("l.sha", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
