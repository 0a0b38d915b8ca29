import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from depquarry.llm import chatrepair
from depquarry.llm.queries import op12_conversation_repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """The first fault of each (role, text), or None."""
    seen, out = set(), []
    for role, text in rows:
        shown = text.strip(" \t\n\v\f\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def exhaustive(rows):
    """(cost, audit, lines) by trying all edits, with up to two turns inserted in each place."""
    best = None
    for inserts in itertools.product([(), ("u",), ("a",), ("u", "a"), ("a", "u")], repeat=len(rows) + 1):
        for edits in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for f in faults(rows)]):
            cost, audit, initials, lines = 0, "", "", []
            for i in range(len(rows) + 1):
                for x in inserts[i]:
                    cost, audit, initials = cost + 5, audit + "I", initials + x
                    lines.append({"u": "user:", "a": "assistant:"}[x])
                if i < len(rows):
                    e, (role, text) = edits[i], rows[i]
                    audit += e[0]
                    cost += {"K": 0, "D": 2, "R": 1}[e[0]] + 5 * (faults(rows)[i] == "truncated" and e != "D")
                    if e != "D":
                        role = {"Ru": "user", "Ra": "assistant"}.get(e, role)
                        initials += role[:1] or "?"
                        lines.append(f"{role}:{text}")
            if GRAMMAR.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def by_suffixes(rows):
    """The same for longer conversations: the least (cost, audit) of every suffix, as whole strings."""
    fault = faults(rows)
    free = {0: 2, 1: 2, 2: 3, 3: 2}
    steps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    name = {2: "user", 3: "assistant"}

    @cache
    def best(i, state, inserts):
        out = []
        if inserts < 2:
            c, audit, lines = best(i, free[state], inserts + 1)
            out.append((c + 5, "I" + audit, (name[free[state]] + ":", lines)))
        if i == len(rows):
            if state in (0, 3):
                out.append((0, "", None))
        else:
            role, text = rows[i]
            c, audit, lines = best(i + 1, state, 0)
            out.append((c + 2, "D" + audit, lines))
            if fault[i] not in ("blank", "duplicate"):
                more = 5 * (fault[i] == "truncated")
                for e, to, says in (("K", steps.get(role[:1], {}).get(state), role), ("R", free[state], name[free[state]])):
                    if to is not None:
                        c, audit, lines = best(i + 1, to, 0)
                        out.append((c + more + (e == "R"), e + audit, (f"{says}:{text}", lines)))
        return min(out, key=lambda x: x[:2], default=(10**9, "~", None))

    for i in range(len(rows), -1, -1):  # not deeper than a row
        for k in (2, 1, 0):
            for s in range(4):
                best(i, s, k)
    cost, audit, lines = best(0, 0, 0)
    out = []
    while lines:
        out.append(lines[0])
        lines = lines[1]
    return cost, audit, out


def want(rows, solve):
    """rows: (turn, role, text) of a conversation, in order."""
    said = [r[1:] for r in rows]
    f = faults(said)
    cost, audit, lines = solve(said)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
    return gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if x == 1:
            text = ""
        elif x == 2:
            text = re.sub("[.!?]", "", text)
        elif x == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (x != 0) * (1 + (x == 3))
    return out


def in_order(rows):
    content = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], content(r[1], r[2])))


def plain(df):
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return {r["conv_id"]: tuple(r[n] for n in names[1:]) for r in df.select(names).collect()}


def repaired(spark, rows):
    c = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, seg string")
    return plain(chatrepair.digest(c, *chatrepair.repair(c)))


def grouped(rows, solve):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(" " if x is None and i else x for i, x in enumerate(r[1:])))
    return {k: want(in_order(v), solve) for k, v in out.items()}


def test_query_against_suffixes(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows} | grouped(damaged(rows), by_suffixes)
    assert plain(op12_conversation_repair(spark, small)) == expected


def test_all_edits_of_short_conversations(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(["a.", "b!", "c", "d?", " ", "e. \n"])) for c in range(60) for t in range(rng.randrange(1, 4))]
    assert repaired(spark, rows) == grouped(rows, exhaustive) == grouped(rows, by_suffixes)


def test_nulls_ties_repeats_and_conversations_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(chatrepair, "RANGE_ROWS", 20)
    rng = random.Random(9)
    roles, texts = ["system", "user", "assistant", None, "agent"], ["yes.", "no.", "cut", None, "", "　", "x" * 50_000 + "."]
    rows = []
    for c, n in ((None, 25), (1, 400), (2, 1), (3, 7), (-4, 60)):
        for _ in range(n):
            t = rng.choice([None, rng.randrange(n)])
            rows.append((c, t, rng.choice(roles), rng.choice([*texts, f"{rng.random()}.", f"{rng.random()}"])))
    rows += [rows[40]] * 30 + [(5, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(200)]
    got = repaired(spark, rows)
    assert got == grouped(rows, by_suffixes)
    assert got[5][5:7] == (4, "D" + "K" * 198 + "D")


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, turns = chatrepair.repair(none)
    assert report.count() == turns.count() == chatrepair.digest(none, report, turns).count() == 0
