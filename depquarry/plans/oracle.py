"""DuckDB expressions that the oracles share, written apart from the Spark ones."""

from __future__ import annotations

_N = "(?:0|[1-9][0-9]*)"
_P = f"(?:{_N}|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
VALID = f"^v({_N})(?:\\.({_N})(?:\\.({_N})(?:-({_P}(?:\\.{_P})*))?(?:\\+([0-9A-Za-z-]+(?:\\.[0-9A-Za-z-]+)*))?)?)?$"


def valid(v: str) -> str:
    return f"regexp_matches({v}, '{VALID}')"


def key(v: str) -> str:
    """A version's sort key; null for none."""
    g = lambda i: f"regexp_extract({v}, '{VALID}', {i})"
    n = lambda i: f"CASE WHEN {g(i)} = '' THEN '0' ELSE {g(i)} END"
    nums = ", ".join(f"'l{i}': length({n(i)}), 't{i}': {n(i)}" for i in (1, 2, 3))
    pre = f"list_transform(list_filter(string_split({g(4)}, '.'), lambda x: x <> ''), lambda x: {{'k': CASE WHEN regexp_matches(x, '^[0-9]+$') THEN 0 ELSE 1 END, 'l': CASE WHEN regexp_matches(x, '^[0-9]+$') THEN length(x) ELSE 0 END, 't': x}})"
    return f"CASE WHEN {valid(v)} THEN {{{nums}, 'r': CASE WHEN {g(4)} = '' THEN 1 ELSE 0 END, 'p': {pre}}} END"


def prefixed(v: str) -> str:
    return f"CASE WHEN {v} = '' OR starts_with({v}, 'v') THEN {v} ELSE 'v' || {v} END"
