"""Kinds of intervals and overlaps as SQL expressions that both engines run.

An overlap joins a side of one interval with a side of another; a side is 0 at the prefix and 1 at the suffix, the overlap's
number is 2 * first side + second side, and its code is that bit. Turning an interval round changes its side; seen from the
other interval the sides change places.

Kinds of intervals are 0 alignment, 1 prefix, 2 suffix, 3 prefix and suffix, 4 substring, 5 single deletion, 6 periodic.
"""

from __future__ import annotations

# Names and colours of the kinds.
NAMES = ("alignment", "prefix", "suffix", "prefix and suffix", "substring", "single deletion", "periodic")
COLOURS = ("#808080", "#1f77b4", "#2ca02c", "#17becf", "#ff7f0e", "#9467bd", "#d62728")


def bit_sql(number: str) -> str:
    return f"case {number} when 0 then 1 when 1 then 2 when 2 then 4 else 8 end"


def flipped_sql(number: str, which: int) -> str:
    """Code of an overlap once the first (0), the second (1) or both (2) intervals are turned round."""
    first = f"(case when {number} >= 2 then {int(which == 1)} else {int(which != 1)} end)"
    second = f"(case when {number} % 2 = 1 then {int(which == 0)} else {int(which != 0)} end)"
    return bit_sql(f"(2 * {first} + {second})")


def oriented_sql(kind: str, turn: str) -> str:
    """The kind in a read of the other orientation (turn 1): prefixes are suffixes there."""
    return f"case when {turn} = 1 and {kind} in (1, 2) then 3 - {kind} else {kind} end"


def merged_sql(a: str, b: str) -> str:
    """The kind of two merged intervals: one dense kind takes up those that it is made of; -2 where there is none."""
    low, high = f"least({a}, {b})", f"greatest({a}, {b})"
    return f"case when {a} = {b} then {a} when {low} = 0 or {high} = 6 then -2 when {low} in (1, 2) and {high} >= 3 then {high} when {low} = 3 then {high} when {low} = 4 then 4 else -2 end"


def substring_sql(part: str, whole: str, turn: str) -> str:
    """Whether an interval of one kind can be part of one of the other kind in another read (turn 2: not known). Periodic
    kinds are short-period ones."""
    same = oriented_sql(part, turn)
    return f"case {whole} when 0 then {part} = 0 when 1 then {part} = 0 or {same} = 1 or {turn} = 2 and {part} = 2 when 2 then {part} = 0 or {same} = 2 or {turn} = 2 and {part} = 1 when 3 then {part} <= 3 when 4 then {part} <= 4 when 5 then {part} <= 3 or {part} = 5 else {part} = 6 end"


def label_sql(kind: str) -> str:
    return f"case {kind} " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(NAMES)) + " end"


def colour_sql(kind: str) -> str:
    return f"case {kind} " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(COLOURS)) + " end"
