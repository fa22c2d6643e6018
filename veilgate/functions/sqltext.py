"""Literals and names for SQL expression strings.

Wide expressions are written as SQL text: one call parses what would take hundreds of calls
from Python to the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def text(value: str) -> str:
    """A string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def raw(pattern: str) -> str:
    """A raw string literal for a regular expression."""
    if "'" in pattern:
        return text(pattern)
    return f"r'{pattern}'"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def texts(values: Iterable[str]) -> str:
    return ", ".join(text(v) for v in values)


def literal(value) -> str:
    return text(value) if isinstance(value, str) else f"{value!r}D"


def lookup(key: str, values: Mapping, default) -> str:
    """One flat CASE over the keys whose value differs from the default."""
    cases = [
        f"WHEN {text(k)} THEN {literal(v)}" for k, v in values.items() if v != default
    ]
    return f"CASE {key} {' '.join(cases)} ELSE {literal(default)} END" if cases else literal(default)


def empty(element: str) -> str:
    return f"CAST(array() AS array<{element}>)"


def let(value: str, variable: str, body: str) -> str:
    """``body`` with ``variable`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {variable} -> {body}), 1)"


def gather(items: str, state: str, element: str, step: str, final: str, block: int = 128) -> str:
    """A fold over an array that also emits elements, in time that grows with the array, not its square.

    ``step`` maps ``run`` (``run.state``, ``run.out``) and ``x`` to the next ``run``; ``out`` only ever holds
    the elements of one block of items, finished blocks are put aside. ``final`` sees ``whole.state`` and
    ``whole.parts`` (one array per block). ``items`` should be a column or variable, since it is named twice.
    """
    inner = (
        f"aggregate(slice({items}, number * {block} + 1, {block}), "
        f"named_struct('state', whole.state, 'out', {empty(element)}), (run, x) -> {step})"
    )
    done = "named_struct('state', part.state, 'parts', concat(whole.parts, array(part.out)))"
    return (
        f"aggregate(sequence(0, greatest(size({items}) - 1, 0) div {block}), "
        f"named_struct('state', {state}, 'parts', CAST(array() AS array<array<{element}>>)), "
        f"(whole, number) -> {let(inner, 'part', done)}, whole -> {final})"
    )
