"""Rendering of literals, identifiers and CASE expressions as SQL text.

The same text runs in Spark SQL and in other warehouses: numbers are printed
in E-notation (a bare ``0.1`` is a DECIMAL), plain identifiers stay unquoted.
"""

from __future__ import annotations

import re

from glasswork.models import Cell

_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
QUOTE = {"spark": "`", "ansi": '"'}
# Above this many bins a chain of WHEN branches becomes a balanced tree.
FLAT_LIMIT = 32
# Above this many bins Spark searches an array of bounds instead; other warehouses keep the tree.
SEARCH_LIMIT = 512
# The same for categories, whose comparisons make longer code.
SEARCH_CATEGORIES = 64


def ident(name: str, dialect: str = "spark") -> str:
    if _PLAIN.match(name):
        return name
    q = QUOTE[dialect]
    return q + name.replace(q, q + q) + q


def alias(name: str) -> str:
    """Output column names are made plain, so no dialect needs to quote them."""
    clean = re.sub(r"[^A-Za-z0-9_]", "_", str(name))
    return clean if _PLAIN.match(clean) else "_" + clean


def number(value: float) -> str:
    value = float(value)
    if value != value or value in (float("inf"), float("-inf")):
        raise ValueError(f"cannot render {value} as a SQL literal")
    text = repr(value)
    return text if "e" in text else text + "E0"


def string(value: str) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def label(value) -> str:
    return str(value) if isinstance(value, int) and not isinstance(value, bool) else string(value)


def case_axis(column: str, cells: tuple[Cell, ...], values: list[str], default: str) -> str:
    """CASE over one axis: missing bin first, then categories or intervals.

    ``values[i]`` is the SQL text of cell ``i``. Intervals are right-closed.
    An empty axis, an unseen category and a null without a missing bin all
    give ``default``.
    """
    null_value = next((v for c, v in zip(cells, values) if c.is_null), default)
    cats = [(c, v) for c, v in zip(cells, values) if c.category is not None]
    bins = [(c, v) for c, v in zip(cells, values) if not c.is_null and c.category is None]
    head = f"CASE WHEN {column} IS NULL THEN {null_value}"
    if cats:
        branches = "".join(f" WHEN {column} = {string(c.category)} THEN {v}" for c, v in cats)
        return f"{head}{branches} ELSE {default} END"
    if not bins:
        return f"{head} ELSE {default} END"
    if len(bins) == 1:
        return f"{head} ELSE {bins[0][1]} END"
    if len(bins) <= FLAT_LIMIT:
        branches = "".join(f" WHEN {column} <= {number(c.hi)} THEN {v}" for c, v in bins[:-1])
        return f"{head}{branches} ELSE {bins[-1][1]} END"
    return f"{head} ELSE {_balanced(column, bins)} END"


def _balanced(column: str, bins) -> str:
    if len(bins) == 1:
        return bins[0][1]
    middle = len(bins) // 2
    left, right = bins[:middle], bins[middle:]
    return (
        f"CASE WHEN {column} <= {number(left[-1][0].hi)} "
        f"THEN {_balanced(column, left)} ELSE {_balanced(column, right)} END"
    )


def doubles(values) -> str:
    """Spark text of an array of numbers; one literal that is folded once, however long."""
    return f"cast(split('{','.join(repr(float(v)) for v in values)}', ',') AS array<double>)"


def whole_numbers(values) -> str:
    """Spark text of an array of integers."""
    return f"cast(split('{','.join(map(str, values))}', ',') AS array<int>)"


def search(value: str, bounds: str, size: int) -> str:
    """Spark text: how many of the ``size`` ascending entries of an array lie strictly below a value, by halving.

    NaN is above every bound; a null gives 0.
    """
    steps = [1 << b for b in reversed(range(max(size, 1).bit_length()))]
    return (f"aggregate(array({', '.join(map(str, steps))}), 0, (at, step) -> "
            f"if(coalesce(get({bounds}, at + step - 1) < {value}, false), at + step, at))")


def strings(values) -> str:
    """Spark text of an array of strings, whatever they hold; one literal that is folded once."""
    values = list(values)
    apart = next(chr(c) for c in range(1, 32) if not any(chr(c) in v for v in values)) if len(values) < 10_000 else "\x01"
    if any(apart in v for v in values):
        return f"array({', '.join(map(string, values))})"
    return f"split(decode(unhex('{apart.join(values).encode().hex()}'), 'UTF-8'), char({ord(apart)}))"


def searched_axis(column: str, cells: tuple[Cell, ...], value, null_value: str, default: str) -> str | None:
    """Spark text of a wide axis, None where a CASE will do.

    ``value`` turns the text of a 0-based place among the intervals, or among
    the categories in order, into the result's; ``default`` is for no category.
    """
    bins = [c for c in cells if not c.is_null and c.category is None]
    names = sorted(c.category for c in cells if c.category is not None)
    if len(bins) > SEARCH_LIMIT and not names:
        place = search(f"cast({column} AS double)", doubles(c.hi for c in bins[:-1]), len(bins) - 1)
        found = value("i")
    elif len(names) > SEARCH_CATEGORIES:
        text = f"cast({column} AS string)"
        place = search(text, strings(names), len(names))
        found = f"if(coalesce(get({strings(names)}, i) = {text}, false), {value('i')}, {default})"
    else:
        return None
    return f"CASE WHEN {column} IS NULL THEN {null_value} ELSE transform(array({place}), i -> {found})[0] END"
