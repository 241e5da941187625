"""Cleaning: detection flags in one aggregate, then lazy projections and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswork.operators.profile import BOOLEANS, NUMBER, as_number, as_timestamp, is_floating, is_integral

# Strings that mean null, money text, and the numeric share that makes a column mixed.
NULL_STRINGS = ("nan", "null", "none")
MONEY = r"^([$£€¥]+\s?)?([0-9,. ]+)([a-zA-Z]+)"
SPACED = r"^[0-9,. ]*$"
MIXED_SHARE = 0.25


def _strings(df: DataFrame, columns=None) -> list[str]:
    kinds = dict(df.dtypes)
    return [c for c in (columns or df.columns) if kinds[c] == "string"]


def _spaced(v: Column) -> Column:
    return v.rlike(SPACED) & v.rlike("[0-9]") & v.contains(" ")


def _nullable(v: Column) -> Column:
    return F.lower(F.trim(v)).isin(*NULL_STRINGS)


def detect(df: DataFrame, columns=None) -> dict[str, dict[str, bool]]:
    """Which rules apply to each string column; one pass, one collected row.

    Null strings are disregarded, as they are removed before the other rules.
    """
    kinds = dict(df.dtypes)
    dates = [c for c in (columns or df.columns) if kinds[c] in ("timestamp", "timestamp_ntz", "date")]
    columns = _strings(df, columns)
    if not columns and not dates:
        return {}
    flags = [F.bool_and(F.col(c).isNotNull()).alias(f"{c}|whole") for c in dates]
    for c in columns:
        v = F.when(~_nullable(F.col(c)), F.col(c))
        number = v.rlike(NUMBER)
        flags += [
            F.bool_or(_spaced(v)).alias(f"{c}|spaced"),
            F.bool_or(_nullable(F.col(c))).alias(f"{c}|null_strings"),
            F.count(v).alias(f"{c}|values"),
            F.count_if(number).alias(f"{c}|numbers"),
            F.bool_and(v.isin(*BOOLEANS)).alias(f"{c}|boolean"),
            F.bool_or(v.rlike(MONEY)).alias(f"{c}|money"),
            F.bool_and(as_timestamp(v).isNotNull()).alias(f"{c}|date"),
        ]
    row = df.agg(*flags).first()
    rules = ("spaced", "null_strings", "mixed", "text_left", "boolean", "money")
    out = {c: dict.fromkeys(rules, False) | {"date": bool(row[f"{c}|whole"])} for c in dates}
    for c in columns:
        values, numbers = row[f"{c}|values"], row[f"{c}|numbers"]
        mixed = numbers > 0 and numbers / values >= MIXED_SHARE
        out[c] = {
            "spaced": bool(row[f"{c}|spaced"]),
            "null_strings": bool(row[f"{c}|null_strings"]),
            "mixed": mixed,
            "text_left": mixed and numbers < values,
            "boolean": bool(row[f"{c}|boolean"]) and not mixed,
            "money": bool(row[f"{c}|money"]) and not mixed,
            "date": bool(row[f"{c}|date"]) and not mixed and not row[f"{c}|money"] and values > 0,
        }
    return out


def null_strings(df: DataFrame, columns=None) -> DataFrame:
    """``nan``, ``null`` and ``none`` in any case become null."""
    return df.withColumns({c: F.when(~_nullable(F.col(c)), F.col(c)) for c in _strings(df, columns)})


def parse_spaced_numbers(df: DataFrame, columns) -> DataFrame:
    """Add ``{c}_numeric`` with the spaces of grouped digits removed."""
    return df.withColumns({f"{c}_numeric": as_number(F.replace(F.col(c), F.lit(" "), F.lit(""))) for c in columns})


def split_mixed(df: DataFrame, columns, keep_text: bool = True) -> DataFrame:
    """Add ``{c}_numeric`` and, with ``keep_text``, ``{c}_non_numeric`` for the rest."""
    cols = {}
    for c in columns:
        number = as_number(F.col(c))
        cols[f"{c}_numeric"] = number
        if keep_text:
            cols[f"{c}_non_numeric"] = F.when(number.isNull(), F.col(c))
    return df.withColumns(cols)


def parse_booleans(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({
        f"{c}_boolean": F.when(F.col(c).isin("True", "true"), True).when(F.col(c).isin("False", "false"), False)
        for c in columns
    })


def split_money(df: DataFrame, columns) -> DataFrame:
    """Replace money text by ``{c}_amount`` and ``{c}_currency``."""
    cols = {}
    for c in columns:
        v = F.col(c)
        matched = v.rlike(MONEY)
        digits = F.regexp_replace(F.regexp_extract(v, MONEY, 2), "[, ]", "")
        cols[f"{c}_amount"] = F.when(matched, as_number(digits))
        cols[f"{c}_currency"] = F.when(matched, F.regexp_extract(v, MONEY, 3))
    return df.withColumns(cols).drop(*columns)


def _parsed(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return as_timestamp(F.col(c)) if kind == "string" else F.col(c).cast("timestamp")


def expand_dates(df: DataFrame, columns, keep: bool = False) -> DataFrame:
    """Replace a date column by its timestamp, year, month, day, weekday name and number (Monday 0)."""
    out = df.withColumns({f"{c}_datetime": _parsed(df, c) for c in columns})
    cols = {}
    for c in columns:
        t = F.col(f"{c}_datetime")
        cols |= {
            f"{c}_year": F.year(t), f"{c}_month": F.month(t), f"{c}_day": F.dayofmonth(t),
            f"{c}_dayofweek": F.date_format(t, "EEEE"), f"{c}_dayofweek_int": F.weekday(t),
        }
    out = out.withColumns(cols)
    return out if keep else out.drop(*columns)


def cyclic_encode(df: DataFrame, columns) -> DataFrame:
    """Sine and cosine of month (period 12) and weekday (period 7)."""
    cols = {}
    for c in columns:
        for part, source, period in (("month", f"{c}_month", 12.0), ("dayofweek", f"{c}_dayofweek_int", 7.0)):
            angle = F.lit(2.0) * F.pi() * F.col(source) / F.lit(period)
            cols |= {f"{c}_{part}_sin": F.sin(angle), f"{c}_{part}_cos": F.cos(angle)}
    return df.withColumns(cols)


def one_hot(df: DataFrame, columns, values: dict | None = None) -> DataFrame:
    """One boolean column per distinct value, named ``{column}_{value}``; the source is dropped.

    The values become the schema, so they are read once on the driver unless
    ``values`` gives them. More values than a schema can hold is an error.
    """
    out = df
    for c in columns:
        found = (values or {}).get(c)
        if found is None:
            found = [r[0] for r in df.filter(F.col(c).isNotNull()).select(c).distinct().limit(10_001).collect()]
            if len(found) > 10_000:
                raise ValueError(f"{c} has more than 10000 values; one column per value does not fit a schema")
        out = out.withColumns({f"{c}_{v}": F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for v in sorted(found)})
    return out.drop(*columns)


def sparse_columns(df: DataFrame, limit: float = 0.5) -> list[str]:
    """Columns whose null share is strictly above ``limit``; one pass."""
    row = df.agg(F.count(F.lit(1)), *[F.count(F.col(c)) for c in df.columns]).first()
    total = row[0]
    return [c for c, n in zip(df.columns, row[1:]) if total and (total - n) / total > limit]


def drop_sparse_columns(df: DataFrame, limit: float = 0.5) -> DataFrame:
    return df.drop(*sparse_columns(df, limit))


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull())


def constant_features(df: DataFrame, features) -> list[str]:
    """Features with exactly one distinct non-null value: smallest equals largest. One pass, no distinct."""
    row = df.agg(*[(F.min(f) == F.max(f)).alias(f) for f in features]).first()
    return [f for f in features if row[f]]


def drop_constant_features(df: DataFrame, features) -> DataFrame:
    return df.drop(*constant_features(df, features))


def drop_singleton_classes(df: DataFrame, target: str) -> DataFrame:
    """Remove rows whose class occurs once. Null classes are kept."""
    single = df.groupBy(target).agg(F.count("*").alias("_n")).filter("_n = 1").select(target)
    return df.join(single, target, "left_anti")


def boolean_strings(df: DataFrame, features) -> list[str]:
    """String features that hold only True, False and null."""
    strings = _strings(df, features)
    if not strings:
        return []
    row = df.agg(*[F.bool_and(F.col(c).isin(*BOOLEANS)).alias(c) for c in strings]).first()
    return [c for c in strings if row[c]]


def cast_features(df: DataFrame, features, booleans=None) -> DataFrame:
    """True/False strings and booleans become 0/1; null stays null; other strings stay categorical."""
    kinds = dict(df.dtypes)
    booleans = boolean_strings(df, features) if booleans is None else booleans
    cols = {c: (F.lower(F.col(c)) == "true").cast("int") for c in booleans}
    cols |= {c: F.col(c).cast("int") for c in features if kinds[c] == "boolean"}
    return df.withColumns(cols) if cols else df


def numeric_only(df: DataFrame, features) -> list[str]:
    """Features that tree and linear models can use."""
    kinds = dict(df.dtypes)
    return [f for f in features if is_integral(kinds[f]) or is_floating(kinds[f]) or kinds[f] == "boolean"]


def clean_pipeline(df: DataFrame, target: str, features, model: str = "ebm",
                   task: str = "classification") -> tuple[DataFrame, list[str]]:
    """Cleaned table and remaining features.

    Null targets, constant features, singleton classes, sparse columns, casts,
    and for models other than ``ebm`` the categorical features, in that order.
    Detection takes two aggregates of one row each: constants before the
    singleton classes go, null shares and boolean strings after.
    """
    out = drop_null_target(df, target)
    if task == "classification":
        out = drop_singleton_classes(out, target)
    strings = _strings(out, features)
    constant = set(constant_features(drop_null_target(df, target), features))
    aggs = [F.count(F.lit(1)).alias("#rows")]
    aggs += [F.count(F.col(c)).alias(f"{c}|n") for c in out.columns]
    aggs += [F.bool_and(F.col(c).isin(*BOOLEANS)).alias(f"{c}|bool") for c in strings]
    row = out.agg(*aggs).first()
    total = row["#rows"]
    sparse = {c for c in out.columns if total and (total - row[f"{c}|n"]) / total > 0.5}
    gone = constant | (sparse - {target})
    kept = [f for f in features if f not in gone]
    out = out.drop(*gone)
    out = cast_features(out, kept, [c for c in strings if c in kept and row[f"{c}|bool"]])
    return out, (kept if model == "ebm" else numeric_only(out, kept))


def quick_clean(df: DataFrame, columns=None) -> DataFrame:
    """Apply every string rule that its column calls for, then drop sparse columns.

    Per column: grouped digits, null strings, mixed numbers and text (which
    ends the column's rules), booleans, money (which replaces the column), dates.
    """
    found = detect(df, columns)

    def having(rule):
        return [c for c, flags in found.items() if flags[rule]]

    out = parse_spaced_numbers(df, having("spaced"))
    out = null_strings(out, having("null_strings"))
    mixed = having("mixed")
    out = split_mixed(out, [c for c in mixed if found[c]["text_left"]])
    out = split_mixed(out, [c for c in mixed if not found[c]["text_left"]], keep_text=False)
    out = parse_booleans(out, having("boolean"))
    out = split_money(out, having("money"))
    dates = having("date")
    if dates:
        out = cyclic_encode(expand_dates(out, dates), dates)
        out = one_hot(out, [f"{c}_{part}" for c in dates for part in ("month", "dayofweek")])
    return drop_sparse_columns(out)
