"""Association between columns: Pearson, bias-corrected Cramer's V and Chatterjee's xi."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from glasswork.functions.hashing import hash_int, row_hash
from glasswork.operators.profile import is_floating, is_integral
from glasswork.operators.ranks import bucket_count, prefix_sums
from glasswork.sources.checkpoint import cut_lineage

PAIRS_PER_PASS = 300


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if is_integral(k) or is_floating(k)]


def category_columns(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if k in ("string", "boolean")]


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _matrix(df: DataFrame, columns, low: float) -> DataFrame:
    """Clip, fill undefined cells with 0 and add the diagonal of ones."""
    value = F.coalesce(F.when(~F.isnan("value"), F.col("value")), F.lit(0.0))
    body = df.select("a", "b", F.least(F.greatest(value, F.lit(low)), F.lit(1.0)).alias("value"))
    ones = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, value double")
    return body.unionByName(ones)


def pearson_matrix(df: DataFrame, columns=None) -> DataFrame | None:
    """Rows (a, b, value) over pairwise complete rows; all pairs in one aggregate (wide tables in a few)."""
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return None
    pairs = list(combinations(columns, 2))
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    frames = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        part = pairs[start:start + PAIRS_PER_PASS]
        corr = wide.agg(*[_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(part)])
        cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("value"))
                 for i, (a, b) in enumerate(part) for x, y in ((a, b), (b, a))]
        frames.append(corr.select(F.explode(F.array(*cells)).alias("s")).select("s.*"))
    return _matrix(_union(frames), columns, -1.0)


def _corr(a: str, b: str) -> Column:
    """Correlation over complete pairs, null for a constant side (where ``corr`` would divide by zero)."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(F.col(a), F.col(b)), F.stddev_pop(x) * F.stddev_pop(y))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by pair of values; pairs with a null are left out."""
    return df.select(F.col(a).cast("string").alias("va"), F.col(b).cast("string").alias("vb")).dropna().groupBy(
        "va", "vb").agg(F.count("*").alias("n"))


def pair_counts(df: DataFrame, columns) -> DataFrame:
    """Contingency cells (a, b, va, vb, n) of all column pairs from one shuffle, combined map-side."""
    values = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    pairs = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("va"), F.col(b).alias("vb"))
        for a, b in combinations(columns, 2)
    ])
    return values.select(F.explode(pairs).alias("s")).select("s.*").filter(
        "va IS NOT NULL AND vb IS NOT NULL").groupBy("a", "b", "va", "vb").agg(F.count("*").alias("n"))


def chi2(cells: DataFrame, keys=()) -> DataFrame:
    """Per key: chi-square (Yates-corrected on 2x2), n, rows r and columns k.

    ``cells`` holds va, vb, n for observed cells only. Zero cells need no rows:
    sum((o-e)^2/e) = n*(sum(o^2/(row*col)) - 1), and on 2x2 every |o-e| is equal.
    """
    keys = list(keys)
    rows = cells.groupBy(*keys, "va").agg(F.sum("n").alias("row_n"))
    cols = cells.groupBy(*keys, "vb").agg(F.sum("n").alias("col_n"))

    def shape(margin, name, size):
        return margin.groupBy(*keys).agg(
            F.sum(name).alias("n_all"), F.count("*").alias(size), F.sum(F.lit(1.0) / F.col(name)).alias(f"inv_{size}"))

    joined = cells.join(rows, [*keys, "va"]).join(cols, [*keys, "vb"])
    o, r, c = (F.col(x).cast("double") for x in ("n", "row_n", "col_n"))
    inner = joined.groupBy(*keys).agg(F.sum(o / r * o / c).alias("share"), F.first(F.struct(o, r, c)).alias("cell"))
    left, right = shape(rows, "row_n", "r"), shape(cols, "col_n", "k").drop("n_all")
    if keys:
        all_ = inner.join(left, keys).join(right, keys)
    else:
        all_ = inner.withColumn("_l", left.select(F.struct("*")).scalar()).withColumn(
            "_r", right.select(F.struct("*")).scalar()).select("share", "cell", "_l.*", "_r.*")
    n = F.col("n_all").cast("double")
    gap = F.abs(F.col("cell.col1") - F.col("cell.col2") * F.col("cell.col3") / n)
    yates = F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2.0)) * n * F.col("inv_r") * F.col("inv_k")
    plain = n * (F.col("share") - F.lit(1.0))
    stat = F.when((F.col("r") == 2) & (F.col("k") == 2), yates).otherwise(F.greatest(plain, F.lit(0.0)))
    return all_.select(*keys, stat.alias("chi2"), F.col("n_all").alias("n"), "r", "k")


def corrected_v(stat: DataFrame, keys=("a", "b")) -> DataFrame:
    """Bias-corrected Cramer's V per key; undefined values are null."""
    n, r, k, one = F.col("n").cast("double"), F.col("r").cast("double"), F.col("k").cast("double"), F.lit(1.0)
    phi2 = F.greatest(F.lit(0.0), F.try_divide(F.col("chi2"), n) - F.try_divide((k - one) * (r - one), n - one))
    rc = r - F.try_divide((r - one) * (r - one), n - one)
    kc = k - F.try_divide((k - one) * (k - one), n - one)
    return stat.select(*keys, F.sqrt(F.try_divide(phi2, F.least(kc - one, rc - one))).alias("value"))


def cramers_v_matrix(df: DataFrame, columns=None) -> DataFrame | None:
    columns = list(columns or category_columns(df))
    if len(columns) < 2:
        return None
    v = corrected_v(chi2(pair_counts(df, columns), ["a", "b"]))
    both = v.unionByName(v.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    return _matrix(both, columns, 0.0)


def xi_pairs(df: DataFrame, pairs, keys=None, ties: bool = True) -> DataFrame:
    """Chatterjee's xi of b on a as rows (a, b, value), all ordered pairs in one job, rows with a null left out.

    Rows run in order of a, ties in a by key hash. With ``ties`` the denominator
    is 2*sum(l*(n-l)), without it (n^2-1)/3. A column without nulls orders the
    rows once for all its partners; one with nulls, whose partners' ranks
    depend on the rows left, orders them once for each.
    """
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    firsts = list(dict.fromkeys(a for a, _ in pairs))
    hashed = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], row_hash(list(keys or columns)).alias("_h"))
    found = hashed.agg(*[F.count_if(F.col(f"x{columns.index(c)}").isNull()).alias(c) for c in firsts]).first()
    whole = [p for p in pairs if not found[p[0]]]
    rest = [p for p in pairs if found[p[0]]]
    frames = []
    if whole:
        frames.append(_xi_by_order(hashed, columns, whole, ties))
    for a, b in rest:
        x, y = columns.index(a), columns.index(b)
        part = hashed.filter(F.col(f"x{x}").isNotNull() & F.col(f"x{y}").isNotNull()).select(
            F.col(f"x{x}").alias("x0"), F.col(f"x{y}").alias("x1"), "_h")
        frames.append(_xi_by_order(part, [a, b], [(a, b)], ties))
    return _union(frames)


def _xi_by_order(hashed: DataFrame, columns: list[str], pairs, ties: bool) -> DataFrame:
    """xi for pairs whose first column (of ``x0, x1, ..``) has no null.

    Each value gets its rank once. A row's place in the order of a column
    follows from rank, copies and hash alone, so buckets of equal size need no
    search for borders and a hot value is spread over many. A scan inside the
    buckets sums the jumps of all partners' ranks; the last rank of the buckets
    before joins the jump at each border.
    """
    values = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"x{i}").alias("v")) for i in range(len(columns))])
    counts = hashed.select(F.explode(values).alias("s")).select("s.*").filter("v IS NOT NULL").groupBy("f", "v").agg(
        F.count(F.lit(1)).alias("c"))
    cum = prefix_sums(counts, "v", ["c"], ["f"])
    # Read by every join and by the sums, so written once: a row per distinct value.
    ranks = cut_lineage(cum.select("f", "v", "c", (F.col("c_before") + F.col("c")).alias("r"), (F.col("c_total") - F.col("c_before")).alias("l")))
    rows, buckets = hashed, bucket_count(hashed)
    orders = sorted({columns.index(a) for a, _ in pairs})
    partners = sorted({columns.index(b) for _, b in pairs})
    for i in sorted({*orders, *partners}):
        side = ranks.filter(F.col("f") == i).select(F.col("v").alias(f"x{i}"), F.col("r").alias(f"r{i}"), F.col("c").alias(f"c{i}"),
                                                    (F.col("l") + F.col("r") - F.col("c")).alias(f"n{i}"))
        rows = rows.join(side, f"x{i}", "left")
    share = hash_int(F.col("_h"), 8) / F.lit(float(16**8))
    spots = F.array(*[F.struct(
        F.lit(i).alias("a"), F.col(f"r{i}").alias("at"),
        F.least(F.floor((F.col(f"r{i}") - F.col(f"c{i}") * (F.lit(1.0) - share)) * buckets / F.col(f"n{i}")), F.lit(buckets - 1)).alias("_bucket"))
        for i in orders])
    placed = rows.select("_h", *[f"r{j}" for j in partners], F.explode(spots).alias("s")).select("_h", *[f"r{j}" for j in partners], "s.*")
    inside = W.partitionBy("a", "_bucket").orderBy("at", "_h").rowsBetween(W.unboundedPreceding, -1)
    place = F.struct("at", "_h")
    jumps = placed.select("a", "_bucket", "at", "_h", *[f"r{j}" for j in partners], *[
        F.abs(F.col(f"r{j}") - F.last(f"r{j}", ignorenulls=True).over(inside)).alias(f"j{j}") for j in partners])
    ends = [f(F.col(f"r{j}"), F.when(F.col(f"r{j}").isNotNull(), place)).alias(f"{n}{j}")
            for j in partners for n, f in (("first", F.min_by), ("last", F.max_by))]
    parts = jumps.groupBy("a", "_bucket").agg(*[F.sum(f"j{j}").alias(f"j{j}") for j in partners], *ends)
    along = W.partitionBy("a").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    edges = parts.select("a", *[F.coalesce(F.col(f"j{j}"), F.lit(0)) + F.coalesce(
        F.abs(F.col(f"first{j}") - F.last(f"last{j}", ignorenulls=True).over(along)), F.lit(0)) for j in partners]).toDF(
        "a", *[f"j{j}" for j in partners])
    sums = edges.groupBy("a").agg(*[F.sum(f"j{j}").cast("double").alias(f"j{j}") for j in partners])
    wanted = F.array(*[F.struct(F.lit(columns.index(a)).alias("i"), F.lit(columns.index(b)).alias("j"), F.lit(a).alias("a"), F.lit(b).alias("b"))
                       for a, b in pairs])
    total = F.coalesce(*[F.when(F.col("p.j") == j, F.col(f"j{j}")) for j in partners])
    long = sums.withColumnRenamed("a", "_a").select("*", F.explode(wanted).alias("p")).filter("p.i = _a").select(
        "p.a", "p.b", F.col("p.j").alias("f"), total.alias("jumps"))
    c, l, one = F.col("c").cast("double"), F.col("l").cast("double"), F.lit(1.0)
    own = ranks.groupBy("f").agg(F.sum(c).alias("n"), F.sum(c * l).alias("l1"), F.sum(c * l * l).alias("l2"))
    n = F.col("n")
    value = (one - F.try_divide(n * F.col("jumps"), F.lit(2.0) * (n * F.col("l1") - F.col("l2"))) if ties
             else one - F.try_divide(F.lit(3.0) * F.col("jumps"), n * n - one))
    return long.join(own, "f").select("a", "b", value.alias("value"))


def xi(df: DataFrame, x: str, y: str, keys=None, ties: bool = True) -> DataFrame:
    return xi_pairs(df, [(x, y)], keys, ties)


def xi_matrix(df: DataFrame, columns=None, keys=None) -> DataFrame | None:
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return None
    return _matrix(xi_pairs(df, list(permutations(columns, 2)), keys), columns, 0.0)


KINDS = {"pearson": pearson_matrix, "cramerv": cramers_v_matrix, "xi": xi_matrix}


def correlation_matrix(df: DataFrame, kind: str) -> DataFrame | None:
    """Rows (a, b, value), or None with fewer than two eligible columns."""
    if kind not in KINDS:
        raise ValueError(f"Invalid correlation type: {kind}")
    return KINDS[kind](df)


def association(df: DataFrame, columns=None, keys=None) -> DataFrame | None:
    """All three matrices as rows (kind, a, b, value); a kind without two eligible columns is skipped."""
    part = df.select(*columns) if columns else df
    found = [("pearson", pearson_matrix(part)), ("cramerv", cramers_v_matrix(part))]
    numeric = numeric_columns(part)
    source = df.select(*dict.fromkeys([*numeric, *(keys or [])]))
    found.append(("xi", xi_matrix(source, numeric, keys)))
    frames = [m.select(F.lit(kind).alias("kind"), "a", "b", "value") for kind, m in found if m is not None]
    return _union(frames) if frames else None
