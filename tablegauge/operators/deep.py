"""Deep table analyses computed on all rows: rules, shifts, spikes, relations,
trends, change points, seasons, segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.columns import as_text, col, nan_to_null, numeric_columns, one_row_to_long, value_counts, with_row_index
from tablegauge.functions.ordered import back_window, running_total, with_halo
from tablegauge.functions.quantiles import iqr_bounds, outside
from tablegauge.functions.wide import correlation
from tablegauge.operators.evaluate import spearman
from tablegauge.operators.quality import duplicate_rows
from tablegauge.session import materialize


def severity(rate: Column) -> Column:
    return F.when(rate > 0.1, "high").when(rate > 0.01, "medium").otherwise("low")


def quality_rules(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Violations of declared rules, one row per broken rule.

    missing_data {column}; duplicates {}; invalid_values {column, allowed};
    range_violation {column, low, high}; format_violation {column, pattern};
    schema_mismatch {column, type}. All row rules share one pass.
    """
    df = nan_to_null(df)
    kinds = dict(df.dtypes)
    aggs, structs, repeated = [F.count(F.lit(1)).alias("n")], [], False
    for i, rule in enumerate(rules):
        kind, c = rule["kind"], rule.get("column")
        if kind == "duplicates":
            repeated = True
            broken = F.col("duplicate_rows")
        elif kind == "schema_mismatch":
            broken = F.when(F.lit(kinds.get(c) != rule["type"]), F.col("n")).otherwise(F.lit(0))
        else:
            value = col(c)
            bad = {
                "missing_data": lambda: value.isNull(),
                "invalid_values": lambda: ~value.isin(*rule["allowed"]),
                "range_violation": lambda: (value < rule["low"]) | (value > rule["high"]),
                "format_violation": lambda: ~value.rlike(rule["pattern"]),
            }[kind]()
            aggs.append(F.count_if(bad).alias(f"v{i}"))
            broken = F.col(f"v{i}")
        rate = F.try_divide(broken, F.col("n"))
        structs.append(F.struct(
            F.lit(kind).alias("type"), F.lit(c).cast("string").alias("column_name"),
            broken.cast("bigint").alias("violations"), rate.alias("rate"), severity(rate).alias("severity")))
    row = df.agg(*aggs)
    if repeated:
        row = row.withColumn("duplicate_rows", duplicate_rows(df).select("duplicate_rows").scalar())
    return one_row_to_long(row, structs, "type string, column_name string, violations bigint, rate double, severity string").filter(
        "violations > 0")


def outlier_magnitude(df: DataFrame) -> DataFrame:
    """How many values lie outside the fences and how far, as a multiple of the median."""
    df = nan_to_null(df)
    cols = numeric_columns(df)
    bounds, q = iqr_bounds(df, cols, probs=(0.25, 0.5, 0.75))
    aggs, structs = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(cols):
        out = outside(col(c), bounds[c])
        aggs += [F.count_if(out).alias(f"k{i}"), F.max(F.when(out, F.abs(col(c).cast("double")))).alias(f"m{i}")]
        structs.append(F.struct(
            F.lit(c).alias("column_name"), F.col(f"k{i}").alias("outlier_count"),
            F.try_divide(F.col(f"k{i}"), F.col("n")).alias("frequency"),
            F.try_divide(F.col(f"m{i}"), F.abs(F.lit(q[c][1]).cast("double"))).alias("magnitude")))
    return one_row_to_long(df.agg(*aggs), structs, "column_name string, outlier_count bigint, frequency double, magnitude double").filter(
        "outlier_count > 0")


def category_surprise(df: DataFrame, column: str, is_reference: Column) -> DataFrame:
    """Categories of the current window that the reference window does not have.

    Both windows are counted in one pass per category.
    """
    counts = df.filter(col(column).isNotNull()).groupBy(column).agg(
        F.count_if(is_reference).alias("_ref"), F.count_if(~is_reference).alias("row_count"))
    return counts.filter("_ref = 0 AND row_count > 0").select(column, "row_count")


def bucket_series(df: DataFrame, at: str, unit: str, value: Column) -> DataFrame:
    """(bucket, value): one aggregate per time bucket.

    The functions below take such a series; it is as long as the calendar, so
    they use plain windows over it.
    """
    return df.groupBy(F.date_trunc(unit, at).cast("timestamp_ntz").alias("bucket")).agg(value.alias("value"))


def spikes(series: DataFrame, trailing: int = 7, sigmas: float = 3.0) -> DataFrame:
    """Buckets beyond the trailing mean by more than the given deviations, looked at in blocks of the row index."""
    indexed = with_row_index(series.select("bucket", "value"), ["bucket"], "i")
    past = back_window(index="i").rowsBetween(-trailing, -1)
    scored = with_halo(indexed, trailing, "i").select(
        "bucket", "value", "_halo", F.avg("value").over(past).alias("trailing_mean"),
        F.stddev_samp("value").over(past).alias("_s"), F.count("value").over(past).alias("_n"))
    z = F.try_divide(F.col("value") - F.col("trailing_mean"), "_s")
    full = scored.filter((F.col("_n") == trailing) & ~F.col("_halo"))
    return full.withColumn("z_score", z).filter(F.abs("z_score") > sigmas).select(
        "bucket", "value", "trailing_mean", "z_score", F.when(F.col("z_score") > 0, "spike").otherwise("drop").alias("type"))


def correlation_kinds(df: DataFrame, pairs: Sequence[tuple[str, str]], gap: float = 0.2) -> DataFrame:
    """Pearson and Spearman per pair: positive, negative, non-linear or none."""
    df = nan_to_null(df)
    parts = []
    for a, b in pairs:
        linear = df.agg(correlation(a, b)).scalar()
        parts.append(spearman(df, a, b).select(
            F.lit(a).alias("column1"), F.lit(b).alias("column2"), linear.alias("pearson"), "spearman"))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    p, s = F.col("pearson"), F.col("spearman")
    return result.withColumn("type", F.when(F.abs(s) - F.abs(p) > gap, "non_linear").when(p > 0.5, "positive_correlation")
                             .when(p < -0.5, "negative_correlation").otherwise("none"))


def segment_difference(df: DataFrame, group: str, value: str) -> DataFrame:
    """η²: the share of the value's variance that lies between the groups."""
    stats = df.filter(col(value).isNotNull()).groupBy(col(group).alias("_group")).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    n, m = F.col("n"), F.col("m")
    row = stats.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(n * m).alias("s"),
                    F.sum(n * m * m).alias("ss"), F.sum(n * F.col("v")).alias("within"))
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return row.select(F.lit(group).alias("segment"), F.lit(value).alias("metric"), "groups",
                      F.try_divide(between, between + F.col("within")).alias("eta_squared"))


def categorical_association(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cramér's V from contingency counts."""
    cells = df.select(col(a).alias("_a"), col(b).alias("_b")).dropna().groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("_a").agg(F.sum("n").alias("r"))
    cols = cells.groupBy("_b").agg(F.sum("n").alias("c"))
    joined = cells.join(rows, "_a").join(cols, "_b")
    stat = joined.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("s"))
    sizes = stat.withColumn("k", F.least(rows.agg(F.count(F.lit(1))).scalar(), cols.agg(F.count(F.lit(1))).scalar()) - 1)
    return sizes.select(F.lit(a).alias("column1"), F.lit(b).alias("column2"),
                        F.sqrt(F.try_divide(F.greatest(F.col("s") - 1, F.lit(0.0)), "k")).alias("cramers_v"))


def trend_type(series: DataFrame) -> DataFrame:
    """increasing, decreasing, stable, mixed or unclear, from a regression on the buckets."""
    half = series.count() // 2
    indexed = with_row_index(series.select("bucket", "value"), ["bucket"], "at").withColumn("i", F.col("at").cast("double"))
    v = F.col("value").cast("double")
    early, late = F.when(F.col("i") < half, v), F.when(F.col("i") >= half, v)
    row = indexed.agg(
        F.regr_slope(v, F.col("i")).alias("slope"), F.regr_r2(v, F.col("i")).alias("r2"), F.avg(v).alias("mean"),
        F.count(F.lit(1)).alias("buckets"), F.regr_slope(early, F.col("i")).alias("a"), F.regr_slope(late, F.col("i")).alias("z"))
    change = F.try_divide(F.col("slope") * (F.col("buckets") - 1), F.abs("mean"))
    kind = (F.when(F.col("r2") < 0.1, F.when(F.col("a") * F.col("z") < 0, "mixed").otherwise("unclear"))
            .when(F.abs(change) < 0.05, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing"))
    return row.select("buckets", "slope", "r2", change.alias("relative_change"), kind.alias("trend_type"))


SEGMENT_BLOCK = 1 << 16  # rows of a block of the index when segments are joined to their points


def prefix_sums(series: DataFrame) -> DataFrame:
    """Stored rows (i, bucket, s, block) of a bucketed series in order: i values up to here sum to s, and (0, null, 0)."""
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    indexed = with_row_index(series.select("bucket", value.alias("v")), ["bucket"], "i")
    summed = running_total(indexed, {"s": "v"}, index="i").select((F.col("i") + 1).alias("i"), "bucket", "s")
    # The row before the first makes every side of a split a difference of two sums.
    begin = summed.filter("i = 1").select(F.lit(0).cast("bigint").alias("i"), F.lit(None).cast(series.schema["bucket"].dataType).alias("bucket"),
                                          F.lit(0.0).alias("s"))
    return materialize(begin.unionByName(summed).withColumn("block", F.floor(F.col("i") / SEGMENT_BLOCK).cast("bigint")), "prefix-sums")


def change_point(series: DataFrame, min_side: int = 5) -> DataFrame:
    """The split of the series that lowers the squared error most, from its prefix sums; a null value counts as 0."""
    sums = prefix_sums(series)
    end = sums.agg(F.struct(F.max("i").alias("n"), F.max_by("s", "i").alias("t"))).scalar()
    p = sums.withColumn("_end", end).select("bucket", F.col("i").alias("k"), "s", "_end.n", "_end.t")
    rest = F.col("n") - F.col("k")
    before, after = F.try_divide(F.col("s"), F.col("k")), F.try_divide(F.col("t") - F.col("s"), rest)
    # Between-sides sum of squares: what the split removes from the error.
    gain = F.col("k") * rest / F.col("n") * F.pow(before - after, F.lit(2))
    split = p.filter((F.col("k") >= min_side) & (rest >= min_side)).select(
        F.col("bucket"), before.alias("mean_before"), after.alias("mean_after"), gain.alias("error_reduction"), "k")
    return split.agg(F.max_by(F.struct("bucket", "mean_before", "mean_after", "error_reduction"),
                              F.struct("error_reduction", -F.col("k"))).alias("b")).select("b.*")


def noise(series: DataFrame) -> Column:
    """Half the mean squared step between neighbouring buckets: a variance that level shifts hardly change."""
    indexed = with_row_index(series.select(F.col("value").cast("double").alias("v"), "bucket"), ["bucket"], "i")
    steps = with_halo(indexed, 1, "i").withColumn("step", F.col("v") - F.lag("v").over(back_window(index="i"))).filter("NOT _halo")
    return steps.agg(F.avg(F.col("step") * F.col("step")) / 2).scalar()


def change_points(series: DataFrame, penalty: float = 3.0, min_side: int = 5) -> DataFrame:
    """All level shifts of a bucketed series by binary segmentation, one row per accepted split.

    Every segment is split where that lowers the squared error most, if the drop exceeds ``penalty`` times the noise times
    ln(number of buckets); both sides go on in the next round, until no segment has such a split. Both sides of a split have
    at least ``min_side`` buckets; of equal drops the earliest counts. Returns ``bucket`` (the last one of the old level),
    ``position`` (buckets up to it), ``segment_start`` and ``segment_end`` (positions around the split segment),
    ``mean_before``, ``mean_after`` (within that segment), ``error_reduction`` and ``round``.

    A round reads the points of segments that are still open, joined to their segment by blocks of the index. A null value
    counts as 0. A series shorter than twice ``min_side`` has no split.
    """
    sums = prefix_sums(series)
    spark = series.sparkSession
    bar = materialize(sums.agg((F.lit(penalty) * F.log(F.max("i")) * noise(series)).alias("bar")), "bar").scalar()
    open_ = sums.agg(F.max("i").alias("hi"), F.max_by("s", "i").alias("s_hi")).filter("hi > 0").select(
        F.lit(0).cast("bigint").alias("lo"), "hi", F.lit(0.0).alias("s_lo"), "s_hi")
    kind = series.schema["bucket"].dataType.simpleString()
    found = spark.createDataFrame([], f"bucket {kind}, position bigint, segment_start bigint, segment_end bigint, mean_before double, "
                                      "mean_after double, error_reduction double, round int")
    turn = 0
    while not open_.isEmpty():
        turn += 1
        # One row per block that a segment reaches, so all segments together have few more rows than there are blocks.
        spread = open_.withColumn("block", F.explode(F.sequence(
            F.floor(F.col("lo") / SEGMENT_BLOCK).cast("bigint"), F.floor(F.col("hi") / SEGMENT_BLOCK).cast("bigint"))))
        k, rest = F.col("i") - F.col("lo"), F.col("hi") - F.col("i")
        before, after = (F.col("s") - F.col("s_lo")) / k, (F.col("s_hi") - F.col("s")) / rest
        points = sums.join(spread, "block").filter((k >= min_side) & (rest >= min_side)).select(
            "lo", "hi", "s_lo", "s_hi", "i", "s", "bucket", before.alias("before"), after.alias("after"),
            (k * rest / (F.col("hi") - F.col("lo")) * F.pow(before - after, F.lit(2))).alias("gain"))
        best = points.groupBy("lo", "hi", "s_lo", "s_hi").agg(
            F.max_by(F.struct("i", "s", "bucket", "before", "after", "gain"), F.struct("gain", -F.col("i"))).alias("b"))
        splits = materialize(best.filter(F.col("b.gain") > bar).select(
            "lo", "hi", "s_lo", "s_hi", "b.*"), "splits")
        found = found.unionByName(splits.select(
            "bucket", F.col("i").alias("position"), F.col("lo").alias("segment_start"), F.col("hi").alias("segment_end"),
            F.col("before").alias("mean_before"), F.col("after").alias("mean_after"), F.col("gain").alias("error_reduction"),
            F.lit(turn).alias("round")))
        open_ = splits.select(F.inline(F.array(
            F.struct("lo", F.col("i").alias("hi"), "s_lo", F.col("s").alias("s_hi")),
            F.struct(F.col("i").alias("lo"), "hi", F.col("s").alias("s_lo"), "s_hi"))))
    return found


SERIES_BLOCK = 1 << 12  # values of a block of a series
MAX_LAG = 1000


def block_autocorrelations(series: DataFrame, lags: Sequence[int] | None = None, block: int = SERIES_BLOCK) -> DataFrame:
    """(lag, autocorrelation) of a bucketed series for the candidate lags, by default from 2 to ``MAX_LAG`` or half its length.

    The series is cut into blocks of the row index, one row each. A lag of q blocks and a rest needs a block next to its
    q-th and (q + 1)-th successor only, so candidates with one q share one pass, and rows and bytes follow the series times
    the number of different q. Missing values leave their products out; a lag as long as the series has no row.
    """
    lags = sorted(set(lags)) if lags is not None else range(2, min(series.count() // 2, MAX_LAG) + 1)
    if not lags:
        return series.sparkSession.createDataFrame([], "lag int, autocorrelation double")
    mean = series.agg(F.avg(F.col("value").cast("double"))).scalar()
    indexed = with_row_index(series.select("bucket", (F.col("value").cast("double") - mean).alias("x")), ["bucket"], "i")
    blocks = materialize(indexed.groupBy(F.floor(F.col("i") / block).alias("b")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("xs")), "series-blocks")
    total = blocks.select(F.aggregate("xs", F.lit(0.0), lambda a, x: a + F.coalesce(x * x, F.lit(0.0))).alias("t")).agg(F.sum("t")).scalar()
    far: dict[int, list[int]] = {}
    for lag in lags:
        far.setdefault(lag // block, []).append(lag)
    steps = [F.struct(F.lit(q).cast("bigint").alias("q"), F.array(*map(F.lit, of)).alias("lags")) for q, of in far.items()]
    later = blocks.select(F.col("b").alias("later"), F.col("xs").alias("ys"))
    pairs = blocks.select("b", "xs", F.inline(F.array(*steps))).withColumn("later", F.col("b") + F.col("q")).join(later, "later").withColumn(
        "later", F.col("later") + 1).join(later.select("later", F.col("ys").alias("zs")), "later", "left").select(
        "q", "lags", "xs", F.concat("ys", F.coalesce("zs", F.array().cast("array<double>"))).alias("ys"))

    def product(lag: Column) -> Column:
        first = (lag - F.col("q") * block + 1).cast("int")
        shifted = F.slice("ys", first, F.size("xs"))
        return F.when(F.size("ys") >= first, F.aggregate(F.zip_with("xs", shifted, lambda x, y: x * y), F.lit(0.0), lambda a, p: a + F.coalesce(p, F.lit(0.0))))

    sums = pairs.select(F.inline(F.arrays_zip("lags", F.transform("lags", lambda lag: product(lag.cast("int"))).alias("s"))))
    return sums.toDF("lag", "s").groupBy("lag").agg(F.sum("s").alias("s")).filter("s IS NOT NULL").select(
        "lag", F.try_divide("s", total).alias("autocorrelation"))


def seasonality(series: DataFrame, threshold: float = 0.5, lags: Sequence[int] | None = None) -> DataFrame:
    """The candidate lag with the highest autocorrelation, seasonal if above the threshold (see ``block_autocorrelations``)."""
    best = block_autocorrelations(series, lags).agg(F.max_by(
        F.struct("lag", "autocorrelation"), F.struct(F.round("autocorrelation", 9), -F.col("lag"))).alias("b")).select("b.*")
    return best.withColumn("is_seasonal", F.col("autocorrelation") > threshold)


def weekday_shares(df: DataFrame, at: str) -> DataFrame:
    counts = df.groupBy(F.dayofweek(at).alias("day_of_week")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.select("day_of_week", "n", F.try_divide("n", total).alias("share"))


def clusters(df: DataFrame, cols: Sequence[str], k: int = 4, seed: int = 7) -> DataFrame:
    """K-means segments: prevalence and the columns whose centre deviates most.

    Rows with a missing value in ``cols`` belong to no segment.
    """
    full = nan_to_null(df.select(*cols)).dropna()
    assembled = VectorAssembler(inputCols=list(cols), outputCol="raw").transform(
        full.select(*[col(c).cast("double").alias(c) for c in cols]))
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(assembled)
    scaled = scaler.transform(assembled).select("scaled")
    model = KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster").fit(scaled)
    parts = vector_to_array("scaled")
    grouped = model.transform(scaled).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(parts[i]).alias(f"m{i}") for i in range(len(cols))])
    n = full.agg(F.count(F.lit(1))).scalar()
    deviations = F.array(*[F.struct(F.abs(f"m{i}").alias("d"), F.lit(c).alias("c")) for i, c in enumerate(cols)])
    top = F.slice(F.array_sort(deviations, lambda a, b: F.when(a["d"] > b["d"], -1).when(a["d"] < b["d"], 1).otherwise(0)), 1, 2)
    return grouped.select("cluster", "size", F.try_divide("size", n).alias("prevalence"),
                          F.array_join(F.transform(top, lambda s: s["c"]), ", ").alias("key_columns"))


def frequent_combinations(df: DataFrame, cols: Sequence[str], min_support: float = 0.01) -> DataFrame:
    """Value pairs of two columns that occur in at least the given share of rows.

    All column pairs are counted in one grouping-sets pass.
    """
    texts = df.select(*[col(c).cast("string").alias(c) for c in cols])
    pairs = list(combinations(cols, 2))
    counted = texts.groupingSets([list(p) for p in pairs], *cols).agg(
        F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_g"))
    width, entry = len(cols), F
    for a, b in pairs:
        mask = (1 << width) - 1
        for c in (a, b):
            mask -= 1 << (width - 1 - list(cols).index(c))
        entry = entry.when(F.col("_g") == mask, F.struct(
            F.lit(a).alias("column1"), col(a).alias("value1"), F.lit(b).alias("column2"), col(b).alias("value2")))
    total = df.agg(F.count(F.lit(1))).scalar()
    found = counted.select(entry.alias("e"), F.col("_n").alias("n"), F.try_divide("_n", total).alias("support"))
    return found.select("e.*", "n", "support").filter(
        (F.col("support") >= min_support) & F.col("value1").isNotNull() & F.col("value2").isNotNull())


PASS_SETS = 100  # column sets that one pass counts


def frequent_itemsets(df: DataFrame, cols: Sequence[str], min_support: float = 0.01, least_size: int = 2) -> DataFrame:
    """Combinations of values of any number of columns that occur in at least the given share of rows, level by level.

    Values that are not frequent alone become null, and rows that are then equal are counted as one. A level counts the
    combinations one column wider of which all parts are frequent, for all column sets in one pass (one per ``PASS_SETS``
    sets); the search ends at a level without frequent combinations. A set of columns has at most 1 / ``min_support``
    frequent combinations, which bounds what the driver and the joins hold. Missing values belong to no combination.

    Returns ``size``, ``columns`` and ``combination`` ("column=value" in column order, joined by " & "), ``n`` and
    ``support``, for combinations of at least ``least_size`` columns.
    """
    if not 0 < min_support <= 1:
        raise ValueError("min_support must be above 0 and at most 1")
    schema = "size int, columns string, combination string, n bigint, support double"
    df, spark = nan_to_null(df.select(*[col(c) for c in cols])), df.sparkSession
    total = df.count()
    if not total or not cols:
        return spark.createDataFrame([], schema)
    floor = min_support * total
    counted = value_counts(df, cols).filter(F.col("n") >= floor)
    codes = materialize(counted.withColumn("code", F.row_number().over(
        Window.partitionBy("column_name").orderBy("value")).cast("string")), "frequent-values")
    coded, place = df.select(*[as_text(df, c).alias(f"c{i}") for i, c in enumerate(cols)]), {c: i for i, c in enumerate(cols)}
    for c, i in place.items():  # at most 1 / min_support rows each
        own = codes.filter(F.col("column_name") == c).select(F.col("value").alias(f"c{i}"), F.col("code").alias(f"k{i}"))
        coded = coded.join(F.broadcast(own), f"c{i}", "left").drop(f"c{i}")
    keys = [f"k{i}" for i in range(len(cols))]
    base = materialize(coded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "coded-rows")

    def code_of(part: Sequence[int]) -> Column:
        return F.concat_ws(",", *[F.col(f"k{i}") for i in part])

    found = [((place[r.column_name],), r.code, r.n) for r in codes.select("column_name", "code", "n").collect()]
    everything, level = list(found), 1
    while found:
        level += 1
        known: dict[tuple[int, ...], list[str]] = {}
        for part, code, _ in found:
            known.setdefault(part, []).append(code)
        sets = sorted({tuple(sorted({*a, b[-1]})) for a in known for b in known if a[:-1] == b[:-1] and a[-1] < b[-1]})
        sets = [s for s in sets if all(s[:i] + s[i + 1:] in known for i in range(level))]
        found = []
        for at in range(0, len(sets), PASS_SETS):
            tried = [F.when(reduce(lambda x, y: x & y, [F.col(f"k{i}").isNotNull() for i in s] + [
                code_of(s[:i] + s[i + 1:]).isin(known[s[:i] + s[i + 1:]]) for i in range(level)]),
                F.struct(F.lit(j).alias("of"), code_of(s).alias("code"))) for j, s in enumerate(sets[at:at + PASS_SETS])]
            seen = base.select(F.inline(F.filter(F.array(*tried), lambda t: t.isNotNull())), "n").groupBy("of", "code").agg(
                F.sum("n").alias("n")).filter(F.col("n") >= floor)
            found += [(sets[at + r.of], r.code, r.n) for r in seen.collect()]
        everything += found
    rows = [(k, len(part), ",".join(cols[i] for i in part), n, list(enumerate(zip((cols[i] for i in part), code.split(",")))))
            for k, (part, code, n) in enumerate(everything) if len(part) >= least_size]
    if not rows:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame(
        [(k, size, names, n, [(i, c, v) for i, (c, v) in parts]) for k, size, names, n, parts in rows],
        "id int, size int, columns string, n bigint, parts array<struct<at: int, column_name: string, code: string>>")
    named = table.select("id", F.inline("parts")).join(codes.select("column_name", "code", "value"), ["column_name", "code"])
    texts = named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "at", F.concat("column_name", F.lit("="), "value").alias("t")))), lambda t: t["t"]), " & ").alias("combination"))
    return table.join(texts, "id").select("size", "columns", "combination", "n", (F.col("n") / F.lit(total)).alias("support"))


def subpopulations(df: DataFrame, dimensions: Sequence[str], metric: str, min_share: float = 0.01,
                   min_z: float = 3.0) -> DataFrame:
    """All groups whose mean of the metric stands out from the whole table, the farthest first."""
    m = col(metric)
    overall = df.agg(F.struct(F.count(m).alias("n"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"))).scalar()
    texts = df.select(m.alias("_m"), *[col(c).cast("string").alias(c) for c in dimensions])
    grouped = texts.groupingSets([[c] for c in dimensions], *dimensions).agg(
        F.count("_m").alias("_n"), F.avg("_m").alias("_mean"), F.grouping_id().alias("_g")).withColumn("_o", overall)
    width, name = len(dimensions), F
    for i, c in enumerate(dimensions):
        name = name.when(F.col("_g") == (1 << width) - 1 - (1 << (width - 1 - i)), c)
    z = F.try_divide((F.col("_mean") - F.col("_o.mean")) * F.sqrt("_n"), "_o.std")
    return (grouped.select(name.alias("dimension"), F.coalesce(*dimensions).alias("value"), F.col("_n").alias("size"),
                           F.col("_mean").alias("mean"), F.col("_o.mean").alias("overall_mean"), z.alias("z_score"),
                           F.try_divide("_n", "_o.n").alias("share"))
            .filter((F.col("share") >= min_share) & (F.abs("z_score") >= min_z))
            .orderBy(F.abs("z_score").desc(), "dimension", "value"))
