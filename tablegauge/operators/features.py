"""Features, baselines, price search, validation splits and pipeline checks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, with_row_index
from tablegauge.functions.ordered import BLOCK_ROWS, back_window, with_halo

EARTH_RADIUS_KM = 6371.0
TWO_PI = 6.283185307179586
# Fixed value: half-width of an 80 % interval in standard deviations.
Z80 = 1.2816


def lag_features(df: DataFrame, series: Sequence[str], order_by: Sequence[str], value: str,
                 lags: Sequence[int] = (1, 7), rolling: int = 7, block: int = BLOCK_ROWS) -> DataFrame:
    """Lags and a trailing mean per series.

    Rows are numbered over (series, order) and windows run within blocks with
    an overlap, so a series of any length is spread over tasks.
    """
    kept = list(dict.fromkeys([*series, *order_by, value]))
    indexed = with_row_index(df.select(*kept), [*series, *order_by])
    reach = max([*lags, rolling - 1])
    w = back_window(series)
    return (
        with_halo(indexed, reach, block=block)
        .withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags})
        .withColumn(f"rolling_mean_{rolling}", F.avg(value).over(w.rowsBetween(-(rolling - 1), 0)))
        .filter(~F.col("_halo")).drop("_halo", "_block", "row_index"))


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    t = col(ts)
    angle = F.lit(TWO_PI) * (F.month(t) - 1) / 12
    return df.withColumns({
        "day_of_week": F.dayofweek(t), "month": F.month(t), "quarter": F.quarter(t),
        "is_weekend": F.dayofweek(t).isin(1, 7), "month_sin": F.sin(angle), "month_cos": F.cos(angle)})


def seasonal_naive(series: DataFrame, key: Sequence[str], at: str, value: str, season: int = 7) -> DataFrame:
    """The value one season earlier with an 80 % interval from past residuals.

    ``series`` is aggregated to one row per key and period, so a key's history
    is as long as the calendar.
    """
    w = Window.partitionBy(*key).orderBy(at)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    forecast = series.withColumn("forecast", F.lag(value, season).over(w))
    residual = forecast.withColumn("_r", col(value) - F.col("forecast"))
    spread = F.stddev_samp("_r").over(past)
    return residual.withColumn("_s", spread).select(
        *key, at, value, "forecast", (F.col("forecast") - Z80 * F.col("_s")).alias("lower_bound"),
        (F.col("forecast") + Z80 * F.col("_s")).alias("upper_bound"))


def behaviour_features(events: DataFrame, entity: str, at: str, kind: str, success: str, amount: str, as_of: str) -> DataFrame:
    """Recency, propensity rate, mean value and their product per entity."""
    grouped = events.groupBy(entity).agg(
        F.max(at).alias("_last"), F.avg((col(kind) == success).cast("int")).alias("propensity"),
        F.avg(amount).alias("mean_value"))
    return grouped.select(
        entity, F.datediff(F.lit(as_of).cast("date"), F.col("_last").cast("date")).alias("recency_days"),
        "propensity", "mean_value", (F.col("propensity") * F.col("mean_value")).alias("propensity_value"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2)))
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(a))


def trade_area(sites: DataFrame, others: DataFrame, radius_km: float) -> DataFrame:
    """Other locations within the radius of each site and a gravity score.

    Both frames: location_id, latitude, longitude; ``others`` also weight. Each
    site is joined to the grid cells around it, so only neighbours meet. Others
    in one exact place are added up first, which keeps crowded spots small.
    Cells form a ring of equal columns, so neighbours across 180 degrees meet,
    and a site whose circle reaches a pole looks at the whole ring.
    """
    angle = math.degrees(radius_km / EARTH_RADIUS_KM)
    step = min(angle, 180.0) * 1.000001
    columns = max(1, int(360 / step))

    def row_of(lat: Column) -> Column:
        return F.floor(lat / step)

    def column_of(lon: Column) -> Column:
        return F.pmod(F.floor((lon + 180) * (columns / 360)), F.lit(columns))

    lat = F.col("latitude")
    # How far a circle reaches east and west, in columns; half the ring is all of it.
    widest = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(angle, 90.0)))) / F.cos(F.radians(lat)))))
    reach = F.when(F.abs(lat) + step >= 90, F.lit(columns)).otherwise(F.ceil(widest * (columns / 360)) + 1).cast("bigint")
    own = column_of(F.col("longitude"))
    ring = F.when(reach * 2 + 1 >= columns, F.sequence(F.lit(0).cast("bigint"), F.lit(columns - 1).cast("bigint"))).otherwise(
        F.transform(F.sequence(own - reach, own + reach), lambda c: F.pmod(c, F.lit(columns))))
    around = sites.withColumn("_row", F.explode(F.sequence(row_of(lat) - 1, row_of(lat) + 1))).withColumn("_col", F.explode(ring))
    places = others.groupBy(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")).agg(
        F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("_n"))
    places = places.withColumn("_row", row_of(F.col("_lat"))).withColumn("_col", column_of(F.col("_lon")))
    distance = haversine_km(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))
    near = around.join(places, ["_row", "_col"]).withColumn("_d", distance).filter(F.col("_d") <= radius_km)
    scored = near.groupBy("location_id").agg(
        F.sum("_n").alias("competitors"), F.sum(F.col("_w") / (1 + F.col("_d") * F.col("_d"))).alias("gravity"))
    return sites.join(scored, "location_id", "left").select(
        "location_id", F.coalesce("competitors", F.lit(0).cast("bigint")).alias("competitors"),
        F.coalesce("gravity", F.lit(0.0)).alias("gravity"))


def optimal_price(products: DataFrame, low: float = 0.85, high: float = 1.25, steps: int = 40) -> DataFrame:
    """The price between the multipliers with the highest margin under constant elasticity.

    ``products``: product_id, base_price, unit_cost, base_quantity, elasticity.
    Candidates are compared within the row, so nothing is shuffled.
    """
    def candidate(i: Column) -> Column:
        m = F.lit(low) + i * F.lit((high - low) / steps)
        price = F.col("base_price") * m
        margin = (price - F.col("unit_cost")) * F.col("base_quantity") * F.pow(m, F.col("elasticity"))
        return F.struct(F.round(margin, 6).alias("margin"), (-i).alias("_order"), price.alias("price"), m.alias("multiplier"))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(steps)), candidate))
    return products.withColumn("_b", best).select(
        "product_id", F.col("_b.price").alias("optimal_price"), F.col("_b.multiplier").alias("multiplier"),
        F.col("_b.margin").alias("expected_margin"))


def time_splits(df: DataFrame, at: str, folds: int = 5, days: int = 30) -> DataFrame:
    """Rows with their fold and role: train before a cut, test in the days after it.

    Cuts step back from the last date. A row takes part in up to ``folds`` folds.
    """
    end = df.agg(F.max(col(at)).cast("date")).scalar()
    day = col(at).cast("date")
    roles = []
    for i in range(folds):
        cut = F.date_sub(end, days * (folds - i))
        role = F.when(day <= cut, "train").when(day <= F.date_add(cut, days), "test")
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(i + 1).alias("fold"), role.alias("role"))))
    return df.select("*", F.inline(F.array_compact(F.array(*roles))))


def hash_fraction(*keys: str) -> Column:
    """A stable number in [0, 1) from the key columns, the same on any engine:
    the first 32 bits of the MD5 of the keys joined by ``|``."""
    head = F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") / float(1 << 32)


def stratified_holdout(df: DataFrame, strata: Sequence[str], key: str, share: float = 0.2) -> DataFrame:
    """Add ``is_test``: the same share of each stratum, chosen by a hash of the
    stratum and the row key, so that it never changes between runs."""
    return df.withColumn("is_test", hash_fraction(*strata, key) < share)


def spatial_folds(df: DataFrame, lat: str, lon: str, cell: float = 1.0, folds: int = 5) -> DataFrame:
    """Add ``fold``; all rows of one grid cell share it."""
    a, b = F.floor(col(lat) / cell), F.floor(col(lon) / cell)
    return df.withColumn("fold", F.pmod(a * 31 + b * 17, F.lit(folds)).cast("int"))


def pipeline_checks(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Each named condition with the rows that break it and a verdict, in one pass.

    A rule is a row condition that must hold; NULL breaks it.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(~F.coalesce(c, F.lit(False))).alias(f"v{i}") for i, c in enumerate(rules.values())])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(f"v{i}").alias("violations"),
                 F.try_divide(F.col(f"v{i}"), F.col("n")).alias("violation_rate"),
                 (F.col(f"v{i}") == 0).alias("passed"))
        for i, n in enumerate(rules)])))


def balance_checks(df: DataFrame, label: Column, treated: Column, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Label balance and treatment split as shares with a verdict."""
    row = df.agg(F.avg(label.cast("int")).alias("a"), F.avg(treated.cast("int")).alias("b"))
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), col(c).alias("share"), col(c).between(low, high).alias("passed"))
        for n, c in (("label_balance", "a"), ("treatment_control_split", "b"))])))
