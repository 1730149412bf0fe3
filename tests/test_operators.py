"""Operators against pandas or worked examples, with awkward rows throughout."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablegauge.operators import ask as A
from tablegauge.operators import context as X
from tablegauge.operators import conversations as V
from tablegauge.operators import deep as N
from tablegauge.operators import dictionary as T
from tablegauge.operators import drift as R
from tablegauge.operators import evaluate as E
from tablegauge.operators import features as FT
from tablegauge.operators import gaps as G
from tablegauge.operators import insights as I
from tablegauge.operators import predict as M
from tablegauge.operators import profile as P
from tablegauge.operators import quality as D
from tablegauge.operators import relational as RL
from tablegauge.operators import sql as S
from tablegauge.operators import synthetic as Y
from tablegauge.sources import files, rows


@pytest.fixture(scope="module")
def pdf():
    """NULL next to NaN, a constant, a zero start, a negative mean, repeated rows."""
    rng = np.random.default_rng(5)
    n = 240
    base = pd.DataFrame({
        "seq": np.arange(n), "start0": np.r_[0.0, rng.normal(5, 2, n - 1)], "negative": rng.normal(-20, 30, n),
        "price": rng.lognormal(2, 1, n) - 3, "flat": 4, "kind": rng.choice(["x", "y", None], n, p=[.5, .2, .3])})
    base.loc[::7, "negative"] = np.nan
    base["twin"] = base.price * 2 + 1
    return pd.concat([base, base.iloc[:30]], ignore_index=True)


@pytest.fixture(scope="module")
def df(spark, pdf):
    clean = pdf.astype(object).where(pdf.notna(), None)
    return spark.createDataFrame(clean.values.tolist(), "seq long, start0 double, negative double, price double, flat int, kind string, twin double").union(
        spark.createDataFrame([], "a long, b double, c double, d double, e int, f string, g double"))


NUM = ["seq", "start0", "negative", "price", "flat", "twin"]


def rows_of(frame, key):
    return {r[key]: r for r in frame.collect()}


def fences(s):
    a, z = s.quantile(.25), s.quantile(.75)
    return a - 1.5 * (z - a), z + 1.5 * (z - a)


def test_outliers_and_risk(df, pdf):
    got, risk = rows_of(I.iqr_outliers(df, only_positive=False), "column_name"), rows_of(I.risk_indicators(df), "metric")
    for c in NUM:
        lo, hi = fences(pdf[c])
        count = ((pdf[c] < lo) | (pdf[c] > hi)).sum()
        assert got[c].outlier_count == count
        assert got[c].percentage == pytest.approx(count / len(pdf) * 100)
    for c in NUM[:5]:
        cv = pdf[c].std() / pdf[c].mean() * 100
        assert risk[c].volatility == pytest.approx(cv)
    assert risk["negative"].volatility < 0
    assert rows_of(I.risk_indicators(df, abs_cv=True), "metric")["negative"].volatility > 0


def test_order_dependent_insights(df, pdf):
    order = ["seq", "start0"]
    s = pdf.sort_values(order, kind="stable").reset_index(drop=True)
    n = len(s)
    trend, kpi = rows_of(I.trends(df, order), "column_name"), rows_of(I.executive_kpis(df, order), "name")
    growth = rows_of(I.growth_metrics(df, order), "column_name")
    for c in NUM[:3]:
        assert growth[c].growth_rate == pytest.approx(
            (s[c][n // 2:].mean() - s[c][:n // 2].mean()) / s[c][:n // 2].mean() * 100)
    assert kpi["start0"].trend == 0 and growth["start0"].cagr == 0  # starts at zero
    assert trend["price"].average_change == pytest.approx((s.price.iloc[-1] - s.price.iloc[0]) / n)
    assert trend["negative"].direction == "decreasing" and trend["negative"].average_change is None  # first value missing
    points = I.downsample(df, order).collect()
    assert [r.row_index for r in points] == list(range(0, n, n // 50))
    line = rows_of(A.linear_projection(df, order), "column_name")["start0"]
    slope = np.polyfit(range(n), s.start0, 1)[0]
    assert line.slope == pytest.approx(slope) and line.next_value == pytest.approx(s.start0.iloc[-1] + slope)


def test_correlations(df, pdf):
    got = {(r.column1, r.column2): r.correlation for r in I.pair_correlations(df).collect()}
    want = pdf[NUM].corr()
    for (a, b), v in got.items():
        if "flat" in (a, b):
            assert v is None
        else:
            assert v == pytest.approx(want.loc[a, b])
    # The perfect pair is listed among correlations but is no gap.
    assert ("price", "twin") in {(r.column1, r.column2) for r in I.correlations(df).collect()}
    assert G.relationship_gaps(df).first().strong_relationships_found == sum(
        0.7 < abs(v) < 1.0 for v in got.values() if v is not None)


def test_histogram_equals_numpy(df, pdf):
    got = I.histogram(df).collect()
    for c in NUM:
        counts, edges = np.histogram(pdf[c].dropna(), bins=10)
        mine = sorted((r.bin, r["count"], r.range) for r in got if r.column_name == c)
        assert [m[1] for m in mine] == list(counts)
        assert [m[2] for m in mine] == [f"{edges[i]:.1f}-{edges[i + 1]:.1f}" for i in range(10)]


def test_quality_and_scores(df, pdf):
    n, missing, dup = len(pdf), pdf.isnull().sum(), pdf.duplicated().sum()
    complete, unique = (1 - missing.sum() / pdf.size) * 100, (1 - dup / n) * 100
    assert dup == 30
    assert D.overall_score(df).first()[0] == round(complete * .6 + unique * .4, 2)
    assert {r.column_name: r.missing_count for r in D.completeness_detail(df).collect()} == missing[missing > 0].to_dict()
    assert rows_of(D.validity(df), "column_name")["price"]["count"] == (pdf.price < 0).sum()
    report = {(r.section, r.metric, r.column_name): r.value for r in D.quality_report(df).collect()}
    assert report["overall", "overall_score", None] == round(complete * .6 + unique * .4, 2)
    assert report["consistency", "duplicate_rows", None] == dup
    assert report["issues", "missing_data", "kind"] == missing["kind"]
    assert ("issues", "missing_data", "price") not in report
    score = I.performance_score(df, ["seq", "start0"]).first()
    cvs = [pdf[c].std() / pdf[c].mean() for c in NUM]
    assert score.data_quality == pytest.approx(complete)
    assert score.consistency == pytest.approx(max(0, 100 - np.mean(cvs) * 100))


def test_profile_counts_nan_as_missing(df, pdf):
    got = rows_of(P.profile_table(df), "column_name")
    for c in pdf.columns:
        assert got[c].null_count == pdf[c].isnull().sum()
        assert got[c].distinct_count == pdf[c].nunique()
    tops = [(r.value, r["count"]) for r in P.top_values(df).orderBy("position").collect()]
    assert tops == list(pdf.kind.value_counts().items())
    assert [r.distinct_count for r in P.top_values(df, top=1).collect()] == [pdf.kind.nunique()]


def test_empty_and_single_row_tables(df):
    for small in (df.limit(0), df.limit(1)):
        P.profile_table(small).collect()
        D.quality_report(small).collect()
        G.coverage_gaps(small).collect()
        I.key_metrics(small).collect()
        I.histogram(small).collect()
        I.correlations(small).collect()
        A.quick_insights(small).collect()
    assert D.completeness_score(df.limit(0)).first()[0] == 100
    assert D.consistency_score(df.limit(0)).first().consistency_score == 100
    assert I.trends(df.limit(1), ["seq"]).count() == 0
    assert I.growth_metrics(df.limit(1), ["seq"]).count() == 0


def test_gap_reports(df, pdf):
    cover = {r.type: r.columns for r in G.coverage_gaps(df).collect()}
    assert cover == {"high_missing_data": "kind", "low_diversity": "flat, kind"}
    assert G.temporal_gaps(df).first().has_temporal_data is False
    got = rows_of(G.diversity(df), "column_name")
    assert got["seq"].diversity_ratio == round(pdf.seq.nunique() / len(pdf), 3) and got["flat"].assessment == "low"


@pytest.mark.parametrize("text,reason", [
    ("SELECT 1 as test_column", None),
    ("DELETE FROM users", S.ONLY_SELECT),
    ("WITH r AS (SELECT 1) SELECT * FROM r", None),
    ("SELECT status, COUNT(*) FROM t GROUP BY status;", None),
    ("SELECT replace(a,'x','y') FROM t", S.FORBIDDEN_PREFIX + "REPLACE"),
    ("SELECT 1; SELECT 2", S.ONE_STATEMENT),
    ("-- drop\nSELECT 1", S.FORBIDDEN_PREFIX + "DROP"),
    ("/* a\nb */  select inserted FROM t", None),
    ("", S.ONLY_SELECT)])
def test_sql_rules(spark, text, reason):
    got = S.audit_queries(spark.createDataFrame([(text,)], "q string"), "q").first()
    assert got.reason == reason and got.allowed == (reason is None)
    assert S.refusal(text) == reason


def test_sql_page(spark):
    page = S.sql_page(spark, "SELECT id FROM nums ORDER BY id", 3, 10, {"nums": spark.range(25)}, ["id"])
    assert [(r.id, r.total_rows) for r in page.collect()] == [(i, 25) for i in range(20, 25)]
    with pytest.raises(ValueError):
        S.sql_page(spark, "DROP TABLE nums")
    with pytest.raises(ValueError):
        S.sql_page(spark, "SELECT id FROM nums", 2, 10, {"nums": spark.range(25)})


def test_sql_leaves_the_callers_views(spark):
    spark.range(3).createOrReplaceTempView("nums")
    assert S.guarded_sql(spark, "SELECT count(*) AS n FROM nums, other", {"nums": spark.range(7), "other": spark.range(2)}).first().n == 14
    assert spark.table("nums").count() == 3
    assert not spark.catalog.tableExists("other")
    spark.catalog.dropTempView("nums")


def test_refusal_and_audit_name_the_same_word(spark):
    text = "SELECT 1 drop insert"
    assert S.refusal(text) == S.audit_queries(spark.createDataFrame([(text,)], "q string"), "q").first().reason == S.FORBIDDEN_PREFIX + "DROP"


def test_sampling_policy(spark):
    df = spark.range(1000)
    assert rows.sample_for_profile(df, 1.0) is df
    assert 60 < rows.sample_for_profile(df, 0.1, seed=1).count() < 140
    with pytest.raises(ValueError):
        rows.sample_for_profile(df, 0.0)


def test_pages(spark, monkeypatch):
    df = spark.range(1000).withColumn("k", F.col("id") % 10)
    want = sorted(range(1000), key=lambda i: (i % 10, i))
    for top in (100_000, 100):
        monkeypatch.setattr(rows, "TOP_ROWS", top)
        got = [r.id for r in rows.page_rows(df, ["k", "id"], 7, 30).collect()]
        assert got == want[180:210]
    assert [r.id for r in rows.sample_rows(df, ["id"], 30, 100).collect()] == list(range(100, 130))
    with pytest.raises(ValueError):
        rows.sample_rows(df, ["id"], 600, 700)


def test_pages_of_tied_rows_are_whole(spark, monkeypatch):
    """All keys tie; pages on both sides of the switch between the two plans hold every row once."""
    monkeypatch.setattr(rows, "TOP_ROWS", 500)
    df = spark.range(1000).select("id", F.lit(1).alias("k")).repartition(7)
    got = [r.id for page in range(1, 11) for r in rows.page_rows(df, ["k"], page, 100).collect()]
    assert sorted(got) == list(range(1000))


def test_thresholds(spark):
    cases = [(5.0, 4.0, 5.0, E.LOWER, "fail"), (4.0, 4.0, 5.0, E.LOWER, "warn"), (3.9, 4.0, 5.0, E.LOWER, "pass"),
             (0.5, 0.7, 0.5, E.HIGHER, "fail"), (0.7, 0.7, 0.5, E.HIGHER, "warn"), (-1.0, None, 0.0, E.HIGHER, "pass"),
             (None, 4.0, 5.0, E.LOWER, "missing")]
    df = spark.createDataFrame(cases, "v double, w double, f double, d string, want string")
    cols = [F.col(c) for c in "vwfd"]
    for r in df.select(E.check_threshold(*cols).alias("got"), "want").collect():
        assert r.got == r.want
    strict = df.filter("v = -1").select(E.check_threshold(*cols, zero_is_unset=False)).first()[0]
    assert strict == "fail"


def test_spearman_and_ks_on_ties(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.integers(0, 6, 500), "y": rng.integers(0, 4, 500), "ref": rng.random(500) < .4})
    pdf["y"] += pdf.x
    df = spark.createDataFrame(pdf)
    assert E.spearman(df, "x", "y").first()[0] == pytest.approx(pdf.x.rank().corr(pdf.y.rank()))
    shares = pd.crosstab(pdf.x, pdf.ref, normalize="columns").cumsum()
    assert R.ks(df, ["x"], F.col("ref")).first().ks == pytest.approx((shares[True] - shares[False]).abs().max())


def entry(column, version, active, source="llm_initial", name="n"):
    return ("default", "s", "t", column, version, active, "note", name, None, None, "int", ["1"], ["a"], source)


ENTRY = ("database_name string, schema_name string, table_name string, column_name string, version_number int, is_active boolean, "
         "version_notes string, business_name string, business_description string, technical_description string, data_type string, "
         "examples array<string>, tags array<string>, source string")


def test_dictionary_versions(spark):
    current = spark.createDataFrame([
        entry("a", 1, True), entry("b", 1, False), entry("b", 2, True, "human_edited"), entry("c", 1, False), entry("keep", 1, True)], ENTRY)
    incoming = spark.createDataFrame([entry(c, 9, None, "llm_initial", "new") for c in "abcd"], ENTRY).drop(
        "version_number", "is_active", "version_notes")
    got = {(r.column_name, r.version_number, r.business_name, r.is_active) for r in T.upsert_dictionary(current, incoming).collect()}
    assert got == {("a", 1, "new", True), ("b", 1, "n", False), ("b", 2, "n", False), ("b", 3, "new", True),
                   ("c", 1, "n", False), ("c", 1, "new", True), ("d", 1, "new", True), ("keep", 1, "n", True)}
    back = T.activate_versions(current, current.filter("column_name = 'b' AND version_number = 1"))
    assert {(r.column_name, r.version_number, r.is_active) for r in back.collect() if r.column_name == "b"} == {("b", 1, True), ("b", 2, False)}


def test_lineage_with_a_cycle_and_a_hub(spark):
    edges = [("hub", f"n{i}") for i in range(300)] + [("n1", "x"), ("x", "hub"), ("x", "y"), ("far", "hub")]
    df = spark.createDataFrame(edges, "source string, target string")
    start = spark.createDataFrame([("hub",)], "node string")
    down = {r.node: r.depth for r in X.lineage(df, start, "downstream").collect()}
    assert down["hub"] == 0 and down["n299"] == 1 and down["x"] == 2 and down["y"] == 3 and "far" not in down
    assert {r.node for r in X.lineage(df, start, "upstream", 1).collect()} == {"hub", "x", "far"}
    assert "far" in {r.node for r in X.lineage(df, start, "both", 1).collect()}


@pytest.mark.parametrize("text,json,lines", [
    ('```json\n{"a": 1}\n```', '{"a":1}', None),
    ('Answer: [1, 2] and more', "[1,2]", None),
    ('see {"a": [1]} end', '{"a":[1]}', None),
    ('  {"b": 2}  ', '{"b":2}', None),
    ("short\nthis line is long enough to keep\n{broken", None, ["this line is long enough to keep"])])
def test_json_in_answers(spark, text, json, lines):
    got = X.extract_json(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert got.json == json and got.key_insights == lines


def test_summary_inputs(spark):
    texts = [("a" * 49,), (" " * 60 + "b",), ("c" * 50,), ("d" * 3000 + "\n" + "e" * 3000,), (None,)]
    got = [(r.part, r.summary_input) for r in X.prepare_summary_inputs(spark.createDataFrame(texts, "text string")).collect()]
    assert got == [(None, None), (None, None), (0, "c" * 50), (0, "d" * 3000), (1, "\n" + "e" * 2999), (2, "e"), (None, None)]


def test_combined_documents_hold_every_text(spark):
    docs = spark.createDataFrame([("a" if i % 3 else None, i, f"text {i} " + "x" * 60) for i in range(40)], "g string, id int, text string")
    got = {(r.g, r.bundle): r.combined for r in X.combine_documents(docs, ["g"], "id").collect()}
    for g in ("a", None):
        ids = [i for i in range(40) if bool(i % 3) == (g == "a")]
        assert [got[g, b].count("text") for b in range(-(-len(ids) // 5))] == [len(ids[b:b + 5]) for b in range(0, len(ids), 5)]
        assert got[g, 0].startswith(f"text {ids[0]} ") and f"text {ids[4]} " in got[g, 0]


def test_lineage_has_no_depth_limit(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(15)], "source string, target string")
    start = spark.createDataFrame([("n7",)], "node string")
    assert {r.node: r.depth for r in X.lineage(edges, start).collect()} == {f"n{i}": abs(i - 7) for i in range(16)}


def test_trade_area_at_the_date_line_and_the_poles(spark):
    rng = np.random.default_rng(5)
    sites = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.choice([-89.9, -60, 0, 10, 86, 89.95], 40) + rng.uniform(-.04, .04, 40),
                                                                    rng.choice([-180, -179.9, 179.9, 0, 90], 40) + rng.uniform(0, .05, 40)))]
    places = [(i, float(a), float(b), 2.0) for i, (a, b) in enumerate(zip(
        rng.choice([-89.8, -60.2, .1, 10.3, 86.2, 89.9], 300) + rng.uniform(-.3, .05, 300), rng.uniform(-180, 180, 300)))]
    places += [(1000 + i, lat + .1, -lon, 1.0) for i, lat, lon in sites if abs(lat) < 89]

    def km(a, b, c, d):
        a, b, c, d = np.radians([a, b, c, d])
        return 2 * 6371 * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))

    frame = FT.trade_area(spark.createDataFrame(sites, "location_id int, latitude double, longitude double"),
                          spark.createDataFrame(places, "location_id int, latitude double, longitude double, weight double"), 80.0)
    for r in frame.collect():
        _, lat, lon = sites[r.location_id]
        near = [(w, km(lat, lon, a, b)) for _, a, b, w in places if km(lat, lon, a, b) <= 80]
        assert r.competitors == len(near)
        assert r.gravity == pytest.approx(sum(w / (1 + x * x) for w, x in near))


def test_role_runs_over_small_blocks(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"conv_id": np.r_[np.zeros(400, int), rng.integers(1, 30, 200)], "role": rng.choice(["tool", "user"], 600, p=[.8, .2])})
    pdf["turn"] = pdf.groupby("conv_id").cumcount()
    got = {(r.conv_id, r.first_turn, r.last_turn, r.role) for r in V.role_runs(spark.createDataFrame(pdf), block=16).collect()}
    want = set()
    for c, part in pdf.sort_values(["conv_id", "turn"]).groupby("conv_id"):
        run = (part.role != part.role.shift()).cumsum()
        want |= {(c, g.turn.iloc[0], g.turn.iloc[-1], g.role.iloc[0]) for _, g in part.groupby(run)}
    assert got == want
    assert V.threads(spark.createDataFrame(pdf)).filter("position <> turn").count() == 0


def test_range_join_meets_brute_force(spark):
    rng = np.random.default_rng(4)
    points = pd.DataFrame({"v": np.where(rng.random(400) < .35, 5.0, rng.uniform(-20, 20, 400))})
    ranges = pd.DataFrame({"low": rng.uniform(-20, 20, 30)})
    ranges["high"] = ranges.low + rng.exponential(3, 30)
    got = RL.range_join(spark.createDataFrame(points), spark.createDataFrame(ranges), "v", "low", "high", 2.0).count()
    assert got == sum(((points.v >= a) & (points.v < z)).sum() for a, z in ranges.values)


def test_trade_area_meets_brute_force(spark):
    rng = np.random.default_rng(6)
    sites = pd.DataFrame({"location_id": range(40), "latitude": rng.uniform(-60, 60, 40), "longitude": rng.uniform(-20, 20, 40)})
    others = pd.DataFrame({"latitude": rng.uniform(-60, 60, 500), "longitude": rng.uniform(-20, 20, 500), "weight": rng.random(500)})
    others.loc[:170, ["latitude", "longitude"]] = sites.loc[0, ["latitude", "longitude"]].values  # a crowded place
    got = rows_of(FT.trade_area(spark.createDataFrame(sites), spark.createDataFrame(others), 400.0), "location_id")
    for s in sites.itertuples():
        a, b = np.radians(s.latitude), np.radians(others.latitude)
        h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(others.longitude - s.longitude) / 2) ** 2
        d = 2 * 6371.0 * np.arcsin(np.sqrt(h))
        assert got[s.location_id].competitors == (d <= 400).sum()
        assert got[s.location_id].gravity == pytest.approx((others.weight / (1 + d * d))[d <= 400].sum())


def test_duplicate_documents_with_a_hot_text(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i // 2}") for i in range(120)], "doc_id long, text string")
    got = X.duplicate_documents(docs).toPandas()
    assert (got.copies == 40).sum() == 40 and got[got.copies == 40].keeper_id.unique().tolist() == [0]


def test_synthetic_tables(spark, df, pdf):
    made = Y.synthesize(df, 4000, seed=1).toPandas()
    assert list(made.columns) == list(pdf.columns) and len(made) == 4000
    assert made.price.between(pdf.price.min(), pdf.price.max()).all()
    assert set(made.kind) == {"x", "y"} and set(made.flat) == {4}
    assert made.kind.value_counts(normalize=True)["x"] == pytest.approx(pdf.kind.value_counts(normalize=True)["x"], abs=.05)
    many = spark.range(3000).select(F.concat(F.lit("v"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id"))).alias("s"))
    drawn = Y.synthesize(many, 3000, seed=2)
    assert drawn.count() == 3000 and drawn.filter("s = 'v0'").count() == pytest.approx(1000, abs=120)
    days = spark.sql("SELECT DATE'2024-01-05' AS d UNION ALL SELECT DATE'2024-01-01'")
    assert [str(r.d) for r in Y.synthesize(days, 3).orderBy("d").collect()] == ["2024-01-01", "2024-01-02", "2024-01-03"]


def test_models(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": range(800), "a": rng.normal(0, 1, 800), "c": rng.choice(["p", "q", "r"], 800)})
    pdf["y"] = pdf.a * 3 + (pdf.c == "q") * 5 + rng.normal(0, .1, 800)
    pdf["label"] = np.where(pdf.y > 2, "high", "low")
    df = spark.createDataFrame(pdf)
    metrics, weights, _ = M.fit_regressor(df.drop("label"), "y", ["id"], trees=10)
    assert metrics.first().r2_score > .8
    assert {r.feature for r in weights.collect()} == {"a", "c_q", "c_r"}  # the first level is dropped
    metrics, _, _ = M.fit_classifier(df.drop("y"), "label", ["id"], trees=10)
    assert metrics.first().accuracy > .85
    assert M.choose_task(df, "label", "classification").first().task == "classification"
    assert M.choose_task(df, "a", "classification").first().task == "regression"
    assert [M.choose_task(spark.range(k).toDF("t"), "t", "classification").first().task for k in (9, 10)] == ["classification", "regression"]


def test_clusters_and_combinations(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"x": np.r_[rng.normal(0, .1, 100), rng.normal(9, .1, 300)], "y": rng.normal(0, .1, 400)})
    got = sorted(r["size"] for r in N.clusters(spark.createDataFrame(pdf), ["x", "y"], k=2).collect())
    assert got == [100, 300]


def test_uplift_of_two_models(spark):
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame({"id": range(600), "a": rng.random(600), "t": rng.random(600) < .5})
    pdf["y"] = pdf.a + pdf.t * 2.0
    got = M.uplift_scores(spark.createDataFrame(pdf), ["a"], "t", "y", ["id"]).agg(F.avg("uplift")).first()[0]
    assert got == pytest.approx(2.0, abs=.2)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("naïve".encode())
    (tmp_path / "b.md").write_bytes("naïve".encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == got["b.md"].text == "naïve" and got["c.bin"].text is None
    assert got["c.bin"].size_bytes == 2
    csv = tmp_path / "s.csv"
    csv.write_text("date,sales,quantity,region\n2024-01-15,12500.50,25,North\n2024-01-16,,3,South\n")
    df = files.read_csv(spark, str(csv))
    assert dict(df.dtypes) == {"date": "date", "sales": "double", "quantity": "int", "region": "string"}
    records = tmp_path / "r.json"
    records.write_text('[{"date":"2024-01-15","created_at":"soon","v":1},{"date":"2024-01-16","created_at":"2024-01-01","v":null}]')
    back = files.read_json_records(spark, str(records), multi_line=True)
    assert dict(back.dtypes) == {"created_at": "string", "date": "timestamp_ntz", "v": "bigint"}
    with pytest.raises(ValueError):
        files.read_source(spark, "snowflake", {})


def test_plain_numbers(spark):
    values = [0.0, -3.5, 499978.59, 10000000.0, 12345678.9, 0.0001, 1e15]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(P.plain_number(F.col("x"))).collect()]
    assert got == ["0.0", "-3.5", "499978.59", "10000000.0", "12345678.9", "0.0001", "1000000000000000.0"]


def test_snapshots_are_listed_newest_first(spark, tmp_path):
    for day in ("2024-01-02", "2024-01-03", "2024-01-01"):
        kept = R.append_snapshot(spark.createDataFrame([("m", day)], "model_id string, captured_at string"), str(tmp_path / "s"))
    assert [r.captured_at for r in R.list_snapshots(kept, "m").collect()] == ["2024-01-03", "2024-01-02", "2024-01-01"]
    assert R.list_snapshots(kept, "other").count() == 0


def test_range_join_of_any_length(spark):
    import random
    r = random.Random(8)
    points = [(i, None if i == 3 else r.uniform(-500, 500)) for i in range(200)] + [(1000 + i, 7.0) for i in range(300)]
    ranges = [(j, a, a + r.choice([0.0, 0.01, 1.0, 64.0, 700.0, 1e7, -5.0])) for j, a in enumerate(r.uniform(-600, 500) for _ in range(120))]
    ranges += [(900, None, 5.0), (901, -1e12, 1e12)]
    left = spark.createDataFrame(points, "_level int, `v.1` double")
    right = spark.createDataFrame(ranges, "_cell int, low double, high double")
    got = sorted((x["_level"], x["_cell"]) for x in RL.range_join(left, right, "v.1", "low", "high", 2.0).collect())
    assert got == sorted((i, j) for i, v in points for j, a, b in ranges if None not in (v, a) and a <= v < b)
    assert RL.range_join(left, right.limit(0), "v.1", "low", "high", 2.0).collect() == []
    lists = right.select("_cell", F.size(RL.dyadic_cells(F.floor(F.col("low") / 2.0), F.floor(F.col("high") / 2.0))).alias("n")).filter("low < high")
    assert lists.agg(F.max("n")).first()[0] <= 84


def test_range_join_counts_without_listing_pairs(spark):
    import random
    r = random.Random(9)
    points = [(None,), (float("nan"),), (float("inf"),), (0.0,), (-0.0,)] + [(r.choice([7.0, r.uniform(-500, 500)]),) for _ in range(400)]
    ranges = [(j % 90, a, a + r.choice([0.0, 0.01, 64.0, 700.0, 1e7, -5.0])) for j, a in enumerate([*(r.uniform(-600, 500) for _ in range(120)), 7.0, 7.0, -0.0])]
    ranges += [(900, None, 5.0), (901, -1e12, 1e12), (None, 0.0, 8.0), (None, 0.0, 8.0), (902, 7.0, 7.5), (903, 0.0, float("inf"))]
    left, right = spark.createDataFrame(points, "`v.1` double"), spark.createDataFrame(ranges, "up_to int, low double, high double")
    got = RL.range_join(left, right, "v.1", "low", "high", 2.0, count="at").collect()
    want = [(j, a, b, sum(v is not None and a <= v < b for v, in points)) for j, a, b in ranges if None not in (a, b) and a < b]
    assert sorted(map(str, map(tuple, got))) == sorted(str(w) for w in want if w[3])
    assert RL.range_join(left, right.limit(0), "v.1", "low", "high", 2.0, count="n").collect() == []
    assert RL.range_join(left.limit(0), right, "v.1", "low", "high", 2.0, count="n").collect() == []
    # As many pairs as the product of both tables: listed, they would not end.
    many, wide = spark.range(200_000), spark.range(100_000).select((F.col("id") % 10).alias("low"), F.lit(10 ** 9).alias("high"))
    assert RL.range_join(many, wide, "id", "low", "high", 1.0, count="n").agg(F.sum("n")).first()[0] == 100_000 * 200_000 - 450_000


def test_the_any_length_join_stays_small(spark, tmp_path):
    from __spark_entry__ import queries
    spark.range(30_000).select(F.col("id").alias("c_custkey"), (F.col("id") / 3).alias("c_acctbal")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(30_000).select((F.col("id") * 4 + 3).alias("s_suppkey"), F.lit(-1.0).alias("s_acctbal")).write.parquet(str(tmp_path / "supplier.parquet"))
    out = queries()["q8_range_join_any_length"](spark, str(tmp_path))
    assert [tuple(x) for x in out.agg(F.count(F.lit(1)), F.min("n"), F.max("n")).collect()] == [(30_000, 30_000, 30_000)]


def test_forests_of_many_rows_are_fitted_to_cells(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"id": range(3000), "a": rng.normal(0, 1, 3000), "c": rng.choice(["p", "q", "r", None], 3000), "b": rng.integers(0, 3, 3000)})
    pdf["y"] = pdf.a * 3 + (pdf.c == "q") * 5 + rng.normal(0, .1, 3000)
    pdf["label"] = np.where(pdf.y > 4, "high", np.where(pdf.y > 1, "mid", "low"))
    df = spark.createDataFrame(pdf)
    results = []
    for many in (0, 10 ** 9):
        by_value, weights, model = M.fit_regressor(df.drop("label"), "y", ["id"], trees=6, max_depth=6, many=many)
        by_class, shares, classes = M.fit_classifier(df.drop("y"), "label", ["id"], trees=6, max_depth=6, many=many)
        assert isinstance(model, M.CellForest) and isinstance(classes, M.CellForest) if many == 0 else not isinstance(model, M.CellForest)
        slots = {r.feature: r.importance for r in weights.collect()}
        assert set(slots) == {"a", "b", "c_q", "c_r"} == {r.feature for r in shares.collect()} and sum(slots.values()) == pytest.approx(1)
        results.append((by_value.first().test_rows, by_value.first().r2_score, by_class.first().accuracy, slots["a"]))
    assert results[0] == pytest.approx(results[1], abs=.03) and results[0][1] > .9 and results[0][2] > .85


def test_draws_of_cells_are_those_of_their_rows(spark):
    rows = spark.range(40_000).select((F.col("id") % 4).alias("cell"), (F.col("id") % 8).cast("double").alias("label"), F.lit(1).cast("bigint").alias("n"))
    equal = rows.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
    for given in (rows, equal):
        drawn = M._drawn(M.with_workers(given), 50).toPandas()
        assert len(drawn) == 4 * 50 and drawn.groupby("tree").weight.sum().std() == pytest.approx(200, rel=.35)
        assert drawn.weight.mean() == pytest.approx(10_000, rel=.01) and drawn.weight.std() == pytest.approx(100, rel=.3)
        assert (drawn.label - drawn.cell - 2).abs().max() < .1  # means of k and k + 4
