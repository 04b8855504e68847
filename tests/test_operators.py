"""Small tables with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import blanks
from tessera.operators import aggregates, arrays, frame, intervals, search, spatial
from tessera.plans import flow, overlay, rowlang
from tessera.sources import binary, text


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_joins(spark):
    left = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, x int")
    right = spark.createDataFrame([(2, 200), (3, 300), (4, 400)], "id int, y int")
    assert rows(frame.join(left, right, "id"), "id") == [(2, 20, 200), (3, 30, 300)]
    assert rows(frame.join(left, right, "id", "left"), "id") == [(1, 10, None), (2, 20, 200), (3, 30, 300)]
    assert rows(frame.join(left, right, "id", "right"), "y") == [(2, 20, 200), (3, 30, 300), (None, None, 400)]
    assert frame.join(left, right, "id", "full").count() == 4
    assert rows(frame.semi(left, right, "id").select("id"), "id") == [(2,), (3,)] and rows(frame.anti(left, right, "id").select("id"), "id") == [(1,)]
    clash = frame.join(left, left, "id")
    assert clash.columns == ["id", "x", "x_r"]


def test_groups(spark):
    df = spark.createDataFrame([("BIF", 60.0, 0.1), ("BIF", 62.0, 0.2), ("ITA", 55.0, 0.3), ("ITA", 58.0, 0.4)], "lith string, fe double, au double")
    out = rows(df.groupBy("lith").agg(F.avg("fe"), F.sum("au"), F.count("fe"), frame.sample_std("fe")), "lith")
    assert out[0][:2] == ("BIF", 61.0) and out[0][2] == pytest.approx(0.3) and out[0][3] == 2
    assert frame.fold(df, ["fe", "au"]).count() == 8


def test_sort_and_dedupe(spark):
    df = spark.createDataFrame([("B", 1), ("A", 3), ("B", 9), ("A", 2), ("B", 5), (None, 7)], "lito string, grade int")
    assert [tuple(r) for r in frame.ordered(df, "lito", ("grade", "desc")).collect()] == [("A", 3), ("A", 2), ("B", 9), ("B", 5), ("B", 1), (None, 7)]
    assert rows(frame.dedupe(df, ["lito"], ["grade"]), "grade") == [("B", 1), ("A", 2), (None, 7)]


def test_profile(spark):
    df = spark.createDataFrame([(v,) for v in ("1", "", "2", "oops", "3", "NA")], "grade string")
    r = aggregates.profile(df, "grade").first()
    assert (r["count"], r["n"], r["nulls"], r["bad"], r["max"]) == (6, 3, 2, 1, 3.0)


def test_weighted_spread_about_a_large_mean(spark):
    v = [1e9 + x for x in (0.1, 0.2, 0.3, 0.4)]
    df = spark.createDataFrame([(x, 2.0) for x in v], "v double, w double").repartition(3)
    r = aggregates.weighted(df, [], "v", "w").first()
    want = sum(2 * (x - sum(v) / 4) ** 2 for x in v) / 7
    assert r["variance"] == pytest.approx(want, rel=1e-6)


def test_bias_corrected_moments(spark):
    v = np.random.default_rng(0).gamma(2, 1, 500)
    r = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(5).agg(aggregates.moments(F.col("v")).alias("m")).first()["m"]
    n, d = len(v), v - v.mean()
    g1, g2 = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3
    assert r["skewness"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2)) and r["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    few = spark.createDataFrame([(1.0,), (2.0,)], "v double").agg(aggregates.moments(F.col("v")).alias("m")).first()["m"]
    assert few["skewness"] is None and few["kurtosis"] is None


def test_interval_union(spark):
    s = "hole string, f double, t double, "
    a = spark.createDataFrame([("H1", 0.0, 2.0, 1.0)], s + "Fe double")
    b = spark.createDataFrame([("H1", 0.0, 1.0, "X"), ("H1", 1.0, 2.0, "Y")], s + "LITO string")
    assert rows(intervals.segments(a, b, "hole", "f", "t"), "f") == [("H1", 0.0, 1.0, 1.0, "X"), ("H1", 1.0, 2.0, 1.0, "Y")]
    gap = spark.createDataFrame([("H1", 3.0, 4.0, 5.0)], s + "Fe double")
    out = intervals.segments(a, gap, "hole", "f", "t")
    assert out.columns[-2:] == ["Fe", "Fe_2"] and rows(out, "f") == [("H1", 0.0, 2.0, 1.0, None), ("H1", 3.0, 4.0, None, 5.0)]


def test_composite(spark):
    df = spark.createDataFrame([("H", 0.0, 1.0, 10.0, "a"), ("H", 1.0, 3.0, 20.0, "a"), ("H", 3.0, 4.0, None, "a"), ("H", 4.0, 5.0, 50.0, "b")], "hole string, f double, t double, g double, c string")
    out = intervals.composite(df, "hole", "f", "t", 2.0, ["c"], ["g"], ["c"]).select("f", "t", "g", "g_support", "c")
    assert rows(out, "f") == [(0.0, 2.0, 15.0, 2.0, "a"), (2.0, 4.0, 20.0, 1.0, "a"), (4.0, 5.0, 50.0, 1.0, "b")]
    assert intervals.composite(df, "hole", "f", "t", 2.0, ["c"], ["g"]).count() == 3 and intervals.default_length(df, "f", "t") == 1.0


def test_minimum_curvature_follows_a_circle(spark):
    radius, n = 100.0, 9
    stations = [("H", radius * math.radians(10 * i), 0.0, 90.0 - 10 * i) for i in range(n)]
    collars = spark.createDataFrame([("H", 0.0, 0.0, 0.0)], "hole string, x double, y double, z double")
    out = intervals.traces(collars, spark.createDataFrame(stations, "hole string, depth double, az double, dip double"), "hole", "depth", "az", "dip")
    for r in out.orderBy("depth").collect():
        a = r["depth"] / radius
        assert r["y"] == pytest.approx(radius * (1 - math.cos(a)), abs=1e-9) and r["z"] == pytest.approx(-radius * math.sin(a), abs=1e-9)


def test_survey_cleanup(spark):
    s = spark.createDataFrame([("H", 30.0, 1.0, 60.0), ("H", 10.0, 2.0, 60.0), ("H", 30.0, 9.0, 70.0), ("H", float("nan"), 0.0, 60.0), ("H", 50.0, 0.0, 95.0)], "hole string, depth double, az double, dip double").coalesce(1)
    assert rows(intervals.stations(s, "hole", "depth", "az", "dip"), "depth") == [("H", 0.0, 2.0, 60.0), ("H", 10.0, 2.0, 60.0), ("H", 30.0, 9.0, 70.0)]


def test_findings(spark):
    df = spark.createDataFrame([("A", 0.0, 10.0), ("A", 10.0, 5.0), ("A", 20.0, 30.0), ("A", 25.0, 25.0)], "hole string, f double, t double")
    assert {r["check"]: r["n"] for r in intervals.summary(intervals.findings(df, "hole", "f", "t"), "hole").collect()} == {"inverted": 1, "gap": 1, "overlap": 1, "empty": 1}


def test_tokens_and_edits(spark):
    df = spark.createDataFrame([("A quick brown fox jumps over the lazy dog, CAFÉ",)], "t string")
    assert df.select(search.tokens(F.col("t"))).first()[0] == ["quick", "brown", "fox", "jumps", "over", "lazy", "dog", "cafe"]
    assert search.edit_distance("foo", "ofo", 2) == 1 and search.edit_distance("foo", "xyzzy", 1) == 2 and search.edit_distance("", "ab", 3) == 2


def test_search_ranks_the_boosted_field(spark):
    docs = spark.createDataFrame([("d1", "encryption", "keys and locks"), ("d2", "storage", "encryption of disks at rest and in flight"), ("d3", "other", "nothing here")], "id string, title string, body string")
    found = search.Index.build(docs, "id", {"title": 3.0, "body": 1.0}).search(spark.createDataFrame([(1, "Encryption")], "q int, text string"), "q", "text")
    assert [r["doc"] for r in found.orderBy("rank").collect()] == ["d1", "d2"]


def test_flow_computes_what_changed(spark, sf):
    f = flow.Flow(spark).add("in", "load", {"path": f"{sf}/part.parquet"}).add("some", "filter", {"where": "p_size > 10"}, ("in",)).add("n", "stats", {"spec": {"n": {"op": "count"}}}, ("some",))
    one = f.pull("n").first()["n"]
    f.add("some", "filter", {"where": "p_size > 40"}, ("in",))
    assert f.pull("n").first()["n"] < one and f.computed == ["in", "some", "n", "some", "n"]
    f.pull("n")
    assert len(f.computed) == 5
    with pytest.raises(ValueError):
        f.add("in", "filter", {}, ("n",))


def test_overlay_versions(spark):
    base = spark.createDataFrame([(1, "ox", 0.5), (2, "su", 1.5)], "id int, lito string, grade double")
    log = spark.createDataFrame([(1, 1, "grade", "9"), (2, 1, "grade", None), (3, 2, "lito", "tr")], overlay.PATCH)
    assert rows(overlay.apply(base, log, "id", 1), "id") == [(1, "ox", 9.0), (2, "su", 1.5)]
    assert rows(overlay.apply(base, log, "id"), "id") == [(1, "ox", None), (2, "tr", 1.5)]


def test_sniffing():
    k = text.sniff(["# made by hand", "id;grade;lito", "1;1,5;ox", "2;0,8;", '3;2,25;"a;b"'])
    assert (k.separator, k.header, k.decimal, k.names, k.types) == (";", True, ",", ("id", "grade", "lito"), ("double", "double", "string"))
    assert text.sniff(["1,2", "3,4"]).header is False


def test_workbook_round_trip():
    table = [["a", "b"], [1.5, "x & <y>"], [None, True], [2.0, None]]
    assert binary.sheet_rows(binary.write_sheet(table)) == [["a", "b"], [1.5, "x & <y>"], [None, True], [2.0, None]]


def test_dates_and_rounding(spark):
    r = spark.sql("select date '1900-01-31' a, date '1900-03-01' b, -2.5d c").select(blanks.date_serial(F.col("a")), blanks.date_serial(F.col("b")), blanks.round_half_up(F.col("c")), blanks.date_from_serial(F.lit(61)).cast("string")).first()
    assert tuple(r) == (31, 61, -2.0, "1900-03-01")


def test_kriging_is_exact_at_samples(spark):
    s = spark.createDataFrame([(i, float(i * 10), float(i % 3 * 10), float(i)) for i in range(12)], "id long, x double, y double, v double")
    out = spatial.krige(s, s, "id", ["x", "y"], "v", 4, 20.0, (0.0, 1.0, 50.0))
    for r in out.collect():
        assert r["estimate"] == pytest.approx(r["id"], abs=1e-5) and r["variance"] == pytest.approx(0, abs=1e-5)


def test_flow_accumulation_on_a_slope(spark):
    a = spark.createDataFrame([(i, j, float(10 - i)) for i in range(6) for j in range(1)], "i long, j long, v double")
    assert rows(arrays.accumulation(arrays.flow_direction(a)), "i") == [(i, 0, i + 1) for i in range(6)]


def test_validation_of_holes(spark):
    nan = float("nan")
    collars = spark.createDataFrame([("H1", 0.0, 0.0, 100.0, 10.0), ("H2", 0.0, 0.0, 0.0, None), ("H1", 9.0, 9.0, 9.0, 9.0), ("H3", nan, 0.0, 0.0, None), ("H4", 0.0, 0.0, 101.0, None)], "hole string, x double, y double, z double, eoh double").coalesce(1)
    surveys = spark.createDataFrame([("H1", 0.0), ("H1", 12.0), ("HX", 0.0)], "hole string, depth double")
    table = spark.createDataFrame([("H1", 0.0, 5.0), ("H1", 5.0, 3.0), ("HY", 0.0, 1.0), ("H1", 3.0, 3.0), ("H4", 0.0, 2.0)], "hole string, f double, t double")
    usable, counts = intervals.validate(collars, surveys, table, "hole", "f", "t")
    assert {r["check"]: r["n"] for r in counts.collect()} == {"dup-collar": 1, "bad-collar": 1, "bad-interval": 2, "orphan-survey": 1, "orphan-interval": 1, "survey-past-eoh": 1}
    assert [r["hole"] for r in usable.orderBy("hole").collect()] == ["H1", "H4"] and usable.where("hole = 'H1'").first()["x"] == 0.0


def test_axis_geometry(spark):
    df = spark.createDataFrame([(5.0 + 2.5 * i,) for i in range(8) for _ in range(3) if i != 4], "x double")
    assert tuple(intervals.axis_geometry(df, "x").first()) == (5.0, 2.5, 8)


def test_sinks_and_watersheds(spark):
    z = np.array([[9, 9, 9, 9, 9], [9, 3, 4, 8, 9], [9, 4, 2, 7, 6], [9, 8, 7, 7, 9], [9, 9, 9, 9, 9]], dtype=float)
    a = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(5) for j in range(5)], "i long, j long, v double")
    got = {(r["i"], r["j"]): r["v"] for r in arrays.fill_sinks(a).collect()}
    assert got[2, 2] == got[1, 1] == got[1, 2] == 7.0 and got[1, 3] == 8.0 and got[0, 0] == 9.0
    slope = spark.createDataFrame([(i, 0, float(10 - i)) for i in range(6)], "i long, j long, v double")
    assert {(r["oi"], r["oj"]) for r in arrays.watershed(arrays.flow_direction(slope)).collect()} == {(5, 0)}


def test_variogram_fit():
    h = np.arange(10, 200, 10)
    gamma = 0.2 + 1.3 * np.where(h < 120, 1.5 * h / 120 - 0.5 * (h / 120) ** 3, 1)
    nugget, sill, reach = aggregates.fit_variogram([(float(x), float(y), 50) for x, y in zip(h, gamma)])
    assert nugget == pytest.approx(0.2, abs=0.05) and sill == pytest.approx(1.3, abs=0.05) and reach == pytest.approx(120, abs=8)


def test_nearest_rows_are_exact(spark):
    from tessera.operators import learning

    v = np.random.default_rng(4).normal(size=(300, 16))
    v[7] = v[250]
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0] * 3)], "id long, v array<double>")
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    for block in (40, 2048):
        got = {}
        for r in learning.nearest(df.where("id % 10 = 0"), df, "id", "v", 3, block).orderBy("q", "rank").collect():
            got.setdefault(r["q"], []).append(r["similarity"])
        assert sorted(got) == list(range(0, 300, 10))
        assert all(np.allclose(got[i], np.sort(s[i])[::-1][:3]) for i in got)


def test_point_queries_without_sql_take_all_customers(spark):
    from tessera.queries import extras

    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    assert n > 601 and extras.normal_scores(spark, sf).count() == n == extras.cluster_by_density(spark, sf).count()


def test_components_of_a_long_chain_and_a_star(spark):
    import random

    chain = list(range(1000, 1300))
    random.Random(1).shuffle(chain)
    edges = [*zip(chain, chain[1:]), *((7, k) for k in range(8, 60)), (5, 5)]
    found = {r["a"]: r["l"] for r in spatial.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{c: 1000 for c in chain}, **{k: 7 for k in range(7, 60)}, 5: 5}


def test_interval_lookup_without_and_with_a_key(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", 10.0), (3, "b", 25.0), (4, "b", None), (5, "c", 1.0), (6, None, 12.0)], "id int, hole string, depth double")
    ref = spark.createDataFrame([("a", 0.0, 10.0, "x"), ("a", 10.0, 20.0, "y"), ("b", 20.0, 30.0, "z"), (None, 11.0, 13.0, "n")], "hole string, `from` double, `to` double, code string")
    get = lambda text: {r["id"]: r["c"] for r in rowlang.Transform(text).run(df, {"d": ref}, order=["id"]).collect()}
    assert get("c = lookup d.code where d.hole == hole and d.from <= depth < d.to") == {1: "x", 2: "y", 3: "z", 4: None, 5: None, 6: "n"}
    assert get("c = lookup d.code where d.from <= depth < d.to") == {1: "x", 2: "y", 3: "z", 4: None, 5: "x", 6: "n"}


def test_overlap_join_without_a_key(spark):
    import random

    r = random.Random(3)
    mine = [(i, float(a), a + r.choice([0.0, 1.0, 7.5, 100.0])) for i in range(40) for a in [r.randrange(-50, 200)]] + [(99, None, 1.0)]
    theirs = [(float(a), a + r.choice([0.5, 3.0, 60.0]), r.random()) for _ in range(50) for a in [r.randrange(-50, 200)]]
    df, ref = spark.createDataFrame(mine, "id int, f double, t double"), spark.createDataFrame(theirs, "`from` double, `to` double, v double")
    out = rowlang.Transform("n = count() where overlap(a.from, a.to, f, t)\ns = sum(a.v) where overlap(a.from, a.to, f, t)").run(df, {"a": ref}, order=["id"]).collect()
    assert len(out) == len(mine)
    for row in out:
        hit = [v for lo, hi, v in theirs if row["f"] is not None and lo < row["t"] and hi > row["f"]]
        assert row["n"] == len(hit) and (row["s"] or 0) == pytest.approx(sum(hit))


def test_geoeas_of_one_variable_and_quoted_line_breaks(spark, tmp_path):
    from tessera.sources import text

    (tmp_path / "one.dat").write_text("title\n1\ngrade\n3\n1\n5\n1\n")
    assert [r[0] for r in text.read_geoeas(spark, str(tmp_path / "one.dat")).collect()] == [3, 1, 5, 1]
    (tmp_path / "q.csv").write_text('id,note\n1,"x\ny"\n2,"a ""b"""\n')
    assert [tuple(r) for r in text.read_csv(spark, str(tmp_path / "q.csv")).collect()] == [(1.0, "x\ny"), (2.0, 'a "b"')]
    (tmp_path / "t.csv").write_text("a,b\n" + "1,2\n" * 300 + "x,2\n" * 300)
    assert dict(text.read_csv(spark, str(tmp_path / "t.csv")).dtypes) == {"a": "string", "b": "double"}


def test_search_terms(spark):
    from tessera.operators import search

    rows = spark.createDataFrame([("Don't 'quote' from you Ångström's café, naïve Über 東京 x",)], "t string").select(search.tokens(F.col("t")).alias("t")).first()[0]
    assert rows == ["don't", "quote", "angstrom's", "cafe", "naive", "uber", "東京"]


def test_search_expands_terms_that_the_index_lacks(spark):
    from tessera.operators import search

    docs = spark.createDataFrame([(1, "encryption keys"), (2, "sondage drilling"), (3, "borehole drilling")], "id int, body string")
    index = search.Index.build(docs, "id", {"body": 1.0})
    ask = lambda text, **o: [r["doc"] for r in index.search(spark.createDataFrame([(0, text)], "q0 int, text string"), "q0", "text", **o).orderBy("rank").collect()]
    assert ask("encryp") == [] and ask("encryp", prefix=True) == [1]
    assert ask("borehloe", fuzzy=2) == [3] and ask("kesy", fuzzy=2) == []
    assert ask("well", synonyms={"well": ["borehole"]}) == [3]


def test_density_clusters_against_all_pairs(spark):
    import random

    def plain(points, radius, least):
        near = {a: [b for b, *q in points if sum((u - v) ** 2 for u, v in zip(p, q)) ** 0.5 <= radius] for a, *p in points}
        core = {a for a in near if len(near[a]) >= least}
        label = {a: a for a in core}
        while any(label[b] < label[a] for a in core for b in near[a] if b in core):
            label = {a: min(label[b] for b in near[a] if b in core) for a in core}
        return {a: label.get(a, min((label[b] for b in near[a] if b in core), default=None)) for a in near}

    r = random.Random(5)
    blobs = [(i, r.choice([0.0, 9.0, 14.0]) + r.gauss(0, 1.1), r.choice([0.0, 5.0]) + r.gauss(0, 0.8)) for i in range(150)]
    # two dense cells that only one pair of points joins, and two that lie just too far apart
    grid = [(1000 + i, 100 + i % 10 * 0.06, 100 + i // 10 * 0.15) for i in range(40)]
    joined = [*grid, *((k + 1000, x + 1.53, y) for k, x, y in grid), *((k + 2000, x, y + 1.55) for k, x, y in grid)]
    for points, radius, least in ((blobs, 0.6, 4), (blobs, 0.3, 3), (joined, 1.0, 4)):
        df = spark.createDataFrame([*points, (9001, None, 1.0), (9002, float("nan"), 1.0)], "id long, x double, y double")
        found = {k["id"]: k["cluster"] for k in spatial.dbscan(df, "id", ["x", "y"], radius, least).collect()}
        assert found == plain(points, radius, least) | {9001: None, 9002: None}


def test_full_cells_of_a_distance_join_are_dealt_into_groups(spark, monkeypatch):
    import random

    r = random.Random(6)
    rows = [(i, r.choice([0.5, r.uniform(-3, 3)]), r.choice([0.5, r.uniform(-3, 3)])) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None, 0.0)], "id long, x double, y double")
    want = sorted((a, b) for a, *p in rows for b, *q in rows if abs(p[0] - q[0]) + abs(p[1] - q[1]) <= 0.7)
    monkeypatch.setattr(spatial, "CHUNK", 16)
    monkeypatch.setattr(spatial, "PAIRS", 5_000)
    out = spatial.within(df, df, "id", ["x", "y"], 0.7, "cityblock")
    assert sorted((p["a"], p["b"]) for p in out.collect()) == want
    assert out.rdd.getNumPartitions() > 4


def test_rows_that_ask_the_same_meet_the_others_once(spark, monkeypatch):
    kept, keep = [], rowlang.keep
    monkeypatch.setattr(rowlang, "keep", lambda df: kept.append(out := keep(df)) or out)
    mine = [(i, "a" if i % 2 else None, float(i % 3), i % 3 + 2.0) for i in range(90)] + [(900, "b", None, 1.0), (901, "z", 0.0, 9.0)]
    theirs = [("a", 0.0, 1.0, 5.0), ("a", 1.5, 4.0, 2.0), (None, 1.0, 2.5, 3.0), ("b", 0.0, 1.0, 1.0), ("a", 0.5, 0.75, None)]
    df, ref = spark.createDataFrame(mine, "id int, h string, f double, t double"), spark.createDataFrame(theirs, "h string, `from` double, `to` double, v double")
    text = "n = count() where a.h == h and overlap(a.from, a.to, f, t)\ns = wmean(a.v, overlap) where a.h == h and overlap(a.from, a.to, f, t)\nw = sum(a.v * f) where a.h == h and overlap(a.from, a.to, f, t)"
    for row in rowlang.Transform(text).run(df, {"a": ref}, order=["id"]).collect():
        hit = [(v, min(hi, row["t"]) - max(lo, row["f"])) for h, lo, hi, v in theirs if row["f"] is not None and h == row["h"] and lo < row["t"] and hi > row["f"]]
        some = [(v, o) for v, o in hit if v is not None]
        assert row["n"] == len(hit) and row["s"] == (pytest.approx(sum(v * o for v, o in some) / sum(o for _, o in some)) if some else None)
        assert row["w"] == (pytest.approx(sum(v * row["f"] for v, _ in some)) if some else None)
    assert max(k.count() for k in kept) == 8


def test_variogram_of_full_cells_against_all_pairs(spark, monkeypatch):
    import random

    from tessera.operators import aggregates

    r = random.Random(8)
    rows = [(i // 2, r.choice([1.0, r.uniform(0, 9)]), r.choice([2.0, r.uniform(-4, 4)]), r.gauss(0, 1)) for i in range(200)] + [(500, 1.0, None, 1.0), (501, 1.0, 1.0, None)]
    met, meet = [], spatial.meet
    monkeypatch.setattr(spatial, "meet", lambda *a: met.append(out := meet(*a)) or out)
    monkeypatch.setattr(spatial, "CHUNK", 16)
    monkeypatch.setattr(spatial, "PAIRS", 5_000)
    got = {x["class"]: x for x in aggregates.variogram(spark.createDataFrame(rows, "id int, x double, y double, v double"), "id", ["x", "y"], "v", 1.0, 3).collect()}
    want = {}
    for a, ax, ay, av in rows[:200]:
        for b, bx, by, bv in rows[:200]:
            h = ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5
            if a < b and 0 < h < 3:
                want.setdefault(int(h), []).append((h, (av - bv) ** 2))
    assert {c: x["pairs"] for c, x in got.items()} == {c: len(v) for c, v in want.items()}
    for c, v in want.items():
        assert got[c]["distance"] == pytest.approx(sum(h for h, _ in v) / len(v)) and got[c]["gamma"] == pytest.approx(sum(d for _, d in v) / len(v) / 2)
    assert met[0].rdd.getNumPartitions() > 4


def test_nearest_of_dense_points_meets_few(spark, monkeypatch):
    import random

    r = random.Random(9)
    rows = [(i, r.choice([0.0, 0.5, r.uniform(0, 1)]), r.choice([0.0, r.uniform(0, 1)])) for i in range(600)] + [(700, 400.0, -3.0)]
    df = spark.createDataFrame([*rows, (800, None, 0.0), (801, float("nan"), 0.0)], "id long, x double, y double")
    seen, within = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a: seen.append(out := within(*a)) or out)
    got = {}
    for p in spatial.nearest(df.where("id % 5 = 0"), df, "id", ["x", "y"], 3, 200.0).orderBy("rank").collect():
        got.setdefault(p["a"], []).append(p["b"])
    far = lambda p, q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5
    assert got == {p[0]: [q[0] for q in sorted(rows, key=lambda q: (far(p, q), q[0]))[:3]] for p in rows if p[0] % 5 == 0}
    assert seen[0].count() < 120 * 60


def test_describe_holds_no_column_in_one_task(spark):
    from tessera.operators import frame

    rows = [(float(v), v) for v in range(1, 8)] + [(float("inf"), None)]
    out = frame.describe(spark.createDataFrame(rows, "x double, n int").withColumn("z", F.lit(None).cast("double")), ["x", "n", "z"])
    assert "percentile" not in out._jdf.queryExecution().toString().lower()
    got = {r["column"]: tuple(r)[4:] for r in out.collect()}
    assert got == {"x": (1.0, 2.75, 4.5, 6.25, float("inf")), "n": (1.0, 2.5, 4.0, 5.5, 7.0), "z": (None,) * 5}


def test_sums_over_few_groups_go_to_the_rows(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("g"), F.col("id") % 4)).alias("g"))
    out = rowlang.Transform("m = mean(id) over g\nn = count() over g where id < 10").run(df, order=["id"])
    assert "hashpartitioning(g" not in out._jdf.queryExecution().toString()
    got = {r["id"]: (r["m"], r["n"]) for r in out.collect()}
    assert len(got) == 1000 and all(got[i] == (498.0 + i % 4, 3 if i % 4 < 2 else 2) for i in got)


def test_vocabulary_counts_documents_where_they_are(spark):
    from tessera.operators import search

    docs = spark.createDataFrame([(1, "ab cd ab", "cd"), (1, "ef", None), (2, "cd x", "gh"), (None, "only nulls", "cd")], "id int, t string, u string")
    for fields, want in (({"t": 1.0}, {"ab": 1, "cd": 2, "ef": 1, "only": 0, "nulls": 0}), ({"t": 1.0, "u": 2.0}, {"ab": 1, "cd": 2, "ef": 1, "gh": 1, "only": 0, "nulls": 0})):
        out = search.Index.build(docs, "id", fields).vocabulary()
        assert {r["term"]: r["df"] for r in out.collect()} == want
        assert "posexplode" not in out._jdf.queryExecution().toString()


def test_search_makes_vocabulary_and_hits_once(spark, monkeypatch):
    from tessera.operators import search

    index = search.Index.build(spark.createDataFrame([(1, "encryption keys"), (2, "drilling 'x'y東京")], "id int, body string"), "id", {"body": 1.0})
    kept, keep = [], search.keep
    monkeypatch.setattr(search, "keep", lambda df: kept.append(out := keep(df)) or out)
    found = index.search(spark.createDataFrame([(0, "encryp 東京")], "q0 int, text string"), "q0", "text", prefix=True)
    assert sorted(r["doc"] for r in found.collect()) == [1, 2]
    assert [k.columns for k in kept] == [["t"], ["term", "doc", "field", "tf", "first"]]
