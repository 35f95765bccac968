"""Hand-checked fixtures and properties of the library's operators."""

import io
import math
import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotweave.functions import numeric, tests as tail, text
from plotweave.operators import derive, funnel, graph, lattice, link, near, rank, stats, validate, weights
from plotweave.sources import layers, sinks, tables


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def sides(spark):
    tx = spark.createDataFrame([("a", 10.0, "park", True), ("b", 5.0, "home", False), ("b", 7.0, "home", False), ("b", 99.0, "park", True), ("d", 4.0, "", False), ("z", 8.0, "home", False)], "addr_key string, price double, purpose string, parking boolean")
    un = spark.createDataFrame([("a", True, False), ("b", False, False), ("b", False, True), ("b", True, False), ("d", False, True), ("d", False, True), ("d", False, True), ("z", False, True)], "addr_key string, parking boolean, parent boolean")
    layer = spark.createDataFrame([("a", 2.0), ("b", 4.0), ("c", 1.0), ("d", 2.0), ("z", 0.0)], "addr_key string, area double")
    return layer, tx, un


def test_fallback_collapse_and_scenarios(sides):
    got = {r.addr_key: r for r in derive.derived_value(*sides).collect()}
    assert (got["a"].price_stat, got["a"].price_fallback, got["a"].unit_fallback, got["a"].scenario) == (10.0, True, True, "S1_single_unit")
    assert (got["b"].price_stat, got["b"].n_units, got["b"].unit_value, got["b"].scenario) == (6.0, 2, 3.0, "S3_multi_several_sales")
    assert got["c"].scenario == "S4_no_sale_or_no_units" and got["c"].unit_value is None
    assert (got["d"].n_units, got["d"].n_units_rows, got["d"].parent_only) == (1, 3, True)
    assert got["z"].unit_value is None and got["z"].value == 8.0 and not got["z"].parent_only


def test_variants(sides):
    layer, tx, un = sides
    leave = derive.Variant(fallback="leave_undefined", blank="drop")
    assert values(derive.sale_aggregates(tx, leave), "addr_key") == [("b",), ("z",)]
    assert values(derive.unit_aggregates(un, derive.Variant(units="non_parking_non_parent")), "addr_key", "n_units") == [("a", 1), ("b", 1), ("d", 1), ("z", 1)]
    for bad in (derive.Variant(statistic="mode"), derive.Variant(sales="x"), derive.Variant(fallback="x")):
        with pytest.raises(ValueError):
            derive.sale_aggregates(tx, bad)


def test_order_of_filters(spark):
    df = spark.createDataFrame([(float(v), a) for v, a in [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0), (9, 1.0), (1000, -1.0), (900, None)]], "v double, a double")
    run = lambda order: [d.count() for _, d in funnel.exclude(df, order, ["v", "a"], "v")]
    assert run(["positivity", "iqr_outliers"]) == [7, 5, 4] and run(["iqr_outliers", "positivity"]) == [7, 7, 5]
    with pytest.raises(ValueError):
        funnel.exclude(df, ["other"], ["v"], "v")
    log = funnel.count_log(funnel.exclude(df, ["positivity"], ["v"], "v"))
    assert values(log, "position", "n") == [(0, 7), (1, 7)]


def test_quantile_and_rounding(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "v double")
    assert df.agg(F.percentile("v", 0.25)).first()[0] == 1.75
    assert spark.range(1).select(F.rint(F.lit(2.5)), F.rint(F.lit(3.5))).first()[:] == (2.0, 4.0)


def test_text(spark):
    df = spark.createDataFrame([(t,) for t in ("  Área   à-Vistoriar ", "GARAGEM HOTEL", "", "Straße Nº 5?", None)], "t string").withColumn("n", text.normalise(F.col("t")))
    assert [r.n for r in df.collect()] == ["AREA A VISTORIAR", "GARAGEM HOTEL", "", "STRASSE NO 5?", None]
    rules = [r[0] for r in df.select(text.classify(F.col("n"), text.RULES, "subcategory")).collect()]
    assert rules == ["residual_area", "garage_building", "unknown", None, None]
    names = spark.createDataFrame([("cd1g2b3k0",), ("xx1",)], "m string").select(text.decode_measure(F.col("m")).alias("d")).collect()
    assert names[0].d.asDict() == {"stem": "cd", "radius": 1, "gamma": 2, "beta": 3, "offset": 0} and names[1].d is None


def test_numeric(spark):
    df = spark.createDataFrame([("1.5", 0.0, 0.0), ("NA", 0.0, 1.0), ("x", 1.0, 0.0), ("", None, 1.0)], "s string, a double, b double")
    got = df.select(numeric.coerce(F.col("s")), numeric.rel_diff(F.col("a"), F.col("b")), numeric.verdict(F.col("a"), F.col("b"), 0.1), numeric.safe_div(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1.5, 0.0, "MATCH", None), (None, 1.0, "MISMATCH", 0.0), (None, math.inf, "MISMATCH", None), (None, None, "MISMATCH", None)]


def test_wildcards(spark):
    v = spark.createDataFrame([("SAO JOAO",), ("SOO JOAO",), ("A.B",), ("AXB",)], "w string")
    q = spark.createDataFrame([("S?O JOAO",), ("SA? JOAO",), ("A.B",), ("?Z",)], "q string")
    got = {r.q: (r.resolved, r.flags) for r in link.resolve(q, v, "q", "w").collect()}
    assert got == {"S?O JOAO": (None, "ambiguous"), "SA? JOAO": ("SAO JOAO", "wildcard"), "A.B": ("A.B", "exact"), "?Z": (None, "unresolved")}


def test_guarded_joins(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, a string"), spark.createDataFrame([(1, "p"), (2, "q")], "k int, b string")
    assert values(link.unambiguous_join(a, b, "k"), "k", "a", "b") == [(1, "x", "p")]
    with pytest.raises(Exception, match="not unique"):
        link.one_to_one(a, b, "k").collect()


def test_lattice(spark):
    g = lattice.Lattice(0.0, 0.0, 10.0)
    points = spark.createDataFrame([(0.0, 0.0), (g.step, -5.0), (0.0, -10.0), (-g.step, -5.0), (0.0, -5.0)], "x double, y double")
    assert [r.cell for r in lattice.assign(points, g).collect()] == ["0_0", "0_1", "1_0", "0_-1", None]
    seg = spark.createDataFrame([("a", 0.0, 0.0, 0.0, -10.0), ("b", 0.5, 0.5, 1.0, 1.0)], "seg string, x1 double, y1 double, x2 double, y2 double")
    cut = lattice.cut_by_cells(seg, g)
    assert values(cut, "seg", "cell") == [("a", "0_0"), ("a", "1_0"), ("b", "0_0")]
    assert cut.where("seg = 'a'").agg(F.sum("part")).first()[0] == pytest.approx(10)
    assert values(lattice.majority_cell(cut, "seg"), "seg", "cell") == [("a", "0_0"), ("b", "0_0")]


def test_ties_follow_the_key(spark):
    rows = [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, -1.0, 0.0), (4, 0.0, 1.0), (5, 0.0, -1.0), (6, 1.0, 0.0)]
    one = near.nearest(spark.createDataFrame(rows, "id long, x double, y double"), spark.createDataFrame(rows, "id long, x double, y double"), 2, self_join=True)
    back = spark.createDataFrame(rows[::-1], "id long, x double, y double").repartition(3)
    two = near.nearest(back, back, 2, self_join=True)
    assert values(one, "q_id", "r_id", "nth") == values(two, "q_id", "r_id", "nth")
    assert [r for r in values(one, "q_id", "r_id", "nth") if r[0] == 1] == [(1, 2, 1), (1, 3, 2)]
    assert values(weights.tie_exposure(back, 2).where("id = 1"), "tied") == [(True,)]
    with pytest.raises(Exception, match="not unique"):
        weights.require_unique(back.union(back), "id").collect()


def test_far_points_are_found(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "id long, x double, y double")
    r = spark.createDataFrame([(i, 1000.0 + i, 1000.0) for i in range(30)], "id long, x double, y double")
    assert values(near.nearest(q, r, 1), "q_id", "r_id") == [(1, 0), (2, 0)]


def test_graph(spark):
    seg = spark.createDataFrame([(1, "a", "b", 60.0, 60.0, 1.0), (2, "a", "b", 30.0, 60.0, 0.0), (3, "c", "c", 10.0, 60.0, 1.0), (4, "b", "d", 6.0, 30.0, 2.0)], "id long, node1 string, node2 string, dist double, speed double, area double")
    half = graph.least_edges(graph.midpoint_graph(seg))
    assert values(half.where("a = 'm:3'"), "b", "cost") == [("n:c", 5.0)]
    paths = {(r.source, r.node): r.cost for r in graph.shortest_paths(half, half.select(F.lit("m:1").alias("node")).distinct()).collect()}
    assert paths[("m:1", "m:4")] == 36.0 and ("m:1", "n:c") not in paths
    local = {(r.source, r.node): r.cost for r in graph.dijkstra_by_source(half, half.select(F.lit("m:1").alias("node")).distinct()).collect()}
    assert local == paths
    labels = graph.components(half)
    assert labels.select("component").distinct().count() == 2 and graph.largest_component(labels).count() == 6
    with pytest.raises(Exception, match="unusable"):
        graph.midpoint_graph(seg.withColumn("speed", F.lit(0.0))).collect()
    line = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "a string, b string, cost double")
    c = {r.node: (r.degree, r.betweenness) for r in graph.centralities(line, spark.createDataFrame([("a",), ("b",), ("c",)], "node string")).collect()}
    assert c == {"a": (1, 0.0), "b": (2, 2.0), "c": (1, 0.0)}
    mass = graph.evolve(graph.decay_kernel(graph.shortest_paths(line, spark.createDataFrame([("a",), ("b",), ("c",)], "node string")), 2.0), spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "node string, r double"), 1.0, 3)
    got = {r.node: r.mass for r in mass.collect()}
    assert sum(got.values()) == pytest.approx(4) and got["a"] == pytest.approx(got["c"])


def test_lm_identity_and_rule(spark):
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(i, float(i % 10), float(i // 10), float(v), float(x)) for i, (v, x) in enumerate(rng.normal(size=(100, 2)))], "id long, x double, y double, v double, x1 double")
    w = weights.knn_weights(pts, 4)
    s = stats.lm_tests(pts, "v", ["x1"], w)
    assert s["lm_err"] + s["rlm_lag"] == pytest.approx(s["lm_lag"] + s["rlm_err"])
    row = spark.createDataFrame([(9.0, 8.0, 1.0, 1.0, 0.01, 0.01, 0.2, 0.2), (9.0, 8.0, 1.0, 2.0, 0.01, 0.01, 0.01, 0.01), (1.0, 1.0, 1.0, 1.0, 0.5, 0.5, 0.5, 0.5), (None, 1.0, 1.0, 1.0, 0.5, 0.5, 0.5, 0.5)], "a double, b double, c double, d double, pa double, pb double, pc double, pd double")
    cols = [F.col(c) for c in "abcd"]
    p = [F.col("p" + c) for c in "abcd"]
    assert [r[0] for r in row.select(stats.lm_rule(*cols, p)[0]).collect()] == ["sem", "sarar", "ols", None]
    assert [r[0] for r in row.select(stats.lm_rule(*cols, p, both_robust="larger_robust_statistic")[0]).collect()][1] == "sar"


def test_tails():
    assert tail.normal_p(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tail.chi2_1_p(3.841458820694124) == pytest.approx(0.05, abs=1e-12)
    assert tail.t_p(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)


def test_choice_rule(spark):
    rows = []
    for k, (b1, p1, b2, p2, rho) in {1: (1, 0.01, 1, 0.5, 0.1), 2: (1, 0.01, -1, 0.5, 0.1), 3: (1, 0.01, -1, 0.01, 0.1), 4: (1, 0.01, 1, 0.01, 0.9), 5: (1, 0.01, 1, 0.01, 0.1)}.items():
        rows += [("l", k, "m1", float(b1), p1, rho, 0.2), ("l", k, "m2", float(b2), p2, rho, 0.2)]
    got = {r.k: r for r in rank.choice_rule(spark.createDataFrame(rows, "level string, k int, measure string, beta double, p double, rho double, lag double")).collect()}
    assert got[1].stable and not got[1].stable_all and got[1].satisfied and not got[1].holds_from_k
    assert not got[2].stable and not got[3].stable and got[3].n_flips == 1
    assert not got[4].interior and got[4].satisfied is False and got[5].stable is None and got[5].satisfied is None
    assert [got[k].interior_above for k in range(1, 6)] == [False, False, False, False, True]


def test_match_shares_and_gate(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (None, 1.0), (1.005, 1.0)], "c double, r double")
    s = df.agg(*validate.match_shares(F.col("c"), F.col("r"), 1e-9, 0.01)).first()
    assert (s.n, s.exact, s.within) == (4, 0.25, 0.5)
    exp = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "k string, target double")
    act = spark.createDataFrame([("a", 1.004), ("c", 5.0)], "k string, value double")
    assert validate.tally(validate.gate(exp, act, ["k"]), []).first()[:] == (2, 1, 1)
    assert values(validate.same_rows(df, df.limit(3)), "only_a", "only_b") == [(2, 0)]
    with pytest.raises(Exception, match="broken"):
        validate.require(df, F.col("c") == F.col("r"), "broken").collect()


def test_order_decides_thinned_points(spark):
    seg = spark.createDataFrame([("a", 0.0, 0.0, 20.0, 0.0), ("b", 20.0, 0.2, 0.0, 0.2)], "id string, x1 double, y1 double, x2 double, y2 double")
    p = validate.sample_points(seg)
    assert values(p.where("id = 'a'"), "x") == [(1.0,), (6.0,), (11.0,), (19.0,)]
    kept = validate.thin_points(p)
    assert kept.where("id = 'a'").count() == 4 and kept.count() < p.count()


def test_restricted_weights(spark):
    w = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 3), (5, 4)], "i long, j long").withColumn("w", F.lit(1.0))
    g = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b")], "id long, g string")
    assert values(weights.restrict(w, g), "i", "j") == [(1, 2), (2, 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("Price;Purpose\n1,5;Área é\n;NA\n".encode("cp850"))
    assert values(tables.read_text_table(spark, str(tmp_path / "t.csv"), ["Price", "Purpose"], encoding="cp850"), "Price", "Purpose") == [("", "NA"), ("1,5", "Área é")]
    got = tables.inventory(spark, str(tmp_path / "*.csv")).first()
    assert (got.lines, got.encoding) == (3, "cp850") and tables.probe_encoding("é".encode()) == "utf-8"

    book = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>v</t></si><si><t>a&amp;b</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>3.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(book.getvalue())
    assert values(tables.read_xlsx(spark, str(tmp_path / "b.xlsx"), ["v", "name"]), "v", "name") == [("3.5", "a&b")]

    np.savez(tmp_path / "a.npz", area=np.array([1.0, 2.0]), pc=np.array([7.0, 8.0]))
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "row long, area double")
    assert values(tables.attach_arrays(spark, df, "row", "area", str(tmp_path / "a.npz"), ["pc"]), "row", "pc") == [(0, 7.0), (1, 8.0)]
    with pytest.raises(Exception, match="array row differs"):
        tables.attach_arrays(spark, df.withColumn("area", F.lit(9.0)), "row", "area", str(tmp_path / "a.npz"), ["pc"]).collect()


def test_layers(spark, tmp_path):
    (tmp_path / "w.csv").write_text('id,geom\n1,"LINESTRING (0 0, 3 4)"\n2,"POINT (5 6)"\n')
    got = layers.read_wkt_table(spark, str(tmp_path / "w.csv"), 31982, 32722).collect()
    assert [(r.id, r.kind, [(p.x, p.y) for p in r.points]) for r in got] == [("1", "LINESTRING", [(0, 0), (3, 4)]), ("2", "POINT", [(5, 6)])]
    with pytest.raises(ValueError):
        layers.read_wkt_table(spark, str(tmp_path / "w.csv"), None, 31982)

    wkb = struct.pack("<BII4d", 1, 2, 2, 0.0, 1.0, 2.0, 3.0)
    db = sqlite3.connect(tmp_path / "l.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INT)")
    db.execute("CREATE TABLE seg (fid INTEGER PRIMARY KEY, node1 TEXT, geom BLOB)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('seg', 'geom', 31982)")
    db.execute("INSERT INTO seg VALUES (1, 'n', ?)", (b"GP\0\1" + struct.pack("<i", 31982) + wkb,))
    db.commit()
    db.close()
    r = layers.read_geopackage(spark, str(tmp_path / "l.gpkg"), "seg", ["node1"], 31982).first()
    assert r.node1 == "n" and [(p.x, p.y) for p in r.points] == [(0, 1), (2, 3)]

    body = struct.pack("<I4dII", 3, 0, 0, 0, 0, 1, 2) + struct.pack("<I4d", 0, 1.0, 2.0, 3.0, 4.0)
    (tmp_path / "s.shp").write_bytes(bytes(100) + struct.pack(">2I", 1, len(body) // 2) + body)
    field = b"dist".ljust(11, b"\0") + b"N" + bytes(4) + bytes([5]) + bytes(15)
    (tmp_path / "s.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, 1, 32 + 32 + 1, 6) + bytes(20) + field + b"\x0d" + b"  12.5")
    s = layers.read_shapefile(spark, str(tmp_path / "s"), ["dist"], 32722, 32722).first()
    assert s.dist == "12.5" and [(p.x, p.y) for p in s.points] == [(1, 2), (3, 4)]
    assert layers.read_shapefile(spark, str(tmp_path / "s"), ["dist"], 32722, 32722, geometry=False).columns == ["row", "dist"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b|c", 1.0), (1, "a", None)], "k int, s string, v double")
    assert sinks.write_sorted(df, str(tmp_path / "p"), ["k"]) == sinks.content_hash(df.repartition(3)) != sinks.content_hash(df.limit(1))
    sinks.write_csv(df, str(tmp_path / "c"), ["k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.write_manifest(df, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).orderBy("value").first()[0] == '{"k":1,"s":"a","v":null}'
    assert sinks.markdown(df.orderBy("k")).splitlines()[2:] == ["| 1 | a |  |", "| 2 | b\\|c | 1 |"]
    assert sinks.side_by_side({"x": df, "y": df}, ["k"]).columns == ["k", "s_x", "v_x", "s_y", "v_y"]


def test_folding_follows_compatibility_decomposition(spark):
    import unicodedata

    letters = [chr(c) for c in [*range(1, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x11000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F300)] if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts = ["ﬁnca № ½ ｆｕｌｌ ǆ ﷺ", "Ação", "", "plain", "a…b™", *(f"a{c}b" for c in letters)]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    # upper case is Spark's on both sides, as the runtimes' Unicode versions differ
    df = spark.createDataFrame([*((t, plain(t)) for t in texts), (None, None)], "t string, p string")
    assert df.where(~text.fold(F.col("t")).eqNullSafe(F.upper("p"))).collect() == []
    assert [r[0] for r in df.limit(2).select(text.fold(F.col("t"))).collect()] == ["FINCA NO 1⁄2 FULL DŽ صلى الله عليه وسلم".replace("DŽ", "DZ"), "ACAO"]


def test_fuzzy_nearest_looks_at_all_lengths(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    queries = ["", "a", "abcd", "abcdefghij", "zzzz", "kitten", "kitten"]
    words = ["abc", "abce", "xabcd", "sitting", "abcdefghijklmnop", "q"]
    got = {(r["q"], r["nearest"], r["distance"]) for r in link.fuzzy_nearest(spark.createDataFrame([(q,) for q in [*queries, None]], "q string"), spark.createDataFrame([(w,) for w in [*words, None]], "w string"), "q", "w").collect()}
    assert got == {(q, *min((distance(q, w), w) for w in words)[::-1]) for q in queries}
    none = link.fuzzy_nearest(spark.createDataFrame([("a",)], "q string"), spark.createDataFrame([], "w string"), "q", "w").collect()
    assert [tuple(r) for r in none] == [("a", None, None)]


def test_ranks_by_ranges_equal_ranks_by_sorting(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    own = pd.DataFrame({"id": range(500), "a": rng.integers(0, 20, 500).astype(float), "b": rng.normal(size=500)})
    df = spark.createDataFrame(own).selectExpr("id", "CASE WHEN id % 7 > 0 THEN a END AS a", "b").repartition(5)
    got = stats.ranks(df, ["a", "b"], "id").toPandas().sort_values("id").reset_index(drop=True)
    want = own.assign(a=own["a"].where(own["id"] % 7 > 0))
    for c in "ab":
        np.testing.assert_array_equal(got[f"r_{c}"].to_numpy(), want[c].rank().to_numpy())
    top = {r["measure"]: (r["n"], round(r["top"], 9)) for r in stats.top_share(df, ["a", "b"]).collect()}
    for c in "ab":
        v = np.sort(want[c].dropna().to_numpy())[::-1]
        assert top[c] == (len(v), round(v[: int(np.ceil(0.2 * len(v)))].sum(), 9))


def test_quantiles_equal_those_of_sorting(spark):
    rng = np.random.default_rng(5)
    v, w = rng.integers(0, 9, 101).astype(float), rng.normal(size=101)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(v, w)], "v double, w double, none double").repartition(4)
    got = {(r["m"], r["share"]): r["value"] for r in stats.quantiles(df, ["v", "w", "none"], [0.0, 0.1, 0.25, 0.5, 1.0]).collect()}
    assert got.keys() == {(m, s) for m in "vw" for s in (0.0, 0.1, 0.25, 0.5, 1.0)}
    for (m, s), x in got.items():
        assert x == pytest.approx(np.quantile(v if m == "v" else w, s), abs=1e-12)
    assert stats.quantiles(df.where("v < 0"), ["v"], [0.5]).collect() == []
    assert tuple(funnel.fence(df.where("v < 0"), "v").first()) == (None, None)


def test_plugin_columns(spark):
    names = ["TgAcc1", "G800Btw0", "T12345Cnc9", "T123456Cnc9", "XgAcc1", "TgAcc", "TgAbc1", "TgAccx", "T Acc1", "", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("ok", text.plugin_column(F.col("n")))
    assert [r["n"] for r in df.where("ok").collect()] == ["TgAcc1", "G800Btw0", "T12345Cnc9"]


def test_rows_come_back_in_their_places(spark):
    df = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "k int, v string")
    assert [r["v"] for r in link.realigned(df, "k", 3).collect()] == ["a", "b", "c"]
    assert link.realigned(df.where("k < 0"), "k", 0).collect() == []
    for other, n in ((df, 4), (df.where("k > 0"), 2), (df.union(df), 6)):
        with pytest.raises(ValueError):
            link.realigned(other, "k", n)


def test_settings_that_drift_apart():
    from plotweave.operators import variants

    settings, head = {"price": "median", "other": 1}, {"price": "median", "extra": 2}
    assert variants.checked_variants(settings, {"head": head, "b": {}}, "head", ["b"]) == {"head": head, "b": {}}
    with pytest.raises(ValueError, match="price"):
        variants.checked_variants(settings | {"price": "mean"}, {"head": head}, "head", [])
    with pytest.raises(KeyError, match="c"):
        variants.checked_variants(settings, {"head": head}, "head", ["c"])


def test_report(spark):
    df = spark.createDataFrame([("a|b", 2.0)], "k string, v double")
    assert sinks.report("T", [("Text", "words"), ("Table", df)]) == "# T\n\n## Text\n\nwords\n\n## Table\n\n| k | v |\n|---|---|\n| a\\|b | 2 |\n"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 20_000])
def test_quantiles_beside_sorting(spark, n):
    rng = np.random.default_rng(n)
    rows = [(float(rng.choice([rng.normal(), 3.0, rng.integers(0, 5)])), None if rng.random() < 0.3 else float(rng.exponential())) for _ in range(n)]
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.m, r.share): r.value for r in stats.quantiles(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], shares).collect()}
    want = {(c, p): np.quantile(v, p) for i, c in enumerate("ab") if (v := [r[i] for r in rows if r[i] is not None]) for p in shares}
    assert got == pytest.approx(want, abs=1e-12)
