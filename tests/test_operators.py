"""Closed-form facts and edge cases of the operators."""

import math
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork import catalog, queries
from loomwork.operators import cleaning, closure, compare, geo, graph, joins, privacy, quality, reports, resolve, selections, shape, stats, taxonomy, vectors
from loomwork.plans import builder, macros
from loomwork.plans.notebook import Notebook, lineage, read_only_tables
from loomwork.sources import readers, sinks
from loomwork.streaming import events as streams


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_pivot_totals(spark):
    rows = [("Acharya", "paid", "1000"), ("Acharya", "paid", "1000"), ("Acharya", "open", "300"), ("Bharat", "paid", "500"), ("Bharat", "open", "300"), (None, "open", "no number")]
    df = spark.createDataFrame(rows, "vendor string, status string, amount string")
    cells = {(r.row_key, r.col_key): r.cell for r in shape.pivot(df, "vendor", "status", "amount", "sum").collect()}
    assert cells["Acharya", "paid"] == 2000 and cells["Acharya", None] == 2300 and cells[None, "paid"] == 2500 and cells[None, None] == 3100
    assert cells["", "open"] is None  # the cell exists, its value is no number


def test_histogram_edges(spark):
    one = shape.histogram(spark.createDataFrame([(5.0,), (5.0,)], "v double"), F.col("v")).collect()
    assert [(r.bin, r.n) for r in one] == [(0, 2)]
    some = shape.histogram(spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double"), F.col("v"), 10).collect()
    assert sum(r.n for r in some) == 11 and max(some, key=lambda r: r.bin).n == 2
    assert shape.histogram(spark.createDataFrame([], "v double"), F.col("v")).count() == 0


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert as_dict(stats.correlation_matrix(df, ["a", "b"]).filter("a <> b"), "a", "corr") == {"a": None}


def test_compare_null_keys_count_on_both_sides(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "k int, v string")
    r = compare.buckets(a, b, "k").first()
    assert (r.only_a, r.only_b, r.matched, r.differing) == (1, 2, 2, 1)
    assert [tuple(x) for x in compare.differing_rows(a, b, "k").collect()] == [(2, "v", "y", "z")]


def test_graph_facts(spark):
    k4 = edges(spark, [(a, b) for a in "abcd" for b in "abcd" if a < b])
    assert set(as_dict(graph.core_numbers(k4), "node", "core").values()) == {3}
    pendant = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")])
    assert as_dict(graph.core_numbers(pendant), "node", "core") == {"a": 2, "b": 2, "c": 2, "d": 1}
    assert as_dict(graph.clustering(edges(spark, [("a", "b"), ("b", "c"), ("a", "c")])), "node", "coefficient") == {"a": 1.0, "b": 1.0, "c": 1.0}
    path = as_dict(graph.betweenness(edges(spark, [("a", "b"), ("b", "c")])), "node", "betweenness")
    assert path == {"a": 0.0, "b": 1.0, "c": 0.0}
    ring = as_dict(graph.betweenness(edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")])), "node", "betweenness")
    assert all(math.isclose(v, 1 / 6) for v in ring.values())
    ranks = as_dict(graph.pagerank(pendant), "node", "rank")
    assert math.isclose(sum(ranks.values()), 1, abs_tol=1e-9) and max(ranks, key=ranks.get) == "c"
    two = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")])
    assert len(set(as_dict(graph.communities(two), "node", "community").values())) == 2
    assert graph.degree(edges(spark, [("a", "b"), ("a", "b")])).filter("node = 'a'").first().degree == 2


@pytest.mark.parametrize("n", [1, 2, 9, 40])
def test_components_of_a_path(spark, n):
    found = as_dict(graph.connected_components(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100)], "src long, dst long")), "node", "component")
    assert {found[i] for i in range(n + 1)} == {0} and found[100] == 100


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_closure_of_a_circle(spark):
    out = closure.transitive_closure(edges(spark, [("a", "b"), ("b", "c"), ("c", "a")]))
    assert {(r.src, r.dst): r.depth for r in out.collect()}["a", "c"] == 2 and out.count() == 9


def test_reasoning_finds_conflicts(spark):
    facts = spark.createDataFrame([("subClassOf", "cat", "animal"), ("subClassOf", "animal", "thing"), ("equivalentClass", "cat", "felis"), ("disjointWith", "animal", "plant"), ("subClassOf", "cat", "plant")], "relation string, src string, dst string")
    known = closure.reason(facts)
    got = {(r.relation, r.src, r.dst) for r in known.collect()}
    assert ("subClassOf", "felis", "thing") in got and ("disjointWith", "cat", "plant") in got
    assert ("cat", "plant") in {(r.src, r.dst) for r in closure.conflicts(known).collect()}


def test_fingerprint_folds_accents_order_and_case(spark):
    df = spark.createDataFrame([("Café  Noir",), ("noir, cafe!",), ("NOIR cafe cafe",), ("...",), (None,)], "v string")
    got = [r[0] for r in df.select(resolve.fingerprint(F.col("v"))).collect()]
    assert got[:3] == ["cafe noir"] * 3 and got[3] == "" and got[4] is None


def test_near_clusters_are_single_link(spark):
    counts = spark.createDataFrame([("acme corp", 5), ("acme corpp", 1), ("acme corppp", 1), ("zenith", 2)], "value string, n long")
    got = {r.value: r.canonical for r in resolve.near_clusters(counts, 0.88).collect()}
    assert got == {v: "acme corp" for v in ("acme corp", "acme corpp", "acme corppp")}


def test_near_pairs_match_brute_force(spark):
    words = ["aa", "aab", "aabb", "abab", "abba", "aabbc", "abcde", "abcdf", "abcd", "aXcde", "a", "ab"]
    counts = spark.createDataFrame([(w, 1) for w in words], "value string, n long")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {tuple(sorted((a, b))) for a in words for b in words if a < b and 1 - lev(a, b) / max(len(a), len(b)) >= 0.7 - 1e-9}
    assert {tuple(sorted((r.a, r.b))) for r in resolve.near_pairs(counts, 0.7).collect()} == want


def test_golden_skips_nulls_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, "a", 1, 1), (1, None, 3, 2), (1, "b", 2, 3), (1, "c", 2, 4)], "e int, v string, t int, id int")
    assert resolve.golden(df, "e", {"v": "latest"}, "t", "id").first().v == "c"


def test_value_states_without_selection(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "c string, d string")
    assert {r.state for r in selections.value_states(df, ["c", "d"], {}).collect()} == {"neutral"}


def test_selections_travel_along_links():
    got = selections.effective({("a", "id"): [1]}, [(("a", "id"), ("b", "a_id")), (("b", "a_id"), ("c", "ref"))])
    assert got["c", "ref"] == [1]
    assert selections.suggest_links({("a", "id"): None, ("b", "ID"): None, ("b", "x"): "email", ("c", "y"): "email"}) == [(("a", "id"), ("b", "ID")), (("b", "x"), ("c", "y"))]


def test_quality_fused_counts_equal_separate_ones(spark):
    df = spark.createDataFrame([("1", "a@b.co"), ("x", "bad"), (None, None), ("200", "a@b.co\n")], "n string, mail string")
    checks = [quality.Check("c", "completeness", "n"), quality.Check("r", "valid_range", "n", {"min": 0, "max": 100}), quality.Check("f", "format", "mail", {"pattern": "[^@]+@[a-z]+[.][a-z]+"})]
    fused = as_dict(quality.run_checks(df, checks), "check_name", "violations")
    assert fused == {k.name: quality.violations(df, k).count() for k in checks} == {"c": 1, "r": 2, "f": 2}


@pytest.mark.parametrize("pattern,ok", [("[0-9]+", True), ("(a+)+", False), ("(?=a)", False), (r"(a)\1", False), ("(a|b)*", False), ("a" * 300, False), ("(", False), ("(?:ab)+", True)])
def test_pattern_safety(pattern, ok):
    assert quality.safe_pattern(pattern) is ok


def test_cleaning(spark):
    df = spark.createDataFrame([("a-1",), ("b-2",), ("c-3",), (None,)], "v string")
    assert cleaning.choose_delimiter(df, "v").first().delimiter == "-"
    wide = spark.createDataFrame([(1, 5, None)], "id int, sales_2020 int, sales_2021 int")
    assert [tuple(r) for r in cleaning.unpivot_years(wide, "sales", ["id"]).collect()] == [(1, 2020, 5)]


def test_privacy(spark):
    df = spark.createDataFrame([("=1+1", None), ("ok", 150.0)], "t string, n double")
    assert [r[0] for r in privacy.csv_safe(df).collect()] == ["'=1+1", "ok"]
    assert privacy.anonymize(df, {"t": "drop", "n": "drop"}).columns == ["_empty"]
    assert privacy.default_strategy(None) == "redact"
    assert "salt" not in str(privacy.manifest({"t": "hash"}))


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "id int, v array<double>")
    assert [(r.id, r.similarity) for r in vectors.top_k(df, "v", [0.0, 1.0], 2, "id").collect()] == [(2, 1.0), (1, 0.0)]
    text = spark.createDataFrame([("[1, 2]",), ("[1, null]",), ("no",)], "v string")
    assert [r[0] for r in text.select(vectors.as_vector(F.col("v"), is_text=True)).collect()] == [[1.0, 2.0], None, None]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "id int, v array<double>")
    got = as_dict(vectors.pca_2d(line, "v", ["id"]), "id", "x")
    assert math.isclose(got[4] - got[0], math.sqrt(80)) and got[4] > 0


def test_asof_takes_the_last_row_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 7, "c")], "k int, rt int, v string")
    assert {(r.k, r.t): r.v for r in joins.asof(left, right, ["k"], "t", "rt", ["v"]).collect()} == {(1, 5): "b", (1, 1): None, (2, 9): None}


def test_classifier(spark):
    rows = [("a@x.com", "27AAPFU0939F1ZV", "GB82WEST12345698765432", "info", 5), ("b@y.org", "29AAGCB7383J1Z4", "DE89370400440532013000", "WARN", 7)]
    df = spark.createDataFrame(rows, "contact_email string, gstin string, iban string, level string, qty int")
    got = {r["column"]: r["type"] for r in taxonomy.classify(df)}
    assert got == {"contact_email": "email", "gstin": "gstin", "iban": "iban", "level": "log_level", "qty": "quantity"}
    assert {r["column"]: r["status"] for r in taxonomy.classify(df, overrides={"qty": "amount"})}["qty"] == "override"


@pytest.mark.parametrize("name,score", [("email", 1.0), ("e_mail", 0.95), ("work_email", 0.85), ("nothing", 0.0)])
def test_header_scores(name, score):
    assert taxonomy.header_score(name, ("email",)) == score


def test_geo(spark):
    df = spark.createDataFrame([(1, 91.0, 0.0), (2, 45.0, 7.0)], "id int, lat double, lon double")
    assert '"coordinates":[7.0,45.0]' in geo.features(df, "lat", "lon", ["id"]).first().feature
    assert geo.coordinate_columns(["Latitude", "LNG"]) == ("Latitude", "LNG")


def test_reports_bind_one_table():
    types = {"a": {"x": ("amount", 0.9)}, "b": {"price": ("amount", 0.8), "kind": ("category", 0.7)}}
    assert reports.bind(types, ["amount", "category"]) == {"amount": ("b", "price"), "category": ("b", "kind")}
    assert reports.bind(types, ["email"]) is None


# --- macros, builder, notebook ------------------------------------------------------------


def test_macros_leave_quotes_and_comments_alone():
    sql = "select MEASURE(m), 'MEASURE(m)', \"DIM(d)\" -- SEGMENT(s)\n/* DIM(d) */ from t where SEGMENT(s)"
    text, unknown = macros.expand(sql, measures={"m": "sum(x)"}, segments={"s": "a = 1"})
    assert text == "select (sum(x)), 'MEASURE(m)', \"DIM(d)\" -- SEGMENT(s)\n/* DIM(d) */ from t where (a = 1)" and not unknown


def test_unknown_and_circular_macros():
    assert macros.expand("select MEASURE(a), DIM(b) where SEGMENT(c) and CROSSFILTER(d)")[0] == "select NULL, NULL where FALSE and TRUE"
    with pytest.raises(macros.UnknownMacro):
        macros.expanded("select MEASURE(a)")
    loop = {"a": "MEASURE(b) + 1", "b": "MEASURE(a)"}
    assert macros.cycles(loop) == [["a", "b", "a"]]
    with pytest.raises(macros.MacroCycle):
        macros.expand("select MEASURE(a)", measures=loop)
    assert not macros.valid_fragment("1; drop table x") and macros.valid_fragment("sum(x) filter (where note = 'drop; it')")


@given(st.text(alphabet="ab'\"-/*@ \n`()", max_size=40))
def test_text_without_macros_is_unchanged(text):
    assert macros.expand(text)[0] == text


def test_builder_skips_bad_literals_and_validates(spark):
    t = {"t": spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")}
    assert builder.build(builder.Spec("t", columns=["n"], filters=[("n", ">", "many"), ("s", "=", "b")]), t).collect()[0].n == 2
    assert builder.validate(builder.Spec("t", columns=["s"], aggregates=[("SUM", "n", "x")]), t)
    with pytest.raises(ValueError):
        builder.pipeline(builder.Spec("t"), [builder.Step(group_by=["s"])], t)


def test_notebook_order_staleness_and_cycles(spark):
    spark.createDataFrame([(1,), (2,)], "n int").createOrReplaceTempView("nb_t")
    book = Notebook(spark, inputs={"least": 2})
    book.add("base", "select n from nb_t where n >= @least")
    book.add("top", "select count(*) as c from @base")
    assert book.run("top").first().c == 1
    assert book.mark_stale(["base"]) == ["base", "top"]
    book.add("a", "select * from @b")
    book.add("b", "select * from @a")
    with pytest.raises(ValueError):
        book.order(["a"])


def test_only_queries_on_allowed_tables(spark):
    assert read_only_tables(spark, "with c as (select * from x) select * from c join y on c.a = y.a where a in (select b from z)") >= {"x", "y"}
    for bad in ("drop table x", "insert into x select 1", "select * from parquet.`/tmp/x`", "create view v as select 1"):
        with pytest.raises(ValueError):
            read_only_tables(spark, bad)
    with pytest.raises(ValueError):
        read_only_tables(spark, "select * from secret", {"open"})
    spark.range(3).createOrReplaceTempView("lin")
    assert lineage(spark, "select * from lin", spark.table("lin"))["tables"] == ["lin"]


# --- sources and sinks -----------------------------------------------------------------------


def test_names_and_formats():
    assert catalog.table_name("2024 Sales-Q1", {"t_2024_sales_q1"}) == "t_2024_sales_q1_2"
    assert readers.format_of("a/b.NDJSON") == "jsonl"
    assert readers.encoding_of("é".encode("cp1252") + b" abcdef") == "windows-1252" and readers.encoding_of("é".encode()) == "utf-8"


def test_csv_round_trip_with_formulas(spark, tmp_path):
    df = spark.createDataFrame([("=cmd", 1), ("plain, \"quoted\"", 2)], "t string, n int")
    sinks.write_csv(df, str(tmp_path / "x"))
    assert sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path / "x")).collect()) == [("'=cmd", 1), ('plain, "quoted"', 2)]


def test_csv_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    assert readers.read_csv(spark, str(tmp_path / "a.csv")).count() == 3
    assert {r.line for r in readers.csv_rejects(spark, str(tmp_path / "a.csv")).collect()} >= {"4,5,6"}


def test_sqlite(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "r.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table reps(rep text, sales real, photo blob)")
        db.executemany("insert into reps values (?, ?, ?)", [("a", 1.5, b"x"), ("b", 2, None)])
        db.execute("create table empty(x text)")
    tables = readers.read_sqlite(spark, path)
    assert sorted(tuple(r) for r in tables["reps"].collect()) == [("a", 1.5, None), ("b", 2.0, None)] and tables["empty"].count() == 0


def test_arrow_geojson_kml_xlsx(spark, tmp_path):
    import json
    import zipfile

    import pyarrow as pa

    table = pa.table({"a": [1, 2], "b": ["x", None]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    assert sorted(r.a for r in readers.read_arrow(spark, str(tmp_path / "t.arrow")).collect()) == [1, 2]
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"name": "n"}}]}))
    row = readers.read_geojson(spark, str(tmp_path / "p.geojson")).first()
    assert row.name == "n" and json.loads(row.geometry)["type"] == "Point"
    (tmp_path / "p.kml").write_text("<kml xmlns='http://www.opengis.net/kml/2.2'><Document><Placemark><name>k</name><Point><coordinates>1,2,0</coordinates></Point></Placemark></Document></kml>")
    assert json.loads(readers.read_kml(spark, str(tmp_path / "p.kml")).first().geometry) == {"type": "Point", "coordinates": [1.0, 2.0]}
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>id</t></si><si><t>name</t></si><si><t>x</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c></row></sheetData></worksheet>')
    sheet = readers.read_xlsx(spark, str(tmp_path / "b.xlsx"))["S"]
    assert sheet.dtypes == [("id", "bigint"), ("name", "string")] and tuple(sheet.first()) == (7, "x")


def test_mount_folder_isolates_failures_and_refresh_is_atomic(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a\n1\n")
    (tmp_path / "bad.xyz").write_text("?")
    c = catalog.Catalog(spark)
    source = c.mount_folder(str(tmp_path))
    assert list(source.tables) == ["good"] and "bad.xyz" in source.errors
    with pytest.raises(KeyError):
        c.refresh({"good": spark.range(1).toDF("a"), "missing": spark.range(1)})
    assert spark.table("good").first().a == 1


def test_sink_mappings(spark):
    df = spark.createDataFrame([("T", "2024-01-02", "about", "x1")], "title string, due string, note string, amount string")
    assert sinks.cards(df, "title", "due").first().card == '{"title":"T","due_date":"2024-01-02","description":"about"}'
    assert sinks.journal_entries(df, "due", "amount").first().entry == '{"date":"2024-01-02","amount":0.0}'
    assert sinks.snapshot(df, "select 1")["sql_hash"] == sinks.fnv1a("select 1")


def test_dates(spark):
    from loomwork.functions import dates

    df = spark.createDataFrame([("2024-03-04",), ("3/4/2024 5:06",), ("31/12/2024",), ("March 4, 2024",), ("2010",), ("x",), (None,)], "t string")
    got = [str(r[0]) for r in df.select(dates.parse_time(F.col("t"))).collect()]
    assert got == ["2024-03-04 00:00:00", "2024-03-04 05:06:00", "2024-12-31 00:00:00", "2024-03-04 00:00:00", "None", "None", "None"]
    times = spark.createDataFrame([(1700000000,), (1700000000000,), (1700000000000000,)], "v long").select(dates.from_epoch(F.col("v"))).distinct()
    assert times.count() == 1


def test_shape_constraints(spark):
    from loomwork.operators.constraints import Shape, validate, violating_rows

    df = spark.createDataFrame([(["V-1", "V-2"], "status", 150.0), (["V-12"], "open", 50.0), (None, "open", None)], "vendor array<string>, status string, amount double")
    shapes = [Shape("vendor", min_count=1, max_count=1, pattern="^V-"), Shape("status", values=("open", "paid")), Shape("amount", maximum=100)]
    got = {(r.field, r.constraint_name): r.violations for r in validate(df, shapes).collect()}
    assert got == {("vendor", "min_count"): 1, ("vendor", "max_count"): 1, ("vendor", "pattern"): 0, ("status", "enumeration"): 1, ("amount", "max_inclusive"): 1}
    assert violating_rows(df, shapes).count() == 2


def test_cells(spark, tmp_path):
    from loomwork.plans import cells

    df = spark.createDataFrame([(1, "a", 2.0)], "order_id int, region string, amount double")
    assert cells.chart_binding(df) == {"x": "region", "y": "amount", "kind": "bar"}
    assert cells.demo_names(df, {"region"}).columns == ["order_id", "field_1", "amount"]
    (tmp_path / "f.txt").write_text("x")
    one = cells.source_fingerprint(spark, str(tmp_path))
    (tmp_path / "g.txt").write_text("y")
    two = cells.source_fingerprint(spark, str(tmp_path))
    assert cells.changed({"s": one}, {"s": two, "t": one}) == {"stale": ["s"], "new": ["t"], "gone": []}


def test_complete_streams_stay_off_the_driver(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (1, "2024-01-02 00:00:00"), (2, "2024-01-01 00:00:00")], "user_id long, ts string")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    events = streams.read_events(spark, f"{tmp_path}/in", rows.schema)
    got = streams.drain(streams.sessions(events, "ts", "6 hours", "user_id"), "sessions_off_driver")
    assert sorted((r.user_id, r.n) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]
    assert got.inputFiles() and not spark.catalog.tableExists("sessions_off_driver")


def test_betweenness_query_takes_all_nodes(spark):
    sf = "/root/testdata/sf0.01"
    pairs = {(r.src, r.dst) for r in queries._places(spark, sf).collect()}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        depth, paths, order = {s: 0}, defaultdict(int, {s: 1}), [s]
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        gained = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    gained[v] += paths[v] / paths[w] * (1 + gained[w])
            if w != s:
                want[w] += gained[w]
    n = len(near)
    got = as_dict(queries.QUERIES["graph_betweenness"](spark, sf), "node", "betweenness")
    assert n > 16 and got.keys() == want.keys() and all(math.isclose(got[k], want[k] / ((n - 1) * (n - 2)), abs_tol=1e-9) for k in want)
