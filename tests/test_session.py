import json

import pytest

from plumbline.operators import charts, rdf, triples
from plumbline.session import Session, clamp_limit, clamp_sample
from plumbline.sources import connections
from plumbline.sources.catalog import Catalog


@pytest.fixture
def session(spark, sf_dir, tmp_path):
    made = Session(spark, output_dir=str(tmp_path)).connect_parquet(sf_dir)
    yield made
    made.close()


def test_limits():
    assert [clamp_limit(x) for x in (1000, 0, -5, 9000, 5000)] == [1000, 100, 100, 5000, 5000]
    assert [clamp_sample(x) for x in (-1, 5, 2000)] == [10, 5, 1000] and [clamp_sample(x, True) for x in (0, 101, 7)] == [10, 10, 7]


def test_schema_and_ontology(session, tmp_path):
    made = session.analyze_schema(save=True)
    assert made["table_count"] == 14 and "rr:TriplesMap" in made["r2rml"]
    assert session.suggest_semantic_names()["error_type"] == "session_error"
    made = session.generate_ontology(save=True)
    assert made["success"] and made["quality_report"]["summary"]["inferred_relationships"] == 1
    assert session.suggest_semantic_names()["summary"]["cryptic"] >= 11
    made = session.apply_semantic_names(json.dumps({"columns": [{"table_name": "lineitem", "original_name": "l_tax", "suggested_name": "Line tax"}]}))
    assert made["applied"] == 2 and "Line tax" in made["ontology"]
    loaded = session.load_my_ontology(str(tmp_path))
    assert loaded["counts"]["classes"] == 14
    assert session.load_ontology_from_file(made["ontology_file"])["counts"]["classes"] == 14
    assert session.load_my_ontology("/nowhere")["error_type"] == "folder_not_found"


def test_execute(session):
    sql = "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment"
    assert session.execute_sql_query(sql)["error_type"] == "validation_error"
    assert session.execute_sql_query(sql, limit=0, checklist_completed=True)["error_type"] == "parameter_error"
    made = session.execute_sql_query(sql, checklist_completed="true")
    assert made["success"] and made["row_count"] == 5 and made["limit_applied"] and sum(r["n"] for r in made["data"]) == 150
    made = session.execute_sql_query("SELECT c_custkey FROM customer", limit=7, checklist_completed=True)
    assert made["row_count"] == 7 and made["warnings"]
    assert not session.execute_sql_query("SELECT c_custkey FROM customer LIMIT 3", checklist_completed=True)["limit_applied"]
    assert session.execute_sql_query("DROP TABLE customer", checklist_completed=True)["error_type"] == "forbidden_operation"
    assert session.execute_sql_query("SELECT nope FROM customer", checklist_completed=True)["error_type"] == "obqc_error"
    assert session.execute_sql_query("SELECT CAST(c_name AS INT) AS x FROM customer", checklist_completed=True)["error_type"] == "execution_error"


def test_validate(session):
    made = session.validate_sql_syntax("SELECT n_name, SUM(c_acctbal) a, SUM(s_acctbal) b FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
    assert made["is_valid"] and made["fan_trap_risk"] and any(w.startswith("[OBQC]") for w in made["warnings"])
    made = session.validate_sql_syntax("SELECT o_custkey, SUM(o_totalprice) FROM orders")
    assert not made["is_valid"] and made["error_type"] == "obqc_error" and made["database_error"]
    assert session.validate_sql_syntax("SHOW TABLES")["query_type"] == "METADATA"


def test_sample_and_info(session):
    made = session.sample_table_data("nation", limit=3)
    assert len(made["data"]) == 3 and made["columns"] == ["n_nationkey", "n_name", "n_regionkey"]
    assert session.sample_table_data("nation; DROP")["error_type"] == "validation_error"
    assert session.sample_table_data("missing")["error_type"] == "database_error"
    assert len(session.get_server_info()["tools"]) == 13 and session.status()["connected"]
    assert session.reset_cache("x")["error_type"] == "parameter_error" and session.reset_cache()["success"]
    session.catalog.register_information_schema()
    assert session.spark.sql("SELECT COUNT(*) FROM information_schema_tables").first()[0] >= 14


def test_sources():
    assert connections.missing_parameters("postgresql", {"host": "h"}) == ["port", "database", "username", "password"]
    assert connections.jdbc_options("clickhouse", host="h", username="u", secure=True)["url"] == "jdbc:clickhouse:https://h:8123/default"
    with pytest.raises(ValueError):
        connections.missing_parameters("oracle", {})


ROWS = [{"month": m, "kind": k, "v": v} for n, m in enumerate(("Mar", "Jan", "Feb")) for k, v in (("a", 10 - n), ("b", 2.5))]


def test_charts(session):
    made = session.generate_chart([r | {"month": r["month"] + "x"} for r in ROWS], "bar", "month", "v", color_column="kind", chart_style="stacked")
    assert made["traces"][0]["x"] == ["Marx", "Janx", "Febx"] and made["layout"]["barmode"] == "stack" and made["layout"]["title"]["text"] == "v by month (stacked by kind)"
    made = session.generate_chart(json.dumps(ROWS), "line", "month", "v", color_column="kind")
    assert made["traces"][0]["x"] == ["Jan", "Feb", "Mar"]
    assert session.generate_chart(ROWS, "bar", "month", "v")["metadata"]["chart_type"] == "line"
    made = session.generate_chart(ROWS, "heatmap", "month", "kind")
    assert made["traces"][0]["z"] == [[1, 1], [1, 1], [1, 1]]  # x_column downwards
    assert session.generate_chart([{"a": 1, "b": 2}, {"a": 2, "b": 4}], "heatmap", "a")["traces"][0]["z"] == [[1.0, 1.0], [1.0, 1.0]]
    made = session.generate_chart([{"t": "2024-02-01", "x": 1, "x_pct": 5}, {"t": "2024-01-01", "x": 2, "x_pct": 6}], "line", "t", ["x", "x_pct"])
    assert made["traces"][0]["x"] == ["2024-01-01", "2024-02-01"] and made["traces"][1]["yaxis"] == "y2"
    for wrong in ({"chart_type": "pie"}, {"x_column": "q"}, {"y_column": ["v"], "chart_type": "bar"}, {"chart_type": "bar", "x_column": "kind", "sort_by": "month"}):
        assert "error" in session.generate_chart(**({"data_source": ROWS, "chart_type": "scatter", "x_column": "month", "y_column": "v"} | wrong))
    assert "error" in session.generate_chart([], "bar", "a", "b") and "error" in session.generate_chart("{bad", "bar", "a", "b")


def test_reconnects(session):
    assert session.ensure_connected()
    session.spark.catalog.dropTempView("nation")
    assert session.ensure_connected() and session.spark.table("nation").count() == 25
    session._connect = None
    session.spark.catalog.dropTempView("nation")
    assert not session.ensure_connected()


def test_refusals_are_audited(session, caplog):
    with caplog.at_level("WARNING", "plumbline.audit"):
        session.validate_sql_syntax("SELECT n_name FROM nation WHERE n_name = 'hush' OR 1=1")
        session.sample_table_data("a;b")
    assert "refused_statement" in caplog.text and "invalid_identifier" in caplog.text and "hush" not in caplog.text


def test_enrichment(session):
    session.generate_ontology()
    made = session.apply_enrichment({"classes": [{"original_name": "nation", "suggested_name": "Country", "description": "A state"}, {"suggested_name": "lost"}], "properties": [{"table_name": "nation", "original_name": "n_name", "suggested_name": "Country name"}], "relationships": [{"from_table": "nation", "to_table": "region", "description": "lies in"}]})
    assert made["success"] and made["applied"] == 4
    said = {(s, p): o for s, p, o, *_ in session.triples}
    n, rdfs = rdf.Namer(session.base_uri), rdf.RDFS
    assert said[n.table("nation"), f"{rdfs}label"] == "Country" and said[n.table("nation"), f"{rdfs}comment"] == "A state"
    assert said[n.column("nation", "n_name"), f"{rdfs}label"] == "Country name" and said[n.link("nation", "region"), f"{rdfs}comment"] == "lies in"
    assert sum(s == n.table("nation") and p == f"{rdfs}label" for s, p, *_ in session.triples) == 1
    lines = [r.value for r in triples.ntriples(session.triples_df()).collect()]
    assert len(lines) == len(session.triples) and f'<{n.table("nation")}> <{rdfs}label> "Country" .' in {x.split("^^")[0].removesuffix(" .") + " ." for x in lines}
    assert session.enrich_ontology()["success"]


def test_heatmap_axes(session):
    rows = [{"a": n, "b": k} for n in (10, 9, 2) for k in ("p", "q", "r")[: n % 4 + 1]]
    made = session.generate_chart(rows, "heatmap", "a", "b")["traces"][0]
    assert made["y"] == [2, 9, 10] and made["x"] == ["r", "q", "p"] and made["z"] == [[1, 1, 1], [0, 1, 1], [1, 1, 1]]
    made = session.generate_chart(rows, "heatmap", "a", "b", sort_order="descending")["traces"][0]
    assert made["y"] == [10, 9, 2] and made["x"] == ["r", "q", "p"]
    numbers = [{"z": 1, "a": 2.0, "m": 3}, {"z": 2, "a": 1.0, "m": 5}]
    assert session.generate_chart(numbers, "heatmap", "z")["traces"][0]["x"] == ["z", "a", "m"]
    assert session.generate_chart(numbers, "heatmap", "z", sort_order="descending")["traces"][0]["y"] == ["z", "m", "a"]


def test_layout(session):
    made = session.generate_chart(ROWS, "line", "month", ["v"])
    assert made["layout"]["showlegend"] and made["layout"]["legend"]["orientation"] == "h" and made["layout"]["margin"]["t"] == 120
    made = session.generate_chart([{"k": f"label number {n}", "v": n} for n in range(3)], "bar", "k", "v")
    assert not made["layout"]["showlegend"] and made["layout"]["legend"]["x"] == 1.02 and made["layout"]["xaxis"]["tickangle"] == 45
    assert made["config"]["toImageButtonOptions"]["filename"] == made["metadata"]["chart_id"] and made["metadata"]["library"] == "plotly"


def test_schemas_do_not_share_metadata(spark):
    for schema, column in (("one_shop", "a"), ("two_shop", "b")):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
        spark.sql(f"DROP TABLE IF EXISTS {schema}.things")
        spark.sql(f"CREATE TABLE {schema}.things ({column} INT) USING parquet")
    held = Catalog(spark).declare_pk("one_shop.things", "a")
    assert [c.name for c in held.table("things", "one_shop").columns] == ["a"] and [c.name for c in held.table("things", "two_shop").columns] == ["b"]
    assert held.table("things", "one_shop").primary_keys == ["a"] and held.table("things", "two_shop").primary_keys == []
    for schema in ("one_shop", "two_shop"):
        spark.sql(f"DROP DATABASE {schema} CASCADE")


def test_heatmap_counts_every_value(spark):
    df = spark.range(charts.CAP + 1).selectExpr("id AS a", "'one' AS b")
    made = charts.cross_tab(df, "a", "b")
    assert made.columns == ["a", "b", "n"] and made.count() == charts.CAP + 1
    assert "error" in charts.figure(df, "heatmap", "a", "b")
    few = spark.createDataFrame([("p", 1), ("p", 1), ("q", 2), (None, 3), ("r", None)], "a string, b int")
    assert sorted(map(tuple, charts.cross_tab(few, "a", "b").collect())) == [("p", 1, 2), ("p", 2, 0), ("q", 1, 0), ("q", 2, 1)]
    assert charts.cross_tab(few.limit(0), "a", "b").collect() == []
    with pytest.raises(ValueError, match="more than 1 values"):
        charts.cross_tab(few, "a", "b", most=1)


def test_a_long_query_is_ended(session, spark):
    session.spark.range(0, 10**13, 1, 8).createOrReplaceTempView("endless")
    made = session.execute_sql_query("SELECT SUM(id * 3 % 7) AS s FROM endless", checklist_completed=True, strict=False, timeout=1.5)
    assert made["error_type"] == "execution_error" and "more than 1.5 s" in made["error"] and 1_000 < made["execution_time_ms"] < 30_000
    tracker = spark.sparkContext.statusTracker()
    assert not tracker.getActiveJobsIds()
    again = session.execute_sql_query("SELECT COUNT(*) AS n FROM customer", checklist_completed=True, timeout=60)
    assert again["data"] == [{"n": 150}] and spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    session.spark.catalog.dropTempView("endless")


def test_nested_containers(spark, monkeypatch):
    catalog = Catalog(spark)
    tree = {(): ["lake"], ("lake",): ["eu", "us"], ("lake", "eu"): ["north"], ("lake", "eu", "north"): ["oslo"], ("lake", "us"): RuntimeError("no right")}

    def below(path):
        found = tree.get(path, [])
        if isinstance(found, Exception):
            raise found
        return found

    monkeypatch.setattr(catalog, "_below", below)
    assert catalog.containers() == ["lake", "lake.eu", "lake.eu.north", "lake.us"]
    assert catalog.containers(1) == ["lake"] and catalog.containers(9)[-2:] == ["lake.eu.north.oslo", "lake.us"]
    assert {"spark_catalog", "spark_catalog.default"} <= set(Catalog(spark).containers())


def test_rows_of_all_tables_by_their_footers(session):
    made = session.analyze_schema(count=True)
    counts = {t["name"]: t["row_count"] for t in made["tables"]}
    assert counts["lineitem"] == session.spark.table("lineitem").count() and counts["region"] == 5 and None not in counts.values()
