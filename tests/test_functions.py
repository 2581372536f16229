import pytest
from pyspark.sql import functions as F

from plumbline.functions import audit, naming, types
from plumbline.functions.calendar import month_order, quarter_order

CLEAN = [("simple_name", "simple_name"), ("name-with-hyphens", "name_with_hyphens"), ("name with spaces", "name_with_spaces"), ("a.b", "a_b"), ("123_x", "_123_x"), ("", "unnamed"), ("MixedCase", "MixedCase")]


def test_clean_name(spark):
    for given, wanted in CLEAN:
        assert naming.clean_name(given) == wanted
    rows = spark.createDataFrame([(g,) for g, _ in CLEAN], "x string").select(naming.clean_name_column(F.col("x"))).collect()
    assert [r[0] for r in rows] == [w for _, w in CLEAN]


@pytest.mark.parametrize(
    ("sql", "wanted"),
    [("INTEGER", "integer"), ("SERIAL", "integer"), ("TINYINT", "byte"), ("VARCHAR(255)", "string"), ("BLOB", "string"), ("TIMESTAMP", "dateTime"), ("DATE", "date"), ("TIME", "time"), ("REAL", "float"), ("DOUBLE PRECISION", "double"), ("MONEY", "decimal"), ("BIT", "boolean"), ("BYTEA", "base64Binary"), ("UUID", "string"), ("JSONB", "string"), ("NUMBER", "decimal")],
)
def test_xsd(spark, sql, wanted):
    assert types.xsd(sql) == wanted
    assert spark.createDataFrame([(sql,)], "t string").select(types.xsd_column(F.col("t"))).first()[0] == wanted


def test_profiles_differ():
    assert types.xsd("BLOB", "r2rml") == "base64Binary"
    assert types.xsd("NUMBER", "r2rml") == "string"


@pytest.mark.parametrize(("sql", "column", "wanted", "override"), [("DOUBLE PRECISION", "orderquantity", "integer", True), ("NUMERIC(10,2)", "product_qty", "integer", True), ("FLOAT", "item_count", "integer", True), ("DOUBLE PRECISION", "unit_price", "double", False), ("INTEGER", "quantity", "integer", False)])
def test_quantity_override(sql, column, wanted, override):
    kind, made = types.column_xsd(sql, column)
    assert kind == wanted and bool(made) == override
    assert types.column_xsd("double", "l_discount", by_word=True)[0] == "double"


def test_identifiers():
    assert all(map(naming.is_identifier, ("a", "_a", "A1", "a" * 128)))
    assert not any(map(naming.is_identifier, ("", None, "1a", "a-b", "a b", "a;", "a" * 129)))
    assert naming.is_qualified_identifier("a.b.c") and not naming.is_qualified_identifier("a.b.c.d")
    assert [naming.sanitise_identifier(x) for x in ("table with spaces", "123table", "table@#$%", "")] == ["table_with_spaces", "_123table", "table____", ""]
    assert naming.quote("a.b`c") == "`a`.`b``c`" and naming.quote_literal("it's") == "'it''s'"


def test_plurals():
    names = ["countries", "user", "products"]
    assert [naming.find_table(x, names) for x in ("country", "users", "products", "customers")] == ["countries", "user", "products", None]


def test_name_quality(spark):
    assert naming.name_quality("cust_dt").is_cryptic and naming.name_quality("ABC").confidence == "high"
    assert not naming.name_quality("customer_name").is_cryptic
    assert not naming.name_quality("address2").is_cryptic and naming.name_quality("address2").reasons
    names = ["cust_dt", "ABC", "customer_name", "address2", "pk_thing", "order_id", "x"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(naming.reason_count_column(F.col("n"))).collect()
    assert [r[0] for r in rows] == [len(naming.name_quality(n).reasons) for n in names]


def test_calendar(spark):
    df = spark.createDataFrame([("Q1 2024",), ("2024-Q2",), ("2023/Q4",), ("Q3-2024",), ("2024 q4",), ("May",), ("september",), ("x",)], "v string")
    rows = df.select(quarter_order(F.col("v")), month_order(F.col("v"))).collect()
    assert [r[0] for r in rows] == [8097, 8098, 8096, 8099, 8100, None, None, None]
    assert [r[1] for r in rows][5:] == [5, 9, None]


def test_text_helpers():
    assert naming.redact_log("SELECT 'secret''s' FROM t") == "SELECT '***' FROM t"
    assert naming.redact_secrets({"password": "x", "a": [{"token": 1}]}) == {"password": "***", "a": [{"token": "***"}]}
    assert naming.strip_leading_comments("-- a\n/* b */ SELECT 1; SELECT 1") == "SELECT 1; SELECT 1"
    assert naming.measure_label("total_amount") == "Total Amount" and naming.is_percentage("growth_pct") and naming.format_bytes(2048) == "2.0 KB"


def test_addresses_identifiers_and_bytes():
    assert [naming.is_uri(x) for x in ("http://a.org", "https://a/b", "ftp://a", "http://", "", None, "http://[")] == [True, True, False, False, False, False, False]
    assert naming.is_lax_identifier("my-table") and not naming.is_lax_identifier("a" * 64) and not naming.is_lax_identifier("1a") and not naming.is_identifier("my-table")
    assert [naming.format_bytes(n) for n in (0, 1023, 1536, 1 << 20, 5 << 50)] == ["0 B", "1023 B", "1.5 KB", "1.0 MB", "5.0 PB"]


def test_audit_hides_secrets(caplog):
    with caplog.at_level("WARNING", "plumbline.audit"):
        shown = audit.event("login", "critical", user="ann", api_key="x", Password="y")
    assert shown == {"user": "ann", "api_key": audit.SHOWN_AS, "Password": audit.SHOWN_AS}
    assert "login" in caplog.text and "critical" in caplog.text and "'x'" not in caplog.text
