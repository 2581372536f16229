from hypothesis import given
from hypothesis import strategies as st
from shop import shop

from plumbline.operators import facts, infer, r2rml, rdf
from plumbline.sources.catalog import Catalog, ForeignKey, TableMeta, load_parquet
from plumbline.sources.catalog import ColumnMeta as C


def test_implicit_links():
    tables = [
        TableMeta("countries", columns=[C("countryid", "INTEGER", is_primary_key=True), C("countryname", "VARCHAR(100)")], primary_keys=["countryid"]),
        TableMeta("suppliers", columns=[C("supplierid", "INTEGER", is_primary_key=True), C("suppliercountryid", "INTEGER")], primary_keys=["supplierid"]),
        TableMeta("orders", columns=[C("orderid", "INTEGER", is_primary_key=True), C("supplierid", "INTEGER", is_foreign_key=True)], primary_keys=["orderid"], foreign_keys=[ForeignKey("supplierid", "suppliers", "supplierid")]),
    ]
    (link,) = infer.implicit_links(tables)
    assert (link.table, link.column, link.target, link.target_column) == ("suppliers", "suppliercountryid", "countries", "countryid")
    assert link.confidence == "medium"  # the types agree and the column ends in id; the table is called otherwise


def test_confidence_of_links():
    """The word found in the column counts against the table's name, not the column against the key."""
    key = lambda name, kind="INTEGER": TableMeta(name, columns=[C("id", kind, is_primary_key=True)], primary_keys=["id"])
    level = lambda column, kind, target: infer.implicit_links([key("orders"), target, TableMeta("facts", columns=[C(column, kind)])])[0].confidence
    assert level("user_id", "INTEGER", key("user")) == "high"  # 2 + 2 + 1
    assert level("user_id", "BIGINT", key("users")) == "high"  # 2 + 1 + 1
    assert level("fk_user", "INTEGER", key("users")) == "medium"  # 2 + 1
    assert level("user_id", "VARCHAR(9)", key("user", "UUID")) == "medium"  # 2 + 1
    assert level("user_id", "VARCHAR(9)", TableMeta("users", columns=[C("a", "INTEGER")])) == "medium"  # 1 + 1
    assert level("user_sk", "VARCHAR(9)", TableMeta("users", columns=[C("a", "INTEGER")])) == "low"  # 1


def test_surrogate_keys():
    tables = [
        TableMeta("CUSTOMER", columns=[C("c_customer_sk", "INTEGER", is_primary_key=True)], primary_keys=["c_customer_sk"]),
        TableMeta("ITEM", columns=[C("i_item_sk", "INTEGER", is_primary_key=True)], primary_keys=["i_item_sk"]),
        TableMeta("STORE_SALES", columns=[C("ss_sold_date_sk", "INTEGER"), C("ss_customer_sk", "INTEGER"), C("ss_item_sk", "INTEGER")]),
    ]
    assert {(x.column, x.target) for x in infer.implicit_links(tables)} == {("ss_customer_sk", "CUSTOMER"), ("ss_item_sk", "ITEM")}


def test_copied_columns():
    tables = [
        TableMeta("clients", columns=[C("clientid", "INTEGER", is_primary_key=True), C("clientname", "VARCHAR(100)")], primary_keys=["clientid"]),
        TableMeta("shipments", columns=[C("shipmentid", "INTEGER"), C("shipmentclient", "VARCHAR(100)"), C("clientcount", "INTEGER")]),
    ]
    assert infer.copied_columns(tables) == [{"table": "shipments", "column": "shipmentclient", "likely_source": "clients"}]


def test_inference_on_the_star_schema(spark, sf_dir):
    catalog = load_parquet(spark, sf_dir)
    tables = catalog.analyse()
    (link,) = infer.implicit_links(tables)
    assert (link.table, link.column, link.target) == ("embeddings", "label", "labels")
    assert [tuple(r) for r in infer.embedded_links_df(catalog.columns_df()).collect()] == [("embeddings", "label", "labels")]
    assert infer.verify_link(spark, link)["orphan_rate"] > 0
    assert {x["column"] for x in infer.type_overrides(tables)} == {"l_quantity", "l_discount"}
    assert {x["name"] for x in infer.cryptic_names(tables)["columns"]} == {"l_tax", "event_id", "ts", "user_id", "doc_id", "vec_id", "page_id", "url", "item_id", "conv_id"}
    assert infer.copied_columns(tables) == []
    assert catalog.context()["fan_trap_hints"] == ["lineitem"]


def test_turtle_round_trip(spark):
    made = rdf.schema_triples(shop())
    text = rdf.to_turtle(made)
    assert set(rdf.from_turtle(text)) == set(made)
    assert rdf.to_turtle(rdf.from_turtle(text)) == text
    assert "Restriction" not in text and "subClassOf" not in text
    back = {t.name: t for t in rdf.tables_of(made)}
    assert back["orders"].foreign_keys[0].referenced_table == "users" and back["users"].row_count == 1000
    assert rdf.element_counts(rdf.triples_df(spark, made))["classes"] == 4


@given(st.text(max_size=40))
def test_turtle_literals(text):
    made = [("http://e/x", f"{rdf.RDFS}comment", text.encode("utf-8", "ignore").decode(), "literal", None)]
    assert rdf.from_turtle(rdf.to_turtle(made)) == made


def test_two_links_between_two_tables():
    t = TableMeta("trips", columns=[C("start_id", "INT"), C("end_id", "INT")], foreign_keys=[ForeignKey("start_id", "places", "id"), ForeignKey("end_id", "places", "id")])
    p = TableMeta("places", columns=[C("id", "INT", is_primary_key=True)], primary_keys=["id"])
    back = {x.name: x for x in rdf.tables_of(rdf.schema_triples([t, p]))}
    assert {k.column for k in back["trips"].foreign_keys} == {"start_id", "end_id"}


def test_names_and_descriptions(spark):
    base = rdf.schema_triples(shop())
    df = rdf.triples_df(spark, base)
    changes = rdf.name_changes({"columns": [{"table_name": "orders", "original_name": "total", "suggested_name": "Order total", "description": "Sum of items"}]})
    made = rdf.upsert(df, rdf.triples_df(spark, changes))
    iri = rdf.Namer().column("orders", "total")
    assert [r.object for r in rdf.match(made, iri, f"{rdf.RDFS}label").collect()] == ["Order total"]
    assert rdf.completeness(made)["datatype_property_coverage"] == 1 / 11
    assert rdf.names_for_review(df)["summary"]["total"] == 15


def test_r2rml(spark):
    users = shop()[0]
    text = r2rml.document(shop(), "http://e/")
    assert 'rr:template "http://e/users/{id}"' in text and 'rr:template "http://e/users/{user_id}" ; rr:termType rr:IRI' in text
    rows = spark.createDataFrame([(1, "Ann", None), (2, None, "b@x.org")], "id int, name string, email string")
    made = {tuple(r)[:3] for r in r2rml.apply(users, rows, "http://e/").collect()}
    assert made == {("http://e/users/1", f"{rdf.RDF}type", "http://e/Users"), ("http://e/users/1", "http://e/id", "1"), ("http://e/users/1", "http://e/name", "Ann"), ("http://e/users/2", f"{rdf.RDF}type", "http://e/Users"), ("http://e/users/2", "http://e/id", "2"), ("http://e/users/2", "http://e/email", "b@x.org")}
    assert r2rml.subject_key(TableMeta("t", columns=[C("x", "INT"), C("rowid", "INT")])) == ["rowid"]


def test_catalog_json(spark, sf_dir):
    catalog = load_parquet(spark, sf_dir, ["orders", "customer"])
    back = Catalog.from_json(spark, catalog.to_json())
    assert back.table("orders") == catalog.table("orders") and catalog.table("missing") is None
    assert catalog.table("orders", count=True).row_count == 1500


def test_safe_totals_equal_base_totals(spark, sf_dir):
    load_parquet(spark, sf_dir, ["nation", "customer", "supplier"])
    given_facts = {"C": (spark.table("customer"), "c_nationkey", {"c": "c_acctbal"}), "S": (spark.table("supplier"), "s_nationkey", {"s": "s_acctbal"})}
    made = facts.total_by_key("k", given_facts)
    checked = facts.verify_total(made, "c", spark.table("customer"), "c_acctbal").first()
    assert abs(checked.difference) < 1e-6
    naive = spark.sql("SELECT c_acctbal FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey")
    assert abs(facts.verify_total(naive, "c_acctbal", spark.table("customer"), "c_acctbal").first().difference) > 1
