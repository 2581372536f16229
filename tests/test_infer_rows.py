"""Rules of inference as joins, against the rules of the driver on generated catalogs."""

import random

import pytest

from plumbline.operators import infer
from plumbline.sources.catalog import Catalog, ColumnMeta, ForeignKey, TableMeta

TAILS = ["id", "_id", "sk", "_sk", "", "key", "name", "title", "_x", "count"]
TYPES = ["int", "bigint", "varchar(20)", "string", "double", "TEXT"]


def catalog(spark, tables, seed, per=(1, 20)):
    rng = random.Random(seed)
    roots = ["customer", "country", "countries", "box", "boxes", "user", "users", "address", "dim_item", "dim_items", "dim_store", "city", "cities", "status", "glass", "us", "ab", "order", "orders", "orderline"]
    names = roots + [f"{rng.choice(['dim_', 'fact_', '', 'x'])}{''.join(rng.choice('abcdeiosy') for _ in range(rng.randrange(3, 7)))}{rng.choice(['', 's', 'es', 'ies', 'y'])}" for _ in range(tables)]
    names = list({n.lower(): n.upper() if rng.random() < 0.1 else n for n in names}.values())
    out = Catalog(spark)
    for n in names:
        columns = [ColumnMeta(f"{n}_pk", rng.choice(TYPES), is_primary_key=rng.random() < 0.8)]
        while len(columns) < rng.randrange(*per) + 1:
            other = rng.choice(names)
            other = rng.choice([other, other.lower(), other.rstrip("s"), other[:-1]])
            made = rng.choice([f"{other}{rng.choice(TAILS)}", f"{rng.choice(['fk_', 'id_', 'ss_', 'fk', 'my'])}{other}{rng.choice(TAILS)}", f"{other}{other}id", rng.choice("abc") * 3])
            if all(c.name.lower() != made.lower() for c in columns):
                columns.append(ColumnMeta(made, rng.choice(TYPES)))
        keys = [ForeignKey(columns[-1].name, names[0], "id")] if rng.random() < 0.1 and len(columns) > 1 else []
        out.add(TableMeta(n, columns=columns, primary_keys=[c.name for c in columns if c.is_primary_key], foreign_keys=keys))
    return out


@pytest.mark.parametrize(("tables", "seed", "suffix"), [(0, 1, False), (40, 2, True), (900, 3, False)])
def test_links_and_copies(spark, tables, seed, suffix):
    held = catalog(spark, tables, seed, (8, 20) if tables == 900 else (1, 20))
    there, columns = held.analyse(), held.columns_df()
    assert tables < 900 or sum(len(t.columns) for t in there) >= 10_000
    made = {(r.table_name, r.column_name): tuple(r)[2:] for r in infer.links_df(columns, suffix).collect()}
    wanted = {(x.table, x.column): (x.target, x.target_column, x.pattern, x.confidence) for x in infer.implicit_links(there, suffix)}
    assert made == wanted and len({x[2] for x in wanted.values()}) >= 2
    copies = {(r.table_name, r.column_name): r.likely_source for r in infer.copies_df(columns).collect()}
    assert copies == {(x["table"], x["column"]): x["likely_source"] for x in infer.copied_columns(there)} and copies


def test_a_shared_beginning_brings_nothing_together(spark):
    """Words are filed under their rarest gram, so tables that all begin alike do not meet all columns."""
    names = [f"dim_{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrtuv"]
    columns = spark.createDataFrame([(n, f"dim_{n[4:]}_x", 1, "string", False, False) for n in names], "table_name string, column_name string, position int, data_type string, is_primary_key boolean, is_foreign_key boolean")
    free = columns.select("table_name", "column_name", columns.column_name.alias("c"))
    index = infer.found_words(free, columns)
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Cartesian" not in index._jdf.queryExecution().executedPlan().toString()
    assert index.count() == 0  # each holds its own table's name alone


def test_a_name_is_looked_up_once(spark):
    """Grams are made of the different names, not of each table's column of that name; a table's own word gives way to the next."""
    names = [f"table{n:02}" for n in range(40)]
    rows = [(t, c, 1, "string", False, False) for t in names for c in ("table07_id", "table07table08", "table09name")]
    columns = spark.createDataFrame(rows, "table_name string, column_name string, position int, data_type string, is_primary_key boolean, is_foreign_key boolean")
    plan = infer.links_df(columns)._jdf.queryExecution().optimizedPlan().toString()
    before = [x for x in plan.split("Generate explode(transform(sequence")[1:] if "gram" in x]
    assert before and all(x.split("+- ")[1].startswith(("Filter", "Aggregate", "Project [c#", "Project [word#")) and "column_name" not in x.split("\n")[0] for x in before)
    links = {(r.table_name, r.column_name): r.target for r in infer.links_df(columns).collect()}
    assert links == {**{(t, "table07_id"): "table07" for t in names if t != "table07"}, **{(t, "table07table08"): "table08" for t in names if t != "table08"}}
    copies = {(r.table_name, r.column_name): r.likely_source for r in infer.copies_df(columns).collect()}
    assert copies == {**{(t, "table07table08"): "table08" if t != "table08" else None for t in names if t != "table08"}, **{(t, "table09name"): "table09" for t in names if t != "table09"}}


def test_empty_catalog(spark):
    columns = Catalog.from_json(spark, {"tables": []}).columns_df().where("false")
    assert infer.links_df(columns).count() == 0 and infer.copies_df(columns).count() == 0


def test_texts_are_read_once(spark):
    """The catalog of words is kept, so that what reads it several times does not cut the texts again."""
    from plumbline.registry import word_catalog

    docs = spark.createDataFrame([("order orderid order customer orderid customername",)], "text string")
    columns = word_catalog(docs)
    plan = infer.copies_df(columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and columns.where("is_primary_key").count() == 4


def test_few_words_go_to_the_names(spark, monkeypatch):
    """Neither grams nor forms of names are dealt for their join with few words; pairs of words are dealt once and unsorted."""
    from plumbline import registry

    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, kept = {}, registry._kept
    monkeypatch.setattr(registry, "_kept", lambda spark, made, tag: (plans.update({tag: plan_of(made)}), kept(spark, made, tag))[1])
    docs = spark.createDataFrame([("order orderid order customer orderid customername customer order",), (None,)], "text string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        columns = registry.word_catalog(docs)
        links, copies = infer.links_df(columns), infer.copies_df(columns)
        for plan in (plan_of(links), plan_of(copies)):
            assert "hashpartitioning(gram" not in plan and "hashpartitioning(name" not in plan and "hashpartitioning(of" not in plan
        assert not any("SortAggregate" in x for x in plans.values()) and plans["catalog"].count("hashpartitioning") == 1
        assert links.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
