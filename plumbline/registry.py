"""Queries of the engine's own operators and the SQL they must agree with.

``SQL`` holds statements that Spark and DuckDB both run as they are: the
delegated surface is SQL text.  ``BUILT`` pairs DataFrame operators with SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.calendar import month_order, quarter_order
from .functions.naming import BEGINNINGS, ENDINGS, clean_name_column, measure_label_column, reason_count_column
from .functions.types import QUANTITY, xsd_column
from .operators import charts, facts, fanout, infer, r2rml, ranks, rdf, triples
from .plans import guard
from .sources import footers, scratch
from .sources.catalog import STAR_KEYS, STAR_LINKS, STAR_TABLES, Catalog, load_parquet, read_parquet

Query = Callable[[SparkSession, str], DataFrame]

MULTI_FACT = """
SELECT n_name AS nation, ROUND(SUM(customer_balance), 2) AS customer_balance, ROUND(SUM(supplier_balance), 2) AS supplier_balance
FROM (
  SELECT c_nationkey AS nationkey, c_acctbal AS customer_balance, 0 AS supplier_balance FROM customer
  UNION ALL
  SELECT s_nationkey AS nationkey, 0 AS customer_balance, s_acctbal AS supplier_balance FROM supplier
) f JOIN nation ON nation.n_nationkey = f.nationkey
GROUP BY n_name
"""

SQL: dict[str, str] = {
    # scans, projections, filters
    "scan_projection": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net_price FROM lineitem",
    "literal_projection": "SELECT s_suppkey, 'SUPPLIER' AS fact_type, 0 AS returned FROM supplier",
    "filter_compare": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 300000 AND o_orderstatus <> 'P'",
    "filter_boolean": "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE (c_acctbal < 0 AND c_mktsegment = 'BUILDING') OR c_acctbal > 9000",
    "filter_in_like": "SELECT p_partkey, p_brand, p_type FROM part WHERE p_size NOT IN (1, 2, 3) AND p_brand NOT LIKE '%1'",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "case_bucket": "SELECT CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS bucket, COUNT(*) AS n, ROUND(SUM(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS finished FROM orders GROUP BY CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END",
    "cte_pipeline": "WITH per AS (SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey) SELECT c_mktsegment, COUNT(*) AS customers, ROUND(SUM(spent), 2) AS spent FROM per JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "having_filter": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15",
    "date_range": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00'",
    "scalar_subquery": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) * 1.8 FROM customer)",
    # joins
    "join_inner": "SELECT c_mktsegment, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "join_left_coalesce": "SELECT o.o_orderkey, COALESCE(l.lines, 0) AS lines FROM orders o LEFT JOIN (SELECT l_orderkey, COUNT(*) AS lines FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey",
    "join_right": "SELECT n_name, c_custkey FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9900",
    "join_full": "SELECT COALESCE(c.k, s.k) AS nationkey, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) c FULL OUTER JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON c.k = s.k",
    "join_star": "SELECT r_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "join_anti": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "join_self": "SELECT a.n_name AS nation, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_theta_range": "SELECT r.r_name, n.n_name FROM region r JOIN nation n ON n.n_nationkey >= r.r_regionkey * 5 AND n.n_nationkey < r.r_regionkey * 5 + 5",
    # aggregates
    "agg_basic": "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_price, ROUND(AVG(l_discount), 6) AS avg_disc, MIN(l_tax) AS min_tax, MAX(l_tax) AS max_tax, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_sum_distinct": "SELECT l_suppkey, ROUND(SUM(DISTINCT l_quantity), 2) AS qty, COUNT(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey",
    "agg_window_distinct": "SELECT DISTINCT c_nationkey, ROUND(SUM(c_acctbal) OVER (PARTITION BY c_nationkey), 2) AS balance FROM customer",
    "agg_rollup": "SELECT r_name, n_name, COUNT(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderpriority) AS BIGINT) AS all_priorities, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    "agg_category": "SELECT p_brand, ROUND(SUM(p_retailprice), 2) AS total, ROUND(AVG(p_retailprice), 4) AS mean, COUNT(*) AS n FROM part GROUP BY p_brand",
    "fan_trap_naive": "SELECT ROUND(SUM(c_acctbal), 2) AS customer_balance, ROUND(SUM(s_acctbal), 2) AS supplier_balance FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey",
    "fan_trap_inflation": "SELECT b.k AS nationkey, ROUND(j.total / b.total, 4) AS inflation, s.n AS suppliers FROM (SELECT c_nationkey AS k, SUM(c_acctbal) AS total FROM customer GROUP BY c_nationkey) b JOIN (SELECT c_nationkey AS k, SUM(c_acctbal) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY c_nationkey) j ON j.k = b.k JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY s_nationkey) s ON s.k = b.k",
    "multi_fact_totals": MULTI_FACT,
    # windows
    "win_partition_sum": "SELECT o_orderkey, o_custkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS customer_total FROM orders",
    "win_row_number": "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders) t WHERE rn <= 3",
    "win_running_total": "SELECT o_custkey, o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "win_first_last": "SELECT o_custkey, o_orderkey, FIRST_VALUE(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first_price, LAST_VALUE(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_price, ROUND(PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6) AS share FROM orders",
    "win_lead_dense": "SELECT o_custkey, o_orderkey, COALESCE(LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS next_order, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS priority_rank FROM orders",
    # order, limits, sets
    "topk_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
    "sample_limit": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "set_except": "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'",
    # scalars
    "fn_round": "SELECT l_orderkey, l_linenumber, CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_tax AS DECIMAL(4, 2)), 1) AS DOUBLE) AS tax FROM lineitem",
    "fn_coalesce": "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'P'), 'pending') AS status FROM orders",
    # data behind the declared keys
    "pk_uniqueness": " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n, COUNT(DISTINCT {k[0]}) AS distinct_keys FROM {t}" for t, k in STAR_KEYS.items() if len(k) == 1),
}


def _views(spark: SparkSession, sf_dir: str, sql: str) -> Catalog:
    words = set(re.findall(r"\w+", sql))
    return load_parquet(spark, sf_dir, [t for t in STAR_TABLES if t in words])


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement that the guard lets through, over the tables it names."""
    _views(spark, sf_dir, sql)
    verdict = guard.inspect(spark, sql)
    if not verdict.is_safe:
        raise ValueError(verdict.error)
    return verdict.frame or spark.sql(sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of two facts by nation: guarded, checked for fan-traps, then run."""
    from .plans.check import Checker

    catalog = _views(spark, sf_dir, MULTI_FACT)
    report = Checker(spark, catalog.analyse()).validate(MULTI_FACT)
    if not report.valid or report.fan_trap_risk:
        raise ValueError("; ".join(i.message for i in report.issues))
    return run_sql(spark, sf_dir, MULTI_FACT)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _nation_facts(spark: SparkSession, d: str) -> dict[str, facts.Fact]:
    return {
        "CUSTOMER": (_t(spark, d, "customer"), "c_nationkey", {"customer_balance": "c_acctbal"}),
        "SUPPLIER": (_t(spark, d, "supplier"), "s_nationkey", {"supplier_balance": "s_acctbal"}),
    }


def agg_union_facts(spark: SparkSession, d: str) -> DataFrame:
    made = facts.total_by_key("nationkey", _nation_facts(spark, d))
    return made.select("nationkey", F.round("customer_balance", 2).alias("customer_balance"), F.round("supplier_balance", 2).alias("supplier_balance"))


def agg_preaggregated(spark: SparkSession, d: str) -> DataFrame:
    spine = _t(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    made = facts.preaggregate_facts(spine, "nationkey", _nation_facts(spark, d))
    return made.select("n_name", F.round("customer_balance", 2).alias("customer_balance"), F.round("supplier_balance", 2).alias("supplier_balance"))


def verify_total(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders")
    joined = orders.join(_t(spark, d, "lineitem"), orders.o_orderkey == F.col("l_orderkey"))
    found = facts.verify_total(joined, "o_totalprice", orders, "o_totalprice")
    return found.select(F.round("result_total", 2).alias("result_total"), F.round("base_total", 2).alias("base_total"), F.round("difference", 2).alias("difference"))


def _month(c: str):
    return F.date_trunc("month", c).cast("timestamp_ntz")


def win_lag_growth(spark: SparkSession, d: str) -> DataFrame:
    by = _t(spark, d, "orders").groupBy(_month("o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    before = F.lag("total").over(Window.orderBy("month"))
    return by.select("month", F.round("total", 2).alias("total"), F.round(100 * (F.col("total") - before) / before, 2).alias("growth"))


def fn_date_trunc(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").groupBy(_month("o_orderdate").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


def fn_label(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", measure_label_column(F.concat(F.lit("net_"), F.lower(F.translate("p_type", " ", "_")))).alias("label"))


def fn_clean_name(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", clean_name_column(F.concat_ws("-", F.col("p_size").cast("string"), "p_name")).alias("name"))


def chart_bar(spark: SparkSession, d: str) -> DataFrame:
    return charts.group_sum(_t(spark, d, "customer"), "c_mktsegment", "c_acctbal").withColumn("c_acctbal", F.round("c_acctbal", 2))


def chart_grouped(spark: SparkSession, d: str) -> DataFrame:
    rows = charts.group_sum(_t(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus")
    made = charts.with_totals(rows, "o_orderpriority", "o_totalprice")
    return made.select("o_orderpriority", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), F.round("category_total", 2).alias("category_total"), "category_rank")


def chart_month_order(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select(F.date_format("o_orderdate", "MMM").alias("month"), "o_totalprice")
    made = charts.group_sum(rows, "month", "o_totalprice")
    return made.select("month", month_order(F.col("month")).cast("long").alias("place"), F.round("o_totalprice", 2).alias("total"))


def chart_quarter_order(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string"))
    made = charts.group_sum(_t(spark, d, "orders").select(label.alias("quarter"), "o_totalprice"), "quarter", "o_totalprice")
    return made.select("quarter", quarter_order(F.col("quarter")).cast("long").alias("place"), F.round("o_totalprice", 2).alias("total"))


def chart_heatmap_counts(spark: SparkSession, d: str) -> DataFrame:
    return charts.cross_tab(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


def chart_corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    made = charts.correlations(_t(spark, d, "lineitem"), list(_MEASURES))
    return made.select("col_a", "col_b", F.round("r", 6).alias("r"))


def chart_multi_measure(spark: SparkSession, d: str) -> DataFrame:
    by = _t(spark, d, "lineitem").groupBy(_month("l_shipdate").alias("month"))
    return by.agg(F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(100 * F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice"), 4).alias("discount_pct"))


def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Values of each declared link that its target lacks; a table with several links is read once."""
    out = []
    for table in dict.fromkeys(x[0] for x in STAR_LINKS):
        links = [x[1:] for x in STAR_LINKS if x[0] == table]
        frame = _t(spark, d, table).select(*(c for c, _, _ in links))
        for n, (column, other, key) in enumerate(links):
            keys = _t(spark, d, other).select(F.col(key).alias(f"key{n}")).distinct()
            frame = frame.join(keys, F.col(column) == F.col(f"key{n}"), "left")
        lone = frame.agg(*(F.count(F.when(F.col(c).isNotNull() & F.col(f"key{n}").isNull(), 1)).alias(f"n{n}") for n, (c, _, _) in enumerate(links)))
        rows = F.array(*(F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("fk"), F.col(f"n{n}").alias("orphans")) for n, (c, _, _) in enumerate(links)))
        out.append(lone.select(F.explode(rows).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, out)


def fk_cardinality(spark: SparkSession, d: str) -> DataFrame:
    per = _t(spark, d, "orders").join(_t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")), "o_orderkey", "left")
    n = F.coalesce("n", F.lit(0))
    return per.agg(F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"))


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders")
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    sums = orders.agg(*(x for c in names for x in (F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}_nulls"), F.count_distinct(c).alias(f"{c}_distinct"), F.min(c).cast("string").alias(f"{c}_min"), F.max(c).cast("string").alias(f"{c}_max"))))
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_nulls").alias("nulls"), F.col(f"{c}_distinct").alias("distinct_values"), F.col(f"{c}_min").alias("least"), F.col(f"{c}_max").alias("most")) for c in names]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def r2rml_apply(spark: SparkSession, d: str) -> DataFrame:
    catalog = load_parquet(spark, d, ["nation", "region"])
    return r2rml.apply(catalog.table("nation"), spark.table("nation"), "http://example.com/")


def footer_profile(spark: SparkSession, d: str) -> DataFrame:
    return footers.profile(spark, {t: f"{d}/{t}.parquet" for t in STAR_TABLES}).where("nulls is not null")


def fan_out_paths(spark: SparkSession, d: str) -> DataFrame:
    """Rows and multiplicity along every path of the declared links."""
    return fanout.measure(spark, load_parquet(spark, d).analyse(), lambda t: _t(spark, d, t))


def fan_trap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Tables that repeat each other's rows when joined through an ancestor of both."""
    return fanout.traps(fan_out_paths(spark, d))


def win_rank(spark: SparkSession, d: str) -> DataFrame:
    """A rank within nations, and quartiles of all customers without one task that holds them."""
    made = ranks.ntile_rows(_t(spark, d, "customer"), ["c_acctbal", "c_custkey"], 4, "quartile")
    return made.select("c_custkey", F.rank().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment")).cast("long").alias("rnk"), "quartile")


def win_global_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of all orders by their day, many to a day; buckets of 1000 days' keys, so that several are needed even here."""
    made = ranks.rank_rows(_t(spark, d, "orders"), ["o_orderdate"], bucket_rows=1000)
    return made.select("o_orderkey", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"))


_MAPPED = "http://example.com/"


def _all_triples(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[str, str, str | None]]]:
    """Triples of all rows of all tables, by a mapping that is written and read back, and the kinds that it makes."""
    maps = r2rml.mappings(r2rml.document(load_parquet(spark, d).analyse(), _MAPPED, references=True))

    def read(m: r2rml.Mapping) -> DataFrame:
        verdict = guard.inspect(spark, m.query)
        if verdict.frame is None:
            raise ValueError(verdict.error)
        return verdict.frame

    return r2rml.triples_of(maps, read), r2rml.kinds(maps)


#: Kinds of triples that one number holds as bits.
_BITS = 63


def _by_predicate(made: DataFrame, kinds: list[tuple[str, str, str | None]]) -> DataFrame:
    """Per predicate and type: triples, different subjects and objects, and the least subject.

    The triples are read once and dealt once.  ``kinds`` (predicate, kind,
    datatype) are numbered, so a subject is one row, whatever its triples, with
    the bits of its kinds; a triple of no such kind is an error.
    """
    numbered = [F.struct(F.lit(n).alias("kind"), *(F.lit(x).cast("string").alias(a) for a, x in zip("pkd", k, strict=True))) for n, k in enumerate(kinds)]
    known = made.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*numbered)))
    none_known = F.raise_error(F.concat(F.lit("a triple of no known kind: "), "predicate")).cast("int")
    same = (F.col("predicate") == F.col("p")) & (F.col("object_kind") == F.col("k")) & F.col("datatype").eqNullSafe(F.col("d"))
    # One number finds a kind, and its three texts are compared once it is found.
    found = made.join(F.broadcast(known.withColumn("h", F.xxhash64("p", "k", "d"))), F.xxhash64("predicate", "object_kind", "datatype") == F.col("h"), "left")
    told = found.select("subject", F.when(same, F.col("kind")).otherwise(none_known).alias("kind"), F.xxhash64("object").alias("o"))
    at = range((len(kinds) - 1) // _BITS + 1)
    bits = [F.bit_or(F.expr(f"if(kind div {_BITS} = {n}, shiftleft(1L, kind % {_BITS}), 0L)")).alias(f"b{n}") for n in at]
    sets = told.groupingSets([["subject"], ["kind", "o"]], "subject", "kind", "o").agg(F.count("*").alias("n"), *bits, F.grouping("subject").alias("of_object"))
    masks = [F.when(F.col("of_object") == 0, F.col(f"b{n}")).otherwise(0).alias(f"b{n}") for n in at]
    few = sets.select("subject", "kind", "n", *masks).groupBy("kind", *(f"b{n}" for n in at)).agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("subject").alias("first"))
    row = lambda k, n, subjects, first, objects: F.struct(k.alias("kind"), n.alias("n"), subjects.alias("subjects"), first.alias("first"), objects.alias("objects"))
    none, nothing = F.lit(0).cast("long"), F.lit(None).cast("string")
    has = F.expr(f"filter(sequence(0, {len(kinds) - 1}), k -> shiftright(element_at(array({', '.join(f'b{n}' for n in at)}), int(k div {_BITS}) + 1), k % {_BITS}) & 1L = 1L)")
    of_subjects = F.transform(has, lambda k: row(k, none, F.col("rows"), F.col("first"), none))
    said = few.select(F.explode(F.when(F.col("kind").isNull(), of_subjects).otherwise(F.array(row(F.col("kind"), F.col("n"), none, nothing, F.col("rows"))))).alias("x")).select("x.*")
    sums = said.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("subjects").alias("subjects"), F.min("first").alias("first"), F.sum("objects").alias("objects"))
    return sums.join(F.broadcast(known), "kind").select(F.col("p").alias("predicate"), F.col("k").alias("object_kind"), F.col("d").alias("datatype"), "n", "subjects", "first", "objects")


def r2rml_all(spark: SparkSession, d: str) -> DataFrame:
    return _by_predicate(*_all_triples(spark, d))


def ntriples_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The same triples, once they have been N-Triples lines, in which a string's type goes without saying."""
    made, kinds = _all_triples(spark, d)
    plain = dict.fromkeys((p, k, None if t == f"{rdf.XSD}string" else t) for p, k, t in kinds)
    return _by_predicate(triples.from_ntriples(triples.ntriples(made)), list(plain))


def _catalog(spark: SparkSession, d: str) -> Catalog:
    return load_parquet(spark, d)


def catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).columns_df().select("table_name", "column_name", "data_type", "is_primary_key", "is_foreign_key")


def infer_fk(spark: SparkSession, d: str) -> DataFrame:
    return infer.embedded_links_df(_catalog(spark, d).columns_df())


#: How often a word of the documents occurs that is taken for a table's name, in a million words.
WORD_SHARE = 60
_WORD_TAILS = ("id", "_id", "_sk", "", "name", "_nr")
_WORD_KINDS = ("bigint", "int", "string")


def _kept(spark: SparkSession, made: DataFrame, tag: str) -> DataFrame:
    """The rows, written once for all that read them."""
    path = scratch.folder(spark, tag)
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def word_catalog(docs: DataFrame) -> DataFrame:
    """Columns of a catalog that the documents' words make up.

    Frequent words are tables; of each, the words that follow it are columns,
    with a tail and a type that their length gives, behind a key.  By their
    share there are at most 16,667 tables, so they go to the pairs, which are many:
    words are counted first, and only pairs that begin with a table's name are
    dealt, once.  Types are compared by their places in alphabetical order, as a
    greatest string would have to be found by sorting.  The catalog is kept in the
    shared folder, so that texts are cut for the counts and for the catalog alone.
    """
    spark = docs.sparkSession
    words = docs.select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    counts = _kept(spark, words.select(F.explode("w").alias("a")).groupBy("a").agg(F.count("*").alias("n")), "words")
    total = counts.agg(F.sum("n").alias("total"))
    tables = counts.join(F.broadcast(total)).where((F.length("a").between(3, 12)) & (F.col("n") * 1_000_000 >= F.col("total") * WORD_SHARE)).select(F.col("a").alias("table_name"))
    tables = _kept(spark, tables, "tables")
    pairs = words.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("x")).select("x.*")
    length = F.length("b")
    tail = F.element_at(F.array(*map(F.lit, _WORD_TAILS)), length % len(_WORD_TAILS) + 1)
    kind = F.element_at(F.array(*(F.lit(_WORD_KINDS.index(x)) for x in ("string", "int", "bigint"))), length % 3 + 1)
    free = pairs.where("b is not null").join(F.broadcast(tables), F.col("a") == F.col("table_name")).select("table_name", F.concat("b", tail).alias("column_name"), kind.alias("kind"), F.lit(False).alias("is_primary_key"))
    key_kind = F.when(F.length("table_name") % 2 == 0, _WORD_KINDS.index("int")).otherwise(_WORD_KINDS.index("string"))
    keys = tables.select("table_name", F.concat("table_name", F.lit("key")).alias("column_name"), key_kind.alias("kind"), F.lit(True).alias("is_primary_key"))
    whole = free.unionByName(keys).groupBy("table_name", "column_name").agg(F.max("kind").alias("kind"), F.max("is_primary_key").alias("is_primary_key"))
    named = F.element_at(F.array(*map(F.lit, _WORD_KINDS)), F.col("kind") + 1)
    return _kept(spark, whole.select("table_name", "column_name", named.alias("data_type"), "is_primary_key"), "catalog").withColumns({"position": F.lit(1), "is_foreign_key": F.lit(False)})


def infer_links(spark: SparkSession, d: str) -> DataFrame:
    return infer.links_df(word_catalog(_t(spark, d, "documents")))


def infer_copies(spark: SparkSession, d: str) -> DataFrame:
    return infer.copies_df(word_catalog(_t(spark, d, "documents")))


def name_quality(spark: SparkSession, d: str) -> DataFrame:
    made = _catalog(spark, d).columns_df().select("table_name", "column_name", reason_count_column(F.col("column_name")).cast("long").alias("reasons"))
    return made.where("reasons > 0")


def xsd_types(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).columns_df().select("data_type", xsd_column(F.col("data_type")).alias("xsd"), xsd_column(F.col("data_type"), "r2rml").alias("r2rml_xsd")).distinct()


def ontology_triples(spark: SparkSession, d: str) -> DataFrame:
    made = rdf.triples_df(spark, rdf.schema_triples(_catalog(spark, d).analyse()))
    return made.groupBy("predicate").agg(F.count("*").alias("n"))


def ontology_counts(spark: SparkSession, d: str) -> DataFrame:
    made = rdf.triples_df(spark, rdf.schema_triples(_catalog(spark, d).analyse()))
    kinds = rdf.match(made, predicate=f"{rdf.RDF}type").groupBy(F.regexp_extract("object", "#(.*)$", 1).alias("kind"))
    return kinds.agg(F.count_distinct("subject").alias("n"))


def type_overrides(spark: SparkSession, d: str) -> DataFrame:
    rows = [(x["table"], x["column"], x["sql_type"]) for x in infer.type_overrides(_catalog(spark, d).analyse())]
    return spark.createDataFrame(rows, "table_name string, column_name string, sql_type string")


def information_schema(spark: SparkSession, d: str) -> DataFrame:
    _catalog(spark, d).register_information_schema()
    return spark.sql("SELECT table_name, COUNT(*) AS columns FROM information_schema_columns GROUP BY table_name")


def fan_trap_hints(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).keys_df().groupBy("table_name").agg(F.count("*").alias("n")).where("n > 1")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from .streaming import windowed_totals

    made = windowed_totals(_t(spark, d, "events"))
    return made.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("value", 2).alias("value"))


def event_windows_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same totals from a stream of the table's files, in micro-batches with state, until all is read."""
    from .streaming import event_stream, latest_totals, running_totals

    out = scratch.folder(spark, "windows")
    events = _t(spark, d, "events")
    running_totals(event_stream(spark, f"{d}/events.parquet*", schema=events.schema), f"{out}/totals", f"{out}/checkpoint").awaitTermination()
    made = latest_totals(spark, f"{out}/totals")
    return made.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("value", 2).alias("value"))


#: Sums over joins of the star: the statement, its total, and that of the measure's own table.
SUMMED = (
    ("SELECT SUM(o_totalprice) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey", "SELECT SUM(o_totalprice) FROM orders"),
    ("SELECT SUM(l_quantity) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "SELECT SUM(l_quantity) FROM lineitem"),
    ("SELECT SUM(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", "SELECT SUM(o_totalprice) FROM orders"),
    ("SELECT SUM(c_acctbal) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey", "SELECT SUM(c_acctbal) FROM customer"),
    ("SELECT SUM(s_acctbal) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "SELECT SUM(s_acctbal) FROM supplier"),
    ("SELECT SUM(p_retailprice) AS total FROM part JOIN lineitem ON l_partkey = p_partkey", "SELECT SUM(p_retailprice) FROM part"),
    ("SELECT SUM(c_acctbal) AS total FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey", "SELECT SUM(c_acctbal) FROM customer"),
)


def checker_fan_traps(spark: SparkSession, d: str) -> DataFrame:
    """What the checker says of joined sums, beside the totals that the data give with and without the join."""
    from .plans.check import Checker

    checker, out = Checker(spark, _catalog(spark, d).analyse()), []
    for n, (joined, own) in enumerate(SUMMED):
        trap = checker.validate(joined).fan_trap_risk
        base = spark.sql(own)
        whole = spark.sql(joined).select(F.col("total"), F.lit(None).cast("double").alias("own")).unionByName(base.select(F.lit(None).cast("double").alias("total"), F.col(base.columns[0]).alias("own")))
        out.append(whole.agg(F.round(F.max("total"), 2).alias("total"), F.round(F.max("own"), 2).alias("own")).select(F.lit(n).cast("long").alias("statement"), F.lit(trap).alias("fan_trap"), "total", "own"))
    return reduce(DataFrame.unionByName, out)


#: Tables, a condition on each, and conditions that a statement adds to it by OR; the data tell which of these widen it to all rows.
ADDED = {
    "nation": ("n_nationkey = 1", ("n_nationkey + 0 = n_nationkey", "n_name LIKE '%'", "length(n_name) >= 0", "n_name = n_name", "1 = 1", "n_regionkey > 2", "n_name LIKE 'NATION_1%'", "n_name <> 'x' AND n_regionkey = 0", "n_nationkey IN (3, 4)", "n_nationkey % 7 <> 3")),
    "customer": ("c_custkey = 7", ("abs(c_acctbal) >= 0", "c_custkey < c_custkey + 1", "NOT c_name <> c_name", "c_acctbal > 0", "c_mktsegment <> 'BUILDING'", "c_custkey BETWEEN 10 AND 20")),
    "orders": ("o_orderkey = 1", ("o_totalprice * o_totalprice >= 0", "o_orderdate = o_orderdate", "o_orderstatus || '' = o_orderstatus", "o_totalprice > 100000", "o_orderstatus IN ('F', 'P')", "o_orderpriority LIKE '1%'", "o_custkey <> 3 AND o_totalprice < 5000")),
    "lineitem": ("l_orderkey = 1", ("coalesce(l_tax, 0) = coalesce(l_tax, 0)", "l_quantity <= l_quantity + 1", "l_discount > 0.05", "l_returnflag <> 'R'")),
}


def _added_sql(judged: str) -> str:
    """Rows of each table, and those that its condition and each added one let through; ``judged`` gives the verdict on condition ``{c}``."""
    out = []
    for t, (base, conditions) in ADDED.items():
        for c in conditions:
            text = c.replace("'", "''")
            out.append(f"SELECT '{t}' AS table_name, '{text}' AS added, COUNT(*) AS total, COUNT(CASE WHEN {base} OR {c} THEN 1 END) AS kept, {judged.format(c=c)} AS is_safe FROM {t}")
    return " UNION ALL ".join(out)


#: Statements over the star schema, whether they are valid, whether they may count rows twice, and the first finding.
CHECKED = (
    ("SELECT n_name FROM nation", True, False, None),
    ("SELECT * FROM nowhere", False, False, "table_not_found"),
    ("SELECT n.n_size FROM nation n", False, False, "column_not_found"),
    ("SELECT * FROM nation, region", False, False, "missing_join_condition"),
    ("SELECT r_name, COUNT(*) FROM nation JOIN region ON n_regionkey = r_regionkey", False, False, "non_aggregated_column"),
    ("SELECT r_name, COUNT(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", True, False, None),
    ("SELECT n.n_name FROM nation n JOIN region r ON n.n_nationkey = r.r_regionkey", True, False, "invalid_join"),
    ("SELECT n_name, SUM(c_acctbal), SUM(s_acctbal) FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name", True, True, "fan_trap_detected"),
    ("SELECT SUM(o_totalprice) FROM orders JOIN lineitem ON l_orderkey = o_orderkey", True, True, "fan_trap_detected"),
    ("SELECT MAX(o_totalprice) FROM orders JOIN lineitem ON l_orderkey = o_orderkey", True, False, None),
)


def guard_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What the guard says of statements over whole tables, beside the rows that they would read; each table is read once."""
    load_parquet(spark, d, list(ADDED))
    out = []
    for t, (base, conditions) in ADDED.items():
        safe = [guard.inspect(spark, f"SELECT * FROM {t} WHERE {base} OR {c}").is_safe for c in conditions]
        sums = spark.table(t).agg(F.count("*").alias("total"), *(F.count_if(F.expr(f"({base}) OR ({c})")).alias(f"k{n}") for n, c in enumerate(conditions)))
        rows = F.array(*(F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("added"), "total", F.col(f"k{n}").alias("kept"), F.lit(safe[n]).alias("is_safe")) for n, c in enumerate(conditions)))
        out.append(sums.select(F.explode(rows).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, out)


def checker_verdicts(spark: SparkSession, d: str) -> DataFrame:
    from .plans.check import Checker

    checker, out = Checker(spark, _catalog(spark, d).analyse()), []
    for n, (sql, *_) in enumerate(CHECKED):
        made = checker.validate(sql)
        out.append((n, made.valid, made.fan_trap_risk, made.issues[0].issue_type if made.issues else None))
    return spark.createDataFrame(out, "statement long, is_valid boolean, fan_trap boolean, finding string")


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

# ---- the catalog as DuckDB sees it: what the files hold, with the declared keys

_TYPES = "CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP_NS' THEN 'timestamp_ntz' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"
_COLS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, {_TYPES} AS data_type FROM (DESCRIBE {t})" for t in STAR_TABLES)
_PKS = ", ".join(f"('{t}', '{c}')" for t, keys in STAR_KEYS.items() for c in keys)
_FKS = ", ".join(f"('{t}', '{c}')" for t, c, _, _ in STAR_LINKS)
_TAILS = ", ".join(f"'{x}'" for x in infer.KEY_TAILS)
#: A column that is no key and ends, but for a tail, with another table's name or its singular.
_LINKED = (
    f"SELECT c.table_name, column_name, t.table_name AS target FROM ({_COLS}) c JOIN (SELECT DISTINCT table_name, unnest([table_name, regexp_replace(table_name, 's$', '')]) AS word FROM ({_COLS})) t "
    f"ON t.table_name <> c.table_name AND len(word) >= 4 AND contains(column_name, word) AND list_contains([{_TAILS}], substr(column_name, strpos(column_name, word) + len(word))) "
    f"WHERE (c.table_name, column_name) NOT IN ({_PKS}) AND (c.table_name, column_name) NOT IN ({_FKS}) GROUP BY ALL"
)
#: The catalog of words, and words with the tables they stand for.
_WORDS = (
    "text AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), "
    "pairs AS MATERIALIZED (SELECT a, b, COUNT(*) AS n FROM (SELECT unnest(w) AS a, unnest(w[2:] || [NULL]) AS b FROM text) GROUP BY a, b), "
    f"named AS MATERIALIZED (SELECT a AS table_name FROM pairs WHERE length(a) BETWEEN 3 AND 12 GROUP BY a HAVING SUM(n) * 1000000 >= (SELECT SUM(n) FROM pairs) * {WORD_SHARE}), "
    "whole AS MATERIALIZED (SELECT table_name, column_name, lower(column_name) AS c, MAX(data_type) AS data_type, MAX(k) AS is_primary_key FROM ("
    f"SELECT table_name, b || [{', '.join(repr(x) for x in _WORD_TAILS)}][length(b) % {len(_WORD_TAILS)} + 1] AS column_name, ['string', 'int', 'bigint'][length(b) % 3 + 1] AS data_type, false AS k FROM pairs JOIN named ON a = table_name WHERE b IS NOT NULL "
    "UNION ALL SELECT table_name, table_name || 'key', CASE WHEN length(table_name) % 2 = 0 THEN 'int' ELSE 'string' END, true FROM named) GROUP BY ALL), "
    "forms AS (SELECT table_name, table_name AS word, 0 AS kind FROM named UNION ALL SELECT table_name, regexp_replace(table_name, '(ies|es|s)$', CASE WHEN table_name LIKE '%ies' THEN 'y' ELSE '' END), 1 FROM named WHERE regexp_matches(table_name, '.(ies|es|s)$')), "
    "words AS MATERIALIZED (SELECT word, arg_max(table_name, (table_name, kind)) AS target, min((table_name, kind)) AS turn FROM forms WHERE length(word) >= 4 GROUP BY word), "
    "met AS MATERIALIZED (SELECT w.table_name, column_name, c, word, target, turn, c[strpos(c, word) + length(word):] AS tail, data_type, is_primary_key FROM whole w JOIN words ON contains(c, word) AND target <> w.table_name)"
)
_FORM_SQL = ", ".join(f"{{'form': {n}, 'pattern': '{name}', 'word': regexp_extract(c, '{form}', 1)}}" for n, (name, form) in enumerate(infer.FORMS))
_LINKS_SQL = (
    f"WITH {_WORDS}, embedded AS (SELECT table_name, column_name, arg_min(target, (-length(word), turn)) AS target, 'embedded_table_name' AS pattern, arg_min(word, (-length(word), turn)) AS word FROM met "
    f"WHERE NOT is_primary_key AND tail IN ({_TAILS}) GROUP BY ALL), "
    f"asked AS (SELECT table_name, column_name, unnest([{_FORM_SQL}], recursive := true) FROM whole WHERE NOT is_primary_key AND (table_name, column_name) NOT IN (SELECT table_name, column_name FROM embedded)), "
    "tried AS (SELECT *, unnest([word, word || 's', word || 'es', word || 'ies', CASE WHEN word LIKE '%_ies' THEN word[:-4] || 'y' END, CASE WHEN word LIKE '%_es' THEN word[:-3] END, CASE WHEN word LIKE '%_s' THEN word[:-2] END, CASE WHEN word LIKE '%y' THEN word[:-2] || 'ies' END]) AS name, "
    "unnest(range(8)) AS turn FROM asked WHERE length(word) >= 3), "
    "formed AS (SELECT table_name, column_name, arg_min(target, form) AS target, arg_min(pattern, form) AS pattern, arg_min(word, form) AS word FROM ("
    "SELECT t.table_name, column_name, form, pattern, word, arg_min(n.table_name, turn) AS target FROM tried t JOIN named n ON n.table_name = name GROUP BY ALL) WHERE target <> table_name GROUP BY table_name, column_name), "
    "hits AS (SELECT * FROM embedded UNION ALL SELECT * FROM formed), "
    "scored AS (SELECT h.*, k.column_name AS target_column, CASE WHEN w.data_type = k.data_type OR (contains(w.data_type, 'int') AND contains(k.data_type, 'int')) THEN 2 ELSE 0 END + CASE WHEN word = target THEN 2 WHEN word || 's' = target THEN 1 ELSE 0 END + ends_with(w.c, 'id')::INT AS score "
    "FROM hits h JOIN whole w USING (table_name, column_name) JOIN whole k ON k.table_name = target AND k.is_primary_key) "
    "SELECT table_name, column_name, target, target_column, pattern, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM scored"
)
_COPIES_SQL = (
    f"WITH {_WORDS} SELECT table_name, column_name, arg_min(target, (-length(word), turn)) AS likely_source FROM met WHERE contains(data_type, 'string') AND (tail IN ('', 'name', 'title', 'desc', 'description') OR "
    + " OR ".join(f"contains(c, '{x}')" for x in infer.TEXT_WORDS) + ") GROUP BY ALL"
)
def _triples_sql(plain_strings: bool) -> str:
    """Triples of all tables, in DuckDB; in N-Triples a string's type goes without saying."""
    out = []
    for t in STAR_TABLES:
        key = STAR_KEYS.get(t) or ({"lineitem": ("l_orderkey",)}[t])
        subject = f"'{_MAPPED}{t}/' || " + " || '-' || ".join(f"e.{k}" for k in key)
        out.append(f"SELECT {subject} AS subject, '{rdf.RDF}type' AS predicate, '{_MAPPED}{t.capitalize()}' AS object, 'iri' AS object_kind, NULL AS datatype FROM {t} e")
        for _, column, other, k in [x for x in STAR_LINKS if x[0] == t]:
            out.append(f"SELECT {subject}, '{_MAPPED}{column}', '{_MAPPED}{other}/' || o.{k}, 'iri', NULL FROM {t} e JOIN {other} o ON e.{column} = o.{k}")
        for column, kind in _COLUMN_TYPES[t].items():
            if (t, column) not in {x[:2] for x in STAR_LINKS}:
                datatype = "NULL" if plain_strings and kind == "string" else f"'{rdf.XSD}{kind}'"
                out.append(f"SELECT {subject}, '{_MAPPED}{column}', e.{column}::VARCHAR, 'literal', {datatype} FROM {t} e WHERE e.{column} IS NOT NULL")
    return f"SELECT predicate, object_kind, datatype, COUNT(*) AS n, COUNT(DISTINCT subject) AS subjects, MIN(subject) AS first, COUNT(DISTINCT object) AS objects FROM ({' UNION ALL '.join(out)}) GROUP BY ALL"


#: The columns of the test tables and their types.
_COLUMN_TYPES = {
    "region": {"r_regionkey": "integer", "r_name": "string"},
    "nation": {"n_nationkey": "integer", "n_name": "string", "n_regionkey": "integer"},
    "customer": {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "double"},
    "part": {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "double"},
    "orders": {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "dateTime", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "dateTime"},
    "events": {"event_id": "integer", "ts": "dateTime", "user_id": "integer", "event_type": "string", "value": "double", "props": "string"},
    "documents": {"doc_id": "integer", "text": "string", "lang": "string", "source": "string", "n_chars": "integer"},
    "embeddings": {"vec_id": "integer", "embedding": "float", "label": "integer"},
    "pages": {"page_id": "integer", "url": "string", "html": "string"},
    "benchmark": {"item_id": "integer", "text": "string"},
    "labels": {"doc_id": "integer", "quality": "integer", "toxic": "integer"},
    "conversations": {"conv_id": "integer", "turn": "integer", "role": "string", "text": "string"},
}
_EXACT = ("integer", "double")
_FOOTER_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS nulls, " + ", ".join(f"{f}({c})::VARCHAR AS {n}" if k in _EXACT else f"NULL AS {n}" for f, n in (("MIN", "least"), ("MAX", "most"))) + f" FROM {t}"
    for t, columns in _COLUMN_TYPES.items() for c, k in columns.items() if k != "float"
)
#: Rows of each path up the links: by the key they reach, one hop more in each turn.
_FAN_OUT = (
    "links AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{t}' AS child, '{o}' AS parent, {('e.' + STAR_KEYS[t][0]) if len(STAR_KEYS.get(t, ())) == 1 else 'NULL'}::BIGINT AS own, e.{c}::BIGINT AS key FROM {t} e" for t, c, o, _ in STAR_LINKS) + "), "
    "up AS (SELECT child AS descendant, parent AS ancestor, [child, parent] AS path, key, COUNT(*) AS n FROM links GROUP BY ALL "
    "UNION ALL SELECT descendant, parent, list_append(path, parent), l.key, n FROM up JOIN links l ON l.child = ancestor AND l.own = up.key WHERE NOT list_contains(path, parent)), "
    "reached AS (SELECT descendant, ancestor, path, key, SUM(n) AS n FROM up WHERE key IS NOT NULL GROUP BY ALL), "
    "fan AS (SELECT descendant, ancestor, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS hops, COUNT(*) AS keys, SUM(n)::BIGINT AS rows, MAX(n)::BIGINT AS most FROM reached GROUP BY ALL)"
)
_REASONS = " + ".join(
    [
        "(len(column_name) <= 3)::INT", "(len(column_name) > 1 AND upper(column_name) = column_name AND regexp_matches(column_name, '[A-Z]'))::INT", "regexp_matches(column_name, '[0-9]$')::INT",
        "(2 * len([x for x in string_split(column_name, '_') if regexp_full_match(x, '[A-Za-z]{1,3}')]) > len(string_split(column_name, '_')))::INT",
        *(f"ends_with(lower(column_name), '_{x}')::INT" for x in ENDINGS), *(f"starts_with(lower(column_name), '{x}_')::INT" for x in BEGINNINGS),
    ]
)
_OVERRIDES = f"SELECT table_name, column_name, data_type AS sql_type FROM ({_COLS}) WHERE regexp_matches(lower(column_name), '{'|'.join(QUANTITY)}') AND regexp_matches(data_type, 'float|double|decimal|numeric|real')"
#: Triples of each predicate, from the numbers of tables, columns, keys and links, declared and found.
_FACTS = (
    (f"{rdf.RDF}type", "1 + t + c + 2 * l"), (f"{rdf.RDFS}label", "1 + t + c + 2 * l"), (f"{rdf.RDFS}comment", "1"), (f"{rdf.RDFS}domain", "c + 2 * l"), (f"{rdf.RDFS}range", "c + 2 * l"), (f"{rdf.OWL}inverseOf", "l"),
    *((f"{rdf.DEFAULT_BASE}db/{x}", n) for x, n in (
        ("tableName", "t + c"), ("schemaName", "t"), ("primaryKey", "k"), ("columnName", "c"), ("sqlDataType", "c"), ("isNullable", "c"), ("isPrimaryKey", "c"), ("isForeignKey", "c"), ("sqlReference", "c"), ("typeOverrideReason", "o"),
        ("foreignKeyColumn", "l"), ("referencedTable", "l"), ("referencedColumn", "l"), ("sqlJoinCondition", "l"), ("relationshipType", "2 * l"), ("isInferredRelationship", "2 * i"), ("inferenceConfidence", "i"), ("inferencePattern", "i"),
    )),
)
_ONTOLOGY = (
    f"WITH m AS (SELECT (SELECT COUNT(DISTINCT table_name) FROM ({_COLS})) AS t, (SELECT COUNT(*) FROM ({_COLS})) AS c, (SELECT COUNT(*) FROM ({_COLS}) WHERE (table_name, column_name) IN ({_PKS})) AS k, "
    f"(SELECT COUNT(*) FROM ({_LINKED})) AS i, (SELECT COUNT(*) FROM ({_COLS}) WHERE (table_name, column_name) IN ({_FKS})) AS f, (SELECT COUNT(*) FROM ({_OVERRIDES})) AS o), n AS (SELECT *, f + i AS l FROM m) "
    + " UNION ALL ".join(f"SELECT '{p}' AS predicate, {x} AS n FROM n" for p, x in _FACTS)
)
_bool = lambda x: "NULL" if x is None else str(x) if isinstance(x, bool) else f"'{x}'"

BUILT: dict[str, tuple[Query, str | None]] = {
    "agg_union_facts": (agg_union_facts, "SELECT nationkey, ROUND(SUM(c), 2) AS customer_balance, ROUND(SUM(s), 2) AS supplier_balance FROM (SELECT c_nationkey AS nationkey, c_acctbal AS c, 0 AS s FROM customer UNION ALL SELECT s_nationkey, 0, s_acctbal FROM supplier) GROUP BY nationkey"),
    "agg_preaggregated": (agg_preaggregated, "SELECT n_name, ROUND(COALESCE(c.v, 0), 2) AS customer_balance, ROUND(COALESCE(s.v, 0), 2) AS supplier_balance FROM nation LEFT JOIN (SELECT c_nationkey AS k, SUM(c_acctbal) AS v FROM customer GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, SUM(s_acctbal) AS v FROM supplier GROUP BY 1) s ON s.k = n_nationkey"),
    "verify_total": (verify_total, "SELECT ROUND(a, 2) AS result_total, ROUND(b, 2) AS base_total, ROUND(a - b, 2) AS difference FROM (SELECT SUM(o_totalprice) AS a FROM orders JOIN lineitem ON l_orderkey = o_orderkey), (SELECT SUM(o_totalprice) AS b FROM orders)"),
    "win_lag_growth": (win_lag_growth, "SELECT month, ROUND(total, 2) AS total, ROUND(100 * (total - LAG(total) OVER (ORDER BY month)) / LAG(total) OVER (ORDER BY month), 2) AS growth FROM (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, SUM(o_totalprice) AS total FROM orders GROUP BY 1)"),
    "fn_date_trunc": (fn_date_trunc, "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1"),
    "fn_label": (fn_label, "SELECT p_partkey, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(replace('net_' || lower(replace(p_type, ' ', '_')), '_', ' '), ' ')], ' ') AS label FROM part"),
    "fn_clean_name": (fn_clean_name, "SELECT p_partkey, '_' || regexp_replace(p_size || '-' || p_name, '[^A-Za-z0-9_]', '_', 'g') AS name FROM part"),
    "chart_bar": (chart_bar, "SELECT c_mktsegment, ROUND(SUM(c_acctbal), 2) AS c_acctbal FROM customer GROUP BY 1"),
    "chart_grouped": (chart_grouped, "WITH g AS (SELECT o_orderpriority, o_orderstatus, SUM(o_totalprice) AS v FROM orders GROUP BY 1, 2), t AS (SELECT o_orderpriority, SUM(v) AS total FROM g GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, o_orderpriority) AS category_rank FROM t) SELECT o_orderpriority, o_orderstatus, ROUND(v, 2) AS o_totalprice, ROUND(total, 2) AS category_total, category_rank FROM g JOIN r USING (o_orderpriority)"),
    "chart_month_order": (chart_month_order, "SELECT strftime(o_orderdate, '%b') AS month, MIN(month(o_orderdate)) AS place, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1"),
    "chart_quarter_order": (chart_quarter_order, "SELECT 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS quarter, MIN(year(o_orderdate) * 4 + quarter(o_orderdate)) AS place, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1"),
    "chart_heatmap_counts": (chart_heatmap_counts, "SELECT s.o_orderstatus, p.o_orderpriority, (SELECT COUNT(*) FROM orders o WHERE o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) s, (SELECT DISTINCT o_orderpriority FROM orders) p"),
    "chart_corr_matrix": (chart_corr_matrix, " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, " + ("1.0::DOUBLE AS r" if a == b else f"ROUND(CORR({a}, {b}), 6) AS r FROM lineitem") for a in _MEASURES for b in _MEASURES)),
    "chart_multi_measure": (chart_multi_measure, "SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS month, ROUND(SUM(l_extendedprice), 2) AS price, ROUND(100 * SUM(l_extendedprice * l_discount) / SUM(l_extendedprice), 4) AS discount_pct FROM lineitem GROUP BY 1"),
    "fk_orphans": (fk_orphans, " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS fk, COUNT(*) AS orphans FROM {t} WHERE {c} NOT IN (SELECT {k} FROM {o})" for t, c, o, k in STAR_LINKS)),
    "fk_cardinality": (fk_cardinality, "SELECT MIN(n) AS least, MAX(n) AS most, ROUND(AVG(n), 4) AS mean FROM (SELECT o_orderkey, COUNT(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"),
    "column_profile": (column_profile, " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls, COUNT(DISTINCT {c}) AS distinct_values, MIN({c})::VARCHAR AS least, MAX({c})::VARCHAR AS most FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))),
    "r2rml_apply": (
        r2rml_apply,
        "WITH s AS (SELECT 'http://example.com/nation/' || n_nationkey AS subject, * FROM nation) "
        f"SELECT subject, '{rdf.RDF}type' AS predicate, 'http://example.com/Nation' AS object, 'iri' AS object_kind, NULL::VARCHAR AS datatype FROM s UNION ALL "
        f"SELECT subject, 'http://example.com/n_nationkey', n_nationkey::VARCHAR, 'literal', '{rdf.XSD}integer' FROM s UNION ALL "
        f"SELECT subject, 'http://example.com/n_name', n_name, 'literal', '{rdf.XSD}string' FROM s UNION ALL "
        "SELECT subject, 'http://example.com/n_regionkey', 'http://example.com/region/' || n_regionkey, 'iri', NULL FROM s",
    ),
    "footer_profile": (footer_profile, _FOOTER_SQL),
    "fan_out_paths": (fan_out_paths, f"WITH RECURSIVE {_FAN_OUT} SELECT * FROM fan"),
    "fan_trap_pairs": (
        fan_trap_pairs,
        f'WITH RECURSIVE {_FAN_OUT} SELECT a.descendant AS "left", b.descendant AS "right", a.ancestor, MAX(b.most) AS left_factor, MAX(a.most) AS right_factor FROM fan a JOIN fan b ON a.ancestor = b.ancestor AND a.descendant < b.descendant '
        "WHERE a.most > 1 AND b.most > 1 AND NOT list_contains(string_split(a.path, '>'), b.descendant) AND NOT list_contains(string_split(b.path, '>'), a.descendant) GROUP BY ALL",
    ),
    "win_rank": (win_rank, "SELECT c_custkey, CAST(RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS rnk, CAST(NTILE(4) OVER (ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quartile FROM customer"),
    "win_global_ranks": (
        win_global_ranks,
        "SELECT o_orderkey, RANK() OVER (ORDER BY o_orderdate) AS rank, DENSE_RANK() OVER (ORDER BY o_orderdate) AS dense_rank, ROUND(PERCENT_RANK() OVER (ORDER BY o_orderdate), 9) AS percent_rank, ROUND(CUME_DIST() OVER (ORDER BY o_orderdate), 9) AS cume_dist FROM orders",
    ),
    "r2rml_all": (r2rml_all, _triples_sql(False)),
    "ntriples_round_trip": (ntriples_round_trip, _triples_sql(True)),
    "fan_trap_hints": (fan_trap_hints, f"SELECT t AS table_name, COUNT(*) AS n FROM (VALUES {_FKS}) k(t, c) GROUP BY t HAVING COUNT(*) > 1"),
    "infer_fk": (infer_fk, _LINKED),
    "infer_links": (infer_links, _LINKS_SQL),
    "infer_copies": (infer_copies, _COPIES_SQL),
    "xsd_types": (xsd_types, f"SELECT DISTINCT data_type, CASE WHEN data_type IN ('int', 'bigint') THEN 'integer' WHEN data_type = 'timestamp_ntz' THEN 'dateTime' WHEN data_type = 'array<float>' THEN 'float' ELSE data_type END AS xsd, xsd AS r2rml_xsd FROM ({_COLS})"),
    "guard_verdicts": (guard_verdicts, _added_sql("COUNT(CASE WHEN {c} THEN 1 END) < COUNT(*)")),
    "checker_verdicts": (checker_verdicts, "SELECT * FROM (VALUES " + ", ".join(f"({n}::BIGINT, {', '.join(map(_bool, x))})" for n, (_, *x) in enumerate(CHECKED)) + ") t(statement, is_valid, fan_trap, finding)"),
    "event_windows": (event_windows, "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS value FROM events GROUP BY 1, 2"),
    "event_windows_stream": (event_windows_stream, "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS value FROM events GROUP BY 1, 2"),
    "checker_fan_traps": (checker_fan_traps, " UNION ALL ".join(f"SELECT {n}::BIGINT AS statement, abs(total - own) > 0.005 AS fan_trap, ROUND(total, 2) AS total, ROUND(own, 2) AS own FROM (SELECT ({joined}) AS total, ({own}) AS own)" for n, (joined, own) in enumerate(SUMMED))),
    "ontology_counts": (ontology_counts, f"SELECT 'Ontology' AS kind, 1::BIGINT AS n UNION ALL SELECT 'Class', COUNT(DISTINCT table_name) FROM ({_COLS}) UNION ALL SELECT 'DatatypeProperty', COUNT(*) FROM ({_COLS}) UNION ALL SELECT 'ObjectProperty', 2 * ((SELECT COUNT(*) FROM (VALUES {_FKS})) + (SELECT COUNT(*) FROM ({_LINKED})))"),
    "type_overrides": (type_overrides, _OVERRIDES),
    "information_schema": (information_schema, " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS columns FROM (DESCRIBE {t})" for t in STAR_TABLES)),
    "catalog_columns": (catalog_columns, f"SELECT table_name, column_name, data_type, (table_name, column_name) IN ({_PKS}) AS is_primary_key, (table_name, column_name) IN ({_FKS}) AS is_foreign_key FROM ({_COLS})"),
    "name_quality": (name_quality, f"SELECT table_name, column_name, ({_REASONS})::BIGINT AS reasons FROM ({_COLS}) WHERE ({_REASONS}) > 0"),
    "ontology_triples": (ontology_triples, _ONTOLOGY),
}


def _sql_query(text: str) -> Query:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, text)


def queries() -> dict[str, Query]:
    return {k: _sql_query(v) for k, v in SQL.items()} | {k: f for k, (f, _) in BUILT.items()}


def oracle_sql() -> dict[str, str]:
    return SQL | {k: v for k, (_, v) in BUILT.items() if v}
