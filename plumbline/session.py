"""The tool API: one session over Spark, with its catalog, ontology and checks."""

from __future__ import annotations

import glob
import json
import logging
import os
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .functions import audit
from .functions.naming import is_identifier, quote, redact_log, redact_secrets
from .operators import charts, infer, r2rml, rdf
from .plans import guard
from .plans.check import Checker
from .plans.walker import Node
from .sources import connections, rest
from .sources.catalog import STAR_TABLES, Catalog, load_parquet

log = logging.getLogger(__name__)

#: Seconds that a query may take, and limits of rows.
QUERY_SECONDS = 60.0
TOOL_ROWS, MOST_ROWS, LEAST_CLAMP = 10_000, 5_000, 100
SAMPLE_DEFAULT, SAMPLE_TOOL_MOST, SAMPLE_MOST = 10, 100, 1_000
#: What to try on Spark's analysis errors.
HINTS = {
    "TABLE_OR_VIEW_NOT_FOUND": "check the table's name and schema",
    "UNRESOLVED_COLUMN": "check the column's name and its table",
    "MISSING_GROUP_BY": "add GROUP BY, or aggregate every column",
    "MISSING_AGGREGATION": "add the column to GROUP BY, or aggregate it",
    "DATATYPE_MISMATCH": "cast one side to the other's type",
    "PARSE_SYNTAX_ERROR": "check keywords, commas and parentheses",
}


def clamp_limit(limit: int) -> int:
    return limit if 0 < limit <= MOST_ROWS else min(max(limit, LEAST_CLAMP), MOST_ROWS)


def clamp_sample(limit: int, tool: bool = False) -> int:
    if tool:
        return limit if 0 < limit <= SAMPLE_TOOL_MOST else SAMPLE_DEFAULT
    return SAMPLE_DEFAULT if limit < 1 else min(limit, SAMPLE_MOST)


def plain(value, binary_hex: bool = False):
    """A value for JSON."""
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, bytes | bytearray):
        return value.hex() if binary_hex else f"<binary:{len(value)} bytes>"
    if hasattr(value, "asDict"):
        return {k: plain(v, binary_hex) for k, v in value.asDict().items()}
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, list):
        return [plain(v, binary_hex) for v in value]
    if isinstance(value, dict):
        return {k: plain(v, binary_hex) for k, v in value.items()}
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def failure(message: str, error_type: str, details: str | None = None) -> dict:
    return {"success": False, "error": message, "error_type": error_type, "details": details}


@dataclass
class TimeLimit:
    passed: bool = False


@contextmanager
def time_limit(spark: SparkSession, seconds: float | None, tag: str) -> Iterator[TimeLimit]:
    """End the jobs that this thread starts inside, once they have taken so long; they run in a pool of the tag's name.

    A query is several jobs, and some may start after the first have been ended,
    so they are ended again until the thread is out.
    """
    context, out, over = spark.sparkContext, TimeLimit(), threading.Event()

    def watch() -> None:
        if not over.wait(seconds):
            out.passed = True
            while not over.is_set():
                context.cancelJobsWithTag(tag)
                over.wait(0.2)

    watcher = threading.Thread(target=watch, daemon=True)
    pool = context.getLocalProperty("spark.scheduler.pool")
    context.addJobTag(tag)
    context.setLocalProperty("spark.scheduler.pool", tag)
    if seconds is not None:
        watcher.start()
    try:
        yield out
    finally:
        over.set()
        context.removeJobTag(tag)
        context.setLocalProperty("spark.scheduler.pool", pool)
        if seconds is not None:
            watcher.join()


class Session:
    def __init__(self, spark: SparkSession, output_dir: str = ".", base_uri: str = rdf.DEFAULT_BASE, r2rml_base: str = "http://example.com/"):
        self.spark, self.output_dir, self.r2rml_base = spark.newSession(), output_dir, r2rml_base
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")  # no path is a table
        self.base_uri = rdf.Namer(base_uri).base
        self.session_id = uuid.uuid4().hex
        self.catalog = Catalog(self.spark)
        self.triples: list[rdf.Triple] | None = None
        self.last: DataFrame | None = None
        self._connect, self._views = None, []
        self._rest: rest.Client | None = None

    # ---- connections

    def connect_parquet(self, folder: str, tables: list[str] | None = None) -> Session:
        self.catalog = load_parquet(self.spark, folder, tables) if tables else load_parquet(self.spark, folder)
        self._connect, self._views = lambda: self.connect_parquet(folder, tables), list(tables or STAR_TABLES)
        return self

    def connect_database(self, db_type: str, tables: list[str] = (), **given) -> dict:
        """Views over a remote database's tables, read by JDBC when they are used."""
        try:
            for name in tables:
                connections.read_jdbc(self.spark, db_type, name, **given).createOrReplaceTempView(name.split(".")[-1])
            options = connections.jdbc_options(db_type, **given)
        except ValueError as e:
            return failure(str(e), "parameter_error")
        except Exception as e:  # noqa: BLE001  drivers raise what they like
            return failure(str(e).splitlines()[0], "connection_error")
        self.catalog.reset()
        self._connect, self._views = lambda: self.connect_database(db_type, tables, **given), [t.split(".")[-1] for t in tables]
        return {"success": True, "db_type": db_type, "options": redact_secrets(options)}

    def connect_rest(self, tables: list[str] = (), queries: dict[str, str] | None = None, **given) -> dict:
        """Views over a remote engine's tables and statements, read by its REST interface, a page a task."""
        try:
            self._rest = rest.Client(given)
            rest.register(self.spark)
            wanted = {t.split(".")[-1]: {"dbtable": t} for t in tables} | {n: {"query": q} for n, q in (queries or {}).items()}
            for name, what in wanted.items():
                self.spark.read.format("rest_query").options(**{k: str(v) for k, v in given.items()}, **what).load().createOrReplaceTempView(name)
        except ValueError as e:
            return failure(str(e), "parameter_error")
        except (rest.RestError, PySparkException) as e:
            return failure(_first(e), "connection_error")
        self.catalog.reset()
        self._connect, self._views = lambda: self.connect_rest(tables, queries, **given), list(wanted)
        return {"success": True, "options": redact_secrets(given), "views": list(wanted)}

    def rest_containers(self, depth: int = 3) -> dict:
        """Containers of the remote engine, ``depth`` levels below the first."""
        if self._rest is None:
            return failure("connect first", "session_error")
        try:
            return {"success": True, "containers": self._rest.containers(depth)}
        except rest.RestError as e:
            return failure(str(e), "connection_error")

    def is_connected(self) -> bool:
        try:
            return self.spark.sql("SELECT 1").first()[0] == 1
        except Exception:  # noqa: BLE001
            return False

    def ensure_connected(self, retries: int = 2) -> bool:
        """Whether statements run and the connected tables are there; connects anew, at most ``retries`` times, if not."""
        for turn in range(retries + 1):
            if self.is_connected() and all(self.spark.catalog.tableExists(t) for t in self._views):
                return True
            if turn < retries and self._connect:
                self._connect()
        return False

    def status(self) -> dict:
        return {"connected": self.is_connected(), "session_id": self.session_id, "tables": len(self.catalog.tables()), "ontology_loaded": self.triples is not None}

    def diagnose_connection_issue(self, db_type: str, **given) -> dict:
        try:
            lacking = connections.missing_parameters(db_type, given)
        except ValueError as e:
            return failure(str(e), "parameter_error")
        return {"success": not lacking, "missing_parameters": lacking, "spark_alive": self.is_connected()}

    def close(self) -> None:
        for t in self.spark.catalog.listTables():
            if t.isTemporary:
                self.spark.catalog.dropTempView(t.name)
        self.catalog.reset()
        self.triples = self.last = None

    # ---- schema

    def list_schemas(self) -> list[str]:
        return self.catalog.schemas()

    def reset_cache(self, cache_type: str | None = None) -> dict:
        kind = cache_type or "all"
        if kind not in ("schema", "ontology", "all"):
            return failure(f"cache type {kind!r} is not one of schema, ontology, all", "parameter_error")
        if kind != "ontology":
            self.catalog.reset()
        if kind != "schema":
            self.triples = None
        return {"success": True, "cleared": kind}

    def analyze_schema(self, schema_name: str | None = None, save: bool = False, count: bool = False) -> dict:
        tables = self.catalog.analyse(schema_name, count=count)
        out = {"success": True, "schema": schema_name or "default", "table_count": len(tables), "tables": json.loads(self.catalog.to_json(schema_name))["tables"]}
        mapping = r2rml.document(tables, self.r2rml_base + f"{schema_name or 'default'}/", schema_name)
        out |= {"r2rml": mapping, "next_tool": "generate_ontology"}
        if save:
            out["schema_file"] = self._save("schema", schema_name or "default", "json", json.dumps(out["tables"], indent=2, default=str))
            out["r2rml_file"] = self._save("r2rml", schema_name or "default", "ttl", mapping)
        return out

    def get_analysis_context(self, schema_name: str | None = None) -> dict:
        return {"success": True} | self.catalog.context(schema_name)

    def sample_table_data(self, table_name: str, schema_name: str | None = None, limit: int = SAMPLE_DEFAULT) -> dict:
        if not is_identifier(table_name) or schema_name and not is_identifier(schema_name):
            audit.event("invalid_identifier", "high", table=table_name, schema=schema_name)
            return failure(f"{table_name!r} is not an identifier", "validation_error")
        try:
            df = self.spark.table(quote(f"{schema_name}.{table_name}" if schema_name else table_name)).limit(clamp_sample(limit, tool=True))
            return {"success": True, "table": table_name, "columns": df.columns, "data": [plain(r, binary_hex=True) for r in df.collect()]}
        except PySparkException as e:
            return failure(_first(e), "database_error")

    # ---- ontology

    def generate_ontology(self, schema_info: str | dict | None = None, schema_name: str | None = None, base_uri: str | None = None, save: bool = False) -> dict:
        try:
            catalog = Catalog.from_json(self.spark, schema_info) if schema_info else self.catalog
        except (ValueError, KeyError, TypeError) as e:
            return failure(f"cannot read the schema: {e}", "parameter_error")
        tables = catalog.analyse(schema_name)
        if not tables:
            return failure("there are no tables", "data_error")
        if base_uri:
            self.base_uri = rdf.Namer(base_uri).base
        self.triples = rdf.schema_triples(tables, self.base_uri)
        text = rdf.to_turtle(self.triples, self.base_uri)
        out = {"success": True, "ontology": text, "triples": len(self.triples), "quality_report": infer.quality_report(tables)}
        return out | ({"ontology_file": self._save("ontology", schema_name or "default", "ttl", text)} if save else {})

    def triples_df(self) -> DataFrame:
        return rdf.triples_df(self.spark, self.triples or [])

    def _need(self, ontology_file: str | None) -> dict | None:
        if ontology_file:
            loaded = self.load_ontology_from_file(ontology_file)
            return None if loaded["success"] else loaded
        return None if self.triples else failure("generate or load an ontology first", "session_error")

    def suggest_semantic_names(self, ontology_file: str | None = None) -> dict:
        return self._need(ontology_file) or {"success": True} | rdf.names_for_review(self.triples_df(), self.base_uri)

    def _change(self, changes: list[rdf.Triple], save: bool) -> dict:
        held = rdf.triples_df(self.spark, self.triples)
        known = {t[0] for t in self.triples}
        applied = [c for c in changes if c[0] in known]
        if applied:
            rows = rdf.upsert(held, rdf.triples_df(self.spark, applied)).collect()
            self.triples = [tuple(r) for r in rows]
        text = rdf.to_turtle(self.triples, self.base_uri)
        out = {"success": True, "applied": len(applied), "skipped": len(changes) - len(applied), "ontology": text}
        return out | ({"ontology_file": self._save("ontology", "semantic", "ttl", text)} if save else {})

    def apply_semantic_names(self, suggestions: str | dict, ontology_file: str | None = None, save_to_file: bool = True) -> dict:
        if wrong := self._need(ontology_file):
            return wrong
        try:
            changes = rdf.name_changes(json.loads(suggestions) if isinstance(suggestions, str) else suggestions, self.base_uri)
        except (ValueError, KeyError, TypeError) as e:
            return failure(f"cannot read the suggestions: {e}", "parameter_error")
        return self._change(changes, save_to_file)

    def apply_enrichment(self, suggestions: dict) -> dict:
        """Relabel and comment classes, properties and relationships of the loaded ontology."""
        return self._need(None) or self._change(rdf.enrichment_changes(suggestions, self.base_uri), False)

    def enrich_ontology(self, *args, **given) -> dict:
        """Plain generation; enrichment is applied by ``apply_enrichment``."""
        return self.generate_ontology(*args, **given)

    def apply_semantic_descriptions(self, descriptions: dict, save_to_file: bool = False) -> dict:
        return self._need(None) or self._change(rdf.description_changes(descriptions, self.base_uri), save_to_file)

    def enrichment_data(self, samples: int = 3) -> dict:
        """What a writer of descriptions needs: tables, columns, keys and a few rows."""
        out = []
        for t in self.catalog.analyse():
            rows = self.spark.table(quote(t.name)).limit(min(samples, 3)).collect() if self.spark.catalog.tableExists(t.name) else []
            out.append({"table": t.name, "comment": t.comment, "columns": [{"name": c.name, "type": c.data_type, "primary_key": c.is_primary_key} for c in t.columns], "foreign_keys": [vars(k) for k in t.foreign_keys], "sample_rows": [plain(r) for r in rows]})
        return {"success": True, "tables": out}

    def ontology_completeness(self) -> dict:
        return self._need(None) or {"success": True} | rdf.completeness(self.triples_df())

    def load_ontology_from_file(self, file_path: str) -> dict:
        try:
            with open(file_path, encoding="utf-8") as f:
                self.triples = rdf.from_turtle(f.read())
        except FileNotFoundError:
            return failure(f"no file {file_path}", "file_not_found")
        except rdf.OntologyError as e:
            return failure(str(e), "parse_error")
        base = next((s for s, p, o, *_ in self.triples if p == f"{rdf.RDF}type" and o == f"{rdf.OWL}Ontology"), None)
        self.base_uri = base or self.base_uri
        text = rdf.to_turtle(self.triples, self.base_uri)
        return {"success": True, "file": file_path, "preview": text[:2000], "counts": rdf.element_counts(self.triples_df())}

    def load_my_ontology(self, import_folder: str = "./import") -> dict:
        if not os.path.isdir(import_folder):
            return failure(f"no folder {import_folder}", "folder_not_found")
        found = glob.glob(os.path.join(glob.escape(import_folder), "*.ttl"))
        if not found:
            return failure(f"no .ttl file in {import_folder}", "no_files_found")
        return self.load_ontology_from_file(max(found, key=os.path.getmtime))

    # ---- queries

    def checker(self, compat: bool = False) -> Checker:
        """Over the loaded ontology, or else the catalog."""
        return Checker(self.spark, rdf.tables_of(self.triples, self.base_uri) if self.triples is not None else self.catalog.analyse() or None, compat)

    def validate_sql_syntax(self, sql_query: str) -> dict:
        verdict = guard.inspect(self.spark, sql_query)
        if verdict.risk_level in ("high", "critical") and verdict.error_type != "empty_query":
            audit.event("refused_statement", verdict.risk_level, issues=[redact_log(x) for x in verdict.issues], statement=redact_log(sql_query))
        #: The keys of a verdict.
        out = {"is_valid": verdict.is_safe, "error": verdict.error, "error_type": verdict.error_type, "database_error": None, "query_type": verdict.query_type, "affected_tables": [], "warnings": [], "suggestions": [], "security_issues": list(verdict.issues), "risk_level": verdict.risk_level}
        if not verdict.is_safe or verdict.query_type == "METADATA":
            return out | {"next_tool": "execute_sql_query" if verdict.is_safe else None}
        report = self.checker().validate(sql_query)
        out |= report.to_dict() | {"affected_tables": report.tables}
        for i in report.issues:
            out["warnings"].append(f"[OBQC] {i.message}")
            if i.suggestion:
                out["suggestions"].append(f"[OBQC] {i.suggestion}")
        if len(report.tables) > 5:
            out["warnings"].append(f"the query reads {len(report.tables)} tables")
        if not report.valid:
            out |= {"is_valid": False, "error_type": "obqc_error", "error": next(i.message for i in report.issues if i.severity == "error")}
        try:
            self.spark.sql(sql_query)  # analysed only; a query is lazy
        except PySparkException as e:
            out |= {"is_valid": False, "database_error": _first(e), "error": out["error"] or _first(e), "error_type": out["error_type"] or "syntax_error"}
            out["suggestions"] += [hint for code, hint in HINTS.items() if (e.getCondition() or "").startswith(code)]
        return out | {"next_tool": "execute_sql_query" if out["is_valid"] else "validate_sql_syntax"}

    def execute_sql_query(self, sql_query: str, limit: int = 1000, checklist_completed: bool | str = False, strict: bool = True, timeout: float | None = QUERY_SECONDS) -> dict:
        """Rows of one safe query, at most ``limit``; ``strict`` refuses what the semantic check finds wrong.

        After ``timeout`` seconds its jobs are ended.
        """
        #: The keys of a result.
        out = {"success": False, "data": [], "columns": [], "schema": [], "row_count": 0, "execution_time_ms": 0.0, "error": None, "error_type": None, "warnings": [], "query_plan": None, "limit_applied": False}
        if not 1 <= limit <= TOOL_ROWS:
            return out | {"error": f"limit must be 1 to {TOOL_ROWS}", "error_type": "parameter_error"}
        if str(checklist_completed).strip().lower() not in ("true", "1", "yes"):
            return out | {"error": "confirm the checklist first: checklist_completed=True", "error_type": "validation_error"}
        verdict = guard.inspect(self.spark, sql_query)
        if not verdict.is_safe:
            return out | {"error": verdict.error, "error_type": verdict.error_type}
        if verdict.query_type != "METADATA":
            report = self.checker().validate(sql_query)
            out["warnings"] += [f"[OBQC] {i.message}" for i in report.issues]
            if strict and not report.valid:
                return out | {"error": next(i.message for i in report.issues if i.severity == "error"), "error_type": "obqc_error"}
        begun, n, limit_ = time.monotonic(), clamp_limit(limit), TimeLimit()
        log.info("query: %s", redact_log(sql_query))
        try:
            self.last = verdict.frame or self.spark.sql(sql_query)
            written = _limit_of(verdict.plan)
            capped = written is None or written > n
            with time_limit(self.spark, timeout, f"plumbline-{self.session_id}") as limit_:
                rows = self.last.limit(n + 1).collect() if capped else self.last.collect()
        except (PySparkException, Py4JJavaError) as e:
            why = f"the query took more than {timeout:g} s" if limit_.passed else _first(e)
            return out | {"error": why, "error_type": "execution_error", "execution_time_ms": 1000 * (time.monotonic() - begun)}
        if len(rows) > n:
            rows = rows[:n]
            out["warnings"].append(f"only the first {n} rows are shown")
        fields = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in self.last.schema.fields]
        return out | {"success": True, "data": [{k: plain(v) for k, v in zip(self.last.columns, r, strict=True)} for r in rows], "columns": self.last.columns, "schema": fields, "row_count": len(rows), "execution_time_ms": 1000 * (time.monotonic() - begun), "limit_applied": capped}

    # ---- charts

    def generate_chart(self, data_source: list[dict] | str | DataFrame, chart_type: str, x_column: str, y_column: str | list[str] | None = None, color_column: str | None = None, title: str | None = None, chart_style: str = "grouped", width: int = 800, height: int = 600, sort_by: str | None = None, sort_order: str | None = None, output_format: str = "interactive") -> dict:
        try:
            df = data_source if isinstance(data_source, DataFrame) else connections.from_rows(self.spark, data_source)
        except (ValueError, SyntaxError) as e:
            return {"error": str(e)}
        return charts.figure(df, chart_type, x_column, y_column, color_column, title, chart_style, width, height, sort_by, sort_order)

    def get_server_info(self) -> dict:
        tools = ("connect_database", "list_schemas", "reset_cache", "analyze_schema", "generate_ontology", "suggest_semantic_names", "apply_semantic_names", "load_my_ontology", "sample_table_data", "validate_sql_syntax", "execute_sql_query", "generate_chart", "get_server_info")
        return {"name": "plumbline", "sources": sorted(connections.NEEDED), "tools": list(tools), "spark": self.spark.version}

    # ---- files

    def _save(self, prefix: str, suffix: str, extension: str, text: str) -> str:
        os.makedirs(self.output_dir, exist_ok=True)
        path = os.path.join(self.output_dir, f"{prefix}_{self.session_id[:8]}_{suffix}_{datetime.now():%Y%m%d_%H%M%S%f}.{extension}")
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return path


def _first(e: Exception) -> str:
    return (str(e).strip().splitlines() or [type(e).__name__])[0]


def _limit_of(plan: Node) -> int | None:
    """The number of a LIMIT at the root of a query."""
    while plan.kind == "UnresolvedWith":
        plan = plan.children[0]
    if plan.kind != "GlobalLimit":
        return None
    return int(e.text()) if (e := plan.get("limitExpr")).kind == "Literal" else None
