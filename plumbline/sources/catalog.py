"""Tables, columns and declared keys of a session."""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions.naming import quote
from ..plans.walker import name_parts
from .footers import row_counts

log = logging.getLogger(__name__)

SYSTEM_SCHEMAS = {"information_schema", "pg_catalog", "pg_toast", "sys", "system", "INFORMATION_SCHEMA"}

COLUMNS = "table_schema string, table_name string, column_name string, position int, data_type string, is_nullable boolean, is_primary_key boolean, is_foreign_key boolean, foreign_key_table string, foreign_key_column string, comment string"
KEYS = "table_name string, column_name string, referenced_table string, referenced_column string"


@dataclass
class ColumnMeta:
    name: str
    data_type: str
    is_nullable: bool = True
    is_primary_key: bool = False
    is_foreign_key: bool = False
    foreign_key_table: str | None = None
    foreign_key_column: str | None = None
    comment: str | None = None


@dataclass
class ForeignKey:
    column: str
    referenced_table: str
    referenced_column: str
    referenced_schema: str | None = None


@dataclass
class TableMeta:
    name: str
    schema: str = "default"
    columns: list[ColumnMeta] = field(default_factory=list)
    primary_keys: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    comment: str | None = None
    row_count: int | None = None
    sample_data: list[dict] | None = None

    def column(self, name: str) -> ColumnMeta | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


class Catalog:
    """Metadata of temp views and tables, with keys declared here.

    Parquet and Spark tables hold no keys, so ``declare_pk`` and ``declare_fk``
    do.  Reflected tables are kept for ``ttl`` seconds.
    """

    def __init__(self, spark: SparkSession, ttl: float = 300.0):
        self.spark, self.ttl = spark, ttl
        self._pk: dict[str, list[str]] = {}
        self._fk: dict[str, list[ForeignKey]] = {}
        self._fixed: dict[str, TableMeta] = {}
        self._kept: dict[tuple[str, str], tuple[float, TableMeta]] = {}
        self.paths: dict[str, str] = {}  # of tables that stand for Parquet files
        self._lock = threading.Lock()

    # -- declared keys

    def declare_pk(self, table: str, *columns: str) -> Catalog:
        self._pk[table.lower()] = list(columns)
        self.reset()
        return self

    def declare_fk(self, table: str, column: str, referenced_table: str, referenced_column: str) -> Catalog:
        """A column takes one foreign key; the first declared stays."""
        held = self._fk.setdefault(table.lower(), [])
        if all(k.column.lower() != column.lower() for k in held):
            held.append(ForeignKey(column, referenced_table, referenced_column))
        self.reset()
        return self

    def reset(self) -> None:
        with self._lock:
            self._kept.clear()

    # -- listings

    def schemas(self) -> list[str]:
        return sorted(x.name for x in self.spark.catalog.listDatabases() if x.name not in SYSTEM_SCHEMAS)

    def tables(self, schema: str | None = None) -> list[str]:
        """Base tables and this session's temp views, sorted; permanent views are left out."""
        if self._fixed:
            return sorted(t.name for t in self._fixed.values())
        held = self.spark.catalog.listTables(schema)
        return sorted({t.name for t in held if (t.isTemporary or t.tableType != "VIEW") and not t.name.startswith("information_schema_")})

    def containers(self, depth: int = 3) -> list[str]:
        """Catalogs and the namespaces in them as dotted paths, breadth first, ``depth`` levels; one that cannot be read counts as empty."""
        level, found = [()], []
        for _ in range(depth):
            below = []
            for path in level:
                try:
                    below += [(*path, name) for name in self._below(path)]
                except Exception as e:  # noqa: BLE001  one broken container must not hide the others
                    log.warning("cannot list %s: %s", ".".join(path), str(e).splitlines()[:1])
            level = [p for p in below if p[-1] not in SYSTEM_SCHEMAS]
            found += [".".join(p) for p in level]
        return sorted(found)

    def _below(self, path: tuple[str, ...]) -> list[str]:
        """Names right below a container; of no container, the catalogs."""
        if not path:
            return [c.name for c in self.spark.catalog.listCatalogs()]
        rows = self.spark.sql(f"SHOW NAMESPACES IN {quote('.'.join(path))}").collect()
        return [name_parts(self.spark, r[0])[-1] for r in rows]

    # -- analysis

    def table(self, name: str, schema: str | None = None, count: bool = False) -> TableMeta | None:
        """Metadata of a table, or None; its rows are counted only if asked."""
        key = name.lower()
        if key in self._fixed:
            return self._fixed[key]
        place = ((schema or "").lower(), key)
        with self._lock:
            kept = self._kept.get(place)
        if kept and time.monotonic() - kept[0] < self.ttl and not (count and kept[1].row_count is None):
            return kept[1]
        full = f"{schema}.{name}" if schema and not self._is_view(name) else name
        if not self.spark.catalog.tableExists(full):
            return None
        frame = self.spark.table(full)
        named = f"{schema}.{name}".lower()  # keys declared for one schema's table come before those of any
        pk = [c.lower() for c in self._pk.get(named, self._pk.get(key, []))]
        fk = {k.column.lower(): k for k in self._fk.get(named, self._fk.get(key, []))}
        columns = []
        for f in frame.schema.fields:
            link = fk.get(f.name.lower())
            columns.append(ColumnMeta(f.name, f.dataType.simpleString(), f.nullable and f.name.lower() not in pk, f.name.lower() in pk, link is not None, link and link.referenced_table, link and link.referenced_column, f.metadata.get("comment")))
        meta = TableMeta(name, schema or "default", columns, [c.name for c in columns if c.is_primary_key], list(fk.values()), row_count=frame.count() if count else None)
        with self._lock:
            self._kept[place] = (time.monotonic(), meta)
        return meta

    def _is_view(self, name: str) -> bool:
        return any(t.name == name and t.isTemporary for t in self.spark.catalog.listTables())

    def analyse(self, schema: str | None = None, workers: int = 5, count: bool = False) -> list[TableMeta]:
        """All tables; those that cannot be read are skipped.

        Rows of Parquet files are counted for all in one job, by their footers.
        """
        names = self.tables(schema)
        held = row_counts(self.spark, {n: self.paths[n] for n in names if n in self.paths}) if count else {}

        def one(name: str) -> TableMeta | None:
            try:
                meta = self.table(name, schema, count and name not in held)
                if meta and name in held:
                    meta.row_count = held[name]
                return meta
            except Exception:  # noqa: BLE001  one broken table must not hide the others
                return None

        with ThreadPoolExecutor(max(1, min(workers, len(names), 10))) as pool:
            return [t for t in pool.map(one, names) if t]

    def relationships(self, schema: str | None = None) -> dict[str, list[ForeignKey]]:
        return {t.name: t.foreign_keys for t in self.analyse(schema) if t.foreign_keys}

    def context(self, schema: str | None = None) -> dict:
        tables = self.analyse(schema)
        return {
            "tables": [asdict(t) for t in tables],
            "relationships": {t.name: [asdict(k) for k in t.foreign_keys] for t in tables if t.foreign_keys},
            "fan_trap_hints": [t.name for t in tables if len(t.foreign_keys) > 1],
        }

    # -- as DataFrames

    def columns_df(self, schema: str | None = None) -> DataFrame:
        rows = [(t.schema, t.name, c.name, n, c.data_type, c.is_nullable, c.is_primary_key, c.is_foreign_key, c.foreign_key_table, c.foreign_key_column, c.comment) for t in self.analyse(schema) for n, c in enumerate(t.columns, 1)]
        return self.spark.createDataFrame(rows, COLUMNS)

    def keys_df(self, schema: str | None = None) -> DataFrame:
        rows = [(t.name, k.column, k.referenced_table, k.referenced_column) for t in self.analyse(schema) for k in t.foreign_keys]
        return self.spark.createDataFrame(rows, KEYS)

    def register_information_schema(self, schema: str | None = None) -> None:
        """Views that stand for information_schema, which Spark lacks."""
        columns = self.columns_df(schema)
        columns.createOrReplaceTempView("information_schema_columns")
        columns.select("table_schema", "table_name").distinct().createOrReplaceTempView("information_schema_tables")

    # -- JSON

    def to_json(self, schema: str | None = None) -> str:
        return json.dumps({"schema": schema or "default", "tables": [asdict(t) for t in self.analyse(schema)]}, indent=2, default=str)

    @classmethod
    def from_json(cls, spark: SparkSession, text: str | dict) -> Catalog:
        """A catalog of described tables, which need not exist."""
        data, out = json.loads(text) if isinstance(text, str) else text, cls(spark)
        for t in data["tables"]:
            columns = [ColumnMeta(**{k: v for k, v in c.items() if k in ColumnMeta.__dataclass_fields__}) for c in t.get("columns", [])]
            keys = [ForeignKey(k["column"], k["referenced_table"], k["referenced_column"], k.get("referenced_schema")) for k in t.get("foreign_keys", [])]
            out.add(TableMeta(t["name"], t.get("schema") or "default", columns, t.get("primary_keys") or [c.name for c in columns if c.is_primary_key], keys, t.get("comment"), t.get("row_count")))
        return out

    def add(self, *tables: TableMeta) -> Catalog:
        for t in tables:
            for key in t.foreign_keys:
                if c := t.column(key.column):
                    c.is_foreign_key, c.foreign_key_table, c.foreign_key_column = True, key.referenced_table, key.referenced_column
            for name in t.primary_keys:
                if c := t.column(name):
                    c.is_primary_key = True
            self._fixed[t.name.lower()] = t
        return self


#: Keys of the star schema of the test data.
STAR_KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",),
    "documents": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "labels": ("doc_id",), "conversations": ("conv_id", "turn"),
}
STAR_LINKS = (
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
)
STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_schemas: dict[tuple, StructType] = {}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; its schema is inferred once for as long as the file or folder is not changed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    except Py4JJavaError:  # no such place; Spark says so as it always does
        return spark.read.parquet(path)
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def load_parquet(spark: SparkSession, folder: str, tables: Iterable[str] = STAR_TABLES) -> Catalog:
    """Views over a folder of parquet tables, with the star schema's keys declared."""
    tables = list(tables)
    for name in tables:
        read_parquet(spark, f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    out = Catalog(spark)
    out.paths = {name: f"{folder}/{name}.parquet" for name in tables}
    for name in tables:
        if name in STAR_KEYS:
            out.declare_pk(name, *STAR_KEYS[name])
    for table, column, other, key in STAR_LINKS:
        if table in tables and other in tables:
            out.declare_fk(table, column, other, key)
    return out
