"""Options of remote sources, for Spark's JDBC reader, and rows from memory."""

from __future__ import annotations

import ast
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: What each kind of source needs, its JDBC URL and its driver.
NEEDED = {
    "postgresql": ("host", "port", "database", "username", "password"),
    "snowflake": ("account", "username", "password", "warehouse", "database"),
    "clickhouse": ("host",),
    "dremio": ("host", "port"),
}
_URL = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "snowflake": "jdbc:snowflake://{account}.snowflakecomputing.com/?warehouse={warehouse}&db={database}&schema={schema}&role={role}",
    "clickhouse": "jdbc:clickhouse:{protocol}://{host}:{port}/{database}",
    "dremio": "jdbc:postgresql://{host}:{port}/dremio",
}
_DRIVER = {"postgresql": "org.postgresql.Driver", "snowflake": "net.snowflake.client.jdbc.SnowflakeDriver", "clickhouse": "com.clickhouse.jdbc.ClickHouseDriver", "dremio": "org.postgresql.Driver"}
_DEFAULTS = {"schema": "PUBLIC", "role": "PUBLIC", "port": 8123, "protocol": "http", "database": "default"}


def missing_parameters(kind: str, given: Mapping[str, object]) -> list[str]:
    if kind not in NEEDED:
        raise ValueError(f"unknown source {kind!r}; known: {', '.join(NEEDED)}")
    if kind == "dremio" and not given.get("pat") and not (given.get("username") and given.get("password")):
        return [x for x in NEEDED[kind] if not given.get(x)] + ["pat, or username and password"]
    return [x for x in NEEDED[kind] if not given.get(x)]


def jdbc_options(kind: str, **given) -> dict[str, str]:
    """Reader options; add partitionColumn, bounds and numPartitions to read in parallel."""
    if lacking := missing_parameters(kind, given):
        raise ValueError(f"{kind}: missing {', '.join(lacking)}")
    values = _DEFAULTS | given
    if kind == "clickhouse" and values.get("secure"):
        values["protocol"] = "https"
    out = {"url": _URL[kind].format(**values), "driver": _DRIVER[kind], "fetchsize": "10000"}
    user = given.get("username") or ("$token" if given.get("pat") else None)
    return out | {k: str(v) for k, v in (("user", user), ("password", given.get("pat") or given.get("password"))) if v}


def read_jdbc(spark: SparkSession, kind: str, table: str, parallel: Mapping[str, object] | None = None, **given) -> DataFrame:
    """``parallel``: partitionColumn, lowerBound, upperBound, numPartitions."""
    reader = spark.read.format("jdbc").options(**jdbc_options(kind, **given), dbtable=table)
    return reader.options(**{k: str(v) for k, v in (parallel or {}).items()}).load()


def from_rows(spark: SparkSession, rows: list[dict] | str) -> DataFrame:
    """Rows given as dicts, or as the text of a JSON or Python list of dicts."""
    if isinstance(rows, str):
        try:
            rows = json.loads(rows)
        except ValueError:
            rows = ast.literal_eval(rows)
    if not isinstance(rows, list) or not rows or not all(isinstance(r, dict) for r in rows):
        raise ValueError("rows must be a list of dicts that is not empty")
    names = list(dict.fromkeys(k for r in rows for k in r))
    mixed = {n for n in names if {type(r.get(n)) for r in rows} >= {int, float}}
    return spark.createDataFrame([{n: float(r[n]) if n in mixed and r.get(n) is not None else r.get(n) for n in names} for r in rows]).select(*names)
