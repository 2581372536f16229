"""A query engine behind a REST interface, read as a Spark data source.

A statement is submitted once, its job polled until it ends, and its result read
page by page: each page is a partition, so pages are fetched in parallel and a
lost executor costs its pages alone.  Containers are listed breadth first.

    register(spark)
    spark.read.format("rest_query").options(uri=..., pat=..., query="SELECT ...").load()

Options: ``uri`` (or ``host``, ``port``, ``ssl``), ``pat`` (or ``username`` and
``password``, or ``token``), ``query`` (or ``dbtable``), ``pagesize``, ``limit``,
``timeout`` and ``poll`` in seconds.
"""

from __future__ import annotations

import base64
import datetime
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The interface's paths, states of a job and kinds of containers, and the limits in seconds.
LOGIN, SUBMIT, JOB, RESULTS, CATALOG, BY_PATH = "/apiv2/login", "/api/v3/sql", "/api/v3/job/{}", "/api/v3/job/{}/results", "/api/v3/catalog", "/api/v3/catalog/by-path/{}"
DONE, ENDED = "COMPLETED", ("FAILED", "CANCELED")
CONTAINERS = ("CONTAINER", "SPACE", "SOURCE", "FOLDER", "HOME")
HIDDEN_CONTAINERS = ("sys", "INFORMATION_SCHEMA")
PORT, TIMEOUT, POLL, PAGE = 9047, 60.0, 0.5, 500

_SIMPLE = {
    "BOOLEAN": T.BooleanType(), "INTEGER": T.IntegerType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType(),
    "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(), "VARBINARY": T.BinaryType(),
}


class RestError(RuntimeError):
    """A request that was refused, or a job that did not end well."""


class AuthError(RestError):
    pass


def spark_type(kind: Mapping) -> T.DataType:
    """The Spark type of a result column; nested and unknown ones come as JSON text."""
    if kind["name"] == "DECIMAL":
        return T.DecimalType(int(kind.get("precision", 38)), int(kind.get("scale", 0)))
    return _SIMPLE.get(kind["name"], T.StringType())


def cell(value, kind: T.DataType):
    """A JSON value as one of a type."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value)).quantize(Decimal(1).scaleb(-kind.scale))
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(str(value)[:10])
    if isinstance(kind, T.TimestampType):
        made = datetime.datetime.fromisoformat(str(value).replace("Z", "+00:00"))
        return made if made.tzinfo else made.replace(tzinfo=datetime.UTC)
    if isinstance(kind, T.BinaryType):
        return base64.b64decode(value)
    return float(value) if isinstance(kind, T.FloatType | T.DoubleType) else value


class Client:
    """Requests of one user; holds no connection, so it travels to tasks as it is."""

    def __init__(self, options: Mapping[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        if not given.get("uri") and not given.get("host"):
            raise ValueError("give uri, or host")
        scheme = "https" if str(given.get("ssl", "true")).lower() in ("true", "1", "yes") else "http"
        self.uri = (given.get("uri") or f"{scheme}://{given['host']}:{given.get('port') or PORT}").rstrip("/")
        self.timeout, self.poll = float(given.get("timeout", TIMEOUT)), float(given.get("poll", POLL))
        if given.get("pat"):
            self.authorization = f"Bearer {given['pat']}"
        elif given.get("token"):
            self.authorization = f"_dremio{given['token']}"
        elif given.get("username") and given.get("password"):
            self.authorization = None
            found = self.ask("POST", LOGIN, {"userName": given["username"], "password": given["password"]}).get("token")
            if not found:
                raise AuthError("the login gave no token")
            self.authorization = f"_dremio{found}"
        else:
            raise ValueError("give pat, or token, or username and password")

    def ask(self, method: str, path: str, body: dict | None = None, **query) -> dict:
        url = self.uri + path + (f"?{urllib.parse.urlencode(query)}" if query else "")
        head = {"Content-Type": "application/json"} | ({"Authorization": self.authorization} if self.authorization else {})
        request = urllib.request.Request(url, json.dumps(body).encode() if body is not None else None, head, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read() or b"{}")
        except urllib.error.HTTPError as e:
            text = e.read().decode(errors="replace")
            try:
                text = json.loads(text).get("errorMessage") or text
            except (ValueError, AttributeError):
                pass
            raise (AuthError if e.code in (401, 403) else RestError)(f"{method} {path}: {e.code} {text[:300]}") from None
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise RestError(f"{method} {path}: {e}") from None

    def submit(self, sql: str) -> str:
        made = self.ask("POST", SUBMIT, {"sql": sql}).get("id")
        if not made:
            raise RestError("the statement was taken without a job id")
        return made

    def wait(self, job: str) -> int:
        """The number of rows of a job, once it has ended; states that are not known keep it waiting."""
        until = time.monotonic() + self.timeout
        while True:
            status = self.ask("GET", JOB.format(job))
            if (state := status.get("jobState")) == DONE:
                return int(status.get("rowCount") or 0)
            if state in ENDED:
                raise RestError(f"job {job} {state.lower()}: {status.get('errorMessage') or 'no reason given'}")
            if time.monotonic() > until:
                self.cancel(job)
                raise RestError(f"job {job} still {state} after {self.timeout:g} s")
            time.sleep(self.poll)

    def cancel(self, job: str) -> None:
        try:
            self.ask("POST", JOB.format(job) + "/cancel", {})
        except RestError:
            pass  # it may have ended meanwhile

    def page(self, job: str, offset: int, limit: int) -> dict:
        return self.ask("GET", RESULTS.format(job), offset=offset, limit=limit)

    def containers(self, depth: int = 3) -> list[str]:
        """Dotted paths of containers, level by level, the first level and ``depth`` below it; a container that cannot be read counts as empty."""
        level = []
        for item in self.ask("GET", CATALOG).get("data", []):
            path = item.get("path") or []
            level.append(([path] if isinstance(path, str) else list(path), item.get("type", "")))
        found: set[str] = set()
        for _ in range(depth + 1):
            below = []
            for path, kind in level:
                if not path or path[0] in HIDDEN_CONTAINERS:
                    continue
                found.add(".".join(path))
                if kind not in CONTAINERS:
                    continue
                try:
                    children = self.ask("GET", BY_PATH.format("/".join(urllib.parse.quote(x, safe="") for x in path))).get("children", [])
                except RestError:
                    continue
                below += [(list(c["path"]), c.get("containerType") or c.get("type", "")) for c in children if c.get("path") and c.get("type") in CONTAINERS]
            level = below
        return sorted(found)


@dataclass
class Page(InputPartition):
    job: str
    offset: int
    limit: int


class RestQuery(DataSource):
    """The result of one statement."""

    @classmethod
    def name(cls) -> str:
        return "rest_query"

    def __init__(self, options: Mapping[str, str]):
        super().__init__(options)
        self.given = {k.lower(): v for k, v in options.items()}
        self.job: str | None = None
        self.rows = 0

    def run(self) -> Client:
        """Run the statement, once for schema and reader together."""
        client = Client(self.given)
        if self.job is None:
            sql = self.given.get("query") or (f"SELECT * FROM {self.given['dbtable']}" if self.given.get("dbtable") else None)
            if not sql:
                raise ValueError("give query, or dbtable")
            self.job = client.submit(sql)
            self.rows = client.wait(self.job)
            if self.given.get("limit") is not None:
                self.rows = min(self.rows, int(self.given["limit"]))
        return client

    def schema(self) -> T.StructType:
        client = self.run()
        columns = client.page(self.job, 0, 1).get("schema", [])
        return T.StructType([T.StructField(c["name"], spark_type(c["type"])) for c in columns])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self, schema)


class Reader(DataSourceReader):
    def __init__(self, source: RestQuery, schema: T.StructType):
        self.client, self.wanted = source.run(), schema
        self.job, self.rows, self.size = source.job, source.rows, max(1, int(source.given.get("pagesize", PAGE)))

    def partitions(self) -> list[InputPartition]:
        return [Page(self.job, at, min(self.size, self.rows - at)) for at in range(0, self.rows, self.size)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # no page, no row
            return
        rows = self.client.page(partition.job, partition.offset, partition.limit).get("rows", [])
        if len(rows) != partition.limit:
            raise RestError(f"job {partition.job}: {len(rows)} rows of {partition.limit} from {partition.offset}")
        for row in rows:
            yield tuple(cell(row.get(f.name), f.dataType) for f in self.wanted.fields)


def register(spark: SparkSession) -> None:
    """Make the source known to a session; once more changes nothing.

    Spark asks the active session whether a name is taken, so this one is made active.
    """
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)
    spark.dataSource.register(RestQuery)
