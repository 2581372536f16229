"""The REST source against a server of this test, and only that."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import PySparkException

from plumbline.session import Session
from plumbline.sources import rest

TYPES = [("k", "BIGINT"), ("name", "VARCHAR"), ("price", "DECIMAL"), ("day", "DATE"), ("at", "TIMESTAMP"), ("ok", "BOOLEAN"), ("tags", "LIST"), ("r", "DOUBLE")]
ROWS = [{"k": n, "name": None if n % 7 == 0 else f"n{n}", "price": f"{n}.25", "day": "2024-02-29", "at": "2024-02-29 10:00:00.5", "ok": n % 2 == 0, "tags": [n, "x"], "r": n} for n in range(1050)]
TREE = {
    "": [("sales", "CONTAINER"), ("sys", "CONTAINER"), ("home", "CONTAINER")],
    "sales": [("eu", "CONTAINER"), ("orders", "DATASET")],
    "sales/eu": [("north", "CONTAINER")],
    "sales/eu/north": [("oslo", "CONTAINER")],
    "sales/eu/north/oslo": [("deep", "CONTAINER")],
}


class Server(ThreadingHTTPServer):
    daemon_threads = True


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def answer(self, body, code=200):
        raw = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def do_POST(self):
        body, state = json.loads(self.rfile.read(int(self.headers["Content-Length"]))), self.server.state
        if self.path == rest.LOGIN:
            return self.answer({"token": "t1"} if body == {"userName": "u", "password": "p"} else {"errorMessage": "no such user"}, 200 if body["password"] == "p" else 401)
        if self.headers["Authorization"] not in ("Bearer pat1", "_dremiot1"):
            return self.answer({"errorMessage": "who are you"}, 401)
        if self.path.endswith("/cancel"):
            state["cancelled"].append(self.path.split("/")[4])
            return self.answer({})
        state["submitted"].append(body["sql"])
        self.answer({"id": {"FAIL": "bad", "HANG": "hang", "NONE": "none"}.get(body["sql"].split()[0], "j1")})

    def do_GET(self):
        state = self.server.state
        path, _, query = self.path.partition("?")
        if path == rest.CATALOG:
            return self.answer({"data": [{"path": [n], "type": k} for n, k in TREE[""]]})
        if path.startswith(rest.BY_PATH.format("")):
            at = path.removeprefix(rest.BY_PATH.format(""))
            if at == "home":
                return self.answer({"errorMessage": "broken"}, 500)
            return self.answer({"children": [{"path": [*at.split("/"), n], "type": k} for n, k in TREE.get(at, [])]})
        job = path.split("/")[4]
        if path.endswith("/results"):
            given = dict(x.split("=") for x in query.split("&"))
            offset, limit = int(given["offset"]), int(given["limit"])
            with state["lock"]:
                state["open"] += 1
                state["most"] = max(state["most"], state["open"])
                state["pages"].append((offset, limit))
            time.sleep(0.2)
            with state["lock"]:
                state["open"] -= 1
            kinds = [{"name": n, "type": {"name": k} | ({"precision": 10, "scale": 2} if k == "DECIMAL" else {})} for n, k in TYPES]
            return self.answer({"rowCount": len(ROWS), "schema": kinds, "rows": [] if job == "none" else ROWS[offset : offset + limit]})
        state["polls"] += 1
        told = {"bad": "FAILED", "hang": "SOMETHING_NEW"}.get(job) or ("RUNNING" if state["polls"] < 3 else "COMPLETED")
        self.answer({"jobState": told, "rowCount": 0 if job == "none" else len(ROWS), "errorMessage": "no such column" if job == "bad" else None})


@pytest.fixture
def server():
    made = Server(("127.0.0.1", 0), Handler)
    made.state = {"submitted": [], "cancelled": [], "pages": [], "polls": 0, "open": 0, "most": 0, "lock": threading.Lock()}
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made
    made.shutdown()


def options(server, **more):
    return {"uri": f"http://127.0.0.1:{server.server_port}", "pat": "pat1", "poll": "0.05", "timeout": "5"} | more


def test_pages_are_partitions(spark, server):
    rest.register(spark)
    made = spark.read.format("rest_query").options(**options(server, query="SELECT * FROM t", pagesize="100")).load()
    assert made.dtypes == [("k", "bigint"), ("name", "string"), ("price", "decimal(10,2)"), ("day", "date"), ("at", "timestamp"), ("ok", "boolean"), ("tags", "string"), ("r", "double")]
    rows = sorted(made.collect())
    assert [r.k for r in rows] == list(range(1050)) and rows[7].name is None and str(rows[8].price) == "8.25" and rows[8].tags == '[8, "x"]' and rows[3].r == 3.0
    assert server.state["submitted"] == ["SELECT * FROM t"]  # once, for schema and rows together
    assert sorted(p for p in server.state["pages"] if p[1] != 1) == [(n, min(100, 1050 - n)) for n in range(0, 1050, 100)]
    assert server.state["most"] >= 2  # pages are read side by side
    assert made.rdd.getNumPartitions() == 11


def test_limits_tables_and_empty_results(spark, server):
    rest.register(spark)
    read = lambda **more: spark.read.format("rest_query").options(**options(server, **more)).load()
    assert read(dbtable="a.b", limit="7").count() == 7 and server.state["submitted"] == ["SELECT * FROM a.b"]
    empty = read(query="NONE")
    assert empty.count() == 0 and "k" in empty.columns
    assert read(query="SELECT 1").where("ok and k > 1000").agg({"k": "sum"}).first()[0] == sum(range(1002, 1050, 2))


def test_what_goes_wrong_is_told(spark, server):
    rest.register(spark)
    for sql, more, why in (("FAIL", {}, "no such column"), ("HANG", {"timeout": "0.3"}, "still SOMETHING_NEW"), ("SELECT 1", {"pat": "other"}, "who are you"), ("SELECT 1", {"uri": "http://127.0.0.1:9"}, "refused"), (None, {}, "give query")):
        given = options(server, **more) | ({"query": sql} if sql else {})
        with pytest.raises(PySparkException, match=why):
            spark.read.format("rest_query").options(**given).load()
    assert server.state["cancelled"] == ["hang"]


def test_login_and_containers(server):
    client = rest.Client({"uri": f"http://127.0.0.1:{server.server_port}", "username": "u", "password": "p"})
    assert client.authorization == "_dremiot1"
    assert client.containers() == ["home", "sales", "sales.eu", "sales.eu.north", "sales.eu.north.oslo"]
    assert client.containers(depth=1) == ["home", "sales", "sales.eu"]
    with pytest.raises(rest.AuthError):
        rest.Client({"uri": f"http://127.0.0.1:{server.server_port}", "username": "u", "password": "q"})
    with pytest.raises(ValueError):
        rest.Client({"host": "h"})


def test_session_over_rest(spark, server):
    session = Session(spark)
    made = session.connect_rest(["t"], {"sums": "SELECT k FROM t"}, **options(server))
    assert made["success"], made
    assert "pat1" not in json.dumps(made)
    made = session.execute_sql_query("SELECT COUNT(*) AS n FROM t WHERE ok", checklist_completed=True)
    assert made["data"] == [{"n": 525}]
    assert session.rest_containers()["containers"][:2] == ["home", "sales"]
    assert session.connect_rest(["t"], **options(server, pat="other"))["error_type"] == "connection_error"
    assert session.connect_rest(["t"], pat="x")["error_type"] == "parameter_error"
    session.close()
