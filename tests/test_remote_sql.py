"""The remote SQL source against a small service that counts what it is asked."""

import datetime as dt
import json
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from spanforge.sources import conditions, remote_sql

NAMES = ["Aramark Services", "ARAMARK", "Bon Appetit", "Legends Patio Grill", "Legends Hospitality", None, "Levy 100%", "levy_x", "O'Neil's"]
ROWS = [(k, NAMES[k % 9], ["Sodexo Inc", None, "x"][k % 3], k * 10.5 if k % 4 else None, f"2024-0{1 + k % 9}-03") for k in range(1, 251)]
SCHEMA = "case_id long, legal_name string, amount double, since date"


@pytest.fixture
def service():
    asked, sent, failing = [], [], []
    con = sqlite3.connect(":memory:", check_same_thread=False)
    con.row_factory = sqlite3.Row
    con.execute("CREATE TABLE cases (case_id INTEGER, legal_name TEXT, trade_nm TEXT, amount REAL, since TEXT)")
    con.executemany("INSERT INTO cases VALUES (?, ?, ?, ?, ?)", ROWS)
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            sql = parse_qs(urlparse(self.path).query)["sql"][0]
            with lock:
                if failing:
                    self.send_error(failing.pop())
                    return
                asked.append(sql)
                try:
                    rows = [dict(r) for r in con.execute(sql).fetchmany(40)]  # the service never gives more
                    body = json.dumps(rows).encode()
                except sqlite3.Error as error:
                    body = json.dumps({"error": str(error)}).encode()
                    rows = []
                sent.append(len(rows))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/db", asked, sent, failing
    server.shutdown()


def test_ranges_and_pages(spark, service):
    url, asked, sent, _ = service
    df = remote_sql.scan(spark, url, "cases", SCHEMA, "case_id", partitions=4, page=40)
    assert df.rdd.getNumPartitions() == 4
    asked.clear(), sent.clear()
    got = sorted(map(tuple, df.collect()))
    assert got == [(k, n, a, dt.date.fromisoformat(d)) for k, n, _, a, d in ROWS]
    # one question for the bounds at most; in each range two pages, and no column that was not declared
    assert sum(sent) <= 251 and len([q for q in asked if "LIMIT" in q]) == 8 and not any("trade_nm" in q for q in asked)


def test_exact_conditions_above_loose_ones(spark, service):
    url, asked, sent, _ = service
    where = [("legal_name", "starts", "Legends"), ("amount", ">", 500), ("case_id", "<=", 200)]
    df = remote_sql.scan(spark, url, "cases", SCHEMA, "case_id", where, page=40)
    got = {r.case_id for r in df.collect()}
    assert got == {k for k, n, _, a, _ in ROWS if n and n.startswith("Legends") and a and a > 500 and k <= 200}
    assert sum(sent) == len(got) and all("LIKE 'LEGENDS%'" in q and '"amount" > 500' in q for q in asked)
    asked.clear(), sent.clear()
    contains = remote_sql.scan(spark, url, "cases", SCHEMA, "case_id", [("legal_name", "contains", "aramark")], page=40)
    assert contains.count() == 0 and sum(sent) == sum(1 for r in ROWS if r[1] and "ARAMARK" in r[1].upper())
    for text, n in (("100%", 28), ("y_x", 27), ("O'N", 27), ("é", 0)):
        assert remote_sql.scan(spark, url, "cases", SCHEMA, "case_id", [("legal_name", "contains", text)], page=40).count() == sum(1 for r in ROWS if r[1] and text in r[1]), text
    both = remote_sql.scan(spark, url, "cases", SCHEMA, "case_id", [("since", "=", dt.date(2024, 2, 3)), ("legal_name", "in", ["ARAMARK", "O'Neil's"]), ("trade_nm", "is not null", None)], page=40)
    assert {r.case_id for r in both.collect()} == {k for k, n, t, _, d in ROWS if d == "2024-02-03" and n in ("ARAMARK", "O'Neil's") and t}
    assert remote_sql.scan(spark, url, "cases", SCHEMA, "case_id", [("amount", "is null", None)], page=40).count() == 62


def test_candidates_by_patterns_over_columns(spark, service):
    url, asked, sent, _ = service
    df = remote_sql.scan(spark, url, "SELECT * FROM cases WHERE case_id > 10", "case_id long, legal_name string, trade_nm string", "case_id", like=(["legal_name", "trade_nm"], ["aramark", "sodex"]), page=40, partitions=3)
    want = {k for k, n, t, *_ in ROWS if k > 10 and any(p in f"{n or ''} {t or ''}".upper() for p in ("ARAMARK", "SODEX"))}
    assert {r.case_id for r in df.collect()} == want
    assert all("LIKE '%ARAMARK%' OR" in q for q in asked)


def test_empty_answers_and_errors(spark, service):
    url, asked, sent, failing = service
    assert remote_sql.scan(spark, url, "cases", SCHEMA, "case_id", [("case_id", "<", 0)], partitions=4).count() == 0
    assert remote_sql.scan(spark, url, "cases", SCHEMA, "case_id", [("legal_name", "in", [])]).count() == 0
    failing.extend([503, 429])
    assert remote_sql.scan(spark, url, "cases", SCHEMA, "case_id", page=40).count() == 250 and not failing
    failing.append(400)
    with pytest.raises(Exception, match="400"):
        remote_sql.scan(spark, url, "cases", SCHEMA, "case_id", page=40).count()
    with pytest.raises(Exception, match="no such table"):
        remote_sql.scan(spark, url, "none", SCHEMA, "case_id").count()


def test_conditions_say_the_same_everywhere(spark):
    rows = [(1, "Ab%c"), (2, "ab_c"), (3, None), (4, ""), (5, "Äb"), (6, "x'y\\z")]
    df = spark.createDataFrame(rows, "k int, t string")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (k INTEGER, t TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    for condition in [("t", "=", "x'y\\z"), ("t", "contains", "b%"), ("t", "contains", "_"), ("t", "contains", "\\"), ("t", "starts", "Ä"), ("t", "ends", "c"), ("t", "in", ["", "Äb"]), ("t", "is null", None), ("k", ">=", 3), ("k", "in", [1, 9]), ("t", "<", "b")]:
        exact = {r.k for r in df.filter(conditions.exactly([condition])).collect()}
        assert exact == {k for k, t in rows if conditions.holds(condition, {"k": k, "t": t}[condition[0]])}, condition
        assert exact <= {k for (k,) in con.execute(f"SELECT k FROM t WHERE {conditions.as_sql(condition)}")}, condition
