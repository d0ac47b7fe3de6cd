"""The REST source against a local server that fails at times, and the sink of pages with tasks that fail."""

from __future__ import annotations

import base64
import json
import os
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from careerloom.sources import files, pages, rest

REPOS = {"ann": [{"name": f"r{k}", "description": f"about {k}", "stargazers_count": k, "forks_count": 1, "fork": k == 3, "updated_at": f"2024-01-{k + 1:02}", "language": "C"} for k in range(5)], "bo b": [{"name": "x/y", "description": None}]}


@pytest.fixture
def server():
    seen: dict[str, int] = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] = seen.get(self.path, 0) + 1
            m = re.fullmatch(r"/users/([^/]+)/repos\?per_page=(\d+)&page=(\d+)", self.path)
            if m and seen[self.path] == 1 and m[3] == "2":  # the second page is refused once
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            user = m and m[1].replace("%20", " ")
            body = REPOS[user][int(m[2]) * (int(m[3]) - 1) : int(m[2]) * int(m[3])] if m and user in REPOS else None
            if self.path == "/users/down/repos?per_page=2&page=1":
                self.send_response(503)
                self.end_headers()
                return
            if self.path.endswith("/languages"):
                body = {"Python": 9, "C": 1}
            if self.path.endswith("/r1/readme"):
                body = {"content": base64.b64encode("Hellö".encode()).decode()}
            self.send_response(200 if body is not None else 404)
            self.end_headers()
            if body is not None:
                self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", seen
    s.shutdown()


def test_repositories_come_page_by_page(spark, server):
    api, seen = server
    df = rest.read_repositories(spark, api + "/", ["ann", "bo b", "nobody", "ann"], page=2, wait=0.01, tasks=3)
    got = {(r.user, r.name): r for r in df.collect()}
    assert set(got) == {("ann", f"r{k}") for k in range(5)} | {("bo b", "x/y")}
    assert got["ann", "r1"].readme == "Hellö" and got["ann", "r2"].readme is None and got["ann", "r2"].languages == ["Python", "C"] and got["bo b", "x/y"].stars is None
    assert seen["/users/ann/repos?per_page=2&page=2"] >= 2 and "/users/ann/repos?per_page=2&page=4" not in seen
    recent = files.recent_repositories(df.where("user = 'ann'"), 3).first()
    assert [r.name for r in recent.repos] == ["r4", "r2"]  # the fork among the newest three is left out
    short = rest.read_repositories(spark, api, ["ann"], page=100, details=False).collect()
    assert {tuple(r.languages) for r in short} == {("C",)}
    assert rest.read_repositories(spark, api, []).count() == 0


def test_a_host_that_stays_down_is_an_error(server):
    api, seen = server
    reader = rest.RepositoryReader({"api": api, "users": '["down"]', "page": "2", "tries": "3", "wait": "0"})
    (part,) = reader.partitions()
    with pytest.raises(Exception, match="503"):
        list(reader.read(part))
    assert seen["/users/down/repos?per_page=2&page=1"] == 3


def test_pages_are_there_together_or_not_at_all(spark, tmp_path):
    at = str(tmp_path / "out")
    df = spark.range(20).repartition(4).select(F.concat(F.lit("p"), "id").alias("n"), F.when(F.col("id") != 3, F.concat(F.lit("é"), "id")).alias("v"))
    pages.write_pages(df, at, F.col("n"), F.col("v"))
    assert sorted(os.listdir(at)) == sorted([f"p{k}.html" for k in range(20)] + ["_SUCCESS"])
    assert open(f"{at}/p7.html", encoding="utf-8").read() == "é7" and open(f"{at}/p3.html").read() == ""
    bad = df.select(F.when(F.col("n") == "p11", F.lit("a/b")).otherwise(F.concat(F.lit("new"), "n")).alias("n"), "v")
    for broken in (bad, df.select(F.lit("one").alias("n"), "v"), df.select("n", F.when(F.col("n") == "p9", F.raise_error(F.lit("lost"))).otherwise(F.col("v")).alias("v"))):
        with pytest.raises(Exception):  # noqa: B017
            pages.write_pages(broken, at, F.col("n"), F.col("v"))
        # what was there before is there as it was, and nothing else
        assert sorted(os.listdir(at)) == sorted([f"p{k}.html" for k in range(20)] + ["_SUCCESS"])
    pages.write_pages(df.where("n = 'p1'"), f"file://{at}", F.col("n"), F.col("v"), ".txt")
    assert sorted(os.listdir(at)) == ["_SUCCESS", "p1.txt"]
    pages.write_pages(df.limit(0), at, F.col("n"), F.col("v"))
    assert os.listdir(at) == ["_SUCCESS"]
