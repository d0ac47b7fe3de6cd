"""A data source over a code host's REST interface: users' repositories, page by page, with retries."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "user string, name string, description string, languages array<string>, stars bigint, forks bigint, fork boolean, updated string, readme string"
#: Answers after which a request is tried again, if the connection did not fail by itself.
PASSING = {403, 408, 425, 429, 500, 502, 503, 504}


@dataclass
class Users(InputPartition):
    users: list[str]


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.api = options["api"].rstrip("/")
        self.users = list(dict.fromkeys(json.loads(options["users"])))
        self.tasks, self.page = int(options.get("tasks", "8")), int(options.get("page", "100"))
        self.tries, self.wait = int(options.get("tries", "4")), float(options.get("wait", "1"))
        self.token, self.details = options.get("token"), options.get("details", "true") == "true"

    def partitions(self) -> list[Users]:
        """Users are dealt out over at most ``tasks`` partitions; a user's pages are read by one task, as the last one ends them."""
        n = max(1, min(self.tasks, len(self.users)))
        return [Users(self.users[k::n]) for k in range(n)]

    def get(self, path: str):
        """The answer to a request as JSON; None where there is nothing.

        Refusals that pass and broken connections are tried again after doubled waits, or what ``Retry-After`` asks for; then the task fails, and Spark tries it again.
        """
        request = urllib.request.Request(self.api + path, headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {}))
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=30) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if e.code not in PASSING or attempt == self.tries - 1:
                    raise
                asked = e.headers.get("Retry-After", "")
                time.sleep(float(asked) if asked.isdigit() else self.wait * 2**attempt)
            except (urllib.error.URLError, ConnectionError, TimeoutError, json.JSONDecodeError):
                if attempt == self.tries - 1:
                    raise
                time.sleep(self.wait * 2**attempt)

    def read(self, partition: Users) -> Iterator[tuple]:
        quoted = lambda x: urllib.parse.quote(x, safe="")
        for user in partition.users:
            number = 1
            while True:
                found = self.get(f"/users/{quoted(user)}/repos?per_page={self.page}&page={number}") or []
                for r in found:
                    at = f"/repos/{quoted(user)}/{quoted(r['name'])}"
                    languages = list(self.get(f"{at}/languages") or {}) if self.details else ([r["language"]] if r.get("language") else [])
                    content = ((self.get(f"{at}/readme") or {}).get("content") or "") if self.details else ""
                    readme = base64.b64decode(content).decode("utf-8", "replace") if content else None
                    yield user, r["name"], r.get("description"), languages, r.get("stargazers_count"), r.get("forks_count"), r.get("fork"), r.get("updated_at"), readme
                if len(found) < self.page:
                    break
                number += 1


class RepositorySource(DataSource):
    """``spark.read.format("repositories")`` with the options ``api``, ``users`` (a JSON list), and if wanted ``tasks``, ``page``, ``tries``, ``wait``, ``token``, ``details``."""

    @classmethod
    def name(cls) -> str:
        return "repositories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(dict(self.options))


def read_repositories(spark: SparkSession, api: str, users: list[str], **options) -> DataFrame:
    """Rows for ``recent_repositories``. Unknown users have none."""
    spark.dataSource.register(RepositorySource)
    reader = spark.read.format("repositories").option("api", api).option("users", json.dumps(users))
    for name, value in options.items():
        reader = reader.option(name, str(value).lower() if isinstance(value, bool) else str(value))
    return reader.load()
