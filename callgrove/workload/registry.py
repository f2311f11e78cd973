"""Query registry: a name, the Spark job, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.jobs: dict[str, Job] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(job: Job) -> Job:
            if name in self.jobs:
                raise ValueError(f"query {name} is registered twice")
            self.jobs[name] = job
            if sql is not None:
                self.sql[name] = sql
            return job
        return add
