"""What a registered query is, and where those that write put their files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import new_path


@dataclass(frozen=True)
class Query:
    """``build`` makes the Spark result; ``sql`` is its counterpart, if SQL can express it."""

    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for written results in the shared folder of the session."""
    return new_path(spark, "written")


def with_ctes(final: str, *ctes: tuple[str, str]) -> str:
    """``WITH a AS (...), b AS (...) final``."""
    head = ",\n".join(f"{name} AS ({body})" for name, body in ctes)
    return f"WITH {head}\n{final}"
