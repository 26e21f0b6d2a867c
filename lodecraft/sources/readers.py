"""Sources by loader name, and layouts they come in."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOADERS: dict[str, Callable[[SparkSession, Mapping], DataFrame]] = {}


def loader(name: str) -> Callable:
    def add(read: Callable[[SparkSession, Mapping], DataFrame]) -> Callable:
        if name in LOADERS:
            raise ValueError(f"loader {name} is registered twice")
        LOADERS[name] = read
        return read

    return add


def load(spark: SparkSession, name: str, params: Mapping, sample: int | None = None) -> tuple[DataFrame, str]:
    """(rows, revision) of a source; ``sample`` keeps the first rows in the order of ``params["order"]``, if any."""
    if name not in LOADERS:
        raise ValueError(f"unknown loader {name}; known: {', '.join(sorted(LOADERS))}")
    rows = LOADERS[name](spark, params)
    if sample is not None:
        rows = (rows.orderBy(params["order"]) if "order" in params else rows).limit(sample)
    return rows, str(params.get("revision", "local"))


@loader("parquet")
def _(spark: SparkSession, params: Mapping) -> DataFrame:
    return spark.read.parquet(params["path"])


@loader("jsonl")
def _(spark: SparkSession, params: Mapping) -> DataFrame:
    """Blank lines are skipped; the schema is declared, so nothing is read to infer it."""
    return spark.read.schema(params["schema"]).json(params["path"])


@loader("json_array")
def _(spark: SparkSession, params: Mapping) -> DataFrame:
    return spark.read.schema(params["schema"]).json(params["path"], multiLine=True)


def require_columns(df: DataFrame, names: list[str] | StructType, exact: bool = False) -> DataFrame:
    """``df`` if it has the columns (and, if ``exact``, no others); an error that names them otherwise."""
    wanted = names.names if isinstance(names, StructType) else list(names)
    missing, extra = [c for c in wanted if c not in df.columns], [c for c in df.columns if c not in wanted]
    if missing or exact and extra:
        raise ValueError(f"missing columns {missing}" + (f", unexpected {extra}" if exact and extra else ""))
    return df


def last_user_message(messages: Column) -> Column:
    """The content of the last user message, else of the last message; null if there is none."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    return F.when(F.size(users) > 0, F.element_at(users, -1)["content"]).when(F.size(messages) > 0, F.element_at(messages, -1)["content"])
