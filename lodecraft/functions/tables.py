"""Table functions for SQL and LATERAL joins: one answer string to the rows of its groups or items, and one row for each of a partition's keys."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from . import answers

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def _schema(**columns) -> StructType:
    """Made of types, since DDL is read by a session, which the process that analyses a call has not."""
    out = StructType()
    for name, kind in columns.items():
        out.add(name, kind)
    return out


def _text(given: AnalyzeArgument, what: str) -> None:
    if not isinstance(given.dataType, StringType):
        raise ValueError(f"{what} takes a string, not {given.dataType.simpleString()}")


def _constant(given: AnalyzeArgument, what: str, allowed: tuple[str, ...]) -> str:
    if given.value not in allowed:
        raise ValueError(f"{what} is one of {', '.join(allowed)}")
    return given.value


@udtf
class AnswerGroups:
    """(place int, value string): the groups of a text, left to right; ``kind`` is boxed, display or inline. Null or no group: no rows."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        _text(text, "text")
        _constant(kind, "kind", ("boxed", "display", "inline"))
        return AnalyzeResult(_schema(place=IntegerType(), value=StringType()))

    def eval(self, text: str | None, kind: str) -> Iterator[tuple]:
        if text is not None:
            groups = answers.boxed(text) if kind == "boxed" else answers.dollar_groups(text, "$$" if kind == "display" else "$")
            yield from enumerate(groups)


@udtf
class AnswerItems:
    """(path string, depth int, kind string, value string, error string): a number, set or tuple and, below it, all its items.

    ``path`` names an item by its places from the outermost in, ``kind`` is number, set or tuple and ``value`` the canonical form. Items of a set stand in the order they are
    written. A text that is none of these is one row with ``error``. Null: no rows.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _text(text, "text")
        return AnalyzeResult(_schema(path=StringType(), depth=IntegerType(), kind=StringType(), value=StringType(), error=StringType()))

    def eval(self, text: str | None) -> Iterator[tuple]:
        if text is None:
            return
        try:
            answers.collection(text)
        except answers.Bad as fault:
            yield "", 0, None, None, str(fault)
            return
        todo = [("", 0, text)]
        while todo:
            path, depth, part = todo.pop()
            part = part.strip()
            value = answers.collection(part)
            kind = "tuple" if isinstance(value, tuple) else "set" if isinstance(value, frozenset) else "number"
            yield path, depth, kind, answers.form(value), None
            if kind != "number" and (inner := part[1:-1].strip()):
                items = answers.split_items(inner)
                todo += [(f"{path}.{k}".lstrip("."), depth + 1, x) for k, x in reversed([*enumerate(items)])]


@udtf
class FirstAccepted:
    """(task_id string, place long, outcome string): of the rows (task_id, place, accepted) of a task, the first accepted one is ``accepted``, later ones ``duplicate_task``, others ``rejected``.

    Called with a table: Spark deals it by task and sorts it by place, so a task's rows stream past and only whether one was accepted is kept.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or [f.name for f in rows.dataType.fields] != ["task_id", "place", "accepted"]:
            raise ValueError("first_accepted takes a table of task_id, place, accepted")
        return AnalyzeResult(_schema(task_id=StringType(), place=LongType(), outcome=StringType()), partitionBy=[PartitioningColumn("task_id")], orderBy=[OrderingColumn("place")])

    def __init__(self):
        self.task, self.done = None, False

    def eval(self, row) -> Iterator[tuple]:
        outcome = "rejected" if not row["accepted"] else "duplicate_task" if self.done else "accepted"
        self.done = self.done or outcome == "accepted"
        yield row["task_id"], row["place"], outcome


#: Name in SQL -> function.
FUNCTIONS = {"answer_groups": AnswerGroups, "answer_items": AnswerItems, "first_accepted": FirstAccepted}


class TableFunctions:
    """Table functions of one session by name; a name that is not an identifier or that the session has already is an error."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, set()

    def register(self, name: str, function) -> None:
        if not _NAME.match(name):
            raise ValueError(f"{name!r} is no name for a function")
        if name.lower() in self.names or self.spark.catalog.functionExists(name):
            raise ValueError(f"{name} is registered already")
        self.spark.udtf.register(name, function)
        self.names.add(name.lower())

    def register_text_function(self, name: str, run: Callable[[str], str | None]) -> None:
        """A tool from text to text as a scalar function of SQL; what it raises becomes its output."""
        if not _NAME.match(name) or name.lower() in self.names or self.spark.catalog.functionExists(name):
            raise ValueError(f"{name!r} is no name for a new function")

        @F.pandas_udf("string")
        def column(values: pd.Series) -> pd.Series:
            def one(value: str | None) -> str | None:
                try:
                    return None if value is None else run(value)
                except Exception as fault:
                    return f"error: {fault}"

            return pd.Series([one(v) for v in values], dtype=object)

        self.spark.udf.register(name, column)
        self.names.add(name.lower())


def register_all(spark: SparkSession) -> None:
    """This library's table functions under their usual names, again if they are there."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
