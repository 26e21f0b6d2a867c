"""Tools as columns: a registry that checks names and arguments and bounds outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import utf8_truncate


class Registry:
    """Tools by name: a predicate on arguments and a column of output."""

    def __init__(self, max_output: int = 4096):
        self.max_output, self.tools = max_output, {}

    def add(self, name: str, accepts: Column, output: Column) -> None:
        if name in self.tools:
            raise ValueError(f"tool {name} is registered twice")
        self.tools[name] = (accepts, output)

    def run(self, tool: Column) -> Column:
        """struct<ok, output, error_code>: ``unknown_tool``, ``invalid_arguments`` or the output, cut to a number of bytes."""
        error, output = F.lit("unknown_tool"), F.lit(None).cast("string")
        for name, (accepts, value) in self.tools.items():
            good = F.coalesce(accepts, F.lit(False))
            error = F.when(tool == name, F.when(~good, F.lit("invalid_arguments"))).otherwise(error)
            output = F.when(tool == name, F.when(good, utf8_truncate(value, self.max_output))).otherwise(output)
        return F.struct(error.isNull().alias("ok"), output.alias("output"), error.alias("error_code"))
