"""What users may plug in: verifiers by answer type, rewards by name, tools of their own."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import verify_one
from .bounded import comparator
from .tools import Registry

Verifier = Callable[[Column, Column], Column]


class Verifiers:
    """Column functions (prediction, reference) -> status by answer type; each row goes to that of its type."""

    def __init__(self):
        self.by_type: dict[str, Verifier] = {}

    def register(self, kind: str) -> Callable[[Verifier], Verifier]:
        def add(verifier: Verifier) -> Verifier:
            if kind in self.by_type:
                raise ValueError(f"a verifier of {kind} is registered twice")
            self.by_type[kind] = verifier
            return verifier

        return add

    def verdict(self, prediction: Column, reference: Column, kind: Column) -> Column:
        """The verdict of the type's verifier, which gets nulls for rows of other types; an unknown type is ``invalid_reference``."""
        def case(rest: Column, one: tuple[str, Verifier]) -> Column:
            mine = kind == one[0]
            return F.when(mine, one[1](F.when(mine, prediction), F.when(mine, reference))).otherwise(rest)

        return reduce(case, self.by_type.items(), F.lit("invalid_reference"))


def standard(symbolic: Callable[[str, str], str] | None = None, wall: float | None = None) -> Verifiers:
    """Verifiers of all seven types; expressions are compared by ``symbolic``, in a child with limits."""
    from .expressions import compare

    found = Verifiers()

    def typed(kind: str) -> Verifier:
        @F.pandas_udf("string")
        def run(prediction: pd.Series, reference: pd.Series) -> pd.Series:
            return pd.Series(["invalid_reference" if r is None else "invalid_prediction" if p is None else verify_one(p, r, kind) for p, r in zip(prediction, reference, strict=True)], dtype=object)

        return run

    for kind in ("integer", "rational", "real", "set", "tuple", "interval"):
        found.register(kind)(typed(kind))
    found.register("expression")(comparator(symbolic or compare, **({} if wall is None else {"wall": wall})))
    return found


class Rewards:
    """Rewards by name: functions of a frame's columns that give a column. A composite is their weighted sum, with its parts beside it."""

    def __init__(self):
        self.by_name: dict[str, Callable[[Mapping[str, Column]], Column]] = {}

    def register(self, name: str) -> Callable:
        def add(build: Callable[[Mapping[str, Column]], Column]) -> Callable:
            if name in self.by_name:
                raise ValueError(f"reward {name} is registered twice")
            self.by_name[name] = build
            return build

        return add

    def composite(self, weights: Mapping[str, float], columns: Mapping[str, Column]) -> Column:
        """struct<total, part of each name> for the named weights; an unknown name is an error that lists the known ones."""
        unknown = sorted(set(weights) - set(self.by_name))
        if unknown:
            raise ValueError(f"unknown rewards {', '.join(unknown)}; known: {', '.join(sorted(self.by_name))}")
        parts = {name: self.by_name[name](columns) * F.lit(float(w)) for name, w in weights.items()}
        return F.struct(reduce(Column.__add__, parts.values(), F.lit(0.0)).alias("total"), *[p.alias(n) for n, p in parts.items()])


def add_python_tool(registry: Registry, name: str, run: Callable[[str], str], argument: Column, accepts: Column | None = None) -> None:
    """A tool made of a Python function from text to text; what it raises becomes its output, so that one row never stops the others."""

    @F.pandas_udf("string")
    def column(values: pd.Series) -> pd.Series:
        def one(value: str | None) -> str | None:
            try:
                return None if value is None else str(run(value))
            except Exception as fault:
                return f"error: {fault}"

        return pd.Series([one(v) for v in values], dtype=object)

    registry.add(name, argument.isNotNull() if accepts is None else accepts, column(argument))
