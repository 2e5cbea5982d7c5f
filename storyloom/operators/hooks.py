"""Checks and stages that users add by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Checks:
    """Named checks of rows: functions from columns to a boolean column, or from pandas series to one (run in Arrow batches). True passes, null too."""

    def __init__(self) -> None:
        self._checks: dict[str, tuple[Callable[..., Column], tuple[str, ...], str]] = {}

    def add(self, name: str, columns: Iterable[str], check: Callable, pandas: bool = False, severity: str = "retry") -> None:
        """A check over some columns. pandas: check takes and gives pandas series. severity: what a failure means, `retry` or `fail`."""
        if name in self._checks:
            raise ValueError(f"there is a check named {name}")
        if severity not in ("retry", "fail"):
            raise ValueError(f"unknown severity {severity}")
        self._checks[name] = (F.pandas_udf(check, "boolean") if pandas else check, tuple(columns), severity)

    def names(self) -> list[str]:
        return list(self._checks)

    def failed(self, severity: str | None = None) -> Column:
        """The names of the checks that a row fails, in the order in which they were added."""
        found = [F.when(~check(*[F.col(c) for c in columns]), F.lit(name)) for name, (check, columns, kind) in self._checks.items() if severity in (None, kind)]
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


class Stages:
    """A list of named stages, functions from DataFrame to DataFrame, that users extend."""

    def __init__(self, stages: Iterable[tuple[str, Callable[[DataFrame], DataFrame]]] = ()):
        self.stages: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
        for name, stage in stages:
            self.add(name, stage)

    def add(self, name: str, stage: Callable[[DataFrame], DataFrame], after: str | None = None) -> None:
        """Add a stage at the end, or behind another one."""
        if name in self.names():
            raise ValueError(f"there is a stage named {name}")
        if after is not None and after not in self.names():
            raise ValueError(f"there is no stage named {after}")
        at = len(self.stages) if after is None else self.names().index(after) + 1
        self.stages.insert(at, (name, stage))

    def names(self) -> list[str]:
        return [name for name, _ in self.stages]
