"""The operators' registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from inspect import signature

from pyspark.sql import DataFrame

from tessel.functions.grids import Frame


@dataclass(frozen=True)
class Operator:
    name: str
    category: str
    build: Callable[..., DataFrame]

    @property
    def parameters(self) -> list[str]:
        return list(signature(self.build).parameters)[1:]

    def __call__(self, grids: DataFrame, **parameters: object) -> DataFrame:
        """``grids`` (columns g, h, w, err and any others) after this operator; refused grids have a null g and a reason in err."""
        return self.build(Frame(grids), **parameters)


OPERATORS: dict[str, Operator] = {}


def operator(category: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        OPERATORS[build.__name__] = Operator(build.__name__, category, build)
        return build

    return register
