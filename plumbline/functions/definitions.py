"""Named typed functions over columns.

A definition is a Python function from Columns to a Column with declared kinds. It is checked while planning and is
pure by construction: it builds an expression and sees no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from plumbline.guards import KindError, require_kind


@dataclass(frozen=True)
class Definition:
    name: str
    inputs: dict[str, str]
    returns: str
    body: Callable[..., Column]

    def over(self, df: DataFrame, **arguments: Column) -> Column:
        """The expression for these arguments, after checking their kinds and the kind of the result."""
        if set(arguments) != set(self.inputs):
            raise KindError(f"{self.name} takes {', '.join(self.inputs)}")
        for name, kind in self.inputs.items():
            require_kind(df, arguments[name], kind)
        result = self.body(**arguments)
        require_kind(df, result, self.returns)
        return result


def define(returns: str, **inputs: str) -> Callable[[Callable[..., Column]], Definition]:
    """``@define("Decimal", total="Int")`` turns a function of Columns into a :class:`Definition`."""
    return lambda body: Definition(body.__name__, inputs, returns, body)
