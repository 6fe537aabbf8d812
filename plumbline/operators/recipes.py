"""Named traversal recipes: how to iterate a column, kept apart from the table they are used on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import items_table
from plumbline.guards import LimitError, require_between

MAX_STAGES = 64


@dataclass(frozen=True)
class Recipe:
    """Items of one column and the stages applied to them, all inside the row: no shuffle, no Python per row."""

    column: str
    items: Callable[[Column], Column]
    stages: tuple[Callable[[Column], Column], ...] = ()

    def _then(self, stage: Callable[[Column], Column]) -> Recipe:
        if len(self.stages) == MAX_STAGES:
            raise LimitError(f"a recipe has at most {MAX_STAGES} stages")
        return replace(self, stages=(*self.stages, stage))

    def map(self, function: Callable[[Column], Column]) -> Recipe:
        return self._then(lambda items: F.transform(items, lambda x: function(x)))

    def filter(self, predicate: Callable[[Column], Column]) -> Recipe:
        return self._then(lambda items: F.filter(items, lambda x: predicate(x)))

    def take(self, n: int) -> Recipe:
        require_between("n", n, 0, (1 << 31) - 1)
        return self._then(lambda items: F.slice(items, 1, n))

    def skip(self, n: int) -> Recipe:
        require_between("n", n, 0, (1 << 30) - 1)
        return self._then(lambda items: F.slice(items, n + 1, 1 << 30))

    def field(self, name: str) -> Recipe:
        return self.map(lambda item: item[name])

    def array(self) -> Column:
        items = self.items(F.col(self.column))
        for stage in self.stages:
            items = stage(items)
        return items

    def use(self, df: DataFrame, item: str = "item", index: str = "index") -> DataFrame:
        return items_table(df, self.array(), item, index)
