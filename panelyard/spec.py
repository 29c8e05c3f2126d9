"""Column names of a panel, so that operators fit any entity-by-week table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PanelSpec:
    entity: str = "entity"
    week: str = "week_start"
    count: str = "cases"
    rate: str = "inc"
    population: str = "population"
    exposures: tuple[str, ...] = field(default=("a_sum", "b_mean", "c_mean"))

    @property
    def w(self) -> WindowSpec:
        """Rows of one entity in week order."""
        return Window.partitionBy(self.entity).orderBy(self.week)

    @property
    def by_day(self) -> WindowSpec:
        """The same rows ordered by an integer day, for frames that are exact in dates."""
        return Window.partitionBy(self.entity).orderBy(F.unix_date(self.week))

    def past(self, n: int | None = None) -> WindowSpec:
        """The ``n`` rows before the current one, or all of them."""
        return self.w.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def at_least(value: Column, threshold: Column | float) -> Column:
    """A comparison that is false, not null, on missing values."""
    return F.coalesce(value >= threshold, F.lit(False))


DEFAULT = PanelSpec()
