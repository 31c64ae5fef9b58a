"""Names of runs, levels, colours and dates for readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least probability, name and colour of each level, highest first.
LEVELS = [(0.8, "high", "#b91c1c"), (0.5, "medium", "#f59e0b"), (0.0, "low", "#64748b")]


def level(p: Column) -> Column:
    """The coarse ladder of a probability; the lowest without one."""
    out = F.lit(LEVELS[-1][1])
    for least, name, _ in reversed(LEVELS[:-1]):
        out = F.when(p >= least, F.lit(name)).otherwise(out)
    return out


def level_colour(p: Column) -> Column:
    out = F.lit(LEVELS[-1][2])
    for least, _, colour in reversed(LEVELS[:-1]):
        out = F.when(p >= least, F.lit(colour)).otherwise(out)
    return out


def delta_colour(delta: Column, dead: float = 0.02) -> Column:
    """What beliefs raise, lower and leave."""
    return F.when(delta > dead, "#15803d").when(delta < -dead, "#b91c1c").otherwise("#64748b")


def valid_date(text: Column) -> Column:
    """Whether a text is one ISO day that exists."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def run_name(run: Column) -> Column:
    """A run's label in words, each with a capital."""
    return F.initcap(F.trim(F.regexp_replace(run, "[_-]+", " ")))


def title_of_runs(runs: Column, most: int = 3) -> Column:
    """The first runs in words, and how many more there are."""
    names = F.array_join(F.transform(F.slice(runs, 1, most), run_name), ", ")
    return F.when(F.size(runs) > most, F.concat(names, F.lit(" and "), (F.size(runs) - most).cast("string"), F.lit(" more"))).otherwise(names)
