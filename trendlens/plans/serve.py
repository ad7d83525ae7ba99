"""Serving queries over the exported trend / article / term tables (the data
preparation of the front-end page)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trend_extent(wide: DataFrame) -> DataFrame:
    return wide.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def trend_melt(wide: DataFrame, names: list[str]) -> DataFrame:
    """(name, date, value) for the selected topic columns."""
    return wide.unpivot("date", names, "name", "value").select("name", "date", "value")


def trend_max(wide: DataFrame, names: list[str]) -> DataFrame:
    return wide.agg(F.max(F.greatest(*[F.col(n) for n in names])).alias("max_value")) \
        if len(names) > 1 else wide.agg(F.max(names[0]).alias("max_value"))


def trend_stack_max(wide: DataFrame, names: list[str]) -> DataFrame:
    """Max over dates of the stacked total of the selected topics."""
    total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return wide.agg(F.max(total).alias("max_total"))


def articles_flatten(best_json: DataFrame, names: list[str]) -> DataFrame:
    """(name, pos, article fields...) for the selected topics."""
    sel = best_json.filter(F.col("name").isin(names))
    return sel.select("name", F.posexplode("articles").alias("pos", "a")).select("name", "pos", "a.*")


def topic_terms_lookup(terms_json: DataFrame, names: list[str]) -> DataFrame:
    return terms_json.filter(F.col("name").isin(names)).select("name", "terms")
