"""Joins with checked cardinality, unique keys, range joins and candidate resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def assert_unique(df: DataFrame, keys: list[str], what: str) -> None:
    """Fail if a key occurs twice; only whether one does reaches the driver."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{what} is not unique by {', '.join(keys)}")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """Join after checking that the sides named ``one`` have unique keys."""
    one_left, _, one_right = validate.partition("_to_")
    if {one_left, one_right} - {"one", "many"}:
        raise ValueError("validate is one_to_one, one_to_many, many_to_one or many_to_many")
    if one_left == "one":
        assert_unique(left, keys, "the left side")
    if one_right == "one":
        assert_unique(right, keys, "the right side")
    return left.join(right, keys, how)


def unique_only(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not null and occurs once."""
    once = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n = 1").select(key)
    return df.join(once, key, "left_semi")


def frozen_panel(cutoffs: DataFrame, references: DataFrame) -> DataFrame:
    """References dated before each cutoff. Cutoffs are the small side: a row for each forecast."""
    return references.join(F.broadcast(cutoffs), F.col("reference_date") < F.col("forecast_cutoff"))


def references_before(references: DataFrame, cutoffs: DataFrame, keys: list[str], embeddings: DataFrame, subtype: str) -> DataFrame:
    """The frozen panel of each cutoff: conditions of one subtype that were measured before it and have an embedding.

    ``references`` has the keys of a condition, ``embedding_id``, ``subtype`` and ``reference_date`` (a text);
    rows of other subtypes or without a valid date don't count. A condition has the row of its earliest
    date, of those the smallest embedding_id.
    """
    dated = references.where(F.lower(F.trim("subtype")) == subtype.lower()).withColumn("reference_date", F.try_to_date("reference_date", "yyyy-MM-dd")).where("reference_date is not null")
    held = dated.join(embeddings.select("embedding_id").distinct(), "embedding_id", "left_semi")
    first = held.groupBy(*keys).agg(F.min(F.struct("reference_date", "embedding_id")).alias("first")).select(*keys, "first.*")
    return frozen_panel(cutoffs.select("window_id", "forecast_cutoff"), first)


def one_value_each(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Every key once with its value; an error if a key stands for two values, as a shortened hash might."""
    sums = rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__most"))
    return held(sums, F.col(value).eqNullSafe(F.col("__most")), f"a {key} stands for two values of {value}").drop("__most")


def past_without_current(rows: DataFrame, cutoffs: DataFrame, years: int = 5) -> DataFrame:
    """Keys seen in the years before each recent half-year and not in it, with how often.

    ``rows`` has ``collection_date`` and ``query_id``; the ranges meet at the day before the recent
    half-year. Rows are counted by day first.
    """
    by_day = rows.groupBy("collection_date", "query_id").agg(F.count("*").alias("n"))
    spans = cutoffs.select("window_id", "recent_start", "recent_end", F.add_months("recent_end", -12 * years).alias("past_start"))
    hits = by_day.join(F.broadcast(spans), F.col("collection_date").between(F.col("past_start"), F.col("recent_end")))
    recent = F.col("collection_date") >= F.col("recent_start")
    sums = hits.groupBy("window_id", "query_id").agg(
        F.sum(F.when(~recent, F.col("n")).otherwise(0)).alias("source_weight"), F.sum(F.when(recent, F.col("n")).otherwise(0)).alias("current"), F.max(F.when(~recent, F.col("collection_date"))).alias("last_seen")
    )
    return sums.where("source_weight > 0 and current = 0").select("window_id", "query_id", "source_weight", "last_seen")


def resolve_unique(records: DataFrame, lookups: list[tuple[str, DataFrame, str]], scored: DataFrame) -> DataFrame:
    """The one scored sequence that a record's candidates hit, with a status.

    ``lookups`` are (record column, table, table column); each table has ``sequence``. Candidates of
    all lookups are joined and cut to the scored ones; ``status`` is unique, ambiguous, unscored or missing.
    """
    found = None
    for column, table, key in lookups:
        own = records.select("record_id", F.col(column).alias("k")).join(table.select(F.col(key).alias("k"), "sequence"), "k").select("record_id", "sequence")
        found = own if found is None else found.unionByName(own)
    marked = found.distinct().join(scored.select("sequence").distinct().withColumn("hit", F.lit(1)), "sequence", "left")
    sums = marked.groupBy("record_id").agg(F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("sequence"))).alias("sequence"))
    out = records.select("record_id").join(sums, "record_id", "left")
    status = F.when(F.col("hits") == 1, "unique").when(F.col("hits") > 1, "ambiguous").when(F.col("hits") == 0, "unscored").otherwise("missing")
    return out.select("record_id", status.alias("status"), F.when(F.col("hits") == 1, F.col("sequence")).alias("sequence"))


def held(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows, with an error if one doesn't hold: a filter on all of them, which no choice of columns takes out."""
    return rows.where(F.assert_true(condition, message).isNull())


def complete_join(left: DataFrame, right: DataFrame, keys: list[str], value: str | None = None, validate: str = "many_to_one", at_once: bool = False) -> DataFrame:
    """A left join that fails when a row has no partner, or with ``value`` one whose value is null.

    The check is a filter, so counts and single columns are checked too; rows that a later filter leaves
    out need not be. With ``at_once`` an anti-join checks all rows before anything is returned.
    """
    require_columns(right, *keys, *([value] if value else []))
    if at_once and not left.join(right.where(F.col(value).isNotNull()) if value else right, keys, "left_anti").isEmpty():
        raise ValueError("a row has no partner")
    rows = checked_join(left, right.withColumn("__met", F.lit(True)), keys, "left", validate)
    met = F.col("__met").isNotNull()
    return held(rows, met & F.col(value).isNotNull() if value else met, "a row has no partner").drop("__met")


def agreeing_join(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Partners by ``keys`` whose ``columns`` must be equal on both sides, else an error; rows without a partner are an error too.

    The check is a filter, as in ``complete_join``.
    """
    marked = right.select(*keys, *[F.col(c).alias(f"__right_{c}") for c in columns], *[c for c in right.columns if c not in {*keys, *columns}], F.lit(True).alias("__met"))
    rows = checked_join(left, marked, keys, "left", "one_to_one")
    same = F.col("__met").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__right_{c}"))
    return held(rows, same, "two tables disagree about a row").drop("__met", *[f"__right_{c}" for c in columns])


def occurrences(rows: DataFrame, key: str) -> DataFrame:
    """Every key once with how often it occurs."""
    return rows.groupBy(key).agg(F.count("*").alias("source_weight"))


def value_sets(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Of each key, how many different values it has, and the value if there is just one."""
    sets = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("least"))
    return sets.select(key, "n_values", F.when(F.col("n_values") == 1, F.col("least")).alias("one_value"))
