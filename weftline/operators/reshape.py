"""Relational reshaping: wide to long, dictionaries, flat tables, collaborations, links and yearly context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import null_if_missing
from weftline.operators.ranking import dense_ids


def to_attributes(df: DataFrame, key: str, attributes: dict[int, Column]) -> DataFrame:
    """``key, info_type_id, info``: one row per attribute that isn't null, blank or "nan", trimmed."""
    items = F.array(*[F.struct(F.lit(i).alias("info_type_id"), null_if_missing(c).alias("info")) for i, c in attributes.items()])
    return df.select(key, F.inline(items)).filter("info IS NOT NULL")


def from_attributes(df: DataFrame, key: str, types: dict[int, str]) -> DataFrame:
    """Long form back to columns in one pass, for attributes with one value each; of several the least."""
    return df.groupBy(key).agg(*[F.min(F.when(F.col("info_type_id") == i, F.col("info"))).alias(n) for i, n in types.items()])


def encoded(df: DataFrame, column: str, id_name: str) -> tuple[DataFrame, DataFrame]:
    """The table with the words of a column replaced by ids in their order, and the dictionary; null stays null."""
    words = dense_ids(df.filter(F.col(column).isNotNull()).select(column).distinct(), [column], id_name)
    return df.join(words, column, "left").drop(column), words


def joined_text(df: DataFrame, key: str, text: str, order: list[str], name: str, separator: str = "; ") -> DataFrame:
    """Texts of a key in order as one."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return df.filter(F.col(text).isNotNull()).groupBy(key).agg(F.array_join(rows["_t"], separator).alias(name))


def flat(base: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    """A table with grouped texts added, empty where there are none."""
    out = base
    for p in parts:
        added = [c for c in p.columns if c != key]
        out = out.join(p, key, "left").fillna("", added)
    return out


def collaborations(credits: DataFrame, billed: int = 20, least: int = 2) -> DataFrame:
    """``a, b, n, first_year, last_year`` of pairs in at least ``least`` films, of the first ``billed`` of each cast.

    ``credits`` has ``film, person, nth, year``. A film gives at most billed**2 / 2 pairs.
    """
    rank = F.row_number().over(Window.partitionBy("film").orderBy("nth", "person"))
    top = credits.withColumn("_r", rank).filter(F.col("_r") <= billed)
    sets = top.groupBy("film").agg(F.array_sort(F.collect_set("person")).alias("p"), F.min("year").alias("year"))
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.lit(billed)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = sets.select("year", F.explode(pairs).alias("x")).select("x.a", "x.b", "year")
    got = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return got.filter(F.col("n") >= least)


def shared_links(left: DataFrame, right: DataFrame, least: int = 2) -> DataFrame:
    """``source, target, n_shared`` of things with at least ``least`` members in common, of ``id, member``.

    Both sides are joined on the member, and pairs are counted before they are sent. A member of
    very many things on both sides gives all pairs of them; that is what is asked for, and the
    join's skew handling spreads it.
    """
    l = left.select(F.col("id").alias("source"), "member").distinct()
    r = right.select(F.col("id").alias("target"), "member").distinct()
    return l.join(r, "member").filter("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n_shared")).filter(F.col("n_shared") >= least)


def yearly_context(casts: DataFrame, first: int = 8) -> DataFrame:
    """``year, a, b, n``: how often people were together among the first ``first`` of a cast in a year.

    ``casts`` has ``year`` and an array ``people``.
    """
    head = F.array_sort(F.array_distinct(F.slice("people", 1, first)))
    pairs = F.flatten(F.transform("h", lambda a, i: F.transform(F.slice("h", i + 2, F.lit(first)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return casts.select("year", head.alias("h")).select("year", F.explode(pairs).alias("x")).groupBy("year", "x.a", "x.b").agg(F.count(F.lit(1)).alias("n"))


def clamped_years(people: DataFrame, years: DataFrame, born: str, youngest: int = 5, oldest: int = 90) -> DataFrame:
    """Birth years held between the last work less ``oldest`` and the first work less ``youngest``.

    ``years`` has ``id, year`` of works; people without any keep theirs.
    """
    span = years.groupBy("id").agg(F.min("year").alias("_first"), F.max("year").alias("_last"))
    held = F.greatest(F.col("_last") - oldest, F.least(F.col(born), F.col("_first") - youngest))
    return people.join(span, "id", "left").withColumn(born, F.when(F.col("_first").isNull(), F.col(born)).otherwise(held)).drop("_first", "_last")


def first_column(df: DataFrame, name: str, candidates: list[str], default: str | None = None) -> DataFrame:
    """Adds ``name``: of the candidate columns that the table has, the first that is filled, else the default."""
    there = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in candidates if c in df.columns]
    return df.withColumn(name, F.coalesce(*there, F.lit(default).cast("string")))


def with_ids(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows whose id is null, not above 0, or used by a row before get ids above all others.

    ``order`` has to tell rows apart; of rows with one id the first in it keeps the id.
    """
    again = F.row_number().over(Window.partitionBy(column).orderBy(*order))
    marked = df.withColumn("_good", F.coalesce(F.col(column) > 0, F.lit(False)) & (again == 1))
    top = marked.filter("_good").agg(F.max(column)).first()[0] or 0
    good, bad = marked.filter("_good").drop("_good"), marked.filter("NOT _good").drop("_good", column)
    return good.unionByName(dense_ids(bad, order, column, first=top + 1))


def exposure(members: DataFrame, others: DataFrame, key: str, first: int) -> DataFrame:
    """``year, a, b, n``: how often each of ``others`` (``key, other``) met each of the first so many of ``members`` (``key, year, people``)."""
    met = members.select(key, "year", F.explode(F.slice("people", 1, first)).alias("b")).join(others.withColumnRenamed("other", "a"), key)
    return met.filter("a <> b").groupBy("year", "a", "b").agg(F.count(F.lit(1)).alias("n"))
