"""References to records that do not exist, are deleted, or arrive later.

A Bloom filter of the parent keys, built by Spark and sent to all tasks, proves
references that it does not hold to be orphans. Only the other references are
verified by an exact join, over one row per distinct key: that join finds the
filter's false positives and the parents that were recorded after, or deleted
before, some reference. References are then held against that short list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import BROADCAST_ROWS, checkpoint

#: Bits of the filter for one key (about 1 % false positives) and its greatest size, 8 MB, as it is part of the plan. It has
#: 1 % false positives up to 6.7 million parents, 10 % at 14, 40 % at 36 million; those go the way of the exact join.
BITS_PER_KEY = 10
MAX_BITS = 8 * 8 * 1024 * 1024
#: References of a suspicious key beyond which it is joined apart where the list is too long to broadcast.
HOT_REFERENCES = 100_000


def bloom_of(hashes: DataFrame, column: str, rows: int, max_bits: int = MAX_BITS) -> Column:
    """A test ``hash column -> might be among the hashes`` as a native expression.

    The size follows ``rows`` up to ``max_bits``; beyond that there are more false
    positives, which the exact join removes, and never a false negative.
    """
    bits = min(max_bits, max(64, rows * BITS_PER_KEY))
    jvm = hashes.sparkSession._jvm
    sketch = hashes._jdf.stat().bloomFilter(column, max(1, rows), bits)
    out = jvm.java.io.ByteArrayOutputStream()
    sketch.writeTo(out)
    return F.lit(bytes(out.toByteArray()))


def might_contain(bloom: Column, hashed: Column) -> Column:
    from pyspark import SparkContext
    from pyspark.sql.classic.column import Column as ClassicColumn

    jvm = SparkContext._active_spark_context._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(
        utils.expression(bloom._jc), utils.expression(hashed._jc)
    )
    return ClassicColumn(utils.column(test))


def broken_references(
    refs: DataFrame, parents: DataFrame, max_bits: int = MAX_BITS, broadcast_rows: int = BROADCAST_ROWS, hot_references: int = HOT_REFERENCES
) -> DataFrame:
    """The references that are missing, late or deleted.

    ``refs`` has ``table_name, ref_field, row_key, parent_kind, parent_id, at``, one
    row per reference with its recording time; ``parents`` has ``parent_kind,
    parent_id, recorded_at, deleted_at`` and may repeat keys: the earliest times
    count. Returns the columns of ``refs`` and ``ref_state``: "missing" if no parent
    has the key, "late" if the parent's time is after the reference's, "deleted" if
    its deletion is not after it; a reference may be late and deleted.

    A null ``parent_id`` is no reference. With a null ``at``, or for a parent without
    times, only "missing" can be told. Without any parents all are missing.
    """
    key = ["parent_kind", "parent_id"]
    known = parents.filter("parent_id IS NOT NULL").groupBy(*key).agg(F.min("recorded_at").alias("recorded_at"), F.min("deleted_at").alias("deleted_at"))
    known = checkpoint(known)
    rows = known.count()
    refs = refs.filter("parent_id IS NOT NULL")
    out = [*refs.columns, "ref_state"]
    if not rows:
        return refs.withColumn("ref_state", F.lit("missing")).select(*out)
    hashed = F.xxhash64(*key)
    maybe = might_contain(bloom_of(known.select(hashed.alias("_h")), "_h", rows, max_bits), hashed)
    # written once, as it is read for the keys asked for and again for the result
    refs = checkpoint(refs.withColumn("_maybe", maybe))
    # one row per distinct key, combined before the shuffle, so a hot key is one row here
    asked = refs.filter("_maybe").groupBy(*key).agg(F.min("at").alias("_first"), F.max("at").alias("_last"), F.count(F.lit(1)).alias("_refs"))
    checked = asked.join(known.withColumn("_known", F.lit(True)), key, "left")
    suspicious = checked.filter(
        F.col("_known").isNull() | (F.col("recorded_at") > F.col("_first")) | (F.col("deleted_at") <= F.col("_last"))
    ).select(*key, "_known", "recorded_at", "deleted_at", "_refs", F.lit(True).alias("_listed"))
    suspicious = checkpoint(suspicious)
    facts = suspicious.agg(F.count(F.lit(1)).alias("n"), F.sum("_refs").alias("refs")).first()
    if facts["n"] <= broadcast_rows:
        held = refs.join(F.broadcast(suspicious), key, "left")
    else:
        # keys with more references than this are few enough to broadcast; no other makes a task long
        hot = F.col("_refs") > max(hot_references, -(-(facts["refs"] or 0) // BROADCAST_ROWS))
        first = refs.join(F.broadcast(suspicious.filter(hot)), key, "left")
        done, rest = first.filter("_listed OR NOT _maybe"), first.filter("_listed IS NULL AND _maybe").select(*refs.columns)
        held = done.unionByName(rest.join(suspicious.filter(~hot), key).select(*done.columns))
    states = F.when(~F.col("_maybe"), F.array(F.lit("missing"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("_listed") & F.col("_known").isNull(), "missing"),
                F.when(F.col("recorded_at") > F.col("at"), "late"),
                F.when(F.col("deleted_at") <= F.col("at"), "deleted"),
            )
        )
    )
    return held.withColumn("ref_state", F.explode(states)).select(*out)


#: Edge types by the kind of record at their ends; all others join people.
COMPANY_TO_PERSON = ("brand_fit", "employment", "blacklist", "exclusive_deal")
COMPANY_TO_COMPANY = ("co_production", "market_rival", "subsidiary")


def film_references(edges: DataFrame, movies: DataFrame) -> DataFrame:
    """References of edges to people and companies and of films to directors.

    Each ``row_id`` or ``mid`` counts once with its earliest recording time. A null,
    zero or negative director is no reference, nor is a null end of an edge.
    """
    kind = F.lower(F.btrim("edge_type", F.lit(" \t\r\n")))
    source = F.when(kind.isin(*COMPANY_TO_PERSON, *COMPANY_TO_COMPANY), "company").otherwise("person")
    target = F.when(kind.isin(*COMPANY_TO_COMPANY), "company").otherwise("person")
    once = (
        edges.select("row_id", "src_id", "dst_id", source.alias("src_kind"), target.alias("dst_kind"), "recorded_at")
        .groupBy("row_id", "src_id", "dst_id", "src_kind", "dst_kind")
        .agg(F.min("recorded_at").alias("at"))
    )
    ref = lambda field, k, i: F.struct(F.lit(field).alias("ref_field"), k.alias("parent_kind"), i.alias("parent_id"))
    ends = F.array(ref("src_id", F.col("src_kind"), F.col("src_id")), ref("dst_id", F.col("dst_kind"), F.col("dst_id")))
    of_edges = once.select(F.lit("edges").alias("table_name"), F.col("row_id").alias("row_key"), "at", F.explode(ends).alias("_r"))
    of_edges = of_edges.select("table_name", "_r.ref_field", "row_key", "_r.parent_kind", "_r.parent_id", "at")
    directors = movies.filter("director_id > 0").groupBy("mid", "director_id").agg(F.min("recorded_at").alias("at"))
    of_movies = directors.select(
        F.lit("movie_context").alias("table_name"), F.lit("director_id").alias("ref_field"), F.col("mid").alias("row_key"),
        F.lit("person").alias("parent_kind"), F.col("director_id").alias("parent_id"), "at",
    )
    return of_edges.unionByName(of_movies)


def film_parents(person: DataFrame, company: DataFrame) -> DataFrame:
    people = person.select(F.lit("person").alias("parent_kind"), F.col("person_id").alias("parent_id"), "recorded_at", "deleted_at")
    return people.unionByName(
        company.select(F.lit("company").alias("parent_kind"), F.col("company_id").alias("parent_id"), "recorded_at", "deleted_at")
    )
