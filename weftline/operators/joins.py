"""Join forms: validity intervals, lookups, orphans, paths, triangles, factorised counts, blocks and near names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.references import bloom_of, might_contain
from weftline.session import BROADCAST_ROWS, broadcast_if_small, checkpoint


def contains(low: Column, high: Column, point: Column) -> Column:
    """Both ends count; false where a bound is null."""
    return (low <= point) & (high >= point)


def overlaps(low: Column, high: Column, first: Column, last: Column) -> Column:
    return (low <= last) & (high >= first)


def interval_join(points: DataFrame, point: str, spans: DataFrame, low: str, high: str, width: int = 8) -> DataFrame:
    """Points with the intervals that contain them, where no other key joins them.

    Both sides are cut into blocks of ``width`` whole numbers, and an interval comes
    once for each block it touches, so this is an equi join with a condition. Null or
    reversed bounds contain nothing. Bounds must be finite: close open ends first.
    """
    block = lambda c: F.floor(c / width)
    cut = spans.filter(F.col(low) <= F.col(high)).select("*", F.explode(F.sequence(block(F.col(low)), block(F.col(high)))).alias("_block"))
    placed = points.filter(F.col(point).isNotNull()).withColumn("_block", block(F.col(point)))
    return placed.join(cut, "_block").filter(contains(F.col(low), F.col(high), F.col(point))).drop("_block")


def lookup(df: DataFrame, key: str, dim: DataFrame, dim_key: str, value: str, order: str, default=None, name: str | None = None) -> DataFrame:
    """Left lookup of one value per key; of repeated keys the last by ``order`` counts.

    The small side is broadcast if its keys are few enough, else both are shuffled.
    """
    last = dim.filter(F.col(dim_key).isNotNull()).groupBy(F.col(dim_key).alias(key)).agg(F.max_by(value, order).alias("_value"))
    few = last.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = df.join(F.broadcast(last) if few else last, key, "left")
    found = F.coalesce("_value", F.lit(default)) if default is not None else F.col("_value")
    return joined.withColumn(name or value, found).drop("_value")


def orphan_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct keys of the child without a parent; null is no key."""
    keys = child.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    return keys.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def two_paths(edges: DataFrame) -> DataFrame:
    """``a, b, c`` of directed paths a -> b -> c with a <> c, of ``src, dst``."""
    first, second = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), edges.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    return first.join(second, "b").filter("a <> c").select("a", "b", "c")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct ``src < dst`` pairs; loops and nulls are left out."""
    ends = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    return edges.filter("src <> dst").select(*ends).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """``a < b < c`` of each triangle of an undirected graph.

    An edge leads from the end with fewer neighbours to the other, so that a hub,
    however large, starts few paths; the paths of two edges are closed by one join.
    """
    pairs = undirected(edges)
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    ranked = pairs.join(degree.select(F.col("v").alias("src"), F.col("d").alias("ds")), "src").join(degree.select(F.col("v").alias("dst"), F.col("d").alias("dd")), "dst")
    forward = F.struct("ds", "src") < F.struct("dd", "dst")
    turned = ranked.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("y"))
    wedge = turned.alias("l").join(turned.alias("r"), F.col("l.x") == F.col("r.x")).filter("l.y < r.y").select(F.col("l.x").alias("x"), F.col("l.y").alias("src"), F.col("r.y").alias("dst"))
    closed = wedge.join(pairs, ["src", "dst"])
    corners = F.array_sort(F.array("x", "src", "dst"))
    return closed.select(corners[0].alias("a"), corners[1].alias("b"), corners[2].alias("c"))


def directed_cycles(edges: DataFrame) -> DataFrame:
    """``a, b, c`` of a -> b -> c -> a, each cycle once from each of its corners."""
    e = edges.select("src", "dst").distinct()
    one, two, three = (e.select(F.col("src").alias(x), F.col("dst").alias(y)) for x, y in (("a", "b"), ("b", "c"), ("c", "a")))
    return one.join(two, "b").join(three, ["c", "a"]).select("a", "b", "c")


def common_neighbours(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """``src, dst, n_common`` of pairs with at least one shared neighbour in undirected ``links``.

    The neighbours are taken from the end that has fewer, so that a hub's are joined only with
    those of other hubs, and looked up at the other end.
    """
    both = undirected(links)
    near = both.select(F.col("src").alias("v"), F.col("dst").alias("w")).unionAll(both.select(F.col("dst").alias("v"), F.col("src").alias("w")))
    degree = near.groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    asked = undirected(pairs).join(degree.select(F.col("v").alias("src"), F.col("d").alias("ds")), "src").join(degree.select(F.col("v").alias("dst"), F.col("d").alias("dd")), "dst")
    fewer = F.col("ds") <= F.col("dd")
    turned = asked.select("src", "dst", F.when(fewer, F.col("src")).otherwise(F.col("dst")).alias("v"), F.when(fewer, F.col("dst")).otherwise(F.col("src")).alias("_other"))
    left = turned.join(near, "v").select("src", "dst", F.col("_other").alias("v"), "w")
    return left.join(near, ["v", "w"]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_common"))


def together(groups: DataFrame, members: str, pairs: DataFrame) -> DataFrame:
    """The asked pairs ``src, dst`` that are in one group, with the other columns of ``groups``.

    ``members`` is a column with the array of a group's distinct members. Pairs are made from
    the groups, whose number of pairs grows with the groups and not with what a member is in;
    of those a Bloom filter of the asked ones leaves few others, and only these are sent.
    """
    asked = checkpoint(pairs.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    n = asked.count()
    hashed = F.xxhash64("src", "dst")
    kept = [c for c in groups.columns if c != members]
    made = groups.select(*kept, members, F.explode(members).alias("src")).select(*kept, "src", F.explode(members).alias("dst"))
    if n:
        made = made.filter(might_contain(bloom_of(asked.select(hashed.alias("_h")), "_h", n), hashed))
    return made.join(broadcast_if_small(asked, n), ["src", "dst"], "left_semi")


def fan_out_count(core: DataFrame, facts: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows of ``core`` joined with every fact table, ``n``, without making them.

    ``facts`` has tables, their key, and the key of ``core``. Each is reduced to counts
    per key, and the products are summed in decimals, as they pass 2**63 soon.
    """
    joined = core
    for i, (fact, key, core_key) in enumerate(facts):
        counts = fact.groupBy(F.col(key).alias(core_key)).agg(F.count(F.lit(1)).cast("decimal(38,0)").alias(f"_n{i}"))
        joined = joined.join(counts, core_key)
    product = reduce(lambda x, y: (x * y).cast("decimal(38,0)"), [F.col(f"_n{i}") for i in range(len(facts))], F.lit(1).cast("decimal(38,0)"))
    return joined.agg(F.coalesce(F.sum(product), F.lit(0)).cast("decimal(38,0)").alias("n"))


def near_names(left: DataFrame, right: DataFrame, block: Column, most: int = 3) -> DataFrame:
    """For each ``name`` of ``left`` the nearest of ``right``, at most ``most`` edits away.

    Only names in one block are compared. Ties go to the name first in order. Returns
    ``name, match, edits``; names without a match don't come out.
    """
    l, r = left.select("name").distinct().withColumn("_b", block), right.select("name").distinct().withColumn("_b", block).withColumnRenamed("name", "match")
    # the length bounds the edits, and keeps most pairs from being compared
    pairs = l.join(r, "_b").filter(F.abs(F.length("name") - F.length("match")) <= most)
    near = pairs.withColumn("edits", F.levenshtein("name", "match", most)).filter("edits >= 0")
    return near.groupBy("name").agg(F.min(F.struct("edits", "match")).alias("m")).select("name", "m.match", "m.edits")


def block_scores(df: DataFrame, key: str, block: list[str], score, keep: int) -> DataFrame:
    """Best ``keep`` partners of each row among those in its block, ``a, b, score``.

    ``score`` maps two functions of a column name, for either side, to a column.
    """
    one, two = df.alias("x"), df.alias("y")
    same = reduce(lambda p, q: p & q, [F.col(f"x.{b}") == F.col(f"y.{b}") for b in block])
    pairs = one.join(two, same & (F.col(f"x.{key}") != F.col(f"y.{key}")))
    scored = pairs.select(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b"), score(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")).alias("score"))
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return scored.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= keep).drop("_r")


def without_one_filter(df: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """Rows left by all filters, and by all but each one, ``dropped, n``, in one pass.

    A filter that is null for a row doesn't let it pass.
    """
    passed = {name: F.coalesce(c, F.lit(False)) for name, c in filters.items()}
    every = lambda names: reduce(lambda x, y: x & y, [passed[n] for n in names], F.lit(True))
    counts = [("", F.count_if(every(passed)))] + [(k, F.count_if(every([n for n in passed if n != k]))) for k in passed]
    one = df.agg(*[c.alias(f"_{i}") for i, (_, c) in enumerate(counts)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("dropped"), F.col(f"_{i}").alias("n")) for i, (k, _) in enumerate(counts)])))


def _one_less(df: DataFrame, text: str) -> DataFrame:
    """``text`` as it is and without each one of its characters; of a run of equal ones the last."""
    at = F.expr(f"explode(sequence(0, length({text})))")
    each = df.withColumn("_at", at).filter(f"_at = 0 OR substring({text}, _at, 1) <> substring({text}, _at + 1, 1)")
    return each.withColumn(text, F.expr(f"IF(_at = 0, {text}, concat(left({text}, _at - 1), substring({text}, _at + 1)))")).drop("_at")


def _near(left: DataFrame, right: DataFrame, edits: int, halves: bool) -> DataFrame:
    """``name, match, edits`` of the nearest within ``edits``, at most 1, or 3 by halves."""
    # an equal piece is told by its hash, as the edits are counted anyway
    piece = lambda df, *kept: _one_less(df, "p").select(*kept, F.xxhash64("i", "p").alias("h"))
    if halves:
        l = left.withColumns({"i": F.expr("explode(array(0, 1))"), "size": F.length("n")})
        low, high = f"greatest((greatest(size - {edits}, 0) + i) DIV 2 - 1, 0)", f"least((size + {edits} + i) DIV 2 + 1, size)"
        l = l.withColumn("t", F.expr(f"explode(sequence({low}, {high}))")).withColumn("p", F.expr("IF(i = 0, left(n, t), right(n, t))"))
        r = right.withColumns({"i": F.expr("explode(array(0, 1))"), "size": F.length("m")}).withColumn("p", F.expr("IF(i = 0, left(m, size DIV 2), right(m, size - size DIV 2))"))
    else:
        l, r = left.withColumns({"i": F.lit(0), "p": F.col("n")}), right.withColumns({"i": F.lit(0), "p": F.col("m")})
    met = piece(l, "name", "n").distinct().join(piece(r, "match", "m"), "h").filter(f"name <> match AND abs(length(n) - length(m)) <= {edits}")
    near = met.withColumn("edits", F.levenshtein("n", "m", edits)).filter("edits >= 0")
    return near.groupBy("name").agg(F.min(F.struct("edits", "match")).alias("_m")).select("name", "_m.match", "_m.edits")


def nearest_of_all(left: DataFrame, right: DataFrame, edits: int = 3) -> DataFrame:
    """``name, match, edits``: for each ``name`` of ``left`` the nearest other one of ``right``, at most ``edits`` away (3 at most).

    Lower-cased names are compared; of equally near ones the least counts. No pair is
    missed: two names one edit apart are the same where each lost a character at most.
    The names without one so near are looked up by halves: of 3 edits one half of the
    other name has one at most, and it begins or ends this one.
    """
    if not 1 <= edits <= 3:
        raise ValueError("edits must be 1, 2 or 3")
    r = right.select(F.col("name").alias("match")).filter("match IS NOT NULL").distinct().withColumn("m", F.lower("match"))
    l = left.select("name").filter("name IS NOT NULL").distinct().withColumn("n", F.lower("name"))
    if edits == 1:
        return _near(l, r, 1, False)
    # read by both steps
    l, r = checkpoint(l), checkpoint(r)
    found = checkpoint(_near(l, r, 1, False))
    return found.unionByName(_near(l.join(found, "name", "left_anti"), r, edits, True))
