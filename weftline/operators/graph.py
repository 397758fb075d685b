"""The temporal property graph: versions with validity, closures, batches of changes, and inference.

Versions are append-only rows ``row_id, src, dst, kind, w, vf, vt, retired``; a closure
row ends one of them. State is always read through :func:`as_of`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import key_uniform
from weftline.operators.intervals import UNDIRECTED
from weftline.operators.overlaps import common_members
from weftline.session import checkpoint, parallelism

#: Changes folded at once.
KEYS_AT_ONCE = 50_000
#: Kinds with a negative sign.
NEGATIVE = ("rivalry", "avoid", "blacklist", "market_rival")


def canonical(edges: DataFrame) -> DataFrame:
    """Kinds without direction take the smaller id first."""
    swap = F.col("kind").isin(*UNDIRECTED) & (F.col("src") > F.col("dst"))
    return edges.withColumns({"src": F.when(swap, F.col("dst")).otherwise(F.col("src")), "dst": F.when(swap, F.col("src")).otherwise(F.col("dst"))})


def sign_of(kind: Column, sign: Column) -> Column:
    """An explicit "+" or "-" counts, else the kind's own."""
    return F.when(sign.isin("+", "-"), sign).otherwise(F.when(kind.isin(*NEGATIVE), "-").otherwise("+"))


def active(year: Column | int, null_from: str = "open") -> Column:
    """A version's activity in a year: both ends count, but a retired one's last year belongs to its successor.

    A null ``vt`` is open; a null ``vf`` is open too, or with "never" the version is never active.
    """
    year = F.lit(year) if isinstance(year, int) else year
    begun = F.coalesce(F.col("vf") <= year, F.lit(null_from == "open"))
    going = F.col("vt").isNull() | F.when(F.coalesce("retired", F.lit(False)), year < F.col("vt")).otherwise(year <= F.col("vt"))
    return begun & going


def as_of(versions: DataFrame, year: int, null_from: str = "open") -> DataFrame:
    return versions.filter(active(year, null_from))


def with_closures(versions: DataFrame, closures: DataFrame) -> DataFrame:
    """Versions after all closures; of several closures of a row the last by ``seq`` counts."""
    last = closures.groupBy("row_id").agg(F.max_by(F.struct("vt", "retired"), "seq").alias("_c"))
    joined = versions.join(last, "row_id", "left")
    return joined.withColumns({"vt": F.coalesce("_c.vt", "vt"), "retired": F.coalesce("_c.retired", "retired")}).drop("_c")


def neighbours(versions: DataFrame, kind: str, year: int) -> DataFrame:
    """``v, w, weight`` of active edges of a kind, both ways for kinds without direction."""
    now = as_of(versions.filter(F.col("kind") == kind), year)
    forth = now.select(F.col("src").alias("v"), F.col("dst").alias("w"), F.col("w").alias("weight"))
    if kind not in UNDIRECTED:
        return forth
    return forth.unionAll(now.select(F.col("dst").alias("v"), F.col("src").alias("w"), F.col("w").alias("weight"))).distinct()


def apply_batch(versions: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies changes in the order of ``seq``, each key's on their own.

    ``ops`` has ``seq, mode, kind, src, dst, weight, delta, year``. "add" is skipped if
    the key is active in the year; "update" closes the active version in the year and
    opens one with the weight moved by ``delta``, held to [0, 1]; any other mode closes
    it. Changes of a missing key are skipped. Returns the versions after it, where new
    ones have a null ``row_id``, and ``seq, status``. Only keys with changes are folded.
    """
    keys = ["kind", "src", "dst"]
    # names of their own, as changes are often made from the versions
    ops = canonical(ops.select(*[F.col(c).alias(c) for c in ops.columns]))
    base = canonical(versions)
    touched = base.join(ops.select(*keys).distinct(), keys, "left_semi")
    rest = base.join(ops.select(*keys).distinct(), keys, "left_anti")
    fields = "row_id long, kind string, src long, dst long, w double, vf int, vt int, retired boolean, seq long, status string"

    def fold_key(key: tuple, rows: list[dict], changes: list[dict]) -> list[dict]:
        log = []
        for c in sorted(changes, key=lambda c: c["seq"]):
            year = c["year"]
            live = [r for r in rows if r["vt"] is None or (year < r["vt"] if r["retired"] else year <= r["vt"])]
            begun = [r for r in live if r["vf"] is None or r["vf"] <= year]
            fresh = {"kind": key[0], "src": key[1], "dst": key[2], "vf": year, "retired": False}
            status = "applied"
            if c["mode"] == "add":
                if begun:
                    status = "skipped"
                else:
                    rows.append(fresh | {"w": c["weight"]})
            elif not live:
                status = "skipped"
            else:
                old = (begun or live)[-1]
                old.update(vt=year, retired=True)
                if c["mode"] == "update":
                    rows.append(fresh | {"w": min(1.0, max(0.0, (old["w"] or 0.0) + (c["delta"] or 0.0)))})
            for r in rows:
                r.setdefault("vt", None)
            log.append({"seq": c["seq"], "status": status})
        return rows + log

    def fold(have, changes):
        import pyarrow as pa

        names = {"row_id": pa.int64(), "kind": pa.string(), "src": pa.int64(), "dst": pa.int64(), "w": pa.float64(), "vf": pa.int32(), "vt": pa.int32(), "retired": pa.bool_(), "seq": pa.int64(), "status": pa.string()}
        by: dict = {}
        for side, table in enumerate((have, changes)):
            for r in table.drop_columns(["_bucket"]).to_pylist():
                by.setdefault((r["kind"], r["src"], r["dst"]), ([], []))[side].append(r)
        out = [r for key, (rows, ops_) in by.items() for r in fold_key(key, sorted(rows, key=lambda r: r["row_id"] or 0), ops_)]
        return pa.table({n: pa.array([r.get(n) for r in out], t) for n, t in names.items()})

    # keys are folded by the bucket, as a call for each takes longer than the fold itself
    buckets = max(parallelism(versions.sparkSession), -(-ops.count() // KEYS_AT_ONCE))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket")
    have = touched.select("row_id", *keys, F.col("w").cast("double").alias("w"), "vf", "vt", "retired", bucket)
    asked = ops.select("*", bucket)
    folded = checkpoint(have.groupBy("_bucket").cogroup(asked.groupBy("_bucket")).applyInArrow(fold, fields))
    changed = folded.filter("seq IS NULL").drop("seq", "status")
    same = rest.select("row_id", *keys, F.col("w").cast("double").alias("w"), "vf", "vt", "retired")
    return same.unionByName(changed), folded.filter("seq IS NOT NULL").select("seq", "status")


def contradicted(versions: DataFrame) -> DataFrame:
    """Friendships of pairs that are rivals too."""
    pairs = canonical(versions)
    rivals = pairs.filter("kind = 'rivalry'").select("src", "dst").distinct()
    return pairs.filter("kind = 'friendship'").join(rivals, ["src", "dst"], "left_semi")


def transitive_pairs(pairs: DataFrame) -> DataFrame:
    """``src < dst`` with a common neighbour and no link of their own, ``n_via``; ``pairs`` are undirected ones."""
    both = pairs.select(F.col("src").alias("id"), F.col("dst").alias("member")).unionAll(pairs.select(F.col("dst").alias("id"), F.col("src").alias("member")))
    return common_members(both, unlinked=True).toDF("src", "dst", "n_via")


def triadic_closure(pairs: DataFrame, chance: float, most: int = 8, seed: int = 42) -> DataFrame:
    """Unlinked pairs with a mutual neighbour, drawn with a chance, at most ``most`` for the smaller id."""
    both = pairs.select(F.col("src").alias("id"), F.col("dst").alias("member")).unionAll(pairs.select(F.col("dst").alias("id"), F.col("src").alias("member")))
    return common_members(both, unlinked=True, chance=chance, most=most, seed=seed).toDF("src", "dst", "n_via")


def shared_tag_pairs(people: DataFrame, least: int = 3, per_tag: int = 200) -> DataFrame:
    """``a, b, n_shared`` of people with at least ``least`` common tags.

    ``people`` has ``id, tags`` (an array). By its meaning only the first ``per_tag``
    people of a tag, by id, are compared, which also bounds the pairs of a tag.
    """
    each = people.select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy("id"))
    kept = each.withColumn("_r", rank).filter(F.col("_r") <= per_tag).drop("_r")
    x, y = kept.alias("x"), kept.alias("y")
    pairs = x.join(y, (F.col("x.tag") == F.col("y.tag")) & (F.col("x.id") < F.col("y.id")))
    return pairs.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count(F.lit(1)).alias("n_shared")).filter(F.col("n_shared") >= least)


def degrees(versions: DataFrame) -> DataFrame:
    """``v, degree`` over both ends."""
    return versions.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))


def components(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """``v, component`` of an undirected graph, the component's least vertex.

    Alternates links to the least neighbour until every vertex points to its least one,
    in some log-many rounds; each is written, and vertices stay spread over all tasks.
    """
    links = checkpoint(pairs.filter("src <> dst").select("src", "dst").distinct())
    vertices = links.select(F.explode(F.array("src", "dst")).alias("v")).distinct()

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.select(F.col("src").alias("v"), F.col("dst").alias("w")).unionAll(links.select(F.col("dst").alias("v"), F.col("src").alias("w")))
        if not large:
            both = both.filter("w < v")
        least = both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
        moved = both.join(least, "v")
        out = moved.filter("w > v AND w <> m" if large else "w <> m").select(F.greatest("w", "m").alias("src"), F.least("w", "m").alias("dst"))
        if not large:
            out = out.unionAll(moved.filter("v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst")))
        return out.distinct()

    before = None
    for _ in range(rounds):
        links = checkpoint(star(star(links, True), False))
        sign = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if sign == before:
            break
        before = sign
    least = links.groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("m"))
    return vertices.join(least, "v", "left").select("v", F.coalesce("m", "v").alias("component"))


def label_propagation(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """``v, label, stable, rounds``: each vertex takes the label with the most weight among its neighbours, the least of equals.

    All vertices move at once, but one that would go back to the label it has just left
    moves only in the rounds that its hash draws, as pairs would change places for ever.
    Ends when none would move, or after ``rounds``; ``stable`` says whether the vertex
    would have stayed in the last of the ``rounds`` made. ``pairs`` has ``src, dst,
    weight``; with decimal weights the sums don't depend on their order.
    """
    both = checkpoint(
        pairs.filter("src <> dst").select(F.col("src").alias("v"), F.col("dst").alias("w"), "weight").unionAll(
            pairs.filter("src <> dst").select(F.col("dst").alias("v"), F.col("src").alias("w"), "weight"))
    )
    state = both.select("v").distinct().select("v", F.col("v").alias("label"), F.lit(None).cast(both.schema["v"].dataType).alias("old"))
    made = 0
    for made in range(1, rounds + 1):
        votes = both.join(state.select(F.col("v").alias("w"), "label"), "w").groupBy("v", "label").agg(F.sum("weight").alias("s"))
        best = votes.groupBy("v").agg(F.max(F.struct("s", (-F.col("label")).alias("n"))).alias("b")).select("v", (-F.col("b.n")).alias("best"))
        back = F.coalesce(F.col("best") == F.col("old"), F.lit(False))
        goes = (F.col("best") != F.col("label")) & (~back | (F.pmod(F.xxhash64("v", F.lit(made)), F.lit(2)) == 0))
        # one that stays keeps the label it came from, or it would count as moving on
        moved = state.join(best, "v").select(
            "v", F.when(goes, F.col("best")).otherwise(F.col("label")).alias("label"),
            F.when(goes, F.col("label")).otherwise(F.col("old")).alias("old"), (F.col("best") == F.col("label")).alias("stable"),
        )
        state = checkpoint(moved)
        if not state.filter("NOT stable").count():
            break
    return state.select("v", "label", "stable" if made else F.lit(False).alias("stable"), F.lit(made).alias("rounds"))


def fill_community(people: DataFrame, communities: DataFrame) -> DataFrame:
    """People without a community get one of the existing ones by the hash of their id.

    ``people`` has ``id, community``; ``communities`` has ``nth`` from 0 and ``community``.
    """
    n = communities.agg(F.count(F.lit(1))).scalar()
    slot = F.pmod(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint"), n)
    missing = people.filter("community IS NULL").select("id", slot.alias("nth"))
    filled = missing.join(communities, "nth").select("id", "community")
    return people.filter("community IS NOT NULL").select("id", "community").unionByName(filled)


def induced(versions: DataFrame, members: DataFrame) -> DataFrame:
    """Versions with both ends among ``members`` (``id``)."""
    ids = members.select("id").distinct()
    return versions.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def similarity(style, genres, tags, scalars, budget, style_kind) -> Column:
    """Weighted likeness of two people from six parts; cosines are held to [0, 1]. Each part is a pair of columns."""
    from weftline.functions.scalars import clip, cosine, jaccard

    close = 1 - sum((F.abs(a - b) for a, b in scalars), F.lit(0.0)) / max(1, len(scalars))
    return (
        0.35 * clip(cosine(*style), 0, 1) + 0.20 * jaccard(*genres) + 0.15 * jaccard(*tags) + 0.15 * clip(close, 0, 1)
        + 0.10 * clip(cosine(*budget), 0, 1) + 0.05 * F.coalesce((style_kind[0] == style_kind[1]).cast("double"), F.lit(0.0))
    )


def active_or_all(versions: DataFrame, year: int, keys: list[str], null_from: str = "open") -> DataFrame:
    """The versions active in a year, with ``active``; a group of ``keys`` without any active one keeps all of its own.

    One aggregate of a flag per group, joined back; null keys are left out.
    """
    marked = versions.withColumn("active", F.coalesce(active(year, null_from), F.lit(False)))
    any_active = marked.groupBy(*keys).agg(F.max("active").alias("_any"))
    return marked.join(any_active, keys).filter(F.col("active") | ~F.col("_any")).drop("_any")


def recent(df: DataFrame, key: str, at: str, order: str, hours: int, last: int) -> DataFrame:
    """The ``last`` rows of each key within ``hours`` of the table's latest moment; ties go to the greater ``order``."""
    latest = df.agg(F.max(at)).first()[0]
    if latest is None:
        return df.limit(0)
    fresh = df.filter(F.col(at) > F.lit(latest) - F.make_interval(hours=F.lit(hours)))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(order)))
    return fresh.withColumn("_r", place).filter(F.col("_r") <= last).drop("_r")


def bucketed(versions: DataFrame, buckets: dict[str, tuple[str, ...]]) -> DataFrame:
    """``v, bucket, n, least, most``: how many others each vertex has in each bucket of kinds, with the ends of their range."""
    bucket = F.coalesce(*[F.when(F.col("kind").isin(*kinds), name) for name, kinds in buckets.items()])
    both = F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("w")), F.struct(F.col("dst").alias("v"), F.col("src").alias("w")))
    others = versions.select(bucket.alias("bucket"), F.inline(both)).filter("bucket IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL").distinct()
    return others.groupBy("v", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("least"), F.max("w").alias("most"))


def pair_metrics(pairs: DataFrame, people: DataFrame, films: DataFrame) -> DataFrame:
    """Features of given pairs ``x, y`` from ``people`` (``id, debut, tags, nationality, pop``) and ``films`` (``title_id, person``).

    Pairs without both records are left out. Common films are found from the side of the
    film, over its people that are in a pair, so nobody's films are joined with anything.
    """
    from weftline.functions.scalars import jaccard, split_list
    from weftline.operators.joins import together

    one = lambda end, tag: people.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{tag}") for c in ("debut", "tags", "nationality", "pop")])
    asked = pairs.select(F.explode(F.array("x", "y")).alias("person")).distinct()
    theirs = films.join(asked, "person", "left_semi")
    n = theirs.groupBy("person").agg(F.count(F.lit(1)).alias("n"))
    casts = theirs.groupBy("title_id").agg(F.collect_set("person").alias("people"))
    met = together(casts, "people", pairs.select(F.col("x").alias("src"), F.col("y").alias("dst")))
    common = met.groupBy(F.col("src").alias("x"), F.col("dst").alias("y")).agg(F.count(F.lit(1)).alias("n_films"))
    joined = pairs.join(one("x", "a"), "x").join(one("y", "b"), "y").join(common, ["x", "y"], "left")
    joined = joined.join(n.select(F.col("person").alias("x"), F.col("n").alias("films_a")), "x", "left").join(n.select(F.col("person").alias("y"), F.col("n").alias("films_b")), "y", "left")
    tags = jaccard(F.array_distinct(split_list(F.col("tags_a"))), F.array_distinct(split_list(F.col("tags_b"))))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return joined.select(
        "x", "y", F.abs(F.col("debut_a") - F.col("debut_b")).alias("debut_gap"), F.round(tags, 6).alias("tags"),
        F.coalesce(F.col("nationality_a") == F.col("nationality_b"), F.lit(False)).alias("same_nation"),
        F.round(F.abs(F.col("pop_a") - F.col("pop_b")), 6).alias("pop_gap"), zero("n_films"), zero("films_a"), zero("films_b"),
    )


def compacted(versions: DataFrame, keys: list[str], dead: Column, slots: int = 100_000, dead_share: float = 0.3) -> DataFrame:
    """The versions without the dead ones of those groups that are due: with ``slots`` rows, or ``dead_share`` of them dead.

    Adds ``_n`` and ``_dead``, the sizes before. The state of the living is the same before and after.
    """
    marked = versions.withColumn("_is_dead", dead)
    sizes = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_is_dead").alias("_dead"))
    due = (F.col("_n") >= slots) | (F.col("_dead") >= dead_share * F.col("_n"))
    return marked.join(sizes, keys).filter(~(F.col("_is_dead") & due)).drop("_is_dead")


def soft_active(year: int, seed: int = 42) -> Column:
    """Active in the year and drawn with a chance that rises with the weight."""
    return active(year) & (key_uniform(seed, F.col("row_id"), F.lit(year)) < 0.3 + 0.7 * F.coalesce("w", F.lit(0.0)))

