"""Tables of a film database made from the working tables: credits, attribute rows, name variants, ranks and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import clip, key_uniform, long_date, normalize_name, null_if_missing, role_of_gender
from weftline.operators.ranking import dense_ids

#: Role of directors, and ids of attributes.
DIRECTOR_ROLE = 8
RELEASE, VOTES, RATING, TOP, BOTTOM = 16, 100, 101, 112, 113
NATIONALITY, CAREER, BIRTH = 201, 203, 21
CAST, CREW, COMPLETE, VERIFIED = 1, 2, 3, 4
#: What a production tier adds to the completeness of a cast.
TIER_BONUS = {"Epic": 0.55, "A": 0.40, "Mid": 0.25, "Indie": 0.15, "Micro": 0.05}
OTHER_TIER = 0.2


def credits(actors: DataFrame, directors: DataFrame, crew: DataFrame | None = None) -> DataFrame:
    """``id, movie_id, person_id, role_id, nr_order, note`` of actors, directors and crew under one numbering.

    ``actors`` has ``movie_id, person_id, gender, nr_order``, ``directors`` has ``movie_id,
    person_id`` and ``crew`` ``movie_id, person_id, role_id, nr_order, note``. Ids follow
    role group, film, order and person, so they are the same on every run. A person without
    known gender has the role of men; rows without film or person are left out.
    """
    none = F.lit(None).cast("string")
    parts = [
        actors.select(F.lit(1).alias("part"), "movie_id", "person_id", F.coalesce(role_of_gender(F.col("gender")), F.lit(1)).alias("role_id"), F.col("nr_order").cast("int").alias("nr_order"), none.alias("note")),
        directors.select(F.lit(2).alias("part"), "movie_id", "person_id", F.lit(DIRECTOR_ROLE).alias("role_id"), F.lit(1).alias("nr_order"), none.alias("note")),
    ]
    if crew is not None:
        parts.append(crew.select(F.lit(3).alias("part"), "movie_id", "person_id", "role_id", F.col("nr_order").cast("int").alias("nr_order"), "note"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    union = union.filter("movie_id IS NOT NULL AND person_id IS NOT NULL").distinct()
    return dense_ids(union, ["part", "movie_id", "nr_order", "person_id", "role_id", "note"]).drop("part")


def release_rows(df: DataFrame, key: str, country: Column, date: Column, kind: Column) -> DataFrame:
    """``key, info_type_id, info, note``: "country:5 March 1999" with the kind of release, or a note drawn by the key.

    A text that is no date stays as it is; a missing one gives no row.
    """
    text = null_if_missing(date)
    drawn = (F.col(key).cast("bigint") * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFF)) / F.lit(float(0xFFFF))
    note = F.when(null_if_missing(kind).isNotNull(), F.concat(F.lit("("), F.trim(kind), F.lit(")"))).otherwise(
        F.when(drawn < 0.05, "(internet)").when(drawn < 0.10, "(limited)").when(drawn < 0.14, "(premiere)")
    )
    info = F.concat(F.coalesce(null_if_missing(country), F.lit("USA")), F.lit(":"), F.coalesce(long_date(text), text))
    return df.filter(text.isNotNull()).select(key, F.lit(RELEASE).alias("info_type_id"), info.alias("info"), note.alias("note"))


def rating_rows(films: DataFrame, top: int = 250, bottom: int = 10, share: float = 0.10) -> DataFrame:
    """``movie_id, info_type_id, info`` of votes, ratings and ranks; ``films`` has ``movie_id, rating, votes``.

    Ranked are films with a rating and at least so many votes as all but ``share`` of the
    rated films (interpolated); ties go to more votes, then to the lower id. Only the
    films that get a rank are sorted into one task.
    """
    rows = F.array(
        F.struct(F.lit(RATING).alias("info_type_id"), F.format_string("%.1f", F.col("rating")).alias("info"), F.col("rating").isNotNull().alias("_has")),
        F.struct(F.lit(VOTES).alias("info_type_id"), F.col("votes").cast("string").alias("info"), F.col("votes").isNotNull().alias("_has")),
    )
    plain = films.select("movie_id", F.inline(rows)).filter("_has").drop("_has")
    rated = films.filter("rating IS NOT NULL").withColumn("votes", F.coalesce("votes", F.lit(0).cast("bigint")))
    least = rated.agg(F.percentile("votes", F.lit(share))).scalar()
    eligible = rated.filter(F.col("votes") >= least)

    def ranked(n: int, kind: int, order: list[Column]) -> DataFrame:
        chosen = eligible.orderBy(*order).limit(n)
        return chosen.select("movie_id", F.lit(kind).alias("info_type_id"), F.row_number().over(Window.orderBy(*order)).cast("string").alias("info"))

    best = ranked(top, TOP, [F.desc("rating"), F.desc("votes"), F.asc("movie_id")])
    worst = ranked(bottom, BOTTOM, [F.asc("rating"), F.asc("votes"), F.asc("movie_id")])
    return plain.unionByName(best).unionByName(worst)


def name_variants(people: DataFrame, share: float = 0.12, one: float = 0.72, seed: int = 42) -> DataFrame:
    """``person_id, name, md5sum``: other forms of the names of a drawn share of people, one or two each.

    "F. Last", "Last, First" and "First L"; a name of one word is doubled. Which people,
    how many and which forms follows from the seed and the id.
    """
    words = F.split(F.regexp_replace(normalize_name(F.col("name")), "-", " "), " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    forms = F.when(F.size(words) == 1, F.array(F.concat_ws(" ", first, first))).otherwise(
        F.array(F.concat(F.left(first, F.lit(1)), F.lit(". "), last), F.concat_ws(", ", last, first), F.concat(first, F.lit(" "), F.left(last, F.lit(1))))
    )
    drawn = people.filter(F.col("name").isNotNull() & (F.trim("name") != "")).filter(key_uniform(seed, F.col("person_id"), F.lit("who")) < share)
    shuffled = F.array_sort(F.transform(forms, lambda f: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("person_id").cast("string"), f)).alias("h"), f.alias("f"))))
    take = F.when(key_uniform(seed, F.col("person_id"), F.lit("many")) < one, 1).otherwise(2)
    variants = drawn.select("person_id", F.col("name").alias("_full"), F.explode(F.slice(shuffled, F.lit(1), take)).alias("v"))
    return variants.filter(F.col("v.f") != F.col("_full")).select("person_id", F.col("v.f").alias("name"), F.md5("v.f").alias("md5sum"))


def completeness(films: DataFrame, seed: int = 42) -> DataFrame:
    """``movie_id, subject_id, status_id`` of each film's cast and crew; ``films`` has ``movie_id, tier, n_cast, n_crew``.

    The chance to be verified rises with the sizes and the tier; a film without crew has a
    row for it in 42 of 100 cases. Null sizes count as 0.
    """
    n_cast, n_crew = F.coalesce("n_cast", F.lit(0)), F.coalesce("n_crew", F.lit(0))
    tiers = F.create_map(*[F.lit(x) for kv in TIER_BONUS.items() for x in kv])
    score = F.log1p(n_cast) * 0.25 + F.log1p(n_crew) * 0.18 + F.coalesce(F.try_element_at(tiers, F.col("tier")), F.lit(OTHER_TIER))
    chance = clip(0.12 + 0.22 * score, 0.08, 0.90)
    of_crew = clip(chance - 0.08 + F.when(n_crew > 4, 0.03).otherwise(0.0), 0.05, 0.85)
    draw = lambda what: key_uniform(seed, F.col("movie_id"), F.lit(what))
    status = lambda p, what: F.when(draw(what) < p, VERIFIED).otherwise(COMPLETE)
    rows = F.array(
        F.struct(F.lit(CAST).alias("subject_id"), status(chance, "cast").alias("status_id"), F.lit(True).alias("_has")),
        F.struct(F.lit(CREW).alias("subject_id"), status(of_crew, "crew").alias("status_id"), ((n_crew > 0) | (draw("any") < 0.42)).alias("_has")),
    )
    return films.select("movie_id", F.inline(rows)).filter("_has").drop("_has")


def ranked_by_risk(df: DataFrame, flags: dict[str, tuple[Column, float]], order: list[str], keep: int | None = None) -> DataFrame:
    """The table with ``risk``, the sum of the weights of the flags a row has, and ``place`` from the riskiest down.

    Ties follow ``order``, which has to tell rows apart; a null flag is none. ``keep`` is for reports of the first so many.
    """
    score = sum((F.when(flag, F.lit(weight)).otherwise(0.0) for flag, weight in flags.values()), F.lit(0.0))
    scored = df.withColumn("risk", F.round(score, 6)).withColumn("_less", -F.col("risk"))
    if keep is not None:
        scored = scored.orderBy("_less", *order).limit(keep)
    return dense_ids(scored, ["_less", *order], "place").drop("_less")
