"""Tables with a fixed contract: columns, types, keys and references, and the literal dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the 21 core tables in order; "i" is int, others are text.
CORE = {
    "title": "id:i title imdb_index kind_id:i production_year:i imdb_id:i phonetic_code episode_of_id:i season_nr:i episode_nr:i series_years md5sum",
    "name": "id:i name imdb_index imdb_id:i gender name_pcode_cf name_pcode_nf surname_pcode md5sum",
    "cast_info": "id:i person_id:i movie_id:i person_role_id:i note nr_order:i role_id:i",
    "char_name": "id:i name imdb_index imdb_id:i name_pcode_nf surname_pcode md5sum",
    "company_name": "id:i name country_code imdb_id:i name_pcode_nf name_pcode_sf md5sum",
    "movie_companies": "id:i movie_id:i company_id:i company_type_id:i note",
    "movie_keyword": "id:i movie_id:i keyword_id:i",
    "keyword": "id:i keyword phonetic_code",
    "movie_link": "id:i movie_id:i linked_movie_id:i link_type_id:i",
    "aka_title": "id:i movie_id:i title imdb_index kind_id:i production_year:i phonetic_code episode_of_id:i season_nr:i episode_nr:i note md5sum",
    "aka_name": "id:i person_id:i name imdb_index name_pcode_cf name_pcode_nf surname_pcode md5sum",
    "movie_info": "id:i movie_id:i info_type_id:i info note",
    "movie_info_idx": "id:i movie_id:i info_type_id:i info note",
    "person_info": "id:i person_id:i info_type_id:i info note",
    "info_type": "id:i info",
    "kind_type": "id:i kind",
    "role_type": "id:i role",
    "company_type": "id:i kind",
    "link_type": "id:i link",
    "complete_cast": "id:i movie_id:i subject_id:i status_id:i",
    "comp_cast_type": "id:i kind",
}
#: References of the core tables: column to table, always to its id.
REFERENCES = {
    ("cast_info", "movie_id"): "title", ("cast_info", "person_id"): "name", ("cast_info", "person_role_id"): "char_name",
    ("cast_info", "role_id"): "role_type", ("movie_companies", "movie_id"): "title", ("movie_companies", "company_id"): "company_name",
    ("movie_companies", "company_type_id"): "company_type", ("movie_keyword", "movie_id"): "title", ("movie_keyword", "keyword_id"): "keyword",
    ("movie_link", "movie_id"): "title", ("movie_link", "linked_movie_id"): "title", ("movie_link", "link_type_id"): "link_type",
    ("aka_title", "movie_id"): "title", ("aka_name", "person_id"): "name", ("movie_info", "movie_id"): "title",
    ("movie_info", "info_type_id"): "info_type", ("movie_info_idx", "movie_id"): "title", ("person_info", "person_id"): "name",
    ("complete_cast", "movie_id"): "title", ("title", "kind_id"): "kind_type", ("title", "episode_of_id"): "title",
}
#: The ids of the small dimensions.
DIMENSIONS = {
    "kind_type": {1: "movie", 2: "tv series", 3: "tv movie", 4: "video movie", 5: "tv mini series", 6: "video game", 7: "episode"},
    "role_type": {1: "actor", 2: "actress", 3: "producer", 4: "writer", 5: "cinematographer", 6: "composer", 7: "costume designer", 8: "director", 9: "editor", 10: "miscellaneous crew", 11: "production designer", 12: "guest"},
    "company_type": {1: "distributors", 2: "production companies", 3: "special effects companies", 4: "miscellaneous companies"},
    "link_type": {1: "follows", 2: "followed by", 3: "remake of", 4: "remade as", 5: "references", 6: "referenced in", 7: "spoofs", 8: "spoofed in", 9: "features", 10: "featured in", 11: "spin off from", 12: "spin off", 13: "version of", 14: "similar to", 15: "edited into", 16: "edited from", 17: "alternate language version of", 18: "unknown link"},
    "comp_cast_type": {1: "cast", 2: "crew", 3: "complete", 4: "complete+verified"},
    "info_type": {1: "runtimes", 2: "color info", 3: "genres", 4: "languages", 5: "certificates", 8: "countries", 16: "release dates", 17: "trivia", 100: "votes", 101: "rating", 105: "budget", 107: "gross", 112: "top 250 rank", 113: "bottom 10 rank"},
}


def core_schema(name: str) -> T.StructType:
    """Schema of a core table; KeyError for an unknown one."""
    fields = (c.partition(":") for c in CORE[name].split())
    return T.StructType([T.StructField(c, T.IntegerType() if k else T.StringType()) for c, _, k in fields])


def dimension(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(list(DIMENSIONS[name].items()), core_schema(name))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a contract in its order: missing ones are null, others are dropped, values are cast if they can be."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def differences(df: DataFrame, schema: T.StructType) -> list[str]:
    """What keeps a table from its contract: order, names or types of columns."""
    want = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return [f"{i}: {w} expected, {h} found" for i, (w, h) in enumerate(zip(want + [None] * len(have), have + [None] * len(want))) if w != h]


def broken_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, n_keys``: distinct keys without a parent, of the references whose tables are given."""
    parts = []
    for (child, column), parent in REFERENCES.items():
        if child in tables and parent in tables:
            keys = tables[child].filter(F.col(column).isNotNull()).select(F.col(column).alias("key")).distinct()
            orphans = keys.join(tables[parent].select(F.col("id").alias("key")), "key", "left_anti")
            parts.append(orphans.agg(F.count(F.lit(1)).alias("n_keys")).select(F.lit(child).alias("table_name"), F.lit(column).alias("column_name"), "n_keys"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
