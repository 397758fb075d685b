"""Scalar expressions: lenient casts, text, phonetics, hashing, dates, arrays and vectors.

All are native column expressions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for a missing attribute.
MISSING = ("", "nan")
#: True in text columns.
TRUE_WORDS = ("1", "true", "yes", "y")


def null_if_missing(c: Column) -> Column:
    """Trimmed text, null for empty text and "nan"."""
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin(*MISSING), text)


def lenient_int(c: Column) -> Column:
    """Whole number of a text such as "7" or "7.0", truncated; null where there is none."""
    number = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 9.2e18), F.signum(number) * F.floor(F.abs(number))).cast("bigint")


def lenient_double(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def lenient_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def text_to(c: Column, kind: str) -> Column:
    """Load-as-text column to a type: empty text is null, and so is what can't be cast."""
    return F.nullif(F.trim(c), F.lit("")).try_cast(kind)


def split_list(c: Column) -> Column:
    """Items of a list delimited by ``;``, ``,`` or ``|``, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"[;,|]"), lambda x: F.trim(x)), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def has_control_chars(c: Column) -> Column:
    return c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def first_last(c: Column) -> Column:
    """``first, last`` of "Last, First" or "First Last"; one word is a last name."""
    name = F.trim(c)
    comma = F.instr(name, ",") > 0
    words = F.split(name, r"\s+")
    last = F.when(comma, F.trim(F.substring_index(name, ",", 1))).otherwise(F.element_at(words, -1))
    first = F.when(comma, F.trim(F.regexp_replace(name, "^[^,]*,", ""))).otherwise(
        F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    )
    return F.struct(first.alias("first"), last.alias("last"))


def normalize_name(c: Column) -> Column:
    """Plain quotes, single blanks, no outer blanks."""
    quotes = F.translate(c, "‘’“”`", "''\"\"'")
    return F.trim(F.regexp_replace(quotes, r"\s+", " "))


def phonetic_code(c: Column, length: int = 5) -> Column:
    """Sound code of up to ``length`` signs, without padding.

    A letter with the code of the letter just before it is skipped; letters without a
    code, h and w among them, end such a run. Empty if there is no letter.
    """
    letters = F.regexp_replace(F.upper(c), r"[^\p{L}]", "")
    codes = F.translate(letters, "BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000000")
    runs = F.regexp_replace(F.regexp_replace(codes, r"[^0-6]", "0"), r"(.)\1+", "$1")
    tail = F.replace(F.substring(runs, 2, 1_000_000), F.lit("0"), F.lit(""))
    return F.concat(F.left(letters, F.lit(1)), F.left(tail, F.lit(length - 1)))


def md5_bucket(c: Column, buckets: int) -> Column:
    """Bucket from 1 to ``buckets`` by the first eight hex digits of the md5."""
    return (F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets + 1).cast("int")


def knuth_uniform(n: Column) -> Column:
    """A number in [0, 1) from a whole number by multiplicative hashing."""
    mixed = (n.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF))
    return mixed.cast("double") / F.lit(2.0**32)


def key_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends only on the seed and the keys, equal on every run."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def offset_date(iso: Column, days: Column | int) -> Column:
    """ISO date text moved by days; null where the text is no date."""
    days = F.lit(days) if isinstance(days, int) else days
    return F.date_format(F.date_add(iso.try_cast("date"), days.cast("int")), "yyyy-MM-dd")


def months_before(iso: Column, months: int) -> Column:
    return F.date_format(F.add_months(iso.try_cast("date"), -months), "yyyy-MM-dd")


def long_date(iso: Column) -> Column:
    """"5 March 1999" of an ISO date text."""
    return F.date_format(iso.try_cast("date"), "d MMMM yyyy")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def year_bucket(year: Column, width: int) -> Column:
    """"1990-1999" for a width of 10."""
    low = (F.floor(year / width) * width).cast("int")
    return F.concat_ws("-", low.cast("string"), (low + width - 1).cast("string"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets; 0 if both are empty, null if one is null."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    norm = l2_norm(a)
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has no length."""
    size = l2_norm(a) * l2_norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def bit_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two bit sets; 0 if both are empty."""
    union = F.bit_count(a.bitwiseOR(b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.bit_count(a.bitwiseAND(b)) / union)


def normalize_weights(weights: Column, floor: float = 0.0) -> Column:
    """Map of weights to shares that sum to 1; uniform if nothing is above the floor."""
    cut = F.transform_values(weights, lambda _, v: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(floor)))
    total = F.aggregate(F.map_values(cut), F.lit(0.0), lambda s, x: s + x)
    return F.transform_values(cut, lambda _, v: F.when(total > 0, v / total).otherwise(1.0 / F.size(F.map_keys(weights))))


def money(c: Column) -> Column:
    """"$1,234,567" of a number."""
    return F.concat(F.lit("$"), F.format_number(c, 0))


#: Country names and their codes; others count as us.
COUNTRY_CODES = {
    "USA": "us", "United States": "us", "UK": "gb", "United Kingdom": "gb", "India": "in", "Japan": "jp",
    "South Korea": "kr", "Korea": "kr", "China": "cn", "France": "fr", "Germany": "de", "Italy": "it", "Spain": "es",
    "Canada": "ca", "Australia": "au", "Brazil": "br", "Mexico": "mx", "Russia": "ru", "Sweden": "se", "Denmark": "dk",
    "Norway": "no", "Finland": "fi", "Netherlands": "nl", "Belgium": "be", "Switzerland": "ch", "Austria": "at",
    "Portugal": "pt", "Czech Republic": "cz", "Hungary": "hu", "Romania": "ro", "Ukraine": "ua", "Poland": "pl",
    "Turkey": "tr", "Greece": "gr", "Argentina": "ar", "Colombia": "co", "Chile": "cl", "Peru": "pe", "Egypt": "eg",
    "South Africa": "za", "Nigeria": "ng", "Kenya": "ke", "Morocco": "ma", "Thailand": "th", "Indonesia": "id",
    "Philippines": "ph", "Vietnam": "vn", "Malaysia": "my", "Singapore": "sg", "Iran": "ir", "Israel": "il",
    "Saudi Arabia": "sa", "UAE": "ae", "Pakistan": "pk", "Bangladesh": "bd", "New Zealand": "nz", "Ireland": "ie",
    "Hong Kong": "hk", "Taiwan": "tw",
}
#: Crew roles and link types by their ids.
CREW_ROLES = {
    "producer": 3, "writer": 4, "cinematographer": 5, "composer": 6, "costume_designer": 7, "editor": 9,
    "production_designer": 11, "production designer": 11,
}
LINK_TYPES = {
    "follows": 1, "prequel": 1, "followed by": 2, "sequel": 2, "remake": 3, "remake of": 3, "remade as": 4,
    "references": 5, "referenced in": 6, "spoofs": 7, "spoofed in": 8, "features": 9, "featured in": 10,
    "spin-off from": 11, "spin_off_from": 11, "spin-off": 12, "spin_off": 12, "version of": 13, "similar": 14,
    "similar to": 14, "edited into": 15, "edited from": 16, "alternate language version of": 17,
}


def _mapped(c: Column, table: dict, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def country_code(c: Column) -> Column:
    """"[de]" of a country name, "[us]" if unknown."""
    return F.concat(F.lit("["), _mapped(F.trim(c), COUNTRY_CODES, "us"), F.lit("]"))


def crew_role_id(c: Column) -> Column:
    return _mapped(F.lower(F.trim(c)), CREW_ROLES, 10)


def link_type_id(c: Column) -> Column:
    return _mapped(F.lower(F.trim(c)), LINK_TYPES, 18)


def role_of_gender(c: Column) -> Column:
    """2 for women, else 1."""
    return F.when(F.lower(F.trim(c)).isin("f", "female", "woman"), 2).otherwise(1)


def company_type_id(c: Column) -> Column:
    role = F.lower(F.trim(c))
    return F.when(role.contains("distrib"), 1).when(role.contains("effect") | role.contains("vfx"), 3).when(role.contains("production") | role.contains("producer"), 2).otherwise(4)
