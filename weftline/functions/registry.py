"""Generators of rows from rows: a registry, seeded by key, run as Arrow batches; and table functions in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Generator:
    """Makes rows of ``schema`` from each row of a table by ``make(row, uniform)``.

    ``uniform(n)`` is the row's n-th number in [0, 1), from the seed and its key alone.
    """

    name: str
    key: str
    schema: str
    make: Callable[[dict, Callable[[int], float]], list[tuple]]
    after: Callable[[DataFrame], DataFrame] | None = None


_GENERATORS: dict[str, Generator] = {}


def register(generator: Generator) -> Generator:
    _GENERATORS[generator.name] = generator
    return generator


def generate(df: DataFrame, name: str, seed: int = 42) -> DataFrame:
    """Rows of a registered generator; KeyError for an unknown one."""
    g = _GENERATORS[name]
    columns = [c.split()[0] for c in g.schema.split(",")]

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        for part in batches:
            out = []
            for row in part.to_dict("records"):
                uniform = lambda n, k=row[g.key]: int(hashlib.md5(f"{seed}|{g.name}|{k}|{n}".encode()).hexdigest()[:12], 16) / 16**12
                out += g.make(row, uniform)
            yield pd.DataFrame(out, columns=columns)

    made = df.mapInPandas(run, g.schema)
    return g.after(made) if g.after else made


def external(df: DataFrame, call: Callable[[list[str]], list[str]], prompt: str, size: int = 16, tries: int = 3) -> DataFrame:
    """Adds ``answer`` by a batched callable, asked again after an error; null if it keeps failing. Nothing here calls out."""

    def run(batches: Iterator) -> Iterator:
        for part in batches:
            answers: list = []
            for i in range(0, len(part), size):
                block = list(part[prompt][i : i + size])
                for n in range(tries):
                    try:
                        answers += call(block)
                        break
                    except Exception:  # noqa: BLE001
                        if n == tries - 1:
                            answers += [None] * len(block)
            yield part.assign(answer=answers)

    return df.mapInPandas(run, ", ".join(f"{n} {k}" for n, k in df.dtypes) + ", answer string")


def register_sql(spark: SparkSession) -> None:
    """Functions of this library for SQL text: ``phonetic(text)`` and the table function ``year_span(first, last)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="year int")
    class YearSpan:
        def eval(self, first: int, last: int):
            if first is not None and last is not None:
                for year in range(first, last + 1):
                    yield (year,)

    spark.udtf.register("year_span", YearSpan)
    codes = "regexp_replace(translate(regexp_replace(upper(t), '[^\\\\p{L}]', ''), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000'), '[^0-6]', '0')"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION phonetic(t STRING) RETURNS STRING RETURN "
        f"concat(left(regexp_replace(upper(t), '[^\\\\p{{L}}]', ''), 1), left(replace(substring(regexp_replace({codes}, '(.)\\\\1+', '$1'), 2), '0', ''), 4))"
    )
