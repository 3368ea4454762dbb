"""The values of a page as a table function, for SQL: ``FROM pages, LATERAL page_values(html, 'title,genre')`` (X4-X8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from marquee.functions.page_fields import FIELDS, page_fields

VALUES = T.StructType(
    [T.StructField("field", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("value", T.StringType())]
)


@dataclass
class _Wanted(AnalyzeResult):
    """What is asked for, found out once when the query is planned."""

    names: tuple = ()


class _PageValues:
    """Rows ``(field, place, value)``: every element that a field's path finds, in page order, from 0.

    ``fields`` is a constant list of names, joined by commas; ``*`` is all of them. It is checked before anything runs, so
    a wrong name fails the query and not its tasks. A page that is null or empty has no rows; an element without
    text has one whose value is null. Each page is parsed once, however many fields are asked for.
    """

    def __init__(self, wanted: _Wanted) -> None:
        self.names = wanted.names

    @staticmethod
    def analyze(html: AnalyzeArgument, fields: AnalyzeArgument) -> _Wanted:
        if not isinstance(html.dataType, (T.StringType, T.NullType)):
            raise ValueError("page_values: the page must be a string")
        if not fields.isConstantExpression or not isinstance(fields.value, str):
            raise ValueError("page_values: the fields must be a constant string")
        asked = [name.strip() for name in fields.value.split(",")]
        names = FIELDS if asked == ["*"] else list(dict.fromkeys(asked))
        unknown = [name for name in names if name not in FIELDS]
        if unknown:
            raise ValueError(f"page_values: no field {', '.join(unknown)}; there are {', '.join(FIELDS)}")
        return _Wanted(VALUES, names=tuple(names))

    def eval(self, html: str | None, fields: str) -> Iterator[tuple]:
        if not html:
            return
        found = page_fields(html)
        for name in self.names:
            for place, value in enumerate(found[name]):
                yield name, place, value


page_values = udtf(_PageValues, useArrow=True)


def register(spark: SparkSession) -> None:
    """Makes ``page_values`` known to the session's SQL."""
    spark.udtf.register("page_values", page_values)


def values_of(pages: DataFrame, fields: str = "*") -> DataFrame:
    """The other columns of ``pages`` with ``field``, ``place`` and ``value``, one row a value."""
    spark = pages.sparkSession
    register(spark)
    kept = ", ".join(f"p.`{name}`" for name in pages.columns if name != "html")
    return spark.sql(
        f"SELECT {kept}, v.field, v.place, v.value FROM {{pages}} AS p, LATERAL page_values(p.html, :fields) AS v",
        args={"fields": fields},
        pages=pages,
    )
