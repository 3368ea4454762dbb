"""Row placement: joins and copies that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import settle

SALTS = 8
COPIES_PER_PIECE = 10_000


def salted_join(
    hot: DataFrame,
    other: DataFrame,
    key: str,
    spread_by: list[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join where ``hot`` may have very many rows of one key and ``other`` has few per key.

    The hot side is split by a hash of ``spread_by`` (a recomputed task gives the same salts),
    the other side is repeated once per salt. AQE still turns it into a broadcast join when the
    other side proves small at run time.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        hot.withColumn("_salt", salt)
        .join(other.withColumn("_salt", every_salt), [key, "_salt"], how)
        .drop("_salt")
    )


def repeat_rows(df: DataFrame, copies: str) -> DataFrame:
    """Each row ``copies`` times. Only large counts are cut into pieces that are spread out first.

    The rows are settled, as both kinds are taken from them.
    """
    df = settle(df)
    single = df.filter(F.col(copies) == 1).drop(copies)
    return single.unionByName(_spread_copies(df.filter(F.col(copies) > 1), copies))


def _spread_copies(df: DataFrame, copies: str) -> DataFrame:
    pieces = F.sequence(F.lit(0), F.ceil(F.col(copies) / COPIES_PER_PIECE) - 1)
    size = F.least(
        F.lit(COPIES_PER_PIECE), F.col(copies) - F.col("_piece") * F.lit(COPIES_PER_PIECE)
    )
    return (
        df.withColumn("_piece", F.explode(pieces))
        .repartition(F.xxhash64("_piece", *df.columns))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), size)))
        .drop("_piece", "_copy", copies)
    )
