"""Column expressions and small task helpers that several operators share."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between words in the contracts that count words by white space.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def filled(text: Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words separated by ASCII white space; null and blank texts have none."""
    trimmed = F.btrim(filled(text), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def in_slices(column: pa.Array, rows: int = 256) -> Iterator[list]:
    """Values of an Arrow column, a few at a time, so that a batch of long texts is never held twice.
    Memory of earlier batches goes back to the system first."""
    pa.default_memory_pool().release_unused()
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Fold by the CRC of the id's text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def kept_rows(docs: DataFrame) -> DataFrame:
    """Each row packed into one column ``doc``, so that no name of the input can clash with a working column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def lookup(table: DataFrame, rows: int = 200_000) -> DataFrame:
    """A written table for the small side of a join: broadcast where it has at
    most ``rows`` rows (some dozen MB), else joined by shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


def spread_lookup(rows: DataFrame, small: DataFrame, key: str, small_key: str, spread: str, salts: int = 8) -> DataFrame:
    """Left join of many rows to one row per key of ``small``, where one key may hold a third of the rows: these are
    spread over ``salts`` partitions by the hash of ``spread``, and ``small`` is repeated as often."""
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    copies = small.withColumn("small_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (rows.withColumn("row_salt", salt)
            .join(copies, (F.col(key) == F.col(small_key)) & (F.col("row_salt") == F.col("small_salt")), "left").drop("row_salt", "small_salt"))
