"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word definition: space and the bytes 09 to 0D.
BLANKS = " \t\n\x0b\x0c\r"
#: A word is a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(name: str) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(key: str, text: str) -> Column:
    """A row's id, which may be null, and its text as one string that is never null."""
    return F.concat(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")), F.lit(":"), F.md5(text_of(text)))


def words_of(text: Column) -> Column:
    """Array of the words of a non-null text; empty for a blank text."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def row_of(docs: DataFrame) -> Column:
    """All columns of a table as one struct, whatever their names."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def quoted(name: str) -> str:
    """A column name as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def crc_of(key: str) -> Column:
    """crc32 of the key as text, unsigned; a null key counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8"))


def crc_bucket(key: str, n: int) -> Column:
    """``crc_of`` modulo n."""
    return crc_of(key) % n


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` computed once a row.

    A column that a lambda refers to may be inlined by the optimizer, and then is
    computed anew for every element; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))
