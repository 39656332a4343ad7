"""What the text operators share: white space, words, null texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of every operator here, as the inside of a regular-expression class.
WS = r"\x20\x09-\x0D"


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The runs of other than white space, in order; an empty array if there is none.

    The text is trimmed first, so that ``split`` yields no empty word at either end.
    """
    trimmed = F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{WS}]+")
    )


def collapsed(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, f"[{WS}]+", " ")


class Shelf:
    """A table whose columns go by position, so that none of their names meets one that an operator makes.

    ``made`` are the names of result columns: a column that clashes with one gives way to it.
    """

    def __init__(self, docs: DataFrame, made: tuple[str, ...] = ()):
        self.names = docs.columns
        self.table = docs.toDF(*[f"_in{k}" for k in range(len(self.names))])
        taken = {name.lower() for name in made}
        self.kept = [k for k, name in enumerate(self.names) if name.lower() not in taken]
        self.columns = [f"_in{k}" for k in self.kept]

    def of(self, name: str) -> str:
        """The shelved name of a column."""
        exact = [k for k, mine in enumerate(self.names) if mine == name]
        found = exact or [k for k, mine in enumerate(self.names) if mine.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name}; there are {', '.join(self.names)}")
        return f"_in{found[0]}"

    def back(self, out: DataFrame) -> DataFrame:
        """``out``, which has :attr:`columns` and then result columns, under the first names again."""
        return out.toDF(*[self.names[k] for k in self.kept], *out.columns[len(self.kept) :])
