"""Design columns from a plain description of model terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.operators.tables import level_dimension

MAX_LEVELS = 5_000


@dataclass(frozen=True)
class Term:
    """One model term.

    Only ``number``: the column as it is. Only ``factor``: one 0/1 column per level
    but the reference. Both: the number within each level, all levels kept.
    """

    factor: str | None = None
    number: str | None = None

    def columns(self) -> list[str]:
        return [c for c in (self.factor, self.number) if c]


def number(name: str) -> Term:
    return Term(number=name)


def factor(name: str) -> Term:
    return Term(factor=name)


def within(factor_name: str, number_name: str) -> Term:
    return Term(factor=factor_name, number=number_name)


def term_columns(terms: Sequence[Term]) -> list[str]:
    return list(dict.fromkeys(c for t in terms for c in t.columns()))


def factor_levels(df: DataFrame, terms: Sequence[Term], reference: Mapping[str, str]) -> dict[str, list[str]]:
    """Observed levels of every factor, reference first.

    The number of levels is the number of model columns, so this list is as small as
    the linear system it defines; too many levels are an error, not truncated.
    """
    names = list(dict.fromkeys(t.factor for t in terms if t.factor))
    if not names:
        return {}
    dim = level_dimension(df, {v: F.col(v) for v in names}, reference=reference)
    rows = dim.select("variable", "level", "ordinal").limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} factor levels in the model")
    out: dict[str, list[str]] = {v: [] for v in names}
    for r in sorted(rows, key=lambda r: r["ordinal"]):
        out[r["variable"]].append(r["level"])
    return out


def design_columns(terms: Sequence[Term], levels: Mapping[str, Sequence[str]]) -> list[tuple[str, Column]]:
    """(label, expression) per model column; labels read ``factorlevel`` and ``factorlevel:number``."""
    out: list[tuple[str, Column]] = []
    for t in terms:
        if t.factor is None:
            out.append((t.number, F.col(t.number).cast("double")))
            continue
        is_level = F.col(t.factor).cast("string")
        if t.number is None:
            for level in levels[t.factor][1:]:
                out.append((f"{t.factor}{level}", F.when(is_level == level, 1.0).otherwise(0.0)))
        else:
            value = F.col(t.number).cast("double")
            for level in levels[t.factor]:
                out.append((f"{t.factor}{level}:{t.number}", F.when(is_level == level, value).otherwise(0.0)))
    return out


def design_entries(terms: Sequence[Term], levels: Mapping[str, Sequence[str]]) -> list[tuple[Column, Column]]:
    """(column number, value) of the one model column that each term sets in a record; 0 where it sets none.

    The same design as :func:`design_columns`, with as many numbers as terms instead of columns.
    """
    out, first = [], 0
    for t in terms:
        if t.factor is None:
            out.append((F.lit(first), F.col(t.number).cast("double")))
            first += 1
            continue
        own = levels[t.factor] if t.number else levels[t.factor][1:]
        if own:
            found = F.array_position(F.array(*[F.lit(v) for v in own]), F.col(t.factor).cast("string"))
            value = F.col(t.number).cast("double") if t.number else F.lit(1.0)
            out.append(((F.greatest(found, F.lit(1)) + (first - 1)).cast("int"), F.when(found > 0, value).otherwise(0.0)))
        first += len(own)
    return out or [(F.lit(0), F.lit(0.0))]


def known_terms(terms: Sequence[Term]) -> Column:
    """TRUE for records with every model variable known (others do not enter a fit)."""
    test = F.lit(True)
    for c in term_columns(terms):
        test = test & F.col(c).isNotNull()
    return test


def design_matrix(df: DataFrame, keep: Sequence[str], terms: Sequence[Term], levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Wide numeric design, one column per model column."""
    return df.where(known_terms(terms)).select(*keep, *[c.alias(label) for label, c in design_columns(terms, levels)])
