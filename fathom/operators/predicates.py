"""Metadata predicates: building, compiling and applying where clauses."""

from __future__ import annotations

from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build(tickers: list[str], years: list[int]) -> dict | None:
    """A where clause from entities; several years set no condition; None if nothing is known."""
    parts: list[dict] = []
    if tickers:
        parts.append({"ticker": {"$eq": tickers[0]} if len(tickers) == 1 else {"$in": tickers}})
    if len(years) == 1:
        parts.append({"fiscal_year": {"$eq": years[0]}})
    return None if not parts else parts[0] if len(parts) == 1 else {"$and": parts}


def compile_where(where: dict[str, Any] | None, columns: list[str]) -> Column:
    """A where clause as a column: never null, so it can be negated and pushed down.

    $and comes before $or, and either hides its siblings; fields are ANDed; a literal means
    equality; a field that is missing or null matches no value but None; operators other than
    $eq and $in are ignored.
    """
    if not where:
        return F.lit(True)
    if "$and" in where:
        return reduce(lambda a, b: a & b, (compile_where(w, columns) for w in where["$and"]), F.lit(True))
    if "$or" in where:
        return reduce(lambda a, b: a | b, (compile_where(w, columns) for w in where["$or"]), F.lit(False))
    out = F.lit(True)
    for field, condition in where.items():
        if field.startswith("$"):
            continue
        value = F.col(field) if field in columns else F.lit(None)
        if not isinstance(condition, dict):
            condition = {"$eq": condition}
        if "$eq" in condition:
            out = out & value.eqNullSafe(F.lit(condition["$eq"]))
        if "$in" in condition:
            given = [v for v in condition["$in"] if v is not None]
            inside = F.coalesce(value.isin(given), F.lit(False)) if given else F.lit(False)
            out = out & (inside | value.isNull() if len(given) < len(condition["$in"]) else inside)
    return out


def apply(df: DataFrame, where: dict[str, Any] | None) -> DataFrame:
    return df.filter(compile_where(where, df.columns)) if where else df


def allows(tickers: Column, years: Column, ticker: Column, year: Column) -> Column:
    """The same clause for a batch of questions, whose entities are array columns."""
    by_ticker = (F.size(tickers) == 0) | F.coalesce(F.array_contains(tickers, ticker), F.lit(False))
    by_year = (F.size(years) != 1) | F.coalesce(F.get(years, F.lit(0)) == year, F.lit(False))
    return by_ticker & by_year


class Allowed:
    """What the entities of a bounded set of questions allow, on blocks of rows: as retrieve.allowed_pairs; questions without entities see every row."""

    def __init__(self, tickers: list[list[str]], years: list[list[int]]):
        self.known = sorted({t for ts in tickers for t in ts or [] if t is not None})
        place = {t: i for i, t in enumerate(self.known)}
        self.places = [[place[t] for t in ts or [] if t is not None] for ts in tickers]
        self.any_ticker = np.array([not ts for ts in tickers], bool)
        one = [ys[0] if ys is not None and len(ys) == 1 else None for ys in years]
        self.year = np.array([np.nan if y is None else y for y in one], float)
        self.nothing = np.array([not ts and ys is not None and len(ys) == 1 and ys[0] is None for ts, ys in zip(tickers, years, strict=True)], bool)

    def mask(self, ticker: pa.Array, year: pa.Array, block: slice) -> np.ndarray:
        """[questions of the block, rows]: whether the question sees the row; a null matches nothing."""
        code = pc.fill_null(pc.index_in(ticker, pa.array(self.known, pa.string())), len(self.known)).to_numpy(zero_copy_only=False)
        table = np.repeat(self.any_ticker[block, None], len(self.known) + 1, axis=1)
        for row, places in zip(table, self.places[block], strict=True):
            row[places] = True
        of, own = self.year[block, None], pc.cast(year, pa.float64()).to_numpy(zero_copy_only=False)[None]
        return table[:, code] & (np.isnan(of) | (of == own)) & ~self.nothing[block, None]
