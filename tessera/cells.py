"""Python cells: a piece of Python over an engine's statements, with what it printed, its value and its error as text.

A cell that is one expression has a value; one of statements has none. Each cell starts with fresh names: `sql` (rows of a query as pandas,
the number of rows for a write), `frame` (the same, but a query as a DataFrame, for results that do not fit the driver), `spark` and `pd`.
`sql` raises when a result passes spark.driver.maxResultSize; texts beyond the bounds below are cut and say so.
Code runs with the rights of this process, so cells are for the engine's own user.
"""

from __future__ import annotations

import ast
import contextlib
import io
import traceback
from typing import TYPE_CHECKING, Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from tessera.engine import Engine

# Characters kept of what a cell prints or raises, and of its value.
MOST_PRINTED = 65536
MOST_VALUE = 4096


class CellResult(NamedTuple):
    """Texts; value and error are None where there is none."""

    printed: str
    value: str | None
    error: str | None


def _cut(text: str, most: int) -> str:
    return text if len(text) <= most else f"{text[:most]} [{len(text) - most} more characters]"


def run_cell(engine: Engine, code: str) -> CellResult:
    """Runs a cell. Its errors, and an exit, are results and are not raised; an interrupt is raised."""

    def rows(text: str, args: list | tuple = ()) -> pd.DataFrame | int:
        out = engine.sql(text, args)
        return out.toPandas() if isinstance(out, DataFrame) else out

    names: dict[str, Any] = {"__name__": "__main__", "sql": rows, "frame": engine.sql, "spark": engine.spark, "pd": pd}
    printed, value, error = io.StringIO(), None, None
    try:
        tree = ast.parse(code.strip(), "<cell>")
        with contextlib.redirect_stdout(printed):
            if len(tree.body) == 1 and isinstance(tree.body[0], ast.Expr):
                found = eval(compile(ast.Expression(tree.body[0].value), "<cell>", "eval"), names)
                value = None if found is None else _cut(repr(found), MOST_VALUE)
            else:
                exec(compile(tree, "<cell>", "exec"), names)
    except (Exception, SystemExit):
        error = _cut(traceback.format_exc(), MOST_PRINTED)
    return CellResult(_cut(printed.getvalue(), MOST_PRINTED), value, error)
