"""Training loops: the only places where parameters feed back.

``run_bsp`` pulls, computes and pushes once a round: rows meet the parameters of the last round in a join, deltas are summed by
id, and the merged table is written to shared storage before the next round. It is deterministic; its staleness is one round.
``run_sequential`` folds rows one at a time in a given order, exactly as a single worker would: the specification that the other
modes are compared with, meant for small inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from .storage import materialize


class Result(NamedTuple):
    """What workers put out, and the parameters."""

    output: DataFrame | None
    params: DataFrame


def run_bsp(params: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int) -> DataFrame:
    """``step(params, round)`` gives the next parameters."""
    for i in range(rounds):
        params = materialize(step(params, i), "params")
    return params


def run_sequential(data: DataFrame, order: str | list[str], logic: Callable[[], Any], output: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Feeds all rows in ``order`` to one ``logic()`` object: ``on_row(row) -> iterable of output rows`` and ``close()`` likewise."""
    by = [order] if isinstance(order, str) else order

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        worker, out = logic(), []
        for row in rows.sort_values(by, kind="stable").itertuples(index=False):
            out.extend(worker.on_row(row))
        out.extend(worker.close())
        names = [part.split()[0] for part in output.split(", ")]
        return pd.DataFrame(out, columns=names)

    kept = data.select(*columns) if columns else data
    return kept.groupBy().applyInPandas(fold, output)
