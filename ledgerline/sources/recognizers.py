"""Recognisers and correctors as functions of pandas batches, by name, and the plain ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.precedence import fallback

#: Rows of cells (cell_id, crop, context columns) to rows of RESULT.
Recognizer = Callable[[pd.DataFrame], pd.DataFrame]
RESULT = "cell_id string, text string, answer string, confidence double, backend string"
_known: dict[str, Recognizer] = {}
_correctors: dict[str, Recognizer] = {}


def register(name: str, recognizer: Recognizer, corrector: bool = False) -> None:
    (_correctors if corrector else _known)[name] = recognizer


def nothing(cells: pd.DataFrame) -> pd.DataFrame:
    """Reads no cell: every one is rejected, so all wait for a reviewer."""
    return pd.DataFrame({"cell_id": cells["cell_id"], "text": "", "answer": "reject", "confidence": 0.0, "backend": "null"})


register("null", nothing)


def recognize(cells: DataFrame, name: str, corrector: str | None = None) -> DataFrame:
    """Cells through a recogniser, batch by batch where they are; a corrector may follow."""
    read, mend = _known[name], _correctors[corrector] if corrector else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = read(b)
            yield mend(out) if mend else out

    return cells.mapInPandas(run, RESULT)


def oracle(cells: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers in place of a recogniser: by source first, then by date."""
    place = ["template", "region", "field_name", "row_key"]
    by_source = answers.where("source IS NOT NULL").select("source", *place, "text")
    by_date = answers.where("source IS NULL AND work_date IS NOT NULL").select("work_date", *place, "text")
    return fallback(cells, by_source, by_date, ["source", *place], ["work_date", *place], "text")
