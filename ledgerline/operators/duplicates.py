"""Repeated scans: a page is held if an earlier page that was not held looks alike."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.80


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if they differ in length or one is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot / n)


def hold_repeats(pages: DataFrame, by: list[str], order: str, vector: str, key: str = "page_id", threshold: float = THRESHOLD) -> DataFrame:
    """key, duplicate_of, similarity for held pages: the most similar earlier page of the group that isn't held itself;
    at equal similarity the earlier one. Whether a page is held depends on those before it, so a group (a day's pages of
    a form) is gone through in order, in one task."""
    schema = f"{key} string, duplicate_of string, similarity double"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([order, key])
        kept: dict[int, tuple[list[str], np.ndarray]] = {}  # by length: pages, and their vectors in the first rows of a matrix
        out = []
        for name, v in zip(group[key].astype(str), group[vector], strict=True):
            v = np.asarray(v if v is not None else [], dtype=np.float64)
            n = np.linalg.norm(v)
            names, rows = kept.setdefault(len(v), ([], np.empty((16, len(v)))))
            if n and names:
                sims = rows[: len(names)] @ (v / n)
                i = int(sims.argmax())
                if sims[i] >= threshold:
                    out.append((name, names[i], float(sims[i])))
                    continue
            if n:
                if len(names) == len(rows):
                    rows = np.concatenate([rows, np.empty_like(rows)])
                    kept[len(v)] = names, rows
                rows[len(names)] = v / n
                names.append(name)
        return pd.DataFrame(out, columns=[key, "duplicate_of", "similarity"])

    return pages.select(*by, order, vector, key).groupBy(*by).applyInPandas(run, schema) if key != order else pages.select(*by, vector, key).groupBy(*by).applyInPandas(run, schema)


def exact_copies(files: DataFrame, content: Column, order: str) -> DataFrame:
    """Files by their content id; the first in order is the document, the others are copies of it."""
    f = files.withColumn("document_id", F.substring(F.sha2(content, 256), 1, 16))
    g = f.groupBy("document_id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    return f.join(g, "document_id").withColumn("is_copy", F.col(order) != F.col("first"))
