"""Batch inference: any text model as a distributed map; the model is made once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def infer(df: DataFrame, make_model: Callable[[], Callable[[list[str], list[str]], list[str]]], system: str = "system", user: str = "user", output: str = "output", batch_size: int = 8) -> DataFrame:
    """df with ``output``: the model's texts for batches of (system, user) prompts, in their order. Null prompts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for b in batches:
            s, u = ([t or "" for t in b.column(c).to_pylist()] for c in (system, user))
            out: list[str] = []
            for at in range(0, len(u), batch_size):
                out += model(s[at : at + batch_size], u[at : at + batch_size])
            if len(out) != b.num_rows:
                raise ValueError("the model returned another number of texts")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, output])

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{output}` string")
