"""Per-item work in Python over Arrow batches, with errors as rows instead of failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def mapped(
    rows: DataFrame,
    item: Callable[[dict], dict],
    schema: str | T.StructType,
    key: str,
    before: Callable[[pd.DataFrame], None] | None = None,
    after: Callable[[pd.DataFrame], None] | None = None,
) -> DataFrame:
    """One row per input row: key, the fields that item() returns, and error (null where it went well).

    before and after see each batch of input and output inside the task. A failing item fails alone.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    out = T.StructType([rows.schema[key], *schema.fields, T.StructField("error", T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if before:
                before(batch)
            found = []
            for record in batch.to_dict("records"):
                try:
                    got = item(record)
                    found.append((record[key], *[got.get(n) for n in names], None))
                except Exception as e:  # whatever goes wrong with one item stays with it
                    found.append((record[key], *[None] * len(names), f"{type(e).__name__}: {e}"[:500]))
            done = pd.DataFrame(found, columns=out.names)
            if after:
                after(done)
            yield done

    return rows.mapInPandas(run, out)
