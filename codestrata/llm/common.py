"""Staging in the shared folder and small Arrow helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Text that one numpy step works on; bounds the temporary arrays of a task, not the size of a text.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``, which the driver and all executors see.

    Only a session on a local master may leave the setting out: it then gets a temporary folder of its own.  On a
    cluster a missing setting is an error, as a machine-local folder would lose data.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    folder = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: no recomputation, no lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input can't clash with those an operator adds."""
    return docs.select(*[docs[c] for c in columns])


def slices(batches, column: str, limit: int = SLICE_BYTES):
    """Arrow batches cut so that ``column`` holds about ``limit`` bytes in each (one row at least)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        batch = pa.RecordBatch.from_arrays(
            [text if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names
        )
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            after = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, after - first)
            first = after
