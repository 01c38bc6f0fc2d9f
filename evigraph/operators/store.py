"""Tables that several later steps read: written once in the shared folder, so plans stay small and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from evigraph.streaming.progress import shared_dir


def kept(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
