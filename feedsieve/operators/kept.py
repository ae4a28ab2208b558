"""Tables that later steps read several times."""

from __future__ import annotations

from pyspark.sql import DataFrame


def kept_once(df: DataFrame) -> DataFrame:
    """Cuts a table off in the session's checkpoint folder, or caches it where none is named.

    Checkpoint files go with the table they belong to, if the session is told so
    (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None and (named := df.sparkSession.conf.get("spark.checkpoint.dir", None)):
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True) if sc.getCheckpointDir() else df.persist()
