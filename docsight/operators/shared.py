"""Cutting a plan's lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def bare(df: DataFrame) -> DataFrame:
    """A materialised table without what the planner knows of its origin: where a loop joins its own results, that doubles with each round."""
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), session)


def cut(df: DataFrame) -> DataFrame:
    """The table, materialised by ``checkpoint`` in the folder of spark.checkpoint.dir.

    Where none is set a temporary folder serves a session that runs in one
    process; on a cluster this raises, as executors could not read one another's files.
    """
    session = df.sparkSession
    sc = session.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = sc.getConf().get("spark.checkpoint.dir") or session.conf.get("spark.checkpoint.dir", None)
        if not path and sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="docsight-checkpoints-"))
    return df.checkpoint(eager=True)
