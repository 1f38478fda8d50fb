"""A store of daily series, bucketed by series, that several readers of one job share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from driftwell.session import scratch_folder


def stored_series(hub: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Writes ``hub`` once, bucketed by ``keys``, and reads it back.

    Aggregates, joins and windows on ``keys`` (or on more columns) read their buckets without an exchange, and a lost executor
    costs a reread of its buckets.  Rows are dealt by the hash of the buckets before writing, so a bucket is one file.  The files
    lie in the folder named by ``spark.checkpoint.dir``; no entry stays in the catalog.  Rows with null keys share a bucket, an
    empty ``hub`` gives an empty store, repeated rows stay.
    """
    spark = hub.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, name = scratch_folder(spark, "series"), f"series_{uuid.uuid4().hex}"
    dealt = hub.repartition(buckets, *keys)
    dealt.write.option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    store = spark.table(name)
    # The resolved plan holds files and buckets; without the entry nothing is left behind in a shared catalog.
    spark.sql(f"DROP TABLE {name}")
    return store
