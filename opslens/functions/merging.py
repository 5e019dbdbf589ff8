"""Union of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

UNION_SETTING = "spark.sql.unionOutputPartitioning"


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, columns matched by name.

    Spark 4.1 may take a union of equally partitioned parts as partitioned by their key and leave out
    the shuffle of a later aggregation, although adaptive execution has merged the partitions of
    each part differently. Groups then come out split. The setting is turned off for the session
    that plans the union.
    """
    parts[0].sparkSession.conf.set(UNION_SETTING, "false")
    return reduce(DataFrame.unionByName, parts)
