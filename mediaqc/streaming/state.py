"""Equal digests as keyed state that expires: each digest remembers the row that registered it, for the look-back.

The state of a digest is one row, so that a batch costs its own rows and not the stored history. Hash votes are no key of
their own and stay with the micro-batches.

Defined results: a row without a digest is an error and leaves no state; rows of a digest go by time, then ``seq``, then id; a row that
comes late is compared with what is registered when it comes; a duplicate does not extend the registration.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECIDED = "image_id string, md5 string, seq long, at long, status string, match_id string"
DAY = 86_400_000_000
#: Rows without a digest have no key; they are spread over so many.
SPREAD = 1024


def ends(spark: SparkSession) -> None:
    """Queries started from now on run no batch without rows; what has expired goes with the next rows."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def by_digest(stream: DataFrame, days: int = 10) -> DataFrame:
    """(image_id, md5, seq, at, status, match_id) of each row of a stream (image_id, md5, seq, at), ``at`` being the time of its batch.

    ``at`` decides what is within the look-back, so that rows which run again give the same answer; by the clock, state is
    dropped when its digest has not come for a look-back (never for days <= 0). A row's
    digest, id, seq and time are all that a task holds of a digest's rows in a batch. A query that is to end when all is read
    (``availableNow``) needs ``ends``, as the engine else runs empty batches for the clock without end.
    """

    def first_of_digest(key: tuple, rows: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        mine = pd.concat(list(rows), ignore_index=True).sort_values(["at", "seq", "image_id"], kind="stable")
        known = tuple(kept.get) if kept.exists else None
        status, match, first = [], [], known
        for name, at in zip(mine["image_id"], mine["at"], strict=True):
            again = key[0] is not None and first is not None and (days <= 0 or first[1] >= at - days * DAY)
            status.append("Error" if key[0] is None else "Duplicate" if again else "Valid")
            match.append(first[0] if again else "")
            first = first if again or key[0] is None else (name, int(at))
        if first is not known:
            kept.update(first)
        if first is not None and days > 0:  # a call that sets no timeout would keep the state for good
            kept.setTimeoutDuration(days * DAY // 1000)
        yield mine[["image_id", "md5", "seq", "at"]].assign(status=status, match_id=match)

    salt = F.when(F.col("md5").isNull(), F.pmod(F.xxhash64("image_id", "seq"), F.lit(SPREAD))).otherwise(0)
    slim = stream.select("image_id", "md5", "seq", F.unix_micros("at").alias("at"), F.col("md5").alias("digest"), salt.alias("salt"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if days > 0 else GroupStateTimeout.NoTimeout
    found = slim.groupBy("digest", "salt").applyInPandasWithState(first_of_digest, DECIDED, "image_id string, at long", "append", timeout)
    return found.withColumn("at", F.timestamp_micros("at"))
