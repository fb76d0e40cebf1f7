"""Sites of a stream of observations, merged over samples and released behind the slowest sample.

Position takes the part of time. A contig's state holds the open sites and each sample's last position; what lies at or before the
smallest of those positions is complete and is released. Observations behind that line come late and are dropped. A sample's
end is announced by a row whose position is beyond the contig.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from splitmark.session import shared_dir, written

OUT = "chr string, pos bigint, sample_count bigint, obs bigint, max_obs bigint"


def absorb(state: dict, rows: pd.DataFrame) -> None:
    """Takes observations (sample, pos, obs) into the open sites; those at or before the line are late and dropped."""
    for sample, pos, obs in rows[["sample", "pos", "obs"]].itertuples(index=False):
        state["at"][sample] = max(state["at"].get(sample, -1), int(pos))
        if pos > state["line"] and obs > 0:
            n, total, most = state["open"].get(str(int(pos)), (0, 0, 0))
            state["open"][str(int(pos))] = (n + 1, total + int(obs), max(most, int(obs)))


def release(state: dict, samples: list[str]) -> list[tuple]:
    """Moves the line to the slowest sample's position and takes out the sites that it has passed."""
    state["line"] = max(state["line"], min(state["at"].get(s, -1) for s in samples))
    done = sorted(int(p) for p in state["open"] if int(p) <= state["line"])
    return [(p, *state["open"].pop(str(p))) for p in done]


def streamed_sites(observed: DataFrame, samples: list[str]) -> DataFrame:
    """Streaming (chr, pos, sample_count, obs, max_obs) from a stream of (chr, sample, pos, obs)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(group.get[0]) if group.exists else {"at": {}, "open": {}, "line": -1}
        for rows in batches:  # all of a trigger's rows come before anything is released, in whatever order
            absorb(state, rows)
        out = release(state, samples)
        group.update((json.dumps(state),))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["chr", "pos", "sample_count", "obs", "max_obs"])

    return observed.groupBy("chr").applyInPandasWithState(step, OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def replay(observed: DataFrame, files: int = 4) -> DataFrame:
    """The streaming build run over a table of (chr, sample, pos, obs) to its end: the table is written by ranges of position, read back as a
    stream of that many files, one a trigger, and closed by a row for each sample and contig beyond the last position."""
    spark = observed.sparkSession
    rows = written(observed.select("chr", "sample", F.col("pos").cast("bigint").alias("pos"), F.col("obs").cast("bigint").alias("obs")), "observed")
    samples = sorted(r["sample"] for r in rows.select("sample").distinct().collect())
    base = f"{shared_dir(spark)}/splitmark-stream-{uuid.uuid4().hex}"
    cuts = rows.agg(F.expr(f"percentile_approx(pos, array({', '.join(f'{i / files}D' for i in range(1, files))}))").alias("c")).first()["c"] or []
    for low, high in zip([-1, *cuts], [*cuts, 1 << 40], strict=True):
        rows.where((F.col("pos") > low) & (F.col("pos") <= high)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    ends = rows.select("chr").distinct().crossJoin(rows.select("sample").distinct())  # one row for each sample and contig
    ends.select("chr", "sample", F.lit(1 << 41).alias("pos"), F.lit(0).cast("bigint").alias("obs")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema("chr string, sample string, pos bigint, obs bigint").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run = streamed_sites(stream, samples).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{base}/out")
