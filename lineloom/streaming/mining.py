"""Template mining over a stream (G1), in two forms with the same line-by-line semantics.

``TemplateStream`` runs the distributed sequential miner on every micro-batch, starting from the templates of the
batches before.  A length that holds most of a batch is spread over the cluster, so it is the form for large streams.

``assign_stream`` keeps the templates of each bucket in the state store and decides row by row, in the order of
arrival.  It answers with the lowest delay; its unit of work is one bucket of one micro-batch, so bound the batch at
the source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lineloom.functions.masking import SEP
from lineloom.operators.messages import partition_by_length, preprocess
from lineloom.operators.mining import assign_templates, mine_templates
from lineloom.operators.sequential import CLUSTER_SCHEMA, Replay
from lineloom.plans.presets import Preset
from lineloom.workspace import Workspace


class TemplateStream:
    """G1 through ``foreachBatch``.

    The templates after batch ``i`` are a written table named after ``i`` below ``state_dir``; a batch that is tried
    again starts from the table of the batch before it and writes the same result, so restarts are safe.
    ``sink(lines, batch_id)`` receives the batch with ``ClusterId``, ``EventId`` and ``EventTemplate`` as of its end.
    """

    def __init__(
        self,
        spark: SparkSession,
        preset: Preset,
        sink: Callable[[DataFrame, int], None],
        state_dir: str | None = None,
        window: int = 65_536,
    ):
        self.spark = spark
        self.preset = preset
        self.sink = sink
        self.window = window
        self.state_dir = state_dir or f"{Workspace(spark).root}/stream-state"

    def templates(self, batch_id: int) -> DataFrame:
        """The templates after a batch (none before the first)."""
        if batch_id < 0:
            return self.spark.createDataFrame([], CLUSTER_SCHEMA)
        return self.spark.read.schema(CLUSTER_SCHEMA).parquet(f"{self.state_dir}/batch={batch_id}")

    def take(self, batch: DataFrame, batch_id: int) -> None:
        ws = Workspace(self.spark)
        lines = ws.table(partition_by_length(preprocess(batch, self.preset)), "batch")
        mining = mine_templates(
            lines.select("LineId", "Bucket", "Signature"), self.preset.method, self.preset.st, self.preset.n,
            "sequential", window=self.window, known=self.templates(batch_id - 1),
        )
        self.sink(assign_templates(lines, mining), batch_id)
        mining.clusters.select("Bucket", "ClusterId", "Tokens").write.mode("overwrite").parquet(
            f"{self.state_dir}/batch={batch_id}"
        )

    def start(self, messages: DataFrame, checkpoint: str | None = None, **trigger):
        """Start the query over a stream of ``LineId, Content``."""
        writer = messages.writeStream.foreachBatch(self.take).option(
            "checkpointLocation", checkpoint or f"{self.state_dir}/progress"
        )
        return (writer.trigger(**trigger) if trigger else writer).start()


_TEMPLATES = StructType(
    [StructField("ClusterId", LongType()), StructField("Tokens", ArrayType(StringType()))]
)
ASSIGNED_SCHEMA = "LineId bigint, ClusterId bigint, Template string"


class _Assign(StatefulProcessor):
    def __init__(self, method: str, st: float, n: int):
        self.measure = (method, st, n)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getListState("templates", _TEMPLATES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        replay = Replay([(cid, tuple(tokens)) for cid, tokens in self.store.get()], *self.measure)
        for chunk in rows:  # one Arrow batch at a time, however many rows the bucket has
            chunk = chunk.sort_values("LineId")
            homes = [
                replay.take(line_id, tuple(signature.split(SEP)) if signature else ())
                for line_id, signature in zip(chunk["LineId"], chunk["Signature"])
            ]
            text = {cid: "".join(tokens) for cid, tokens in replay.clusters}
            yield pd.DataFrame(
                {"LineId": chunk["LineId"].to_numpy(), "ClusterId": homes, "Template": [text[h] for h in homes]}
            )
        self.store.put([(int(cid), list(tokens)) for cid, tokens in replay.clusters])

    def close(self) -> None:
        pass


def assign_stream(messages: DataFrame, preset: Preset) -> DataFrame:
    """G1 through keyed state: each line with its cluster and the template as it stands then."""
    lines = partition_by_length(preprocess(messages, preset)).select("LineId", "Bucket", "Signature")
    return lines.groupBy("Bucket").transformWithStateInPandas(
        _Assign(preset.method, preset.st, preset.n), ASSIGNED_SCHEMA, "Append", "None"
    )


def state_store_options(spark: SparkSession) -> None:
    """Keyed state of this kind lives in RocksDB."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
