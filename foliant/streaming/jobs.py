"""Structured Streaming forms of ingestion, versions, counters, buffers and near texts.

Event time is ours to define: a watermark of one hour, later rows are dropped.

Keyed state is kept by ``transformWithState``: maps and lists of which a batch reads and
writes only the entries it touches, in the RocksDB state store, so a key with a long
history costs what arrives.  State that may be forgotten has a time to live (``idle``), measured
in processing time; without it nothing expires.  A query with such a time runs until it is
stopped, whatever its trigger, since something may expire at any time.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WATERMARK = "1 hour"
#: The state store that keyed state of several variables needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of new files with their content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)


def ingest(stream: DataFrame, out: str, checkpoint: str, parsers: dict | None = None):
    """Parse arriving files and append one row per file with its job status; runs until all are taken."""
    from ..functions import text as T
    from ..sources.files import elements_of

    parsed = stream.select("path", F.sha2("content", 256).alias("sha256"), elements_of(F.col("content"), T.suffix("path"), parsers).alias("p"))
    status = F.when(F.col("p.error").isNull(), "completed").otherwise("failed")
    jobs = parsed.select("path", "sha256", status.alias("status"), F.col("p.error").alias("error"), F.col("p.elements").alias("elements"))
    return jobs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str, idle: timedelta | None) -> DataFrame:
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = f"`{key}` {stream.schema[key].dataType.simpleString()}, {schema}"
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, mode, "processingTime" if idle else "none")


def _millis(idle: timedelta | None) -> int | None:
    return None if idle is None else int(idle.total_seconds() * 1000)


class _Versions(StatefulProcessor):
    """A map from digest to version, and the number of versions."""

    def __init__(self, key: str, digest: str, idle: timedelta | None) -> None:
        self.key, self.digest, self.idle = key, digest, _millis(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "digest string", "version int", self.idle)
        self.count = handle.getValueState("count", "n int", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, out = self.count.get()[0] if self.count.exists() else 0, []
        for batch in rows:
            for sha in batch[self.digest]:
                seen = self.known.getValue((sha,)) if self.known.containsKey((sha,)) else None
                if seen is None:
                    n += 1
                    self.known.updateValue((sha,), (n,))
                out.append((key[0], sha, n if seen is None else seen[0], seen is not None))
        self.count.update((n,))
        yield pd.DataFrame(out, columns=[self.key, "sha256", "version", "is_duplicate"])


def register_versions(uploads: DataFrame, key: str = "document_key", digest: str = "sha256", idle: timedelta | None = None) -> DataFrame:
    """Version and duplicate flags of uploads as they arrive; a null digest is not an upload."""
    return _keyed(uploads.where(F.col(digest).isNotNull()), key, _Versions(key, digest, idle), "sha256 string, version int, is_duplicate boolean", "append", idle)


def running_counters(increments: DataFrame) -> DataFrame:
    """Sums by series, in update mode."""
    return increments.groupBy("name", "labels").agg(F.sum("value").alias("value"))


def windowed_counters(events: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Counts by event type and tumbling window of event time."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


class _Recent(StatefulProcessor):
    """A ring of the last values: place to value, and the number of values so far."""

    def __init__(self, name: str, most: int, idle: timedelta | None) -> None:
        self.name, self.most, self.idle = name, most, _millis(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getMapState("ring", "place int", "value double", self.idle)
        self.count = handle.getValueState("count", "n long", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        for batch in rows:
            values = batch["value"].tolist()
            for at, value in list(enumerate(values, n))[-self.most :]:
                self.ring.updateValue((at % self.most,), (float(value),))
            n += len(values)
        self.count.update((n,))
        held = [v[0] for v in self.ring.values()]
        yield pd.DataFrame([(key[0], len(held), max(held, default=0.0))], columns=[self.name, "held", "greatest"])


def recent_values(observations: DataFrame, most: int = 5000, idle: timedelta | None = None) -> DataFrame:
    """The size and the greatest of each series' last ``most`` values, as they arrive; null values are not observed."""
    return _keyed(observations.where("value is not null"), "name", _Recent("name", most, idle), "held long, greatest double", "update", idle)


class _Near(StatefulProcessor):
    """The signatures of one band, in the order of arrival."""

    def __init__(self, threshold: float, idle: timedelta | None) -> None:
        self.threshold, self.idle = threshold, _millis(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "id string, sig array<bigint>", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = list(self.held.get()) if self.held.exists() else []
        ids, sigs = [r[0] for r in known], [np.asarray(r[1], np.int64) for r in known]
        out, fresh = [], []
        for batch in rows:
            for id_, sig in zip(batch["id"], batch["sig"], strict=True):
                sig = np.asarray(sig, np.int64)
                if sigs:
                    share = (np.stack(sigs) == sig).mean(axis=1)
                    best = int(share.argmax())  # the first of the best
                    if share[best] >= self.threshold and ids[best] != id_:
                        out.append((key[0], id_, ids[best], float(share[best])))
                if id_ not in ids:
                    ids.append(id_)
                    sigs.append(sig)
                    fresh.append((id_, sig.tolist()))
        if fresh:
            self.held.appendList(fresh)
        yield pd.DataFrame(out, columns=["band", "id", "match", "similarity"])


def near_texts(stream: DataFrame, out: str, checkpoint: str, threshold: float = 0.9, idle: timedelta | None = None):
    """Append (id, match, similarity) of each arriving text (id, text) that one before it is near to; runs until all are taken.

    Signatures are kept by band, each arriving one is compared with those of its bands; a text
    meets several bands in one batch, of which the best match counts.  Every text is registered, near ones too.
    """
    from ..operators import dedup

    signed = dedup.banded(dedup.signatures(stream.withColumn("id", F.col("id").cast("string")), "id", "text"), threshold)
    matched = _keyed(signed, "band", _Near(threshold, idle), "id string, match string, similarity double", "append", idle)

    def best(batch: DataFrame, _: int) -> None:
        top = batch.groupBy("id").agg(F.max_by(F.struct("match", "similarity"), F.struct("similarity", F.col("match"))).alias("m"))
        top.select("id", "m.*").write.mode("append").parquet(out)

    return matched.writeStream.foreachBatch(best).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_texts(stream: DataFrame, text: str = "text", time: str = "ts") -> DataFrame:
    """Texts not seen within the watermark, case and spacing aside."""
    from ..functions import text as T

    keyed = stream.withColumn("digest", F.sha2(T.fold(text), 256)).withWatermark(time, WATERMARK)
    return keyed.dropDuplicatesWithinWatermark(["digest"])
