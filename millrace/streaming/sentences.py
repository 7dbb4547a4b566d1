"""Answers as streams of deltas: the start of each is held back until its first sentence can be judged.

State is kept for each message: what is held, or that its start has been passed. A start is released at the first sentence
end or line break, or from ``MOST`` characters on; a first sentence that warns without being asked to is dropped. Later
deltas pass as they come. A delta marked as last releases what is held and drops the state; in a stream that goes on
(``start``), a message that breaks off is released by a timer. A run over what there is (``run``) has no timers, since
they would keep it waiting; what is held stays in its state for the next run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Ends of a sentence, the length from which nothing is held, phrases of warnings.
END, MOST = r"[.!?。]\s*|\n", 80
WARNING = r"전원\s*(을|를)?\s*(차단|끄|뽑)|사용\s*(을|를)?\s*중지|플러그\s*(를|을)?\s*(뽑|분리)"
OUT = "message_id string, seq long, text string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def released(held: str, warned: bool, last: bool, phrase: str = WARNING) -> str | None:
    """What of a held start goes out: None if it is held on."""
    end = re.search(END, held)
    if end is None and len(held) < MOST:
        return held if last else None
    if end and not warned and re.search(phrase, held[: end.end()]):
        return held[end.end() :].lstrip()
    return held


class Holding(StatefulProcessor):
    """Rows (message_id, seq, delta, warned, last) to rows (message_id, seq, text)."""

    def __init__(self, phrase: str, patience_ms: int | None):
        self.phrase, self.patience = phrase, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("start", "held string, passed boolean, warned boolean, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("seq", kind="stable")  # a message's deltas of one batch
        held, passed, warned, _ = self.state.get() if self.state.exists() else ("", False, False, 0)
        out, last = [], False
        for seq, delta, asks, ends in zip(found["seq"], found["delta"], found["warned"], found["last"]):
            warned, last, seq = warned or bool(asks), last or bool(ends), int(seq)
            delta = delta if isinstance(delta, str) else ""
            if passed:
                text = delta
            else:
                held += delta
                text = released(held, warned, last, self.phrase)
                passed = text is not None
                held = "" if passed else held
            if text:
                out.append((key[0], seq, text))
        if self.patience is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if last:
            self.state.clear()
        else:
            self.state.update((held, passed, warned, int(found["seq"].max())))
            if self.patience is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield pd.DataFrame(out, columns=["message_id", "seq", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, passed, warned, seq = self.state.get() if self.state.exists() else ("", True, False, 0)
        text = None if passed else released(held, warned, True, self.phrase)
        self.state.clear()
        yield pd.DataFrame([(key[0], seq, text)] if text else [], columns=["message_id", "seq", "text"])

    def close(self) -> None:
        pass


def held_starts(deltas: DataFrame, phrase: str = WARNING, patience_ms: int | None = None) -> DataFrame:
    """The stream of texts of a stream of deltas (message_id string, seq long, delta, warned, last); with ``patience_ms``,
    starts are released that long after their last delta."""
    deltas.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # what timers and typed state need
    mode = "None" if patience_ms is None else "ProcessingTime"
    return deltas.groupBy("message_id").transformWithStateInPandas(Holding(phrase, patience_ms), OUT, "Append", mode)


def _writer(spark: SparkSession, source: str, folder: str, schema, phrase: str, patience_ms: int | None, files: int):
    deltas = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    texts = held_starts(deltas, phrase, patience_ms)
    return texts.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")


def run(spark: SparkSession, source: str, folder: str, schema, phrase: str = WARNING, files: int = 4) -> DataFrame:
    """Reads what there is under ``source``, ``files`` at a time, and appends to ``folder``/out; goes on from its checkpoint."""
    _writer(spark, source, folder, schema, phrase, None, files).trigger(availableNow=True).start().awaitTermination()
    return shown(spark, folder)


def start(spark: SparkSession, source: str, folder: str, schema, phrase: str = WARNING, patience_ms: int = 60_000, files: int = 4, every: str = "1 second"):
    """A query that goes on reading ``source``, with timers."""
    return _writer(spark, source, folder, schema, phrase, patience_ms, files).trigger(processingTime=every).start()


def shown(spark: SparkSession, folder: str) -> DataFrame:
    """What has been released so far."""
    return spark.read.schema(OUT).parquet(f"{folder}/out")
