"""Prompts that wait for the model of their answer: a stateful operator with timers.

A transcript's prompt takes the model of the next answer of its file. Prompts wait in a list by file until that answer comes; one
that has waited WAIT goes out without a model. A file that starts over, or a later one under its name, lets what waits go without
a model. State holds the waiting prompts alone, so a file that is quiet leaves none.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds that a prompt waits.
WAIT = 10 * 60 * 1000
#: Events may be this late, where waiting goes by the events' times.
LATE = "1 minute"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_PROMPT = "at long, ts timestamp, native_key string, session string, cwd string, text string"
_OUT = "file string, at long, ts timestamp, native_key string, session string, cwd string, text string, model string"


class Waiting(StatefulProcessor):
    def __init__(self, by_events: bool):
        self.by_events = by_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prompts = handle.getListState("prompts", _PROMPT)

    @staticmethod
    def _due(prompt) -> int:
        return int(prompt[1].timestamp() * 1000) + WAIT

    def _out(self, file: str, prompt, model: str) -> Row:
        return Row(file=file, at=prompt[0], ts=prompt[1], native_key=prompt[2], session=prompt[3], cwd=prompt[4], text=prompt[5], model=model)

    def _keep(self, prompts: list[tuple]) -> None:
        if prompts:
            self.prompts.put(prompts)
        else:
            self.prompts.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() if self.by_events else timerValues.getCurrentProcessingTimeInMs()
        held = [tuple(p) for p in self.prompts.get()]
        for r in sorted(rows, key=lambda r: r.at):
            if held and r.at <= held[-1][0]:
                yield from (self._out(key[0], p, "") for p in held)
                held = []
            if r.model:
                yield from (self._out(key[0], p, r.model) for p in held)
                held = []
            if r.text is not None:
                held.append((r.at, r.ts, r.native_key, r.session, r.cwd, r.text))
        overdue = [p for p in held if self._due(p) <= now]
        yield from (self._out(key[0], p, "") for p in overdue)
        held = [p for p in held if self._due(p) > now]
        for due in {self._due(p) for p in held}:
            self.handle.registerTimer(due)
        self._keep(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held = expiredTimerInfo.getExpiryTimeInMs(), [tuple(p) for p in self.prompts.get()]
        yield from (self._out(key[0], p, "") for p in held if self._due(p) <= now)
        self._keep([p for p in held if self._due(p) > now])

    def close(self) -> None:
        pass


def with_models(lines: DataFrame, by_events: bool = False) -> DataFrame:
    """Of lines (file, at, ts, model, native_key, session, cwd, text), prompts with text and answers with a model: the prompts with their model.

    by_events: waiting goes by the watermark of ts, which a replay repeats, and not by the clock. Needs the RocksDB state store.
    """
    kept = lines.where("text is not null or model <> ''").select("file", "at", "ts", "model", "native_key", "session", "cwd", "text")
    kept = kept.withWatermark("ts", LATE) if by_events else kept
    return kept.groupBy("file").transformWithState(Waiting(by_events), _OUT, "append", "eventTime" if by_events else "processingTime")


def transcript_lines(lines: DataFrame) -> DataFrame:
    """What with_models reads, from lines (file, at, value) of transcripts; each line is judged by itself, as a stream can."""
    from talliard.sources import logs

    rows = logs.transcript(lines.select("file", "at", F.try_parse_json("value").alias("v")).where("v is not null"))
    prompt = logs.transcript_prompt(rows)
    return prompt.select("file", "at", "ts", F.when(F.col("counted"), F.col("model")).otherwise("").alias("model"), F.col("uuid").alias("native_key"), "session", "cwd", F.col("text"))


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that with_models needs, for queries that start within."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)
