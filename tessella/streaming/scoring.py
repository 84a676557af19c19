"""Scoring as answers arrive: a batch's request goes out when the batch before it is answered, since it tells what earlier segments covered."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessella.functions import values as V
from tessella.operators import scoring as S

REQUESTS = "doc_id string, batch int, ids array<int>, system string, user string"
RESPONSES = "doc_id string, batch int, raw string, error string"
PROMPTS = "doc_id string, batch int, system string, narrative string, user string"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Turns(StatefulProcessor):
    """Of each course: the batch whose turn it is, whether it has been asked, the last few summaries, and what has arrived before its turn."""

    def __init__(self, last: int = V.NARRATIVE_SUMMARIES, chars: int = V.NARRATIVE_CHARS, glue: str = V.NARRATIVE_GLUE):
        self.last, self.chars, self.glue = last, chars, glue

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.course = handle.getValueState("course", "turn int, asked boolean, summaries array<string>")
        self.requests = handle.getMapState("requests", "batch int", "ids array<int>, system string, user string")
        self.answers = handle.getMapState("answers", "batch int", "ids array<int>, summaries array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.course.get()
        turn, asked, summaries = known or (0, False, [])
        summaries = list(summaries)
        # what arrives now is held in memory and only goes into the state if its turn doesn't come now: each call of the state is a round trip
        requests: dict[int, tuple] = {}
        answers: dict[int, tuple] = {}
        for r in rows:
            if r.batch < turn:
                continue  # settled; a late or repeated row changes nothing
            if not r.answer:
                requests[r.batch] = (list(r.ids), r.system, r.user)
            elif r.batch not in answers:
                answers[r.batch] = (list(r.ids), list(r.summaries))
        before = lambda state, batch: state.getValue((batch,)) if known and state.containsKey((batch,)) else None
        while request := requests.get(turn) or before(self.requests, turn):
            ids, system, user = request
            if user is not None:
                if not asked:
                    asked = True
                    yield Row(doc_id=key[0], batch=turn, system=system, narrative=self.cut(summaries), user=user)
                answer = before(self.answers, turn) or answers.get(turn)  # the first to arrive counts
                if not answer:
                    break
                told = dict(zip(*answer, strict=True))  # the last of a segment counts
                summaries = [*summaries, *(told[i] for i in ids if told.get(i))][-self.last :]
                if known:
                    self.answers.removeKey((turn,))
            if known:
                self.requests.removeKey((turn,))
            turn, asked = turn + 1, False
        for batch, row in requests.items():
            if batch >= turn:
                self.requests.updateValue((batch,), row)
        for batch, row in answers.items():
            if batch >= turn and not before(self.answers, batch):
                self.answers.updateValue((batch,), row)
        self.course.update((turn, asked, summaries))

    def cut(self, summaries: list[str]) -> str:
        text = self.glue.join(summaries)
        return text[: self.chars] + "..." if len(text) > self.chars else text

    def close(self) -> None:
        pass


def prompts_in_turn(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Streams of REQUESTS and RESPONSES to a stream of doc_id, batch, prompt.

    A course's batches are asked in order from 0, each once, when the one before has a response, be it a failure (a null raw). A batch without
    a user half is passed over. A batch whose request never comes, or whose response doesn't, ends its course's turns: its segments and those of
    later batches stay incomplete. The state of a course is its last few summaries, and requests and summaries that came before their turn.
    """
    null = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    asked = requests.select("doc_id", "batch", F.lit(False).alias("answer"), "ids", "system", "user", null("summaries", "array<string>"))
    said = F.filter(S.summaries_in("raw"), lambda x: x["segment_id"].isNotNull())
    told = responses.select("doc_id", "batch", F.lit(True).alias("answer"), F.transform(said, lambda x: x["segment_id"]).alias("ids"), null("system"), null("user"), F.transform(said, lambda x: x["summary"]).alias("summaries"))
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the process that runs the state need not know this package
    try:
        rows = asked.unionByName(told).groupBy("doc_id").transformWithState(Turns(), PROMPTS, "Append", "None")
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    return rows.select("doc_id", "batch", F.concat_ws("\n\n", S.with_narrative(F.col("system"), F.col("narrative")), "user").alias("prompt"))


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of a session that hold while a query is started, which keeps them."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def ask(spark: SparkSession, requests: str, responses: str, prompts: str, checkpoint: str, partitions: int = 0) -> StreamingQuery:
    """Files of requests and responses that have arrived to files of prompts whose turn has come. Run again, it goes on from the checkpoint.

    `partitions` of the state (0: spark.sql.shuffle.partitions) are fixed by the first run of a checkpoint.
    """
    with settings(spark, {PROVIDER[0]: PROVIDER[1]} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})):
        rows = prompts_in_turn(spark.readStream.schema(REQUESTS).parquet(requests), spark.readStream.schema(RESPONSES).parquet(responses))
        return rows.writeStream.format("parquet").outputMode("append").option("path", prompts).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_in_turn(spark: SparkSession, requests: str, responses: str, prompts: str, checkpoint: str, call: Callable[[str], str], tries: int = 3) -> int:
    """Asks, scores and answers until no prompt is open; the number of rounds. All courses advance together, a batch each a round.

    Rounds end with the longest course. A run that is killed goes on where it was: prompts are written once, by their checkpoint, and
    those without a response are scored again.
    """
    rounds = 0
    spark.createDataFrame([], RESPONSES).write.mode("append").parquet(responses)  # a stream needs its folder
    while True:
        ask(spark, requests, responses, prompts, checkpoint).awaitTermination()
        answered = spark.read.schema(RESPONSES).parquet(responses)
        open_ = spark.read.schema("doc_id string, batch int, prompt string").parquet(prompts).join(answered, ["doc_id", "batch"], "left_anti")
        if open_.isEmpty():
            return rounds
        found = S.score_prompts(open_, call, tries).withColumnRenamed("ord", "batch")
        found.select("doc_id", "batch", "raw", "error").write.mode("append").parquet(responses)
        rounds += 1
