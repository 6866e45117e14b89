"""The refusal gate over streamed answers: deltas come in any order, what may be shown goes out.

What can be shown is a function of the text so far: nothing while it may still become the
refusal sentence, the sentence alone once it is one, else the text. The operator keeps, per
answer, the text that it has not shown yet and the deltas that came before their turn; a part
is shown as soon as all before it are there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftspark.functions import text as T

SHOWN = "answer_id string, seq int, shown string, done boolean"
#: Groups of keys that a stream with state calls Python for, in each batch that has rows of theirs.
BUCKETS = 1024
#: Spark keeps state of this kind in RocksDB.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def visible(text: str, ended: bool = False) -> str:
    """What a reader may see of the beginning of an answer; case and white space before it don't matter."""
    own, refusal = text.lstrip().casefold(), T.REFUSAL.casefold()
    if own.startswith(refusal):
        return T.REFUSAL
    return "" if refusal.startswith(own) and not ended else text


def opened(at: tuple, take: Callable[[int], tuple | None]) -> tuple[tuple, list[tuple]]:
    """The state after the parts that have their turn, and what each shows: (seq, shown, last). take: the part of a number (text, last), once, or None."""
    turn, held, refused = at
    out = []
    while (part := take(turn)) is not None:
        text, last = part
        if held is None:
            shown = "" if refused else text
        else:
            shown = visible(held + text, last)
            refused = shown == T.REFUSAL
            held = None if shown or last else held + text
        out.append((turn, shown, last))
        turn += 1
    return (turn, held, refused), out


class Gate(StatefulProcessor):
    """For one answer a key: the next part's number, the text held back (null once the answer is open or refused), and parts before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", S.StructType([S.StructField("next", S.IntegerType()), S.StructField("held", S.StringType()), S.StructField("refused", S.BooleanType())]))
        self.early = handle.getMapState("early", S.StructType([S.StructField("seq", S.IntegerType())]), S.StructType([S.StructField("part", S.StringType()), S.StructField("last", S.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.at.get() if self.at.exists() else (0, "", False)
        came = {int(s): (p, bool(e)) for pdf in rows for s, p, e in zip(pdf["seq"], pdf["part"], pdf["last"], strict=True) if s >= at[0]}

        def take(turn: int) -> tuple | None:
            part = came.pop(turn, None)
            if part is None and self.early.containsKey((turn,)):
                part = tuple(self.early.getValue((turn,)))
                self.early.removeKey((turn,))
            return part

        at, out = opened(at, take)
        for s, p in came.items():
            self.early.updateValue((s,), p)
        self.at.update(at)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["answer_id", "seq", "shown", "done"])

    def close(self) -> None:
        pass


class Gates(StatefulProcessor):
    """The same for the answers of a bucket, whose states are one row of arrays: it is read and written once a batch, however many parts came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("answers", "answer_id array<string>, next array<int>, held array<string>, refused array<boolean>, early array<array<struct<seq: int, part: string, last: boolean>>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {a: (tuple(at), [tuple(x) for x in early]) for a, *at, early in zip(*self.state.get(), strict=True)} if self.state.exists() else {}
        came: dict[str, dict[int, tuple]] = {}
        for pdf in rows:
            for a, s, p, e in zip(*(pdf[c].tolist() for c in ("answer_id", "seq", "part", "last")), strict=True):
                came.setdefault(a, {})[s] = (p, e)
        out = []
        for answer, parts in came.items():
            at, early = held.get(answer, ((0, "", False), []))
            waiting = {s: (p, e) for s, p, e in early} | {s: x for s, x in parts.items() if s >= at[0]}
            at, shown = opened(at, lambda turn, waiting=waiting: waiting.pop(turn, None))
            out += [(answer, *x) for x in shown]
            held[answer] = at, [(s, *x) for s, x in waiting.items()]
        self.state.update((list(held), *(list(x) for x in zip(*((*at, early) for at, early in held.values()), strict=True))))
        yield pd.DataFrame(out, columns=["answer_id", "seq", "shown", "done"])

    def close(self) -> None:
        pass


def shown(deltas: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of parts (answer_id, seq from 0, part, last) to what each adds to the answer that is seen.

    A part that comes twice counts once. Answers that never end keep their state. A call into
    Python costs more than an answer's rows, so it is made for a bucket of answers; its states are read and
    written together, so the buckets should be so many that some thousand answers fall in each.
    """
    deltas.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = deltas.selectExpr("cast(answer_id as string) as answer_id", "cast(seq as int) as seq", "coalesce(part, '') as part", "coalesce(last, false) as last").withColumn("bucket", F.pmod(F.xxhash64("answer_id"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(Gates(), outputStructType=SHOWN, outputMode="append", timeMode="none")
