"""The journal of operations as a state machine for each item, over a table of events or a stream of them.

An event ``item, seq, state`` asks for a new state; legal ones are taken, others
rejected. In a table the order is ``seq``; in a stream an event that isn't newer
than the last one of its item is stale, so repeated and late events do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.rank import within

# States of an item and what may follow; an item begins as planned.
NEXT = {
    "": ("planned",),
    "planned": ("done", "failed", "skipped", "cancelled", "interrupted"),
    "done": ("undoing",),
    "undoing": ("undone", "undo_failed"),
    "undo_failed": ("undoing",),
    "failed": (),
    "skipped": (),
    "cancelled": (),
    "interrupted": (),
    "undone": (),
}
#: What an open state becomes when nothing follows in time.
LAPSED = {"planned": "interrupted", "undoing": "undo_failed"}
STATES = list(NEXT)
#: Events of an item that one task folds at a time.
PART_EVENTS = 1000
_MAP = "array<struct<to: int, taken: bigint>>"


def _step(at: Column, asked: Column) -> Column:
    """Where an item at ``to, taken`` is after an event that asks for the state of that number."""
    legal = F.array(*[F.array(*[F.lit(STATES.index(s)) for s in NEXT[name]]).cast("array<int>") for name in STATES])
    fits = F.array_contains(F.element_at(legal, at["to"] + 1), asked)
    return F.struct(F.when(fits, asked).otherwise(at["to"]).alias("to"), (at["taken"] + F.when(fits, 1).otherwise(0)).alias("taken"))


def folded(events: DataFrame) -> DataFrame:
    """``item, state, taken, rejected`` after all of ``events(item, seq, state)``; equal events count once, a null or unknown state is rejected.

    What a run of events does is a map from the state before to the state after,
    and maps of following runs combine; so the events of an item are folded in
    parts of ``PART_EVENTS``, and a task never holds more of a busy item.
    """
    number = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATES]), F.coalesce("state", F.lit("?"))) - 1, F.lit(-1)).cast("int")
    asked = events.where("item is not null and seq is not null").select("item", "seq", number.alias("asked")).distinct()
    parts = within(asked, ["item"], [F.col("seq"), F.col("asked")], "k").withColumn("part", F.expr(f"(k - 1) div {PART_EVENTS}"))
    start = F.array(*[F.struct(F.lit(k).alias("to"), F.lit(0).cast("bigint").alias("taken")) for k in range(len(STATES))]).cast(_MAP)
    each = parts.groupBy("item", "part").agg(F.sort_array(F.collect_list(F.struct("k", "asked"))).alias("run"), F.count("*").alias("n"))
    each = each.select("item", "part", "n", F.aggregate("run", start, lambda m, e: F.transform(m, lambda at: _step(at, e["asked"])).cast(_MAP)).alias("map"))
    whole = each.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("part", "map"))).alias("maps"), F.sum("n").alias("n"))
    first = F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("taken"))

    def after(at: Column, p: Column) -> Column:
        met = F.element_at(p["map"], at["to"] + 1)
        return F.struct(met["to"].alias("to"), (at["taken"] + met["taken"]).alias("taken"))

    out = whole.select("item", "n", F.aggregate("maps", first, after).alias("at"))
    return out.select("item", F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("at.to") + 1).alias("state"), F.col("at.taken").alias("taken"), (F.col("n") - F.col("at.taken")).alias("rejected"))


def take(state: str, last: int, asked: list[tuple[int, str]]) -> tuple[str, int, int, int, int]:
    """``state, last, taken, rejected, stale`` after events ``seq, state`` that arrived together."""
    taken = rejected = stale = 0
    for seq, new in sorted(asked, key=lambda e: (e[0], STATES.index(e[1]) if e[1] in NEXT else -1)):
        if seq <= last:
            stale += 1
        elif new in NEXT[state]:
            state, taken = new, taken + 1
        else:
            rejected += 1
        last = max(last, seq)
    return state, last, taken, rejected, stale


def tracked(events: DataFrame, lapse: str | None = None) -> DataFrame:
    """``item, state, taken, rejected, stale`` of each item that a batch of the stream ``events(item, seq, state, at)`` changes; ``at``: a time.

    State is one short row an item. With ``lapse``, an interval, an item that is
    planned or being undone is given up once the watermark has passed its last
    event by that much. Events of one item with equal ``seq`` must come in one batch.
    """
    milliseconds = int(pd.Timedelta(lapse).total_seconds() * 1000) if lapse else 0

    def one(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, last, taken, rejected, stale, at = held.get if held.exists else ("", -(1 << 62), 0, 0, 0, 0)
        if held.hasTimedOut:
            state = LAPSED.get(state, state)
            held.update((state, last, taken, rejected, stale, at))
        else:
            asked = []
            for rows in batches:
                asked += [(int(s), x) for s, x in zip(rows["seq"], rows["state"], strict=True)]
                at = max(at, int(rows["at"].max().timestamp() * 1000))
            asked = list(dict.fromkeys(asked))
            state, last, *more = take(state, last, asked)
            taken, rejected, stale = taken + more[0], rejected + more[1], stale + more[2]
            held.update((state, last, taken, rejected, stale, at))
            if lapse and state in LAPSED:
                held.setTimeoutTimestamp(max(at + milliseconds, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"item": [key[0]], "state": [state], "taken": [taken], "rejected": [rejected], "stale": [stale]})

    rows = events.where("item is not null and seq is not null").select("item", "seq", F.coalesce("state", F.lit("?")).alias("state"), "at")
    kind = events.schema["item"].dataType.simpleString()
    out = f"item {kind}, state string, taken bigint, rejected bigint, stale bigint"
    kept = "state string, last bigint, taken bigint, rejected bigint, stale bigint, at bigint"
    return rows.groupBy("item").applyInPandasWithState(one, out, kept, "update", GroupStateTimeout.EventTimeTimeout if lapse else GroupStateTimeout.NoTimeout)
