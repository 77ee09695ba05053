"""Folds in order over streams: rows wait for the watermark, then are taken in order of event time."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkvault.operators.fold import OUT_ROWS, Fold

#: The state store that timers and lists of state ask for.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that keys are dealt into: a call of the processor, with its round trips to the state store, is for a group.
GROUPS = 4096


class Ordered(StatefulProcessor):
    """Runs a fold for each key of a group.

    A group has the rows that the watermark has not passed, as a list of Arrow
    batches, and the states of its keys. One timer stands for the earliest of
    the waiting rows and of what the fold has due; where neither is left,
    nothing is kept. Rows are put in order as columns, and taken and handed on
    by ``OUT_ROWS``, so that few of many are there as objects.
    """

    def __init__(self, fold: Fold, names: list[str], kinds: pa.Schema, keys: list[str], order: list[tuple[str, bool]]):
        self.fold, self.names, self.kinds, self.keys, self.order = fold, names, kinds, keys, order
        self.results = [c.split()[0].strip("`") for c in fold.schema.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.states = handle.getValueState("states", "data binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frame in rows:
            columns = [pa.Array.from_pandas(frame[f.name], type=f.type) for f in self.kinds]
            self.waiting.appendList([(pa.record_batch(columns, schema=self.kinds).serialize().to_pybytes(),)])
            least = int(frame["us"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(r[0]), self.kinds) for r in self.waiting.get()], self.kinds)
        over = pc.less(rows.column("us"), now)
        ready, later = rows.filter(over), rows.filter(pc.invert(over))
        n, earliest = len(rows), pc.min(later.column("us")).as_py()
        del rows, over
        if len(later) < n:
            self.waiting.clear()
            if len(later):
                self.waiting.put([(b.serialize().to_pybytes(),) for b in later.combine_chunks().to_batches(OUT_ROWS)])
        del later
        held = self.states.get()
        states = pickle.loads(held[0]) if held else {}
        out, own, state = [], None, None
        for batch in self.sorted(ready).to_batches(OUT_ROWS):
            for row in batch.to_pylist():
                key_of_row = tuple(row[k] for k in self.keys)
                if own is None or key_of_row != own:
                    own = key_of_row
                    state = states[own] if own in states else states.setdefault(own, self.fold.start())
                out += self.fold.step(state, row)
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=self.results)
                out = []
        ahead = [] if earliest is None else [earliest]
        for own, state in list(states.items()):
            out += self.fold.expire(state, now)
            if self.fold.empty(state):
                del states[own]
            elif (due := self.fold.due(state)) is not None:
                ahead.append(due)
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=self.results)
                out = []
        if ahead:
            self.handle.registerTimer(max(-(-min(ahead) // 1000), now // 1000 + 1))
        if states:
            self.states.update((pickle.dumps(states),))
        elif held:
            self.states.clear()
        if out:
            yield pd.DataFrame(out, columns=self.results)
        if n > OUT_ROWS:
            del ready
            pa.default_memory_pool().release_unused()

    def sorted(self, rows: pa.Table) -> pa.Table:
        """``rows`` by key and in order; nulls come first where it rises, and last where it falls."""
        by = []
        for name, rising in [*((k, True) for k in self.keys), *self.order]:
            way = "ascending" if rising else "descending"
            if rows.column(name).null_count:
                rows = rows.append_column(f"{len(by)} there", pc.is_valid(rows.column(name)).cast(pa.int8()))
                by.append((f"{len(by)} there", way))
            by.append((name, way))
        return rows.take(pc.sort_indices(rows, by)).select(self.names)


def ordered_stream(rows: DataFrame, keys: list[str], order: list[tuple[str, bool]], fold: Fold, late: str) -> DataFrame:
    """What ``fold`` makes of the rows of each key, taken by ``order`` (column, rising), of which the first is ``us``.

    ``rows`` has ``us`` and the same time as ``ts``, which may be up to
    ``late`` behind the latest; rows later than that are dropped. A row has its
    effect once the watermark is behind it, so that rows may come out of order.
    The session must keep state in RocksDB (``spark.sql.streaming.stateStore.providerClass``);
    where it has another store, that is set for the session.
    """
    spark = rows.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = [c for c in rows.columns if c != "ts"]
    kinds = to_arrow_schema(rows.select(*names).schema)
    group = "_" * max(map(len, rows.columns)) + "group"  # longer than any column
    grouped = rows.withColumn(group, F.pmod(F.xxhash64(*keys), F.lit(GROUPS))).withWatermark("ts", late).groupBy(group)
    return grouped.transformWithStateInPandas(Ordered(fold, names, kinds, keys, order), fold.schema, "append", "EventTime")
