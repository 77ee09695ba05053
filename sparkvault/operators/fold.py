"""Folds in order: what a key's rows, one after the other, make of a small state.

A :class:`Fold` is a rule that runs in two ways. Over a table,
:func:`ordered_fold` has Spark deal the rows out by key and sort them, with
spilling where they are many; a partition is then read batch by batch with the
state of one key carried on, so that a key of any length takes the memory of
one batch. Over a stream, ``streaming.ordered`` keeps the state between batches
and holds rows back until the watermark has passed them.

Rows have ``us``, their time in microseconds, where a rule has to do with time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

State, Row = Any, dict[str, Any]

#: Rows that are handed on at once.
OUT_ROWS = 10_000
#: A time after all rows.
END = 1 << 62


class Fold:
    """A rule over a key's rows in order. Results are tuples of ``schema``'s columns."""

    schema: str

    def start(self) -> State:
        """The state of a key without rows."""

    def step(self, state: State, row: Row) -> Iterable[tuple]:
        """Take the next row; changes the state in place."""
        raise NotImplementedError

    def due(self, state: State) -> int | None:
        """The time in microseconds at which :meth:`expire` has something to do, if any."""
        return None

    def expire(self, state: State, now: int) -> Iterable[tuple]:
        """What comes of time alone, once all rows before ``now`` have been taken; ``END`` after the last row of a table."""
        return ()

    def empty(self, state: State) -> bool:
        """Whether the state is as at the start, and need not be kept."""
        return not state


def micros(window: str) -> int:
    """An interval such as ``250 milliseconds`` in microseconds."""
    return pd.Timedelta(window).value // 1000


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str | Column], fold: Fold) -> DataFrame:
    """What ``fold`` makes of the rows of each key in ``order``.

    Null keys are one key. Rows that are equal in ``order`` come in any order.
    """
    arrow = to_arrow_schema(StructType.fromDDL(fold.schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held = None, None, []

        def cut() -> pa.RecordBatch:
            columns = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if key is None or own != key:
                    if key is not None:
                        held += fold.expire(state, END)
                    key, state = own, fold.start()
                held += fold.step(state, row)
                if len(held) >= OUT_ROWS:
                    yield cut()
                    held.clear()
        if key is not None:
            held += fold.expire(state, END)
        if held:
            yield cut()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, fold.schema)


class PairRenames(Fold):
    """(vault_id, hash, from, to, us): each delete with the create of the same content that answers it, or alone.

    Rows are (vault_id, hash, action, path, us) by vault and hash. Deletes wait
    in a queue; a create takes the first, and a delete leaves it with a null
    ``to`` once more than the window has passed. A create that finds none
    waiting leaves no trace. Without a hash nothing is paired.
    """

    schema = "vault_id string, hash string, `from` string, `to` string, us long"

    def __init__(self, window: str):
        self.window = micros(window)

    def start(self) -> State:
        return []

    def step(self, state: State, row: Row) -> Iterable[tuple]:
        yield from self.expire(state, row["us"])
        vault, content = row["vault_id"], row["hash"]
        if row["action"] == "delete":
            if content is None:
                yield vault, None, row["path"], None, row["us"]
            else:
                state.append((vault, content, row["path"], row["us"]))
        elif state:
            _, _, path, us = state.pop(0)
            yield vault, content, path, row["path"], us

    def due(self, state: State) -> int | None:
        return state[0][3] + self.window + 1 if state else None

    def expire(self, state: State, now: int) -> Iterable[tuple]:
        while state and state[0][3] + self.window < now:
            vault, content, path, us = state.pop(0)
            yield vault, content, path, None, us


class StuckWrites(Fold):
    """(client_id, path, seq, stuck) of the writes of a path, by vault and path.

    A client's write is stuck if its hash is among the last ``depth`` accepted
    ones of the client at this path; stuck writes are not remembered. A row of
    ``kind`` commit has all clients' writes of the path forgotten.
    """

    schema = "client_id string, path string, seq long, stuck boolean"

    def __init__(self, depth: int = 3):
        self.depth = depth

    def start(self) -> State:
        return {}

    def step(self, state: State, row: Row) -> Iterable[tuple]:
        if row["kind"] == "commit":
            state.clear()
            return
        recent = state.setdefault(row["client_id"], [])
        stuck = row["hash"] in recent
        if not stuck:
            recent.append(row["hash"])
            del recent[: -self.depth]
        yield row["client_id"], row["path"], row["seq"], stuck


class RateLimit(Fold):
    """(key, seq, in_window, refused): the accepted rows of the last ``seconds`` before each, and whether they are ``limit``.

    Refused rows do not count for later ones.
    """

    def __init__(self, limit: int, seconds: int, key: str = "client_id"):
        self.limit, self.window, self.key = limit, seconds * 1_000_000, key
        self.schema = f"{key} string, seq long, in_window long, refused boolean"

    def start(self) -> State:
        return []

    def step(self, state: State, row: Row) -> Iterable[tuple]:
        self.forget(state, row["us"])
        n = len(state)
        if n < self.limit:
            state.append(row["us"])
        yield row[self.key], row["seq"], n, n >= self.limit

    def forget(self, state: State, now: int) -> None:
        while state and state[0] <= now - self.window:
            state.pop(0)

    def due(self, state: State) -> int | None:
        return state[-1] + self.window if state else None

    def expire(self, state: State, now: int) -> Iterable[tuple]:
        self.forget(state, now)
        return ()


class StagedCommits(Fold):
    """(client_id, ops, bytes, reason): the commits of a client's stage; rows have client_id, bytes, us.

    A stage is committed when it reaches a cap (byte_cap, file_cap), when
    nothing came for the quiet time, or when the longest delay has passed since
    its first op, whichever is first; of both at once the delay.
    """

    schema = "client_id string, ops long, bytes long, reason string"

    def __init__(self, max_bytes: int = 50 << 20, max_ops: int = 200, max_delay_s: float = 60, quiet_s: float = 3, at_end: bool = False):
        self.max_bytes, self.max_ops, self.at_end = max_bytes, max_ops, at_end
        self.max_delay, self.quiet = int(max_delay_s * 1_000_000), int(quiet_s * 1_000_000)

    def start(self) -> State:
        return {}

    def step(self, state: State, row: Row) -> Iterable[tuple]:
        yield from self.expire(state, row["us"])
        if not state:
            state.update(client=row["client_id"], ops=0, bytes=0, first=row["us"])
        state["ops"] += 1
        state["bytes"] += row["bytes"]
        state["last"] = row["us"]
        if state["bytes"] >= self.max_bytes or state["ops"] >= self.max_ops:
            yield self.commit(state, "byte_cap" if state["bytes"] >= self.max_bytes else "file_cap")

    def commit(self, state: State, reason: str) -> tuple:
        out = state["client"], state["ops"], state["bytes"], reason
        state.clear()
        return out

    def due(self, state: State) -> int | None:
        return min(state["first"] + self.max_delay, state["last"] + self.quiet) if state else None

    def expire(self, state: State, now: int) -> Iterable[tuple]:
        if state and self.due(state) <= now and (now < END or self.at_end):
            yield self.commit(state, "max_delay" if state["first"] + self.max_delay <= state["last"] + self.quiet else "quiet")


class PackBatches(Fold):
    """(key, seq, chunk): greedy chunks of at most ``target``; a larger row has a chunk of its own. Rows have by, seq, size."""

    def __init__(self, target: int, kind: str):
        self.target, self.schema = target, f"by {kind}, seq long, chunk int"

    def start(self) -> State:
        return [0, 0]

    def step(self, state: State, row: Row) -> Iterable[tuple]:
        if state[0] > 0 and state[0] + row["size"] > self.target:
            state[:] = 0, state[1] + 1
        state[0] += row["size"]
        yield row["by"], row["seq"], state[1]


class Debounce(Fold):
    """(by, batch, us): the batch of each row; one ends at a gap above ``idle_s`` and ``max_delay_s`` after its first row."""

    def __init__(self, idle_s: float, max_delay_s: float, kind: str):
        self.idle, self.most, self.schema = int(idle_s * 1_000_000), int(max_delay_s * 1_000_000), f"by {kind}, batch long, us long"

    def start(self) -> State:
        return {}

    def step(self, state: State, row: Row) -> Iterable[tuple]:
        us = row["us"]
        if not state:
            state.update(batch=0, first=us)
        elif us - state["last"] > self.idle or us - state["first"] >= self.most:
            state.update(batch=state["batch"] + 1, first=us)
        state["last"] = us
        yield row["by"], state["batch"], us


class Digest(Fold):
    """(vault_id, digest): the SHA-256 of a vault's lines, one after the other."""

    schema = "vault_id string, digest string"

    def start(self) -> State:
        return {}

    def step(self, state: State, row: Row) -> Iterable[tuple]:
        state.setdefault("vault", row["vault_id"])
        state.setdefault("digest", hashlib.sha256()).update(row["line"].encode())
        return ()

    def expire(self, state: State, now: int) -> Iterable[tuple]:
        yield state["vault"], state["digest"].hexdigest()
