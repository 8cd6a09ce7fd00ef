"""One definition of an ordered, keyed, stateful operator for batch and streaming.

A ``Fold`` holds a stream's state; ``step`` takes a row and returns output
rows. In batch a stream's rows are sorted and folded; in Structured Streaming
the state is kept between micro-batches as one blob, rows of a micro-batch are
sorted, and rows behind the stream's position are dropped, for state can't go back.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Fold:
    """State of one stream. Subclasses are built without arguments and must pickle."""

    def step(self, row: dict) -> list[dict]:
        raise NotImplementedError

    def end(self) -> list[dict]:
        """Rows that only the end of the stream releases (batch)."""
        return []


def _rows(frame: pd.DataFrame) -> Iterator[dict]:
    """Rows with None for what is missing; the check is made column by column, not row by row."""
    columns = []
    for name in frame.columns:
        column = frame[name]
        missing = column.isna().to_numpy()
        values = column.astype(object).tolist()
        columns.append([None if m else v for v, m in zip(values, missing, strict=True)] if missing.any() else values)
    names = list(frame.columns)
    return (dict(zip(names, values, strict=True)) for values in zip(*columns, strict=True))


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def by_stream(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every stream whole in one partition and in order, streams one after the other."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *[o for o in order if o not in keys])


OUT_ROWS, OUT_VALUES = 2000, 2_000_000


def fold_batch(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], Fold], schema: str) -> DataFrame:
    """Folds every stream in order. ``schema`` names the output columns; keys among them are filled in.

    Rows come and go in batches, so a task holds a stream's state and a batch, never a whole stream.
    """
    names = [c.split()[0] for c in _columns(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, now, key, out, weight = None, None, {}, [], 0
        for frame in frames:
            for row in _rows(frame):
                place = tuple(row[k] for k in keys)
                if fold is None or place != now:
                    if fold is not None:
                        out += [key | r for r in fold.end()]
                    fold, now, key = make(), place, {k: row[k] for k in keys}
                for r in fold.step(row):
                    out.append(key | r)
                    weight += sum(len(v) for v in r.values() if isinstance(v, list | bytes))
                if len(out) >= OUT_ROWS or weight > OUT_VALUES:
                    yield _frame(out, names)
                    out, weight = [], 0
        if fold is not None:
            out += [key | r for r in fold.end()]
        if out:
            yield _frame(out, names)

    return by_stream(df, keys, order).mapInPandas(run, schema)


def _columns(schema: str) -> list[str]:
    """Splits a DDL schema at commas outside brackets."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[at:k].strip())
            at = k + 1
    return [*out, schema[at:].strip()]


class _Processor(StatefulProcessor):
    def __init__(self, keys: list[str], order: list[str], make: Callable[[], Fold], names: list[str]):
        self.keys, self.order, self.make, self.names = keys, order, make, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "blob binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fold, last = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else (self.make(), None)
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out, named = [], dict(zip(self.keys, key, strict=True))
        for row in _rows(frame):
            place = tuple(row[o] for o in self.order)
            if last is not None and place <= last:
                continue
            last = place
            out += [named | r for r in fold.step(row)]
        self.state.update((pickle.dumps((fold, last)),))
        yield _frame(out, self.names)

    def close(self) -> None:
        return


def fold_stream(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], Fold], schema: str) -> DataFrame:
    """The same fold over a streaming DataFrame; needs the RocksDB state store provider."""
    names = [c.split()[0] for c in _columns(schema)]
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=_Processor(keys, order, make, names), outputStructType=schema, outputMode="Append", timeMode="None")
