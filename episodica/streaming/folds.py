"""Folds along episodes: one rule, run over sorted partitions in batch and with keyed state in streams.

A rule names its input columns (scalars, or lists of one length), its outputs and its state, and makes folds. A fold takes
the next steps of one episode as arrays and gives an output for each; stored() is what it carries on. Batch repartitions by
episode, sorts, and folds rows as they stream by, so an episode may be of any length; a stream keeps what stored() gives in
a ValueState of transformWithState. NaN in a floating output becomes NULL.

Steps of an episode come in order within and across micro-batches.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..runtime import ship


class Rule:
    """Columns, DDL of outputs (after ep and q) and state, and the fold of an episode."""

    inputs: tuple[str, ...] = ()
    output: str = ""
    state: str = ""

    def fold(self, stored: tuple | None = None) -> Any:
        raise NotImplementedError


def _array(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _ddl(rule: Rule) -> str:
    return f"ep long, q int, {rule.output}"


def batch(df: DataFrame, rule: Rule) -> DataFrame:
    """The rule's outputs at every step of df (ep, q and the inputs)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    kinds = StructType.fromDDL(_ddl(rule))
    schema = to_arrow_schema(kinds)
    floats = {f.name for f in kinds if isinstance(f.dataType, (FloatType, DoubleType))}

    def run(batches):
        held, fold = None, None
        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: _array(b.column(n)) for n in b.schema.names}
            edges = np.flatnonzero(np.diff(cols["ep"])) + 1
            done: dict[str, list] = {n: [] for n in schema.names[2:]}
            for low, high in zip([0, *edges], [*edges, b.num_rows]):
                if held != cols["ep"][low]:
                    held, fold = cols["ep"][low], rule.fold()
                for name, part in fold.take(cols["q"][low:high], {n: cols[n][low:high] for n in rule.inputs}).items():
                    done[name].extend(part)
            arrays = [pa.array(np.array(done[n]) if n in floats else done[n], schema.field(n).type, from_pandas=n in floats) for n in schema.names[2:]]
            yield pa.record_batch([b.column("ep").cast(pa.int64()), b.column("q").cast(pa.int32()), *arrays], schema=schema)

    return df.repartition("ep").sortWithinPartitions("ep", "q").select("ep", "q", *rule.inputs).mapInArrow(run, kinds)


class Processor(StatefulProcessor):
    """Folds the steps of an episode in each micro-batch."""

    def __init__(self, rule: Rule, floats: set[str]) -> None:
        self.rule, self.floats = rule, floats

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("fold", self.rule.state)

    def handleInputRows(self, key, rows, timerValues):
        fold = self.rule.fold(self.held.get() if self.held.exists() else None)
        frame = pd.concat(list(rows)).sort_values("q")
        q = frame["q"].to_numpy()
        column = lambda n: np.stack(frame[n].map(np.asarray)) if frame[n].dtype == object else frame[n].to_numpy()
        out = fold.take(q, {n: column(n) for n in self.rule.inputs})
        self.held.update(fold.stored())
        done = pd.DataFrame({"ep": key[0], "q": q.astype(np.int32)} | {n: list(v) for n, v in out.items()})
        for n in self.floats:
            done[n] = done[n].astype(object).where(done[n].notna(), None)
        yield done

    def close(self) -> None:
        pass


def stream(df: DataFrame, rule: Rule) -> DataFrame:
    """The same outputs over a stream; the session needs the RocksDB state store."""
    ship(df.sparkSession)
    floats = {f.name for f in StructType.fromDDL(_ddl(rule)) if isinstance(f.dataType, (FloatType, DoubleType))}
    return df.select("ep", "q", *rule.inputs).groupBy("ep").transformWithStateInPandas(Processor(rule, floats), _ddl(rule), "Update", "None")
