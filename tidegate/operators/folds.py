"""Sequential forms: what passes depends on what passed before, so no window frame tells it.

Rows come sorted by subject and order within a partition, and the state of one subject is all
that is held, whatever the number of its rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Deadband:
    def __init__(self):
        self.kept = None

    def step(self, ts, v, width):
        if self.kept is None or abs(v - self.kept) >= width:
            self.kept = v
            return True
        return False


class HoldOff:
    def __init__(self):
        self.passed = None

    def step(self, ts, v, ms):
        if self.passed is None or ts - self.passed >= ms:
            self.passed = ts
            return True
        return False


class ThrottleTicks:
    def __init__(self):
        self.passes: deque = deque()

    def step(self, ts, v, size, most):
        ok = sum(self.passes) < most
        self.passes.append(ok)
        if len(self.passes) > size:
            self.passes.popleft()
        return ok


class ThrottleTime:
    def __init__(self):
        self.passes: deque = deque()

    def step(self, ts, v, size, most):
        while self.passes and self.passes[0] < ts - size:
            self.passes.popleft()
        if len(self.passes) < most:
            self.passes.append(ts)
            return True
        return False


class Ewma:
    def __init__(self):
        self.value = None

    def step(self, ts, v, alpha):
        self.value = v if self.value is None else alpha * v + (1 - alpha) * self.value
        return self.value


FOLDS: dict[str, type] = {"deadband": Deadband, "hold-off": HoldOff, "throttle": ThrottleTicks, "throttle-ms": ThrottleTime, "ewma": Ewma}


def folded(df: DataFrame, kind: str, guard: str, value: str, params: tuple, out: str, order: str, partitioned: bool = False) -> DataFrame:
    """``df`` with a column ``out``: the fold's answer on rows where ``guard`` holds, null elsewhere.
    ``partitioned``: the rows of a subject lie in one partition already."""
    number = kind == "ewma"
    make: Callable = FOLDS[kind]
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType() if number else T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subject, fold = object(), None
        for batch in batches:
            got = []
            for s, on, ts, v in zip(*(batch.column(c).to_pylist() for c in ("subject", guard, "ts_ms", value)), strict=True):
                if s != subject:
                    subject, fold = s, make()
                got.append(fold.step(ts, v, *params) if on else None)
            columns = [*batch.columns, pa.array(got, pa.float64() if number else pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, out])

    dealt = df if partitioned else df.repartition("subject")
    return dealt.sortWithinPartitions("subject", order).mapInArrow(work, schema)
