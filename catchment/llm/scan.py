"""Running sums, positions and neighbours over a sorted table of any size.

Rows are sorted by range, so equal segment keys may span tasks; each task
scans its own rows, and what it has to know of the tasks before and after
(one first and one last row of each) is added in a second pass.  Only those
rows, two a task, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import ship_package, written


def _wrap(x: int) -> int:
    """A Python integer as the 64-bit one that numpy's sums would hold."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def sorted_scan(
    df: DataFrame,
    segment: list[str],
    order: list[str],
    keep: list[str],
    sums: list[str] = (),
    firsts: list[str] = (),
    nexts: list[str] = (),
) -> DataFrame:
    """The ``keep`` columns of ``df``, sorted by ``segment`` then ``order``,
    with ``pos`` (from 0 in the segment), ``sum_<c>`` (up to and with the row,
    64 bits, wrapping), ``first_<c>`` (of the segment's first row),
    ``next_<c>`` (of the next row of all) and ``next_same`` (whether that is
    in this segment).  Segment, sum, first and next columns are longs without
    nulls.  Rows with equal keys are in any order.
    """
    ship_package(df.sparkSession)
    keys = [*segment, *order]
    carried = list(dict.fromkeys([*keep, *segment, *sums, *firsts, *nexts]))
    # rows with equal keys are dealt apart by their place in the input
    tie = F.monotonically_increasing_id().alias("__tie")
    rows = df.select(*dict.fromkeys([*keys, *carried]), tie)
    dealt = rows.repartitionByRange(*keys, "__tie").sortWithinPartitions(*keys).select(*carried)
    made = [("pos", "long"), *((f"sum_{c}", "long") for c in sums), *((f"first_{c}", "long") for c in firsts),
            *((f"next_{c}", "long") for c in nexts), ("next_same", "boolean"),
            ("__part", "int"), ("__head", "boolean"), ("__edge", "int")]
    schema = T.StructType([*dealt.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in made)])
    local = _LocalScan(segment, sums, firsts, nexts, [n for n, _ in made])
    stage = written(dealt.mapInArrow(local, schema), "scan")
    edges = stage.filter("__edge > 0").collect()
    carry = _carries(edges, segment, sums, firsts, nexts)
    out = T.StructType([f for f in schema.fields if f.name in keep or not f.name.startswith("__") and f.name in dict(made)])
    return stage.mapInArrow(_Carry(carry, sums, firsts, nexts, [f.name for f in out.fields]), out)


class _LocalScan:
    """Scan of one task's sorted rows; ``__edge`` marks its first (1) and
    last (2) row, ``__head`` the rows of its first segment."""

    def __init__(self, segment, sums, firsts, nexts, made) -> None:
        self.segment, self.sums, self.firsts, self.nexts, self.made = segment, sums, firsts, nexts, made

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield self._finish(*held, batch)
            names = batch.schema.names
            column = lambda c: batch.column(names.index(c)).to_numpy()
            n = batch.num_rows
            new = np.zeros(n, bool)
            for c in self.segment:
                values = column(c)
                new[1:] |= values[1:] != values[:-1]
            key = tuple(int(column(c)[0]) for c in self.segment)
            continues = state is not None and state["key"] == key
            new[0] = not continues
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: before this batch
            inherited = start < 0
            pos = np.arange(n) - np.maximum(start, 0)
            out = {"pos": np.where(inherited, pos + (state["pos"] + 1 if continues else 0), pos)}
            with np.errstate(over="ignore"):
                for c in self.sums:
                    values = column(c)
                    total = np.cumsum(values)
                    before = np.where(inherited, state["sum_" + c] if continues else 0, -(total - values)[np.maximum(start, 0)])
                    out["sum_" + c] = total + before
            for c in self.firsts:
                values = column(c)
                out["first_" + c] = np.where(inherited, state["first_" + c] if continues else 0, values[np.maximum(start, 0)])
            first = state is None
            segments = np.cumsum(new) - (1 if first else 0)
            head = (segments == 0) & (first or state["head"])
            edge = np.zeros(n, np.int32)
            edge[0] = 1 if first else 0
            state = {name: int(values[-1]) for name, values in out.items()}
            state["key"] = tuple(int(column(c)[-1]) for c in self.segment)
            state["head"] = bool(head[-1])
            held = (batch, out, part, head, edge, new)
        if held is not None:
            yield self._finish(*held, None)

    def _finish(self, batch, out, part, head, edge, new, following) -> pa.RecordBatch:
        n = batch.num_rows
        same = np.append(~new[1:], False)
        columns = {name: pa.array(values, pa.int64()) for name, values in out.items()}
        if following is None:
            edge[-1] += 2
        else:
            same[-1] = all(following.column(c)[0] == batch.column(c)[-1] for c in self.segment)
        for c in self.nexts:
            rest = batch.column(c).slice(1)
            last = following.column(c).slice(0, 1) if following is not None else pa.nulls(1, pa.int64())
            columns["next_" + c] = pa.concat_arrays([rest.cast(pa.int64()), last.cast(pa.int64())])
        columns |= {"next_same": pa.array(same), "__part": pa.array(np.full(n, part, np.int32)),
                    "__head": pa.array(head), "__edge": pa.array(edge)}
        return pa.RecordBatch.from_arrays(
            [*batch.columns, *(columns[name] for name in self.made)], [*batch.schema.names, *self.made]
        )


def _carries(edges, segment, sums, firsts, nexts) -> dict:
    """What each task's rows lack: of the tasks before, for its first
    segment; of the one after, for its last row."""
    begins = {r["__part"]: r for r in edges if r["__edge"] & 1}
    ends = {r["__part"]: r for r in edges if r["__edge"] & 2}
    carry, state = {}, None
    parts = sorted(begins)
    for part, after in zip(parts, [*parts[1:], None], strict=False):
        begin, end = begins[part], ends[part]
        key = tuple(begin[c] for c in segment)
        before = state if state is not None and state["key"] == key else None
        follows = begins[after] if after is not None else None
        carry[part] = {
            "before": before,
            "next": {c: follows[c] for c in nexts} if follows is not None else None,
            "same": follows is not None and all(follows[c] == end[c] for c in segment),
        }
        joined = before if before is not None and end["__head"] else None
        state = {"key": tuple(end[c] for c in segment), "pos": end["pos"] + (joined["pos"] + 1 if joined else 0)}
        for c in sums:
            state["sum_" + c] = _wrap(end["sum_" + c] + (joined["sum_" + c] if joined else 0))
        for c in firsts:
            state["first_" + c] = joined["first_" + c] if joined else end["first_" + c]
    return carry


class _Carry:
    """Adds to local scans what the other tasks' rows give."""

    def __init__(self, carry, sums, firsts, nexts, names) -> None:
        self.carry, self.sums, self.firsts, self.nexts, self.names = carry, sums, firsts, nexts, names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            part, head, last = get("__part"), get("__head"), get("__edge") >= 2
            columns = {}
            for p in np.unique(part).tolist():
                carry, here = self.carry[p], part == p
                before = carry["before"]
                if before is not None:
                    rows = here & head
                    for name, add in [("pos", before["pos"] + 1), *(("sum_" + c, before["sum_" + c]) for c in self.sums)]:
                        values = columns.setdefault(name, get(name).copy())
                        with np.errstate(over="ignore"):
                            values[rows] += np.int64(add)
                    for c in self.firsts:
                        columns.setdefault("first_" + c, get("first_" + c).copy())[rows] = before["first_" + c]
                rows = here & last
                if carry["next"] is not None and rows.any():
                    columns.setdefault("next_same", get("next_same").copy())[rows] = carry["same"]
                    for c in self.nexts:
                        name = "next_" + c
                        old = columns.get(name, batch.column(name))
                        columns[name] = pc.if_else(pa.array(rows), pa.scalar(carry["next"][c], pa.int64()), old)
            arrays = [columns.get(name, batch.column(name)) for name in self.names]
            arrays = [pa.array(a) if isinstance(a, np.ndarray) else a for a in arrays]
            yield pa.RecordBatch.from_arrays(arrays, self.names)
