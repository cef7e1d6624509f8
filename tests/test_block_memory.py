"""A task that works on pairs of blocks holds a few of its batches at a time, however many it is given."""
import gc
import weakref

import numpy as np
import pyarrow as pa
import pytest

from shelfsense.operators import similarity as sim


class Bytes(bytearray):
    """Bytes that tell when they go."""


@pytest.fixture()
def pairs():
    """(x, y) batches of all pairs of 12 blocks of 20 items, read from bytes that are watched, and the references to these bytes."""
    r, rows = np.random.default_rng(1), []
    for k in range(12):
        t = np.sort(r.choice(40, 15, replace=False))
        of = r.integers(0, 20, (15, 4))
        cells = [np.unique(x) for x in of]
        rows.append({"block": k, "ids": [100 * k + i for i in range(20)], "terms": t.astype(np.int64).tobytes(),
                     "ends": np.cumsum([len(c) for c in cells]).astype(np.int32).tobytes(), "rows": np.concatenate(cells).astype(np.int32).tobytes(),
                     "w": r.random(sum(map(len, cells))).tobytes(), "own": [int(v) for v in r.integers(0, 2, 20)], "probes": [int(v) for v in r.integers(0, 2, 20)],
                     "asked": [{"a": 100 * k + 1, "b": 100 * j + 2} for j in range(12)]})
    refs = []

    def batches(columns):
        for x in rows:
            for y in rows:
                sink = pa.BufferOutputStream()
                batch = pa.RecordBatch.from_pylist([{f"x_{c}": x[c] for c in columns} | {f"y_{c}": y[c] for c in columns}])
                for c in ("own", "probes"):
                    if c in columns:
                        for p in "xy":
                            at = batch.schema.get_field_index(f"{p}_{c}")
                            batch = batch.set_column(at, f"{p}_{c}", pa.ListArray.from_arrays(pa.array([0, 20], pa.int32()), pa.ListArray.from_arrays(pa.array(range(21), pa.int32()), batch.column(at).values)))
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch)
                held = Bytes(sink.getvalue().to_pybytes())
                refs.append(weakref.ref(held))
                yield pa.ipc.open_stream(pa.py_buffer(held)).read_next_batch()
                held = batch = None
                alive.append(sum(ref() is not None for ref in refs))
    alive = []
    return batches, alive


class Plan:
    """Stands for a table of blocks: it keeps the function that a task runs."""

    def __init__(self, columns):
        from pyspark.sql import types as T
        self.columns, self.schema = columns, T.StructType([T.StructField("ids", T.ArrayType(T.LongType()))])

    def mapInArrow(self, task, schema):
        self.task = task
        return self


COLUMNS = ["block", "ids", "terms", "ends", "rows", "w"]


@pytest.mark.parametrize("top_n, more", [(3, []), (None, []), (3, ["own", "probes"])])
def test_batches_go_when_they_are_worked_on(monkeypatch, pairs, top_n, more):
    batches, alive = pairs
    monkeypatch.setattr(sim, "crossed", lambda blocks, left, half=False: blocks)
    plan = sim.block_pairs(Plan(COLUMNS + more), 0.2, top_n)
    gc.disable()
    try:
        found = sum(b.num_rows for b in plan.task(batches(COLUMNS + more)))
    finally:
        gc.enable()
    assert found and len(alive) == 144 and max(alive) <= 3


def test_blocks_leave_nothing_behind(pairs):
    batches, _ = pairs
    gc.disable()
    try:
        batch = next(batches(COLUMNS))
        block = sim.Block(batch, 0, "x_")
        sim.pair_products(block, sim.Block(batch, 0, "y_"), np.array([0, 1]), np.array([0, 1]))
        ref = weakref.ref(block)
        del block
        assert ref() is None
    finally:
        gc.enable()
