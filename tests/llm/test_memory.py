"""What a Python worker takes at its peak, in MB: it is kept, beside the executor's heap, for the stages that follow."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from passagemill.llm import classlm, minhash


def peak(rows) -> float:
    tracemalloc.start()
    for _ in rows:
        pass
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def batch(rows: int, words: int, types: int) -> pa.RecordBatch:
    draw = np.random.default_rng(0).integers(0, types, (rows, words))
    return pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array([" ".join(f"word{x}" for x in row) for row in draw.tolist()])], ["doc_id", "text"])


LISTED = SimpleNamespace(value=[b"word%d" % x for x in range(20_000)])
STATES = np.full(len(LISTED.value) + 2, classlm.OTHER)


# 4

def test_signing_takes_a_slice_at_a_time():
    assert peak(minhash._sign(iter([batch(4_000, 500, 50_000)]))) < 6


# 6

@pytest.mark.parametrize("step, most", [("count", 40), ("pairs", 45), ("contexts", 45), ("rest", 140)])
def test_learning_takes_a_run_at_a_time(step, most):
    docs = iter([batch(8_000, 280, 800_000)])
    steps = {"count": lambda: classlm._count(docs), "pairs": lambda: classlm._pairs(docs, LISTED, 2000), "contexts": lambda: classlm._contexts(docs, LISTED, STATES, 2001), "rest": lambda: classlm._rest(docs, LISTED, STATES)}
    assert peak(steps[step]()) < most
