"""The state of open requests without Spark: what it holds, and that it costs linear time."""

import random
import time

import pandas as pd
import pytest

from opslens.streaming.requests import _FIELDS, Collecting


class Cell:
    def __init__(self):
        self.value, self.writes = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if not isinstance(self.value, list) else iter(self.value)

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Rows(Cell):
    def appendList(self, rows):
        if self.value is None:
            self.value = []
        self.value.extend(rows)
        self.writes += len(rows)


class Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, name, schema):
        self.rows = Rows()
        return self.rows

    def getValueState(self, name, schema):
        return Cell()

    def listTimers(self):
        return list(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Timers:
    def getCurrentWatermarkInMs(self):
        return 0


def batch(numbers, ended=False):
    rows = [(n, 10**9 + n, "/u", "SELECT 1", "{}", 1.0, "c") for n in numbers]
    return pd.DataFrame(rows, columns=list(_FIELDS)).assign(ended=ended)


def closed(cap, batches):
    state, handle = Collecting(cap), Handle()
    state.init(handle)
    out = []
    for i, numbers in enumerate(batches):
        out += list(state.handleInputRows(("r",), iter([batch(numbers, i == len(batches) - 1)]), Timers()))
    assert handle.timers == [] and not handle.rows.exists()
    return [int(n) for frame in out for n in frame["seq"]], handle.rows.writes


@pytest.mark.parametrize("cap", [None, 1, 7, 50])
@pytest.mark.parametrize("seed", range(4))
def test_first_samples_are_held(cap, seed):
    rng = random.Random(seed)
    numbers = rng.sample(range(1000), 90)
    if seed == 0:
        numbers.sort()
    cuts = sorted(rng.sample(range(1, 90), 6))
    batches = [numbers[a:b] for a, b in zip([0, *cuts], [*cuts, 90])]
    assert closed(cap, batches)[0] == sorted(numbers)[:cap]


def test_many_samples_cost_linear_time():
    started = time.perf_counter()
    found, writes = closed(None, [range(n, n + 500) for n in range(0, 100_000, 500)])
    assert len(found) == writes == 100_000
    assert time.perf_counter() - started < 20
