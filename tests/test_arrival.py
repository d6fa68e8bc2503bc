"""Streams' segments in the order of arrival: the same rows as a sort in memory, and few of them held at once."""

import pickle
import random
import tracemalloc
import weakref

import pandas as pd
import pytest

from millrace.model import Trigger, Window
from millrace.streaming import arrival, processors
from millrace.streaming.fold import CustomTrigger, Fold
from millrace.streaming.processors import WindowProcessor


class Store(dict):
    """A map state, and (by the key None) a value state."""

    iterator = dict.items
    removeKey = dict.pop  # noqa: N815
    updateValue = dict.__setitem__  # noqa: N815

    def exists(self):
        return None in self

    def get(self):
        return self[None]

    def update(self, value):
        self[None] = value


class Handle:
    getMapState = getValueState = lambda self, *a: Store()  # noqa: E731, N815


class Live:
    """Frames of a shuffled group, and the most of them that were alive at once."""

    def __init__(self, n: int, rows: int):
        self.order, self.rows, self.made, self.most = random.Random(7).sample(range(n * rows), n * rows), rows, [], 0

    def __iter__(self):
        for i in range(0, len(self.order), self.rows):
            seqs = self.order[i : i + self.rows]
            frame = pd.DataFrame({"event_id": seqs, "event_type": "a", "user_id": [s % 30 for s in seqs]})
            self.made.append(weakref.ref(frame))
            self.most = max(self.most, sum(ref() is not None for ref in self.made))
            yield frame
            del frame


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(arrival, "RUN", 40_000)
    monkeypatch.setattr(arrival, "BLOCK", 2_000)
    monkeypatch.setattr(arrival, "WAYS", 3)


def released(trigger: Trigger, n: int = 60, rows: int = 100):
    """Releases of a count over n frames, the sizes of the frames that hand them on, the most frames held, the processor."""
    fold = Fold(Window("w", "t", "global", "count"), trigger)
    processor, frames = WindowProcessor(fold, "event_id", ["event_type"]), Live(n, rows)
    processor.init(Handle())
    out = list(processor.handleInputRows(("a",), iter(frames), None))
    return [(r.fire_seq, r.state) for f in out for r in f.itertuples()], [len(f) for f in out], frames.most, processor


def test_segment_trigger_holds_few_rows(small):
    got, _, most, _ = released(Trigger("g", "w", "segment", threshold=(9, "elements")))
    assert got == [(s, str(s + 1)) for s in range(6000) if (s + 1) % 9 == 0] and most < 20


def test_punctuation_hands_releases_on_in_frames(small, monkeypatch):
    monkeypatch.setattr(processors, "ROWS", 50)
    trigger = Trigger("g", "w", "punctuation", pred=lambda t, event: event["type"] == "new-segment" and event["segment"]["user_id"] % 10 == 0)
    got, sizes, most, _ = released(trigger)
    assert got == [(s, str(s + 1)) for s in range(0, 6000, 10)] and most < 20 and len(sizes) >= 12 and max(sizes) == 50


def test_custom_trigger_steps_in_order_over_few_rows(small, monkeypatch):
    monkeypatch.setattr(processors, "ROWS", 500)
    second = CustomTrigger((0, -1), lambda t, state, event: (state[0] + 1, event["segment"]["event_id"]), lambda t, state, event, extent: state[0] % 2 == 0 and state[1] == state[0] - 1)
    got, sizes, most, processor = released(Trigger("g", "w", second))
    assert got == [(s, str(s + 1)) for s in range(1, 6000, 2)] and most < 20 and max(sizes) == 500
    assert pickle.loads(processor.own.get()[0]) == (6000, 5999)


def test_window_state_is_the_whole_groups_over_few_rows(small):
    _, _, most, processor = released(Trigger("g", "w", "segment", threshold=(5, "elements")), rows=103)
    assert {k: pickle.loads(v[0]) for k, v in processor.extents.items()} == {(0, -1): 6180} and most < 20
    assert pickle.loads(processor.own.get()[0]) == 5


def test_memory_does_not_grow_with_a_group(small, monkeypatch):
    """Peaks of a segment trigger, whose releases grow with the group, too, over 3000 and 12,000 rows."""
    monkeypatch.setattr(processors, "ROWS", 50)

    def peak(n: int) -> int:
        processor = WindowProcessor(Fold(Window("w", "t", "global", "count"), Trigger("g", "w", "segment", threshold=(5, "elements"))), "event_id", ["event_type"])
        processor.init(Handle())
        frames = (pd.DataFrame({"event_id": [(i * 100 + j) * 7919 % (n * 100) for j in range(100)], "event_type": "a"}) for i in range(n))
        tracemalloc.start()
        try:
            assert sum(map(len, processor.handleInputRows(("a",), frames, None))) == n * 20
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    peak(5)
    assert peak(120) < 2 * peak(30)


@pytest.mark.parametrize("seqs", [[3, None, 1, 3, 2, None, 1], list(range(50, 0, -1)), [5], []], ids=["ties and nulls", "backwards", "one", "none"])
@pytest.mark.parametrize("run", [1, 10**9])
def test_order_is_a_stable_sort_with_nulls_last(small, monkeypatch, seqs, run):
    monkeypatch.setattr(arrival, "RUN", run)
    rows = [{"seq": s, "at": i, "odd": None if i == 2 else i, "text": "x" * i, "deep": [i], "ts": pd.Timestamp(i, unit="s")} for i, s in enumerate(seqs)]
    frames = [pd.DataFrame(rows[i : i + 2]) for i in range(0, len(rows), 2)]
    want = pd.concat(frames).sort_values("seq", kind="stable").to_dict("records") if frames else []
    got = list(arrival.ordered(iter(frames), "seq"))
    assert repr(got) == repr(want)
    assert repr(list(arrival.ordered(iter(frames), None))) == repr([r for f in frames for r in f.to_dict("records")])
