"""What the processors of silence and gaps ask of the state, a message to the JVM for each call."""

from types import SimpleNamespace

from pyspark.sql import Row

from trafficlens.streaming.live import GapProcessor, SilenceProcessor

SECOND = 1_000_000


class State:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()
        self.state = State(self.calls)

    def getValueState(self, *_):
        return self.state

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


def started(processor):
    handle = Handle()
    processor.init(handle)
    return handle


def feed(processor, mark_seconds, *seconds):
    rows = iter([Row(first_at=a * SECOND, last_at=b * SECOND) for a, b in seconds])
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark_seconds * 1000)
    return [tuple([x // SECOND for x in part] for part in row[1:]) for row in processor.handleInputRows(("b",), rows, clock)]


def expire(processor, handle, at_seconds):
    out = [tuple([x // SECOND for x in part] for part in row[1:]) for row in processor.handleExpiredTimer(("b",), None, None)]
    handle.timers.discard(at_seconds * 1000)
    return out


def test_a_due_alarm_is_told_with_its_row_in_one_row_and_three_calls():
    processor = SilenceProcessor("host", 10 * SECOND, 100 * SECOND)
    handle = started(processor)
    assert feed(processor, 90, (40, 45), (0, 5), (70, 71)) == [([5, 45, 71], [5, 45], [40, 70])]
    assert handle.calls == ["get", "update", "register"]
    assert handle.state.value == (71 * SECOND, True) and handle.timers == {171_000}


def test_one_timer_follows_the_key():
    processor = SilenceProcessor("host", 10 * SECOND, 100 * SECOND)
    handle = started(processor)
    assert feed(processor, 0, (1, 2)) == [] and handle.timers == {12_000}
    assert feed(processor, 5, (6, 9)) == [] and handle.timers == {19_000}
    assert expire(processor, handle, 19) == [([9], [], [])] and handle.timers == {109_000}
    assert feed(processor, 45, (50, 51)) == [([], [9], [50])] and handle.timers == {61_000}
    assert expire(processor, handle, 61) == [([51], [], [])] and expire(processor, handle, 151) == []
    assert handle.state.value is None and handle.timers == set()


def test_a_key_that_is_past_keeping_leaves_no_state():
    processor = SilenceProcessor("host", 10 * SECOND, 10 * SECOND)
    handle = started(processor)
    assert feed(processor, 90, (1, 2)) == [([2], [], [])]
    assert handle.state.value is None and handle.timers == set()


def test_gaps_of_a_batch_come_in_one_row():
    processor = GapProcessor("host", 10 * SECOND)
    handle = started(processor)
    assert feed(processor, 0, (40, 45), (0, 5), (50, 51), (70, 70)) == [([5, 51], [40, 70])]
    assert handle.calls == ["get", "update"] and feed(processor, 0, (75, 75)) == []
