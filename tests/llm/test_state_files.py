"""How the stream of the exact deduplication writes its state."""

import glob
import os
import threading

import pytest

from trafficlens.llm import stream_dedup


@pytest.mark.skipif(not os.path.isdir("/proc"), reason="reads the process table")
def test_commits_write_changes_and_start_no_process_for_a_file(spark, frame, tmp_path):
    """A started process shares the executor's memory until it runs its own program: a few hundred of them do harm."""
    path, _ = frame([(i, f"t{i % 50}") for i in range(100)])
    check, parent, started, over = str(tmp_path / "state"), str(spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()), set(), threading.Event()

    def watch():
        while not over.wait(0.001):
            for children in glob.glob(f"/proc/{parent}/task/*/children"):
                try:
                    for pid in open(children).read().split():
                        started.add(open(f"/proc/{pid}/cmdline").read().split("\0")[0])
                except OSError:  # gone meanwhile
                    pass

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        state = {(r.keeper.doc_id, r.group_size) for r in stream_dedup.update_state(spark, path, check, "doc_id", "text").collect()}
    finally:
        over.set()
        watcher.join()
    assert state == {(i, 2) for i in range(50, 100)}
    assert glob.glob(f"{check}/state/0/*/1.changelog") and not glob.glob(f"{check}/state/0/*/1.zip")
    assert "readlink" not in started
