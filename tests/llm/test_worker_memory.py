"""What Python workers keep between the stages of the pipeline."""

import glob
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import chosen_path, language, mixing, packing
from trafficlens.llm.common import with_made


def kept_by_workers(spark):
    """Names of the vocabularies that some worker holds."""

    def look(frames):
        import gc

        for _ in frames:
            time.sleep(0.5)  # so that every worker gets one
            yield pd.DataFrame({"kind": [type(x).__name__ for x in gc.get_objects() if type(x).__name__ in ("Encoder", "Pieces")]}, dtype=object)

    return {r[0] for r in spark.range(8, numPartitions=8).mapInPandas(look, "kind string").collect()}


def test_a_stage_does_not_keep_what_an_earlier_one_loaded(spark, frame):
    rows = [(i, f"the cat number {i} sat on a mat and saw {i * 7} dogs", "en") for i in range(40)]
    _, docs = frame(rows)
    assert packing.pieces(docs, 4096, "doc_id", "text", packing.default_path(), 2).count() == 40
    assert language.predict(docs, language.train(docs)).where("lang_pred = 'en'").count() == 40
    assert chosen_path.describe(docs.repartition(8), ["doc_id"], "text", 5).count() == 40

    def slow():  # so that every worker gets a task
        return lambda f: (time.sleep(0.5), pd.DataFrame({"x": f["id"]}))[1]

    with_made(spark.range(8, numPartitions=8), ["id"], slow, "x long").collect()
    assert kept_by_workers(spark) == set()


@pytest.mark.skipif(not glob.glob("/proc/self/smaps_rollup"), reason="reads the memory of a process on Linux")
def test_free_memory_of_a_task_goes_back(spark):
    """200 MB in small pieces, with a piece that stays behind every hundredth of them."""

    def start():
        def make(f):
            import builtins

            pieces = [np.ones(2000) for _ in range(12_000)]
            builtins.left_behind = pieces[::100]
            del pieces
            return pd.DataFrame({"x": f["id"]})

        return make

    def own(frames):
        for _ in frames:
            import builtins

            if hasattr(builtins, "left_behind"):
                mb = [int(x.split()[1]) / 1024 for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous:")][0]
                del builtins.left_behind
                yield pd.DataFrame({"mb": [mb]})

    with_made(spark.range(1, numPartitions=1), ["id"], start, "x long").collect()
    found = [r.mb for r in spark.range(8, numPartitions=8).mapInPandas(own, "mb double").collect()]
    assert found and max(found) < 150


def test_small_tables_of_the_mix_start_no_workers(spark, frame, monkeypatch):
    _, docs = frame([(i, "a b c " * i, "en", f"s{i % 3}") for i in range(1, 30)] + [(99, "x y", "en", None)])
    monkeypatch.setattr(spark.sparkContext, "parallelize", lambda *a, **k: pytest.fail("plain rows"))
    rows, slots = mixing.schedule(docs, ["doc_id"], mixing.word_count(F.col("text")), "source", block=8)
    assert rows.count() == 30
    assert rows.agg(F.sum("taken")).first()[0] == slots.agg(F.sum("words")).first()[0] > 0
