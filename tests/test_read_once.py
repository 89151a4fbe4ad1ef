"""Steps that were made again for every use, or by a table for each key."""

import random

from pyspark.sql import Row

from ohmlake.operators import crawl as W
from ohmlake.queries import QUERIES
from ohmlake.streaming.state import JobStates

from .test_operators import numbered_one_by_one

AT = "/root/testdata/sf0.001"


def test_documents_and_answers_read_stored_components_and_nets(spark):
    for name in ("cir12_all_documents", "gq8_question_answers"):
        assert "lineitem" not in QUERIES[name](spark, AT)._jdf.queryExecution().optimizedPlan().toString(), name


def test_running_counts_go_by_ranges_only_for_large_keys(spark, monkeypatch):
    rng, tables = random.Random(42), []
    kept = W.stored
    monkeypatch.setattr(W, "stored", lambda df, name: tables.append(name) or kept(df, name))
    names = [rng.choice(["a.pdf", "a-1.pdf", "a-1-1.pdf", "b.pdf"]) for _ in range(200)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, filename string").repartition(3)
    for largest, ranged in ((1000, False), (20, True)):
        monkeypatch.setattr(W, "LARGEST", largest)
        tables.clear()
        got = sorted((r.i, r.unique_name) for r in W.unique_names(df, [], ["i"]).collect())
        assert [u for _, u in got] == numbered_one_by_one(names) and ("ranged" in tables) == ranged


class Held:
    """A state of one key in memory."""

    def __init__(self):
        self.value, self.map = None, {}

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def iterator(self):
        return iter(self.map.items())

    def updateValue(self, key, value):
        self.map[key] = value


def test_job_states_take_and_give_rows():
    made = JobStates({"n": "bigint", "e": "string"}, None)
    made.init(Held())
    row = lambda us, status, n=None, e=None: Row(processing_id="p", event_us=us, status=status, n=n, e=e)
    first = list(made.handleInputRows(("p",), iter([row(5, "uploaded", 1), row(None, "failed", 7, "x")]), None))
    assert [r.asDict() for r in first] == [{"processing_id": "p", "status": "uploaded", "created_us": 5, "updated_us": 5, "n": 1, "e": "x"}]
    second = list(made.handleInputRows(("p",), iter([row(3, "failed", 9), row(5, "completed")]), None))
    assert [r.asDict() for r in second] == [{"processing_id": "p", "status": "completed", "created_us": 3, "updated_us": 5, "n": 1, "e": "x"}]
