"""Requests that are asked once, whatever is lost."""

import glob
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from normlattice.operators import ledger


def service(folder, fails=(), breaks=()):
    """A stub that notes each request that it is asked; some fail, and some end the task."""

    def load():
        import os
        import uuid

        def ask(keys, requests):
            with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(keys))
            if set(keys) & set(breaks):
                raise KeyboardInterrupt  # no error of the service: the worker ends
            return [{"error": "busy"} if k in fails else {"response": {"text": r.upper()}} for k, r in zip(keys, requests)]

        return ask

    return load


def calls(folder):
    return Counter(k for p in glob.glob(f"{folder}/*") for k in open(p).read().split("\n"))


def folders(tmp_path, *names):
    for x in names:
        (tmp_path / x).mkdir()
    return [str(tmp_path / x) for x in names]


def requests(spark, n):
    rows = [(f"k{i}", f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows + rows[:5] + [(None, "x"), ("k", None)], "key string, request string")


def test_each_request_is_asked_once(spark, tmp_path):
    (noted,) = folders(tmp_path, "noted")
    df, path = requests(spark, 40), f"{tmp_path}/ledger"
    got = {r.key: (r.response, r.error, r.n_failed) for r in ledger.ask_all(df, service(noted, fails={"k3"}), path, parallel=2, batch=4).collect()}
    assert got.keys() == {f"k{i}" for i in range(40)}
    assert got["k3"] == (None, "busy", 3) and got["k4"] == (json.dumps({"text": "TEXT 4"}), None, 0)
    assert calls(noted) == Counter({f"k{i}": 3 if i == 3 else 1 for i in range(40)})
    # later calls ask what is new, and a failure again if more attempts are allowed
    again = ledger.ask_all(requests(spark, 42), service(noted), path, parallel=2, attempts=4)
    assert {r.key for r in again.filter("response is not null").collect()} == {f"k{i}" for i in range(42)}
    assert calls(noted) == Counter({f"k{i}": 4 if i == 3 else 1 for i in range(42)})
    assert ledger.ask_all(df.limit(0), service(noted), f"{tmp_path}/none").count() == 0


def test_what_was_answered_before_a_loss_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "TASK_ROWS", 5)
    noted, later = folders(tmp_path, "noted", "later")
    df, path = requests(spark, 60), f"{tmp_path}/ledger"
    # a request of the last round ends the run
    last = df.filter("key is not null and request is not null").distinct().filter(F.pmod(F.xxhash64("key"), F.lit(6)) == 5).first().key
    with pytest.raises(Exception):
        ledger.ask_all(df, service(noted, breaks={last}), path, parallel=2)
    kept = {r.key for r in ledger.asked(spark, path).collect()}
    assert 30 < len(kept) < 60 and last not in kept
    assert ledger.ask_all(df, service(later), path, parallel=2).filter("response is not null").count() == 60
    assert calls(later) == Counter({f"k{i}": 1 for i in range(60) if f"k{i}" not in kept})


def test_calls_are_spaced():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    ask = ledger.paced(lambda keys, requests: [{}] * len(keys), 2.0, lambda: now[0], sleep)
    ask(["a", "b"], ["", ""])
    now[0] += 1
    ask(["c"], [""])
    now[0] += 9
    ask(["d"], [""])
    assert slept == [3.0]


def test_a_call_that_fails_or_is_short_fails_for_its_requests():
    assert ledger._answered(lambda k, r: [{}], ["a", "b"], ["", ""]) == [(None, "ValueError: 1 answers for 2 requests")] * 2
    assert ledger._answered(lambda k, r: 1 / 0, ["a"], [""])[0][1].startswith("ZeroDivisionError")
    assert ledger._answered(lambda k, r: [{}, {"response": "é", "error": None}], ["a", "b"], ["", ""]) == [(None, None), ('"é"', None)]
