import hashlib
import os

import numpy as np

from evalframe import plans
from evalframe.operators import windows
from evalframe.plans.base import Tables
from evalframe.storage import shared_dir

SF_DIR = "/root/testdata/sf0.001"


def test_mean_over_twenty_shuffles(spark):
    rows = sorted(Tables(spark, SF_DIR).scored.select("uid", "gold_option", "picked").collect())
    rates = []
    for rep in range(1, 21):
        dealt = sorted(rows, key=lambda r: (hashlib.sha1(f"{rep}:{r.uid}".encode()).hexdigest(), r.uid))
        rates.append(sum(a.gold_option == b.picked for a, b in zip(rows, dealt)) / len(rows))
    got = plans.QUERIES["t13_permutation_mean"](spark, SF_DIR).first()
    assert got.shuffles == 20 and abs(got.mean_rate - sum(rates) / 20) < 1e-8


def stored_bytes(spark):
    folder = shared_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_shuffles_store_little_more_than_a_byte_a_row(spark):
    before, n = stored_bytes(spark), spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()
    assert plans.QUERIES["t13_permutation_mean"](spark, "/root/testdata/sf0.01").first().shuffles == 20
    assert stored_bytes(spark) - before < 4 * 20 * n


def test_rates_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(windows, "_DEALT", 100)
    monkeypatch.setattr(windows, "_PLACES", 37)
    for width in (3, 300):
        rows = [(k * 7919 - 9000, None if k % 11 == 0 else f"v{k % width}", None if k % 13 == 0 else f"v{k * 3 % width}") for k in range(1500)]
        got = {r.rep: r.rate for r in windows.hash_order_null(spark.createDataFrame(rows, "k long, a string, b string"), "k", "a", "b", 3).collect()}
        assert sorted(got) == [1, 2, 3]
        for rep, rate in got.items():
            dealt = sorted(rows, key=lambda r: (hashlib.sha1(f"{rep}:{r[0]}".encode()).hexdigest(), r[0]))
            assert rate == sum(x[1] is not None and x[1] == y[2] for x, y in zip(sorted(rows), dealt)) / len(rows)


def test_equal_first_bits_are_told_apart_by_the_whole_hash():
    keys = np.array([5, 3, 9, 4])
    want = sorted(range(4), key=lambda i: hashlib.sha1(f"2:{keys[i]}".encode()).digest())
    assert windows._in_order(2, np.zeros(4, "u8"), keys).tolist() == want
