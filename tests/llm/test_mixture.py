import random

import pytest

from callweave.llm import mixture as M


def test_water_filling():
    got = M.water_fill({"a": 100, "b": 10, "c": 1000}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 4, "c": 1}, 200)
    assert got == pytest.approx({"a": 100, "b": 40, "c": 60})
    assert M.water_fill({"a": 1}, {"a": 1.0, "z": 0.0}, {"a": 2, "z": 3}, 100) == {"a": 2.0, "z": 0.0}
    assert M.water_fill({}, {"a": 1.0}, {"a": 2}, 10) == {"a": 0.0}


def test_mix(spark):
    rnd = random.Random(1)
    docs = [(i, "word " * rnd.randrange(1, 60), rnd.choice(["Big", " big ", "big"]) if i % 5 else "small", 1) for i in range(2000)]
    docs += [(5000, None, "big", 1), (5001, "", "small", 1), (5002, "x", None, 1), (5003, "x", "other", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, repeats int")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("none", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = M.mix(d, t)
    r = {x["source"]: x for x in report.collect()}
    assert set(r) == {"big", "small", "none"}
    assert r["big"]["actual_share"] == pytest.approx(0.6, abs=0.005) and r["small"]["actual_share"] == pytest.approx(0.4, abs=0.005)
    got = chosen.collect()
    assert all(1 <= x["repeats"] <= (1 if x["source"] == "big" else 3) for x in got)
    assert sum(x["n_tokens"] * x["repeats"] for x in got if x["source"] == "small") == r["small"]["mixture_tokens"]
    again = {x["doc_id"]: x["repeats"] for x in M.mix(d.repartition(7), t)[0].collect()}
    assert again == {x["doc_id"]: x["repeats"] for x in got}
    assert M.mix(d.limit(0), t)[0].count() == 0 and M.mix(d, t.limit(0))[0].count() == 0


def test_even_total(spark):
    assert M.largest_even_total({"a": 100, "b": 50, "c": 0}, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 1, "b": 3, "c": 9}) == pytest.approx(150)
    assert M.largest_even_total({}, {"a": 1.0}, {"a": 1}) == 0
    d = spark.createDataFrame([(i, "word " * 20, "big" if i % 20 else "small") for i in range(3000)], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    r = {x["source"]: x for x in M.mix(d, t, "even")[1].collect()}
    assert r["small"]["epochs"] == 2.0 and r["big"]["actual_share"] == pytest.approx(0.5, abs=0.01)


def test_tokens(spark):
    d = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "id int, text string")
    n = {r["id"]: r["n_tokens"] for r in M.count_tokens(d).collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 1
