"""The general preparation operators against brute force, and their edge cases."""

import random
import re
from datetime import datetime, timedelta

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.operators import orphans as O
from callweave.operators import rejects as R
from callweave.operators import skew as S


def loadable(raw):
    """The line format, character by character."""
    if raw is None:
        return False
    for end in ("\r\n", "\n\r", "\n", "\r"):
        if raw.endswith(end):
            raw = raw[: -len(end)]
            break
    if re.search("[\r\n\0]", raw):
        return False
    fields, i = [], 0
    while True:
        if raw[i : i + 1] == '"':
            i, value = i + 1, ""
            while True:
                if i >= len(raw):
                    return False
                if raw[i] == '"':
                    if raw[i + 1 : i + 2] == '"':
                        value, i = value + '"', i + 2
                        continue
                    i += 1
                    break
                value, i = value + raw[i], i + 1
        else:
            j = raw.find("\t", i)
            value = raw[i:] if j < 0 else raw[i:j]
            if '"' in value:
                return False
            i += len(value)
        fields.append(value)
        if i >= len(raw):
            break
        if raw[i] != "\t":
            return False
        i += 1
    if len(fields) != 4:
        return False
    file, _, line, _ = fields
    return bool(
        file.strip() and re.search(r"\.(c|h|cpp|hpp|cc|hh)$", file.lower()) and re.fullmatch("[0-9]+", line) and int(line) <= 2**63 - 1
    ) and fields


PIECES = st.sampled_from(['"', '""', "\t", "\n", "\r", "\0", "a.c", ".H", "b.txt", "7", "007", "9223372036854775807", "9223372036854775808", " ", "f", "x y", "é"])
LINES = st.one_of(
    st.lists(PIECES, max_size=12).map("".join),
    st.tuples(*[st.one_of(PIECES, st.lists(PIECES, max_size=3).map(lambda x: '"' + "".join(x).replace('"', '""') + '"'))] * 4, st.sampled_from(["", "\n", "\r\n", "\n\r", "\n\n"])).map(
        lambda t: "\t".join(t[:4]) + t[4]
    ),
    st.tuples(PIECES, PIECES).map(lambda t: f'"a{t[0]}.cc"\t{t[1]}\t12\t"q""{t[0]}"'.replace('"".cc', '""".cc')),
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(LINES, min_size=60, max_size=120))
def test_rejects_against_brute_force(spark, lines):
    lines = [*lines, None, "", "x.c\t\t1\t", 'x.c\t""\t"5"\t"a\tb"\r\n', " \t\t1\t", "x.c\tf\t1\t" + "y" * 100_000, "x.c\tf\t1\t\"" + 'a""' * 20_000 + '"']
    df = spark.createDataFrame([(i, x, "clash", 3) for i, x in enumerate(lines)], "raw_id bigint, raw string, file string, reason int")
    got = {r["raw_id"]: r for r in R.parse_with_reasons(df, "raw_id", "raw").collect()}
    assert len(got) == len(lines)
    for i, x in enumerate(lines):
        want = loadable(x)
        assert (got[i]["reason"] is None) == bool(want), (x, got[i])
        if want:
            assert [got[i]["file"], got[i]["symbol"], got[i]["line"], got[i]["context"]] == [want[0], want[1], int(want[2]), want[3]]


def test_rejects_with_a_large_dictionary(spark, monkeypatch):
    """Beyond the size for a broadcast the result is the same."""
    lines = [f"d/hot.c\tf\t{i % 7}\tx" for i in range(300)] + [f"{i}.txt\tf\t{i}\tx" for i in range(50)] + ["a.c\tf\tq\tx", None, "z"]
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id bigint, raw string").repartition(3)
    want = rows(R.parse_with_reasons(df, "raw_id", "raw"))
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    assert rows(R.parse_with_reasons(df, "raw_id", "raw")) == want
    assert rows(R.reject_reasons(df, "raw_id", "raw")) == [t[:2] for t in want if t[1] is not None]


def test_reject_reasons(spark):
    cases = {None: "null line", "a\0": "nul character", "a\nb.c\tf\t1\tx": "line break inside", 'a.c\tf"\t1\tx': "broken quoting", "a.c\tf\t1": "wrong column count",
             " \tf\t1\tx": "blank file", "a.txt\tf\tq\tx": "not a source file", "a.c\tf\t1.0\tx": "line isn't digits", "a.c\tf\t9223372036854775808\tx": "line out of range"}
    df = spark.createDataFrame(list(enumerate(cases)), "raw_id bigint, raw string")
    assert {r[0]: r[1] for r in R.parse_with_reasons(df, "raw_id", "raw").select("raw_id", "reason").collect()} == dict(enumerate(cases.values()))
    assert R.parse_with_reasons(df.limit(0), "raw_id", "raw").count() == 0


def test_heavy_keys(spark):
    rnd = random.Random(5)
    keys = ["hot"] * 400 + ["warm"] * 30 + [None] * 70 + [f"k{rnd.randrange(400)}" for _ in range(500)]
    data = [(k, f"v{rnd.randrange(60)}" if rnd.random() < 0.9 else None, i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(data, "k string, _value string, n int").repartition(5)
    assert rows(S.heavy_hitters(df, "k")) == [("hot", 400), ("warm", 30)]
    got = S.per_key(df, "k", {"n_rows": F.count(F.lit(1)), "top": F.max("n")}, {"n_rows": F.sum("n_rows"), "top": F.max("top")}, distinct="_value")
    want = {}
    for k, v, n in data:
        w = want.setdefault(k, [0, -1, set()])
        w[0] += 1
        w[1] = max(w[1], n)
        w[2] |= {v} - {None}
    assert {r["key"]: (r["n_rows"], r["top"], r["n_distinct"]) for r in got.collect()} == {k: (a, b, len(c)) for k, (a, b, c) in want.items()}
    plain = S.per_key(df, "k", {"n_rows": F.count(F.lit(1))}, {"n_rows": F.sum("n_rows")})
    assert {r["key"]: r["n_rows"] for r in plain.collect()} == {k: v[0] for k, v in want.items()}
    empty = df.limit(0)
    assert S.heavy_hitters(empty, "k").count() == 0
    assert S.per_key(empty, "k", {"n_rows": F.count(F.lit(1))}, {"n_rows": F.sum("n_rows")}, distinct="_value").count() == 0
    assert S.heavy_hitters(df.where("k is null"), "k").count() == 0


def test_orphans_against_brute_force(spark):
    rnd = random.Random(7)
    t0 = datetime(2024, 1, 1)
    when = lambda: None if rnd.random() < 0.05 else t0 + timedelta(hours=rnd.randrange(240), microseconds=rnd.randrange(3))
    some = [*"abcdefgh", "ext", None]
    calls = [(i, rnd.choice(some), rnd.choice(some), when()) for i in range(300)]
    defs = [(rnd.choice([*"abcde", None]), (t := when()), t + timedelta(hours=rnd.randrange(1, 60)) if t and rnd.random() < 0.6 else None) for _ in range(40)]
    c = spark.createDataFrame([(*r, 1) for r in calls], "ord bigint, caller string, callee string, imported_at timestamp_ntz, name int")
    d = spark.createDataFrame(defs, "symbol string, imported_at timestamp_ntz, retracted_at timestamp_ntz")
    x = spark.createDataFrame([("ext",), (None,)], "name string")
    got = O.orphan_cascade(c, d, x).collect()
    want = {}
    for o, a, b, t in calls:
        for side, n in (("caller", a), ("callee", b)):
            if n is None or n == "ext":
                continue
            own = [r for r in defs if r[0] == n]
            if not (t and any(i and i <= t and (r is None or r > t) for _, i, r in own)):
                want[o, side] = "retracted" if t and any(i and i <= t for _, i, _ in own) else "late" if own else "missing"
    assert {(r["ord"], r["side"]): r["reason"] for r in got if r["kind"] == "direct"} == want
    depth = {o: 0 for o, _, _, _ in calls if (o, "caller") in want}
    while True:
        new = {}
        for o, a, _, t in calls:
            if o not in depth and a not in (None, "ext") and t:
                up = [depth[p] for p, pa, pb, pt in calls if p in depth and pb == a and pa != pb and pt and pt <= t]
                if up:
                    new[o] = min(up) + 1
        if not new:
            break
        depth |= new
    inherited = {o: n for o, n in depth.items() if n}
    assert {r["ord"]: r["depth"] for r in got if r["kind"] == "inherited"} == inherited
    assert sum(r["n_refs"] for r in O.orphan_report(O.orphan_cascade(c, d, x)).collect()) == len(got)
    assert O.orphan_cascade(c.limit(0), d, x).count() == 0
    assert O.orphan_cascade(c, d.limit(0), x).where("kind = 'direct' and reason <> 'missing'").count() == 0


def test_hot_names_and_times_of_orphans(spark):
    t0 = datetime(2024, 1, 1)
    calls = [(i, "hot", "hot" if i % 2 else f"f{i % 40}", t0 + timedelta(seconds=i if i % 3 else 7)) for i in range(3000)]
    c = spark.createDataFrame(calls, "ord bigint, caller string, callee string, imported_at timestamp_ntz").repartition(7)
    d = spark.createDataFrame([("hot", t0 + timedelta(seconds=100), t0 + timedelta(seconds=900)), ("hot", t0 + timedelta(seconds=1500), None)], "symbol string, imported_at timestamp_ntz, retracted_at timestamp_ntz")
    got = {(r["ord"], r["side"]): r["reason"] for r in O.direct_orphans(O.call_references(c, spark.createDataFrame([], "name string")), d).collect()}
    want = {}
    for o, a, b, t in calls:
        for side, n in (("caller", a), ("callee", b)):
            s = (t - t0).seconds
            if n != "hot":
                want[o, side] = "missing"
            elif not (100 <= s < 900 or s >= 1500):
                want[o, side] = "late" if s < 100 else "retracted"
    assert got == want


def test_salted_join_equals_join(spark):
    rnd = random.Random(3)
    left = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), i) for i in range(500)]
    a = spark.createDataFrame(left, "k string, i int").repartition(5)
    b = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), (None, 4), ("z", 5)], "k string, j int")
    for how in ("inner", "left", "left_semi"):
        assert rows(S.salted_join(a, b, "k", how)) == rows(a.join(b, "k", how))
    assert S.salted_join(a.limit(0), b, "k").count() == 0


def test_below_keeps_least_depths(spark):
    pairs = [(f"{i}", f"{i + 1}") for i in range(23)] + [("0", "9"), ("5", "0")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    got = {r[0]: r[1] for r in O.below(spark.createDataFrame([("0",)], "name string"), e).collect()}
    assert got == {f"{i}": i if i < 9 else i - 8 for i in range(24)}
