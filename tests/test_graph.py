import pytest
from conftest import rows
from fixture_calls import FUNCTIONS, edges
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from callweave.operators import export as E
from callweave.operators import graph as G
from callweave.operators import hierarchy as H
from callweave.operators import relations as R


def call_rows(spark, pairs):
    data = [(i, "f.c", a, i, f"{b}();", b) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(data, "ord bigint, file string, caller string, line bigint, context string, callee string")


def def_rows(spark, names, kind="function"):
    data = [(i, f"f{i}.c", n, i, "", kind) for i, n in enumerate(names)]
    return spark.createDataFrame(data, "ord bigint, file string, symbol string, line bigint, context string, kind string")


def names(df, column="symbol"):
    return sorted(r[column] for r in df.collect())


def levels(spark, fs, pairs):
    out = {}
    for k, s in rows(G.dependency_levels(def_rows(spark, fs), call_rows(spark, pairs))):
        out.setdefault(k, set()).add(s)
    return out


@pytest.mark.parametrize(("mode", "cone", "sizes", "order", "paths"), [("compat", 24, [6, 6, 6, 5, 3, 1], 62, 56), ("strict", 27, [6, 4, 6, 7, 3, 1], 59, 77)])
def test_fixture_program(spark, mode, cone, sizes, order, paths):
    calls, defs = call_rows(spark, edges(mode)), def_rows(spark, FUNCTIONS)
    assert len(FUNCTIONS) == 27
    assert names(R.leaf_symbols(defs, calls)) == ["abs_val", "max", "min", "str_copy", "str_equal", "str_len"]
    assert G.dependency_cone(calls, "main").count() == cone
    assert "min" in names(G.dependency_cone(calls, "main"))
    assert R.calls(calls, caller="processor_init").count() == 2
    got = levels(spark, FUNCTIONS, edges(mode))
    assert [len(got[k]) for k in sorted(got)] == sizes
    assert len(G.conversion_order_compat(defs, calls)) == order
    assert sum(r["n_paths"] for r in G.path_counts(calls).where("caller = 'main'").collect()) == paths
    assert E.export_edges(calls, E.export_symbols(defs)).count() == {"compat": 35, "strict": 41}[mode]


def test_levels_of_cycles_and_externals(spark):
    assert levels(spark, "ab", [("a", "b"), ("b", "a")]) == {2: {"a", "b"}}
    assert levels(spark, "ab", [("a", "a")]) == {1: {"b"}, 2: {"a"}}
    assert levels(spark, "abcd", [("c", "a"), ("a", "b"), ("b", "a")]) == {1: {"d"}, 2: {"a", "b", "c"}}
    assert levels(spark, "a", [("a", "printf")]) == {2: {"a"}}
    long = [(f"n{i:03}", f"n{i + 1:03}") for i in range(30)]
    assert {k: next(iter(v)) for k, v in levels(spark, [f"n{i:03}" for i in range(31)], long).items()} == {31 - i: f"n{i:03}" for i in range(31)}


def test_bags_and_sets(spark):
    calls = call_rows(spark, [("a", "b"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert R.calls(calls, "a", "b").count() == 2
    assert rows(G.path_counts(calls).where("caller = 'a'")) == [("a", "b", 2), ("a", "c", 1), ("a", "d", 3)]
    assert rows(G.cone_sizes(calls)) == [("a", 3), ("b", 1), ("c", 1)]
    defs = def_rows(spark, ["x", "x", "aaa"])
    assert names(R.leaf_symbols(defs, calls, bag=True)) == ["aaa", "x", "x"]
    assert names(R.leaf_symbols(defs, calls)) == ["aaa", "x"]
    assert names(R.symbols_matching(defs, "AA", bag=True)) == ["aaa", "aaa"]
    assert names(R.symbols_matching(defs, "AA")) == ["aaa"]
    with pytest.raises(ValueError):
        G.path_counts(call_rows(spark, [("a", "a")]))
    with pytest.raises(ValueError):
        G.conversion_order_compat(def_rows(spark, "rab"), call_rows(spark, [("r", "a"), ("a", "b"), ("b", "a")]), max_steps=100)
    with pytest.raises(ValueError):
        G.conversion_order_compat(defs, calls, max_edges=4)
    assert names(G.callers_transitive(calls, "d")) == ["a", "b", "c"]
    looped = call_rows(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("x", "a"), ("x", "x"), (None, "c"), ("c", None)])
    assert rows(G.path_counts(looped, caller="a")) == [("a", "b", 2), ("a", "c", 2)]
    assert G.path_counts(looped, caller="nobody").count() == 0
    with pytest.raises(ValueError):
        G.path_counts(looped, caller="x")


def test_listing_and_export(spark, tmp_path):
    import json

    calls, defs = call_rows(spark, [("a", "b"), ("a", "z"), ("a", "b")]), def_rows(spark, ["a", "b"])
    listing = G.level_listing(G.dependency_levels(defs, calls), calls)
    assert G.format_level(listing, 2) == "Level 2:\n  a -> b, z, b\n"
    assert G.format_level(listing, 1) == "Level 1 (Leaves):\n  [b]\n"
    assert G.format_level(listing, 9) == "Level 9 does not exist\n"
    assert G.format_all_levels(listing).startswith("Level 2:")
    E.export_to_file(defs, calls, str(tmp_path / "g.json"))
    assert E.graph_json(E.export_nodes(defs, E.export_symbols(defs)), E.export_edges(calls, E.export_symbols(defs))) == (tmp_path / "g.json").read_text()
    assert json.loads(E.graph_json(E.export_nodes(defs, defs.select("symbol").limit(0)), E.export_edges(calls, defs.select("symbol").limit(0)))) == {"elements": {"nodes": [], "edges": []}}
    got = json.loads((tmp_path / "g.json").read_text())["elements"]
    assert [n["data"]["id"] for n in got["nodes"]] == ["a", "b"]
    assert [e["data"]["id"] for e in got["edges"]] == ["a_b", "a_b"]
    assert names(E.export_symbols(defs, max_nodes=1)) == ["a"]


def brute(pairs):
    pairs = {p for p in pairs if None not in p}
    dist = {p: 1 for p in pairs}
    while True:
        new = {}
        for (a, b), n in dist.items():
            for c, d in pairs:
                if b == c and (a, d) not in dist:
                    new[a, d] = min(new.get((a, d), n + 1), n + 1)
        if not new:
            return dist
        dist |= new


def brute_paths(pairs):
    pairs = {p for p in pairs if None not in p}
    tops = {a for a, _ in pairs} - {b for a, b in pairs if a != b}
    best = {}
    front = [[t] for t in tops]
    while front:
        for p in front:
            k = (p[0], p[-1])
            if k not in best or (len(p), p) < (len(best[k]), best[k]):
                best[k] = p
        front = [[*p, b] for p in front for a, b in pairs if a == p[-1] and b not in p]
    return best


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from([*"abcdefg", None]), st.sampled_from([*"abcdefg", None])), max_size=12))
def test_closure_and_paths_against_brute_force(spark, pairs):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in pairs], "p string, c string, src string, dist int")
    e = H.distinct_edges(df, "p", "c")
    want = brute(pairs)
    assert {(a, b): n for a, b, n in rows(H.reach(e))} == want
    assert {r[0] for r in H.on_cycles(e).collect()} == {a for a, b in want if a == b}
    got = {(r["root"], r["name"]): r["path"] for r in H.root_paths(e).collect()}
    assert got == brute_paths(pairs)
    h = H.hierarchy(e).collect()
    assert {r["symbol"] for r in h} == {x for p in pairs if None not in p for x in p}
    assert all(r["on_cycle"] == ((r["symbol"], r["symbol"]) in want) for r in h)


def test_long_chain_takes_few_rounds(spark):
    e = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(100)], "src string, dst string")
    got = H.root_paths(e).orderBy("depth").collect()
    assert [r["depth"] for r in got] == list(range(101)) and got[-1]["path"][50] == "050"
    assert H.reach(e).count() == 100 * 101 // 2


def components(df):
    out = {}
    for n, c in rows(df):
        assert n not in out
        out[n] = c
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(4, 16).flatmap(lambda n: st.lists(st.tuples(st.integers(0, n), st.integers(0, n)), min_size=n, max_size=2 * n)))
def test_components_against_brute_force(spark, pairs):
    pairs = [(f"n{a}", f"n{b}") for a, b in pairs]
    far = brute(pairs)
    got = components(H.components(spark.createDataFrame(sorted(set(pairs)), "src string, dst string").coalesce(2)))
    assert set(got) == {a for a, b in far if a == b}
    assert all((got[a] == got[b]) == ((a, b) in far and (b, a) in far) for a in got for b in got if a != b)


def test_components_of_dense_graphs_and_long_chains(spark):
    dense = [(x + a, x + b) for x in "pq" for a in "abcd" for b in "abcd"] + [("pa", "qa")]
    got = components(H.components(spark.createDataFrame(dense, "src string, dst string").coalesce(1)))
    assert len(got) == 8 and len(set(got.values())) == 2
    n = 10_000
    chain = spark.range(n).selectExpr("'n' || id as src", "'n' || (id + 1) as dst")
    assert H.on_cycles(chain).isEmpty()
    closed = chain.union(spark.sql(f"select 'n{n}', 'n5000'")).union(spark.sql("select 'n7000', 'n6000'"))
    got = components(H.components(closed))
    assert len(got) == n - 5000 + 1 and len(set(got.values())) == 1
    assert H.root_paths(chain.where("src in ('n1', 'n2', 'n3')")).count() == 4


def test_hot_parents(spark):
    """One name with most of the children, on a cycle and off it: its rows are split, the result is the same."""
    n = 1500
    star = [("top", "hub")] + [("hub", f"a{i}") for i in range(n)] + [(f"a{i}", f"b{i}") for i in range(n)]
    e = spark.createDataFrame(star, "src string, dst string").repartition(4)
    got = {(r["root"], r["name"]): r["path"] for r in H.root_paths(e).collect()}
    assert len(got) == 2 * n + 2 and all(got["top", f"b{i}"] == ["top", "hub", f"a{i}", f"b{i}"] for i in range(n))
    assert H.on_cycles(e).isEmpty()
    looped = e.union(spark.createDataFrame([(f"b{i}", "hub") for i in range(0, n, 2)], "src string, dst string"))
    assert {r["name"] for r in H.on_cycles(looped).collect()} == {"hub"} | {f"{c}{i}" for c in "ab" for i in range(0, n, 2)}
    fs = ["top", "hub", *(f"{c}{i}" for c in "ab" for i in range(n))]
    calls, defs = call_rows(spark, [(b, a) for a, b in star]), def_rows(spark, fs)  # everybody calls the hub in the end
    sizes = {k: len(v) for k, v in levels(spark, fs, [(b, a) for a, b in star]).items()}
    assert sizes == {1: 1, 2: 1, 3: n, 4: n}
    assert G.level_listing(G.dependency_levels(defs, calls), calls).count() == 2 * n + 2


def test_path_counts_are_whole_or_an_error(spark):
    calls = call_rows(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    with pytest.raises(ValueError):
        G.path_counts(calls, max_depth=2)
    assert G.path_counts(calls, max_depth=4).count() == G.path_counts(calls).count() == 10
