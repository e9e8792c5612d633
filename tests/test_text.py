import pytest
from conftest import rows
from pyspark.sql import functions as F

from callweave.functions import text as X
from callweave.operators import relations as R
from callweave.sources import lines as L


def one(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_line_grammar(spark):
    good = ["a.c\tf\t1\tx", "a.c\tf\t1\tx\n", "a.c\tf\t1\tx\r\n", "a.c\tf\t1\tx\r", "a.c\tf\t1\tx\n\r", "a.c\tf\t1\t", "a.c\t\t0\tx\ty", "Файл.c\tf\t999999\tx"]
    bad = ["", "a.c f 1 x", "a.c\tf\tx\ty", "a.c\tf\t1", "a.c\tf\t1\tx\n\n", "a.c\tf\t1\tx\ry", None]
    assert one(spark, X.is_line, *good) == [True] * len(good)
    assert one(spark, X.is_line, *bad) == [False] * len(bad)
    assert one(spark, lambda c: X.line_field(c, 4), "a\tb\t1\tp, *q\tr\r\n") == ["p, *q\tr"]


def test_kind_and_callee(spark):
    kinds = {"int f(void) {": "function", "struct foo {": "struct", "typedef int x;": "typedef", "#define A 1": "macro", "enum e {": "enum", "int x;": "unknown",
             "f(struct a *p)": "struct", "typedef struct X {": "struct", "union V {": "unknown", None: "unknown"}
    assert one(spark, X.infer_kind, *kinds) == list(kinds.values())
    first = {"if (validate(data)) {": "if", "/* only text */": "unknown", "(*callback)(data);": "unknown", "x = f (1);": "f", "éfoo(x)": "foo", None: "unknown", "": "unknown"}
    assert one(spark, X.first_callee, *first) == list(first.values())
    assert one(spark, X.all_callees, "if (a(b(c))) return d(1);", None) == [["a", "b", "d"], []]


def test_definitions_in_context(spark):
    loose = {"#define A 1": ("A", "macro"), "typedef unsigned long size_t;": ("size_t", "typedef"), "typedef struct X {": ("X", "typedef"), "struct P {": ("P", "struct"),
             "union U {": ("U", "union"), "enum E {": ("E", "enum"), "int g(void);": ("g", "function"), "  while (x)": None, "struct P;": None, "": None, None: None}
    assert [tuple(r) if r else None for r in one(spark, X.symbol_in_context, *loose)] == list(loose.values())
    strict = {"#define A 1": ("A", "macro"), "typedef unsigned long size_t;": None, "typedef struct X {": ("X", "typedef"), "typedef T U;": None, "typedef T;": ("T", "typedef"),
              "struct P;": None, "struct {": None, "// #define X": None, "#define 1A": None, "int f(void);": None}
    assert [tuple(r) if r else None for r in one(spark, X.global_definition, *strict)] == list(strict.values())


def test_small_functions(spark):
    assert one(spark, X.normalize_path, "A\\B/C.H", None) == ["a/b/c.h", None]
    assert one(spark, lambda c: X.occurrences(c, "AA"), "aaaa", "b", "") == [3, 0, 0]
    assert one(spark, X.included_file, '# include "x/y.h"', "#include <z.h>", "int x;") == ["x/y.h", "z.h", None]
    assert [tuple(r) if r else None for r in one(spark, X.index_line, "A\\b.c main 3 x y  z", "a b c")] == [("a/b.c", "main", "3", "x y  z"), None]


def test_import_listing(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes(b"a.c\tmain\t1\tif (f(g(1)))\nbroken\nB.C\tmain\t2\tdone;\r\n")
    lines = L.ordered_lines(spark, str(tmp_path / "l.txt"))
    assert rows(L.import_stats(lines)) == [(4, 2, 1)] and rows(L.import_stats(lines, "strict")) == [(3, 2, 1)]
    assert rows(L.import_calls(lines).select("ord", "file", "callee")) == [(0, "a.c", "if"), (2, "b.c", "unknown")]
    assert rows(L.import_calls(lines, "strict").select("ord", "callee")) == [(0, "f"), (0, "g"), (2, "unknown")]
    assert L.error_log(L.parsed(lines)[1]).first()[0] == "Line 2: Parse failed\n  Content: broken\n"
    with pytest.raises(ValueError, match="parse_error\\(calls, 2"):
        L.stop_on_error(lines, "calls")
    assert L.ordered_lines(spark, str(tmp_path / "none")).count() == 0
    assert L.count_lines(spark, str(tmp_path / "l.txt")) >= 3 and L.count_lines(spark, str(tmp_path / "none")) == 0


def test_scopes(spark):
    data = [(0, "f", "main", 1, "int main"), (1, "f", "main", 2, "int main(void) {"), (2, "f", "main", 3, "g(1);"), (3, "f", "<global>", 4, "#define Q 1"), (4, "f", "<global>", 5, "int x;"), (5, None, None, None, None)]
    t = spark.createDataFrame(data, "ord bigint, file string, symbol string, line bigint, context string")
    assert rows(R.extract_definitions(t).select("ord", "symbol")) == [(1, "main"), (3, "Q")]
    assert rows(R.extract_calls(t).select("ord", "callee")) == [(2, "g")]
    assert rows(R.function_names(t)) == [("main", 0)]


def test_empty_tables(spark):
    sym = spark.createDataFrame([], "ord bigint, file string, symbol string, line bigint, context string, kind string")
    calls = spark.createDataFrame([], "ord bigint, file string, caller string, line bigint, context string, callee string")
    from callweave.operators import graph as G

    assert R.extract_definitions(sym).count() == R.leaf_symbols(sym, calls).count() == 0
    assert G.dependency_levels(sym, calls).count() == G.transitive_calls(calls).count() == G.dependency_cone(calls, "x").count() == 0
    assert rows(R.statistics(symbol=sym, calls=calls)) == [("calls", 0), ("symbol", 0)]
