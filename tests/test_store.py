from conftest import rows

from callweave import cli
from callweave.plans import pipeline as P
from callweave.sources import lines as L
from callweave.sources import scanner as S
from callweave.store import Store
from callweave.streaming.imports import append_batch, follow

CODE = r"""
#include <stdio.h>
#include "util/a.h"
#define LIMIT 3 /* not f(x) */

struct box {
    int (*call)(int);
};

static int add(int a,
               int b)
{
    // no_call(1);
    return twice(a) + twice(b);
}

int twice(int x) { return x * 2; }

int proto(int x);

int main(void) {
    if (add(1, 2) > LIMIT) {
        printf("text call(3) }\n");
    }
    /* block
       ghost(4);
    */
    return 0;
}
int after;
"""


def test_scanner(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "X.C").write_text(CODE)
    (tmp_path / "notes.txt").write_text("int main(void) { f(); }")
    lines = S.scan_lines(L.source_files(spark, str(tmp_path)))
    assert sorted(r["symbol"] for r in S.function_definitions(lines).collect()) == ["add", "main", "twice"]
    assert rows(S.call_sites(lines).select("caller", "callee")) == [("add", "twice"), ("add", "twice"), ("main", "add"), ("main", "printf")]
    got = P.extract_tree(spark, str(tmp_path))
    assert sorted(r["included"] for r in got["includes"].collect()) == ["stdio.h", "util/a.h"]
    scope = {r["context"]: r["symbol"] for r in got["symbol"].collect()}
    assert scope["struct box {"] == scope["int after;"] == "<global>" and scope["return 0;"] == "main"
    assert rows(got["def"].select("symbol", "kind")) == [("LIMIT", "macro"), ("add", "function"), ("box", "struct"), ("main", "function"), ("twice", "function")]
    assert {r["file"] for r in got["symbol"].collect()} == {"sub/x.c"}
    for name in ("symbol", "def", "calls"):
        ords = [r["ord"] for r in got[name].orderBy("file", "line").collect()]
        assert sorted(ords) == list(range(len(ords)))
    out = P.write_extracted(spark, str(tmp_path), str(tmp_path / "out"))
    assert L.count_lines(spark, out["definitions"]) == 5
    kb = Store(spark, str(tmp_path / "kb"))
    for _ in range(2):
        P.import_listing(kb, "calls", out["callees"], "listed")
    back = [(r["caller"], r["line"], r["context"], r["callee"]) for r in kb.table("calls").collect()]
    assert sorted(back) == sorted(2 * [(r["caller"], r["line"], r["context"], r["callee"]) for r in got["calls"].collect()])
    assert sorted(r["ord"] for r in kb.table("calls").collect()) == list(range(len(back)))


def scan(spark, code):
    lines = S.scan_lines(spark.createDataFrame([("a.c", code)], "file string, text string"))
    return rows(S.call_sites(lines).select("caller", "callee")), sorted(r["symbol"] for r in S.function_definitions(lines).collect())


def test_scanner_comments_and_literals(spark):
    code = "/* see http://x */\nint f(void) {\n  g(); // it\'s \"one\n}\nint k(void) {\n  char *s = \"/* no\"; h(); /* \" */ i('\"');\n}\n"
    assert scan(spark, code.replace("\\'", "'")) == ([("f", "g"), ("k", "h"), ("k", "i")], ["f", "k"])
    open_end = "int f(void) {\n  g(\"a\\\n b(\");\n}\n/* never closed int z(void) { q(); }\n"
    assert scan(spark, open_end) == ([("f", "g")], ["f"])
    assert scan(spark, "") == ([], []) and scan(spark, None) == ([], [])
    long = "int f(void) {\n" + "/* " + "x" * 200_000 + ' */ g("' + "y" * 200_000 + '");\n}\n'
    assert scan(spark, long) == ([("f", "g")], ["f"])


def test_source_files(spark, tmp_path):
    for name in ("a b+c.c", "Z.HPP", ".hidden.c", "sub/x.cc", "n.txt", "y.hh"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("int x;")
    assert {r[0] for r in L.source_files(spark, str(tmp_path)).select("file").collect()} - {".hidden.c"} == {"a b+c.c", "Z.HPP", "sub/x.cc", "y.hh"}
    assert rows(L.source_files(spark, str(tmp_path), recursive=False).select("file")) == [("a b+c.c",)]


def test_ordered_lines(spark, tmp_path):
    for name, n in (("b", 1000), ("a", 3), ("c", 0)):
        (tmp_path / name).write_text("".join(f"{name}{i}\r\n" if i % 2 else f"{name}{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = [(r["ord"], r["raw"].rstrip("\r")) for r in L.ordered_lines(spark, str(tmp_path), 5).orderBy("ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate([f"a{i}" for i in range(3)] + [f"b{i}" for i in range(1000)], 5))
    assert L.ordered_lines(spark, str(tmp_path / "none")).count() == 0


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "kb"))
    assert s.attach() == {"symbol": 0, "def": 0, "calls": 0}
    one = spark.createDataFrame([(1, "a.c", "f", "extra")], "ord bigint, file string, symbol string, other string")
    s.append("def", one), s.append("def", one)
    assert s.table("def").count() == 2
    s.append("def", spark.createDataFrame([(2, None, "g")], "ord bigint, file string, symbol string"))
    s.retract_all("def", file="a.c")
    assert rows(s.table("def").select("symbol")) == [("g",)]
    s.compact()
    s.create_views()
    assert spark.sql("select count(*) from def").first()[0] == 1
    old = s.table("def")
    s.clear()
    assert old.count() == 1  # a reader of the version before
    assert s.attach(silent=False) == {"symbol": 0, "def": 0, "calls": 0} and s.next_ord("def") == 0
    s.append("def", one, part="p"), s.append("def", one, part="p")
    assert s.table("def").count() == 1


def test_import_stream_and_cli(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.txt").write_text("a.c\tmain\t1\tf();\na.c\tf\t2\tg();\nbad\n")
    kb = str(tmp_path / "kb")
    assert cli.main(["--store", kb, "import", "calls", str(tmp_path / "in"), "--error-log", str(tmp_path / "log")]) == 0
    assert "'failed': 1" in capsys.readouterr().out
    assert cli.main(["--store", kb, "query", "cone", "main"]) == 0
    assert capsys.readouterr().out.split() == ["f", "g"]
    assert cli.main(["--store", kb, "query", "reaches", "g"]) == 0
    assert capsys.readouterr().out.split() == ["f", "main"]
    assert cli.main(["--store", kb, "import", "calls", str(tmp_path / "in"), "--stop-on-error"]) == 1
    assert "parse_error(calls, 3, 'bad')" in capsys.readouterr().err
    (tmp_path / "d.txt").write_text("a.c\tmain\t1\tint main(void) {\na.c\tf\t2\tint f(void) {\na.c\tg\t3\tint g(void) {\n")
    assert cli.main(["--store", kb, "import", "def", str(tmp_path / "d.txt"), "--log", str(tmp_path / "logs"), "--debug", "1"]) == 0
    assert "[sample]" in (tmp_path / "logs" / "generation.log").read_text() and "d.txt" in (tmp_path / "logs" / "files_accessed.txt").read_text()
    capsys.readouterr()
    assert cli.main(["--store", kb, "query", "level", "3"]) == 0
    assert capsys.readouterr().out == "Level 3:\n  main -> f\n\n"
    assert cli.main(["--store", kb, "query", "level", "x"]) == 1
    (tmp_path / "src").mkdir(), (tmp_path / "src" / "a.c").write_text("int f(void) {\n  g();\n}\n")
    assert cli.main(["extract", str(tmp_path / "src"), str(tmp_path / "o"), "--dry-run"]) == 0
    assert capsys.readouterr().out == "a.c\n" and not (tmp_path / "o").exists()
    assert cli.main(["extract", str(tmp_path / "src"), str(tmp_path / "o"), "--quiet"]) == 0
    assert "callees:1\n" in capsys.readouterr().out
    s = Store(spark, str(tmp_path / "kb2"))
    q = follow(spark, str(tmp_path / "in"), s, "calls", str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert rows(s.table("calls").select("ord", "caller", "callee")) == [(0, "main", "f"), (1, "f", "g")]
    batch = spark.createDataFrame([("b.c\tx\t1\ty();",)], "value string")
    for _ in range(2):  # a batch that is run again, with a number beyond any shift
        append_batch(s, "calls", batch, 5000, "stream")
    assert rows(s.table("calls").where("caller = 'x'").select("ord", "callee")) == [(2, "y")]
