"""Lookups over names, questions, answers and chunks on small cases: nulls, empty and repeated rows, cycles."""

from pyspark.sql import functions as F

from codeloom.operators import chunking, graph, search
from codeloom.sources import imports

FILES = "file_id string, path string, content string, module_name string"


def test_every_way_to_import(spark):
    py = "import numpy as np, os.path  # both\nfrom ..a.b import (c as d,\n    e,  # last\n)\nif x:\n    from f import *\n    import g\ns = 'import h'\n"
    js = "import 'side';\nimport d, { a as b, c } from './m.js';\nimport * as ns from \"n\";\nexport { x } from './y';\nimport {\n  p,\n  q as r,\n} from 'multi';\nconst z = require('req');\n"
    java = "package k;\nimport java.util.List;\nimport static a.B.*;\nclass C {}\n"
    rows = [("p", "a.py", py, "clash"), ("j", "a.ts", js, ""), ("v", "A.java", java, ""), ("n", "b.py", None, ""), ("e", "c.js", "", ""), ("p", "a.py", py, "clash"), ("o", "d.go", 'import "x"', "")]
    got = {tuple(r) for r in imports.imported_names(spark.createDataFrame(rows, FILES)).collect()}
    assert {r[1:] for r in got if r[0] == "p"} == {("numpy", None, "np", 0), ("os.path", None, None, 0), ("a.b", "c", "d", 2), ("a.b", "e", None, 2), ("f", "*", None, 0), ("g", None, None, 0)}
    assert {r[1:] for r in got if r[0] == "j"} == {
        ("side", None, None, 0), ("./m.js", "d", None, 0), ("./m.js", "a", "b", 0), ("./m.js", "c", None, 0), ("n", "*", "ns", 0), ("./y", "x", None, 0), ("multi", "p", None, 0), ("multi", "q", "r", 0), ("req", None, None, 0),
    }
    assert {r[1:] for r in got if r[0] == "v"} == {("java.util", "List", None, 0), ("a.B", "*", None, 0)} and {r[0] for r in got} == {"p", "j", "v"}
    assert imports.imported_names(spark.createDataFrame(rows, FILES).limit(0)).count() == 0


def test_declarations_of_four_languages(spark):
    rows = [
        ("p", "a.py", "class A(B):\n    async def f(self):\n        pass\ndef g[T](x): pass\n", ""),
        ("t", "a.ts", "export abstract class C {\n  private async run(x: number): Promise<void> {\n    if (x) {\n    }\n  }\n}\ninterface I {}\nexport const enum E { A }\nexport const h = async (x) => x;\nfunction* k() {}\n", ""),
        ("j", "A.java", "public final class D {\n    public D(int a) {}\n    static <T> Map<String, T> m(List<T> x) {\n        return n(x);\n    }\n}\nenum F { A }\nrecord R(int a) {}\n@interface Q {}\n", ""),
        ("n", "b.py", None, ""), ("e", "b.java", "", ""),
    ]
    got = {(r.file_id, r.kind, r.name, r.start_line) for r in imports.declared(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {
        ("p", "class", "A", 1), ("p", "function", "f", 2), ("p", "function", "g", 4), ("t", "class", "C", 1), ("t", "method", "run", 2), ("t", "interface", "I", 7), ("t", "enum", "E", 8), ("t", "arrow", "h", 9),
        ("t", "function", "k", 10), ("j", "class", "D", 1), ("j", "constructor", "D", 2), ("j", "method", "m", 3), ("j", "enum", "F", 7), ("j", "class", "R", 8), ("j", "interface", "Q", 9),
    }
    made = {tuple(r) for r in imports.made(spark.createDataFrame([("j", "A.java", "a = new X<>(1);\nb = new p.Y<Map<K>>(new Z());\n", ""), ("n", "b", None, "")], FILES)).collect()}
    assert ("j", "X", 1) in made and ("j", "Z", 2) in made


def test_paths_meet_no_node_twice(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 2), (None, 1), (1, 2)], "src int, dst int")
    got = {(r.src, r.dst, r.length, tuple(r.path)) for r in graph.paths(edges, 3).collect()}
    assert got == {(1, 2, 1, (1, 2)), (2, 3, 1, (2, 3)), (3, 1, 1, (3, 1)), (1, 3, 2, (1, 2, 3)), (2, 1, 2, (2, 3, 1)), (3, 2, 2, (3, 1, 2))}


def test_questions(spark):
    asked = spark.createDataFrame([(1, "Where is the function load_rows(x)?"), (2, "the class FooBar in python, definition of it"), (3, None), (4, ""), (5, "method doIt without any")], "i int, t string")
    rows = {r.i: r for r in asked.select("i", search.entities_in(F.col("t")).alias("e"), search.filters_from(F.col("t")).alias("f")).collect()}
    assert (rows[1].e.kind, rows[1].e.names) == ("functions", ["Where", "load_rows"]) and (rows[2].e.kind, rows[2].e.names) == ("classes", ["FooBar"]) and rows[5].e.kind is None
    assert rows[2].f.language == ["python"] and rows[2].f.entity_type == ["function", "class", "method", "module"] and rows[3].f.language == [] and rows[4].f.entity_type == []


def test_answers_of_each_kind(spark):
    asked = spark.createDataFrame([(1, ["definition"]), (2, ["usage", "definition"]), (3, ["information"]), (4, None), (5, ["explanation"])], "query_id int, intents array<string>")
    cols = "query_id int, file_path string, start_line int, end_line int, entity_id string, entity_type string, search_type string, rank_score double"
    hits = spark.createDataFrame(
        [(1, "a.py", 1, 2, "f", "Function", "definition", 0.9), (1, "b.py", 1, 2, "g", "Class", "usage", 1.0), (2, "a.py", 1, 2, "f", "Function", None, 0.9), (3, "a.py", 1, 2, None, "", None, 0.5), (3, "a.py", 1, 2, None, "", None, 0.5), (5, "c.py", 1, 1, "h", "Function", None, 0.1), (9, "x", 1, 1, "y", "z", None, 1.0)],
        cols,
    )
    got = {r.query_id: r for r in search.answers_by_kind(asked, hits).collect()}
    assert got[1].results == 1 and got[1].answer == "`f` is defined in one of 1 files: 1 function." and got[2].kind == "usage" and got[2].results == 1
    assert got[3].kind == "general" and got[3].results == 2 and got[3].entities == "" and got[4].answer.startswith("Nothing") and got[5].answer.startswith("Read `h` first") and 9 not in got


def test_chunks_of_files(spark):
    rows = [("a", "a.py", "import x\n\nclass A:\n    def f(self):\n        pass\n\ndef g():\n    pass\n", ""), ("b", "b.md", "text\n" * 3, ""), ("c", "c.py", "x = 1\n", ""), ("n", "n.py", None, ""), ("e", "e.py", "", "")]
    files = spark.createDataFrame(rows, FILES)
    got = [tuple(r) for r in chunking.file_chunks(files).select("file_id", "pos", "kind", "start_line").orderBy("file_id", "pos").collect()]
    assert got == [("a", 0, "class", 3), ("a", 1, "function", 4), ("a", 2, "function", 7), ("b", 0, "code_segment", 1), ("c", 0, "code_segment", 1)]
    entities = spark.createDataFrame([("k", "a", 3, 5), ("l", "a", 0, 0), ("m", "b", 1, 2), ("o", None, 1, 1)], "id string, file_id string, start_line int, end_line int")
    got = {(r.file_id, r.kind, r.start_line, r.end_line) for r in chunking.dispatched(files, entities).collect()}
    assert got == {("a", "header", 1, 2), ("a", "entity", 3, 5), ("b", "window", 1, 4), ("c", "window", 1, 2)}
    assert chunking.file_chunks(files.limit(0)).count() == 0


def test_call_sites_of_whole_texts(spark, tmp_path):
    from codeloom.sources import entities as e

    py = 'import x\nmain(1)\ndef outer(a):\n    """calls nothing(1)\n    nor this(2)"""\n    def inner(b):\n        return b.go(f(1), "g(2)")  # h(3)\n    inner(a)\nclass K(Base):\n    field = make()\n'
    ts = "const r = () => run<string>(1);\n/** doc(1)\n * more(2)\n */\nexport class C {\n  method(a) {\n    return `t(${1})` + this.go(a); // no(1)\n  }\n}\n"
    files = [("p", "a.py", py), ("t", "b.ts", ts), ("n", "c.py", None), ("m", "d.md", "text(1)")]
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("source_files", [(i, p, p, None, "r", "u", "c", "b", None, "2025") for i, p, _ in files], "id string, path string, name string, language string, repository string, repository_url string, commit string, branch string, created_at string, last_updated string")
    write("files_raw", [(p, c, "r", "u", "c", "b") for _, p, c in [*files, files[0]]], "path string, content string, repository string, url string, commit string, branch string")
    functions = [("fo", "outer", "p", 3, 8), ("fi", "inner", "p", 6, 7), ("fm", "method", "t", 6, 8), ("fx", "lost", "p", 0, 0), ("fo", "outer", "p", 3, 8)]
    write("function_defs", [(i, n, None, None, f, None, None, None, s, t, False) for i, n, f, s, t in functions], "id string, name string, docstring string, return_type string, file_id string, class_id string, repository string, params array<string>, start_line int, end_line int, is_method boolean")
    got = {(r.caller_file_id, r.call_name, r.start_line, r.caller_function_id, r.is_attribute_call) for r in e.call_sites(spark, str(tmp_path)).collect()}
    assert got == {
        ("p", "main", 2, None, False), ("p", "go", 7, "fi", True), ("p", "f", 7, "fi", False), ("p", "inner", 8, "fo", False), ("p", "make", 10, None, False),
        ("t", "run", 1, None, False), ("t", "go", 7, "fm", True),
    }
    sites = [(r.module_name, r.start_line, r.is_from_import) for r in e.import_sites(spark, str(tmp_path)).collect()]
    assert sites == [("x", 1, False)]


def test_stages_over_days(spark):
    from codeloom.streaming import events as ev

    rows = [
        (1, "a", "2024-01-01 10:00:00", "S"), (2, "a", "2024-01-03 10:00:00", "E"), (3, "a", "2024-01-03 11:00:00", "S"), (4, "a", "2024-01-03 11:00:30", "E"), (5, "b", "2024-01-02 00:00:00", "E"),
        (6, None, "2024-01-01 00:00:00", "S"), (7, None, "2024-01-05 00:00:00", "E"), (8, "a", None, "E"), (9, "a", "2024-01-02 00:00:00", "X"),
    ]
    df = spark.createDataFrame(rows, "event_id int, source string, t string, kind string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    got = {(r.event_id, r.source): r.seconds for r in ev.stage_durations(df, "S", "E").collect()}
    assert got == {(2, "a"): 172800.0, (4, "a"): 30.0, (7, None): 345600.0}
    made = {r.event_id: (r.kind, r.data) for r in ev.made(spark.createDataFrame([(1, "view", '{"k": 3, "source": "x"}', 5), (2, None, None, None)], "event_id int, event_type string, props string, user_id int").withColumn("ts", F.lit(None).cast("timestamp"))).collect()}
    assert made[1] == ("FILE_PROCESSED", {"k": "3", "source": "x", "type": "view"}) and made[2][1] == {}
