"""Operators on small cases: nulls, empty tables, repeats, ties, long texts, and properties of the rewrites."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import analysis, chunking, embed, graph, resolve, search, syntax_tree, vectors
from codeloom.sources import snapshots
from codeloom.sources.collections import Collection, schema_of, store
from codeloom.streaming import events, ingest


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- text -------------------------------------------------------------------------------------------------------------


def plain_loc(path, content):
    ext = "." + path.rsplit(".", 1)[1] if "." in path else ""
    slash = ext in text.SLASH_COMMENTS
    mark, opening, closing = ("//", "/*", "*/") if slash else ("#", "=begin" if ext == ".rb" else '"""', "=end" if ext == ".rb" else '"""')
    code = comment = blank = total = 0
    inside = False
    for line in content.replace("\r\n", "\n").removesuffix("\n").split("\n") if content else []:
        line = line.strip()
        total += 1
        if not line:
            blank += 1
        elif inside:
            comment += 1
            inside = closing not in line
        elif line.startswith(mark):
            comment += 1
        elif opening in line:
            comment += 1
            inside = closing not in line
        else:
            code += 1
    return code, comment, blank, total


def test_loc_counts_as_brute_force(spark):
    cases = [
        ("a.py", '# x\n\nx = 1\n"""doc\nmore\n"""\ny = 2\n'),
        ("a.js", "/* a */\n// b\n\ncode();\n/*\n in\n*/\nx\n"),
        ("a.java", "class A {\r\n  // c\r\n}\r\n"),
        ("a.rb", "=begin\nx\n=end\nputs 1"),
        ("noext", "# a\nb"),
        ("a.py", ""),
        ("a.py", "x" * 50_000),
    ]
    df = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(cases)] + [(99, "a.py", None)], "i int, p string, c string")
    got = {r.i: r.l for r in df.select("i", text.loc(F.col("p"), F.col("c")).alias("l")).collect()}
    assert got[99] is None
    for i, (p, c) in enumerate(cases):
        assert tuple(got[i]) == plain_loc(p, c), (p, c[:40])


def test_paths_and_languages(spark):
    df = spark.createDataFrame([("A/b.PY",), ("node_modules/x.js",), ("x.cs",), ("noext",), (None,)], "p string")
    got = [tuple(r) for r in df.select(text.language_of(F.col("p")), text.language_of(F.col("p"), text.CHUNKER, "unknown"), text.language_of(F.col("p"), text.EXTRACTOR)).collect()]
    assert got == [("python", "python", "python"), ("javascript", "javascript", "javascript"), (None, "csharp", "c_sharp"), (None, "unknown", None), (None, None, None)]
    kept = rows(df.where(text.indexable(F.col("p"), F.lit(10))), "p")
    assert kept == [("A/b.PY",), ("noext",), ("x.cs",)]


@pytest.mark.parametrize("given_,want", [("true", True), ("False", False), ("12", 12), ("1.5", 1.5), ("1.2.3", "1.2.3"), ("x", "x"), ("", "")])
def test_filter_values(given_, want):
    assert text.cast_filter_value(given_) == want


# --- chunks and trees -------------------------------------------------------------------------------------------------


@given(st.lists(st.text("ab (.,", max_size=30), max_size=60), st.integers(1, 40), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_windows_cover_every_line(lines, tokens, overlap):
    found = chunking.windows(lines, tokens, overlap)
    assert {i for a, b in found for i in range(a, b)} == set(range(len(lines)))
    assert all(a < b for a, b in found) and all(x[0] < y[0] for x, y in zip(found, found[1:]))
    full = chunking.windows(lines, tokens, overlap, compat=True)
    assert full[: len(found)] == found and (not lines or full[-1] == (len(lines) - 1, len(lines)))


def test_windows_of_the_recurrence():
    assert len(chunking.windows(["x"] * 5, compat=True)) == 5
    many = chunking.windows(["a b c d"] * 600, compat=True)
    assert len(many) == 13 and many[-1] == (599, 600)


def test_window_chunks_of_nulls(spark):
    files = spark.createDataFrame([("a", None), ("b", ""), ("c", "x\ny")], "file_id string, content string")
    assert rows(chunking.window_chunks(files), "file_id", "start_line", "end_line", "content") == [("c", 1, 2, "x\ny")]


def test_syntax_trees(spark):
    code = "import os\nfrom a.b import c as d\n\nclass K(Base):\n    def m(self):\n        return self.x.run(os.getcwd())\n\nasync def f():\n    m()\n"
    files = spark.createDataFrame([("f", code), ("bad", "def ("), ("none", None)], "file_id string, content string")
    nodes = syntax_tree.python_nodes(files).cache()
    assert rows(syntax_tree.definitions(nodes), "kind", "name", "start_row") == [("class", "K", 4), ("function", "f", 8), ("function", "m", 5)]
    assert rows(syntax_tree.call_names(nodes), "call_name", "is_attribute_call") == [("getcwd", True), ("m", False), ("run", True)]
    assert rows(syntax_tree.imported(nodes), "module_name", "import_name") == [("a.b", "c"), ("os", "os")]
    assert [r.type for r in nodes.where("file_id = 'bad'").collect()] == ["error"]


def test_embedder(spark):
    df = spark.createDataFrame([("load rows",), ("LOAD_rows",), (None,), ("",)], "t string")
    got = [r.v for r in df.select(embed.embedded(F.col("t"), dim=8).alias("v")).collect()]
    assert got[2] is None and got[3] == [0.0] * 8 and abs(sum(x * x for x in got[0]) - 1) < 1e-5
    with pytest.raises(ValueError):
        embed.embedded(F.col("t"), "no such")


# --- graph ------------------------------------------------------------------------------------------------------------


def test_upsert_is_idempotent_and_keeps_extra_columns(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, ts int, note string")
    new = spark.createDataFrame([("b", 2, 7), ("b", 3, 8), ("c", 1, 9), (None, 1, 1)], "id string, ts int, n int")
    once = graph.upsert(old, new, "id", "ts")
    want = [("a", 1, None), ("b", 3, 8), ("c", 1, 9)]
    assert rows(once, "id", "ts", "n") == want
    assert rows(graph.upsert(once, new, "id", "ts"), "id", "ts", "n") == want
    assert rows(graph.update_only(old, new.drop("n"), "id"), "id") == [("a",), ("b",)]


def test_edges_need_both_ends(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    new = spark.createDataFrame([("a", "b", None), ("a", "b", None), ("a", "z", "T"), ("q", "b", "T")], "src string, dst string, rel_type string")
    assert rows(graph.upsert_edges(new.limit(0), new, nodes, nodes), "src", "dst", "rel_type") == [("a", "b", "RELATED_TO")]


def test_closure_with_cycle_and_depth(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), (None, "a"), ("a", "b")], "src string, dst string")
    got = rows(graph.closure(e), "src", "dst", "depth")
    assert ("a", "d", 3) in got and ("d", "d", 1) not in got and len(got) == 9
    assert all(r[2] <= 1 for r in rows(graph.closure(e, most=1), "src", "dst", "depth"))
    assert rows(graph.closure(e.limit(0)), "src", "dst") == []


def test_detach(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    n, e = graph.detach(nodes, edges, nodes.where("id = 'b'"))
    assert rows(n, "id") == [("a",), ("c",)] and rows(e, "src", "dst") == [("a", "c")]


def test_resolution_rewrite_equals_ranking(spark):
    rng = random.Random(5)
    defs = [(f"d{i:03}", rng.choice("pqr"), f"f{rng.randrange(6)}", f"r{rng.randrange(2)}", None) for i in range(60)]
    sites = [(f"s{i:03}", rng.choice("pqrz"), bool(i % 2), f"f{rng.randrange(6)}", f"c{i}", f"r{rng.randrange(2)}") for i in range(90)]
    d = spark.createDataFrame([*defs, ("dn", None, "f1", "r1", None)], "id string, name string, file_id string, repository string, class_id string")
    s = spark.createDataFrame([*sites, ("sn", None, False, "f1", "c", None)], "id string, call_name string, is_attribute_call boolean, caller_file_id string, caller_function_id string, repository string")
    fast, slow = resolve.resolve(s, d), resolve.resolve_naive(s, d)
    # a file may belong to two repositories here: compare where the ranking's own-file rule agrees
    same = {r[0]: r for r in rows(slow, "src", "dst", "score")}
    got = {r[0]: r for r in rows(fast, "src", "dst", "score")}
    assert set(same) <= set(got)
    assert all(got[k][2] >= same[k][2] for k in same)
    assert rows(resolve.resolve_new(s, d, fast), "src") == []
    assert rows(resolve.resolve(s.limit(0), d), "src") == []


def test_dead_code(spark):
    f = spark.createDataFrame([("1", "main"), ("2", "used"), ("3", "left"), ("4", "test_x"), ("5", "_p")], "id string, name string")
    c = spark.createDataFrame([("2",)], "callee string")
    assert rows(analysis.dead(f, c, ["_.*"]), "name") == [("left",)]
    assert analysis.samples(analysis.dead(f, c), 1).collect()[0].samples == ["_p:5"]
    assert analysis.resolution_stats(f.limit(0), c.select(F.col("callee").alias("src"))).collect()[0].pct == 0


def test_name_status_and_diff(spark):
    lines = spark.createDataFrame([("M\ta.py",), ("R100\told x.py\tnew.py",), ("A\tb",), ("",)], "value string")
    assert rows(snapshots.name_status(lines), "path", "change_type") == [("a.py", "M"), ("b", "A"), ("new.py", "A"), ("old x.py", "D")]
    a = spark.createDataFrame([("p", "1"), ("q", None), ("r", "1")], "path string, hash string")
    b = spark.createDataFrame([("p", "2"), ("q", None), ("s", "1")], "path string, hash string")
    assert rows(snapshots.diff(a, b), "path", "change_type") == [("p", "M"), ("r", "D"), ("s", "A")]


def test_read_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 'é'\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.js").write_text("x")
    (tmp_path / "c.png").write_bytes(b"\x89PNG")
    assert rows(snapshots.read_tree(spark, str(tmp_path), "r"), "path", "content") == [("src/a.py", "x = 'é'\n")]


# --- vectors and search -----------------------------------------------------------------------------------------------


def test_top_k_with_ties_nulls_and_extra_columns(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0], "x"), (1, [2.0, 0.0], "y"), (2, [0.0, 1.0], None), (4, None, "z")], "id bigint, vector array<double>, note string")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id bigint, vector array<double>")
    assert rows(vectors.top_k(q, v, 2), "id", "score", "rank") == [(1, 1.0, 1), (3, 1.0, 2)]
    assert rows(vectors.top_k(q, v, 5, "l2"), "id", "score") == [(1, 1.0), (2, 1.414214), (3, 0.0)]
    assert vectors.top_k(q, v.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vectors.top_k(q, v, metric="no such")


def test_blocks_do_not_change_results(spark, monkeypatch):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)], "id bigint, vector array<double>")
    q = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    whole = rows(vectors.top_k(q, v, 7), "query_id", "id", "score", "rank")
    monkeypatch.setattr(vectors, "BLOCK", 23)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    assert rows(vectors.top_k(q, v, 7), "query_id", "id", "score", "rank") == whole


CASES = st.recursive(
    st.one_of(
        st.builds(lambda f, v: {"operator": "==", "field": f, "value": v}, st.sampled_from("ab"), st.integers(0, 3)),
        st.builds(lambda f, v: {"operator": "!=", "field": f, "value": v}, st.sampled_from("ab"), st.integers(0, 3)),
        st.builds(lambda f, v: {"operator": "in", "field": f, "value": v}, st.sampled_from("ab"), st.lists(st.integers(0, 3), max_size=2)),
        st.builds(lambda f, v, n: {"operator": "range", "field": f, "value": {n: v}}, st.sampled_from("ab"), st.integers(0, 3), st.sampled_from(["gt", "gte", "lt", "lte"])),
        st.just({"operator": "odd", "field": "a", "value": 1}),
    ),
    lambda inner: st.builds(lambda o, c: {"operator": o, "conditions": c}, st.sampled_from(["and", "or"]), st.lists(inner, max_size=3)),
    max_leaves=5,
)


def holds(f, row):
    op = f["operator"]
    if op in ("and", "or"):
        parts = [p for c in f["conditions"] if (p := holds(c, row)) is not None]
        return None if not parts else all(parts) if op == "and" else any(parts)
    x = row[f["field"]] if "field" in f else None
    if op == "==":
        return x == f["value"]
    if op == "!=":
        return x != f["value"]
    if op == "in":
        return x in f["value"] if f["value"] else None
    if op == "range":
        (n, v), = f["value"].items()
        return {"gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[n]
    return None


@given(CASES)
@settings(max_examples=15, deadline=None)
def test_filters_as_an_evaluator(spark, tree):
    table = [{"a": a, "b": b} for a in range(4) for b in range(4)]
    df = spark.createDataFrame([(r["a"], r["b"]) for r in table], "a int, b int")
    want = sorted((r["a"], r["b"]) for r in table if holds(tree, r) is not False)
    assert rows(vectors.where(df, tree), "a", "b") == want
    text_ = vectors.expression(tree)
    assert rows(df.where(text_) if text_ else df, "a", "b") == want


def test_flat_filters_and_strict():
    assert vectors.expression({"l": "x'y", "n": [1, 2], "b": True}) == "l = 'x''y' AND n IN (1, 2) AND b = true"
    assert vectors.condition({}) is None and vectors.condition({"operator": "odd"}) is None
    with pytest.raises(ValueError):
        vectors.condition({"operator": "odd"}, strict=True)


def test_rerank_and_merge_by_hand(spark):
    schema = "query_id int, id string, score double, entity_type string, start_line int, end_line int, expanded boolean"
    hits = spark.createDataFrame([(1, "a", 0.8, "function", None, None, False), (1, "b", 0.85, "class", None, None, False), (1, "c", 0.75, "function", None, None, True)], schema)
    assert rows(search.rerank(hits).select("id", F.round("score", 5).alias("s")), "id", "s") == [("a", 0.798), ("b", 0.84788), ("c", 0.73316)]
    spans = hits.withColumn("start_line", F.lit(10)).withColumn("end_line", F.lit(15))
    assert rows(search.rerank(spans).select("id", F.round("score", 6).alias("s")).where("id = 'c'"), "s") == [(0.77175,)]
    p = spark.createDataFrame([(1, "x", 0.9)], "query_id int, id string, score double")
    more = spark.createDataFrame([(1, "x", 0.99, 1), (1, "y", 0.5, 2), (1, "y", 0.4, 1)], "query_id int, id string, score double, expansion int")
    assert rows(search.merged(p, more), "id", "score", "expanded") == [("x", 0.9, False), ("y", 0.4, True)]


def test_fusion_and_rank_by_hand(spark):
    v = spark.createDataFrame([(1, "a.py", 10, 20, 0.8, "", "function")], "query_id int, file_path string, start_line int, end_line int, score double, entity_id string, entity_type string")
    g = spark.createDataFrame([(1, "a.py", 10, 20, "e", "function", "definition"), (1, "b.py", 1, 2, "f", "class", "usage")], "query_id int, file_path string, start_line int, end_line int, entity_id string, entity_type string, search_type string")
    f = search.ranked(search.fused(v, g))
    assert rows(f.select("file_path", "source", "entity_id", F.round("rank_score", 6).alias("r")), "file_path", "source", "entity_id", "r") == [("a.py", "both", "e", 1.0), ("b.py", "graph", "f", 0.77)]


def test_query_understanding(spark):
    df = spark.createDataFrame([("Explain how does load_rows() run",), ("hello",), (None,), ("",)], "q string")
    got = [tuple(r) for r in df.select(search.intents(F.col("q")), search.names_in(F.col("q")), F.size(search.expansions(F.col("q")))).collect()]
    assert got[0] == (["explanation", "execution"], ["Explain", "load_rows"], 3)
    assert got[1][0] == ["information"] and got[2][0] is None


def test_collection_versions(spark, tmp_path):
    c = store("parquet", spark, str(tmp_path), "code")
    assert not c.exists() and c.create() and c.create() and c.count() == 0
    c.insert(spark.createDataFrame([("a", [1.0, 0.0], "python"), ("b", [0.0, 1.0], None)], "id string, vector array<float>, language string"))
    assert c.count() == 2 and c.count({"language": "python"}) == 1 and c.get(spark.createDataFrame([("b",)], "id string")).collect()[0].language == ""
    c.insert(spark.createDataFrame([("b", [1.0, 1.0], "java")], "id string, vector array<float>, language string"))
    assert c.count({"language": "java"}) == 1
    assert c.undo() and c.count({"language": "java"}) == 0
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    assert rows(c.search(q, least=0.5), "id", "language") == [("a", "python")]
    c.delete(filters={"language": "python"})
    assert c.count() == 1
    assert c.drop() and not c.drop()
    with pytest.raises(ValueError):
        store("other")
    assert schema_of({"x": "odd"})["x"].dataType.simpleString() == "string"


# --- feeds ------------------------------------------------------------------------------------------------------------


def test_apply_batch_twice_and_late(spark):
    state = spark.createDataFrame([("a", 5, "new"), ("b", 1, "old")], "id string, last_updated int, v string")
    batch = spark.createDataFrame([("a", 3, "late"), ("b", 2, "now"), ("c", 1, "c"), (None, 9, "x")], "id string, last_updated int, v string")
    once = ingest.apply_batch(state, batch)
    assert rows(once, "id", "v") == [("a", "new"), ("b", "now"), ("c", "c")]
    assert rows(ingest.apply_batch(once, batch), "id", "v") == rows(once, "id", "v")


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    from conftest import SMALL

    from codeloom import catalogue

    for table in ("source_files", "events"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    for name in ("stream_files", "event_stream_tumbling"):
        query = catalogue.queries()[name]
        got, want = (sorted(tuple(r) for r in query(spark, d).collect()) for d in (str(tmp_path), SMALL))
        assert got == want and got


def test_feed_keeps_an_index(spark, tmp_path):
    schema = "id string, last_updated int, v string"
    for n, part in enumerate(([("a", 1, "x")], [("a", 2, "y"), ("b", 1, "z")], [("a", 1, "x")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    index = ingest.Index(spark, str(tmp_path / "index"))
    index.run(ingest.feed(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, per_trigger=1))
    assert rows(index.read(), "id", "v") == [("a", "y"), ("b", "z")]


def test_event_statistics(spark):
    e = spark.sql("SELECT * FROM VALUES ('ENTITY_CREATED', TIMESTAMP_NTZ '2024-01-01 00:00:00', 3L), ('ENTITY_CREATED', TIMESTAMP_NTZ '2024-01-01 00:00:10', NULL), ('FILE_PROCESSED', TIMESTAMP_NTZ '2024-01-01 00:00:20', 1L) t(kind, ts, count)")
    got = events.statistics(e).collect()[0]
    assert got.entity_count == 4 and got.file_count == 1 and got.files_per_second == 0.05
    assert events.statistics(e.limit(0)).collect()[0].file_count == 0


# --- state that outlives a driver -------------------------------------------------------------------------------------


def test_an_index_goes_on_after_a_restart(spark, tmp_path):
    from codeloom.streaming.ingest import Index

    rows = lambda *r: spark.createDataFrame(list(r), "id string, last_updated int, note string")
    folder = str(tmp_path / "index")
    Index(spark, folder).upsert(rows(("a", 1, "x"), ("b", 1, "y")), 0)
    again = Index(spark, folder)
    assert again.version == 0
    again.upsert(rows(("a", 1, "lost"), ("z", 9, "lost")), 0)  # the batch that was applied before
    again.upsert(rows(("b", 2, "z"), ("c", 1, "w")), 1)
    (tmp_path / "index" / "v7").mkdir()  # a version that was not written to its end
    assert sorted(tuple(r) for r in Index(spark, folder).read().collect()) == [("a", 1, "x"), ("b", 2, "z"), ("c", 1, "w")]


def test_latest_keeps_maps(spark):
    from codeloom.tables import latest

    df = spark.createDataFrame([("a", 1, {"x": "1"}, "p"), ("a", 2, {"y": "2"}, "q"), ("a", 2, {"y": "2"}, "q"), ("b", None, None, None), (None, 1, {}, "r")], "id string, t int, extra map<string,string>, note string")
    got = {r.id: (r.t, r.extra, r.note) for r in latest(df, ["id"], "t").collect()}
    assert got == {"a": (2, {"y": "2"}, "q"), "b": (None, None, None), None: (1, {}, "r")}
    assert latest(df, ["id"], "t").columns == df.columns


def test_constants_stay_whole(spark):
    from codeloom.operators import syntax_tree

    df = spark.createDataFrame([("f", "x = '" + "y" * 5000 + "'\n")], "file_id string, content string")
    assert syntax_tree.python_nodes(df).where("type = 'Constant'").collect()[0].text == "y" * 5000
