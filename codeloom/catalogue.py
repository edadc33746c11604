"""The registered queries of the core, one per operator, each over its whole tables; their SQL twins are in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import oracle, oracle_lookups
from codeloom.functions import ids, text
from codeloom.operators import analysis, chunking, embed, graph, resolve, search, syntax_tree, vectors
from codeloom.plans.api import CodeIndex
from codeloom.sources import entities as e
from codeloom.sources import snapshots
from codeloom.streaming import events as ev
from codeloom.streaming import ingest
from codeloom.tables import current_files, cut, latest, read

FLAGSHIP = "dead_functions"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    known = oracle.queries() | oracle_lookups.queries()
    return {n: known[n] for n in _QUERIES if n in known}


def _sources(s: SparkSession, d: str) -> DataFrame:
    """Current texts, repeats once."""
    return current_files(s, d).dropDuplicates(["file_id", "content"])


def _entities(s: SparkSession, d: str) -> DataFrame:
    cols = ["id", "file_id", "start_line", "end_line"]
    return e.functions(s, d).select(*cols).unionByName(e.classes(s, d).select(*cols))


def _calls(s: SparkSession, d: str) -> DataFrame:
    sites = e.call_sites(s, d)
    return resolve.calls(sites, resolve.resolve(sites, e.functions(s, d)))


# --- sources, scans, scalar functions ---------------------------------------------------------------------------------


@query
def files_current(s: SparkSession, d: str) -> DataFrame:
    return e.files(s, d).select("id", "path", "repository", "language")


@query
def indexable_files(s: SparkSession, d: str) -> DataFrame:
    src = _sources(s, d)
    return src.where(text.indexable(F.col("path"), F.octet_length("content"))).select("file_id")


@query
def parse_gate(s: SparkSession, d: str) -> DataFrame:
    fine, failed = snapshots.parse_gate(_sources(s, d))
    both = fine.select(F.lit("parse").alias("outcome")).unionByName(failed.select(F.col("reason").alias("outcome")))
    return analysis.counts_by(both, "outcome")


@query
def snapshot_diff(s: SparkSession, d: str) -> DataFrame:
    """Oldest superseded state of each file against its current one."""
    now = e.files(s, d).select("id", F.col("commit").alias("hash"), F.col("last_updated").alias("now"))
    old = read(s, d, "source_files").join(now.select("id", "now"), "id").where("last_updated < now")
    first = old.groupBy("id").agg(F.min_by("commit", "last_updated").alias("hash"))
    return snapshots.diff(first, now.select("id", "hash"), "id")


@query
def language_by_ext(s: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return e.files(s, d).select(
        "id",
        text.language_of(p).alias("parser"),
        text.language_of(p, text.CHUNKER, "unknown").alias("chunker"),
        text.language_of(p, text.CHUNK_TOOL, "unknown").alias("tool"),
        text.language_of(p, text.EXTRACTOR).alias("extractor"),
    )


@query
def language_by_content(s: SparkSession, d: str) -> DataFrame:
    return e.chunks(s, d).select("chunk_id", text.language_of_text(F.col("content")).alias("language"))


@query
def url_normalise(s: SparkSession, d: str) -> DataFrame:
    u = F.col("repository_url")
    return read(s, d, "source_files").select("repository_url").distinct().select("repository_url", text.normalised_url(u).alias("url"), text.repository_name(u).alias("name"))


@query
def content_hash(s: SparkSession, d: str) -> DataFrame:
    rows = _sources(s, d).where("content IS NOT NULL").select(F.md5("content").alias("hash"), "repository")
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("repository").alias("repositories"))


@query
def binary_files(s: SparkSession, d: str) -> DataFrame:
    return _sources(s, d).select("file_id", text.binary_like(F.col("path"), F.col("content")).alias("is_binary"))


@query
def loc_counts(s: SparkSession, d: str) -> DataFrame:
    return _sources(s, d).where("content IS NOT NULL").select("file_id", text.loc(F.col("path"), F.col("content")).alias("l")).select("file_id", "l.*")


@query
def line_tokens(s: SparkSession, d: str) -> DataFrame:
    return _sources(s, d).where("content IS NOT NULL").select("file_id", text.text_tokens(F.col("content")).alias("tokens"))


# --- chunks, trees, embeddings ----------------------------------------------------------------------------------------


@query
def chunk_windows(s: SparkSession, d: str) -> DataFrame:
    return chunking.window_chunks(_sources(s, d)).select("file_id", "start_line", "end_line", F.md5("content").alias("hash"))


@query
def chunk_windows_compat(s: SparkSession, d: str) -> DataFrame:
    return chunking.window_chunks(_sources(s, d), compat=True).select("file_id", "start_line", "end_line", F.md5("content").alias("hash"))


@query
def entity_chunks(s: SparkSession, d: str) -> DataFrame:
    src = _sources(s, d).where("content IS NOT NULL").select("file_id", "content")
    return chunking.entity_chunks(src, _entities(s, d), "entity").select("entity_id", F.md5("content").alias("hash"))


@query
def header_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.header_chunks(_sources(s, d).select("file_id", "content"), _entities(s, d)).select("file_id", "end_line", F.md5("content").alias("hash"))


@query
def split_functions(s: SparkSession, d: str) -> DataFrame:
    return chunking.split(_sources(s, d), "function").select("file_id", "start_line", "end_line", F.md5("content").alias("hash"))


@query
def split_classes(s: SparkSession, d: str) -> DataFrame:
    return chunking.split(_sources(s, d), "class").select("file_id", "start_line", "end_line", F.md5("content").alias("hash"))


@query
def format_for_embedding(s: SparkSession, d: str) -> DataFrame:
    shown = chunking.for_embedding(F.col("content"), F.col("language"), F.col("file_path"), F.col("content_type"))
    return e.chunks(s, d).select("chunk_id", F.md5(shown).alias("hash"))


@query
def chunk_embeddings(s: SparkSession, d: str) -> DataFrame:
    shown = chunking.for_embedding(F.col("content"), F.col("language"), F.col("file_path"), F.col("content_type"))
    return e.chunks(s, d).select("chunk_id", embed.embedded(shown).alias("vector"))


@query
def syntax_definitions(s: SparkSession, d: str) -> DataFrame:
    """Functions and classes of Python files, read off their syntax trees."""
    src = _sources(s, d).where("path LIKE '%.py'").select("file_id", "content")
    return syntax_tree.definitions(syntax_tree.python_nodes(src))


@query
def syntax_calls(s: SparkSession, d: str) -> DataFrame:
    src = _sources(s, d).where("path LIKE '%.py'").select("file_id", "content")
    names = syntax_tree.call_names(syntax_tree.python_nodes(src))
    return names.groupBy("call_name").agg(F.count(F.lit(1)).alias("sites"), F.count_if("is_attribute_call").alias("on_attribute"))


# --- sites, edges, resolution -----------------------------------------------------------------------------------------


@query
def call_sites(s: SparkSession, d: str) -> DataFrame:
    return e.call_sites(s, d)


@query
def import_sites(s: SparkSession, d: str) -> DataFrame:
    return e.import_sites(s, d).drop("id")


@query
def contains_edges(s: SparkSession, d: str) -> DataFrame:
    return e.contains(s, d)


@query
def inherits_edges(s: SparkSession, d: str) -> DataFrame:
    return e.inherits(s, d)


@query
def parents_named(s: SparkSession, d: str) -> DataFrame:
    rows = e.classes(s, d).select("id", "repository", F.explode("parents").alias("parent"))
    return rows.groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.count_distinct("repository").alias("repositories"))


@query
def resolve_calls(s: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(e.call_sites(s, d), e.functions(s, d))


@query
def resolve_calls_naive(s: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_naive(e.call_sites(s, d), e.functions(s, d))


@query
def resolve_ladder(s: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_ladder(e.call_sites(s, d), e.functions(s, d), e.import_sites(s, d), e.files(s, d))


@query
def resolve_qualified(s: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_qualified(e.call_sites(s, d), e.functions(s, d), e.classes(s, d))


@query
def resolve_new(s: SparkSession, d: str) -> DataFrame:
    """Resolution of what an earlier run, over the files last updated before July 2025, has left open."""
    sites, defs = e.call_sites(s, d), e.functions(s, d)
    before = e.files(s, d).where("last_updated < TIMESTAMP_NTZ '2025-07-01'").select(F.col("id").alias("caller_file_id"))
    earlier = resolve.resolve(sites.join(before, "caller_file_id", "left_semi"), defs)
    return resolve.resolve_new(sites, defs, earlier)


@query
def calls(s: SparkSession, d: str) -> DataFrame:
    return _calls(s, d)


def _projected(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Call sites and functions as the order tables stand for them: 64 names shared by all functions."""
    nation = read(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("repository"))
    supplier = read(s, d, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("file_id"), "repository")
    n = read(s, d, "supplier").agg(F.count(F.lit(1)).alias("n"))
    part = read(s, d, "part")
    defs = (
        part.join(F.broadcast(n))
        .select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.expr("p_partkey % n").alias("file_id"))
        .join(supplier, "file_id")
    )
    sites = (
        read(s, d, "lineitem")
        .select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("file_id"), "l_linenumber")
        .join(part.select("p_partkey", "p_name"), "p_partkey")
        .select(F.col("file_id"), F.col("p_name").alias("call_name"), F.col("l_linenumber").alias("start_line"))
        .distinct()
        .join(supplier, "file_id")
        .select(F.struct("file_id", "call_name", "start_line").alias("id"), F.col("file_id").alias("caller_file_id"), "call_name", "repository")
    )
    return sites, defs


@query
def resolve_projected(s: SparkSession, d: str) -> DataFrame:
    found = resolve.resolve(*_projected(s, d))
    return found.select(F.col("src.file_id").alias("caller_file_id"), "src.call_name", "src.start_line", "dst", "score")


@query
def dead_projected(s: SparkSession, d: str) -> DataFrame:
    sites, defs = _projected(s, d)
    called = resolve.resolve(sites, defs).select(F.col("dst").alias("callee"))
    return analysis.dead(defs, called, entry_points=False).select("id", "name", "file_id", "repository")


@query
def calls_projected(s: SparkSession, d: str) -> DataFrame:
    sites, defs = _projected(s, d)
    found = resolve.resolve(sites, defs).join(defs.select(F.col("id").alias("dst"), F.col("file_id").alias("dst_file")), "dst")
    return found.select(F.col("src.file_id").alias("src_file"), "dst_file").where("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.count(F.lit(1)).alias("strength"))


# --- reports ----------------------------------------------------------------------------------------------------------


@query
def node_counts(s: SparkSession, d: str) -> DataFrame:
    tables = {"File": e.files(s, d), "Class": e.classes(s, d), "Function": e.functions(s, d), "CallSite": e.call_sites(s, d), "ImportSite": e.import_sites(s, d)}
    return _counted(tables, "label")


@query
def rel_counts(s: SparkSession, d: str) -> DataFrame:
    sites = cut(e.call_sites(s, d))  # read off the texts once
    found = resolve.resolve(sites, e.functions(s, d))
    tables = {"CONTAINS": e.contains(s, d), "RESOLVES_TO": found, "CALLS": resolve.calls(sites, found), "INHERITS_FROM": e.inherits(s, d), "IMPORTS": e.import_sites(s, d)}
    return _counted(tables, "rel_type")


def _counted(tables: dict[str, DataFrame], key: str) -> DataFrame:
    found = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias(key), "n")
        found = one if found is None else found.unionByName(one)
    return found


@query
def repo_stats(s: SparkSession, d: str) -> DataFrame:
    return analysis.counts_by(e.files(s, d), "repository", name="files")


@query
def function_stats(s: SparkSession, d: str) -> DataFrame:
    return analysis.degree_stats(e.functions(s, d), _calls(s, d), "callee")


@query
def class_stats(s: SparkSession, d: str) -> DataFrame:
    return analysis.degree_stats(e.classes(s, d), e.functions(s, d).where("class_id IS NOT NULL"), "class_id")


@query
def call_resolution_stats(s: SparkSession, d: str) -> DataFrame:
    sites = e.call_sites(s, d)
    return analysis.resolution_stats(sites, resolve.resolve(sites, e.functions(s, d)))


@query
def import_resolution_stats(s: SparkSession, d: str) -> DataFrame:
    """An import is resolved when its repository has a file named as the module's last part."""
    stems = e.files(s, d).select("repository", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("module")).distinct()
    imports = e.import_sites(s, d).withColumn("module", F.regexp_extract("module_name", r"([A-Za-z0-9_-]+)(?:\.js|\.ts)?$", 1))
    return analysis.resolution_stats(imports, imports.join(stems, ["repository", "module"], "left_semi").select(F.col("id").alias("src")))


@query
def top_called(s: SparkSession, d: str) -> DataFrame:
    n = _calls(s, d).groupBy(F.col("callee").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    return analysis.top(n.join(e.functions(s, d).select("id", "name"), "id").select("id", "name", "callers"), "callers", "id")


@query
def top_files(s: SparkSession, d: str) -> DataFrame:
    return analysis.top(analysis.counts_by(e.functions(s, d), "file_id", name="functions"), "functions", "file_id")


@query
def most_called_names(s: SparkSession, d: str) -> DataFrame:
    return e.call_sites(s, d).groupBy("call_name").agg(F.count(F.lit(1)).alias("sites"), F.count_distinct("caller_file_id").alias("files"))


@query
def dead_functions(s: SparkSession, d: str) -> DataFrame:
    paths = e.files(s, d).select(F.col("id").alias("file_id"), "path", "language")
    return analysis.dead(e.functions(s, d), _calls(s, d)).join(paths, "file_id", "left").select("id", "name", "file_id", "path", "language")


@query
def dead_functions_filtered(s: SparkSession, d: str) -> DataFrame:
    return analysis.dead(e.functions(s, d), _calls(s, d), exclude=["_.*", "emit.*"]).select("id", "name")


@query
def dead_classes(s: SparkSession, d: str) -> DataFrame:
    return analysis.dead_classes(e.classes(s, d), e.functions(s, d), _calls(s, d), e.inherits(s, d)).select("id", "name")


@query
def dead_samples(s: SparkSession, d: str) -> DataFrame:
    return analysis.samples(analysis.dead(e.functions(s, d), _calls(s, d)))


@query
def language_breakdown(s: SparkSession, d: str) -> DataFrame:
    return analysis.shares(e.files(s, d), "language")


@query
def calls_per_function(s: SparkSession, d: str) -> DataFrame:
    n = e.call_sites(s, d).groupBy(F.col("caller_function_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return e.functions(s, d).select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("calls"))


@query
def param_histogram(s: SparkSession, d: str) -> DataFrame:
    bucket = F.least(F.coalesce(F.array_size("params"), F.lit(0)), F.lit(5)).cast("bigint")
    return e.functions(s, d).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query
def callers_of(s: SparkSession, d: str) -> DataFrame:
    f = e.functions(s, d)
    return (
        _calls(s, d)
        .join(f.select(F.col("id").alias("callee"), F.col("name").alias("callee_name")), "callee")
        .join(f.select(F.col("id").alias("caller"), F.col("name").alias("caller_name"), F.col("file_id").alias("caller_file")), "caller")
        .select("callee", "callee_name", "caller", "caller_name", "caller_file", "score")
    )


@query
def calls_both_ways(s: SparkSession, d: str) -> DataFrame:
    c = _calls(s, d)
    into = c.groupBy(F.col("callee").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    out = c.groupBy(F.col("caller").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    zero = F.lit(0).cast("bigint")
    return e.functions(s, d).select("id").join(into, "id", "left").join(out, "id", "left").select("id", F.coalesce("i", zero).alias("callers"), F.coalesce("o", zero).alias("callees"))


@query
def cross_file_strength(s: SparkSession, d: str) -> DataFrame:
    return analysis.file_calls(_calls(s, d), e.functions(s, d))


@query
def dependants_of_file(s: SparkSession, d: str) -> DataFrame:
    return analysis.file_calls(_calls(s, d), e.functions(s, d)).groupBy(F.col("dst_file").alias("id")).agg(F.count(F.lit(1)).alias("dependants"))


@query
def import_strength(s: SparkSession, d: str) -> DataFrame:
    return e.import_sites(s, d).groupBy("repository", "module_name").agg(F.count_distinct("file_id").alias("files"), F.count(F.lit(1)).alias("imports"))


@query
def package_imports(s: SparkSession, d: str) -> DataFrame:
    return e.import_sites(s, d).groupBy(F.split_part("module_name", F.lit("."), F.lit(1)).alias("package")).agg(F.count_distinct("file_id").alias("files"))


def _tree(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("src"), F.expr("(c_custkey - 1) DIV 2").alias("dst"))


@query
def class_closure(s: SparkSession, d: str) -> DataFrame:
    return graph.closure(_tree(s, d))


@query
def hierarchy_1_3(s: SparkSession, d: str) -> DataFrame:
    return graph.closure(_tree(s, d), most=3)


@query
def containment_closure(s: SparkSession, d: str) -> DataFrame:
    return graph.closure(e.contains(s, d))


@query
def file_delete_cascade(s: SparkSession, d: str) -> DataFrame:
    """What goes when all files of the repositories stale-... are deleted."""
    return graph.contained_in(e.files(s, d).where("repository LIKE 'stale-%'").select("id"), e.contains(s, d))


@query
def class_methods(s: SparkSession, d: str) -> DataFrame:
    m = (
        e.functions(s, d)
        .where("class_id IS NOT NULL")
        .groupBy(F.col("class_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", F.col("id")))), lambda x: x["name"]), ",").alias("names"))
    )
    return e.classes(s, d).select("id", "name").join(m, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("methods"), "names")


@query
def definitions(s: SparkSession, d: str) -> DataFrame:
    paths = e.files(s, d).select(F.col("id").alias("file_id"), "path")
    c = e.classes(s, d).select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    return e.functions(s, d).join(paths, "file_id").join(c, "class_id", "left").select("name", "id", "path", "start_line", "end_line", "class_name")


@query
def usages(s: SparkSession, d: str) -> DataFrame:
    paths = e.files(s, d).select(F.col("id").alias("caller_file_id"), "path")
    defined = e.functions(s, d).select(F.col("name").alias("call_name")).distinct()
    return e.call_sites(s, d).join(defined, "call_name", "left_semi").join(paths, "caller_file_id").select("call_name", "caller_function_id", "path", "start_line")


@query
def inheritance_relations(s: SparkSession, d: str) -> DataFrame:
    """Both directions of every inheritance; relationship_type is the role of the class asked about."""
    c = e.classes(s, d).select("id", "name")
    edges = e.inherits(s, d).join(c.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src").join(c.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    up = edges.select(F.col("src").alias("id"), F.col("dst_name").alias("related"), F.lit("child").alias("relationship_type"))
    return up.unionByName(edges.select(F.col("dst").alias("id"), F.col("src_name").alias("related"), F.lit("parent").alias("relationship_type")))


@query
def general_lookup(s: SparkSession, d: str) -> DataFrame:
    f = e.functions(s, d).select(F.lit("Function").alias("label"), "name", "id")
    wanted = f.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    return f.unionByName(e.classes(s, d).select(F.lit("Class").alias("label"), "name", "id")).join(wanted, "name", "left_semi").select("label", "name", "id")


# --- writing ----------------------------------------------------------------------------------------------------------


@query
def upsert_files(s: SparkSession, d: str) -> DataFrame:
    """The older half of the file states upserted with all states."""
    rows = read(s, d, "source_files").select("id", "commit", "last_updated")
    old = latest(rows.where("last_updated < TIMESTAMP_NTZ '2025-01-01'"), ["id"], "last_updated")
    return graph.upsert(old, rows, "id", "last_updated").select("id", "commit", "last_updated")


@query
def upsert_edges(s: SparkSession, d: str) -> DataFrame:
    new = _calls(s, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("CALLS").alias("rel_type"))
    f = e.functions(s, d).select("id")
    return graph.upsert_edges(new.limit(0), new, f, f)


@query
def clear_repository(s: SparkSession, d: str) -> DataFrame:
    return analysis.counts_by(graph.delete_where(e.files(s, d), F.col("repository") == "atlas-mono"), "repository")


@query
def delete_vectors(s: SparkSession, d: str) -> DataFrame:
    tree = {"operator": "and", "conditions": [{"operator": "==", "field": "language", "value": "python"}, {"operator": "range", "field": "start_line", "value": {"gt": 20}}]}
    return graph.delete_where(read(s, d, "chunk_vectors"), vectors.condition(tree)).agg(F.count(F.lit(1)).alias("n"))


# --- vectors and search -----------------------------------------------------------------------------------------------


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(s: SparkSession, d: str, rest: int = 0) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20 (or that follows one)."""
    return _vectors(s, d).where(F.col("id") % 20 == rest).select(F.col("id").alias("query_id"), "vector")


def _top(s: SparkSession, d: str, metric: str) -> DataFrame:
    return vectors.top_k(_asked(s, d), _vectors(s, d), 10, metric).select("query_id", "id", "score")


@query
def vector_topk_cosine(s: SparkSession, d: str) -> DataFrame:
    return _top(s, d, "cosine")


@query
def vector_topk_ip(s: SparkSession, d: str) -> DataFrame:
    return _top(s, d, "ip")


@query
def vector_topk_l2(s: SparkSession, d: str) -> DataFrame:
    return _top(s, d, "l2")


@query
def vector_filtered(s: SparkSession, d: str) -> DataFrame:
    tree = {
        "operator": "and",
        "conditions": [
            {"operator": "in", "field": "label", "value": [1, 2, 3]},
            {"operator": "or", "conditions": [{"operator": "range", "field": "id", "value": {"gte": 50}}, {"operator": "==", "field": "label", "value": 2}]},
        ],
    }
    return vectors.top_k(_asked(s, d), vectors.where(_vectors(s, d), tree), 10).select("query_id", "id", "score")


@query
def vector_threshold(s: SparkSession, d: str) -> DataFrame:
    return _top(s, d, "cosine").where("score >= 0.2")


@query
def vector_counts(s: SparkSession, d: str) -> DataFrame:
    return analysis.counts_by(read(s, d, "chunk_vectors").select("id", "language", "entity_type").distinct(), "language", "entity_type")


@query
def vector_filter_counts(s: SparkSession, d: str) -> DataFrame:
    eq = lambda f, v: {"operator": "==", "field": f, "value": v}
    filters = {
        "eq": {"language": "python"},
        "ne": {"operator": "!=", "field": "language", "value": "python"},
        "in": {"language": ["java", "typescript"]},
        "range": {"operator": "range", "field": "start_line", "value": {"gte": 10, "lt": 40}},
        "and_or": {"operator": "and", "conditions": [eq("entity_type", "function"), {"operator": "or", "conditions": [eq("language", "python"), eq("language", "java")]}, {"operator": "range", "field": "end_line", "value": {"gt": 30}}]},
        "none": {"operator": "in", "field": "language", "value": []},
    }
    rows = read(s, d, "chunk_vectors")
    tests = {n: c if (c := vectors.condition(f)) is not None else F.lit(True) for n, f in filters.items()}
    once = rows.agg(*[F.count_if(c).alias(n) for n, c in tests.items()])
    return once.select(F.explode(F.array(*[F.struct(F.lit(n).alias("test"), F.col(n).alias("n")) for n in filters])).alias("r")).select("r.*")


def _meta(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    kind = F.when(F.col("label") % 4 == 0, "Function").when(F.col("label") % 4 == 1, "Class").when(F.col("label") % 4 == 2, "Method").otherwise("Module")
    return _vectors(s, d).select(
        "id",
        F.concat(F.lit("src/f"), (i % 50).cast("string"), F.lit(".py")).alias("file_path"),
        kind.alias("entity_type"),
        F.concat(F.lit("e"), i.cast("string")).alias("entity_id"),
        (i * 10).alias("start_line"),
        (i * 10 + i % 7).alias("end_line"),
    )


def _merged(s: SparkSession, d: str) -> DataFrame:
    """Hits of every query, and half as many of one expansion of it."""
    more = vectors.top_k(_asked(s, d, 1), _vectors(s, d), 5)
    expanded = more.select((F.col("query_id") - 1).alias("query_id"), "id", "score", F.lit(1).alias("expansion"))
    return search.merged(_top(s, d, "cosine"), expanded)


def _reranked(s: SparkSession, d: str) -> DataFrame:
    return search.rerank(_merged(s, d).join(_meta(s, d), "id"))


def _fused(s: SparkSession, d: str) -> DataFrame:
    near = _asked(s, d).select("query_id", F.explode(F.array(F.col("query_id"), F.col("query_id") + 1)).alias("id"))
    g = near.join(_meta(s, d), "id").withColumn("search_type", F.when(F.col("id") % 2 == 0, "definition").otherwise("usage")).drop("id")
    return search.fused(_reranked(s, d), g)


@query
def merge_expanded(s: SparkSession, d: str) -> DataFrame:
    return _merged(s, d).select("query_id", "id", "score", "expanded")


@query
def rerank(s: SparkSession, d: str) -> DataFrame:
    return _reranked(s, d).select("query_id", "id", "score", "expanded")


@query
def fuse_results(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d)


@query
def rank_results(s: SparkSession, d: str) -> DataFrame:
    return search.ranked(_fused(s, d)).select("query_id", "file_path", "start_line", "end_line", "rank_score", "source")


@query
def select_snippets(s: SparkSession, d: str) -> DataFrame:
    content = _meta(s, d).select("entity_id", F.concat(F.lit("code of "), F.col("entity_id")).alias("content"))
    return search.snippets(search.ranked(_fused(s, d)), content).select("query_id", "entity_id", "rank_score", F.col("pos").cast("bigint").alias("pos"))


@query
def result_type_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts per entity type, search type and source in one pass."""
    rows = search.ranked(_fused(s, d))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("entity_type", "search_type", "source")]))
    return analysis.counts_by(rows.select(pairs.alias("p")).select("p.*").where("value <> ''"), "dimension", "value")


@query
def answers(s: SparkSession, d: str) -> DataFrame:
    return search.answers(search.ranked(_fused(s, d)))


@query
def intent_flags(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "documents").select("doc_id", search.intents(F.col("text")).alias("i"))
    return rows.select("doc_id", F.array_join("i", ",").alias("intents"), search.flags(F.col("i")).alias("f")).select("doc_id", "intents", "f.requires_code_execution", "f.requires_structural_search")


@query
def language_mentions(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.array_join(search.languages(F.col("text")), ",").alias("languages"))


@query
def query_expansion(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.md5(F.array_join(search.expansions(F.col("text")), "|")).alias("hash"))


@query
def entity_words(s: SparkSession, d: str) -> DataFrame:
    names = search.names_in(F.col("text"))
    return read(s, d, "documents").select("doc_id", F.coalesce(F.array_size(names), F.lit(0)).cast("bigint").alias("n"), F.try_element_at(names, F.lit(1)).alias("first"))


# --- events and feeds -------------------------------------------------------------------------------------------------


def _events(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select("event_id", "ts", F.col("user_id").alias("source"), "user_id", "event_type", "value", ev.kind_of(F.col("event_type")).alias("kind"), F.get_json_object("props", "$.k").cast("bigint").alias("count"))


def _shown(rows: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return rows


@query
def event_stats(s: SparkSession, d: str) -> DataFrame:
    return _shown(ev.statistics(_events(s, d)), "first_ts", "last_ts")


@query
def event_rates(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).groupBy("kind", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query
def stage_durations(s: SparkSession, d: str) -> DataFrame:
    return ev.stage_durations(_events(s, d), "STAGE_STARTED", "RELATIONSHIP_CREATED").select("event_id", "source", "seconds")


@query
def event_tumbling(s: SparkSession, d: str) -> DataFrame:
    return _shown(ev.windowed(_events(s, d), "6 hours"), "window_start")


@query
def event_sliding(s: SparkSession, d: str) -> DataFrame:
    return _shown(ev.windowed(_events(s, d), "6 hours", "3 hours"), "window_start")


@query
def event_sessions(s: SparkSession, d: str) -> DataFrame:
    return _shown(ev.sessions(_events(s, d), "2 hours"), "session_start")


def _feed(s: SparkSession, d: str, table: str) -> DataFrame:
    """A table as a stream: the files of its folder, or the one file that it is."""
    path = s._jvm.org.apache.hadoop.fs.Path(f"{d}/{table}.parquet")
    folder = path.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    schema = read(s, d, table).schema
    return ingest.feed(s, f"{d}/{table}.parquet", schema) if folder else ingest.feed(s, d, schema, f"{table}.parquet")


@query
def event_stream_tumbling(s: SparkSession, d: str) -> DataFrame:
    """The tumbling windows of a stream over the events, drained."""
    rows = _feed(s, d, "events").select("ts", "event_type", "value")
    return _shown(ev.drained(s, ev.windowed(rows, "6 hours"), "event-windows"), "window_start")


@query
def recent_files(s: SparkSession, d: str) -> DataFrame:
    return ingest.recent(e.files(s, d)).select("id", "path")


@query
def stream_files(s: SparkSession, d: str) -> DataFrame:
    """The index that a feed of file states leaves, by upserts per micro-batch."""
    import uuid

    from codeloom.tables import ensure_checkpoint_dir

    folder = f"{ensure_checkpoint_dir(s)}/index-{uuid.uuid4().hex}"
    index = ingest.Index(s, folder)
    index.run(_feed(s, d, "source_files").select("id", "commit", "last_updated"))
    return index.read().select("id", "commit")


@query
def graph_report(s: SparkSession, d: str) -> DataFrame:
    return CodeIndex(s, d).report()


@query
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    """Every document whose id is divisible by 20 as a query against all chunks and all definitions."""
    asked = read(s, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return CodeIndex(s, d).search(asked, 5).select("query_id", "file_path", "start_line", "end_line", "entity_id", "source", "rank_score")


@query
def id_rules(s: SparkSession, d: str) -> DataFrame:
    """Files whose id follows from repository and path, and those whose doesn't."""
    right = F.col("id") == ids.file_id(F.col("repository"), F.col("path"))
    return e.files(s, d).groupBy(right.alias("right")).agg(F.count(F.lit(1)).alias("n"))


from codeloom import lookups  # noqa: E402, F401  registers more queries
