"""Registered queries of lookups over names, filters from questions, answers by kind, chunk dispatch and feeds of states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import catalogue as c
from codeloom.catalogue import query
from codeloom.functions import text
from codeloom.operators import analysis, chunking, graph, search
from codeloom.sources import entities as e
from codeloom.sources import imports
from codeloom.streaming import events as ev
from codeloom.streaming import ingest
from codeloom.tables import latest, read


def _named(s: SparkSession, d: str) -> DataFrame:
    return imports.imported_names(c._sources(s, d))


@query
def import_names(s: SparkSession, d: str) -> DataFrame:
    return _named(s, d)


@query
def files_importing(s: SparkSession, d: str) -> DataFrame:
    """Files that import a package, with their paths."""
    package = F.split_part("module_name", F.lit("."), F.lit(1))
    rows = _named(s, d).where("level = 0").select("file_id", package.alias("package")).where("package <> ''").distinct()
    return rows.join(e.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id").select("package", "file_id", "path")


@query
def declarations(s: SparkSession, d: str) -> DataFrame:
    return imports.declared(c._sources(s, d))


@query
def declaration_counts(s: SparkSession, d: str) -> DataFrame:
    return analysis.counts_by(imports.declared(c._sources(s, d)), "kind")


@query
def instantiations(s: SparkSession, d: str) -> DataFrame:
    """Where classes are made, and whether the repository defines a class of the name."""
    known = e.classes(s, d).join(e.files(s, d).select(F.col("id").alias("file_id"), F.col("repository").alias("repo")), "file_id").select(F.col("repo").alias("repository"), F.col("name").alias("class_name"), F.lit(True).alias("known")).distinct()
    rows = imports.made(c._sources(s, d)).join(e.files(s, d).select(F.col("id").alias("file_id"), "repository"), "file_id")
    return rows.join(known, ["repository", "class_name"], "left").select("file_id", "class_name", "start_line", F.coalesce("known", F.lit(False)).alias("known"))


@query
def class_definitions(s: SparkSession, d: str) -> DataFrame:
    """Classes with their place and, where there are any, the parents they name and the least class of that name."""
    rows = e.classes(s, d).join(e.files(s, d).select(F.col("id").alias("file_id"), "path"), "file_id")
    least = e.classes(s, d).groupBy(F.col("name").alias("parent")).agg(F.min("id").alias("parent_id"))
    asked = rows.select("id", "name", "path", "start_line", F.explode_outer("parents").alias("parent"))
    return asked.join(least, "parent", "left").select("id", "name", "path", "start_line", "parent", "parent_id")


def _projected_classes(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as classes, each a child of the one with half its number."""
    n = read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    up = n.select((F.col("id")).alias("parent_id"), F.col("name").alias("parent"))
    return n.withColumn("parent_id", F.expr("id DIV 2")).join(up, "parent_id").where("id > 0").select("id", "name", F.array("parent").alias("parents")).unionByName(n.where("id = 0").select("id", "name", F.array().cast("array<string>").alias("parents")))


@query
def inherits_projected(s: SparkSession, d: str) -> DataFrame:
    return e.inherits_of(_projected_classes(s, d))


@query
def inheritance_projected(s: SparkSession, d: str) -> DataFrame:
    """Both directions of every inheritance; relationship_type is the role of the class asked about."""
    edges = e.inherits_of(_projected_classes(s, d))
    up = edges.select(F.col("src").alias("id"), F.col("dst").alias("related"), F.lit("child").alias("relationship_type"))
    return up.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("related"), F.lit("parent").alias("relationship_type")))


@query
def inheritance_paths(s: SparkSession, d: str) -> DataFrame:
    """Every class with each of its ancestors up to three steps away and the way there."""
    edges = e.inherits_of(_projected_classes(s, d))
    return graph.paths(edges, 3).select("src", "dst", "length", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query
def general_words(s: SparkSession, d: str) -> DataFrame:
    """Entities that the words of a question name: how many of each label, and the least id."""
    nodes = e.functions(s, d).select(F.lit("Function").alias("label"), "name", "id").unionByName(e.classes(s, d).select(F.lit("Class").alias("label"), "name", "id"))
    once = nodes.groupBy("label", "name").agg(F.count(F.lit(1)).alias("nodes"), F.min("id").alias("id"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Za-z][A-Za-z0-9_]{2,}"), F.lit(0)))
    asked = read(s, d, "documents").where("doc_id % 20 = 0").select("doc_id", F.explode(words).alias("name"))
    return asked.join(once, "name").select("doc_id", "label", "name", "nodes", "id")


@query
def name_links(s: SparkSession, d: str) -> DataFrame:
    """Files and the functions of every repository that they call by name: one row per file and name, with the class of its targets."""
    targets = e.functions(s, d).groupBy(F.col("name").alias("call_name")).agg(F.count(F.lit(1)).alias("functions"), F.min("id").alias("first"))
    return e.call_sites(s, d).select(F.col("caller_file_id").alias("file_id"), "call_name").distinct().join(targets, "call_name").select("file_id", "call_name", "functions", "first")


@query
def resolve_imports(s: SparkSession, d: str) -> DataFrame:
    """Imported names by their qualified name, repository + module's last part + name; unresolved ones stay with a null."""
    at = e.files(s, d).select(F.col("id").alias("file_id"), "repository", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("stem"))
    fqn = lambda module, name: F.concat_ws(".", module, name)
    defs = e.functions(s, d).select("id", "name", "file_id").join(at, "file_id").groupBy("repository", fqn(F.col("stem"), F.col("name")).alias("fqn")).agg(F.min("id").alias("dst"))
    asked = _named(s, d).where("import_name IS NOT NULL").join(at.select("file_id", "repository"), "file_id")
    asked = asked.withColumn("fqn", fqn(F.regexp_extract("module_name", r"([A-Za-z0-9_-]+)(?:\.js|\.ts)?$", 1), F.col("import_name")))
    return asked.select("file_id", "repository", "fqn").distinct().join(defs, ["repository", "fqn"], "left").select("file_id", "fqn", "dst")


# --- questions --------------------------------------------------------------------------------------------------------


def _questions(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", "text")


@query
def query_entities(s: SparkSession, d: str) -> DataFrame:
    """Names in a question by the kind that it asks about."""
    rows = _questions(s, d).select("doc_id", search.entities_in(F.col("text")).alias("x"))
    return rows.select("doc_id", "x.kind", F.array_join("x.names", ",").alias("names"))


@query
def query_filters(s: SparkSession, d: str) -> DataFrame:
    f = search.filters_from(F.col("text"))
    return _questions(s, d).select("doc_id", F.array_join(f["language"], ",").alias("languages"), F.array_join(f["entity_type"], ",").alias("entity_types"))


@query
def answers_by_kind(s: SparkSession, d: str) -> DataFrame:
    """Answers to the ranked hits of every vector query; the five kinds take turns over the queries."""
    kinds = F.array(*[F.lit(k) for k in ("definition", "usage", "inheritance", "explanation", "information")])
    hits = search.ranked(c._fused(s, d))
    asked = c._asked(s, d).select("query_id", F.array(F.get(kinds, ((F.col("query_id") / 20) % 5).cast("int"))).alias("intents"))
    return search.answers_by_kind(asked, hits)


# --- chunks -----------------------------------------------------------------------------------------------------------


@query
def chunk_files(s: SparkSession, d: str) -> DataFrame:
    """Class and function chunks of each file in order; windows for files without either."""
    return chunking.file_chunks(c._sources(s, d)).select("file_id", F.col("pos").cast("bigint").alias("pos"), "kind", "start_line", "end_line")


@query
def chunk_dispatch(s: SparkSession, d: str) -> DataFrame:
    """Chunks of each file by what is known of it: its entities and the text before them, else windows."""
    return chunking.dispatched(c._sources(s, d), c._entities(s, d)).select("file_id", "kind", "start_line", "end_line")


@query
def metadata_rows(s: SparkSession, d: str) -> DataFrame:
    """The metadata of each vector as it is stored: all mandatory fields, optional ones where they hold something, extras."""
    return read(s, d, "chunk_vectors").select("id", "indexed_at", F.md5(chunking.metadata_text()).alias("hash")).distinct()


# --- reports and states -----------------------------------------------------------------------------------------------


@query
def extension_breakdown(s: SparkSession, d: str) -> DataFrame:
    """The five most frequent extensions and their shares."""
    rows = e.files(s, d).select(text.extension(F.col("path")).alias("extension"))
    return analysis.top(analysis.shares(rows, "extension"), "n", "extension", 5)


@query
def repositories_like(s: SparkSession, d: str) -> DataFrame:
    return analysis.counts_by(e.files(s, d).where(F.col("repository").contains("mono") | F.col("repository").contains("stale")), "repository")


@query
def class_methods_calling(s: SparkSession, d: str) -> DataFrame:
    """Of each class and name that its methods call: how many of them do."""
    methods = e.functions(s, d).where("class_id IS NOT NULL").select(F.col("id").alias("caller_function_id"), "class_id")
    return e.call_sites(s, d).join(methods, "caller_function_id").groupBy("class_id", "call_name").agg(F.count_distinct("caller_function_id").alias("methods"))


@query
def classes_named_like(s: SparkSession, d: str) -> DataFrame:
    """Methods of the classes whose name holds a word, in any case."""
    some = e.classes(s, d).where(F.lower("name").contains("base") | F.lower("name").contains("er")).select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    return e.functions(s, d).join(some, "class_id").select("class_name", "name", "id", "start_line", "end_line")


@query
def dead_with_parent(s: SparkSession, d: str) -> DataFrame:
    """Functions that nothing calls and whose name shows no privacy, with what contains them: class first, else file."""
    dead = analysis.dead(e.functions(s, d), c._calls(s, d), exclude=["_.*"], entry_points=False)
    within = e.classes(s, d).select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    paths = e.files(s, d).select(F.col("id").alias("file_id"), "path")
    label = F.when(F.col("class_name").isNotNull(), "Class").when(F.col("path").isNotNull(), "File")
    return dead.join(within, "class_id", "left").join(paths, "file_id", "left").select("id", "name", label.alias("parent_type"), F.coalesce("class_name", "path").alias("parent"))


@query
def class_rows(s: SparkSession, d: str) -> DataFrame:
    """Classes beside each of their methods and each of the parents they name, as a drawing of them needs it."""
    methods = e.functions(s, d).where("class_id IS NOT NULL").select(F.col("class_id").alias("id"), F.col("name").alias("method"))
    return e.classes(s, d).select("id", "name", F.explode_outer("parents").alias("parent")).join(methods, "id", "left").select("id", "name", "parent", "method")


@query
def entities_in_order(s: SparkSession, d: str) -> DataFrame:
    """The entities of each file by their first line, each with its position."""
    from pyspark.sql import Window

    order = Window.partitionBy("file_id").orderBy("start_line", "end_line", "id")
    return c._entities(s, d).where("start_line > 0").select("id", "file_id", "start_line", F.row_number().over(order).cast("bigint").alias("position"))


@query
def failed_files(s: SparkSession, d: str) -> DataFrame:
    """The ten first of the files that a parser left an error on, by path; the count is that of all."""
    rows = read(s, d, "ast_data").where("error IS NOT NULL").select("file_id", "file_path", "error").distinct()
    n = rows.agg(F.count(F.lit(1)).alias("failed"))
    return rows.orderBy("file_path", "file_id", "error").limit(10).join(n).select("file_id", "file_path", "failed")


@query
def placeholder_content(s: SparkSession, d: str) -> DataFrame:
    """Hits with the text of their chunk in the place of a template: every vector's entity with the length of its code."""
    text_of = e.chunks(s, d).select("chunk_id", F.length("content").cast("bigint").alias("length"), "content_type")
    return read(s, d, "chunk_vectors").select("id", "chunk_id").distinct().join(text_of, "chunk_id", "left").select("id", "chunk_id", "length", "content_type")


@query
def event_data(s: SparkSession, d: str) -> DataFrame:
    """Events as their constructors write them: kind, message and the fields that hold something, as a map."""
    rows = ev.made(read(s, d, "events"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("data")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return rows.select("event_id", "kind", "message", shown.alias("data"))


@query
def commit_history(s: SparkSession, d: str) -> DataFrame:
    """Commits of each repository in the order in which they were first seen."""
    from pyspark.sql import Window

    seen = read(s, d, "source_files").groupBy("repository_url", "commit").agg(F.min("last_updated").alias("first_seen"), F.count_distinct("id").alias("files"))
    order = Window.partitionBy("repository_url").orderBy("first_seen", "commit")
    return seen.select("repository_url", "commit", "files", F.row_number().over(order).cast("bigint").alias("position"), F.lag("commit").over(order).alias("before"))


@query
def incremental_states(s: SparkSession, d: str) -> DataFrame:
    """States of the index after the older files and then the others were applied, batch by batch, as a full run gives them."""
    rows = read(s, d, "source_files").select("id", "commit", "last_updated")
    old = rows.where("last_updated < TIMESTAMP_NTZ '2025-01-01'")
    state = latest(old, ["id"], "last_updated")
    for batch in (rows.where("last_updated >= TIMESTAMP_NTZ '2025-01-01'"), old):  # late rows change nothing
        state = ingest.apply_batch(state, batch)
    return state.select("id", "commit")


@query
def changed_since_commit(s: SparkSession, d: str) -> DataFrame:
    """What a repository's next commit adds to its first one: files new (A) or with another state (M)."""
    rows = read(s, d, "source_files").select("id", "repository_url", "commit", "last_updated").distinct()
    first = rows.groupBy(F.col("repository_url").alias("url")).agg(F.min_by("commit", F.struct("last_updated", "commit")).alias("base"))
    marked = rows.join(first, F.col("repository_url").eqNullSafe(F.col("url"))).withColumn("old", F.col("commit").eqNullSafe(F.col("base")))
    return (
        marked.groupBy("id")
        .agg(F.max("old").alias("known"), F.max(~F.col("old")).alias("later"))
        .where("later")
        .select("id", F.when(F.col("known"), "M").otherwise("A").alias("change_type"))
    )


@query
def vector_near(s: SparkSession, d: str) -> DataFrame:
    """Hits that are near enough, with a bar that the scores lie on both sides of."""
    return c._top(s, d, "cosine").where("score >= 0.9")


@query
def upsert_known_edges(s: SparkSession, d: str) -> DataFrame:
    """Call edges upserted onto those of the callers with an even last digit; an edge's type is set where it has none."""
    new = c._calls(s, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit(None).cast("string").alias("rel_type"))
    old = new.where(F.substring("src", -1, 1).isin("0", "2", "4", "6", "8")).withColumn("rel_type", F.lit("CALLS"))
    f = e.functions(s, d).select("id")
    return graph.upsert_edges(old, new, f, f)
