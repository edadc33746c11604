"""The engine as a user meets it: views for SQL, hybrid search, canned searches, the graph report (O1, O2, S10, GQ20, D14, D16).

    index = CodeIndex(spark, folder)
    index.sql("SELECT name, count(*) FROM function GROUP BY name")
    index.search(queries, k=10).show()
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import analysis, chunking, embed, resolve, search, vectors
from codeloom.sources import entities as e
from codeloom.sources import imports
from codeloom.tables import current_files, cut


class CodeIndex:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str, embedder: str = "hashing", dim: int = 64):
        self.spark, self.folder, self.embedder, self.dim = spark, folder, embedder, dim

    def tables(self, once: bool = False) -> dict[str, DataFrame]:
        """Nodes and edges by name; only what a query uses is computed. once: call sites and what they mean are written
        and read again, for plans that use them several times."""
        s, d = self.spark, self.folder
        sites, functions = e.call_sites(s, d), e.functions(s, d)
        sites = cut(sites) if once else sites
        found = resolve.resolve(sites, functions)
        found = cut(found) if once else found
        return {
            "file": e.files(s, d), "class": e.classes(s, d), "function": functions, "call_site": sites, "import_site": e.import_sites(s, d), "import": imports.imported_names(current_files(s, d)), "chunk": e.chunks(s, d),
            "contains": e.contains(s, d), "inherits_from": e.inherits(s, d), "resolves_to": found, "calls": resolve.calls(sites, found),
        }

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the views of tables()."""
        for name, rows in self.tables().items():
            rows.createOrReplaceTempView(name)
        return self.spark.sql(text)

    def chunk_vectors(self) -> DataFrame:
        rows = e.chunks(self.spark, self.folder)
        shown = chunking.for_embedding(F.col("content"), F.col("language"), F.col("file_path"), F.col("content_type"))
        return rows.withColumn("vector", embed.embedded(shown, self.embedder, self.dim))

    def search(self, queries: DataFrame, k: int = 10, kind: str = "hybrid", filters: Mapping | None = None) -> DataFrame:
        """Ranked hits of a table of queries (query_id bigint, text); kind is hybrid, vector or graph.

        The graph side finds functions and classes whose names the text mentions. Null and empty texts have no hits
        from the graph; null texts have none at all.
        """
        if kind not in ("hybrid", "vector", "graph"):
            raise ValueError(f"unknown search: {kind}")
        asked = queries.where("text IS NOT NULL").select("query_id", "text")
        near, named = self._near(asked, k, filters), self._named(asked)
        if kind == "vector":
            named = named.limit(0)
        if kind == "graph":
            near = near.limit(0)
        return search.ranked(search.fused(near, named))

    def _near(self, asked: DataFrame, k: int, filters: Mapping | None) -> DataFrame:
        chunks = vectors.where(self.chunk_vectors(), filters)
        q = asked.select("query_id", embed.embedded(F.col("text"), self.embedder, self.dim).alias("vector"))
        # ids are text here: both sides travel as text and the query's id is turned back
        hits = vectors.top_k(q, chunks.select(F.col("chunk_id").alias("id"), "vector"), k, "cosine", "string")
        about = chunks.select(F.col("chunk_id").alias("id"), "file_path", "start_line", "end_line", "entity_id", "entity_type")
        found = hits.join(about, "id").withColumn("query_id", F.col("query_id").cast("bigint")).withColumn("expanded", F.lit(False))
        return search.rerank(found)

    def _named(self, asked: DataFrame) -> DataFrame:
        s, d = self.spark, self.folder
        words = asked.select("query_id", F.explode(search.names_in(F.col("text"))).alias("name")).distinct()
        paths = e.files(s, d).select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
        cols = ["id", "name", "file_id", "start_line", "end_line"]
        things = e.functions(s, d).select(*cols).withColumn("entity_type", F.lit("Function")).unionByName(e.classes(s, d).select(*cols).withColumn("entity_type", F.lit("Class")))
        return words.join(things, "name").join(paths, "file_id").select(
            "query_id", "file_path", "start_line", "end_line", F.col("id").alias("entity_id"), "entity_type", F.lit("definition").alias("search_type")
        )

    def search_by_file(self, queries: DataFrame, path: str, **options) -> DataFrame:
        return self.search(queries, filters={"file_path": path}, **options)

    def search_by_function(self, names: DataFrame, **options) -> DataFrame:
        """names: query_id, name."""
        return self.search(names.select("query_id", F.concat(F.lit("definition of function "), F.col("name")).alias("text")), **options)

    def search_by_class(self, names: DataFrame, **options) -> DataFrame:
        return self.search(names.select("query_id", F.concat(F.lit("definition of class "), F.col("name")).alias("text")), **options)

    def explain(self, names: DataFrame, **options) -> DataFrame:
        """(query_id, answer) for a table of names."""
        texts = names.select("query_id", F.concat(F.lit("explain how does "), F.col("name"), F.lit(" work")).alias("text"))
        return search.answers(self.search(texts, **options))

    def report(self) -> DataFrame:
        """(section, key, value): counts of nodes and edges, degrees, resolution, dead code, languages."""
        t = self.tables(once=True)
        total = lambda rows, section, key: rows.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(section).alias("section"), F.lit(key).alias("key"), "value")
        parts = [total(t[n], "nodes", n) for n in ("file", "class", "function", "call_site", "import_site")]
        parts += [total(t[n], "edges", n) for n in ("contains", "inherits_from", "resolves_to", "calls")]
        parts.append(total(analysis.dead(t["function"], t["calls"]), "dead", "functions"))
        parts.append(total(analysis.dead_classes(t["class"], t["function"], t["calls"], t["inherits_from"]), "dead", "classes"))
        for section, rows in (
            ("resolution", analysis.resolution_stats(t["call_site"], t["resolves_to"])),
            ("callers", analysis.degree_stats(t["function"], t["calls"], "callee")),
            ("methods", analysis.degree_stats(t["class"], t["function"].where("class_id IS NOT NULL"), "class_id")),
        ):
            pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in rows.columns])
            parts.append(rows.select(F.lit(section).alias("section"), F.explode(pairs).alias("p")).select("section", "p.*"))
        languages = analysis.counts_by(t["file"], "language").select(F.lit("languages").alias("section"), F.coalesce("language", F.lit("none")).alias("key"), F.col("n").cast("double").alias("value"))
        found = parts[0]
        for p in [*parts[1:], languages]:
            found = found.unionByName(p)
        return found
