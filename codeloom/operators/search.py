"""Query understanding, rerank, fusion, ranking and answers, as expressions over whole tables of queries and hits.

(Q1-Q6, V2-V4, W3, W4, C1-C4, A11, A12, G1, U3, L4, L7, P32)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases that show an intent, in the order in which intents are listed.
INTENTS = {
    "definition": ["find definition", "where is defined", "definition of", "how is implemented"],
    "usage": ["how is used", "where is used", "usage of", "references to"],
    "explanation": ["explain", "how does", "what does", "why does"],
    "generation": ["implement", "create", "write code", "generate"],
    "execution": ["run", "execute", "performance", "time complexity"],
    "inheritance": ["inherits", "extends", "parent class", "child class", "subclass"],
}
# How a language is mentioned.
MENTIONS = {
    "python": ["python", "py", ".py"],
    "javascript": ["javascript", "js", ".js", "node"],
    "typescript": ["typescript", "ts", ".ts"],
    "java": ["java", ".java"],
    "go": ["golang", "go", ".go"],
    "ruby": ["ruby", "rb", ".rb"],
    "rust": ["rust", "rs", ".rs"],
    "c++": ["c++", "cpp", ".cpp"],
    "c#": ["c#", "csharp", ".cs"],
}
# Words that are put in another way when a query is widened.
VARIANTS = {"how": "what is the way", "where": "in which location", "find": "locate"}
GENERIC = ("code that ", "implementation of ", "function for ")


def _listed(table: dict[str, list[str]], low: Column) -> Column:
    def any_of(words: list[str]) -> Column:
        test = low.contains(words[0])
        for w in words[1:]:
            test = test | low.contains(w)
        return test

    return F.array_compact(F.array(*[F.when(any_of(words), F.lit(name)) for name, words in table.items()]))


def intents(query: Column) -> Column:
    """Intents of a query in fixed order; [information] where there is none. Null gives null."""
    found = _listed(INTENTS, F.lower(query))
    return F.when(query.isNull(), None).when(F.size(found) > 0, found).otherwise(F.array(F.lit("information")))


def languages(query: Column) -> Column:
    """Languages that a query mentions."""
    return F.when(query.isNotNull(), _listed(MENTIONS, F.lower(query)))


def expansions(query: Column, n: int = 3) -> Column:
    """Up to n other wordings of a query: replaced words first, then generic ones."""
    low = F.lower(query)
    swapped = F.array_compact(F.array(*[F.when(low.contains(a), F.replace(low, F.lit(a), F.lit(b))) for a, b in VARIANTS.items()]))
    generic = F.array(*[F.concat(F.lit(g), query) for g in GENERIC])
    return F.when(query.isNotNull(), F.slice(F.when(F.size(swapped) < n, F.concat(swapped, generic)).otherwise(swapped), 1, n))


def names_in(query: Column) -> Column:
    """Words of a query that look like identifiers: letters of both cases, or an underscore; each once, in order."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(query, "[().]", " "), r"\s+", " ")), " ")
    looks = F.filter(words, lambda w: (w.rlike("[A-Z]") & w.rlike("[a-z]")) | w.contains("_"))
    return F.array_distinct(looks)


# Kinds of entities that a definition can be of.
DEFINED = ("function", "class", "method", "module")


def entities_in(query: Column) -> Column:
    """struct(kind, names): the names in a query, by what its words ask for.

    functions where it speaks of a function or method and has brackets, classes where it speaks of a class; null where
    it speaks of neither.
    """
    said = F.split(F.trim(F.regexp_replace(F.lower(query), r"\s+", " ")), " ")
    has = lambda w: F.array_contains(said, w)
    about = has("function") | has("method")
    kind = F.when(about, F.when(query.contains("(") | query.contains(")"), "functions")).when(has("class"), "classes")
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), names_in(query)).alias("names"))


def filters_from(query: Column) -> Column:
    """struct(language, entity_type): lists that a query's words narrow the search to, empty where they don't."""
    none = F.array().cast("array<string>")
    wanted = F.when(F.array_contains(intents(query), "definition"), F.array(*map(F.lit, DEFINED))).otherwise(none)
    return F.struct(F.coalesce(languages(query), none).alias("language"), F.coalesce(wanted, none).alias("entity_type"))


def flags(found: Column) -> Column:
    """struct(requires_code_execution, requires_structural_search, kind of graph search) from a list of intents."""
    has = lambda name: F.array_contains(found, name)
    kind = F.when(has("definition"), "definition").when(has("usage"), "usage").when(has("inheritance"), "inheritance").when(has("imports"), "imports").otherwise("general")
    return F.struct(
        has("execution").alias("requires_code_execution"),
        (has("definition") | has("usage") | has("inheritance")).alias("requires_structural_search"),
        kind.alias("graph_search"),
    )


def rerank(hits: DataFrame) -> DataFrame:
    """hits (query_id, id, score, entity_type, start_line, end_line, expanded) with reranked scores, at most 1.

    x 1.05 for functions and classes, x 0.95 for spans under 3 lines (missing lines are a span of 0), x 0.98 for hits of
    an expansion; in this order.
    """
    span = F.coalesce(F.col("end_line") - F.col("start_line"), F.lit(0))
    score = (
        F.col("score")
        * F.when(F.lower("entity_type").isin("function", "class"), 1.05).otherwise(1.0)
        * F.when(span < 3, 0.95).otherwise(1.0)
        * F.when(F.col("expanded"), 0.98).otherwise(1.0)
    )
    return hits.withColumn("score", F.round(F.least(score, F.lit(1.0)), 12))


def merged(primary: DataFrame, expanded: DataFrame) -> DataFrame:
    """Both lists with each id once per query: the primary hit wins, then the first expansion (column expansion)."""
    both = primary.withColumn("expanded", F.lit(False)).withColumn("expansion", F.lit(0)).unionByName(expanded.withColumn("expanded", F.lit(True)))
    first = Window.partitionBy("query_id", "id").orderBy("expanded", "expansion", F.desc("score"))
    return both.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "expansion")


def fused(vector: DataFrame, graph: DataFrame) -> DataFrame:
    """Hits of both searches by (query_id, file_path, start_line, end_line); source both, vector or graph.

    Of a field that both have, the vector search's value counts unless it is empty.
    """
    key = ["query_id", "file_path", "start_line", "end_line"]
    v = vector.select(*key, F.col("score").alias("score"), F.col("entity_id").alias("ve"), F.col("entity_type").alias("vt"), F.lit(True).alias("v"))
    g = graph.select(*key, F.col("search_type"), F.col("entity_id").alias("ge"), F.col("entity_type").alias("gt"), F.lit(True).alias("g"))
    fill = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    return v.join(g, key, "full").select(
        *key,
        "score",
        "search_type",
        fill("ve", "ge").alias("entity_id"),
        fill("vt", "gt").alias("entity_type"),
        F.when(F.col("v") & F.col("g"), "both").when(F.col("v"), "vector").otherwise("graph").alias("source"),
    )


def ranked(hits: DataFrame) -> DataFrame:
    """fused() hits with rank_score: vector score (else 0.7 from the graph), x 1.2 both, x 1.1 function, class or method,
    x 1.1 definition, at most 1."""
    score = (
        F.coalesce("score", F.when(F.col("source") == "graph", 0.7).otherwise(0.0))
        * F.when(F.col("source") == "both", 1.2).otherwise(1.0)
        * F.when(F.lower("entity_type").isin("function", "class", "method"), 1.1).otherwise(1.0)
        * F.when(F.col("search_type") == "definition", 1.1).otherwise(1.0)
    )
    return hits.withColumn("rank_score", F.round(F.least(score, F.lit(1.0)), 12))


def snippets(hits: DataFrame, content: DataFrame, n: int = 3) -> DataFrame:
    """The n best distinct entities per query that have a text. content: entity_id, content."""
    with_text = hits.where("entity_id IS NOT NULL").join(content.select("entity_id", "content"), "entity_id").where("content <> ''")
    once = Window.partitionBy("query_id", "entity_id").orderBy(F.desc("rank_score"), "file_path", "start_line", "end_line")
    first = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "entity_id")
    return (
        with_text.withColumn("_r", F.row_number().over(once))
        .where("_r = 1")
        .withColumn("pos", F.row_number().over(first))
        .where(F.col("pos") <= n)
        .drop("_r")
    )


def answers(hits: DataFrame) -> DataFrame:
    """(query_id, answer): one sentence per query from its ranked hits."""
    return (
        hits.groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("file_path").alias("files"),
            F.max_by("entity_id", F.struct("rank_score", "entity_id")).alias("best"),
        )
        .select(
            "query_id",
            F.concat(
                F.lit("Found "), F.col("n").cast("string"), F.lit(" results in "), F.col("files").cast("string"), F.lit(" files; best is `"), F.coalesce("best", F.lit("")), F.lit("`")
            ).alias("answer"),
        )
    )


def answers_by_kind(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, kind, results, entities, files, answer) of each question, also of those without hits.

    asked: query_id, intents. hits: ranked() rows. The kind is the first intent of definition, usage, inheritance and
    explanation, else general. Definitions, usages and inheritances speak of the graph's hits of that kind where there
    are any, else of all. entities counts the types of the five best hits spoken of, most frequent first.
    """
    first = F.try_element_at("intents", F.lit(1))
    kind = F.when(first.isin("definition", "usage", "inheritance", "explanation"), first).otherwise("general")
    rows = asked.select("query_id", kind.alias("kind")).join(hits, "query_id", "left")
    fits = F.coalesce(F.col("search_type") == F.col("kind"), F.lit(False))
    some = rows.groupBy("query_id").agg(F.max(fits).alias("some"))
    spoken = rows.join(some, "query_id").where(~F.col("some") | fits | ~F.col("kind").isin("definition", "usage", "inheritance"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "file_path", "start_line", "end_line", "entity_id")
    best = spoken.withColumn("r", F.row_number().over(order))
    kinds = (
        best.where("r <= 5 AND entity_type <> ''")
        .groupBy("query_id", F.lower("entity_type").alias("t"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "t"))).alias("l"))
        .select("query_id", F.array_join(F.transform("l", lambda x: F.concat((-x["m"]).cast("string"), F.lit(" "), x["t"])), ", ").alias("entities"))
    )
    facts = best.groupBy("query_id", "kind").agg(
        F.count("rank_score").alias("results"), F.count_distinct("file_path").alias("files"), F.max(F.when(F.col("r") == 1, F.col("entity_id"))).alias("best")
    )
    name, results, files = F.concat(F.lit("`"), F.coalesce("best", F.lit("")), F.lit("`")), F.col("results").cast("string"), F.col("files").cast("string")
    listed = F.coalesce("entities", F.lit("no typed entities"))
    told = (
        F.when(F.col("results") == 0, F.lit("Nothing in the index answers this."))
        .when(F.col("kind") == "definition", F.concat(name, F.lit(" is defined in one of "), files, F.lit(" files: "), listed, F.lit(".")))
        .when(F.col("kind") == "usage", F.concat(name, F.lit(" is used "), results, F.lit(" times in "), files, F.lit(" files: "), listed, F.lit(".")))
        .when(F.col("kind") == "inheritance", F.concat(name, F.lit(" has "), results, F.lit(" relatives in "), files, F.lit(" files: "), listed, F.lit(".")))
        .when(F.col("kind") == "explanation", F.concat(F.lit("Read "), name, F.lit(" first, then the other "), (F.col("results") - 1).cast("string"), F.lit(" of "), listed, F.lit(".")))
        .otherwise(F.concat(results, F.lit(" results in "), files, F.lit(" files: "), listed, F.lit(".")))
    )
    return facts.join(kinds, "query_id", "left").select("query_id", "kind", "results", F.coalesce("entities", F.lit("")).alias("entities"), "files", told.alias("answer"))
