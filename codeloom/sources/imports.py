"""Imported names and declarations read off whole texts, in the four languages.

One expression per statement form runs over the whole text, so a statement may go over lines, be indented or carry a
comment; everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text

# Statement forms; group numbers are those of their parts.
PY_FROM = r"(?m)^[ \t]*from[ \t]+[.\w]+[ \t]+import[ \t]+(?:\([^)]*\)|[^\n#;(]+)"
PY_PLAIN = r"(?m)^[ \t]*import[ \t]+[A-Za-z_][^\n#;'\"]*"
JS_FROM = r"(?m)^[ \t]*(?:import|export)\b[^;'\"()=]*?\bfrom[ \t]*['\"][^'\"\n]+['\"]"
JS_BARE = r"(?m)^[ \t]*import[ \t]*['\"]([^'\"\n]+)['\"]"
JS_REQUIRE = r"\brequire\([ \t]*['\"]([^'\"\n]+)['\"][ \t]*\)"
JAVA = r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;"
#: A declaration's line by language and kind, with its name.
DECLARED = {
    "python": {"class": r"^\s*class\s+(\w+)", "function": r"^\s*(?:async\s+)?def\s+(\w+)\s*[\[(]"},
    "script": {
        "class": r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(\w+)",
        "interface": r"^\s*(?:export\s+)?(?:declare\s+)?interface\s+(\w+)",
        "enum": r"^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(\w+)",
        "function": r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*[<(]",
        "arrow": r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^={]+)?=>|\w+\s*=>)",
        "method": r"^\s+(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(\w+)\s*\([^;]*\)\s*(?::[^={;]+)?\{\s*$",
    },
    "java": {
        "class": r"^\s*(?:(?:public|protected|private|static|final|abstract|sealed|strictfp)\s+)*(?:class|record)\s+(\w+)",
        "interface": r"^\s*(?:(?:public|protected|private|static|abstract|sealed)\s+)*@?interface\s+(\w+)",
        "enum": r"^\s*(?:(?:public|protected|private|static)\s+)*enum\s+(\w+)",
        "method": r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)+(?:<[^<>]*>\s+)?[\w<>\[\],.?]+(?:\s*,\s*[\w<>\[\],.?]+)*\s+(\w+)\s*\(",
        "constructor": r"^\s*(?:public|protected|private)\s+(\w+)\s*\(",
    },
}
# Words before a bracket that begin a statement and no method.
STATEMENTS = "if for while switch catch return function with else do try new super constructor".split()
#: A class made: new X(...), also with type arguments.
MADE = r"\bnew\s+([A-Za-z_][\w.]*)\s*(?:<[^<>()]*>)?\s*\("


def _all(pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all("content", F.lit(pattern), F.lit(group))


def _blank(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def family(path: Column) -> Column:
    ext = text.extension(path)
    return F.when(ext == ".py", "python").when(ext.isin(".js", ".ts", ".jsx", ".tsx"), "script").when(ext == ".java", "java")


def imported_names(files: DataFrame) -> DataFrame:
    """(file_id, module_name, import_name, alias, level): one row per name that a file imports, each once."""
    return import_statements(files).select("file_id", "module_name", "import_name", "alias", "level").distinct()


def import_statements(files: DataFrame) -> DataFrame:
    """(file_id, module_name, import_name, alias, level, target, start_line): one row per name of each import statement.

    target is the module that the statement asks for, in Java the whole dotted name. A statement that a text has several
    times counts where it is first.

    import_name is null where a module is imported for its effects or as a whole; level counts the dots before a module.
    files: file_id, path, content; null texts have none.
    """
    src = files.where("content IS NOT NULL").select("file_id", family(F.col("path")).alias("family"), "content")
    python, script, java = (src.where(F.col("family") == n) for n in ("python", "script", "java"))
    named = lambda c: F.regexp_extract(c, r"^(.*?)\s+as\s+", 1)
    alias = _none(F.regexp_extract("item", r"\s+as\s+(\S+)$", 1))
    name = F.coalesce(_none(named("item")), F.col("item"))
    items = lambda c: F.explode(F.transform(F.split(F.regexp_replace(c, r"#[^\n]*|[(){}]", " "), ","), lambda x: _blank(F.regexp_replace(x, r"\s+", " "))))

    # the line on which a statement's own text, blanks before it aside, first stands
    line = (F.length(F.regexp_replace(F.expr("substring(content, 1, locate(s, content) + length(s) - length(ltrim(s)) - 1)"), "[^\n]", "")) + 1).alias("start_line")
    frm = python.select("file_id", "content", F.explode(_all(PY_FROM)).alias("s")).select(
        "file_id", line, F.regexp_extract("s", r"from[ \t]+([.\w]+)", 1).alias("module"), items(F.regexp_extract("s", r"[ \t]import[ \t]+([\s\S]*)$", 1)).alias("item")
    )
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    rows = frm.where("item <> ''").select("file_id", "start_line", F.regexp_replace("module", r"^\.+", "").alias("module_name"), name.alias("import_name"), alias.alias("alias"), dots.alias("level"))
    plain = python.select("file_id", "content", F.explode(_all(PY_PLAIN)).alias("s")).select("file_id", line, items(F.regexp_extract("s", r"import[ \t]+([\s\S]*)$", 1)).alias("item"))
    zero, null = F.lit(0), F.lit(None).cast("string")
    rows = rows.unionByName(plain.where("item <> ''").select("file_id", "start_line", name.alias("module_name"), null.alias("import_name"), alias.alias("alias"), zero.alias("level")))
    clause = script.select("file_id", "content", F.explode(_all(JS_FROM)).alias("s")).select(
        "file_id", line, F.regexp_extract("s", r"['\"]([^'\"]+)['\"]$", 1).alias("module_name"),
        items(F.regexp_replace(F.regexp_extract("s", r"^\s*(?:import|export)\b\s*(?:type\b)?([\s\S]*?)\bfrom[ \t]*['\"]", 1), r"\*\s+as\s+", "* as ")).alias("item"),
    )
    rows = rows.unionByName(clause.where("item <> ''").select("file_id", "start_line", "module_name", name.alias("import_name"), alias.alias("alias"), zero.alias("level")))
    bare = script.select("file_id", "content", F.explode(F.concat(_all(JS_BARE), _all(JS_REQUIRE))).alias("s")).select("file_id", line, F.regexp_extract("s", r"['\"]([^'\"\n]+)['\"]", 1).alias("module_name"))
    rows = rows.unionByName(bare.select("file_id", "start_line", "module_name", null.alias("import_name"), null.alias("alias"), zero.alias("level")))
    rows = rows.withColumn("target", F.col("module_name"))
    whole = java.select("file_id", "content", F.explode(_all(JAVA)).alias("s")).select("file_id", line, F.regexp_extract("s", JAVA, 1).alias("item"))
    rows = rows.unionByName(
        whole.select("file_id", "start_line", F.col("item").alias("target"), F.regexp_replace("item", r"\.?[^.]*$", "").alias("module_name"), F.regexp_extract("item", r"([^.]*)$", 1).alias("import_name"), null.alias("alias"), zero.alias("level"))
    )
    return rows.distinct()


def declared(files: DataFrame) -> DataFrame:
    """(file_id, kind, name, start_line): classes, interfaces, enums, functions, methods and constructors by their lines."""
    src = files.where("content IS NOT NULL").select("file_id", family(F.col("path")).alias("family"), F.posexplode(text.lines(F.col("content"))).alias("at", "line")).where("family IS NOT NULL")
    found = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.when(F.col("family") == language, F.regexp_extract("line", pattern, 1)).alias("name"))
        for language, kinds in DECLARED.items() for kind, pattern in kinds.items()
    ])
    rows = src.select("file_id", "family", (F.col("at") + 1).alias("start_line"), F.explode(found).alias("d")).select("file_id", "start_line", "d.kind", "d.name")
    return rows.where((F.col("name") != "") & ~F.col("name").isin(STATEMENTS)).select("file_id", "kind", "name", "start_line")


def made(files: DataFrame) -> DataFrame:
    """(file_id, class_name, start_line): every place where a class is made with new."""
    src = files.where("content IS NOT NULL").select("file_id", F.posexplode(text.lines(F.col("content"))).alias("at", "line"))
    return src.select("file_id", F.explode(F.regexp_extract_all("line", F.lit(MADE), F.lit(1))).alias("class_name"), (F.col("at") + 1).alias("start_line"))
