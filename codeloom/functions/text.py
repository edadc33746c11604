"""Column expressions over paths, addresses and source text (inventory rows P1-P5, P16-P22, F1, F2, F15).

All of them stay inside the JVM. Null in gives null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language, for each of the places that decide it.
PARSER = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java"}
CHUNKER = PARSER | {
    ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rb": "ruby", ".php": "php",
    ".swift": "swift", ".kt": "kotlin", ".rs": "rust",
}
CHUNK_TOOL = CHUNKER | {".pyc": "python", ".pyw": "python", ".ipynb": "python", ".cc": "cpp"}
EXTRACTOR = PARSER | {
    ".go": "go", ".rb": "ruby", ".php": "php", ".cs": "c_sharp", ".cpp": "cpp", ".cc": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".rs": "rust",
}
# What is not indexed, and extensions of binary files.
IGNORED_EXTENSIONS = ".jpg .jpeg .png .gif .svg .ico .pdf .zip .tar .gz .tgz .rar .jar .war .mp3 .mp4 .avi .mov .wmv .flv .mkv".split()
IGNORED_FOLDERS = ".git __pycache__ node_modules venv env .venv .env dist build target bin obj .idea .vscode".split()
BINARY_EXTENSIONS = """.pyc .pyo .so .dll .obj .exe .bin .jpg .jpeg .png .gif .bmp .ico .pdf .doc .docx .xls .xlsx .ppt .pptx .zip .tar .gz
.tgz .jar .war .ear .class .o""".split()
# Comment marks by extension; other extensions have Python's.
HASH_COMMENTS = (".py", ".rb", ".pl", ".sh", ".bash")
SLASH_COMMENTS = (".java", ".js", ".jsx", ".ts", ".tsx", ".c", ".cpp", ".h", ".hpp", ".cs", ".php", ".go", ".swift", ".kt", ".rs")
MAX_BYTES = 1024 * 1024


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; '' where there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language_of(path: Column, table: dict[str, str] = PARSER, default: str | None = None) -> Column:
    """Language by extension under one of the tables; `default` for others."""
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(names, extension(path))
    return found if default is None else F.when(path.isNotNull(), F.coalesce(found, F.lit(default)))


def language_of_text(text: Column) -> Column:
    """Language guessed from content, first rule that fits; unknown where none does."""
    has = text.contains
    return (
        F.when(text.isNull(), None)
        .when(F.regexp_like(text, F.lit(r"^\s*<\?php")), "php")
        .when(has("function") & has("{") & has("}") & has(";"), "javascript")
        .when(has("def ") & has(":") & has("import "), "python")
        .when(has("class ") & has("{") & has("public") & has(";"), "java")
        .when(has("package ") & has("import") & has("func "), "go")
        .otherwise("unknown")
    )


def indexable(path: Column, size: Column) -> Column:
    """Whether a file is indexed: no ignored extension or folder, at most 1 MB (null sizes count as 0)."""
    folders = F.array(*[F.lit(x) for x in IGNORED_FOLDERS])
    return ~extension(path).isin(IGNORED_EXTENSIONS) & ~F.arrays_overlap(F.split(path, "/"), folders) & (F.coalesce(size, F.lit(0)) <= MAX_BYTES)


def normalised_url(url: Column) -> Column:
    """Address without closing slashes and without .git."""
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", "")


def repository_name(url: Column) -> Column:
    """Last part of an address, other signs than letters, digits, - and _ as _."""
    return F.regexp_replace(F.regexp_extract(normalised_url(url), r"([^/]*)$", 1), "[^A-Za-z0-9_-]", "_")


def binary_like(path: Column, text: Column) -> Column:
    """Extension of a binary file, or a sign other than plain text within the first 1,024."""
    return extension(path).isin(BINARY_EXTENSIONS) | F.coalesce(F.regexp_like(F.substring(text, 1, 1024), F.lit(r"[^\x07-\x0a\x0c\x0d\x1b\x20-\x7e]")), F.lit(False))


def lines(text: Column) -> Column:
    """Lines of a text, CRLF and CR as LF; [''] for an empty text."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def line_tokens(line: Column) -> Column:
    """Token estimate of a line: words and the signs ( ) . , ; — at least 1."""
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(line, F.lit(r"\S+"), 0)) + F.length(F.regexp_replace(line, "[^().,;]", "")))


def text_tokens(text: Column) -> Column:
    """Sum of line_tokens over the lines of a text, as bigint."""
    return F.aggregate(lines(text), F.lit(0).cast("bigint"), lambda total, line: total + line_tokens(line))


def loc(path: Column, text: Column) -> Column:
    """struct(code, comment, blank, total): lines of a text by kind, with a state for block comments.

    A closing empty line is no line. Null text: null.
    """
    ext = extension(path)
    slash = ext.isin(*SLASH_COMMENTS)
    mark = F.when(slash, "//").otherwise("#")
    opening = F.when(slash, "/*").when(ext == ".rb", "=begin").otherwise('"""')
    closing = F.when(slash, "*/").when(ext == ".rb", "=end").otherwise('"""')
    rows = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\n\z", ""), "\n")
    # each line once as a number of flags: 1 blank, 2 begins with a mark, 4 has an opening, 8 has a closing
    flag = lambda c, n: F.when(c, n).otherwise(0)
    trimmed = F.transform(rows, lambda raw: F.regexp_replace(raw, r"^\s+|\s+$", ""))
    flags = F.transform(trimmed, lambda x: flag(x == "", 1) + flag(x.startswith(mark), 2) + flag(x.contains(opening), 4) + flag(x.contains(closing), 8))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("comment"), zero.alias("blank"), F.lit(False).alias("inside"))

    def step(s: Column, f: Column) -> Column:
        blank, marked, ends = f.bitwiseAND(1) > 0, f.bitwiseAND(2) > 0, f.bitwiseAND(8) > 0
        opens = ~s["inside"] & ~marked & (f.bitwiseAND(4) > 0)
        comment = ~blank & (s["inside"] | marked | opens)
        inside = F.when(blank, s["inside"]).when(s["inside"] | opens, ~ends).otherwise(False)
        one = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
        return F.struct((s["comment"] + one(comment)).alias("comment"), (s["blank"] + one(blank)).alias("blank"), inside.alias("inside"))

    def shaped(s: Column) -> Column:
        total = F.size(rows).cast("bigint")
        return F.struct((total - s["comment"] - s["blank"]).alias("code"), s["comment"].alias("comment"), s["blank"].alias("blank"), total.alias("total"))

    counted = F.aggregate(flags, start, step, shaped)
    empty = F.struct(*[zero.alias(n) for n in ("code", "comment", "blank", "total")])
    return F.when(text == "", empty).when(text.isNotNull(), counted)


def cast_filter_value(text: str):
    """A filter value given as text: true/false, digits, one dot between digits, else the text."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.isdigit():
        return int(text)
    if text.replace(".", "", 1).isdigit():
        return float(text)
    return text
