"""Problem 1: source files that nobody on the project wrote by hand.

In this order:

1. An inverted index of line hashes over all files tells of each line in how many repositories it stands and which files
   may be its origin (the least file, and the least file known to be foreign, of the first and of the last repository
   that has it). The owners that a file's lines point to are its candidate origins, however many there are. A file that they do
   not settle is met with every file that has one of its rarest lines, so many of them that an origin must have one.
2. Of each file and candidate origin of another repository the containment is counted exactly, over the full line sets of
   both. A file nearly all of whose lines stand in one file, and in several repositories, is a copy of it; so is an
   edited one half of whose lines stand in files known to be foreign, most of them in a single one.
3. A file is known to be foreign where the library that it names in a comment, or the package folder that it lies in, is
   met in several repositories and announced in one at least; a licence, a folder or a name by itself is no verdict.
   Copies found by their lines are known from then on, too.
4. What remains is judged by the make-up of its tokens (minified code, data laid down as code, compiler output) and by
   generators' notices at the head of comment lines.

Null and empty texts are hand-written; so are files of other languages. Rows with a null file id are left out; a null
repository is one of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.tables import cut, extension

EXTENSIONS = (".py", ".js", ".ts", ".java")
#: A line counts in the index from this length on (blanks at its ends aside).
LINE = 24
#: Shares of a file's indexed lines that must stand in foreign files, of these in a single one, and the least number; a file
#: of fewer lines must stand whole in one, with WHOLE lines at least.
COPIED, MAIN, LEAST, WHOLE = 0.5, 0.4, 6, 3
#: Share of lines that must stand in one file and in WIDE_REPOS repositories for a copy of unmarked origin, and share and
#: least number for an edited copy of such a copy (idioms count here, so both are higher than those of named libraries).
WIDE, WIDE_REPOS, NEAR, NEAR_LEAST = 0.8, 5, 0.6, 10
#: A file is a candidate origin from this share of the lines on that point to it, and a line is evidence of foreign origin
#: where this share of the repositories that have it have it in a foreign file.
POINTED, FOREIGN_SHARE = 0.1, 0.2
#: Rows of the index for one line, so that a line that every file has is no single key.
SALTS = 4

PY_PARTS = re.compile(r"(?P<s>[rbfuRBFU]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))|(?P<c>#[^\n]*)")
C_PARTS = re.compile(r"(?P<s>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`)|(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))")

# How generators announce their output at the head of a comment line, in the languages met.
NOTICE = re.compile(
    r"""(?imx) ^[^\w@<\n]* (?:
      @generated\b | <auto-?generated | (?:this\s+(?:file|code|class|module|source)\s+(?:is|was|has\s+been)\s+)?(?:auto-?generated|automatically\s+(?:generated|created|produced|built|written)|machine[\- ](?:made|generated|written|produced))\b(?!\s+(?:method|stub))
    | (?:this\s+)?(?:\w+\s+)?(?:code|file|source|class|module|client|bindings?|this)\s+(?:was\s+|is\s+|has\s+been\s+)?(?:automatically\s+|auto-?)?(?:generated|produced|created|written|emitted)\s+(?:by|from|with|using|on)\b | generated\s+(?:by|from|with|on)\s+\S+
    | (?:produced|created|written|emitted)\s+by\s+(?:a\s+|the\s+)?(?:tool|generator|compiler|program|script)\b | output\s+of\s+(?:the\s+)?[\w\-]+\s+(?:compiler|generator|tool|step)
    | built\s+from\s+\S+\.\w+\s+(?:by|with)\b | end\s+of\s+generated\b | autogenerated\b(?!\s+(?:method|stub))
    | (?:\W*|[^\n]*(?:generated|produced|created|compiled|built)\b[^\n]*[.,;:\-]\s*)(?:please\s+)?do\s+not\s+(?:edit|modify|change|hand[\- ]edit)\b(?=\s*(?:$|[.!*/#\-]|by\s+hand|this|manually|directly|it))
    | (?:manual\s+|your\s+|any\s+|all\s+|hand\s+)?(?:changes?|edits?|modifications?)\s+(?:made\s+)?(?:to\s+this\s+file\s+|here\s+|by\s+hand\s+)?(?:are|will\s+be|get)\s+(?:lost|overwritten|discarded)
    | [^\n]*(?:g[ée]n[ée]r[ée]e?\s+(?:par|automatiquement) | ne\s+pas\s+(?:modifier|[ée]diter) | automatisch\s+(?:erzeugt|generiert|erstellt) | nicht\s+(?:von\s+hand|manuell)\s+(?:(?:ae|ä)ndern|bearbeiten)
      | generado\s+(?:por|autom) | no\s+(?:editar|modificar)\b | gerado\s+(?:por|autom) | сгенерирован | 自動生成 | 自动生成)
    )"""
)
#: What every notice has in it, found faster.
NOTICED = re.compile(
    r"(?i)g[eé]n[eé]r|gerado|сгенер|自動|自动|not\s+(?:edit|modify|change|hand)|automat|machine|produced|created|written|emitted|output\s+of|built\s+from|overwritten|discarded|lost|pas\s+(?:modifier|[eé]diter)|no\s+(?:editar|modificar)|von\s+hand|manuell"
)
# How files of a foreign library name it.
ANNOUNCED = re.compile(
    r"""(?imx)
      \(c\)\s+(?:\d{4}[\d,\- ]*\s+)?the\s+(?P<a>[\w.\-]+)\s+(?:authors|contributors|project|developers) | \bpart\s+of\s+the\s+(?P<b>[\w.\-]+)\s+(?:library|package|framework|toolkit)\b
    | \b(?:copied|vendored|taken|imported|backported|ported|adapted)\s+from\s+(?P<c>[\w.\-/@]+)\s+v?\d+(?:\.\d+)+ | ^\W*part\s+of\s+(?P<d>[\w.\-]+)\s+v?\d+(?:\.\d+)+\W*$
    | ^/\*!\s*(?P<e>[\w.\-@/]+)\s+v?\d+\.\d+ | ^\W*upstream:\s*(?:https?://)?(?:github\.com/)?(?P<f>[\w\-]+)
    """
)
# Folders that package managers and projects keep foreign code in; group a or b is what lies there.
FILED = re.compile(
    r"(?i)(?:^|/)(?:vendor|vendored|_vendor|_vendored|third[_-]?party|node_modules|bower_components|jspm_packages|site-packages|dist-packages|deps|external|externals|contrib|ext|pods|carthage|godeps)/(?P<a>@?[^/]+)|(?:^|/)(?P<b>[a-z][\w.]*-v?\d+\.\d+(?:\.\d+)*)/"
)
TOOL_CODE = re.compile(
    r"""(?mx)
      ^_(?:tabversion|lr_method|lr_action_items|lr_productions|lr_goto_items)\b | \bObject\.defineProperty\(exports,\s*""\s*, | ^var\s+__\w+\s*=\s*\(this\s*&&\s*this\.__\w+\)
    | \bDESCRIPTOR\s*=\s*[\w.]+\( | \b_serialized_(?:start|end)\b
    """
)
#: Words of which TOOL_CODE has one.
TOOL_WORDS = ("_tabversion", "_lr_", "defineProperty", "__", "DESCRIPTOR", "_serialized_")
MAPPED = re.compile(r"^//# sourceMappingURL=\S+\s*$", re.M)
ACCESSOR = re.compile(r"\bbitField\d+_\b")
DTO = re.compile(r"^export interface \w+ \{\n(?:  \w+\??: \w+;\n)+\}", re.M)
CLIENT = re.compile(r"^export (?:async )?function \w+\(\w+\) \{ return \{.*\}; \}$", re.M)
TOKEN = re.compile(r"[A-Za-z_$][\w$]*|-?\.?\d[\w.]*|\"\"")
ESCAPE = re.compile(r"\\x[0-9a-fA-F]{2}|\\[0-3][0-7]{2}|\\u[0-9a-fA-F]{4}")


def taken_apart(ext: str, text: str) -> tuple[str, str, int, int]:
    """Code with its strings blanked, comments, characters in strings, escapes in strings."""
    comments: list[str] = []
    inside = escapes = 0

    def part(m: re.Match) -> str:
        nonlocal inside, escapes
        s = m["s"]
        if s is None:
            comments.append(m["c"])
            return " "
        inside += len(s)
        if "\\" in s and len(s) > 40:
            escapes += len(ESCAPE.findall(s))
        return '""'

    code = (PY_PARTS if ext == ".py" else C_PARTS).sub(part, text)
    return code, "\n".join(comments), inside, escapes


def libraries(path: str, comments: str) -> tuple[list[str], list[str]]:
    """Names of the libraries that a file says in its comments to be of, and that it is filed under."""
    said = {next(filter(None, m.groups())).strip("./-@").lower() for m in ANNOUNCED.finditer(comments)}
    filed = {re.split(r"[.@]|[-_]v?\d", next(filter(None, m.groups())).lstrip("@"))[0].lower() for m in FILED.finditer(path)}
    return sorted(said - {""}), sorted(filed - {""})


def verdict(ext: str, text: str, apart: tuple[str, str, int, int] | None = None) -> str | None:
    """generated, minified, data, or None where the make-up and the notices of a file show no sign."""
    text = text.replace("\r\n", "\n")
    code, comments, inside, escapes = apart or taken_apart(ext, text)
    if NOTICED.search(comments) and NOTICE.search(comments):
        return "generated"
    if any(x in code for x in TOOL_WORDS) and TOOL_CODE.search(code) or ext == ".java" and "@Generated(" in code or "bitField" in code and len(ACCESSOR.findall(code)) >= 6 or escapes >= 100:
        return "generated"
    if "sourceMappingURL" in text and MAPPED.search(text) and "exports" in code:
        return "generated"
    lines = code.split("\n")
    long = [x for x in lines if len(x) >= 250]
    if long and sum(map(len, long)) >= 0.5 * len(code.strip()):
        joined = "".join(long)
        tokens = TOKEN.findall(joined)
        literals = sum(t[0] in '"-.0123456789' for t in tokens)
        if literals < 0.7 * len(tokens) and joined.count(" ") < 0.14 * len(joined):
            return "minified"
    tokens = TOKEN.findall(code)
    if len(tokens) >= 80:
        literals = sum(t[0] in '"-.0123456789' for t in tokens)
        if literals >= 0.82 * len(tokens):
            return "data"
    if inside >= 1_000 and inside >= 0.85 * len(text) and literals_only(code):
        return "data"
    dto = DTO.findall(text) if "export interface" in text else []
    if len(dto) >= 4 and sum(map(len, dto)) >= 0.8 * len(text.strip()):
        return "generated"
    clients = CLIENT.findall(text) if "export " in text else []
    if len(clients) >= 3 and sum(map(len, clients)) >= 0.8 * len(text.strip()):
        return "generated"
    return None


def literals_only(code: str) -> bool:
    return len(re.findall(r"[A-Za-z_$][\w$]*", code)) <= 12


def line_hashes(text: str) -> list[int]:
    """Signed 64-bit hashes of the distinct indexed lines of a text."""
    found = {x for line in text.split("\n") if len(x := line.strip()) >= LINE}
    return [h - (1 << 64) if (h := xxhash.xxh64_intdigest(x.encode("utf-8", "replace"))) >= 1 << 63 else h for x in found]


def judged(files: DataFrame) -> DataFrame:
    """Files of the languages met that have a text: the text gives way to what each shows by itself, with the hashes of its lines."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch, rows = batch[[bool(text) for text in batch["content"]]], []
            for path, text in zip(batch["path"], batch["content"]):
                ext = re.search(r"(\.[^./]+)?$", path)[0].lower()
                apart = taken_apart(ext, text.replace("\r\n", "\n"))
                rows.append((verdict(ext, text, apart), *libraries(path, apart[1]), line_hashes(text)))
            yield pd.concat([batch.drop(columns="content").reset_index(drop=True), pd.DataFrame(rows, columns=["kind", "said", "filed", "lines"])], axis=1)

    kept = ", ".join(f"`{c}` {kind}" for c, kind in files.dtypes if c != "content")
    return files.where(extension(F.col("path")).isin(*EXTENSIONS)).mapInPandas(judge, f"{kept}, kind string, said array<string>, filed array<string>, lines array<bigint>")


def known_foreign(one: DataFrame) -> DataFrame:
    """(f): files of libraries that several repositories have and one at least announces."""
    named = one.where("size(said) + size(filed) > 0").select(
        "f", "repo", F.explode(F.array_union("said", "filed")).alias("name"), F.expr("cardinality(said) > 0").alias("announces")
    )
    met = (
        named.groupBy("name", "repo").agg(F.max("announces").alias("announces")).groupBy("name").agg(F.count(F.lit(1)).alias("repos"), F.max("announces").alias("announces"))
    ).where("repos > 1 AND announces").select("name")
    return named.join(met, "name", "left_semi").select("f").distinct()


def sent(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts what is no longer than this checkpointed table, if that has been counted and is small."""
    return F.broadcast if df.count() * 64 < 16 << 20 else lambda x: x


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id, kind), one row per file that nobody on the project wrote; kind copied: found through its lines."""
    return told_apart(judged(files.where("file_id IS NOT NULL").select("file_id", "repository", "path", "content")).dropDuplicates(["file_id"]))


def told_apart(files: DataFrame) -> DataFrame:
    """The same of judged files, one row each. Line sets are what is large: they stay where they are, and only those in question travel."""
    raw = cut(files.where("file_id IS NOT NULL").select("file_id", F.xxhash64("file_id").alias("f"), F.xxhash64("repository").alias("repo"), "kind", "said", "filed", "lines"))
    marked = cut(known_foreign(raw))
    # a file that no library names is not known to be foreign, so it need not meet those that are
    no_name = F.size("said") + F.size("filed") == 0
    named = raw.where(~no_name).join(marked.withColumn("foreign", F.lit(True)), "f", "left").withColumn("foreign", F.coalesce("foreign", F.lit(False)))
    one = raw.where(no_name).withColumn("foreign", F.lit(False)).unionByName(named).select("file_id", "f", "repo", "kind", "foreign", "lines")
    lines = one.where(F.size("lines") > 0).select("f", "repo", "foreign", F.explode("lines").alias("h"))
    # of each line: in how many repositories it is, in how many of them in a foreign file, and its owners: the least file
    # (and the least foreign file) of the first and of the last of those repositories, so that every file finds one outside its own
    # (lines are brought together by their hash at once, which serves both groupings with one shuffle)
    index = (
        lines.repartition("h")
        .groupBy("h", "repo")
        .agg(F.min(F.when(F.col("foreign"), F.col("f"))).alias("owner"), F.min("f").alias("any"))
        .groupBy("h")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("owner").alias("nf"),
            *[
                agg(F.when(F.col(c).isNotNull(), F.struct("repo", F.col(c).alias("file")))).alias(f"{c}_{name}")
                for c in ("owner", "any")
                for name, agg in (("first", F.min), ("last", F.max))
            ],
        )
        .where((F.col("n") >= WIDE_REPOS) | (F.col("nf") >= FOREIGN_SHARE * F.col("n")) & (F.col("n") > 1))
    )

    def elsewhere(c: str):
        return F.when(F.col(f"{c}_first.repo") != F.col("repo"), F.col(f"{c}_first.file")).otherwise(
            F.when(F.col(f"{c}_last.repo") != F.col("repo"), F.col(f"{c}_last.file"))
        )

    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = lines.where("NOT foreign").select("f", "repo", "h", F.pmod("f", F.lit(SALTS)).cast("int").alias("salt"))
    by_foreign, wide = F.col("nf") >= FOREIGN_SHARE * F.col("n"), F.col("n") >= WIDE_REPOS
    met = asked.join(salted, ["h", "salt"]).select(
        "f",
        F.explode(
            F.array(
                F.struct(F.lit("foreign").alias("by"), F.when(by_foreign, elsewhere("owner")).alias("owner")),
                F.struct(F.lit("wide").alias("by"), F.when(wide, elsewhere("any")).alias("owner")),
            )
        ).alias("m"),
    )
    votes = met.select("f", "m.by", "m.owner").where("owner IS NOT NULL").groupBy("f", "by", "owner").agg(F.count(F.lit(1)).alias("hits"))
    sizes = one.where("NOT foreign").select("f", F.size("lines").alias("size")).where(F.col("size") >= WHOLE)
    totals = cut(
        votes.groupBy("f")
        .agg(
            *[F.coalesce(F.sum(F.when(F.col("by") == by, F.col("hits"))), F.lit(0)).alias(f"{by}_hits") for by in ("foreign", "wide")],
            F.collect_set(F.struct("owner", "hits")).alias("owners"),
        )
        .join(sizes, "f")
        .where((F.col("foreign_hits") >= COPIED * F.col("size")) | (F.col("wide_hits") >= COPIED * F.col("size")))
    )
    # what half of a file's lines point to is counted exactly: the candidate's whole line set against the file's
    pairs = cut(
        totals.select("f", "size", F.explode("owners").alias("o"))
        .where(F.col("o.hits") >= POINTED * F.col("size"))
        .select("f", F.col("o.owner").alias("g"))
        .distinct()
    )
    mine = cut(one.select("f", "repo", "foreign", "lines").join(sent(totals)(totals.drop("owners")), "f"))

    def counted(pairs: DataFrame, owners: DataFrame) -> DataFrame:
        """Pairs with the number of lines that both have, counted over both line sets as a whole."""
        theirs = owners.select(F.col("f").alias("g"), F.col("foreign").alias("marked"), F.col("lines").alias("g_lines")).join(sent(pairs)(pairs), "g")
        return cut(theirs.join(mine, "f").withColumn("shared", F.size(F.array_intersect("lines", "g_lines"))).drop("repo", "foreign", "lines", "g_lines"))

    def all_pairs(unsettled: DataFrame, owners: DataFrame, share: float) -> DataFrame:
        """All pairs of unsettled files with owners of other repositories that may have this share of their lines.

        An owner that has it has one of the rarest lines of a file at least, if no more than the rest of them is left out.
        """
        asking = mine.join(sent(unsettled)(unsettled), "f", "left_semi").select("f", "repo", "size", F.explode("lines").alias("h"))
        wanted = cut(asking.select("h").distinct())
        theirs = cut(owners.select(F.col("f").alias("g"), F.col("repo").alias("g_repo"), F.explode("lines").alias("h")).join(sent(wanted)(wanted), "h", "left_semi"))
        often = theirs.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
        by = Window.partitionBy("f").orderBy(F.coalesce("often", F.lit(0)), "h")
        rare = asking.join(often, "h", "left").withColumn("r", F.row_number().over(by)).where(F.col("r") <= F.floor((1 - share) * F.col("size") + 1e-6) + 1)
        return cut(rare.join(theirs, "h").where("repo != g_repo").select("f", "g").distinct())

    exact = counted(pairs, one)
    whole = (F.col("shared") == F.col("size")) | (F.col("size") >= LEAST)
    wide_file = (F.col("wide_hits") >= WIDE * F.col("size")) & (F.col("size") >= LEAST)
    is_copy = wide_file & (F.col("shared") >= WIDE * F.col("size"))
    copies = exact.where(is_copy).select("f").distinct()
    unsettled = cut(totals.where(wide_file).select("f").join(copies, "f", "left_anti"))
    if not unsettled.isEmpty():
        copies = cut(copies.unionByName(counted(all_pairs(unsettled, one, WIDE), one).where(is_copy).select("f")).distinct())
    known = copies.select(F.col("f").alias("g"), F.lit(True).alias("copy"))

    def edited_of(exact: DataFrame) -> DataFrame:
        return (
            exact.join(known, "g", "left")
            .where(
                (F.col("marked") & whole & (F.col("shared") >= MAIN * F.col("size")) & (F.col("foreign_hits") >= COPIED * F.col("size")))
                | (F.col("copy") & (F.col("size") >= NEAR_LEAST) & (F.col("shared") >= NEAR * F.col("size")))
            )
            .select("f")
        )

    edited = edited_of(exact)
    unsettled = cut(totals.select("f").join(copies.unionByName(edited).distinct(), "f", "left_anti"))
    if not unsettled.isEmpty():
        owners = one.where("foreign").select("f", "repo", "foreign", "lines").unionByName(mine.join(copies, "f", "left_semi").select("f", "repo", "foreign", "lines"))  # no copy is known to be foreign
        edited = edited.unionByName(edited_of(counted(all_pairs(unsettled, owners, MAIN), owners)))
    copied = copies.unionByName(edited).distinct().withColumn("copied", F.lit(True))
    kind = F.when(F.col("foreign"), "foreign").when(F.col("copied"), "copied").otherwise(F.col("kind"))
    return one.select("file_id", "f", "foreign", "kind").join(copied, "f", "left").select("file_id", kind.alias("kind")).where("kind IS NOT NULL")
