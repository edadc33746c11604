"""Problem 5: functions paired with their documentation.

A packrat grammar per language finds the functions of a file with the offsets of head, body and documentation: in Python
the string that opens the body, else the /** */ block right before the function and its annotations. It walks the file by
logical lines, so that what stands in strings and comments is no code. A row of function_defs meets its function by its
first line, or by its name where the row has lost its place; the code of the pair is the text between the grammar's
offsets. A docstring of the row comes before the block of the source. Rows that no function of a readable text meets keep
their docstring and the lines that the row names.

A documentation says nothing when, apart from the words of the function's name, its parameters, types and the terms
that documentation is made of, no word is left.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.peg import Expression, Packrat, choice, maybe, named, nested, rule, seq, star, token

STRING = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
PY_STRING = r'(?i:[rbuf]|rb|br|fr|rf)?(?:"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|' + r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|" + STRING + ")"
MARGIN = re.compile(r"[ \t\f]*")
NO_CODE = re.compile(PY_STRING + r"|#[^\n]*")
#: A regular expression behind a sign that no value ends with.
REGULAR = r"(?:(?<=[=(,:\[!&|?;+{}])|(?<=[=(,:\[!&|?;+{}] )|(?<=return ))/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
BLOCK, TEMPLATE = r"/\*[\s\S]*?\*/", r"`(?:[^`\\]|\\[\s\S])*`"


def grammar(language: str) -> dict[str, Expression]:
    """Rules of one language; `line` takes a logical line, `function` a function's head with the names it binds."""
    if language == "python":
        gap = r"(?:[ \t\f]|\\\r?\n)*"
        other = PY_STRING + r"|#[^\n]*|[^()\"'#]+|[\"']"
        return {
            "balanced(": nested("balanced(", "(", ")", other),
            "string": token(PY_STRING),
            "head": seq(
                token(gap + r"(?:async[ \t]+)?def[ \t]+"), named("name", token(r"\w+")), token(gap + r"(?:\[[^\]\n]*\])?" + gap),
                rule("balanced("), token(r"(?:[ \t]*->[^:\n]*(?:\[[^\]]*\])?[^:\n]*)?" + gap + ":"),
            ),
            "doc": seq(token(r"[ \t]*(?:#[^\n]*)?(?:\r?\n[ \t]*(?:#[^\n]*)?)*"), named("doc", token(r"(?!(?i:b|f|br|rb|fr|rf)[\"'])" + PY_STRING)), token(r"[ \t]*(?:[\r\n;#]|\Z)")),
            "function": seq(named("function", rule("head")), maybe(rule("doc"))),
            "line": token(r"(?:" + PY_STRING + r"|#[^\n]*|\\\r?\n|[^\"'#\n\\]+|[\"'\\])*(?:\n|\Z)"),
        }
    regular = "" if language == "java" else REGULAR + "|"
    code = rf"(?:{STRING}|{TEMPLATE}|//[^\n]*|{BLOCK}|{regular}[^\"'`/()\n]+|[/\n\"'`])"
    gap = rf"(?:\s|//[^\n]*|{BLOCK})*"
    rules = {
        "balanced(": nested("balanced(", "(", ")", code),
        "balanced{": nested("balanced{", "{", "}", code.replace("()\\n]+", "{}\\n]+")),
        # the function, or its first annotation, begins on the line of the block's end or on the next one
        "comment": seq(token(r"[ \t]*"), named("doc", token(r"/\*\*(?!/)[\s\S]*?\*/")), token(r"[ \t]*(?:\r?\n)?")),
        "mark": seq(token(r"[ \t]*@(?!interface\b)[\w.$]+"), maybe(rule("balanced(")), token(r"[ \t]*\r?\n")),
        # an expression after an arrow: to the ; or , or the end of the line outside brackets
        "value": seq(token(r"(?!\{)"), star(choice(rule("balanced("), rule("balanced{"), token(rf"{STRING}|{TEMPLATE}|//[^\n]*|{BLOCK}|\[|\]|[^\"'`/(){{}}\[\];,\n]+|/")))),
        "body": choice(
            rule("balanced{"),
            seq(token(r"\s*=>\s*"), choice(rule("balanced{"), rule("value"))),
            seq(token(r"(?:\s*:\s*(?:\{[^{}\n]*\}[\[\]|\w\s.<>,]*?|[^={;\n]+))?\s*"), rule("balanced{")),
        ),
        "line": token(rf"(?:{STRING}|{TEMPLATE}|//[^\n]*|{BLOCK}|[^\"'`/\n]+|[/\"'`])*(?:\n|\Z)"),
    }
    name = named("name", token(r"#?[\w$]+"))
    if language == "java":
        modifiers = r"[ \t]*(?:@[\w.]+(?:\([^)\n]*\))?[ \t]*)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*"
        type_ = r"(?:<[^()\n=;]*>\s*)?(?!(?:return|new|throw|else|case|assert|yield|package|import)\b)(?:[\w.$]+(?:\s*<[^()\n=;]*>)?(?:\s*\[\s*\])*\s+)?"
        rules["head"] = seq(token(modifiers + type_ + r"(?!(?:if|for|while|switch|catch|synchronized|try|return|new|super|this)\b)"), name, token(gap), rule("balanced("), token(gap + r"(?:throws[^{;]*)?[{;]"))
    else:
        result = r"(?:\s*:\s*(?:\{[^{}\n]*\}[\[\]|\w\s.<>,]*?|[^={;\n]+))?"
        generic = r"(?:<[^()\n]*>)?"
        start = r"[ \t]*(?:export\s+)?(?:default\s+)?"
        rules["head"] = choice(
            seq(token(start + r"(?:declare\s+)?(?:async\s+)?function\s*\*?\s*"), name, token(generic + gap), rule("balanced(")),
            seq(token(start + r"(?:const|let|var)\s+"), name, token(r"(?:\s*:[^=\n]*)?\s*=\s*(?:async\s*)?(?:function\s*\*?\s*[\w$]*\s*)?" + generic + gap), rule("balanced("), token(result + r"\s*(?:=>|\{)")),
            seq(token(start + r"(?:const|let|var)\s+"), name, token(r"\s*=\s*(?:async\s+)?[\w$]+\s*=>")),
            seq(
                token(r"[ \t]*(?:(?:public|protected|private|static|async|override|readonly|abstract|get|set)\s+)*\*?\s*(?!(?:if|for|while|switch|catch|with|return|function|new|super|await|typeof)\b)"),
                name, token(generic + gap), rule("balanced("), token(result + r"\s*[{;]"),
            ),
        )
    rules["function"] = seq(maybe(rule("comment")), named("marks", star(rule("mark"))), named("function", rule("head")))
    return rules


GRAMMARS = {ext: grammar(name) for ext, name in {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java"}.items()}


def python_end(parser: Packrat, begin: int, end: int) -> int:
    """Where the body of the function ends whose head is at these offsets: before the first logical line no deeper than it."""
    text = parser.text
    first = text.rfind("\n", 0, begin) + 1
    margin = len(MARGIN.match(text, first)[0].expandtabs())
    at, last, open_ = end, end, 0
    while 0 <= at < len(text):
        if at > end and not open_:  # a line that goes on in brackets may have any margin
            m = MARGIN.match(text, at)
            blank = text[m.end() : m.end() + 1] in ("", "\n", "\r", "#")
            if not blank and len(m[0].expandtabs()) <= margin:
                break
        else:
            blank = False
        after = max(parser.parse("line", at), at + 1)
        code = NO_CODE.sub("", text[at:after])
        open_ = max(0, open_ + sum(map(code.count, "([{")) - sum(map(code.count, ")]}")))
        at = after
        last = last if blank else at
    return len(text[:last].rstrip())


def brace_end(parser: Packrat, end: int) -> int:
    """Where the body ends that follows a head; the end of the head where there is none."""
    text = parser.text
    if text[end - 1] == "{":
        found = parser.parse("balanced{", end - 1)
    elif text[end - 2 : end] == "=>":
        found = parser.parse("body", end - 2)
    elif text[end - 1] == ";":
        found = end
    else:
        found = parser.parse("body", end)
    return found


def functions(ext: str, text: str) -> list[dict]:
    """name, line (of the function), offsets of code and documentation of each function of a file, in order."""
    rules = GRAMMARS.get(ext)
    if rules is None or not text:
        return []
    parser, found, at, line, counted = Packrat(rules, text), [], 0, 1, 0
    python = ext == ".py"
    while at < len(text):
        parser.names = {}
        if parser.parse("function", at) >= 0:
            got = dict(parser.names)
            begin, end = got["function"]
            line += text.count("\n", counted, begin)
            counted = begin
            doc = text[slice(*got["doc"])] if "doc" in got else None
            stop = python_end(parser, begin, end) if python else brace_end(parser, end)
            marks = got.get("marks", (begin, begin))
            found.append(
                {
                    "name": text[slice(*got["name"])], "line": line + text.count("\n", begin, got["name"][0]), "first": line - text.count("\n", *marks), "doc": doc,
                    "begin": text.rfind("\n", 0, got["name"][0]) + 1, "end": stop if stop >= 0 else None,
                }
            )
            # go on after the head (Python: after its string as well, else it would be read as code)
            at = max(end, got["doc"][1] if python and doc is not None else end)
        at = max(parser.parse("line", at), at + 1) if python or "\n" not in text[at : at + 1] else at + 1
        if len(parser.memo) > 100_000:
            parser.memo.clear()
    return found


def plain(doc: str) -> str:
    """The words of a documentation without its delimiters and the margin of its lines."""
    text = doc.strip()
    if text[:3] == "/**":
        text = re.sub(r"\*+/$", "", text[3:])
        text = re.sub(r"(?m)^[ \t]*\*+[ \t]?", "", text)
    return text.strip()


def literal(source: str) -> str:
    try:
        return str(ast.literal_eval(source))
    except (ValueError, SyntaxError):
        return source.strip("\"' ")


# Words that documentation is made of, whatever it documents, in the languages met.
TERMS = frozenset(
    """a an the this that these those it its is are be of by for to in on at as and or from with if any all no not given
    param params parameter parameters arg args argument arguments kwargs return returns returned returning rtype type types raises
    raise yields yield throws exception result results value values output input object objects self cls none null void undefined
    str string int integer float double number numeric bool boolean list dict map array set tuple record any optional char long short byte
    unknown true false function func method methods class constructor member callable procedure routine helper
    todo fixme xxx tbd hack tba wip na add write document documentation documented docs doc docstring docstrings javadoc jsdoc description
    descriptions describe summary placeholder missing here later me implement implemented implementation auto automatically generated
    generate stub stubs fill non see inherited inherit inheritdoc inherits base parent super superclass overridden override overrides
    overriding same above below empty nothing needed required yet come coming soon please insert your goes lorem ipsum
    noqa pragma cover pylint flake8 mypy disable enable ignore next line lint eslint tslint prettier istanbul ts nocheck expect error jshint
    isort skip off fmt yapf black nosec sonar nosonar codeql suppress suppresswarnings
    beschreibung folgt dokumentation kommentar fehlt keine à completer compléter documenter description décrire faire por hacer
    documentar descripción pendiente br nbsp html code link p""".split()
)
WORD = re.compile(r"[^\W\d_]{2,}|[A-Za-z](?=')")
DIRECTIVE = re.compile(
    r"(?:#\s*)?(?:noqa|pragma:|type:\s*ignore|pylint:|flake8:|mypy:|eslint-|tslint:|prettier-|istanbul\s|@ts-|jshint|isort:|fmt:|yapf:|c8\s|v8\s|nosec|nosonar|@override\b|@suppress)[^\n]*",
    re.I,
)


def parts(name: str) -> set[str]:
    """The lower-case words of an identifier or declaration."""
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+", name)}


def stems(word: str) -> set[str]:
    """A word with the forms it may have been inflected from."""
    found = {word}
    for end, put in (("ies", "y"), ("es", ""), ("s", ""), ("es", "e"), ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("er", ""), ("er", "e")):
        if word.endswith(end) and len(word) > len(end) + 1:
            found.add(word[: -len(end)] + put)
            if len(word) > len(end) + 2 and word[-len(end) - 1] == word[-len(end) - 2]:
                found.add(word[: -len(end) - 1])
    return found


def informative(doc: str | None, name: str | None, params: list[str] | None, result: str | None = None) -> bool:
    """Whether a documentation says something that name, parameters and types don't."""
    if doc is None:
        return False
    text = plain(doc)
    text = re.sub(r"<[^<>\n]*>|&\w+;|\{@\w+[^}]*\}|\{[^{}\n]*\}", " ", text)
    text = DIRECTIVE.sub(" ", text)
    known = parts(name or "") | parts(result or "")
    for p in params if params is not None else ():
        known |= parts(p or "")
    # names that the documentation itself introduces as parameters
    for m in re.finditer(r"@param\s+([\w$.]+)|:(?:param|type)\s+(?:\w+\s+)?(\w+)\s*:|^[ \t]*(\w+)[ \t]*(?:\([^)\n]*\))?[ \t]*:(?=[ \t])", text, re.M):
        known |= parts(m[1] or m[2] or (m[3] if params is None or any(re.search(rf"\b{re.escape(m[3])}\b", p or "") for p in params) else ""))
    for word in WORD.findall(text):
        for w in parts(word) or {word.lower()}:
            if len(w) < 2 or w in TERMS or w in known:
                continue
            if not (stems(w) & known or any(w in stems(k) for k in known)):
                return True
    return False


def documented(defs: DataFrame, files: DataFrame) -> DataFrame:
    """(function_id, code, doc, informative): each function with its text and documentation.

    defs as function_defs, files as tables.current_files. Functions of one file travel together, so each text is
    shuffled and parsed once. Repeated function rows count once; functions without a file keep their docstring and no code.
    A text that was delivered twice gives its rows twice.
    """
    one = (
        defs.where(F.col("id").isNotNull())
        .select("id", "file_id", F.struct("name", "docstring", "params", "return_type", "start_line", "end_line").alias("d"))
        .groupBy("id")
        .agg(F.min("file_id").alias("file_id"), F.min("d").alias("d"))
    )
    # functions travel by file and stretch of 2,000 lines, rows that lost their place or their file in small parts, so
    # that no group grows with the table
    spot = (
        F.when(F.col("file_id").isNull(), F.xxhash64("id"))
        .when(F.col("d.start_line") > 0, F.floor(F.col("d.start_line") / 2_000))
        .otherwise(-1 - F.pmod(F.xxhash64("id"), F.lit(32)))
    )
    grouped = one.groupBy("file_id", spot.alias("spot")).agg(F.collect_list(F.struct("id", "d.*")).alias("defs"))
    texts = files.select("file_id", "path", "content")
    schema = "function_id string, code string, doc string, informative boolean"

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text, defs in zip(batch["path"], batch["content"], batch["defs"]):
                ext = re.search(r"(\.[^./]+)?$", path or "")[0].lower()
                found = functions(ext, text or "")
                at = {f["first"]: f for f in found} | {f["line"]: f for f in found}
                by_name = {f["name"]: f for f in found}
                lines = None
                for d in defs:
                    start, end = d["start_line"] or 0, d["end_line"] or 0
                    here = at.get(start) if start > 0 else by_name.get(d["name"])
                    doc = d["docstring"]
                    if doc is None and here is not None and here["doc"] is not None:
                        doc = literal(here["doc"]) if ext == ".py" else here["doc"]
                    if here is not None and here["end"] is not None:
                        code = text[here["begin"] : here["end"]]
                    else:
                        lines = lines or (text or "").split("\n")
                        start = here["line"] if start <= 0 and here is not None else start
                        code = "\n".join(lines[start - 1 : max(end, start)]) if 0 < start <= len(lines) and text else None
                    params = None if d["params"] is None else list(d["params"])
                    rows.append((d["id"], code, doc, informative(doc, d["name"], params, d["return_type"])))
            yield pd.DataFrame(rows, columns=["function_id", "code", "doc", "informative"])

    return grouped.join(texts, "file_id", "left").select("path", "content", "defs").mapInPandas(pair, schema)
