"""Problem 8: one consistent form for texts that look the same.

Folding (characters): invisible characters go, every kind of space becomes U+0020, full-width forms and mathematical
letters become ordinary ones, accents are composed. Letter case, digits, line ends, tabs and the number of spaces stay
as they are, and so do ligatures, superscripts, circled digits and typographic quotes, which a reader can see.

Script-aware repair (tokens): only tokens whose letters come from several scripts are touched. The dominant script of
such a token is the one with most letters among those that can write it; its look-alikes replace the letters of the
others where the result is a word of the corpus. Tokens of a single script stay, in whatever script.

One form per look (texts): what repair leaves apart although a reader can't tell it apart (a rare word in two disguises,
a Cyrillic а standing alone in an English sentence) is brought together over whole texts. The look of a text is its
folded text with every look-alike letter in Latin; texts of one look take the form of the one among them that is
written most plainly: wholly Latin first, then with the fewest changes of script, then the most frequent. A text whose
look nobody shares keeps what repair made of it, so Russian and Greek stay Russian and Greek.

Null texts stay null, empty texts empty. Rows with a null key keep their form and are in no pair.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.tables import cut

# Letters that look like a Latin letter, script by script, with their Latin twins (after the public list
# of confusable characters).
TWINS = {
    "Cyrillic": ("асԁеһіјорԛѕԝхуүӏѵАВЕЅІЈКМНОРԚСТԜХҮӀѴԌ", "acdehijopqswxyylvABESIJKMHOPQCTWXYIVG"),
    "Greek": ("ονραυιϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovpauicjABEZHIKMNOPTYXCJ"),
    "Armenian": ("հոսօզՕՏ", "hnuoqOS"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏟᏚᏙᏞᏢᏦᏴ", "DRTAJEWMHYGZCSVLPKB"),
    "Latin": ("ɡɑⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "gaIVXLCDMivxlcdm"),
}
# Characters that take no room on the page (joiners are treated apart).
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff"
# Spaces other than U+0020.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

LATIN_OF = {a: b for letters, twins in TWINS.values() for a, b in zip(letters, twins, strict=True)}
BACK = {s: {b: a for a, b in reversed(list(zip(*pair, strict=True)))} for s, pair in TWINS.items() if s != "Latin"}
FOLD = str.maketrans(
    {c: "" for c in INVISIBLE}
    | {c: " " for c in SPACES}
    | {chr(0xFF00 + i): chr(0x20 + i) for i in range(1, 0x5F)}
    | {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF61, 0xFFA0), *range(0xFFE0, 0xFFE7), *range(0x1D400, 0x1D800)]}
    | {"µ": "μ", "ﾞ": "\u3099", "ﾟ": "\u309a"}
)
#: Any character that FOLD knows, those of other planes as one range.
FOLDABLE = re.compile("[" + re.escape("".join(chr(c) for c in sorted(FOLD) if c < 0x10000)) + "\U0001d400-\U0001d7ff]")
TO_LATIN = str.maketrans(LATIN_OF)
#: A letter of a script that shares letters with Latin.
OTHER = re.compile("[" + "".join(LATIN_OF) + "Ͱ-ԯ\u0530-֏Ꭰ-Ᏽ]")
#: Runs of them with what is set on them.
OTHERS = re.compile(f"(?:{OTHER.pattern}[\u0300-\u036f\u0483-\u0487]*)+")
#: Runs of letters of one script, where scripts share letters.
RUNS = re.compile("([A-Za-zª-ɏɐ-ʯḀ-ỿⅠ-ⅿ]+)|([Ѐ-ԯ]+)|([Ͱ-Ͽἀ-\u1fff]+)|([\u0530-֏]+)|([Ꭰ-Ᏽ]+)")
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee")
WORD = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036fⅠ-ⅿ])*|[Ⅰ-ⅿ]+")
#: The same for Spark's expressions.
WORDS = r"[\p{L}Ⅰ-ⅿ][\p{L}\u0300-\u036fⅠ-ⅿ]*"
EMOJI_JOIN = regex.compile(r"(?<=\p{Extended_Pictographic}[\ufe0f\U0001f3fb-\U0001f3ff]*)\u200d(?=\p{Extended_Pictographic})")
#: Words that are sent to every task at most, some megabytes.
FEW = 100_000
#: Stands for a joiner that holds an emoji together while the other joiners go.
KEPT = "\ue0ff"


def fold(text: str) -> str:
    """The characters of a text in one form; look-alike letters stay."""
    if text.isascii():
        return text
    if "\u200d" in text:
        text = EMOJI_JOIN.sub(KEPT, text)
    if FOLDABLE.search(text):  # most texts have nothing to fold
        text = text.translate(FOLD)
    return (text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).replace(KEPT, "\u200d")


@lru_cache(maxsize=200_000)
def latin_run(run: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", run).translate(TO_LATIN))


def latin(text: str) -> str:
    """The folded text with every look-alike letter in its Latin form, also below an accent."""
    return OTHERS.sub(lambda m: latin_run(m[0]), text)


@lru_cache(maxsize=200_000)
def options(token: str) -> tuple[str, ...]:
    """How a token of several scripts would be written in one, the script with most letters first; () for others."""
    if token.isascii():
        return ()
    counts = [0] * len(SCRIPTS)
    for m in RUNS.finditer(token):
        counts[m.lastindex - 1] += m.end() - m.start()
    if sum(n > 0 for n in counts) < 2:
        return ()
    found = []
    plain = unicodedata.normalize("NFD", token).translate(TO_LATIN)
    for i in sorted(range(len(SCRIPTS)), key=lambda i: -counts[i]):
        if counts[i]:
            script = SCRIPTS[i]
            word = unicodedata.normalize("NFC", plain if script == "Latin" else plain.translate(str.maketrans(BACK[script])))
            if all(m.lastindex == i + 1 for m in RUNS.finditer(word)):
                found.append(word)
    return tuple(found)


def asked(text: str) -> list[str]:
    """The words of which the repair of a folded text depends."""
    return sorted({w for t in set(WORD.findall(text)) for w in options(t)}) if OTHER.search(text) else []


def repair(text: str, words: set[str]) -> str:
    """The folded text, tokens of several scripts in their dominant one where that gives one of the words."""

    def form(match: re.Match) -> str:
        return next((w for w in options(match[0]) if w in words), match[0])

    return WORD.sub(form, text) if words and OTHER.search(text) else text


def switches(text: str) -> int:
    """How often the letters of a text change between scripts that share letters."""
    kinds = [m.lastindex for m in RUNS.finditer(text)] if OTHER.search(text) else []
    return sum(a != b for a, b in zip(kinds, kinds[1:]))


def read_once(rows: DataFrame) -> DataFrame:
    """(k, stored, folded, look, other, switches, asked) of (k, t): what one look at each text tells of it.

    Texts in ASCII are their own form and look and stay with Spark's expressions.
    """

    @F.pandas_udf("struct<folded:string, look:string, other:boolean, switches:int, asked:array<string>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = []
            for t in texts:
                text = fold(t)
                other = OTHER.search(text) is not None
                look = md5(latin(text).encode("utf-8", "replace")).hexdigest()
                found.append((text, look, other, switches(text) if other else 0, asked(text) if other else None))
            yield pd.DataFrame(found, columns=["folded", "look", "other", "switches", "asked"])

    ascii_ = F.col("t").isNull() | (F.length("t") == F.octet_length("t"))
    plain = rows.where(ascii_).select(
        "k", F.md5("t").alias("stored"), F.col("t").alias("folded"), F.md5("t").alias("look"), F.lit(False).alias("other"), F.lit(0).alias("switches"),
        F.lit(None).cast("array<string>").alias("asked"),
    )
    rest = rows.where(~ascii_).select("k", F.md5("t").alias("stored"), read("t").alias("r")).select("k", "stored", "r.*")
    return plain.unionByName(rest)


def repaired(one: DataFrame, salts: int) -> DataFrame:
    """(k, stored, form, look, other, switches): the rows of read_once after script-aware repair.

    The vocabulary are the words of the whole corpus. It is never collected: the words that texts ask for are joined to
    it, salted, because a word may be asked for by every text.
    """
    asking = one.where("size(asked) > 0")
    wanted = cut(asking.select(F.explode("asked").alias("word")).distinct())
    words = one.select(F.explode(F.array_distinct(F.regexp_extract_all("folded", F.lit(WORDS), F.lit(0)))).alias("word"))
    # few words are sought where the texts are; many meet the distinct words of the corpus
    few = wanted.count() <= FEW
    vocabulary = words.join(F.broadcast(wanted), "word", "left_semi").distinct() if few else words.distinct().join(wanted, "word", "left_semi")
    salted = vocabulary.select("word", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    spread = asking.select("k", "stored", F.explode("asked").alias("word")).withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(salts)).cast("int"))
    known = spread.join(salted, ["word", "salt"]).groupBy("k", "stored").agg(F.collect_set("word").alias("known"))

    @F.pandas_udf("struct<form:string, switches:int>")
    def mend(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, words in batches:
            forms = [repair(t, set(w)) for t, w in zip(texts, words)]
            yield pd.DataFrame({"form": forms, "switches": [switches(f) for f in forms]})

    # texts with a row of `known` can change; the others never travel
    b = known.select(F.col("k").alias("bk"), F.col("stored").alias("bs"), "known")
    hit = one.where("size(asked) > 0").join(b, F.col("k").eqNullSafe(F.col("bk")) & (F.col("stored") == F.col("bs")), "left")
    mended = (
        hit.where("known IS NOT NULL")
        .select("k", "stored", "look", mend("folded", "known").alias("m"))
        .select("k", "stored", F.col("m.form").alias("form"), "look", F.col("m.form").rlike(OTHER.pattern).alias("other"), F.col("m.switches").alias("switches"))
    )
    same = ["k", "stored", F.col("folded").alias("form"), "look", "other", "switches"]
    return one.where("asked IS NULL OR size(asked) = 0").select(same).unionByName(hit.where("known IS NULL").select(same)).unionByName(mended)


def unified(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 8) -> DataFrame:
    """(key, stored, form): each row with the md5 of its stored text and the one form; nulls keep a null form."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    every = cut(repaired(cut(read_once(rows)), salts))
    plain, other = every.where("NOT other"), every.where("other")
    # of each look: how many forms there are, and the plainest
    ways = every.groupBy("look", F.md5("form").alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.min("switches").alias("switches"), F.max("other").alias("other")
    )
    best = (
        ways.groupBy("look")
        .agg(F.count(F.lit(1)).alias("forms"), F.min(F.struct("other", "switches", (-F.col("n")).alias("n"), "f")).alias("best"))
        .where("forms > 1")
        .select("look", F.col("best.f").alias("best"), F.col("best.other").alias("as_text"))
    )

    @F.pandas_udf("string")
    def latin_form(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else latin(t) for t in texts], dtype=object)

    # wholly Latin forms never change and stay where they are; a Latin form is worked out from the text itself, another
    # one comes from a row that has it
    met = other.join(best, "look", "left").withColumn("moves", F.col("best").isNotNull() & (F.md5("form") != F.col("best")))
    held = met.where("as_text AND NOT moves").groupBy("look").agg(F.min("form").alias("held"))
    moved = met.join(held, "look", "left").select(
        "k", "stored",
        F.coalesce(F.when(~F.col("moves"), F.col("form")), F.when(F.col("as_text"), F.col("held")), latin_form(F.when(F.col("moves") & ~F.col("as_text"), F.col("form")))).alias("form"),
    )
    return plain.select("k", "stored", "form").unionByName(moved).withColumnRenamed("k", key)


def same_look(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 8) -> DataFrame:
    """(key_a, key_b), key_a < key_b: rows whose texts differ as stored but have one form with a visible character.

    Works on classes of equal stored texts, so that a text copied into a third of all rows is paired with its
    disguises only, never with itself. The members of both classes of a pair are salted.
    """
    forms = (
        unified(docs, key, text, salts)
        .where(F.col("form").rlike(r"[^\s\p{Cc}]") & F.col(key).isNotNull())
        .select(F.col(key).alias("k"), F.md5("form").alias("f"), F.col("stored").alias("t"))
    )
    # both sides of the later joins start from this narrow table; it is written once
    forms = cut(forms)
    several = forms.groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("f")
    members = forms.join(several, "f", "left_semi").withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(salts)).cast("int"))
    classes = members.select("f", "t").distinct()
    a, b = classes.alias("a"), classes.alias("b")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    pairs = a.join(b, F.expr("a.f = b.f AND a.t < b.t")).select(
        F.col("a.f").alias("f"), F.col("a.t").alias("ta"), F.col("b.t").alias("tb"), every.alias("salt")
    )
    left = members.select("f", F.col("t").alias("ta"), "salt", F.col("k").alias("ka"))
    right = members.select("f", F.col("t").alias("tb"), "salt", F.col("k").alias("kb"))
    return (
        pairs.join(left, ["f", "ta", "salt"])
        .select("f", "tb", "ka", every.alias("salt"))
        .join(right, ["f", "tb", "salt"])
        .select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"))
        .distinct()
    )
