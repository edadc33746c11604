"""Problem 2: credentials embedded in source code, configuration and comments.

Each line is taken apart into literals (quoted strings, parts joined by + or join, values of configuration lines,
comments) with the name that they are given to. A literal is searched for credentials of known shape, for fields that
carry one (addresses, command lines, connection strings, markup) and, under a name that calls for a secret, is itself
judged. Literals that are base64, hex, percent or backslash encoded are decoded, layer by layer until nothing decodes (each
layer is shorter than the one around it), and searched again; decoded bytes are parsed as key containers (DER: PKCS#1,
PKCS#8, SEC1; OpenSSH), also where a key's text goes over several literals on lines of their own. A find in a decoded
layer masks the encoded literal that encloses it.

Values to be filled in, references to environments or vaults, names of fields, checksums, ids, certificates and public
keys are not credentials. Null and empty contents have none.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "*"

# Last words of names that hold a secret, and last words that make such a name harmless.
SECRET_NAMES = frozenset(
    """password passwd passwrd pwd pw pass passphrase passcode secret token apikey authkey accesskey secretkey privatekey signingkey
    masterkey encryptionkey deploykey sharedkey sessionkey servicekey adminkey rootkey accountkey storagekey hmackey jwtkey sshkey
    cred creds credential credentials auth authorization bearer kennwort passwort geheimnis motdepasse contrasena clave senha pin
    connectionstring""".split()
)
#: Those of them under which a plain word is a secret, too.
PASSWORD_NAMES = frozenset("password passwd passwrd pwd passphrase passcode secret kennwort passwort geheimnis motdepasse contrasena senha".split())
# Shapes of tokens that services publish, each with the text that stands before its random part.
TOKENS = re.compile(
    r"""(?<![\w/+=.\-])(?:
      eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{16,}
    | (?:AK[A-Z]{1,2}|ASIA)[A-Z0-9]{16,17}(?::[A-Za-z0-9/+]{30,}=*)?(?![A-Za-z0-9])
    | (?:gh[pousr]|github_pat|glpat|xox[abprs]|npm|pypi|hf|dop_v1|shpat|sk|pk|rk|sq0[a-z]{3}|whsec|[a-z]{2,4}_(?:live|prod|test|pat|sec|key))[_\-](?=[\w\-]*\d)[\w\-]{20,}
    | (?:sk|rk|pk)_(?:live|prod|test)_[A-Za-z0-9]{16,}
    | (?:glpat|sk|key)-(?=[\w\-]*\d)[A-Za-z0-9_\-]{18,}
    | AIza[\w\-]{35} | SG\.[\w\-]{20,}\.[\w\-]{30,} | ya29\.[\w\-]{20,}
    )""",
    re.X,
)
#: A token of no service in particular: a short name, a sign, and a long run that no hand wrote.
ISSUED = re.compile(r"(?<![\w/+=.\-@:#$%&?])(?P<head>[a-z][a-z0-9]{1,5}(?:[_\-][a-z]{2,5})?[_\-.])(?P<body>[A-Za-z0-9][A-Za-z0-9_\-]{17,})(?![\w/+=.\-(@])")
# Heads of sums, ids and parts that look like such a token.
NO_TOKEN = re.compile(r"^(?:sha\d*|md\d|crc\d*|blake\w*|etag|uuid|guid|rev|ref|git|img|css|js|id|req|trace|span|build|chunk|hash|sum|v\d+|x64|utf)[_\-.]")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_WHOLE = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----(?:[\s\S]*?-----END \1-----|(?:[A-Za-z0-9+/=\s\\,:\-]|\\[nr])*)")
# Places in a text that carry a credential; group v is the credential.
FIELDS = [
    re.compile(r"(?<![\w+.\-])[a-z][\w+.\-]*+://[^\s/:@\"'<>]*:(?P<v>[^\s/@\"'<>]+)@", re.I),
    re.compile(r"(?:^|\s)(?:-u|--user)[ =][\"']?[\w.\-]+:(?P<v>[^\s\"'@]+)"),
    re.compile(r"-u\s+\S+\s+-p(?P<v>[^\s\"']+)"),
    re.compile(r"--?(?:password|passwd|pass|token|api[_-]?key|secret|access[_-]?token|auth[_-]?token)[= ](?P<v>[^\s\"'&]+)", re.I),
    re.compile(r"-D[\w.\-]*(?:password|passwd|secret|token|key)=(?P<v>[^\s\"']+)", re.I),
    re.compile(r"(?:-e|--env)[ =](?P<n>\w+)=(?P<v>[^\s\"']+)"),
    re.compile(r"\blogin\s+\S+\s+password\s+(?P<v>[^\s\"'`;,]+)"),
    re.compile(r"<(?P<t>\w*(?:password|passwd|secret|token|pwd|pass|apikey)\w*)>(?P<v>[^<>]+)</(?P=t)>", re.I),
    re.compile(r"(?:^|[;\s])(?:password|passwd|pwd|pin|secret|accountkey|sharedaccesskey|access_?key)\s*=\s*(?P<v>[^;\s\"'`]+)(?=;|\s|$)", re.I),
    re.compile(r"[?&](?:key|token|access_token|api_?key|apikey|secret|sig|password|pwd|auth|client_secret)=(?P<v>[^&\s\"'`#]+)", re.I),
    re.compile(r"\bBearer\s+(?P<v>[\w\-.~+/=]{16,})", re.I),
]
BASIC = re.compile(r"\bBasic\s+(?P<v>[A-Za-z0-9+/]{8,}={0,2})")
LOGIN = re.compile(r"\b(?:login|account|user|credentials?)\s+(?:was|is|:|=)?\s*[\w.\-@]+\s*/\s*(?P<v>[^\s,;]{6,})", re.I)
COMMENT_FIELD = re.compile(
    r"(?i)\b(?:password|passwd|pwd|pw|passphrase|secret|token|api[ _-]?key|credentials?|kennwort|mot de passe|login|pin)\b(?:\s+(?:is|was|for\s+\S+(?:\s+is)?|=))?\s*[:=]?\s*[\"'`]?(?P<v>[^\s\"'`,;]{6,})"
)

# What stands where a value has still to be put in.
PLACEHOLDER = re.compile(
    r"""(?ix)^(?:
      [x*.\-_#?0•]{2,} | <[^>]*>.* | \$\{.* | \$\(.* | \{\{.* | \{[\w.\s]*\} | %\(?\w+\)?[s%]? | \$\w+ | @\w+@ | __\w+__ | \#\{.*
    | (?:.*[^a-z0-9])?(?:your|example|changeme|change[_\-]?me|change[_\- ]?it|replace|insert|placeholder|dummy|redacted|fill[_\- ]?in|to[_\-]?do|tbd|
       fixme|sample|enter|goes[_\- ]?here|not[_\-]?set|not[_\-]?a[_\-]?real|fake)(?:[^a-z0-9].*)?
    | (?:none|null|nil|true|false|undefined|empty|unset|default|user|password|passwd|pass|pwd|secret|token|key|api_?key|credentials?|admin|root|test|
       bearer|basic|oauth2?|digest|user_key|jwt|hmac|public|private|string|str|xxx+|prompt|input|env|vault|file|stdin|ask)
    | (?:process\.)?env[.:\[(].* | os\.(?:environ|getenv).* | System\.getenv.* | (?:vault|kv|ssm|arn|secretsmanager|op|keyring|env|file):?/.* | ENC\[.*
    )$"""
)
UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
HOST = re.compile(r"^(?:https?://)?(?:[a-z0-9\-]+\.)+[a-z]{2,}(?::\d+)?(?:/[\w./\-]*)?$", re.I)
STRING = re.compile(r"\"\"\"|'''|\"((?:[^\"\\]|\\.)*)\"?|'((?:[^'\\]|\\.)*)'?|`((?:[^`\\]|\\.)*)`?")
NAME = re.compile(r"(?<![\w.\-])([A-Za-z_][\w.\-]*)[\"'`]?\]?\s*(?::\s*[A-Za-z_][\w<>\[\], ]*?)?\s*(?:=>|:=|\?=|\+=|=|:|\()\s*(?:[\[(]\s*|[\"'`]{2}\.join\(\[?\s*|String\.join\(\"\",\s*|[rbfuRBFU]{1,2}(?=$))*$")
PAIR = re.compile(r"\(\s*[\"'`]([A-Za-z_][\w.\-]*)[\"'`]\s*,\s*$")
SETTING = re.compile(r"^(\s*(?:export\s+|set\s+|ENV\s+|-\s+)?[\"']?([A-Za-z_][\w.\-]*)[\"']?\s*(?:=|:\s|:$)\s*)(.*?)\s*$")
JOINED = re.compile(r"^\s*(?:\+|,|\.\.|\.)?\s*$")
ENCODED = [
    ("base64", re.compile(r"(?<![\w+/=\-])[A-Za-z0-9+/_\-]{16,}={0,2}(?![\w+/=])")),
    ("hex", re.compile(r"(?<![\w])(?:0x)?(?:[0-9a-fA-F]{2}){10,}(?![\w])")),
    ("percent", re.compile(r"(?<![\w.\-~+/:@=&])(?:[\w.\-~+/:@=&]*+%[0-9A-Fa-f]{2}){3,}[\w.\-~+/:@=&%]*")),
    ("escape", re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[0-3][0-7]{2}){4,}")),
]
CONFIG = (".env", ".properties", ".yaml", ".yml", ".ini", ".cfg", ".conf", ".toml", ".sh", ".netrc", ".pgpass", ".txt", ".md")
#: Heads of FIELDS, BASIC, LOGIN and COMMENT_FIELD that are no names of secrets.
HEADS = ("-u", "user", "login", "account", "key", "sig", "basic")
#: Names of secrets that hold no shorter one; what a text has of them is found at the speed of a substring search.
HINTS = tuple(sorted(n for n in SECRET_NAMES if not any(h in n for h in HEADS) and not any(o != n and o in n for o in SECRET_NAMES)))
LETTERS = str.maketrans("", "", "".join(chr(c) for c in range(128) if not chr(c).isalpha()))
#: Runs that can be a token or encoded, and literals that are joined to something.
RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}")
JOINS = re.compile(r"[\"'`](?:\s*\+\s*|\s+)[\"'`]|[\"'`]\s*,\s*[\"'`](?=.*join)|join.*[\"'`]\s*,\s*[\"'`]")
LONG_HEX = re.compile(r"[0-9a-fA-F]{20}")


def telling(text: str) -> bool:
    """Whether a text has a token's shape or a run that decodes to something; never false where a search finds such a one."""
    m = None
    for m in RUN.finditer(text):
        run = m[0]
        data = decoded("base64", run)
        if data and (data.isascii() or data[0] == 0x30 or readable(data)) or LONG_HEX.search(run):
            return True
    return m is not None and (TOKENS.search(text) is not None or ISSUED.search(text) is not None)


def hint(text: str, named: bool = True, shaped: bool = True) -> bool:
    """Whether a text can hold a credential at all: never false where a search finds one. named, shaped: what is looked for."""
    low = text.lower()
    if named:
        for head in HEADS:
            if head in low:
                return True
    if shaped and ("://" in low and "@" in low or low.count("%") >= 3 or low.count("\\") >= 4 or telling(text) or JOINS.search(text)):
        return True
    return named and names(low)


def names(low: str) -> bool:
    letters = low.translate(LETTERS)  # a name may be written in several words
    if not letters.isascii():
        letters = re.sub(r"[^a-z]", "", letters)
    return any(name in letters for name in HINTS)


def drawn(body: str) -> bool:
    """Whether a run of letters and digits looks drawn at random: capitals, small letters and digits change often."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in body if c.isalnum()]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    return len(set(kinds)) == 3 and 3 * turns >= len(kinds)


def tokens(text: str) -> Iterator[re.Match]:
    """Tokens by their shape."""
    for m in TOKENS.finditer(text):
        if not placeholder(m[0]):
            yield m
    for m in ISSUED.finditer(text):
        if drawn(m["body"]) and not NO_TOKEN.match(m["head"]) and not TOKENS.match(m[0]):
            yield m


def words(name: str) -> list[str]:
    name = re.sub(r"\d+$", "", name)
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]


def calls_for_secret(name: str | None) -> bool:
    """Whether a name's last words name a secret: password, api key, signing key ..., but no field, type or length."""
    if not name:
        return False
    w = words(name)
    if not w:
        return False
    return w[-1] in SECRET_NAMES or "".join(w[-2:]) in SECRET_NAMES or "".join(w[-3:]) in SECRET_NAMES


def placeholder(value: str) -> bool:
    v = value.strip()
    if len(v) < 4 or PLACEHOLDER.match(v) is not None or len(set(v)) <= 2:
        return True
    parts = re.split(r"[^A-Za-z0-9]+", v)  # my-password, but not my-Secr3t-pw9
    return any(p.lower() in ("my", "sample") for p in parts) and all(p.isalpha() or p.isdigit() for p in parts if p)


def names_field(value: str) -> bool:
    """Whether a value is itself the name of a field: it ends like one that holds a secret, or consists of such words."""
    return calls_for_secret(value) or all(w in SECRET_NAMES for w in words(value))


def secret_value(value: str, name: str | None = None) -> bool:
    """Whether a literal under a secret's name can be one: digits or mixed letters; under a password's name also letters
    of one kind, and a few words where one has digits."""
    v = value.strip()
    if len(v) < 6 or placeholder(v) or HOST.match(v) or re.match(r"^[\w+.\-]+://", v) and "@" not in v:
        return False
    if re.fullmatch(r"[\d.,:\-+]+", v) and len(v) < 8:
        return False
    if re.fullmatch(r"[A-Za-z_\-.]+", v) and names_field(v):
        return False
    if re.search(r"[{}()<>\[\]$%]{2}|^\W*$|^[/~.]+/|^\w+\(|\$\{|\{\w*\}", v):
        return False
    password = bool(name) and not {*words(name)[-1:], "".join(words(name)[-2:])}.isdisjoint(PASSWORD_NAMES)
    if re.search(r"\s", v):
        return password and 2 <= len(v.split()) <= 4 and re.search(r"\d", v) is not None and not v[0].isupper() and not re.search(r"[.,:;?!]", v)
    if re.search(r"\d", v):
        return True
    if re.search(r"[a-z]", v) and re.search(r"[A-Z]", v) and len(v) >= 8 and (not v.isalpha() or len(v) >= 12):
        return True
    return password and re.fullmatch(r"[A-Za-z]+", v) is not None and not names_field(v)


# --- key containers -------------------------------------------------------------------------------------------------


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list | None:
    """The (tag, content or members) list of DER bytes, None where they don't follow the encoding rules."""
    end = len(data) if end is None else end
    found = []
    while at < end:
        if end - at < 2:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            n = size & 0x7F
            if not 0 < n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > end:
            return None
        inner = der(data, at, at + size, depth + 1) if tag & 0x20 and depth < 8 else data[at : at + size]
        if inner is None:
            return None
        found.append((tag, inner))
        at += size
    return found


def private_container(data: bytes) -> bool:
    """Whether bytes are a private key: PKCS#1 (nine integers), PKCS#8, SEC1, or an OpenSSH container."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    if len(data) < 40 or data[0] != 0x30:
        return False
    tree = der(data)
    if not tree or len(tree) != 1 or not isinstance(tree[0][1], list):
        return False
    members = tree[0][1]
    tags = [t for t, _ in members]
    if tags[:1] != [0x02]:
        return False
    return tags[:9] == [0x02] * 9 or tags[:3] == [0x02, 0x30, 0x04] or tags[:2] == [0x02, 0x04]


def decoded(kind: str, text: str) -> bytes | None:
    """The bytes that an encoded literal stands for; None where it is not of that encoding."""
    try:
        if kind == "hex":
            return bytes.fromhex(text[2:] if text[:2] in ("0x", "0X") else text)
        if kind == "percent":
            return unquote_to_bytes(text)
        if kind == "escape":
            return re.sub(
                rb"\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\([0-3][0-7]{2})",
                lambda m: bytes([int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3], 8)]),
                text.encode(),
            )
        plain = text.rstrip("=").replace("-", "+").replace("_", "/")
        return base64.b64decode(plain + "=" * (-len(plain) % 4)) if len(plain) % 4 != 1 else None
    except (ValueError, binascii.Error):
        return None


def readable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and sum(c.isprintable() or c in "\r\n\t" for c in text) == len(text) else None


# --- search ---------------------------------------------------------------------------------------------------------


def spans_in(text: str) -> list[tuple[int, int]]:
    """Spans of credentials in a text, whatever it is called."""
    found: list[tuple[int, int]] = []
    for m in PRIVATE_WHOLE.finditer(text):
        found.append(m.span())
    found += [m.span() for m in tokens(text)]
    for field in FIELDS:
        for m in field.finditer(text):
            v = m["v"]
            if "n" in field.groupindex and not calls_for_secret(m["n"]):
                continue
            plain = v.isalpha() and (v.islower() or v.isupper())
            if not placeholder(v) and not re.search(r"[{}$<>]|^\W+$", v) and len(v) >= 5 and (re.search(r"\d", v) or not v.islower() and not v.isupper() or field is FIELDS[0] and plain and not names_field(v)):
                found.append(m.span("v"))
    for m in BASIC.finditer(text):
        data = decoded("base64", m["v"])
        if data and (t := readable(data)) and re.fullmatch(r"[^\s:]+:\S{3,}", t) and not placeholder(t.split(":", 1)[1]):
            found.append(m.span("v"))
    for kind, pattern in ENCODED:
        for m in pattern.finditer(text):
            if any(a <= m.start() < b for a, b in found):
                continue
            data = decoded(kind, m[0])
            if data and (private_container(data) or (inner := readable(data)) and len(inner) < len(m[0]) and hides(inner)):
                found.append(m.span())
    return found


def hides(text: str) -> bool:
    """Whether a decoded text holds a credential: by its shape, in a field, or given to a secret's name."""
    if spans_in(text):
        return True
    for line in text.splitlines():
        m = re.search(r"([A-Za-z_][\w.\-]*)[\"']?\s*[=:]\s*[\"']?([^\s\"',;]+)", line)
        if m and calls_for_secret(m[1]) and secret_value(m[2], m[1]):
            return True
    return False


def literals(line: str) -> list[tuple[str | None, str, list[tuple[int, int]], bool]]:
    """(name, value, spans, whole) of the quoted literals of a line; parts that are joined are one value.

    whole is false where something that is no literal is joined to it.
    """
    pieces = []
    for m in STRING.finditer(line):
        if m[0] in ('"""', "'''"):
            continue
        g = 1 if m[1] is not None else 2 if m[2] is not None else 3
        pieces.append((m.start(), m.end(), m.start(g), m.end(g), m[g]))
    found = []
    i = 0
    while i < len(pieces):
        j = i
        # "".join([ "a", "b" ]) and "a" + "b"
        joining = re.search(r"(?:join\(\s*\[?|^\s*\[|=\s*\[)\s*$", line[: pieces[i][0]]) is not None and re.search(r"join", line) is not None
        while j + 1 < len(pieces):
            between = line[pieces[j][1] : pieces[j + 1][0]]
            if re.fullmatch(r"\s*\+\s*|\s+", between) or joining and re.fullmatch(r"\s*,\s*", between):
                j += 1
            else:
                break
        head = line[: pieces[i][0]]
        if pieces[i][4] == "" and j == i and head and line[pieces[i][1] :].startswith(".join"):
            i += 1
            continue
        if joining:
            head = re.sub(r"[\"'`]{2}\.join\(\s*\[?\s*$|\[\s*$", "", head)
        m = NAME.search(head) or PAIR.search(head)
        tail = line[pieces[j][1] :].lstrip()
        whole = not tail.startswith(("+", ".format", ".split", "%")) and not head.rstrip().endswith("+")
        found.append((m[1] if m else None, "".join(p[4] for p in pieces[i : j + 1]), [(p[2], p[3]) for p in pieces[i : j + 1]], whole))
        i = j + 1
    return found


def search_line(line: str, before: str, config: bool) -> list[tuple[int, int]]:
    """Spans of credentials on one line; `before` is the line above, `config` whether bare values are literals."""
    found: list[tuple[int, int]] = []
    for name, value, spans, whole in literals(line):
        if name is None and before:
            # a value on a line of its own belongs to the name that the line above ends with
            only = re.fullmatch(r"\s*[\"'`].*[\"'`]\s*[;,)]*\s*", line)
            m = re.search(r"([A-Za-z_][\w.\-]*)[\"']?\s*(?:(?::\s*\w+\s*)?=\s*[(\[]?|:\s*[(\[]?)\s*$", before) if only else None
            name = m[1] if m else None
        hit = spans_in(value)
        if hit or (whole and calls_for_secret(name) and secret_value(value, name)):
            found += place(hit or [(0, len(value))], spans)
    setting = SETTING.match(line) if config else None
    if setting and setting[3] and setting[3][0] not in "\"'`|>&*{[":
        value, at = setting[3], len(setting[1])
        bare = re.sub(r"\s+#.*$", "", value)
        hit = spans_in(bare)
        if not hit and calls_for_secret(setting[2]) and secret_value(bare, setting[2]):
            hit = [(0, len(bare))]
        found += [(a + at, b + at) for a, b in hit]
    block = re.match(r"\s*(?:-\s+)?([A-Za-z_][\w.\-]*):\s*[|>]?[-+]?\s*$", before) if config else None
    if block and calls_for_secret(block[1]) and not setting and secret_value(line, block[1]) and line.strip()[0] not in "\"'-":
        found.append((len(line) - len(line.lstrip()), len(line.rstrip())))
    mark = re.search(r"(?:^|\s)(?:#|//|\*|/\*|--|<!--|;)\s?", line)
    rest = line[mark.end() :] if mark else ""
    if rest:
        at = mark.end()
        hit = spans_in(rest)
        hit += [m.span("v") for m in LOGIN.finditer(rest) if secret_value(m["v"])]
        for m in COMMENT_FIELD.finditer(rest):
            if not hit and secret_value(m["v"]) and re.search(r"\d", m["v"]) and not re.search(r"[/()]", m["v"]):
                hit.append(m.span("v"))
        found += [(a + at, b + at) for a, b in hit]
    if not found:
        # what is neither quoted nor a setting: shapes only
        found += [m.span() for m in PRIVATE.finditer(line)]
        found += [m.span() for m in tokens(line)]
        for field in FIELDS[:1] + FIELDS[6:8]:
            found += [m.span("v") for m in field.finditer(line) if not placeholder(m["v"]) and not re.search(r"[{}$<>]", m["v"]) and re.search(r"\d", m["v"])]
    return merged(found)


def place(hit: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of a joined value as spans of the line that its parts stand on."""
    found, at = [], 0
    for start, end in spans:
        size = end - start
        for a, b in hit:
            lo, hi = max(a, at), min(b, at + size)
            if lo < hi:
                found.append((start + lo - at, start + hi - at))
        at += size
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[list[int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def search(content: str | None, path: str | None) -> tuple[list[int], str | None]:
    """Lines on which a credential begins, and the content with every credential masked (its length is kept)."""
    if not content:
        return [], content
    low = content.lower()
    called = any(head in low for head in HEADS) or names(low)
    shaped = RUN.search(content) is not None or hint(content, named=False)
    if not called and not shaped:
        return [], content
    config = (path or "").lower().endswith(CONFIG) or "." not in (path or "").rpartition("/")[2]
    lines = content.split("\n")
    numbers: list[int] = []
    wrapped = wrapped_keys(lines) if KEY_BEGINS.search(content) else {}
    before = ""
    named = False  # whether the line above has a hint, perhaps the name of this line's value
    i = 0
    while i < len(lines):
        line = lines[i]
        hinted = bool(line) and hint(line, called, shaped)
        spans = search_line(line, before, config) if line and (hinted or named) else []
        before, named = line, hinted
        if i in wrapped:
            numbers.append(i + 1)
            for k, a, b in wrapped[i]:
                lines[k] = blank(lines[k], [(a, b)])
                i = k
        elif spans:
            numbers.append(i + 1)
            key = PRIVATE.search(line)
            lines[i] = blank(line, spans)
            if key and "-----END" not in line[key.end() :]:
                # a key over several lines: mask to its end
                while i + 1 < len(lines) and re.fullmatch(r"[\sA-Za-z0-9+/=:,\-\"'\\n+#*|]*", lines[i + 1]) and "-----END" not in lines[i + 1] and lines[i + 1].strip():
                    i += 1
                    lines[i] = re.sub(r"[A-Za-z0-9+/=]{8,}", lambda m: MASK * len(m[0]), lines[i])
        i += 1
    return numbers, "\n".join(lines)


#: A line that holds nothing but a literal of base64, as far as a key's text goes over lines.
PART = re.compile(r"^\s*(?:[\w.\[\]]+\s*(?:=|:|\+=)\s*)?[(\[]?\s*(?:\+\s*)?[rb]?[\"'`]?(?P<v>[A-Za-z0-9+/]{16,}={0,2})(?:\\n)?[\"'`]?\s*[+,;)\]\\]*\s*$")


#: How a line begins that the first part of such a key may stand on: a DER sequence or OpenSSH's mark in base64.
KEY_BEGINS = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-P]|b3B)[A-Za-z0-9+/]{14}")


def wrapped_keys(lines: list[str]) -> dict[int, list[tuple[int, int, int]]]:
    """First line -> (line, from, to) of each part, of keys whose text goes over several lines without any marks."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    i = 0
    while i < len(lines):
        parts: list[tuple[int, int, int]] = []
        while i < len(lines) and len(lines[i]) < 4_096 and (m := PART.match(lines[i])):
            parts.append((i, *m.span("v")))
            i += 1
            if lines[i - 1][parts[-1][2] - 1] == "=":
                break
        if len(parts) > 1:
            data = decoded("base64", "".join(lines[k][a:b] for k, a, b in parts))
            if data and private_container(data):
                found[parts[0][0]] = parts
        i += not parts
    return found


def blank(line: str, spans: list[tuple[int, int]]) -> str:
    for a, b in reversed(spans):
        line = line[:a] + MASK * (b - a) + line[b:]
    return line


def masked(chunks: DataFrame) -> DataFrame:
    """(chunk_id, finds, content): each chunk that holds a credential, masked; each content is seen once."""

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, *search(c, p)) for i, c, p in zip(batch["chunk_id"], batch["content"], batch["file_path"])]
            yield pd.DataFrame([(i, len(n), c) for i, n, c in found if n], columns=["chunk_id", "finds", "content"])

    rows = chunks.select("chunk_id", "content", "file_path")
    return rows.mapInPandas(mask, "chunk_id string, finds int, content string").distinct()


def lines_of(content: Column, path: Column) -> Column:
    """Only the lines, so that no text travels back from the Python workers."""

    @F.pandas_udf("array<int>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, paths in batches:
            yield pd.Series([search(c, p)[0] for c, p in zip(contents, paths)], dtype=object)

    return find(content, path)


def found(chunks: DataFrame) -> DataFrame:
    """(chunk_id, line_no), distinct."""
    return (
        chunks.select("chunk_id", F.explode(lines_of(F.col("content"), F.col("file_path"))).alias("line_no"))
        .select("chunk_id", F.col("line_no").cast("bigint").alias("line_no"))
        .distinct()
    )
