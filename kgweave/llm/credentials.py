"""Credentials embedded in source code: entropy of quoted strings and long tokens, with their context, and redaction.

Candidates are quoted strings (joined over concatenation), values after a key, long tokens, addresses and key blocks. A
candidate's alphabet (hex, capitals and digits, letters and digits, base64, printable) sets the highest entropy that its
length allows; a random string comes close to it and changes between kinds of characters all the time, a name does
neither. Hashes, ids, certificates, images, placeholders and references to other stores are ruled out by form and key.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest random token, and shortest password.
MIN_TOKEN, MIN_PASSWORD = 16, 6
#: Random characters after a known beginning from which their entropy is tested.
MIN_TAIL = 8
#: Share of the entropy that alphabet and length allow, and share of neighbours of different kinds, of a random token.
MIN_ENTROPY, MIN_CHANGES = 0.80, 0.22
#: Longest random string without a telling name that counts as a token; longer ones, and those of three parts or more, are
#: encoded data.
MAX_UNNAMED = 256

# Alphabets with their sizes, the narrowest first.
ALPHABETS = (("hex", re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z"), 16), ("upper", re.compile(r"[A-Z0-9]+(?:-[A-Z0-9]+)*\Z"), 36), ("alnum", re.compile(r"[A-Za-z0-9]+\Z"), 62), ("base64", re.compile(r"[A-Za-z0-9+/_=.-]+\Z"), 65), ("printable", re.compile(r"[!-~]+\Z"), 94))

MASK = "REDACTED"
_KEY = re.compile(r"(?i)pass(?!ive|ed|es|ing|age)|pwd|secret|token|api[_.-]?key|access[_.-]?key|signing[_.-]?key|private[_.-]?key|(?<![a-z])auth(?!or(?!iz))|credential|(?<![a-z])creds?(?![a-z])|bearer")
_PASSWORD_KEY = re.compile(r"(?i)pass(?:word|wd|phrase)?(?![a-z]*field)|pwd|secret|credential|(?<![a-z])creds?(?![a-z])|auth|token")
_HASH_KEY = re.compile(r"(?i)sha|md5|etag|digest|checksum|hash|commit|revision|(?<![a-z])rev(?![a-z])|integrity|fingerprint|uuid|guid|(?<![a-z])id(?![a-z])|(?<![a-z])ref(?![a-z])|object|image|logo|icon|public|certificate|(?<![a-z])ca(?![a-z])|nonce|salt")
_PLACEHOLDER = re.compile(
    r"(?i)\A(?:[x*.#_-]+|<[^>]*>|\[[^\]]*\]|\$\{?[\w.]+\}?|\$\([^)]*\)|\{\{?[^}]*\}?\}|%\(?\w*\)?[sdv]|:\w+|(?:your|my|the|some|insert|enter|change|replace|dummy|example|sample|fake|test|todo|tbd|fixme|none|null|redacted|secret|password|passwd|pass|token|placeholder)(?:[-_ ]?(?:me|here|your|my|api|access|secret|auth|token|key|password|passwd|value|this|it|field|input|user))*[-_ !.]*)\Z"
)
_REFERENCE = re.compile(r"(?i)process\.env|os\.environ|getenv|System\.getenv|env::var|ENV\[|vault|keyring|key[_ ]?store|secrets?\.|config\.|settings\.|\$\{|\$\(|^\$[A-Za-z]")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----")
_PEM_BODY = re.compile(r"(?:\\[nr]|[A-Za-z0-9+/=]{8,}|[\s\"'+,;#*|>\\.])*")
_DATA = re.compile(r"data:[\w/+.-]+;base64,[A-Za-z0-9+/=]*(?:[\"']\s*\+?\s*\n?\s*[\"'][A-Za-z0-9+/=]{20,})*")
_URL = re.compile(r"\b([a-z][a-z0-9+.-]*)://([^\s/:@\"'<>]*):([^\s/@\"']+|<[^>]*>)@(?=[\w.\[$%{<-])", re.I)
_PARAM = re.compile(r"[?&;]([\w.~-]+)=([^&\s\"'#;)>]+)")
_QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'")
_GLUE = re.compile(r"\s*(?:\+|\.\.?|<>|\\)\s*|[ \t]*\n[ \t]+|[ \t]+")
_BEFORE = re.compile(r"([A-Za-z_$][\w$.-]*)[\"']?\]?\s*(?::\s*&?(?:'static\s+)?[\w<>\[\]]+\s*)?(?::=|=>|==?|:)\s*\(?\s*(?:[bruf]{1,2})?\Z")
_NESTED = re.compile(r"\\?[\"'][\w.-]+\\?[\"']\s*[:=]")
_ESCAPED = re.compile(r"\\[\"']([\w.-]+)\\[\"']\s*[:=]\s*\\[\"']([^\"'\\]+)\\[\"']")
_LINE = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?([A-Za-z_][\w.-]*)[ \t]*[=:][ \t]*([^\s\"'`(){}\[\]][^\n]*?)[ \t]*;?$", re.M)
_SEGMENT = re.compile(r"(?:^|/)([A-Za-z_][\w.-]*)=([^/\s]+)")
_HEADER = re.compile(r"(?i)\b(?:bearer|basic|token)\s+([A-Za-z0-9+/=_.~!@#%^&*?-]{8,})")
_FLAG = re.compile(r"(?i)(?:^|\s)--?(?:password|passwd|pass|pwd|token|secret|api-?key|auth)[ =]([^\s\"'\;]+)")
_USER = re.compile(r"(?:^|\s)(?:-u|--user)[ =][\"']?[\w.@-]+:([^\s\"']+)")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)>\s*([^<>\n]+?)\s*</\1>")
_LOGIN = re.compile(r"(?i)\b(?:log-?in|user(?:name)?|account|pass(?:word)?|pw|credentials?|creds?)\b[^\n:=/]{0,40}[:=]\s*(?:[\w.@-]+\s*[/:|]\s*)?([^\s/|,;\"'`()]{6,})")
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}|(?<![A-Za-z0-9])github_pat_\w{20,}|(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?|(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{30,}|(?<![A-Za-z0-9])[a-z]{2,5}_(?:live|test|prod)_[A-Za-z0-9]{12,}"
    r"|(?<![A-Za-z0-9])[a-z]{2,5}-[A-Z0-9]{6,}(?:-[A-Z0-9]{6,}){1,}(?![A-Za-z0-9])|(?<![A-Za-z0-9])glpat-[\w-]{16,}"
)
_BARE = re.compile(r"(?<![\w+/=.\"'$@:-])[A-Za-z0-9_-]{20,}(?![\w+/=.(\"'-])")
_HUMP = re.compile(r"(?<=[a-z])[A-Z](?=[a-z]{2})")
_CUT = re.compile(r"\.\.\.\Z")


class Secret(NamedTuple):
    start: int
    end: int
    kind: str


def entropy(s: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def is_random(s: str, least: int = MIN_TOKEN) -> bool:
    """High entropy for its alphabet and length, and no name: the kinds of characters change all the time."""
    if len(s) < least or _UUID.match(s):
        return False
    size = next((n for _, form, n in ALPHABETS if form.match(s)), 0)
    if not size or not any(c.isdigit() for c in s) or not any(c.isalpha() for c in s):
        return False
    highest = math.log2(min(len(s), size))
    # a short random string misses its highest entropy by chance; the allowance shrinks with the length
    if entropy(s) < (MIN_ENTROPY - 1.0 / len(s)) * highest:
        return False
    flat = _HUMP.sub("a", s)  # a capital that starts a word within a name is no change
    changes = sum(_class(a) != _class(b) for a, b in zip(flat, flat[1:])) / (len(s) - 1)
    return changes >= MIN_CHANGES


def is_hash(s: str) -> bool:
    return bool(re.match(r"(?i)(?:sha(?:1|256|384|512)[-:]|md5[-:])", s)) or bool(re.match(r"(?:[0-9a-f]{7,}|[0-9A-F]{7,})\Z", s))


def is_password(s: str, named: bool) -> bool:
    """A made-up password: letters, digits and a mark; behind a password's name, letters and two digits will do."""
    if len(s) < MIN_PASSWORD or re.search(r"[\s(){}\[\]<>]", s) or re.match(r"[\w.-]*/|https?:|\.", s):
        return False
    letters, digits = any(c.isalpha() for c in s), any(c.isdigit() for c in s)
    if not (letters and digits):
        return False
    return bool(re.search(r"[!@#$%^&*?~]", s)) or named and bool(re.match(r"(?:[A-Za-z]{3,}[-_.])?[A-Za-z]{4,}\d{2,}(?:-\w)?\Z", s))


def _value(key: str, value: str) -> str | None:
    """The kind of credential that ``value`` is behind ``key``, if any."""
    v = _CUT.sub("", value.strip())
    m = _HEADER.match(v)
    if m:
        v = m[1]
    if re.match(r"[A-Za-z_]\w*[#.:]\d+\Z", v):  # a name with a number
        return None
    if not v or _PLACEHOLDER.match(v) or _REFERENCE.search(v) or v.startswith(("data:", "sha")) or _UUID.match(v):
        return None
    if not _KEY.search(key):
        return None
    if _HASH_KEY.search(key) and not re.search(r"(?i)pass|pwd|secret|token|private", key):
        return None
    if is_random(v):
        return "token"
    return "password" if is_password(v, bool(_PASSWORD_KEY.search(key))) else None


def _unnamed(key: str, value: str) -> bool:
    """A long random token behind a neutral name or none; names of hashes, ids and images rule it out."""
    v = _CUT.sub("", value.strip())
    if not v or _PLACEHOLDER.match(v) or _REFERENCE.search(v) or v.startswith(("data:", "sha")) or is_hash(v) or _HASH_KEY.search(key):
        return False
    # without a name: letters of both cases and digits, no address or path, and no longer than keys are
    return len(v) <= MAX_UNNAMED and is_random(v, 20) and "://" not in v and v[0] not in "/." and any(c.islower() for c in v) and any(c.isupper() for c in v)


def find_secrets(text: str | None, is_path: bool = False) -> list[Secret]:
    """Spans of the literal credentials in a text, in order, without overlaps."""
    if not text:
        return []
    found: list[Secret] = []
    closed: list[tuple[int, int]] = []  # spans that hold none: certificates, public keys, images
    for m in _PEM.finditer(text) if "-----BEGIN" in text else ():
        end, other = text.find("-----END", m.end()), text.find("-----BEGIN", m.end())
        if end < 0 or 0 <= other < end:  # cut off
            end = _PEM_BODY.match(text, m.end()).end()
        if "PRIVATE" in m[1] and len(re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", text[m.end() : end])) >= 16:
            found.append(Secret(m.end(), end, "private_key"))
        closed.append((m.start(), end))
    for m in _DATA.finditer(text) if "base64," in text else ():
        closed.append(m.span())
    free = lambda a, b: not any(a < y and x < b for x, y in closed)
    for m in _KNOWN.finditer(text):
        tail = re.sub(r"^[A-Za-z]+[_-](?:live_|test_|prod_)?", "", m[0])
        if free(*m.span()) and not re.search(r"(?i)example|x{6}|0{8}", m[0]) and (len(tail) < MIN_TAIL or is_random(tail, MIN_TAIL)):
            found.append(Secret(*m.span(), "token"))
    for m in _URL.finditer(text) if "://" in text else ():
        if not _PLACEHOLDER.match(m[3]) and not re.search(r"[${}<>*]", re.sub(r"[*!^&%@#?$]\Z", "", m[3])):
            found.append(Secret(*m.span(3), "address"))
    for m in _PARAM.finditer(text) if "=" in text and "?" in text else ():
        signed = re.search(r"(?i)\A(?:sig|signature|x-amz-signature|hmac|key)\Z", m[1])
        if signed and is_random(m[2]) and not _PLACEHOLDER.match(m[2]) or not signed and _value(m[1], m[2]):
            found.append(Secret(*m.span(2), "address"))
    if is_path:
        for m in _SEGMENT.finditer(text):
            if _value(m[1], m[2]):
                found.append(Secret(*m.span(2), "token"))
    else:
        _in_code(text, found, free)
    found.sort(key=lambda s: (s.start, -s.end))
    out: list[Secret] = []
    for s in found:
        if s.end > s.start and (not out or s.start >= out[-1].end):
            out.append(s)
    return out


def _in_code(text: str, found: list[Secret], free) -> None:
    quoted = [m for m in _QUOTED.finditer(text)] if '"' in text or "'" in text else []
    k = 0
    while k < len(quoted):
        group = [quoted[k]]
        while k + 1 < len(quoted) and _GLUE.fullmatch(text, group[-1].end(), quoted[k + 1].start()):
            k += 1
            group.append(quoted[k])
        k += 1
        spans = [m.span(1 if m[1] is not None else 2) for m in group]
        value = "".join(text[a:b] for a, b in spans)
        if not value or not free(spans[0][0], spans[-1][1]):
            continue
        before = _BEFORE.search(text, max(0, group[0].start() - 90), group[0].start()) if group[0].start() else None
        inner = [s for m in _HEADER.finditer(value) if re.search(r"(?i)authori[sz]ation|bearer|basic", value[: m.start(1)] + (before[1] if before else "")) and (s := m[1]) and not _PLACEHOLDER.match(s) and not _REFERENCE.search(s) and (is_random(s) or is_password(s, True))]
        if inner:
            at = value.index(inner[0])
            if len(group) == 1:
                found.append(Secret(spans[0][0] + at, spans[0][0] + at + len(inner[0]), "header"))
            else:
                found.extend(Secret(a, b, "header") for a, b in spans)
            continue
        if len(group) == 1 and _NESTED.search(value):  # code within a string
            inside: list[Secret] = []
            if "\\" in value:
                inside += [Secret(*m.span(2), "token") for m in _ESCAPED.finditer(value) if _value(m[1], m[2])]
            else:
                _in_code(value, inside, lambda a, b: True)
            found.extend(Secret(spans[0][0] + x.start, spans[0][0] + x.end, x.kind) for x in inside)
            continue
        kind = _value(before[1], value) if before else None
        if not kind and len(group) < 3 and _unnamed(before[1] if before else "", value):
            kind = "token"
        if kind:
            found.extend(Secret(a, b, kind) for a, b in spans)
    for m in _LINE.finditer(text):
        if '"' not in m[2] and free(*m.span(2)):
            h = _HEADER.search(m[2])
            if not re.search(r"\s", m[2]) and _value(m[1], m[2]):
                found.append(Secret(*m.span(2), "token"))
            elif h and (is_random(h[1]) or is_password(h[1], True)) and re.search(r"(?i)auth|header|bearer", m[1] + m[2]):
                found.append(Secret(m.start(2) + h.start(1), m.start(2) + h.end(1), "header"))
    strings = [(m.start(), m.end()) for m in quoted]
    at = 0
    for m in _BARE.finditer(text):
        while at < len(strings) and strings[at][1] <= m.start():
            at += 1
        before = _BEFORE.search(text, max(0, m.start() - 90), m.start())
        if not (at < len(strings) and strings[at][0] < m.end()) and free(*m.span()) and _unnamed(before[1] if before else "", m[0]):
            found.append(Secret(*m.span(), "token"))
    for m in _ELEMENT.finditer(text) if "</" in text else ():
        if free(*m.span(2)) and _value(m[1], m[2]):
            found.append(Secret(*m.span(2), "token"))
    for m in _USER.finditer(text):
        if free(*m.span(1)) and not _PLACEHOLDER.match(m[1]) and not _REFERENCE.search(m[1]):
            found.append(Secret(*m.span(1), "password"))
    for form, kind in ((_FLAG, "password"), (_LOGIN, "password")):
        for m in form.finditer(text):
            v = m[1]
            if free(*m.span(1)) and not _PLACEHOLDER.match(v) and not _REFERENCE.search(v) and (is_password(v, kind == "x") or is_random(v) and not is_hash(v)):
                found.append(Secret(*m.span(1), kind))


def redact(text: str, secrets: list[Secret]) -> str:
    """The text with each credential replaced by MASK; quotes, keys, addresses and key-block frames stay as they are."""
    out, at = [], 0
    for s in secrets:
        body = text[s.start : s.end]
        mask = MASK
        if s.kind == "private_key":  # line ends at the block's frame stay
            head, tail = re.match(r"(?:\\[nr]|\s)*", body)[0], re.search(r"(?:\\[nr]|[\s\"'+,;])*\Z", body)[0] if len(body) > 4 else ""
            mask = head + MASK + tail
        out += [text[at : s.start], mask]
        at = s.end
    return "".join([*out, text[at:]])


def credentials(rows: DataFrame, key: str, field: str) -> DataFrame:
    """field_name, rec_key, secrets, kinds, redacted: each row of ``rows`` whose ``field`` holds a literal credential.

    Works row by row on whole texts, nothing is shuffled; null or empty fields hold none, a null key stays null, repeated
    rows are repeated. ``field`` named source_file is read as a path or address, anything else as code.
    """
    is_path = field == "source_file"

    def run(batches):
        for pdf in batches:
            out = []
            for k, text in zip(pdf["k"], pdf["t"]):
                s = find_secrets(text, is_path)
                if s:
                    out.append((field, k, len(s), ",".join(sorted({x.kind for x in s})), redact(text, s)))
            yield pd.DataFrame(out, columns=["field_name", "rec_key", "secrets", "kinds", "redacted"])

    picked = rows.select(F.col(key).alias("k"), F.col(field).alias("t")).where(F.col("t").isNotNull() & (F.length("t") >= MIN_PASSWORD))
    return picked.mapInPandas(run, "field_name string, rec_key string, secrets int, kinds string, redacted string")


def all_credentials(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``credentials`` of nodes.label, nodes.source_file and files.content."""
    return credentials(nodes, "id", "label").unionByName(credentials(nodes, "id", "source_file")).unionByName(credentials(files, "path", "content"))
