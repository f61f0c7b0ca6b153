"""Secret scans by assignment-aware lexing.

Fixed patterns give the base spans. On top, source and configuration syntax is lexed into assignments: names (dotted,
quoted or in capitals) with string literals, joined literals, bare configuration values or other names; so are elements, calls with one literal, indented blocks and the
credentials of addresses. A name is read once, from the start of its run of characters, so time grows with the text. Names that hold
constants are remembered, so that a literal counts by every name it flows to. A literal is scored by how sensitive its
target names are and how random it looks.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import pick

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

#: Weights of words in target names.
NAME_WEIGHTS = {
    "password": 3, "passwd": 3, "pwd": 3, "pass": 2.9, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3,
    "auth": 1, "key": 1, "private": 1, "access": 1, "api": 1, "signing": 1, "encryption": 1, "bearer": 3, "salt": 1, "jwt": 3, "client": 0.5,
}
#: Words after which a name holds something about a secret, not the secret.
HARMLESS = frozenset("name path file url uri length len size count type id policy hint field label header prefix expiry ttl".split())
PLACEHOLDER = re.compile(r"(?i)^(.)\1*$|^(your|my|the|some|change|example|dummy|test|sample|placeholder|none|null|true|false|xxx|todo)|^<.*>$|^\$\{.*\}$|^%\(?\w*\)?s?$|\{\w*\}")
LITERAL = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
#: A type as it stands between a name and its '='.
TYPE = r"[&*]*(?:'\w+[\x20\t]+|mut[\x20\t]+)*[A-Za-z_][\w.]*+(?:\[[\w.,\x20\[\]|*]{0,80}\]|<[\w.,\x20<>\[\]|&?*]{0,80}>)?(?:\[\])*[?!]?"
#: What stands between an operator and the value: types, or names in a chain. A '=' that ends a word may be its padding.
VIA = rf"""{TYPE}(?:[\x20\t]*\|[\x20\t]*{TYPE}){{0,4}}(?:[\x20\t]+(?::=|=(?![=>]))[\x20\t]*|(?::=|=(?![=>]))(?=\S)|=[\x20\t]+(?=["']))"""
BARE = re.compile(r"""[^\s"',;(){}\[\]<>]+""")
#: What a bare value may be instead, as a whole or in a sum (of at most SUM characters): names of constants.
NAME, SUM = re.compile(r"[A-Za-z_][\w.]*"), 1000
STATEMENT = re.compile(
    rf"""(?<![\w.\-])(?:(?![A-Za-z_])[\w.\-])*+(?P<name>["']?[A-Za-z_][\w.\-]*+["']?(?:\[["'][\w.\-]++["']\])?)(?:[?!](?=:))?[\x20\t]*+(?P<op>:=|=>|=(?!=)|:(?!:|//))[\x20\t]*
    (?P<via>(?:{VIA}){{1,3}})?(?:(?P<value>(?:{LITERAL})(?:[\x20\t]*\+?[\x20\t]*(?:{LITERAL}))*)|(?=(?P<bare>[^\s"',;(){{}}\[\]<>])))""",
    re.VERBOSE,
)
#: Words that are types rather than names where both may stand.
TYPE_WORD = re.compile(r"str|string|bytes?|char|text|any|object|[A-Z]\w*[a-z]\w*")
WORDS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")


def name_score(name: str) -> float:
    """How sensitive a target name is, by its words."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    joined = "".join(words)
    return max(sum(NAME_WEIGHTS.get(w, 0) for w in words), max((v for k, v in NAME_WEIGHTS.items() if v >= 3 and joined.endswith(k)), default=0))


def literal_score(text: str) -> float:
    """How much a literal looks like a secret: bits a character, less for words and placeholders."""
    if len(text) < 8 or PLACEHOLDER.search(text) or any(c.isspace() for c in text):
        return 0.0
    n = len(text)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    kinds = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return bits / 4 * (1 if kinds >= 2 else 0.5)


def assignments(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Name and where the literals of its value stand (without quotes), in order; names of constants are replaced by what they hold.

    A word between ':' and '=' may be a type (pwd: str = ...) or a name (ERROR: db_pwd = ...), so the value is that of both.
    """
    known: dict[str, list[tuple[int, int]]] = {}
    at, typed, end = 0, -1, 0
    while m := STATEMENT.search(text, at):
        name, values, bare = m["name"].strip("\"'"), [], []
        if m["value"]:
            start = m.start("value")
            values = [[(start + p.start() + 1, start + p.end() - 1) for p in re.finditer(LITERAL, m["value"])]]
        else:
            bare = [m.start("bare")]
        if m["via"]:
            # Without a space before its '=', what looks like a name may as well begin a bare value.
            word = BARE.match(text, m.start("via"), m.end("via"))
            if word and "=" in word[0] and not (m["value"] and word.end() == m.start("value")):
                bare.append(m.start("via"))
        for start in bare:
            if start >= end:
                end = BARE.match(text, start).end()
            stop = end
            if m.start("name") and text[m.start("name") - 1] in "?&":  # a parameter of a query
                for mark in "&#":
                    stop = text.find(mark, start, stop) if text.find(mark, start, stop) >= 0 else stop
            parts = text[start:stop].split("+") if stop - start <= SUM else []
            held = [known[x] for x in parts if x in known]
            if len(held) < max(len(parts), 1):
                first = NAME.match(text, start, stop)
                if first and first[0] in known and first[0] not in parts:
                    held.append(known[first[0]])
                if m["op"] != "=>":
                    held.append([(start, stop)])
            values += held
        if values and not (m.start("name") == typed and TYPE_WORD.fullmatch(name)):
            key = name.split(".")[-1] if name.startswith(("self.", "this.")) else name
            known[key] = known[name] = values[0]
        for spans in values:
            yield name, spans
        typed = m.start("via")
        at = typed if m["via"] else m.end()


#: Values that stand elsewhere than behind an operator: elements, credentials of an address, a call's only literal, an indented block.
ELEMENT = re.compile(r"<([A-Za-z_][\w.\-:]*+)(?:\s[^<>]*+)?>([^<>\s]++)</\1\s*>")
ADDRESS = re.compile(r"""(?<=://)[^\s/:@"'<>]*+:([^\s/@"'<>]++)@""")
CALL = re.compile(rf"""\(\s*({LITERAL})\s*\)""")
CALLED = re.compile(r"[A-Za-z_][\w.]*$")
BLOCK = re.compile(r"""^([ \t]*+)(?:-[ \t]++)?["']?([A-Za-z_][\w.\-]*+)["']?:[ \t]*+[|>][+\-1-9]*+[ \t]*+(?:#.*+)?$""", re.MULTILINE)
LINE = re.compile(r"\n([ \t]*+)(.*+)")


def elsewhere(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Names and literals of elements, addresses, calls and blocks."""
    if "</" in text:
        for m in ELEMENT.finditer(text):
            yield m[1], [m.span(2)]
    if "://" in text and "@" in text:
        for m in ADDRESS.finditer(text):
            yield "password", [m.span(1)]
    if "(" in text and ("'" in text or '"' in text):
        for m in CALL.finditer(text):
            name = CALLED.search(text, max(0, m.start() - 80), m.start())
            if name:
                yield name[0], [(m.start(1) + 1, m.end(1) - 1)]
    if "|" in text or ">" in text:
        for m in BLOCK.finditer(text):
            spans, at = [], m.end()
            while (line := LINE.match(text, at)) and (not line[2].strip() or len(line[1]) > len(m[1])):
                if line[2].strip():
                    spans.append((line.start(2), line.start(2) + len(line[2].rstrip())))
                at = line.end()
            if spans:
                yield m[2], spans


def literals(text: str, least: float = 2.0, begun: frozenset[int] = frozenset()) -> list[tuple[int, int]]:
    """Spans of literals whose names and looks together make them secrets; none is within another.

    Literals without spaces that start in begun are secrets by any name.
    """
    best: dict[tuple, float] = {}
    names: dict[str, float] = {}
    looks: dict[tuple, float] = {}
    end = -1
    if any(c in text for c in "=:<("):
        for name, spans in itertools.chain(assignments(text), elsewhere(text)):
            if name not in names:
                names[name] = name_score(name)
            score, key = names[name], tuple(spans)
            if len(spans) == 1 and spans[0][0] in begun and not re.search(r"\s", text[slice(*spans[0])]):
                best[key] = least
            elif score:
                if key not in looks:
                    # Values nested in one bare value share its end: of these the first characters are looked at, or time would grow with its square.
                    looks[key] = literal_score("".join(text[a : min(b, a + SUM) if b == end else b] for a, b in spans))
                    end = spans[-1][1]
                best[key] = max(best.get(key, 0), score * looks[key])
    out: list[tuple[int, int]] = []
    for a, b in sorted({s for spans, score in best.items() if score >= least for s in spans if s[1] > s[0]}, key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and these with the literals that none of them contains; what a base span begins is a secret to its end."""
    base = base_spans(text)
    begun = frozenset(ASSIGN.match(text, a).start(2) for a, _, k in base if k == "assign")
    starts, reach = [a for a, _, _ in base], list(itertools.accumulate((b for _, b, _ in base), max))
    within = lambda a, b: (k := bisect.bisect_right(starts, a)) and reach[k - 1] >= b
    extra = [(a, b, "literal") for a, b in literals(text, begun=begun) if not within(a, b)]
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with every secret replaced; of an assignment just the value."""
    cuts = []
    for a, b, kind in all_spans(text)[1]:
        cuts.append((ASSIGN.match(text, a).start(2) if kind == "assign" else a, b))
    out, end = [], 0
    for a, b in sorted(cuts):
        if b <= end:
            continue
        if a >= end:
            out += [text[end:a], mark]
        end = b
    return "".join([*out, text[end:]])


def _redact_each(texts: pd.Series) -> pd.Series:
    return texts.map(redact, na_action="ignore")


def redacted(text: Column | str) -> Column:
    """The column's texts with every secret cut out; null stays null."""
    return F.pandas_udf(_redact_each, "string")(text)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"


def _scanned() -> Callable:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans = [], [], []
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text or "")
                of = Counter(k for _, _, k in every)
                counts.append([of[k] for k in KINDS])
                sha.append(hashlib.sha256(_told(base).encode()).hexdigest())
                spans.append(_told(every))
            columns = list(zip(*counts, strict=True)) or [()] * 4
            n = [pa.array(c, pa.int64()) for c in columns]
            yield pa.record_batch([batch.column("doc_id"), *n[:3], pa.array(sha, pa.string()), pa.array(spans, pa.string()), n[3]], [c.split()[0] for c in SCHEMA.split(", ")])

    return f


def scan(docs: DataFrame) -> DataFrame:
    """Secrets in every text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal (found by lexing only).

    Spans are kind:start:end in code points, end exclusive; of spans that start alike the kind that is listed first comes
    first. A null text is empty; very long ones are scanned whole. Rows with null or repeated ids are scanned like any
    other. Other columns are ignored; no rows give no rows.
    """
    return pick(docs, doc_id="long", text="string").mapInArrow(_scanned(), SCHEMA)
