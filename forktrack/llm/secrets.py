"""Secret scan: pattern spans plus assignment-aware lexing of name-literal pairs.

Every whole text is read; a null text counts as empty. Texts without any match give empty spans. Rows are
independent, so repeated rows give repeated results, and columns beside the text are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

KINDS = ("assign", "access", "hex", "named")

# The base patterns and the least length of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN, ACCESS_MIN = 6, 20

# How sensitive a part of a target's name is; two-part names are looked up joined.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 0.9,
    "accesskey": 0.9, "privatekey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "authkey": 0.9, "secretkey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.7, "authorization": 0.7, "auth": 0.6,
}
# Literals that stand for a secret without being one.
PLACEHOLDERS = {"password", "changeme", "example", "secret", "placeholder", "undefined", "redacted", "your_password"}

_MARKS = re.compile(r"[:=!<>+*/|&^%-]+")
_VALUE = re.compile(r"""[ \t]*(?:[rbfuRBFU]{0,2}(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`)|([^\s"'`,;(){}\[\]<>#]+))""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-$")
_ASSIGNING = {"=", ":", ":=", "=>"}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, leftmost and non-overlapping within each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _target(text: str, at: int) -> str:
    """The name that ends before ``at``, a quoted key or an annotated variable included."""
    for _ in range(2):
        end = at
        while end and text[end - 1] in " \t":
            end -= 1
        if end and text[end - 1] in "\"'`":
            end -= 1
        start = end
        while start and text[start - 1] in _NAME:
            start -= 1
        name, left = text[start:end], start
        while left and text[left - 1] in " \t":
            left -= 1
        if not (name and left and text[left - 1] == ":" and text[at:at + 1] == "="):
            return name
        at = left - 1
    return name


def operators(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what may assign: each run of marks up to its last ``:`` or ``=`` and a ``>`` after that."""
    for m in _MARKS.finditer(text):
        run = m.group()
        last = max(run.rfind(":"), run.rfind("="))
        if last >= 0:
            yield m.start(), m.start() + last + 1 + run.startswith(">", last + 1)


def pairs(text: str) -> list[tuple[str, int, int, bool]]:
    """(name, literal's start, its end, whether it is quoted) of each assignment, in order."""
    out = []
    for start, end in operators(text):
        if text[start:end] in _ASSIGNING and (v := _VALUE.match(text, end)) and (name := _target(text, start)):
            group = next(g for g in (1, 2, 3, 4) if v.group(g) is not None)
            out.append((name, v.start(group), v.end(group), group != 4))
    return out


def sensitivity(name: str) -> float:
    """The most sensitive part, or two adjacent parts, of a target's name."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return max([SENSITIVE.get(p, 0.0) for p in parts + [a + b for a, b in zip(parts, parts[1:])]], default=0.0)


def literal_weight(value: str) -> float:
    """0 to 1: how much a literal looks like a secret, by length, variety of characters and entropy."""
    if len(value) < 6 or value.lower() in PLACEHOLDERS or value[:2] in ("${", "{{", "<%") or len(set(value)) < 4:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    return min(1.0, entropy / 4) * (0.5 + kinds / 6) * (0.4 if " " in value else 1.0)


def named_spans(text: str, threshold: float) -> list[tuple[int, int, int]]:
    """Literals given to sensitive names, directly or through a constant that holds them."""
    constants: dict[str, tuple[int, int]] = {}
    out = set()
    for name, start, end, quoted in pairs(text):
        value = text[start:end]
        if not quoted and value in constants:
            start, end = constants[value]
        elif not quoted and value.rpartition(".")[2] in constants:
            start, end = constants[value.rpartition(".")[2]]
        constants[name] = (start, end)
        if sensitivity(name) * literal_weight(text[start:end]) >= threshold:
            out.add((start, 3, end))
    return sorted(out)


def scan_text(text: str | None, threshold: float = 0.45) -> tuple[list, list]:
    """(base spans, all spans); a lexed literal inside a base span is not given twice."""
    text = text or ""
    base = base_spans(text)
    extra = [s for s in named_spans(text, threshold) if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)] if ":" in text or "=" in text else []
    return base, sorted(base + extra)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_TYPE = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(text: Column, threshold: float = 0.45) -> Column:
    """Struct column (n_assign, n_access, n_hex, base_sha256, spans) of a text column."""

    @F.arrow_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            base, every = scan_text(value.as_py(), threshold)
            n = Counter(k for _, k, _ in base)
            rows.append({"n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(shown(base).encode()).hexdigest(), "spans": shown(every)})
        return pa.array(rows, _TYPE)

    return run(text)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.45) -> DataFrame:
    """One row for each row of ``docs``: its id and what ``scan`` finds."""
    runtime.prepare(docs.sparkSession)
    return docs.select(F.col(id_col), scan(F.col(text_col), threshold).alias("found")).select(id_col, "found.*")
