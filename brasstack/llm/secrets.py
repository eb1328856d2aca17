"""Secret scans by assignment-aware lexing.

Fixed patterns find base spans. Beside them a lexer reads name-literal pairs from source and configuration syntax
(name = "x", name := 'x', "name": "x", name: x, x + y of literals), follows names that stand for constants assigned
earlier in the text, and scores each literal by how sensitive the target names are that it reaches and how random it
looks. Literals over THRESHOLD become spans of kind literal.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, table

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Score from which a literal counts as a secret.
THRESHOLD = 3.0
#: How much a part of a target name says that its value is secret.
NAMES = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5,
    "auth": 1.5, "bearer": 2.0, "private": 1.5, "access": 1.0, "api": 1.0, "key": 1.5, "signing": 1.0, "encryption": 1.0, "client": 0.5, "session": 0.5,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|example\w*|your[_-].*|test\w*|dummy|none|null|true|false|todo|<.*|\$\{?.*|\{\{.*|%\(.*)$")
_HEXMAP = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_SEP = re.compile(r":=|=>|[=!<>]=|[:=]")
_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
_STRING = re.compile(r"""[ \t]*(?:[brfu]?("|'|`))((?:\\.|(?!\1)[^\\\n])*)\1""")
_BARE = re.compile(r"""[ \t]*([^\s"'`,;#()\[\]{}<>]+)""")
_PLUS = re.compile(r"[ \t]*\+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    whole = "".join(parts[-2:])
    return sum(NAMES.get(p, 0.0) for p in set(parts)) + (NAMES["apikey"] if whole == "apikey" else 0.0)


def literal_score(value: str) -> float:
    if len(value) < 8 or PLACEHOLDER.match(value) or value.isalpha() and value.islower():
        return -3.0
    kinds = bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search(r"\d", value))
    return 0.5 * (len(value) >= 16) + 0.5 * (kinds >= 2) + 0.25 * max(0.0, entropy(value) - 2.5) - 1.5 * (" " in value)


def pairs(text: str):
    """(name, [(value, start, end)], reference): literals assigned to a name, or the name its right side refers to."""
    end = 0
    for m in _SEP.finditer(text):
        if m.start() < end or m[0] in ("==", "!=", "<=", ">="):
            continue
        i = m.start()
        while i and text[i - 1] in " \t":
            i -= 1
        if i and text[i - 1] in "\"'":
            i -= 1
        stop = i
        while i > end and text[i - 1] in _NAME:
            i -= 1
        name = text[i:stop].strip(".-")
        if not name or name[0].isdigit():
            continue
        at, found, ref = m.end(), [], None
        while s := _STRING.match(text, at):
            found.append((s[2], s.start(2), s.end(2)))
            at = s.end()
            if not (p := _PLUS.match(text, at)):
                break
            at = p.end()
        if not found and (b := _BARE.match(text, at)) and not b[1].startswith("//"):
            at, ref = b.end(), b[1]
            found.append((b[1], b.start(1), b.end(1)))
        if found:
            end = at
            yield name, found, ref


def lex(text: str) -> list[tuple[int, int]]:
    """Spans of literals that score THRESHOLD or more at the most sensitive name they reach."""
    constants: dict[str, list] = {}
    best: dict[tuple[int, int], float] = {}
    for name, found, ref in pairs(text):
        found = constants.get(ref, found) if ref else found
        constants[name] = found
        s = name_score(name)
        if s <= 0:
            continue
        whole = literal_score("".join(v for v, _, _ in found))
        for _, a, b in found:
            best[a, b] = max(best.get((a, b), -9.0), s + whole)
    return sorted(k for k, v in best.items() if v >= THRESHOLD)


def find(text: str | None) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of every span of a whole text, in order."""
    if not text:
        return []
    out, low = [], text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if text.encode("utf-8", "surrogatepass").translate(_HEXMAP).find(b"x" * 32) >= 0:
        out += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        out += [(a, 3, b, a, b) for a, b in lex(text)]
    return sorted(out)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with the value of every span replaced; overlapping values become one mark."""
    if not (spans := find(text)):
        return text
    out, at = [], 0
    for a, b in sorted((s[3], s[4]) for s in spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


SPANS = "doc_id long, kind array<string>, start array<long>, end array<long>"


@lean
def _scan(batches):
    for b in batches:
        spans = [find(t) for t in b.column("text").to_pylist()]
        cols = [[KINDS[s[1]] for s in x] for x in spans], [[s[0] for s in x] for x in spans], [[s[2] for s in x] for x in spans]
        kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "kind", "start", "end"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id and the arrays kind, start, end of its spans (code points, end exclusive).

    Null and empty texts have no spans; null ids and repeated rows pass through; other columns are not read.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, SPANS)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the values of secrets replaced in text; n_chars, where present, follows. Nulls stay null."""
    small_batches(docs.sparkSession)
    names = list(docs.columns)

    @lean
    def run(batches):
        for b in batches:
            i = b.schema.get_field_index("text")
            t = pa.array([redact(x) for x in b.column(i).to_pylist()], b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays([t if k == i else b.column(k) for k in range(b.num_columns)], schema=b.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    text = F.transform(F.arrays_zip("kind", "start", "end"), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.array_join(F.filter(text, lambda s: ~s.startswith("literal:")), ",")
    count = lambda k: F.size(F.filter("kind", lambda x: x == k)).cast("long").alias("n_" + k)
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), F.array_join(text, ",").alias("spans"))


def base_digest(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in find(text) if s[1] < 3).encode()).hexdigest()
