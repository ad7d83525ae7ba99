"""Secret scan: base patterns, and an assignment-aware reading of code and
configuration.

The base kinds are plain patterns over the whole text. Beyond them, texts that
hold ``:``, ``=`` or closing tags are read as source or configuration. Name-literal
pairs come from assignments (JSON, YAML, INI, shell, query strings, most
programming languages; with type annotations, subscripts, calls and
concatenations), XML elements and key/value attributes, and YAML block scalars;
literals may be quoted in any way, triple quotes too. A name used in a value
stands for its last binding before the use, or else its first one after it. A
value is scored by its shape, with what its names stand for put in, and by the
sensitivity of the name it ends up in; the literals it is made of are reported
where they are written.

Work is in proportion to the text: a binding is read once, and values of joined
names are kept as counts of characters.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")
# fixed values: the base patterns of the contract
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")                  # the maximal runs of 16 and more
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

# sensitivity of the words in a name, alone or next to each other
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "token": 0.9,
             "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.8,
             "bearer": 0.8, "signature": 0.5, "salt": 0.5, "pin": 0.4, "cookie": 0.5, "session": 0.4}
SENSITIVE_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"),
                   ("encryption", "key"), ("account", "key"), ("connection", "string"), ("auth", "key")}
PLACEHOLDER = re.compile(r"(?i)^(?:.*(?:example|changeme|placeholder|your[_-]|dummy|redacted).*|x+|\*+|<.*>|true|false|"
                         r"null|none|nil|undefined|(.)\1*)$")
LEAST_SCORE = 0.45

# words that make a name speak of a secret instead of holding one
ABOUT = frozenset("label hint prompt message msg help title placeholder error text description field length min max "
                  "url uri file path policy regex pattern name type format count id class style".split())
SCHEME = re.compile(r"(?i)(?:bearer|basic|token)\s+")
WHOLE = 400                                   # joined values up to here are also held against ``PLACEHOLDER``

_STRING = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`"
_ANNOTATION = r"(?:[ \t]*+:[ \t]*+[A-Za-z_][\w.$|?]*+(?:[<\[][^\n=:'\"]*+)?[ \t]*+(?==))?"
_PAIR = re.compile(rf"(?<![\w$.\-])([\"'`]?)([A-Za-z_$][\w$.\-]*+)\1\]?[ \t]*+{_ANNOTATION}(:=|=>|\+=|[:=])(?![:=/])",
                   re.ASCII)
_TERM = re.compile(rf"(?:[rRbBfFuU]{{1,2}}(?=[\"'`]))?(\"{{3}}|'{{3}}|{_STRING})|\$\{{(\w+)\}}|(\$?[A-Za-z0-9_+/=.\-$@!%^*~]++)")
_JOIN = re.compile(r"\+|\.(?=[ \t]*+[\"'`$])")
_STARTS = re.compile(r"[rRbBfFuU]{0,2}[\"']")
_BLANK, _BLANKS = re.compile(r"[ \t]*+(?:\\\r?\n[ \t]*+)?"), re.compile(r"\s*+")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-:]*+)(?:\s[^<>]*+)?>(?:<!\[CDATA\[)?\s*+([^<>]*[^<>\s\]])\s*+(?:\]\]>)?</\1\s*+>", re.ASCII)
_ATTRIBUTES = re.compile(r"\b(?:key|name)\s*+=\s*+([\"'])([A-Za-z_][\w.\-]*+)\1\s++value\s*+=\s*+([\"'])([^\"'\n]++)\3", re.ASCII)
_BLOCK_SIGN = re.compile(r":[ \t]*+[|>][+\-0-9]*+[ \t]*+\r?\n")
_BLOCK = re.compile(r"^([ \t]*+)(?:- )?([\"']?)([A-Za-z_][\w.\-]*+)\2[ \t]*+:[ \t]*+[|>][+\-0-9]*+[ \t]*+\r?\n"
                    r"((?:\1[ \t]++\S[^\n]*+(?:\n|\Z)|[ \t]*+\n)++)", re.ASCII | re.MULTILINE)
_INSIDE = re.compile(r"\$?\{(\w+)\}")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Term(NamedTuple):
    kind: str                                 # string, bare or reference
    value: str
    start: int
    end: int


class Binding(NamedTuple):
    name: str
    at: int
    groups: list[list[Term]]                  # the joined terms of the value, of every argument in a call
    onto: bool = False                        # += : what the name stood for comes first


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    if ABOUT.intersection(words):
        return 0.0
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    return 1.0 if any(p in SENSITIVE_PAIRS for p in zip(words, words[1:])) else best


def counts_score(counts: Counter) -> float:
    """0 to 1 by length, entropy and mix of signs."""
    n = sum(counts.values())
    digit = any(c.isdigit() for c in counts)
    classes = (any(c.islower() for c in counts) + any(c.isupper() for c in counts) + digit
               + any(not c.isalnum() for c in counts))
    if n < 8 or classes < 2 or not digit and classes < 3:
        return 0.0
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    return min(1.0, entropy / 3.5) * min(1.0, 0.4 + min(n, 24) / 40)


def literal_score(value: str) -> float:
    """``counts_score``; 0 for placeholders, addresses and names of secrets. With
    blanks, a value counts by its one long word of two (after a scheme such as
    Bearer) or of a block of lines, or as a passphrase: three words and more with small and
    capital letters and digits that speak of no secret and end as no sentence."""
    value = value.strip()
    if len(value) < 8 or "://" in value or PLACEHOLDER.match(value):
        return 0.0
    words = value.split()
    if len(words) == 1:
        named = value.isidentifier() and any(SENSITIVE.get(w.lower()) for w in _WORDS.findall(value))
        return 0.0 if named and value.isupper() else counts_score(Counter(value))
    words = SCHEME.sub("", value, count=1).split()
    if len(words) <= 2 or "\n" in value:
        return max(literal_score(w) for w in words)
    counts = Counter("".join(words))
    mixed = all(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit))
    prose = value[-1] in ".!?:" or any(SENSITIVE.get(w.lower().strip(",.;:!?()")) for w in words)
    return counts_score(counts) if mixed and not prose else 0.0


def expression(text: str, at: int) -> tuple[list[list[Term]], int]:
    """The value that starts at ``at`` as groups of joined terms, and where it ends.
    What is called is no term, its arguments are groups of their own; a keyword
    argument ends the value, as it is a pair itself."""
    groups, terms, depth = [], [], 0
    while True:
        at = (_BLANKS if depth else _BLANK).match(text, at).end()
        if text.startswith("(", at):
            depth, at = depth + 1, at + 1
            continue
        m = _TERM.match(text, at)
        if m and m[1]:
            if len(m[1]) == 3 and m[1][0] * 3 == m[1]:
                end = text.find(m[1], m.end())
                if end < 0:
                    break
                terms.append(Term("string", text[m.end():end], m.end(), end))
                at = end + 3
            else:
                terms.append(Term("string", m[1][1:-1], m.start(1) + 1, m.end(1) - 1))
                at = m.end()
        elif m and m[2]:
            terms.append(Term("reference", m[2], m.start(2), m.end(2)))
            at = m.end()
        elif m:
            if text.startswith("(", m.end()):
                groups, terms, depth, at = [*groups, terms] if terms else groups, [], depth + 1, m.end() + 1
                continue
            if depth and "=" in m[3]:
                break
            if m[3] in ("new", "await"):
                at = m.end()
                continue
            if m[3] != "+":
                terms.append(Term("bare", m[3], m.start(3), m.end(3)))
            at = m.end()
        while depth and text.startswith(")", b := _BLANKS.match(text, at).end()):
            depth, at = depth - 1, b + 1
        b = (_BLANKS if depth else _BLANK).match(text, at).end()
        joined = _JOIN.match(text, b)
        if joined:
            at = joined.end()
        elif depth and text.startswith(",", b):
            groups, terms, at = [*groups, terms] if terms else groups, [], b + 1
        elif terms and terms[-1].kind == "string" and _STARTS.match(text, b):
            at = b
        else:
            break
    return [g for g in [*groups, terms] if g], at


def bindings_of(text: str) -> list[Binding]:
    """Every binding of a name to a value, by place. What a quoted value holds is not
    read again as assignments."""
    out, done = [], 0
    for m in _PAIR.finditer(text):
        if m.start() < done:
            continue
        groups, end = expression(text, m.end())
        if groups:
            out.append(Binding(m[2], m.start(2), groups, m[3] == "+="))
            last = groups[-1][-1]
            if any(t.kind == "string" for g in groups for t in g):
                done = end
            elif "=" in last.value:                     # a=b=c is one value, a=b='c' two assignments
                done = text.rfind("=", last.start, end - 1) + 1 if text[end:end + 1] in ("'", '"', "`") else end
    found = [(m[1], m.start(), m[2], m.start(2), m.end(2)) for m in _ELEMENT.finditer(text)] if "</" in text else []
    if "value" in text:
        found += [(m[2], m.start(), m[4], m.start(4), m.end(4)) for m in _ATTRIBUTES.finditer(text)]
    if _BLOCK_SIGN.search(text):
        for m in _BLOCK.finditer(text):
            inner = m[4].strip()
            s = m.start(4) + len(m[4]) - len(m[4].lstrip())
            found.append((m[3], m.start(3), "\n".join(line.strip() for line in inner.split("\n")), s, s + len(inner)))
    out += [Binding(name, at, [[Term("string", value, s, e)]]) for name, at, value, s, e in found]
    return sorted(out, key=lambda b: b.at)


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of literals that reach a sensitive name."""
    if ":" not in text and "=" not in text and "</" not in text:
        return []
    bound = bindings_of(text)
    weights = [name_score(b.name) for b in bound]
    if not any(weights):
        return []
    places: dict[str, list[int]] = {}
    for i, b in enumerate(bound):
        places.setdefault(b.name.rpartition(".")[2], []).append(i)

    def meant(name: str, user: int) -> int | None:
        """The last binding of ``name`` before binding ``user``, or else the first after it."""
        known = places.get(name.lstrip("$").rpartition(".")[2])
        if known is None:
            return None
        k = bisect_left(known, user)
        if k:
            return known[k - 1]
        return next((i for i in known[:2] if i != user), None)

    def parts_of(i: int) -> list[list[str | int]]:
        """Each group of binding i as literals and the bindings its names stand for."""
        out = []
        for terms in bound[i].groups:
            earlier = meant(bound[i].name, i) if bound[i].onto else None
            parts: list[str | int] = [] if earlier is None else [earlier]
            for t in terms:
                other = meant(t.value, i) if t.kind != "string" else None
                if other is not None:
                    parts.append(other)
                elif t.kind != "reference":
                    inside = _INSIDE.findall(t.value) if t.kind == "string" else []
                    parts.append(_INSIDE.sub("", t.value) if inside else t.value)
                    parts += [j for name in inside if (j := meant(name, i)) is not None]
            out.append(parts)
        return out

    parts, scores, shapes = {}, {}, {}                   # of the bindings that sensitive names reach

    def finish(i: int) -> None:
        first, scores[i] = None, []
        for group in parts[i]:
            # a name that stands for itself in a circle adds nothing
            made = [(Counter(p), p) if isinstance(p, str) else shapes[p] for p in group if isinstance(p, str) or p in shapes]
            counts = made[0][0] if len(made) == 1 else sum((c for c, _ in made), Counter())
            short = len(made) == 1 or all(v is not None for _, v in made) and sum(len(v) for _, v in made) <= WHOLE
            value = "".join(v for _, v in made) if short and made and made[0][1] is not None else None
            scores[i].append(counts_score(counts) if value is None else literal_score(value))
            first = first or (counts, value)
        shapes[i] = first or (Counter(), "")

    for root in (i for i, w in enumerate(weights) if w):
        open_ = [root]
        while open_:
            i = open_[-1]
            if i in parts:
                open_.pop()
                if i not in shapes:
                    finish(i)
                continue
            parts[i] = parts_of(i)
            open_ += [p for group in parts[i] for p in group if not isinstance(p, str) and p not in parts]

    def written(t: Term, i: int) -> bool:
        """Whether the term holds more of the value than names and a scheme."""
        if t.kind == "string":
            own = _INSIDE.sub("", t.value).strip()
            return bool(own) and not SCHEME.fullmatch(own + " ")
        return t.kind == "bare" and meant(t.value, i) is None

    out, seen = set(), set()
    todo = [(i, g) for i, w in enumerate(weights) if w for g, x in enumerate(scores[i]) if w * x >= LEAST_SCORE]
    while todo:
        node = todo.pop()
        if node in seen:
            continue
        seen.add(node)
        i, g = node
        out.update((t.start, t.end, "literal") for t in bound[i].groups[g] if written(t, i))
        for j in parts[i][g]:
            if not isinstance(j, str):
                todo += [(j, h) for h, x in enumerate(scores[j]) if x or len(scores[j]) == 1]
    return list(out)


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """All spans by start, then kind in the order of ``KINDS``, then end."""
    return sorted(base_spans(text) + literal_spans(text), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every whole text, in code
    points, end exclusive. A null or empty text has none; rows are kept as they
    come, other columns are not read, an empty table gives an empty one."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"doc_id": d.as_py(), "spans": [{"kind": k, "start": s, "end": e}
                                                   for s, e, k in spans_of(t.as_py() or "")]}
                    for d, t in zip(batch.column(0), batch.column(1))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for s, e, _ in spans_of(text):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mark``; all other columns
    and all rows stay, a null text stays null."""
    @F.pandas_udf("string")
    def masked(text):
        return text.map(lambda t: t if t is None else redact_text(t, mark))
    return docs.withColumn("text", masked("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    def listed(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def only(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(only(k) for k in KINDS[:3]),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "literal")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))
