"""Secret scan: base patterns, and multipart credentials whose weak parts are reported only where they occur together.

Each whole text is scanned for parts in three roles: identifiers (key ids, named accounts), secrets (named values, tokens
of mixed characters, short hexadecimals, passwords inside urls) and endpoints (urls, named hosts, addresses). Matches of the base
patterns are parts too. A part of its own says little, so weak ones wait for their complement: a secret's scope reaches REACH
code points to both sides, not over blank lines, `[section]` headings or `---` lines, and an interval join on (document,
bin of REACH code points) brings the identifiers and endpoints that start in it. A secret is a credential if its
weight and those of the heaviest identifier and endpoint there come to NEEDED, and it has at least one of the two. Then
the secret and the identifiers of its scope are linked; what the base patterns have already is not said again.

A secret meets only parts within its scope, so pairs grow with the text's length, however many parts a document has; bins spread a long
document over tasks. Defined cases: null text is empty; repeated rows and null ids are rows of their own; input columns named
like an output column are replaced; an empty table gives no rows. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import Scratch, chunks, ship, text_bytes

REACH, NEEDED = 300, 3
KINDS = ("assign", "access", "hex", "id", "secret")  # the order of spans that start together
#: Base patterns, the group that is measured, and the least length of a match that stays.
BASE = (
    ("assign", re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(rb"[0-9a-f]{32,}"), 0, 32),
)
_IS = rb"""["']?\x20*[:=]\x20*["']?"""
_NAMED = rb"(?<![A-Za-z])(?i:%s)" + _IS
_NEEDS = {"assign": (b":", b"="), "access": (b"AKIA",), "hex": (b"",)}  # a text without any of them has no match
_URL, _SIGN, _KEYS, _ANY = (b"://",), (b":", b"="), (b"AKIA", b"ASIA", b"AROA", b"AIDA", b"AGPA"), (b"",)
#: Weak parts, first come first served: role, weight, what a text needs, pattern; group 1 is the part. Secrets without a name come last.
WEAK = (
    ("secret", 2, _URL, re.compile(rb"[A-Za-z][A-Za-z0-9+.-]{1,19}://[^\s:/@\"'<>]+:([^\s:/@\"'<>]{3,})@")),
    ("id", 1, _URL, re.compile(rb"[A-Za-z][A-Za-z0-9+.-]{1,19}://([^\s:/@\"'<>]+):[^\s:/@\"'<>]{3,}@")),
    ("id", 2, _KEYS, re.compile(rb"(?<![A-Za-z0-9])((?:AKIA|ASIA|AROA|AIDA|AGPA)[A-Z0-9]{12,})(?![A-Za-z0-9])")),
    ("id", 2, _SIGN, re.compile(_NAMED % rb"(?:aws_)?access_?key_?id|key_?id|client_?id|app_?id|tenant_?id" + rb"([A-Za-z0-9._@+-]{4,})")),
    ("id", 1, _SIGN, re.compile(_NAMED % rb"user(?:_?name)?|login|account|uid|e-?mail" + rb"([A-Za-z0-9._@+-]{3,})")),
    ("secret", 2, _SIGN, re.compile(_NAMED % rb"pass(?:_?phrase|code)?|pwd|pin|credentials?|auth(?:_?key)?|(?:secret|private|access|account|shared|signing)_?key|client_?secret|password|passwd|secret|token" + rb"([^\s\"',;<>]{4,})")),
    ("endpoint", 1, _URL, re.compile(rb"([A-Za-z][A-Za-z0-9+.-]{1,19}://[^\s\"'<>]{3,})")),
    ("endpoint", 1, _SIGN, re.compile(_NAMED % rb"host(?:_?name)?|endpoint|server|base_?url|url|uri|addr(?:ess)?" + rb"([A-Za-z0-9._:/-]{4,})")),
    ("endpoint", 1, (b":",), re.compile(rb"(?<![\d.])((?:\d{1,3}\.){3}\d{1,3}:\d{2,5})(?!\d)")),
    ("secret", 1, _ANY, re.compile(rb"(?<![A-Za-z0-9+/_.=-])([A-Za-z0-9+/_-]{20,}={0,2})(?![A-Za-z0-9+/_.=-])")),
    ("secret", 1, _ANY, re.compile(rb"(?<![A-Za-z0-9])([0-9a-f]{16,31})(?![A-Za-z0-9])")),
)
_ROLES = {"assign": ("secret", 2), "access": ("id", 2), "hex": ("secret", 1)}  # of base matches
_EDGE = re.compile(rb"\n[ \t\r]*\n|\n(?=\[[^\]\n]{1,80}\][ \t\r]*(?:\n|$))|\n-{3,}[ \t\r]*(?=\n|$)")
_INNER = bytes(range(0x80, 0xC0))


def mixed(token: bytes) -> bool:
    """Whether a token without a name looks made by chance: letters and digits, at 3 bits a character or more (2.5 if hexadecimal)."""
    if not (re.search(rb"\d", token) and re.search(rb"[A-Za-z]", token)):
        return False
    short = re.fullmatch(rb"[0-9a-f]+", token) is not None
    if not short and not (re.search(rb"[a-z]", token) and re.search(rb"[A-Z]", token)):
        return False
    counts = Counter(token).values()
    return -sum(n / len(token) * log2(n / len(token)) for n in counts) >= (2.5 if short else 3.0)


def _points(text: bytes, at: list[int]) -> dict[int, int]:
    """Code points before each of these byte offsets."""
    out, last, n = {}, 0, 0
    for i in sorted(set(at)):
        n += len(text[last:i].translate(None, _INNER))
        last = i
        out[i] = n
    return out


def base_matches(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start, then kind as listed."""
    found = [(k, m.start(), m.end()) for k, pattern, group, least in BASE if any(x in text for x in _NEEDS[k]) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan_text(text: bytes) -> tuple[list[dict], list[dict]]:
    """The base spans of a text, and its parts with their role, weight and the bounds (low, high) of their block, in code points.

    Without a secret and a complement there is nothing to link, and no parts are given.
    """
    base = base_matches(text)
    parts = [(_ROLES[k][0], _ROLES[k][1], a, b, False) for k, a, b in base]
    taken, least = sorted((a, b) for _, a, b in base), []
    for a, b in taken:  # spans of different base kinds may overlap: merged
        if least and a < least[-1][1]:
            least[-1] = (least[-1][0], max(b, least[-1][1]))
        else:
            least.append((a, b))
    starts, ends = [a for a, _ in least], [b for _, b in least]
    urls: list[tuple[int, int]] = []
    for role, weight, needs, pattern in WEAK:
        if needs is _ANY and all(p[0] == "secret" for p in parts):
            break  # nothing to link to
        if not any(x in text for x in needs):
            continue
        fresh = []
        for m in pattern.finditer(text):
            a, b = m.span(1)
            if role == "endpoint":  # holds other parts: it only gives way to other endpoints
                i = bisect_right(urls, (a, len(text)))
                if i and urls[i - 1][1] > a or i < len(urls) and urls[i][0] < b:
                    continue
                urls.insert(i, (a, b))
                parts.append((role, weight, a, b, True))
                continue
            i = bisect_right(ends, a)
            if i < len(starts) and starts[i] < b or role == "secret" and weight == 1 and not mixed(m.group(1)):
                continue
            if role == "secret" and weight == 1 and (i := bisect_right(urls, (a, len(text)))) and urls[i - 1][1] > a:
                continue  # a long word of a url
            fresh.append((a, b))
            parts.append((role, weight, a, b, True))
        if fresh:
            least = sorted([*zip(starts, ends), *fresh])
            starts, ends = [a for a, _ in least], [b for _, b in least]
    roles = {p[0] for p in parts}
    if "secret" not in roles or len(roles) < 2:
        parts = []
    edges = [m.start() for m in _EDGE.finditer(text)] if parts else []
    blocks = []
    for _, _, a, _, _ in parts:
        i = bisect_right(edges, a)
        blocks.append((edges[i - 1] if i else 0, edges[i] if i < len(edges) else len(text)))
    at = _points(text, [x for _, a, b in base for x in (a, b)] + [x for p in parts for x in p[2:4]] + [x for b in blocks for x in b])
    spans = [{"kind": k, "start": at[a], "end": at[b]} for k, a, b in base]
    return spans, [{"role": r, "weight": w, "start": at[a], "end": at[b], "low": at[lo], "high": at[hi], "weak": weak} for (r, w, a, b, weak), (lo, hi) in zip(parts, blocks)]


_SPAN = "array<struct<kind:string,start:long,end:long>>"
_PARTS = "array<struct<role:string,weight:int,start:long,end:long,low:long,high:long,weak:boolean>>"
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_ARROW_PART = pa.list_(pa.struct([("role", pa.string()), ("weight", pa.int32()), *((n, pa.int64()) for n in ("start", "end", "low", "high")), ("weak", pa.bool_())]))


def _link(parts: DataFrame, reach: int, needed: int) -> DataFrame:
    """(uid, linked) of parts (uid, role, weight, start, end, low, high, weak): the weak parts of credentials."""
    inside = {"lo": F.greatest("low", F.col("start") - reach), "hi": F.least("high", F.col("end") + reach)}
    secret = parts.filter("role = 'secret'").select("uid", F.col("start").alias("s"), F.col("end").alias("e"), "weight", "weak", *[x.alias(n) for n, x in inside.items()])
    secret = secret.withColumn("bin", F.explode(F.sequence(F.expr(f"lo div {reach}"), F.expr(f"hi div {reach}"))))
    other = parts.filter("role != 'secret'").select("uid", "role", F.col("weight").alias("w"), "start", "end", F.col("weak").alias("o_weak"), F.expr(f"start div {reach}").alias("bin"))
    met = secret.join(other.hint("merge"), ["uid", "bin"]).filter("start >= lo AND start < hi")
    weights = [F.coalesce(F.max(F.when(F.col("role") == r, F.col("w"))), F.lit(0)).alias(r) for r in ("id", "endpoint")]
    ids = F.collect_set(F.when((F.col("role") == "id") & F.col("o_weak"), F.struct(F.lit("id").alias("kind"), "start", "end"))).alias("ids")
    scored = met.groupBy("uid", "s", "e", "weight", "weak").agg(*weights, ids).filter(F.col("weight") + F.col("id") + F.col("endpoint") >= needed)
    own = F.when(F.col("weak"), F.array(F.struct(F.lit("secret").alias("kind"), F.col("s").alias("start"), F.col("e").alias("end")))).otherwise(F.array())
    spans = scored.select("uid", F.explode(F.concat("ids", own)).alias("span")).distinct()
    return spans.groupBy("uid").agg(F.collect_list("span").alias("linked_spans"))  # of one document


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, reach: int = REACH, needed: int = NEEDED) -> DataFrame:
    """`keep` columns (default: all but the text), base_spans and linked_spans (arrays of kind, start, end), each in order of start and kind."""
    ship(__name__)
    scratch = Scratch(docs.sparkSession, "secrets")
    keep = [c for c in (keep if keep is not None else docs.columns) if c in docs.columns and c != text_col and c.lower() not in ("base_spans", "linked_spans")]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(keep)], F.monotonically_increasing_id().alias("uid"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = T.StructType([*inner.schema.fields[:-1], *T.StructType.fromDDL(f"base_spans {_SPAN}, parts {_PARTS}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, len(keep) + 1):
                base, parts = zip(*(scan_text(t) for t in text_bytes(part.column(len(keep) + 1))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(base, _ARROW_SPAN), pa.array(parts, _ARROW_PART)], names=schema.names)

    rows = scratch.write(inner.mapInArrow(run, schema))
    linked = scratch.write(_link(rows.filter("size(parts) > 0").select("uid", F.inline("parts")), reach, needed))
    out = rows.join(linked, "uid", "left")
    place = F.array(*[F.lit(k) for k in KINDS])
    spans = F.coalesce("linked_spans", F.expr(f"CAST(array() AS {_SPAN})"))
    ordered = F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(place, x["kind"]).alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(keep)], "base_spans", ordered.alias("linked_spans"))
