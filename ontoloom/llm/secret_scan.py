"""Secret scans: base patterns, and weak parts of credentials that count only next to their complement.

Weak parts: identifiers (user or client names given by assignment), secrets (runs of 20+ characters that mix cases and
digits) and endpoints (URLs with a scheme and host). An interval join within each scope (a paragraph) links a weak secret
with an identifier or endpoint at most WINDOW characters away, found by bisection; only linked parts become spans.
Null text counts as empty; long texts are scanned whole; repeated rows each give a row; other columns are not read.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa

from ontoloom.llm.common import table

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
WEAK_ID = re.compile(r"""(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.I | re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/])(?=[a-z+/A-Z]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{20,}", re.A)
ENDPOINT = re.compile(r"[a-z][a-z0-9+]{1,9}://[A-Za-z0-9.-]+(?::[0-9]+)?", re.A)
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
WINDOW = 400


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def linked_spans(text: str, base: list) -> list[tuple[int, int, int]]:
    """Weak parts with a complement in the same paragraph and window; a base span also counts as the complement of its side."""
    secrets = [(m.start(), 4, m.end()) for m in WEAK_SECRET.finditer(text)]
    names = [(m.start(), 3, m.end()) for m in WEAK_ID.finditer(text)]
    ends = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)] if secrets or base else []
    if not (secrets or base) or not (names or ends or base):
        return []
    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
    left = sorted(secrets + [b for b in base if b[1] != 1])
    right = sorted(names + ends + [b for b in base if b[1] == 1])

    scope = lambda x: bisect.bisect(breaks, x[0])

    def near(spans, others):
        starts, tops = [o[0] for o in others], []  # tops: the largest end so far in the scope of each
        for k, o in enumerate(others):
            tops.append(max(o[2], tops[-1]) if k and scope(others[k - 1]) == scope(o) else o[2])
        for x in spans:
            k, at = bisect.bisect_left(starts, x[0]), scope(x)
            before = k > 0 and scope(others[k - 1]) == at and x[0] - tops[k - 1] <= WINDOW
            if before or k < len(others) and scope(others[k]) == at and starts[k] - x[2] <= WINDOW:
                yield x

    return sorted([*near(secrets, right), *near(names + ends, left)])


def scan_secrets(df, id_col="doc_id", text_col="text"):
    """id, base and linked: arrays of struct<start, kind, end> (code points, end exclusive)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def scan(batches):
        for b in batches:
            base = [base_spans(t or "") for t in b.column(1).to_pylist()]
            linked = [linked_spans(t or "", x) for t, x in zip(b.column(1).to_pylist(), base, strict=True)]
            cols = [pa.array([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in x] for x in v], kind) for v in (base, linked)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["_id", "base", "linked"])

    source = df.select(df[id_col].alias("_id"), df[text_col].alias("_text"))
    span = "array<struct<start:bigint,kind:string,end:bigint>>"
    return source.mapInArrow(scan, f"_id {source.schema[0].dataType.simpleString()}, base {span}, linked {span}").withColumnRenamed("_id", id_col)


def op1_secret_scan(spark, sf_dir):
    order = ",".join(f"'{k}'" for k in KINDS)
    said = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    ranked = f"transform(array_sort(transform(concat(base, linked), x -> struct(x.start, array_position(array({order}), x.kind), x.end, x.kind))), y -> struct(y.start as start, y.kind as kind, y.end as end))"
    counts = [f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint) as n_{k}" for k in KINDS[:3]]
    return scan_secrets(table(spark, sf_dir, "documents")).selectExpr("doc_id", *counts, f"sha2({said.format('base')}, 256) as base_sha256", f"{said.format(ranked)} as spans", "cast(size(linked) as bigint) as n_linked")
