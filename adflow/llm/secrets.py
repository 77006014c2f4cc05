"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by its content: the blob id is the
SHA-256 of its text, so copies and unchanged versions are one blob. The ledger
says which (blob, rule version) pairs have been scanned and what was found. A
scan takes only the pairs that are not in it, each blob once, whatever the
number of paths that hold it, and joins the findings back to all paths.

A ledger is a table of (blob, rules, spans): one row for each scan of a blob,
with the rule versions that were run and the spans found. ``scan`` returns the new
rows, ``append`` writes them behind the earlier ones. A rule's version is a digest
of its definition, so an edited rule is scanned again and an unedited one is not.

Spans are code point offsets [start, end) of the match (or of the rule's span group). A
rule's matches are leftmost and non-overlapping; those below its least length are
dropped after matching. Kinds assign, access and hex are the base; the others come
on top. Every rule reads a text in time linear in its length.

Defined results: a null text counts as empty, a null id is an id like any other. Ties in
start are ordered by the rule order. Very long texts are searched whole, in one task
each. Repeated rows give repeated results; an empty table gives an empty one. Columns
are taken by name into fresh ones, so that other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import checkpoint
from .common import slices, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``least`` characters in group ``measured`` are needed; group ``span`` is what is
    reported. ``hints`` (lower case): a text without any of them cannot match and is
    not searched."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 1
    any_case: bool = False
    hints: tuple[str, ...] = ()
    span: int = 0

    @property
    def version(self) -> str:
        what = f"{self.pattern}\n{self.measured}\n{self.least}\n{self.any_case}" + (f"\n{self.span}" if self.span else "")
        return f"{self.kind}@{hashlib.sha256(what.encode()).hexdigest()[:12]}"

    def compiled(self):
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 8, True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, False, ("akia",)),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # the maximal runs of [0-9a-f]+ with 32 or more
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False, ("private key-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, False, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    # A run of the alphabet is looked at from its start and only if two more parts follow
    # it, so that a long run of "eyJ" is read once and not from each of them.
    Rule("jwt", r"(?<![\w-])(?=[\w-]++\.eyJ[\w-]++\.[\w-])[\w-]*?(eyJ[\w-]++\.eyJ[\w-]++\.[\w-]++)", 1, 1, False, ("eyj",), 1),
)
RULES = BASE_RULES + MORE_RULES

SPANS = "array<struct<start: long, rank: int, kind: string, end: long>>"
LEDGER = f"blob string, rules array<string>, spans {SPANS}"


def find_spans(text: str, rules, patterns) -> list[tuple[int, int, str, int]]:
    """(start, rank of the rule, kind, end) of every finding, by start and rank."""
    low = text.lower()
    out = []
    for rank, (rule, pattern) in enumerate(zip(rules, patterns)):
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        for m in pattern.finditer(text):
            if m.end(rule.measured) - m.start(rule.measured) >= rule.least:
                out.append((m.start(rule.span), rank, rule.kind, m.end(rule.span)))
    return sorted(out)


def blob_id(text: str = "text") -> Column:
    return F.sha2(text_or_empty(f"`{text}`"), 256)


def _scanner(rules: tuple[Rule, ...]):
    def run(batches):
        import pyarrow as pa

        patterns = [r.compiled() for r in rules]
        places = {r.version: i for i, r in enumerate(rules)}
        kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())]))
        for b in (part for whole in batches for part in slices(whole)):
            found = []
            for text, todo in zip(b.column("text").to_pylist(), b.column("todo").to_pylist()):
                pick = [places[v] for v in todo]
                spans = find_spans(text, [rules[i] for i in pick], [patterns[i] for i in pick])
                found.append([{"start": s, "rank": pick[r], "kind": k, "end": e} for s, r, k, e in spans])
            yield pa.RecordBatch.from_arrays(
                [b.column("blob"), b.column("todo"), pa.array(found, kind)], names=["blob", "rules", "spans"])

    return run


def scan(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text",
         rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: the (blob, rule version) pairs of ``versions`` that are not
    in ``ledger``, scanned once each."""
    wanted = F.array(*[F.lit(r.version) for r in rules])
    blobs = versions.select(blob_id(text).alias("blob"), text_or_empty(f"`{text}`").alias("text"))
    if ledger is None:
        todo = blobs.withColumn("todo", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = (blobs.join(seen, "blob", "left")
                .withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
                .filter(F.size("todo") > 0))
    once = todo.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    return once.mapInArrow(_scanner(rules), LEDGER)


def append(rows: DataFrame, path: str) -> None:
    """Put new ledger rows behind those at ``path`` (a shared folder)."""
    rows.write.mode("append").parquet(path)


def spans_by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): what the given rule versions found, by start and rule order.
    A span counts if its ledger row ran the current version of its rule."""
    current = F.array(*[F.lit(r.version) for r in rules])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    ran = ledger.filter(F.arrays_overlap("rules", current)).withColumn(
        "ran", F.transform(F.array_intersect("rules", current), lambda v: F.substring_index(v, "@", 1)))
    mine = ran.withColumn("spans", F.filter("spans", lambda s: F.array_contains("ran", s["kind"])))
    return mine.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans")).select(
        "blob", F.array_sort(F.transform("spans", lambda s: F.struct(
            s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"),
            s["kind"].alias("kind"), s["end"].alias("end")))).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text",
                   doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(result, new ledger rows). The result has one row per row of ``docs``: id,
    n_assign, n_access, n_hex, base_sha256 (of the base spans as text), spans."""
    new = checkpoint(scan(docs, ledger, text))
    known = new if ledger is None else ledger.unionByName(new)
    paths = checkpoint(docs.select(F.col(f"`{doc_id}`").alias("id"), blob_id(text).alias("blob")))
    spans = checkpoint(spans_by_blob(known))
    base = F.filter("spans", lambda s: s["rank"] <= len(BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    report = spans.select("blob", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
                          F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
    return paths.join(report, "blob").select(F.col("id").alias(doc_id), "n_assign", "n_access", "n_hex",
                                             "base_sha256", "spans"), new
