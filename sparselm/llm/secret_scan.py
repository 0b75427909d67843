"""Secret scans through a trigram inverted index (operator 6).

Each rule's regular expression gives a Boolean trigram query.  Every Arrow
slice of documents is an index shard: postings of the trigrams that any query
names are built in one numpy pass, lists are intersected from the shortest, and
only the candidates are verified with the expression itself.  Rules without a
mandatory trigram scan every text.  The index never leaves its task: there is
no shuffle and nothing grows with a trigram's frequency.

Spans are (kind, start, end) in code points, end exclusive, leftmost and
non-overlapping per kind.  A null text counts as empty and has none; masking
leaves it null.  Repeated rows are scanned each; other columns pass through
untouched whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparselm.llm import textblock
from sparselm.llm.trigrams import TrigramIndex, slot_table, trigram_query, trigrams_in

MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0              # the group whose length counts
    least: int = 0              # its least length; shorter matches are dropped
    head: str = ""              # a run of these before the pattern, from its first letter
                                # on, belongs to the match and is needed (two or more)


BASE_RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# well-known credential formats
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?ai:bearer) [A-Za-z0-9._~+/-]{20,}"),
    Rule("url_login", r"://[^\s:/@]++:[^\s:/@]++@",
         head="abcdefghijklmnopqrstuvwxyz0123456789+.-"),
)
RULES = BASE_RULES + MORE_RULES


def _matches(rule: Rule, expr: re.Pattern, s: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in expr.finditer(s):
        if rule.head:
            run = s[done:m.start()]
            run = run[len(run.rstrip(rule.head)):].lstrip("0123456789+.-")
            done = m.end()
            if len(run) >= 2:
                yield m.start() - len(run), m.end()
        elif m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.start(), m.end()


class _Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(_whole(r)), trigram_query(r.pattern)) for r in rules]
        self.slot, self.number = slot_table(
            set().union(*(trigrams_in(q) for _, _, q in self.rules)))

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per text its spans as (start, rule number, end), sorted."""
        data, off = textblock.block(texts)
        index = TrigramIndex(data, off, self.slot, len(self.number))
        strings: dict[int, str] = {}
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        for k, (rule, expr, query) in enumerate(self.rules):
            for i in index.matching(query, self.number).tolist():
                if i not in strings:
                    strings[i] = texts[i].as_py() or ""
                out[i] += [(a, k, b) for a, b in _matches(rule, expr, strings[i])]
        for spans in out:
            spans.sort()
        return out


def _whole(rule: Rule) -> str:
    """A lone repeated set may ask for its least length at once: a run that is
    too short fails as a whole either way, and no partial match is kept."""
    m = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{m[1]}{{{rule.least},}}" if m and rule.group == 0 and rule.least else rule.pattern


_scanners: dict[tuple, _Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> _Scanner:
    if rules not in _scanners:
        _scanners[rules] = _Scanner(rules)
    return _scanners[rules]


def _scan_pass(rules: tuple[Rule, ...], mask: str | None):
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for whole in batches:
            for b in textblock.text_slices(whole, "text"):
                texts = b.column("text")
                found = scanner.scan(texts)
                spans = pa.array(
                    [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in f] for f in found],
                    pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                        ("end", pa.int64())])))
                cols, names = [b.column("row"), spans], ["row", "spans"]
                if mask is not None:
                    cols.append(pa.array([masked(t, f, mask) if f else t for t, f in
                                          zip(texts.to_pylist(), found)], pa.string()))
                    names.append("masked")
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = MASK) -> str:
    """The text with every maximal run of spans replaced."""
    out, at, until = [], 0, -1
    for start, _, end in spans:
        if start >= until:
            out.append(text[at:start])
            out.append(mask)
        until = max(until, end)
        at = until
    out.append(text[at:])
    return "".join(out)


def masked_or_null(text: Column, rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> Column:
    """The text with its secrets replaced; null where it has none (or is null).
    Only the text travels to Python, and only changed texts come back."""
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = _scanner(rules)
        for texts in batches:
            out = []
            for part in textblock.array_slices(texts):
                out += [masked(part[i].as_py(), spans, mask) if spans else None
                        for i, spans in enumerate(scanner.scan(part))]
            yield pa.array(out, pa.string())
    return run(text)


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                 mask: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """(row: the columns ``keep`` of ``docs``, by default all; spans: array of
    kind, start, end, sorted by start and rule; with ``mask`` also the masked
    text)."""
    src = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col(text_col).alias("text"))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()),
                                     T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType())]))
    fields = [src.schema["row"], T.StructField("spans", span)]
    if mask is not None:
        fields.append(T.StructField("masked", T.StringType()))
    return src.mapInArrow(_scan_pass(tuple(rules), mask), T.StructType(fields))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    base = [r.kind for r in BASE_RULES]
    some = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    line = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                     s["end"].cast("string"))), ",")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(line(some).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"))
