"""Secret scans with one combined deterministic automaton.

All rules are compiled into a single minimal automaton of their mirror images, which reads
every byte once, from the end of the text to its start, and so marks each position where a
match of some rule begins.  From the leftmost marked position the rule's own automaton gives
the longest match; the search goes on behind it, which is the leftmost, non-overlapping order.
Matches that are too short are dropped after they have consumed their text.

Each text is read whole in Arrow batches; nothing is shuffled.  Long texts are cut into
chunks that are read side by side, with entry states that are checked, so cost is linear.

Edge cases: null and empty texts have no spans; positions are code points, the end
exclusive; repeated rows give repeated results; an empty table gives an empty result; a very long text
is a block of its own (about 18 times its bytes); extra columns are ignored by ``report`` and stay in ``redacted``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from . import automaton, textbuf


@dataclass(frozen=True)
class Rule:
    """``least`` is the smallest length of a match without its ``head``."""

    name: str
    pattern: str
    least: int = 1
    head: str = ""
    fold_head: bool = False


#: The base rules (fixed forms), then those this operator adds.
BASE = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 6, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        heads = [automaton.parse(r.head, r.fold_head) for r in rules]
        trees = [("seq", [h, automaton.parse(r.pattern)]) for h, r in zip(heads, rules, strict=True)]
        self.all = automaton.compile_rules([automaton.mirrored(t) for t in trees], search=True)
        self.own = [automaton.compile_rules([t], search=False) for t in trees]
        self.head = [automaton.compile_rules([h], search=False) if r.head else None for h, r in zip(heads, rules, strict=True)]

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start byte, rule number, end byte) of each text's spans, sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        joined = bytes([automaton.BREAK]).join([*texts, b""])
        if len(joined) <= len(texts):
            return out
        data = np.frombuffer(joined, np.uint8)
        mask = self.all.accept[automaton.run_backward(self.all, data)]
        at = np.flatnonzero(mask)
        if not len(at):
            return out
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        doc = np.searchsorted(begins, at, "right") - 1
        masks = mask[at]
        for k, rule in enumerate(self.rules):
            mine = np.flatnonzero(masks >> k & 1)
            done = -1
            places, docs = at[mine], doc[mine]
            i = 0
            while i < len(places):
                s = int(places[i])
                done = automaton.longest(self.own[k], joined, s)
                size = done - (automaton.longest(self.head[k], joined, s) if rule.head else s)
                if size >= rule.least:
                    d = int(docs[i])
                    out[d].append((s - int(begins[d]), k, done - int(begins[d])))
                i = max(i + 1, int(np.searchsorted(places, done)))
        return [sorted(x) for x in out]

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """As scan(), in code points."""
        found = self.scan(texts)
        for d, spans in enumerate(found):
            if spans and not texts[d].isascii():
                raw = np.frombuffer(texts[d], np.uint8)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                found[d] = [(int(chars[a]), k, int(chars[b])) for a, k, b in spans]
        return found


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def _reporter(bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner: Scanner = bc.value
        names = [r.name for r in scanner.rules]
        for b in textbuf.blocks(batches):
            found = scanner.spans(_texts(b.column("text")))
            label = [[f"{names[k]}:{s}:{e}" for s, k, e in x] for x in found]
            base = [",".join(t for t, (_, k, _) in zip(x, f, strict=True) if k < len(BASE)) for x, f in zip(label, found, strict=True)]
            cols = {"doc_id": b.column("doc_id")}
            for k, r in enumerate(BASE):
                cols[f"n_{r.name}"] = pa.array([sum(x[1] == k for x in f) for f in found], pa.int64())
            cols["base_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string())
            cols["spans"] = pa.array([",".join(x) for x in label], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return run


def report(spark: SparkSession, documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as ``kind:start:end``."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return textbuf.small_batches(rows).mapInArrow(_reporter(spark.sparkContext.broadcast(Scanner())), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The documents with each (merged) span replaced by its kind in angle brackets; other texts and columns stay,
    but for ``n_chars``: where that is an int or a long, a changed text's length is put there (a null stays)."""
    counted = any(f.name == "n_chars" and f.dataType in (IntegerType(), LongType()) for f in documents.schema.fields)
    bc = spark.sparkContext.broadcast(Scanner())
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner: Scanner = bc.value
        for b in textbuf.blocks(batches):
            texts = _texts(b.column("text"))
            found = scanner.scan(texts)
            if any(found):
                new = b.column("text").to_pylist()
                for d, spans in enumerate(found):
                    if spans:
                        out, pos = [], 0
                        for s, k, e in spans:
                            if s >= pos:
                                out += [texts[d][pos:s], f"<{scanner.rules[k].name}>".encode()]
                            pos = max(pos, e)
                        new[d] = b"".join([*out, texts[d][pos:]]).decode()
                cols = [pa.array(new, b.schema.field("text").type) if c == "text" else b.column(c) for c in names]
                if counted:
                    i = names.index("n_chars")
                    counts = cols[i].to_pylist()
                    for d, spans in enumerate(found):
                        if spans and counts[d] is not None:
                            counts[d] = len(new[d])
                    cols[i] = pa.array(counts, b.schema.field("n_chars").type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return textbuf.small_batches(documents).mapInArrow(run, documents.schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same rows in DuckDB: between two matches of a rule lies a piece of the text split at its matches."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for k, r in enumerate(RULES):
        head = f"(?i:{r.head})" if r.fold_head else r.head
        body = "[0-9a-f]+" if r.name == "hex" else r.pattern
        tail = f"length(m[i]) - length(regexp_extract(m[i], {quoted('^' + head)}))" if r.head else "length(m[i])"
        parts.append(
            f"select doc_id, {k} as k, '{r.name}' as kind, list_sum(list_transform(p[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) as s, length(m[i]) as n "
            f"from (select doc_id, regexp_extract_all(t, {quoted(head + body)}) as m, string_split_regex(t, {quoted(head + body)}) as p from d), unnest(range(1, len(m) + 1)) as u(i) where {tail} >= {r.least}"
        )
    count = ", ".join(f"count(*) filter (where k = {k}) as n_{r.name}" for k, r in enumerate(BASE))
    zero = ", ".join(f"coalesce(n_{r.name}, 0) as n_{r.name}" for r in BASE)
    label = "kind || ':' || s::bigint || ':' || (s + n)::bigint"
    return (
        "with d as (select doc_id, coalesce(text, '') as t from documents), f as (" + " union all ".join(parts) + f"), "
        f"g as (select doc_id, {count}, string_agg({label}, ',' order by s, k) filter (where k < {len(BASE)}) as base, string_agg({label}, ',' order by s, k) as spans from f group by doc_id) "
        f"select d.doc_id, {zero}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)"
    )


OP9_SQL = _sql()
