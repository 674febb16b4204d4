"""Secret scans by one combined automaton.

All rules are compiled into a single minimal automaton of transition arrays (``regexdfa``), and each text is read once,
byte by byte, whatever the number of rules. Where the automaton accepts, the rule's reversed automaton walks back to
the leftmost start after that rule's previous match, and its anchored automaton walks on to the longest end; both touch
only the bytes of the match. A rule whose walks on end in vain is looked for backwards once in such a text, so hostile texts
take linear time too. Matches of a rule don't overlap; matches of different rules may.

Nothing is shuffled: the scan is a narrow ``mapInArrow`` that streams batches, so memory is a batch and the tables
(some hundred KB), and a lost executor costs only its own partitions.

Defined results: a null or empty text has no spans; repeated rows give repeated results; other columns, whatever their
names, are left out of the result; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.llm.regexdfa import Dfa, compile_rules


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; those that ``keep`` (a Python pattern on the match) doesn't accept are dropped.

    A dropped match still uses up its text. ``probe``: a pattern for the combined automaton that every match begins
    with, in place of one with long counted repeats, to keep that automaton small.
    """

    kind: str
    pattern: str
    keep: str = ""
    fold: bool = False
    probe: str = ""


_KEYS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?"

#: The contract's kinds, in its order. A run of hex or of an access key is maximal, so its least length can be counted
#: in the pattern; a short value of an assignment uses up its text, so it is matched and then dropped.
BASE_RULES = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", keep=_ASSIGN + "([A-Za-z0-9+/_.=-]{6,})"),
    Rule("access", "AKIA[A-Z0-9]{16,}", probe="AKIA[A-Z0-9]"),
    Rule("hex", "[0-9a-f]{24,}", probe="[0-9a-f]{8}"),
)
#: What the method adds: shapes that hardly occur by chance.
MORE_RULES = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36}", probe="gh[opsur]_[A-Za-z0-9]"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}", probe="AIza[0-9A-Za-z_-]{3}"),
    Rule("slack", "xox[abprs]-[0-9]{6,}-[A-Za-z0-9-]{10,}", probe="xox[abprs]-[0-9]"),
    Rule("stripe", "[rs]k_live_[0-9A-Za-z]{24,}", probe="[rs]k_live_"),
    Rule("pem", "-----BEGIN ((RSA|EC|DSA|OPENSSH|PGP) )?PRIVATE KEY( BLOCK)?-----", probe="-----BEGIN [A-Z]"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}", probe="eyJ[A-Za-z0-9_-]{2}"),
)


#: Bytes of a walk in vain after which a rule's beginnings are found for the whole text, so that time stays linear.
FAR = 256


class Scanner:
    """The rules' automata; ``spans`` gives (rule number, start byte, end byte) of all matches in a text's bytes."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        probes = [r.probe or r.pattern for r in rules]
        fold = [r.fold for r in rules]
        self.all: Dfa = compile_rules(probes, fold, search=True)
        self.back = [compile_rules([p], [f], search=False, backward=True) for p, f in zip(probes, fold, strict=True)]
        self.ahead = [compile_rules([r.pattern], [r.fold], search=False) for r in rules]
        self.keep = [re.compile(r.keep.encode()) if r.keep else None for r in rules]
        self.begin: list[Dfa | None] = [None] * len(rules)  # made when first needed

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """Sorted by start, then by rule."""
        table, first = self.all.next, self.all.first_final
        state, found, last = self.all.start, [], [0] * len(self.rules)
        begins: dict[int, bytearray] = {}
        for p, b in enumerate(data):
            state = table[state][b]
            if state >= first:
                for k in self.all.rules[state]:
                    if p >= last[k] and (got := self._exact(k, data, p, last[k], begins)):
                        last[k] = got[1]
                        if self.keep[k] is None or self.keep[k].fullmatch(data, *got):
                            found.append((k, *got))
        return sorted(found, key=lambda x: (x[1], x[0]))

    def _exact(self, k: int, data: bytes, p: int, floor: int, begins: dict[int, bytearray]) -> tuple[int, int] | None:
        dfa, begin = self.back[k], -1
        state, i = dfa.start, p
        while i >= floor:
            state = dfa.next[state][data[i]]
            if state == dfa.dead:
                break
            if state >= dfa.first_final:
                begin = i
            i -= 1
        if begin < 0 or k in begins and not begins[k][begin]:
            return None
        dfa, end = self.ahead[k], -1
        state = dfa.start
        for i in range(begin, len(data)):
            state = dfa.next[state][data[i]]
            if state == dfa.dead:
                break
            if state >= dfa.first_final:
                end = i + 1
        if end < 0 and i - begin > FAR:  # no second walk like it: find all places where a match begins, in one pass
            begins[k] = self._begins(k, data)
        return (begin, end) if end > 0 else None

    def _begins(self, k: int, data: bytes) -> bytearray:
        """1 at each byte where some match of the rule begins, by its reversed automaton from the end of the text."""
        if self.begin[k] is None:
            self.begin[k] = compile_rules([self.rules[k].pattern], [self.rules[k].fold], search=True, backward=True)
        table, first, state = self.begin[k].next, self.begin[k].first_final, self.begin[k].start
        out = bytearray(len(data))
        for i in range(len(data) - 1, -1, -1):
            state = table[state][data[i]]
            out[i] = state >= first
        return out


def codepoint_offsets(data: bytes) -> np.ndarray:
    """For each byte offset, the end included, the number of code points before it."""
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(lead)])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) in code points, by start and then by the order of the rules."""
    return docs.select("doc_id", "text").mapInArrow(_scanning(rules), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def _scanning(rules: tuple[Rule, ...]):
    names = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            out = []
            for data in batch.column("text").cast(pa.large_string()).cast(pa.large_binary()):
                data = data.as_py() or b""
                got = scanner.spans(data)
                if got:
                    at = codepoint_offsets(data)
                    got = [{"kind": names[k], "start": int(at[a]), "end": int(at[b])} for k, a, b in got]
                out.append(got)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(kind))], ["doc_id", "spans"])

    return run


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents, under the contract's columns."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = [r.kind for r in BASE_RULES]
    count = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(text(F.filter("spans", lambda x: x.kind.isin(base))), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mask: str = "[redacted]") -> DataFrame:
    """The documents' columns with each span, or union of overlapping spans, replaced by ``mask``."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            i, out = batch.schema.get_field_index("text"), []
            for text in batch.column(i).to_pylist():
                data, pieces, end = (text or "").encode(), [], 0
                for _, a, b in scanner.spans(data):
                    if a >= end:
                        pieces += [data[end:a], mask.encode()]
                    end = max(end, b)
                out.append(None if text is None else (b"".join(pieces) + data[end:]).decode())
            yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))

    return docs.mapInArrow(run, schema)


