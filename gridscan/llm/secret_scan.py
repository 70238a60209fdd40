"""Secret scans with one combined automaton.

All rules are compiled, mirrored, into one minimal automaton; a single pass over a text's bytes from its end
to its start tells at each byte which rules have a match that starts there.  At those few starts a rule's
own automaton finds the longest match.  Matches of a rule are taken from the left and do not overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridscan.llm.automata import compiled


@dataclass(frozen=True)
class Rule:
    """`least` characters in all and, after the first accepting one, `tail` characters; shorter matches are dropped.

    `rest` is what may follow a match and belongs to it; it moves no start, so only the rule's own automaton has it.
    """

    kind: str
    pattern: str
    least: int = 0
    tail: int = 0
    rest: str = ""


# What follows the first line of a key: all up to the END line, which no second BEGIN comes before, also as an
# escaped or quoted string.  Without an END line (a text that was cut), headers and then runs of 16 or more base64
# characters and a shorter last one; what shorter runs hold of a key is the same in every key of its kind.
BASE64, BREAK = "[A-Za-z0-9+/=]", r"""[\x20\x09\x0a\x0d"'\\]"""
WHOLE = r"""(-?[A-Za-z0-9+/=:,"'\\\x20\x09\x0a\x0d])*-----END [A-Z ]*PRIVATE KEY-----"""
CUT = rf"({BREAK}+[A-Za-z\-]+:[A-Za-z0-9+/=,.:@_\-\x20]*)*({BREAK}*{BASE64}{{16,}})+({BREAK}+{BASE64}+)?"


# The three base rules, then formats of published credential types.  A hex run shorter than
# its limit holds no other match, so the limit is part of the pattern; so few starts are followed up.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", tail=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", rest=f"({WHOLE}|{CUT})?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", least=20),
    Rule("google", r"AIza[A-Za-z0-9_\-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"),
)
BASE = ("assign", "access", "hex")


class Scanner:
    """The compiled automata of a list of rules; plain lists, cheap to send."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.back = compiled([r.pattern for r in rules], reverse=True, anywhere=True)
        self.ahead = [compiled([r.pattern + r.rest]) for r in rules]

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(byte offset, mask of rules) of every match start, from the right."""
        table, first, width, accepted = self.back.table, self.back.first, self.back.width, self.back.accepted
        out, state, at = [], 0, len(data)
        for c in data.translate(self.back.classes)[::-1]:
            at -= 1
            state = table[state + c]
            if state >= first:
                out.append((at, accepted[state // width]))
        return out

    def longest(self, rule: int, data: bytes, at: int) -> tuple[int, int]:
        """Offsets after the first and after the last accepting byte of the rule's match at `at`."""
        m = self.ahead[rule]
        state, once, last = 0, 0, at
        for k in range(at, len(data)):
            state = m.table[state + m.classes[data[k]]]
            if state == m.dead:
                break
            if state >= m.first:
                once, last = once or k + 1, k + 1
        return once, last

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, end exclusive, by start and then in the order of the rules."""
        data = text.encode() if text else b""
        after = [0] * len(self.rules)
        found = []
        for at, mask in reversed(self.starts(data)):
            for k, rule in enumerate(self.rules):
                if mask >> k & 1 and at >= after[k]:
                    once, end = self.longest(k, data, at)
                    after[k] = end
                    if end - at >= rule.least and (not rule.tail or end - once + 1 >= rule.tail):
                        found.append((at, k, end))
        if not found or text.isascii():
            return [(self.rules[k].kind, at, end) for at, k, end in found]
        place, seen, points = {}, 0, 0
        for offset in sorted({x for at, _, end in found for x in (at, end)}):
            points += len(data[seen:offset].decode())
            seen, place[offset] = offset, points
        return [(self.rules[k].kind, place[at], place[end]) for at, k, end in found]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each stretch that spans cover replaced by the kind of its first span; others unchanged."""
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join(out) + text[at:]


def span_column(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    scanner = Scanner(rules)

    @F.pandas_udf("array<struct<kind string, start int, end int>>")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in scanner.spans(t)] for t in texts], dtype=object)

    return scan(text)


def redacted(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    scanner = Scanner(rules)

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([redact(t, scanner.spans(t)) for t in texts], dtype=object)

    return clean(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of `docs`: doc_id (null stays null) and spans, by start and then in the order of `rules`.

    Null counts as empty: no spans.  Repeated rows are each scanned; other columns are not read.
    """
    return docs.select(F.col(id_col).alias("doc_id"), span_column(F.col(text_col), rules).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
