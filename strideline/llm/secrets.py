"""Secret scans with a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that every match
must contain, lower-cased. Each block of texts gets an inverted index, trigram to
the texts that hold it, for the trigrams which the rules ask for; a rule's postings
are united and intersected by its query, and the regex runs over the candidates
only. A rule without a mandatory trigram runs over all texts.

The index lives and ends with its block, so nothing is shuffled, memory is bounded
by a block, and a lost executor repeats its own blocks.

Defined results: null text is empty; repeated rows are scanned alike; spans with one
start come in the order of the rules; a very long text is a block of its own and read
whole; the input's columns are kept in a struct, so their names cannot clash; an empty
table gives an empty result; positions are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm.columns import row_of, text_of


@dataclass(frozen=True)
class Rule:
    """``counted``: the group whose length counts, with the least length of it."""

    kind: str
    pattern: str
    counted: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled().finditer(text) if len(m[self.counted]) >= self.least]


#: Between the lines of a key: blanks, escaped line ends, and the marks of quoted or concatenated lines.
_GAP = r"""(?:[\s>|#*"',]|\\+[nrt])"""
#: The last line of a key: base64 that is no plain word, or stands alone on its line.
_TAIL = r"""(?:[A-Za-z0-9+/]*[0-9+/=][A-Za-z0-9+/=]*|[A-Za-z0-9+/]+(?=[\x20\t]*(?:[\r\n\\"']|\Z)))"""
#: A private key from its BEGIN line to its END line; without END, its headers and base64 lines.
_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----|"
    rf"(?:{_GAP}*(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:(?:{_GAP}+[A-Za-z0-9+/=]{{16,}})+(?:{_GAP}+{_TAIL})?|{_GAP}*(?:[\r\n]|\\n){_GAP}*{_TAIL})?)"
)

#: What counts as a secret. The first three are the base kinds.
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("private_key", _KEY),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_password", r"://[^\s/:@]+:[^\s/:@]+@"),
)

#: Longest set of alternatives that is kept apart while a regex is read.
_MOST = 16


def trigram_query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """Conjunction of clauses; a clause is a set of alternatives, each a set of trigrams.

    Every match of ``pattern`` holds, for each clause, all trigrams of some
    alternative. No clause: the regex has no mandatory trigram. The pattern's
    syntax tree is read with the standard library's parser.
    """
    from re import _constants as c
    from re import _parser as parser

    def strings(node) -> list[str] | None:
        """All texts the node can match, or None if they are many or unknown."""
        op, arg = node
        if op is c.LITERAL:
            return [chr(arg).lower()]
        if op is c.IN and all(k is c.LITERAL for k, _ in arg):
            return sorted({chr(v).lower() for _, v in arg})
        if op is c.SUBPATTERN:
            return joined(arg[-1])
        if op is c.BRANCH:
            parts = [joined(x) for x in arg[1]]
            return None if None in parts else sorted({s for p in parts for s in p})
        if op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[1] in (0, 1):
            inner = joined(arg[2])
            return None if inner is None else sorted({*inner, *([""] if arg[0] == 0 else [])})
        return None

    def joined(nodes) -> list[str] | None:
        out = [""]
        for node in nodes:
            more = strings(node)
            if more is None or len(out) * len(more) > _MOST:
                return None
            out = sorted({a + b for a in out for b in more})
        return out

    clauses: list[frozenset[frozenset[str]]] = []

    def flush(texts: list[str]) -> None:
        if all(len(s) >= 3 for s in texts):
            clauses.append(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in texts))

    def read(nodes) -> None:
        run = [""]
        for node in nodes:
            more = strings(node)
            if more is not None and len(run) * len(more) <= _MOST:
                run = sorted({a + b for a in run for b in more})
                continue
            flush(run)
            run = [""]
            op, arg = node
            if op is c.SUBPATTERN:
                read(arg[-1])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] >= 1:
                read(arg[2])
        flush(run)

    read(parser.parse(pattern))
    return list(dict.fromkeys(clauses))


def _code(trigram: str) -> int:
    a, b, c = trigram.encode("ascii")
    return a << 16 | b << 8 | c


class BlockIndex:
    """Postings of the wanted trigrams over one block of texts."""

    def __init__(self, texts: list[str], wanted: list[str]):
        self.size = len(texts)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n\n\n".join(raw), dtype=np.uint8)
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        data = table[data]
        self.postings: dict[str, np.ndarray] = {w: np.zeros(0, np.int64) for w in wanted}
        if len(data) < 3 or not wanted:
            return
        ends = np.cumsum([len(x) + 3 for x in raw])
        first = np.zeros(256, bool)
        first[[_code(w) >> 16 for w in wanted]] = True
        at = np.flatnonzero(first[data[:-2]])
        codes = (data[at].astype(np.int32) << 16) | (data[at + 1].astype(np.int32) << 8) | data[at + 2]
        for w in wanted:
            hits = at[codes == _code(w)]
            self.postings[w] = np.unique(np.searchsorted(ends, hits, side="right"))

    def candidates(self, query: list[frozenset[frozenset[str]]]) -> np.ndarray:
        if not query:
            return np.arange(self.size)
        clauses = []
        for clause in query:
            either = [reduce(np.intersect1d, (self.postings[t] for t in sorted(one))) for one in clause]
            clauses.append(reduce(np.union1d, either))
        return reduce(np.intersect1d, clauses).astype(np.int64)


def scan_block(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its spans as (start, rule number, end), sorted."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({t for q in queries for clause in q for one in clause for t in one})
    index = BlockIndex(texts, wanted)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        for i in index.candidates(query):
            found[i] += [(a, k, b) for a, b in rule.spans(texts[i])]
    return [sorted(x) for x in found]


_BLOCK_CHARS = 4_000_000


def _blocks(texts: pd.Series) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= _BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


_SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]
    )
)


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        out: list[list[dict]] = []
        for block in _blocks(texts):
            out += [
                [{"start": a, "kind": RULES[k].kind, "end": b} for a, k, b in spans] for spans in scan_block(block)
            ]
        yield pd.Series(out, index=texts.index, dtype=object)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row``: the input's columns; ``text``; ``spans``: array of (start, kind, end)."""
    return docs.select(row_of(docs).alias("row"), text_of(text).alias("text")).withColumn(
        "spans", F.pandas_udf(_scan, _SPANS)("text")
    )


def _masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def one(text: str, found) -> str:
        out, at = [], 0
        for s in sorted(found, key=lambda x: (x["start"], x["end"])):
            if s["end"] <= at:
                continue
            if s["start"] >= at:
                out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
            at = s["end"]
        return "".join([*out, text[at:]])

    return pd.Series([one(t, f) for t, f in zip(texts, spans, strict=True)], index=texts.index, dtype=object)


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every secret span replaced by its kind; a null text stays null.

    Overlapping spans are replaced together. A column ``n_chars`` follows the new text.
    """
    found = find_secrets(docs, text)
    new = F.when(F.col(f"row.{text}").isNull(), F.lit(None).cast("string")).when(
        F.size("spans") == 0, F.col("text")
    ).otherwise(F.pandas_udf(_masked, T.StringType())("text", "spans"))
    out = found.select("row", new.alias("new"))
    made = {text: F.col("new")}
    if "n_chars" in docs.columns:
        was = F.col("row").getField("n_chars")
        made["n_chars"] = F.when(F.col("new").isNull(), was).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    return out.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
