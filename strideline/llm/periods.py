"""Periodic runs of words: maximal stretches that repeat with one period.

Steps, for a text at a time, inside Spark's tasks; no row leaves its partition:

1. Stretches, without loss: a run of ``least`` words or more and ``times`` periods or more holds
   only words of windows that occur twice in the text (a period apart), so all else is left
   out. Windows are found for a block of texts at once by hash; a collision adds a stretch.
2. ``lyndon_lengths``: the grouping phase of Baier's suffix sorter. Groups of suffixes with one
   Lyndon prefix are taken from the greatest down; each hands its prefix on to the nearest
   earlier suffix of a smaller group, whose own prefix it extends. When a group is taken its
   prefix is the longest Lyndon word there, so the lengths come without sorting suffixes.
3. A run's Lyndon root is the longest Lyndon word at its place in the order of words or in the
   reverse of that order; so the candidates are (place, length) under both. Those that
   repeat at once are extended by the common extensions of two places a period apart, left and
   right, and long enough ones are runs. The words are compared themselves, not their hashes.

Defined results: null text has no words; runs may overlap and all are returned, by start,
then period; a root's word order is that of first occurrence, and any other gives the
same runs; repeated rows and equal ids are rows like others; a very long text is worked on in
one piece, in memory linear in its length; the input's columns are kept in a struct, so
their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.columns import row_of, text_of
from strideline.llm.hashing import blocks, combined, mixed, word_hashes

_FOUND = "runs array<struct<start: bigint, length: bigint, period: bigint>>, kept string, n_words bigint"


def lyndon_lengths(s: list[int], kinds: int) -> list[int]:
    """Length of the longest Lyndon word that begins at each place of ``s`` (values below ``kinds``)."""
    members: list[list[int]] = [[] for _ in range(kinds)]
    for i, c in enumerate(s):
        members[c].append(i)
    group, size = list(s), [1] * kinds
    below, above = list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    earlier, taken, out = [-1] * len(s), bytearray(len(s) + 1), [0] * len(s)  # taken[-1] stands before the text
    g = kinds - 1
    while g >= 0:
        length = size[g]
        grown: dict[tuple[int, int], list[int]] = {}  # by group and number of copies taken over
        holder, copies = -1, 0
        for i in members[g]:
            if group[i] != g:
                continue  # went on to a greater group
            p = i - 1
            while taken[p]:
                p = earlier[p]
            earlier[i], taken[i], out[i] = p, 1, length
            if p == holder:
                copies += 1
                continue
            if holder >= 0:
                grown.setdefault((group[holder], copies), []).append(holder)
            holder, copies = p, 1
        if holder >= 0:
            grown.setdefault((group[holder], copies), []).append(holder)
        members[g] = []
        # More copies are greater; each new group stands right above those of its old group with fewer.
        for old, copies in sorted(grown, reverse=True):
            new = len(members)
            of = grown[old, copies]
            members.append(of)
            size.append(size[old] + copies * length)
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            if up < len(below):
                below[up] = new
            for i in of:
                group[i] = new
        g = below[g]
    return out


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements of two arrays are equal, in time linear in that."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        end = min(n, at + step)
        other = a[at:end] != b[at:end]
        k = int(other.argmax())
        if other[k]:
            return at + k
        at, step = end, step * 2
    return n


def _roots(s: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of the Lyndon words that are followed by a copy of themselves."""
    at = np.flatnonzero(np.arange(len(s)) + 2 * lengths <= len(s))
    p = lengths[at]
    sure = []
    for k in range(8):  # the first words of all at once
        same = s[at + k] == s[at + k + p]
        at, p = at[same], p[same]
        whole = p == k + 1
        sure.append((at[whole], p[whole]))
        at, p = at[~whole], p[~whole]
    same = np.fromiter((np.array_equal(s[i : i + k], s[i + k : i + 2 * k]) for i, k in zip(at, p, strict=True)), bool, len(at))
    sure.append((at[same], p[same]))
    at, p = (np.concatenate(x) for x in zip(*sure, strict=True))
    order = np.lexsort((at, p))
    return at[order], p[order]


def runs_of(words: list, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``least`` words and ``times`` periods or more, in order."""
    number: dict = {}
    s = [number.setdefault(w, len(number)) for w in words]
    here = np.array(s, np.int32)
    back = here[::-1]
    n, top, found = len(s), len(number) - 1, set()
    for values in (s, [top - c for c in s]):
        at, periods = _roots(here, np.array(lyndon_lengths(values, top + 1), np.int64))
        k = 0
        while k < len(at):
            i, p = int(at[k]), int(periods[k])
            end = i + p + _agree(here[i:], here[i + p :])
            start = i - _agree(back[n - i :], back[n - i - p :])
            if end - start >= max(least, times * p):
                found.add((start, end - start, p))
            # Further roots of this period inside are roots of the same run.
            stop = int(np.searchsorted(periods, p, "right"))
            k += 1 + int(np.searchsorted(at[k + 1 : stop], end - p, "right"))
    return sorted(found)


def stretches(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's words begin in the block, and for every word of the block whether a window that
    occurs twice in its text covers it; one more False at the end."""
    h, first = word_hashes(texts, lower=False)
    covered = np.zeros(len(h) + 1, bool)
    if len(h) < width:
        return first, covered
    reach = 1
    while 2 * reach <= width:
        h, reach = combined([h[:-reach], h[reach:]]), 2 * reach
    if reach < width:
        h = combined([h[: len(h) - (width - reach)], h[width - reach :]])
    of = np.searchsorted(first, np.arange(len(h)), "right") - 1
    inside = np.arange(len(h)) + width <= first[of + 1]
    at = np.flatnonzero(inside)
    key = mixed(h[at] + mixed(of[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(covered) + 1, np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    return first, np.cumsum(edge[:-1]) > 0


def _search(texts: list[str], least: int, times: int) -> list[tuple[list, str, int]]:
    """Runs, the text without their repeats and the number of words of every text of a block."""
    width = math.ceil(least - least / times)
    first, covered = stretches(texts, width)
    out = []
    for k, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").split()
        mine = np.concatenate([[False], covered[first[k] : first[k + 1]], [False]])
        edge = np.flatnonzero(mine[1:] != mine[:-1])
        runs = [
            (int(a) + start, length, p)
            for a, b in zip(edge[::2], edge[1::2], strict=True)
            for start, length, p in runs_of(words[a:b], least, times)
        ]
        n = len(words)
        if runs:
            gone = np.zeros(n + 1, np.int32)
            for start, length, p in runs:
                gone[start + p] += 1
                gone[start + length] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
        out.append((sorted(runs), b" ".join(words).decode("utf-8", "surrogatepass"), n))
    return out


def find_runs(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """row (all columns of ``docs``), n_words, runs (start, length, period in words) and kept, the words
    that no run holds after its first period, joined by one space."""
    if times < 3 or least < 1:
        raise ValueError("runs of 3 periods or more are found")

    @F.pandas_udf(_FOUND)
    def search(texts: pd.Series) -> pd.DataFrame:
        found = [f for block in blocks(texts.tolist()) for f in _search(block, least, times)]
        runs = [[{"start": a, "length": n, "period": p} for a, n, p in r] for r, *_ in found]
        return pd.DataFrame({"runs": runs, "kept": [k for _, k, _ in found], "n_words": [n for *_, n in found]})

    out = docs.select(row_of(docs).alias("row"), search(text_of(text)).alias("found"))
    return out.select("row", "found.n_words", "found.runs", "found.kept")
