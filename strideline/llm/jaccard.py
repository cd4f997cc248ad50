"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct five-word shingles, as 64-bit hashes in an order
that puts rare ones first. Two sets with Jaccard similarity t or more share an
element among the first n - ceil(t n) + 1 of each (the prefix). Steps:

1. A sketch of shingle frequencies, of fixed size and over all documents, gives the
   order; any order is exact, a good one keeps the candidates few.
2. Documents with equal sets are one unit, units with the same prefix and size one
   group. Groups that share a prefix element are candidates.
3. In the bucket of a prefix element every group is first paired with the bucket's
   centre only, the group in which the element comes first, so the one with the
   fewest rare shingles of its own; the pairs are expanded to units and verified.
   Most of a large bucket is then connected.
4. Pairs of a bucket whose units are still in different components are verified too,
   unless their sizes, the places of the element (what is left after it bounds the
   overlap; exact at the first common element) or the triangle inequality over the
   bucket's centre rule them out. After that every link between different texts is either found or
   lies inside a component, so components are exact with few pairs.

Defined results: a text with fewer than five words has its whole sequence as its one
shingle; without words it has no shingle and is linked with nothing; a null id takes
part, but is never the smallest; repeated rows are copies of each other; a component
is named by its least id, so ties do not arise; a very long text is one set; extra
columns take no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.columns import row_of, text_of
from strideline.llm.components import components
from strideline.llm.hashing import blocks, combined, mixed, word_hashes
from strideline.sources.scratch import Scratch

#: Counters of the frequency sketch, and the slices in which it is added up.
COUNTERS, SLICES = 1 << 20, 16


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    h, first = word_hashes(texts)
    wide = combined([h[k : len(h) - width + 1 + k] for k in range(width)]) if len(h) >= width else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(wide[a : b - width + 1]))
        elif b > a:
            out.append(mixed(combined([h[i : i + 1] for i in range(a, b)]) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)  # 20 bits


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def frequency_sketch(docs: DataFrame, text: str, width: int, scratch: Scratch) -> np.ndarray:
    """How many documents hold a shingle of each slot; COUNTERS numbers at any input size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.uint32)
        for pdf in batches:
            for block in blocks(list(pdf["text"])):
                sets = shingle_sets(block, width)
                total += np.bincount(_slot(np.concatenate(sets)), minlength=COUNTERS).astype(np.uint32)
        salt = int(total[:64].sum()) % 31
        parts = np.split(total, SLICES)
        yield pd.DataFrame({"slice": range(SLICES), "salt": salt, "n": [zlib.compress(x.tobytes(), 1) for x in parts]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in pdf["n"])
        packed = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "salt": [0], "n": [packed]})

    schema = "slice int, salt int, n binary"
    parts = docs.select(text_of(text).alias("text")).mapInPandas(count, schema)
    summed = parts.groupBy("slice", "salt").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
    rows = scratch.save(summed, "sketch").collect()  # SLICES rows
    out = np.zeros((SLICES, COUNTERS // SLICES), np.uint32)
    for r in rows:
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["n"]), np.uint32)
    return out.ravel()


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _unit_rows(docs: DataFrame, keep: dict[str, Column], text: str, width: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """keep, n, unit, grp, prefix (null where the block has shown the group's prefix already)."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)
    names = [*keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            n, unit, grp, prefix = [], [], [], []
            shown: set[int] = set()
            for block in blocks(texts):
                for s in shingle_sets(block, width):
                    if not len(s):
                        n.append(0), unit.append(None), grp.append(None), prefix.append(None)
                        continue
                    u = int(_signed(mixed(mixed(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))))[0])
                    first = s[np.lexsort((s, sent.value[_slot(s)]))[: prefix_length(len(s), percent)]]
                    g = int(_signed(mixed(mixed(first).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(s) << 1)))[0])
                    n.append(len(s)), unit.append(u), grp.append(g)
                    prefix.append(None if g in shown else _signed(first))
                    shown.add(g)
            columns = [batch.column(i) for i in range(len(names))]
            columns += [pa.array(n, pa.int64()), pa.array(unit, pa.int64()), pa.array(grp, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n", "unit", "grp", "prefix"])

    rows = docs.select(*[c.alias(k) for k, c in keep.items()], text_of(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)])
    return rows.mapInArrow(work, f"{fields}, n bigint, unit bigint, grp bigint, prefix array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """unit, s: the packed set of every wanted unit (unit, doc)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wants = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            units, packed = [], []
            at = 0
            for block in blocks(texts):
                for s in shingle_sets(block, width):
                    want, at = wants[at], at + 1
                    u = int(_signed(mixed(mixed(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))))[0])
                    if u == want:  # rows may share an id and differ in text
                        units.append(u), packed.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(packed, pa.binary())], names=["unit", "s"])

    rows = docs.select(F.col(key).alias("__key"), text_of(text).alias("__text")).join(wanted, F.col("__key").eqNullSafe(F.col("doc")))
    return rows.select("unit", "__text").mapInArrow(work, "unit bigint, s binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked and similarity of every pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(2), batch.column(3)
            linked, sims = [], []
            for x, y in zip(xs, ys, strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                either = len(p) + len(q) - both
                linked.append(100 * both >= percent * either), sims.append(both / either)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(sims, pa.float64())], names=["a", "b", "linked", "similarity"]
            )

    x, y = sets.select(F.col("unit").alias("ua"), F.col("s").alias("x")), sets.select(F.col("unit").alias("ub"), F.col("s").alias("y"))
    rows = pairs.join(x, F.col("a") == F.col("ua")).join(y, F.col("b") == F.col("ub")).select("a", "b", "x", "y")
    return rows.mapInArrow(work, "a bigint, b bigint, linked boolean, similarity double")


def _fits(m: Column, n: Column, percent: int) -> Column:
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def _meets(p: Column, q: Column, percent: int) -> Column:
    """Sizes fit, and what is left from the element on suffices if it is the first common one."""
    m, n = (x.bitwiseAND(F.lit(0xFFFFFFFF)) for x in (p, q))
    left = F.least(m - F.shiftright(p, 32), n - F.shiftright(q, 32))
    return _fits(m, n, percent) & ((100 + percent) * left >= percent * (m + n))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, keep: dict[str, Column] | None = None
) -> DataFrame:
    """``keep`` columns, doc, n_shingles and component_id of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    sketch = frequency_sketch(docs, text, width, scratch)
    names = [*(keep or {})]
    rows = scratch.save(_unit_rows(docs, {**(keep or {}), "doc": F.col(key)}, text, width, percent, sketch), "rows")
    units = scratch.save(
        rows.filter("unit is not null").groupBy("unit").agg(F.min("doc").alias("doc"), F.first("grp").alias("grp"), F.first("n").alias("n")), "units"
    )
    # Prefix elements that at least two groups share. ``at`` and the size are one number.
    entries = rows.filter("prefix is not null").select("grp", "n", F.posexplode("prefix").alias("at", "element"))
    entries = entries.select("element", "grp", (F.shiftleft(F.col("at").cast("bigint"), 32) + F.col("n")).alias("place"))
    keys = entries.groupBy("element").agg(
        F.min("grp").alias("g0"), F.max("grp").alias("g1"), F.min(F.struct("place", "grp")).alias("first")
    )
    keys = scratch.save(
        keys.filter("g0 != g1").select(F.col("element").alias("of"), F.col("first.grp").alias("centre"), F.col("first.place").alias("centre_place")), "keys"
    )
    # Units by group: the least speaks for the group. A group of several units is a bucket too.
    speakers = units.groupBy("grp").agg(F.min("unit").alias("speaker"), F.max("unit").alias("last"), F.first("n").alias("gn"))
    speakers = scratch.save(speakers, "speakers")
    shared = entries.join(keys, F.col("element") == F.col("of")).select("element", "grp", "place", "centre", "centre_place").distinct()
    own = speakers.filter("speaker != last").select(
        F.xxhash64("grp", F.lit("group")).alias("element"), "grp", F.col("gn").alias("place"), F.col("grp").alias("centre"), F.col("gn").alias("centre_place")
    )
    shared = scratch.save(shared.union(own), "shared")
    slim = scratch.save(rows.drop("prefix", "grp"), "slim")
    scratch.drop("rows", "keys")
    stars = shared.filter("grp != centre").filter(_meets(F.col("place"), F.col("centre_place"), percent)).select("grp", "centre").distinct()
    s1, s2 = (speakers.select(F.col("grp").alias(f"{x}g"), F.col("speaker").alias(f"{x}u")) for x in ("p", "q"))
    between = stars.join(s1, F.col("grp") == F.col("pg")).join(s2, F.col("centre") == F.col("qg")).select(F.col("pu").alias("u"), F.col("qu").alias("v"))
    inside = units.join(speakers.filter("speaker != last").withColumnRenamed("grp", "sg"), F.col("grp") == F.col("sg")).filter("unit != speaker")
    first_pairs = scratch.save(
        between.union(inside.select(F.col("unit").alias("u"), F.col("speaker").alias("v")))
        .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        .distinct(),
        "first-pairs",
    )
    # Sets of the units that may be compared, once each.
    groups = shared.select("grp").distinct()
    wanted = units.join(groups.withColumnRenamed("grp", "wg"), F.col("grp") == F.col("wg"), "left_semi").select("unit", "doc")
    sets = scratch.save(_sets(docs, wanted, key, text, width), "sets")
    scores = scratch.save(_verified(first_pairs, sets, percent), "scores")
    links = scores.filter("linked").select("a", "b")
    found = components(links, scratch, "stars")

    # Members of the buckets, with component and distance to the bucket's speaker.
    far = scores.select("a", "b", (1 - F.col("similarity")).alias("d"))
    far = far.union(far.select("b", "a", "d")).select(F.col("a").alias("du"), F.col("b").alias("dv"), "d")
    members = (
        shared.join(units.select(F.col("grp").alias("ug"), "unit", "n"), F.col("grp") == F.col("ug"))
        .join(s2, F.col("centre") == F.col("qg"))
        .join(found, F.col("unit") == F.col("node"), "left")
        .join(far, (F.col("unit") == F.col("du")) & (F.col("qu") == F.col("dv")), "left")
        .select("element", "unit", "place", F.coalesce("component", "unit").alias("c"), F.when(F.col("unit") == F.col("qu"), 0.0).otherwise(F.col("d")).alias("d"))
    )
    open_keys = members.groupBy("element").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 != c1").select(F.col("element").alias("oe"))
    members = scratch.save(members.distinct().join(open_keys, F.col("element") == F.col("oe"), "left_semi"), "members")
    main = members.groupBy("element", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("element").agg(F.max_by("c", F.struct("k", "c")).alias("main"))
    side = members.join(main.withColumnRenamed("element", "me"), F.col("element") == F.col("me"))
    left = side.filter("c != main").select(*[F.col(x).alias(f"l{x}") for x in ("element", "unit", "place", "c", "d", "main")])
    slack = 1 - percent / 100 + 1e-9
    # Outside the main component each pair is met from both sides, so one side is enough there.
    cross = left.join(
        members,
        (F.col("lelement") == F.col("element"))
        & (F.col("lc") != F.col("c"))
        & ((F.col("c") == F.col("lmain")) | (F.col("lunit") < F.col("unit")))
        & _meets(F.col("lplace"), F.col("place"), percent)
        & (F.abs(F.coalesce(F.col("ld") - F.col("d"), F.lit(0.0))) <= slack),
    )
    cross = cross.select(F.least("lunit", "unit").alias("a"), F.greatest("lunit", "unit").alias("b")).distinct()
    done = scores.select(F.col("a").alias("xa"), F.col("b").alias("xb"))
    cross = scratch.save(cross.join(done, (F.col("a") == F.col("xa")) & (F.col("b") == F.col("xb")), "left_anti"), "cross")
    more = scratch.save(_verified(cross, sets, percent).filter("linked").select("a", "b"), "more")
    if not more.isEmpty():
        found = components(links.union(more), scratch, "all")
    least = units.join(found, F.col("unit") == F.col("node"), "left").withColumn("c", F.coalesce("component", "unit"))
    smallest = least.groupBy("c").agg(F.min("doc").alias("component_id")).withColumnRenamed("c", "sc")
    by_unit = scratch.save(
        least.join(smallest, F.col("c") == F.col("sc")).select(F.col("unit").alias("of"), "component_id"), "by-unit"
    )
    scratch.drop("sets", "members", "shared", "scores")
    return slim.select(*names, "doc", "n", "unit").join(by_unit, F.col("unit") == F.col("of"), "left").select(
        *names, "doc", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that are near duplicates of a kept one.

    Of a component one row stays: that of the smallest id, null ids last, and of the
    smallest text hash among equal ids. Documents without words are linked with nothing
    and stay.
    """
    row = F.struct(F.col(key).isNull().alias("unnamed"), F.col(key).alias("id"), F.md5(text_of(text)).alias("stamp"))
    found = near_duplicates(docs.select(row.alias("__row"), F.col(text)), "__row", text)
    chosen = found.filter((F.col("doc") == F.col("component_id")) & (F.col("n_shingles") > 0)).select("doc").distinct()
    blank = ~text_of(text).rlike(r"[^\x20\x09-\x0D]")
    packed = docs.select(row_of(docs).alias("row"), row.alias("__row"), blank.alias("__blank"))
    stay = packed.filter(~F.col("__blank")).join(chosen, F.col("__row") == F.col("doc"), "left_semi")
    stay = stay.groupBy("__row").agg(F.first("row").alias("row"))
    return stay.select("row").unionByName(packed.filter("__blank").select("row")).select("row.*")
