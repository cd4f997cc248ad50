"""Language-model scoring with a Katz backoff bigram model.

P(w | v) is the Good-Turing discounted share of a bigram that was seen after v, once
or more often (``min_count``), else alpha(v) P(w); P(w) is the discounted share of a
word that was seen, else the mass that the discounts leave. alpha(v) is
(1 - sum of the seen bigrams' shares) / (1 - sum of their words' P), so every
distribution sums to 1 exactly. Where discounts leave nothing, the total is one more.

Counts are gathered through the shuffle. Texts become blocks: token numbers and a
sorted dictionary of 64-bit word hashes. For each of two tables, unigrams and
bigrams, every block sends its distinct entries with their training counts to the
table's partitions (by hash range), the partition adds them up, and answers the
block's entries with totals and sums over contexts; the block looks up per token.
Unigrams also number the words, so that bigrams travel in a few bytes.
A frequent entry is one row a block, whatever its count. Followers of contexts with
at least N / HOT_CONTEXTS tokens are dealt by bigram; those contexts, at most
HOT_CONTEXTS + 1 of them, are added up and broadcast.

Defined results: null text is empty and has only its end token; without training
tokens every probability is 1; repeated rows count as often as they come; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.columns import text_of
from strideline.llm.hashing import blocks, mixed, word_hashes
from strideline.sources.scratch import Scratch

#: Hash of the end token; number of the context before the first word.
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0)
HOT_CONTEXTS = 10_000
BLOCK_CHARS = 3 << 20
PARTITION_BYTES = 4 << 20
#: Counts up to this are discounted.
TOP = 5


def _thin(a: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane after their width, packed: the upper planes are mostly zero."""
    width = 8 if len(a) and int(a.max()) >= 2**32 else 4
    return zstandard.compress(bytes([width]) + a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def _thick(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8)
    width = int(planes[0])
    return np.ascontiguousarray(planes[1:].reshape(width, -1).T).view(f"<u{width}").ravel()


def _packed(nums: np.ndarray) -> bytes:
    """Sums of contexts but their tokens, a row each: whole numbers thinly, the last column as it is."""
    floats = nums[:, -1].astype("<f8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(nums).to_bytes(8, "little") + zstandard.compress(floats, 1) + _thin(nums[:, 1:-1].T.ravel())


def _unpacked(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    out = np.empty((n, TOP + 2))
    floats = zstandard.ZstdDecompressor().decompressobj()
    out[:, -1] = np.ascontiguousarray(np.frombuffer(floats.decompress(b[8:]), np.uint8).reshape(8, n).T).view("<f8").ravel()
    out[:, :-1] = _thick(floats.unused_data).reshape(TOP + 1, n).T
    return out


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches one at a time; binary values are views of the batch."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {}
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                value = column[i]
                row[name] = value.as_buffer() if pa.types.is_binary(column.type) and value.is_valid else value.as_py()
            yield row


def _batch(columns: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in columns.values()], names=[*columns])


def discounts(n: list[float]) -> np.ndarray:
    """Factor for counts 0 (unused) to TOP, from the numbers n[r] of entries seen r times, r up to TOP + 1.

    Good-Turing by Katz; where the counts of counts give no factor in (0, 1], half an
    occurrence is taken off instead.
    """
    out = np.ones(TOP + 1)
    a = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 0.0
        out[r] = d if 0 < d <= 1 else (r - 0.5) / r
    return out


@dataclass(frozen=True)
class Unigrams:
    tokens: int
    distinct: int
    factors: np.ndarray
    unseen: float
    total: float

    def p(self, c: np.ndarray) -> np.ndarray:
        seen = self.factors[np.minimum(c, TOP)] if len(c) else np.zeros(0)
        seen = np.where(c > TOP, 1.0, seen) * c / self.total
        return np.where(c > 0, seen, self.unseen)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def unigrams_of(tokens: int, distinct: int, n: list[float]) -> Unigrams:
    d = discounts(n)
    kept = tokens - sum((1 - d[r]) * r * n[r] for r in range(1, TOP + 1))
    total = tokens if kept < tokens else tokens + 1
    return Unigrams(tokens, distinct, d, 1 - kept / total if tokens else 1.0, max(1, total))


def _counts_of_counts(c: np.ndarray) -> list[float]:
    return np.bincount(np.minimum(c, TOP + 2).astype(np.int64), minlength=TOP + 3)[: TOP + 2].astype(float).tolist()


def _blocks(docs: DataFrame, key: str, text: str, held_out: Column) -> DataFrame:
    """block, keys, held, ends, dictionary, tokens and the dictionary's training counts."""
    rows = docs.select(F.col(key).alias("k"), held_out.alias("h"), text_of(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            at = 0
            for block in blocks(batch.column(2).to_pylist(), BLOCK_CHARS):
                hashes, ends, n = [], [], 0
                for part in blocks(block):
                    h, first = word_hashes(part)
                    hashes.append(np.insert(h, first[1:], END))
                    ends.append(first[1:] + np.arange(1, len(part) + 1) + n)
                    n += len(hashes[-1])
                words, token = np.unique(np.concatenate(hashes), return_inverse=True)
                ends = np.concatenate(ends)
                keys, held = batch.column(0).slice(at, len(block)), batch.column(1).slice(at, len(block))
                at += len(block)
                learned = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), np.diff(ends, prepend=0))
                count = np.bincount(token[learned], minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(block)], pa.int32()), keys),
                        pa.ListArray.from_arrays(pa.array([0, len(block)], pa.int32()), held),
                        pa.array([ends.astype("<i8").tobytes()], pa.binary()),
                        pa.array([words.tobytes()], pa.binary()),
                        pa.array([_thin(token)], pa.binary()),
                        pa.array([_thin(count)], pa.binary()),
                    ],
                    names=["block", "keys", "held", "ends", "words", "tokens", "counts"],
                )
                number += 1

    return rows.mapInArrow(
        work, f"block bigint, keys array<{kind}>, held array<boolean>, ends binary, words binary, tokens binary, counts binary"
    )


def _bits(size: int) -> int:
    """Bits of a hash that number the partitions of a table of ``size`` bytes."""
    return max(4, int(np.ceil(np.log2(max(1, size / PARTITION_BYTES)))))


def _part(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _unigram_table(table: DataFrame, bits: int) -> DataFrame:
    """block, part, c, at: totals of the block's words in the part and their numbers in it; and by part the sums in nums."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            w, c = np.frombuffer(row["words"], np.uint64), _thick(row["counts"])
            part = _part(w, bits)
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            yield _batch(
                {
                    "part": (pa.int32(), part[cut]),
                    "block": (pa.int64(), [row["block"]] * len(cut)),
                    "words": (pa.binary(), [x.tobytes() for x in np.split(w, cut[1:])] if len(cut) else []),
                    "counts": (pa.binary(), [_thin(x) for x in np.split(c, cut[1:])] if len(cut) else []),
                }
            )

    def add(group: pa.Table) -> pa.Table:
        rows = list(_each(group.to_batches()))
        w = [np.frombuffer(r["words"], np.uint64) for r in rows]
        distinct, at = np.unique(np.concatenate(w), return_inverse=True)
        total = np.bincount(at, np.concatenate([_thick(r["counts"]) for r in rows]), minlength=len(distinct)).astype(np.int64)
        ends = np.cumsum([len(x) for x in w])[:-1]
        answers, places = np.split(total[at], ends), np.split(at, ends)
        seen = total[total > 0]
        nums = [float(len(seen)), float(seen.sum()), *_counts_of_counts(seen)]
        return pa.Table.from_batches(
            [
                _batch(
                    {
                        "block": (pa.int64(), [*[r["block"] for r in rows], -1]),
                        "part": (pa.int32(), [rows[0]["part"]] * (len(rows) + 1)),
                        "c": (pa.binary(), [*(_thin(x) for x in answers), None]),
                        "at": (pa.binary(), [*(_thin(x) for x in places), None]),
                        "nums": (pa.list_(pa.float64()), [*([None] * len(rows)), nums]),
                    }
                )
            ]
        )

    sent = table.select("block", "words", "counts").mapInArrow(send, "part int, block bigint, words binary, counts binary")
    return sent.groupBy("part").applyInArrow(add, "block bigint, part int, c binary, at binary, nums array<double>")


def _sums(df: DataFrame, size: int) -> list[float]:
    """Element-wise sum of the column ``nums``."""
    row = df.agg(*[F.sum(F.get("nums", F.lit(i))).alias(f"n{i}") for i in range(size)]).first()
    return [x or 0.0 for x in row]


class BlockBigrams:
    """The distinct bigrams of a block, in the order in which they are sent."""

    def __init__(self, row, hot_least: int, bits: int):
        self.ids = _thick(row["ids"]).astype(np.uint64)
        self.c1 = _thick(row["c1"]).astype(np.int64)
        token = _thick(row["tokens"]).astype(np.int64)
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.learned = np.repeat(~np.asarray(row["held"], bool), np.diff(self.ends, prepend=0))
        begin = len(self.ids)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[np.concatenate([[0], self.ends[:-1]])] = begin
        pair, of = np.unique((before.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64), return_inverse=True)
        v, w = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        id_v = np.append(self.ids, BEGIN)[v]
        hot = np.append(self.c1 >= hot_least, True)[v]
        part = _part(np.where(hot, mixed(id_v + mixed(self.ids[w])), mixed(id_v)), bits)
        order = np.argsort(part, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.of, self.token = rank[of], token
        self.v, self.w, self.hot, self.part = id_v[order], w[order], hot[order], part[order]
        self.n = np.bincount(self.of[self.learned], minlength=len(pair))
        # Contexts by runs of one part. Where all training tokens of a context are in this block, it needs no answer.
        self.run = np.flatnonzero(np.concatenate([[True], (self.v[1:] != self.v[:-1]) | (self.part[1:] != self.part[:-1])]))
        self.tokens = np.append(self.c1, -1)[v][order][self.run]
        self.own = ~self.hot[self.run] & (np.add.reduceat(self.n, self.run) == self.tokens)

    def parts(self) -> list[slice]:
        cut = np.flatnonzero(np.diff(self.part, prepend=-1))
        return [slice(a, b) for a, b in zip(cut, [*cut[1:], len(self.part)], strict=True)]


    def runs_of(self, s: slice) -> slice:
        return slice(*np.searchsorted(self.run, [s.start, s.stop]))


def context_sums(of: np.ndarray, c: np.ndarray, p1: np.ndarray, size: int, min_count: int) -> np.ndarray:
    """By context: tokens, followers seen 1 to TOP times, tokens of the others, and the sum of the seen followers' P."""
    kept = c >= min_count
    out = [np.bincount(of, c, minlength=size)]
    out += [np.bincount(of, kept & (c == r), minlength=size) for r in range(1, TOP + 1)]
    out += [np.bincount(of, np.where(kept & (c > TOP), c, 0), minlength=size), np.bincount(of, np.where(kept, p1, 0.0), minlength=size)]
    return np.stack(out, axis=1)


def _bigram_table(table: DataFrame, uni: Unigrams, hot_least: int, bits: int, min_count: int) -> DataFrame:
    """Answers by block and part: c, and ctx by context; kind 1 rows: sums of hot contexts; kind 2: counts of counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            b = BlockBigrams(row, hot_least, bits)
            out: dict[str, list] = {k: [] for k in ("part", "v", "run", "kind", "w", "c1", "n")}
            for s in b.parts():
                r = b.runs_of(s)
                run = b.run[r]
                out["part"].append(int(b.part[s.start]))
                out["v"].append(_thin(b.v[run]))
                out["run"].append(_thin(np.diff(run, append=s.stop)))
                out["kind"].append((b.hot[run] + 2 * b.own[r]).astype(np.uint8).tobytes())
                out["w"].append(_thin(b.ids[b.w[s]]))
                out["c1"].append(_thin(b.c1[b.w[s]]))
                out["n"].append(_thin(b.n[s]))
            kinds = {k: (pa.int32() if k == "part" else pa.binary(), v) for k, v in out.items()}
            yield _batch({"part": kinds.pop("part"), "block": (pa.int64(), [row["block"]] * len(out["part"])), **kinds})

    def add(group: pa.Table) -> pa.Table:
        rows = list(_each(group.to_batches()))
        runs = [_thick(r["run"]).astype(np.int64) for r in rows]
        vs = np.concatenate([_thick(r["v"]).astype(np.int64) for r in rows])
        kind = np.concatenate([np.frombuffer(r["kind"], np.uint8) for r in rows])
        contexts, v_of = np.unique(vs, return_inverse=True)
        is_hot = np.zeros(len(contexts), bool)
        is_hot[v_of] = kind == 1
        v = np.repeat(v_of, np.concatenate(runs))
        w = np.concatenate([_thick(r["w"]).astype(np.int64) for r in rows])
        order = np.lexsort((w, v))
        new = np.concatenate([[True], (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])])
        first = np.flatnonzero(new)
        n = np.concatenate([_thick(r["n"]) for r in rows]).astype(np.int64)
        c = np.add.reduceat(n[order], first)
        p1 = uni.p(np.concatenate([_thick(r["c1"]) for r in rows]).astype(np.int64)[order][first])
        cv = v[order][first]
        total = np.empty_like(v)
        total[order] = c[np.cumsum(new) - 1]
        nums = context_sums(cv, c, p1, len(contexts), min_count)
        lens = np.cumsum([r.sum() for r in runs])
        cut = np.cumsum([len(r) for r in runs])[:-1]
        ctx = [nums[x[k == 0]] for x, k in zip(np.split(v_of, cut), np.split(kind, cut), strict=True)]
        hots = np.flatnonzero(is_hot)
        k, none = len(rows), [None] * (len(hots) + 1)
        return pa.Table.from_batches(
            [
                _batch(
                    {
                        "kind": (pa.int32(), [0] * k + [1] * len(hots) + [2]),
                        "block": (pa.int64(), [*[r["block"] for r in rows], *[-1] * (len(hots) + 1)]),
                        "part": (pa.int32(), [rows[0]["part"]] * (k + len(hots) + 1)),
                        "c": (pa.binary(), [*(_thin(x) for x in np.split(total, lens[:-1])), *none]),
                        "ctx": (pa.binary(), [*map(_packed, ctx), *none]),
                        "v": (pa.int64(), [*[0] * k, *contexts[hots].tolist(), 0]),
                        "nums": (pa.list_(pa.float64()), [*[None] * k, *nums[hots].tolist(), _counts_of_counts(c[c > 0])]),
                    }
                )
            ]
        )

    sent = table.select("block", "ids", "tokens", "c1", "ends", "held").mapInArrow(
        send, "part int, block bigint, v binary, run binary, kind binary, w binary, c1 binary, n binary"
    )
    return sent.groupBy("part").applyInArrow(
        add, "kind int, block bigint, part int, c binary, ctx binary, v bigint, nums array<double>"
    )


def bigram_logs(
    b: BlockBigrams, c: np.ndarray, ctx: np.ndarray, uni: Unigrams, factors: np.ndarray, min_count: int
) -> np.ndarray:
    """log10 P of each distinct bigram of a block. ``ctx`` by bigram: tokens, followers seen 1 to TOP times, tokens of others, sum of P."""
    r = np.arange(1, TOP + 1)
    seen = ctx[:, 1 : TOP + 1] @ (factors[1:] * r) + ctx[:, TOP + 1]
    total = np.where(seen < ctx[:, 0] - 1e-9, ctx[:, 0], ctx[:, 0] + 1)
    left = 1 - seen / total
    alpha = np.where(ctx[:, 0] > 0, left / np.maximum(1 - ctx[:, -1], 1e-300), 1.0)
    share = np.where(c > TOP, 1.0, factors[np.minimum(c, TOP)]) * c / total
    return np.log10(np.where(c >= min_count, share, alpha * uni.p(b.c1[b.w])))


def score(
    docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", min_count: int = 1
) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    table = scratch.save(_blocks(docs, key, text, F.coalesce(held_out, F.lit(False))), "blocks")
    sizes = table.agg(F.sum(F.length("words")).alias("w"), F.sum(F.length("tokens")).alias("t")).first()
    word_bits = _bits(sizes["w"] or 0)
    answers = scratch.save(_unigram_table(table, word_bits), "unigrams")
    distinct, tokens, *n = _sums(answers.filter("block = -1"), TOP + 4)
    uni = unigrams_of(int(tokens), int(distinct), n)
    by_block = answers.filter("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "c", "at"))).alias("got"))

    def with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words get numbers: their place in the part, then the part; 0 is kept for the context before the first word."""
        for batch in batches:
            c1, ids = [], []
            for got in batch.column("got"):
                got = got.as_py()
                c1.append(_thin(np.concatenate([_thick(x["c"]) for x in got])))
                ids.append(_thin(np.concatenate([(_thick(x["at"]).astype(np.int64) << word_bits | x["part"]) + 1 for x in got])))
            names = ["block", "keys", "held", "ends", "tokens"]
            made = [pa.array(c1, pa.binary()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *made], names=[*names, "c1", "ids"])

    kind = table.schema["keys"].dataType.simpleString()
    schema = f"block bigint, keys {kind}, held array<boolean>, ends binary, tokens binary, c1 binary, ids binary"
    joined = table.drop("counts", "words").join(by_block.withColumnRenamed("block", "of"), F.col("block") == F.col("of")).drop("of")
    known = scratch.save(joined.mapInArrow(with_counts, schema), "known")
    scratch.drop("blocks", "unigrams")

    bits = _bits((sizes["t"] or 0) * 6)
    hot_least = max(1, -(-int(tokens) // HOT_CONTEXTS))
    pairs = scratch.save(_bigram_table(known, uni, hot_least, bits, min_count), "bigrams")
    factors = discounts(_sums(pairs.filter("kind = 2"), TOP + 2))
    hot = pairs.filter("kind = 1").groupBy("v").agg(*[F.sum(F.get("nums", F.lit(i))).alias(f"n{i}") for i in range(TOP + 3)])
    hot_rows = hot.collect()  # at most HOT_CONTEXTS + 1
    sent = spark.sparkContext.broadcast(
        (
            np.array(sorted(r["v"] for r in hot_rows), np.uint64),
            np.array([list(r)[1:] for r in sorted(hot_rows, key=lambda r: r["v"])], float).reshape(-1, TOP + 3),
        )
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_v, hot_nums = sent.value
        for batch in batches:
            for i, row in enumerate(_each([batch])):
                b = BlockBigrams(row, hot_least, bits)
                c = np.concatenate([_thick(x["c"]) for x in row["got"]]).astype(np.int64)
                run_of = np.repeat(np.arange(len(b.run)), np.diff(b.run, append=len(c)))
                ctx = context_sums(run_of, b.n, uni.p(b.c1[b.w]), len(b.run), min_count)
                for s, x in zip(b.parts(), row["got"], strict=True):
                    r = b.runs_of(s)
                    asked = np.arange(r.start, r.stop)[~b.own[r] & ~b.hot[b.run[r]]]
                    ctx[asked, 1:] = _unpacked(x["ctx"])
                    ctx[asked, 0] = b.tokens[asked]
                hot = b.hot[b.run]
                if hot.any():
                    ctx[hot] = hot_nums[np.searchsorted(hot_v, b.v[b.run][hot])]
                ctx = ctx[run_of]
                logs = bigram_logs(b, c, ctx, uni, factors, min_count)[b.of]
                first = np.concatenate([[0], b.ends[:-1]])
                c1 = b.c1[b.token]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("keys")[i].values,
                        pa.array(row["held"], pa.bool_()),
                        pa.array(b.ends - first, pa.int64()),
                        pa.array(np.add.reduceat((c1 > 0).astype(np.int64), first)),
                        pa.array(np.full(len(first), uni.tokens, np.int64)),
                        pa.array(np.add.reduceat(uni.base(c1), first)),
                        pa.array(np.add.reduceat(logs, first)),
                    ],
                    names=["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                del b, c, ctx, logs, c1

    got = pairs.filter("kind = 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "c", "ctx"))).alias("got"))
    rows = known.join(got.withColumnRenamed("block", "of"), F.col("block") == F.col("of")).drop("of")
    element = known.schema["keys"].dataType.elementType.simpleString()
    out = rows.mapInArrow(
        finish,
        f"k {element}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
    return out.withColumnRenamed("k", key)
