"""Quality rules: distribution divergence from language references.

Every document has a histogram of character classes and one of its language's
common words. Each is compared with the language's reference, which sums the same
counts over all documents of that language, by the Jensen-Shannon distance (base 2,
0 to 1). Short texts scatter widely, so each comparison has a least length. Fixed
rules on length and repetition come first.

Defined results: null text is empty and fails the length rule; a null language has
the reference of all rows with null language; a language with fewer than
``min_reference_words`` words has no reference and rejects nothing; repeated rows
are judged alike; ties among common words go to the smaller word; a very long text is
one row, read by native functions in time n log n; an empty table gives an empty
result. Columns of the input are kept apart in a struct, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideline.llm.columns import BLANKS, let, row_of, text_of, words_of
from strideline.sources.scratch import Scratch

#: The characters that count as symbols, and as punctuation.
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"

CLASSES = ("blank", "upper", "letter", "digit", "punctuation", "symbol", "other")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    n_common: int = 30
    common_max_chars: int = 5
    min_reference_words: int = 1000
    min_chars_for_classes: int = 200
    max_class_distance: float = 0.30
    min_words_for_common: int = 150
    max_common_distance: float = 0.30


def _bare(chars: Column, drop: str) -> Column:
    return F.length(chars) - F.length(F.translate(chars, drop, ""))


def _class_counts(text: Column, rest: Column) -> dict[str, Column]:
    """Counts by class; ``rest`` is the text without its letters."""
    n = F.length(text)
    upper = F.regexp_count(text, F.lit(r"\p{Lu}"))
    blank, symbol, mark = (_bare(rest, x) for x in (BLANKS, SYMBOLS, PUNCTUATION))
    digit = _bare(rest, "0123456789")
    return {
        "blank": blank,
        "upper": upper,
        "letter": n - F.length(rest) - upper,
        "digit": digit,
        "punctuation": mark,
        "symbol": symbol,
        "other": F.length(rest) - blank - symbol - mark - digit,
    }


def _window_hashes(words: Column) -> Column:
    """Hashes of all three-word windows; each word is hashed once."""

    def windows(h: Column) -> Column:
        return F.when(
            F.size(h) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))),
        ).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _covered(windows: Column) -> Column:
    """Words inside the windows that are next to an equal one; ``windows`` is sorted by hash, then place."""

    def twice(x: Column, i: Column) -> Column:
        before, after = F.get(windows, i - 1)["h"], F.get(windows, i + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    return F.aggregate(
        F.sort_array(F.transform(F.filter(windows, twice), lambda x: x["at"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(x - s["last"], F.lit(3))).alias("n")),
        lambda s: s["n"],
    )


def _repeat_words(hashes: Column) -> Column:
    """Words inside three-word windows found twice or more; windows are told apart by 64 bits within a text."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    none = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(none, F.lit(0).cast("bigint")).otherwise(let(placed, _covered))


def _tally(words: Column) -> Column:
    """Map from each word to how often it occurs: runs of the sorted words."""

    def runs(s: Column) -> Column:
        placed = F.transform(s, lambda w, i: F.struct(w.alias("word"), i.alias("at")))
        starts = F.filter(placed, lambda x: F.coalesce(F.get(s, x["at"] - 1) != x["word"], F.lit(True)))
        return let(
            starts,
            lambda b: F.transform(b, lambda x, k: F.struct(x["word"], (F.coalesce(F.get(b, k + 1)["at"], F.size(s)) - x["at"]).alias("n"))),
        )

    return F.map_from_entries(let(F.sort_array(words), runs))


def text_stats(docs: DataFrame, rules: QualityRules, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: ``keep`` columns, the counts of the rules, and ``short``, how often each short word occurs."""
    names = [*(keep or {})]
    base = docs.select(*[c.alias(k) for k, c in (keep or {}).items()], text_of(text).alias("__t"))
    base = base.select("*", F.regexp_replace("__t", r"\p{L}+", "").alias("__rest"), words_of(F.col("__t")).alias("__words"))
    counts = _class_counts(F.col("__t"), F.col("__rest"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    short = F.transform(F.filter("__words", lambda w: F.length(w) <= rules.common_max_chars), F.lower)
    return base.select(
        *names,
        F.size("__words").cast("bigint").alias("n_words"),
        *[c.cast("bigint").alias(k) for k, c in counts.items()],
        F.length("__t").cast("bigint").alias("n_chars"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        let(_window_hashes(F.col("__words")), _repeat_words).alias("n_repeat_words"),
        _tally(short).alias("short"),
    )


def _distance(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon distance of two histograms given as probabilities."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(F.lit(0.0))

    total = F.lit(0.0)
    for x, y in zip(p, q, strict=True):
        total = total + part(x, y) + part(y, x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _array_distance(p: Column, q: Column) -> Column:
    """The same over two arrays of equal length."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def language_references(stats: DataFrame, rules: QualityRules) -> DataFrame:
    """One row per language of ``stats``: sums of its character classes, its common words and their shares.

    Common words are the ``n_common`` most frequent lower-cased words of at most
    ``common_max_chars`` characters, ties by the word itself.
    """
    top = (
        stats.select("lang", F.explode("short").alias("word", "k"))
        .groupBy("lang", "word")
        .agg(F.sum("k").alias("n"))
        .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
        .filter(F.col("r") <= rules.n_common)
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
        .select(
            F.col("lang").alias("top_lang"),
            F.transform("top", lambda x: x["word"]).alias("common"),
            F.transform("top", lambda x: x["n"]).alias("common_n"),
        )
    )
    sums = stats.groupBy("lang").agg(
        *[F.sum(F.col(k).cast("double")).alias(f"ref_{k}") for k in CLASSES], F.sum(F.col("n_words").cast("double")).alias("ref_words")
    )
    return (
        sums.join(top, F.col("lang").eqNullSafe(F.col("top_lang")), "left")
        .filter(F.col("ref_words") >= rules.min_reference_words)
        .select(
            F.col("lang").alias("ref_lang"),
            *[f"ref_{k}" for k in CLASSES],
            F.coalesce("common", F.array().cast("array<string>")).alias("common"),
            F.coalesce(
                F.transform("common_n", lambda n: n / F.col("ref_words")), F.array().cast("array<double>")
            ).alias("common_p"),
        )
    )


def judge(
    docs: DataFrame,
    rules: QualityRules = QualityRules(),
    text: str = "text",
    lang: str = "lang",
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """``keep`` (default: the rows of ``docs`` as the struct ``row``), the counts, both distances, base_failed and kept.

    Texts are read once: counts and tallies of short words are saved with ``keep``, and
    the references and verdicts are made from the saved table.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    keep = keep or {"row": row_of(docs)}
    stats = scratch.save(text_stats(docs, rules, text, {**keep, "lang": F.col(lang)}), "stats")
    # One row a language. Saved, so that the planner knows its true size and
    # broadcasts it only under the session's threshold; beyond that it sorts and merges.
    refs = scratch.save(language_references(stats, rules).coalesce(1), "references")
    joined = stats.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    n = F.col("n_words").cast("double")
    shares = F.transform("common", lambda s: F.coalesce(F.try_element_at("short", s), F.lit(0)) / n)

    def with_rest(a: Column) -> Column:
        return F.concat(a, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(a, F.lit(0.0), lambda s, x: s + x))))

    own = sum((F.col(k) for k in CLASSES), F.lit(0.0))
    ref = sum((F.col(f"ref_{k}") for k in CLASSES), F.lit(0.0))
    class_distance = F.when(
        (F.col("n_chars") >= rules.min_chars_for_classes) & F.col("ref_blank").isNotNull(),
        _distance([F.col(k) / own for k in CLASSES], [F.col(f"ref_{k}") / ref for k in CLASSES]),
    )
    common_distance = F.when(
        (F.col("n_words") >= rules.min_words_for_common) & (F.size("common") > 0),
        let(shares, lambda p: _array_distance(with_rest(p), with_rest(F.col("common_p")))),
    )
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    return joined.select(
        *keep,
        "n_words",
        (F.col("n_chars") - F.col("blank")).alias("word_chars"),
        F.col("symbol").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        class_distance.alias("class_distance"),
        common_distance.alias("common_distance"),
    ).withColumn(
        "kept",
        ~F.col("base_failed")
        & (F.coalesce("class_distance", F.lit(0.0)) <= rules.max_class_distance)
        & (F.coalesce("common_distance", F.lit(0.0)) <= rules.max_common_distance),
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    return judge(docs, rules).filter("kept").select("row.*")
