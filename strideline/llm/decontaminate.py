"""Benchmark decontamination by template canonicalisation.

Words become a template: a number ``<num>``, a unit after a number ``<unit>``, a run
of capitalised words inside a sentence ``<name>``, any other word itself in lower case
without punctuation. Windows of ``width`` template words of the documents are
hash-joined with those of the benchmark items. Matched windows on one diagonal
(document position less item position) are one alignment; its slots must agree: an
item's value at a placeholder always meets the same document value and no two item
values meet one. Near diagonals (other names of more words, words put in or left out)
are added up as long as their slots agree. Windows that are matched and agree cover
item words; a document is contaminated by an item when they cover at least
``min_percent`` of its words. So copies are found, and so are questions with other
numbers, names or units.

The plain lower-cased words of the windows are hash-joined as well, so that a verbatim
copy is found whatever its case and however many numbers or names it holds. Items
shorter than a window have windows of their own length; those shorter than ``least``
words are looked for by their plain words only.

Defined results: null text is empty and matches nothing; slots are filled anew only in
windows of which half the words at least are literal; an item of at most ``alone`` words
is found only as a whole sentence or line, for inside running text it is a common
phrase; repeated rows are found alike; a very long text is
one row, read by native functions; equal hits of one document and item are one row; an empty table of either
kind gives an empty result. A result row is (doc, item); extra columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.llm.columns import BLANKS, let, row_key, row_of, text_of
from strideline.sources.scratch import Scratch

#: Units of measure, currency and time that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours "
    "day days week weeks month months year years percent pct usd eur gbp dollar dollars euro euros pound pounds cent cents "
    "kmh mph kph w kw kwh v a hz khz mhz ghz b kb mb gb tb meter meters metre metres kilometer kilometers kilometre kilometres "
    "gram grams kilogram kilograms litre litres liter liters mile miles inch inches foot feet degree degrees"
).split()


@dataclass(frozen=True)
class Decontamination:
    width: int = 8
    least: int = 5
    min_percent: int = 50
    alone: int = 2


#: Words between two kept counts of the places that joined words take.
BLOCK = 64
#: Marks that the templates put into a text: words of one value, a name, an end. Taken out of texts before.
_JOINT, _NAME, _END = "\u0001", "\u0002", "\u0003"


def _plain(text: Column) -> Column:
    """The words of a text in lower case without punctuation; of a text without words, one empty word."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}\s]+", "")
    return F.split(F.btrim(bare, F.lit(BLANKS)), r"\s+")


def _slotted(text: Column) -> Column:
    """Whether the text may hold a number or a name."""
    return text.rlike(r"\p{N}|[\p{L},;][ \t]\p{Lu}\p{L}")


def _template(text: Column) -> tuple[Column, Column]:
    """Template words of a text and their values one for one.

    A run of name words is one template word; \u0001 joins the words of its value.
    """
    # A capital after a blank and no sentence end marks a name.
    marked = F.regexp_replace(F.translate(text, _JOINT + _NAME + _END, ""), r"([\p{L}\p{N},;][ \t])(?=\p{Lu}\p{L})", "$1\u0002")
    marked = F.regexp_replace(marked, r"(\u0002[\p{L}\p{M}\p{N}'’-]+)[ \t](?=\u0002)", "$1\u0001")
    bare = F.regexp_replace(F.regexp_replace(marked, r"[^\p{L}\p{M}\p{N}\s\u0001\u0002]+", ""), r"[\s\u0002]*\s[\s]*", " ")
    bare = F.btrim(bare)
    # A number keeps one place, whatever its digits; a unit is named by the number before it.
    template = F.lower(F.regexp_replace(bare, r"\u0002\S+", "<name>"))
    template = F.regexp_replace(template, r"(^| )\p{N}\S*", "$1<num>")
    template = F.regexp_replace(template, r"<num> (?:" + "|".join(UNITS) + r")(?!\S)", "<num> <unit>")
    return F.split(template, " "), F.split(F.lower(F.replace(bare, F.lit(_NAME), F.lit(""))), " ")


def _joints(values: Column) -> Column:
    """How many more plain words than template words the values have."""
    return F.aggregate(values, F.lit(0), lambda n, x: n + F.length(x) - F.length(F.replace(x, F.lit("\u0001"), F.lit(""))))


def _hashes(words: Column, width: int, plain: bool) -> Column:
    """Hashes of all windows of ``width`` words, in their order; each word is hashed once. Null where there is none."""
    kind = F.lit(width if plain else -width)

    def windows(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - width)
        return F.when(F.size(h) >= width, F.transform(places, lambda i: F.xxhash64(kind, *[F.get(h, i + k) for k in range(width)])))

    return let(F.transform(words, lambda x: F.xxhash64(x)), windows)


def _sought(words: Column, width: int, plain: bool) -> Column:
    return let(words, lambda x: _hashes(x, width, plain))


def _ends(text: Column) -> Column:
    """Of each plain word, whether a sentence or line ends with it."""
    ended = F.regexp_replace(F.translate(text, _JOINT + _NAME + _END, ""), r"[.!?:;]+[\"'’”)\]]*(?=\s|\z)|[\r\n]+", "\u0003 ")
    bare = F.regexp_replace(ended, r"[^\p{L}\p{M}\p{N}\s\u0003]+", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[\s\u0003]*\u0003[\s\u0003]*", "\u0003 "), r"\A[\s\u0003]+|\s+\z", "")
    return F.transform(F.split(F.regexp_replace(bare, r"\s+", " "), " "), lambda x: x.endswith("\u0003"))


def _joints_before(values: Column) -> Column:
    """``_joints`` of all values before every BLOCK-th, in linear time."""
    blocks = F.sequence(F.lit(0), F.floor(F.size(values) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: _joints(F.slice(values, b * BLOCK + 1, BLOCK)))
    return F.aggregate(sums, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))


def _window(d: Column, before: Column, p: Column) -> Column:
    """A place of a document that was met: its words and values, its place among the plain words, and whether it is a whole sentence."""
    at, w = p["at"], p["w"]
    first = F.floor(at / BLOCK).cast("int")
    moved = F.get(before, first) + _joints(F.slice(d["dv"], first * BLOCK + 1, at - first * BLOCK))
    starts = (at == 0) | F.get(d["de"], at - 1)
    ends = (at + w == F.size(d["dp"])) | F.get(d["de"], at + w - 1)
    return F.struct(
        at.alias("dat"), w.alias("dw"), p["plain"].alias("dplain"),
        F.slice(F.when(p["plain"], d["dp"]).otherwise(d["dt"]), at + 1, w).alias("said"),
        F.slice(d["dv"], at + 1, w).alias("dvw"),
        (at + F.when(p["plain"], 0).otherwise(moved)).alias("place"),
        (starts & ends).alias("whole"),
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    cfg: Decontamination = Decontamination(),
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """doc, item, covered and item_words, and whether slots were filled anew, of every hit."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    (template, values), plain = _template(F.col("t")), _plain(F.col("t"))
    items = benchmark.select(F.col(item).alias("item"), text_of(item_text).alias("t")).select(
        "item", template.alias("it"), values.alias("iv"), plain.alias("ip"), F.btrim("t").rlike(r"^\p{Lu}\p{L}").alias("capital")
    )
    items = items.filter(F.get("ip", F.lit(0)) != "")
    fits = F.array(F.least(F.lit(cfg.width), F.size("ip")), F.least(F.lit(cfg.width), F.size("it")), F.least(F.lit(cfg.width), F.size("it") - 1))
    widths = sorted(r["w"] for r in items.select(F.explode(fits).alias("w")).distinct().filter("w > 0").collect())  # at most width numbers
    if not widths:
        widths = [cfg.width]
    # Fewer words than ``least`` are no template; a window without a slot is a plain one.
    filled = [w for w in widths if w >= cfg.least]

    def grams_of(rows: DataFrame, words: str, of: str, ws: list[int]) -> DataFrame:
        by_width = [F.struct(F.lit(w).alias("w"), _hashes(F.col(words), w, words == "ip").alias("hs")) for w in ws]
        made = rows.select("item", F.col(words).alias("words"), F.col(of).alias("of"), "ip", F.explode(F.array(*by_width)).alias("g"))
        made = made.filter(F.col("g.w") == F.least(F.lit(cfg.width), F.size("words")))
        made = made.select("item", "words", "of", "ip", F.col("g.w").alias("w"), F.posexplode("g.hs").alias("at", "h"))
        lo = F.col("at") + _joints(F.slice("of", 1, F.col("at")))
        inside = F.slice("of", F.col("at") + 1, F.col("w"))
        return made.select(
            F.col("h").alias("ih"), "item", F.col("at").alias("iat"), "w", F.size("ip").alias("item_words"),
            lo.alias("lo"), (lo + F.col("w") + _joints(inside)).alias("hi"),
            F.slice("words", F.col("at") + 1, F.col("w")).alias("iw"), inside.alias("ivw"), F.lit(words == "ip").alias("plain"),
        )

    grams = grams_of(items, "ip", "ip", widths)
    if filled:
        # Inside a document's sentence the capital that begins an item reads as a name, alone
        # or with the name after it: its first window has these forms too.
        def rest(x: str, k: int) -> Column:
            return F.slice(x, k, F.greatest(F.size(x) - k + 1, F.lit(0)))

        name = F.array(F.lit("<name>"))
        named = items.filter("capital").withColumn("it", F.concat(name, rest("it", 2)))
        runs = named.filter(F.get("it", F.lit(1)) == "<name>").withColumns(
            {"it": F.concat(name, rest("it", 3)), "iv": F.concat(F.array(F.array_join(F.slice("iv", 1, 2), "\u0001")), rest("iv", 3))}
        )
        first = grams_of(named, "it", "iv", filled).unionByName(grams_of(runs, "it", "iv", filled)).filter("iat = 0")
        slotted = grams_of(items, "it", "iv", filled).unionByName(first)
        literal = F.size(F.filter("iw", lambda x: ~x.startswith("<")))
        grams = grams.unionByName(slotted.filter((2 * literal >= F.col("w")) & (literal < F.col("w"))))
    # Saved, so that the planner knows its size: broadcast under the session's threshold, else merged.
    grams = scratch.save(grams, "grams")
    looked = docs.select(row_key(key, text).alias("doc"), F.col(key).alias("id"), text_of(text).alias("t"))
    # Windows with a slot differ from plain ones; texts without any are not made into templates.
    found = [_sought(plain, w, True) for w in widths]
    found += [F.when(_slotted(F.col("t")), _sought(template, w, False)) for w in filled]
    # Only ids, places and hashes meet the benchmark; the words follow for the documents that were hit.
    met = looked.select("doc", F.explode(F.array(*found)).alias("hs")).select("doc", F.posexplode("hs").alias("at", "h"))
    met = scratch.save(met.join(grams, F.col("h") == F.col("ih")), "met")
    # Of a document that was hit, its row gives the words of each place that was met, and no more: a join with
    # the document itself would carry all of its words with every window.
    hit_docs = scratch.save(met.groupBy(F.col("doc").alias("hit")).agg(F.collect_set(F.struct("at", "w", "plain")).alias("places")), "hit-docs")
    # Short ids first leave the texts of the others where they are; a shared short id only lets one more through.
    short = scratch.save(hit_docs.select(F.xxhash64("hit").alias("short")).distinct(), "hit-ids")
    looked = looked.join(short, F.xxhash64("doc") == F.col("short"), "left_semi")
    read = F.struct(template.alias("dt"), values.alias("dv"), plain.alias("dp"), _ends(F.col("t")).alias("de"))
    words = looked.join(hit_docs, F.col("doc") == F.col("hit")).select(
        F.col("doc").alias("of"), "id", F.inline(let(read, lambda d: let(_joints_before(d["dv"]), lambda before: F.transform("places", lambda p: _window(d, before, p)))))
    )
    words = scratch.save(words, "windows")
    slots = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.col("w") - 1),
            lambda i: F.struct(F.get(F.col("iw"), i).alias("kind"), F.get(F.col("ivw"), i).alias("ours"), F.get(F.col("dvw"), i).alias("theirs")),
        ),
        lambda s: ~F.col("plain") & s["kind"].startswith("<"),
    )
    hits = (
        met.join(words, (F.col("doc") == F.col("of")) & (F.col("at") == F.col("dat")) & (F.col("w") == F.col("dw")) & (F.col("plain") == F.col("dplain")))
        .filter((F.col("said") == F.col("iw")) & ((F.col("item_words") > cfg.alone) | F.col("whole")))
        .select("doc", "id", "item", "item_words", "w", "lo", "hi", (F.col("place") - F.col("lo")).alias("diagonal"), "iw", "ivw", "dvw", "plain")
        .select("doc", "id", "item", "item_words", "lo", "hi", "diagonal", slots.alias("slots"))
    )

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.array_sort(at),
            F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
            lambda s, x: F.struct(
                F.greatest(s["to"], x["hi"]).alias("to"), (s["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(s["to"], x["lo"]))).alias("n")
            ),
            lambda s: s["n"],
        )

    def agree(pairs: Column) -> Column:
        n = F.size(pairs)
        return (n == F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["kind"], p["ours"]))))) & (
            n == F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["kind"], p["theirs"]))))
        )

    aligned = (
        hits.groupBy("doc", "id", "item", "item_words", "diagonal")
        .agg(
            F.collect_set(F.struct("lo", "hi")).alias("at"),
            F.collect_set(F.when(F.size("slots") == 0, F.struct("lo", "hi"))).alias("literal_at"),
            F.array_distinct(F.flatten(F.collect_set("slots"))).alias("pairs"),
        )
        # Where slots disagree, only the windows without slots count.
        .withColumn("agree", agree(F.col("pairs")))
        .withColumns({"at": F.when(F.col("agree"), F.col("at")).otherwise(F.col("literal_at")), "pairs": F.when(F.col("agree"), F.col("pairs")).otherwise(F.slice("pairs", 1, 0))})
    )
    # A diagonal that is near the one before it belongs to the same copy.
    by = Window.partitionBy("doc", "item").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(by) > F.greatest(F.lit(cfg.width), F.col("item_words") / 2)
    aligned = aligned.withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn("copy", F.sum("far").over(by))
    parts = F.struct((-covered(F.col("at"))).alias("less"), "diagonal", "at", "literal_at", "pairs")
    copies = aligned.groupBy("doc", "id", "item", "item_words", "copy").agg(F.sort_array(F.collect_list(parts)).alias("parts"))

    def add(s: Column, x: Column) -> Column:
        """The widest diagonals first; of one whose slots disagree with theirs, the windows without slots."""
        pairs = F.array_distinct(F.concat(s["pairs"], x["pairs"]))
        return F.when(agree(pairs), F.struct(pairs.alias("pairs"), F.concat(s["at"], x["at"]).alias("at"))).otherwise(
            F.struct(s["pairs"].alias("pairs"), F.concat(s["at"], x["literal_at"]).alias("at"))
        )

    none = F.struct(F.slice(F.col("parts")[0]["pairs"], 1, 0).alias("pairs"), F.slice(F.col("parts")[0]["at"], 1, 0).alias("at"))
    copies = copies.select(
        "id", "item", "item_words", F.aggregate("parts", none, add).alias("all"), covered(F.flatten(F.transform("parts", lambda x: x["literal_at"]))).alias("copied")
    )
    least = cfg.min_percent * F.col("item_words")
    copies = copies.withColumn("covered", covered(F.col("all.at"))).filter(100 * F.col("covered") >= least)
    refilled = (F.col("copied") < F.col("covered")) & F.exists("all.pairs", lambda p: p["ours"] != p["theirs"])
    return copies.groupBy(F.col("id").alias("doc"), "item").agg(
        F.max("covered").cast("bigint").alias("covered"),
        F.max("item_words").cast("bigint").alias("item_words"),
        F.max(refilled).alias("refilled"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cfg: Decontamination = Decontamination(), key: str = "doc_id") -> DataFrame:
    """The documents that are on no hit; rows are told apart by id, null or not, and text."""
    packed = docs.select(row_of(docs).alias("row"), row_key(key, "text").alias("id"), F.col("text"))
    hit = find_contamination(packed.select("id", "text"), benchmark, cfg, "id").select(F.col("doc").alias("hit")).distinct()
    hit = Scratch(docs.sparkSession, "decontaminated").save(hit, "hits")
    return packed.join(hit, F.col("id") == F.col("hit"), "left_anti").select("row.*")
