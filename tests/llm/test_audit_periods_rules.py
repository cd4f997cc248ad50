"""Filter audit, periodic runs and rule ensembles against brute force, planted labels and odd tables."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from strideline.llm import filter_audit, periods, queries, rules
from strideline.llm.columns import text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "`a.b` string, row bigint, n bigint, part string, mask int, stats string, runs int"


def _table(spark, rows):
    """doc_id, text, source rows with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3, "z", 4) for r in rows], f"doc_id bigint, text string, source string, {CLASH}")


# Periodic runs


def _runs(words, least, times):
    """Runs by their definition: every period, every maximal stretch, smallest period checked."""
    out, n = set(), len(words)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if i > start and length >= max(least, times * p):
                if not any(all(words[k] == words[k + q] for k in range(start, start + length - q)) for q in range(1, p)):
                    out.add((start, length, p))
            i += 1
    return sorted(out)


def _words(r, n):
    kinds = r.randint(1, 4)
    if r.random() < 0.5:
        return [r.randrange(kinds) for _ in range(n)]
    out = ([r.randrange(kinds) for _ in range(r.randint(1, 9))] * n)[:n]
    for _ in range(r.randint(0, 2) if n else 0):
        out[r.randrange(n)] = r.randrange(kinds)
    return out


def test_lyndon_lengths_are_those_of_the_definition():
    r = random.Random(1)
    for _ in range(400):
        s = _words(r, r.randint(0, 40))
        want = [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]
        assert periods.lyndon_lengths(s, max(s, default=-1) + 1) == want


def test_runs_equal_brute_force():
    r = random.Random(2)
    for _ in range(400):
        s = _words(r, r.randint(0, 70))
        for least, times in ((1, 3), (24, 3), (6, 4)):
            assert periods.runs_of(s, least, times) == _runs(s, least, times), s


def test_runs_of_a_block_of_texts():
    r = random.Random(3)
    many = [_words(r, r.randint(0, 70)) for _ in range(60)]
    far = [[f"u{i}" for i in range(40)] + ["a", "b", "c"] * 9 + [f"v{i}" for i in range(40)] + ["q"] * 30]
    for words in (many + far, [*far, []]):
        texts = [" ".join(f"w{x}" for x in s) for s in words]
        for s, (runs, kept, n) in zip(words, periods._search(texts, 24, 3), strict=True):
            assert (runs, n) == (_runs(s, 24, 3), len(s))
            gone = {i for a, length, p in runs for i in range(a + p, a + length)}
            assert kept == " ".join(f"w{x}" for i, x in enumerate(s) if i not in gone)


@pytest.mark.parametrize("kind", ["ones", "fibonacci", "thue", "rising", "saw"])
def test_runs_of_long_texts_take_linear_time(kind):
    n = 60_000
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    s = {"ones": [0] * n, "fibonacci": b[:n], "thue": [i.bit_count() & 1 for i in range(n)], "rising": list(range(n)), "saw": [i % 451 for i in range(n)]}[kind]
    found = periods.runs_of(s, 24, 3)
    if kind in ("ones", "saw"):
        assert found == [(0, n, {"ones": 1, "saw": 451}[kind])]
    elif kind == "fibonacci":
        assert len(found) > 100 and all(s[i] == s[i + p] for a, length, p in found[:50] for i in range(a, a + length - p))
    else:
        assert found == []


def _op12(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _runs(words, 24, 3)
    gone = {i for a, length, p in runs for i in range(a + p, a + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{length},{p}\n" for a, length, p in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *digest


def test_op12_equals_brute_force(spark, tmp_path):
    r = random.Random(4)
    rows = []
    for d in range(160):
        s = _words(r, r.randint(0, 90)) if d % 3 else [r.randrange(50) for _ in range(r.randint(0, 200))]
        rows.append((d, r.choice([" ", "\n", "\t "]).join(f"w{x}é" for x in s), "s"))
    rows += [(500, None, None), (501, "", "s"), (502, " \n ", "s"), (503, "a b  ", "s"), (None, "z " * 40, "s"), (7, rows[7][1], "s"), (504, "ab " * 900, "s")]
    _table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((_op12(d, t) for d, t, _ in rows), key=str)
    assert sum(g[1] > 0 for g in got) > 20


# Filter audit


def test_paths_over_the_lattice():
    for n in range(1, 6):
        edges = filter_audit.lattice(n)
        passed = {(s, f): 0 for s, f, _ in edges}
        for order in permutations(range(n)):
            for k in range(n):
                passed[sum(1 << f for f in order[:k]), order[k]] += 1
        assert {(s, f): w for s, f, w in edges} == passed and len(edges) == n << (n - 1)


def test_audit_of_three_filters_by_hand(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1), ("p", 1, 2, 0), ("p", 3, 4, 3), ("p", 7, 1, 1)], "part string, mask int, n bigint, bad bigint")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(counts, "ABC", ["bad"]).collect()}
    assert len(got) == 18
    assert [got["ABC", k].asDict() for k in (1, 2)] == [
        {"part": "p", "filter_order": "ABC", "step": 1, "kept": 5, "removed": 7, "redundant": 0, "unique_fails": 2, "bad_lost": 4, "shapley": 2 * 6 + 4 * 3 + 1 * 2},
        {"part": "p", "filter_order": "ABC", "step": 2, "kept": 5, "removed": 0, "redundant": 5, "unique_fails": 0, "bad_lost": 0, "shapley": 4 * 3 + 1 * 2},
    ]
    assert got["CBA", 1]["removed"] == 1 and got["CBA", 2]["removed"] == 4 and got["CBA", 3]["removed"] == 2
    with pytest.raises(ValueError):
        filter_audit.audit(counts, "ABCDEFGH", [])


def _fails(rows):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        f = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t))]
        out.append({c for c, x in zip("ABCDE", [*f, d is not None and d > first[t]], strict=True) if x})
    return out


def test_op13_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(90)]
    rows = []
    for d in range(120):
        t = " ".join(r.choice(vocab[: r.choice([20, 90])]) for _ in range(r.choice([10, 60, 90])))
        rows.append((d, t.upper() if d % 7 == 0 else t + " #" if d % 5 == 0 else t, r.choice(["s0", "s1", "", None])))
    rows += [(200 + k, rows[k % 9][1], rows[k][2]) for k in range(60)]
    rows += [(300, None, "s1"), (301, "", None), (None, rows[3][1], "s0"), (None, rows[3][1], "s0"), (3, rows[3][1], "s1"), (302, "one " * 20_000, "s0")]
    labels = [(d, d % 3 % 2, d % 4 == 0) for d in range(0, 260, 2)] + [(4, 1, True), (None, 1, True)]
    _table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, q, int(x)) for d, q, x in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x and d is not None}
    fails, parts = _fails(rows), {s or "" for *_, s in rows}
    want = {}
    for part in parts:
        mine = [(f, d) for f, (d, _, s) in zip(fails, rows, strict=True) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, c in enumerate(order):
                before, now = set(order[:k]), set(order[: k + 1])
                gone = [d for f, d in mine if c in f and not f & before]
                shapley[c] += len(gone)
                want[part, "".join(order), k + 1] = [
                    sum(not f & now for f, _ in mine), len(gone), sum(c in f and bool(f & before) for f, _ in mine), sum(f == {c} for f, _ in mine),
                    sum(d in good for d in gone), sum(d in toxic for d in gone), c,
                ]
        for order in permutations("ABCDE"):
            for k in range(5):
                row = want[part, "".join(order), k + 1]
                row[-1] = shapley[row[-1]]
    got = {tuple(x[:3]): list(x[3:]) for x in queries.op13_filter_audit(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 600 * len(parts)


def test_audit_of_an_empty_table(spark):
    docs = _table(spark, [(1, "x", "s")]).limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_five(docs, labels).count() == 0
    assert periods.find_runs(docs).count() == 0


# Rule ensemble


def _stats(text):
    w, lines = WORD.findall(text), [x for x in text.split("\n") if x.strip(" ")]
    share = lambda a, b: a / b if b else 0.0
    return {
        "capitals": share(sum(c.isupper() for c in text), len(text)), "letters": share(sum(c.isalpha() for c in text), len(text)),
        "digits": share(sum(c in "0123456789" for c in text), len(text)), "stops": share(sum(c in ".,;:!?" for c in text), len(text)),
        "symbols": share(sum(c in "#*$%&|<>@\\^_{}~" for c in text), len(text)), "breaks": share(text.count("\n"), len(text)),
        "words": math.log1p(len(w)), "word_length": share(sum(map(len, w)), len(w)), "longest": float(max(map(len, w), default=0)),
        "different": share(len(set(w)), len(w)), "different_lines": share(len(set(lines)), len(lines)),
        "ended_lines": share(sum(bool(re.search(r"[.!?]\s*$", x)) for x in lines), len(lines)),
        "stuttered": share(sum(a == b for a, b in zip(w, w[1:])), len(w)),
    }


def test_statistics_equal_plain_python(spark):
    texts = ["", "Word", "A b. a b!\n\nC,  c c\nA b.", "x " * 500, "# $|\nüÉ 12\t9", " \n\t "]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(rules.statistics(text_of("text")).alias("s")).collect()
    for t, r in zip(texts, got, strict=True):
        assert r["s"].asDict() == pytest.approx(_stats(t)), t


@pytest.fixture(scope="module")
def judged(spark, tmp_path_factory):
    """Good and junk texts of several kinds, two thirds labelled, with odd rows."""
    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(800)]
    rows, truth = [], {}
    for d in range(600):
        t = ". ".join(" ".join(r.choice(vocab) for _ in range(r.randint(5, 15))) for _ in range(r.randint(3, 20))) + "."
        kind = d % 8
        t = {0: t.replace(" ", " | "), 1: t.upper().replace(" ", "!! "), 2: "\n".join([t[:60]] * 30)}.get(kind, t)
        rows.append((d, t, "s"))
        truth[d] = int(kind > 2)
    odd = [(700, None, None), (701, "", "s"), (None, rows[3][1], "s"), (702, "long " * 50_000, "s"), (3, rows[3][1], "s")]
    out = tmp_path_factory.mktemp("judged")
    _table(spark, rows + odd).write.parquet(f"{out}/documents.parquet")
    labels = [(d, q, 0) for d, q in truth.items() if d % 3] + [(9, None, 0), (10, 7, 0), (None, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), rows + odd, truth


def test_op11_on_held_out_rows(spark, judged):
    got = queries.op11_quality_classifier(spark, judged[0]).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, *_ in judged[1])
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    unseen = [(r["predicted"], judged[2][r["doc_id"]]) for r in got if r["doc_id"] in judged[2] and (r["held_out"] or r["doc_id"] % 3 == 0)]
    assert len(unseen) > 200 and sum(a == b for a, b in unseen) >= 0.98 * len(unseen)


def test_scores_learn_from_held_in_labels_only(spark, judged, tmp_path):
    """Other labels of held-out rows, and other sources, leave every score as it is."""
    docs = spark.read.parquet(f"{judged[0]}/documents.parquet")
    docs.withColumn("source", F.lit("other")).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{judged[0]}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    a, b = ({(r["doc_id"], round(r["score"], 9)) for r in queries.op11_quality_classifier(spark, d).collect()} for d in (judged[0], str(tmp_path)))
    assert a == b


def test_compiled_rules_equal_plain_python(spark):
    model = rules.Ensemble(-0.5, (rules.Rule((("different", 0.5, math.inf),), 1.5), rules.Rule((("capitals", -math.inf, 0.1), ("words", 1.0, 3.0)), -2.0)))
    texts = ["", "Ab ab ab", "one two three four", "A A A A", "x " * 90]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(model.score(rules.statistics(text_of("text"))).alias("s")).collect()
    for t, r in zip(texts, got, strict=True):
        s = _stats(t)
        total = -0.5 + 1.5 * (s["different"] > 0.5) - 2.0 * (s["capitals"] <= 0.1 and 1 < s["words"] <= 3)
        assert r["s"] == pytest.approx(1 / (1 + math.exp(-total)))


def test_ensembles_without_two_labels(spark):
    stats = _table(spark, [(1, "a b", "s"), (2, "c", "s")]).select(F.col("doc_id").alias("id"), rules.statistics(text_of("text")).alias("stats"))
    for label, share in ((None, 0.5), (1, 1.0), (0, 0.0)):
        model = rules.fit(stats.withColumn("label", F.lit(label).cast("int")))
        assert model.rules == () and 1 / (1 + math.exp(-model.intercept)) == pytest.approx(share, abs=1e-5)
