"""The ten operators against brute force, round trips and held-out accuracy, and on edge cases."""

import hashlib
import math
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm import chat, decontaminate, html, jaccard, katz, langid, mixing, quality, secrets, suffixes
from strideline.llm.columns import crc_bucket

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _words(t):
    return WORD.findall((t or "").translate(LOWER))


def _docs(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def _some_texts(n=60, seed=3):
    r = np.random.default_rng(seed)
    vocab = ["".join(r.choice(list("abcdefghij"), 4)) for _ in range(400)]
    texts = [" ".join(r.choice(vocab, int(r.integers(1, 120)))) for _ in range(n)]
    base = " ".join(r.choice(vocab, 100))
    near = []
    for _ in range(12):  # near copies: some words changed
        w = base.split()
        for i in r.integers(0, 100, int(r.integers(0, 5))):
            w[i] = "x" + w[i]
        near.append(" ".join(w))
    passage = " ".join(r.choice(vocab, 60))
    return [*texts, *near, base, base, f"{texts[0]} {passage}", f"{passage} {texts[1]}", None, "", "   ", "one", "One two", "éé " * 40, texts[5].upper()]


@pytest.fixture(scope="module")
def texts():
    return _some_texts()


# op1


def test_main_text_of_marked_and_unmarked_pages():
    marked = (
        "<html><head><title>x</title></head><body><nav><a href='/'>Home</a></nav><article><header>h</header><h1>T &amp; x</h1><p>a  b&nbsp;c<br>d"
        "<p>e<div class='ad'>buy</div><p>f</p><section id='comments'><p>nice</p></section></article><footer>z</footer>"
    )
    assert html.main_text(marked) == "T & x\na b c d\ne\nf"
    long = "long text " * 20
    plain = f"<div class='menu'><a>x</a></div><div><p>{long}</p><p>s</p></div><div class=sidebar>no</div><p><a href=x>link</a></p>"
    assert html.main_text(plain) == long.strip() + "\ns"
    assert html.main_text("<script>if(a<b){'</p>'}</script><style>p{}</style><p>hello") == "hello"
    assert [html.main_text(x) for x in (None, "", "<p></p>", "<!-- a", "<script>x")] == [""] * 5


def test_main_text_is_not_swallowed():
    long = "long text " * 20
    body = f"<p>{long}</p>"
    want = long.strip()
    assert html.main_text(f"<html><head><title>x</title><meta charset=u><body>{body}") == want
    assert html.main_text(f"<head><script>'<p>'</script><title>x</title><article>{body}</article>") == want
    for tag in ("svg", "math", "iframe", "object"):
        assert html.main_text(f"<body><{tag} class='a>b' /><{tag}/>{body}") == want
        assert html.main_text(f"<{tag}>no</{tag}>{body}") == want
    nav, foot = "<nav><p>go there</p></nav>", "<footer>end</footer>"
    for wrap in ("<form id=aspnetForm>", "<div class='layout has-sidebar'>", "<div class='no-comments'>"):
        close = "</form>" if "form" in wrap[:5] else "</div>"
        for inner in (f"<article>{body}</article>", f"<div role=main>{body}</div>", body):
            assert html.main_text(f"<body>{wrap}{nav}{inner}<div class=sidebar>{long}</div>{foot}{close}" if inner != body else f"{wrap}{nav}{body}{foot}{close}") == want
    # Furniture stays furniture beside the article.
    assert html.main_text(f"<main>{body}</main><aside class=related><article>{long}</article></aside>") == want
    assert html.main_text(f"<div>{body}</div><div id=comments><p>{long}</p><p>{long}</p></div>") == want


def test_windows_decide_on_marked_pages():
    long = "long text " * 20
    nav = "<nav><p>x</p></nav>" * 4
    page = f"<main><p>stray</p>{nav}<h1>Head</h1><p>By me</p><p>{long}</p><p>end</p>{nav}<p>stray</p></main>"
    assert html.main_text(page) == f"Head\nBy me\n{long.strip()}\nend"
    assert html.main_text("<main><p>all</p><p>short</p></main>") == "all\nshort"
    links = "<a href=/home/>link words</a> " * 30
    assert html.main_text(f"<p>{links}</p><div><p>{long}</p></div>") == long.strip()  # the slash belongs to the value


def test_pages_are_read_in_linear_time():
    import time

    for make in (lambda n: "x <a y " * n, lambda n: "<b>" * n + "<p>z</p>" * n, lambda n: "<p>" * n, lambda n: "</x>" * n):
        took = []
        for n in (20_000, 80_000):
            began = time.perf_counter()
            html.main_text(make(n))
            took.append(time.perf_counter() - began)
        assert took[1] < 10 * took[0] + 0.2


def test_extract_text_on_frames(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a</p></article>"), (2, None, None), (2, None, None)], "page_id bigint, url string, html string")
    assert sorted(r["text"] for r in html.extract_text(pages.withColumn("text", F.lit("clash"))).collect()) == ["", "", "a"]
    assert html.extract_text(pages.limit(0)).count() == 0


# op2


def test_language_accuracy_and_code_switching(spark):
    r = np.random.default_rng(1)
    vocab = {"aa": ["".join(r.choice(list("abcde"), 5)) for _ in range(80)], "zz": ["".join(r.choice(list("vwxyz"), 5)) for _ in range(80)]}
    rows = [(i, " ".join(r.choice(vocab[lang], 30)), lang, "s", 0) for i in range(120) for lang in [("aa", "zz")[i % 2]]]
    docs = spark.createDataFrame(rows, DOCS)
    held = crc_bucket("doc_id", 3) == 1
    cfg = langid.Training(rounds=12)
    model = langid.fit(docs.filter(~held), cfg)
    odd = [(900, None, None, None, None), (901, "12 - !", None, None, None), (902, "", None, None, None), (903, vocab["zz"][0], None, None, None)]
    both = docs.unionByName(spark.createDataFrame(odd, DOCS))
    got = {r["k"]: r for r in langid.predict(both, model, {"k": F.col("doc_id")}).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _, _ in rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "zz"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    words = langid.Words([" ".join(vocab["aa"][:6] + vocab["zz"][:6])], model.lexicon)
    marginal, _ = langid.forward_backward(words.scores(model.weights), model.moves, np.array([0]), np.array([12]))
    assert marginal.argmax(axis=1).tolist() == [0] * 6 + [1] * 6  # the switch is labelled word by word
    assert langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None, {"k": F.col("doc_id")}).collect()} == {"und"}


def test_forward_backward_is_exact():
    r = np.random.default_rng(0)
    s, a = r.normal(size=(4, 3)), r.normal(size=(3, 3))
    want, z = np.zeros((4, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        p = math.exp(sum(s[t, y] for t, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:])))
        z += p
        for t, y in enumerate(path):
            want[t, y] += p
    got, moves = langid.forward_backward(s, a, np.array([0]), np.array([4]))
    assert np.allclose(got, want / z) and abs(moves.sum() - 3) < 1e-9


def test_pieces_carry_exact_messages():
    r = np.random.default_rng(1)
    s, a = r.normal(size=(23, 3)), 2 * r.normal(size=(3, 3))
    texts = [(0, 10), (10, 12), (12, 23)]
    whole, _ = langid.forward_backward(s, a, np.array([x for x, _ in texts]), np.array([y - x for x, y in texts]))
    for chain in (1, 2, 3, 5, 11):
        cuts = [(x + k, min(x + k + chain, y), k == 0) for x, y in texts for k in range(0, y - x, chain)]
        start, end, first = (np.array(c) for c in zip(*cuts, strict=True))
        ends = langid.messages(s, a, start, end - start, first)
        got, _ = langid.forward_backward(s, a, start, end - start, ends)
        assert np.allclose(got, whole, atol=1e-12)


# op3


def test_mix_meets_targets(spark, texts):
    docs = _docs(spark, texts * 3, sources={i: [None, "a", "b", "é", "Z"][i % 5] for i in range(3 * len(texts))})
    got = mixing.mix(docs).collect()
    assert len(got) == 3 * len(texts)
    size = defaultdict(int)
    for r in got:
        size[r["source"]] += r["size"]
        assert r["size"] == len(WORD.findall(docs_text(texts, r["doc_id"]))) and 0 <= r["taken"] <= 3 * r["size"]
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        share = {s: 3 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if share[s] > 3 * size[s]} - capped
        if not over:
            break
        capped |= over
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - share[s]) < 1e-6 and r["source_size"] == size[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - share[s]) <= max(r["size"] for r in own)
    assert sum(r["taken"] for r in got) == total
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


def docs_text(texts, i):
    return texts[i % len(texts)] or ""


def test_mix_without_words(spark):
    assert [r["taken"] for r in mixing.mix(_docs(spark, [None, "", " "])).collect()] == [0, 0, 0]
    assert mixing.mix(_docs(spark, ["a"]).limit(0)).count() == 0


# op4


def _katz(train, asked):
    c1, c2 = Counter(), Counter()
    for t in train:
        c1.update(t), c2.update(zip(["<s>", *t[:-1]], t))
    n = sum(c1.values())

    def factors(c):
        k = Counter(c.values())
        return katz.discounts([k[r] for r in range(7)])

    d1, d2 = factors(c1), factors(c2)
    d = lambda f, c: 1.0 if c > 5 else f[c]
    kept = sum(d(d1, c) * c for c in c1.values())
    total = n if kept < n else n + 1
    p1 = lambda w: d(d1, c1[w]) * c1[w] / total if w in c1 else 1 - kept / total
    after = defaultdict(dict)
    for (v, w), c in c2.items():
        after[v][w] = c

    def p(v, w):
        if v not in after:
            return p1(w)
        f = after[v]
        t, seen = sum(f.values()), sum(d(d2, c) * c for c in f.values())
        t = t if seen < t - 1e-9 else t + 1
        c = f.get(w, 0)
        return d(d2, c) * c / t if c else (1 - seen / t) / (1 - sum(map(p1, f))) * p1(w)

    for v in list(after)[:20]:
        assert abs(sum(p(v, w) for w in c1) + p(v, ("unseen",)) - 1) < 1e-9  # exactly normalised
    return [sum(math.log10(p(v, w)) for v, w in zip(["<s>", *t[:-1]], t)) for t in asked]


def test_katz_against_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(katz, "HOT_CONTEXTS", 20)  # several hot contexts on little data
    all_texts = texts * 2
    got = sorted(katz.score(_docs(spark, all_texts).repartition(5), crc_bucket("doc_id", 10) == 0).collect(), key=lambda r: r["doc_id"])
    tokens = [[*_words(t), None] for t in all_texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(tokens))]
    train = [t for t, h in zip(tokens, held) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    want = _katz(train, tokens)
    for i, r in enumerate(got):
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens[i]), sum(w in c for w in tokens[i]), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i]), rel_tol=1e-9)
        assert math.isclose(r["score"], want[i], rel_tol=1e-9, abs_tol=1e-9)


def test_katz_without_rows_or_training(spark):
    assert katz.score(_docs(spark, ["a"]).limit(0), F.lit(False)).count() == 0
    assert [(r["n_tokens"], r["score"]) for r in katz.score(_docs(spark, ["a b"]), F.lit(True)).collect()] == [(3, 0.0)]


# op5


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] == []
    assert q["access"] == [frozenset({frozenset({"aki", "kia"})})]
    (clause,) = q["assign"][:1]
    assert frozenset({"sec", "ecr", "cre", "ret"}) in clause and len(clause) == 6


def test_index_loses_no_match(spark):
    key = "0123456789abcdef" * 2
    cases = [
        "x PassWord = 'abcdefgh' y", "api_key:12345678", "APIKEY=short", "AKIA" + "A" * 12, "AKIA123", key, key[:31], None, "", "é" * 5 + " token=abcdefghi",
        "secret=token=abcdefgh12 AKIA" + "Z" * 16 + " " + key, "-----BEGIN RSA PRIVATE KEY-----", "tokenſecret=abcdefgh1", "K" * 3 + "toKen=abcdefgh",
    ]
    got = secrets.find_secrets(_docs(spark, cases).withColumn("spans", F.lit(1))).collect()
    for r in got:
        t = cases[r["row"]["doc_id"]] or ""
        want = sorted((a, k, b) for k, rule in enumerate(secrets.RULES) for a, b in rule.spans(t))
        names = [r.kind for r in secrets.RULES]
        assert [(s["start"], names.index(s["kind"]), s["end"]) for s in r["spans"]] == want
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(_docs(spark, cases)).collect()}
    assert clean[0] == "x <ASSIGN>' y" and clean[7] is None and clean[6] == key[:31]


def test_redaction_leaves_no_byte_of_a_key(spark):
    r = np.random.default_rng(1)
    lines = ["".join(r.choice(list("ABCDEFGHijklmnop0123456789+/"), 64)) for _ in range(5)] + ["Zz9+Zz8="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n"
    bodies = ["\n".join(lines), head + "\n".join(lines), "\\n".join(lines), "\r\n".join(lines)]
    cases = [f"before {begin}{g}{b}{g}{end} after" for b, g in zip(bodies, ["\n", "\n", "\\n", "\r\n"], strict=True)]
    cases += [f"before {begin}{g}{b}{g} after" for b, g in zip(bodies, ["\n", "\n", "\\n", "\r\n"], strict=True)]
    cases += [f"before {begin} after", "".join(f"before {begin}\n{bodies[0]}\n{end} after " for _ in range(2)).strip()]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(_docs(spark, cases)).collect()}
    for i, c in enumerate(cases):
        assert not any(x in clean[i] for x in [*lines, "END", "DEK"]), clean[i]
        assert clean[i].startswith("before <PRIVATE_KEY>") and clean[i].endswith("after")
    assert clean[len(cases) - 1].count("<PRIVATE_KEY>") == 2


# op6


def test_quality_counts(spark, texts):
    extra = ["a b c\na b c\n\nx", "#$% <&>| a b", "a " * 60, "Émile, 12! " * 30]
    every = [*texts, *extra]
    got = {r["row"]["doc_id"]: r for r in quality.judge(_docs(spark, every).withColumn("kept", F.lit(1))).collect()}
    for i, t in enumerate(every):
        t = t or ""
        w = WORD.findall(t)
        lines, seen = 0, set()
        for line in t.split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), lines, len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_quality_keeps_clean_and_rejects_other_distributions(spark):
    r = np.random.default_rng(5)
    words = ["the", "of", "and", "to", "in"] * 20 + ["".join(r.choice(list("abcdefgh"), 6)) for _ in range(100)]
    clean = [" ".join(r.choice(words, 300)) for _ in range(40)]
    junk = [" ".join(w + "%%%$$$" for w in r.choice(words, 300))]
    got = {x["row"]["doc_id"]: x["kept"] for x in quality.judge(_docs(spark, clean + junk)).collect()}
    assert all(got[i] for i in range(40)) and not got[40]
    assert quality.judge(_docs(spark, clean).limit(0)).count() == 0


# op7


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<|im_start|>assistant ok", "\\", "\\s", "\\p", "<\\p", "<", "|", "<<|", "", None, "a\nb\n", "\\<|\\"]
    rows = [(c, t, ("user", "assistant", None)[(t + c) % 3], x) for c in range(3) for t, x in enumerate(nasty)] + [(None, 1, "user", "x"), (9, None, "a\nb\\", "y"), (9, None, "a\nb\\", "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    back = {r["conv_id"]: r for r in chat.parse(chat.render(chat.fold_events(chat.rows_as_events(df)))).collect()}
    for c in range(3):
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r or "", x or "") for k, _, r, x in rows if k == c]
        spans = [back[c]["formatted"][s["start"] : s["start"] + s["length"]] for s in back[c]["loss_spans"]]
        assert [s.replace("\\p", "|").replace("\\s", "\\") for s in spans] == [x or "" for k, _, r, x in rows if k == c and r == "assistant"]
    assert len(back[None]["turns"]) == 1 and [t["role"] for t in back[9]["turns"]] == ["a\nb\\"] * 2


def test_chat_events_fold(spark):
    e = [
        (1, 1, "message", 10, "user", "hi"), (1, 2, "delta", 11, "assistant", "he"), (1, 3, "delta", 11, None, "llo"), (1, 4, "edit", 10, None, "hey"),
        (1, 5, "regenerate", 11, None, None), (1, 6, "delta", 11, None, "good "), (1, 7, "delta", 11, None, "day"),
    ]
    df = spark.createDataFrame(e, "conv_id int, seq int, kind string, msg_id int, role string, text string")
    got = sorted(chat.fold_events(df).collect(), key=lambda r: r["seq"])
    assert [(r["role"], r["text"]) for r in got] == [("user", "hey"), ("assistant", "good day")]
    assert chat.fold_events(df.limit(0)).count() == 0


# op8


def test_suffixes_against_brute_force(spark, texts):
    every = [*texts, "ab" * 80, "ab" * 60 + "c", texts[0][:49], "z" * 200, None]
    got = {r["row"]["doc_id"]: r for r in suffixes.remove_repeats(_docs(spark, every)).collect()}
    first: dict[bytes, int] = {}
    raw = [(t or "").encode() for t in every]
    for d, b in enumerate(raw):
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, b in enumerate(raw):
        gone = {i + k for i in range(len(b) - 49) if first[b[i : i + 50]] < d for k in range(50)}
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        spans = sum(i in gone and i - 1 not in gone for i in range(len(b)))
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], bytes(got[d]["kept"])) == (len(b), len(gone), spans, kept)


def test_suffix_order_is_sorted(texts):
    raw = [(t or "").encode() for t in texts[:6]] + [b"ab" * 200, b"z" * 100]
    data = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(v) for v in raw])
    places = np.concatenate([np.arange(e - len(v), max(e - len(v), e - 49)) for e, v in zip(end, raw, strict=True)])
    got = suffixes.suffix_order(data, places, 50)
    prefixes = [bytes(data[i : i + 50]) for i in got]
    assert prefixes == sorted(prefixes) and sorted(got) == sorted(places)


def test_suffix_work_stays_in_the_cache(monkeypatch):
    """Over 2 MB of text, fingerprints and suffix arrays are worked on in short stretches, with the same result."""
    data = np.random.default_rng(8).integers(97, 101, 1 << 21).astype(np.uint8)
    suffixes.minima(data, 50)  # powers that are kept
    tracemalloc.start()
    m = suffixes.minima(data, 50)
    peak = tracemalloc.get_traced_memory()[1] - m.nbytes
    tracemalloc.stop()
    assert peak < 4 << 20
    at = np.arange(len(data) - suffixes.GRAM + 1)
    grams = suffixes.Spans(data).hash(at, at + suffixes.GRAM)
    assert np.array_equal(m, np.lib.stride_tricks.sliding_window_view(grams, 50 - suffixes.GRAM + 1).min(1))

    # 8,000 pieces of 4,000 fingerprints, two different pieces each
    rng = np.random.default_rng(9)
    pieces = [x + tail for x in (rng.integers(97, 123, 55).astype(np.uint8).tobytes() for _ in range(4_000)) for tail in (b"one", b"other")]
    fp, pid, least = np.repeat(np.arange(4_000), 2), np.arange(8_000), rng.integers(0, 100, 8_000)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(fp * 0), *map(pa.array, (pid, fp, pid, least, least + 1)), pa.array(pieces, pa.binary())],
        names=["block", "at", "fp", "pid", "least", "greatest", "bytes"],
    )
    sorted_bytes = []
    plain = suffixes.suffix_order
    monkeypatch.setattr(suffixes, "suffix_order", lambda data, *rest: sorted_bytes.append(len(data)) or plain(data, *rest))
    out = suffixes.lows_of([batch], 50)
    rows = out.to_pydict()
    got = {p: np.repeat(low, list(n)).tolist() for p, low, n in zip(rows["piece"], rows["low"], rows["places"], strict=True)}
    assert sum(sorted_bytes) == sum(map(len, pieces)) and max(sorted_bytes) <= suffixes.SORTED_BYTES + 200
    for p in range(8_000):
        want = [min(least[p], least[p ^ 1])] * 7 + [least[p]] * (len(pieces[p]) - 56)  # both tails begin with an o
        assert got[p] == want


def test_cut_joins_spans_that_meet():
    def packed(*spans):
        return np.array([a << 32 | b for a, b in spans], np.int64)

    raw = bytes(range(40))
    assert suffixes.cut(raw, packed((30, 35), (2, 6), (6, 9), (3, 4), (34, 40))) == (40, 17, 2, raw[:2] + raw[9:30])
    assert suffixes.cut(raw, packed()) == (40, 0, 0, raw)


def test_order_is_stable():
    for top in (3, 1 << 40, 1 << 62):
        key = np.random.default_rng(top % 7).integers(0, top, 5_000) // 2 * 2
        assert np.array_equal(suffixes._order(key), np.argsort(key, kind="stable"))


def test_suffixes_of_nothing(spark):
    assert suffixes.remove_repeats(_docs(spark, ["a"]).limit(0)).count() == 0
    assert hashlib.sha256(suffixes.remove_repeats(_docs(spark, [None])).first()["kept"]).hexdigest().startswith("e3b0")


# op9

ITEM = "A train leaves the northern station at 9 with 120 passengers and meets Maria after 45 minutes near the river bridge"


def _bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, "tiny one"), (3, None), (4, "This is a six word item")], "item_id bigint, text string")


def test_contamination(spark):
    filler = "some quite ordinary words that are in no benchmark at all and go on for a while "
    renamed = ITEM.replace("9", "10").replace("120", "300").replace("Maria", "Peter").replace("45", "50")
    mixed = renamed.replace("300", "10")  # two item values meet one document value
    docs = [filler + ITEM + " " + filler, filler + renamed, filler, None, "", filler + "This is a six word item. " + filler, filler + mixed, "tiny one " * 3]
    hits = decontaminate.find_contamination(_docs(spark, docs).withColumn("item", F.lit(0)), _bench(spark)).collect()
    assert {(r["doc"], r["item"], r["refilled"]) for r in hits if r["doc"] != 6} == {(0, 1, False), (1, 1, True), (5, 4, False)}
    assert {r["doc"] for r in hits if r["doc"] == 6 and r["refilled"]} == set()
    kept = decontaminate.drop_contaminated(_docs(spark, docs), _bench(spark))
    assert {2, 3, 4, 7} <= {r["doc_id"] for r in kept.collect()} and kept.columns == _docs(spark, docs).columns


def test_contamination_by_plain_words(spark):
    filler = "some quite ordinary words that are in no benchmark at all and go on for a while "
    items = ["What is 3 + 5 * 12 - 7 + 40", "Call Anna Bert Carl Dora Emil Fritz Greta Hans", "How many is 7", ITEM, "yes"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = [filler + x + " " + filler for x in items[:4]]
    docs += [filler + ITEM.lower() + " " + filler, filler + ITEM.title(), filler + "and yes " + filler, "Is it so?\n\nYes.\n" + filler, "yes", filler]
    docs.append(filler + items[0].replace("5", "6").replace("12", "9"))  # other numbers among few literal words
    hits = decontaminate.find_contamination(_docs(spark, docs), bench).collect()
    assert {(r["doc"], r["item"]) for r in hits} == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 3), (7, 4), (8, 4)}
    assert not any(r["refilled"] for r in hits)


def test_contamination_over_near_diagonals(spark):
    filler = "some quite ordinary words that are in no benchmark at all and go on for a while "
    words = [f"w{chr(97 + i)}" for i in range(30)]
    words[10], words[20] = "Maria", "Peter"
    item = " ".join(words)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    plain = item.lower().split()
    docs = [
        item.replace("Maria", "Ana Lopez").replace("Peter", "Jan van Ek").replace("van", "Van"),
        " ".join([*plain[:10], "so", *plain[10:20], "then", *plain[20:]]),
        " ".join([*plain[:9], *plain[10:20], *plain[21:]]),
        " ".join([*plain[:9], filler * 4, *plain[20:]]),  # pieces far from each other
        item.replace("Maria", "Ana Lopez").replace("Peter", "Ana Lopez"),  # only one of the slots counts
    ]
    hits = decontaminate.find_contamination(_docs(spark, [filler + x + " " + filler for x in docs]), bench).collect()
    assert {(r["doc"], r["refilled"]) for r in hits} == {(0, True), (1, False), (2, False), (4, True)}
    assert all(r["covered"] <= 30 and r["item_words"] == 30 for r in hits)


def test_contamination_of_null_and_shared_ids(spark):
    rows = [(None, "so " + ITEM, "a"), (None, "clean text", "b"), (7, "and " + ITEM, "c"), (7, "another clean text", "d"), (8, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mark string")
    assert {(r["doc"], r["item"]) for r in decontaminate.find_contamination(docs, _bench(spark)).collect()} == {(None, 1), (7, 1)}
    kept = decontaminate.drop_contaminated(docs, _bench(spark))
    assert {r["mark"] for r in kept.collect()} == {"b", "d", "e"} and kept.columns == docs.columns


def test_contamination_of_nothing(spark):
    assert decontaminate.find_contamination(_docs(spark, ["a"]).limit(0), _bench(spark)).count() == 0
    assert decontaminate.find_contamination(_docs(spark, [ITEM]), _bench(spark).limit(0)).count() == 0


# op10


def _components(texts):
    sets = []
    for t in texts:
        w = _words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_jaccard_against_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    texts = _some_texts(40, seed)
    base = ["".join(r.choice(list("klmnop"), 5)) for _ in range(60)]
    for k in range(25):  # a chain and a cloud around one text
        w = list(base)
        for i in r.integers(0, 60, k % 4):
            w[i] = f"q{k}"
        texts.append(" ".join(w[: 60 - k % 7]))
    got = {x["doc"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_duplicates(_docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == _components(texts)


def test_one_of_each(spark, texts):
    docs = _docs(spark, texts)
    docs = docs.unionByName(docs)  # every row twice
    kept = [r["doc_id"] for r in jaccard.one_of_each(docs).collect()]
    want = _components(texts)
    blank = [i for i, (n, _) in enumerate(want) if not n]
    assert sorted(kept) == sorted([i for i, (n, c) in enumerate(want) if n and c == i] + blank + blank)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_judges_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, a), (None, a + " more"), (3, b), (None, b), (None, c), (5, None), (None, ""), (4, b)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum((r["text"] or "").startswith("a0 ") for r in kept) == 1
    assert sorted(((r["doc_id"], r["text"]) for r in kept if r["text"] in (b, c)), key=str) == sorted([(3, b), (None, c)], key=str)
    assert sum(not r["text"] for r in kept) == 2 and len(kept) == 5


# All


def test_pipeline_stages_on_odd_rows(spark, texts, tmp_path):
    import corpus_pipeline

    filler = "the quick brown fox jumps over a lazy dog while many other small animals look on from afar "
    docs = _docs(spark, [*texts, filler * 5, None])
    assert docs.schema == T._parse_datatype_string(DOCS)
    _bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert out.count() <= docs.count()


@pytest.mark.parametrize(
    "made",
    [lambda n: "<a" + ' "<a"' * n, lambda n: '<div class="nav">x' * n, lambda n: '<div class="no-comments">x y' * n, lambda n: "<svg \"" * n, lambda n: "<script 'x'" * n],
)
def test_pages_of_one_mark_take_linear_time(made):
    """Twice the page takes about twice the time; quadratic work would take four times as much and minutes here."""
    took = []
    for n in (20_000, 40_000):
        began = time.process_time()
        html.main_text(made(n))
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 0.5 and took[1] < 20


def test_references_do_not_run_across_tags_and_an_articles_header_stays():
    filler = "word " * 30
    assert html.main_text(f"<p>a &<b>lt;</b> b {filler}</p>").startswith("a &lt; b word")
    page = f'<body><header><h1>Site</h1></header><article><header class="article-header"><h1>Title</h1></header><p>{filler}</p><nav>go</nav></article></body>'
    assert html.main_text(page) == f"Title\n{filler.strip()}"


def test_contamination_in_a_long_text_of_one_item(spark):
    """A text that repeats an item thousands of times is read in time linear in its length."""
    text = (ITEM + ". ") * (200_000 // (len(ITEM) + 2))
    hits = decontaminate.find_contamination(_docs(spark, [text, "nothing of it"]), _bench(spark)).collect()
    assert {r["doc"] for r in hits} == {0}


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_rules_take_linear_time(rule):
    """On runs of what a rule begins with, twice the text takes about twice the time."""
    starts = {"assign": "token=", "access": "AKIA", "hex": "0f", "private_key": "-----BEGIN PRIVATE KEY-----\n", "jwt": "eyJ", "forge_token": "ghp_", "chat_token": "xoxb-", "cloud_key": "AIza", "payment_key": "sk_live_", "url_password": "://a:"}
    took = []
    for n in (60_000, 120_000):
        text = starts[rule.kind] * (n // len(starts[rule.kind]))
        began = time.process_time()
        rule.spans(text)
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 0.3
