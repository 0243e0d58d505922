"""Operators 2, 4, 5 and 10 and the pipeline against plain versions on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest

from tessera.llm import decontamination, langid, repeated_spans, secrets, toxicity, weak_quality
from tests.llm.test_operators_a import SMALL, plain_components, plain_fingerprint, plain_secrets

ODD = [
    (1, "", None, None),
    (2, None, "en", None),
    (4, "one two three four five", "en", "a"),
    (4, "one two three four five", "en", "a"),
    (None, "Ünïcode tëxt   with words", "de", "b"),
    (7, "  \n\t ", None, "b"),
    (8, "word " * 20_000, "en", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, lang string, source string, share int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def plain_removal(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    keyed = {(d is not None, d or 0, t or ""): d for d, t in rows}
    seen: dict[bytes, tuple] = {}
    out = {}
    for key in sorted(keyed):
        data = key[2].encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i : i + 100] = True
            else:
                seen[s] = key
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out[key] = (keyed[key], len(data), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return sorted((out[(d is not None, d or 0, t or "")] for d, t in rows), key=str)


def test_repeated_spans(spark, odd):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, repeated_spans.removal_digests(df).collect()), key=str) == plain_removal([tuple(r) for r in df.collect()])
    rng = random.Random(3)
    base = ["".join(rng.choice("abé \n") for _ in range(n)) for n in (99, 100, 150, 400, 1000)]
    texts = base + [base[4][100:260] + base[3], base[2] * 3, "x" * 500, "y" + "x" * 120, base[1], base[3][:250] + "!" + base[3][251:]]
    texts += [rng.choice("pqr") * 7 + base[3][rng.randrange(100) :] + rng.choice("uvw") for _ in range(150)]  # one crowded passage
    rows = list(enumerate(texts)) + [(None, base[0] + base[4]), (1, base[1])]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).union(odd.select("doc_id", "text"))
    assert sorted(map(tuple, repeated_spans.removal_digests(made).collect()), key=str) == plain_removal([tuple(r) for r in made.collect()])
    assert repeated_spans.removal_digests(odd.limit(0)).count() == 0
    assert repeated_spans.remove_repeats(odd).count() == len(ODD)


def test_weak_quality(spark, odd):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = weak_quality.quality_scores(df).collect()
    got = {r.doc_id: r.kept for r in rows}
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert got.keys() == {r.doc_id for r in df.select("doc_id").collect()}
    good, junk = [i for i, q in truth.items() if q == 1], [i for i, q in truth.items() if q == 0]
    assert sum(got[i] for i in good) >= 0.99 * len(good)
    assert sum(not got[i] for i in junk) >= 0.95 * len(junk)
    v = {r.doc_id: weak_quality.pattern_votes(np.array([r.pattern]))[0] for r in rows}
    right = lambda kept: sum(kept(i) for i in good) + sum(not kept(i) for i in junk)
    assert right(lambda i: got[i]) > right(lambda i: v[i].sum() > 0)  # the majority of the labellers
    assert sorted(map(tuple, weak_quality.quality_scores(df.repartition(7)).collect())) == sorted(map(tuple, rows))
    assert weak_quality.quality_scores(odd).count() == len(ODD)
    assert weak_quality.quality_scores(odd.limit(0)).count() == 0


def plain_votes(text: str | None) -> list[int]:
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0, 0, 0, 0, -1, 0, 0]
    n, low = len(words), [w.lower() for w in words]
    letters = re.findall(rb"[A-Za-z]", data)
    grade = lambda value, good, junk: 1 if value <= good else -1 if value >= junk else 0
    mean = sum(map(len, words)) / n
    return [
        grade(len(re.findall(rb"[#*$%&|<>]", data)) / n, 0.05, 0.2),
        grade(len(re.findall(rb"[A-Z]", data)) / max(1, len(letters)), 0.15, 0.5),
        grade(sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, 0.05, 0.2),
        grade(data.count(b"!") / n, 0.05, 0.2),
        int(n >= 20),
        1 if 2.5 <= mean <= 9.5 else -1 if mean < 2 or mean > 14 else 0,
        0 if n < 20 else grade(-len(set(low)) / n, -0.3, -0.15),
    ]


def test_weak_quality_by_brute_force(spark, odd):
    """Votes, their expectation maximisation and the posteriors by plain loops over documents."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = [tuple(r) for r in df.collect()]
    v = [plain_votes(t) for _, t in rows]
    k = len(weak_quality.LABELLERS)
    rates = [[0.9 if c == j + 1 else 0.01 for j in range(k)] for c in range(k + 1)]
    start, shares = [list(r) for r in rates], [0.8] + [0.2 / k] * k
    for _ in range(weak_quality.ROUNDS):
        posts = []
        for d in v:
            like = [shares[c] * np.prod([1.0 if x == 0 else rates[c][j] if x < 0 else 1 - rates[c][j] for j, x in enumerate(d)]) for c in range(k + 1)]
            posts.append([x / sum(like) for x in like])
        rates = [
            [(sum(p[c] for p, d in zip(posts, v, strict=True) if d[j] < 0) + 2 * start[c][j]) / (sum(p[c] for p, d in zip(posts, v, strict=True) if d[j]) + 2) for j in range(k)]
            for c in range(k + 1)
        ]
        shares = [sum(p[c] for p in posts) + 1 for c in range(k + 1)]
        shares = [s / sum(shares) for s in shares]
    want = sorted((str(i), sum((x + 1) * 3**j for j, x in enumerate(d)), round(p[0], 6)) for (i, _), d, p in zip(rows, v, posts, strict=True))
    got = sorted((str(r.doc_id), r.pattern, round(r.posterior, 6)) for r in weak_quality.quality_scores(df).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, want, strict=True)) < 1e-5


def test_label_model_finds_rates():
    rng = np.random.default_rng(1)
    kind = np.where(rng.random(20_000) < 0.85, -1, rng.integers(0, 7, 20_000))
    junk = rng.random((20_000, 7)) < np.where(np.arange(7) == kind[:, None], 0.95, 0.01)
    codes, at, counts = np.unique(weak_quality.pattern_codes(np.where(junk, -1, 1)), return_inverse=True, return_counts=True)
    posterior, rates, shares = weak_quality.estimate(codes, counts.astype(float))
    assert abs(shares[0] - 0.85) < 0.08
    assert ((posterior[at] > 0.5) == (kind < 0)).mean() > 0.9
    assert rates[0].max() < 0.05 < 0.8 < min(rates[k + 1][k] for k in range(7))


def plain_words(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)


def test_decontamination(spark, odd):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
    exact = set()
    items = [(r.item_id, " " + " ".join(plain_words(r.text)) + " ") for r in bench.collect()]
    for r in df.collect():
        text = " " + " ".join(plain_words(r.text)) + " "
        exact |= {(r.doc_id, i) for i, w in items if w in text}
    assert exact <= found
    assert len(found) <= len(exact) * 1.1
    rng = random.Random(2)
    words = plain_words(bench.orderBy("item_id").first().text)
    changed = list(words)
    for i in rng.sample(range(len(words)), len(words) // 6):
        changed[i] = "zzz"
    filler = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    made = spark.createDataFrame([(1, f"{filler} {' '.join(changed)} {filler}"), (2, filler), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id for r in decontamination.contaminated(made, bench).collect()} == {1}
    assert decontamination.contaminated(odd, bench).count() == 0
    assert decontamination.contaminated(odd, bench.limit(0)).count() == 0
    assert decontamination.drop_contaminated(odd, bench).count() == len(ODD)


def test_lcs():
    rng = random.Random(4)
    for _ in range(200):
        a, b = [[rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.lcs_length(a, b) == table[-1][-1]


def test_lcs_of_many_passages():
    rng = random.Random(8)
    items = [[rng.randrange(9) for _ in range(n)] for n in (1, 8, 33, 63, 64)]
    text = np.array([rng.randrange(12) for _ in range(700)])
    masks = np.zeros((len(items), 13), np.uint64)
    for k, item in enumerate(items):
        for i, w in enumerate(item):
            masks[k, w] |= np.uint64(1 << i)
    runs = [(rng.randrange(len(items)), *sorted(rng.sample(range(701), 2))) for _ in range(300)]
    item, left, right = np.array(runs).T
    got = decontamination.batched_lcs(masks, text, item, np.array([len(x) for x in items]), left, right)
    assert got.tolist() == [decontamination.lcs_length(items[k], text[a:b].tolist()) for k, a, b in runs]


def test_toxicity(spark, odd, labels):
    sf = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    more = [
        (10**6, "The end of the road is near, you 1d10t and i d i o t."),
        (10**6 + 1, "the thing is of st00pid and wooorthless, really"),
        (10**6 + 2, "The end of the road is near and 1 2 3 4 5 words are 100% fine, a b."),
        (10**6 + 3, "well, you are a s t u p i d one"),
        (10**6 + 4, "the end, you-1d10t"),
        (10**6 + 5, "the end is such_an_1d10t"),
        (10**6 + 6, "A B C D E F G and the table of 1999, 2000 and 2001 costs 20$ or 30$"),
    ]
    made = spark.createDataFrame([(*m, None, None, None) for m in more], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(df.union(made), labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sum(got[i].predicted == 1 for i in held if truth[i]) >= 0.85 * sum(truth[i] for i in held)
    assert sum(got[i].predicted == 0 for i in held if not truth[i]) >= 0.98 * sum(1 - truth[i] for i in held)
    assert got[10**6].predicted == 1
    assert got[10**6 + 1].predicted == 1
    assert got[10**6 + 2].predicted == 0
    assert [got[10**6 + k].predicted for k in (3, 4, 5, 6)] == [1, 1, 1, 0]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(odd, none).count() == len(ODD)
    assert toxicity.toxicity_scores(odd.limit(0), none).count() == 0


def test_restoring():
    rng = np.random.default_rng(0)
    text = " ".join(rng.choice(["the", "idiot", "moron", "good", "letter", "stupid", "street"], 5000))
    c = toxicity._CLASS[np.frombuffer(text.encode(), np.uint8)]
    model = toxicity.character_model(np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3))
    want = {"1d10t": "idiot", "i d i o t": "idiot", "idiooot": "idiot", "m.o.r.o.n": "moron", "5tup1d": "stupid", "goood": "good", "good-1d10t": "good idiot", "the_5treet": "the street"}
    assert {k: toxicity.restore(k, model) for k in want} == want
    assert toxicity.restore("i" + "-" * 5000 + "d10t", model) == "idiot"
    assert toxicity.restore("1d10t\u00e9", model).startswith("idiot\u00e9"[:5])
    pieces = lambda t: [p for _, p, _ in toxicity.hidden_pieces(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))]
    assert pieces("a$$ dumb@$$ good! 100% d\u00fcmml1ng") == [b"a$$", b"dumb@$$", "d\u00fcmml1ng".encode()]


def plain_path(piece: str, model: np.ndarray) -> float:
    """The best score of a piece by trying every path of its lattice."""
    import itertools

    best = -np.inf
    for path in itertools.product(*toxicity.lattice(piece)):
        codes = [0, 0, *(toxicity.letter_class(c) for letters, _ in path for c in letters), 0]
        best = max(best, sum(model[codes[i], codes[i + 1], codes[i + 2]] for i in range(len(codes) - 2)) - sum(cost for _, cost in path))
    return best


def test_restoring_by_brute_force():
    rng = np.random.default_rng(2)
    model = toxicity.character_model(rng.integers(0, 50, 27**3))
    for _ in range(60):
        piece = "".join(rng.choice(list("ab10|-.@!x"), rng.integers(3, 8)))
        got = toxicity.restore(piece, model)
        fits = [p for p in __import__("itertools").product(*toxicity.lattice(piece)) if "".join(x for x, _ in p) == got]
        score = lambda p: sum(model[c[i], c[i + 1], c[i + 2]] for c in [[0, 0, *(toxicity.letter_class(x) for letters, _ in p for x in letters), 0]] for i in range(len(c) - 2)) - sum(k for _, k in p)
        assert abs(max(map(score, fits)) - plain_path(piece, model)) < 1e-9


def test_trigrams_end_with_their_document(spark):
    texts = ["abc", "", None, "d e f", "xyz 12"]
    rows = list(enumerate(texts)) * 3
    counts = [toxicity.trigram_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)) for n in (1, 4)]
    want = np.zeros(27**3, np.int64)
    for _, t in rows:
        c = [0, 0, *(ord(x) - 96 if x.isalpha() else 0 for x in t or ""), 0, 0]
        for i in range(len(c) - 2):
            want[c[i] * 729 + c[i + 1] * 27 + c[i + 2]] += 1
    assert all((c[1:] == want[1:]).all() for c in counts)


def plain_tail(rows: list[tuple[int | None, str]], items: list[str]) -> list[tuple]:
    """What the stages after language ID return, by plain versions of them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.test_leaks import plain_found
    from tests.llm.test_nearcopies import plain_firsts

    left = plain_firsts(rows)
    bad = {d for d, _ in plain_found(dict(enumerate(t for _, t in left)), dict(enumerate(items)))}
    want = []
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in (row for k, row in enumerate(left) if k not in bad):
        for a, b, kind in reversed(secrets._merged(plain_secrets(text))):
            text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(want, key=str)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = {r.doc_id for r in langid.language_digests(docs).collect() if r.lang_pred != "und" and r.score >= 0.5}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, got.collect()), key=str) == plain_tail([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in known], items)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and blank texts, repeated rows, ties, a very long text, and extra columns with names that stages use."""
    base = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").where("length(text) > 200").orderBy("doc_id").limit(60).collect()]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    long = " ".join(t for _, t, lang in base if lang == base[0][2]) * 40
    rows = base + base[:9] + [(None, None, None), (None, "", "en"), (7, " \n", None), (base[0][0], base[5][1], None), (None, base[6][1], None)]
    rows += [(None, f"{base[1][1]} {item}", base[1][2]), (None, base[1][1] + " and more of it", None), (9000, long, base[0][2]), (9000, long, base[0][2])]
    schema = "doc_id long, text string, lang string, source string, score double, lang_pred string, tie long, fp string, node int, component int, held_out boolean, __row map<string,int>"
    made = [(*r, None, float(k), f"p{k}", k, None, k, None, True, {"a": k}) for k, r in enumerate(rows)]
    for name, table in (("odd", made), ("none", [])):
        spark.createDataFrame(table, schema).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{SMALL}/benchmark.parquet").union(spark.createDataFrame([(None, None), (5000, "")], "item_id long, text string")).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/odd")
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert {(r.score, r.lang_pred, r.tie) for r in out.collect()} <= {(float(k), f"p{k}", k) for k in range(len(rows))}
    left = [(r.doc_id, r.text) for r in corpus_pipeline.STAGES[0][1](spark, docs, "").collect()]
    assert {t for _, t in left} <= {t for _, t, _ in rows if t and t.strip()}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = sorted(map(tuple, corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()), key=str)
    assert got == plain_tail(left, items)
