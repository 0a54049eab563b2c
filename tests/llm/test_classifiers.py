"""The two classifiers by held-out accuracy, their gradients, and odd rows."""

import numpy as np
import pandas as pd
import pytest

from tidewave.llm import features, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
BAD = ["vilewort", "grimslur", "nastoid"]


def corpus(n, seed=1):
    """Plain words; a third of the texts holds a bad word or one of its kin somewhere."""
    rng = np.random.default_rng(seed)
    words = np.array([f"{a}{b}" for a in ("lo", "mi", "tra", "sen", "ku") for b in ("ma", "ri", "del", "po", "nim", "sa")])
    rows = []
    for i in range(n):
        t = rng.choice(words, rng.integers(5, 120)).tolist()
        bad = i % 3 == 0
        if bad:
            for _ in range(2):
                t[rng.integers(len(t))] = BAD[rng.integers(3)] + ["", "s", "ish"][rng.integers(3)]
        rows.append((i, " ".join(t), int(bad)))
    return rows


def frames(spark, rows, column):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t, _ in rows], DOCS)
    return docs, spark.createDataFrame([(i, y, 1) for i, _, y in rows if y is not None], f"doc_id long, {column} int, other int")


@pytest.fixture(scope="module", autouse=True)
def short_training():
    steps = toxicity.STEPS
    toxicity.STEPS = 160
    yield
    toxicity.STEPS = steps


def test_character_features_are_those_of_the_words():
    book = features.Words()
    assert book.tokens([b"ab", b"c", b"ab"]).tolist() == [1, 2, 1]
    buckets, grams, starts = book.features()
    assert starts.tolist() == [0, 2] and len(grams) == 3 and len(buckets) == 2

    def code(s):
        return (int.from_bytes(s, "little") * 2654435761 % (1 << 32) >> 16) % features.GRAM_BUCKETS

    assert grams.tolist() == [code(b"<ab>"), code(b"ab>>"), code(b"<c>>")]


def test_gradients():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_parameters().items() if k not in ("word", "gram")}
    x = rng.standard_normal((6, toxicity.INPUT))
    x[0] = 0
    tokens = rng.integers(1, 6, (4, toxicity.WINDOW))
    tokens[1, 10:] = 0
    y = np.array([1, 0, 1, 0])

    def loss():
        z = toxicity.forward(p, x, tokens).astype(np.float64)
        return float((np.logaddexp(0, z) - y * z).sum())

    keep = {}
    d = features.sigmoid(toxicity.forward(p, x, tokens, keep)) - y
    grad, d_x = toxicity.gradients(p, x, tokens, d, keep)
    for array, g in [(p[k], grad[k]) for k in ("w0", "u0", "b1", "u1", "wa", "va", "out", "bias")] + [(x[1:], d_x[1:])]:
        at = tuple(rng.integers(n) for n in array.shape)
        old = array[at]
        array[at] = old + 1e-2
        up = loss()
        array[at] = old - 1e-2
        down = loss()
        array[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=2e-3)


def test_windows_cover_every_word():
    counts = np.array([0, 1, 24, 25, 100])
    start, end, first = toxicity.windows(counts)
    tokens = np.arange(1, counts.sum() + 1)
    w = toxicity.window_tokens(tokens, start, end)
    for k, (f, n) in enumerate(zip(first, counts, strict=True)):
        own = w[f : (first[k + 1] if k + 1 < len(first) else len(w))]
        assert set(own[own > 0].tolist()) == set(range(counts[:k].sum() + 1, counts[:k].sum() + n + 1))


def test_toxicity_on_held_out_texts(spark):
    rows = corpus(900)
    docs, labels = frames(spark, rows, "toxic")
    got = toxicity.score_documents(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    y = {i: t for i, _, t in rows}
    assert len(got) == 900 and 200 < len(held) < 400
    right = sum(r["predicted"] == y[r["doc_id"]] for r in held)
    assert right / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    long = " ".join(t for _, t, b in rows if not b)
    extra = [(5000, None, None), (5001, "", None), (None, "lo", None), (5002, long, None), (5003, long + " grimslur vilewort nastoids grimslurs", None), (5003, "lo", None)]
    odd, _ = frames(spark, extra, "toxic")
    more = toxicity.score_documents(docs.unionByName(odd), labels.unionByName(labels.limit(3)))
    assert more.count() == 906
    kept = toxicity.keep_clean(docs.unionByName(odd), labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {5000, 5001, None} <= ids and sum(y.get(i, 0) for i in ids if i is not None) < 25


def test_one_label_or_none(spark):
    rows = [(i, "lo mi", 0) for i in range(9)]
    docs, labels = frames(spark, rows, "toxic")
    for lab, low in ((labels, True), (labels.where("doc_id < 0"), True), (labels.selectExpr("doc_id", "1 as toxic"), False)):
        assert all((r["score"] < 0.5) == low for r in toxicity.score_documents(docs, lab).collect())
    assert toxicity.score_documents(docs.where("doc_id < 0"), labels).count() == 0
    q = labels.selectExpr("doc_id", "toxic as quality")
    assert all(not r["kept"] for r in quality.score_documents(docs, q).collect())
    assert all(r["kept"] for r in quality.score_documents(docs, q.where("doc_id < 0")).collect())
    assert quality.score_documents(docs.where("doc_id < 0"), q).count() == 0


def pages(n, seed=2):
    rng = np.random.default_rng(seed)
    rows = corpus(n, seed)
    out = []
    for i, t, _ in rows:
        good = i % 4 != 0
        if not good:
            t = [t.upper().replace(" ", "!! ") + "!!", "\n".join([t.split()[0]] * 40), " ".join(w + "###" for w in t.split())][rng.integers(3)]
        out.append((i, t, int(good)))
    return out


def test_quality_on_held_out_texts(spark):
    rows = pages(600)
    docs, labels = frames(spark, rows, "quality")
    some = labels.where("doc_id % 2 = 0 or doc_id % 5 = 0")
    odd, _ = frames(spark, [(5000, None, None), (5001, "", None), (None, "lo mi ra", None), (3, rows[3][1], None)], "quality")
    got = quality.score_documents(docs.unionByName(odd.withColumn("source", odd["source"].substr(9, 1))), some).collect()
    y = {i: t for i, _, t in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in y]
    assert len(got) == 604
    assert sum(r["kept"] == bool(y[r["doc_id"]]) for r in held) / len(held) > 0.95
    kept = quality.keep_good(docs, some)
    assert kept.columns == docs.columns and 0.9 < kept.count() / sum(y.values()) < 1.1


def test_views_teach_each_other():
    rows = pages(300, 5)
    pdf = pd.DataFrame([(t, "s" if v else "junk", "en", len(t)) for _, t, v in rows], columns=quality.COLUMNS)
    y = np.array([v if i < 60 else -1 for i, _, v in rows])
    model = quality.fit(pdf, y)
    text, meta = model.views(pdf)
    truth = np.array([v for _, _, v in rows])
    assert ((model.combine(text, meta) >= 0.5) == truth)[60:].mean() > 0.95
    assert np.allclose(model.combine(*model.views(pdf.iloc[:7])), model.combine(text, meta)[:7])


def test_long_texts_are_learnt_from(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "lo " * (20_000 if i % 2 else 10), "en", "s", 1, "x") for i in range(40)], DOCS)
    ids = spark.range(40).selectExpr("id doc_id", "cast(id % 2 as int) y")
    assert len(features.gather(docs.unionByName(docs), ids, ["text"])) == 40
    monkeypatch.setattr(features, "SAMPLE_CHARS", 300_000)
    some = features.gather(docs, ids, ["text"])
    assert 5 < len(some) < 40 and 0 < sum(r["y"] for r in some) < len(some)
    assert some == features.gather(docs.repartition(7), ids, ["text"])


def test_quality_score_by_plain_sums():
    """A score recomputed word by word, gram by gram, from the weights."""
    rows = pages(200, 7)
    pdf = pd.DataFrame([(t, "s", "en", len(t)) for _, t, _ in rows], columns=quality.COLUMNS)
    model = quality.fit(pdf, np.array([v for _, _, v in rows]))
    text, meta = model.views(pdf.iloc[:5])
    for k in range(5):
        words = pdf["text"][k].encode().lower().split()
        of = lambda w: model.text.w[features.zlib.crc32(w) % features.WORD_BUCKETS]

        def grams(w):
            b = b"<" + w + b">>"
            at = [(int.from_bytes(b[i : i + 4], "little") * 2654435761 % (1 << 32) >> 16) % features.GRAM_BUCKETS for i in range(len(w))]
            return sum(model.text.w[features.WORD_BUCKETS + a] for a in at) / len(at)

        shape = (np.array(quality.layout(pdf["text"][k], len(words), len(set(words)))) - model.mean) / model.scale
        want = quality.SCALE * sum(of(w) + grams(w) for w in words) / len(words) + shape @ model.text.w[quality.LAYOUT :] + model.text.b
        assert text[k] == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_toxicity_score_by_plain_steps():
    """The network, a word at a time in plain loops, over all windows of a text."""
    rows = corpus(90)
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows]))
    p, sig = {k: v.astype(float) for k, v in model.p.items()}, features.sigmoid
    text = rows[3][1]
    words = text.encode().lower().split()
    h_, n_ = toxicity.HIDDEN, toxicity.WINDOW

    def vector(w):
        b = b"<" + w + b">>"
        g = [(int.from_bytes(b[i : i + 4], "little") * 2654435761 % (1 << 32) >> 16) % features.GRAM_BUCKETS for i in range(len(w))]
        z, k = model.prior.gram[g], features.zlib.crc32(w) % features.WORD_BUCKETS
        return np.concatenate([[model.prior.word[k], z.mean(), z.max()], p["word"][k], p["gram"][g].mean(0)])

    def run(j, xs):
        h, out = np.zeros(h_), []
        for x in xs:
            a, b = x @ p[f"w{j}"] + p[f"b{j}"], h @ p[f"u{j}"]
            z, r = sig(a[:h_] + b[:h_]), sig(a[h_ : 2 * h_] + b[h_ : 2 * h_])
            n = np.tanh(a[2 * h_ :] + r * b[2 * h_ :])
            h = n + z * (h - n)
            out.append(h)
        return out

    logits = []
    for start in range(0, max(1, len(words) - n_ + toxicity.STRIDE), toxicity.STRIDE):
        xs = [vector(w) for w in words[start : start + n_]]
        h = np.concatenate([np.array(run(0, xs)), np.array(run(1, xs[::-1]))[::-1]], 1)
        e = np.tanh(h @ p["wa"]) @ p["va"]
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        logits.append(a @ h @ p["out"] + p["bias"][0])
    assert model.scores([text])[0] == pytest.approx(sig(model.a * max(logits) + model.b), abs=1e-4)


def test_empty_tables_and_clashing_columns_of_the_filters(spark):
    docs, labels = frames(spark, [(i, "lo mi", i % 2) for i in range(9)], "toxic")
    both = labels.selectExpr("doc_id", "toxic", "toxic as quality")
    for keep in (toxicity.keep_clean, quality.keep_good):
        assert keep(docs.where("doc_id < 0"), both).count() == 0
        assert keep(docs, both.where("doc_id < 0")).count() == 9
        assert keep(docs, both).columns == docs.columns
