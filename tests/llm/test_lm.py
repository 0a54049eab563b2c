import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewave.llm import lm
from tidewave.llm.common import words_of
from tidewave.llm.eliasfano import EliasFano

SCHEMA = "doc_id long, text string, score string"


@pytest.mark.parametrize("top", [0, 3, 1000, 1 << 40, (1 << 64) - 1])
def test_elias_fano(top):
    rng = np.random.default_rng(1)
    values = np.sort(rng.integers(0, top, 1000, np.uint64, endpoint=True))
    ef = EliasFano.build(values)
    assert (ef.access(np.arange(1000)) == values).all() and (ef.all() == values).all()
    asked = np.concatenate([values, rng.integers(0, top, 1000, np.uint64, endpoint=True), np.array([0, (1 << 64) - 1], np.uint64)])
    i, equal = ef.successor(asked)
    assert (i == np.searchsorted(values, asked)).all()
    assert (equal == np.isin(asked, values)).all()
    assert EliasFano.build(values[:0]).successor(asked)[0].sum() == 0


def brute(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    tokens = lambda t: [*words_of(t), lm.END]
    train = [tokens(t) for i, t, *_ in rows if not held[i]]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    levels = []
    for size in (1, 2):
        grams = collections.defaultdict(collections.Counter)
        for t in train:
            padded = [None] * size + t
            for k, w in enumerate(t):
                grams[tuple(padded[k : k + size])][w] += 1
        levels.append(grams)

    def p(w, h):
        if not h:
            return p1(w)
        seen = levels[len(h) - 1].get(tuple(h))
        if not seen:
            return p(w, h[1:])
        off = lambda k: lm.DISCOUNTS[min(k, 3) - 1] if k else 0.0
        total = sum(seen.values())
        return (seen[w] - off(seen[w])) / total + sum(map(off, seen.values())) / total * p(w, h[1:])

    out = []
    for i, t, *_ in rows:
        t = tokens(t)
        padded = [None, None, *t]
        out.append((i, held[i], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), sum(math.log10(p(w, padded[k : k + 2])) for k, w in enumerate(t))))
    return out


def check(spark, rows):
    got = lm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=2e-3)


def test_against_counting(spark):
    rng = np.random.default_rng(3)
    words = np.array(["the", "of", "and", "Größe", "x", "sea", "ship", "wave", "rare", "salt"])
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.03, 0.02])), "s") for i in range(200)]
    rows += [(None, None, "s"), (900, "", None), (901, " \t\n ", "s"), (3, rows[3][1], "s"), (902, "the of " * 30_000, "s")]
    check(spark, rows)


def test_hot_contexts_are_split(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    rows = [(i, f"the w{i % 37} the w{i % 11} end of the w{i % 3} sea", "s") for i in range(400)]
    plan = lm.train(spark.createDataFrame(rows, SCHEMA))
    assert len(plan["hot"]) > 2 and plan["shards"] > 4 and len(plan["hot_files"]) > 2
    check(spark, rows)


def test_parts_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 7)
    rows = [(i, " ".join(f"w{(i * k) % 5}" for k in range(i % 9)), "s") for i in range(60)] + [(99, "w1 w2 " * 50, "s")]
    check(spark, rows)


def test_twice_is_told_from_once(spark):
    """Texts that stand twice in the corpus score higher by token than those that stand once."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(300)])
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    texts = [" ".join(rng.choice(words, 80)) for _ in train]
    rows = [(i, texts[k // 2] if k < 100 else texts[k], "s") for k, i in enumerate(train)]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert min(got[i] for i in train[:100]) > max(got[i] for i in train[100:])


def test_the_model_sums_to_one(spark):
    rows = [(i, "a b c a b d"[: 1 + 2 * (i % 6)], "s") for i in range(30)]
    vocabulary = ["a", "b", "c", "d"]
    asked = [(f"a b {w}".rstrip(), w) for w in [*vocabulary, "zz", ""]]
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    more = [(held[0], "a", "s")] + [(held[k + 1], t, "s") for k, (t, _) in enumerate(asked)]
    score = {r["doc_id"]: r["score"] for r in lm.score_documents(spark.createDataFrame(rows + more, SCHEMA)).collect()}
    brutes = {r[0]: r[6] for r in brute(rows + more)}
    assert all(score[i] == pytest.approx(brutes[i], rel=2e-3) for i in held[: len(more)])


def test_no_training_texts_and_no_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score_documents(spark.createDataFrame([(held, "a b", "s")], SCHEMA)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)
    assert lm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("top", "n"), [(50, 2000), (1 << 31, 2000), (1 << 31, 3_000_000)])
def test_distinct_rows_of_any_number_of_words(top, n):
    """Packed, packed as ranks, and sorted by columns, where three ranks don't go into 63 bits."""
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, top, n) for _ in range(3)]
    columns = [np.concatenate([c, c[:100]]) for c in columns]
    got, place = lm._distinct(*columns)
    assert all((g[place] == c).all() for g, c in zip(got, columns, strict=True))
    keys = list(zip(*(g[:5000].tolist() for g in got), strict=True))
    assert keys == sorted(set(keys)) and len(got[0]) == place.max() + 1


def test_texts_are_read_and_split_once(spark):
    rows = [(i, f"the w{i % 7} sea", "s") for i in range(50)] + [(None, None, "s"), (60, "", "s")]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(t):
        read.add(1)
        return t

    lm.score_documents(spark.createDataFrame(rows, SCHEMA).withColumn("text", text("text"))).collect()
    assert read.value == len(rows)


def test_tokens_are_the_words_and_the_end():
    texts = ["", " ", "\t\n\x0b\x0c\r", "A b", " a  B\x0ba ", "\x1ca\x1f \x85b", "\u00a0a\u2003b", "ÄÖÜ İI Kk", "a" * 5000, "x\x00y \x00", "🜁 🜂🜁"]
    hashes, place, sizes = lm._tokens(pa.array(texts))
    want = [[*words_of(t), lm.END] for t in texts]
    assert sizes.tolist() == list(map(len, want))
    assert hashes[place].tolist() == [lm.hash_word(w) for t in want for w in t]
    assert len(set(hashes.tolist())) == len(hashes)


@pytest.mark.parametrize("top", [5, 1 << 20, 1 << 30])
def test_runs_of_any_width(top):
    """Sorted with the texts in one number, and by places, where those don't go into 63 bits."""
    rng = np.random.default_rng(2)
    columns = [np.concatenate([c, c[:500]]) for c in (rng.integers(0, top, 3000) for _ in range(3))]
    text = rng.integers(0, 40, 3500)
    rows, times, own = lm._runs(text, *columns)
    want = collections.defaultdict(list)
    for *row, t in zip(*(c.tolist() for c in columns), text.tolist(), strict=True):
        want[tuple(row)].append(t)
    assert list(zip(*(c.tolist() for c in rows), strict=True)) == sorted(want)
    until = np.cumsum([0, *times])
    assert [sorted(own[a:b].tolist()) for a, b in zip(until[:-1], until[1:], strict=True)] == [sorted(want[k]) for k in sorted(want)]


def test_packed_columns_come_back():
    rng = np.random.default_rng(4)
    for columns in ([np.zeros(3, np.int64)], [np.empty(0, np.int64)] * 2, [rng.integers(0, 1 << k, 100) for k in (1, 8, 9, 16, 17, 31, 32, 40, 62)]):
        got = lm._unpacked(lm._packed(*columns))
        assert all((a == b).all() for a, b in zip(got, columns, strict=True))


def test_parts_of_several_chunks(spark, monkeypatch):
    """Chunks of a part share its words; each numbers its own."""
    monkeypatch.setattr(lm, "CHUNK", 20)
    docs = spark.createDataFrame([(str(i), " ".join(f"w{(i * k) % 11}" for k in range(i % 13)), i % 5 == 0) for i in range(90)], "doc_id string, text string, held_out boolean").coalesce(1)
    parts = lm.parts_of(docs)
    plan = lm.learn(parts)
    asked = parts.drop("counts").mapInPandas(lm._ask(plan), lm.ASKED).where("shard < 0").collect()
    assert parts.count() < len(asked) == len({r["chunk"] for r in asked})
    assert sorted(i for r in asked for i in r["doc_id"]) == sorted(map(str, range(90)))
