"""Spelling variants, vector codes and language prediction against brute force, with odd rows."""

import collections
import hashlib
import math
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewave.llm import codes, languages, variants

DOCS = "doc_id long, text string, lang string, n long, word string, n_near string"
SF = "/root/testdata/sf0.001"


def docs_frame(spark, rows):
    """(doc_id, text, lang) with columns that clash with names of ours."""
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], DOCS)


# spelling variants


def brute_words(rows, every):
    n = collections.Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, every=97):
    n = brute_words(rows, every)
    forms, out = {}, set()
    for w in n:
        others = sorted((-n[v], v) for v in n if near(w, v))
        best = others[0][1] if others and -others[0][0] >= 2 * n[w] else None
        forms[w] = best, len(others)
    for w in n:
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        form = forms[w][0]
        out.add((w, form, root, n[w], forms[w][1], n.get(form)))
    return out


def variant_rows(rng):
    words = ["spelling", "spellingg", "spellin", "pelling", "spalling", "Éclair", "éclair", "aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "abaaa", "ababab", "bababa", "straße", "strasse", "abcd", "abcde", "abcdef", "xbcde", "ÿÿÿÿÿ", "ÿÿÿÿÿÿ"]
    words += ["".join(rng.choice(list("abé"), rng.integers(4, 8))) for _ in range(150)]
    long = "".join(rng.choice(list("abc"), 64))
    words += [long, long[:-1], long + "a", "b" + long, long[:30] + "z" + long[31:], (long + "a")[:32] + "ab" + long[32:], long * 3, long * 3 + "q", "q" + long * 3, (long * 3)[1:]]
    rows = [(k, " ".join(rng.choice(words, 40)) + ", " + "/".join(words[k % 7 :: 7]), "en") for k in range(60)]
    rows += [(None, "spelling Spelling SPELLING", "en"), (5, None, None), (5, "", None), (5, "spelling " * 3000, None), (5, "spelling " * 3000, None), (6, " \t .;1234", "en")]
    return rows


@pytest.mark.parametrize("every", [97, 3])
def test_variants_are_those_of_all_pairs(spark, every):
    rows = variant_rows(np.random.default_rng(3))
    got = [tuple(r) for r in variants.group_variants(docs_frame(spark, rows), every).collect()]
    assert len(got) == len(set(got)) > 100
    assert set(got) == brute_variants(rows, every)


def test_variants_of_short_walks_and_long_hashes_agree(spark, monkeypatch):
    """Whatever length is walked, the pairs are the same."""
    rows = variant_rows(np.random.default_rng(4))
    monkeypatch.setattr(variants, "WALKED", 6)
    assert {tuple(r) for r in variants.group_variants(docs_frame(spark, rows)).collect()} == brute_variants(rows)


def test_variants_of_a_very_long_run(spark):
    run = "ab" * 100_000
    rows = [(k, t, None) for k in range(3) for t in (run, run + "c", run[:77_777] + run[77_778:])] + [(9, run, None)] * 3
    got = {r["word"]: r for r in variants.group_variants(docs_frame(spark, rows), every=1 << 40).collect()}
    assert {w: (r["n"], r["n_near"], r["form"] == run) for w, r in got.items()} == {run: (6, 2, False), run + "c": (3, 1, True), run[:77_777] + run[77_778:]: (3, 1, True)}


def test_variants_of_nothing(spark):
    assert variants.group_variants(docs_frame(spark, [])).collect() == []
    assert variants.group_variants(docs_frame(spark, [(1, None, None), (2, "a b", None)])).collect() == []


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(40)] + [("x", "w7")]
    got = dict(variants.follow(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == dict.fromkeys([w for w, _ in chain], "w40")


# vector codes

VECTORS = "vec_id long, embedding array<double>, label int, code string, error long"


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in e], c) for i, e, c in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    d = len(kept[0][1]) if kept else 0
    cut = [(k * d // parts, (k + 1) * d // parts) for k in range(parts)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in cut]
    far = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            own = collections.defaultdict(list)
            for r in kept:
                own[near(r[1][a:b], books[p])].append(r[1][a:b])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, by = [], collections.Counter()
    for i, x, c in kept:
        k = [near(x[a:b], book) for (a, b), book in zip(cut, books, strict=True)]
        error = sum(far(x[a:b], book[e]) for (a, b), book, e in zip(cut, books, k, strict=True))
        by[c] += error
        out.append((i, "".join(f"{e:02x}" for e in k), error, c))
    return sorted((*r[:3], by[r[3]], sha) for r in out)


def vector_rows(rng, n, d):
    centres = rng.standard_normal((5, d))
    rows = [(k, (centres[k % 5] + 0.02 * rng.standard_normal(d)).tolist() if k % 3 else rng.standard_normal(d).tolist(), [None, 1, 2][k % 3]) for k in range(n)]
    rows += [(1000 + k, rows[0][1], 3) for k in range(40)]  # copies
    rows += [(7, rows[3][1], None), (7, rows[4][1], 1), (7, rows[4][1], 1)]  # repeated ids and rows
    return rows


def odd_vectors(d):
    return [(2001, None, 1), (2002, [0.0] * (d - 1) + [None], 1), (2003, [float("nan")] * d, 1), (2004, [float("inf")] * d, None), (2005, [0.0] * d, None), (2006, [0.5] * (d + 1), 1), (2007, [], 1)]


def code_rows(spark, rows, **named):
    out = codes.compress(spark.createDataFrame([(*r, "x", 5) for r in rows], VECTORS), **named)
    return sorted(map(tuple, out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))


@pytest.mark.parametrize(("d", "entries", "tree"), [(16, 24, 1024), (10, 8, 32), (3, 256, 64)])
def test_codes_are_those_of_plain_rounds(spark, d, entries, tree):
    rows = vector_rows(np.random.default_rng(d), 220, d) + odd_vectors(d)
    assert code_rows(spark, rows, entries=entries, tree=tree) == brute_codes(rows, entries=entries)


def test_codes_of_large_components_and_null_ids(spark):
    """Products that doubles don't hold are made in whole numbers; ids come in any order."""
    rng = np.random.default_rng(1)
    rows = [(int(k), (60_000 * rng.standard_normal(8)).clip(-65_000, 65_000).tolist(), 1) for k in rng.permutation(60)]
    rows.reverse()
    assert code_rows(spark, rows, entries=10) == brute_codes(rows, entries=10)
    got = codes.compress(spark.createDataFrame([(None, [0.1] * 4, None, "x", 5), (1, [0.2] * 4, None, "x", 5)], VECTORS), entries=1).collect()
    assert {r["vec_id"] for r in got} == {None, 1} and {r["code"] for r in got} == {"00000000"}
    huge = codes.compress(spark.createDataFrame([(1, [1e300] * 4, 1, "x", 5), (2, [-1e300] * 4, 1, "x", 5)], VECTORS)).collect()
    assert [r["error"] for r in huge] == [0, 0]


def test_codes_of_nothing(spark):
    assert code_rows(spark, []) == []
    assert code_rows(spark, [(1, None, 1), (2, [None], 1)]) == []


def test_nodes_hold_what_cover_trees_hold():
    """Every point lies in its node's reach; children split their node; whole nodes are given as single points would be."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-900, 900, (300, 5)), np.repeat(rng.integers(-900, 900, (3, 5)), 60, 0), rng.integers(-9, 9, (300, 5))])
    tree = codes.CoverTree.build(x)
    assert (x[tree.order] == tree.points).all()
    for s, e, r, f, c in zip(tree.start, tree.end, tree.reach, tree.first, tree.children, strict=True):
        assert ((tree.points[s:e] - tree.points[s]) ** 2).sum(1).max() == r
        if c:
            assert tree.start[f] == s and tree.end[f + c - 1] == e and (tree.end[f : f + c - 1] == tree.start[f + 1 : f + c]).all()
            centres = tree.points[tree.start[f : f + c]]
            assert (codes.distances(centres, centres) + np.eye(c) * 1e18 > r / codes.SHRINK**2).all()
    book = np.concatenate([rng.integers(-900, 900, (20, 5)), rng.integers(-900, 900, (1, 5)).repeat(2, 0)])
    entry, sums, counts = tree.nearest(book)
    assert (entry == ((tree.points[:, None] - book) ** 2).sum(2).argmin(1)).all()
    assert all((sums[k] == tree.points[entry == k].sum(0)).all() and counts[k] == (entry == k).sum() for k in range(len(book)))


@pytest.mark.parametrize(("query", "sql"), [("documents", variants.ORACLE), ("embeddings", codes.ORACLE)])
def test_queries_match_sql(spark, query, sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {query} AS SELECT * FROM read_parquet('{SF}/{query}.parquet')")
    table = spark.read.parquet(f"{SF}/{query}.parquet")
    got = (variants.group_variants if query == "documents" else codes.compress)(table)
    cells = lambda pdf: sorted(tuple("null" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))
    got, want = cells(got.toPandas()), cells(con.sql(sql).df())
    assert len(got) == len(want) > 0
    assert got == want


# language


def plain_letters(text):
    if text is None or not any(unicodedata.category(c)[0] == "L" for c in text):
        return None
    return " ".join("".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split())


def plain_grams(text, buckets):
    out, text = [], f" {text} "
    for n in range(1, languages.LONGEST + 1):
        for k in range(len(text) - n + 1):
            h = 0
            for c in text[k : k + n]:
                h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
            out.append(((h ^ n * 0x85EBCA6B) & 0xFFFFFFFF) >> 32 - (buckets.bit_length() - 1))
    return out


def brute_language(rows, buckets=languages.BUCKETS):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for i, t, lang in rows:
        if not held(i) and lang is not None and (found := plain_letters(t)) is not None:
            texts[lang] += 1
            counts[lang].update(plain_grams(found, buckets))
    out = []
    for i, t, _ in rows:
        found = plain_letters(t)
        if found is None or not texts:
            out.append((i, held(i), "und", 0.0))
            continue
        grams, score = plain_grams(found, buckets), {}
        for lang, c in counts.items():
            total = sum(c.values()) + languages.SMOOTHING * buckets
            score[lang] = math.log(texts[lang] / sum(texts.values())) + sum(math.log((c[g] + languages.SMOOTHING) / total) for g in grams) / languages.LONGEST
        best = min(score, key=lambda k: (-score[k], k))
        out.append((i, held(i), best, 1 / sum(math.exp(s - score[best]) for s in score.values())))
    return out


def language_rows(rng):
    pools = {"aa": "the of and water house", "bb": "der die und Wasser Straße", "cc": "вода дом и на", "dd": "l'eau où été maison"}
    rows = [(k, ", ".join(rng.choice(pools[lang].split(), rng.integers(1, 12))), lang) for k, lang in enumerate(rng.choice(list(pools), 60).tolist())]
    rows += [(100, None, "aa"), (101, "", "aa"), (102, "12 34 !?", "bb"), (103, "Water", None), (None, "maison où", "dd"), (104, "x", "aa"), (104, "x", "aa"), (105, "नमस्ते दुनिया", "ee"), (106, "́ 1", "aa")]
    return rows + [(107 + k, "und die " * 4000, "bb") for k in range(4)]


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_language_is_that_of_plain_counts(spark, monkeypatch, piece):
    """Also where long texts are cut in pieces."""
    monkeypatch.setattr(languages, "PIECE", piece)
    rows = language_rows(np.random.default_rng(2))
    key = lambda r: (str(r[0]), r[2], r[3])
    got = sorted((tuple(r) for r in languages.predict_documents(docs_frame(spark, rows)).collect()), key=key)
    want = sorted(brute_language(rows), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-4)


def test_more_languages_have_fewer_buckets(spark, monkeypatch):
    monkeypatch.setattr(languages, "CELLS", 5 << 10)
    rows = language_rows(np.random.default_rng(3))
    got = {(r["doc_id"], r["lang_pred"]) for r in languages.predict_documents(docs_frame(spark, rows)).collect()}
    assert got == {(r[0], r[2]) for r in brute_language(rows, 1 << 10)}


def test_language_without_labels(spark):
    assert languages.predict_documents(docs_frame(spark, [])).collect() == []
    got = languages.predict_documents(docs_frame(spark, [(1, "water", None), (2, None, "aa")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = languages.predict_documents(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(r) > 200
    assert (r["lang"] == r["lang_pred"]).mean() >= 0.99
