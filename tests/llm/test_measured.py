"""Figures that the README gives, measured on whole tables, and the least that they may be."""

import collections
import os

import numpy as np
import pytest

from tidewave.llm import packing, resemblance

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_near_copies_are_those_of_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = [np.unique(resemblance.shingles(r["text"])) for r in rows]
    posts = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for h in s.tolist():
            posts[h].append(k)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a, s in enumerate(sets):
        common = collections.Counter(b for h in s.tolist() for b in posts[h] if b < a)
        for b, n in common.items():
            if n / (len(s) + len(sets[b]) - n) >= 0.8:
                links += 1
                parent[root(a)] = root(b)
    want = collections.defaultdict(set)
    for k, r in enumerate(rows):
        want[root(k)].add(r["doc_id"])
    got = collections.defaultdict(set)
    for r in resemblance.near_copies(docs).collect():
        got[r["component_id"]].add(r["doc_id"])
    assert links > 50
    assert set(map(frozenset, got.values())) == set(map(frozenset, want.values()))


def test_bins_are_as_full_as_one_best_fit_would_make_them(spark):
    """Within two in a hundred of one best fit over all pieces, though they are packed in groups, five of them here."""
    packed = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).toPandas()
    assert (packed["bin_id"] // packing.GROUP_BINS).nunique() > 1
    order = packed.sort_values("words", ascending=False, kind="stable")
    number = lambda c: order[c].astype(str).factorize()[0].tolist()
    best, _ = packing.best_fit(order["words"].tolist(), number("source"), number("cluster"), packing.CAPACITY)
    assert packed["bin_id"].nunique() <= 1.02 * len(set(best))
