"""Sharding, top-k, SimHash, mixing, packing and WARC against brute force, with odd rows."""

import collections
import gzip
import hashlib
import io

import duckdb
import numpy as np
import pytest
import xxhash

from tidewave.llm import mixing, packing, sharding, simhash, topk, warc
from tidewave.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    """(doc_id, text, source) with the other columns, and two that clash with names of ours."""
    full = [(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS + ", slot string, size string")


ODD = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None), (3, "", "s"), (4, " \t\n", "t"), (None, "a B c", "t"), (5, "é " * 3000, None), (6, "x", "")]


def components_of(nodes, linked):
    nodes = sorted(nodes)
    seen, out = set(), {}
    for n in nodes:
        if n in seen:
            continue
        todo, comp = [n], []
        seen.add(n)
        while todo:
            a = todo.pop()
            comp.append(a)
            for b in nodes:
                if b not in seen and linked(a, b):
                    seen.add(b)
                    todo.append(b)
        for a in comp:
            out[a] = min(comp)
    return out


# sharding


def fill(names, slots):
    """Turns, by walking whole preference lists."""
    prefs = []
    for name in names:
        d = hashlib.md5(name.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        prefs.append(iter([(offset + j * skip) % slots for j in range(slots)]))
    out = {}
    while len(out) < slots:
        for i, p in enumerate(prefs):
            slot = next((s for s in p if s not in out), None)
            if slot is not None:
                out[slot] = i
    return [out[s] for s in range(slots)]


def test_lookup_table():
    names = [f"n{i}" for i in range(7)]
    assert sharding.lookup_table(names, 211) == fill(names, 211)
    counts = collections.Counter(sharding.lookup_table(sharding.SHARDS))
    assert max(counts.values()) - min(counts.values()) <= 1
    a, b = sharding.lookup_table(names, 65537), sharding.lookup_table(names[:-1], 65537)
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 6)
    assert moved < 0.1 * 65537
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a"], 2_000_003), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark):
    names = ["a", "b", "c"]
    got = sharding.place(docs_frame(spark, ODD), "doc_id", names, 101).collect()
    table = fill(names, 101)
    assert len(got) == len(ODD)
    for r in got:
        slot = int(hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert sharding.place(docs_frame(spark, []), "doc_id", names, 101).count() == 0


# exact top-k


def plain_top_k(rows, k=10, every=100):
    fine = [(i, [int(np.floor(1024 * x)) if abs(x) < 2**43 else int(x) * 1024 for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for a, (q, v) in enumerate(fine):
        if q % every == 0:
            score = lambda w, v=v: min(max(sum(x * y for x, y in zip(v, w, strict=True)), -(2**63) + 1), 2**63 - 1)
            found = sorted((-score(w), i) for b, (i, w) in enumerate(fine) if b != a and len(w) == len(v))[:k]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(want)


@pytest.mark.parametrize("block", [8192, 40])
def test_top_k_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.standard_normal(8) * (1 + i % 3)).tolist()) for i in range(600)]
    # repeated rows, other vectors under one id, a query's own vector under other ids, ties
    rows += [(1000 + i, rows[0][1]) for i in range(15)] + [rows[3], rows[100], rows[100], (200, rows[201][1]), (200, rows[202][1])]
    rows += [(700, None), (701, [1.0] * 7 + [None]), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (None, [1.0] * 8), (800, [0.0] * 8), (801, [1.0, 2.0]), (900, [3.0, 4.0]), (902, []), (1100, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    assert sorted(tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()) == plain_top_k(rows)
    huge = rows[:250] + [(9000, [1e18] * 8), (9001, [1e18] * 4 + [-1e18] * 4), (9100, [2e13] * 8), (9101, [3e300] * 8)]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == plain_top_k(huge)
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


def test_the_walk_stops_early():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.standard_normal((2000, 2)) * 1024)
    rows[:20] *= 50
    ids, query = np.arange(2000), np.array([100.0, -70.0])
    got, s, met = topk.threshold_search(ids, ids, rows, np.argsort(rows, axis=0).T, -1, query, 5)
    full = rows @ query
    assert met < 1000 and s.tolist() == sorted(full.tolist(), reverse=True)[:5] and (full[got] == s).all()


def test_the_bound_by_length_stops_where_the_sum_does_not():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64))
    x[:30] = x[0] + 0.05 * rng.standard_normal((30, 64))
    rows = np.floor(x / np.sqrt((x * x).sum(1))[:, None] * 1024)
    order, ids = np.argsort(rows, axis=0).T, np.arange(4000)
    full = (rows @ rows[0]).astype(int)
    for length, most in ((None, 4000), (float(np.sqrt((rows**2).sum(1).max())), 1500)):
        got, s, met = topk.threshold_search(ids, ids, rows, order, 0, rows[0], 10, length=length)
        assert s.tolist() == sorted(full[1:].tolist(), reverse=True)[:10] and (full[got] == s).all() and met <= most
    for _ in range(200):  # the bound holds for what lies below the caps
        q, y = rng.standard_normal(6), rng.standard_normal(6)
        last = np.where(q > 0, np.maximum(y, rng.standard_normal(6)), np.minimum(y, rng.standard_normal(6)))
        assert q @ y <= topk.bound(q, last, float(np.sqrt(y @ y))) + 1e-9


# SimHash


def plain_print(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_masks_cover():
    m = [x & (1 << 64) - 1 for x in simhash.masks()]
    assert len(m) == 7
    assert all(any(not x >> i & 1 and not x >> j & 1 for x in m) for i in range(64) for j in range(i + 1))


@pytest.mark.parametrize("bucket", [48, 2])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words, 300)) for _ in range(12)]
    rows = [(10 + i, t, "s") for i, t in enumerate(base)]
    for k in range(150):
        t = base[k % 12].split()
        for _ in range(k % 4):
            t[rng.integers(len(t))] = "zz"
        rows.append((100 + k, " ".join(t).upper() if k % 2 else " ".join(t), "s"))
    rows += [(i, t, s) for i, t, s in ODD]
    got = simhash.near_duplicates(docs_frame(spark, rows)).collect()
    prints = {i: plain_print(t) for i, t, _ in rows}
    comp = components_of({p for p in prints.values()}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, p in prints.items():
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    assert len(got) == len(rows)
    for r in got:
        p = prints[r["doc_id"]]
        assert r["fingerprint"] == f"{p:016x}" and r["component_id"] == least.get(comp[p])
    assert simhash.near_duplicates(docs_frame(spark, [])).count() == 0


def test_keep_one(spark):
    rows = [(3, "a b c d", "s"), (2, "A b  c d", "s"), (9, "other words are here", "s"), (2, "A b  c d", "s"), (None, "q r s t u", "s")]
    assert sorted((r["doc_id"] or 0) for r in simhash.keep_one(docs_frame(spark, rows)).collect()) == [0, 2, 2, 9]


def test_components_of_a_long_path_and_a_star(spark):
    e = [(i, i + 1) for i in range(50, 120)] + [(1, k) for k in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 50 for i in range(50, 121)}, **{k: 1 for k in (1, *range(200, 260))}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# mixing


def plain_mix(rows):
    size = lambda t: len((t or "").encode().split())
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * total[s] for s in over}
        free -= over
        if not free:
            break
    return size, total, target


def test_mix_against_plain_shares(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 40)), "abcdefg"[min(6, int(rng.geometric(0.3)) - 1)]) for i in range(400)] + ODD
    got = mixing.mix(docs_frame(spark, rows)).collect()
    size, total, target = plain_mix(rows)
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]], abs=1e-5)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5001 for s in total)
    again = mixing.mix(docs_frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    hot = [(None if i % 3 else 7, "w " * (i % 5), "a") for i in range(300)] + rows[:50]
    total = collections.Counter()
    for r in mixing.mix(docs_frame(spark, hot)).collect():
        total[r["source"], r["target"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(t - n) <= 0.5001 for (_, t), n in total.items())
    repeated = mixing.repeat(docs_frame(spark, rows[:400]))
    assert repeated.columns == docs_frame(spark, []).columns
    copies = collections.Counter(r["doc_id"] for r in repeated.collect())
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(docs_frame(spark, rows[:400])).collect()}
    assert copies == {i: n for i, n in plan.items() if n}
    assert mixing.mix(docs_frame(spark, [])).count() == 0


# packing


def test_best_fit_takes_the_tightest_compatible_bin():
    bins, starts = packing.best_fit([6, 5, 4, 3, 2], [0, 1, 1, 2, 0], [0, 1, 2, 3, 4], 10)
    assert bins == [0, 1, 0, 1, 1] and starts == [0, 0, 6, 5, 8]
    assert packing.best_fit([4, 4], [0, 1], [9, 9], 10)[0] == [0, 1]


def test_bins_hold_what_they_may(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(0, 50)) + str(i % 90), "abc"[int(rng.integers(3))]) for i in range(500)] + ODD
    docs = docs_frame(spark, rows)
    got = packing.pack_documents(docs, 40, 64).collect()
    size = lambda t: len((t or "").encode().split())
    assert sum(r["words"] for r in got) == sum(size(t) for _, t, _ in rows)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    for b in bins.values():
        b.sort(key=lambda r: (r["bin_start"], r["words"]))
        assert sum(r["words"] for r in b) <= 40
        assert all(x["bin_start"] + x["words"] == y["bin_start"] for x, y in zip(b, b[1:], strict=False))
        assert len({r["source"] for r in b}) == len(b) == len({r["cluster"] for r in b})
    pieces = collections.Counter(r["doc_id"] for r in got)
    want = collections.Counter()
    for i, t, _ in rows:
        want[i] += max(1, -(-size(t) // 40))
    assert pieces == want
    texts = packing.bin_texts(docs.where("doc_id >= 10"), packing.pack_documents(docs.where("doc_id >= 10"), 40, 64)).orderBy("doc_id", "piece").collect()
    whole = collections.defaultdict(list)
    for r in texts:
        whole[r["doc_id"]] += r["text"].split()
    assert all(whole[i] == t.split() for i, t, _ in rows[10:500])
    assert packing.pack_documents(docs_frame(spark, [])).count() == 0


def test_equal_rows_are_dealt_to_all_groups(spark):
    rows = spark.range(20_000).selectExpr("7L doc_id", "'s' source", "500L words", "5L cluster").unionByName(spark.range(100).selectExpr("id doc_id", "'t' source", "100L words", "id cluster"))
    got = packing.pack(rows, 2048, 1024)
    groups = got.groupBy((got["bin_id"] / packing.GROUP_BINS).cast("long").alias("g")).count().collect()
    assert sum(r["count"] for r in groups) == 20_100 and len(groups) == 20 and max(r["count"] for r in groups) < 2000
    assert got.where("doc_id = 7").select("bin_id").distinct().count() >= 20_000  # equal pieces share no bin


def test_bin_texts_of_repeated_and_null_ids(spark):
    docs = docs_frame(spark, [*ODD, (1, "A b  C", "s"), (1, "d e", "t")])
    texts = packing.bin_texts(docs, packing.pack_documents(docs, 40, 64)).collect()
    whole = collections.Counter()
    for r in texts:
        whole[r["doc_id"]] += len(r["text"].split())
    assert whole == collections.Counter({1: 11, 2: 0, 3: 0, 4: 0, None: 3, 5: 3000, 6: 1}) and len(texts) == packing.pack_documents(docs, 40, 64).count()


# WARC


def test_round_trip(spark):
    big = 2**60 + 1
    rows = [(5, "http://a", "<p>x</p>"), (3, "http://b\r\nX: y", "<p>x</p>"), (3, "http://b", "<p>x</p>"), (9, None, None), (8, "http://c", ""), (None, "http://d", "<p>x</p>"), (None, "http://e", "only"), (big, "http://f", "é" * 200_000), (big + 1, "http://f", "é" * 200_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = warc.round_trip(pages).collect()
    seen, want = set(), []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2] or "")):
        b = (h or "").encode()
        least = min((j for j, _, g in rows if (g or "").encode() == b and j is not None), default=None)
        first = least is None or (i == least and (i, b) not in seen)
        seen.add((i, b))
        want.append((i, len(b), warc.base32_sha1(b), "response" if first else "revisit", None if first else least))
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    assert warc.round_trip(pages.where("page_id < 0")).count() == 0
    # a third of all rows has no page, or one page; none of them are lost, and one response is left of each payload
    many = spark.range(900).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 5 else id end page_id", "'u' url", "concat('x', id % 4) html")
    got = warc.round_trip(many).groupBy("payload_digest", "record_type").count().collect()
    assert sorted((r["record_type"], r["count"]) for r in got) == [("response", 1)] * 4 + [("revisit", 224)] * 4


def test_files_roll_and_repeat(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, f"http://x/{i}", rng.bytes(3000).hex()) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    names = []
    for k in (0, 1):
        folder = tmp_path / str(k)
        folder.mkdir()
        m = warc.write_warc(pages.repartition(3 + k), f"file://{folder}", roll_bytes=20_000, partitions=2).collect()
        names.append(sorted((r["file"], r["records"], r["sha256"]) for r in m))
        assert len(m) > 4 and sum(r["records"] for r in m) == 60
        assert not [p for p in folder.iterdir() if p.name.startswith(".tmp")]
        for r in m:
            data = (folder / r["file"]).read_bytes()
            assert hashlib.sha256(data).hexdigest() == r["sha256"]
            heads = list(warc.parse(io.BytesIO(gzip.decompress(data))))
            assert len(heads) == r["records"] and all(h["warc-type"] == "response" for h, _ in heads)
    assert names[0] == names[1]
    small = tmp_path / "small"
    small.mkdir()
    twins = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "bb"), (4, "u", "bb")], pages.schema)
    m = warc.write_warc(twins, f"file://{small}", min_payload=2)
    assert sorted((r["page_id"], r["record_type"]) for r in warc.read_warc(m, f"file://{small}").collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_pages_without_ids_match_sql(spark):
    """Also payloads that only such pages have, which are responses all."""
    rows = [(1, "a"), (2, "a"), (None, "a"), (None, "b"), (None, "b"), (3, "c"), (3, "c"), (None, None), (4, ""), (None, "d")]
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, 'u', ?)", rows)
    got = warc.round_trip(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string"))
    key = lambda r: tuple(str(v) for v in r)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(key(r) for r in got.select(*names).collect()) == sorted(key(r) for r in con.sql(f"SELECT {', '.join(names)} FROM ({warc.ORACLE})").fetchall())
