"""Spelling variants by a walk through a trie of words, level by level.

The words of a corpus make two tries, one of the words and one of the words
read backwards, each a table of edges ``(side, node, letter)``; a node is named
by its prefix, and an edge leads to the node with its letter added. A walk
carries states ``(word, position, node, edits)``. Without an edit a word walks
its own path; an edit either follows an edge of another letter or leaves a
letter of the word out. After its edit a state goes on by equal letters only,
and one that has used up its word stands at a word one edit away.

An edit lies in one half of the word or the other, so the forward walk makes
those of the second half and the backward walk those of the first: states
start at the middle, where few words share a node, instead of at the root that
all share. Letters put in are letters left out of the other word, so those
pairs are found from the longer word's side. At each level the states at nodes
of one depth meet the edges of that depth, so every edge is shuffled once.

Words longer than ``WALKED`` would make as many levels; they are matched by
hashes of themselves with each letter left out, and candidates are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, lower_ascii, stored

#: A run of letters, the share of runs that lose a letter, and what makes a word.
RUN, EVERY, LEAST_LENGTH, LEAST_TIMES = "[A-Za-zÀ-ÿ]+", 97, 5, 3
#: A form is at least so many times as frequent as its variant.
FACTOR = 2
#: Letters of a word that is walked; longer words are matched by hashes.
WALKED = 64
FOUND = "word string, n long, near string"


def count_words(docs: DataFrame, every: int = EVERY, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> DataFrame:
    """``(word, n)``: the runs of letters of all texts, A-Z in lower case, after the deletion, and how often they occur."""
    run = F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), run.alias("run"))
    runs = runs.where(F.length("run") >= least_length).withColumn("run", lower_ascii(F.col("run")))
    h = F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(h % every == 0, less).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_times)


def _sides(words: DataFrame) -> DataFrame:
    """Every word read forwards and backwards, with the position from which edits are made: those before it are the other side's."""
    length = F.length("word")
    half = (length / 2).cast("int")
    both = F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("letters"), half.alias("start")),
        F.struct(F.lit(1).alias("side"), F.reverse("word").alias("letters"), (length - half).alias("start")),
    )
    return words.select("n", F.explode(both).alias("x")).select("x.side", "x.letters", "x.start", "n")


def _letter(word: str, at: Column | int) -> Column:
    return F.substring(F.col(word), F.lit(at) if isinstance(at, int) else at, F.lit(1))


def edges(sides: DataFrame) -> DataFrame:
    """``(depth, side, node, letter)``: the edges of both tries from where the walks start."""
    depth = F.explode(F.sequence("start", F.length("letters") - 1))
    rows = sides.select("side", "letters", depth.alias("depth"))
    return rows.select("depth", "side", F.substring(F.col("letters"), F.lit(1), F.col("depth")).alias("node"), _letter("letters", F.col("depth") + 1).alias("letter")).distinct()


def walk(words: DataFrame) -> DataFrame:
    """``(word, n, near)``: candidates one edit away from words of ``WALKED`` letters at most; ``near`` is a node's prefix, word or not.

    One round per letter of the longest word. A round's states are written
    out, so that a lost executor costs one level; nothing comes to the driver
    but the longest length.
    """
    sides = stored(_sides(words))
    least, most = sides.agg(F.min("start"), F.max(F.length("letters"))).first()
    trie = stored(edges(sides))
    levels: list[DataFrame] = []
    for depth in range(least or 0, most or 0):
        states = sides.where(F.col("start") == depth).select("side", "letters", "n", F.lit(depth).alias("position"), F.substring(F.col("letters"), F.lit(1), F.lit(depth)).alias("node"), F.lit(0).alias("edits"))
        if levels:
            states = states.unionByName(levels[-1].where(F.length("node") == depth))
        stay = F.struct("position", "edits")
        skip = F.struct((F.col("position") + 1).alias("position"), F.lit(1).alias("edits"))
        states = states.select("side", "letters", "n", "node", F.explode(F.when(F.col("edits") == 0, F.array(stay, skip)).otherwise(F.array(stay))).alias("x"))
        states = states.select("side", "letters", "n", "node", "x.*").where(F.col("position") < F.length("letters"))
        own = _letter("letters", F.col("position") + 1) == F.col("letter")
        met = states.join(trie.where(F.col("depth") == depth).select("side", "node", "letter"), ["side", "node"]).where((F.col("edits") == 0) | own)
        levels.append(stored(met.select("side", "letters", "n", (F.col("position") + 1).alias("position"), F.concat("node", "letter").alias("node"), (F.col("edits") + F.when(own, 0).otherwise(1)).alias("edits"))))
    spark, left = words.sparkSession, F.length("letters") - F.col("position")
    found = spark.createDataFrame([], FOUND)
    for level in levels:
        # at the end of the word after an edit, or one letter before it without one: that letter is left out
        ends = level.where(left == 1 - F.col("edits")).select("side", "letters", "n", "node")
        turned = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
        found = found.unionByName(ends.select(turned("letters").alias("word"), "n", turned("node").alias("near")))
    found = stored(found.distinct())
    for df in (sides, trie, *levels):
        forget(df)
    return found


PRIMES = ((2_147_483_629, 1_000_003), (2_147_483_587, 998_244_353))


def _without_each(letters: np.ndarray) -> np.ndarray:
    """Hashes of a word with each letter left out, and of the word, by running sums of letters times powers."""
    out = np.zeros(len(letters) + 1, np.uint64)
    for p, b in PRIMES:
        powers = np.ones(1, np.uint64)
        while len(powers) <= len(letters):
            powers = np.concatenate([powers, powers * np.uint64(pow(b, len(powers), p)) % np.uint64(p)])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters.astype(np.uint64) * powers[: len(letters)] % np.uint64(p), dtype=np.uint64)])
        after = (sums[-1] - sums[1:]) % np.uint64(p) * np.uint64(pow(b, -1, p))
        out = out << np.uint64(31) | np.append((sums[:-1] + after) % np.uint64(p), sums[-1] % np.uint64(p))
    return out


def _hashes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        for name, word in zip(pdf["id"], pdf["word"], strict=True):
            keys = _without_each(np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32) + 1)
            yield pd.DataFrame({"id": name, "at": np.append(np.arange(len(keys) - 1), -1), "key": keys.view(np.int64)})


def match_long(words: DataFrame) -> DataFrame:
    """``(word, n, near)`` of words over ``WALKED`` letters and those as long as that: without the letter at one
    place both are equal, or one is what is left of the other. Hashes give the candidates, the words decide."""
    ids = words.where(F.length("word") >= WALKED).select(F.xxhash64("word").alias("id"), "word", "n")
    keys = ids.mapInPandas(_hashes, "id long, at long, key long")
    less, same = keys.where("at >= 0"), ["key", "at"]
    replaced = less.join(less.withColumnRenamed("id", "other"), same).where("id <> other").select("id", "other", "at", F.lit(True).alias("both"))
    left_out = less.join(keys.where("at < 0").select("key", F.col("id").alias("other")), "key").select("id", "other", "at", F.lit(False).alias("both"))
    pairs = replaced.unionByName(left_out).groupBy("id", "other", "both").agg(F.min("at").alias("at"))
    pairs = pairs.join(ids, "id").join(ids.select(F.col("id").alias("other"), F.col("word").alias("near")), "other")
    without = lambda c: F.concat(F.substring(F.col(c), F.lit(1), F.col("at")), F.substring(F.col(c), F.col("at") + 2, F.length(c)))
    return pairs.where(without("word") == F.when(F.col("both"), without("near")).otherwise(F.col("near"))).where("word <> near").select("word", "n", "near")


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)``: all pairs of ``(word, n)`` that differ by one letter put in, left out or replaced, in both directions."""
    short, long = words.where(F.length("word") <= WALKED), words.where(F.length("word") >= WALKED)
    found = walk(short)
    if not long.isEmpty():
        found = found.unionByName(match_long(words))
    pairs = found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    back = pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select("word", "near", "near_n").unionByName(back).distinct()


def follow(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: forms followed to the last. The way is halved every round; counts grow along it, so it has an end."""
    ways = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        rows = ways.join(on, "root", "left")
        longer = stored(rows.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        forget(ways)
        ways = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return ways


def group_variants(docs: DataFrame, every: int = EVERY, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``(doc_id, text)``.

    A word's form is the most frequent of the words one edit away, the first
    of equally frequent ones in the order of code points, if it is at least
    twice as frequent. Null and empty texts have no words; a null id is the
    empty string where runs are hashed; repeated rows count each; a word may
    have any length and any number of neighbours; no words give no rows.
    Other columns are not read.
    """
    words = stored(count_words(docs, every, least_length, least_times))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    near = near.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    rows = words.join(near, "word", "left")
    is_form = F.col("near_n") >= FACTOR * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    roots = follow(rows.where("form is not null").select("word", "form"))
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8)::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) r(b))),
runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS times FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, times, xor(list_reduce(
    flatten([CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END FOR c IN [unicode(s)::BIGINT FOR s IN string_split(doc_id || ':' || run, '')]]),
    lambda h, b: xor(h >> 8, t[xor(h, b) % 256 + 1]), 4294967295), 4294967295) AS h FROM runs, crc_table),
cut AS (SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
less AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM words, unnest(range(length(word))) u(p)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
ranked AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM pairs),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r USING (word)),
ways AS (SELECT word, form AS root, 1 AS steps FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT w.word, f.form, w.steps + 1 FROM ways w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n
FROM forms f LEFT JOIN (SELECT word, arg_max(root, steps) AS root FROM ways GROUP BY word) r USING (word)
"""
