"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 of the trie has the words, as a monotone sequence of 64-bit hashes; a
word's number is its rank. It is counted and built in shards by hash. Texts are
read and split once: the corpus is kept as parts, each with the hashes of its
own words and a number among these for every token. Then every part is cut
into n-grams of word numbers, and sends its distinct ones, with their counts
in training texts, to the shard that holds their context. A shard builds its levels 2 and 3: contexts,
monotone pointers to the successors of each, the successors made monotone over
the contexts, and quantised discounted probabilities, in a flat file that is
memory-mapped; and it answers what it was asked by searching every n-gram's
word among the successors of its context. What it finds goes back to the parts
as sums by text. No task sees more of the trie than its shard of it, and no
n-gram comes from a part more than once, however common it is; the numbers of
the texts it stands in follow it.

``p(w | h) = d(h, w) + g(h) * p(w | shorter h)``, where ``d`` is the absolutely
discounted frequency of an n-gram, ``g`` the mass that discounting leaves, and
``p(w) = (c(w) + 1) / (N + V + 1)``; so the model sums to 1 over the words and
one unknown. Every n-gram counts, from its first occurrence on.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, settle
from .eliasfano import EliasFano, map_flat, remove_flat, write_flat

#: What is taken off the count of an n-gram that occurs once, twice, or more often.
DISCOUNTS = (0.8, 1.1, 1.4)
#: Training texts a shard of level 1, and training tokens a shard of the levels above.
SHARD_DOCS, SHARD_TOKENS = 16_384, 1_000_000
#: A part of the corpus, and a chunk that is asked at once, have the product of the first two in tokens; bytes that a token takes on average, and counts that a task adds up before it sends them.
CHUNK, PART_CHUNKS, TOKEN_BYTES, HELD_COUNTS = 300_000, 4, 6, 1_000_000
#: The token that ends a text. No word holds a space.
END = b" "
HALF = 32
LOWEST, STEPS = 16.0, 65_535


def quantise(p: np.ndarray) -> np.ndarray:
    """16 bits for log10 of a probability, from 0 down to -LOWEST; finer near 0, where long runs of sure words add up."""
    return np.rint(np.sqrt(np.clip(-np.log10(np.clip(p, 1e-300, 1)), 0, LOWEST) / LOWEST) * STEPS).astype(np.uint16)


def log_of(code: np.ndarray) -> np.ndarray:
    x = code.astype(np.float64) / STEPS
    return -LOWEST * x * x


RESTORED = 10.0 ** log_of(np.arange(STEPS + 1))


def restored(code: np.ndarray) -> np.ndarray:
    return RESTORED[code]


def hash_word(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w, 42)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)


def _blocks(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """A row a shard: its keys as bytes, and its counts packed."""
    order = np.argsort(shards, kind="stable")
    shards, keys, counts = shards[order], keys[order], counts[order]
    cut = np.flatnonzero(np.diff(shards)) + 1
    rows = [(int(s[0]), k.tobytes(), _packed(c)) for s, k, c in zip(*(np.split(x, cut) for x in (shards, keys, counts)), strict=True) if len(s)]
    return pd.DataFrame(rows, columns=["shard", "k", "n"])


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = _starts(keys)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _summed(pdf: pd.DataFrame, kind: type) -> tuple[np.ndarray, np.ndarray]:
    return _added(np.frombuffer(b"".join(pdf["k"]), kind), np.concatenate([np.empty(0, np.int64), *(_unpacked(n)[0] for n in pdf["n"])]))


def _pieces(sizes: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of about that size, or of one that is larger: (from, to)."""
    until, a = np.cumsum(sizes), 0
    while a < len(until):
        b = min(len(until), 1 + int(np.searchsorted(until, (until[a - 1] if a else 0) + size)))
        yield a, b
        a = b


PARTS = "first long, doc_id array<string>, held_out array<boolean>, sizes binary, words binary, counts binary, tokens binary"


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words of texts, in the order of their first tokens, so that common ones have small numbers; the
    place of every token's word among them; tokens of each text.

    The words are those of ``common.words_of``: these functions change A-Z only, and split at exactly the same characters.
    """
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    # behind a space that follows the last word stands an empty word, which is the end; an empty text is just that
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(texts, "", " "))
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    hashes = np.array([hash_word(w or END) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    return hashes, coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)


def _cut(tokens: int):
    """The corpus as parts of about so many tokens, or one longer text: the number of the first text, ids of the texts and
    their tokens, hashes of the words, their counts in training texts, and the words of all tokens by their place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << HALF
        kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), *[pa.binary()] * 4)
        for batch in batches:
            text, held = pc.fill_null(batch["text"], ""), batch["held_out"].to_numpy(zero_copy_only=False).astype(bool)
            for a, b in _pieces(pc.binary_length(text).to_numpy().astype(np.int64) + 1, tokens * TOKEN_BYTES):
                hashes, place, sizes = _tokens(text.slice(a, b - a))
                counts = np.bincount(place[np.repeat(~held[a:b], sizes)], minlength=len(hashes))
                row = (first + a, batch["doc_id"].slice(a, b - a).to_pylist(), held[a:b].tolist(), sizes.tobytes(), hashes.tobytes(), _packed(counts), _packed(place))
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=[c.split()[0] for c in PARTS.split(", ")])
            first += batch.num_rows

    return cut


def _count_words(shift: int):
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, size = [], [], 0

        def flush() -> pd.DataFrame:
            h, n = _added(np.concatenate(keys), np.concatenate(counts))
            keys.clear()
            counts.clear()
            return _blocks((h >> np.uint64(shift)).astype(np.int64), h, n)

        for pdf in parts:
            for k, n in zip(pdf["words"], pdf["counts"], strict=True):
                h, (n,) = np.frombuffer(k, np.uint64), _unpacked(n)
                keys.append(h[n > 0])
                counts.append(n[n > 0])
                size += len(keys[-1])
                if size > HELD_COUNTS:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return count


def _build_words(folder: str, hot: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        keys, counts = _summed(pdf, np.uint64)
        meta, arrays = {}, {}
        for name, values in (("words", keys), ("sums", np.concatenate([[0], np.cumsum(counts)]))):
            m, a = EliasFano.build(values).parts(name)
            meta |= m
            arrays |= a
        write_flat(posixpath.join(folder, f"words-{shard}"), meta, arrays)
        often = np.flatnonzero(counts > hot)
        return pd.DataFrame({"shard": [shard], "distinct": [len(keys)], "total": [int(counts.sum())], "hot": [often.tolist()], "often": [counts[often].tolist()]})

    return build


class Words:
    """The mapped level 1. ``plan``: folder, shift, words per shard, totals."""

    def __init__(self, plan: dict):
        self.plan, self.words, self.sums = plan, {}, {}
        self.offsets = np.array([0, *np.cumsum(plan["distinct"])], np.int64)
        self.vocabulary = int(self.offsets[-1])
        # the start of a text, and what no training text holds, as numbers
        self.start, self.unknown = self.vocabulary, self.vocabulary + 1

    def _level1(self, shard: int) -> None:
        if shard not in self.words:
            meta, arrays = map_flat(posixpath.join(self.plan["folder"], f"words-{shard}"))
            self.words[shard], self.sums[shard] = (EliasFano.of(meta, arrays, k) for k in ("words", "sums"))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of hashes."""
        shards = (hashes >> np.uint64(self.plan["shift"])).astype(np.int64)
        found = np.full(len(hashes), self.unknown, np.int64)
        for s in np.unique(shards).tolist():
            if self.plan["distinct"][s]:
                self._level1(s)
                at = np.flatnonzero(shards == s)
                i, equal = self.words[s].successor(hashes[at])
                found[at[equal]] = i[equal] + self.offsets[s]
        return found

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of word numbers; 0 for the start and the unknown."""
        out = np.zeros(len(ids), np.int64)
        shards = np.searchsorted(self.offsets, ids, side="right") - 1
        for s in np.unique(shards[ids < self.vocabulary]).tolist():
            self._level1(s)
            at = np.flatnonzero((shards == s) & (ids < self.vocabulary))
            k = ids[at] - self.offsets[s]
            out[at] = self.sums[s].access(k + 1).astype(np.int64) - self.sums[s].access(k).astype(np.int64)
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.plan["tokens"] + self.vocabulary + 1)


def discount(counts: np.ndarray) -> np.ndarray:
    return np.array([0.0, *DISCOUNTS])[np.minimum(counts, 3)]


def _level(name: str, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, own: np.ndarray | None = None) -> tuple[dict, dict[str, np.ndarray]]:
    """One level from distinct (context, word) in order. ``own``: how often each context occurs, if that isn't their sum."""
    start = _starts(contexts)
    held = contexts[start]
    ends = np.append(start[1:], len(words)).astype(np.int64)
    sizes = ends - start
    total = (np.add.reduceat(counts, start) if len(start) else np.empty(0, np.int64)) if own is None else own
    off = discount(counts)
    left = (np.add.reduceat(off, start) if len(start) else off) / np.maximum(total, 1)
    # every context's successors start one past the last of the context before
    base = np.concatenate([[0], np.cumsum(words[ends - 1] + 1)[:-1]]) if len(start) else np.empty(0, np.int64)
    meta, arrays = {}, {f"{name}.code": quantise((counts - off) / np.repeat(np.maximum(total, 1), sizes)), f"{name}.left": quantise(left)}
    for part, values in (("contexts", held), ("pointers", np.append(start, len(words))), ("successors", words + np.repeat(base, sizes))):
        m, x = EliasFano.build(values).parts(f"{name}.{part}")
        meta |= m
        arrays |= x
    return meta, arrays


class Level:
    """A mapped level: the discounted frequency of n-grams, and the mass their contexts leave."""

    def __init__(self, meta: dict, arrays: dict[str, np.ndarray], name: str):
        self.contexts, self.pointers, self.successors = (EliasFano.of(meta, arrays, f"{name}.{k}") for k in ("contexts", "pointers", "successors"))
        self.code, self.left = arrays[f"{name}.code"], arrays[f"{name}.left"]

    def look(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(d, g)`` of n-grams whose contexts are in order; 0 and 1 where the trie holds none of the context."""
        d, g = np.zeros(len(words)), np.ones(len(words))
        if not self.contexts.n:
            return d, g
        first = _starts(contexts)
        own, inverse = contexts[first], np.repeat(np.arange(len(first)), np.diff(first, append=len(contexts)))
        held, pointers = self.contexts.all(), self.pointers.all().astype(np.int64)
        i = np.minimum(np.searchsorted(held, own.astype(np.uint64)), len(held) - 1)
        found = held[i] == own.astype(np.uint64)
        start, end = pointers[i], pointers[i + 1]
        # a successor search relative to the context: one past the last word of the context before
        many = 8 * len(words) >= self.successors.n
        held = self.successors.all() if many else None
        before = np.maximum(start - 1, 0)
        last = held[before] if many else self.successors.access(before)
        base = np.where(start > 0, last.astype(np.int64) + 1, 0)
        asked = (base[inverse] + words).astype(np.uint64)
        if many:
            j = np.minimum(np.searchsorted(held, asked), len(held) - 1)
            same = held[j] == asked
        else:
            j, same = self.successors.successor(asked)
            j = np.minimum(j, self.successors.n - 1)
        same &= found[inverse] & (j >= start[inverse]) & (j < end[inverse])
        d[same] = restored(self.code[j[same]])
        seen = found[inverse]
        g[seen] = restored(self.left[i])[inverse[seen]]
        return d, g


def _grams(words: Words, part: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of a part's words and of the start, in order; of all tokens the place there of the word, the word
    before and the one before that; and the tokens of each text."""
    sizes, (place,) = np.frombuffer(part.sizes, np.int64), _unpacked(part.tokens)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    ids, rank = np.unique(np.append(words.find(np.frombuffer(part.words, np.uint64)), words.start), return_inverse=True)
    w = rank[place]
    h1, h2 = np.roll(w, 1), np.roll(w, 2)
    h1[starts] = h2[starts] = rank[-1]
    h2[starts[sizes > 1] + 1] = rank[-1]
    return ids, w, h1, h2, sizes


def shard_of(plan: dict, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """N-grams of one last word stay together; those of a hot word are dealt by the word before it, too."""
    hot = np.isin(h1, plan["hot"])
    return (_mixed(np.where(hot, h1 << HALF ^ h2, h1)) % np.uint64(plan["shards"])).astype(np.int64)


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows in order, and the place of each row among them."""
    width = lambda values: [int(c.max(initial=0)).bit_length() for c in values]
    ranks, bits = [(c, None) for c in columns], width(columns)
    for k, c in enumerate(columns):
        if sum(bits) > 63:  # ranks take fewer bits
            values, r = np.unique(c, return_inverse=True)
            ranks[k], bits[k] = (r, values), len(values).bit_length()
    if sum(bits) > 63:  # a text of so many words that not even their ranks go into one number
        order = np.lexsort(columns[::-1])
        new = np.concatenate([[True], np.any([c[order[1:]] != c[order[:-1]] for c in columns], 0)])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return [c[order[new]] for c in columns], place
    key = np.zeros(len(columns[0]), np.int64)
    for (r, _), n in zip(ranks, bits, strict=True):
        key = key << n | r
    key, place = np.unique(key, return_inverse=True)
    out = []
    for (_, values), n in zip(ranks[::-1], bits[::-1], strict=True):
        r = key & (1 << n) - 1
        key = key >> n
        out.append(r if values is None else values[r])
    return out[::-1], place


def _runs(text: np.ndarray, *columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct rows in order, how often each stands, and the texts it stands in, in the order of the rows."""
    bits = [int(c.max(initial=0)).bit_length() for c in (*columns, text)]
    if sum(bits[:-1]) > 63:
        rows, place = _distinct(*columns)
        return rows, np.bincount(place, minlength=len(rows[0])), text[np.argsort(place, kind="stable")]
    key = np.zeros(len(text), np.int64)
    for c, n in zip(columns, bits, strict=False):
        key = key << n | c
    if sum(bits) > 63:
        order = np.argsort(key)
        text, key = text[order], key[order]
    else:  # the text goes along, as numbers alone are sorted much faster than places
        key = key << bits[-1] | text
        key.sort()
        text, key = key & (1 << bits[-1]) - 1, key >> bits[-1]
    first = _starts(key)
    times, key, rows = np.diff(first, append=len(key)), key[first], []
    for n in bits[-2::-1]:
        rows.append(key & (1 << n) - 1)
        key = key >> n
    return rows[::-1], times, text


_PRESS, _OPEN = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of as many numbers each as one compressed run of bytes: the high bytes of all numbers together, and none
    that the column's largest number doesn't need."""
    widths = [max(1, -(-int(c.max(initial=0)).bit_length() // 8)) for c in columns]
    planes = [(c >> 8 * k).astype(np.uint8).tobytes() for c, width in zip(columns, widths, strict=True) for k in range(width)]
    return _PRESS.compress(b"".join([bytes([len(widths), *widths]), *planes]))


def _unpacked(data: bytes) -> list[np.ndarray]:
    data = np.frombuffer(_OPEN.decompress(data), np.uint8)
    widths = data[1 : 1 + data[0]].tolist()
    planes, out = iter(data[1 + data[0] :].reshape(sum(widths), -1)), []
    for width in widths:
        column = next(planes).astype(np.int64)
        for k in range(1, width):
            column |= next(planes).astype(np.int64) << 8 * k
        out.append(column)
    return out


ASKED = "shard int, chunk long, keys int, tokens int, a binary, b binary, doc_id array<string>, held_out array<boolean>"


def _asked(plan: dict, chunk: int, ids: np.ndarray, train: np.ndarray, sizes: np.ndarray, *grams: np.ndarray) -> list[tuple]:
    """The distinct n-grams of a chunk and the texts they stand in, a row a shard."""
    used = np.zeros(len(ids), bool)
    for x in grams:
        used[x] = True
    rank, ids = np.cumsum(used) - 1, ids[used]  # a chunk's own numbers are shorter
    (x1, x2, x3), times, text = _runs(np.repeat(np.arange(len(sizes)), sizes), *(rank[x] for x in grams))
    n = np.add.reduceat(train[text].astype(np.int64), np.cumsum(times) - times)
    x1, x2, x3 = ids[x1], ids[x2], ids[x3]
    shard = shard_of(plan, x1, x2).astype(np.min_scalar_type(plan["shards"]))  # short numbers are sorted in linear time
    order, text = np.argsort(shard, kind="stable"), text[np.argsort(np.repeat(shard, times), kind="stable")]
    x1, x2, x3, n, times, shard = (x[order] for x in (x1, x2, x3, n, times, shard))
    first, until, out = [*_starts(shard).tolist(), len(shard)], np.concatenate([[0], np.cumsum(times)]), []
    for i, j in zip(first[:-1], first[1:], strict=True):
        own = text[until[i] : until[j]]
        out.append((int(shard[i]), chunk, j - i, len(own), _packed(np.diff(x1[i:j], prepend=0), x2[i:j], x3[i:j], n[i:j], times[i:j]), _packed(own), None, None))
    return out


def _ask(plan: dict):
    """Each chunk's distinct n-grams and the texts they stand in, a row a shard; and a row of shard -1 or below with
    what is known of the chunk's texts already."""

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(plan)
        for pdf in parts:
            for part in pdf.itertuples(index=False):
                ids, w, h1, h2, sizes = _grams(words, part)
                counts, until = words.counts(ids), np.concatenate([[0], np.cumsum(sizes)])
                known, base = (counts > 0).astype(np.int64), np.log10(words.unigram(counts))
                for a, b in _pieces(sizes, CHUNK * PART_CHUNKS):
                    chunk, held, own = part.first + a, part.held_out[a:b], slice(until[a], until[b])
                    starts = until[a:b] - until[a]
                    facts = [sizes[a:b], np.add.reduceat(known[w[own]], starts), np.add.reduceat(base[w[own]], starts).view(np.int64)]
                    out = [(-1 - chunk % plan["shards"], chunk, 0, 0, np.concatenate(facts).tobytes(), b"", part.doc_id[a:b], held)]
                    out += _asked(plan, chunk, ids, ~np.array(held, bool), sizes[a:b], h1[own], h2[own], w[own])
                    yield pd.DataFrame(out, columns=["shard", "chunk", "keys", "tokens", "a", "b", "doc_id", "held_out"])

    return ask


ANSWERED = "chunk long, shard int, a binary, doc_id array<string>, held_out array<boolean>"


def _answer(plan: dict):
    """Builds a shard's levels from what it is asked and told, maps them, and answers: of each block the sums of log10 p by text."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        if shard < 0:
            return pdf[["chunk", "shard", "a", "doc_id", "held_out"]]
        words = Words(plan)
        blocks = [_unpacked(x) for x in pdf["a"]]
        bounds = np.cumsum([0, *pdf["keys"]])
        h1, h2, w, n = (np.concatenate(c) for c in ([np.cumsum(x[0]) for x in blocks], *([x[k] for x in blocks] for k in (1, 2, 3))))
        times = [x[4] for x in blocks]
        del blocks
        (h1, h2, w), place = _distinct(h1, h2, w)
        n = np.bincount(place, n, len(h1)).astype(np.int64)
        name = posixpath.join(plan["folder"], f"grams-{shard}-{uuid.uuid4().hex}")
        _build(plan, name, h1[n > 0], h2[n > 0], w[n > 0], n[n > 0])
        meta, arrays = map_flat(name)
        seen, inverse = np.unique(w, return_inverse=True)
        p = words.unigram(words.counts(seen))[inverse]
        d, g = Level(meta, arrays, "two").look(h1, w)
        hot = np.flatnonzero(np.isin(h1, plan["hot"]))
        if len(hot):
            d[hot], g[hot] = Hot(plan).look(h1[hot], w[hot])
        p = d + g * p
        d, g = Level(meta, arrays, "three").look(h1 << HALF | h2, w)
        said = np.log10(np.minimum(d + g * p, 1.0))
        remove_flat(name)  # all that is asked of this shard is answered; a task that is run again builds it again
        sums = []
        for k, data in enumerate(pdf["b"]):
            own = np.repeat(said[place[bounds[k] : bounds[k + 1]]], times[k])
            sums.append(np.bincount(_unpacked(data)[0], own).astype(np.float32).tobytes())
        return pd.DataFrame({"chunk": pdf["chunk"], "shard": pdf["shard"], "a": sums, "doc_id": None, "held_out": None})

    return answer


def _build(plan: dict, name: str, h1: np.ndarray, h2: np.ndarray, w: np.ndarray, n: np.ndarray) -> None:
    """Levels 2 and 3 of a shard in one flat file; hot words have a level 2 of their own."""
    cold = ~np.isin(h1, plan["hot"])
    (x1, x2), place = _distinct(h1[cold], w[cold])
    meta, arrays = _level("two", x1, x2, np.bincount(place, n[cold], len(x1)).astype(np.int64))
    for m, x in (_level("three", h1 << HALF | h2, w, n),):
        meta |= m
        arrays |= x
    write_flat(name, meta, arrays)


def _count_hot(plan: dict):
    """Pairs whose first word is hot, dealt by both words."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(plan)
        for pdf in parts:
            for part in pdf.itertuples(index=False):
                ids, w, h1, _, sizes = _grams(words, part)
                at = np.flatnonzero(np.isin(ids, plan["hot"])[h1] & np.repeat(~np.array(part.held_out, bool), sizes))
                keys, n = np.unique(ids[h1[at]] << HALF | ids[w[at]], return_counts=True)
                yield _blocks((_mixed(keys) % np.uint64(plan["hot_shards"])).astype(np.int64), keys, n.astype(np.int64))

    return count


def _build_hot(plan: dict):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        keys, counts = _summed(pdf, np.int64)
        h1, w = keys >> HALF, keys & (1 << HALF) - 1
        held, start = np.unique(h1, return_index=True)
        meta, arrays = _level("two", h1, w, counts, np.array([plan["hot_counts"][int(h)] for h in held], np.int64))
        write_flat(posixpath.join(plan["folder"], f"hot-{shard}"), meta, arrays)
        return pd.DataFrame({"shard": shard, "h": held, "off": np.add.reduceat(discount(counts), start)})

    return build


class Hot:
    """Level 2 of hot words, over all shards; what a word leaves is known for the word as a whole."""

    def __init__(self, plan: dict):
        self.plan = plan

    def look(self, h1: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.zeros(len(w))
        shards = (_mixed(h1 << HALF | w) % np.uint64(self.plan["hot_shards"])).astype(np.int64)
        for s in np.intersect1d(shards, self.plan["hot_files"]).tolist():
            at = np.flatnonzero(shards == s)
            d[at] = Level(*map_flat(posixpath.join(self.plan["folder"], f"hot-{s}")), "two").look(h1[at], w[at])[0]
        own, inverse = np.unique(h1, return_inverse=True)
        return d, np.array([self.plan["hot_left"][int(h)] for h in own])[inverse]


def parts_of(docs: DataFrame) -> DataFrame:
    """The corpus of ``(doc_id, text, held_out)`` as parts, kept in the shared folder: later passes don't split texts again."""
    return settle(docs.mapInArrow(_cut(CHUNK * PART_CHUNKS), PARTS))


def train(texts: DataFrame) -> dict:
    """Builds level 1 of the whole of ``texts`` (a column ``text``), and level 2 of its hot words; returns the plan."""
    return learn(parts_of(texts.select(F.lit(None).cast("string").alias("doc_id"), "text", F.lit(False).alias("held_out"))))


def learn(parts: DataFrame) -> dict:
    """Builds level 1 of the texts in ``parts`` that aren't held out, and level 2 of their hot words; returns the plan.

    Totals, a number a shard, and two for every hot word (there are fewer than
    twice as many as shards) come to the driver.
    """
    n = parts.agg(F.sum(F.size(F.filter("held_out", lambda x: ~x)))).first()[0] or 0
    bits = max(2, (max(1, n) // SHARD_DOCS).bit_length())
    folder = f"{shared_dir(parts.sparkSession)}/lm-{uuid.uuid4().hex}"
    path = parts.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(parts.sparkSession._jsc.hadoopConfiguration())
    store.mkdirs(path)
    folder = store.makeQualified(path).toUri().toString()
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    plan = {"folder": folder, "shift": 64 - bits}
    blocks = parts.select("words", "counts").mapInPandas(_count_words(64 - bits), "shard int, k binary, n binary")
    schema = "shard int, distinct long, total long, hot array<long>, often array<long>"
    rows = settle(blocks.groupBy("shard").applyInPandas(_build_words(folder, SHARD_TOKENS // 2), schema)).collect()
    distinct = [0] * (1 << bits)
    for r in rows:
        distinct[r["shard"]] = r["distinct"]
    plan |= {"distinct": distinct, "tokens": sum(r["total"] for r in rows)}
    if sum(distinct) + 2 >= 1 << (HALF - 1):
        raise ValueError("word numbers take 31 bits at most")
    offsets = np.cumsum([0, *distinct]).tolist()
    # words of more occurrences than half a shard should hold
    hot = {offsets[r["shard"]] + k: c for r in rows for k, c in zip(r["hot"], r["often"], strict=True)}
    end = Words(plan).find(np.array([hash_word(END)], np.uint64))[0] if n else -1  # the end is no one's context, but the start is
    hot.pop(int(end), None)
    hot |= {offsets[-1]: n} if n > SHARD_TOKENS // 2 else {}
    plan |= {"shards": max(4, -(-plan["tokens"] // SHARD_TOKENS)), "hot": np.array(sorted(hot), np.int64), "hot_counts": hot, "hot_left": {}, "hot_files": []}
    if hot:
        plan["hot_shards"] = max(1, -(-sum(hot.values()) // SHARD_TOKENS))
        blocks = parts.select("held_out", "sizes", "words", "tokens").mapInPandas(_count_hot(plan), "shard int, k binary, n binary")
        off = settle(blocks.groupBy("shard").applyInPandas(_build_hot(plan), "shard int, h long, off double"))
        plan["hot_left"] = {r["h"]: r["off"] / hot[r["h"]] for r in off.groupBy("h").agg(F.sum("off").alias("off")).collect()}
        plan["hot_files"] = [r["shard"] for r in off.select("shard").distinct().collect()]
    return plan


def _sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """The answers of a part, summed up by text."""
    pdf = pdf.sort_values("shard")
    facts = pdf.iloc[0]
    sizes, known, base = np.frombuffer(facts["a"], np.int64).reshape(3, -1)
    total = np.zeros(len(sizes))
    for x in pdf["a"].iloc[1:]:
        x = np.frombuffer(x, np.float32)
        total[: len(x)] += x
    return pd.DataFrame({"doc_id": list(facts["doc_id"]), "held_out": list(facts["held_out"]), "n_tokens": sizes, "n_known": known, "base_score": base.view(np.float64), "score": total})


def held_out(doc_id: str = "doc_id", mod: int = 7, rest: int = 2):
    """crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores all ``(doc_id, text)``, having learnt from those that aren't held out.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a
    row for each document. Null texts count as empty: their one token is the
    end. Null ids are learnt from; repeated rows count each; with no training
    texts every token is unknown and has probability 1; an empty table gives
    no rows. Other columns are not read. Words are told apart by 64-bit
    hashes, so from about a billion words on some counts may be of two. ``docs``
    is read once.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", held_out().alias("held_out"))
    parts = parts_of(docs)
    plan = learn(parts)
    answers = parts.drop("counts").mapInPandas(_ask(plan), ASKED).groupBy("shard").applyInPandas(_answer(plan), ANSWERED)
    rows = answers.groupBy("chunk").applyInPandas(_sum_up, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return rows.select(F.col("doc_id").cast("long"), "held_out", "n_tokens", "n_known", F.lit(plan["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
