"""Benchmark passages in documents: SimHash windows, a multi-index, exact verification.

Words are lower-cased (A-Z) runs without blanks; shingles are 5 words. An
item's shingle weighs its count over the number of items of the whole benchmark
that have it (counted in Spark, so it does not depend on blocks). A window of as
many words as the item is a leak if the item's weight that it holds is at least
0.8 of the whole.

1. One pass over the documents keeps the places of shingles that some item has,
   found with a bitmap of bounded size (false positives are harmless).
2. Items of one length are indexed together. Each window of that many words, at
   every start that can hold the most, is fingerprinted: 128-bit SimHash over the
   shingles that items of this length have, each with the square root of its
   weight. Words of no item have no say, so filler, however often repeated,
   does not turn a fingerprint. A window that holds the share c of an item has a cosine
   of at least sqrt(c) with it if it holds nothing of other items: at c = 0.8
   19 of 128 bits are expected to differ, with a standard deviation of 4.
3. Sixteen one-byte tables hold all items within two bits; by the pigeonhole
   principle they give every item within ``RADIUS`` = 45 bits (16 * 2 + 13 < 16 * 3).
4. Candidates are verified: every window of the item's length is weighed, by
   counts updated from one to the next, and the best one is reported.

What can be missed: a leak near 0.8 next to other items of the same length whose
shingles weigh far more than its own.

Items are worked through in blocks (bounded objects sent to the tasks), by length, over the
places kept in step 1, not over the documents again.

Nulls, empty texts and items without words match nothing. Repeated items are one. Texts and items under 5
words are one shingle; texts are also searched for shingles as short as such items (a shingle as
short as the item is the item, no fingerprint needed). Repeated rows are reported for each row; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarmill.llm.textnum import SHINGLE, mix64, shingle_hashes, texts_words
from sonarmill.session import cut, free

SIMILARITY = 0.8
BLOCKS = 16  # of 8 bits
RADIUS = 45
PER_BLOCK = RADIUS // BLOCKS
ITEMS_PER_BLOCK = 5000
WORDS_PER_BLOCK = 1_000_000
#: Words of 64 bits in the bitmap of item shingles: four shingles a word, within these bounds.
BITMAP = (1 << 18, 1 << 22)

_BITS = np.array([bin(k).count("1") for k in range(256)], np.uint8)


def signs(shingles: np.ndarray) -> np.ndarray:
    """A row of 128 signs for each shingle."""
    pair = np.stack([shingles, mix64(shingles ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
    return np.unpackbits(pair.view(np.uint8).reshape(len(shingles), BLOCKS), axis=1).astype(np.float32) * 2 - 1


class Items:
    """A block of benchmark items, indexed by shingle and by fingerprint byte.

    ``spread`` tells for each shingle hash how many items of the whole benchmark have it; without
    it the block is the whole.
    """

    def __init__(self, ids: list[int], texts: list[str | None], spread: dict[int, int] | None = None):
        words = [w for _, w in texts_words(pa.array(texts, pa.string()))]
        self.ids, self.words = ids, words
        shingles = [shingle_hashes(w) for w in words]
        flat = np.concatenate([*shingles, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(words)), [len(s) for s in shingles])
        offset = np.concatenate([np.arange(len(s)) for s in shingles] + [np.zeros(0, np.int64)]).astype(np.int64)
        order = np.lexsort((offset, owner, flat))
        flat, owner, offset = flat[order], owner[order], offset[order]
        self.values, at = np.unique(flat, return_index=True)
        self.at, self.owner, self.offset = np.append(at, len(flat)), owner, offset
        key = np.stack([flat, owner.astype(np.uint64)], axis=1)
        pairs, counts = np.unique(key, axis=0, return_counts=True)
        value, item = np.searchsorted(self.values, pairs[:, 0]), pairs[:, 1].astype(np.int64)
        own = np.bincount(value, minlength=len(self.values))
        weight = 1.0 / np.array([spread[v] for v in self.values.tolist()], np.float64) if spread else 1.0 / own
        self.weights: list[dict[int, tuple[int, float]]] = [{} for _ in words]
        for v, o, c in zip(value.tolist(), item.tolist(), counts.tolist(), strict=True):
            self.weights[o][v] = (c, float(weight[v]))
        self.total = np.array([math.fsum(c * w for c, w in x.values()) for x in self.weights])
        self.short = sorted({len(w) for w in words if 0 < len(w) < SHINGLE})
        self.signs = signs(self.values)
        size = np.array([len(w) for w in words], np.int64)
        #: For each length: its shingles, the most that an item has of each, and the least weight of a leak.
        self.of_length: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
        for n in sorted(set(size.tolist()) - set(range(SHINGLE))):
            mine = size[item] == n
            has, inverse = np.unique(value[mine], return_inverse=True)
            most = np.zeros(len(has), np.int64)
            np.maximum.at(most, inverse, counts[mine])
            self.of_length[n] = (has, most, float(self.total[size == n].min()))
        self.size, self.weight = size, weight
        votes = np.zeros((len(words), 8 * BLOCKS), np.float32)
        np.add.at(votes, item, self.signs[value] * np.sqrt(counts * weight[value])[:, None].astype(np.float32))
        self.prints = np.packbits(votes > 0, axis=1)
        near = _BITS[np.bitwise_xor.outer(np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8))] <= PER_BLOCK
        self.tables = [np.packbits(near[:, self.prints[:, b]], axis=1) for b in range(BLOCKS)]

    def known(self, place: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places where the block has the shingle, and which value."""
        if not len(shingles) or not len(self.values):
            return place[:0], np.zeros(0, np.int64)
        value = np.minimum(np.searchsorted(self.values, shingles), len(self.values) - 1)
        real = self.values[value] == shingles
        return place[real], value[real]

    def within(self, finger: np.ndarray) -> np.ndarray:
        """Items whose fingerprints differ in at most RADIUS bits."""
        found = self.tables[0][finger[0]].copy()
        for b in range(1, BLOCKS):
            found |= self.tables[b][finger[b]]
        items = np.flatnonzero(np.unpackbits(found, count=len(self.ids)))
        return items[_BITS[self.prints[items] ^ finger].sum(axis=1, dtype=np.int64) <= RADIUS]

    def similarity(self, item: int, value_counts: dict[int, int]) -> float:
        own = self.weights[item]
        if not own:
            return 0.0
        return math.fsum(w * min(c, value_counts.get(v, 0)) for v, (c, w) in own.items()) / self.total[item]

    def candidates(self, place: np.ndarray, value: np.ndarray, n_words: int, similarity: float) -> set[int]:
        """Items within RADIUS of the fingerprint of some window of their length."""
        found: set[int] = set()
        owners = np.unique(np.concatenate([self.owner[self.at[v] : self.at[v + 1]] for v in np.unique(value).tolist()]))
        for n in sorted(set(self.size[owners].tolist()) & self.of_length.keys()):
            has, most, least = self.of_length[n]
            k = np.minimum(np.searchsorted(has, value), len(has) - 1)
            mine = has[k] == value
            at, own, cap = place[mine], value[mine], most[k[mine]]
            end = max(0, n_words - n)
            starts = np.unique(np.append(np.minimum(at, end), end))
            lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + n - SHINGLE + 1)
            sums = np.concatenate([[0.0], np.cumsum(self.weight[own])])
            may = sums[hi] - sums[lo] >= (similarity - 1e-6) * least  # repeats count in full: an upper bound
            seen = None
            for a, b in zip(lo[may].tolist(), hi[may].tolist(), strict=True):
                if seen == (a, b):
                    continue
                seen = (a, b)
                inside, first, times = np.unique(own[a:b], return_index=True, return_counts=True)
                times = np.minimum(times, cap[a:b][first])
                votes = np.sqrt(times * self.weight[inside]).astype(np.float32) @ self.signs[inside]
                items = self.within(np.packbits(votes > 0))
                found.update(items[self.size[items] == n].tolist())
        return found

    def _windows(self, item: int, place: np.ndarray, value: np.ndarray, n_words: int, similarity: float) -> Iterator[tuple[int, float]]:
        """(first word, similarity) of the item's windows that reach ``similarity``, in order.

        A window that starts at no shingle of the item holds no more than the one
        that starts at the next shingle, so starts at these, at the last window
        and lined up with a shingle's offset in the item stand for all windows.
        """
        own = self.weights[item]
        n = len(self.words[item])
        end, size = max(0, n_words - n), max(1, n - SHINGLE + 1)
        mine = np.isin(value, np.fromiter(own, np.int64, len(own)))
        place, value = place[mine], value[mine]
        starts = [place, np.array([end])]
        for v in np.unique(value).tolist():
            at = slice(self.at[v], self.at[v + 1])
            starts.append(np.subtract.outer(place[value == v], self.offset[at][self.owner[at] == item]).ravel())
        starts = np.unique(np.clip(np.concatenate(starts), 0, end))
        lo, hi = np.searchsorted(place, starts).tolist(), np.searchsorted(place, starts + size).tolist()
        values, counts, held, a, b = value.tolist(), dict.fromkeys(own, 0), 0.0, 0, 0
        for start, x, y in zip(starts.tolist(), lo, hi, strict=True):
            for v in values[b:y]:
                held += own[v][1] * (counts[v] < own[v][0])
                counts[v] += 1
            for v in values[a:x]:
                counts[v] -= 1
                held -= own[v][1] * (counts[v] < own[v][0])
            a, b = x, y
            # The running sum may be off in its last digits; the similarity is summed afresh.
            if held >= (similarity - 1e-6) * self.total[item] and (s := self.similarity(item, counts)) >= similarity:
                yield start, s

    def leaks(self, place: np.ndarray, shingles: np.ndarray, width: np.ndarray, n_words: int, similarity: float) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity): the best window of each item that the text leaks."""
        out = []
        for w in self.short:
            at, value = self.known(place[width == w], shingles[width == w])
            values, first = np.unique(value, return_index=True)
            out += [(i, int(at[k]), w, 1.0) for v, k in zip(values.tolist(), first.tolist(), strict=True) for i in self.owner[self.at[v] : self.at[v + 1]].tolist()]
        at, value = self.known(place[width == SHINGLE], shingles[width == SHINGLE])
        if not len(at):
            return out
        best: dict[int, tuple[int, int, float]] = {}
        for item in sorted(self.candidates(at, value, n_words, similarity)):
            for start, s in self._windows(item, at, value, n_words, similarity):
                if item not in best or s > best[item][2]:
                    best[item] = (start, len(self.words[item]), s)
        return sorted([*out, *((i, *x) for i, x in best.items())])


LEAK_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])
LEAK_DDL = "doc_id long, item_id long, first_word long, n_words long, similarity double"


def _leaks(ids: list[int], texts: list[str], spread: dict[int, int], similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts, spread)
        for batch in batches:
            rows = []
            lists = [batch.column(k) for k in (2, 3, 4)]
            for k in range(batch.num_rows):
                place, shingle, width = (c[k].values.to_numpy(zero_copy_only=False) for c in lists)
                rows += [(batch.column(0)[k].as_py(), ids[i], *x) for i, *x in items.leaks(place, shingle.view(np.uint64), width, batch.column(1)[k].as_py(), similarity)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LEAK_SCHEMA, strict=True)], schema=LEAK_SCHEMA)

    return run


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, values = [], []
        for _, words in texts_words(batch.column(1)):
            sizes.append(len(words))
            values.append(np.unique(shingle_hashes(words)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["item_id", "text", "n", "s"])


def _hits(bitmap: np.ndarray, widths: list[int]):
    shift = np.uint64(64 - (len(bitmap).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row, words in texts_words(batch.column(1)):
                found = []
                for w in widths:
                    if w > len(words):
                        continue
                    h = shingle_hashes(words, w)
                    at = np.flatnonzero((bitmap[(h >> shift).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1))
                    if len(at):
                        found.append((at, h[at].view(np.int64), np.full(len(at), w)))
                if found:
                    rows.append((batch.column(0)[row].as_py(), len(words), *(np.concatenate(x) for x in zip(*found, strict=True))))
            if rows:
                kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "place", "shingle", "width"])

    return run


def _bitmap(spread: DataFrame) -> np.ndarray:
    """Bits of the shingles; at most BITMAP[1] words whatever the benchmark's size."""
    size = min(max(BITMAP[0], 1 << max(spread.count() // 4, 1).bit_length()), BITMAP[1])
    word = F.shiftrightunsigned("shingle", 64 - (size.bit_length() - 1)).alias("word")
    bits = spread.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(shingle & 63 as int))")).alias("bits")).toArrow()  # 16 bytes a row
    out = np.zeros(size, np.uint64)
    out[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return out


def _blocks(sizes: list[tuple[int, int]]) -> list[Column]:
    """Conditions on items (n, text) that deal them to blocks: lengths together, a length with very many items in parts."""
    out, lengths, items, words = [], [], 0, 0
    for n, count in sorted(sizes):
        limit = max(1, min(ITEMS_PER_BLOCK, WORDS_PER_BLOCK // n))
        if lengths and (items + count > ITEMS_PER_BLOCK or words + n * count > WORDS_PER_BLOCK):
            out.append(F.col("n").isin(lengths))
            lengths, items, words = [], 0, 0
        if count > limit:
            parts = -(-2 * count // limit)  # parts by hash are of uneven size
            out += [(F.col("n") == n) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]
        else:
            lengths, items, words = [*lengths, n], items + count, words + n * count
    return out + ([F.col("n").isin(lengths)] if lengths else [])


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity) of every leak: the best window of each item and document."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    indexed = cut(items.mapInArrow(_item_shingles, "item_id long, text string, n long, s array<long>").where("n > 0"), "items")
    spread = cut(indexed.select(F.explode("s").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("spread")), "spread")
    sizes = [(r["n"], r["count"]) for r in indexed.groupBy("n").count().collect()]
    widths = sorted({n for n, _ in sizes if n < SHINGLE} | {SHINGLE})
    hits = cut(texts.mapInArrow(_hits(_bitmap(spread), widths), "doc_id long, n_words long, place array<long>, shingle array<long>, width array<long>"), "hits")
    weighed = indexed.select("item_id", "text", "n", F.explode("s").alias("shingle")).join(spread, "shingle").groupBy("item_id", "text", "n").agg(F.collect_list(F.struct("shingle", "spread")).alias("s"))
    weighed = cut(weighed, "weighed")
    conditions = _blocks(sizes)
    found = None
    for block in conditions:
        rows = weighed.where(block).orderBy("item_id", "text").collect()  # bounded by ITEMS_PER_BLOCK and WORDS_PER_BLOCK
        known = {x["shingle"] % (1 << 64): x["spread"] for r in rows for x in r["s"]}
        leaks = hits.mapInArrow(_leaks([r["item_id"] for r in rows], [r["text"] for r in rows], known, similarity), LEAK_DDL)
        leaks = cut(leaks, "leaks") if len(conditions) > 1 else leaks
        found = leaks if found is None else found.union(leaks)
    free(indexed, spread, weighed)
    return found if found is not None else spark.createDataFrame([], LEAK_DDL)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
