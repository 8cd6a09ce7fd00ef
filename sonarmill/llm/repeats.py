"""Removal of every byte under a string of 400 bytes that starts more than once.

1. *Anchors.* Among the 96-byte strings inside a 400-byte window the one with
   the least hash is the window's anchor; it depends on the window's bytes only,
   so equal windows have equal anchors at equal offsets. A text has about one
   anchor per 150 bytes.
2. *Equal surroundings.* An anchor's surroundings are the bytes that any window
   with this anchor can reach. Surroundings that occur twice are repeated as a
   whole: settled, with a combined count and a join that adaptive execution can
   split.
3. *Shards.* What remains are anchors that occur with different surroundings.
   Windows are dealt by the anchor's offset in them into a few bands; all windows
   of a band share a core. Cores that occur once can hold no repeat. The pieces
   of text round the others are dealt by core to shards, and each shard's suffixes are sorted
   with common-prefix values by induced sorting (``induced``), whose queues lie
   and arrays lie on disk, so a shard may be far larger than memory. Neighbours
   with a common prefix of 400 are the repeats.
4. *Hot cores.* A core with over ``HOT_PIECES`` pieces would be one task's shard.
   Its bands are cut in two, so its pieces part by longer cores; halves that are
   equal as a whole are settled by a count as in 2. What is still hot is
   cut again, down to single windows, which a count settles.

Matches never cross a text: pieces are cut at its ends, and a separator that
stands for no byte keeps a common prefix inside its piece.

Nulls: a null text is empty. A null doc_id is a value like others. Rows that
repeat doc_id and text count as different documents (each makes the other a
repeat). Texts under 400 bytes are kept whole. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarmill.llm.dealing import dealt_join
from sonarmill.llm.induced import Sorter
from sonarmill.llm.textnum import _BYTE_CODE, _powers, buffers_of, mix64
from sonarmill.session import cut

WINDOW = 400
GRAM = 96
BANDS = 2
PIECE_SLAB = 1 << 22
SHARD_BYTES = 2 << 20
HOT_PIECES = 30_000  # of one core; more are split by longer cores

_POSITION_BITS = 24
_CHUNK = 1 << 20


def anchors_of(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Places and hashes of the anchors of one text, and the first and last start of a window with each."""
    places, hashes, first, last = [], [], [], []
    width = window - gram + 1
    for at in range(0, max(1, len(data) - window + 1), _CHUNK):
        part = data[at : at + _CHUNK + window - 1]
        if len(part) < window:
            break
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[part] * up[: len(part)], out=total[1:])
        h = mix64((total[gram:] - total[:-gram]) * down[: len(part) - gram + 1])
        key = (h >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | np.arange(len(h), dtype=np.uint64)
        n_windows = len(part) - window + 1
        rows = -(-len(key) // width)
        padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        grid = padded.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n_windows], ahead[width - 1 : width - 1 + n_windows])
        starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        where = (least[starts] & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        places.append(where + at)
        hashes.append(h[where])
        first.append(starts + at)
        last.append(np.append(starts[1:] - 1, n_windows - 1) + at)
    if not places:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    place, h, lo, hi = map(np.concatenate, (places, hashes, first, last))
    new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))  # a run may go on in the next chunk
    return place[new], h[new], lo[new], hi[np.append(new[1:] - 1, len(place) - 1)]


ANCHOR_SCHEMA = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("place", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("h", pa.int64()), ("c", pa.int64())])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = buffers_of(batch.column(2))
        ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
        parts, rows = [], 0
        for k in range(batch.num_rows):
            data = raw[off[k] : off[k + 1]]
            if len(data) < WINDOW:
                continue
            place, h, lo, hi = anchors_of(data)
            view = memoryview(data)
            around = [xxhash.xxh3_64_intdigest(view[a : b + WINDOW], seed=p - a) for p, a, b in zip(place.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            parts.append((np.full(len(place), ids[0][k]), np.full(len(place), ids[1][k]), place, lo, hi, h.view(np.int64), np.array(around, np.uint64).view(np.int64)))
            rows += len(place)
            if rows > 50_000:
                yield _columns(parts)
                parts, rows = [], 0
        if parts:
            yield _columns(parts)


def _columns(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], schema=ANCHOR_SCHEMA)


def _bands() -> list[tuple[int, int]]:
    """Ranges of the anchor's offset in a window."""
    edges = [round(k * (WINDOW - GRAM + 1) / BANDS) for k in range(BANDS + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


PIECE_SCHEMA = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("key", pa.int64()), ("need", pa.bool_()), ("start", pa.int64()), ("lead", pa.int64()), ("o1", pa.int64()), ("o2", pa.int64()), ("piece", pa.binary())])
PIECE_DDL = "d long, th long, key long, need boolean, start long, lead long, o1 long, o2 long, piece binary"
HALF_SCHEMA = PIECE_SCHEMA.append(pa.field("hull", pa.int64()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, its open anchors) to a row for each band in which windows have the anchor.

    If any window of a band has the anchor, the band's core lies inside the
    text, so equal windows have equal cores, near a text's ends too.
    """
    for batch in batches:
        raw, off = buffers_of(batch.column(2))
        rows, size = [], 0
        for k in range(batch.num_rows):
            data = raw[off[k] : off[k + 1]].tobytes()
            d, th = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            for item in batch.column(3)[k].as_py():
                p = item["place"]
                for j, (a, b) in enumerate(_bands()):
                    start, stop = max(item["lo"], p - b + 1), min(item["hi"], p - a) + WINDOW
                    if stop - start < WINDOW:
                        continue
                    key = xxhash.xxh3_64_intdigest(data[p - a : p - b + 1 + WINDOW], seed=j) - (1 << 63)
                    rows.append((d, th, key, item["need"], start, p - start, a, b, data[start:stop]))
                    size += stop - start
            if size > PIECE_SLAB:
                yield _rows(rows, PIECE_SCHEMA)
                rows, size = [], 0
        if rows:
            yield _rows(rows, PIECE_SCHEMA)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's band cut in two, with longer cores; ``hull`` tells all windows of the half band."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            lead, piece = r["lead"], r["piece"]
            middle = (r["o1"] + r["o2"]) // 2
            for x, y in ((r["o1"], middle), (middle, r["o2"])):
                lo, hi = max(0, lead - y + 1), min(len(piece) - WINDOW, lead - x)
                if x == y or lo > hi:
                    continue
                key = xxhash.xxh3_64_intdigest(piece[lead - x : lead - y + 1 + WINDOW], seed=x << 16 | y) - (1 << 63)
                part = piece[lo : hi + WINDOW]
                hull = xxhash.xxh3_64_intdigest(part, seed=lead - lo) - (1 << 63)
                rows.append((r["d"], r["th"], key, r["need"], r["start"] + lo, lead - lo, x, y, part, hull))
        if rows:
            yield _rows(rows, HALF_SCHEMA)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


SPAN_SCHEMA = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


PIECE = np.dtype([("at", np.int64), ("size", np.int64), ("d", np.int64), ("th", np.int64), ("start", np.int64), ("need", np.bool_)])
SPAN_ROWS = 50_000


class _Shard:
    """Pieces gathered in files of the task's scratch folder, then sorted. Memory holds chunks only."""

    def __init__(self) -> None:
        self.text, self.meta = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        self.symbols = self.pieces = 0

    def add(self, d, th, need, start, piece: bytes) -> None:
        symbols = np.frombuffer(piece + b"\0", np.uint8).astype(np.uint16) + 2
        symbols[-1] = 1  # stands for no byte
        symbols.tofile(self.text)
        np.array([(self.symbols, len(piece), d, th, start, need)], PIECE).tofile(self.meta)
        self.symbols += len(symbols)
        self.pieces += 1

    def spans(self) -> Iterator[pa.RecordBatch]:
        if self.pieces < 2:
            return
        self.text.flush()
        self.meta.flush()
        text = np.memmap(self.text, np.uint16, "r", shape=(self.symbols,))
        meta = np.memmap(self.meta, PIECE, "r", shape=(self.pieces,))
        with Sorter(WINDOW) as sorter:
            repeated = sorter.mapped(np.uint8, self.symbols)
            last = 0
            for places, lcp in sorter.sort(text):
                hit = lcp >= WINDOW
                for at in (places[hit], np.append(last, places[:-1])[hit]):
                    repeated.put(at, np.ones(len(at), np.uint8))
                last = int(places[-1])
            for a in range(0, self.pieces, SPAN_ROWS):
                part = np.array(meta[a : a + SPAN_ROWS])
                rows = self._spans_of(part, repeated.part(int(part["at"][0]), int(part["at"][-1] + part["size"][-1]) + 1))
                if rows:
                    yield _rows(rows, SPAN_SCHEMA)

    @staticmethod
    def _spans_of(part: np.ndarray, repeated: np.ndarray) -> list[tuple]:
        """Runs of repeated windows in some consecutive pieces."""
        at = part["at"] - part["at"][0]
        starts = np.flatnonzero(repeated)
        piece = np.searchsorted(at, starts, "right") - 1
        whole = (starts + WINDOW <= at[piece] + part["size"][piece]) & part["need"][piece]  # others run into a separator
        starts, piece = starts[whole], piece[whole]
        if not len(starts):
            return []
        new = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (starts[1:] != starts[:-1] + 1)))
        last = np.append(new[1:] - 1, len(starts) - 1)
        of = part[piece[new]]
        begin = of["start"] - at[piece[new]]
        return list(zip(of["d"].tolist(), of["th"].tolist(), (begin + starts[new]).tolist(), (begin + starts[last] + WINDOW).tolist(), strict=True))


def _shard_spans(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = _Shard(), None
        for batch in batches:
            for row in batch.to_pylist():
                if shard.symbols > shard_bytes and row["key"] != before:
                    yield from shard.spans()
                    shard = _Shard()
                before = row["key"]
                shard.add(row["d"], row["th"], row["need"], row["start"], row["piece"])
        yield from shard.spans()

    return run


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of the union of [start, stop)."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = buffers_of(batch.column(1))
        rows = []
        for k in range(batch.num_rows):
            data = raw[off[k] : off[k + 1]]
            runs = merged([(x["start"], x["stop"]) for x in batch.column(2)[k].as_py() or []])
            sha, at = hashlib.sha256(), 0
            for a, b in [*runs, [len(data), len(data)]]:
                sha.update(data[at:a])
                at = b
            rows.append((batch.column(0)[k].as_py(), len(data), sum(b - a for a, b in runs), len(runs), sha.hexdigest(), [{"start": a, "stop": b} for a, b in runs]))
        if rows:
            yield _rows(rows, RESULT_SCHEMA)


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte runs of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    base = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("th"), text.cast("binary").alias("data"))
    anchors = cut(base.where(F.octet_length("data") >= WINDOW).select("d", "th", "data").mapInArrow(_anchor_rows, "d long, th long, place long, lo long, hi long, h long, c long"), "anchors")
    around = cut(anchors.groupBy("h", "c").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("d", "th", "place", "lo", "hi")]), "around")
    again = around.where("n > 1").select("h", "c", "n")
    settled = dealt_join(anchors, again, ["h", "c"], anchors.count(), ["d", "place"]).select("d", "th", F.col("lo").alias("start"), (F.col("hi") + WINDOW).alias("stop"))

    wanting = around.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("h", F.col("k").alias("n"))
    members = dealt_join(around.withColumnRenamed("n", "times"), wanting, ["h"], around.count(), ["d", "place"]).select("d", "th", F.struct("place", "lo", "hi", (F.col("times") == 1).alias("need")).alias("a"))
    of_text = members.groupBy("d", "th").agg(F.collect_list("a").alias("a"))
    once = base.select("d", "th", "data").join(of_text, ["d", "th"])
    pieces = cut(once.select("d", "th", "data", "a").mapInArrow(_pieces, PIECE_DDL), "pieces")
    found = settled
    while True:
        cores = cut(pieces.groupBy("key").agg(F.count("*").alias("n"), F.max("need").alias("any")).where("n > 1 and any").select("key", "n"), "cores")
        dealt = pieces.join(cores.where(F.col("n") <= hot_pieces), "key", "left_semi").select("key", "d", "th", "need", "start", "piece").repartition("key").sortWithinPartitions("key", "d", "start")
        found = found.union(dealt.mapInArrow(_shard_spans(shard_bytes), "d long, th long, start long, stop long"))
        hot = cores.where(F.col("n") > hot_pieces)
        if hot.isEmpty():
            break
        halves = cut(dealt_join(pieces, hot, ["key"], pieces.count(), ["d", "start"]).select(*PIECE_SCHEMA.names).mapInArrow(_halves, PIECE_DDL + ", hull long"), "halves")
        groups = cut(halves.groupBy("key", "hull").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("d", "th", "need", "start", "lead", "o1", "o2", "piece")]), "groups")
        again = dealt_join(halves.where("need"), groups.where("n > 1").select("key", "hull", "n"), ["key", "hull"], halves.count(), ["d", "start"])
        found = found.union(again.select("d", "th", "start", (F.col("start") + F.octet_length("piece")).alias("stop")))
        # A band of one offset has one window, so its count has settled it.
        pieces = groups.where("o2 - o1 > 1").withColumn("need", F.col("need") & (F.col("n") == 1)).select(*PIECE_SCHEMA.names)

    spans = cut(found.distinct(), "spans").groupBy("d", "th").agg(F.collect_list(F.struct("start", "stop")).alias("s"))
    rows = base.join(spans, ["d", "th"], "left").select("doc_id", "data", "s")
    return rows.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, stop: long>>")


def op3_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")
