import random

import pytest
from pyspark.sql import functions as F

from sonarmill.sources import container as c


def _stream():
    rng = random.Random(4)
    packets = [bytes([0xFC]) + rng.randbytes(n) for n in (39, 254, 0, 1, 200_000, 509, 76)]
    return packets, c.container(packets, [960] * len(packets), c.make_head(2, 3840, 44100), c.make_tags(b"me", [b"TITLE=a", b"artist=b=c", b"Title=z"]), 7)


def _fold(pages):
    fold, out = c.Assembly(), []
    for p in pages:
        out += fold.step(vars(p) | {"page_no": 0})
    return out


@pytest.mark.parametrize(("data", "crc"), [(b"", 0), (b"\x01", 0x04C11DB7), (b"OggS", 0x5FB0A94F), (b"123456789", 0x89A1897F)])
def test_checksum(data, crc):
    assert c.checksum(data) == crc


def test_round_trip_with_spanning_and_exact_lacing():
    packets, data = _stream()
    pages = [p for _, p in c.scan(data)]
    got = _fold(pages)
    assert [g["data"] for g in got[2:]] == packets
    assert len(pages) >= 6 and pages[0].bos and pages[-1].eos
    assert got[-1]["granule"] == 3840 + 7 * 960


def test_damage_is_skipped_and_garbage_ignored():
    packets, data = _stream()
    places = [at for at, _ in c.scan(data)]
    hurt = bytearray(data)
    hurt[places[3] + 60] ^= 1
    got = _fold([p for _, p in c.scan(bytes(hurt))])
    got = [g["data"] for g in got]
    assert packets[4] not in got  # it spans the damaged page; what follows the gap is a packet of its own
    assert [p for p in packets if p in got] == [p for k, p in enumerate(packets) if k != 4]
    assert len(list(c.scan(b"x" * 1000 + data))) == len(places)
    cut = data[:-10]
    assert len(list(c.scan(cut))) == len(places) - 1


def test_truncation_can_be_searched_past():
    _, data = _stream()
    places = [at for at, _ in c.scan(data)]
    hurt = bytearray(data)
    hurt[places[2] + 26] = 255
    hurt[places[2] + 27 : places[2] + 27 + 255] = b"\xff" * 255
    hurt = bytes(hurt[: places[3] + 300])
    assert len(list(c.scan(hurt))) <= len(list(c.scan(hurt, past_truncation=True)))


def test_headers():
    assert c.parse_head(c.make_head(2, 3840, 44100))["pre_skip"] == 3840
    surround = c.make_head(6, family=1, stream_count=4, coupled_count=2, mapping=[0, 4, 1, 2, 3, 5], output_gain_q8=-256)
    assert c.parse_head(surround)["mapping"] == [0, 4, 1, 2, 3, 5]
    assert c.parse_head(surround)["output_gain_q8"] == -256
    for bad in (b"", b"OpusHead", c.make_head(1)[:18], c.HEAD_MAGIC + bytes([1, 3]) + bytes(9), c.HEAD_MAGIC + bytes([16, 1]) + bytes(9)):
        with pytest.raises(ValueError):
            c.parse_head(bad)
    for bad in (c.TAGS_MAGIC + b"\xff\xff\xff\xff", c.TAGS_MAGIC + b"\0\0\0\0\xff\xff\xff\xff", b"no"):
        with pytest.raises(ValueError, match="invalid_comment_header"):
            c.parse_tags(bad)


def test_spark_demux(spark):
    packets, data = _stream()
    files = spark.createDataFrame([("a", data), ("b", b"junk"), ("c", None)], "path string, content binary")
    pages = c.pages_of(files)
    assert [tuple(r) for r in c.first_audio_serial(pages).collect()] == [("a", 7)]
    got = c.with_positions(c.packets_of(pages), ["path", "serial"], "packet_no").orderBy("packet_no").collect()
    assert [bytes(r["data"]) for r in got][2:] == packets
    assert [r["end_pos_48k"] for r in got][2:] == [3840 + 960 * k for k in range(1, 8)]
    tags = spark.createDataFrame([(bytes(got[1]["data"]),), (b"bad",), (None,)], "d binary").select(c.tags(F.col("d")).alias("t"))
    found = tags.select("t.error", c.tag_value(F.col("t.comments"), "title").alias("title"), c.tag_value(F.col("t.comments"), "ARTIST").alias("artist")).collect()
    assert [tuple(r) for r in found] == [(None, "a", "b=c"), ("invalid_comment_header", None, None), (None, None, None)]


def test_positions_match_a_stepwise_walk(spark):
    rng = random.Random(8)
    rows, want = [], []
    for s in range(20):
        durations = [rng.choice([120, 480, 960]) for _ in range(15)]
        anchors = [rng.random() < 0.3 for _ in durations]
        total, granules = 0, []
        for d, a in zip(durations, anchors, strict=True):
            total += d
            granules.append(max(0, total - rng.randrange(300)) if a else None)
        group, last = [], 0
        for k, (d, g) in enumerate(zip(durations, granules, strict=True)):
            rows.append((s, k, d, g))
            group.append((k, d))
            if g is not None:
                pos = g
                for j, dd in reversed(group):
                    want.append((s, j, pos))
                    pos = max(0, pos - dd)
                last, group = g, []
        for j, dd in group:
            last += dd
            want.append((s, j, last))
    frame = spark.createDataFrame(rows, "s int, k int, dur long, granule long")
    got = c.positions_from(frame, ["s"], "k", "granule", "dur").select("s", "k", "end_pos_48k").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_bit_records():
    data = b"\0\0\0\2\0\0\0\7ab" + b"\0\0\0\0\0\0\0\1" + b"\0\0\0\x09\0\0\0\1cut"
    assert list(c.bit_records(data)) == [(2, 7, b"ab"), (0, 1, b"")]
