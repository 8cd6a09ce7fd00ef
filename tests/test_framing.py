import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonarmill.functions import packet
from sonarmill.functions.framing import FramingError, parsed, split, split_streams


@pytest.mark.parametrize(
    ("data", "frames", "padding"),
    [
        ("08deadbeef", ["deadbeef"], 0),
        ("e9010203040506", ["010203", "040506"], 0),
        ("08", [""], 0),
        ("ff04" + "00" * 20, ["00" * 5] * 4, 0),
        ("0afc01" + "11" * 256 + "22", ["11" * 256, "22"], 0),
        ("7b820301020304", ["010203", "04"], 0),
        ("0b4102aabb0000", ["aabb"], 2),
        ("0b41ff01" + "aa" + "00" * 255, ["aa"], 255),
    ],
)
def test_worked_examples(data, frames, padding):
    got = split(bytes.fromhex(data))
    assert [f.hex() for f in got.frames] == frames
    assert got.padding == padding


@pytest.mark.parametrize(
    ("data", "error"),
    [
        (b"", "empty"),
        (b"\x08" + bytes(1276), "frame_too_large"),
        (b"\x09\x01", "code1_uneven"),
        (b"\x0a", "bad_frame_length"),
        (b"\x0a\x05\x01", "bad_frame_length"),
        (b"\x0b\x00", "bad_frame_count"),
        (b"\x0b\x06" + bytes(72), None),
        (b"\x0b\x07" + bytes(70), "bad_frame_count"),
        (b"\x0b\x0d", "bad_frame_count"),
        (b"\x83\x31", "bad_frame_count"),
        (b"\x0b\x41\x05\x00", "bad_padding"),
        (b"\x0b\x02" + bytes(5), "cbr_uneven"),
        (b"\x0b\x83\x03", "bad_frame_length"),
    ],
)
def test_one_error_a_rule(data, error):
    if error is None:
        split(data)
        return
    with pytest.raises(FramingError) as caught:
        split(data)
    assert caught.value.args[0] == error


@given(st.binary(max_size=80))
def test_any_bytes_split_or_fail(data):
    try:
        got = split(data)
    except FramingError as error:
        assert error.args[0] in packet.ERRORS
        return
    assert got.used == len(data)
    assert sum(map(len, got.frames)) + got.padding < len(data)


def test_self_delimited_streams():
    first = bytes([0x08, 3]) + b"abc"
    got = split_streams(first + b"\x08rest", 2)
    assert [g.frames for g in got] == [[b"abc"], [b"rest"]]


def test_configurations_by_rule():
    rows = packet.configurations()
    assert len(rows) == 32
    assert rows[0] == (0, "speech", "narrow", 100)
    assert rows[11] == (11, "speech", "wide", 600)
    assert rows[15] == (15, "hybrid", "full", 200)
    assert rows[16] == (16, "transform", "narrow", 25)
    assert rows[31] == (31, "transform", "full", 200)


def test_columns_agree_with_the_splitter(spark):
    data = [bytes([h, second]) + bytes(14) for h in range(256) for second in (0, 1, 4, 14, 63, 65, 130)] + [b"", b"\x0b", None]
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(data)], "id int, data binary")
    d = F.col("data")
    got = rows.select("id", packet.cheap_error(d).alias("cheap"), packet.equal_frames(d).alias("equal"), parsed(d).alias("p")).collect()
    for r in got:
        raw = data[r["id"]]
        if raw is None:
            assert r["p"]["error"] is None and r["p"]["header"] is None
            continue
        judged = not raw or raw[0] & 3 < 2 or (raw[0] & 3 == 3 and (len(raw) < 2 or not raw[1] & 192))
        if judged:
            assert r["cheap"] == r["p"]["error"], raw.hex()
        if r["equal"] is not None:
            assert [bytes(x) for x in r["equal"]] == [bytes(x) for x in r["p"]["frames"]]
