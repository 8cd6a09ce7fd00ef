"""The registered queries over the supplied tables and their SQL.

The tables hold no audio. A document's payload is the 16 bytes of its text's
MD5, an embedding is a frame of PCM, ``events`` are packets of one stream a user.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarmill.functions import analysis, entropy, lpc, packet, signal, transform
from sonarmill.functions.framing import parsed
from sonarmill.operators import streams
from sonarmill.plans.registry import ORACLE_SQL, QUERIES, query
from sonarmill.sources import container

def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.unhex(F.md5("text")).alias("data"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets: a stream a user, numbered in order of time, with a level and a length in 48 kHz samples."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    return rows.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("samples", (F.pmod("event_id", F.lit(4)) + 1).cast("long") * 240)


#: CTEs that state the same inputs in SQL.
_CONFIG_ROWS = """(0, 'speech', 'narrow', 100, 8000, 4000, 480), (1, 'speech', 'narrow', 200, 8000, 4000, 960), (2, 'speech', 'narrow', 400, 8000, 4000, 1920), (3, 'speech', 'narrow', 600, 8000, 4000, 2880),
(4, 'speech', 'medium', 100, 12000, 6000, 480), (5, 'speech', 'medium', 200, 12000, 6000, 960), (6, 'speech', 'medium', 400, 12000, 6000, 1920), (7, 'speech', 'medium', 600, 12000, 6000, 2880),
(8, 'speech', 'wide', 100, 16000, 8000, 480), (9, 'speech', 'wide', 200, 16000, 8000, 960), (10, 'speech', 'wide', 400, 16000, 8000, 1920), (11, 'speech', 'wide', 600, 16000, 8000, 2880),
(12, 'hybrid', 'superwide', 100, 24000, 12000, 480), (13, 'hybrid', 'superwide', 200, 24000, 12000, 960),
(14, 'hybrid', 'full', 100, 48000, 20000, 480), (15, 'hybrid', 'full', 200, 48000, 20000, 960),
(16, 'transform', 'narrow', 25, 8000, 4000, 120), (17, 'transform', 'narrow', 50, 8000, 4000, 240), (18, 'transform', 'narrow', 100, 8000, 4000, 480), (19, 'transform', 'narrow', 200, 8000, 4000, 960),
(20, 'transform', 'wide', 25, 16000, 8000, 120), (21, 'transform', 'wide', 50, 16000, 8000, 240), (22, 'transform', 'wide', 100, 16000, 8000, 480), (23, 'transform', 'wide', 200, 16000, 8000, 960),
(24, 'transform', 'superwide', 25, 24000, 12000, 120), (25, 'transform', 'superwide', 50, 24000, 12000, 240), (26, 'transform', 'superwide', 100, 24000, 12000, 480), (27, 'transform', 'superwide', 200, 24000, 12000, 960),
(28, 'transform', 'full', 25, 48000, 20000, 120), (29, 'transform', 'full', 50, 48000, 20000, 240), (30, 'transform', 'full', 100, 48000, 20000, 480), (31, 'transform', 'full', 200, 48000, 20000, 960)"""
PAYLOADS = f"""dim(config, mode, bandwidth, tenth_ms, sample_rate_hz, audio_hz, frame_samples) as (values {_CONFIG_ROWS}),
raw as (select doc_id, md5(text) as hx from documents),
p as (select doc_id, hx, ('0x' || substr(hx, 1, 2))::int as header, ('0x' || substr(hx, 3, 2))::int as second from raw),
h as (select p.*, header >> 3 as config, (header >> 2) & 1 as stereo, header & 3 as code, second & 63 as cnt,
  dim.mode, dim.bandwidth, dim.tenth_ms, dim.sample_rate_hz, dim.audio_hz, dim.frame_samples,
  case header & 3 when 0 then 1 when 3 then second & 63 else 2 end as n_frames
  from p join dim on dim.config = p.header >> 3)"""
EVENTS = """ev as (select event_id, ts, user_id, event_type, value, row_number() over (partition by user_id order by ts, event_id) as seq,
  (event_id % 4 + 1) * 240 as samples from events)"""
FRAMES = "f as (select vec_id, label, list_transform(embedding, lambda v: v::double) as x from embeddings)"
_ERROR = """case when code = 1 then 'code1_uneven'
  when code = 3 and (cnt = 0 or cnt * tenth_ms > 1200) then 'bad_frame_count'
  when code = 3 and (second & 192) = 0 and 14 % greatest(cnt, 1) <> 0 then 'cbr_uneven' end"""


@query(f"with {PAYLOADS} select mode, code, count(*) as n, sum(coalesce(tenth_ms * n_frames, 0) * 100)::bigint as audio_us from h group by mode, code")
def header_mode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets and audio time for each mode and frame-count code: headers, durations, one aggregate."""
    data = F.col("data")
    h = packet.header_byte(data)
    rows = _payloads(spark, sf_dir).select(packet.mode(h).alias("mode"), packet.frame_code(h).alias("code"), packet.packet_duration(data).alias("us"))
    return rows.groupBy("mode", "code").agg(F.count("*").alias("n"), F.sum(F.coalesce("us", F.lit(0))).cast("long").alias("audio_us"))


@query(f"with {PAYLOADS} select doc_id, header, config, stereo = 1 as stereo, 1 + stereo as channels, code, mode, bandwidth, tenth_ms, sample_rate_hz, audio_hz, frame_samples from h")
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All header fields; modes and sizes from the 32-row dimension, which is small by construction."""
    h = packet.header_byte(F.col("data"))
    rows = _payloads(spark, sf_dir).select("doc_id", h.alias("header"))
    h = F.col("header")
    rows = rows.select("doc_id", "header", packet.config(h).alias("config"), packet.is_stereo(h).alias("stereo"), packet.channels(h).alias("channels"), packet.frame_code(h).alias("code"))
    dim = packet.header_table(spark).withColumnRenamed("frame_samples_48k", "frame_samples")
    return rows.join(F.broadcast(dim), "config")


@query(f"with {PAYLOADS} select doc_id, mode, bandwidth, tenth_ms, frame_samples, count(*) over (partition by mode, bandwidth, tenth_ms) as alike from h")
def header_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields as Columns, and how many packets share them."""
    h = packet.header_byte(F.col("data"))
    rows = _payloads(spark, sf_dir).select("doc_id", packet.mode(h).alias("mode"), packet.bandwidth(h).alias("bandwidth"), packet.tenth_ms(h).alias("tenth_ms"), packet.frame_samples(h).alias("frame_samples"))
    alike = rows.groupBy("mode", "bandwidth", "tenth_ms").agg(F.count("*").alias("alike"))
    return rows.join(alike, ["mode", "bandwidth", "tenth_ms"])


@query(f"with {PAYLOADS} select doc_id, header as rebuilt, (config << 3) | (stereo << 2) | code = header as same from h")
def header_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = packet.header_byte(F.col("data"))
    rebuilt = packet.make_header(packet.config(h), packet.is_stereo(h), packet.frame_code(h))
    return _payloads(spark, sf_dir).select("doc_id", rebuilt.alias("rebuilt"), (rebuilt == h).alias("same"))


@query(f"with {PAYLOADS} select doc_id, n_frames, (frame_samples * n_frames)::bigint as samples, (tenth_ms * n_frames)::bigint * 100 as us from h")
def packet_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("data")
    return _payloads(spark, sf_dir).select("doc_id", packet.frame_count(d).alias("n_frames"), packet.packet_samples(d).alias("samples"), packet.packet_duration(d).alias("us"))


@query(f"with {PAYLOADS} select doc_id, {_ERROR} as error from h")
def packet_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir).select("doc_id", packet.cheap_error(F.col("data")).alias("error"))


@query(f"with {PAYLOADS} select coalesce({_ERROR}, 'none') as error, count(*) as n, count(distinct config) as configs from h group by 1")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("data")
    rows = _payloads(spark, sf_dir).select(F.coalesce(packet.cheap_error(d), F.lit("none")).alias("error"), packet.config(packet.header_byte(d)).alias("config"))
    return rows.groupBy("error").agg(F.count("*").alias("n"), F.countDistinct("config").alias("configs"))


_EQUAL = f"""{PAYLOADS}, ok as (select *, case when code = 3 then 2 else 1 end as skip from h where ({_ERROR}) is null and (code < 2 or (code = 3 and (second & 192) = 0))),
fr as (select doc_id, unnest(range(n_frames)) as frame_no, (16 - skip) // n_frames as size, skip, hx from ok)"""


@query(f"with {_EQUAL} select doc_id, frame_no::int as frame_no, size::int as size, substr(hx, (2 * (skip + frame_no * size) + 1)::int, (2 * size)::int) as frame_hex from fr")
def frames_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of equal size split by Columns and exploded, no Python."""
    rows = _payloads(spark, sf_dir).select("doc_id", F.posexplode(packet.equal_frames(F.col("data"))).alias("frame_no", "frame"))
    return rows.select("doc_id", "frame_no", F.length("frame").alias("size"), F.lower(F.hex("frame")).alias("frame_hex"))


@query(
    """with recursive dim(config, tenth) as (select c, case when c < 12 then [100, 200, 400, 600][c % 4 + 1] when c < 16 then [100, 200][c % 2 + 1] else [25, 50, 100, 200][c % 4 + 1] end from (select unnest(range(32)) as c)),
bytes as (select doc_id, list_transform(range(16), lambda i: ('0x' || substr(hx, (2 * i + 1)::int, 2))::int) as b from (select doc_id, md5(text) as hx from documents)),
h as (select doc_id, b, b[1] as header, b[1] & 3 as code, tenth, b[2] & 63 as cnt, coalesce(nullif(list_position(list_transform(b[3:16], lambda x: x < 255), true), 0), 99) as p from bytes join dim on config = b[1] >> 3),
c as (select *, code = 2 or (code = 3 and b[2] >= 128) as varying, code = 3 and (b[2] & 64) > 0 as padded from h),
d as (select *, case when padded and p < 99 then 254 * (p - 1) + b[2 + p] else 0 end as padding, case when code = 3 then 2 + case when padded then p else 0 end else 1 end as at0, case code when 0 then 1 when 3 then cnt else 2 end as n from c),
e as (select *, 16 - padding as stop, case when code = 1 then 'code1_uneven' when code = 3 and (cnt = 0 or cnt * tenth > 1200) then 'bad_frame_count' when padded and (p = 99 or padding > 16 - at0) then 'bad_padding'
  when code = 3 and not varying and (16 - padding - at0) % cnt <> 0 then 'cbr_uneven' end as early from d),
r as (select doc_id, at0 as pos, 0 as k, []::int[] as sizes, false as bad from e where early is null and varying
  union all select doc_id, case when b[pos + 1] < 252 then pos + 1 else pos + 2 end, k + 1, list_append(sizes, case when b[pos + 1] < 252 then b[pos + 1] else b[pos + 1] + 4 * b[pos + 2] end),
  pos >= stop or (b[pos + 1] >= 252 and pos + 1 >= stop) from r join e using (doc_id) where k < n - 1 and not bad),
last as (select doc_id, pos, sizes, bad, stop - pos - coalesce(list_sum(sizes), 0) as rest, stop, padding from r join e using (doc_id) where bad or k = n - 1),
v as (select doc_id, case when bad or rest < 0 then 'bad_frame_length' end as error, list_append(sizes, rest::int) as sizes from last),
o as (select e.doc_id, e.header, e.padding, coalesce(e.early, v.error) as error, case when e.early is not null then null when e.varying then v.sizes else list_transform(range(n), lambda i: (stop - at0) // n) end as sizes from e left join v using (doc_id))
select doc_id, header, case when error is null then padding end::int as padding, case when error is null then 16 end::int as used, error, case when error is null then len(sizes) end::int as n, case when error is null then array_to_string(sizes, ',') end as sizes from o"""
)
def packet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames with length chains and padding, errors kept as rows."""
    rows = _payloads(spark, sf_dir).select("doc_id", parsed(F.col("data")).alias("p"))
    sizes = F.array_join(F.transform("p.frames", lambda f: F.length(f).cast("string")), ",")
    return rows.select("doc_id", "p.header", "p.padding", "p.used", "p.error", F.when(F.col("p.error").isNull(), F.size("p.frames")).alias("n"), sizes.alias("sizes"))


@query(f"with {EVENTS}, kept as (select * from ev where event_id % 7 <> 3) select event_id, user_id, seq, coalesce(seq - lag(seq) over (partition by user_id order by seq) - 1, 0)::bigint as missing from kept")
def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence gaps after every seventh packet is lost."""
    kept = _events(spark, sf_dir).where(F.pmod("event_id", F.lit(7)) != 3)
    return streams.with_gaps(kept, ["user_id"], "seq").select("event_id", "user_id", "seq", "missing")


@query(f"with {EVENTS} select event_id, user_id, (312 + sum(samples) over (partition by user_id order by seq))::bigint as end_pos_48k from ev")
def granule_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.running_position(_events(spark, sf_dir), ["user_id"], "seq", F.col("samples"), 312).select("event_id", "user_id", "end_pos_48k")


@query(
    f"""with {EVENTS}, pos as (select *, (312 + sum(samples) over (partition by user_id order by seq))::bigint as fwd from ev),
g as (select *, case when seq % 5 = 0 then fwd end as granule, sum(samples) over (partition by user_id order by seq) as upto from pos),
w as (select *, first_value(granule ignore nulls) over (partition by user_id order by seq rows between current row and unbounded following) as anchor,
  first_value(case when granule is not null then upto end ignore nulls) over (partition by user_id order by seq rows between current row and unbounded following) as upto_anchor,
  last_value(granule ignore nulls) over (partition by user_id order by seq rows between unbounded preceding and current row) as known,
  last_value(case when granule is not null then upto end ignore nulls) over (partition by user_id order by seq rows between unbounded preceding and current row) as upto_known from g)
select event_id, user_id, seq, (case when anchor is not null then greatest(anchor - (upto_anchor - upto), 0) else coalesce(known, 0) + upto - coalesce(upto_known, 0) end)::bigint as end_pos_48k from w"""
)
def granule_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions resolved backward from every fifth packet's granule, forward at the tail."""
    rows = streams.running_position(_events(spark, sf_dir), ["user_id"], "seq", F.col("samples"), 312)
    rows = rows.withColumn("granule", F.when(F.col("seq") % 5 == 0, F.col("end_pos_48k"))).drop("end_pos_48k")
    return container.positions_from(rows, ["user_id"], "seq", "granule", "samples").select("event_id", "user_id", "seq", F.col("end_pos_48k").cast("long").alias("end_pos_48k"))


@query(f"with {FRAMES} select vec_id, round(list_reduce(list_transform(list_slice(x, 9, 56), lambda v: v * pow(10.0, -256 / 5120.0)), lambda a, b: a + b, 0.0), 6) as total, len(list_slice(x, 9, 56)) as n from f")
def pre_skip_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 samples skipped, 48 kept, output gain of -1 dB."""
    x = signal.gain(signal.trimmed(F.col("x"), F.lit(8), F.lit(48)), F.lit(-256.0))
    return _frames(spark, sf_dir).select("vec_id", F.round(signal.total(x), 6).alias("total"), F.size(x).cast("long").alias("n"))


@query(
    """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events),
i as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as island from e)
select user_id, min(ts) as start_ts, max(ts) as last_ts, count(*) as n from i group by user_id, island"""
)
def talk_spurts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows with a gap of 30 minutes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    found = streams.spurts(events, ["user_id"], "t")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start_ts"), (F.col("end") - F.expr("interval 30 minutes")).cast("timestamp_ntz").alias("last_ts"), "n")


@query(
    f"""with {EVENTS}, a as (select *, value > 20 as active from ev), r as (select *, sum(active::int) over (partition by user_id order by seq) as run from a),
q as (select *, row_number() over (partition by user_id, run, active order by seq) - 3 as place from r)
select event_id, user_id, seq, active, (not active and place >= 0 and place % 6 < 5) as suppressed from q"""
)
def suppression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 80 ms: two sent, five suppressed, one refresh, and so on."""
    rows = _events(spark, sf_dir).withColumn("active", F.col("value") > 20)
    return streams.suppression(rows, ["user_id"], "seq", F.col("active"), frame_ms=80).select("event_id", "user_id", "seq", "active", "suppressed")


@query(f"with {EVENTS}, n as (select *, lead(event_id) over (partition by user_id order by seq) as nxt from ev) select event_id, user_id, (seq % 10 = 7) as lost, case when seq % 10 = 7 then nxt end as recover_from from n")
def recovery_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lost packet with the one that carries its copy."""
    rows = _events(spark, sf_dir).withColumn("lost", streams.simulated_loss(F.col("seq")))
    return streams.with_recovery(rows, ["user_id"], "seq", "event_id", F.col("lost")).select("event_id", "user_id", "lost", "recover_from")


_LAG = "list_reduce(list_transform(range({k} + 1, len(x) + 1), lambda i: x[i] * x[i - {k}]), lambda a, b: a + b, 0.0)"


@query(f"with {FRAMES} select vec_id, round(list_reduce(list_transform(x, lambda v: v * v), lambda a, b: a + b, 0.0) / len(x), 9) as energy, round({_LAG.format(k=1)}, 9) as r1, round({_LAG.format(k=2)}, 9) as r2, round({_LAG.format(k=3)}, 9) as r3 from f")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    rows = _frames(spark, sf_dir).select("vec_id", signal.energy(x).alias("energy"), signal.autocorrelation(x, 3).alias("r"))
    return rows.select("vec_id", F.round("energy", 9).alias("energy"), *[F.round(F.col("r")[k], 9).alias(f"r{k}") for k in (1, 2, 3)])


@query(
    f"""with {FRAMES} select vec_id, len(list_filter(range(2, len(x) + 1), lambda i: (x[i] >= 0) <> (x[i - 1] >= 0)))::int as crossings,
round(greatest(-1.0, least(1.0, {_LAG.format(k=1)} / list_reduce(list_transform(list_slice(x, 2, len(x)), lambda v: v * v), lambda a, b: a + b, 0.0))), 9) as tilt from f"""
)
def crossings_and_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _frames(spark, sf_dir).select("vec_id", signal.zero_crossings(x).alias("crossings"), F.round(signal.lag1_correlation(x), 9).alias("tilt"))


_NORM = """case when list_reduce(list_transform(list_slice(x, 1, len(x) - k), lambda v: v * v), lambda a, b: a + b, 0.0) > 0 then
 list_reduce(list_transform(range(k + 1, len(x) + 1), lambda i: x[i] * x[i - k]), lambda a, b: a + b, 0.0)
 / sqrt(list_reduce(list_transform(list_slice(x, 1, len(x) - k), lambda v: v * v), lambda a, b: a + b, 0.0)) else 0.0 end"""
_SCORED = f"{FRAMES}, l as (select vec_id, x, unnest(range(8, 41))::int as k from f), s as (select vec_id, k, round({_NORM}, 9) as c from l)"


@query(f"with {_SCORED}, t as (select vec_id, k, c, row_number() over (partition by vec_id order by c desc, k) as place from s) select vec_id, k as lag, c as score, place from t where place <= 3")
def top_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best lags of each frame."""
    rows = _frames(spark, sf_dir).select("vec_id", "x", F.explode(F.sequence(F.lit(8), F.lit(40))).alias("lag"))
    rows = rows.select("vec_id", "lag", F.round(signal.normalised_lag(F.col("x"), F.col("lag")), 9).alias("score"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "lag")).cast("long")).where("place <= 3")


@query(f"with {_SCORED.replace('round(' + _NORM + ', 9)', _NORM)}, t as (select vec_id, k, row_number() over (partition by vec_id order by c desc, k) as place from s) select vec_id, k as lag from t where place = 1")
def pitch_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("vec_id", signal.pitch_lag(F.col("x"), 8, 40).alias("lag"))


@query(f"with {FRAMES}, r as (select vec_id, list_transform(range(1, len(x) + 1), lambda i: x[i] - case when i > 5 then 0.5 * x[i - 5] else 0.0 end) as e from f) select vec_id, round(list_reduce(list_transform(e, lambda v: v * v), lambda a, b: a + b, 0.0), 9) as energy, round(e[64], 9) as last from r")
def long_term_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = signal.ltp_residual(F.col("x"), 5, 0.5)
    rows = _frames(spark, sf_dir).select("vec_id", e.alias("e"))
    return rows.select("vec_id", F.round(signal.dot(F.col("e"), F.col("e")), 9).alias("energy"), F.round(F.element_at("e", 64), 9).alias("last"))


@query(f"with {FRAMES} select vec_id, list_transform(x, lambda v: round_even(greatest(-32768.0, least(32767.0, v * 32768.0)), 0)::int)::varchar as pcm from f")
def pcm_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("vec_id", F.concat(F.lit("["), F.array_join(signal.to_int16(F.col("x")).cast("array<string>"), ", "), F.lit("]")).alias("pcm"))


@query(f"with {FRAMES}, m as (select vec_id, list_transform(range(1, 33), lambda i: (x[2 * i - 1] + x[2 * i]) * 0.5) as y from f) select vec_id, len(y) as n, round(list_reduce(list_transform(y, lambda v: v * v), lambda a, b: a + b, 0.0), 9) as energy from m")
def stereo_downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _frames(spark, sf_dir).select("vec_id", signal.downmix(F.col("x")).alias("y"))
    return rows.select("vec_id", F.size("y").cast("long").alias("n"), F.round(signal.dot(F.col("y"), F.col("y")), 9).alias("energy"))


_POLE = analysis.pole(4000.0)


@query(f"with {FRAMES} select vec_id, round(list_reduce(x, lambda y, v: y + {_POLE!r} * (v - y), 0.0), 9) as last from f")
def one_pole_lowpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a 4 kHz one-pole low-pass ends."""
    return _frames(spark, sf_dir).select("vec_id", F.round(F.element_at(signal.one_pole(F.col("x"), _POLE), -1), 9).alias("last"))


_YS = ", ".join(f"list_transform(range(1, len(x) + 1), lambda i: list_reduce(list_slice(x, 1, i), lambda y, v: y + {analysis.pole(f)!r} * (v - y), 0.0)) as y{k}" for k, f in enumerate(analysis.EDGES))
_SUMSQ = "list_reduce(list_transform({0}, lambda v: v * v), lambda a, b: a + b, 0.0) / len(x)"


@query(
    f"""with {FRAMES}, ys as (select vec_id, x, {_YS} from f),
e as (select vec_id, x, greatest({_SUMSQ.format("x")}, 1e-12) as e, {_SUMSQ.format("y0")} as b0, {_SUMSQ.format("y1")} as c1, {_SUMSQ.format("y2")} as c2, {_SUMSQ.format("y3")} as c3 from ys),
b as (select *, b0 / e as s0, greatest(c1 - b0, 0.0) / e as s1, greatest(c2 - c1, 0.0) / e as s2, greatest(c3 - c2, 0.0) / e as s3, greatest(e - c3, 0.0) / e as s4,
  len(list_filter(range(2, len(x) + 1), lambda i: (x[i] >= 0) <> (x[i - 1] >= 0))) / len(x) as zcr,
  greatest(-1.0, least(1.0, {_LAG.format(k=1)} / list_reduce(list_transform(list_slice(x, 2, len(x)), lambda v: v * v), lambda a, b: a + b, 0.0))) as tilt from e)
select vec_id, round(e, 9) as energy,
  round(greatest(0.0, least(1.0, 0.5 + 1.6 * (s3 + s4) + 2.0 * s4 - 0.5 * s0 - case when tilt > 0.9 and zcr < 0.1 and s3 + s4 < 0.05 then 0.2 else 0.0 end + case when zcr > 0.25 and s3 + s4 > 0.1 then 0.2 else 0.0 end)), 6) as music,
  case when s4 > 0.02 then 'full' when s3 > 0.02 then 'superwide' when s2 > 0.02 then 'wide' when s1 > 0.02 then 'medium' else 'narrow' end as bandwidth from b"""
)
def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy, music score and bandwidth of each frame."""
    rows = _frames(spark, sf_dir).select("vec_id", analysis.features(F.col("x")).alias("a"))
    return rows.select("vec_id", F.round("a.energy", 9).alias("energy"), F.round("a.music", 6).alias("music"), F.col("a.bandwidth").alias("bandwidth"))


@query(
    f"""with {EVENTS}, recursive_input as (select user_id, list(value / 100.0 order by seq) as v from ev group by user_id),
s as (select user_id, list_transform(range(1, len(v) + 1), lambda i: list_reduce(list_slice(v, 1, i), lambda m, x: m + 0.2 * (x - m), 0.5)) as sm from recursive_input)
select user_id, len(sm) as n, round(sm[len(sm)], 6) as last, round(list_reduce(sm, lambda a, b: a + b, 0.0), 4) as total from s"""
)
def smoothed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential smoothing along each stream by the shared fold."""
    rows = _events(spark, sf_dir).select("user_id", "seq", F.lit(1.0).alias("energy"), (F.col("value") / 100.0).alias("music"))
    smooth = streams.smoothed_music(rows, ["user_id"])
    return smooth.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max_by("smooth", "seq"), 6).alias("last"), F.round(F.sum("smooth"), 4).alias("total"))


@query(
    f"""with recursive {EVENTS}, e as (select user_id, seq, value * value / 1e4 as energy from ev),
f(user_id, seq, energy, floor) as (select user_id, 0::bigint, 0.0::double, 1.0::double from (select distinct user_id from e)
  union all select e.user_id, e.seq, e.energy, case when greatest(e.energy, 0.0) < f.floor then greatest(e.energy, 0.0) else f.floor * 1.0003 end from f join e on e.user_id = f.user_id and e.seq = f.seq + 1)
select user_id, count(*) as n, sum((energy > greatest(floor * 8.0, 1e-7))::int)::bigint as active from f where seq > 0 group by user_id"""
)
def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity against the adaptive noise floor, and how many frames of a stream are active."""
    rows = _events(spark, sf_dir).select("user_id", "seq", (F.col("value") * F.col("value") / 1e4).alias("energy"))
    return streams.activity(rows, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("active").cast("long")).alias("active"))


@query(
    """with c as (select label, unnest(range(1, 65)) as k, embedding from embeddings), m as (select label, k, avg(embedding[k]::double) as v from c group by label, k),
book as (select label, list(round(v, 6) order by k) as v from m group by label),
d as (select e.vec_id, b.label as code, round(list_reduce(list_transform(range(1, 65), lambda i: (e.embedding[i]::double - b.v[i]) * (e.embedding[i]::double - b.v[i])), lambda a, b: a + b, 0.0), 9) as distance from embeddings e, book b),
r as (select *, row_number() over (partition by vec_id order by distance, code) as place from d)
select vec_id, code, distance from r where place = 1"""
)
def codebook_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's nearest label centroid: a vector quantiser's search."""
    frames = _frames(spark, sf_dir)
    means = frames.select("label", F.posexplode("x").alias("k", "v")).groupBy("label", "k").agg(F.round(F.avg("v"), 6).alias("v"))
    book = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("v"))
    found = streams.nearest_code(frames, "vec_id", "x", book.withColumnRenamed("label", "code"), "code", "v")
    return found.select("vec_id", "code", F.round("distance", 9).alias("distance"))


@query(
    f"""with {EVENTS}, w as (select event_id, user_id, seq, value, list(value) over (partition by user_id order by seq rows between 2 preceding and 2 following) as v from ev)
select event_id, user_id, case when len(v) = 5 then list_sort(v)[3] end as median from w"""
)
def median_of_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("seq")
    around = [F.lag("value", 2).over(w), F.lag("value").over(w), F.col("value"), F.lead("value").over(w), F.lead("value", 2).over(w)]
    rows = _events(spark, sf_dir).select("event_id", "user_id", *[c.alias(f"v{k}") for k, c in enumerate(around)])
    five = [F.col(f"v{k}") for k in range(5)]
    whole = F.col("v0").isNotNull() & F.col("v4").isNotNull()
    return rows.select("event_id", "user_id", F.when(whole, signal.median_of(five)).alias("median"))


_SPLIT_ROWS = "(0, 12000, 0, 10000), (12000, 16000, 10000, 13500), (16000, 20000, 13500, 16000), (20000, 24000, 16000, 18000), (24000, 32000, 18000, 22000), (32000, 64000, 22000, 38000)"


@query(
    f"""with t(x0, x1, y0, y1) as (values {_SPLIT_ROWS}), r as (select event_id, (event_id * 37) % 90000 as rate, event_id % 2 = 1 as wide from events)
select r.event_id, rate::bigint as rate, (coalesce((y0 * (x1 - rate) + y1 * (rate - x0)) // (x1 - x0), 38000 + (rate - 64000) // 2) + case when wide then 300 else 0 end)::bigint as speech,
 case when rate < 11000 then 'narrow' when rate < 14000 then 'medium' when rate < 24000 then 'wide' when rate < 42000 then 'superwide' else 'full' end as band
from r left join t on rate >= x0 and rate < x1"""
)
def rate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit-rate split of the hybrid mode and the affordable bandwidth."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.pmod(F.col("event_id") * 37, F.lit(90000)).alias("rate"))
    return rows.select("event_id", "rate", analysis.speech_rate(F.col("rate"), F.col("event_id") % 2 == 1).alias("speech"), analysis.affordable_bandwidth(F.col("rate")).alias("band"))


@query(
    """with r as (select event_id, (event_id * 37) % 90000 as rate, value / 100.0 as music, ['narrow', 'medium', 'wide', 'superwide', 'full'][event_id % 5 + 1] as band from events),
s as (select *, greatest(0.0, least(1.0, music - 0.35)) as score, band in ('narrow', 'medium', 'wide') as low from r)
select event_id, case when low and rate <= 24000 then case when score > 0.7 then 'transform' else 'speech' end
 when not low and rate <= 40000 then case when score > 0.7 then 'transform' else 'hybrid' end
 when score < 0.25 then case when low then 'speech' else 'hybrid' end else 'transform' end as mode from s"""
)
def mode_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding mode from a music score, a bandwidth and a bit rate, asked for voice."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    band = F.get(F.array(*map(F.lit, packet.BANDWIDTHS)), (F.col("event_id") % 5).cast("int"))
    mode = analysis.chosen_mode(F.col("value") / 100.0, band, F.pmod(F.col("event_id") * 37, F.lit(90000)), hint="voice")
    return events.select("event_id", mode.alias("mode"))


@query(
    """with c as (select conv_id, list(role || '=' || left(text, 20) order by turn, text) as comments from conversations where role is not null and text is not null group by conv_id)
select conv_id, len(comments) as n, substr(list_filter(comments, lambda t: upper(split_part(t, '=', 1)) = 'ASSISTANT')[1], 11) as value from c"""
)
def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as comments ``role=text``: the first one of a name, whatever its case."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role is not null and text is not null")
    entry = F.struct("turn", "text", F.concat_ws("=", "role", F.left("text", F.lit(20))).alias("c"))
    comments = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["c"]).alias("comments"))
    return comments.select("conv_id", F.size("comments").cast("long").alias("n"), container.tag_value(F.col("comments"), "assistant").alias("value"))


@query(
    """with s as (select vec_id, [embedding[1:16], embedding[17:32], embedding[33:48], embedding[49:64]] as streams from embeddings),
m(ch, src) as (values (0, 3), (1, 0), (2, 255), (3, 2), (4, 1)),
r as (select vec_id, ch, case when src = 255 then list_transform(range(16), lambda i: 0.0::double) else list_transform(streams[src + 1], lambda v: v::double) end as x from s, m)
select vec_id, ch, round(list_reduce(list_transform(x, lambda v: v * v), lambda a, b: a + b, 0.0), 9) as energy, round(x[1], 9) as first from r"""
)
def channel_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four decoded streams routed to five channels; 255 is a silent one."""
    x = F.col("x")
    rows = _frames(spark, sf_dir).select("vec_id", F.array(*[F.slice(x, 16 * k + 1, 16) for k in range(4)]).alias("streams"))
    mapping = [3, 0, 255, 2, 1]
    silent = F.array_repeat(F.lit(0.0), 16)
    routed = F.array(*[silent if src == 255 else F.get("streams", F.lit(src)) for src in mapping])
    out = rows.select("vec_id", F.posexplode(routed).alias("ch", "y"))
    return out.select("vec_id", "ch", F.round(signal.dot(F.col("y"), F.col("y")), 9).alias("energy"), F.round(F.get("y", F.lit(0)), 9).alias("first"))


@query(f"with {FRAMES}, q as (select vec_id, x, list_transform(x, lambda v: round_even(v * 32768.0, 0) / 32768.0) as y from f) select vec_id, round(10 * log10(list_reduce(list_transform(x, lambda v: v * v), lambda a, b: a + b, 0.0) / list_reduce(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])), lambda a, b: a + b, 0.0)), 4) as snr from q")
def quantisation_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal-to-noise ratio of int16 rounding."""
    rows = _frames(spark, sf_dir).select("vec_id", "x", signal.from_int16(signal.to_int16(F.col("x"))).alias("y"))
    return rows.select("vec_id", F.round(signal.snr_db(F.col("x"), F.col("y")), 4).alias("snr"))


@query(f"with {EVENTS} select user_id, count(*) as packets, sum(octet_length(props::blob))::bigint as bytes, round(sum(octet_length(props::blob)) * 8 / (sum(samples) / 48000.0) / 1000, 4) as kbps from ev join events using (event_id) group by user_id".replace("select user_id, count", "select ev.user_id, count").replace("group by user_id", "group by ev.user_id"))
def bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded bytes over audio time of each stream."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select("user_id", F.octet_length("props").cast("long").alias("b"), ((F.pmod("event_id", F.lit(4)) + 1) * 240).cast("long").alias("samples"))
    out = rows.groupBy("user_id").agg(F.count("*").alias("packets"), F.sum("b").alias("bytes"), F.sum("samples").alias("s"))
    return out.select("user_id", "packets", "bytes", F.round(F.col("bytes") * 8 / (F.col("s") / 48000.0) / 1000, 4).alias("kbps"))


_LEVINSON = ", ".join(
    f"""l{m + 1} as (select vec_id, x, r, list_concat(list_transform(range(1, {m + 1}), lambda i: a[i] - k * a[{m + 1} - i]), [k]) as a, e * (1 - k * k) as e
  from (select *, (r[{m + 2}] - coalesce(list_sum(list_transform(range(1, {m + 1}), lambda i: a[i] * r[{m + 2} - i])), 0.0)) / e as k from l{m}))"""
    for m in range(8)
)


@query(
    f"""with {FRAMES}, g as (select vec_id, x, list_transform(range(0, 9), lambda l: list_sum(list_transform(range(1, 65 - l), lambda i: x[i] * x[i + l]))) as r from f),
l0 as (select vec_id, x, r, []::double[] as a, r[1] as e from g), {_LEVINSON},
s as (select vec_id, x, r, a, list_transform(range(1, 65), lambda n: x[n] - list_sum(list_transform(range(1, 9), lambda k: case when n > k then a[k] * x[n - k] else 0.0 end))) as d from l8)
select vec_id, len(a)::int as "order", round(a[1], 6) as first, round(a[8], 6) as last, round(list_sum(list_transform(d, lambda v: v * v)) / r[1], 6) as left_over, true as restored from s"""
)
def linear_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-8 predictors of each frame of 64 samples, residual energy, and whether synthesis restores the frame.

    Sums go in the order of the SQL's, so frames that magnify a last digit agree too.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", lpc.prediction(F.col("embedding"), 8, 64).alias("p"))
    return rows.select(
        "vec_id",
        F.size("p.a").alias("order"),
        signal.rounded(F.element_at("p.a", 1), 6).alias("first"),
        signal.rounded(F.element_at("p.a", 8), 6).alias("last"),
        signal.rounded(F.col("p.left_over"), 6).alias("left_over"),
        F.col("p.restored").alias("restored"),
    )


@query(
    """with t as (select conv_id, row_number() over (partition by conv_id order by turn, text) as seq, text from conversations)
select conv_id, seq, (strlen(text) + 1)::int as size, md5(text) as payload, (312 + 960 * seq)::bigint as end_pos_48k from t"""
)
def container_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as containers, scanned, reassembled and timed again; every packet must come back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    packets = turns.select("conv_id", F.row_number().over(w).cast("long").alias("seq"), F.concat(F.unhex(F.lit("FC")), F.col("text").cast("binary")).alias("data"))
    files = container.write_containers(packets, "conv_id", "seq", container.make_head(2), container.make_tags(b"sonarmill", []))
    back = container.packets_of(container.pages_of(files.select(F.col("conv_id").cast("string").alias("path"), "content"))).where("packet_no >= 2")
    timed = container.with_positions(back, ["path", "serial"], "packet_no")
    same = timed.select(F.col("path").cast("long").alias("conv_id"), (F.col("packet_no") - 1).alias("seq"), F.col("data").alias("got"), "end_pos_48k")
    return packets.join(same, ["conv_id", "seq"], "left").select("conv_id", "seq", F.length("got").alias("size"), F.md5(F.expr("substring(got, 2)")).alias("payload"), "end_pos_48k")


@query(f"with {FRAMES}, e as (select vec_id, list_transform(range(1, len(x) + 1), lambda i: x[i] - {transform.EMPHASIS!r} * case when i > 1 then x[i - 1] else 0.0 end) as y from f) select vec_id, round(list_reduce(list_transform(y, lambda v: v * v), lambda a, b: a + b, 0.0), 9) as energy, round(y[64], 9) as last from e")
def emphasised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy after the emphasis filter."""
    rows = _frames(spark, sf_dir).select("vec_id", signal.ltp_residual(F.col("x"), 1, transform.EMPHASIS).alias("y"))
    return rows.select("vec_id", F.round(signal.dot(F.col("y"), F.col("y")), 9).alias("energy"), F.round(F.element_at("y", 64), 9).alias("last"))


def _there_and_back(x: np.ndarray) -> np.ndarray:
    return transform.synthesis_frames(transform.analysis_frames(x, 16, 8), len(x), 8)


def _one_pulse(x: np.ndarray) -> np.ndarray:
    return transform.pulses(x, 1)


@query(
    f"""with {FRAMES}, m as (select vec_id, x, list_transform(x, lambda v: abs(v)) as size from f)
select vec_id, round(list_reduce(list_transform(x, lambda v: v * v), lambda a, b: a + b, 0.0), 6) as energy, round(x[20], 6) as one, list_position(size, list_max(size))::int as place, sign(x[list_position(size, list_max(size))])::double as pulse from m"""
)
def lapped_and_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames through the lapped transform and back, and as one signed pulse: it stands where the frame is largest."""
    x = F.col("x")
    rows = _frames(spark, sf_dir).select("vec_id", "x", transform.kernel(_there_and_back)(x).alias("y"), transform.kernel(_one_pulse)(x).alias("q"))
    place = F.array_position(F.transform("q", F.abs), F.lit(1.0)).cast("int")
    return rows.select("vec_id", F.round(signal.dot(F.col("y"), F.col("y")), 6).alias("energy"), F.round(F.element_at("y", 20), 6).alias("one"), place.alias("place"), F.element_at("q", place).alias("pulse"))


@query()
def voice_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice activity of each label's frames in order, summed up."""
    rows = _frames(spark, sf_dir).select("label", F.col("vec_id").alias("seq"), F.col("x").alias("pcm"))
    found = streams.voice_activity(rows, ["label"])
    return found.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("activity"), 6).alias("activity"), F.round(F.avg("tilt"), 6).alias("tilt"))


@query(f"with {FRAMES} select label, vec_id as seq, vec_id % 10 = 7 as filled, case when vec_id % 10 <> 7 then round(list_reduce(list_transform(x, lambda v: v * v), lambda a, b: a + b, 0.0), 6) end as energy, case when sum((vec_id % 10 <> 7)::int) over (partition by label order by vec_id) > 0 then 64 else 0 end::bigint as n from f where label is not null")
def loss_concealment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth frame lost and filled from the frames before it; the others are as they came."""
    rows = _frames(spark, sf_dir).where("label is not null").select("label", F.col("vec_id").alias("seq"), F.when(~streams.simulated_loss(F.col("vec_id")), F.col("x")).alias("pcm"))
    got = streams.filled(rows, ["label"])
    energy = F.when(~F.col("filled"), F.round(signal.dot(F.col("pcm"), F.col("pcm")), 6))
    return got.select("label", "seq", "filled", energy.alias("energy"), F.size("pcm").cast("long").alias("n"))


def _recode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each byte as a Laplace number, a uniform number and a bit: coded, then summed up as decoded."""
    for frame in frames:
        rows = []
        for doc_id, data in zip(frame["doc_id"], frame["data"], strict=True):
            enc = entropy.Encoder(96)
            for b in data:
                entropy.encode_laplace(enc, (b >> 4) - 8, 9000, 8000)
            for b in data:
                enc.uniform(b, 256)
                enc.bit(bool(b & 1), 1 + (b >> 5))
            dec = entropy.Decoder(enc.finish())
            numbers = [entropy.decode_laplace(dec, 9000, 8000) for _ in data]
            got, bits = [], []
            for b in data:
                got.append(dec.uniform(256))
                bits.append(dec.bit(1 + (b >> 5)))
            rows.append((doc_id, sum(numbers), bytes(got).hex(), sum(bits), enc.range == dec.range))
        yield pd.DataFrame(rows, columns=["doc_id", "numbers", "bytes", "odd", "in_step"])


@query(
    """with b as (select doc_id, md5(text) as bytes, list_transform(range(16), lambda i: ('0x' || substr(md5(text), (2 * i + 1)::int, 2))::int) as b from documents)
select doc_id, list_sum(list_transform(b, lambda v: (v >> 4) - 8))::bigint as numbers, bytes, list_sum(list_transform(b, lambda v: v & 1))::bigint as odd, true as in_step from b"""
)
def range_coder_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy coding of each payload: symbols come back and both final ranges agree."""
    return _payloads(spark, sf_dir).mapInPandas(_recode, "doc_id long, numbers long, bytes string, odd long, in_step boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_mode_counts(spark, sf_dir)


from sonarmill.plans import kernels as kernels  # noqa: E402  adds its queries to those above

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
