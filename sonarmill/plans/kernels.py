"""Queries over fixed-point kernels and format dimensions, with SQL that states every constant itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarmill.functions import allocation, fixed, messages, signal
from sonarmill.functions.entropy import pulse_vectors
from sonarmill.operators import codec
from sonarmill.plans.registry import query
from sonarmill.sources import container

#: Pseudo-random 32-bit numbers a and b (b odd), shifts s from 1 to 7, of every line item.
NUMBERS = """n as (select l_orderkey as k, l_linenumber as line, (l_orderkey::bigint * 2654435761 + l_linenumber * 40503) % 4294967296 - 2147483648 as a,
  (l_partkey::bigint * 2246822519 + l_suppkey::bigint * 3266489917) % 2147483648 * 2 - 2147483647 as b, l_linenumber::bigint as s, l_suppkey::bigint as c from lineitem)"""


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key, line, part, supp = (F.col(c).cast("long") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return rows.select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("line"),
        ((key * 2654435761 + line * 40503) % 4294967296 - 2147483648).alias("a"),
        ((part * 2246822519 + supp * 3266489917) % 2147483648 * 2 - 2147483647).alias("b"),
        line.alias("s"),
        supp.alias("c"),
    )


def _wrap(x: str, half: int = 1 << 31) -> str:
    return f"(((({x}) + {half}) % {2 * half} + {2 * half}) % {2 * half} - {half})"


def _low(x: str) -> str:
    return _wrap(x, 1 << 15)


def _unsigned(x: str) -> str:
    return f"((({x}) % 4294967296 + 4294967296) % 4294967296)"


def _zeros(x: str) -> str:
    return f"(case when {_unsigned(x)} = 0 then 32 else 32 - length(bin({_unsigned(x)}::bigint)) end)::bigint"


_BL = _low("b")


@query(
    f"""with {NUMBERS} select k, line, (a * {_BL}) >> 16 as word_by_low, {_wrap(f"a + ((b * {_low('a')}) >> 16)")} as add_word_by_low,
{_wrap("a + ((a * (b >> 16)) >> 16)")} as add_word_by_high, {_low("a")} * {_BL} as low_by_low, {_wrap(f"b + {_low('a')} * {_BL}")} as add_low_by_low,
{_wrap("(a >> 16) * (b >> 16)")} as high_by_high, {_wrap("(a * b) >> 16")} as words, {_wrap("a + ((a * b) >> 16)")} as add_words,
(a * b) >> 32 as top, ({_low("a")} * {_BL} + 16384) >> 15 as fractions from n"""
)
def fixed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of 32- and 16-bit parts."""
    a, b = F.col("a"), F.col("b")
    return _numbers(spark, sf_dir).select(
        "k",
        "line",
        fixed.word_by_low(a, b).alias("word_by_low"),
        fixed.add_word_by_low(a, b, a).alias("add_word_by_low"),
        fixed.add_word_by_high(a, a, b).alias("add_word_by_high"),
        fixed.low_by_low(a, b).alias("low_by_low"),
        fixed.add_low_by_low(b, a, b).alias("add_low_by_low"),
        fixed.high_by_high(a, b).alias("high_by_high"),
        fixed.words(a, b).alias("words"),
        fixed.add_words(a, a, b).alias("add_words"),
        fixed.top_of_words(a, b).alias("top"),
        fixed.fractions(a, b).alias("fractions"),
    )


@query(
    f"""with {NUMBERS} select k, line, least(greatest(a + b, -2147483648), 2147483647) as added, least(greatest(a - b, -2147483648), 2147483647) as subtracted,
least(greatest({_low("a")} + {_BL}, -32768), 32767) as added_short, least(greatest(a, (-2147483648)::bigint >> s::int), 2147483647::bigint >> s::int) * (1::bigint << s::int) as shifted,
((a >> (s - 1)::int) + 1) >> 1 as rounded, {_unsigned(f"{_unsigned('a')} + ({_unsigned('b')} >> s::int)")} as unsigned_sum,
{_wrap(f"({_unsigned('a')} % (1::bigint << s::int)) * (1::bigint << (32 - s)::int) + ({_unsigned('a')} >> s::int)")} as turned,
{_zeros("a >> (3 * s)::int")} as zeros from n"""
)
def fixed_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturating sums and shifts, rounding shifts, rotations, leading zeros."""
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    return _numbers(spark, sf_dir).select(
        "k",
        "line",
        fixed.add_capped(a, b).alias("added"),
        fixed.subtract_capped(a, b).alias("subtracted"),
        fixed.add_capped(fixed.low(a), fixed.low(b), 16).alias("added_short"),
        fixed.left_capped(a, s).alias("shifted"),
        fixed.right_rounded(a, s).alias("rounded"),
        fixed.add_right_unsigned(a, b, s).alias("unsigned_sum"),
        fixed.rotated_right(a, s).alias("turned"),
        fixed.leading_zeros(F.call_function("shiftright", a, (s * 3).cast("int"))).alias("zeros"),
    )


# For a positive x with m bits, the seven bits behind its leading one.
_POSITIVE = "p as (select k, line, x, length(bin(x)) as m, case when length(bin(x)) > 7 then (x >> (length(bin(x)) - 8)::int) & 127 else (x << (8 - length(bin(x)))::int) & 127 end as f from (select k, line, (abs(a) >> (4 * s)::int) + 1 as x from n) where x <= 2147483647)"


@query(
    f"""with {NUMBERS}, {_POSITIVE}, y as (select *, (case when m % 2 = 1 then 32768 else 46214 end)::bigint >> ((32 - m) // 2)::int as y, x % 4200 - 100 as e from p)
select k, line, y + ((y * 213 * f) >> 16) as root, f + ((f * (128 - f) * 179) >> 16) + (m - 1) * 128 as log2,
case when e < 0 then 0 when e >= 3967 then 2147483647 when e < 2048 then (1::bigint << (e >> 7)::int) + (((1::bigint << (e >> 7)::int) * ((e & 127) + (((e & 127) * (128 - (e & 127)) * -174) >> 16))) >> 7)
  else (1::bigint << (e >> 7)::int) + ((1::bigint << (e >> 7)::int) >> 7) * ((e & 127) + (((e & 127) * (128 - (e & 127)) * -174) >> 16)) end::bigint as power2 from y"""
)
def fixed_approximations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square root, logarithm and power by short formulas."""
    s = F.col("s")
    x = F.call_function("shiftright", F.abs("a"), (s * 4).cast("int")) + 1
    rows = _numbers(spark, sf_dir).select("k", "line", x.alias("x")).where("x <= 2147483647")
    return rows.select("k", "line", fixed.root(F.col("x")).alias("root"), fixed.log2(F.col("x")).alias("log2"), fixed.power2(F.col("x") % 4200 - 100).alias("power2"))


@query(
    f"""with {NUMBERS}, h as (select *, 31 - length(bin(abs(b))) as rb, 31 - length(bin(abs(a))) as ra from n where a <> 0 and abs(a) < 2147483648),
m as (select *, b * (1::bigint << rb::int) as nb, a * (1::bigint << ra::int) as na from h),
i as (select *, (sign(nb) * floor(536870911 / abs(nb >> 16)))::bigint as inv from m),
r as (select *, {_wrap(f"{_wrap('inv * 65536')} + (({_wrap(f'(536870912 - ((nb * {_low(chr(105) + chr(110) + chr(118))}) >> 16)) * 8')} * inv) >> 16)")} as v, 61 - rb - 46 as sv, (na * {_low("inv")}) >> 16 as q0 from i),
d as (select *, {_wrap(f"q0 + (({_wrap('na - ' + _wrap('((nb * q0) >> 32) * 8'))} * {_low('inv')}) >> 16)")} as q1, 29 + ra - rb - 8 as sq from r)
select k, line, case when sv <= 0 then least(greatest(v, (-2147483648)::bigint >> greatest(-sv, 0)::int), 2147483647::bigint >> greatest(-sv, 0)::int) * (1::bigint << greatest(-sv, 0)::int) when sv < 32 then v >> greatest(sv, 0)::int else 0 end as reciprocal,
case when sq <= 0 then least(greatest(q1, (-2147483648)::bigint >> greatest(-sq, 0)::int), 2147483647::bigint >> greatest(-sq, 0)::int) * (1::bigint << greatest(-sq, 0)::int) when sq < 32 then q1 >> greatest(sq, 0)::int else 0 end as quotient from d"""
)
def fixed_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocals and quotients by one step of refinement."""
    a, b = F.col("a"), F.col("b")
    rows = _numbers(spark, sf_dir).where("a <> 0 and abs(a) < 2147483648")
    return rows.select("k", "line", fixed.reciprocal(b, F.lit(46)).alias("reciprocal"), fixed.quotient(a, b, F.lit(8)).alias("quotient"))


_FRACTION = "((({0} * {1}) + 16384) >> 15)"


@query(
    f"""with {NUMBERS}, t as (select k, line, s, c, (k * 7 + line * 131) % 16255 + 64 as x, (k * 31 + line) % 4294967296 as seed from n),
sq as (select *, (x * x + 4096) >> 13 as q, ((16384 - x) * (16384 - x) + 4096) >> 13 as r from t),
cs as (select *, 1 + 32767 - q + {_FRACTION.format("q", f"(-7651 + {_FRACTION.format('q', '(8277 + ' + _FRACTION.format('-626', 'q') + ')')})")} as cosine,
  1 + 32767 - r + {_FRACTION.format("r", f"(-7651 + {_FRACTION.format('r', '(8277 + ' + _FRACTION.format('-626', 'r') + ')')})")} as sine from sq),
ln as (select *, length(bin(sine)) as ls, length(bin(cosine)) as lc from cs), sh as (select *, sine << (15 - ls)::int as s1, cosine << (15 - lc)::int as c1 from ln),
st as (select *, 2 * (c % 30 + 2) - 1 - (case when s % 2 = 0 and c % 30 + 2 = 2 then 1 else 0 end) as fr from sh),
qb as (select *, least(x % 700 - 40 - 32, floor((x % 700 + fr * 20) / fr)::bigint, 64) as share from st)
select k, line, cosine, (ls - lc) * 2048 + {_FRACTION.format("s1", f"({_FRACTION.format('s1', '-2597')} + 7932)")} - {_FRACTION.format("c1", f"({_FRACTION.format('c1', '-2597')} + 7932)")} as log_tangent,
(seed * 1664525 + 1013904223) % 4294967296 as noise, floor(sqrt(seed))::bigint as whole_root,
case when share < 4 then 1 else ((([16384, 17866, 19483, 21247, 23170, 25267, 27554, 30048])[(greatest(share, 0) & 7) + 1] >> (14 - (greatest(share, 0) >> 3))::int) + 1 >> 1) * 2 end::bigint as steps from qb"""
)
def split_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine, logarithm of the tangent and resolution of a split's angle; noise generator and whole roots."""
    rows = _numbers(spark, sf_dir)
    key, line, c = F.col("k").cast("long"), F.col("line").cast("long"), F.col("c")
    x = ((key * 7 + line * 131) % 16255 + 64).alias("x")
    seed = ((key * 31 + line) % 4294967296).alias("seed")
    rows = rows.select("k", "line", "s", "c", x, seed).withColumn("cosine", fixed.cosine(F.col("x"))).withColumn("sine", fixed.cosine(F.lit(16384) - F.col("x")))
    steps = fixed.angle_steps(c % 30 + 2, F.col("x") % 700, F.lit(20), F.lit(40), (F.col("s") % 2) == 0)
    return rows.select("k", "line", "cosine", fixed.log_tangent(F.col("sine"), F.col("cosine")).alias("log_tangent"), fixed.noise_step(F.col("seed")).alias("noise"), fixed.whole_root(F.col("seed")).alias("whole_root"), steps.alias("steps"))



@query(
    """with w(j, width) as (values (0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1), (8, 2), (9, 2), (10, 2), (11, 2), (12, 4), (13, 4), (14, 4), (15, 6), (16, 6), (17, 8), (18, 12), (19, 18), (20, 22)),
c(lm, channels, caps) as (values (0, 1, [224, 224, 224, 224, 224, 224, 224, 224, 160, 160, 160, 160, 185, 185, 185, 178, 178, 168, 134, 61, 37]),
(0, 2, [224, 224, 224, 224, 224, 224, 224, 224, 240, 240, 240, 240, 207, 207, 207, 198, 198, 183, 144, 66, 40]),
(1, 1, [160, 160, 160, 160, 160, 160, 160, 160, 185, 185, 185, 185, 193, 193, 193, 183, 183, 172, 138, 64, 38]),
(1, 2, [240, 240, 240, 240, 240, 240, 240, 240, 207, 207, 207, 207, 204, 204, 204, 193, 193, 180, 143, 66, 40]),
(2, 1, [185, 185, 185, 185, 185, 185, 185, 185, 193, 193, 193, 193, 193, 193, 193, 183, 183, 172, 138, 65, 39]),
(2, 2, [207, 207, 207, 207, 207, 207, 207, 207, 204, 204, 204, 204, 201, 201, 201, 188, 188, 176, 141, 66, 40]),
(3, 1, [193, 193, 193, 193, 193, 193, 193, 193, 193, 193, 193, 193, 194, 194, 194, 184, 184, 173, 139, 65, 39]),
(3, 2, [204, 204, 204, 204, 204, 204, 204, 204, 201, 201, 201, 201, 198, 198, 198, 187, 187, 175, 140, 66, 40]))
select lm, channels, j as band, (width << lm)::int as bins, ((caps[j + 1] + 64) * channels * (width << lm) >> 2)::int as cap from w, c"""
)
def band_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins and most eighths of bits of each band by frame size and channels."""
    rows = [(lm, c, j, allocation.part_size(j, lm), cap) for lm in range(4) for c in (1, 2) for j, cap in enumerate(allocation.caps(lm, c))]
    return spark.createDataFrame(rows, "lm int, channels int, band int, bins int, cap int")


#: 2 ** i * (n over i) * (k - 1 over i - 1), summed, counts the vectors.
_BINOMIAL = "list_reduce(list_prepend(1::hugeint, list_transform(range({1}), lambda j: j::hugeint)), lambda acc, j: acc * (({0}) - j) // (j + 1))"


@query(
    f"""with p as (select p_partkey, (p_partkey % 20 + 1)::bigint as n, (p_partkey // 20 % 7 + 1)::bigint as k from part),
d as (select distinct n, k from p), t as (select n, k, i, {_BINOMIAL.format("n", "i")} as x, {_BINOMIAL.format("k - 1", "i - 1")} as y from d, (select unnest(range(1, 8)) as i) where i <= k),
v as (select n, k, sum((1::hugeint << i::int) * x * y)::bigint as vectors from t group by n, k)
select p_partkey, n, k, vectors, ceil(round(8 * log2(vectors), 9))::bigint as cost from p join v using (n, k)"""
)
def pulse_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors of n numbers have absolute sum k, and what one of them costs: a dimension, broadcast."""
    key = F.col("p_partkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (key % 20 + 1).cast("long").alias("n"), (F.floor(key / 20) % 7 + 1).cast("long").alias("k"))
    rows = [(n, k, pulse_vectors(n, k), allocation.ladder(n)[k]) for n in range(1, 21) for k in range(1, 8)]  # 140 rows
    return parts.join(F.broadcast(spark.createDataFrame(rows, "n long, k long, vectors long, cost long")), ["n", "k"]).select("p_partkey", "n", "k", "vectors", "cost")


@query(
    """with w as (select vec_id, list_transform(embedding, lambda v: v::double) as x from embeddings),
p as (select vec_id, x, list_sum(list_transform(range(64), lambda k: x[k + 1] * cos(k * 2 * pi() * 3000 / 48000))) / 32 as a, list_sum(list_transform(range(64), lambda k: x[k + 1] * sin(k * 2 * pi() * 3000 / 48000))) / 32 as b from w),
f as (select *, list_transform(range(64), lambda k: a * cos(k * 2 * pi() * 3000 / 48000) + b * sin(k * 2 * pi() * 3000 / 48000)) as y from p)
select vec_id, round(sqrt(a * a + b * b), 9) as amplitude, round(10 * log10(list_sum(list_transform(y, lambda v: v * v)) / list_sum(list_transform(range(1, 65), lambda k: (x[k] - y[k]) * (x[k] - y[k])))), 6) as snr_db from f"""
)
def sine_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 kHz sine that fits each frame best."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", signal.projection(F.col("embedding"), 3000.0).alias("p"))
    return rows.select("vec_id", F.round("p.amplitude", 9).alias("amplitude"), F.round("p.snr_db", 6).alias("snr_db"))


@query(
    """with h as (select doc_id, md5(text) as hx from documents),
s as (select doc_id, hx, list_transform(range(8), lambda k: (('0x' || substr(hx, (4 * k + 3)::int, 2) || substr(hx, (4 * k + 1)::int, 2))::int + 32768) % 65536 - 32768) as pcm from h),
q as (select *, list_sum(list_transform(pcm, lambda v: v::bigint * v))::bigint as e from s), g as (select *, greatest(0, length(bin(e)) - 30)::int as shift from q)
select doc_id, array_to_string(pcm, ',') as pcm, hx as bytes, upper('00000010' || printf('%08x', doc_id % 65536) || hx) as record, e >> shift as energy, shift from g"""
)
def sample_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as 16-bit samples and back, their test-vector records, their energy with its shift."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.unhex(F.md5("text")).alias("data"))
    rows = rows.withColumn("pcm", signal.from_bytes(F.col("data"))).withColumn("e", fixed.energy_and_shift(F.col("pcm")))
    return rows.select(
        "doc_id",
        F.array_join(F.transform("pcm", lambda v: v.cast("string")), ",").alias("pcm"),
        F.lower(F.hex(signal.to_bytes(F.col("pcm")))).alias("bytes"),
        F.hex(container.bit_record(F.col("data"), F.col("doc_id") % 65536)).alias("record"),
        F.col("e.energy").alias("energy"),
        F.col("e.shift").alias("shift"),
    )


@query(
    """with n as (select event_id, event_id % 500 - 250 as x from events), p as (select event_id, x, least(abs(x), 191) as s from n)
select event_id, case when x >= 192 then 32767 when x <= -192 then 0 when x < 0 then [16384, 8812, 3906, 1554, 589, 219][(s >> 5) + 1] - [237, 153, 73, 30, 12, 7][(s >> 5) + 1] * (s & 31)
  else [16384, 23955, 28861, 31213, 32178, 32548][(s >> 5) + 1] + [237, 153, 73, 30, 12, 7][(s >> 5) + 1] * (s & 31) end::bigint as sigmoid,
case event_id % 4 when 0 then 'the packet has no bytes' when 1 then 'the page is cut short' when 2 then 'unheard of' end as message from p"""
)
def sigmoid_and_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The straight-line sigmoid, and error values in words."""
    kind = F.col("event_id") % 4
    error = F.when(kind == 0, "empty").when(kind == 1, "truncated").when(kind == 2, "unheard of")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", fixed.sigmoid(F.col("event_id") % 500 - 250).alias("sigmoid"), messages.message(error).alias("message"))


@query()
def packet_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's frames, 120 samples each, through packets and back: sizes, samples, and whether both sides end in the same state."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null")
    pcm = F.slice(F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), 2)), 1, 120)
    packets = codec.encode(rows.select("label", F.col("vec_id").cast("long").alias("seq"), pcm.alias("pcm")), ["label"], 1, 96.0, "wide")
    back = codec.decode(packets.select("label", "seq", "data"), ["label"], 1).select("label", "seq", F.col("final_range").alias("got"), F.col("samples").alias("n"))
    return packets.join(back, ["label", "seq"]).select("label", "seq", F.length("data").alias("size"), "n", (F.col("final_range") == F.col("got")).alias("in_step"))
