"""Near-duplicate classes by HyperMinHash registers, banding and verification.

A document's set is its distinct 5-word shingles (64-bit hashes). Documents
with equal sets are one class at once, whatever their number. One
representative a class is sketched: register i keeps the least value of the
i-th hash over the set as its leading-zero count and the mantissa bits that
follow. Runs of registers are hashed to band keys. Candidates share a band
key; their Jaccard index is estimated from equal registers, corrected for
chance collisions, and what may reach the threshold is verified on full sets
recomputed from the texts.

No group is expanded into all pairs. First every member of a bucket is tried
against a few pivots of the bucket, chosen by hash. Only where a bucket still
holds different components are the pairs *between* components tried, and these
only if sizes and estimate allow the threshold (the estimate is part of the
join's condition, so other pairs are never made). Pairs inside a component need
no test, for it is joined already, so no link between components is lost.

A class is known by a node: doc_id and text hash of its least row, as one
number that sorts by doc_id. Classes that share a doc_id (rows that repeat it
with other texts) are linked, so such rows are one document with several texts.

Nulls: a null or wordless text has an empty set, is linked with nothing and
kept. A null doc_id is linked with nothing: its component_id is null and it is
kept. Rows that repeat a doc_id and its text are alike; n_shingles is always
that of the row's own text. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarmill.llm.components import components
from sonarmill.llm.textnum import shingle_sets
from sonarmill.session import cut, free

BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
DIGEST, GLANCE = 448, 112  # registers of the digest that estimates use, and those of a first look
LEAD, TAIL = 5, 3  # bits of a digest's register: lead count (31 stands for more) and mantissa
LANE = LEAD + TAIL + 1  # one bit to spare: the sum of two lanes stays inside
LANES = 7
CHANCE = 0.18034 / (1 << TAIL)  # that registers of two unlike sets of one size agree: the integral of density squared times cell width
SURE = 4.5  # standard deviations allowed below an expectation before a pair is let go
PIVOTS = 3
SPLIT = 1000  # members of a bucket that one task compares with all others
SPAN = 10**18

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(1, 1 << 63, DIGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, DIGEST, dtype=np.uint64)


def registers_of(values: np.ndarray) -> np.ndarray:
    """Least values (one per register) as leading-zero count and mantissa, 16 bits each."""
    v = np.maximum(values, np.uint64(1))
    # The float's exponent may round up at 53 bits; shifting right first keeps it exact.
    high = (v >> np.uint64(32)).astype(np.float64)
    low = (v & np.uint64(0xFFFFFFFF)).astype(np.float64)
    top = np.where(high > 0, 32 + np.frexp(high)[1] - 1, np.frexp(low)[1] - 1).astype(np.int64)
    left = (v << (63 - top).astype(np.uint64)) << np.uint64(1)  # bits after the leading one
    mantissa = left >> np.uint64(64 - MANTISSA)
    return (((63 - top).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def sketch(shingles: np.ndarray, n: int = REGISTERS) -> np.ndarray:
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    step = max(64, (1 << 18) // n)
    for at in range(0, len(shingles), step):
        part = np.multiply.outer(shingles[at : at + step], _A[:n])
        part += _B[:n]
        np.minimum(least, part.min(axis=0), out=least)
    return registers_of(least)


def band_keys(registers: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(registers[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k) - (1 << 63) for k in range(BANDS)]


def digest_of(registers: np.ndarray) -> list[int]:
    """Lead counts and leading mantissa bits of DIGEST registers, LANES to a number."""
    lead = np.minimum(registers >> MANTISSA, (1 << LEAD) - 1).astype(np.int64)
    tail = ((registers >> (MANTISSA - TAIL)) & ((1 << TAIL) - 1)).astype(np.int64)
    lanes = (lead << TAIL | tail).reshape(-1, LANES)
    return (lanes << (LANE * np.arange(LANES))).sum(axis=1).tolist()


def first_common() -> str:
    """SQL over rows x and y of a bucket (band, keys): it is the first bucket that they share, so a pair is made once."""
    return " and ".join(f"(x.band <= {k} or x.keys[{k}] <> y.keys[{k}])" for k in range(BANDS - 1))


def may_reach(percent: int) -> str:
    """SQL over digests x.d and y.d of sets of x.n and y.n: the estimate may still reach the threshold.

    Registers of unlike sets agree by chance c = CHANCE * 4 n m / (n + m)^2, so of
    k registers k (J + (1 - J) c) are expected to be equal. The estimate of J
    corrected for that may be SURE standard deviations below the threshold.
    """
    j = percent / 100
    ones, tops = (sum(v << (LANE * k) for k in range(LANES)) for v in ((1 << LANE - 1) - 1, 1 << LANE - 1))
    c = f"({CHANCE!r}D * 4D * x.n * y.n / (double(x.n + y.n) * double(x.n + y.n)))"

    def differing(p: str, q: str) -> str:
        return f"bit_count((({p} ^ {q}) + {ones}L) & {tops}L)"

    def reached(registers: int, differ: str) -> str:
        least = j - SURE * (j * (1 - j) / registers) ** 0.5
        return f"{registers} - ({differ}) >= {registers} * ({c} + {least!r}D * (1D - {c}))"

    glance = " + ".join(differing(f"x.d[{k}]", f"y.d[{k}]") for k in range(GLANCE // LANES))
    digest = f"aggregate(zip_with(x.d, y.d, (p, q) -> {differing('p', 'q')}), 0, (total, one) -> total + one)"
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {reached(GLANCE, glance)} and {reached(DIGEST, digest)}"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sizes, h1, h2, keys = [], [], [], []
            for _, s in shingle_sets(part.column(2)):
                sizes.append(len(s))
                digest = xxhash.xxh3_128_digest(s.tobytes())
                h1.append(int.from_bytes(digest[:8], "little", signed=True))
                h2.append(int.from_bytes(digest[8:], "little", signed=True))
                if not len(s):
                    keys.append(None)
                    continue
                keys.append(band_keys(sketch(s)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "th", "n", "h1", "h2", "keys"],
            )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sizes, digests, keys = [], [], []
            for _, s in shingle_sets(part.column(1)):
                r = sketch(s, DIGEST)  # its first registers are those of the bands
                sizes.append(len(s))
                digests.append(digest_of(r))
                keys.append(band_keys(r))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, longs), pa.array(keys, longs)], names=["id", "n", "d", "keys"])


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                inter, union = [], []
                for (_, x), (_, y) in zip(shingle_sets(part.column("ta")), shingle_sets(part.column("tb")), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    inter.append(both)
                    union.append(len(x) + len(y) - both)
                ok = np.array([100 * i >= percent * u for i, u in zip(inter, union, strict=True)], bool)
                out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "n_both", "n_union"])
                yield out.filter(pa.array(ok))

    return run


NODE = "decimal(38,0)"


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link on full sets."""
    ta, tb = (texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    return cut(pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_verified(percent), f"a {NODE}, b {NODE}, n_both long, n_union long"), "links")


def _node(doc_id: str = "doc_id", th: str = "th") -> Column:
    return (F.col(doc_id).cast("decimal(19,0)") * F.lit(SPAN).cast("decimal(19,0)") + F.pmod(F.col(th), F.lit(SPAN))).cast(NODE)


def _doc_id(node: str) -> Column:
    return F.expr(f"({node} - pmod({node}, {SPAN}BD)) div {SPAN}BD")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_links for every row of ``docs``.

    n_links counts verified links of the document's class that the search
    needed; it is a lower bound once a component is joined.
    """
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))
    sketches = cut(base.mapInArrow(_sketches, "doc_id long, th long, n long, h1 long, h2 long, keys array<long>"), "sketches")
    known = sketches.where("doc_id is not null and n > 0").withColumn("id", _node())
    classes = cut(known.groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.min_by("keys", "id").alias("keys")), "classes")

    buckets = cut(classes.select("id", F.posexplode("keys").alias("band", "key")), "buckets")
    crowded = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(buckets.join(crowded, "key"), "shared")
    ids = shared.select("id").distinct()
    # One pass moves the texts that any pair may need; planned alike at every size.
    texts = base.where("doc_id is not null").withColumn("id", _node()).join(ids.hint("merge"), "id", "left_semi").dropDuplicates(["id"])
    texts = cut(texts.select("id", "text"), "texts")
    digests = cut(texts.mapInArrow(_digests, f"id {NODE}, n long, d array<long>, keys array<long>"), "digests")

    order = [F.xxhash64("id", "key", F.lit(k)) for k in range(PIVOTS)]
    pivots = shared.groupBy("key").agg(*[F.min_by("id", o).alias(f"p{k}") for k, o in enumerate(order)]).select("key", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("pivot"))
    star = shared.join(pivots, "key").where("id <> pivot").select(F.least("id", "pivot").alias("low"), F.greatest("id", "pivot").alias("high")).distinct()
    x = digests.select(F.col("id").alias("low"), F.struct("n", "d").alias("x"))
    y = digests.select(F.col("id").alias("high"), F.struct("n", "d").alias("y"))
    near = star.join(x, "low").alias("s").join(y.alias("t"), F.expr(f"s.high = t.high and {may_reach(percent)}"))
    stars = cut(near.select(F.col("low").alias("a"), F.col("s.high").alias("b")), "stars")
    first = _links(stars, texts, percent)

    # Classes that share a doc_id are texts of one document.
    several = known.groupBy("doc_id").agg(*[f(x).alias(f"{x}_{k}") for x in ("h1", "h2", "n") for k, f in enumerate((F.min, F.max))])
    several = several.where("h1_0 < h1_1 or h2_0 < h2_1 or n_0 < n_1").select("doc_id")
    owned = cut(known.join(several, "doc_id", "left_semi").select("doc_id", "h1", "h2", "n").distinct().join(classes.select("h1", "h2", "n", "id"), ["h1", "h2", "n"]).select("doc_id", "id"), "owned")
    same = owned.join(owned.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("a <> id").select("a", F.col("id").alias("b"))
    joined = cut(components(first.select("a", "b").union(same)), "joined")

    # Buckets that still hold different components: pairs between these. A large bucket's members are dealt to several tasks.
    marked = shared.where("size > 2").join(joined, "id", "left").select("key", "band", "size", "id", F.coalesce("component", "id").alias("c"))
    mixed = marked.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    open_rows = cut(marked.join(mixed, "key", "left_semi").join(digests, "id").withColumn("parts", F.ceil(F.col("size") / SPLIT).cast("int")).withColumn("hid", F.xxhash64("id")).withColumn("hc", F.xxhash64("c")).drop("c"), "open")
    one = open_rows.withColumn("part", F.pmod("hid", "parts").cast("int"))
    every = open_rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    between = one.alias("x").join(every.alias("y"), F.expr(f"x.key = y.key and x.part = y.part and x.hid < y.hid and x.hc <> y.hc and {may_reach(percent)} and {first_common()}"))
    more = cut(between.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).join(stars, ["a", "b"], "left_anti"), "between")
    second = _links(more, texts, percent)
    links = first.union(second).select("a", "b")
    found = cut(components(links.union(same)), "joined")

    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    of_class = cut(
        classes.join(found, "id", "left").join(degree, "id", "left").select("h1", "h2", "n", _doc_id("coalesce(component, id)").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "of-class",
    )
    free(classes, buckets, shared, texts, digests, stars, joined, open_rows, more, first, second, owned, found)
    rows = sketches.select("doc_id", "n", "h1", "h2").join(of_class, ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("root")), F.col("doc_id")))
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def op10_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85).drop("n_links")


OP10_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
n as (select doc_id, len(s) as n from s),
e as (select doc_id, unnest(list_transform(s, lambda x: hash(x))) as x from s),
both_in as (select p.doc_id as a, q.doc_id as b, count(*) as k from e p join e q on p.x = q.x and p.doc_id < q.doc_id group by all),
one_way as (select a, b from both_in join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
links as (select a, b from one_way union all select b, a from one_way),
r(id, c) as (select doc_id, doc_id from documents union select links.b, r.c from r join links on links.a = r.id)
select n.doc_id, n.n::bigint as n_shingles, min(r.c) as component_id, min(r.c) = n.doc_id as kept from n join r on r.id = n.doc_id group by n.doc_id, n.n
"""
