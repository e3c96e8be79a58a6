"""Operators on rows, generators, examples, files and streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkbits.functions import convert as V
from sparkbits.functions import words as W
from sparkbits.operators import applied as A
from sparkbits.operators import generators as G
from sparkbits.operators import relation as R
from sparkbits.sources import files
from sparkbits.streaming import presence as S


@pytest.fixture
def vectors(spark):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice("01") for _ in range(n))) for k, n in enumerate((1, 5, 64, 65, 130))]
    return spark.createDataFrame(rows, "id int, bits string"), dict(rows)


def test_rows_and_back(vectors):
    df, model = vectors
    for again in (R.collapse_bits(R.explode_bits(df, "id"), "id"), R.collapse_words(R.explode_words(df, "id"), "id")):
        assert {r.id: r.bits for r in again.collect()} == model


def test_runs_and_select(vectors):
    df, model = vectors
    rows = R.explode_bits(df, "id")
    runs = R.intervals(rows, "id").collect()
    for k, b in model.items():
        mine = sorted((r.start, r.stop, r.value) for r in runs if r.id == k)
        assert "".join(str(v) * (z - a) for a, z, v in mine) == b and all(x[2] != y[2] for x, y in zip(mine, mine[1:]))
    by_words = {r.id: r.place for r in R.count_n_words(R.explode_words(df, "id"), "id", 3).collect()}
    by_bits = {r.id: r.place for r in R.count_n(rows, "id", 3).collect()}
    for k, b in model.items():
        want = next((i + 1 for i in range(len(b)) if b[: i + 1].count("1") == 3), None)
        assert by_bits[k] == want and by_words.get(k) == want


def test_primes(spark):
    for n, count, total, squares in ((10, 4, 17, 87), (100, 25, 1060, 65796), (1000, 168, 76127, 49345379), (10000, 1229, 5736396, 37546387960)):
        r = G.sieve_report(spark, n).first()
        assert (r["count"], r.sum_p, int(r.sum_sq)) == (count, total, squares)
    assert [r.idx for r in G.primes(spark, 3).collect()] == [2] and G.primes(spark, 2).count() == G.primes(spark, 0).count() == 0
    assert sorted(r.idx for r in G.primes(spark, 10, odd=True).collect()) == [1, 2, 3, 5, 6, 8, 9]
    assert [G.nth_prime(spark, n).first().prime for n in (1, 5, 6, 100)] == [2, 11, 13, 541]


def test_random(spark):
    assert G.random_k(spark, 50, 0).agg(F.sum("bit")).first()[0] == 0 and G.random_k(spark, 50, 50).agg(F.sum("bit")).first()[0] == 50
    with pytest.raises(ValueError):
        G.random_k(spark, 5, 6)
    with pytest.raises(ValueError):
        G.random_p(spark, 5, 1.5)
    seen = [G.random_k(spark, 20, 5, seed=s).where("bit = 1").agg(F.sum("idx")).first()[0] for s in range(4)]
    assert len(set(seen)) > 1


@pytest.mark.parametrize("p", [0.0001, 0.01, 0.03, 0.3, 0.98, 0.9999])
def test_random_density(spark, p):
    """Shares of ones over all bits, over the first bit of words and over bits behind a one stay within five standard deviations."""
    n = 2_000_000 if 0.001 < p < 0.999 else 20_000_000
    w = F.col("word")
    pairs = F.bit_count(w.bitwiseAND(F.shiftleft(w, 1)))
    r = G.random_words(spark, n, p, seed=3).agg(F.sum(F.bit_count(w)).alias("ones"), F.sum((w < 0).cast("int")).alias("first"), F.sum(pairs).alias("pairs")).first()
    for got, size, q in ((r.ones, n, p), (r.first, n // 64, p), (r.pairs, n // 64 * 63, p * p)):
        assert abs(got - size * q) <= 5 * (size * q * (1 - q)) ** 0.5 + 2


def test_bloom_by_join_and_broadcast(spark):
    keys = spark.range(500).withColumnRenamed("id", "k")
    m, k = A.bloom_size(500, 0.01)
    bloom = A.bloom_build(keys, "k", m, k)
    for bits in (1 << 26, 0):
        assert A.bloom_probe(keys, "k", bloom, m, k, bits).where("maybe").count() == 500
        assert A.bloom_probe(spark.range(10_000, 11_000).withColumnRenamed("id", "k"), "k", bloom, m, k, bits).where("maybe").count() < 40
    empty = A.bloom_build(keys.where("k < 0"), "k", m, k)
    assert A.bloom_probe(keys, "k", empty, m, k).where("maybe").count() == 0


def test_registers(spark):
    states = [9]
    while len(states) < 20:
        s = states[-1]
        states.append(s >> 1 | (s ^ s >> 1) % 2 << 3)
    assert [r.state for r in A.lfsr(spark, 9, 3, 4, 19).orderBy("step").collect()] == states
    assert A.lexico_all(spark, 6, 2).count() == 15 and A.lexico_all(spark, 4, 0).first().bits == "0000"


def test_pbm_and_json(spark, one):
    image = spark.createDataFrame([(0, "1010101010"), (1, "0000011111")], "y int, bits string")
    assert A.pbm(image, 10).select(A.from_pbm(F.col("content"))).first()[0] == ["1010101010", "0000011111"]
    assert one(V.from_json(V.to_json(F.lit("1" * 60))), V.from_json(V.to_json(F.lit("")))) == ["1" * 60, ""]


def test_files(spark, tmp_path, vectors):
    df, model = vectors
    files.write_vectors(df, str(tmp_path / "v"), endian="little")
    assert {r.id: r.bits for r in files.read_vectors(spark, str(tmp_path / "v")).collect()} == model
    blobs = spark.createDataFrame([("a.bin", b"\xf0\x01"), ("b.bin", b"")], "name string, content binary")
    assert sorted(tuple(r) for r in files.write_files(blobs, f"file://{tmp_path}/raw", "name", "content").collect()) == [("a.bin", 2), ("b.bin", 0)]
    assert sorted(r.bits for r in files.read_files(spark, f"{tmp_path}/raw/*.bin").collect()) == ["1111000000000001"]
    short = blobs.select(files.first_bytes(F.col("content"), 3, strict=False).alias("x"))
    assert sorted(len(r.x) for r in short.collect()) == [0, 2]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(n, rng.randrange(5), rng.choice(S.EVENT_TYPES), f"2024-01-01 {rng.randrange(24):02d}:{rng.randrange(60):02d}:00") for n in range(300)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, t string").select("event_id", "user_id", "event_type", F.to_timestamp("t").alias("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = S.event_stream(spark, str(tmp_path / "e"), events.schema)
    got = S.run_to_table(S.tumbling(stream, "2 hours", late="2 days"), "tumbled", str(tmp_path / "c"), "complete")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(got) == key(S.tumbling(events, "2 hours"))
    for r in S.presence(events).collect():
        assert r.bits == "".join("1" if any(u == r.user_id and e == k for _, u, e, _ in rows) else "0" for k in S.EVENT_TYPES)


def test_all_pairs(spark):
    a, b = (spark.range(n).select(F.col("id").alias(f"{x}_id"), (F.col("id") * 7).alias(f"{x}_v")) for x, n in (("a", 60), ("b", 250)))
    pairs = R.all_pairs(a, "a_id", b, "b_id", rows=20, per_task=1000)
    got = pairs.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.a_id, r.b_id) for r in got) == [(x, y) for x in range(60) for y in range(250)]
    assert all(r.a_v == 7 * r.a_id and r.b_v == 7 * r.b_id for r in got)
    assert len({r.task for r in got}) > 5  # the tables are small, their pairs many
    assert R.all_pairs(a.limit(0), "a_id", b, "b_id").count() == 0


def test_words_as_columns(spark):
    rng = random.Random(8)
    for n in (1, 64, 65, 200):
        rows = [tuple("".join(rng.choice("01") for _ in range(n)) for _ in "ab") for _ in range(5)]
        a, b = (W.columns(x, n) for x in "ab")
        counts = [f.cast("long") for f in (W.count_and(a, b), W.count_or(a, b), W.count_xor(a, b), W.popcount(a))]
        r = W.correspond_all(a, b, F.length("a"))
        got = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.array(counts).alias("n"), W.any_and(a, b).alias("meets"), W.subset(a, b).alias("inside"), W.subset(W.and_(a, b), b).alias("both"), F.array(*(r[x] for x in ("ff", "ft", "tf", "tt"))).alias("r")).collect()
        for x in got:
            p = list(zip(x.a, x.b))
            both = p.count(("1", "1"))
            assert list(x.n) == [both, n - p.count(("0", "0")), p.count(("0", "1")) + p.count(("1", "0")), x.a.count("1")]
            assert (x.meets, x.inside, x.both) == (both > 0, ("1", "0") not in p, True) and list(x.r) == [p.count((u, v)) for u, v in (("0", "0"), ("0", "1"), ("1", "0"), ("1", "1"))]


def test_bloom_of_shards(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD_BITS", 1000)
    keys = spark.range(500).withColumnRenamed("id", "k")
    m, k = A.bloom_size(500, 0.01)
    shards, bits = A.bloom_shards(m)
    assert shards == 5 and bits % 64 == 0 and shards * bits >= m
    bloom = A.bloom_build(keys, "k", m, k).cache()
    words = {r.word_idx: r.word for r in bloom.collect()}
    assert len(words) == bloom.count() and max(words) < shards * bits // 64
    for p in keys.select(A.bloom_positions(F.col("k"), m, k).alias("p")).collect():
        assert len({x // bits for x in p.p}) == 1 and all(words[x // 64] >> x % 64 & 1 for x in p.p)
    others = spark.range(10_000, 12_000).withColumnRenamed("id", "k")
    joined, plain = ({r.k for r in A.bloom_probe(others, "k", bloom, m, k, b).where("maybe").collect()} for b in (0, 1 << 24))
    assert joined == plain and len(joined) < 80
    twice = A.bloom_probe(keys.union(keys), "k", bloom, m, k, 0)
    assert twice.where("maybe").count() == 1000 and twice.columns == ["k", "maybe"]
    assert A.bloom_probe(keys, "k", A.bloom_build(keys.where("k < 3"), "k", m, k), m, k, 0).where("maybe").count() < 100
    assert abs(A.bloom_stats(bloom, m, k).first().approx_items - 500) < 50
    # places aren't shuffled: only keys are dealt out, once, before they become k places
    plan = A.bloom_build(keys.where("k <> 7"), "k", m, k)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
