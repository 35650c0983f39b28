"""Nearest cross-split pairs and hash clusters against all pairs."""

import random

import pytest

from roadloom.operators import hashing, nearest

IMAGES = "grp string, image string, split string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(rows, distance):
    found = [(distance(p, q), p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[2] != q[2] and p[1] < q[1]]
    return [min(found)] if found else []


@pytest.mark.parametrize("seed,alphabet,lengths,n", [(1, "ab", (1, 4), 14), (2, "abcdefghij", (8, 14), 40), (3, "0123456789", (3, 6), 60), (4, "aé中", (0, 9), 30)])
def test_nearest_names_equal_all_pairs(spark, seed, alphabet, lengths, n):
    rng = random.Random(seed)
    names = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths))) for _ in range(n)})
    rows = [(rng.choice("gh"), name, rng.choice(["train", "val", "test"])) for name in names]
    got = nearest.nearest_names(spark.createDataFrame(rows, IMAGES)).collect()
    assert [(r.edit_distance, r.a, r.b) for r in got] == plain(rows, lambda p, q: edits(p[1], q[1]))


def test_nearest_names_far_apart_and_none(spark):
    rows = [("g", "aaaaaaaaaaaaaaaaaaaa", "train"), ("g", "zzzzzz", "val"), ("h", "b", "train"), ("h", "c", "train"), ("i", "b1", "val")]
    assert nearest.nearest_names(spark.createDataFrame(rows, IMAGES)).collect() == [("aaaaaaaaaaaaaaaaaaaa", "zzzzzz", 20)]
    assert nearest.nearest_names(spark.createDataFrame(rows[2:], IMAGES)).count() == 0


def test_nearest_hashes_equal_all_pairs(spark):
    rng = random.Random(5)
    for near in (0, 3, 11, 64):
        base = rng.getrandbits(64)
        rows = [("g", f"i{i:03d}", rng.choice(["train", "val"]), rng.getrandbits(64) & (2**40 - 1)) for i in range(30)] if near < 64 else []
        other = base ^ sum(1 << p for p in rng.sample(range(64), near))
        rows += [("h", "x", "train", base), ("h", "y", "val", other), ("h", "y2", "val", other), ("h", "none", "val", None), ("k", "z", "val", base)]
        signed = [(g, i, s, h if h is None or h < 2**63 else h - 2**64) for g, i, s, h in rows]
        got = nearest.nearest_hashes(spark.createDataFrame(signed, IMAGES + ", hash bigint")).collect()
        want = plain([r for r in rows if r[3] is not None], lambda p, q: (p[3] ^ q[3]).bit_count())
        assert [(r.distance, r.a, r.b) for r in got] == want
    assert nearest.nearest_hashes(spark.createDataFrame(signed[-1:], IMAGES + ", hash bigint")).count() == 0


def test_bands_follow_threshold_count_and_bits():
    even = [0.5] * 64
    assert [len(hashing.plan_bands(n, even, 10)[0]) for n in (500, 100_000)] == [11, 4]
    # constant bits tell nothing: no band holds one
    bands, wide, narrow = hashing.plan_bands(100_000, [1.0] * 16 + [0.5] * 48, 10)
    assert min(min(b) for b in bands) == 16 and wide + narrow == 10 // len(bands)
    assert hashing.plan_bands(5, [1.0] * 64, 3)[0]


def test_hash_groups_of_a_crowd_with_constant_bits(spark):
    """The crowd is one node per key, so open pairs stay below 100 a hash (it alone has 1.1 million pairs)."""
    rng = random.Random(6)
    base = rng.getrandbits(63)
    crowd = {base ^ sum(1 << p for p in rng.sample(range(16, 63), rng.randrange(1, 5))) for _ in range(1500)}
    values = sorted(crowd) + [rng.getrandbits(63) for _ in range(3000)]
    df = spark.createDataFrame([(f"i{i:05d}", v) for i, v in enumerate(values)], "image string, hash bigint")
    comp, opened = hashing.hash_links(df, 10)
    assert opened.count() < 100 * len(values)
    sizes = sorted((r["count"] for r in hashing.hash_groups(df, 10).groupBy("grp").count().collect()), reverse=True)
    assert sizes[0] == len(crowd) and sum(sizes) == len(values)


def test_hash_groups_chain_and_copies(spark):
    # links of 10 bits in a row; copies; a null hash; another group beyond the threshold
    chain = [(1 << 10 * k) - 1 for k in range(6)]
    rows = [(f"c{k}", h) for k, h in enumerate(chain)] + [("copy", chain[3]), ("far", 0b1 << 61 | 0x3FF << 50), ("none.jpg", None)]
    got = {r.image: r.grp for r in hashing.hash_groups(spark.createDataFrame(rows, "image string, hash bigint"), 10).collect()}
    assert {got[f"c{k}"] for k in range(6)} | {got["copy"]} == {"c0"} and got["none.jpg"] == "none"
    assert got["far"] == "far"


def test_hashes_compared_in_blocks_give_all_links(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    # one crowd, and chains of pairs further apart than the crowd that lie in different blocks
    rnd = random.Random(5)
    crowd = [rnd.getrandbits(20) for _ in range(150)]
    far = [rnd.getrandbits(60) | 15 << 60 for _ in range(60)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in crowd + far + [v ^ 0b11 << 40 for v in far[::2]]})
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 8 and (p := find(a)) != (q := find(b)):
                parent[max(p, q)] = min(p, q)
    want = {v: find(v) for v in values}
    monkeypatch.setattr(hashing, "PACK", 32)
    monkeypatch.setattr(hashing, "TILE", 8)
    df = spark.createDataFrame([(v,) for v in values], "hash bigint")
    got = {r.hash: r.c for r in hashing.packed_components(df, len(values), 8).collect()}
    assert got == want and 30 < len(set(want.values())) < len(values) - 100
    # a wide threshold takes this way, and needs no keys
    monkeypatch.setattr(hashing, "band_keys", None)
    images = df.withColumn("image", F.col("hash").cast("string"))
    assert hashing.hash_groups(images, 18).select("grp").distinct().count() < len(set(want.values()))
