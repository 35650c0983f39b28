"""Suffix buckets, filter audit and prefix trie against plain versions."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from roadloom.llm import filter_audit, prefix_trie, suffix_dedup
from roadloom.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, source string, doc string, tie string, span int, part int, A int, _h string, m int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "d", "t", 1, 2, 3, "h", 4) for i, t, s in rows], DOCS)


def plain_removal(rows, length=100):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans = [len(list(g)) for on, g in itertools.groupby(gone) if on]
        kept = bytes(b for b, x in zip(raw, gone, strict=True) if not x)
        out.append((doc_id, len(raw), sum(spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removal(df):
    found = suffix_dedup.remove_repeats(df).collect()
    for r in found:
        assert all(a.stop < b.start for a, b in itertools.pairwise(r.removed))
    return sorted(((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in found), key=str)


def odd_texts(seed, n):
    rng = random.Random(seed)
    words = ["aé", "bcd", "  ", "xyzw", "中", "0" * 7, "ab" * 30]
    passages = ["".join(rng.choice(words) for _ in range(80)) for _ in range(4)]
    pieces = [lambda: rng.choice(passages), lambda: rng.choice(passages)[: rng.randrange(20, 150)], lambda: "".join(rng.choice(words) for _ in range(20)), lambda: "a" * rng.randrange(150)]
    return [None, ""] + ["".join(rng.choice(pieces)() for _ in range(rng.randrange(5))) for _ in range(n)]


def test_removal_of_odd_texts(spark):
    rows = [(3 * i if i != 9 else None, t) for i, t in enumerate(odd_texts(1, 90))]
    # a repeated row, one of them thrice, a short one twice
    rows += [rows[20], rows[30], rows[30], (1, "short"), (1, "short")]
    assert removal(documents(spark, [(i, t, "s") for i, t in rows])) == plain_removal(rows)


def test_removal_where_one_id_has_several_texts(spark):
    p = "".join(hashlib.md5(bytes([i])).hexdigest() for i in range(5))
    got = removal(documents(spark, [(5, p + "x", None), (5, p + "y", None), (6, "z" + p, None), (None, p, None), (None, p, None)]))
    # whichever text of id 5 comes first stays whole; all later copies of the passage go
    assert sorted(r[2] for r in got) == [0, 160, 160, 160, 160]
    assert [r[2] for r in got if r[0] == 6] == [160] and sum(r[2] for r in got if r[0] == 5) == 160


def test_removal_in_texts_beyond_a_chunk(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(suffix_dedup.CHUNK + 40_000))
    at = suffix_dedup.CHUNK
    rows = [(1, text + text[at - 150 : at + 150] + "k" * 700), (2, text[1000:1600] + "!" + text[at - 60 : at + 60])]
    assert removal(documents(spark, [(i, t, "s") for i, t in rows])) == plain_removal(rows)


def test_removal_of_a_common_passage_in_other_surroundings(spark):
    rng = random.Random(6)
    common = "the very same passage of 110 bytes stands in every text of this table, between words that no other text has at all"
    rows = [(i, "".join(rng.choice("abcdef") for _ in range(200)) + common + "".join(rng.choice("ghijkl") for _ in range(200))) for i in range(60)]
    assert removal(documents(spark, [(i, t, "s") for i, t in rows])) == plain_removal(rows)


def test_no_texts_no_rows(spark):
    none = documents(spark, [(1, "x", "s")]).filter("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert filter_audit.audit(none, labels).count() == 0
    turns, conversations = prefix_trie.share_openings(prefix_trie.number_turns(spark.createDataFrame([], TURNS)))
    assert prefix_trie.prefix_trie(turns, conversations).count() == 0


# ---------------------------------------------------------------- filter audit


def test_least_squares_give_the_mean_over_orders():
    rng = random.Random(2)
    for n in (2, 3, 5):
        v = [0] + [rng.randrange(1000) for _ in range(2**n - 1)]
        mean = [Fraction(0)] * n
        orders = list(itertools.permutations(range(n)))
        for order in orders:
            before = 0
            for i in order:
                mean[i] += Fraction(v[before | 1 << i] - v[before], len(orders))
                before |= 1 << i
        fit = [sum(w * x for w, x in zip(row, v, strict=True)) for row in filter_audit.shapley_weights(n)]
        assert fit == mean


def audit_rows(spark):
    rng = random.Random(8)
    long = " ".join(f"w{i}" for i in range(230))
    texts = [None, "", " \t\n", long, long, long + " #", "AB " * 210, ("x " * 250), long.upper(), "no | sign", long + "\x0bz\x0c", "é中" * 90, *(long[: rng.randrange(1400)] for _ in range(20))]
    rows = [(i if i != 6 else None, t, rng.choice(["a", "b", None, ""])) for i, t in enumerate(texts)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 30, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    return documents(spark, rows + rows[3:5] + [(None, "", "a")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit_of_odd_rows_equals_its_oracle(spark, tmp_path):
    docs, labels = audit_rows(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    compare(spark, tmp_path, "op12_filter_audit", ["documents", "labels"])


def test_audit_of_one_known_table(spark):
    good = " ".join(f"w{i}" for i in range(300))
    docs = documents(spark, [(1, good, "s"), (2, good, "s"), (3, "short #", "s")])
    rows = filter_audit.audit(docs, spark.createDataFrame([(2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 600
    by = {(r.filter_order, r.step): r for r in rows}
    first, fourth = by["ABCDE", 1], by["ABCDE", 4]
    assert (first.kept, first.removed, first.redundant, first.unique_fails, first.good_lost, first.toxic_lost, first.shapley) == (2, 1, 0, 0, 0, 1, 60)
    assert (fourth.kept, fourth.removed, fourth.redundant, fourth.shapley) == (2, 0, 1, 60)
    assert (by["ABCDE", 5].removed, by["ABCDE", 5].good_lost, by["ABCDE", 5].unique_fails, by["ABCDE", 5].shapley) == (1, 1, 1, 120)


# ---------------------------------------------------------------- prefix trie

TURNS = "conv_id long, turn long, role string, text string, pos int, depth int, a long, node string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = []
    for k, convs in members.items():
        under = [x for x in members if x[: len(k)] == k]
        leaves = [x for x in under if not any(y[: len(x)] == x and len(y) > len(x) for y in under)]
        saved = sum((len(members[x]) - 1) * len([w for w in split(x[-1][1]) if w]) for x in under if x)
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == k)))
        children = sum(len(x) == len(k) + 1 for x in under)
        out.append((min(convs), len(k), min(members[k[:-1]]) if k else None, len(convs), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def split(text):
    return "".join(" " if ch in "\t\n\x0b\x0c\r" else ch for ch in text).split(" ")


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 3 * n), n):
        for t in range(rng.choice([1, 1, 2, 3, 6])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "user", None]), rng.choice(["hi there", "hi\x0bthere you", "", None, f"own {c}"])))
    rows += rows[:3] + [(None, 1, "user", "lost"), (7, 3, "user", "中 文")]
    rows += [(c, 0, "user", "the common one") for c in range(400, 440)]
    return rows


def trie(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2, 3, "n") for r in rows], TURNS)
    turns, convs = prefix_trie.share_openings(prefix_trie.number_turns(df))
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(turns, convs, **kw).collect()), key=str)


@pytest.mark.parametrize("cells", [None, 1, 7])
def test_trie_of_odd_conversations(spark, cells):
    """Also where the sketch is far too small, so that it proves little or nothing."""
    rows = conversations(3, 60)
    assert trie(spark, rows, cells=cells) == plain_trie(rows)


def test_trie_of_long_conversations_and_many_ends(spark):
    block = prefix_trie.BLOCK
    rows = [(c, t, "user", f"turn {t}") for c in (20, 40) for t in range(block + 300 + c)]
    rows += [(c, 0, "user", "same") for c in range(1000, 1000 + 400)]
    turns = spark.createDataFrame([(c, t + 1, r, x) for c, t, r, x in rows], "conv_id long, depth long, role string, text string")
    got = prefix_trie.prefix_trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("total"))).collect()
    assert len(got) == 1 + (block + 340) + 1
    by = {(r.conv_id, r.depth): r for r in got}
    ids = ",".join(str(c) for c in range(1000, 1400))
    assert by[1000, 1].ends_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    assert by[20, 0].n_convs == 402 and by[20, 0].n_leaves == 2 and by[20, 0].n_children == 2
    assert by[20, block + 320].n_convs == 2 and by[20, block + 320].n_leaves == 1
    assert by[40, block + 321].parent_conv_id == 20 and by[40, block + 340].n_children == 0
    assert by[20, 1].saved_tokens == 2 * (block + 320)


def test_trie_equals_its_oracle(spark, tmp_path):
    rows = [r for r in conversations(5, 50) if r[0] is None or r[0] >= 0]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    compare(spark, tmp_path, "op13_prefix_trie", ["conversations"])


def compare(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


# ---------------------------------------------------------------- earlier operators


def test_decontamination_folds_only_ascii(spark, tmp_path):
    from roadloom.llm import decontamination

    greek = [f"ΛΟΓΟ{c}Σ" for c in "ΑΒΓΔΕΖΗΘΙΚΛΜ"]
    odd = ["İstanbul", "Kelvin", "kelvin", "ΟΔΟΣ", "οδος", "οδοσ", "Straße", "STRASSE", "ǅ", "One", "two", "III"]
    items = [(1, ".".join(greek)), (2, " ".join(odd)), (3, "kelvin ss")]
    texts = [".".join(greek), " ".join(greek), "x " + "/".join(odd), " ".join(odd).replace("One", "oNE"), " ".join(odd).lower(), "Kelvin ss", "KELVIN SS", None]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.contamination(docs, bench).collect()}
    assert got[0] == got[1] == (12, 12, 1) and got[2] == (13, 12, 1) and got[3] == (12, 12, 1)
    assert got[4][1:] == (0, 0) and got[5][1:] == (0, 0) and got[6] == (2, 2, 1) and got[7] == (0, 0, 0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    compare(spark, tmp_path, "op3_decontamination", ["documents", "benchmark"])


def test_pipeline_keeps_one_row_of_each_class(spark):
    import corpus_pipeline

    long = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(3)]
    rows = [(5, long[0], "s"), (5, long[1], "s"), (3, long[1], "s"), (None, long[2], "s"), (None, long[2], "s"), (None, long[0], "s"), (8, long[1], "s"), (9, "", "s"), (10, None, "s")]
    kept = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(5, long[0]), (3, long[1]), (None, long[2]), (9, "")], key=str)
    assert corpus_pipeline.drop_near_copies(spark, documents(spark, rows).filter("false"), "").count() == 0
