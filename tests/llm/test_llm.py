"""Corpus operators against plain versions, on small tables with odd rows."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from roadloom.llm import (
    decontamination, embedding_dedup, html_extraction, language_id, line_dedup, packing, passage_dedup,
    simhash_dedup, tokens, url_filter,
)
from roadloom.llm.queries import ORACLES, QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, page_id string, host string, t int, _doc int"
ODD = [None, "", "  \n ", "...", "a", "One two", "naïve café Ünïcode 中文 字 ½²", "x<|endoftext|>y", "a  b \n\n c"]


def words_of(seed, n):
    rng = random.Random(seed)
    return [rng.choice(["alpha", "Beta", "gamma", "delta,", "eps", "zeta.", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(60)) for _ in range(n)]


def documents(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t or ""), "p", "h", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], DOCS)  # two repeated rows


@pytest.fixture(scope="module")
def sample(spark):
    base = words_of(1, 300)
    near = [*base[:150], "changed", *base[151:]]
    texts = [*ODD, " ".join(base), " ".join(near), " ".join(base), " ".join(words_of(2, 90) + base[40:110] + words_of(3, 90)), " ".join(words_of(4, 30_000))]
    return documents(spark, texts)


def test_empty_tables(spark):
    docs = documents(spark, []).filter("false")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert tokens.count_tokens(docs, PATH).count() == 0
    assert packing.pack_documents(docs, PATH).count() == 0
    assert simhash_dedup.near_duplicates(docs).count() == 0
    assert line_dedup.drop_boilerplate(docs).count() == 0
    assert passage_dedup.near_duplicate_passages(docs).count() == 0
    assert language_id.identify(docs, F.lit(True)).count() == 0
    assert html_extraction.extract(pages).count() == 0
    assert url_filter.judge_urls(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(vectors).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs, bench).count() == 0


def test_token_counts_equal_the_library(sample):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(sample, PATH).collect())
    want = []
    for r in sample.select("doc_id", "text").collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 512))
    assert got == sorted(want)


def test_other_tokenizers_count_by_the_library(sample):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {(r.doc_id, r.n_tokens) for r in tokens.count_tokens(sample, path).collect()}
    assert got == {(r.doc_id, len(library.encode(r.text or ""))) for r in sample.select("doc_id", "text").collect()}


def test_shortcut_on_random_strings():
    merger = tokens.Merger(PATH, tokens.prove_whole_tokens(PATH), False)
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\t\x1c\xa0 ab'sTtll12²½éß中文́.,!?-_\x00×ª") for _ in range(rng.randrange(14)))
        assert merger.encode(text) == len(merger.tok.encode(text, add_special_tokens=False).ids), repr(text)


def test_packing_is_gapless_and_whole(sample):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(sample, PATH).collect()
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for r in sample.dropDuplicates(["doc_id"]).select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        own = {p.piece: p for p in pieces[r.doc_id]}
        assert sum(p.length for p in own.values()) == len(ids)
        for p in own.values():
            part = ids[p.start : p.start + p.length]
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == p.ids_crc32
    assert len(bins) <= -(-sum(r.length for r in rows) // 1024) + 1


def test_plan_pairs_large_items():
    plan = packing.plan_bins({700: 3, 500: 2, 400: 5, 324: 3, 20: 50})
    assert sum(b.n * len(b.slots) for b in plan) == 63
    assert all(sum(s > 1024 // 3 for s, _, _ in b.slots) <= 2 for b in plan)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, linked):
    best = {i: i for i in ids}
    while True:
        before = dict(best)
        for a, b in linked:
            best[a] = best[b] = min(best[a], best[b])
        if best == before:
            return best


def test_simhash_against_all_pairs(sample):
    rows = {r.doc_id: plain_fingerprint(r.text) for r in sample.select("doc_id", "text").collect()}
    best = plain_components(rows, [(a, b) for a, b in itertools.combinations(rows, 2) if (rows[a] ^ rows[b]).bit_count() <= 3])
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(sample).collect()}
    assert got == {(i, f"{rows[i]:016x}", best[i]) for i in rows}


def test_trie_links_crowded_fingerprints(spark):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(4)]
    fps = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for c in centre for _ in range(150)} | {c ^ (1 << b) for c in centre for b in range(64)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = [(r.a, r.b) for r in simhash_dedup.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    both = lambda pairs: plain_components(signed, pairs)
    want = [(signed[i], signed[j]) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert both(links) == both(want)


def test_contamination_against_plain(spark, sample):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    base = words_of(1, 300)
    items = [(1, " ".join(base[20:60])), (2, "two"), (3, None), (10, " ".join(base[55:75])), (4, "CAFÉ Ünïcode 中文"), (5, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontamination.contamination(sample, bench).collect():
        got[r.doc_id] = (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
    for r in sample.select("doc_id", "text").collect():
        w, hit, who = cut(r.text), set(), set()
        for item, text in items:
            v = cut(text)
            n = min(10, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        who.add(str(item))
        digest = hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()
        assert got[r.doc_id] == (len(w), len(hit), len(who), digest, bool(hit)), r.doc_id
    left = {r.doc_id for r in decontamination.decontaminate(sample, bench).collect()}
    assert left == {i for i, x in got.items() if not x[4]}
    spans = decontamination.decontaminate(sample, bench, mode="spans").collect()
    assert len(spans) == sample.count() and len([r for r in spans if r.doc_id == 5][0].text.split()) == 1


def test_language_is_learned_and_rejected(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "to", "mi", "re"], "bb": ["scht", "öß", "ung", "ver"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(lang, 60), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    odd = [(1000, None, "aa"), (1001, "123 ²½", None), (1002, "zzxq wqxz qqjx xzzq jjqw " * 9, None), (1003, make("bb", 5), None), (1003, make("bb", 5), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, F.col("doc_id") % 3 != 1).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected and 0 <= got[i].score <= 1 for i, _, lang in rows)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert got[1002].rejected and got[1003].lang_pred == "bb" and not got[1003].rejected
    kept = {r.doc_id for r in language_id.keep_identified(docs, F.col("lang").isNotNull()).collect()}
    assert kept == {i for i, _, _ in rows} | {1003}


def test_html_extraction(spark):
    page = ('<html><head><title>no</title></head><body><nav><a href=x>menu</a></nav><div class="post-{0}"><h1>T&amp;{0}</h1><p>First <b>bo</b>ld'
            '<p>second&nbsp;  line<ul><li>one<li>two</ul><script>var x="<p>";</script><div class="comments"><p>rubbish</p></div></div>'
            '<div class="sidebar">bar</div><footer>foot</footer></body></html>')
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(6)] + [(7, None, None), (8, "x", ""), (9, "http://b/", "<a \""), (9, "http://b/", "<a \"")]
    got = {r.page_id: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "T&3\nFirst bold\nsecond line\none\ntwo" and got[3].n_chars == len(got[3].text)
    assert got[7].text == got[8].text == "" and got[7].n_chars == 0 and got[9].text == '<a "'
    short = page.format(1).replace("<h1>", "<!--").replace("</h1>", "-->")
    assert html_extraction.main_text(short, ["html/body/div.post-#"]).startswith("First bold")


def test_embedding_links_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    near = [base[k % 3] + 0.02 * rng.standard_normal(16) for k in range(45)]
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate([*base, *near])]
    rows += [(200 + i, r[1], r[2]) for i, r in enumerate(rows[:20])]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, rows[0][1], None), (305, [], 0), (306, [1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = {i: np.array(np.float32(v), dtype=float) for i, v, lab in rows if i < 300}
    labels = {i: lab for i, _, lab in rows}
    cos = lambda a, b: a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)
    links = [(a, b) for a, b in itertools.combinations(good, 2) if labels[a] == labels[b] and cos(good[a], good[b]) >= 0.98]
    best = plain_components([r[0] for r in rows], links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(vectors).collect()}
    assert got == {i: (sum(i in p for p in links), best[i], best[i] == i) for i in best}


def test_compact_windows_against_plain():
    rng = np.random.default_rng(1)
    for trial in range(200):
        v = rng.integers(trial % 2, rng.choice([3, 50, 10**9]), rng.integers(1, 100)).astype("uint64")
        width, want = int(rng.integers(1, 20)), set()
        for i in np.flatnonzero(v):
            a = b = i
            while a > 0 and v[a - 1] >= v[i]:
                a -= 1
            while b < len(v) - 1 and v[b + 1] >= v[i]:
                b += 1
            if b - a + 1 >= width:
                want.add((a, b, v[i]))
        left, c, right = passage_dedup.compact_windows(v, width)
        assert set(zip(left, right, v[c], strict=True)) == want and len(c) == len(want)


def near_runs(a, b, width, similarity):
    """Do any runs of that width share enough? Tries every start and stop of both."""
    a, b = a.tolist(), b.tolist()
    for s, p in itertools.product(range(len(a) - width + 1), range(len(b) - width + 1)):
        for e in range(s + width, len(a) + 1):
            one = set(a[s:e])
            for q in range(p + width, min(len(b), p + int((e - s) / similarity)) + 1):
                two = set(b[p:q])
                if len(one & two) >= similarity * len(one | two):
                    return True
    return False


def test_edited_passages_are_verified_wherever_the_edits_lie():
    width, met = 46, 0
    for length, at in itertools.chain(((50, k) for k in range(5, 45)), ((60, k) for k in range(60))):
        base = [f"w{k}" for k in range(length)]
        near = [*base[:at], "changed", *base[at + 1 :]]
        found = passage_dedup._segments(*(passage_dedup.shingle_hashes(" ".join(x)) for x in (base, near)), width, 0.8)
        assert found and found[0][4] >= 0.8, (length, at)
    for seed in range(120):
        rng = random.Random(seed)
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(50, 81))]
        near = list(base)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(near))
            near[at : at + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(2)
        a, b = (passage_dedup.shingle_hashes(" ".join(x)) for x in (base, near))
        found = passage_dedup._segments(a, b, width, 0.8)
        assert all(e - s >= width and q - p >= width and j >= 0.8 for s, e, p, q, j in found)
        if min(len(a), len(b)) < 58:
            assert bool(found) == near_runs(a, b, width, 0.8), seed
            met += bool(found)
    assert met > 5


def test_passages_are_found_and_others_left(sample):
    rows = passage_dedup.near_duplicate_passages(sample).collect()
    n = len(ODD)
    linked = {frozenset((r.doc_id, r.match_doc_id)) for r in rows}
    reach = plain_components(range(n, n + 5), [tuple(x) for x in linked])
    assert reach == {n: n, n + 1: n, n + 2: n, n + 3: n, n + 4: n + 4}
    assert all(r.stop - r.start >= 50 and r.similarity >= 0.8 for r in rows)


def test_passages_next_to_a_phrase_that_all_texts_share(spark):
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    phrase, rows = new(44), []
    for pair in range(400):
        passage = [*new(8), *phrase, *new(8)]
        edited = list(passage)
        edited[rng.choice([1, 2, 57, 58])] = "edit" + str(pair)
        rows += [(2 * pair, " ".join(new(40) + passage + new(40))), (2 * pair + 1, " ".join(new(25) + edited + new(60)))]
    rows += [(None, rows[0][1]), (5000, None), (5001, ""), rows[1], rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("rep", F.lit("x"))
    found = passage_dedup.near_duplicate_passages(docs).collect()
    assert {min(r.doc_id, r.match_doc_id) for r in found} == set(range(0, 800, 2))
    assert {abs(r.doc_id - r.match_doc_id) for r in found} == {1} and len(found) == 400


def test_passages_with_one_rare_shingle_beside_a_common_phrase(spark):
    rng = random.Random(19)
    new = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    phrase, rows = new(44), []
    for pair in range(60):
        passage = [*new(1), *phrase]  # 41 shared shingles of 46 and 46: Jaccard 0.804; without the first word 0.77
        rows += [(2 * pair, " ".join(new(40) + passage + new(40))), (2 * pair + 1, " ".join(new(25) + passage + new(60)))]
    found = passage_dedup.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(sorted((r.doc_id, r.match_doc_id))) for r in found} == {(2 * k, 2 * k + 1) for k in range(60)}


def test_passages_against_all_pairs(spark):
    rng = random.Random(4)
    new = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    kinds, texts = [new(rng.randrange(55, 90)) for _ in range(12)], []
    for i in range(120):
        passage = list(kinds[i % 12])
        for _ in range(rng.randrange(3)):
            passage[rng.randrange(len(passage))] = f"e{rng.randrange(4)}"
        texts.append(" ".join(new(rng.randrange(60)) + passage + kinds[(i + 1) % 12][:30] + new(rng.randrange(60))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    linked = [(r.doc_id, r.match_doc_id) for r in passage_dedup.near_duplicate_passages(docs).collect()]
    hashes = [passage_dedup.shingle_hashes(t) for t in texts]
    true = [(i, j) for i, j in itertools.combinations(range(120), 2) if passage_dedup._segments(hashes[i], hashes[j], 46, 0.8)]
    assert plain_components(range(120), linked) == plain_components(range(120), true)


def test_passages_whose_shingles_all_stand_in_a_third_text(spark):
    """Whichever text comes first: the third one has the passage in two pieces far apart, so it is nobody's partner."""
    rng = random.Random(8)
    new = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    rows = []
    for k in range(0, 90, 3):
        passage = new(50)
        rows += [(k, " ".join(new(9) + passage[:30] + new(60) + passage[26:] + new(9))), (k + 1, " ".join(new(40) + passage + new(40))), (k + 2, " ".join(new(25) + passage + new(60)))]
    found = passage_dedup.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(sorted((r.doc_id, r.match_doc_id))) for r in found} == {(k + 1, k + 2) for k in range(0, 90, 3)}


def test_passages_at_the_second_place_of_a_text(spark):
    """The first text of a shingle has it twice, first in a phrase, then in a passage that another text has too."""
    rng = random.Random(12)
    new = lambda n: [f"z{rng.randrange(10**7)}" for _ in range(n)]
    rows = []
    for k in range(0, 60, 2):
        passage = new(50)
        rows += [(k, " ".join(new(60) + passage[:28] + new(60) + passage[24:] + new(60) + passage + new(60))), (k + 1, " ".join(new(25) + passage + new(60)))]
    found = passage_dedup.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(sorted((r.doc_id, r.match_doc_id))) for r in found} == {(k, k + 1) for k in range(0, 60, 2)}


def test_shingles_that_can_lie_in_a_passage():
    rng = np.random.default_rng(5)
    for _ in range(100):
        t, pos, want = [], [], []
        for text in range(3):
            shared = np.flatnonzero(rng.random(rng.integers(1, 60)) < rng.choice([0.5, 0.75, 0.9]))
            in_run = np.zeros(60, dtype=bool)
            for s, e in itertools.combinations(range(70), 2):
                if e - s >= 10 and ((shared >= s) & (shared < e)).sum() >= 0.8 * (e - s) - 1e-9:
                    in_run[s:e] = True
            t, pos, want = t + [text] * len(shared), pos + shared.tolist(), want + in_run[shared].tolist()
        assert passage_dedup._eligible(np.array(t, dtype="int64"), np.array(pos, dtype="int32"), 10, 0.8).tolist() == want


def test_long_attributes_are_no_text():
    body = "<p>" + "A sentence of the article, with some words. " * 8 + "</p>"
    for quote in "\"'":
        long = f"<article><p data-x={quote}{'a > b ' * 5000}{quote}>First.</p>{body}</article>"
        blocks = [b[1] for b in html_extraction.parse(long).blocks]
        assert blocks[0] == "First." and len(blocks) == 2
    assert "After." in [b[1] for b in html_extraction.parse('<p title="never closed>One.</p>' * 1 + "<p>After.</p>").blocks]
    html_extraction.parse('<a x="' * 20_000)  # in linear time


def test_line_dedup_ignores_copies(spark):
    rows = [(i, f"shared line\nown line {i}\n\nmore {i}", "a") for i in range(20)] + [(100 + i, "copy one\ncopy two", "a") for i in range(9)]
    rows += [(200, None, None), (201, "", None), (202, "shared line", "b")]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3].text == "own line 3\n\nmore 3" and got[3].n_dropped == 1 and got[3].n_lines == 4
    assert got[101].text == "copy one\ncopy two" and got[202].text == "shared line"
    assert got[200].text is None and got[200].n_lines == 0 and got[201].text == ""


def test_urls_of_odd_form(spark):
    urls = [None, "", "nohost/path", "http://", "HTTP://A.Example.ORG:80/es/x?y#z", "http://example.org/en/12", "http://x.com?/fr/", "http://x.com/fr/a", "http://xcom/fr/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(9)] + [(7, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, labels).collect()}
    assert got[0][:3] == got[1][:3] == got[2][:3] == got[3][:3] == ("", "", None)
    assert got[4] == ("a.example.org:80", "/es/x", None, got[4][3]) and got[5][2:] == ("example.org/en/1", "block")
    assert got[6][:3] == ("x.com", "", None) and got[7][2:] == ("com/fr/", "allow") and got[8][2] is None


def test_pipeline_keeps_one_of_each_class(spark, tmp_path, sample):
    sample.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(words_of(4, 30_000)[50:90]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    n = len(ODD)
    assert {n, n + 3} <= kept and not {0, 1, 2, 3, n + 1, n + 2, n + 4} & kept
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(kept)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got, want = QUERIES[name](spark, folder).toPandas(), con.sql(ORACLES[name]).df()
    tidy = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert tidy(got) == tidy(want)
