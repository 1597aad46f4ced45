"""The corpus operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from magpie.llm import decontam, near_dup, packing, substring_dedup, suffix_dedup, token_store, tokens, url_rules, warc
from magpie.llm.host_quality import judge_hosts
from magpie.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, kept string, score int, node string, class string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, clashing extra columns."""
    r = random.Random(4)
    w = ["foo", "bar", "baz", "qux", "ünï", "a.", "b,", "c!"] + [f"w{i}" for i in range(60)]
    make = lambda n: " ".join(r.choices(w, k=n))
    common, base = make(60), make(120)
    texts = [None, "", " \t\n", "one", make(30), base, base, base.replace("foo", "fop", 2), common + " " + make(40), make(25) + "\n" + common, make(4000), "x " * 3000, "ab" * 2000, make(50) + "\x1f" + make(5), common]
    rows = [(i, t, "k", i, None, "c") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, base, "k", 1, "n", "c"), (-7, make(80), "", None, "", "")], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_substring(odd, none):
    rows = [(x.doc_id, (x.text or "").encode().split()) for x in odd.collect()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    got = substring_dedup.repeated_windows(odd).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and any(x[2] for x in want)
    assert substring_dedup.repeated_windows(none).count() == 0


def test_cover():
    for period, places in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in places for b in places} == set(range(period))


@pytest.mark.parametrize("hot", [256, 1])
def test_suffix(odd, none, hot):
    rows = [(x.doc_id, (x.text or "").encode()) for x in odd.collect()]
    seen = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    want = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want.append((i, len(t), int(gone.sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()))
    got = suffix_dedup.repeated_bytes(odd, hot=hot).select("doc_id", "n_bytes", "n_removed", "kept").collect()
    assert sorted(repr((a, b, c, bytes(d))) for a, b, c, d in got) == sorted(map(repr, want))
    assert suffix_dedup.repeated_bytes(none).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(150):
        t = rng.integers(97, 97 + rng.integers(1, 5), int(rng.integers(1, 100))).astype(np.uint8)
        assert suffix_dedup.suffix_array(t, None, 128).tolist() == sorted(range(len(t)), key=lambda i: t.tobytes()[i:])


def test_near_duplicates(odd, none):
    rows = [(x.doc_id, near_dup.shingle_set((x.text or "").encode(), 4)) for x in odd.collect()]
    sets = {i: set(s.tolist()) for i, s in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    for r in near_dup.near_duplicates(odd, 4).collect():
        assert (r.component_id, r.kept) == ((None, True) if r.doc_id is None else (root(r.doc_id), root(r.doc_id) == r.doc_id))
    assert near_dup.near_duplicates(none).count() == 0


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    for n in (1, 5, 200, 3000):
        a, b = (np.unique(rng.choice(pool, n)) for _ in "ab")
        unequal = int(np.unpackbits((near_dup.parities(a) ^ near_dup.parities(b)).view(np.uint8)).sum())
        assert unequal <= len(np.setxor1d(a, b)) and not (near_dup.parities(a) ^ near_dup.parities(a)).any()


def test_near_copies_that_are_no_links(spark):
    """A chain of links beside many copies just too different from everything: components as by brute force."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(i % 12):
            w[r.randrange(150)] = f"x{i}_{r.randrange(99)}"
        rows.append((i, " ".join(w)))
    sets = {i: set(near_dup.shingle_set(t.encode(), 4).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for _ in range(3):
        for a, b in combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4).collect()
    assert {x.doc_id: x.component_id for x in got} == root and 2 < len(set(root.values())) < 120


def test_tokens_and_shards(odd, none, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.byte_bpe())
    r = random.Random(2)
    texts = ["".join(r.choices(["a", " ", "\n", "é", "'s", "1", "the ", "\t", "<|endoftext|>", "日本"], k=r.randint(0, 25))) for _ in range(3000)]
    got = list(tokens.Encoder(tokens.byte_bpe()).encode(texts))
    assert got == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    x = np.array([0] * 500 + [5, 1 << 40, 7] + list(range(3000)), np.uint64)
    data = token_store.shard(x, np.array([len(x)]), 512)
    assert (token_store.unshard(data)[0] == x).all() and (token_store.unshard(data, range(1, 2))[0] == x[512:1024]).all()
    start = 0
    for row in sorted(token_store.token_store(odd, tokens.byte_bpe()).collect(), key=lambda r: r.start):
        assert row.start == start and len(row.ids) == 4 * row.n_tokens and bytes(row.ids)[-4:] == b"\0\0\0\0"
        start += row.n_tokens
    assert token_store.token_store(none, tokens.byte_bpe()).count() == 0


def test_packing(odd, none):
    p = packing.pack_documents(odd, tokens.byte_bpe()).toPandas()
    total = p.groupby("sequence_id").length.sum()
    assert (total <= 2048).all() and len(p) >= odd.count()
    p = p.sort_values(["sequence_id", "offset"])
    assert (p.offset == p.groupby("sequence_id").length.cumsum() - p.length).all()
    assert all(zlib.crc32(bytes(i)) == c and len(i) == 4 * n for i, c, n in zip(p.ids, p.ids_crc32, p.length, strict=True))
    assert packing.pack_documents(none, tokens.byte_bpe()).count() == 0
    rng = np.random.default_rng(0)
    demand = Counter(rng.integers(1, 65, 2000).tolist())
    used = Counter()
    for pattern, n in packing.patterns(dict(demand), 64):
        assert sum(a * b for a, b in pattern) <= 64
        for a, b in pattern:
            used[a] += b * n
    assert used == demand


def test_masks():
    n, gone = decontam.WINDOW, decontam.WINDOW - decontam.EQUAL
    for lost in combinations(range(n), gone):
        left = set(range(n)) - set(lost)
        assert any({m + s for m in mask} <= left for mask in decontam.MASKS for s in range(n - mask[-1]))


def test_contamination(spark, odd):
    item = " ".join(f"item{i}" for i in range(20))
    changed = item.replace("item4 ", "other ").replace("item9 ", "word ")
    docs = spark.createDataFrame([(1, "a b c " + changed.upper() + ", d"), (2, "nothing of it"), (3, None), (4, " ".join(f"item{i}" for i in range(9)))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short one")], "item_id long, text string")
    got = {r.doc_id: r.overlaps for r in decontam.contamination(docs, bench).collect()}
    assert [(o.item_id, o.start, o.end, o.equal) for o in got[1]] == [(7, 3, 23, 18)] and not (got[2] or got[3] or got[4])
    assert decontam.decontaminate(odd, bench).columns == odd.columns
    assert decontam.decontaminate(odd, bench.limit(0)).count() == odd.count()


def test_warc(spark, tmp_path):
    big, long = "x" * 1500, "é" * 400_000
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/ c\r\n", "small"), (4, "http://c", "small"), (5, "", None), (6, "http://d", long), (None, "http://e", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive(pages, f"file://{tmp_path}").collect()
    text = {}
    for r in sorted(got, key=lambda r: r.chunk_no):
        text[r.record_id] = text.get(r.record_id, b"") + bytes(r.data)
    last = {r.record_id: r for r in got if r.last}
    assert text[6].decode() == long and max(r.chunk_no for r in got) == 3 and all(r.digest == r.header_digest for r in last.values() if r.record_type == "response")
    assert {k: (r.record_type, r.refers_to, r.header_bytes) for k, r in last.items()} == {1: ("revisit", 2, 1500), 2: ("response", None, 1500), 3: ("response", None, 5), 4: ("response", None, 5), 5: ("response", None, 0), 6: ("response", None, 800_000), None: ("revisit", 2, 1500)}
    assert warc.archive(pages.limit(0)).count() == 0


def test_url_rules(spark):
    urls = [None, "no scheme", "http://Www.Example.ORG/es/1?x", "http://example.org/en/12#f", "http://a.com", "https://x.com/fr/a", "http://badcom/fr/", "http://org/x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://spam.net/a/{i}") for i in range(40)], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, 0, 0) for i in range(30)] + [(i, 1, None) for i in range(8)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.filter_urls(pages, labels, URL_RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(8)] == [("", "", None, "allow"), ("", "", None, "allow"), ("www.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("a.com", "", None, "allow"), ("x.com", "/fr/a", "com/fr/", "allow"), ("badcom", "/fr/", None, "allow"), ("org", "/x", "org/", "allow")]
    assert all(got[100 + i].verdict == "block" for i in range(40))
    assert url_rules.filter_urls(pages.limit(0), labels.limit(0), URL_RULES).count() == 0


def test_hosts(spark, odd, none):
    rows = [(i, "good words " + " ".join(f"w{k}" for k in range(60)), "fine") for i in range(200)] + [(200 + i, "same line\nsame line\n", "bad") for i in range(150)] + [(400, " ".join(f"v{k}" for k in range(60)), "bad"), (401, None, None)]
    got = {r.doc_id: r for r in judge_hosts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].kept and not got[200].kept and got[200].n_dup_lines == 1 and not got[400].base_failed and not got[400].kept and got[401].base_failed
    assert judge_hosts(odd, "node").count() == odd.count() and judge_hosts(none, "node").count() == 0


def test_quality(spark):
    from magpie.llm.mil_quality import score_quality, train
    from magpie.llm.queries import QUERIES

    got = QUERIES["op10_mil_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 5000)], "doc_id long, text string")
    blank = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert score_quality(docs, train(docs, labels)).where("score >= 0 AND score <= 1").count() == 3
    assert score_quality(blank, train(blank, labels)).count() == 0


def test_pipeline(spark, odd):
    import corpus_pipeline as p

    assert p.run(spark, SF).count() > 0
    docs = odd.select("doc_id", "text", "score")
    kept = p.near_dup(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in near_dup.near_duplicates(docs, 5).where("kept").collect()}
    for stage in (p.quality, p.suffix_dedup, p.decontamination):
        assert stage(spark, docs, SF).columns == docs.columns
    cut = {r.doc_id: r.text for r in p.suffix_dedup(spark, kept, SF).collect()}
    want = {r.doc_id: bytes(r.kept).decode(errors="ignore") for r in suffix_dedup.repeated_bytes(kept).collect() if r.n_removed}
    assert all(cut[i] == t for i, t in want.items() if i is not None)
