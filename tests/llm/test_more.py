"""More of the corpus operators: texts made to collide, fresh sessions, brute force, and the stages on odd rows."""

import gzip
import random
import subprocess
import sys
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from magpie.llm import decontam, hashing, mil_quality, near_dup, packing, store, substring_dedup, suffix_dedup, token_store, tokens, url_rules, warc

SF = "/root/testdata/sf0.001"
REPO = str(Path(__file__).parent.parent.parent)


def thue_morse(n: int) -> list[int]:
    return [bin(k).count("1") & 1 for k in range(n)]


def morse_texts(filler: int) -> list[str]:
    """Two texts that differ in every 128th byte, by a sequence and its complement; no window of 200 bytes is in both."""
    out = []
    for flip in (0, 1):
        fill = random.Random(filler)
        out.append("".join("ab"[x ^ flip] + "".join(fill.choices("cdefghij", k=127)) for x in thue_morse(64)))
    return out


def test_bytes_of_texts_that_differ_regularly_stay(spark):
    one, two = morse_texts(1)
    windows = Counter(t[i : i + 200] for t in (one, two) for i in range(len(t) - 199))
    assert max(windows.values()) == 1
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    for hot in (256, 1):
        assert [r.n_removed for r in suffix_dedup.repeated_bytes(docs, hot=hot).collect()] == [0, 0]


def test_words_of_texts_that_differ_regularly_stay(spark):
    r = random.Random(3)
    words = [("".join(r.choices("cdefghij", k=7)), x) for x in thue_morse(1024)]
    # the first letter of each word is the only difference
    texts = [" ".join("ab"[x ^ flip] + w for w, x in words) for flip in (0, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.n_removed for x in substring_dedup.repeated_windows(docs).collect()] == [0, 0]


def test_shingles_of_long_words_differ():
    r = random.Random(5)
    fill = ["".join(r.choices("cdefghij", k=7)) for _ in range(1024)]
    long = ["".join("ab"[x ^ flip] + w for x, w in zip(thue_morse(1024), fill, strict=True)).encode() for flip in (0, 1)]
    assert len(np.intersect1d(*(near_dup.shingle_set(t, 4) for t in long))) == 0
    # ranges at and beyond the longest one that has a polynomial, in the middle of very long texts
    x = np.random.default_rng(0).integers(97, 100, 3 * hashing.LONGEST + 500).astype(np.uint8)
    start = np.array([5, hashing.LONGEST - 3, 2 * hashing.LONGEST + 7, 9])
    end = start + np.array([50, 50, 50, hashing.LONGEST])
    for a, b, h in zip(start, end, hashing.Modular(x).ranges(start, end), strict=True):
        assert hashing.Modular(x[a:b].copy()).ranges(np.array([0]), np.array([b - a]))[0] == h


FRESH = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
from magpie.llm.queries import QUERIES
for name in sys.argv[1:]:
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    rows = QUERIES[name](spark, {SF!r}).count()
    print(name, rows)
    spark.stop()
"""


def test_each_operator_first_in_a_fresh_session(tmp_path):
    """Workers without the repository on their path get the package from the operator itself."""
    from magpie.llm.queries import QUERIES

    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYSPARK_PYTHON": sys.executable} | {k: v for k, v in __import__("os").environ.items() if k in ("JAVA_HOME", "SPARK_HOME", "PATH")}
    got = subprocess.run([sys.executable, "-c", FRESH, *QUERIES], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    assert got.returncode == 0, got.stderr[-2000:]
    assert [x.split()[0] for x in got.stdout.splitlines() if x.startswith("op")] == list(QUERIES)


def test_no_private_folder_on_a_cluster(monkeypatch):
    class Option:
        def isEmpty(self):  # noqa: N802
            return True

    class Context:
        master = "yarn"

        def getConf(self):  # noqa: N802
            return {}

        class _jsc:
            @staticmethod
            def sc():
                return type("", (), {"getCheckpointDir": staticmethod(Option)})

    spark = type("", (), {"sparkContext": Context(), "conf": type("", (), {"get": staticmethod(lambda *a: None)})})
    with pytest.raises(RuntimeError):
        store.shared_root(spark)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.byte_bpe())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def wild(seed: int, n: int) -> list:
    r = random.Random(seed)
    parts = ["a", " ", "\n", "é", "'s", "1", "the ", "\t", "<|endoftext|>", "日本", " b", " word", "  ", "　", ".\n", "�", "x" * 50]
    return [None, "", *("".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(n))]


def test_store_holds_the_librarys_ids(spark, library):
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(wild(1, 300))], "doc_id long, text string").repartition(5)
    got = sorted(token_store.token_store(docs, tokens.byte_bpe()).collect(), key=lambda r: r.start)
    want = sorted((r.doc_id, library(r.text)) for r in docs.collect())
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == [(i, [*ids, 0]) for i, ids in want]
    assert any(50256 in ids for _, ids in want)


@pytest.mark.parametrize(("memo", "size"), [(1_500_000, 1 << 21), (50, 200)])
def test_memo_and_batches_change_nothing(monkeypatch, library, memo, size):
    monkeypatch.setattr(tokens, "MEMO", memo)
    monkeypatch.setattr(tokens, "BATCH_BYTES", size)
    texts = [*wild(2, 400), " ".join(t or "" for t in wild(3, 100)), "plain words " * 300]
    e = tokens.Encoder(tokens.byte_bpe())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [library(t) for t in texts]


def test_packing_covers_every_document(spark, library):
    r = random.Random(6)
    texts = [*wild(4, 200), *(" ".join(r.choices(["foo", "bar", "qux"], k=n)) for n in (10, 500, 2047, 2048, 5000, 9000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = packing.pack_documents(docs, tokens.byte_bpe(), end=1, length=2048).collect()
    of = {i: [] for i in range(len(texts))}
    for x in rows:
        of[x.doc_id].append(x)
        assert zlib.crc32(bytes(x.ids)) == x.ids_crc32 and len(x.ids) == 4 * x["length"]
    for i, text in enumerate(texts):
        mine = sorted(of[i], key=lambda x: x.start)
        ids = np.concatenate([np.frombuffer(x.ids, "<u4") for x in mine]).tolist()
        assert ids == [*library(text), 1] and all(x.doc_tokens == len(ids) for x in mine)
        assert [x.start for x in mine] == np.cumsum([0, *(x["length"] for x in mine)])[:-1].tolist()
    sequences: dict = {}
    for x in rows:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    total = sum(x["length"] for x in rows)
    assert sorted(sequences) == list(range(len(sequences))) and len(sequences) <= total / 2048 + 2


def test_column_generation_reaches_its_bound():
    rng = np.random.default_rng(2)
    # sizes that fill sequences nearly without a rest, and some whose optimum is plain
    for demand, best in ((dict(Counter(rng.integers(1, 65, 20_000).tolist())), None), ({40: 1000, 30: 500, 24: 1000}, 1250), ({64: 5}, 5), ({33: 7}, 7)):
        made = packing.patterns(demand, 64)
        used = Counter()
        for pattern, n in made:
            assert sum(a * b for a, b in pattern) <= 64
            for a, b in pattern:
                used[a] += b * n
        least = best or sum(k * n for k, n in demand.items()) / 64
        most = least if best else 1.01 * least + len(demand) / 4
        assert used == demand and least <= sum(n for _, n in made) <= most


def test_overlaps_by_brute_force():
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(12)]
    for trial in range(60):
        item = r.choices(vocabulary if trial % 3 else ["a", "b"], k=r.randint(11, 40))
        text = r.choices(vocabulary, k=r.randint(0, 30))
        if trial % 2:
            part = item[r.randint(0, 5) :]
            part = [w if r.random() > 0.15 else "other" for w in part]
            at = r.randint(0, len(text))
            text[at:at] = part
        want = set()
        for d in range(-len(item), len(text)):
            for a in range(max(0, d), min(len(text), d + len(item)) - 12):
                if sum(text[k] == item[k - d] for k in range(a, a + 13)) >= 10:
                    want |= {(d, k) for k in range(a, a + 13)}
        found = decontam.SeedIndex([(7, " ".join(item))]).overlaps(decontam.word_hashes(" ".join(text)))
        covered = Counter(k for o in found for k in range(o["start"], o["end"]))
        assert covered == Counter(k for _, k in want), (item, text)


def test_repeated_words_on_both_sides(spark):
    import time

    index = decontam.SeedIndex([(1, "a " * 1000), (2, "a b " * 300)])
    began = time.time()
    found = index.overlaps(decontam.word_hashes("a " * 4000))
    assert {o["item_id"] for o in found} == {1} and len(found) == 4000 + 1000 - 1 - 2 * 12 and time.time() - began < 5


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x y", ["own"], 3, "t", 9)], "doc_id long, text string, overlaps array<string>, score int, _text string, __text int")
    bench = spark.createDataFrame([(1, "nothing of it at all, nothing of it here")], "item_id long, text string")
    assert decontam.decontaminate(docs, bench).collect() == docs.collect()
    assert decontam.contamination(docs, bench, into="found").columns == [*docs.columns, "found"]
    model = mil_quality.Model()
    got = mil_quality.score_quality(docs, model, into="quality")
    assert got.columns == [*docs.columns, "quality"] and got.drop("quality").collect() == docs.collect()


def test_gradients_are_slopes():
    rng = np.random.default_rng(4)
    m = mil_quality.Model()
    for name in m.NAMES:
        setattr(m, name, getattr(m, name) + rng.normal(0, 0.1, getattr(m, name).shape))
    sizes, y, weight = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0]), np.array([0.7, 1.5, 0.9])
    x = rng.normal(size=(6, mil_quality.WIDTH))

    def loss() -> float:
        p = m.forward(x, sizes)[6]
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / len(y))

    for name, grad in zip(m.NAMES, m.gradients(x, sizes, y, weight), strict=True):
        value = getattr(m, name)
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in value.shape)
            kept = value[at]
            value[at] = kept + 1e-5
            high = loss()
            value[at] = kept - 1e-5
            low = loss()
            value[at] = kept
            assert abs((high - low) / 2e-5 - grad[at]) < 1e-6


def test_fit_uses_every_passage_whatever_the_memory(spark, monkeypatch):
    """One bad passage among 40 good ones makes a document bad; only a fit on all passages can learn it."""
    r = random.Random(1)
    good = lambda n: " ".join("".join(r.choices("aeioubdgklmnprst", k=5)) for _ in range(n))
    rows, labels = [], []
    for i in range(120):
        text = good(40 * 170)
        if i % 2:
            at = r.randint(5000, 30_000)
            text = text[:at] + "#$%&" * 300 + text[at:]
        rows.append((i, text))
        labels.append((i, 1 - i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = mil_quality.train(docs, marks)
    monkeypatch.setattr(mil_quality, "FIT_BYTES", 1 << 20)
    monkeypatch.setattr(mil_quality, "EPOCHS", 2)
    small = mil_quality.train(docs, marks)
    monkeypatch.setattr(mil_quality, "FIT_BYTES", 1 << 30)
    large = mil_quality.train(docs, marks)
    assert all((getattr(small, n) == getattr(large, n)).all() for n in [*mil_quality.Model.NAMES, "mean", "scale"])
    got = {x.doc_id: x.score for x in mil_quality.score_quality(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 20 and sum((got[i] >= 0.5) == (i % 2 == 0) for i in held) >= 0.95 * len(held)


def test_mined_rules_are_the_frequent_sure_itemsets(spark):
    r = random.Random(2)
    hosts, paths = ["x.com", "y.net", "z.org"], ["a", "b", "c"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(paths)}/{r.choice(paths)}/{i}" for i in range(400)]
    bad = [("y.net" in u and "/b/" in u and r.random() < 0.9) or r.random() < 0.1 for u in urls]
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(urls)], "page_id long, url string, document long")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    items = [frozenset(x.t) for x in pages.select(url_rules.tokens_of(F.col("url")).alias("t")).collect()]
    share, sure = sum(bad) / len(bad), {}
    for size in range(1, max(map(len, items)) + 1):
        for s in {frozenset(c) for t in items for c in combinations(sorted(t), size)}:
            mine = [b for t, b in zip(items, bad, strict=True) if s <= t]
            n, p, z = len(mine), sum(mine) / len(mine), url_rules.SURE
            low = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
            if sum(mine) >= 20 and p >= 0.6 and low > share:
                sure[s] = p
    want = {s: p for s, p in sure.items() if not any(t < s and q >= p for t, q in sure.items())}
    got = {frozenset(x.antecedent): x.confidence for x in url_rules.mine(pages, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want) and any(len(s) > 1 for s in want)
    blocked = {x.page_id for x in url_rules.filter_urls(pages, labels, []).where("verdict = 'block'").collect()}
    assert blocked == {i for i, t in enumerate(items) if any(s <= t for s in want)} and 0 < len(blocked) < 200


def test_pages_take_the_label_of_their_document(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.com/en/{500 - i}.html?x=1") for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(500 - i, int(i % 2 == 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = url_rules.filter_urls(pages, labels, [], document=url_rules.document_of(F.col("url"))).collect()
    assert {x.page_id for x in got if x.verdict == "block"} == set(range(1, 100, 2))
    ends = spark.createDataFrame([("http://a/en/17",), ("http://a/en/17/#x",), ("http://a/b/c.html",), (None,), ("http://a/99999999999999999999",)], "url string")
    assert [x.d for x in ends.select(url_rules.document_of(F.col("url")).alias("d")).collect()] == [17, 17, None, None, None]


def test_archives_of_other_writers(spark, tmp_path):
    def record(kind, content, block, *more):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type:{kind}", f"Content-Type:   {content}", *more, f"Content-Length:{len(block)}"])
        return gzip.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    body = b"hello " * 60_000
    http = b"HTTP/1.0  200   OK\r\nX-Long: one\r\n  two\r\nServer:x\r\n\r\n"
    data = record("warcinfo", "application/warc-fields", b"software: x\r\n") + record("request", "application/http", b"GET / HTTP/1.0\r\n\r\n")
    data += record("response", "application/http; msgtype=response", http + body, "WARC-Record-ID: <urn:page:7>", "WARC-Target-URI: http://a/") + record("response", "text/dns", b"a 1")
    data += record("metadata", "text/plain", b"") + record("response", "application/http", http, "WARC-Record-ID: <urn:uuid:1-2>")
    (tmp_path / "x.warc.gz").write_bytes(data)
    got = warc.read_warc(spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "file string")).orderBy("chunk_no").collect()
    mine = [r for r in got if r.record_id == 7]
    assert b"".join(bytes(r.data) for r in mine) == body and mine[-1].last and mine[-1].header_bytes is None and mine[0].target_uri == "http://a/"
    assert [(r.payload_bytes, r.last) for r in got if r.record_id is None] == [(0, True)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, overlaps int, identity string, sha string, kept int, place int, `__text` string"


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    make = lambda n: " ".join(r.choices(words, k=n))
    common, copy = "é" + make(60) + " �", make(90)
    texts = [(1, None), (2, ""), (3, "x�" + common + "日" + make(30)), (None, make(20) + common), (4, make(30) + common[1:]), (5, copy), (6, copy), (7, copy + " more"), (8, make(70)), (8, make(71)), (8, None), (None, copy), (None, None), (9, make(3000)), (9, "again " + copy)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "i", "s", 3, 4, "own") for i, t in texts], DOCS).repartition(3)


def test_suffix_stage_on_odd_rows(spark, rows):
    before = [(x.doc_id, x.text) for x in rows.collect()]
    seen = Counter(t[i : i + 200] for _, text in before for t in [(text or "").encode()] for i in range(len(t) - 199))
    want = []
    for i, text in before:
        t = (text or "").encode()
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        at, out = 0, []
        for c in text or "":
            n = len(c.encode())
            if not gone[at : at + n].any():
                out.append(c)
            at += n
        new = "".join(out) if gone.any() else text
        want.append((i, new, len(new) if gone.any() else len(text or "")))
    got = pipeline.suffix_dedup(spark, rows, SF)
    assert got.columns == rows.columns and Counter((x.doc_id, x.text, x.n_chars) for x in got.collect()) == Counter(want)
    assert any(x and "�" in x for _, x, _ in want) and sum(x != t for (_, x, _), (_, t) in zip(want, before, strict=True)) >= 5


def test_near_dup_stage_on_odd_rows(spark, rows):
    got = pipeline.near_dup(spark, rows, SF)
    assert got.columns == rows.columns
    kept = Counter((x.doc_id, x.text) for x in got.collect())
    texts = [(x.doc_id, x.text) for x in rows.collect()]
    assert sum(n for (i, _), n in kept.items() if i is None) == 3
    assert {i for i, _ in kept if i is not None} == {1, 2, 3, 4, 5, 8, 9} and all(n == 1 for n in kept.values())
    # of one id the largest text, whatever the order of the rows
    for i in (8, 9):
        assert [t for j, t in kept if j == i] == [max(t for j, t in texts if j == i and t)]
    again = Counter((x.doc_id, x.text) for x in pipeline.near_dup(spark, rows.repartition(7, "text"), SF).collect())
    assert again == kept


def test_other_stages_on_odd_rows(spark, rows, library):
    whole = Counter(tuple(x) for x in rows.collect())
    got = pipeline.decontamination(spark, rows, SF)
    assert got.columns == rows.columns and Counter(tuple(x) for x in got.collect()) == whole
    bench = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = rows.limit(1).withColumn("text", F.lit("so " + bench[0] + " end")).unionByName(rows)
    assert Counter(tuple(x) for x in pipeline.decontamination(spark, dirty, SF).collect()) == whole
    got = pipeline.quality(spark, rows, SF)
    model = mil_quality.train(rows, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = mil_quality.score_quality(rows, model, into="q")
    assert got.columns == rows.columns and Counter(tuple(x) for x in got.collect()) == Counter(tuple(x)[:-1] for x in scored.collect() if x.q >= 0.5)
    packed = pipeline.packing(spark, rows, SF).collect()
    want = Counter()
    for x in rows.collect():
        ids = [*library(x.text), 1]
        for k in range(0, len(ids), 2048):
            want[(x.doc_id, k, tuple(ids[k : k + 2048]))] += 1
    assert Counter((x.doc_id, x.start, tuple(np.frombuffer(x.ids, "<u4").tolist())) for x in packed) == want


def test_stages_on_empty_tables(spark, rows):
    none = rows.limit(0)
    for name, stage in pipeline.STAGES:
        got = stage(spark, none, SF)
        assert got.count() == 0 and (name == "packing" or got.columns == rows.columns)


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SIDE", 4)
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 10):
            w[r.randrange(120)] = f"x{i}_{r.randrange(99)}"
        texts.append((i, " ".join(w)))
    sets = {i: set(near_dup.shingle_set(t.encode(), 4).tolist()) for i, t in texts}
    root = {i: i for i in sets}
    for _ in range(3):
        for a, b in combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), 4).collect()
    assert {x.doc_id: x.component_id for x in got} == root and 2 < len(set(root.values())) < 60


@pytest.mark.parametrize("n", range(1, 15))
def test_short_items_with_all_changes(n):
    item = [f"item{i}" for i in range(n)]
    index = decontam.SeedIndex([(7, " ".join(item))])
    size = min(n, decontam.WINDOW)
    # as many changes as the share of equal words allows, and one more
    allowed = size - -(-10 * size // 13)
    for gone in range(allowed + 2):
        for lost in combinations(range(n), gone):
            if n > size and gone > allowed:
                continue
            changed = ["other" if i in lost else x for i, x in enumerate(item)]
            for before, after in ((0, 0), (3, 0), (0, 2)):
                found = index.overlaps(decontam.word_hashes(" ".join(["a"] * before + changed + ["b"] * after)))
                assert bool(found) == (gone <= allowed), (n, lost, before, after)
    assert not decontam.SeedIndex([(7, "")]).overlaps(decontam.word_hashes("a b"))
