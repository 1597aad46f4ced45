"""Sources, sinks, the facade, streams and pixels, on small made-up inputs."""

import io
import json
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from magpie.config import SearchConfig
from magpie.embedders import HashEmbedder, embed
from magpie.functions import paths as P
from magpie.functions import vectors as V
from magpie.operators import knn, pixels, tables, votes
from magpie.plans.fixtures import Tables
from magpie.session import Search
from magpie.sources import files
from magpie.streaming import changes
from magpie.streaming.votes import finish, stream_votes, total_votes

SF = "/root/testdata/sf0.001"


def png(image: np.ndarray, kind: int) -> bytes:
    """A PNG whose rows all use one filter."""
    h, w = image.shape[:2]
    depth = 1 if image.ndim == 2 else image.shape[2]
    flat = image.reshape(h, w * depth).astype(int)
    left = np.pad(flat, ((0, 0), (depth, 0)))[:, :-depth]
    up = np.pad(flat, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(left, ((1, 0), (0, 0)))[:-1]
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    guess = [0 * flat, left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))][kind]
    rows = np.hstack([np.full((h, 1), kind), (flat - guess) % 256]).astype(np.uint8)
    piece = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\0" * 4
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[depth], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", head) + piece(b"IDAT", zlib.compress(rows.tobytes())) + piece(b"IEND", b"")


@pytest.fixture
def tree(tmp_path):
    rng = np.random.default_rng(0)
    for name in ("b/one.PNG", "a/two.jpg", "a/three.png", "a/x/four.webp"):
        at = tmp_path / "tree" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(rng.bytes(100))
    (tmp_path / "tree" / "a" / "notes.txt").write_text("no image")
    return tmp_path / "tree"


def test_image_tree_and_folders(spark, tree):
    got = files.images(spark, str(tree)).collect()
    names = [r.path.split("/tree/")[1] for r in got]
    assert names == ["a/three.png", "a/two.jpg", "a/x/four.webp", "b/one.PNG"] and len(got[0].content) == 100
    assert "content" not in files.images(spark, str(tree), False).columns
    rows = files.folders(files.images(spark, str(tree), False)).collect()
    assert sorted((r.folder.rpartition("/")[2], r.files, r.bytes) for r in rows) == [("a", 2, 200), ("b", 1, 100), ("x", 1, 100)]
    one = files.image(spark, data=b"abc").first()
    assert one.path is None and bytes(one.content) == b"abc"
    assert files.image(spark, str(tree / "a" / "two.jpg")).count() == 1


def test_bundles(spark, tmp_path):
    rng = np.random.default_rng(1)

    def save(name, **arrays):
        data = io.BytesIO()
        np.savez(data, **arrays)
        (tmp_path / name).write_bytes(data.getvalue())

    d, p = rng.random((5, 128)), rng.random((5, 2)) * 50
    save("full.npz", descriptors=d, keypoints=p, image_size=np.array([40, 60]))
    save("plain.npz", arr_0=np.zeros((3, 2)), arr_1=d)
    save("points.npz", descriptors=d, keypoints=p)
    save("bad.npz", descriptors=np.zeros((4, 7)))
    (tmp_path / "broken.npz").write_bytes(b"PK nothing")
    rows = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rpartition("/")[2]: r for r in files.features(rows).collect()}
    assert (got["full.npz"].n, got["full.npz"].width, got["full.npz"].height) == (5, 60, 40)
    assert np.allclose(got["full.npz"].descriptors, d, atol=1e-6) and got["plain.npz"].points is None
    assert got["points.npz"].width == int(np.ceil(p[:, 0].max()))
    assert all(got[k].n is None and got[k].error for k in ("bad.npz", "broken.npz"))


def test_lists_ids_and_keys(spark, tmp_path):
    (tmp_path / "list.txt").write_text("one\tx\n\n  two \nthree\n")
    assert [r.item for r in files.lines(spark, str(tmp_path / "list.txt")).collect()] == ["one", "two", "three"]
    (tmp_path / "list.json").write_text(json.dumps(["b", "a"]))
    assert [tuple(r) for r in files.json_list(spark, str(tmp_path / "list.json")).collect()] == [(0, "b"), (1, "a")]
    assert [r.item for r in files.listed(" a,, b ", spark).collect()] == ["a", "b"]
    vectors = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "chunk long, pos int")
    ids = spark.createDataFrame([(1, [7, 9])], "chunk long, ids array<long>")
    assert sorted((r.pos, r.compact_id) for r in files.ids(ids, vectors, "chunk").fillna(-1).collect()) == [(0, 7), (1, 9), (2, -1)]
    keys = spark.createDataFrame([(1,), (1,), (5,)], "pos int")
    assert [r.pos for r in files.by_keys(vectors, keys, "pos").collect()] == [1]


def test_chunks_are_replaced_alone(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30)], "collection string, chunk_no int, n int")
    tables.write_chunks(rows, str(tmp_path / "t"))
    tables.replace_partitions(spark.createDataFrame([("a", 2, 21), ("a", 2, 22)], rows.schema), str(tmp_path / "t"), ("collection", "chunk_no"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(tuple(r) for r in back.select("collection", "chunk_no", "n").collect()) == [("a", 1, 10), ("a", 2, 21), ("a", 2, 22), ("b", 1, 30)]
    plan = back.where("collection = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection" in plan
    assert tables.snapshot(rows, str(tmp_path / "copy")).first().ok


def test_numbered_has_ties_of_groups_and_empty_tables(spark):
    rows = spark.createDataFrame([(i % 3, (i * 37) % 100) for i in range(100)], "g long, x long")
    got = tables.numbered(rows, ["x"], ("g",)).collect()
    for g in range(3):
        mine = sorted(r.x for r in got if r.g == g)
        assert {r.x: r.place for r in got if r.g == g} == {x: k + 1 for k, x in enumerate(mine)}
    assert tables.numbered(rows.limit(0), ["x"]).count() == 0


def test_titles_paths_and_codecs(spark):
    names = ["A [b] (c) -- by d", "A", " x_y; z & w", "w " * 80, "nospace" * 30]
    rows = spark.createDataFrame(list(enumerate(names)), "i long, name string")
    got = [r.title for r in P.unique_titles(rows, "name", "i").orderBy("i").collect()]
    assert got == ["A", "A 2", "x y z and w", ("w " * 50).strip(), ("nospace" * 30)[:100]]
    halves = spark.createDataFrame([([0.5, -1.0, 0.1],), (None,), ([],)], "v array<float>").withColumn("w", V.unpack_halves(V.pack_halves(F.col("v"))))
    out = halves.select("w", V.same_within(F.col("v"), F.col("w"), 1e-3).alias("ok"), V.same_within(F.col("v"), F.col("w"), 1e-9).alias("exact")).collect()
    assert [(r.ok, r.exact) for r in out] == [(True, False), (False, False), (True, True)]


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    for image in (rng.integers(0, 256, (7, 9)), rng.integers(0, 256, (5, 6, 3))):
        assert (pixels.decode(png(image, kind)) == image).all()
    four = rng.integers(0, 256, (4, 4, 4))
    assert (pixels.decode(png(four, kind)) == four[..., :3]).all()


def test_other_pixels():
    image = np.arange(24, dtype=np.uint8).reshape(4, 6)
    assert (pixels.decode(b"P5 # note\n6 4\n255\n" + image.tobytes()) == image).all()
    with pytest.raises(ValueError):
        pixels.decode(b"GIF89a")
    assert pixels.grey(np.full((2, 2, 3), 100, np.uint8)).tolist() == [[100, 100], [100, 100]]
    assert (pixels.resize(np.full((10, 8), 7, np.uint8), 3, 5) == 7).all()
    assert pixels.resize(np.array([[0, 100], [100, 200]], np.uint8), 1, 1).tolist() == [[100]] and pixels.resize(image, 8, 12).shape == (8, 12)
    rng = np.random.default_rng(5)
    page = rng.integers(0, 256, (90, 120)).astype(np.uint8)
    best = pixels.template(page, pixels.resize(page[10:50, 20:70], 80, 100), scales=(0.5, 1.0))
    assert (best["y"], best["x"], best["scale"]) == (10, 20, 0.5) and best["score"] > 0.7
    a, b, c = pixels.correlate(page, page[5:30, 7:40], centred=False)
    assert a == pytest.approx(1) and (b, c) == (5, 7)


def test_broken_images_are_reported(spark, tree):
    class Careful(HashEmbedder):
        def image(self, data):
            if data[:1] < b"\x40":
                raise ValueError("broken")
            return super().image(data)

    rows = spark.createDataFrame([("a", bytearray(b"\x50x")), ("b", bytearray(b"\x10")), ("c", None)], "path string, content binary")
    got = {r.path: r for r in embed(rows, "content", Careful()).collect()}
    assert len(got["a"].embedding) == 64 and got["b"].error == "broken" and got["c"].embedding is None


def place(spark):
    """Two planted pages: one holds the query moved by half its size, one only its descriptors."""
    rng = np.random.default_rng(8)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(n, 16)))
    q, at = unit(40), rng.random((40, 2)) * 100
    rows = []
    for page, vectors, points in ((1, q, at * 0.5 + 20), (2, q, rng.random((40, 2)) * 300), (3, unit(40), at)):
        rows += [(page, page * 100 + i, 0, "books", v.tolist(), float(x), float(y)) for i, (v, (x, y)) in enumerate(zip(vectors, points, strict=True))]
    side = spark.createDataFrame(rows, "page_id long, vec_id long, chunk_no long, collection string, v array<double>, x double, y double")
    queries = spark.createDataFrame([(0, i, v.tolist(), float(x), float(y), 100.0, 100.0, float(i)) for i, (v, (x, y)) in enumerate(zip(q, at, strict=True))], "query_id long, kp long, q array<double>, x double, y double, w double, h double, norm double")
    lookup = spark.createDataFrame([(1, "B/z.jpg"), (2, "B/a.jpg"), (3, "B/c.jpg")], "page_id long, path string")
    return side, queries, lookup


def test_localised_search(spark):
    side, queries, lookup = place(spark)
    search = Search(spark, {"keypoints": side, "path_lookup": lookup, "exclusions": spark.createDataFrame([], "path string")}, config=SearchConfig(threshold=0.9, max_keypoints=30))
    plain = search.keypoint_search(queries).orderBy("rank").collect()
    # equal votes: the path decides; 30 of the 40 keypoints count
    assert [(r.path, r.votes) for r in plain] == [("B/a.jpg", 30), ("B/z.jpg", 30)]
    got = search.keypoint_search(queries, localise=True).orderBy("rank").collect()
    assert [r.path for r in got] == ["B/z.jpg", "B/a.jpg"] and got[0].inliers == 30 and got[0].prior == 2
    assert abs(got[0].x1 - 20) < 1 and abs(got[0].y2 - 70) < 1
    assert search.keypoint_search(queries, collections=["none"]).count() == 0 and search.keypoint_search(queries, chunks=[0]).count() == 2
    search.exclude(["b\\Z.jpg", "B/z.jpg/"])
    assert search.tables["exclusions"].count() == 1
    assert [r.path for r in search.keypoint_search(queries).collect()] == ["B/a.jpg"]
    search.include(["B/Z.JPG"])
    assert search.tables["exclusions"].count() == 0
    seed = spark.createDataFrame([(0, 3, 99)], "query_id long, page_id long, votes long")
    assert search.resume(queries, seed=seed).orderBy("rank").first().path == "B/c.jpg"


def test_index_history_and_queue(spark, tree):
    empty = spark.createDataFrame([], "vec_id long, collection string, path string, v array<double>")
    history = spark.createDataFrame([(1, "in_progress", "DISK", "2020-01-01", None), (2, "completed", "text", "2020-01-02", "2020-01-03")], "id long, status string, type string, started string, ended string")
    history = history.withColumns({"started": F.col("started").cast("timestamp"), "ended": F.col("ended").cast("timestamp"), "date": F.col("started").cast("timestamp")})
    results = spark.createDataFrame([], "history_id long, rank int, path string, votes long, score double")
    jobs = spark.createDataFrame([(1, 5, "queued"), (2, 4, "queued"), (3, 1, "done")], "job_id long, ts long, state string")
    search = Search(spark, {"vectors": empty, "search_history": history, "search_results": results, "jobs": jobs, "collections": spark.createDataFrame([("b", 2), ("a", 1)], "name string, priority int")}, HashEmbedder())
    rows = search.index(str(tree), "books")
    search.add_to_index(rows)
    known = {(r.vec_id, r.path) for r in search.tables["vectors"].collect()}
    search.add_to_index(search.index(str(tree), "books"))
    assert {(r.vec_id, r.path) for r in search.tables["vectors"].collect()} == known and {i for i, _ in known} == {0, 1, 2, 3}
    data = (tree / "a" / "two.jpg").read_bytes()
    best = search.image_search(data, 2).first()
    assert best.path.endswith("two.jpg") and best.score == pytest.approx(1)
    assert search.text_search("words", 3).count() == 3 and search.stats().first().vectors == 4
    assert search.search_all(data, 2).where("rank = 1").first().vec_id == best.vec_id
    assert search.results(search.image_search(data, 4)).first().metadata.filename == "two.jpg"
    assert [r.name for r in search.collections().collect()] == ["a", "b"]
    ranked = spark.createDataFrame([(k, f"p{k}", 10, 0.5) for k in range(1, 30)], "rank int, path string, votes long, score double")
    assert search.store_results(1, ranked).count() == 20 and search.store_results(1, ranked.where("rank < 3")).count() == 2
    assert json.loads(search.results_json(1).first().json) == {"rank": 1, "path": "p1", "votes": 10, "score": 0.5}
    search.set_status(spark.createDataFrame([(1, "stopped"), (2, "failed")], "id long, status string").withColumn("ts", F.lit("2020-02-01").cast("timestamp")))
    assert {r.id: r.status for r in search.history().collect()} == {1: "stopped", 2: "completed"}
    search.delete_history(spark.createDataFrame([(1,)], "id long"))
    assert search.history().count() == 1 and search.history_detail(1).count() == 0
    assert [(r.job_id, r.position) for r in search.queue_info().where("state = 'queued'").collect()] == [(2, 1), (1, 2)]


def test_faces(spark):
    e = HashEmbedder()
    data = b"ab"
    rows = [(s, k, v) for s, d in ((1, b"ab"), (2, b"xy")) for k, v in enumerate(e.faces(d))]
    faces = spark.createDataFrame(rows, "source_image long, vec_id long, v array<double>")
    got = Search(spark, {"faces": faces}, e).face_search(data, 5, 0.9).collect()
    assert [(r.source_image, r.faces) for r in got] == [(1, 2)]


def test_approximate_recall(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    centres, cells = knn.cells(t.keypoints(), 24)
    near = {tuple(r) for r in knn.probe(t.queries(), centres, cells, 10, 18).select("kp", "vec_id").collect()}
    want = {tuple(r) for r in knn.top_matches(t.queries(), t.keypoints(), 10, None, "global").select("kp", "vec_id").collect()}
    assert len(near & want) >= 0.9 * len(want) and cells.count() == t.keypoints().count()


def test_stream_snapshots_stop_and_clear(spark, tmp_path):
    t = Tables(spark, SF)
    side, config = t.keypoints(), SearchConfig(threshold=0.25, stored_top=5)
    for c in range(4):
        side.where(F.col("chunk_no") == c).coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
        time.sleep(0.02)
    queries = t.queries(True).cache()
    gone = queries.where("query_id = 1").select("query_id").distinct()
    seen = []
    out, mark, leaders = (str(tmp_path / x) for x in ("out", "cp", "leaders"))
    start = lambda **kw: stream_votes(spark, str(tmp_path / "chunks"), side.schema, queries, out, mark, config, progress=seen.append, leaders=leaders, **kw)
    assert not finish(spark, start(), mark, stop=lambda: len(seen) >= 1) and (tmp_path / "cp").exists()
    assert finish(spark, start(stopped=lambda: gone), mark) and not (tmp_path / "cp").exists()
    assert sorted(set(seen)) == list(range(4))
    got = {(r.query_id, r.page_id): r.votes for r in total_votes(spark, out).collect()}
    want = {(r.query_id, r.page_id): r.votes for r in votes.votes(knn.top_matches(queries, side, 5, 0.25)).collect()}
    rest = {k: n for k, n in want.items() if k[0] != 1}
    assert {k: n for k, n in got.items() if k[0] != 1} == rest and sum(n for k, n in got.items() if k[0] == 1) <= sum(n for k, n in want.items() if k[0] == 1)
    last = {(r.query_id, r.page_id): r.votes for r in spark.read.parquet(leaders).where("step = 3").collect()}
    first = sorted((k for k in got if k[0] == 0), key=lambda k: (-got[k], k[1]))[:5]
    assert {k for k in last if k[0] == 0} == set(first)


def test_new_files_are_seen(spark, tree):
    query = changes.watch(spark, str(tree / "a")).writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    query.awaitTermination(60)
    names = {r.path.rpartition("/")[2] for r in spark.sql("SELECT path FROM watched").collect()}
    assert names == {"two.jpg", "three.png", "notes.txt"}


def test_events_on_a_stream_and_dry_runs(spark):
    rows = spark.createDataFrame([("a/x",), ("b/x",)], "path string")
    same, count = changes.apply_event(rows, "path", "delete", "a/", dry=True)
    assert same.count() == 2 and count.first().touched == 1
    got = tables.delete_where({"s": rows}, "path", ["a/"], dry=True)["s"]
    assert got[0].count() == 2 and tuple(got[1].first()) == ("s", "dry run", 1)


def test_command_line(spark, tree, tmp_path, capsys):
    from magpie.__main__ import main

    at = str(tmp_path / "vectors")
    main(["index", at, str(tree / "a"), "books"])
    main(["add", at, str(tree), "books"])
    main(["stats", at])
    main(["search", at, str(tree / "b" / "one.PNG"), "--top", "1"])
    text = capsys.readouterr().out
    assert "one.PNG" in text and "|books     |4" in text


def test_parts_without_the_corpus_operators():
    import ast
    from pathlib import Path

    root = Path(__file__).parent.parent / "magpie"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            for node in ast.walk(ast.parse(file.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), file
