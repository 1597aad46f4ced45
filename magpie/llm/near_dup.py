"""Near-duplicate groups by an inverted join of MinHash coordinates.

A signature has 64 coordinates, each made of 5 minima. Every distinct shingle set is posted under
its (coordinate, value) pairs; sets at a Jaccard similarity of 0.8 agree in a coordinate with
probability 0.33, so in at least 4 of the 64 in all but about 5 in 100 million cases.

* Equal sets are one class from the start and posted once.
* A pair with 4 agreements has one among any 61 coordinates, so only in those lists do members meet the first
  of their list (prefix).
* What is a set's own, shingles that no other set in the lists has, bounds its similarity with any
  other from above; pairs beyond the bound are never formed.
* In each list, members are first compared with one of them only, that with the least of its own;
  full sets confirm each link.
* Members of the largest component of a list need no comparison with each other (skip). All other
  pairs of a list whose components differ and whose parities allow a link are counted over the
  lists, and those with enough agreements are confirmed on full sets too. So no link between
  components is left out, however long a list is, and a list of many near copies costs about its
  length. Long lists are compared in blocks of ``SIDE`` members, so none meets in one task.
* Parities: a set has one bit for each of 512 ranges of hashes, whether it has an odd number of them
  there. Two sets differ in at least as many shingles as they have unequal bits, so the bits bound
  the similarity from above, and only pairs at or just below the threshold remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, digest, mix
from .store import release, save, ship

COORDINATES, ROWS, MATCHES = 64, 5, 4
#: Members of a list that meet in one group.
SIDE = 1000
_rng = np.random.default_rng(77)
_A = (_rng.integers(0, 1 << 31, COORDINATES * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))
_B = _rng.integers(0, 1 << 32, COORDINATES * ROWS, dtype=np.uint32)
_STEP = 192
PARITY_BITS = 9


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; with fewer words, the whole sequence is one."""
    words = Words(text.lower())
    return np.unique(words.windows(min(size, words.n))) if words.n else np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """Coordinate values of a non-empty set; the coordinate is part of the value."""
    x = ((s >> np.uint64(32)) ^ (s & np.uint64(0xFFFFFFFF))).astype(np.uint32)
    low = np.full(COORDINATES * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), _STEP):
        np.minimum(low, (x[k : k + _STEP, None] * _A + _B).min(axis=0), out=low)
    out = np.arange(COORDINATES, dtype=np.uint64)
    for column in low.reshape(COORDINATES, ROWS).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def parities(s: np.ndarray) -> np.ndarray:
    """Whether a set has an odd number of hashes in each range of 2**PARITY_BITS, as bits of 64-bit words."""
    odd = np.bincount((s >> np.uint64(64 - PARITY_BITS)).astype(np.int64), minlength=1 << PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for t in batch.column(1):
        t = t.as_py()
        yield b"" if t is None else t.encode()


def _signed(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, signs = [], [], [], []
            for text in _texts(batch):
                s = shingle_set(text, size)
                n.append(len(s))
                a, b = digest(s.tobytes())
                one.append(a)
                two.append(b)
                signs.append(signature(s) if len(s) else s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), _lists(signs)], names=["doc_id", "n_shingles", "s1", "s2", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, sig array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets), _lists([parities(x) for x in sets])], names=["node", "set", "parity"])

    return docs.mapInArrow(run, "node long, set array<long>, parity array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one, two = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    na, nb = F.size("set_a"), F.size("set_b")
    close = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    both = F.size(F.array_intersect("set_a", "set_b"))
    # the sizes are compared first: they decide most pairs
    linked = F.when(close, 100 * both >= percent * (na + nb - both)).otherwise(False)
    return pairs.join(two, "b").join(one, "a").where(linked).select("a", "b")


def _bounds(sets: DataFrame, percent: int) -> DataFrame:
    """(node, size, own) of the nodes that can have a link at all; own: shingles that no other node here has."""
    once = sets.select("node", F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    own = once.groupBy("node").agg(F.count("*").alias("own"))
    sizes = sets.groupBy("node").agg(F.max(F.size("set")).cast("long").alias("size"))
    out = sizes.join(own, "node", "left").select("node", "size", F.coalesce("own", F.lit(0)).alias("own"))
    return out.where(100 * (F.col("size") - F.col("own")) >= percent * F.col("size"))


def _possible(own: str, size: str, own2: str, size2: str, percent: int):
    """Whether two sets can be similar enough, from what is each one's own."""
    most = F.least(F.col(size) - F.col(own), F.col(size2) - F.col(own2))
    return 100 * most >= percent * (F.col(size) + F.col(size2) - most)


def _alike(parity: str, size: str, parity2: str, size2: str, percent: int):
    """Whether two sets can be similar enough, from the ranges in which their parities differ."""
    words = range(1 << PARITY_BITS - 6)
    unequal = sum((F.bit_count(F.col(parity)[k].bitwiseXOR(F.col(parity2)[k])) for k in words), F.lit(0))
    return (100 + percent) * unequal <= (100 - percent) * (F.col(size) + F.col(size2))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of the edges (a, b); component: its smallest node.

    Alternating large and small stars; each step is a minimum per node and a join, written once.
    """
    edges = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        edges = save(small, "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by 100 x intersection >= percent x union of their word shingles.

    docs: doc_id, text; other columns are ignored. A-Z are lower-cased; words are
    ``[^\\x20\\x09-\\x0D]+``; with fewer words than a shingle the whole sequence is one shingle;
    texts without words (null, empty) have the empty set and are linked with nothing. Rows of one
    doc_id are one document; rows whose doc_id is null are linked with nothing and kept, with a
    null component. Returns per row doc_id, n_shingles, component_id (smallest doc_id reachable)
    and kept (doc_id = component_id: one document of each group).
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = save(_signed(docs, shingle), "signatures", codec="lz4")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
    classes = save(classes, "classes")
    reps = signed.join(classes.withColumn("doc_id", F.col("node")), ["s1", "s2", "doc_id"])
    prefix = COORDINATES - MATCHES + 1
    postings = reps.select("node", F.posexplode("sig").alias("coordinate", "key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = save(postings.join(lists, "key", "left_semi"), "postings")
    release(spark)
    involved = shared.select(F.col("node").alias("doc_id")).distinct()
    sets = save(_sets(docs.join(involved, "doc_id", "left_semi"), shingle), "sets", codec="lz4")
    release(spark)
    shared = save(shared.join(_bounds(sets, percent), "node"), "postings")
    # the first of a list is the member with the least of its own: others are likeliest to link with it
    first = F.max_by(F.struct(F.col("node").alias("pivot"), F.col("own").alias("pivot_own"), F.col("size").alias("pivot_size")), F.struct(F.col("own") / F.col("size") * -1, -F.col("node")))
    star = shared.where(f"coordinate < {prefix}").join(shared.groupBy("key").agg(first.alias("f")).select("key", "f.*"), "key")
    star = star.where(F.col("node") != F.col("pivot")).where(_possible("own", "size", "pivot_own", "pivot_size", percent))
    star = save(star.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct(), "pairs")
    edges = save(_confirmed(star, sets, percent), "links")
    labels = save(components(edges), "labels")
    # the rest of each list: what lies outside its largest component, against all of it
    named = shared.join(labels, "node", "left").select("key", "node", "own", "size", F.coalesce("component", "node").alias("c"))
    named = save(named, "named")
    sizes = named.groupBy("key", "c").count()
    main = sizes.groupBy("key").agg(F.max(F.struct("count", F.col("c").alias("main"))).alias("x"), F.count("*").alias("parts"), F.sum("count").alias("n")).where("parts > 1")
    blocks = lambda n: F.ceil(n / SIDE).cast("int")
    main = main.select("key", "x.main", blocks(F.col("n")).alias("n_all"), blocks(F.col("n") - F.col("x.count")).alias("n_rest"))
    mixed = save(named.join(main, "key").join(sets.select("node", "parity"), "node"), "mixed")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = mixed.where("c <> main").select("key", deal("n_rest").alias("i"), every("n_all").alias("j"), F.col("node").alias("p"), F.col("c").alias("pc"), F.col("own").alias("p_own"), F.col("size").alias("p_size"), F.col("parity").alias("p_parity"))
    whole = mixed.select("key", every("n_rest").alias("i"), deal("n_all").alias("j"), "node", "c", "main", "own", "size", "parity")
    cross = rest.join(whole, ["key", "i", "j"]).where("pc <> c AND (c = main OR p < node)").where(_possible("own", "size", "p_own", "p_size", percent))
    cross = cross.where(_alike("parity", "size", "p_parity", "p_size", percent))
    cross = cross.groupBy(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).count()
    cross = cross.where(F.col("count") >= MATCHES).join(star, ["a", "b"], "left_anti").select("a", "b")
    more = save(_confirmed(cross, sets, percent), "links")
    if not more.isEmpty():
        labels = save(components(edges.unionByName(more)), "labels")
    named = classes.join(labels, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
