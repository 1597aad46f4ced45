"""Exact removal of repeated byte strings with suffix arrays built by two-stage sorting.

1. Each window of 200 bytes is named by the smallest hash of the 40-byte strings in it, so equal
   windows have equal names. Names that occur once in the corpus can hold no repeated window.
2. A name that is in more than ``HOT`` places is split: of its windows, those whose own hash occurs
   once are left out, the others get a second name, from strings of 160 bytes.
3. Windows of one name in a row make a piece of text; distinct pieces go to the range of their name.
4. There a suffix array of the pieces is built: suffixes smaller than their successors are sorted
   directly, the others are induced by bucket scans. Adjacent common prefixes of 200 bytes mark
   the repeated windows. Hashes only nominate; bytes are compared.

Texts that are equal as a whole (128 bits of BLAKE2b) are sorted once, and equal pieces too.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .blocks import NOMINATE, SENT, SENT_ARROW, Block, Keys, meet, pack, ranges, replies, resolve, scan, sent, spread, unpack
from .hashing import covered, digest, rolling, runs
from .store import discard, release, save, ship

HOT = 256
CHUNK = 1 << 19
NONE = pa.Table.from_batches([], schema=SENT_ARROW)
SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, sha256 string, kept "


# --- suffix array of some texts -------------------------------------------------------------


def _words8(t: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as one big-endian number (zeros after the end)."""
    x = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    n, out = len(t), np.zeros(len(t), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | x[k : k + n]
    return out


def _smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the end of the text counts as smallest."""
    n = len(t)
    x = np.append(t.astype(np.int16), -1)
    step = np.diff(x)
    nearest = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    return step[nearest] > 0


def _direct(t8: np.ndarray, pick: np.ndarray, depth: int) -> np.ndarray:
    """pick, sorted by the depth bytes that follow, eight at a time.

    Each group of suffixes that agree so far jumps to the first place where one of them differs
    from its first member; groups that agree throughout are done.
    """
    pad = np.append(t8, np.zeros(depth + 8, np.uint64))
    order = pick[np.argsort(t8[pick], kind="stable")]
    if len(order) < 2:
        return order
    fresh = np.concatenate([[True], t8[order[1:]] != t8[order[:-1]]])
    active, done = np.arange(len(order)), np.full(len(order), 8)
    while True:
        # fresh: where groups begin among active; groups of one are in place
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(active)))
        keep = np.repeat(size > 1, size)
        active, fresh, done = active[keep], fresh[keep], done[keep]
        if not len(active):
            return order
        who, begin = order[active], np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        lead = who[begin][group]
        until = np.full(len(active), depth)
        rest, at = np.arange(len(active)), done.copy()
        while len(rest):
            e = at[rest]
            bad = pad[who[rest] + e] != pad[lead[rest] + e]
            until[rest[bad]] = e[bad]
            at[rest] += 8
            rest = rest[~bad]
            rest = rest[at[rest] < depth]
        split = np.minimum.reduceat(until, begin)[group]
        keep = split < depth
        active, fresh, split, who, group = active[keep], fresh[keep], split[keep], who[keep], group[keep]
        if not len(active):
            return order
        key = pad[who + split]
        by = np.lexsort((key, group))
        who, key = who[by], key[by]
        order[active] = who
        done = split + 8
        fresh = fresh | np.concatenate([[True], key[1:] != key[:-1]])


def suffix_array(t: np.ndarray, wanted: np.ndarray | None = None, depth: int = 200) -> np.ndarray:
    """Suffixes of t in the order of their first depth bytes, by two-stage sorting.

    wanted: the suffixes needed (all by default); those are extended to the next directly sorted
    suffix, from which they are induced.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    up = _smaller_than_next(t)
    need = np.ones(n, bool) if wanted is None else wanted.copy()
    if wanted is not None:
        # a suffix that is not sorted directly is induced from its successor
        at = np.where(up, np.arange(n), n - 1)
        at = np.minimum.accumulate(at[::-1])[::-1]
        _, ends = runs(need)
        last = at[ends - 1]
        need |= covered(n, ends - 1, last - ends + 2)
    direct = _direct(_words8(t), np.flatnonzero(up & need), depth)
    head = t[direct]
    cut = np.searchsorted(head, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(from_: np.ndarray) -> None:
        p = from_[from_ > 0] - 1
        p = p[need[p] & ~up[p]]
        c = t[p]
        by = np.argsort(c, kind="stable")
        p, c = p[by], c[by]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(c.astype(np.int16))) + 1, [len(p)]]) if len(p) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            induced[c[a]].append(p[a:b])

    if need[n - 1] and not up[n - 1]:
        induced[t[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix, the smallest
    out = []
    for c in range(256):
        k = 0
        while k < len(induced[c]):  # grows while equal bytes in a row are induced
            out.append(induced[c][k])
            induce(induced[c][k])
            k += 1
        b = direct[cut[c] : cut[c + 1]]
        out.append(b)
        induce(b)
    return np.concatenate(out)


def adjacent_common(t: np.ndarray, sa: np.ndarray, size: int) -> np.ndarray:
    """Whether suffixes next to each other in sa have a common prefix of that size."""
    t8 = np.append(_words8(t), np.zeros(size + 8, np.uint64))
    a, b = sa[:-1], sa[1:]
    same = np.zeros(len(a), bool)
    live = np.arange(len(a))
    short = np.uint64(8 * max(0, 8 - size))
    for d in [*range(0, size - 8, 8), max(size - 8, 0)]:
        live = live[(t8[a[live] + d] ^ t8[b[live] + d]) >> short == 0]
    same[live] = True
    return same


def repeated_starts(pieces: list[bytes], size: int) -> list[np.ndarray]:
    """For each piece, which of its windows of that size start anywhere else in the pieces too."""
    n_windows = [max(0, len(p) - size + 1) for p in pieces]
    t = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    at = np.cumsum([0, *(len(p) + 1 for p in pieces)])[:-1]
    wanted = covered(len(t), at, np.array(n_windows)) if pieces else np.zeros(0, bool)
    sa = suffix_array(t, wanted, size)
    sa = sa[wanted[sa]]
    hit = np.zeros(len(t), bool)
    if len(sa) > 1:
        same = adjacent_common(t, sa, size)
        hit[sa[:-1][same]] = True
        hit[sa[1:][same]] = True
    return [hit[a : a + n] for a, n in zip(at, n_windows, strict=True)]


# --- names and pieces -----------------------------------------------------------------------


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """The least of each so many numbers in a row."""
    low, k = g, 1
    while 2 * k <= width:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    return np.minimum(low[: len(low) - (width - k)], low[width - k :]) if width > k else low


class Names:
    """The name of each window of a text: the least hash of the grams in it."""

    def __init__(self, text: bytes, window: int, gram: int):
        self.data = np.frombuffer(text, np.uint8)
        if len(text) < window:
            self.of, self.own, self.times = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
            return
        g = rolling(self.data, gram) & NOMINATE
        self.of = _least(g, window - gram + 1)
        edge = np.concatenate([[True], self.of[1:] != self.of[:-1]])
        self.own = np.unique(self.of[edge])
        # how often the own names occur among the grams
        maybe = np.zeros(1 << 16, bool)
        maybe[(self.own >> np.uint64(48)).astype(np.int64)] = True
        some = g[maybe[(g >> np.uint64(48)).astype(np.int64)]]
        k = np.minimum(np.searchsorted(self.own, some), len(self.own) - 1)
        self.times = np.bincount(k[self.own[k] == some], minlength=len(self.own))


def _names(block: Block, window: int, gram: int) -> tuple[Keys, np.ndarray, Keys, np.ndarray, list[Names]]:
    names = [Names(t, window, gram) for t in block.texts]
    own = np.concatenate([np.zeros(0, np.uint64), *(x.own for x in names)])
    keys = Keys(own)
    times = np.concatenate([np.zeros(0, np.int64), *(x.times for x in names)])
    keys.count = np.bincount(keys.inverse, times, len(keys.one)).astype(np.int64)
    long = np.array([k for k, t in enumerate(block.texts) if len(t) >= window], np.int64)
    prints = np.array([digest(block.texts[k]) for k in long], np.uint64).reshape(-1, 2)
    for x in names:
        x.of = None  # made again when needed: whole blocks of window names are large
    return keys, times, Keys(prints[:, 0], prints[:, 1]), long, names


def _piece_messages(found: dict[tuple[int, bytes], list[int]], kind: str, no: int, buckets: int, least_of: int) -> tuple[np.ndarray, list[tuple]]:
    """Pieces in the order of their names, by ranges; and the rank of each. found: (name, text) to [number, count]."""
    name = np.fromiter((x[0] for x in found), np.uint64, len(found))
    order = np.argsort(name, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    text, count = [x[1] for x in found], [x[1] for x in found.values()]
    rows = [(kind, k, no, pack((name[order[a:b]], [text[i] for i in order[a:b]], [count[i] for i in order[a:b]]))) for k, a, b in spread(name[order], buckets, least_of)]
    return rank, rows


def _pieces(block: Block, answers: pa.Table, no: int, window: int, gram: int, most: int, buckets: int) -> pa.Table:
    keys, _, copies, long, names = _names(block, window, gram)
    total, copied = (replies(answers, "name") >> 1).astype(np.int64), replies(answers, "copy")
    n_copies, first, seen = np.ones(len(names), np.int64), np.zeros(len(names), bool), set()
    for k, x in zip(long, copies.inverse, strict=True):
        n_copies[k] = copied[x] >> 1
        first[k] = bool(copied[x] & 1) and x not in seen
        seen.add(x)
    done, found = 0, {}
    where: list[tuple[int, int, int, int]] = []
    hot: list[tuple[int, int, bytes]] = []
    nominated: list[np.ndarray] = []
    for k, (x, text) in enumerate(zip(names, block.texts, strict=True)):
        mine = keys.inverse[done : done + len(x.own)]
        done += len(x.own)
        if not first[k]:
            continue
        all_ = total[mine]
        # what only the copies of this text have needs no windows: a text with copies goes as a whole
        shared = (all_ > n_copies[k] * x.times) | ((x.times > 1) & (n_copies[k] == 1))
        if not shared.any():
            continue
        of = Names(text, window, gram).of
        edge = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
        which = np.searchsorted(x.own, of[edge[:-1]])
        crowded = np.zeros(len(of) + 1, np.int64)
        for a, b, w in zip(edge[:-1], edge[1:], which, strict=True):
            if shared[w]:
                if all_[w] > most:
                    crowded[a:b] = 1
                else:
                    key = (int(x.own[w]), text[a : b + window - 1])
                    where.append((k, int(a), found.setdefault(key, [len(found), 0])[0], int(b - a)))
                    found[key][1] += 1
        for a, b in zip(*runs(crowded > 0), strict=True):
            part = text[a : b + window - 1]
            hot.append((k, int(a), part))
            nominated.append(rolling(np.frombuffer(part, np.uint8), window) & NOMINATE)
    prints = Keys(np.concatenate([np.zeros(0, np.uint64), *nominated]))
    rank, rows = _piece_messages(found, "piece", no, buckets, window - gram + 1)
    state = [(k, a, int(rank[p]), n) for k, a, p, n in where], n_copies > 1
    rows += [("state", 0, no, pack(state)), *prints.messages("window", no, buckets)]
    if hot:
        rows.append(("hot", 0, no, pack((hot, prints.inverse.astype(np.int32)))))
    return pa.Table.from_batches([sent(rows)])


def _split(table: pa.Table, answers: pa.Table, window: int, gram: int, buckets: int) -> pa.Table:
    """The windows of hot names that can be repeated, as pieces by their second names."""
    no = table["block"][0].as_py()
    hot, inverse = unpack(table["payload"][0].as_py())
    twice = (replies(answers, "window") >> 1) >= 2
    found, where, done = {}, [], 0
    for k, at, part in hot:
        n = len(part) - window + 1
        live = twice[inverse[done : done + n]]
        done += n
        if not live.any():
            continue
        of = _least(rolling(np.frombuffer(part, np.uint8), gram) & NOMINATE, window - gram + 1)
        for a, b in zip(*runs(live), strict=True):
            edge = [a, *(np.flatnonzero(of[a + 1 : b] != of[a : b - 1]) + a + 1), b]
            for c, d in zip(edge[:-1], edge[1:], strict=True):
                key = (int(of[c]), part[c : d + window - 1])
                where.append((k, at + int(c), found.setdefault(key, [len(found), 0])[0], int(d - c)))
                found[key][1] += 1
    rank, rows = _piece_messages(found, "hotpiece", no, buckets, window - gram + 1)
    return pa.Table.from_batches([sent([*rows, ("hotstate", 0, no, pack([(k, a, int(rank[p]), n) for k, a, p, n in where]))])])


def _sort(table: pa.Table, window: int) -> pa.Table:
    """The pieces of some names: which of their windows are repeated, packed by piece."""
    table = table.sort_by([("block", "ascending"), ("kind", "ascending")])
    got = [unpack(x.as_py()) for x in table["payload"]]
    marks: dict[tuple[int, bytes], np.ndarray | bool] = {}
    times: dict[tuple[int, bytes], int] = {}
    for names, texts, counts in got:
        for key, c in zip(zip(names.tolist(), texts, strict=True), counts, strict=True):
            times[key] = times.get(key, 0) + c
    by: dict[int, list[bytes]] = {}
    for name, text in times:
        by.setdefault(name, []).append(text)
    todo: list[tuple[int, bytes]] = []

    def sort() -> None:
        for key, hit in zip(todo, repeated_starts([x[1] for x in todo], window), strict=True):
            marks[key] = hit
        todo.clear()

    size = 0
    for name, texts in by.items():
        if len(texts) == 1 and times[(name, texts[0])] > 1:
            continue  # nothing but whole copies
        todo += [(name, x) for x in texts]
        size += sum(map(len, texts))
        if size >= CHUNK:
            sort()
            size = 0
    if todo:
        sort()
    out = []
    for names, texts, _ in got:
        out.append(pack([True if times[key] > 1 else np.packbits(marks[key]) for key in zip(names.tolist(), texts, strict=True)]))
    return pa.Table.from_arrays([table["kind"], table["bucket"], table["block"], pa.array(out, pa.binary())], schema=SENT_ARROW)


def _whole_characters(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Removed bytes, with all bytes of each character that lost some."""
    lead = np.flatnonzero(text & 0xC0 != 0x80)
    lost = np.maximum.reduceat(gone, lead)
    return np.repeat(lost, np.diff(np.append(lead, len(text))))


def _removed(block: Block, answers: pa.Table, window: int, characters: bool) -> pa.Table:
    kinds = set(answers["kind"].to_pylist())

    def of(kind: str) -> list:
        return [unpack(x.as_py()) for x in answers.filter(pc.equal(answers["kind"], kind)).sort_by("bucket")["payload"]]

    where, copy = of("state")[0]
    starts: dict[int, list[np.ndarray]] = {}
    for places, kind in ((where, "piece"), (of("hotstate")[0] if "hotstate" in kinds else [], "hotpiece")):
        marks = [m for part in of(kind) for m in part]
        for k, a, p, n in places:
            starts.setdefault(k, []).append(a + (np.arange(n) if marks[p] is True else np.flatnonzero(np.unpackbits(marks[p], count=n))))
    rows = []
    for k, text in enumerate(block.texts):
        n = len(text)
        if copy[k]:
            gone = np.ones(n, bool)
        elif k in starts:
            gone = covered(n, np.concatenate(starts[k]), window)
        else:
            gone = np.zeros(n, bool)
        a, b = runs(gone)
        data = np.frombuffer(text, np.uint8)
        kept = data[~(_whole_characters(data, gone) if characters else gone)].tobytes() if len(a) else text
        sha = sha256(text).hexdigest() if len(a) else None
        rows.append((block.ids[k], n, int(gone.sum()), [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)], sha, kept.decode() if characters else kept))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string() if characters else pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "spans", "sha256", "kept"])


def repeated_bytes(docs: DataFrame, window: int = 200, gram: int = 40, hot: int = HOT, characters: bool = False) -> DataFrame:
    """Remove each byte covered by a string of that many bytes that also starts anywhere else.

    docs: doc_id, text (as UTF-8); other columns are ignored. Matches never cross documents;
    overlaps count; strings are judged on the input. Returns one row per input row: doc_id,
    n_bytes, n_removed, spans (maximal removed runs, end exclusive), sha256 (of the text, where
    something was removed; else null) and kept (remaining bytes; with characters, a string of the
    characters that lost none of their bytes).
    Null and empty texts, and texts shorter than the window, lose nothing; a repeated row is a copy
    like any other; a null doc_id stays null; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = ranges(docs)
    crowd = window - gram + 1
    long = max(gram, window * 4 // 5)

    def send(block: Block, no: int, buckets: int) -> Iterator[tuple]:
        keys, _, copies, _, _ = _names(block, window, gram)
        yield from keys.messages("name", no, buckets, crowd)
        yield from copies.messages("copy", no, buckets)

    table = scan(docs, send, "suffix", buckets)
    texts = table.where("kind = 'text'")
    first = resolve(table.where("kind IN ('name', 'copy')"))
    found = save(meet(texts, first, lambda b, t, no: _pieces(b, t, no, window, gram, hot, buckets), SENT), "pieces", by="kind", codec="uncompressed")
    del first
    discard(table, "kind = 'name'")
    release(spark)
    split = found.where("kind = 'hot'").groupBy("block").cogroup(resolve(found.where("kind = 'window'")).groupBy("block"))
    split = save(split.applyInArrow(lambda x, y: _split(x, y, window, long, buckets) if x.num_rows else NONE, SENT), "hotpieces", by="kind", codec="uncompressed")
    discard(found, "kind = 'window'")
    discard(found, "kind = 'hot'")
    # a task for each range: the work is in the sorting, and small inputs would be put together again
    pieces = found.where("kind = 'piece'").unionByName(split.where("kind = 'hotpiece'")).repartition(buckets, "bucket")
    sorted_ = pieces.groupBy("bucket").applyInArrow(lambda t: _sort(t, window), SENT)
    second = sorted_.unionByName(found.where("kind = 'state'")).unionByName(split.where("kind = 'hotstate'"))
    return meet(texts, second, lambda b, t, no: _removed(b, t, window, characters), SCHEMA + ("string" if characters else "binary"))
