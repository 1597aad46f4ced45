"""Token ids of whole texts, by the tokenizers library, with a bounded memo of text parts.

In byte-level BPE a single space between two characters that are no white space always begins a
new part, so a text can be cut there and parts seen before need not be encoded again. The parts of
a batch of texts are looked up at once by 122 bits of two hashes. New ones go to the library as one
text; the byte lengths of its tokens tell them apart. Texts with longer runs of white space around
a space, or with the text of an added token (such as the one that ends a text), go to the library
as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from .hashing import Modular

#: Parts that the memo holds before it starts anew.
MEMO = 1_000_000
#: Bytes of text that are looked up at once; a text of more is cut near multiples of it.
BATCH_BYTES = 1 << 18
_CUT = re.compile(rb"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


class Memo:
    """Ids of parts by two hashes of each: an open hash table, searched for many keys at once."""

    def __init__(self):
        self.n, self.used = 0, 0
        self.one, self.two = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(1, np.uint32), np.zeros(1, np.int32)
        self.ids = np.zeros(0, "<u4")
        self.slots = np.full(1 << 16, -1, np.int32)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        mask = len(self.slots) - 1
        out = np.full(len(one), -1, np.int64)
        open_, place = np.arange(len(one)), (one & np.uint64(mask)).astype(np.int64)
        while len(open_):
            entry = self.slots[place]
            there = entry >= 0
            same = there.copy()
            same[there] = self.one[entry[there]] == one[open_[there]]
            out[open_[same]] = entry[same]
            go = there & ~same
            open_, place = open_[go], (place[go] + 1) & mask
        got = out >= 0
        out[got] = np.where(self.two[out[got]] == two[got], out[got], -1)
        return out

    def _place(self, first: int) -> None:
        mask = len(self.slots) - 1
        entry = np.arange(first, self.n, dtype=np.int32)
        place = (self.one[first : self.n] & np.uint64(mask)).astype(np.int64)
        while len(entry):
            free = self.slots[place] < 0
            self.slots[place[free]] = entry[free]
            left = self.slots[place] != entry
            entry, place = entry[left], (place[left] + 1) & mask

    def add(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """New keys, all different in their first hash, with their ids one after the other."""
        first, used = self.n, self.used
        self.n, self.used = first + len(one), used + len(ids)
        at = used + np.cumsum(size) - size
        for name, new, begin, end in (("one", one, first, self.n), ("two", two, first, self.n), ("at", at, first, self.n), ("size", size, first, self.n), ("ids", ids, used, self.used)):
            held = getattr(self, name)
            if end > len(held):
                held = np.concatenate([held[:begin], np.zeros(max(end, 5 * len(held) // 4) - begin, held.dtype)])
                setattr(self, name, held)
            held[begin:end] = new
        if 3 * self.n > 2 * len(self.slots):
            self.slots = np.full(2 * len(self.slots) if self.n < len(self.slots) else 1 << int(2 * self.n).bit_length(), -1, np.int32)
            first = 0
        self._place(first)

    def gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some entries one after the other, and where each entry's begin (with the end)."""
        size = self.size[entry].astype(np.int64)
        edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        return self.ids[np.repeat(self.at[entry] - edge[:-1], size) + np.arange(edge[-1])], edge


class Encoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        # each character of a byte-level token stands for one byte
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # such a token could lie across the places where texts are cut
        self.never = any(c.isspace() for t in self.added for c in t)
        self.memo = Memo()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, one: np.ndarray, two: np.ndarray, parts: list[str]) -> None:
        """Encode different parts, as one text, and put them into the memo. Those that follow a space begin with it."""
        first = [k for k, p in enumerate(parts) if p[0] != " "]
        later = [k for k, p in enumerate(parts) if p[0] == " "]
        order = np.array(first + later, np.int64)
        # a line end between parts that begin a text is a token of its own
        joined = "\n".join([parts[k] for k in first]) + "".join([parts[k] for k in later])
        ids = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, "<u4")
        size = np.array([len(parts[k].encode()) for k in order], np.int64)
        gap = np.zeros(len(order), np.int64)
        gap[: max(len(first) - 1, 0)] = 1
        end = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(size + gap)) + 1
        begin = np.concatenate([np.zeros(1, np.int64), end[:-1]])
        keep = np.ones(len(ids), bool)
        keep[end[gap == 1] - 1] = False
        self.memo.add(one[order], two[order], ids[keep], end - begin - gap)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; None and "" have none."""
        batch: list[bytes] = []
        held: list[int] = []  # texts of the batch, by the number of pieces they are cut into
        size = 0
        for text in texts:
            pieces = self._pieces((text or "").encode())
            for k, piece in enumerate(pieces):
                batch.append(piece)
                size += len(piece) + 64
                if size >= BATCH_BYTES and k == len(pieces) - 1:
                    yield from self._joined(batch, [*held, len(pieces)])
                    batch, held, size = [], [], 0
                    break
            else:
                held.append(len(pieces))
        yield from self._joined(batch, held)

    def _pieces(self, text: bytes) -> list[bytes]:
        """A very long text cut before single spaces between letters or digits."""
        if len(text) <= 2 * BATCH_BYTES or self.never:
            return [text]
        out, at = [], 0
        while len(text) - at > 2 * BATCH_BYTES and (m := _CUT.search(text, at + BATCH_BYTES)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def _joined(self, pieces: list[bytes], held: list[int]) -> Iterator[bytes]:
        at = 0
        got: list[bytes] = []
        for n in held:
            while len(got) < n:
                # as many pieces as fit a batch
                size, end = 0, at
                while end < len(pieces) and (end == at or size + len(pieces[end]) <= 2 * BATCH_BYTES):
                    size += len(pieces[end]) + 64
                    end += 1
                got += self._batch(pieces[at:end])
                at = end
            yield b"".join(got[:n])
            del got[:n]

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        plain = {k for k, t in enumerate(texts) if self.never or any(a.encode() in t for a in self.added)}
        mine = [k for k, t in enumerate(texts) if t and k not in plain]
        out = [b""] * len(texts)
        if self.memo.n > MEMO:
            self.memo = Memo()
        if mine:
            whole = b"".join([texts[k] for k in mine])
            data = np.frombuffer(whole, np.uint8)
            begin = np.cumsum([0, *(len(texts[k]) for k in mine)])
            mark = data == 32
            mark[begin[:-1]] = True
            start = np.flatnonzero(mark)
            end = np.append(start[1:], len(data))
            one, two = (Modular(data, f).ranges(start, end) for f in (0, 1))
            entry = self.memo.find(one, two)
            missing = np.flatnonzero(entry < 0)
            if len(missing):
                new = missing[np.unique(one[missing], return_index=True)[1]]
                parts = [whole[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
                sure = [k for k, p in enumerate(parts) if not _open(p)]
                if sure:
                    self._learn(one[new[sure]], two[new[sure]], [parts[k] for k in sure])
                entry[missing] = self.memo.find(one[missing], two[missing])
                # what is still missing has no sure boundary
                of = np.searchsorted(begin, start[entry < 0], side="right") - 1
                plain |= {mine[k] for k in np.unique(of).tolist()}
            ids, edge = self.memo.gather(np.maximum(entry, 0))
            ids = ids.tobytes()
            cut = (4 * edge[np.searchsorted(start, begin)]).tolist()
            for k, a, b in zip(mine, cut[:-1], cut[1:], strict=True):
                if k not in plain:
                    out[k] = ids[a:b]
        for k in plain:
            out[k] = self._whole(texts[k].decode())
        return out


def _open(part: str) -> bool:
    """Whether a part has white space (or nothing) at an end, besides the space that it begins with, so that no boundary is sure there."""
    part = part[part[0] == " " :]
    return not part or part[0].isspace() or part[-1].isspace()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def byte_bpe() -> str:
    """Place of the byte-level BPE vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
