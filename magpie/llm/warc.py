"""WARC archives through a chunked record table.

Records are never held whole: payloads go to the writer as rows (record, chunk number, bytes), the
writer feeds each chunk to the compressor and to a running SHA-1, and the reader gives such rows
back, each with the digest of the payload so far. Each file is a series of gzip members, one a record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import save, ship, workdir

CHUNK = 256 << 10
FILE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "file string, n_records long, n_bytes long"
CHUNKS = "record_id long, record_type string, refers_to long, target_uri string, chunk_no long, last boolean, payload_bytes long, digest string, header_bytes long, header_digest string, data binary"
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """One row per page: page_id, url, payload, payload_bytes, digest, refers_to.

    Of payloads that are equal and have at least that many bytes, the one with the largest page_id
    is stored (refers_to is null), the others refer to it.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    same = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("stored"), F.count("*").alias("n"))
    same = same.where("n > 1 AND stored IS NOT NULL").select("digest", "stored")
    rows = rows.join(same, "digest", "left")
    return rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("stored")), F.col("stored"))).drop("stored")


def chunk_rows(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunked record table: stored payloads in pieces, revisits as one empty piece."""
    data = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / size)).cast("int")
    rows = rows.withColumn("data", data).drop("payload").withColumn("chunk_no", F.explode(F.sequence(F.lit(0), count - 1)))
    rows = rows.withColumn("last", F.col("chunk_no") == count - 1)
    return rows.select("page_id", "url", "refers_to", "payload_bytes", "digest", "chunk_no", "last", F.expr(f"substring(data, chunk_no * {size} + 1, {size})").alias("data"))


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%" + format(ord(c), "02X") for c in value)


def _head(row: dict, date: str) -> bytes:
    """Header of a record and the start of its block: an HTTP response, for revisits without its body."""
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>", f"WARC-Date: {date}"]
    if row["url"]:
        lines.append(f"WARC-Target-URI: {_clean(row['url'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['digest'])).decode()}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_warc(chunks: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a chunked record table as .warc.gz files below path; returns the table of files.

    Files are put in place by a rename, so a task that runs again leaves the same files.
    """
    ship(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(path)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        out, no, n, size, name = None, 0, 0, 0, ""

        def close() -> pa.RecordBatch:
            nonlocal out, no, n, size
            out.close()
            fs.move(f"{root}/{name}.{attempt}", f"{root}/{name}")
            done = pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "n_records": [n], "n_bytes": [size]})
            out, no, n, size = None, no + 1, 0, 0
            return done

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is None:
                        name = f"{part:06d}-{no:05d}.warc.gz"
                        out = fs.open_output_stream(f"{root}/{name}.{attempt}", compression=None)
                    zip_, sha = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    data = zip_.compress(_head(row, date))
                else:
                    data = b""
                sha.update(row["data"])
                data += zip_.compress(row["data"])
                if row["last"]:
                    if row["refers_to"] is None and sha.hexdigest() != row["digest"]:
                        raise ValueError(f"payload of page {row['page_id']} changed on its way")
                    data += zip_.compress(b"\r\n\r\n") + zip_.flush()
                    n += 1
                out.write(data)
                size += len(data)
                if row["last"] and size >= FILE_BYTES:
                    yield close()
        if out is not None:
            yield close()

    return save(chunks.mapInArrow(run, FILES), "archives")


class _Stream:
    """Decompressed bytes of a file of gzip members, a bounded piece at a time."""

    def __init__(self, file, step: int = 1 << 20):
        self.file, self.step, self.unzip, self.raw, self.buffer = file, step, zlib.decompressobj(31), b"", bytearray()
        #: Bytes handed out so far.
        self.taken = 0

    def _more(self) -> bool:
        if self.unzip.eof:
            self.raw = self.unzip.unused_data + self.raw
            self.unzip = zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.file.read(self.step)
            if not self.raw:
                return False
        self.buffer += self.unzip.decompress(self.raw, self.step)
        self.raw = self.unzip.unconsumed_tail
        return True

    def line(self) -> bytes:
        """Up to a line end, which is left out; b"" at the end of the file too."""
        while (k := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                return b""
        out = bytes(self.buffer[:k])
        del self.buffer[: k + 2]
        self.taken += k + 2
        return out

    def fields(self) -> dict[str, str]:
        """Header lines up to an empty one; a line that begins with a blank continues the one before it."""
        out, key = {}, ""
        while line := self.line():
            text = line.decode(errors="replace")
            if text[0] in " \t" and key:
                out[key] += " " + text.strip()
            else:
                key, _, value = text.partition(":")
                key = key.strip().lower()
                out[key] = value.strip()
        return out

    def skip(self, n: int) -> None:
        while n:
            n -= len(self.read(min(n, CHUNK)))

    def read(self, n: int) -> bytes:
        """n bytes, or fewer if the buffer has some but not as many."""
        while not self.buffer:
            if not self._more():
                raise EOFError("a record is cut off")
        out = bytes(self.buffer[:n])
        del self.buffer[: len(out)]
        self.taken += len(out)
        return out

    def at_end(self) -> bool:
        while not self.buffer:
            if not self._more():
                return True
        return False


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.removeprefix("-").isdigit() else None


def _hex(digest: str | None) -> str | None:
    """A SHA-1 digest in Base 32 as hexadecimal digits."""
    if not (digest or "").lower().startswith("sha1:"):
        return None
    return base64.b32decode(digest[5:].upper()).hex()


def _chunks(stream: _Stream, with_data: bool) -> Iterator[tuple]:
    while not stream.at_end():
        if not (version := stream.line()).startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        warc = stream.fields()
        left = int(warc["content-length"])
        if warc.get("warc-type") not in ("response", "revisit") or not warc.get("content-type", "").startswith("application/http"):
            stream.skip(left)
            stream.line()
            stream.line()
            continue
        before = stream.taken
        stream.line()  # status
        http = stream.fields()
        left -= stream.taken - before
        sha, size, no = hashlib.sha1(), 0, 0
        digest = _hex(warc.get("warc-payload-digest"))
        full = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        while True:
            data = stream.read(min(left, CHUNK)) if left else b""
            left -= len(data)
            size += len(data)
            sha.update(data)
            yield _page(warc["warc-record-id"]), warc["warc-type"], _page(warc.get("warc-refers-to")), warc.get("warc-target-uri"), no, not left, size, sha.hexdigest(), full, digest, data if with_data else None
            no += 1
            if not left:
                break
        stream.line()
        stream.line()


def read_warc(files: DataFrame, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives: each has the count and the SHA-1 of the payload bytes so far; header_bytes and header_digest are those of the full payload, for revisits too.

    Records that are neither a response nor a revisit, or have no HTTP block, are passed over;
    header lines may be folded. header_bytes and header_digest are null where a record doesn't give them.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=[c.split()[0] for c in CHUNKS.split(", ")])

        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(file)
                with fs.open_input_stream(name, compression=None) as f:
                    rows, size = [], 0
                    for row in _chunks(_Stream(f), with_data):
                        rows.append(row)
                        size += 200 + (len(row[-1]) if with_data else 0)
                        if size > 4 << 20:
                            yield out(rows)
                            rows, size = [], 0
                    if rows:
                        yield out(rows)

    # a count of its own: the rows are few, but each stands for a file
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file").repartition(parts, "file").mapInArrow(run, CHUNKS)


def archive(pages: DataFrame, path: str | None = None, with_data: bool = True) -> DataFrame:
    """Write a WARC record per page and read the archives back, as chunk rows.

    pages: page_id, url, html; other columns are ignored. The payload is the html in UTF-8 (null:
    empty). A page with a null page_id can only refer to others; repeated rows that share the
    largest page_id are each stored; a null or empty url leaves the record without a target; an
    empty table gives no archives and no rows.
    """
    ship(pages.sparkSession)
    path = path or workdir(pages.sparkSession, "warc")
    return read_warc(write_warc(chunk_rows(records(pages)), path), with_data)
