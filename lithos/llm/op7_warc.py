"""Operator 7: WARC archives through a chunked record table.

A record is a run of rows (record, chunk number, bytes): no more than one chunk of a payload is held while an archive is
written or read. On reading, the digest and the length so far travel with every chunk, so the last chunk of a record
carries those of the whole payload, and a payload of any size costs one chunk of memory.

Equal payloads are found by SHA-1 and length: the smallest page_id of a group is the response, the others are revisits
that name it by page_id, target and date. Record ids are made of the archive and the record's place in it, so they are
unique where page_ids are null or repeated. The group's smallest id comes from a partial aggregate, and only groups of two or more are joined back.

Archives are gzip members, one per record, in files of about FILE_BYTES. A task writes under names of its own attempt and
the manifest lists what finished, so a lost executor leaves nothing that is read.

Edge cases: null payloads are empty ones; a null page_id stays null and is a response only if its whole group has none;
repeated rows of the smallest id are all responses; a null url leaves the target line out, and line ends in a url are
percent-encoded; extra columns are ignored; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm import files
from lithos.llm.shared import shared_dir, stored, table

CHUNK_BYTES = 1 << 20
FILE_BYTES = 64 << 20
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNKS = "page_id long, url string, record_type string, refers_to long, refers_to_url string, payload_bytes long, sha1 string, chunk_no int, chunk binary, last boolean"
RECORDS = "page_id long, record_type string, refers_to long, chunk_no int, chunk binary, payload_bytes long, payload_digest string, last boolean"


def with_roles(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, sha1, record_type, refers_to and that response's url of each page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    firsts = pages.select("page_id", "url", payload.alias("p")).select("page_id", "url", F.octet_length("p").cast("long").alias("payload_bytes"), F.sha1("p").alias("sha1")).where(F.col("payload_bytes") >= min_bytes)
    firsts = firsts.groupBy("sha1", "payload_bytes").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f"), F.count(F.lit(1)).alias("_n"))
    firsts = firsts.where("_n > 1").select("sha1", "payload_bytes", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"))
    firsts = stored(firsts, "warc-firsts")  # so that the pages of a frequent payload, an empty one say, can be split in the join
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(firsts, ["sha1", "payload_bytes"], "left").select("page_id", "url", "payload", "payload_bytes", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_to_url"))


def chunked(roles: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The record table: a row per chunk of a payload, in order; a revisit is one row without bytes."""
    # cut into an array first: exploding numbers instead would copy the whole payload for each of its chunks
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("payload_bytes") / chunk_bytes).cast("int") - 1))
    pieces = F.transform(numbers, lambda i: F.struct(i.alias("no"), F.substring("payload", i * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk")))
    nothing = F.array(F.struct(F.lit(0).alias("no"), F.lit(b"").alias("chunk")))
    kept = ["page_id", "url", "record_type", "refers_to", "refers_to_url", "payload_bytes", "sha1"]
    rows = roles.select(*kept, F.when(F.col("record_type") == "revisit", nothing).otherwise(pieces).alias("pieces"))
    rows = rows.select(*kept, F.size("pieces").alias("n"), F.explode("pieces").alias("piece"))
    return rows.select(*kept, F.col("piece.no").alias("chunk_no"), F.col("piece.chunk").alias("chunk"), (F.col("piece.no") == F.col("n") - 1).alias("last"))


def _urn(archive: str, record: int) -> str:
    """The id of an archive's record: no page_id goes in, as those may be null or repeated."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{record}')}>"


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def _head(r: dict, ident: str) -> bytes:
    """A record's header block, with the block length known before the first chunk."""
    revisit = r["record_type"] == "revisit"
    block = len(HTTP) + (0 if revisit else r["payload_bytes"])
    lines = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {ident}", f"WARC-Date: {DATE}"]
    if r["url"] is not None:
        lines.append(f"WARC-Target-URI: {_uri(r['url'])}")
    if r["page_id"] is not None:
        lines.append(f"Page-ID: {r['page_id']}")
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(r['sha1'])).decode()}", f"Payload-Length: {r['payload_bytes']}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {DATE}", f"Refers-To-Page-ID: {r['refers_to']}"]
        if r["refers_to_url"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_uri(r['refers_to_url'])}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(chunks: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a chunk table whose records' chunks follow one another; one row per archive: path, n_records, n_bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = stream = path = gz = None
        n = size = 0

        def closed() -> pa.RecordBatch:
            stream.__exit__(None, None, None)
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                if r["chunk_no"] == 0:
                    if out is not None and size >= file_bytes:
                        yield closed()
                        out = None
                    if out is None:
                        stream = files.writer(folder, "pages.warc.gz")
                        (out, path), n, size = stream.__enter__(), 0, 0
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(gz.compress(_head(r, _urn(path, n)) + HTTP))
                data = gz.compress(r["chunk"])
                if r["last"]:
                    data += gz.compress(b"\r\n\r\n") + gz.flush()
                    n += 1
                out.write(data)
                size += len(data)
        if out is not None:
            yield closed()

    return chunks.mapInArrow(task, "path string, n_records long, n_bytes long")


class _Members:
    """Bytes of a file of gzip members, by need."""

    def __init__(self, f, block: int = 1 << 18):
        self.f, self.block, self.buf, self.raw, self.gz = f, block, bytearray(), b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.gz.eof:
                self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            data = self.gz.unconsumed_tail or self.raw or self.f.read(self.block)
            self.raw = b""
            if not data:
                return False
            if got := self.gz.decompress(bytes(data), self.block):
                self.buf += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buf.find(mark)) < 0:
            if not self._more():
                if self.buf:
                    raise ValueError("the archive ends within a record")
                return None
        got = bytes(self.buf[:at])
        del self.buf[: at + len(mark)]
        return got

    def take(self, n: int) -> bytes:
        while len(self.buf) < n and self._more():
            pass
        if len(self.buf) < n:
            raise ValueError("the archive ends within a record")
        got = bytes(self.buf[:n])
        del self.buf[:n]
        return got


def records(f, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """The chunk rows of an archive, with the digest and length up to each chunk."""
    data = _Members(f)
    while (head := data.until(b"\r\n\r\n")) is not None:
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        kind, block = fields["WARC-Type"], int(fields["Content-Length"])
        http = data.until(b"\r\n\r\n")
        left = block - len(http) - 4
        ident = lambda k: int(fields[k]) if k in fields else None  # noqa: E731, B023
        row = {"page_id": ident("Page-ID"), "record_type": kind, "refers_to": ident("Refers-To-Page-ID")}
        digest, so_far, no = hashlib.sha1(), 0, 0
        if kind == "revisit":
            yield row | {"chunk_no": 0, "chunk": b"", "payload_bytes": int(fields["Payload-Length"]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "last": True}
        else:
            while True:
                chunk = data.take(min(left, chunk_bytes))
                left -= len(chunk)
                so_far += len(chunk)
                digest.update(chunk)
                now = base64.b32encode(digest.digest()).decode()
                if not left and fields["WARC-Payload-Digest"] != f"sha1:{now}":
                    raise ValueError(f"record {fields['WARC-Record-ID']} does not have its digest")
                yield row | {"chunk_no": no, "chunk": chunk, "payload_bytes": so_far, "payload_digest": now, "last": not left}
                no += 1
                if not left:
                    break
        if data.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it says")


def read_archives(archives: DataFrame, payloads: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of archives(path); without payloads, the rows leave their bytes behind."""
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with files.reader(path) as f:
                    for r in records(f, chunk_bytes):
                        held += len(r["chunk"])
                        rows.append(r if payloads else r | {"chunk": b""})
                        if held >= 8 * chunk_bytes or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(n, "path").mapInArrow(task, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunked(with_roles(table(spark, sf_dir, "pages")))
    archives = stored(write_archives(chunks, shared_dir(spark, "warc")), "warc-manifest")
    return read_archives(archives, payloads=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS f FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN f END AS refers_to FROM q
"""
