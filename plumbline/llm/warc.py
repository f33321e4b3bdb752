"""WARC archives: one gzip member per record, repeated payloads as revisits, and a sequential reader.

Writing: each task writes its rows to archives in the shared folder and returns a manifest (path, records, bytes), which is
written to a table before anything reads it. A task that runs again writes new files; only those of the manifest count.

Reading: a file is decompressed piece by piece, a record is framed by its Content-Length and must end where its gzip member
ends, and digests are computed while the bytes pass. Memory does not depend on the size of a record unless the payload is
asked for.

Defined cases: a null payload is empty; a page without url has no target URI; a null page_id is kept (largest of its group
only if all are null); of repeated rows of the response's own page_id, the one with the first url is the response and the
others revisit it; no rows give an empty manifest and no records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import open_folder, shared_folder, written

LEAST_BYTES = 1000
ROLL_BYTES = 64 << 20
PIECE = 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"


def choose_responses(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to, copy: of equal payloads of at least ``least_bytes`` the largest page_id answers.

    Groups are found on (digest, page_id) alone; payloads are shuffled once, by page, so that no group of copies meets in a task.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    key = F.concat_ws(":", "digest", F.coalesce(F.col("page_id").cast("string"), F.lit("-")))
    large = p.filter(F.octet_length("html") >= least_bytes).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("rows"))
    answers = large.groupBy("digest").agg(F.max("page_id").alias("answer"), F.sum("rows").alias("rows")).filter("rows > 1")
    decided = large.select("digest", "page_id").join(answers.select("digest", "answer"), "digest").select(
        key.alias("key"), "answer", F.lit(True).alias("repeated"))
    own = Window.partitionBy("key").orderBy("url")
    joined = p.withColumn("key", key).join(decided, "key", "left").withColumn("copy", F.row_number().over(own))
    revisit = F.coalesce("repeated", F.lit(False)) & ~(F.col("page_id").eqNullSafe(F.col("answer")) & (F.col("copy") == 1))
    return joined.select(
        "page_id", "url", "html", "digest", "copy", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("answer")).alias("refers_to"))


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_bytes(page_id, url, html: str, digest: str, copy: int, record_type: str, refers_to) -> bytes:
    """One WARC record, uncompressed. The HTTP head of a revisit keeps the length of the payload it leaves out."""
    payload = html.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if record_type == "response":
        block += payload
    name = "-" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{RECORD_URN}{name}:{copy}>", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{_base32(digest)}",
        f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: quote(m[0], safe=""), url))
    if record_type == "revisit":
        target = "-" if refers_to is None else refers_to
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_URN}{target}:1>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the records of ``choose_responses``; returns path, records, bytes of each archive."""
    folder = shared_folder(records.sparkSession)

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        out, path, n, size = None, "", 0, 0
        made: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in batch.schema.names), strict=True):
                member = gzip.compress(record_bytes(*(v.as_py() for v in row)), 5, mtime=0)
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)  # the members are the compression
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= roll_bytes:
                    out.close()
                    made.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            made.append((path, n, size))
        if made:
            root = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
            yield pa.RecordBatch.from_pydict({
                "path": [root + m[0] for m in made], "records": pa.array([m[1] for m in made], pa.int64()), "bytes": pa.array([m[2] for m in made], pa.int64())})

    cols = ("page_id", "url", "html", "digest", "copy", "record_type", "refers_to")
    return written(records.select(*cols).mapInArrow(write, "path string, records bigint, bytes bigint"))


class Members:
    """Bytes of an archive, gzip member by gzip member, decompressed in pieces."""

    def __init__(self, stream, piece: int = PIECE):
        self.stream, self.piece, self.raw, self.inflate, self.ready = stream, piece, b"", None, b""

    def next_member(self) -> bool:
        """Moves to the next member; False at the end of the archive."""
        if self.ready or self.inflate is not None and not self.inflate.eof:
            raise ValueError("a record ends before its gzip member")
        if not self.raw:
            self.raw = bytes(self.stream.read(self.piece))
        if not self.raw:
            return False
        self.inflate = zlib.decompressobj(31)
        return True

    def more(self) -> bool:
        """Inflates one more piece of this member; False at its end."""
        while not self.inflate.eof:
            if not self.raw:
                self.raw = bytes(self.stream.read(self.piece))
                if not self.raw:
                    raise ValueError("the archive ends within a gzip member")
            got = self.inflate.decompress(self.raw, self.piece)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if got:
                self.ready += got
                return True
        return False

    def head(self) -> bytes:
        """Up to the first empty line."""
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise ValueError("a record without end of its head")
        out, self.ready = self.ready[:end], self.ready[end + 4 :]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.ready and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            out, self.ready = self.ready[:n], self.ready[n:]
            n -= len(out)
            yield out

    def end(self) -> None:
        """The record's closing lines, and with them the end of the member."""
        if b"".join(self.exactly(4)) != b"\r\n\r\n" or self.ready or self.more():
            raise ValueError("a record and its gzip member end at different places")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def read_records(stream, keep_payload: bool = False) -> Iterator[dict]:
    """Records of one archive: fields, payload length and digest, and whether the bytes agree with the digests of the head."""
    members = Members(stream)
    while members.next_member():
        fields = _fields(members.head())
        left = int(fields["content-length"])
        block, payload, kept, http, seen, length = hashlib.sha1(), hashlib.sha1(), [], b"", False, 0
        for piece in members.exactly(left):
            block.update(piece)
            if not seen:  # the HTTP head comes first
                http += piece
                if (end := http.find(b"\r\n\r\n")) < 0:
                    continue
                seen, http, piece = True, http[:end], http[end + 4 :]
            payload.update(piece)
            length += len(piece)
            if keep_payload:
                kept.append(piece)
        members.end()
        response = fields["warc-type"] == "response"
        told = {k: base64.b32decode(fields[f"warc-{k}-digest"].partition(":")[2]).hex() for k in ("payload", "block")}
        ok = block.hexdigest() == told["block"] and (not response or payload.hexdigest() == told["payload"])
        id_of = lambda v: None if v == "-" else int(v)
        refers = fields.get("warc-refers-to")
        yield {
            "page_id": id_of(fields["warc-record-id"].strip("<>").removeprefix(RECORD_URN).split(":")[0]),
            "url": unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None,
            "payload_bytes": length if response else int(_fields(http)["content-length"]),
            "payload_digest": payload.hexdigest() if response else told["payload"],
            "record_type": fields["warc-type"],
            "refers_to": id_of(refers.strip("<>").removeprefix(RECORD_URN).split(":")[0]) if refers else None,
            "digest_ok": ok,
            "payload": b"".join(kept) if keep_payload and response else None,
        }


SCHEMA = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
          "digest_ok boolean, payload binary")


def read_archives(manifest: DataFrame, keep_payload: bool = False, rows: int = 256) -> DataFrame:
    """Every record of the archives named in ``manifest.path``, read from start to end."""

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for uri in batch["path"]:
                fs, path = open_folder(uri)
                with fs.open_input_stream(path, compression=None) as stream:
                    found: list[dict] = []
                    for record in read_records(stream, keep_payload):
                        found.append(record)
                        if len(found) >= rows:
                            yield frame(pd, found)
                            found = []
                    if found:
                        yield frame(pd, found)

    def frame(pd, found: list[dict]):
        out = pd.DataFrame(found)
        for c in ("page_id", "payload_bytes", "refers_to"):
            out[c] = out[c].astype("Int64")
        return out

    return manifest.select("path").mapInPandas(read, SCHEMA)
