"""WARC archives: one gzip member per record, written in parallel and read sequentially file by file.

Null html counts as an empty payload, a null url is written without WARC-Target-URI. Repeated rows give repeated
records. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.common import arrow_rows, work_folder, written

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed date: archives of the same pages are the same bytes, so a repeated task writes the same file again.
DATE = "2024-01-01T00:00:00Z"
BLOCK = 1 << 16


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header (with the full length) and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class WarcReader:
    """Iterates over the records of a binary stream: (headers, block). Memory: one record and one block of input."""

    def __init__(self, stream):
        self.stream, self.raw, self.z, self.ended = stream, b"", None, False
        self.text = bytearray()

    def _more(self) -> bool:
        """Inflates some more of the current member; False at its end."""
        while True:
            if not self.raw and not self.ended:
                self.raw = self.stream.read(BLOCK)
                self.ended = not self.raw
            if not self.raw:
                if self.z is not None:
                    raise ValueError("archive ends inside a gzip member")
                return False
            if self.z is None:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(self.raw)
            self.raw = b""
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, None
                self.text += out
                return False
            if out:
                self.text += out
                return True

    def _until(self, n: int) -> None:
        while len(self.text) < n:
            if not self._more() and len(self.text) < n:
                raise ValueError("record is shorter than its Content-Length")

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            open_member = True
            while b"\r\n\r\n" not in self.text and open_member:
                open_member = self._more()
            if not self.text:
                return
            end = self.text.find(b"\r\n\r\n")
            if end < 0 or not self.text.startswith(b"WARC/1."):
                raise ValueError("not a WARC record")
            lines = bytes(self.text[:end]).decode("utf-8", "replace").split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            start, size = end + 4, int(headers["content-length"])
            self._until(start + size + 4)
            block = bytes(self.text[start : start + size])
            if bytes(self.text[start + size : start + size + 4]) != b"\r\n\r\n":
                raise ValueError("record is longer than its Content-Length")
            del self.text[: start + size + 4]
            while self.z is not None:  # the trailer of the member
                self._more()
            yield headers, block


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes every page into ``folder`` (a URI that all executors reach) and returns the manifest (path, n_records).

    Of pages with equal payloads the one with the largest id is a response record, the others are revisits of it. The
    largest id of each payload comes from a combined aggregation over (SHA-256, length), as payloads of one SHA-1 can be
    made; only ids and digests are shuffled
    for that, the html once, by id. A task writes its file under a name of its own and renames it when it is whole.
    """
    src = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"d": F.sha2("payload", 256), "n": F.length("payload")})
    keyed = src.select("id", "d", "n")
    owners = keyed.groupBy("d", "n").agg(F.max("id").alias("owner"), F.count("*").alias("copies"))
    revisits = keyed.join(owners.where("copies > 1"), ["d", "n"]).where("id < owner").distinct().drop("copies")
    plan = src.join(revisits, ["id", "d", "n"], "left")
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        attempt, n, out = f"{name}.{uuid.uuid4().hex}.tmp", 0, None
        for batch in batches:
            cols = [batch.column(i) for i in range(4)]
            for k in range(batch.num_rows):
                page_id, url, payload, owner = (c[k].as_py() for c in cols)
                if out is None:
                    out = store.open_output_stream(attempt, compression=None)
                out.write(record_bytes(page_id, url, payload, payload_digest(payload), owner))
                n += 1
        if out is not None:
            out.close()
            store.move(attempt, name)
            yield pa.RecordBatch.from_arrays([[name], [n]], schema=schema)

    return written(plan.select("id", "url", "payload", "owner").mapInArrow(run, "path string, n_records long"), "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives in the manifest: page_id, url, record_type, refers_to, payload (null for revisits),
    payload_bytes, payload_digest and ``digest_ok``.

    A file is read by one task from start to end. Lengths and digests of response records are recomputed from the
    payload; those of revisits are what their headers state.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_())])

    def number(x: str | None) -> int | None:
        x = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x and x != "None" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)

        def rows(path):
            with store.open_input_stream(path, compression=None) as stream:
                for h, block in WarcReader(stream):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    said = h["warc-payload-digest"].removeprefix("sha1:")
                    ok = h["warc-block-digest"] == "sha1:" + payload_digest(block)
                    if h["warc-type"] == "response":
                        size, digest = len(payload), payload_digest(payload)
                        ok = ok and digest == said
                    else:
                        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        payload, digest = None, said
                    yield number(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], number(h.get("warc-refers-to")), payload, size, digest, ok

        for batch in batches:
            for path in batch.column(0):
                yield from arrow_rows(rows(path.as_py()), schema)

    spark: SparkSession = manifest.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(n).mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, digest_ok boolean"
    )


def verified(records: DataFrame) -> DataFrame:
    """records without their payloads; a revisit's digest_ok also takes a sound response with its id, digest and length.

    The records are written first, small rows, so that the archives are read once.
    """
    rows = written(records.drop("payload"), "records")
    sound = rows.where("record_type = 'response' and digest_ok").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", F.lit(True).alias("found")).distinct()
    again = rows.where("record_type = 'revisit'").join(sound, ["refers_to", "payload_digest", "payload_bytes"], "left")
    again = again.withColumn("digest_ok", F.col("digest_ok") & F.coalesce("found", F.lit(False))).select(*rows.columns)
    return rows.where("record_type <> 'revisit'").unionByName(again)


def round_trip(pages: DataFrame, **cols) -> DataFrame:
    """Writes the pages to a fresh shared folder and reads the archives back, revisits verified. A record whose digest
    does not fit is an error."""
    folder = work_folder(pages.sparkSession, "warc")
    out = verified(read_archives(write_archives(pages, folder, **cols), folder))
    return out.withColumn("digest_ok", F.when(F.col("digest_ok"), True).otherwise(F.raise_error(F.lit("a WARC record does not fit its digest")).cast("boolean")))
