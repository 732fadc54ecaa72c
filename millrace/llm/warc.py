"""WARC writing by a deterministic sharded writer, and reading back.

Records are range-sorted by page id. Each task streams its range into files of one gzip member per
record, rolls to the next file by compressed size, regenerates headers and digests from the payload,
writes under a temporary name, renames, and returns a manifest row for each file. The manifest is
written last, as JSON through Spark's own commit; readers open only the files it names, so files of
failed or repeated attempts are never read. Contents depend on the rows and the range bounds only.

Which page of a group with equal payloads is the response is decided on (digest, id) pairs; these
decisions are merged with the pages by the range sort itself, so payloads are shuffled once.

Files are opened with ``pyarrow.fs`` (local, S3, GCS, HDFS), below the folder that all machines share.

Edge cases: null html is an empty payload; repeated page ids with equal payloads make one response
and revisits that refer to that id; a page with a null id is written in full, with an empty id that is
read back as null, and takes no part in groups; an empty table gives an empty manifest. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, shared_dir

#: Payloads below this many bytes are always written in full.
MIN_REVISIT_BYTES = 100
#: A file is closed once its compressed size reaches this.
ROLL_BYTES = 64 << 20
#: Payload bytes that one task writes, about: the sort is cut into more ranges where the session's number gives larger ones.
RANGE_BYTES = 1 << 30
#: Records carry a fixed date, so that equal input gives equal bytes.
DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string, first_id string, last_id string"
READ_BLOCK = 1 << 20
#: Tasks that read archives, at most.
MAX_READERS = 20_000


def _open_fs(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _header(kind: str, url: str, page: str, digest: str, size: int, refers: str | None, content: bytes) -> bytes:
    """The WARC header block; the id of the record is derived from the page and its payload."""
    seed = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind} {page} {digest}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{seed}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[^!-~]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode('utf-8', 'replace')), url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(content).hexdigest()}",
        f"X-Page-Id: {page}",
        f"X-Payload-Length: {size}",
    ]
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers}"]
    kind_of = "application/http; msgtype=response"
    return "\r\n".join([*lines, f"Content-Type: {kind_of}", f"Content-Length: {len(content)}", "", ""]).encode()


def record(page: str, url: str, payload: bytes, digest: str, refers: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    content = http if refers is not None else http + payload
    return _header("response" if refers is None else "revisit", url, page, digest, len(payload), refers, content) + content + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    # One gzip member with an empty time stamp: equal records give equal bytes.
    held = zlib.compressobj(6, zlib.DEFLATED, 31)
    return held.compress(data) + held.flush()


class _Shards:
    """The files of one task: written to a temporary name, renamed when full or at the end."""

    def __init__(self, root: str, part: int, roll: int):
        self.fs, self.root = _open_fs(root)
        self.part, self.roll, self.seq, self.attempt, self.out = part, roll, 0, uuid.uuid4().hex, None
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)

    def add(self, page: str, data: bytes):
        if self.out is None:
            self.name = f"part-{self.part:05d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.root}/_temporary/{self.attempt}-{self.name}"
            self.out, self.sha, self.n, self.size, self.first = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0, page
        packed = _gzip(data)
        self.out.write(packed)
        self.sha.update(packed)
        self.n, self.size, self.last = self.n + 1, self.size + len(packed), page
        if self.size >= self.roll:
            yield self.close()

    def close(self):
        self.out.close()
        self.fs.move(self.temp, f"{self.root}/{self.name}")
        self.out, self.seq = None, self.seq + 1
        return self.name, self.n, self.size, self.sha.hexdigest(), self.first, self.last


def _writer(root: str, roll: int):
    def write(batches):
        from pyspark import TaskContext

        shards, rows = _Shards(root, TaskContext.get().partitionId(), roll), []
        flags: dict[str, str] = {}
        at, seen = object(), set()
        for pdf in batches:
            for page, kind, url, html, digest, refers in zip(*(pdf[c].tolist() for c in ("p", "kind", "url", "html", "digest", "refers")), strict=True):
                page = None if pd.isna(page) else str(int(page) if isinstance(page, float) else page)
                if page != at:
                    at, flags, seen = page, {}, set()
                if kind == 0:  # decisions on this id come before its pages
                    flags[digest] = str(int(refers) if isinstance(refers, float) else refers)
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(payload).hexdigest()
                target = flags.get(digest)
                if target == page and page is not None and digest not in seen:
                    target = None
                seen.add(digest)
                rows.extend(shards.add(page or "", record(page or "", url or "", payload, digest, target)))
        if shards.out is not None:
            rows.append(shards.close())
        yield pd.DataFrame(rows, columns=["file", "records", "bytes", "sha256", "first_id", "last_id"])

    return write


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write ``pages`` below ``root`` and return the manifest, one row for each committed file. The number of ranges
    follows from the bytes of all payloads, and is the session's number of shuffle partitions at least."""
    spark = pages.sparkSession
    bound_batches(spark)
    rows = pages.select(F.col(id_col).alias("p"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    ids = rows.select("p", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size"))
    ids = ids.filter((F.col("size") >= MIN_REVISIT_BYTES) & F.col("p").isNotNull()).select("p", "digest")
    groups = ids.groupBy("digest").agg(F.min("p").alias("refers"), F.count("*").alias("n")).filter("n > 1").select("digest", "refers")
    kind = rows.schema["p"].dataType
    flags = ids.join(groups, "digest").distinct().select("p", F.lit(0).alias("kind"), F.lit("").alias("url"), F.lit("").alias("html"), "digest", F.col("refers").cast(kind))
    merged = rows.select("p", F.lit(1).alias("kind"), "url", "html", F.lit("").alias("digest"), F.lit(None).cast(kind).alias("refers")).unionByName(flags)
    # Ids travel as strings from here on: pandas would turn long ids beside nulls into floats.
    size = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    sortable = merged.repartitionByRange(ranges, "p").sortWithinPartitions("p", "kind", "url", "html").withColumns({"p": F.col("p").cast("string"), "refers": F.col("refers").cast("string")})
    sortable.mapInPandas(_writer(root, roll_bytes), MANIFEST).write.json(f"{root}/manifest")
    fs, base = _open_fs(root)
    if fs.get_file_info(f"{base}/_temporary").type.name == "Directory":
        fs.delete_dir(f"{base}/_temporary")  # what lost attempts left
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def parse_records(stream):
    """Headers and content of each record of a stream of gzip members, in bounded memory."""
    unzip, data = zlib.decompressobj(31), b""
    plain = bytearray()
    while True:
        if not data:
            data = stream.read(READ_BLOCK)
            if not data:
                break
        plain += unzip.decompress(data)
        data = b""
        if unzip.eof:
            head, _, rest = bytes(plain).partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(headers["Content-Length"])
            if len(rest) != n + 4:
                raise ValueError(f"record {headers['WARC-Record-ID']} is cut short")
            yield headers, rest[:n]
            data, plain, unzip = unzip.unused_data, bytearray(), zlib.decompressobj(31)
    if plain:
        raise ValueError("the last record of the file is cut short")


READ = "page_id {id}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id}"


def read_archives(spark: SparkSession, root: str, manifest: DataFrame, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """A row for each record of the files in ``manifest``; digests of full payloads are recomputed."""

    def read(batches):
        fs, base = _open_fs(root)
        for pdf in batches:
            for name in pdf["file"]:
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for h, content in parse_records(stream):
                        if hashlib.sha256(content).hexdigest() != h["WARC-Block-Digest"][7:]:
                            raise ValueError(f"{name}: block digest differs")
                        payload = content.partition(b"\r\n\r\n")[2]
                        full = h["WARC-Type"] == "response"
                        digest = hashlib.sha256(payload).hexdigest() if full else h["WARC-Payload-Digest"][7:]
                        size = len(payload) if full else int(h["X-Payload-Length"])
                        row = [h["X-Page-Id"] or None, h["WARC-Target-URI"], size, digest, h["WARC-Type"], h.get("X-Refers-To-Page-Id")]
                        rows.append([*row, payload if full else None] if with_payload else row)
                        held += len(payload) if with_payload else 0
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    schema = READ.format(id="string") + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    files = manifest.select("file")
    files = files.repartition(max(1, min(files.count(), MAX_READERS)))  # a task for each, however small its row is
    out = files.mapInPandas(read, schema)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def fresh_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
