"""WARC archives: writing, normalising whole-file gzip into a member a record with an offset index, and reading back."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, scratch_path, small_batches, written

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Date of records whose capture time is not known.
DATE = "1970-01-01T00:00:00Z"
#: Payload bytes after which a writer begins a new archive, and bytes read at once.
ARCHIVE_BYTES, READ_BYTES = 32_000_000, 1 << 20
#: Smallest payload that may be written as a revisit.
REVISIT_BYTES = 100


def open_file(uri: str, mode: str):
    """A file in the shared folder, on whatever store: local paths directly, others through Arrow's file systems."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        path = unquote(parts.path)
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        store.create_dir(os.path.dirname(path))
        return store.open_output_stream(path)
    return store.open_input_file(path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of another page's response; its HTTP head names the payload's length in either case."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url else f"urn:page:{page_id}"
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha256:{digest}",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields, names in lower case, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def inflated(file) -> Iterator[bytes]:
    """The contents of a gzip file of one member or more, inflated once, chunk by chunk."""
    engine = zlib.decompressobj(31)
    while chunk := file.read(READ_BYTES):
        while chunk:
            if data := engine.decompress(chunk):
                yield data
            chunk = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
                if not chunk:
                    break


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Each record's bytes, with its closing blank lines, from a stream cut anywhere."""
    held = bytearray()
    need, begin = 0, 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                end = held.find(b"\r\n\r\n", begin)
                if end < 0:
                    break
                size = re.search(rb"(?im)^content-length:[ \t]*(\d+)", bytes(held[begin:end]))
                if not size:
                    raise ValueError("a record without Content-Length")
                need = end - begin + 4 + int(size[1]) + 4
            if len(held) - begin < need:
                break
            yield bytes(held[begin : begin + need])
            begin += need
            need = 0
        del held[:begin]
        begin = 0
    if held.strip():
        raise ValueError("the archive ends within a record")


def write_archives(rows: DataFrame, folder: str, *, level: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, payload, digest, refers_to) as archives that are one gzip stream each, as crawlers
    that compress whole files leave them. Returns archive (its URI) and n (records), as a table.

    Each attempt of a task writes under names of its own; only a finished attempt's archives get into the table, so a
    lost executor leaves at most files that nobody names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int]] = []
        out, held, n, path = None, 0, 0, ""

        def close() -> None:
            nonlocal out, held, n
            if out is not None:
                out.write(engine.flush())
                out.close()
                done.append((path, n))
            out, held, n = None, 0, 0

        for batch in batches:
            for page, url, payload, digest, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, engine = open_file(path, "wb"), zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(engine.compress(record(page, url, payload, digest, refers)))
                held, n = held + len(payload), n + 1
                if held >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["archive", "n"])

    small_batches(rows.sparkSession)
    return written(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, n long"), "archives")


def _dealt(archives: DataFrame) -> DataFrame:
    """Archives dealt out evenly, so that a task gets few."""
    spark = archives.sparkSession
    return archives.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def normalise(archives: DataFrame, folder: str, *, level: int = 6) -> DataFrame:
    """Rewrites archives (archive: URI of a gzip file, of any members) so that each record is a member of its own, and
    writes beside each a sidecar index, a JSON line a record: offset, length, type, id, target, digest. Every input is
    inflated once, as a stream; what is held is a record. Returns archive, sidecar and n, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for source in batch.column(0).to_pylist():
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                offset = n = 0
                with open_file(source, "rb") as file, open_file(path, "wb") as out, open_file(f"{path}.idx", "wb") as index:
                    for raw in records(inflated(file)):
                        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = engine.compress(raw) + engine.flush()
                        head = raw[: raw.index(b"\r\n\r\n") + 4]
                        fields, _ = parse(head)
                        line = {"offset": offset, "length": len(member)} | {k: fields.get(f) for k, f in (("type", "warc-type"), ("id", "warc-record-id"), ("target", "warc-target-uri"), ("digest", "warc-payload-digest"))}
                        out.write(member)
                        index.write(json.dumps(line, ensure_ascii=False).encode() + b"\n")
                        offset, n = offset + len(member), n + 1
                made.append((path, f"{path}.idx", n))
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], ["archive", "sidecar", "n"])

    return written(_dealt(archives.select("archive")).mapInArrow(run, "archive string, sidecar string, n long"), "normalised")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of archives (archive, sidecar), each inflated on its own at its offset in the index: page_id,
    record_type, refers_to, payload_bytes and payload_digest (both of the full payload, which a revisit only names),
    payload (null for a revisit) and url. A response whose payload does not have its digest is an error."""

    def page(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def one(raw: bytes) -> tuple:
        fields, block = parse(raw)
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)[1])
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        kind = fields["warc-type"]
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"the payload of {fields['warc-record-id']} is not what was written")
        return page(fields["warc-record-id"]), kind, page(fields.get("warc-refers-to")), size, digest, payload if kind == "response" else None, fields["warc-target-uri"]

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(path, "rb") as file, open_file(sidecar, "rb") as index:
                    found, held = [], 0
                    for line in index.read().splitlines():
                        at = json.loads(line)
                        file.seek(at["offset"])
                        engine = zlib.decompressobj(31)
                        found.append(one(engine.decompress(file.read(at["length"]))))
                        held += found[-1][3]
                        if held >= 4 * READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], names)
                            found, held = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(types)], names)

    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, url string"
    return _dealt(archives.select("archive", "sidecar")).mapInArrow(run, schema)


def with_revisits(pages: DataFrame, *, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (html in UTF-8, null as empty), digest and refers_to: of pages with equal payloads of at
    least `least` bytes, the smallest page_id, for all but that page; else null.

    Only groups of several pages are joined back; they are a table of known size, so that the payloads are shuffled
    only when it is too large to broadcast. A page without an id is always a response.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))
    groups = written(groups.where("first_id <> last_id").select("digest", "first_id"), "revisits")
    refers = F.when(F.col("page_id") != F.col("first_id"), F.col("first_id"))
    return rows.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """pages (page_id, url, html) written as whole-file archives, normalised into folder, and read back; see
    read_archives(). The whole-file archives are deleted once all are normalised. An empty table gives no rows;
    rows that repeat a page are records each; other columns are ignored."""
    raw = scratch_path(spark, "warc-whole")
    archives = write_archives(with_revisits(pages), raw)
    normal = normalise(archives, folder or scratch_path(spark, "warc"))
    delete_path(spark, raw)
    return read_archives(normal)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    back = round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), g as (
  select *, case when payload_bytes >= 100 and page_id is not null
            then min(page_id) over (partition by payload_digest) end as first_id from p
)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when first_id <> page_id then 'revisit' else 'response' end as record_type,
       case when first_id <> page_id then first_id end as refers_to
from g
"""
