"""WARC archives: writing, reading, and revisit resolution.

Revisits are resolved on headers alone.  The header of every record (id,
payload size, payload digest) is grouped by digest; the record with the
smallest id is the original response, every later record of the same payload
becomes a revisit that names it.  The decision meets the payload in one join
on the digest, and the archives are written with fresh headers: a response
carries its payload, a revisit only the reference.  Reading goes the other
way: headers are read from the archives and each revisit is joined to its
original by digest, which gives it back the payload's size and the id it
refers to.

Both joins are null-safe on a digest that an aggregate produced, so Spark
shuffles both sides afresh and AQE can split a digest that a third of all
records share; only the ids of originals are aggregated, map-side first.

Files: each task writes its records into gzip archives of one member per
record and starts a new one at ``roll_bytes``; the manifest a write returns
lists the archives of the task attempts that succeeded, so files left by a
lost executor are never read.  Files are opened through ``pyarrow.fs`` by URI
(``file:``, ``hdfs:``, ``s3:``, ``gs:``); one record's body is held at a time.

Nulls: a null payload is empty; a null id is kept (written as a fresh
``urn:uuid``, which reads back as null) and sorts after every id.  Payloads under ``min_bytes`` are never
revisits.  Of repeated rows (same id and payload) one is the response and the
others revisit that id.  An empty table writes no archive and reads as empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import materialize, shared_path, ship, text_of, with_row_key
from pagewright.operators.ranking import join_per_group

MIN_REVISIT_BYTES = 100
ROLL_BYTES = 256 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long"
HEADERS = "record_id string, record_type string, payload_digest string, payload_bytes long, refers_to string, archive string"


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html",
                  min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``record_id, url, payload, payload_digest, payload_bytes, record_type, refers_to`` per row of ``pages``."""
    rows = with_row_key(pages)
    payload = text_of(F.col(f"_row.`{payload_col}`")).cast("binary")
    url = F.col(f"_row.`{url_col}`").cast("string") if url_col else F.lit(None).cast("string")
    rows = rows.select(
        F.col(f"_row.`{id_col}`").alias("record_id"), url.alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"), "_key",
    )
    first = F.min(F.struct(F.col("record_id").isNull().alias("none"), F.col("record_id").alias("id"), F.col("_key").alias("key")))
    heads = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(
        first.alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    heads = heads.filter("_n > 1").select("payload_digest", "_first")
    rows = join_per_group(rows, heads, ["payload_digest"], "left")
    revisit = F.col("_first").isNotNull() & (F.col("_key") != F.col("_first.key"))
    return rows.select(
        F.col("record_id").cast("string").alias("record_id"), "url", "payload", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first.id").cast("string")).alias("refers_to"),
    )


def _record(record_id, url, payload, digest, kind, refers_to, date) -> bytes:
    """One WARC 1.1 record; a revisit has the headers of its response and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{f'urn:uuid:{uuid.uuid4()}' if record_id is None else f'urn:record:{record_id}'}>",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(ch if ch > " " else "%%%02X" % ord(ch) for ch in url))
    if kind == "revisit":
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:record:{refers_to}>")
    block = http if kind == "revisit" else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, path: str | None = None, date: str | None = None,
                   roll_bytes: int = ROLL_BYTES, level: int = 4) -> DataFrame:
    """Write ``records`` (see ``mark_revisits``) as archives under ``path``; returns the written manifest.

    ``date`` is the records' date, by default the time of writing (UTC).
    """
    from datetime import UTC, datetime

    ship()
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = path or shared_path(records.sparkSession, "warc")

    def write(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        done, out, name, size, n = [], None, None, 0, 0

        def close():
            if out is not None:
                out.close()
                done.append((name, n))

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in
                    ("record_id", "url", "payload", "payload_digest", "record_type", "refers_to")]
            for i in range(batch.num_rows):
                if out is None or size >= roll_bytes:
                    close()
                    fs.create_dir(base, recursive=True)
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = member.compress(_record(*[c[i].as_py() for c in cols], date)) + member.flush()
                out.write(data)
                size += len(data)
                n += 1
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{x}" for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())],
            names=["path", "records"],
        )

    cols = records.select("record_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    return materialize(cols.mapInArrow(write, MANIFEST), "warc-manifest")


def _members(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip stream."""
    import gzip

    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            head = {}
            while (line := f.readline().strip()):
                k, _, v = line.decode().partition(":")
                head[k.lower()] = v.strip()
            yield head, f.read(int(head["content-length"]))


def _of(urn: str | None) -> str | None:
    return (urn[len("<urn:record:"):-1] or None) if urn and urn.startswith("<urn:record:") else None


def read_headers(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives in ``manifest``; a response's digest and size come from its payload."""
    ship()
    schema = T.StructType.fromDDL(HEADERS)

    def read(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        from pyarrow import fs as pafs

        names = schema.names
        types = [pa.int64() if x == "payload_bytes" else pa.string() for x in names]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    for head, block in _members(stream):
                        digest, size = head["warc-payload-digest"].removeprefix("sha256:"), None
                        if head["warc-type"] != "revisit":
                            payload = block[block.index(b"\r\n\r\n") + 4:]
                            size = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: payload of {head['warc-record-id']} does not match its digest")
                        rows.append((_of(head["warc-record-id"]), head["warc-type"], digest, size, _of(head.get("warc-refers-to")), path))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    # One archive is one row.  A stated number of tasks is not coalesced: as many as there are archives.
    paths = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return paths.mapInArrow(read, schema)


def resolve_revisits(headers: DataFrame) -> DataFrame:
    """Gives each revisit its original's payload size and id, by payload digest.

    A revisit whose original is in no archive keeps a null size and the id its
    own header names.
    """
    headers = materialize(headers, "warc-headers")
    known = F.struct(F.col("record_id").isNull().alias("none"), F.col("payload_bytes").alias("bytes"))
    originals = (
        headers.filter("record_type = 'response'").groupBy("payload_digest").agg(F.min(known).alias("_of"))
    )
    responses = headers.filter("record_type <> 'revisit'")
    revisits = join_per_group(headers.filter("record_type = 'revisit'"), originals, ["payload_digest"], "left")
    revisits = revisits.withColumn("payload_bytes", F.col("_of.bytes")).drop("_of")
    return responses.unionByName(revisits)
