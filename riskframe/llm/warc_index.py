"""WARC archives by an index: each record's file, offset and length are written first, then selected records are read by ranges.

Every record is a gzip member of its own. A payload that several pages share is stored once, with the largest page id; the other
pages' records are revisits that name it. A reader takes any selection of index rows, sorts it by place, and reads neighbouring
records with one request.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import words as W
from riskframe.llm.files import Written, place
from riskframe.llm.shared import new_folder, small_side, stored, tasks

#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 1000
#: Bytes between two records that are still read with one request, and the most that one request reads.
GAP, SPAN = 64 << 10, 8 << 20
_INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def marked(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``pages`` with ``digest`` (SHA-1 of the html's UTF-8 bytes) and ``refers_to``: null where the payload is to be stored."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(body).alias("digest"), F.octet_length(body).alias("bytes"))
    copies = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    copies = stored(copies.where("n > 1").drop("n"), "copies")
    joined = rows.join(small_side(copies), ["digest", "bytes"], "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("kept")), None).otherwise(F.col("kept"))).drop("kept", "bytes")


def _name(page: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"none" if page is None else b"%d" % page)


def record(page: int | None, url: str | None, digest: str, refers: int | None, payload: bytes) -> bytes:
    """One record, compressed."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers is None else b"revisit"), b"WARC-Record-ID: " + _name(page),
            b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Payload-Digest: sha1:" + digest.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20]", lambda m: b"%%%02X" % m[0][0], url.encode()))
    if refers is None:
        block += payload
    else:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _name(refers)]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parsed(member: bytes) -> dict:
    """A record's fields; a stored payload is checked against its length and digest."""
    plain = zlib.decompress(member, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest, kind = fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode(), fields[b"WARC-Type"].decode()
    number = lambda v: None if v is None or v == b"<urn:page:none>" else int(v[len(b"<urn:page:") : -1])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields[b'WARC-Record-ID']!r} is damaged")
    url = fields.get(b"WARC-Target-URI")
    return {"page_id": number(fields[b"WARC-Record-ID"]), "url": None if url is None else url.decode(), "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": number(fields.get(b"WARC-Refers-To")), "payload": payload if kind == "response" else None}


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        system.create_dir(root, recursive=True)
        task, out = TaskContext.get(), None
        name = f"part-{task.partitionId():06d}.warc.gz"
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
                            ("page_id", pa.int64()), ("record_type", pa.string())])
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or Written(system, f"{root}/{name}", task.taskAttemptId())
            data, ends = W.utf8(batch.column("html"))
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
            for k, (page, url, digest, refers) in enumerate(zip(*columns, strict=True)):
                member = record(page, url, digest, refers, data[ends[k] : ends[k + 1]].tobytes())
                rows.append((name, out.size, len(member), url, digest, page, "response" if refers is None else "revisit"))
                out.write(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if out:
            out.close()

    return run


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> tuple[str, DataFrame]:
    """Write ``pages`` (page_id, url, html) as archives; returns their folder and the index: file, offset, length, url, digest,
    page_id, record_type.

    Pages with equal payloads of at least ``least`` bytes revisit the one with the largest id; rows that repeat that id are all
    stored. Null html is an empty payload, a null url is left out, a null page_id is written as "none" and never revisited.
    """
    folder = folder or new_folder(pages.sparkSession, "archives")
    return folder, stored(marked(pages, least).mapInArrow(_write(folder), _INDEX), "index")


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = place(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def fetch(run: list[tuple[str, int, int]]) -> pa.RecordBatch:
            with system.open_input_file(f"{root}/{run[0][0]}") as f:
                f.seek(run[0][1])
                data = f.read(run[-1][1] + run[-1][2] - run[0][1])
            rows = [parsed(data[o - run[0][1] : o - run[0][1] + n]) for _, o, n in run]
            if not payloads:
                for r in rows:
                    r["payload"] = None
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        run: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if run and (row[0] != run[-1][0] or row[1] - run[-1][1] - run[-1][2] > GAP or row[1] + row[2] - run[0][1] > SPAN):
                    yield fetch(run)
                    run = []
                run.append(row)
        if run:
            yield fetch(run)

    return run


def read(folder: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` point to, in any selection; ``payloads=False`` checks payloads but returns none."""
    rows = index.select("file", "offset", "length", F.expr(f"offset div {SPAN}").alias("stretch"))
    rows = rows.repartition(tasks(index.sparkSession), "file", "stretch").sortWithinPartitions("file", "offset")
    return rows.select("file", "offset", "length").mapInArrow(_read(folder, payloads), _RECORDS)
