"""Operator 4, WARC: an index of every record first, then coalesced byte-range reads of the selected records."""

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.staging import join_groups, new_path, staged

INDEX = "page_id long, path string, offset long, length long, url string, digest string, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Bytes of one read, at most about; reads are dealt to as many tasks as they hold of it.
MOST = 1 << 23
DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def _identity(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(identity: str) -> int | None:
    number = identity.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _clean(url: str | None) -> str:
    """A header holds no line break."""
    return "".join(" " if c in "\r\n" else c for c in url or "")


def _headers(first: str, fields: dict[str, str]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP headers of its payload and no payload."""
    block = _headers("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(size)})
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _identity(page_id), "WARC-Target-URI": _clean(url), "WARC-Date": DATE}
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _identity(refers_to)}
    else:
        block += payload
    fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return _headers("WARC/1.1", fields) + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def parsed(member: bytes) -> tuple:
    """The columns of RECORD from a record as written; a response whose payload does not have its digest is an error."""
    head, rest = zlib.decompress(member, wbits=31).split(b"\r\n\r\n", 1)
    fields = _fields(head)
    http, payload = rest[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and digest32(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    size = int(_fields(http)["Content-Length"]) if revisit else len(payload)
    refers = _page(fields["WARC-Refers-To"]) if revisit else None
    return _page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], refers, size, digest, None if revisit else payload


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to, revisit) of every row.

    Of records with equal payloads of at least least_bytes bytes that with the largest id is the response, and the
    others revisit it. Null payloads count as empty. Null ids are never the largest but in a group of their own; rows
    that repeat the largest id are responses too.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    key = F.unhex(F.sha2("payload", 256))
    groups = rows.select(key.alias("key"), "page_id", F.length("payload").alias("size")).filter(F.col("size") >= least_bytes)
    groups = groups.groupBy("key").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1")
    groups = staged(groups, "payloads")
    total = groups.agg(F.sum("n")).first()[0] or 0
    joined = join_groups(rows.withColumn("key", key), groups, "key", "n", total, how="left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        F.length("payload").cast("bigint").alias("size"),
        F.when(revisit, F.col("response")).alias("refers_to"),
        revisit.alias("revisit"),
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the rows of with_revisits as gzip members, one archive per task and batch; returns the index.

    The index has page_id, path, offset, length, url, digest and record_type per record. A task that runs again
    writes archives of new names, and only those that its index rows name are read.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        for k, batch in enumerate(batches):
            name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.gz"
            index, at = [], 0
            with files.open_output_stream(f"{base}/{name}", compression=None) as out:
                for x in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "size", "refers_to", "revisit")), strict=True):
                    page_id, url, payload, size, refers_to, revisit = (v.as_py() for v in x)
                    digest = digest32(payload)
                    packed = zlib.compress(record(page_id, url, payload, digest, size, refers_to, revisit), level=6, wbits=31)
                    out.write(packed)
                    index.append((page_id, name, at, len(packed), url, digest, "revisit" if revisit else "response"))
                    at += len(packed)
            names = [f.strip().split(" ")[0] for f in INDEX.split(",")]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in index], t) for i, t in enumerate(types)], names)

    return staged(records.mapInArrow(written, INDEX), "warc-index")


def ranges_of(index: DataFrame, gap: int = 1 << 16, most: int = MOST) -> DataFrame:
    """(path, begin, members) of the reads that cover the selected index rows.

    Rows of one archive are taken in the order of their offsets; a new read starts where more than gap bytes would
    be read for nothing, and at every multiple of most bytes, so that no read grows with the archive.
    """
    slot = index.withColumn("part", F.expr(f"offset div {most}"))
    member = F.struct("offset", "length")
    grouped = slot.groupBy("path", "part").agg(F.array_sort(F.collect_list(member)).alias("members"))
    breaks = F.expr(
        f"filter(sequence(0, size(members) - 1), i -> i = 0 or "
        f"members[i].offset - (members[if(i = 0, 0, i - 1)].offset + members[if(i = 0, 0, i - 1)].length) > {gap})"
    )
    cut = grouped.withColumn("breaks", breaks).select("path", "members", F.posexplode("breaks").alias("k", "first"), "breaks")
    last = F.expr("coalesce(try_element_at(breaks, k + 2), size(members))")
    return cut.select("path", F.slice("members", F.col("first") + 1, last - F.col("first")).alias("members"))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows name, as RECORD, each archive range read once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [f.strip().split(" ")[0] for f in RECORD.split(",")]
        for batch in batches:
            for row in batch.to_pylist():
                members = row["members"]
                begin, end = members[0]["offset"], members[-1]["offset"] + members[-1]["length"]
                with files.open_input_file(f"{base}/{row['path']}") as archive:
                    data = archive.read_at(end - begin, begin)
                found = [parsed(data[m["offset"] - begin : m["offset"] - begin + m["length"]]) for m in members]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names)

    size = index.agg(F.sum("length")).first()[0] or 0
    reads = ranges_of(index).repartition(max(1, -(-size // MOST)), "path", "members")
    return reads.mapInArrow(read, RECORD)


def archive(pages: DataFrame, folder: str | None = None, selected: Column | None = None, **names) -> DataFrame:
    """Write every row of pages as a WARC record, then read back those whose index row is selected (default: all).

    Returns RECORD: page_id, url, record_type, refers_to, payload_bytes, payload_digest (bare base32 SHA-1 of the full
    payload) and payload (null for revisits). folder is in the shared folder unless given. Null payloads and urls
    count as empty; an empty table gives an empty result. Other columns of pages are not archived.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    index = write_archives(with_revisits(pages, **names), folder)
    return read_records(index if selected is None else index.filter(selected), folder)
