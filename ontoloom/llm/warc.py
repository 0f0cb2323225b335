"""WARC bundles in seekable Zstandard.

Records are grouped into independent frames of about FRAME_BYTES; a skippable frame with the seek table closes each file.
The index maps record identifiers to file, frame number and offset in the frame; where a frame lies in its file is read
from the file's own seek table. Files go to the shared folder under names that each task attempt draws anew, and only
files named in the returned index count, so a repeated task does no harm. Of equal payloads of at least min_revisit bytes,
the record with the largest id is the response and others revisit it.

Cases: null payloads are empty; null ids rank lowest and lose no header but their own; rows that repeat an id and a payload
are all responses, each a record with an identifier of its own; an empty table gives an empty index; long payloads take a
frame of their own; columns other than the id, the URL and the payload are not read, whatever their names. The folder must
be reachable through pyarrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from ontoloom.llm.common import scratch, table, written

FRAME_BYTES, FILE_BYTES = 1 << 20, 64 << 20
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = {"_record": pa.string(), "_page": pa.string(), "_file": pa.string(), "_frame": pa.int64(), "_at": pa.int64(), "_bytes": pa.int64()}


def record(name: str, uri, payload: bytes, page, refers) -> bytes:
    kind = "response" if refers is None else "revisit"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    clean = "".join(c for c in uri or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page is not None:
        head.append(f"X-Page-ID: {quote(str(page), safe='')}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {quote(str(refers), safe='')}"]
    body = payload if refers is None else b""
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """frames: compressed and whole size of each."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame of an open file of that size."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    out, at = [], 0
    for packed, _ in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, packed))
        at += packed
    return out


class Frames:
    """Frames of bundles by file and number. It holds the last frame and the last file's seek table."""

    def __init__(self, folder: str) -> None:
        import zstandard

        self.fs, _ = pafs.FileSystem.from_uri(folder)
        self.press, self.file, self.frame, self.table, self.data = zstandard.ZstdDecompressor(), None, None, [], b""

    def get(self, file: str, frame: int) -> bytes:
        if (self.file, self.frame) != (file, frame):
            with self.fs.open_input_file(file) as f:
                if self.file != file:
                    self.table = read_seek_table(f, f.size())
                start, size = self.table[frame]
                f.seek(start)
                self.file, self.frame, self.data = file, frame, self.press.decompress(f.read(size))
        return self.data


def write_bundles(rows, folder: str):
    """rows: _id, _url, _payload, _refers. Writes the files; returns the index: _record, _page, _file, _frame, _at, _bytes."""

    def bundle(batches):
        import zstandard

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        press = zstandard.ZstdCompressor(level=3)

        def files():
            new = lambda: (f"{root}/{uuid.uuid4().hex}.warc.zst", io.BytesIO(), [], bytearray(), [])
            name, out, frames, frame, index = new()
            size = 0
            for b in batches:
                for page, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{len(index)}')}>"
                    r = record(own, url, payload or b"", page, refers)
                    index.append((own, None if page is None else str(page), name, len(frames), len(frame), len(r)))
                    frame += r
                    size += len(r)
                    if len(frame) >= FRAME_BYTES:
                        frames.append((out.write(press.compress(bytes(frame))), len(frame)))
                        frame = bytearray()
                    if size >= FILE_BYTES:
                        yield name, out, frames, frame, index
                        name, out, frames, frame, index = new()
                        size = 0
            yield name, out, frames, frame, index

        for name, out, frames, frame, index in files():
            if not index:
                continue
            if frame:
                frames.append((out.write(press.compress(bytes(frame))), len(frame)))
            with fs.open_output_stream(name, compression=None) as f:
                f.write(out.getbuffer())
                f.write(seek_table(frames))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), INDEX.values(), strict=True)], list(INDEX))

    return written(rows.mapInArrow(bundle, "_record string, _page string, _file string, _frame long, _at long, _bytes long"), "warc-index")


def read_records(index, folder: str):
    """_record, headers (a map) and payload of each indexed record; a task opens each of its frames once."""

    def load(batches):
        frames = Frames(folder)
        for b in batches:
            rows, size = [], 0
            for own, _, file, frame, at, n in zip(*(b.column(c).to_pylist() for c in INDEX), strict=True):
                fields, body = parse(frames.get(file, frame)[at : at + n])
                if fields["WARC-Record-ID"] != own:
                    raise ValueError(f"{own} is not where the index says")
                if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
                    raise ValueError(f"payload of {own} is damaged")
                rows.append((own, list(fields.items()), body))
                size += len(body)
                if size > FILE_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)

    return index.repartition("_file", "_frame").sortWithinPartitions("_file", "_frame", "_at").mapInArrow(load, "_record string, headers map<string,string>, payload binary")


def _batch(rows):
    cols = zip(*rows, strict=True) if rows else ((),) * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()), strict=True)], ["_record", "headers", "payload"])


def lookup(index, folder: str, records):
    """read_records() of the records that a DataFrame's column _record names; only their frames are read."""
    return read_records(index.join(records.select("_record").distinct(), "_record", "left_semi"), folder)


def read_bundles(index, folder: str, id_type: str = "long"):
    """_id, payload_bytes, payload_digest, record_type, refers_to of each indexed record; responses' payloads are checked."""

    def load(batches):
        for b in batches:
            rows = []
            for h in map(dict, b.column(0).to_pylist()):
                page, refers = (None if h.get(x) is None else unquote(h[x]) for x in ("X-Page-ID", "X-Refers-To-Page"))
                rows.append((page, int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], refers))
            cols = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), *[pa.string()] * 3), strict=True)], ["_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    out = read_records(index, folder).select("headers").mapInArrow(load, "_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("_id", "refers_to")})


def qualified(spark, folder: str) -> str:
    """folder with its scheme: that of Spark's default file system where it has none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    said = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return f"file://{said.removeprefix('file:')}" if said.startswith("file:/") and not said.startswith("file://") else said


def archive(df, id_col="page_id", url_col="url", payload_col="html", min_revisit=0, folder=None):
    """(index, folder). The join deals by payload digest; adaptive skew handling splits hot payloads, as winners are unique."""
    folder = qualified(df.sparkSession, folder or scratch(df.sparkSession, "warc"))
    payload = F.coalesce(F.encode(df[payload_col], "UTF-8"), F.lit(b""))
    rows = df.select(df[id_col].alias("_id"), df[url_col].alias("_url"), payload.alias("_payload"))
    rows = rows.withColumn("_digest", F.struct(F.unhex(F.sha2("_payload", 256)).alias("d"), F.octet_length("_payload").alias("n")))
    best = rows.groupBy("_digest").agg(F.max("_id").alias("_best"), F.count(F.lit(1)).alias("_n"))
    joined = rows.join(best, "_digest")
    revisit = (F.col("_n") > 1) & (F.octet_length("_payload") >= min_revisit) & ~F.col("_id").eqNullSafe(F.col("_best"))
    return write_bundles(joined.select("_id", "_url", "_payload", F.when(revisit, F.col("_best")).alias("_refers")), folder), folder


def op6_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    index, folder = archive(pages)
    return read_bundles(index, folder, pages.schema["page_id"].dataType.simpleString()).withColumnRenamed("_id", "page_id")
