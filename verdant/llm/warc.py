"""Web archives (WARC) in Zstandard: writer, reader and revisit records.

An archive begins with a skippable frame that holds the dictionary; each
record then is a frame of its own. The reader loads the dictionary, walks the
frames by their headers without searching, decodes one at a time, and checks
each record's version line, headers, lengths and payload digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.llm import files
from verdant.llm.shared import new_path, written
from verdant.shipping import ship

# Fixed values of the formats.
DICTIONARY_FRAME, ZSTD_FRAME, ZSTD_DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is trained from so many pages of the least hash, cut to so many characters.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 200, 20_000, 32 << 10
LEVEL = 3
WARC_DATE = "2020-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or record that isn't as the formats say."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; empty if the samples don't make one."""
    if sum(map(len, samples)) < 10 * size or len(samples) < 20:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


def _record(kind: str, record_id: str, url: str, digest: str, length: int, payload: bytes, refers_to: str | None) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + payload
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", WARC_DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(length)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    def __init__(self, out, words: bytes):
        self.out = out
        if words:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(words)
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True, write_content_size=True)

    def add(self, record: bytes) -> None:
        self.out.write(self.compressor.compress(record))


def _exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise WarcError("the archive ends within a frame")
    return data


def frames(f) -> Iterator[tuple[int, bytes]]:
    """(magic, bytes) of each frame: a skippable frame's content, or a whole Zstandard frame."""
    while head := f.read(4):
        if len(head) != 4:
            raise WarcError("the archive ends within a frame")
        magic = struct.unpack("<I", head)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            yield magic, _exactly(f, struct.unpack("<I", _exactly(f, 4))[0])
            continue
        if magic != ZSTD_FRAME:
            raise WarcError(f"no frame begins with {magic:08x}")
        parts = [head, _exactly(f, 1)]
        flags = parts[1][0]
        single = flags >> 5 & 1
        size = (flags >> 6 and 1 << (flags >> 6)) or single
        parts.append(_exactly(f, (not single) + (0, 1, 2, 4)[flags & 3] + size))
        last = False
        while not last:
            parts.append(_exactly(f, 3))
            block = int.from_bytes(parts[-1], "little")
            last, kind = bool(block & 1), block >> 1 & 3
            if kind == 3:
                raise WarcError("a reserved block type")
            parts.append(_exactly(f, 1 if kind == 1 else block >> 3))
        if flags & 4:
            parts.append(_exactly(f, 4))
        yield magic, b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block; checks the version, the needed fields and the length."""
    head, cut, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not cut or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC record begins here")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError("a header line without a colon")
        fields[name.decode().lower()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("the block isn't as long as its header says")
    return fields, rest[:-4]


def read_archive(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record of an archive, one frame in memory at a time.

    Raises WarcError for a frame or record that is broken, cut short, or
    whose payload has another length or digest than its header says.
    """
    unpack = zstandard.ZstdDecompressor()
    first = True
    for magic, frame in frames(f):
        if magic != ZSTD_FRAME:
            if first and magic == DICTIONARY_FRAME:
                words = zstandard.ZstdDecompressor().decompress(frame) if frame[:4] == struct.pack("<I", ZSTD_FRAME) else frame
                if words[:4] != struct.pack("<I", ZSTD_DICTIONARY):
                    raise WarcError("the leading frame holds no dictionary")
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
            first = False
            continue
        first = False
        try:
            whole = unpack.decompressobj()  # a frame written as a stream doesn't say its content's size
            data = whole.decompress(frame)
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from e
        if not whole.eof or whole.unused_data:
            raise WarcError("a frame doesn't end where its blocks do")
        fields, block = parse_record(data)
        head, cut, payload = block.partition(b"\r\n\r\n")
        if fields.get("content-type", "").startswith("application/http") and not cut:
            raise WarcError("no HTTP header ends")
        if fields["warc-type"] == "response":
            if str(len(payload)) != fields.get("warc-payload-length", str(len(payload))):
                raise WarcError("the payload isn't as long as its header says")
            if fields.get("warc-payload-digest", "sha1:").removeprefix("sha1:") not in ("", sha1_base32(payload)):
                raise WarcError("the payload's digest isn't its header's")
        yield fields, payload


def _urn(key) -> str:
    return f"urn:page:{'null' if key is None else key}"


def _key(urn: str) -> int | None:
    last = urn.strip("<>").rpartition(":")[2]
    return None if last == "null" else int(last)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record for each page; returns (path) of the archives, one per partition that has rows.

    Of pages with equal payloads of at least ``least_bytes`` bytes, those with
    the largest id are responses, all others revisit them. Only the digests of
    repeated payloads are joined; payloads themselves move only if that list is
    too large to broadcast, which Spark decides by its size at run time.

    Nulls: a null html is an empty payload, a null url an empty one, and a null
    id stays so. Repeated rows have a record each. An empty table gives no
    archive. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html"))
    again = rows.where(F.octet_length("html") >= least_bytes).groupBy(F.col("sha1").alias("_sha1")).agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = written(again, "digests")
    # The pages of least hash, found by their ids and URLs alone: whole pages don't travel to the driver.
    key = F.xxhash64("page_id", "url")
    least = [r[0] for r in rows.select(key.alias("h")).distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    sample = rows.where(key.isin(least)).groupBy(key.alias("h")).agg(F.min(F.substring("html", 1, SAMPLE_CHARS)).alias("html")).orderBy("h").collect() if least else []
    words = spark.sparkContext.broadcast(dictionary([bytes(r["html"]) for r in sample if r["html"]]))
    marked = rows.join(again, (F.col("sha1") == F.col("_sha1")) & (F.octet_length("html") >= least_bytes), "left")
    marked = marked.select("page_id", "url", "html", F.when(F.col("_sha1").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last")).alias("refers_to"), (F.col("_sha1").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))).alias("revisit"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        each = (row for b in batches for at in range(0, b.num_rows, 256) for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True))
        first = next(each, None)
        if first is None:
            return
        with files.create(folder, TaskContext.get().partitionId(), ".warc.zst") as (name, out):
            archive = ArchiveWriter(out, words.value)
            row = first
            while row is not None:
                key, url, html, refers_to, revisit = row
                html = bytes(html or b"")
                url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                kind = "revisit" if revisit else "response"
                archive.add(_record(kind, _urn(key), url, sha1_base32(html), len(html), b"" if revisit else html, _urn(refers_to) if revisit else None))
                row = next(each, None)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["path"])

    return written(marked.mapInArrow(run, "path string"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records; an archive is read by one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with files.opened(path) as f:
                    for fields, payload in read_archive(f):
                        kind = fields["warc-type"]
                        n = int(fields["warc-payload-length"]) if kind == "revisit" else len(payload)
                        digest = fields["warc-payload-digest"].removeprefix("sha1:") if kind == "revisit" else sha1_base32(payload)
                        rows.append((_key(fields["warc-record-id"]), n, digest, kind, _key(fields["warc-refers-to"]) if kind == "revisit" else None))
                        if len(rows) == 4096:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    ship(archives.sparkSession)
    n = archives.count()
    return archives.repartition(max(1, n)).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page; a null html is an empty payload, a null page_id stays null, repeated rows a record each."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages, new_path(spark, "warc")))
