"""Media columns: 8-bit WAV members in ZIP archives, and a data source that reads them back by byte range.

``write_media`` turns texts into media: the UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are stored
as 8-bit PCM samples of a WAV member.  Each task writes its own archives of bounded size into a shared folder, under names
that no other attempt uses; which archives count stands in a manifest, a table that Spark commits.

``ZipMediaSource`` is a Spark data source over such a folder, or over any folder of ZIP archives.  It plans partitions as byte
ranges of archives from their names and sizes alone; a task reads its archive's central directory, takes the members that
begin in its range, and streams their payloads as Arrow batches of bounded size.  A member that can't be read, or whose length
or CRC-32 is not the one in the directory, is retried on its own, from its own offset; one that never can be read becomes
a row with an error, and so does a member that holds no sound WAV data.  An archive whose directory can't be read gives one such row.

Edge cases: a null text is an empty one (64 zero bytes); a row with a null id is stored and comes back with a null id;
repeated rows are members of their own; a text that ends in zero
bytes keeps its length, which stands in the member's name; an empty table gives an empty folder and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import time
import uuid
import wave
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strataflow.llm.common import filesystem, scratch_path

UNIT = 64
RATE = 8000
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
#: Folder of the table (archive, size) of the archives that count.
MANIFEST = "_manifest"
#: Members that write_media makes: the row's id, its place in the task, and its bytes without padding.
NAMED = re.compile(r"(-?\d+|null)/\d+-(\d+)\.wav")
MEMBER_SCHEMA = "member string, archive string, offset long, media binary, error string"


def padded(data: bytes) -> bytes:
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


class _ArchiveWriter:
    """Archives of one attempt of a task; ``done`` has the names and sizes of the whole ones."""

    def __init__(self, folder: str, partition: int):
        self.fs, self.folder = filesystem(folder)
        self.base, self.zip, self.done = f"part-{partition:06d}-{uuid.uuid4().hex}", None, []

    def add(self, name: str, data: bytes) -> None:
        if self.zip is None:
            self.current = f"{self.base}-{len(self.done):04d}.zip"
            self.stream = self.fs.open_output_stream(f"{self.folder}/{self.current}", compression=None)
            self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_DEFLATED, compresslevel=3)
            self.size = 0
        self.zip.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
        self.size += len(data)
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.zip is not None:
            self.zip.close()
            self.stream.close()
            self.done.append((self.current, self.fs.get_file_info(f"{self.folder}/{self.current}").size))
            self.zip = None


def write_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store every row's text as a WAV member of an archive in ``folder``."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, row = _ArchiveWriter(folder, TaskContext.get().partitionId()), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                key = str(doc_id.as_py()) if doc_id.is_valid else "null"
                out.add(f"{key}/{row}-{len(data)}.wav", to_wav(padded(data)))
                row += 1
        out.close()
        names, sizes = ([x[i] for x in out.done] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["archive", "size"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.mapInArrow(store, "archive string, size long").write.parquet(f"{folder}/{MANIFEST}")


class ByteRange(InputPartition):
    """Members of an archive that begin in [start, stop)."""

    def __init__(self, archive: str, start: int, stop: int):
        self.archive, self.start, self.stop = archive, start, stop


class ZipMediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", 3))
        self.wait = float(options.get("retrywait", 0.2))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges from the archives' names and sizes; no archive is opened here."""
        fs, path = filesystem(self.folder)
        if fs.get_file_info(f"{path}/{MANIFEST}").type == pafs.FileType.Directory:
            table = pq.read_table(f"{path}/{MANIFEST}", filesystem=fs)
            archives = [(f"{path}/{a}", n) for a, n in zip(table.column("archive").to_pylist(), table.column("size").to_pylist(), strict=True)]
        else:
            archives = [(x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".zip")]
        return [ByteRange(a, start, min(start + self.range_bytes, n)) for a, n in sorted(archives) for start in range(0, n, self.range_bytes)]

    def _member(self, fs: pafs.FileSystem, archive: str, info: zipfile.ZipInfo) -> bytes:
        with fs.open_input_file(archive) as f:
            f.seek(info.header_offset)
            head = f.read(30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("no member starts at this offset")
            name, extra = struct.unpack("<HH", head[26:30])
            f.seek(info.header_offset + 30 + name + extra)
            data = f.read(info.compress_size)
        if len(data) != info.compress_size:
            raise ValueError("the member is cut short")
        if info.compress_type != zipfile.ZIP_STORED:
            data = zlib.decompress(data, -15)
        if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
            raise ValueError("the member's data is not what the directory says")
        return data

    def _directory(self, fs: pafs.FileSystem, archive: str) -> list[zipfile.ZipInfo]:
        with fs.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
            return sorted(z.infolist(), key=lambda x: x.header_offset)

    def _retried(self, get) -> tuple:
        """(result, error) of a read that is tried several times."""
        error = None
        for attempt in range(self.retries + 1):
            try:
                return get(), None
            except (OSError, ValueError, zlib.error, zipfile.BadZipFile, NotImplementedError) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(self.wait * attempt)
        return None, error

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark passes where no range was planned
            return
        fs, _ = filesystem(self.folder)
        rows, held = [], 0
        schema = pa.schema([("member", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])
        members, error = self._retried(lambda: self._directory(fs, partition.archive))
        if error and partition.start == 0:
            rows.append((None, partition.archive, None, None, error))
        for info in members or []:
            if not partition.start <= info.header_offset < partition.stop or info.is_dir():
                continue
            media, error = self._retried(lambda m=info: self._member(fs, partition.archive, m))
            rows.append((info.filename, partition.archive, info.header_offset, media, error))
            held += len(media or b"")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class ZipMediaSource(DataSource):
    """``spark.read.format("zipmedia").load(folder)``; options: rangebytes, retries, retrywait."""

    @classmethod
    def name(cls) -> str:
        return "zipmedia"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZipMediaReader(self.options)


def read_media(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    spark.dataSource.register(ZipMediaSource)
    return spark.read.format("zipmedia").options(**options).load(folder)


def _features(samples: bytes, n_bytes: int) -> str:
    """Level, energy, sign changes and peak of the samples, as integers."""
    import numpy as np

    x = np.frombuffer(samples, np.uint8).astype(np.int64)[:n_bytes] - 128
    if not len(x):
        return "n=0"
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    return f"n={len(x)};mean={int(x.sum()) * 1000 // len(x)};energy={int((x * x).sum()) // len(x)};crossings={crossings};peak={int(np.abs(x).max())}"


def media_features(members: DataFrame) -> DataFrame:
    """Digests and features of media members.  A member that couldn't be read, or holds no sound WAV data, has nulls and its error."""

    def row(member: str | None, media: bytes | None, error: str | None) -> tuple:
        named = NAMED.fullmatch(member or "")
        doc_id = int(named[1]) if named and named[1] != "null" else None
        if media is None:
            return (doc_id, *(None,) * 7, error)
        try:
            payload = from_wav(media)
        except (wave.Error, EOFError, struct.error) as e:
            return (doc_id, *(None,) * 7, f"{type(e).__name__}: {e}")
        n = min(int(named[2]), len(payload)) if named else len(payload)
        return (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), _features(payload, n), None)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row(member, media.as_buffer().to_pybytes() if media.is_valid else None, error) for member, media, error in zip(batch.column("member").to_pylist(), batch.column("media"), batch.column("error").to_pylist(), strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=FEATURE_NAMES)

    return members.select("member", "media", "error").mapInArrow(compute, FEATURE_SCHEMA)


FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
FEATURE_NAMES = [x.split()[0] for x in FEATURE_SCHEMA.split(", ")]


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the texts as media archives, read them back through the data source and compute their features."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "media")
    write_media(docs, folder, id_col, text_col)
    return media_features(read_media(spark, folder))
