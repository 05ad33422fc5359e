"""WARC archives with revisit resolution.

``write_archives`` writes one gzip-compressed response record per row: an HTTP head and the payload.  ``read_archives`` parses
archives record by record into headers and, of responses, length and digests of the payload.  ``resolve_revisits`` shuffles
headers only: it groups the responses by payload digest, takes the row with the smallest id of each digest as the original and
joins to it the other responses and the revisit records that the archives already hold.  These are followed by the record that
they name, else by their digest: SHA-1 or SHA-256 in hex or base32 are worked out for every response, digests of other kinds
are compared as the headers write them.  ``write_deduplicated`` then streams each archive once more and writes it anew:
originals with their payload, the others as revisit records that name the original's record, address and date.  Every record
gets a fresh id, and headers that name a record of the archives get that one's.  Payloads never cross a shuffle.

A digest that many headers share is spread over ``SALTS`` salts in each join; Spark's adaptive join splits what is larger still.

Edge cases: a null payload is an empty one; payloads under ``min_bytes`` are always responses; rows with a null id never
become an original of others (where all rows of a digest have null ids, each stays a response); rows that repeat an id
and a payload: one of them stays the response; a revisit whose payload no archive holds stays a revisit of what it named; a
record that cannot be read (cut short, damaged, without a length) is a row of type ``damaged`` at its offset, reading goes on at
the next sound one, and it is left out of the new archive; very long payloads are held one at a time; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import datetime
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import filesystem, scratch_path, written

MIN_BYTES = 100
ARCHIVE_BYTES = 64 << 20
SALTS = 16
HEADER_SCHEMA = "page_id long, archive string, offset long, record_id string, target_uri string, date string, record_type string, refers_to string, payload_bytes long, payload_digest string, digests array<string>, links array<string>"
#: Headers that name other records.
LINKS = ("warc-refers-to", "warc-concurrent-to", "warc-warcinfo-id")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"


def _record_id(folder: str, archive: str, place: int) -> str:
    """A record's name follows from its place, so that a repeated task gives the same one and others can work it out."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{folder}/{archive}/{place}')}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", compresslevel=2, mtime=0)


def canonical_digest(label: str) -> str:
    """``algorithm:hex`` of a digest that is written in hex or base32; one of another kind as it is written."""
    name, _, value = label.strip().partition(":")
    name, value = name.lower().replace("-", ""), value.strip()
    size = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}.get(name)
    try:
        if size and len(value) == 2 * size:
            return f"{name}:{bytes.fromhex(value).hex()}"
        if size and len(value.rstrip("=")) == -(-8 * size // 5):
            bare = value.rstrip("=").upper()
            return f"{name}:{base64.b32decode(bare + '=' * (-len(bare) % 8)).hex()}"
    except (ValueError, binascii.Error):
        pass
    return label.strip()


def _http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").replace(" ", "").startswith("application/http") else block


class _Writer:
    """Archives of one task; each gets its final name when it is whole, and a repeated task replaces it by an equal one."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = filesystem(folder)
        self.name, self.number, self.stream = name, 0, None

    def current(self) -> str:
        return f"{self.name}-{self.number:04d}.warc.gz"

    def add(self, data: bytes) -> None:
        if self.stream is None:
            self.temporary = f"{self.folder}/_{uuid.uuid4().hex}.tmp"
            self.stream, self.size = self.fs.open_output_stream(self.temporary, compression=None), 0
        self.stream.write(data)
        self.size += len(data)
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.current()}")
            self.stream, self.number = None, self.number + 1


def _new_folder(spark: SparkSession, label: str) -> str:
    folder = scratch_path(spark, label)
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    return folder


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None) -> int:
    """One response record per row; returns the number of records.  ``date``: when the pages were fetched, by default now."""
    when = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, n = _Writer(folder, f"part-{TaskContext.get().partitionId():06d}"), 0
        for batch in batches:
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                target = (url or "").replace("\r", "%0D").replace("\n", "%0A") or "about:blank"
                headers = [("WARC-Record-ID", _record_id(folder, out.current(), n)), ("WARC-Date", when), ("WARC-Target-URI", target)]
                headers += [("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()), ("Content-Type", HTTP), ("X-Row-Id", "" if page_id is None else str(page_id))]
                out.add(_record("response", headers, _http(payload)))
                n += 1
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col).cast("string"))
    return rows.mapInArrow(store, "n long").agg(F.sum("n")).first()[0] or 0


def _member(file, start: int) -> tuple[int, bytes] | None:
    """(its end, content) of the gzip member at ``start``; None at the end of the file.  Fails where the member is damaged."""
    file.seek(start)
    inflate, parts, end = zlib.decompressobj(31), [], start
    while not inflate.eof:
        held = file.read(min(1 << 20, max(1 << 15, end - start)))
        if not held:
            if end == start:
                return None
            raise ValueError("cut short")
        parts.append(inflate.decompress(held))
        end += len(held) - len(inflate.unused_data)
    return end, b"".join(parts)


def _parsed(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers with names in lower case, block) of a record."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        raise ValueError("not a record")
    lines = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")[1:]
    fields = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
    named = dict(fields)
    size = int(named["content-length"])
    if "warc-type" not in named or not 0 <= size <= len(rest):
        raise ValueError("not a whole record")
    return fields, rest[:size]


def _next_member(file, start: int) -> int | None:
    """Where the next bytes stand, from ``start`` on, that may begin a gzip member."""
    magic, kept, at = b"\x1f\x8b\x08", b"", start
    file.seek(start)
    while held := file.read(1 << 20):
        window = kept + held
        if (found := window.find(magic)) >= 0:
            return at - len(kept) + found
        at, kept = at + len(held), window[-2:]
    return None


def _records(file) -> Iterator[tuple[int, list[tuple[str, str]] | None, bytes]]:
    """(offset, headers with names in lower case, block) of each gzip member; holds one record at a time.

    A stretch of the file that cannot be read is one record without headers; reading goes on at the next sound member.
    """
    file, at, damaged = io.BufferedReader(file, 1 << 20), 0, False
    while at is not None:
        try:
            if (found := _member(file, at)) is None:
                return
            yield at, *_parsed(found[1])
            at, damaged = found[0], False
        except (ValueError, KeyError, zlib.error):
            if not damaged:
                yield at, None, b""
            at, damaged = _next_member(file, at + 1), True


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    """The names of the archives, one partition for each."""
    fs, path = filesystem(folder)
    names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(".warc.gz"))
    return spark.createDataFrame([(x,) for x in names], "archive string").repartitionByRange(max(1, len(names)), "archive")


def _row_id(headers: dict[str, str]) -> int | None:
    """The page's id; archives from elsewhere have none."""
    text = headers.get("x-row-id", "")
    return int(text) if text.lstrip("-").isdecimal() else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: its headers and, of all but revisits, length and digest of the payload as read.

    ``digests`` are others that the payload goes by: its SHA-1 and what the header says.  A revisit has those that its header
    says, the record that it names in ``refers_to``, and no length.  ``links`` are all records that a record names.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            rows = []
            with fs.open_input_file(f"{path}/{name}") as f:
                for offset, fields, block in _records(f):
                    if fields is None:
                        rows.append((None, name, offset, None, None, None, "damaged", None, None, None, [], []))
                        continue
                    h = dict(fields)
                    kind, size, digest = h["warc-type"], None, None
                    digests = {canonical_digest(h["warc-payload-digest"])} if h.get("warc-payload-digest") else set()
                    if kind != "revisit":
                        payload = _payload(h, block)
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        digests |= {"sha1:" + hashlib.sha1(payload, usedforsecurity=False).hexdigest()}
                        digests -= {"sha256:" + digest}
                    links = sorted({v for k, v in fields if k in LINKS and v})
                    rows.append((_row_id(h), name, offset, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), kind, h.get("warc-refers-to"), size, digest, sorted(digests), links))
                    if len(rows) >= 5000:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    return _archives(spark, folder).mapInArrow(scan, HEADER_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in HEADER_SCHEMA.split(", ")])


def _salted(rows: DataFrame, table: DataFrame, left: str, right: str) -> DataFrame:
    """Left join of headers, of which many may share a key, to a table with one row for each key (``right`` goes)."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("archive", "offset"), F.lit(SALTS)).cast("int"))
    table = table.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(table, (rows[left] == table[right]) & (rows["_salt"] == table["_salt2"]), "left").drop("_salt", "_salt2", right)


def _followed(headers: DataFrame) -> DataFrame:
    """``headers`` in which revisits have the ``payload_digest`` of the response that they name or whose digest they share.

    Only keys that some revisit asks for leave the table of the responses.
    """
    is_response, is_revisit = F.col("record_type") == "response", F.col("record_type") == "revisit"
    by_id = F.when(F.col("refers_to").isNotNull(), F.struct(F.lit(0).alias("rank"), F.concat(F.lit("id "), "refers_to").alias("key")))
    by_digest = F.transform("digests", lambda d: F.struct(F.lit(1).alias("rank"), d.alias("key")))
    asks = headers.where(is_revisit).select("archive", "offset", F.explode(F.array_compact(F.concat(F.array(by_id), by_digest))).alias("_ask")).select("archive", "offset", "_ask.*")
    keys = F.concat(F.array(F.concat(F.lit("id "), "record_id"), F.concat(F.lit("sha256:"), "payload_digest")), F.col("digests"))
    held = headers.where(is_response).select(F.explode(F.array_compact(keys)).alias("_key"), F.struct("archive", "offset", "payload_digest").alias("_held"))
    held = held.join(asks.select(F.col("key").alias("_key")).distinct(), "_key", "left_semi").groupBy("_key").agg(F.min("_held")["payload_digest"].alias("_digest"))
    found = _salted(asks, held, "key", "_key").where(F.col("_digest").isNotNull()).groupBy("archive", "offset").agg(F.min(F.struct("rank", "_digest"))["_digest"].alias("_digest"))
    revisits = headers.where(is_revisit).join(found, ["archive", "offset"], "left").withColumn("payload_digest", F.col("_digest")).drop("_digest")
    return headers.where(~is_revisit).unionByName(revisits)


def _linked(headers: DataFrame) -> DataFrame:
    """archive, offset and ``linked``: id, archive and offset of each record of the archives that a record names."""
    asks = headers.select("archive", "offset", F.explode("links").alias("id"))
    places = headers.where(F.col("record_id").isNotNull()).groupBy(F.col("record_id").alias("_id")).agg(F.min(F.struct("archive", "offset")).alias("_place"))
    found = _salted(asks, places, "id", "_id").where(F.col("_place").isNotNull())
    return found.groupBy("archive", "offset").agg(F.collect_list(F.struct("id", "_place.archive", "_place.offset")).alias("linked"))


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds ``original`` (null: the record stays what it is) to headers: page_id, archive, offset, target_uri and date of the
    response that the record is to revisit, and ``linked``: where the records stand that its headers name.  Revisits that were
    there get theirs whatever the size of the payload.  ``headers`` should be a written table: it is read several times.

    Originals are picked by partial aggregation; only digests that occur more than once are repeated for every salt.
    """
    is_response, is_revisit = F.col("record_type") == "response", F.col("record_type") == "revisit"
    # Archives without revisits or links need none of the lookups.
    has = headers.agg(F.max(is_revisit).alias("revisits"), F.max(F.size("links") > 0).alias("links")).first()
    linked = _linked(headers) if has["links"] else None
    if has["revisits"]:
        headers = _followed(headers)
    large = is_response & (F.col("payload_bytes") >= min_bytes)
    # Rows with an id come first; the others only stand for revisits that have no better one.
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "offset", "target_uri", "date")).alias("first")
    several = headers.where(is_response).groupBy("payload_digest").agg(first, F.count("*").alias("n"), F.max("payload_bytes").alias("bytes"))
    wanted = (F.col("n") > 1) & (F.col("bytes") >= min_bytes)
    if has["revisits"]:
        asked = headers.where(is_revisit).select("payload_digest").distinct().withColumn("asked", F.lit(True))
        several = several.join(asked, "payload_digest", "left")
        wanted = wanted | F.col("asked")
    several = several.where(wanted).select(F.col("payload_digest").alias("_digest"), "first")
    is_first = F.struct("archive", "offset") == F.struct("first.archive", "first.offset")
    original = F.when(is_revisit | (large & ~F.col("first.none") & ~is_first), F.col("first"))
    out = _salted(headers, several, "payload_digest", "_digest").withColumn("original", original).drop("first")
    if linked is None:
        return out.withColumn("linked", F.array().cast("array<struct<id:string,archive:string,offset:bigint>>"))
    return out.join(linked, ["archive", "offset"], "left")


def write_deduplicated(spark: SparkSession, source: str, resolved: DataFrame, target: str) -> int:
    """Write the archives of ``source`` anew: what has an original loses its payload and becomes its revisit; all get fresh ids.

    Returns the number of records written, which leaves out damaged ones.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(source)
        stream, records, out, current, n = None, None, None, None, 0
        for batch in batches:
            for name, offset, original, linked in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != current:
                    if out:
                        out.close()
                        stream.close()
                    stream = fs.open_input_file(f"{path}/{name}")
                    records, out, current = _records(stream), _Writer(target, name.removesuffix(".warc.gz")), name
                at, fields, block = next(records)
                if at != offset:
                    raise ValueError(f"{name} has a record at {at} where its headers say {offset}")
                if fields is None:
                    continue
                h = dict(fields)
                places = {x["id"]: _record_id(target, x["archive"], x["offset"]) for x in linked or ()}
                fresh = [("WARC-Record-ID", _record_id(target, name, offset))]
                if original is None and h["warc-type"] != "response":
                    left = [(k, places.get(v, v) if k in LINKS else v) for k, v in fields if k not in ("warc-type", "warc-record-id", "content-length")]
                    out.add(_record(h["warc-type"], [*fresh, *left], block))
                    n += 1
                    continue
                fresh += [("WARC-Date", h.get("warc-date", "")), ("WARC-Target-URI", h.get("warc-target-uri", ""))]
                fresh += [(k, places.get(v, v)) for k, v in fields if k in LINKS and k != "warc-refers-to"]
                row = [("X-Row-Id", h["x-row-id"])] if "x-row-id" in h else []
                if original is not None:
                    named = [("WARC-Refers-To", _record_id(target, original["archive"], original["offset"])), ("WARC-Refers-To-Target-URI", original["target_uri"] or ""), ("WARC-Refers-To-Date", original["date"] or "")]
                    # What a revisit says itself (the head of its reply) stays; of a response only the payload's digest does.
                    was = h["warc-type"] == "revisit"
                    kept = [("Content-Type", h["content-type"])] if was and "content-type" in h else []
                    digest = [("WARC-Payload-Digest", h["warc-payload-digest"])] if h.get("warc-payload-digest") else []
                    out.add(_record("revisit", [*fresh, *digest, ("WARC-Profile", PROFILE), *named, *kept, *row], block if was else b""))
                else:
                    digest = "sha256:" + hashlib.sha256(_payload(h, block)).hexdigest()
                    out.add(_record("response", [*fresh, ("WARC-Payload-Digest", digest), ("Content-Type", h.get("content-type", HTTP)), *row], block))
                n += 1
        if out:
            out.close()
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    # All headers of an archive meet in one task, in the order of the file; archives are bounded in size.
    parts = max(1, resolved.select("archive").distinct().count())
    rows = resolved.select("archive", "offset", "original", "linked").repartitionByRange(parts, "archive").sortWithinPartitions("archive", "offset")
    return rows.mapInArrow(rewrite, "n long").agg(F.sum("n")).first()[0] or 0


def described(headers: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (a page_id) of responses and revisits.

    A revisit has no payload of its own: length and digest come from the record that it names; both are null in case no archive
    holds that.
    """
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses, revisits = headers.where(F.col("record_type") == "response"), headers.where(F.col("record_type") == "revisit")
    named = revisits.select(F.col("refers_to").alias("record_id")).distinct()
    # A record id that archives repeat stands for its first record.
    full = responses.join(named, "record_id").groupBy(F.col("record_id").alias("_id"))
    full = full.agg(F.min(F.struct("archive", "offset", "page_id", "payload_bytes", "payload_digest")).alias("_full"))
    full = full.select("_id", F.col("_full.page_id").alias("_page"), F.col("_full.payload_bytes").alias("_bytes"), F.col("_full.payload_digest").alias("_digest"))
    joined = _salted(revisits, full, "refers_to", "_id")
    found = joined.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"))
    return responses.select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(found)


def deduplicated_pages(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write, resolve, write deduplicated, read back: one row per page."""
    spark = pages.sparkSession
    raw, target = _new_folder(spark, "warc-raw"), _new_folder(spark, "warc")
    write_archives(pages, raw, id_col, url_col, payload_col)
    headers = written(read_archives(spark, raw), "warc-headers")
    resolved = written(resolve_revisits(headers, min_bytes), "warc-resolved")
    write_deduplicated(spark, raw, resolved, target)
    return described(written(read_archives(spark, target), "warc-back"))
