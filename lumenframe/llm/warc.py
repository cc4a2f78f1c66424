"""WARC writing with revisit resolution.

Headers (payload digest and id, no bodies) are aggregated by digest to find each payload's original; revisits are joined to their originals' records; archives are
written with fresh headers by Spark's text writer, whose lines are whole records, so they land on any file system that Spark knows and follow its commit protocol.
Reading streams each archive and resolves revisits by a join on the original's page.

Defined cases: a null html is an empty payload; of rows that repeat the original's page and payload all are responses; a null page_id sorts last, so it is the
original only where every page of its payload is null; an empty table gives no records. Extra input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

DATE = "2024-01-01T00:00:00Z"
#: Payloads smaller than this are always written whole.
MIN_REVISIT_BYTES = 0
#: Records a file holds at most.
FILE_RECORDS = 2_000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string column: each 5 hex digits are 4 letters."""
    hex40 = F.sha1(payload.cast("binary"))
    letters = []
    for i in range(8):
        n = F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_ALPHABET), (F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def record_id(page: Column, url: Column, kind: Column) -> Column:
    h = F.md5(F.concat_ws("|", kind, F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-"))))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def resolve(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest, record_type, refers_to and refers_url (both null for responses)."""
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    full = full.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", base32_sha1(F.col("html")))
    headers = full.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "url", F.col("payload_digest").alias("digest"))
    firsts = headers.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("times")).filter("times > 1 AND first_page IS NOT NULL").drop("times")
    out = full.join(firsts, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= min_bytes), "left")
    revisit = F.col("first_page").isNotNull() & ~F.col("first_page").eqNullSafe(F.col("page_id"))
    return out.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_page")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url")
    )


def records(resolved: DataFrame) -> DataFrame:
    """(record): each row's whole WARC record, but for its last line end."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    optional = lambda name, value: F.when(value.isNotNull(), line(name, value)).otherwise(F.lit(""))
    plain = lambda x: F.regexp_replace(x, r"[\r\n]", " ")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL + EOL))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("record_type"))),
        line("WARC-Date", F.lit(DATE)),
        optional("WARC-Target-URI", plain(F.col("url"))),
        optional("WARC-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{EOL}")).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("refers_url"), F.lit("response")))).otherwise(F.lit("")),
        F.when(revisit, optional("WARC-Refers-To-Target-URI", plain(F.col("refers_url")))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string"))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Refers-To-Date", F.lit(DATE))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{EOL}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(EOL),
    )
    return resolved.select(F.concat(head, block, F.lit(EOL)).alias("record"))


def write(resolved: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Archives below path, each one gzip stream of records."""
    records(resolved).write.option("lineSep", EOL).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


class _Stream:
    """Bytes of a gzip archive as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.z, self.buffer = memoryview(data), 0, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        while self.at < len(self.data):
            if self.z.eof:
                rest = self.z.unused_data
                self.at -= len(rest)
                self.z = zlib.decompressobj(31)
                if self.at >= len(self.data):
                    return False
            piece = self.data[self.at : self.at + 262_144]
            self.at += len(piece)
            got = self.z.decompress(piece)
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        return self._take(i + len(mark))

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("archive ends inside a record")
        return self._take(n)

    def _take(self, n: int) -> bytes:
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse(data: bytes):
    """(headers, http headers, payload) of each record of an archive."""
    s = _Stream(data)
    while (head := s.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").split(EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        named = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        block = s.exactly(int(named["Content-Length"]))
        if s.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record has no end")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield named, http, payload


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the archives below path: digest and size are those of the payload read; for revisits they are the recorded digest and null."""

    def run(batches):
        for b in batches:
            for data in b.column("content"):
                rows = []
                for named, _, body in parse(data.as_py()):
                    revisit = named["WARC-Type"] == "revisit"
                    own = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    said = named["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and own != said:
                        raise ValueError(f"payload of {named['WARC-Record-ID']} has digest {own}, not {said}")
                    page, refers = named.get("WARC-Page-ID"), named.get("WARC-Refers-To-Page-ID")
                    rows.append((int(page) if page else None, named.get("WARC-Target-URI"), named["WARC-Type"], None if revisit else len(body), said, int(refers) if refers else None, *([None if revisit else body] if payload else [])))
                    if len(rows) >= 1000:
                        yield _batch(rows, payload)
                        rows = []
                yield _batch(rows, payload)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, READ + (", payload binary" if payload else ""))


def _batch(rows: list[tuple], payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payload
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payload
    columns = list(zip(*rows)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def resolved_records(read_back: DataFrame) -> DataFrame:
    """Revisits with the size of their original's payload; an original is found by page and digest."""
    originals = read_back.filter("record_type = 'response' AND page_id IS NOT NULL").select(F.col("page_id").alias("o_page"), F.col("payload_digest").alias("o_digest"), F.col("payload_bytes").alias("o_bytes")).dropDuplicates()
    hit = read_back.filter("record_type = 'revisit'").join(originals, (F.col("refers_to") == F.col("o_page")) & (F.col("payload_digest") == F.col("o_digest")), "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read_back.filter("record_type = 'response'").select(*names).union(hit.withColumn("payload_bytes", F.col("o_bytes")).select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(resolve(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    return resolved_records(cut(read(spark, path), "warc-read"))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT page_id, payload_bytes, list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), lambda a, c: a || c) AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_page THEN first_page END AS refers_to FROM f
"""
