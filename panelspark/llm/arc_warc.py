r"""Legacy ARC archives to WARC.

``write_arc`` stores pages as ARC files of versions 1 and 2, ``convert`` parses such files by the header
line that each file's version block declares and by the declared lengths, and writes WARC files with
equivalent identifiers, timestamps, types and digests:

* identifier: a name-based UUID of the ARC file's name and the record's number in it, so that a
  task that runs again writes the same one;
* date: the ARC date (14 digits) in ISO form;
* type: of the records with equal payloads of at least MIN_REVISIT bytes the one with the smallest
  page id is a response, the others are revisits that refer to it; smaller ones are responses;
* payload digest: SHA-256 of the full payload, which a revisit keeps although it holds none.

``read_warc`` parses the result again.  The files are written and read by Spark (gzip text writer,
binaryFile reader), so they may lie in any store that Spark reaches.  Payloads are never shuffled:
digests are compared first, and each ARC file then meets the short list of its revisits.

The page id travels in the archived HTTP header, as X-Page-Id.

Defined cases: a null html is an empty payload; a null url becomes ``about:blank``; a null page id has
no header and comes after all others when the response is chosen; of equal ids the record with
the smallest identifier is the response; white space, control and non-ASCII characters of a url are
percent-encoded; an empty table gives archives without records and no rows; other columns are not
archived; a malformed archive stops the job with the file's name.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.tables import released
from panelspark.llm.textscan import flat, pieces

MIN_REVISIT = 100
FILE_RECORDS = 1000
DATE = "20240101000000"
OUT_BYTES = 4 << 20        # record text that a task holds before it passes it on

#: Fixed values of the ARC format: the header lines' fields by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
_URL_CHARS = "".join(map(chr, range(0x21, 0x7F)))


def _arc_line(version: int, url: str, date: str, kind: str, length: int, name: str) -> str:
    more = f" 200 - - 0 {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind}{more} {length}\n"


def _arc_file_header(version: int, name: str, date: str) -> str:
    block = f"{version} 0 archive\n{ARC_FIELDS[version]}\n"
    return _arc_line(version, f"filedesc://{name}", date, "text/plain", len(block), name) + block


def _rows(values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
              date: str = DATE) -> None:
    """ARC files of at most FILE_RECORDS records, of versions 1 and 2 in turn."""
    src = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for piece in pieces(batches, "html", OUT_BYTES):
            out = []
            size = flat(piece.column("html"))[1]
            for i, (page, link, text) in enumerate(zip(*(c.to_pylist() for c in piece.columns), strict=True)):
                version = 1 + (part + n // FILE_RECORDS) % 2
                name = f"pages-{part:06d}-{n // FILE_RECORDS:06d}.arc"
                if n % FILE_RECORDS == 0:          # the writer starts a new file here
                    out.append(_arc_file_header(version, name, date))
                n += 1
                named = "" if page is None else f"X-Page-Id: {page}\r\n"
                length = int(size[i + 1] - size[i])
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n{named}\r\n"
                link = quote("about:blank" if link is None else link, safe=_URL_CHARS)
                out.append(_arc_line(version, link, date, "text/html", len(head) + length, name) + head + (text or ""))
            yield _rows(out)

    (src.mapInArrow(run, "value string").write.mode("overwrite").options(**_GZIP)
     .option("lineSep", "\n").option("maxRecordsPerFile", FILE_RECORDS + 1).text(path))


def parse_arc(raw: bytes, path: str) -> Iterator[tuple[str, int, dict[str, str], bytes, bytes]]:
    """(ARC file name, record number, header fields, HTTP header, payload) of each record."""
    source = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw)), 1 << 20)
    fields: list[str] | None = None
    name, number = "", 0
    while line := source.readline():
        if line == b"\n":
            continue
        got = line.decode().rstrip("\n").split(" ")
        if got[0].startswith("filedesc://"):
            name, number = got[0].removeprefix("filedesc://"), 0
            version, declared = source.read(int(got[-1])).decode().split("\n")[:2]
            if ARC_FIELDS.get(int(version.split(" ")[0])) != declared:
                raise ValueError(f"{path}: unknown ARC version block {version!r}")
            fields = declared.split(" ")
            continue
        if fields is None or len(got) != len(fields):
            raise ValueError(f"{path}: bad ARC header line {line[:200]!r}")
        head = dict(zip(fields, got, strict=True))
        length = int(head["Archive-length"])
        body = source.read(length)
        if len(body) != length or source.read(1) != b"\n":
            raise ValueError(f"{path}: record {number} of {name} is not {length} bytes long")
        http, _, payload = body.partition(b"\r\n\r\n")
        yield name, number, head, http + b"\r\n\r\n", payload
        number += 1


def _http_field(http: bytes, name: bytes) -> str | None:
    for line in http.split(b"\r\n"):
        if line.lower().startswith(name.lower() + b":"):
            return line[len(name) + 1:].strip().decode()
    return None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def record_id(name: str, number: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{name}/{number}')}"


def _arc_digests(files: DataFrame) -> DataFrame:
    """(path, rid, page_id, n, digest) of each ARC record."""
    def run(batches):
        for batch in batches:
            for path, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
                out = [[], [], [], [], []]
                for name, number, _, http, payload in parse_arc(raw, path):
                    page = _http_field(http, b"X-Page-Id")
                    for to, v in zip(out, (path, record_id(name, number), None if page is None else int(page), len(payload),
                                           hashlib.sha256(payload).hexdigest()), strict=True):
                        to.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                    names=["path", "rid", "page_id", "n", "digest"])

    return files.mapInArrow(run, "path string, rid string, page_id long, n long, digest string")


def _warc(kind: str, rid: str, date: str, fields: list[tuple[str, str]], block: str) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", date), *fields,
            ("Content-Length", str(len(block.encode())))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + block


def _iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def convert(spark: SparkSession, arc: str, warc: str, min_revisit: int = MIN_REVISIT) -> None:
    """WARC files at ``warc`` of the ARC files at ``arc``."""
    records = released(_arc_digests(_files(spark, arc)))
    large = records.where(F.col("n") >= min_revisit)
    place = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "rid")
    first = (large.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"))
             .where("copies > 1").select("digest", F.col("first.rid").alias("refers_to")))
    revisits = large.join(first, "digest").where("rid <> refers_to")
    lists = revisits.groupBy("path").agg(F.collect_list(F.struct("rid", "refers_to")).alias("revisits"))

    def run(batches):
        for batch in batches:
            for path, raw, listed in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "revisits")), strict=True):
                refers = {x["rid"]: x["refers_to"] for x in listed or ()}
                out, size, known = [], 0, None
                for name, number, head, http, payload in parse_arc(raw, path):
                    date, rid = _iso(head["Archive-date"]), record_id(name, number)
                    if name != known:
                        known = name
                        out.append(_warc("warcinfo", record_id(name, -1), date, [("Content-Type", "application/warc-fields")],
                                         f"converted-from: {name}\r\n"))
                    fields = [("WARC-Target-URI", head["URL"]), ("WARC-IP-Address", head["IP-address"]),
                              ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
                              ("Content-Type", "application/http; msgtype=response")]
                    block = http.decode()
                    if rid in refers:
                        fields += [("WARC-Refers-To", f"<{refers[rid]}>"),
                                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                        out.append(_warc("revisit", rid, date, fields, block))
                    else:
                        out.append(_warc("response", rid, date, fields, block + payload.decode()))
                    size += len(payload)
                    if size > OUT_BYTES:
                        yield _rows(out)
                        out, size = [], 0
                yield _rows(out)

    (_files(spark, arc).join(lists, "path", "left").mapInArrow(run, "value string").write.mode("overwrite")
     .options(**_GZIP).option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS + 1).text(warc))


def parse_warc(raw: bytes, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by declared lengths."""
    source = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw)), 1 << 20)
    while line := source.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"{path}: bad WARC record start {line[:100]!r}")
        head = {}
        while (line := source.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[key] = value
        length = int(head["Content-Length"])
        block = source.read(length)
        if len(block) != length or source.read(4) != b"\r\n\r\n":
            raise ValueError(f"{path}: record {head.get('WARC-Record-ID')} is not {length} bytes long")
        yield head, block


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(record_id, record_type, page_id, url, date, payload_bytes, payload_digest, refers_to_record,
    payload) of the response and revisit records.  A response's digest is computed anew and must be
    the declared one; a revisit's figures are the declared ones.  ``payload`` only on request."""
    schema = ("record_id string, record_type string, page_id long, url string, date string, payload_bytes long, "
              "payload_digest string, refers_to_record string, payload string")
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for file, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
                out, size = [], 0
                for head, block in parse_warc(raw, file):
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    declared = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != declared:
                        raise ValueError(f"{file}: payload of {head['WARC-Record-ID']} does not match its digest")
                    page = _http_field(http, b"X-Page-Id")
                    n = len(payload) if kind == "response" else int(_http_field(http, b"Content-Length"))
                    out.append((head["WARC-Record-ID"][1:-1], kind, None if page is None else int(page), head["WARC-Target-URI"],
                                head["WARC-Date"], n, declared, head.get("WARC-Refers-To", "")[1:-1] or None,
                                payload.decode() if with_payload and kind == "response" else None))
                    size += len(payload) if with_payload else 0
                    if size > OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return _files(spark, path).mapInArrow(run, schema)


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id): one row per record
    of ``read_warc``, ``refers_to`` being the page id of the record that a revisit refers to."""
    target = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"),
                                                              F.col("page_id").alias("refers_to"))
    plain = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    revisits = records.where("record_type = 'revisit'").join(target, "refers_to_record", "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    return plain.select(*cols).unionByName(revisits.select(*cols))
