"""WARC archives of pages, with a two-level capture index.

Archives are gzip members, one per record, gathered into segments of a few megabytes. A segment is a
complete ``.warc.gz``; the segments of a crawl are rows (archive, data) of a Parquet table in the shared
folder, because executors reach that folder through Spark only. The index sorts captures by
reversed-host URL key into compressed blocks of lines; a sparse directory keeps the first and last key
of each block. A look-up binary-searches the directory, opens only the blocks that may hold the key, and
then takes byte ranges of the archives. Blocks grow with the corpus so that the directory, which is
broadcast, never has more than ``DIRECTORY`` entries.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fieldweave.llm.common import shared_folder, ship, stored

SEGMENT = 4 << 20  # compressed bytes at which a segment ends
BLOCK_LINES, DIRECTORY = 1000, 50_000
DATE = "2024-01-01T00:00:00Z"
SALTS = 16
CAPTURE = "array<struct<key:string,page_id:bigint,offset:bigint,length:bigint>>"


def url_key(url: str | None) -> str:
    """Reversed host, port, path and query, lower case, without scheme and a leading www; empty if there is none."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return re.sub(r"\s", "%20", (url or "").lower())
    reverse = ",".join(reversed(host.split(".")))
    tail = f"{f':{port}' if port else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"
    return re.sub(r"\s", "%20", (reverse + tail).lower())


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, refers_url: str | None) -> bytes:
    """One record; a revisit has headers only."""
    shown = lambda u: re.sub(r"[\r\n]+", "%0A", u or "")
    name = f"<urn:page:{'' if page is None else page}>"
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url} {digest}')}>"), ("WARC-Date", DATE), ("WARC-Target-URI", shown(url)),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page", name)]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is None:
        body += b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", shown(refers_url)), ("X-Refers-To-Page", f"<urn:page:{refers}>")]
        body += b"\r\n"
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def members(data: bytes) -> Iterator[bytes]:
    """The records of a segment, one gzip member at a time."""
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data) + d.flush()
        data = d.unused_data


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; raises ValueError if its lengths do not fit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def _page(shown: str | None) -> int | None:
    number = (shown or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def with_originals(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(id, url, html, digest, refers, refers_url): each page beside the first page of equal payload."""
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    plain = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"))
    groups = plain.where((F.col("size") >= least) & F.col("id").isNotNull()).groupBy("digest").agg(F.min(F.struct("id", F.col("url"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = stored(groups.select("digest", F.col("first.id").alias("to"), F.col("first.url").alias("to_url")), "originals")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ids = plain.select("id", "url", "html", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = ids.join(salted, ["digest", "salt"], "left")
    other = F.col("id") > F.col("to")
    return out.select("id", "url", "html", "digest", F.when(other, F.col("to")).alias("refers"), F.when(other, F.col("to_url")).alias("refers_url"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> str:
    """Write a record per row and return the folder of the table (archive, data, captures).

    Of equal payloads of ``least`` bytes or more the row of the smallest id is a response and the
    others are revisits; rows that repeat that id are responses too. Null html is an empty payload, a null
    url an empty one; a row without an id is a response that nothing refers to. An empty table writes no records.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        data, captures = bytearray(), []

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{number:06d}.warc.gz"], "data": pa.array([bytes(data)], pa.binary()),
                                               "captures": pa.array([captures], pa.list_(pa.struct([("key", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])))})
        for batch in batches:
            for i, url, html, digest, refers, refers_url in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "digest", "refers", "refers_url"))):
                raw = gzip.compress(record(i, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers, refers_url), 6, mtime=0)
                captures.append({"key": url_key(url), "page_id": i, "offset": len(data), "length": len(raw)})
                data += raw
                if len(data) >= SEGMENT:
                    yield segment()
                    data, captures, number = bytearray(), [], number + 1
        if captures:
            yield segment()

    ship(pages.sparkSession)
    path = shared_folder(pages.sparkSession, "warc")
    with_originals(pages, id_col, url_col, html_col, least).mapInArrow(run, f"archive string, data binary, captures {CAPTURE}").write.parquet(path)
    return path


def build_index(spark, archives: str) -> str:
    """Write the blocks (block, first, last, data) of the capture index and return their folder."""
    captures = spark.read.parquet(archives).select("archive", F.explode("captures").alias("c")).select("c.key", "c.page_id", "archive", "c.offset", "c.length")
    captures = captures.where(F.col("page_id").isNotNull())
    lines = max(BLOCK_LINES, 2 * captures.count() // DIRECTORY)
    ordered = captures.repartitionByRange("key", "page_id", "archive", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            text = "\n".join("\t".join(map(str, r)) for r in rows)
            return pa.RecordBatch.from_pydict({"block": [f"{part:06d}-{number:06d}"], "first": [rows[0][0]], "last": [rows[-1][0]], "data": pa.array([zlib.compress(text.encode("utf-8", "surrogatepass"))], pa.binary())})
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "archive", "offset", "length")))
            while len(held) >= lines:
                yield block(held[:lines])
                held, number = held[lines:], number + 1
        if held:
            yield block(held)

    ship(spark)
    path = shared_folder(spark, "captures")
    ordered.mapInArrow(run, "block string, first string, last string, data binary").write.parquet(path)
    return path


def candidate_blocks(first: list[str], last: list[str], key: str) -> range:
    """Numbers of the directory entries whose key range may hold ``key`` (ranges ascend)."""
    return range(bisect.bisect_left(last, key), bisect.bisect_right(first, key))


def look_up(spark, index: str, wanted: DataFrame) -> DataFrame:
    """Captures (key, page_id, archive, offset, length) of the wanted (key, page_id), each once.

    Keys that no block holds give no row.
    """
    wanted = wanted.select("key", "page_id").distinct()
    blocks = spark.read.parquet(index)
    rows = sorted(blocks.select("first", "last", "block").collect())  # at most DIRECTORY entries and one per partition
    directory = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, names = directory.value
        for batch in batches:
            hit = {names[i] for key in set(batch.column("key").to_pylist()) for i in candidate_blocks(first, last, key)}
            yield pa.RecordBatch.from_pydict({"block": pa.array(sorted(hit), pa.string())})

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                cols = list(zip(*(x.split("\t") for x in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n"))))
                number = lambda c: pa.array([int(x) for x in c], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), number(cols[1]), pa.array(cols[2]), number(cols[3]), number(cols[4])], ["key", "page_id", "archive", "offset", "length"])

    named = wanted.mapInArrow(find, "block string").distinct()
    opened = blocks.join(named, "block", "left_semi").select("data").mapInArrow(lines, "key string, page_id long, archive string, offset long, length long")
    found = opened.join(wanted, ["key", "page_id"], "left_semi")
    return found.groupBy("key", "page_id").agg(F.min(F.struct("archive", "offset", "length")).alias("at")).select("key", "page_id", "at.*")


def range_read(spark, archives: str, captures: DataFrame) -> DataFrame:
    """(page_id, headers, payload) of captures, by byte range of their segment."""
    by = captures.groupBy(F.col("archive").alias("own")).agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))  # at most a segment's records
    rows = spark.read.parquet(archives).select("archive", "data").join(by, F.col("archive") == F.col("own")).select("data", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ranges in zip(batch.column("data").to_pylist(), batch.column("ranges").to_pylist()):
                read = [parse(zlib.decompress(data[r["offset"]:r["offset"] + r["length"]], 31)) for r in ranges]
                yield pa.RecordBatch.from_arrays([pa.array([_page(h["X-Page"]) for h, _ in read], pa.int64()), pa.array([list(h.items()) for h, _ in read], pa.map_(pa.string(), pa.string())), pa.array([p for _, p in read], pa.binary())], ["page_id", "headers", "payload"])

    return rows.mapInArrow(run, "page_id long, headers map<string,string>, payload binary")


def read_archives(spark, archives: str) -> DataFrame:
    """(page_id, record_type, url, payload_digest, refers_to, refers_url, payload_bytes) of every record, as read back.

    Digest and size are those of the payload read; a revisit has none of its own and null sizes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                out = []
                for raw in members(data):
                    h, payload = parse(raw)
                    refers = _page(h.get("X-Refers-To-Page"))
                    own = refers is None
                    out.append((_page(h["X-Page"]), h["WARC-Type"], h["WARC-Target-URI"], hashlib.sha256(payload).hexdigest() if own else h["WARC-Payload-Digest"].removeprefix("sha256:"), refers, url_key(h["WARC-Refers-To-Target-URI"]) if not own else None, len(payload) if own else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["page_id", "record_type", "url", "payload_digest", "refers_to", "refers_key", "payload_bytes"])

    return spark.read.parquet(archives).select("data").mapInArrow(run, "page_id long, record_type string, url string, payload_digest string, refers_to long, refers_key string, payload_bytes long")


def archive_report(pages: DataFrame) -> DataFrame:
    """Write all pages, read all records back; what a revisit refers to is fetched through the index."""
    spark = pages.sparkSession
    archives = write_archives(pages.select("page_id", "url", "html"))
    index = build_index(spark, archives)
    back = stored(read_archives(spark, archives), "records")
    wanted = back.where("refers_to IS NOT NULL").select(F.col("refers_key").alias("key"), F.col("refers_to").alias("page_id"))
    full = range_read(spark, archives, look_up(spark, index, wanted)).select("page_id", F.octet_length("payload").cast("long").alias("full_bytes"), F.sha2("payload", 256).alias("full_digest"))
    full = stored(full, "originals_read").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("page_id", "to")
    salted = back.withColumn("salt", F.when(F.col("refers_to").isNotNull(), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")))
    out = salted.join(full, (F.col("refers_to") == F.col("to")) & (salted["salt"] == full["salt"]), "left")
    return out.select("page_id", F.coalesce("full_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("full_digest", "payload_digest").alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), firsts AS (SELECT d, min(page_id) AS m FROM sized WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, sized.d AS payload_digest,
       CASE WHEN m < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m < page_id THEN m END AS refers_to
FROM sized LEFT JOIN firsts ON sized.d = firsts.d AND n >= 100
"""
