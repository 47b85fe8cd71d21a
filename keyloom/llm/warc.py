"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL key and page_id, so archives, index blocks and keys run in one order. Each task writes one
archive (a gzip member per record), one index of compressed blocks of lines, and one sparse directory with the first key of each block.
Reading searches the parts' first keys, then a part's directory, then a block by bisection and reads byte ranges of an archive; keys that
are read in order share the directory, the block and the range that they need. `round_trip` reads every page back that way.

Of captures with equal payloads of at least `least` bytes the one with the largest page_id is a response, the others revisit it. Which
do is found from digests alone; the verdicts are sorted among the payloads, which are shuffled once.

Defined results: a null payload is empty; a null url has the key `-`; page_id null never is revisited and stays a response where
all ids of a payload are null; rows that agree in page_id and payload are each written, as responses if the id is the largest;
extra columns are dropped; an empty table has no archive. A very long page is one record, held whole. Rows that agree in URL key and
page_id are written by one task.
"""

from __future__ import annotations

import base64
import bisect
import datetime
import gzip
import hashlib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise
from .store import Reader, filesystem, own_name

#: A block ends at so many lines or bytes of archive.
LINES, SPAN = 500, 4 << 20
LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
#: Host, port, path and query of a URL, for Python and Java alike.
_URL = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(?:#[\s\S]*)?$"


def url_key(url: str | None) -> str:
    """`http://www.Example.com:80/a?b` as `com,example,www)/a?b`; control characters and spaces are escaped."""
    if not url:
        return "-"
    url = url.strip(" ")
    found = re.match(_URL, url)
    if not found:
        return _plain(url)
    host, port, path, query = (x or "" for x in found.groups())
    port = f":{port}" if port not in ("", "80", "443") else ""
    return _plain(",".join(reversed(host.lower().split("."))) + port + ")" + (path or "/") + query)


def _plain(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in text)


def key_column(url: Column) -> Column:
    """`url_key` in built-in expressions."""
    bare = F.trim(url)
    part = lambda k: F.regexp_extract(bare, _URL, k)
    host = F.array_join(F.reverse(F.split(F.lower(part(1)), r"\.")), ",")
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.when(part(3) == "", "/").otherwise(part(3))
    key = F.when(bare.rlike(_URL), F.concat(host, port, F.lit(")"), path, part(4))).otherwise(bare)
    escaped = F.array_join(F.transform(F.split(key, ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")
    key = F.when(key.rlike(r"[\x00-\x20\x7f]"), escaped).otherwise(key)
    return F.when(url.isNull() | (url == ""), "-").otherwise(key)


def place(key: str, page_id: int | None) -> tuple:
    """Where a capture stands in the order of archives and indexes; null ids come first."""
    return key, page_id is not None, page_id or 0


def _record(row: dict) -> bytes:
    body = row["payload"]
    base32 = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    revisit = row["kind"] == "revisit"
    content = http if revisit else http + body
    head = [
        "WARC/1.1", f"WARC-Type: {row['kind']}", f"WARC-Record-ID: <{_ID}{row['page_id']}>", f"WARC-Date: {row['date']}",
        f"WARC-Target-URI: {_plain(row['url'] or '')}", f"WARC-Payload-Digest: sha1:{base32}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{row['refers_to']}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(content)}",
    ]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + content + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of one record; a response's payload is held against its digest."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    content = rest[: int(fields["Content-Length"])]
    http, _, body = content.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda v: None if v in (None, "None") else int(v)
    ident = lambda k: number(fields[k][1:-1].removeprefix(_ID)) if k in fields else None
    if fields["WARC-Type"] == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": ident("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": ident("WARC-Refers-To"), "url": fields["WARC-Target-URI"], "payload": body}


def _writer(folder: str, date: str):
    names = ["index", "directory", "archive", "first_key", "first_id", "n_blocks"]
    kinds = [pa.string()] * 4 + [pa.int64()] * 2

    def run(batches):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        archive, index, directory = own_name("archive", ".warc.gz"), own_name("index", ".cdx"), own_name("directory", ".json")
        out, lines, entries, first, at, index_at, began = None, [], [], None, 0, 0, 0
        here, verdicts = None, {}

        def close_block():
            nonlocal index_at, began
            if lines:
                packed = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
                index_out.write(packed)
                entries.append((*first, index_at, len(packed)))
                index_at += len(packed)
                lines.clear()
            began = at

        for batch in batches:
            for row in batch.to_pylist():
                if (row["key"], row["page_id"]) != here:
                    here, verdicts = (row["key"], row["page_id"]), {}
                if row["digest"] is not None:  # a verdict; those of a capture come before it
                    verdicts[row["digest"]] = row["refers_to"]
                    continue
                if out is None:
                    out, index_out = fs.open_output_stream(f"{path}/{archive}", compression=None), fs.open_output_stream(f"{path}/{index}", compression=None)
                    out.write(info := gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{archive}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(), 1, mtime=0))
                    at = began = len(info)
                digest = hashlib.sha1(row["payload"]).hexdigest()
                refers_to = verdicts.get(digest)
                member = _record(row | {"digest": digest, "date": date, "refers_to": refers_to, "kind": "response" if refers_to is None else "revisit"})
                out.write(member)
                if not lines:
                    first = here
                lines.append(f"{row['key']} {json.dumps({'archive': archive, 'offset': at, 'length': len(member), 'page_id': row['page_id']})}")
                at += len(member)
                if len(lines) >= LINES or at - began >= SPAN:
                    close_block()
        if out is None:
            return
        close_block()
        out.close()
        index_out.close()
        with fs.open_output_stream(f"{path}/{directory}", compression=None) as f:
            f.write(json.dumps(entries).encode())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((index, directory, archive, *entries[0][:2], len(entries)), kinds)], names)

    return run


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST, date: str | None = None) -> tuple[str, DataFrame]:
    """Write archives and index; returns the folder and the parts, one row per task: index, directory, archive, first_key, first_id,
    n_blocks. The table says nothing of when a page was fetched: records have `date`, or the time of writing."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(key_column(F.col("url").cast("string")).alias("key"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    thin = rows.filter(F.octet_length("payload") >= least).select("key", "page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n"))
    thin = materialise(thin, "digests")
    equal = thin.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")).filter("c > 1 and refers_to is not null")
    revisits = thin.join(equal, ["digest", "n"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    none = F.lit(None)
    verdicts = revisits.select("key", "page_id", none.cast("string").alias("url"), none.cast("binary").alias("payload"), "digest", "refers_to").distinct()
    both = rows.select("*", none.cast("string").alias("digest"), none.cast("long").alias("refers_to")).unionByName(materialise(verdicts, "verdicts"))
    both = both.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", F.col("digest").isNull())
    parts = both.mapInArrow(_writer(folder, date), "index string, directory string, archive string, first_key string, first_id long, n_blocks long")
    return folder, materialise(parts, "parts")


def _lines(data: bytes) -> list[tuple[str, dict]]:
    return [(k, json.loads(v)) for k, v in (line.split(" ", 1) for line in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n"))]


class Index:
    """The two levels: `parts` (first key, first id, index, directory), and what the last search read."""

    def __init__(self, folder: str, parts: list[tuple]):
        self.parts = sorted((place(k, i), index, directory) for k, i, index, directory in parts)
        self.firsts = [p[0] for p in self.parts]
        self.reader = Reader(folder)
        self.directory: tuple = (None, [])
        self.block: tuple = (None, [], [], 0, b"")

    def _entries(self, part: int) -> list[tuple]:
        if self.directory[0] != part:
            with self.reader.fs.open_input_file(f"{self.reader.path}/{self.parts[part][2]}") as f:
                self.directory = part, [(place(k, i), offset, length) for k, i, offset, length in json.loads(f.read())]
        return self.directory[1]

    def _open(self, part: int, offset: int, length: int) -> tuple:
        """(places, lines, where the archive's range begins, the range) of a block."""
        if self.block[0] != (part, offset):
            lines = [x for x in _lines(self.reader.read(self.parts[part][1], offset, length))]
            begin, end = lines[0][1]["offset"], lines[-1][1]["offset"] + lines[-1][1]["length"]
            data = self.reader.read(lines[0][1]["archive"], begin, end - begin)
            self.block = (part, offset), [place(k, x["page_id"]) for k, x in lines], [x for _, x in lines], begin, data
        return self.block[1:]

    def find(self, low: tuple, high: tuple):
        """The records from place `low` to place `high`, both included: bisection in parts, directory and block."""
        for part in range(max(0, bisect.bisect_left(self.firsts, low) - 1), len(self.parts)):
            if self.firsts[part] > high:
                break
            entries = self._entries(part)
            for first, offset, length in entries[max(0, bisect.bisect_left(entries, (low,)) - 1) :]:
                if first > high:
                    break
                places, lines, begin, data = self._open(part, offset, length)
                for x in lines[bisect.bisect_left(places, low) : bisect.bisect_right(places, high)]:
                    yield parse(data[x["offset"] - begin : x["offset"] - begin + x["length"]])


def _parts(parts: DataFrame) -> list[tuple]:
    return [tuple(r) for r in parts.select("first_key", "first_id", "index", "directory").collect()]  # a row per task of the writer


def read_back(folder: str, parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of `wanted` (key, page_id), searched in the index in order."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    shared = wanted.sparkSession.sparkContext.broadcast(_parts(parts))

    def run(batches):
        index = Index(folder, shared.value)
        for batch in batches:
            spots = [place(k, i) for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            found = [r for p in spots for r in index.find(p, p)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds)], names)

    spread = wanted.select("key", "page_id").distinct().repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def captures(pages: DataFrame) -> DataFrame:
    """(key, page_id) of every page."""
    return pages.select(key_column(F.col("url").cast("string")).alias("key"), F.col("page_id").cast("long").alias("page_id"))


def lookup(spark: SparkSession, folder: str, parts: DataFrame, urls: list[str]) -> list[dict]:
    """The records of these URLs, from the driver."""
    index = Index(folder, _parts(parts))
    return [r for url in urls for r in index.find((url_key(url),), (url_key(url), True, 1 << 63))]


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read every one back through the index."""
    folder, parts = write(pages)
    return read_back(folder, parts, captures(pages))


#: DuckDB SQL for `round_trip` of pages whose ids differ and whose URLs hold no blanks.
ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), e AS (SELECT h, max(page_id) AS latest FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN latest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN latest <> page_id THEN latest END AS refers_to, coalesce(url, '') AS url
FROM p LEFT JOIN e ON e.h = p.h
"""
