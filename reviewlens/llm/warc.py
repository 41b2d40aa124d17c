"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per record; of records with equal payloads one is a response and
the others are revisits that point to it. ``build_index`` sorts captures by reversed-host URL keys into
compressed blocks and keeps a sparse directory, one row per block. ``look_up`` binary-searches the directory,
range-reads and decompresses one block per hit, binary-searches inside, and ``read_records`` range-reads
the records found.

Archives and blocks are ordinary files in the shared folder, opened through ``pyarrow.fs``, so object stores
and HDFS work like local paths. A task names its files freshly and reports what it wrote; a report counts
only once Spark has committed it, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.session import scratch_path
from reviewlens.sources.scratch import materialise

_FILE_BYTES = 256 << 20
_BLOCK_ROWS = 1000
_LEVEL = 4
_SAFE = "".join(map(chr, range(33, 127)))
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "capture string, file string, offset bigint, length bigint"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query; no scheme, port 80 or 443, fragment or login.

    ``https://m.site.org/a?b`` becomes ``org,site,m)/a?b``. Null is the empty key; what is no URL is its own key.
    """
    plain = quote(url or "", safe=_SAFE)
    try:
        parts = urlsplit(plain)
        host, port = parts.hostname, parts.port
    except ValueError:
        return plain
    if not host:
        return plain
    labels = ",".join(reversed(host.rstrip(".").split(".")))
    shown = f":{port}" if port not in (None, 80, 443) else ""
    return f"{labels}{shown}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    """URL key and page, in an order that strings keep; a null page comes first."""
    return f"{url_key(url)}\t{'' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "<urn:page:none>")[len("<urn:page:") : -1]
    return None if number == "none" else int(number)


def _lines(*headers: str) -> bytes:
    return ("\r\n".join(headers) + "\r\n\r\n").encode()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: bool, first: int | None) -> bytes:
    """A WARC 1.1 record, uncompressed. A revisit keeps the response's HTTP head and leaves the payload out."""
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}")
    block = http if revisits else http + payload
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisits:
        headers[4:4] = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(first)}"]
    return _lines(*headers) + block + b"\r\n\r\n"


def _head(raw: bytes) -> tuple[str, dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    return first, {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}, rest


def parse_record(raw: bytes) -> dict:
    """What a record says; the payload is None for revisits. A response whose payload fails its digest raises."""
    version, headers, rest = _head(raw)
    if version != "WARC/1.1" or len(rest) != int(headers["content-length"]) + 4:
        raise ValueError(f"not a whole WARC record: {version[:40]}")
    _, http, payload = _head(rest[: int(headers["content-length"])])
    revisits = headers["warc-type"] == "revisit"
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if not revisits and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
    return {
        "page_id": _page(headers["warc-record-id"]),
        "url": headers["warc-target-uri"],
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
        "record_type": headers["warc-type"],
        "refers_to": _page(headers["warc-refers-to"]) if revisits else None,
        "payload": None if revisits else payload,
    }


@dataclass
class _Files:
    """Appends to fresh files in a folder, a new one when the last is full."""

    folder: str
    suffix: str
    name: str = ""
    at: int = 0
    _out: pa.NativeFile | None = None

    def append(self, data: bytes) -> tuple[str, int, int]:
        if self._out is None or self.at > _FILE_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            system, path = pa.fs.FileSystem.from_uri(self.folder)
            system.create_dir(path, recursive=True)
            self._out = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self._out.write(data)
        start, self.at = self.at, self.at + len(data)
        return self.name, start, len(data)

    def close(self) -> None:
        if self._out is not None:
            self._out.close()
            self._out = None


class _Ranges:
    """Range reads of files in a folder; the file read last stays open."""

    def __init__(self, folder: str) -> None:
        self._system, self._path = pa.fs.FileSystem.from_uri(folder)
        self._name, self._file = "", None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self._name:
            self.close()
            self._file, self._name = self._system.open_input_file(f"{self._path}/{name}"), name
        self._file.seek(offset)
        return self._file.read(length)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


def _write_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, ".warc.gz")
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                record = make_record(row["page_id"], row["url"], payload, digest, row["revisits"], row["first"])
                place = files.append(gzip.compress(record, _LEVEL, mtime=0))
                found.append((capture_key(row["url"], row["page_id"]), *place))
            yield _captures(found)
        files.close()

    return run


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    kinds = (("capture", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))
    return pa.RecordBatch.from_pydict({name: pa.array(values, kind) for (name, kind), values in zip(kinds, columns, strict=True)})


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record per row of ``pages`` into ``folder``; returns the captures, one row each.

    Among payloads of at least ``least_bytes`` that are equal (by SHA-1 and length), rows with the smallest
    page id are responses and the others revisit it; smaller payloads are all responses. A null page id is
    larger than all others. A null html is empty.
    """
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumns({"sha1": F.sha1(body), "bytes": F.length(body).cast("long")})
    # Partial minimums, and only groups with something to refer to; written, so that the join has two plain
    # exchanges and a payload that a third of the pages share is split over tasks.
    shared = rows.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes")
    shared = shared.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(materialise(shared, "payloads"), ["sha1", "bytes"], "left")
    revisits = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    dealt = joined.select("page_id", "url", "html", "sha1", revisits.alias("revisits"), "first")
    return materialise(dealt.mapInArrow(_write_batches(folder), _CAPTURE), "captures")


@dataclass(frozen=True)
class CaptureIndex:
    """Folder of blocks and path of the directory table ``(first, last, file, offset, length)``."""

    blocks: str
    directory: str


def _block_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, out = _Files(folder, ".index"), [], []

        def block(rows: list[dict]) -> None:
            lines = "".join(f"{r['capture']}\t{r['file']}\t{r['offset']}\t{r['length']}\n" for r in rows)
            place = files.append(gzip.compress(lines.encode(), _LEVEL, mtime=0))
            out.append((rows[0]["capture"], rows[-1]["capture"], *place))

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= _BLOCK_ROWS:
                block(held[:_BLOCK_ROWS])
                held = held[_BLOCK_ROWS:]
        if held:
            block(held)
        files.close()
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        names = ("first", "last", "file", "offset", "length")
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, k, v in zip(names, kinds, columns, strict=True)})

    return run


def _sorted(df: DataFrame, *columns: str) -> DataFrame:
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def build_index(captures: DataFrame, folder: str) -> CaptureIndex:
    """Sorts captures by key over range partitions into blocks of 1,000 and writes the sparse directory."""
    keyed = _sorted(captures, "capture", "file", "offset")
    directory = keyed.mapInArrow(_block_batches(folder), "first string, last string, file string, offset bigint, length bigint")
    path = f"{folder}-directory"
    directory.write.parquet(path)
    return CaptureIndex(folder, path)


def _find_batches(index: CaptureIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Ranges(index.blocks)
        system, path = pa.fs.FileSystem.from_uri(index.directory)
        for batch in batches:
            wanted = batch.to_pylist()
            if not wanted:
                continue
            # Wanted keys are sorted: only the part of the directory between the first and the last is read.
            filters = [("last", ">=", wanted[0]["low"]), ("first", "<=", max(w["high"] for w in wanted))]
            part = pq.read_table(path, filesystem=system, filters=filters).sort_by("first").to_pylist()
            lasts, found, seen = [row["last"] for row in part], [], (-1, [], [])
            for w in wanted:
                at = bisect.bisect_left(lasts, w["low"])
                while at < len(part) and part[at]["first"] <= w["high"]:
                    if seen[0] != at:
                        raw = blocks.read(part[at]["file"], part[at]["offset"], part[at]["length"])
                        lines = [line.rsplit("\t", 3) for line in gzip.decompress(raw).decode().split("\n")[:-1]]
                        seen = (at, [line[0] for line in lines], lines)
                    low, high = bisect.bisect_left(seen[1], w["low"]), bisect.bisect_right(seen[1], w["high"])
                    found += [(key, file, int(offset), int(length)) for key, file, offset, length in seen[2][low:high]]
                    at += 1
            yield _captures(found)
        blocks.close()

    return run


def _range_batches(exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            if exact:
                low = high = [capture_key(u, p) for u, p in zip(urls, batch.column("page_id").to_pylist(), strict=True)]
            else:
                low, high = [url_key(u) + "\t" for u in urls], [url_key(u) + "\t~" for u in urls]
            yield pa.RecordBatch.from_pydict({"low": pa.array(low, pa.string()), "high": pa.array(high, pa.string())})

    return run


def look_up(index: CaptureIndex, wanted: DataFrame) -> DataFrame:
    """Captures of the ``url`` s in a table, or of the pages, if it has ``page_id`` as well; each once.

    Requests are sorted like the index, so a task reads a stretch of the directory and each block once.
    """
    exact = "page_id" in wanted.columns
    ranges = wanted.select("url", "page_id") if exact else wanted.select("url")
    keyed = ranges.mapInArrow(_range_batches(exact), "low string, high string").distinct()
    return _sorted(keyed, "low", "high").mapInArrow(_find_batches(index), _CAPTURE)


def _read_batches(folder: str, with_payload: bool):
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
    kinds |= {"record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if with_payload else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Ranges(folder)
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)
            records = []
            for place in places:
                record = parse_record(gzip.decompress(archives.read(*place)))
                records.append(record if with_payload else record | {"payload": None})
            yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in records], k) for n, k in kinds.items()})
        archives.close()

    return run


_RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_records(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of captures, by range reads in the order of the files."""
    schema = _RECORD + (", payload binary" if with_payload else "")
    return _sorted(captures, "file", "offset").mapInArrow(_read_batches(folder, with_payload), schema)


def archived_pages(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives ``pages`` below the shared folder, indexes them and reads every page back through the index.

    One row per row of ``pages`` with page_id, url, payload_bytes, payload_digest, record_type and
    refers_to. Repeated pages come back repeated. Other columns are not read.
    """
    root = scratch_path(pages.sparkSession, "warc")
    root = root if "://" in root else root.replace("file:", "file://", 1) if root.startswith("file:") else f"file://{root}"
    captures = write_archives(pages, f"{root}/archives", least_bytes, page_id, url, html)
    index = build_index(captures, f"{root}/index")
    wanted: list[Column] = [F.col(url).alias("url"), F.col(page_id).cast("long").alias("page_id")]
    return read_records(look_up(index, pages.select(*wanted)), f"{root}/archives")
