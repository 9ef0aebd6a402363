"""WARC archives under a two-level capture index (operator 1).

`write_archives` writes one gzipped WARC file a task, a gzip member a record, and returns one index line a record. `CaptureIndex.build`
range-sorts those lines by reversed-host URL key into shards of compressed blocks; every shard keeps a sparse directory of its blocks'
first keys, and the index keeps the shards' first keys. A look-up binary-searches the shards, then the shard's directory, then range-reads
one block, and so finds the archive, offset and length of a record, which `read_records` range-reads. Only the shards' first keys are held
by every task; their number is that of the index's partitions, not of its captures.

Records of equal payloads of at least `least` bytes: the one with the smallest page_id is the response, the others are revisits that name it
and hold its HTTP header but no payload.

Defined cases: a null html is empty; a null url has the empty key; repeated rows of one page_id are a record each, and those
with the smallest page_id of their payload are all responses; a null page_id counts as larger than any other; hosts are compared in
lower case, without a leading www and the default port; a payload held by a third of all pages is resolved through one row a payload;
an empty table gives no rows; other columns are ignored.

Archives lie in the shared folder as real files: this module writes them with pyarrow's file systems, by the folder's URI. A file's name
is unique to the task attempt and only files of attempts that succeeded get into the index, so lost executors leave unread files only.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import Scratch, slices

#: Fixed values of the archive format.
VERSION, CRLF = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LINE = "surt string, page_id long, file string, offset long, length long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: A capture date for tables without one.
DATE = "2024-01-01T00:00:00Z"


def surt(url: str = "url"):
    """Column: the URL with its host's labels reversed, as com,example)/path?query; without scheme, user, port and fragment."""
    text = F.coalesce(F.col(url), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(text, r"#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^(?:[^/?@]*@)?([^/?:]*)", 1)), r"^www[0-9]*\.", "")
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    return F.when(text == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    )


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record(page: int | None, url: str | None, payload: bytes, digest: str, response: bool, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if response else http
    fields = [
        ("WARC-Type", "response" if response else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Page-ID", "" if page is None else str(page)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if not response:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head = VERSION + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in fields) + CRLF
    return head + block + CRLF + CRLF


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    head, _, rest = data.partition(CRLF + CRLF)
    first, *lines = head.split(CRLF)
    if first != VERSION:
        raise ValueError("no WARC record here")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != CRLF + CRLF:
        raise ValueError("record length differs")
    return fields, rest[:n]


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    place = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
    out, at = None, 0
    try:
        for batch in slices(batches):
            if out is None:
                system, path = opened(place)
                out = system.open_output_stream(path, compression=None)
            spans = []
            for page, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                data = gzipped(record(page, url, (html or "").encode(), digest, first is None or first == page, first))
                out.write(data)
                spans.append((at, len(data)))
                at += len(data)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([place] * batch.num_rows), *(pa.array(x, pa.int64()) for x in zip(*spans, strict=True))],
                ["surt", "page_id", "file", "offset", "length"],
            )
    finally:
        if out is not None:
            out.close()


def write_archives(pages: DataFrame, scratch: Scratch, least: int = 100) -> DataFrame:
    """pages: page_id, url, html. Writes the archives and returns their index lines (surt, page_id, file, offset, length), stored."""
    body = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"), F.octet_length(body).alias("size"))
    shared = scratch.table(
        pages.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first"),
        "payloads",
    )
    folder = scratch.path("archives")
    mk = scratch.spark._jvm.org.apache.hadoop.fs.Path(folder)
    mk.getFileSystem(scratch.spark._jsc.hadoopConfiguration()).mkdirs(mk)
    # shared is a stored table of one row a repeated payload: the planner broadcasts it only if its size on disk allows, else splits hot digests.
    rows = pages.join(shared, "digest", "left").select(surt("url").alias("surt"), "page_id", "url", "html", "digest", "first")
    lines = rows.mapInArrow(lambda it: _written(it, folder), LINE)
    return scratch.table(lines, "lines")


def _blocked(batches: Iterator[pa.RecordBatch], folder: str, lines: int) -> Iterator[pa.RecordBatch]:
    """Writes one shard: sorted lines in compressed blocks, then its directory; returns the shard's first key and files."""
    place = f"{folder}/shard-{uuid.uuid4().hex}"
    out, at, held, directory = None, 0, [], []

    def flush() -> None:
        nonlocal at
        data = zlib.compress("\n".join(held).encode())
        directory.append("\t".join((*held[0].split("\t")[:2], str(at), str(len(data)))))
        out.write(data)
        at += len(data)
        held.clear()

    for batch in slices(batches, 4096):
        for key, page, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                system, path = opened(place + ".cdx")
                out = system.open_output_stream(path, compression=None)
            held.append("\t".join((key, page_key(page), file, str(offset), str(length))))
            if len(held) == lines:
                flush()
    if out is None:
        return
    if held:
        flush()
    out.close()
    system, path = opened(place + ".dir")
    with system.open_output_stream(path, compression=None) as f:
        f.write(zlib.compress("\n".join(directory).encode()))
    key, page = directory[0].split("\t")[:2]
    yield pa.record_batch([pa.array([key]), pa.array([page]), pa.array([place])], ["key", "page", "place"])


def clean(key: str) -> str:
    """Keys hold no tab or line feed in the index; both sides of a look-up go through this."""
    return key.replace("%", "%25").replace("\t", "%09").replace("\n", "%0A") if "\t" in key or "\n" in key else key


def page_key(page: int | None) -> str:
    """Sorts as the number does (nulls last), as text of one width."""
    return "~" if page is None else f"{page + (1 << 63):020d}"


class CaptureIndex:
    """shards: sorted (first key, first page key, place) of every shard; small, and sent with each task."""

    def __init__(self, shards: list[tuple[str, str, str]], keep: int = 8):
        self.shards, self.keep = shards, keep
        self.firsts = [(k, p) for k, p, _ in shards]
        self.directories: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()

    @staticmethod
    def build(lines: DataFrame, scratch: Scratch, block_lines: int = 3000, shards: int | None = None) -> CaptureIndex:
        folder = scratch.path("index")
        mk = scratch.spark._jvm.org.apache.hadoop.fs.Path(folder)
        mk.getFileSystem(scratch.spark._jsc.hadoopConfiguration()).mkdirs(mk)
        raw = F.col("surt")
        without = F.replace(F.replace(F.replace(raw, F.lit("%"), F.lit("%25")), F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0A"))
        # In order of the keys as they are stored and searched, not of the raw ones.
        lines = lines.withColumn("surt", F.when(raw.contains("\t") | raw.contains("\n"), without).otherwise(raw))
        keys = [F.col("surt"), F.col("page_id").asc_nulls_last(), F.col("file"), F.col("offset")]
        n = shards or int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = lines.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(lambda it: _blocked(it, folder, block_lines), "key string, page string, place string")
        rows = scratch.table(placed, "shards").collect()  # one row a shard
        return CaptureIndex(sorted((r.key, r.page, r.place) for r in rows))

    def _cached(self, cache: OrderedDict, key, load):
        if key not in cache:
            cache[key] = load()
            if len(cache) > self.keep:
                cache.popitem(last=False)
        return cache[key]

    def _directory(self, place: str) -> list[tuple]:
        def load():
            system, path = opened(place + ".dir")
            with system.open_input_stream(path, compression=None) as f:
                rows = [x.split("\t") for x in zlib.decompress(f.read()).decode().split("\n")]
            return [(k, p) for k, p, _, _ in rows], [(int(o), int(n)) for _, _, o, n in rows]

        return self._cached(self.directories, place, load)

    def _block(self, place: str, offset: int, length: int) -> tuple[list, list]:
        def load():
            system, path = opened(place + ".cdx")
            with system.open_input_file(path) as f:
                data = f.read_at(length, offset)
            rows = [x.split("\t") for x in zlib.decompress(data).decode().split("\n")]
            return [(k, p) for k, p, *_ in rows], [(f, int(o), int(n)) for _, _, f, o, n in rows]

        return self._cached(self.blocks, (place, offset), load)

    def find(self, key: str, page: int | None) -> list[tuple[str, int, int]]:
        """(file, offset, length) of every capture of this key and page: the last block that starts at or before it, and those after it that start with it."""
        want = (clean(key), page_key(page))
        found = []
        for s in range(self._first(self.firsts, want), len(self.shards)):
            if self.firsts[s] > want:
                break
            place = self.shards[s][2]
            firsts, spans = self._directory(place)
            for b in range(self._first(firsts, want), len(firsts)):
                if firsts[b] > want:
                    break
                keys, targets = self._block(place, *spans[b])
                k = bisect_right(keys, want) - 1
                while k >= 0 and keys[k] == want:
                    found.append(targets[k])
                    k -= 1
        return found

    @staticmethod
    def _first(firsts: list, want: tuple) -> int:
        """The first place whose block can hold want: the last one that starts before it."""
        k = bisect_right(firsts, want) - 1
        while k > 0 and firsts[k] == want:
            k -= 1
        return max(k, 0)


def _looked_up(batches: Iterator[pa.RecordBatch], shards: list, must: bool) -> Iterator[pa.RecordBatch]:
    index = CaptureIndex(shards)
    for batch in slices(batches, 4096):
        rows = []
        for key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hits = index.find(key, page)
            if must and not hits:
                raise LookupError(f"the index has no capture of {key!r}, page {page}")
            rows += [(*hit, 0) for hit in hits]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))], ["file", "offset", "length"])


def look_up(keys: DataFrame, index: CaptureIndex, must: bool = False) -> DataFrame:
    """keys: surt, page_id. (file, offset, length) of their captures; sorted keys make a task read each block once. must: a key without one is an error."""
    shards = index.shards
    keys = keys.select("surt", "page_id").distinct()
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = keys.repartitionByRange(n, "surt", "page_id").sortWithinPartitions("surt", F.col("page_id").asc_nulls_last())
    return keys.mapInArrow(lambda it: _looked_up(it, shards, must), "file string, offset long, length long")


def _read(batches: Iterator[pa.RecordBatch], gap: int, most: int) -> Iterator[pa.RecordBatch]:
    """Spans come sorted by file and offset; near ones are read at once."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    handle, name = None, None
    for batch in slices(batches, 2048):
        spans = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        rows, k = [], 0
        while k < len(spans):
            file, start, n = spans[k]
            end, j = start + n, k + 1
            while j < len(spans) and spans[j][0] == file and spans[j][1] <= end + gap and spans[j][1] + spans[j][2] - start <= most:
                end, j = max(end, spans[j][1] + spans[j][2]), j + 1
            if file != name:
                if handle:
                    handle.close()
                system, path = opened(file)
                handle, name = system.open_input_file(path), file
            data = handle.read_at(end - start, start)
            for _, o, n in spans[k:j]:
                rows.append(_row(zlib.decompress(data[o - start : o - start + n], 31)))
            k = j
        if rows:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    if handle:
        handle.close()


def _row(data: bytes) -> tuple:
    fields, block = parsed(data)
    http, _, payload = block.partition(CRLF + CRLF)
    size = int(next(x for x in http.split(CRLF) if x.lower().startswith(b"content-length:")).split(b":")[1])
    page = int(fields["warc-page-id"]) if fields["warc-page-id"] else None
    stated = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "revisit":
        return page, size, stated, "revisit", int(fields["warc-refers-to-page-id"])
    digest = hashlib.sha256(payload).hexdigest()
    if len(payload) != size or digest != stated:
        raise ValueError("payload differs from its header")
    return page, size, digest, "response", None


def read_records(spans: DataFrame, gap: int = 65_536, most: int = 8 << 20) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records at (file, offset, length)."""
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = spans.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return spans.mapInArrow(lambda it: _read(it, gap, most), RESULT)


def archive(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes all pages, indexes them, looks every page up in the index and reads its record back."""
    scratch = Scratch(pages.sparkSession, "warc")
    lines = write_archives(pages, scratch, least)
    index = CaptureIndex.build(lines, scratch)
    keys = pages.select(surt("url").alias("surt"), F.col("page_id").cast("long").alias("page_id"))
    return read_records(look_up(keys, index))
