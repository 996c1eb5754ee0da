"""WARC: a monolithic gzip normaliser.

A WARC file that was compressed as one gzip stream can't be read from the middle. Each such file is inflated once, as
a stream, by one task; every record is written again as a gzip member of its own, and a sidecar index gets each
record's place. Records can then be read alone, and files be split between tasks. Nothing holds a whole file or, but
for the record at hand, more than a block of it.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import common

#: Bytes of payload in a file that ``write_monolithic`` makes, at most, unless one record has more.
FILE_BYTES = 64 << 20
#: Bytes of members that a task reads through the index.
READ_BYTES = 16 << 20
#: Bytes that are read or inflated at a time.
BLOCK = 1 << 20
LEVEL = 6
_END = b"\r\n\r\n"

INDEX = "file string, record long, offset long, length long, type string, uri string, record_id string, page_id long"
_INDEX = pa.schema([("file", pa.string()), ("record", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64())])


class Malformed(ValueError):
    """Bytes that are no WARC record, or a stream that ends inside one."""


def inflate(stream) -> Iterator[bytes]:
    """The blocks of a gzip stream of one or many members, each inflated once; plain bytes pass as they are."""
    data = stream.read(BLOCK)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = stream.read(BLOCK)
        return
    z = zlib.decompressobj(31)
    while True:
        while data:
            out = z.decompress(data, BLOCK)
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data = z.unused_data
                # zeros may pad the end of a file
                if not data.strip(b"\0"):
                    break
                z = zlib.decompressobj(31)
        data = stream.read(BLOCK)
        if not data:
            break
        if z.eof:
            if not data.strip(b"\0"):
                continue
            z = zlib.decompressobj(31)
    if not z.eof:
        raise Malformed("the gzip stream ends early")


class _Reader:
    """Bytes of blocks by count and by line."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, bytearray()

    def _more(self) -> bool:
        block = next(self.blocks, None)
        if block is None:
            return False
        self.held += block
        return True

    def line(self) -> bytes:
        """The next line with its end; what is left at the end of the stream."""
        seen = 0
        while (at := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if not self._more():
                at = len(self.held) - 1
                break
        out = bytes(self.held[: at + 1])
        del self.held[: at + 1]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in pieces."""
        while n:
            if not self.held and not self._more():
                raise Malformed("a record ends early")
            piece = bytes(self.held[:n])
            del self.held[: len(piece)]
            n -= len(piece)
            yield piece


def records(blocks: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
    """(head as it stands, its fields by lower-case name, payload in pieces) of every record, one after the other.

    A payload that isn't read to its end is skipped.
    """
    r = _Reader(blocks)
    while True:
        version = r.line()
        while version in (b"\r\n", b"\n"):
            version = r.line()
        if not version:
            return
        if not version.startswith(b"WARC/"):
            raise Malformed(f"no WARC record: {version[:20]!r}")
        head, fields, name = [version], {}, ""
        while (line := r.line()).rstrip(b"\r\n"):
            head.append(line)
            text = line.decode("utf-8", "replace")
            if text[0] in " \t":  # the value goes on
                fields[name] = f"{fields.get(name, '')} {text.strip()}"
                continue
            name, colon, value = text.partition(":")
            name = name.strip().lower()
            if not colon:
                raise Malformed(f"no header field: {line[:40]!r}")
            fields[name] = value.strip()
        if not line.endswith(b"\n"):
            raise Malformed("a record ends early")
        size = fields.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            raise Malformed(f"no content length: {size!r}")
        payload = r.take(int(size))
        yield b"".join(head) + line, fields, payload
        for _ in payload:
            pass


def _page_id(fields: dict[str, str]) -> int | None:
    """The identifier of a page; null for a foreign one that is no whole number of 64 bits."""
    text = fields.get("warc-page-id", "")
    return n if re.fullmatch("-?[0-9]{1,19}", text) and -(1 << 63) <= (n := int(text)) < 1 << 63 else None


def _normalise(target: str, attempt: str, files: list[str]) -> Iterator[pa.RecordBatch]:
    for path in files:
        fs, name = common.filesystem(path)
        stem = f"{name.rpartition('/')[2].removesuffix('.gz')}-{attempt}"
        out_fs, folder = common.filesystem(target)
        out_path = f"{folder}/{stem}.gz"
        rows: list[tuple] = []
        with fs.open_input_stream(name, compression=None) as source, out_fs.open_output_stream(out_path, compression=None) as out:
            at = 0
            for n, (head, fields, payload) in enumerate(records(inflate(source))):
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                start = at
                out.write(z.compress(head))
                for piece in payload:
                    out.write(z.compress(piece))
                out.write(z.compress(_END))
                out.write(z.flush())
                at = out.tell()
                rows.append((f"{target}/{stem}.gz", n, start, at - start, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-record-id"), _page_id(fields)))
        side = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_INDEX), _INDEX, strict=True)], schema=_INDEX)
        with out_fs.open_output_stream(f"{folder}/{stem}.idx", compression=None) as sink, pa.ipc.new_stream(sink, _INDEX) as writer:
            writer.write_table(side)
        yield from side.to_batches()


def normalise(spark: SparkSession, files: DataFrame, target: str | None = None) -> DataFrame:
    """Rewrites the WARC files named in ``files`` (column ``file``) and returns the index of their records.

    Written below ``target``, a folder that all executors share: X.gz with a member for each record, and X.idx, an Arrow
    stream of the rows that are returned. Null names are skipped; a file named twice is rewritten twice; no files give
    no rows. Files already in members, and plain ones, are normalised alike. A damaged file fails the query with
    ``Malformed``. A task that runs again writes other files, and the index only names those of the run that counted.
    """
    target = target or common.scratch(spark, "warc")
    fs, folder = common.filesystem(target)
    fs.create_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _normalise(target, uuid.uuid4().hex, [f for f in b.column(0).to_pylist() if f is not None])

    # a stream can't be split: one task for each file
    names = files.select("file")
    return common.stash(names.repartition(max(1, names.count())).mapInArrow(run, INDEX), "index")


def write_monolithic(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages`` as WARC files of one gzip stream each, and returns their names (column ``file``).

    Each row is a response record. A null identifier or address is left out of the head; a null page is marked there.
    """
    spark = pages.sparkSession
    common.bound_batches(spark)
    target = common.scratch(spark, "monolithic")
    fs, folder = common.filesystem(target)
    fs.create_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_fs, where = common.filesystem(target)
        names, out, size = [], None, 0
        z = None
        for b in batches:
            for i, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body = b"" if html is None else html.encode()
                if out is None or size and size + len(body) > file_bytes:
                    if out is not None:
                        out.write(z.flush())
                        out.close()
                    name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, z = out_fs.open_output_stream(f"{where}/{name}", compression=None), 0, zlib.compressobj(1, zlib.DEFLATED, 31)
                    names.append(f"{target}/{name}")
                head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i} {url}')}>"]
                head += [f"WARC-Page-Id: {i}"] * (i is not None) + ([f"WARC-Target-URI: {_escape(url)}"] if url is not None else []) + ["WARC-Page-Null: true"] * (html is None)
                out.write(z.compress("\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + _END))
                size += len(body)
        if out is not None:
            out.write(z.flush())
            out.close()
        yield pa.record_batch([pa.array(names, pa.string())], names=["file"])

    return common.stash(common.pick(pages, i=id_col, u=url_col, h=html_col).select(F.col("i").cast("long").alias("i"), "u", "h").mapInArrow(run, "file string"), "files")


def _escape(url: str) -> str:
    """Blanks at the ends and line breaks can't stand in a head."""
    return "".join(f"%{{{ord(c):x}}}" if c in "\r\n" or c == "%" and url[k + 1 : k + 2] == "{" else c for k, c in enumerate(url)) if url == url.strip() else "".join(f"%{{{ord(c):x}}}" for c in url)


def _unescape(url: str) -> str:
    return re.sub(r"%\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), url)


def read_records(index: DataFrame) -> DataFrame:
    """page_id, url, html and record_bytes of every record that ``index`` names, each from its own member alone.

    A member that holds anything but its one record is ``Malformed``. ``record_bytes`` is its size, inflated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size, opened, name = [], 0, None, None
            for file, offset, length in sorted(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if file != name:
                    if opened:
                        opened.close()
                    fs, path = common.filesystem(file)
                    opened, name = fs.open_input_file(path), file
                opened.seek(offset)
                member = zlib.decompress(opened.read(length), 31)
                found = records(iter([member]))
                _, fields, payload = next(found)
                body, url = b"".join(payload), fields.get("warc-target-uri")
                if next(found, None) is not None:
                    raise Malformed(f"more than a record in the member at {offset} of {file}")
                rows.append((_page_id(fields), None if url is None else _unescape(url), None if "warc-page-null" in fields else body.decode("utf-8", "replace"), len(member)))
                size += len(body)
                if size > common.ARROW_BATCH_BYTES:
                    yield _pages(rows)
                    rows, size = [], 0
            if opened:
                opened.close()
            if rows:
                yield _pages(rows)

    places = index.select("file", "offset", "length")
    total = places.agg(F.sum("length")).first()[0] or 0
    spread = places.repartitionByRange(max(1, -(-total // READ_BYTES)), "file", "offset")
    return spread.mapInArrow(run, "page_id long, url string, html string, record_bytes long")


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "html", "record_bytes"])


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """page_id, url, html and record_bytes of every row of ``pages``, through monolithic files, the normaliser and its index.

    Identifiers are whole numbers of 64 bits. Nulls, empty pages and repeated rows come back as they were; other columns don't. No rows give no rows.
    """
    files = write_monolithic(pages, id_col, url_col, html_col, file_bytes)
    return read_records(normalise(pages.sparkSession, files))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of ``pages``, written as monolithic WARC, normalised and read back by the index."""
    return round_trip(common.table(spark, sf_dir, "pages"))


#: ``record_bytes`` says that each page came out of a record of its own, head and all.
SQL = """
SELECT page_id, url, html, CAST(octet_length(encode(concat_ws(chr(13) || chr(10),
  'WARC/1.1', 'WARC-Type: response', 'WARC-Record-ID: <urn:uuid:' || repeat('0', 36) || '>', 'WARC-Page-Id: ' || page_id, 'WARC-Target-URI: ' || url,
  CASE WHEN html IS NULL THEN 'WARC-Page-Null: true' END, 'Content-Length: ' || coalesce(octet_length(encode(html)), 0), '', coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)))) AS BIGINT) AS record_bytes
FROM pages
"""
