"""WARC archives: records written with an index, read back by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import bounded_batches, counted, give_back, key_filter, maybe_in, scratch, written
from glintframe.llm.dedup import maybe_repeated, repeat_filter

INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long"
#: What stands for itself in a URI, but for the percent sign.
URI = "!#$&'()*+,/:;=?@[]~"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _urn(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:x-page:").rstrip(">")
    return None if name == "none" else int(name)


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member: an HTTP response with the payload, of `size` bytes, or,
    where it refers to another page's, a revisit with the response's header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        plain = quote(url, safe=f"{URI}%")
        head.append(f"WARC-Target-URI: {plain}")
        if plain != url:  # what isn't a URI is told as it was, too
            head.append(f"X-Target-As-Written: {quote(url, safe=URI)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple:
    """A gzip member's record as a row of RECORDS; raises where lengths or digests don't agree."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if not first.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != told or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    url = unquote(fields["X-Target-As-Written"]) if "X-Target-As-Written" in fields else fields.get("WARC-Target-URI")
    refers = _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return _page(fields["WARC-Record-ID"]), url, told, digest, kind, refers, payload if kind == "response" else None


def _writer(folder: str, date: str, batch: int = 2000):
    """Writes rows (page, url, html, bytes, sha, refers): where refers is set, a
    revisit of what has `bytes` bytes and the digest sha, html being of no account."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at)
        name, out, offset, rows = f"{uuid.uuid4().hex}.warc.gz", None, 0, []

        def told() -> pa.RecordBatch:
            cols = list(zip(*rows))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

        for b in batches:
            for page, url, html, n, digest, refers in zip(*(b.column(i) for i in range(6))):
                page, url, refers = page.as_py(), url.as_py(), refers.as_py()
                if refers is None:
                    payload = (html.as_py() or "").encode()
                    n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                else:
                    payload, n, digest = b"", n.as_py(), digest.as_py()
                raw = record(page, url, payload, n, digest, refers, date)
                out = out or store.open_output_stream(f"{at}/{name}", compression=None)
                out.write(raw)
                rows.append((name, offset, len(raw), url, digest, "response" if refers is None else "revisit", page))
                offset += len(raw)
                if len(rows) >= batch:
                    yield told()
                    rows.clear()
        if out:
            out.close()  # before the last index rows go, the file is whole
        if rows:
            yield told()

    return run


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", *, min_revisit: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of df to archives in `folder`; returns their
    index (INDEX), itself a table in the shared folder.

    Of rows whose payloads are equal and have min_revisit bytes or more, that with
    the smallest id is a response and the others revisit it. Null texts are empty
    payloads, null URLs are left out, rows with a null id are always responses, and
    so are those that repeat the smallest id. Other columns aren't read. An empty
    table gives an empty index.

    A first pass writes narrow rows with digests; those that a filter of repeated
    digests lets through are compared. Revisits are written from narrow rows alone.
    The second pass over the texts writes all rows that can't be repeated as they
    come; of the others only the responses, one per payload, are shuffled, to meet
    what was decided. Each task writes one file of its own name, and the index
    counts it only if the task ended well: files of lost attempts are never referred to.
    """
    bounded_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    pages = df.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.col(text_col).alias("html"), F.octet_length(text).cast("long").alias("n"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
    )
    narrow, seen = counted(pages.drop("html"), "digests")
    bits, blocks = repeat_filter(narrow.where(F.col("n") >= min_revisit), seen["rows"])
    bits = written(bits, "filter")
    some = maybe_repeated(narrow.where(F.col("n") >= min_revisit), bits, blocks).where("maybe").drop("maybe")
    first = written(some.groupBy("sha").agg(F.min("page").alias("keep")), "repeated", rows=seen["rows"])
    decided, told = counted(
        some.join(first, "sha").select("page", "url", "n", "sha", F.when(F.col("page") > F.col("keep"), F.col("keep")).alias("refers")), "decided", seen["rows"]
    )
    tested = maybe_repeated(pages, bits, blocks).withColumn("maybe", F.col("maybe") & (F.col("n") >= min_revisit))
    none = F.lit(None).cast("long")
    cols = ["page", "url", "html", "n", F.lower(F.hex("sha")).alias("digest")]
    out = tested.where("not maybe").select(*cols, none.alias("refers"))
    if told["rows"]:
        key = lambda: F.xxhash64("page", "sha").alias("key")
        stay = decided.where("refers is null").select("page", "sha", key()).distinct()
        held, many = key_filter(stay, "key", told["rows"])
        again = maybe_in(tested.where("maybe").withColumn("key", key()), "key", written(held, "responses"), many, "there").where("there").alias("t")
        s = stay.alias("s")
        match = (F.col("t.key") == F.col("s.key")) & (F.col("t.sha") == F.col("s.sha")) & F.col("t.page").eqNullSafe(F.col("s.page"))
        responses = again.join(s, match, "left_semi").select(*cols, none.alias("refers"))
        revisits = decided.where("refers is not null").select("page", "url", F.lit(None).cast("string").alias("html"), *cols[3:], "refers")
        out = out.union(responses).union(revisits)
    return written(out.mapInArrow(give_back(_writer(folder, date)), INDEX), "warc-index")


def _reader(folder: str, gap: int, run_bytes: int, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        opened: list = [None, None]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

        def fetch(file: str, todo: list[tuple[int, int]]) -> pa.RecordBatch:
            if opened[0] != file:
                if opened[1]:
                    opened[1].close()
                opened[:] = [file, store.open_input_file(f"{at}/{file}")]
            start = todo[0][0]
            raw = opened[1].read_at(todo[-1][0] + todo[-1][1] - start, start)
            rows = [parse(raw[o - start : o - start + n]) for o, n in todo]
            cols = list(zip(*rows))
            if not payloads:
                cols[-1] = (None,) * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])

        file, todo = None, []
        for b in batches:
            for f, o, n in zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist()):
                if todo and (f != file or o - (todo[-1][0] + todo[-1][1]) > gap or o + n - todo[0][0] > run_bytes):
                    yield fetch(file, todo)
                    todo = []
                file = f
                todo.append((o, n))
        if todo:
            yield fetch(file, todo)
        if opened[1]:
            opened[1].close()

    return run


def read_records(index: DataFrame, folder: str, *, gap: int = 1 << 16, run_bytes: int = 4 << 20, slice_bytes: int = 32 << 20, payloads: bool = True) -> DataFrame:
    """The records (RECORDS) that rows of an index stand for.

    Rows are dealt by file and slice of slice_bytes and sorted by offset; ranges no
    further than `gap` bytes apart are read at once, up to run_bytes. Every
    response's payload is held against its length and digest. Of a revisit, size
    and digest are those of the payload it refers to, from its own header.
    """
    where = index.select("file", "offset", "length")
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = where.repartition(n, "file", F.floor(F.col("offset") / slice_bytes)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(give_back(_reader(folder, gap, run_bytes, payloads)), RECORDS)


def archive_folder(spark) -> str:
    """A new folder for archives, under the cluster's shared folder."""
    return scratch(spark, "warc")
