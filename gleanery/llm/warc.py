"""WARC archives of pages: written, read back, and indexed by an external merge of sorted capture runs.

Writing: pages are dealt by id hash into tasks, each of which appends gzip members (one per record) to files of about FILE_BYTES in the
folder that all executors share. A task names its files by a fresh id, so a task run again after an executor is lost writes new files,
and only those named in the committed run table are ever read. A record whose payload equals that of a page with a larger id is a
revisit and carries no payload.

Index: a task's captures, sorted by URL key and timestamp, are runs of at most RUN_ROWS. Key ranges are cut at quantiles, as many as
keep a range near RANGE_ROWS, and the runs' segments of a range meet in one task, which merges them through a tree of losers; nothing is
sorted again. Ranges are in order and so is each range, so the places of the ranges' first captures number the capture history of all
keys. Equal keys and times go by page id, then by place in the archives.

Defined results: a null html is an empty payload; a null page id makes a record without one, a response; a null URL is the key "" and an
empty target; equal URLs stay separate captures; rows with one page id and one payload are separate records, both of them responses if no
larger id has the payload; one page id with several payloads is several records, each with its own payload's role; very long pages are
whole records, a few MB of pages in a task's memory at a time; an empty table gives no archive and no row. Only page_id, url, html and
captured_at are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, fresh_path, in_slices, read, written

FILE_BYTES = 16 << 20
#: Captures of a run, which is sorted in a task's memory, and about as many as a range has.
RUN_ROWS, RANGE_ROWS = 50_000, 50_000
LEVEL = 1
#: Fixed value: the time from which page ids count seconds where a table has no capture time.
EPOCH = "2024-01-01T00:00:00Z"

T = TypeVar("T")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324  the digest that the format names


#: Host, path and query of a URL with a scheme; user, www, port and fragment stay out.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/:?#]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?"
_URL = re.compile(URL)


def url_key(url: str | None) -> str:
    """Host labels from last to first, then path and query: captures of a site lie together, whatever the scheme, port or www."""
    m = _URL.match(url or "")
    if not m:
        return (url or "").lower()
    return (",".join(reversed(m[1].split("."))) + ")" + (m[2] or "/") + (m[3] or "")).lower()


def record(kind: str, page_id: int, url: str | None, when: str, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with an HTTP block; a revisit's block ends after the HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when}", f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', '', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}", f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields, with the payload of a response; its digest is found anew and must be the one in the head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    named = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and payload_digest(payload) != named:
        raise ValueError(f"record {fields['warc-record-id']} has another payload than its digest says")
    return {
        "record_type": fields["warc-type"], "page_id": number(fields["warc-record-id"]), "url": fields["warc-target-uri"], "captured_at": fields["warc-date"], "payload_digest": named,
        "refers_to": number(fields.get("warc-refers-to", "")), "payload": payload if fields["warc-type"] == "response" else None,
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
    }


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of each gzip member of a file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        part, raw, end = zlib.decompressobj(31), [], at
        while not part.eof and end < len(data):  # in small steps: what follows a member is copied
            step = view[end : end + (1 << 14)]
            raw.append(part.decompress(step))
            end += len(step)
        if not part.eof:
            raise ValueError(f"archive breaks off in the member at {at}")
        end -= len(part.unused_data)
        yield at, end - at, b"".join(raw)
        at = end


def loser_tree_merge(runs: Sequence[Iterator[T]], key: Callable[[T], object]) -> Iterator[T]:
    """Merges sorted runs. Inner nodes hold the loser of their match, so a new item of the winner's run replays one path only."""
    runs = [iter(r) for r in runs]
    k = len(runs)
    if not k:
        return
    heads: list[tuple | None] = []

    def pull(i: int) -> tuple | None:
        for item in runs[i]:
            return key(item), i, item
        return None

    heads = [pull(i) for i in range(k)]

    def beats(a: int, b: int) -> bool:
        return heads[b] is None or (heads[a] is not None and heads[a][:2] < heads[b][:2])

    tree = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    champion = winners[1] if k > 1 else 0
    while heads[champion] is not None:
        yield heads[champion][2]
        heads[champion] = pull(champion)
        node = (champion + k) // 2
        while node:
            if beats(tree[node], champion):
                champion, tree[node] = tree[node], champion
            node //= 2


def order_of(capture: tuple) -> tuple:
    """URL key, time, page id (a missing one comes first), then file and offset."""
    return capture[0], capture[1], -(1 << 63) if capture[2] is None else capture[2], capture[5], capture[6]


def streams(captures: Iterable[tuple[str, tuple]]) -> list[list[tuple]]:
    """The sorted segments in (run, capture) rows: a run's captures as long as they ascend, a new segment where they don't."""
    latest: dict[str, list[tuple]] = {}
    found: list[list[tuple]] = []
    for run, capture in captures:
        segment = latest.get(run)
        if segment is None or order_of(capture) < order_of(segment[-1]):
            latest[run] = segment = []
            found.append(segment)
        segment.append(capture)
    return found


def _with_roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, url, captured_at, html, answer): answer is the page whose record carries the payload, null if it is this one.

    Digests are folded to (digest, largest id) in a partial aggregate first; only digests of two or more pages meet the pages' ids again,
    in a join that Spark can split where one digest has many pages, and a page finds its role by its id and digest.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "captured_at", "html", F.sha2(payload, 256).alias("digest"))
    keyed = written(rows.where(F.octet_length(payload) >= least_bytes).select("page_id", "digest"), "digests")
    groups = keyed.groupBy("digest").agg(F.max("page_id").alias("answer"), F.count("*").alias("n")).where("n > 1").select("digest", "answer")
    repeated = keyed.join(written(groups, "repeated"), "digest").where("page_id < answer").distinct()
    return rows.join(written(repeated, "revisits"), ["page_id", "digest"], "left").select("page_id", "url", "captured_at", "html", "answer")


RUN = "url_key string, captured_at string, page_id long, record_type string, payload_digest string, file string, offset long, length long"
_NAMES = [c.split()[0] for c in RUN.split(", ")]


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES, run_rows: int = RUN_ROWS) -> DataFrame:
    """Writes pages (page_id, url, html, captured_at) as archives under folder; returns the runs: one row per capture, with its run."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    dealt = _with_roles(pages, least_bytes)

    def as_run(captures: list[tuple]) -> Iterator[pa.RecordBatch]:
        run, fields = uuid.uuid4().hex, list(zip(*sorted(captures, key=order_of), strict=True))
        for start in range(0, len(captures), 10_000):
            part = [f[start : start + 10_000] for f in fields]
            yield pa.RecordBatch.from_arrays([pa.array([run] * len(part[0])), *(pa.array(x) for x in part)], ["run", *_NAMES])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        captures: list[tuple] = []
        out, name, at = None, "", 0
        for part in in_slices(batches, 3):
            for r in part.to_pylist():
                payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                digest = payload_digest(payload)
                kind = "response" if r["answer"] is None else "revisit"
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = pack.compress(record(kind, r["page_id"], r["url"], r["captured_at"], digest, payload, r["answer"])) + pack.flush()
                if out is None:
                    store, path = fs.FileSystem.from_uri(folder)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                out.write(data)
                captures.append((url_key(r["url"]), r["captured_at"], r["page_id"], kind, digest, name, at, len(data)))
                at += len(data)
                if at >= file_bytes:
                    out.close()
                    out = None
            if len(captures) >= run_rows:
                yield from as_run(captures)
                captures = []
        if out is not None:
            out.close()
        if captures:
            yield from as_run(captures)

    return written(dealt.transform(bounded).mapInArrow(write, f"run string, {RUN}"), "runs")


def merged_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures with capture_no, their place (from 0) in the order of url_key, captured_at, page_id, file and offset."""
    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(n, "url_key", "captured_at", "page_id", "file", "offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held, nth = [], 0
        for capture in loser_tree_merge([iter(s) for s in streams((run, tuple(capture)) for run, *capture in rows)], order_of):
            held.append((here, nth, *capture))
            nth += 1
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], ["range", "nth", *_NAMES])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], ["range", "nth", *_NAMES])

    merged = written(dealt.transform(bounded).mapInArrow(merge, f"range long, nth long, {RUN}"), "index")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    first = merged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return merged.join(first, "range").select((F.col("first") + F.col("nth")).alias("capture_no"), *_NAMES)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives in folder; payload is null for revisits, and for all if payloads is false (it is checked anyway).
    A lost task may have left files that no run names: keep those (file, offset) that the runs or the index have."""
    schema = "page_id long, url string, captured_at string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, file string, offset long"
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for offset, _, raw in members(content.as_py()):
                    found = parse(raw) | {"file": path.rsplit("/", 1)[-1], "offset": offset}
                    held.append(found if payloads else found | {"payload": None})
                    size += len(raw)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    return files.transform(bounded).mapInArrow(run, schema)


def with_capture_time(pages: DataFrame) -> DataFrame:
    """captured_at: EPOCH plus page_id seconds, as text that sorts by time."""
    start = F.unix_timestamp(F.lit(EPOCH[:19]), "yyyy-MM-dd'T'HH:mm:ss")
    return pages.withColumn("captured_at", F.date_format(F.timestamp_seconds(start + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture history of all pages: each capture's place in it, and its record as read back at the index's file and offset."""
    folder = fresh_path(spark, "archives")
    index = merged_index(write_archives(with_capture_time(read(spark, sf_dir, "pages").select("page_id", "url", "html")), folder))
    records = read_archives(spark, folder, payloads=False).select(
        "file", "offset", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    found = index.select("file", "offset", "url_key", "captured_at", "capture_no").join(records, ["file", "offset"])
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "capture_no")


#: Base32 of a digest: each five hex digits are four characters. Fixed: the digits of base32.
ORACLE_SQL = rf"""
    WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    m AS (SELECT html, max(page_id) AS answer FROM p GROUP BY html),
    k AS (SELECT p.*, answer, strftime(TIMESTAMP '{EPOCH[:19]}' + to_seconds(coalesce(page_id, 0)), '%Y-%m-%dT%H:%M:%SZ') AS captured_at,
      lower(CASE WHEN regexp_matches(url, '{URL}') THEN
        array_to_string(list_reverse(string_split(regexp_extract(url, '{URL}', 1), '.')), ',') || ')'
        || coalesce(nullif(regexp_extract(url, '{URL}', 2), ''), '/') || regexp_extract(url, '{URL}', 3) ELSE url END) AS url_key
      FROM p JOIN m USING (html))
    SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
      array_to_string(flatten(list_transform(range(0, 8), lambda g: list_transform([15, 10, 5, 0], lambda s:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, CAST(5 * g + 1 AS BIGINT), 5))::BIGINT >> s) & 31) + 1 AS BIGINT), 1)))), '') AS payload_digest,
      CASE WHEN page_id < answer THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < answer THEN answer END AS refers_to,
      url_key, captured_at, row_number() OVER (ORDER BY url_key COLLATE "binary", captured_at, page_id NULLS FIRST) - 1 AS capture_no
    FROM k
    """
