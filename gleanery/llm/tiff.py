"""TIFF as a column: a writer of pages, and a reader that walks image directories and emits one row per page.

The reader takes either byte order, strips or tiles, no compression, PackBits, LZW or deflate, one or more 8-bit samples a pixel, and
undoes horizontal differencing. The query stores each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as grey pages of 64
pixels a row and up to PAGE_ROWS rows in strips of STRIP_ROWS, packed by CODEC, whatever their size; ``text_media`` takes any other.

Defined results: a null or empty text is one row of 64 zero samples; very long texts are several pages, a few MB of texts in a task's
memory at a time; equal texts give equal files, and repeated rows each their own; a file that isn't TIFF, or one with a broken page (a
size of zero or beyond what the file can hold, missing strips, unknown codes), gives one row with ``page`` -1 and the reason in
``error``; a null file gives a row with ``error`` "null"; an empty table gives no row. Only the named columns are read, so others may have
any name; ``carry`` may not name a column of PAGES.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, in_slices, read

WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 1024, 256
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: What the query packs its pages by.
CODEC = LZW
#: Bytes that a packed byte can stand for at most, in any of the codecs.
MOST = 4096
VALUES = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}  # struct codes of a directory entry's values, by its type


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more become (257 - n, byte); what lies between is copied in pieces of up to 128."""
    out, done = bytearray(), 0

    def copied(part: bytes) -> None:
        for at in range(0, len(part), 128):
            piece = part[at : at + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        copied(data[done : m.start()])
        out += bytes((257 - (m.end() - m.start()), m[1][0]))
        done = m.end()
    copied(data[done:])
    return bytes(out)


def packbits_decode(data: bytes, most: int) -> bytes:
    """Up to ``most`` bytes."""
    out, at, size = [], 0, 0
    while at < len(data) and size < most:
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
            if n == 128:
                continue
        size += len(out[-1])
    return b"".join(out)


CLEAR, END, FIRST, FULL = 256, 257, 258, 4094
#: Bits of the k-th code since a clear (9 to 12, one more once entry 511, 1023 or 2047 is made), where it begins and ends, and its mask.
WIDTHS = np.repeat([9, 10, 11, 12], [512 - FIRST, 512, 1024, 4096])
ENDS = np.cumsum(WIDTHS)
PLACES = ENDS - WIDTHS
MASKS = ((1 << WIDTHS) - 1).astype(np.uint32)
_SINGLE = [bytes((i,)) for i in range(256)] + [b"", b""]
_SHOWN = np.arange(16) >= 16 - np.arange(13)[:, None]  # by width: which of 16 bits a code has


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW, high bit first: codes are found byte by byte, then laid out as bits all together."""
    codes, widths = [CLEAR], [[9]]
    table: dict[int, int] = {}
    known, put = table.get, codes.append
    free, word, begun = FIRST, data[0] if data else -1, 1  # begun: where the codes since the last clear begin
    for c in data[1:]:
        key = word << 8 | c
        longer = known(key)
        if longer is not None:
            word = longer
            continue
        put(word)
        table[key] = free
        free += 1
        word = c
        if free == FULL:
            widths += [WIDTHS[: len(codes) - begun], [12]]
            put(CLEAR)
            table.clear()
            free, begun = FIRST, len(codes)
    if word >= 0:
        put(word)
    put(END)
    widths.append(WIDTHS[: len(codes) - begun])
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[_SHOWN[np.concatenate(widths)]]).tobytes()


def lzw_decode(data: bytes, most: int) -> bytes:
    """Up to about ``most`` bytes. Codes up to the next clear are cut out together, as their widths go by their number; words are then
    built one by one."""
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    threes = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    out: list[bytes] = []
    table: list[bytes] = []
    last, at, k, size = b"", 0, 0, 0  # at: where the codes since the last clear begin; k: how many of them are read
    while size < most:
        upto = int(np.searchsorted(ENDS, 8 * len(data) - at, "right"))
        if upto <= k:
            break
        places = at + PLACES[k:upto]
        codes = threes[places >> 3] >> (24 - (places & 7) - WIDTHS[k:upto]).astype(np.uint32) & MASKS[k:upto]
        marks = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(marks[0]) if len(marks) else len(codes)
        if stop and not table:
            raise ValueError("LZW data without a clear code")
        if stop == len(codes) and upto == len(WIDTHS):
            raise ValueError("LZW data without a clear code for too long")
        before = len(out)
        todo = iter(codes[:stop].tolist())
        for code in todo:  # the first since a clear
            if code > 255:
                raise ValueError("LZW code out of range")
            last = table[code]
            out.append(last)
            break
        for code in todo:
            if code < len(table):
                word = table[code]
            elif code == len(table):
                word = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            out.append(word)
            table.append(last + word[:1])
            last = word
        size += sum(map(len, out[before:]))
        if stop == len(codes) or codes[stop] == END:
            break
        at, k, table = int(places[stop]) + int(WIDTHS[k + stop]), 0, _SINGLE[:]
    return b"".join(out)


def _inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


def _pack(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 4)}[compression](data)


def _unpack(data: bytes, compression: int, most: int) -> bytes:
    kinds = {NONE: lambda x, n: x[:n], PACKBITS: packbits_decode, LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate}
    if compression not in kinds:
        raise ValueError(f"compression {compression}")
    return kinds[compression](data, most)


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile_rows: int = 0, order: str = "<") -> bytes:
    """Pages of 8-bit samples (height, width) or (height, width, samples), each as one directory; tile_rows: tiles of the page's width (a
    multiple of 16) and so many rows, else strips."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width, samples = (*page.shape, 1)[:3]
        rows = tile_rows or min(STRIP_ROWS, height)
        parts = [page[at : at + rows].reshape(-1, width, samples) for at in range(0, height, rows)]
        if tile_rows:
            parts[-1] = np.pad(parts[-1], ((0, rows - len(parts[-1])), (0, 0), (0, 0)))
        if predictor == 2:
            parts = [np.diff(p, axis=1, prepend=np.zeros((len(p), 1, samples), np.uint8)) for p in parts]
        places, lengths = [], []
        for part in parts:
            packed = _pack(part.tobytes(), compression)
            places.append(len(out))
            lengths.append(len(packed))
            out += packed
        out += b"\0" * (len(out) % 2)
        entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8] * samples), (259, 3, [compression]), (262, 3, [2 if samples > 2 else 1])]
        entries += [] if tile_rows else [(273, 4, places)]
        entries += [(277, 3, [samples])] + ([] if tile_rows else [(278, 4, [rows]), (279, 4, lengths)]) + [(317, 3, [predictor])]
        entries += [(322, 4, [width]), (323, 4, [rows]), (324, 4, places), (325, 4, lengths)] if tile_rows else []
        at = []
        for tag, kind, values in entries:
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw
                raw = struct.pack(order + "I", where)
            at.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(at)) + b"".join(at) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The values of each image directory, by tag, in the order of their chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a ring")
        seen.add(at)
        found = {}
        n = struct.unpack_from(order + "H", data, at)[0]
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if code := VALUES.get(kind):
                here = at + 10 + 12 * i
                where = here if struct.calcsize(f"<{count}{code}") <= 4 else struct.unpack_from(order + "I", data, here)[0]
                found[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, where))
        yield found
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read_page(data: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    """The samples of one directory's page: (height, width, samples)."""
    width, height, samples = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    compression, predictor, tiled = tags.get(259, [NONE])[0], tags.get(317, [1])[0], 324 in tags
    if set(tags.get(258, [1])) != {8} or tags.get(284, [1])[0] != 1 or predictor not in (1, 2):
        raise ValueError("only 8-bit samples, pixel by pixel, plain or differenced")
    part_width, rows = (tags[322][0], tags[323][0]) if tiled else (width, min(tags.get(278, [height])[0], height))
    if min(width, height, samples, part_width, rows) < 1:
        raise ValueError("a size of zero")
    across, down = -(-width // part_width), -(-height // rows)
    if across * part_width * down * rows * samples > MOST * len(data):
        raise ValueError("a page beyond what the file can hold")
    places, lengths = tags[324 if tiled else 273], tags[325 if tiled else 279]
    if not len(places) == len(lengths) == across * down:
        raise ValueError("missing strips or tiles")
    page = np.zeros((down * rows, across * part_width, samples), np.uint8)
    for i, (at, length) in enumerate(zip(places, lengths, strict=True)):
        top, left = i // across * rows, i % across * part_width
        n = rows if tiled else min(rows, height - top)
        size = n * part_width * samples
        part = np.frombuffer(_unpack(data[at : at + length], compression, size)[:size], np.uint8).reshape(n, part_width, samples)
        page[top : top + n, left : left + part_width] = np.cumsum(part, axis=1, dtype=np.uint8) if predictor == 2 else part
    return page[:height, :width]


PAGES = "doc_id long, page int, pages int, width int, height int, samples int, pixels binary, error string"


def tiff_pages(media: DataFrame, id_col: str = "doc_id", content: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of each file, in the files' order, pages from 0; columns in carry are repeated on each page."""
    types = [f.simpleString().replace(":", " ", 1) for f in media.select(*carry).schema] if carry else []
    names = [x.split()[0] for x in PAGES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                data, rows = data.as_py(), []
                try:
                    if data is None:
                        raise ValueError("null")
                    found = [read_page(data, tags) for tags in directories(data)]
                    rows = [(k, len(found), p.shape[1], p.shape[0], p.shape[2], p.tobytes(), None) for k, p in enumerate(found)]
                    if not rows:
                        raise ValueError("no page")
                except (ValueError, KeyError, IndexError, OverflowError, struct.error, zlib.error) as e:
                    rows = [(-1, 0, None, None, None, None, f"{type(e).__name__}: {e}" if isinstance(e, KeyError) else str(e))]
                ids = batch.slice(i, 1)
                many = pa.array(np.zeros(len(rows), np.int64))
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                columns = [
                    ids.column(0).take(many), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)),
                    *(ids.column(2 + k).take(many) for k in range(len(carry)))
                ]
                yield pa.RecordBatch.from_arrays(columns, [*names, *carry])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.nbytes
            if size > 1 << 22 or len(held) >= 5000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    rows = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(content).alias("content"), *carry)
    return rows.transform(bounded).mapInArrow(packed, ", ".join([PAGES, *types]))


def store(payload: bytes, codec: int = CODEC, predictor: int = 1, tile_rows: int = 0) -> bytes:
    """A payload (a positive multiple of 64 bytes) as TIFF."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return write_tiff([samples[at : at + PAGE_ROWS] for at in range(0, len(samples), PAGE_ROWS)], codec, predictor, tile_rows)


def text_media(docs: DataFrame, id_col: str = "doc_id", text: str = "text", codec: int = CODEC, predictor: int = 1, tile_rows: int = 0) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a TIFF file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            texts = batch.column(1).to_pylist()
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            files = [store(x.ljust(max(64, -(-len(x) // 64) * 64), b"\0"), codec, predictor, tile_rows) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")
    ).transform(bounded).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def page_features(pages: DataFrame) -> DataFrame:
    """Folds the pages of each file, which follow each other, into one row with digests and figures of its samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts = ([] if r["page"] <= 0 else parts) + [r["pixels"] or b""]
                if r["page"] + 1 < r["pages"]:
                    continue
                samples = b"".join(parts)
                a = np.frombuffer(samples, np.uint8)
                words = f"pages={r['pages']} rows={len(a) // WIDTH} sum={int(a.sum(dtype=np.int64))} max={int(a.max(initial=0))} zeros={int((a == 0).sum())} step={int(np.abs(np.diff(a.astype(np.int16))).sum(dtype=np.int64))}"
                out.append(
                    (
                        r["doc_id"], r["n_bytes"], len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), r["media_bytes"],
                        r["media_sha256"], r["error"] or words
                    )
                )
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return pages.transform(bounded).mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = text_media(read(spark, sf_dir, "documents")).select(
        "*", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")
    )
    return page_features(tiff_pages(media, carry=("n_bytes", "media_bytes", "media_sha256")))


def tiff_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_tiff that don't depend on the stored form and that SQL has functions for."""
    return op10_tiff(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOADS_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents),
    p AS (SELECT *, greatest({WIDTH}, (n_bytes + {WIDTH - 1}) // {WIDTH} * {WIDTH})::BIGINT AS payload_bytes FROM d)
    SELECT doc_id, n_bytes, payload_bytes, sha256(t || repeat(chr(0), payload_bytes - n_bytes)) AS payload_sha256 FROM p
    """
