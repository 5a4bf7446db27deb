"""Media columns: TIFF files as binary columns.

``read_tiff`` walks a file's chain of image directories (both byte orders) and returns every page as a
numpy array: strips or tiles, uncompressed, PackBits, LZW or deflate, horizontal differencing undone,
8 or 16 bits per sample, contiguous or planar samples. ``tiff_pages`` is the column operator: one row
per page. ``write_tiff`` makes the files the query reads back.

Defined cases: null media gives one row with page -1 and an error; so does a file that is no TIFF or is
damaged (its intact leading pages are still returned), has an image of no size, or claims a page larger than
its stored bytes can hold or than ``most_bytes`` (a parameter; None: no bound); nothing is decoded past what a page
needs, and of a directory only the known tags are read, lists only where they have an entry for each strip or tile.
A directory offset seen before ends the walk. An empty table gives an empty one. Extra columns are kept; one that has a
result's name (in any case) gets underscores behind it until its name is free.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexcheck.llm.common import small_batches, table, text_or_empty

# Fixed values of the TIFF 6.0 format: field types to struct codes, tags, compression schemes.
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
LZW_CLEAR, LZW_END, LZW_FIRST, LZW_MOST_BITS = 256, 257, 258, 12
SINGLE = {WIDTH, LENGTH, BITS, COMPRESSION, SAMPLES, ROWS_PER_STRIP, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH}
LISTS = {STRIP_OFFSETS, STRIP_COUNTS, TILE_OFFSETS, TILE_COUNTS}

#: The most bytes that one stored byte can stand for.
GROWTH = {NONE: 1, PACKBITS: 64, LZW: 2_732, DEFLATE: 1_032, OLD_DEFLATE: 1_032}
MOST_PAGE_BYTES = 1 << 30

UNIT = 192
ROW_SAMPLES = 64  # of 3 bytes: one image row is one unit of the payload
ROWS_PER_PAGE = 1 << 16


def unpack_bits(data: bytes, want: int | None = None) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and (want is None or len(out) < want):
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def unpack_lzw(data: bytes, want: int | None = None) -> bytes:
    """MSB-first variable-width codes; the width grows one code early, as TIFF writers do."""
    out, entries, width, last, size = [], [], 9, b"", 0
    value = held = 0
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    entries = base[:]
    for byte in data:
        value, held = (value << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = value >> held
        value &= (1 << held) - 1
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            entries, width, last = base[:], 9, b""
            continue
        if not last:
            if code > 255:
                raise ValueError("bad LZW stream")
            piece = entries[code]
        else:
            if code > len(entries):
                raise ValueError("bad LZW stream")
            piece = entries[code] if code < len(entries) else last + last[:1]
            if len(entries) < 1 << LZW_MOST_BITS:  # a full table waits for the next clear code
                entries.append(last + piece[:1])
        out.append(piece)
        last, size = piece, size + len(piece)
        if want is not None and size >= want:
            break
        if len(entries) + 1 >= (1 << width) and width < LZW_MOST_BITS:
            width += 1
    return b"".join(out)


def _decode(data: bytes, scheme: int, want: int) -> bytes:
    if scheme == NONE:
        raw = data
    elif scheme == PACKBITS:
        raw = unpack_bits(data, want)
    elif scheme == LZW:
        raw = unpack_lzw(data, want)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompressobj().decompress(data, want)
    else:
        raise ValueError(f"compression {scheme} is not supported")
    if len(raw) < want:
        raise ValueError("a strip or tile is too short")
    return raw[:want]


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    """The known tags and the next directory's place. A single tag has its first value, a list its type, length and place:
    what a file claims is unpacked once it is known to be needed."""
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in TYPES or not count or tag not in SINGLE | LISTS:
            continue
        code, place = order + TYPES[kind], at + 2 + 12 * k + 8
        if count * struct.calcsize(code) > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        tags[tag] = (code, count, place) if tag in LISTS else struct.unpack_from(code, data, place)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _list(data: bytes, tag: tuple[str, int, int], want: int) -> np.ndarray:
    """A list of places or sizes, one for each of ``want`` strips or tiles."""
    code, count, place = tag
    if count != want:
        raise ValueError("the number of strips or tiles does not fit the image")
    values = np.frombuffer(data, code, count, place)
    if values.dtype.kind not in "iu" or values.min() < 0:
        raise ValueError("strips or tiles without size")
    return values.astype(np.int64)


def rows_bytes(wide: int, tall: int, deep: int, itemsize: int, count: int, tiled: bool) -> int:
    """Bytes of all tiles, whose edges may lie outside the image; strips end with it."""
    return wide * tall * deep * itemsize * count if tiled else 0


def _page(data: bytes, tags: dict[int, tuple], order: str, most_bytes: int | None = MOST_PAGE_BYTES) -> np.ndarray:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, length, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    bits, scheme, predictor, planar = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (8, 16) or predictor not in (1, 2) or planar not in (1, 2) or scheme not in GROWTH:
        raise ValueError(f"{bits} bits, predictor {predictor}, planar {planar} or compression {scheme} is not supported")
    if not all(isinstance(x, int) and x > 0 for x in (width, length, samples)):
        raise ValueError("an image without size")
    kind = np.dtype(f"{order}u{bits // 8}")
    deep = samples if planar == 1 else 1
    if TILE_OFFSETS in tags:
        wide, tall, lists = one(TILE_WIDTH), one(TILE_LENGTH), (TILE_OFFSETS, TILE_COUNTS)
    else:
        rows = one(ROWS_PER_STRIP, length)
        wide, tall, lists = width, min(rows, length) if isinstance(rows, int) else None, (STRIP_OFFSETS, STRIP_COUNTS)
    if not all(isinstance(x, int) and x > 0 for x in (wide, tall)):
        raise ValueError("strips or tiles without size")
    across, down = -(-width // wide), -(-length // tall)
    offsets, counts = (_list(data, tags[t], across * down * (samples if planar == 2 else 1)) for t in lists)
    size = width * length * samples * kind.itemsize
    stored = GROWTH[scheme] * (int(counts.sum()) + len(counts))
    if max(size, rows_bytes(wide, tall, deep, kind.itemsize, len(offsets), TILE_OFFSETS in tags)) > stored:
        raise ValueError("the page is larger than its stored bytes can hold")
    if most_bytes is not None and size > most_bytes:
        raise ValueError(f"the page has {size} bytes, over the bound of {most_bytes}")
    image = np.zeros((length, width, samples), kind.newbyteorder("="))
    for k in range(len(offsets)):
        place, count = int(offsets[k]), int(counts[k])
        plane, cell = divmod(k, across * down)
        top, left = cell // across * tall, cell % across * wide
        rows = tall if TILE_OFFSETS in tags else min(tall, length - top)
        if place + count > len(data):
            raise ValueError("the file is cut off")
        raw = _decode(data[place : place + count], scheme, rows * wide * deep * kind.itemsize)
        block = np.frombuffer(raw, kind).reshape(rows, wide, deep).astype(image.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=image.dtype)
        keep_rows, keep_cols = min(rows, length - top), min(wide, width - left)
        if planar == 1:
            image[top : top + keep_rows, left : left + keep_cols] = block[:keep_rows, :keep_cols]
        else:
            image[top : top + keep_rows, left : left + keep_cols, plane] = block[:keep_rows, :keep_cols, 0]
    return image


def read_tiff(data: bytes, most_bytes: int | None = MOST_PAGE_BYTES) -> Iterator[np.ndarray]:
    """The pages, each as rows x columns x samples."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        tags, at = _directory(data, at, order)
        yield _page(data, tags, order, most_bytes)


def write_tiff(pages: list[np.ndarray], rows_per_strip: int = 256) -> bytes:
    """Little-endian, 8-bit samples, deflate strips with horizontal differencing; same pages, same bytes."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for image in pages:
        length, width, samples = image.shape
        diff = image.copy()
        diff[:, 1:] = image[:, 1:] - image[:, :-1]
        strips = [zlib.compress(diff[r : r + rows_per_strip].tobytes(), 6) for r in range(0, length, rows_per_strip)]
        offsets = []
        for s in strips:
            offsets.append(len(out))
            out += s + b"\0" * (len(s) % 2)
        entries = []

        def put(tag: int, kind: int, values: list[int]) -> None:
            packed = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(packed) > 4:
                place = len(out)
                out.extend(packed + b"\0" * (len(packed) % 2))  # noqa: B023
                packed = struct.pack("<I", place)
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))  # noqa: B023

        put(WIDTH, 4, [width])
        put(LENGTH, 4, [length])
        put(BITS, 3, [8] * samples)
        put(COMPRESSION, 3, [DEFLATE])
        put(PHOTOMETRIC, 3, [2 if samples == 3 else 1])
        put(STRIP_OFFSETS, 4, offsets)
        put(SAMPLES, 3, [samples])
        put(ROWS_PER_STRIP, 4, [rows_per_strip])
        put(STRIP_COUNTS, 4, [len(s) for s in strips])
        put(PLANAR, 3, [1])
        put(PREDICTOR, 3, [2])
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


PAGE_SCHEMA = "page int, width int, height int, samples int, pixels binary, feature string, error string"


def page_feature(image: np.ndarray) -> str:
    """Mean and deviation of the samples and a 16-bin histogram in parts per thousand."""
    flat = image.reshape(-1)
    counts = np.bincount((flat >> (8 * flat.itemsize - 4)).astype(np.int64), minlength=16)
    shares = ",".join(str(x) for x in (counts * 1000 // max(1, flat.size)).tolist())
    return f"mean={flat.mean(dtype=np.float64):.4f};std={flat.std(dtype=np.float64):.4f};hist={shares}"


def pages_of(data: bytes | None, most_bytes: int | None = MOST_PAGE_BYTES) -> Iterator[tuple]:
    n = 0
    try:
        if data is None:
            raise ValueError("no data")
        for image in read_tiff(data, most_bytes):
            yield n, image.shape[1], image.shape[0], image.shape[2], image.tobytes(), page_feature(image), None
            n += 1
        if not n:
            raise ValueError("no page")
    except (ValueError, LookupError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
        yield -1, None, None, None, None, None, f"{type(e).__name__}: {e}"


def tiff_pages(df: DataFrame, media: str = "media", most_bytes: int | None = MOST_PAGE_BYTES) -> DataFrame:
    """All columns of ``df`` but the media, then one row per page of each file; a page of over ``most_bytes`` is an error row."""
    made = [x.split() for x in PAGE_SCHEMA.split(", ")]
    at = df.columns.index(media)
    keep = [k for k in range(len(df.columns)) if k != at]
    names, taken = [], {n for n, _ in made} | {df.columns[k].lower() for k in keep}
    for k in keep:
        name = df.columns[k]
        if name.lower() in {n for n, _ in made}:
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        names.append(name)
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    schema = ", ".join([f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(quoted, keep, strict=True)] + [PAGE_SCHEMA])
    small_batches(df.sparkSession)

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                kept = [batch.column(k).slice(i, 1) for k in keep]
                for page in pages_of(batch.column(at)[i].as_py(), most_bytes):  # a page at a time: memory holds one
                    kinds = [pa.int32()] * 4 + [pa.binary(), pa.string(), pa.string()]
                    columns = [pa.array([x], k) for x, k in zip(page, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(kept + columns, names + [n for n, _ in made])

    # by place: names with dots or backticks cannot be handed over
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(decode, schema)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" "), len(raw)


def text_to_tiff(text: str | None) -> tuple[bytes, int]:
    """The padded UTF-8 bytes as RGB rows of 64 pixels, in pages of at most ROWS_PER_PAGE rows."""
    payload, n = payload_of(text)
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW_SAMPLES, 3)
    return write_tiff([image[r : r + ROWS_PER_PAGE] for r in range(0, len(image), ROWS_PER_PAGE)]), n


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media for ``docs(doc_id, text)``."""
    small_batches(docs.sparkSession)

    def encode(batches):
        for batch in batches:
            made = [text_to_tiff(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([m for m, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def media_digests(encoded: DataFrame) -> DataFrame:
    """One row per file, its pages decoded in place one after another (no shuffle to regroup them)."""
    small_batches(encoded.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(batches):
        for batch in batches:
            rows = []
            for doc, n, media in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sha, size, tail, features = hashlib.sha256(), 0, b"", []
                for _, _, _, _, pixels, feature, error in pages_of(media):
                    if error:
                        raise ValueError(f"stored media of document {doc}: {error}")
                    sha.update(pixels)
                    size, tail = size + len(pixels), pixels[-16:]
                    features.append(feature)
                rows.append((doc, n, size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), "|".join(features)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return encoded.mapInArrow(
        digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(encode_texts(table(spark, sf_dir, "documents")))
