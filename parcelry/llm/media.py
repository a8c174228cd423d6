"""Media columns: text bytes stored as FLAC streams, decoded into a table of PCM blocks with seekable sample offsets.

stored() encodes, decoded() verifies and decodes and gives each stream's blocks, features() describes what is read back
from the table of blocks. The query writes that table to the shared folder; streams themselves travel from the encoder to
the decoder within a task, as text shrinks little as sound and a table of them would be as large as the texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.llm import flac
from parcelry.llm.common import binaries, lean

#: Payloads are padded with bytes 0 to a positive multiple of this.
UNIT = 64
#: Bytes of payload that one call of the codec gets, so that its arrays stay small whatever the texts' lengths.
BATCH_BYTES = 1 << 20


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH_BYTES:
            yield a, i
            a, total = i, 0
        total += n
    if sizes:
        yield a, len(sizes)


def stored(docs: DataFrame) -> DataFrame:
    """Every document's text as an 8-bit mono FLAC stream: doc_id, n_bytes (without padding), media binary.

    Null and empty text is stored as 64 bytes 0. Equal texts give equal streams; repeated rows stay, and no rows give no
    rows. A very long text is one stream, whose codec takes some 100 bytes of memory for each of its own. Other columns
    of docs aren't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _chunks([n or 0 for n in batch.column(2).to_pylist()]):
                part = batch.slice(a, b - a)
                texts = [t or b"" for t in binaries(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(flac.encode([padded(t) for t in texts]), pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "text", "octet_length(text) AS size").mapInArrow(lean(run), f"doc_id {kind}, n_bytes bigint, media binary")


BLOCKS = "array<struct<first_sample: bigint, first_byte: bigint, pcm: binary>>"
_BLOCKS = pa.list_(pa.struct([("first_sample", pa.int64()), ("first_byte", pa.int64()), ("pcm", pa.binary())]))


def decoded(media: DataFrame) -> DataFrame:
    """The streams of stored(), decoded: doc_id, n_bytes, media_bytes, media_sha256, and blocks: of each frame its first sample, its first byte in the stream, and its unsigned 8-bit samples.

    Checksums are verified; a stream that fails one raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_pylist()
            for a, b in _chunks(sizes):
                part = batch.slice(a, b - a)
                streams = part.column(2).to_pylist()
                blocks = []
                for stream, payload in zip(streams, flac.decode(streams), strict=True):
                    bounds = flac.Stream(stream).bounds()
                    blocks.append([{"first_sample": first, "first_byte": at, "pcm": payload[first : first + n]} for first, n, at, _ in bounds])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(map(len, streams), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in streams]), pa.array(blocks, _BLOCKS)],
                    ["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"],
                )

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.selectExpr("doc_id", "n_bytes", "media", "octet_length(media) AS size").mapInArrow(lean(run), f"doc_id {kind}, n_bytes bigint, media_bytes bigint, media_sha256 string, blocks {BLOCKS}")


def samples_at(blocks: DataFrame, first: int, count: int) -> DataFrame:
    """doc_id, pcm: `count` samples of each stream from `first` on (fewer at its end), from the only blocks that hold them; all within the JVM."""
    here = F.filter("blocks", lambda b: (b["first_sample"] < first + count) & (b["first_sample"] + F.octet_length(b["pcm"]) > first))
    skip = F.greatest(F.lit(first) - F.col("here")[0]["first_sample"], F.lit(0))
    joined = F.aggregate("here", F.lit(b""), lambda a, b: F.concat(a, b["pcm"]))
    return blocks.select("doc_id", here.alias("here")).select("doc_id", F.substring(joined, skip.cast("int") + 1, F.lit(count)).alias("pcm"))


def feature(payload: bytes, n_blocks: int) -> str:
    """Blocks, the samples' sum and energy, and how often the sign changes; all integers."""
    x = (np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8).astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"blocks={n_blocks};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"


def features(blocks: DataFrame) -> DataFrame:
    """The blocks of decoded(), described: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, crc, size, told = [], [], [], []
            own = batch.column(4)
            pcm = own.flatten().field("pcm") if len(own) else pa.array([], pa.binary())
            parts = pcm.to_pylist()
            ends = np.asarray(own.offsets)[1:] - np.asarray(own.offsets)[0]
            at = 0
            for end in ends.tolist():
                payload = b"".join(parts[at:end])
                sha.append(hashlib.sha256(payload).hexdigest())
                crc.append(zlib.crc32(payload[-UNIT:]))
                size.append(len(payload))
                told.append(feature(payload, end - at))
                at = end
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), batch.column(2), batch.column(3), pa.array(told, pa.string())],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = blocks.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return blocks.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(lean(run), schema)
