"""Documents as FLAC audio: store, read back, and cut into blocks of samples that can be sought."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordaudit.llm import flac
from recordaudit.llm.common import table

SLICE = 4 << 20  # payload bytes handled at a time, at least one document
MEDIA = "doc_id long, n_bytes long, media binary"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PCM = "doc_id long, frame long, sample_offset long, n_samples int, byte_offset long, pcm binary"


def payload(text: str | None) -> bytes:
    """The text as UTF-8 (null: empty), filled with spaces up to a positive multiple of 192 bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(-(-len(raw) // flac.BLOCK), 1) * flac.BLOCK, b" ")


def _runs(sizes: list[int]) -> Iterator[slice]:
    """Runs of rows of about SLICE bytes together."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts.cast(pa.binary())), 0)
        for run in _runs(sizes.to_pylist()):
            part = batch.slice(run.start, run.stop - run.start)
            media = flac.encode([payload(t) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), sizes[run].cast(pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the whole text of every row as a FLAC stream of 8-bit mono samples.

    Null and empty texts become 192 spaces; repeated rows and null ids stay row by row; other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode, MEDIA)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[flac.Stream]]]:
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("media")).to_pylist()
        for run in _runs(sizes):
            part = batch.slice(run.start, run.stop - run.start)
            media = part.column("media").to_pylist()
            yield part, media, flac.decode(media)


def feature(pcm: bytes) -> str:
    """Root mean square, zero crossings and mean step of the signal, in whole thousandths."""
    x = np.frombuffer(pcm, dtype=np.uint8).astype(np.int64) - 128
    rms = int(np.sqrt(float((x * x).sum()) / len(x)) * 1000)
    crossings = int((np.diff(x >= 0)).sum()) * 1000 // len(x)
    return f"rms={rms};zcr={crossings};step={int(np.abs(np.diff(x)).sum()) * 1000 // len(x)}"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, media, streams in _decoded(batches):
        sha = lambda all_bytes: pa.array([hashlib.sha256(b).hexdigest() for b in all_bytes])
        pcm = [s.pcm for s in streams]
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), part.column("n_bytes"), pa.array(list(map(len, pcm)), pa.int64()), sha(pcm), pa.array([zlib.crc32(p[-16:]) for p in pcm], pa.int64()),
            pa.array(list(map(len, media)), pa.int64()), sha(media), pa.array([feature(p) for p in pcm])], [f.split()[0] for f in DIGEST.split(", ")])


def digest_media(media: DataFrame) -> DataFrame:
    """Decode every stream of (doc_id, n_bytes, media), its checksums verified, and tell its sizes, digests and features."""
    return media.mapInArrow(_digest, DIGEST)


def pcm_blocks(media: DataFrame, frames: int = 64) -> DataFrame:
    """The samples of every stream in blocks of `frames` frames: where a block's samples begin, and at which stored byte its first frame does."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, streams in _decoded(batches):
            rows = [
                (doc_id, k, k * flac.BLOCK, len(own := s.pcm[k * flac.BLOCK:(k + frames) * flac.BLOCK]), int(s.offsets[k]), own)
                for doc_id, s in zip(part.column("doc_id").to_pylist(), streams) for k in range(0, len(s.offsets), frames)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in PCM.split(", ")])

    return media.mapInArrow(cut, PCM)


def op5_flac(spark, sf_dir):
    # FLAC of text is as large as the text, so the stored form stays a column between writer and reader and is not written to disk
    return digest_media(encode_media(table(spark, sf_dir, "documents")))
