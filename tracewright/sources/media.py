"""Facts of media files from their containers: durations, frames and formats, without decoding.

``binaryFile`` reads the files in the cluster. WAV and MP4 (and what shares its boxes, such as MOV and M4A) are
understood. A worker keeps the facts of the contents it has seen by their SHA-256, over all batches, so copies are read once.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.validate import media_reason
from tracewright.session import ship_package

#: What :func:`media_facts` tells of a file; what a file does not have is null, as everything but path, digest and size is where there is an error.
FACTS = (
    "path string, sha256 string, bytes long, kind string, duration double, frames long, frame_rate double, width int, height int, "
    "audio_duration double, audio_format string, rate int, channels int, error string"
)
_NAMES = [c.split()[0] for c in FACTS.split(", ")]
_KEPT = 100_000
_SEEN: OrderedDict[bytes, tuple] = OrderedDict()


class Unreadable(ValueError):
    """A file whose container cannot be followed."""


def boxes(data: memoryview, begin: int, end: int) -> Iterator[tuple[str, int, int]]:
    """``(type, begin, end)`` of the contents of the boxes in a range; a box of size 0 goes to its end."""
    while begin + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1:
            if begin + 16 > end:
                raise Unreadable("cut in a box header")
            (size,) = struct.unpack_from(">Q", data, begin + 8)
            head = 16
        size = size or end - begin
        if size < head or begin + size > end:
            raise Unreadable(f"box {kind.decode('latin-1')!r} leaves its parent")
        yield kind.decode("latin-1"), begin + head, begin + size
        begin += size


def inside(data: memoryview, place: tuple[int, int], *path: str) -> tuple[int, int] | None:
    """The first box along a path of types."""
    for wanted in path:
        found = next(((b, e) for kind, b, e in boxes(data, *place) if kind == wanted), None)
        if found is None:
            return None
        place = found
    return place


def _length(data: memoryview, place: tuple[int, int]) -> float | None:
    """Seconds from a header with a time scale and a duration, of either version; null if it is not known there."""
    begin, _ = place
    wide = data[begin] == 1
    scale, length = struct.unpack_from(">IQ" if wide else ">II", data, begin + (20 if wide else 12))
    return length / scale if scale and length != (1 << (64 if wide else 32)) - 1 else None


def _samples(data: memoryview, place: tuple[int, int]) -> int:
    """The number of samples of a track, from its table of durations."""
    begin, end = place
    (entries,) = struct.unpack_from(">I", data, begin + 4)
    if begin + 8 + 8 * entries > end:
        raise Unreadable("cut in a sample table")
    return sum(n for n, _ in struct.iter_unpack(">II", data[begin + 8 : begin + 8 + 8 * entries]))


def read_mp4(data: memoryview) -> dict:
    """Facts of the first video and the first audio track."""
    moov = inside(data, (0, len(data)), "moov")
    if moov is None:
        raise Unreadable("no moov box")
    out: dict = {"kind": "mp4"}
    head = inside(data, moov, "mvhd")
    whole = _length(data, head) if head else None
    for kind, *track in boxes(data, *moov):
        if kind != "trak":
            continue
        handler, header, table = (inside(data, tuple(track), "mdia", *p) for p in (("hdlr",), ("mdhd",), ("minf", "stbl")))
        if not handler or not header or not table:
            continue
        what = bytes(data[handler[0] + 8 : handler[0] + 12])
        seconds = _length(data, header) or whole
        times, about = inside(data, table, "stts"), inside(data, table, "stsd")
        entry = next(boxes(data, about[0] + 8, about[1]), None) if about else None
        if what == b"vide" and "frames" not in out:
            frames = _samples(data, times) if times else None
            out |= {"duration": seconds, "frames": frames, "frame_rate": frames / seconds if frames and seconds else None}
            if entry:
                out["width"], out["height"] = struct.unpack_from(">HH", data, entry[1] + 24)
        elif what == b"soun" and "audio_duration" not in out:
            out["audio_duration"] = seconds
            if entry:
                out["audio_format"] = entry[0].strip()
                out["channels"], out["rate"] = struct.unpack_from(">H", data, entry[1] + 16)[0], struct.unpack_from(">I", data, entry[1] + 24)[0] >> 16
    return out


def read_wave(data: bytes) -> dict:
    with wave.open(io.BytesIO(data)) as w:
        if not w.getframerate():
            raise Unreadable("no frame rate")
        return {"kind": "wav", "audio_duration": w.getnframes() / w.getframerate(), "audio_format": f"pcm_s{8 * w.getsampwidth()}le", "rate": w.getframerate(), "channels": w.getnchannels()}


def read_facts(content: bytes) -> dict:
    """The facts of a file's content, or an ``error``."""
    try:
        if content[:4] == b"RIFF" and content[8:12] == b"WAVE":
            return read_wave(content)
        if content[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"wide"):
            return read_mp4(memoryview(content))
        raise Unreadable("unknown container")
    except (Unreadable, wave.Error, EOFError, struct.error, IndexError) as e:
        return {"error": f"{type(e).__name__}: {e}"}


def _probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for path, content in zip(frame["path"], frame["content"]):
            digest = hashlib.sha256(content).digest()
            facts = _SEEN.pop(digest, None)
            if facts is None:
                facts = read_facts(content)
            _SEEN[digest] = facts
            if len(_SEEN) > _KEPT:
                _SEEN.popitem(last=False)
            out.append({"path": path, "sha256": digest.hex(), "bytes": len(content)} | facts)
        rows = pd.DataFrame(out, columns=_NAMES, dtype=object)
        kinds = {"bytes": "Int64", "frames": "Int64"} | {c: "Int32" for c in ("width", "height", "rate", "channels")} | {c: "Float64" for c in ("duration", "frame_rate", "audio_duration")}
        yield rows.where(rows.notna(), None).astype(kinds)


def media_facts(spark: SparkSession, path: str) -> DataFrame:
    """:data:`FACTS` of all files of a path or pattern."""
    ship_package(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_probe, FACTS)


def checked_clips(clips: DataFrame, facts: DataFrame, most_frames: int = 768, tolerance: float = 0.5, expected: str = "pcm_s16le") -> DataFrame:
    """Clips (with ``audio`` and ``video``, as paths end in ``facts``) with ``media_error``: what is missing, unreadable or wrong, null for good ones.

    As many frames as seconds are taken of a clip, rounded up, and they must not be more than ``most_frames``.
    """
    known = facts.withColumn("_name", F.regexp_replace("path", r"^[a-z]+:/*", "/"))
    of = lambda side: known.select(F.struct(*[c for c in facts.columns]).alias(f"_{side}"), F.col("_name").alias(f"_{side}_name"))
    name = lambda c: F.regexp_replace(F.col(c), r"^[a-z]+:/*", "/")
    met = clips.join(of("a"), name("audio") == F.col("_a_name"), "left").join(of("v"), name("video") == F.col("_v_name"), "left")
    duration = F.col("_v.duration")
    reason = (
        F.when(F.col("_a").isNull(), "missing_audio")
        .when(F.col("_v").isNull(), "missing_video")
        .when(F.col("_a.error").isNotNull(), "unreadable_audio")
        .when(F.col("_v.error").isNotNull(), "unreadable_video")
        .otherwise(media_reason(duration, F.ceil(duration), _seconds(), F.col("_a.audio_format"), most_frames, tolerance, expected))
    )
    return met.withColumn("media_error", reason).drop("_a", "_v", "_a_name", "_v_name")


def _seconds() -> Column:
    return F.coalesce(F.col("_a.audio_duration"), F.lit(float("nan")))
