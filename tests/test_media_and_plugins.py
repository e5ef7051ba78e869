"""Containers read from real files, plugins loaded by path, inputs that a judge needs."""

import hashlib
import struct
import wave

import pytest
from pyspark.sql import functions as F

from tracewright.operators import plugins, rewards
from tracewright.sources import media


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def track(kind, scale, length, runs, entry):
    times = box(b"stts", struct.pack(">II", 0, len(runs)), *[struct.pack(">II", n, d) for n, d in runs])
    table = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), entry), times)
    header = box(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, scale, length, 0))
    return box(b"trak", box(b"tkhd", bytes(20)), box(b"mdia", header, box(b"hdlr", bytes(8), kind, bytes(12)), box(b"minf", table)))


VIDEO = box(b"avc1", bytes(24), struct.pack(">HH", 640, 360), bytes(50))
AUDIO = box(b"mp4a", bytes(16), struct.pack(">H", 2), bytes(6), struct.pack(">I", 44_100 << 16))


def mp4(seconds=3, fps=25, late=True):
    tracks = [track(b"vide", 1000, seconds * 1000, [(fps * seconds - 5, 40), (5, 40)], VIDEO), track(b"soun", 44_100, seconds * 44_100, [(1, 1024)], AUDIO)]
    moov = box(b"moov", box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, 600, seconds * 600), bytes(80)), *tracks)
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + 1000) + bytes(1000)  # a 64-bit size
    return box(b"ftyp", b"isom", bytes(4)) + (data + moov if late else moov + data)


def wav(path, seconds, rate=16_000, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(bytes(width * int(rate * seconds)))


def test_boxes_of_all_kinds():
    facts = media.read_facts(mp4())
    assert facts == media.read_facts(mp4(late=False))
    assert facts == {"kind": "mp4", "duration": 3.0, "frames": 75, "frame_rate": 25.0, "width": 640, "height": 360, "audio_duration": 3.0, "audio_format": "mp4a", "channels": 2, "rate": 44_100}
    wide = box(b"mdhd", b"\1\0\0\0", struct.pack(">QQIQ", 0, 0, 90_000, 450_000))
    assert media._length(memoryview(wide), (8, len(wide))) == 5.0
    unknown = box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 1000, 0xFFFFFFFF))
    assert media._length(memoryview(unknown), (8, len(unknown))) is None


@pytest.mark.parametrize("cut", [10, 40, 1_100, 1_300, 1_500])
def test_cut_files_are_errors(cut):
    assert "error" in media.read_facts(mp4()[:cut])


def test_other_files_are_errors():
    assert all("error" in media.read_facts(x) for x in (b"", b"RIFF", b"RIFF0000WAVEfmt ", b"ID3 something else", box(b"ftyp", b"isom")))
    lying = bytearray(mp4(late=False))
    at = lying.index(b"stts") + 8
    lying[at : at + 4] = struct.pack(">I", 1 << 30)  # a table that claims more than there is
    assert "error" in media.read_facts(bytes(lying))


def test_clips_from_real_files(spark, tmp_path):
    for name, content in (("a.mp4", mp4()), ("copy.mp4", mp4()), ("long.mp4", mp4(seconds=9)), ("bad.mp4", mp4()[:1_300])):
        (tmp_path / name).write_bytes(content)
    wav(tmp_path / "a.wav", 3.2)
    wav(tmp_path / "short.wav", 1)
    wav(tmp_path / "deep.wav", 3, width=3)
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    facts = media.media_facts(spark, str(tmp_path / "*.*"))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in facts.collect()}
    assert rows["a.mp4"].sha256 == rows["copy.mp4"].sha256 == hashlib.sha256(mp4()).hexdigest() and rows["copy.mp4"].frames == 75
    assert rows["deep.wav"].audio_format == "pcm_s24le" and rows["bad.mp4"].error and rows["bad.mp4"].duration is None
    clips = [("ok", "a.wav", "a.mp4"), ("short", "short.wav", "a.mp4"), ("long", "a.wav", "long.mp4"), ("deep", "deep.wav", "copy.mp4"), ("none", "z.wav", "a.mp4"), ("novideo", "a.wav", "z.mp4"), ("badaudio", "bad.wav", "a.mp4"), ("badvideo", "a.wav", "bad.mp4"), ("twice", "a.mp4", "a.mp4")]
    frame = spark.createDataFrame([(i, f"{tmp_path}/{a}", f"file://{tmp_path}/{v}") for i, a, v in clips], "id string, audio string, video string")
    got = {r.id: r.media_error for r in media.checked_clips(frame, facts, most_frames=8).collect()}
    assert got == {
        "ok": None, "short": "durations_differ", "long": "too_many_frames", "deep": "bad_format", "none": "missing_audio", "novideo": "missing_video",
        "badaudio": "unreadable_audio", "badvideo": "unreadable_video", "twice": "bad_format",
    }


PLUGIN = """
import pandas as pd

SCALE = 2.0

def brevity(response):
    return None if response is None else SCALE / (1 + len(response))

def spread(frame: pd.DataFrame):
    return (frame["score"] - frame["score"].iloc[0] * 0 - frame["gold"]).tolist()

class Sentences:
    def eval(self, text):
        for part in (text or "").split("."):
            if part.strip():
                yield (part.strip(),)

PLUGINS = [
    {"name": "brevity", "function": brevity, "inputs": ["response"], "kind": "scalar"},
    {"name": "spread", "function": spread, "inputs": ["gold", "score"], "kind": "batch"},
    {"name": "sentences", "function": Sentences, "kind": "table", "returns": "sentence string"},
]
"""


def test_plugins_by_path(spark, tmp_path):
    path = tmp_path / "own_rewards.py"
    path.write_text(PLUGIN)
    assert plugins.load_plugins(spark, str(path)) == ["brevity", "spread", "sentences"] == plugins.load_plugins(spark, f"file://{path}")
    rows = spark.createDataFrame([(0, 1.5, "One. Two."), (1, 1.0, None)], "gold int, score double, response string").repartition(2)
    assert sorted((r.gold, r.brevity, r.spread) for r in rewards.rewarded(rows, ["brevity", "spread"]).collect()) == [(0, 0.2, 1.5), (1, None, 0.0)]
    rows.createOrReplaceTempView("rows_of_plugins")
    assert [r[0] for r in spark.sql("select spread(gold, score) from rows_of_plugins order by gold").collect()] == [1.5, 0.0]
    assert [tuple(r) for r in spark.sql("select gold, sentence from rows_of_plugins, lateral sentences(response) order by sentence").collect()] == [(0, "One"), (0, "Two")]
    path.write_text(PLUGIN.replace("2.0", "3.0"))
    with pytest.raises(ValueError, match="there is a plugin 'brevity'"):
        plugins.load_plugins(spark, str(path))
    for broken, said in (("PLUGINS = []", "no list"), ("PLUGINS = [{'name': 'x', 'kind': 'odd'}]", "not a plugin"), ("PLUGINS = [{'name': 'x', 'kind': 'scalar', 'function': abs}]", "lacks its inputs")):
        path.write_text(broken)
        with pytest.raises(ValueError, match=said):
            plugins.load_plugins(spark, str(path))
    with pytest.raises(FileNotFoundError):
        plugins.load_plugins(spark, str(tmp_path / "none.py"))


def test_inputs_are_required(spark):
    rows = spark.createDataFrame([(1, "said", ["a.wav"], ["v.mp4"])], "id int, transcript string, audios array<string>, videos array<string>")
    assert rewards.require_inputs(rows).count() == 1
    for column, value, said in (("transcript", F.lit(" 　"), "missing_transcript"), ("transcript", F.lit(None).cast("string"), "missing_transcript"), ("audios", F.array(F.lit(" ")), "missing_audio"), ("videos", F.lit(None).cast("array<string>"), "missing_video")):
        with pytest.raises(Exception, match=said):
            rewards.require_inputs(rows.withColumn(column, value)).collect()
