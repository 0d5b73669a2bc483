"""AVI files as a source and a sink: ranges, filters, codecs, broken files."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

from reelspark.plans.entry import QUERIES
from reelspark.sources import files
from reelspark.sources import video as V

H, W = 6, 7
IMAGES = np.random.default_rng(1).integers(0, 256, (40, H, W, 3), dtype=np.uint8)


def _frames(spark, videos=(3, 4), n=40):
    rows = [(v, i, i / 10, ("", H, W, 3, V.BGR_MODE, bytearray(((IMAGES[i].astype(int) + (v or 0)) % 256).astype(np.uint8).tobytes()))) for v in videos for i in range(n)]
    return spark.createDataFrame(rows, f"video_id long, frame_index long, ts double, image {V.IMAGE}").repartition(5)


@pytest.fixture(scope="module")
def clips(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('videos')}"
    made = V.write_videos(_frames(spark), folder, 12.5).collect()
    assert sorted((r.video_id, r.frames) for r in made) == [(3, 40), (4, 40)] and made[0].path.startswith("file:///")
    return folder


def _chunk(kind, data):
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _avi(contents, codec=b"MJPG", with_index=True, absolute=False, sound=False, height=H, bits=24):
    """An AVI file with frames of any bytes, sound between them, with or without an index."""
    main = struct.pack("<14I", 40000, 0, 0, 16, len(contents), 0, 2, 0, W, abs(height), 0, 0, 0, 0)
    strh = lambda kind, scale, rate: _chunk(b"strh", struct.pack("<4s4sIHHIIIIIIIIHHHH", kind, codec, 0, 0, 0, 0, scale, rate, 0, len(contents), 0, 0, 0, 0, 0, 0, 0))
    form = _chunk(b"strf", struct.pack("<IiiHH4sIiiII", 40, W, height, 1, bits, codec, 0, 0, 0, 0, 0))
    streams = ([_chunk(b"LIST", b"strl" + strh(b"auds", 1, 8000) + _chunk(b"strf", bytes(18)))] if sound else []) + [_chunk(b"LIST", b"strl" + strh(b"vids", 1001, 30000) + form)]
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + b"".join(streams))
    number = len(streams) - 1
    movie, index = b"movi", b""
    start = 12 + len(header) + 8
    for c in contents:
        for name, data in ([(b"00wb", b"abc")] if sound else []) + [(f"{number:02d}dc".encode(), c)]:
            index += struct.pack("<4sIII", name, 16, len(movie) + (start if absolute else 0), len(data))
            movie += _chunk(name, data)
    body = b"AVI " + header + _chunk(b"LIST", movie) + (_chunk(b"idx1", index) if with_index else b"")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_what_was_written_is_read(spark, clips):
    got = V.video_frames(V.video_chunks(spark, clips)).collect()
    assert len(got) == 80
    for r in got:
        want = ((IMAGES[r.frame_index].astype(int) + r.video_id) % 256).astype(np.uint8)
        assert bytes(r.image.data) == want.tobytes() and (r.image.height, r.image.width, r.image.nChannels) == (H, W, 3) and r.ts == r.frame_index / 12.5
    (meta,) = [r for r in files.ingest(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(clips)).collect() if "video_id=3" in r.path]
    assert (meta.fps, meta.total_frames, meta.width, meta.height, meta.error) == (12.5, 40, W, H, None)


def test_scan_equals_image_folder(spark, clips, tmp_path):
    (tmp_path / "video_id=3").mkdir()
    for i in range(40):
        (tmp_path / "video_id=3" / f"frame_{i}.png").write_bytes(files.png(((IMAGES[i].astype(int) + 3) % 256).astype(np.uint8)))
    columns = ("video_id", "frame_index", "ts", F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.mode").alias("m"), F.hex("image.data").alias("d"))
    a = files.image_frames(spark, str(tmp_path / "*"), 12.5).select(*columns)
    b = V.video_frames(V.video_chunks(spark, clips).where("video_id = 3")).select(*columns)
    assert sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize("range_bytes", [200, 1000, 1 << 26])
@pytest.mark.parametrize("every", [1, 3])
def test_ranges_and_strides_lose_and_repeat_nothing(spark, clips, every, range_bytes):
    rows = V.video_chunks(spark, clips, every, range_bytes).where("frame_index > 4 and frame_index <= 31").select("video_id", "frame_index").collect()
    assert sorted(map(tuple, rows)) == [(v, i) for v in (3, 4) for i in range(40) if i % every == 0 and 4 < i <= 31]


class _Counting:
    """A file that counts what is read of it."""

    def __init__(self, f):
        self.f, self.bytes, self.calls = f, 0, 0

    def size(self):
        return self.f.size()

    def read_at(self, n, at):
        self.calls += 1
        got = self.f.read_at(n, at)
        self.bytes += len(got)
        return got


def test_reader_reads_the_asked_frames_only(clips):
    path = V.listed(clips)[0][0]
    with fs.LocalFileSystem().open_input_file(path.removeprefix("file://")) as f:
        counted = _Counting(f)
        clip = V.read_clip(counted)
        header, calls = counted.bytes, counted.calls
        frame = (3 * W + 3) // 4 * 4 * H
        assert header < 40 * 16 + 500  # the index and what describes the stream
        got = list(V._contents(counted, clip, np.array([5, 6, 7, 30])))
        assert [i for i, _ in got] == [5, 6, 7, 30] and counted.calls == calls + 2
        assert counted.bytes - header == 4 * frame + 2 * 8  # what lies between neighbours is a chunk's head


def test_filters_reach_the_reader(spark, clips):
    filters = [GreaterThan(("frame_index",), 3), LessThanOrEqual(("frame_index",), 9), In(("video_id",), (4, None)), StringContains(("path",), "x")]
    reader = V.AviReader({"path": clips, "rangebytes": "1000"})
    assert list(reader.pushFilters(filters)) == filters[3:]
    assert (reader.asked.low, reader.asked.high, reader.asked.videos) == (4, 10, [4])
    parts = reader.partitions()
    assert {r.video_id for p in parts for r in p.ranges} == {4} and len(parts) > 2
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 6
    assert list(reader.pushFilters([EqualTo(("frame_index",), 5), In(("frame_index",), (5, 7))])) == [] and reader.asked.of(40).tolist() == [5]
    plan = V.video_chunks(spark, clips).where("frame_index = 5 and video_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "(frame_index" not in plan.split("BatchScan")[0]  # no filter is left above the scan
    none = V.video_chunks(spark, clips).where("video_id = 99 or video_id is null").count()
    assert none == 0 and V.video_chunks(spark, clips).where("video_id = 99").count() == 0


def test_frames_of_other_parts_of_a_file_may_be_anything(spark, tmp_path):
    raw = bytearray(_avi([bytes([i]) * 100 for i in range(20)]))
    for i in list(range(1, 8)) + list(range(12, 20)):
        at = raw.index(bytes([i]) * 100)
        raw[at - 8 : at + 100] = b"\xff" * 108  # not even a chunk; the first one's head tells what offsets count from
    (tmp_path / "video_id=1").mkdir()
    (tmp_path / "video_id=1" / "a.avi").write_bytes(raw)
    got = V.video_chunks(spark, str(tmp_path)).where("frame_index between 8 and 11").collect()
    assert sorted((r.frame_index, bytes(r.content)[:1]) for r in got) == [(i, bytes([i])) for i in range(8, 12)]


@pytest.mark.parametrize("options", [{}, {"with_index": False}, {"absolute": True}, {"sound": True}, {"sound": True, "with_index": False}])
def test_compressed_frames_keep_their_bytes(spark, tmp_path, options):
    contents = [bytes([i]) * (10 + 3 * i) for i in range(12)]
    (tmp_path / "video_id=8.avi").write_bytes(_avi(contents, **options))
    rows = V.video_chunks(spark, str(tmp_path)).orderBy("frame_index").collect()
    assert [bytes(r.content) for r in rows] == contents and rows[0].codec == "MJPG" and rows[5].ts == 5 / (30000 / 1001) and rows[0].video_id == 8
    chunks = V.video_chunks(spark, str(tmp_path))
    assert V.video_frames(chunks).count() == 0  # nothing decodes them
    size = lambda raw: np.full((2, len(raw), 3), raw[0], np.uint8)
    assert [(r.image.width, bytes(r.image.data)[:1]) for r in V.video_frames(chunks, size).orderBy("frame_index").collect()] == [(len(c), c[:1]) for c in contents]


def test_top_down_rows_and_other_depths(spark, tmp_path):
    row = (3 * W + 3) // 4 * 4
    content = bytes(range(row)) * H
    (tmp_path / "down.avi").write_bytes(_avi([content], b"\0\0\0\0", height=-H))
    (tmp_path / "deep.avi").write_bytes(_avi([content], b"\0\0\0\0", bits=32))
    rows = {r.path.rsplit("/", 1)[1]: r for r in V.video_chunks(spark, str(tmp_path)).collect()}
    assert (rows["down.avi"].codec, rows["down.avi"].bottom_up, rows["deep.avi"].codec) == ("BGR", False, "RGB32")
    (image,) = [r.image for r in V.video_frames(V.video_chunks(spark, str(tmp_path))).collect()]
    assert bytes(image.data) == bytes(range(3 * W)) * H and rows["down.avi"].video_id is None


def test_cut_and_broken_files(spark, tmp_path):
    whole = _avi([bytes([i]) * 50 for i in range(10)], with_index=False)
    at = whole.index(bytes([7]) * 50)
    (tmp_path / "cut.avi").write_bytes(whole[: at + 20])
    assert sorted(r.frame_index for r in V.video_chunks(spark, str(tmp_path)).collect()) == list(range(7))
    for name, content in (("empty.avi", b""), ("text.avi", b"RIFFno, a text"), ("head.avi", whole[:100]), ("sound.avi", whole.replace(b"vids", b"auds"))):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "other.mp4").write_bytes(b"not looked at")
    assert V.video_chunks(spark, str(tmp_path), permissive=True).count() == 7
    with pytest.raises(Exception, match="not an AVI file"):
        V.video_chunks(spark, str(tmp_path)).count()
    with pytest.raises(Exception, match="missing"):
        V.video_chunks(spark, str(tmp_path / "missing")).count()


def test_writer_runs_again_and_refuses_mixed_sizes(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for _ in range(2):
        V.write_videos(_frames(spark, (1, None), 5), folder, 10.0).collect()
    assert V.video_chunks(spark, folder).count() == 5 and [p.name for p in tmp_path.rglob("*") if p.is_file()] == ["clip.avi"]
    odd = spark.createDataFrame([(2, 0, 0.0, ("", 1, 1, 3, 16, bytearray(3))), (2, 1, 0.1, ("", 1, 2, 3, 16, bytearray(6)))], f"video_id long, frame_index long, ts double, image {V.IMAGE}")
    with pytest.raises(Exception, match="several sizes"):
        V.write_videos(odd, folder, 10.0).collect()
    assert V.write_videos(odd.limit(0), folder, 10.0).count() == 0


def test_frames_of_a_batch_are_written_together():
    """A clip's chunks go out in one request, and the file is what it is frame by frame."""

    class Out(list):
        write = list.append

    rng = np.random.default_rng(2)
    frames = [rng.integers(0, 256, (4, 5, 3), dtype=np.uint8).tobytes() for _ in range(40)]
    together, single = Out(), Out()
    one, other = V._Writer(together, 40, 4, 5, 8.0), V._Writer(single, 40, 4, 5, 8.0)
    one.add(frames)
    for f in frames:
        other.add([f])
    one.close()
    other.close()
    assert len(together) == 3 and b"".join(together) == b"".join(single)


def test_heads_are_read_by_their_paths(spark, tmp_path):
    big = b"RIFFavihvids" + bytes(range(256)) * 400
    late = b"RIFF" + bytes(V.HEAD_BYTES) + b"avihvids"
    for name, content in (("a.avi", big), ("b.mp4", b"mp4 " + big), ("e.avi", late), ("c.avi", b"RIFF"), ("d.avi", b"")):
        (tmp_path / name).write_bytes(content)
    files = spark.createDataFrame([(f"file://{tmp_path}/a.avi",), (f"{tmp_path}/b.mp4",), (f"file:{tmp_path}/c.avi",), (f"{tmp_path}/d.avi",), (f"{tmp_path}/e.avi",)], "path string")
    got = {r.path[-5]: (r.length, bytes(r.content)) for r in V.heads(files).collect()}
    assert got == {"a": (len(big), big[: V.HEAD_BYTES]), "b": (len(big) + 4, b"mp4 " + big), "c": (4, b"RIFF"), "d": (0, b""), "e": (len(late), late)}
    assert V.heads(files.limit(0)).count() == 0
    with pytest.raises(Exception, match="missing"):
        V.heads(spark.createDataFrame([(f"{tmp_path}/missing.avi",)], "path string")).collect()


def test_metadata_of_written_files_list_no_folder(spark):
    found = QUERIES["video_metadata"](spark, "/root/testdata/sf0.001")
    assert "binaryfile" not in found._jdf.queryExecution().toString().lower()
    assert found.count() > 0
