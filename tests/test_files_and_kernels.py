"""Pixel kernels with closed answers, readers and writers."""

from __future__ import annotations

import json
import struct
import zipfile
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from reelspark import schemas
from reelspark.operators import kernels as K
from reelspark.sources import files

CHECKER = (np.indices((40, 40)).sum(axis=0) % 2 * 255).astype(np.uint8)[..., None].repeat(3, axis=2)


def flat(v, h=40, w=60):
    return np.full((h, w, 3), v, np.uint8)


def ramp():
    x = np.zeros((60, 60, 3), np.uint8)
    x[..., 2] = np.linspace(0, 255, 60).astype(np.uint8)[None, :]
    x[..., 1] = np.linspace(255, 0, 60).astype(np.uint8)[:, None]
    return x


def test_grey_and_sharpness():
    assert K.brightness(flat(77)) == 77 and K.blur_score(flat(9)) == 0
    assert K.blur_score(CHECKER) == 1020.0**2
    assert K.pixel_similarity(flat(0), flat(255)) == 0 and K.structural_similarity(flat(0), flat(255)) == 0 and K.structural_similarity(CHECKER, CHECKER) == 1


def test_histograms():
    h = K.bgr_histogram(ramp())
    assert len(h) == 768 and np.allclose([(h[i : i + 256] ** 2).sum() for i in (0, 256, 512)], 1)
    c = K.colour_features(flat(200))
    assert len(c) == 38 and c[0] == 1 and c[32] == 1 and c[37] == 1
    assert len(K.scene_histogram(ramp())) == 128 and np.isclose(K.scene_histogram(ramp()).sum(), 2)


def test_hsv_of_pure_colours():
    pure = np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [0, 0, 0], [255, 255, 255]]], np.uint8)
    assert K.hsv(pure)[0].tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 0], [0, 0, 255]]


def test_resize_and_filters():
    x = np.arange(16, dtype=float).reshape(4, 4)
    assert np.allclose(K.resize(x, 4, 4), x) and np.allclose(K.resize(x, 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    assert np.allclose([k.sum() for k in K.gabor_bank()], 1) and len(K.gabor_bank()) == 40
    t = K.texture_features(flat(100))
    assert len(t) == 80 and np.allclose(t[0::2], 100) and np.allclose(t[1::2], 0, atol=1e-6)
    assert np.allclose(K.gaussian(np.full((30, 30), 7.0)), 7)


def square():
    x = flat(0, 128, 128)
    x[40:90, 30:80] = 255
    return x


def test_edges_and_shape():
    e = K.canny(K.grey(square()))
    assert not K.canny(K.grey(flat(50))).any() and 150 <= e.sum() <= 450 and not e[55:75, 45:65].any()
    s = K.shape_features(square())
    assert len(s) == 64 and np.isclose(np.hypot(s[0], s[32]), 1) and not K.shape_features(flat(3)).any()
    assert len(K.combined_features(square())) == 182


def test_entropy_and_motion():
    assert K.colour_entropy(flat(120)) < 1e-6 < 1 < K.colour_entropy(ramp()) and K.is_uniform(flat(120)) and not K.is_uniform(CHECKER)
    assert K.motion_between(flat(10), flat(30)) == 20 and K.edge_density(flat(1)) == 0


def _frames(spark, arrays):
    rows = [(1, i, float(i), ("", a.shape[0], a.shape[1], 3, 16, bytearray(a.tobytes()))) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "video_id long, frame_index long, ts double, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")


def test_frame_columns(spark):
    f = _frames(spark, [flat(10), CHECKER, ramp()])
    got = K.frame_metrics(f).orderBy("frame_index").collect()
    assert [r.brightness for r in got][0] == 10 and got[1].sharpness == 1020.0**2 and got[0].uniform and "image" not in got[0].asDict()
    assert len(f.select(K.features_of(F.col("image")).alias("x")).first().x) == 182


def test_redundancy_compares_with_the_last_kept(spark):
    a, b = flat(10), ramp()
    got = K.redundancy_filter(_frames(spark, [a, a, b, a, a])).orderBy("frame_index").collect()
    assert [r.frame_index for r in got] == [0, 2, 3] and got[0].diff_score == 0
    drift = [flat(v) for v in range(0, 100, 10)]
    kept = K.redundancy_filter(_frames(spark, drift), 0.9, "pixel").orderBy("frame_index").collect()
    assert [r.frame_index for r in kept] == [0, 3, 6, 9]  # each step is small, three together are not
    assert K.redundancy_filter(_frames(spark, [a, b]), 0.75, "combined").count() == 2


def test_image_source_reads_what_is_encoded(spark, tmp_path):
    folder = tmp_path / "video_id=7"
    folder.mkdir()
    for i, a in enumerate((flat(10), square())):
        (folder / f"frame_{i}.png").write_bytes(files.png(a))
    got = files.image_frames(spark, str(tmp_path / "*"), 2.0).orderBy("frame_index").collect()
    assert [(r.video_id, r.frame_index, r.ts) for r in got] == [(7, 0, 0.0), (7, 1, 0.5)]
    assert (K.to_array(got[1].image) == square()).all()


def test_keyframes_storyboard_and_zip(spark):
    f = _frames(spark, [flat(10), square(), ramp()]).where("frame_index <> 1").withColumnRenamed("video_id", "job_id")
    got = files.encoded_keyframes(f).orderBy("index").collect()
    assert [r["name"] for r in got] == ["keyframe_001.png", "keyframe_002.png"]
    (board,) = files.storyboards(f).collect()
    assert struct.unpack(">II", bytes(board.content)[16:24]) == (10 + 4 * 70, 10 + 50)  # four columns, however few frames
    z = zipfile.ZipFile(BytesIO(files.export_zip([(r["name"], bytes(r.content)) for r in got])))
    assert z.namelist() == ["keyframe_001.png", "keyframe_002.png"]


def test_storyboard_has_numbers_bars_and_times():
    b = files.board([np.full((90, 160, 3), 200, np.uint8)] * 5, [0.0, 61.0, 2.0, 3.0, 3600.0])
    assert b.shape == (10 + 2 * 100, 10 + 4 * 170, 3) and (b[:10] == 30).all() and (b[110:, 180:] == 30).all()
    thumb = b[10:100, 10:170]
    assert (thumb[60:68] == 0).all() and (thumb[40:60] == 200).all()
    five, three = (np.zeros((20, 20, 3), np.uint8) for _ in range(2))
    files.write_text(five, "5", 0, 0, 1)
    assert (five[:5, :3, 0] // 255).tolist() == [[1, 1, 1], [1, 0, 0], [1, 1, 1], [0, 0, 1], [1, 1, 1]]
    files.write_text(three, "61:00", 0, 0, 1)  # goes on beyond the edge
    assert three.any()


def test_export_needs_a_completed_job(spark):
    jobs = spark.createDataFrame([(1, "completed", "a/b/clip.mp4"), (2, "clustering", "x.mp4")], "id long, status string, filename string")
    names = ["keyframe_1000.png", "keyframe_001.png", "storyboard.png", "storyboard.jpg", "notes.txt"]
    listed = spark.createDataFrame([(1, n, bytearray(n.encode())) for n in names], "job_id long, name string, content binary")
    code, name, content = files.export_job(jobs, listed, 1)
    assert (code, name) == (200, "clip_keyframes.zip")
    assert zipfile.ZipFile(BytesIO(content)).namelist() == ["keyframe_001.png", "keyframe_1000.png", "storyboard.jpg"]
    assert files.export_job(jobs, listed, 2) == (400, None, None) and files.export_job(jobs, listed, 3) == (404, None, None)
    assert files.extractor_info(spark).first().feature_dim == 182


def test_contour_keeps_corners_only():
    assert sorted(K.corners([(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)])) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert K.corners([(3, 3)]) == [(3, 3)]


def test_shape_of_a_rectangle_is_that_of_its_corners(monkeypatch):
    mask = np.zeros((128, 128), bool)
    mask[20:61, 30:101] = True
    monkeypatch.setattr(K, "canny", lambda *_: mask)
    corners = np.array([30 + 20j, 30 + 60j, 100 + 60j, 100 + 20j])  # down first
    f = np.fft.fft(corners) / abs(corners.sum())
    s = K.shape_features(flat(0))
    assert np.allclose(s[:4], f.real) and np.allclose(s[32:36], f.imag) and not s[4:32].any()


def test_fallback_features(spark):
    x = K.fallback_features(square())
    assert len(x) == 256 and np.allclose([np.linalg.norm(x[i : i + 64]) for i in range(0, 256, 64)], 1)
    assert x[192] > 0.9 and x[255] > 0 and not x[193:255].any()  # edges are there or not
    got = _frames(spark, [flat(10), square()]).orderBy("frame_index").select(K.fallback_features_of(F.col("image")).alias("f")).collect()
    assert np.allclose(got[1].f, x) and got[0].f[192] == 1


def test_motion_context_takes_the_neighbours_there_are(spark):
    values = [10, 30, 30, 90]
    rows = K.motion_context(K.frame_metrics(_frames(spark, [flat(v) for v in values]))).orderBy("frame_index").collect()
    assert [r.motion for r in rows] == [20.0, 10.0, 30.0, 60.0] and "small" not in rows[0].asDict()


def _noisy(v, seed):
    """A sharp picture around a grey level."""
    return np.clip(np.random.default_rng(seed).normal(v, 40, (60, 80, 3)), 0, 255).astype(np.uint8)


def test_filter_skips_intro_dark_and_blurred_frames(spark):
    f = _frames(spark, [_noisy(120, 0), flat(120), _noisy(5, 1) // 8, _noisy(120, 2), _noisy(60, 3)])
    got = K.redundancy_filter(f, 0.99, "histogram", blur=30.0, dark=25.0, skip=1.0).orderBy("frame_index").collect()
    assert [r.frame_index for r in got] == [3, 4] and got[0].diff_score == 0.0


def test_adaptive_similarity_matches_rounds_of_the_filter(spark):
    f = _frames(spark, [_noisy(40 + 11 * (i % 13), i) for i in range(30)])
    for least, most in ((3, 5), (1, 40), (25, 29)):
        threshold, n = 0.95, None
        for _ in range(10):
            used, n = threshold, K.redundancy_filter(f, threshold, "combined", blur=50.0, dark=25.0).count()
            if least <= n <= most:
                break
            threshold = round(max(0.5, min(0.99, threshold + (0.02 if n < least else -0.02))), 6)
        (got,) = K.adaptive_similarity(f, least, most).collect()
        assert (got.threshold, got.kept) == (used, n)


def test_images_to_summary(spark, tmp_path):
    """PNG files to a summary: three shots of twelve frames each, and an intro."""
    from reelspark.config import Settings
    from reelspark.plans import summary

    folder = tmp_path / "video_id=3"
    folder.mkdir()
    for i in range(36):
        a = _noisy(60 + 60 * (i // 12), i)
        a[:, : 20 + 2 * (i % 12), i // 12] = 255
        (folder / f"frame_{i}.png").write_bytes(files.png(a))
    frames = files.image_frames(spark, str(tmp_path / "*"), 2.0)
    settings = Settings(similarity=0.999, skip_intro=1.0)
    found = summary.from_images(frames, settings, inits=2).cache()
    rows = found.collect()
    assert sorted(r.frame_index for r in rows) == list(range(2, 36)) and all(abs(np.linalg.norm(r.features) - 1) < 1e-9 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.cluster_id, []).append(r.frame_index // 12)
    assert sum(max(map(shots.count, shots)) for shots in by.values()) >= 0.7 * len(rows)  # clusters follow the shots
    cut = max((r for r in rows if r.frame_index in (12, 24)), key=lambda r: r.motion)
    assert cut.motion > np.median([r.motion for r in rows])
    (s,) = summary.summarize(found, settings).collect()
    assert s.num_keyframes == len(s.keyframes) > 0 and {k.frame_index // 12 for k in s.keyframes} == {0, 1, 2}


def test_worker_takes_one_job_file_at_a_time(spark, tmp_path):
    import time

    from reelspark.operators.jobs import latest_state
    from reelspark.streaming.queries import poll_jobs, with_failures

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(3):
        (inbox / f"{i}.json").write_text(json.dumps({"id": i}))
    taken = []

    def work(df, n):
        taken.append([r.id for r in df.collect()])
        if taken[-1] == [1]:
            raise ValueError("no such video")

    worker = poll_jobs(spark, f"file://{inbox}", f"file://{tmp_path}/work", "id long", with_failures(work, f"file://{tmp_path}/log"), "200 milliseconds")
    for _ in range(150):
        if len(taken) >= 3 and not worker.status["isTriggerActive"]:
            break
        time.sleep(0.2)
    worker.stop()
    (state,) = latest_state(spark.read.parquet(f"file://{tmp_path}/log")).collect()
    assert (state.job_id, state.status, state.error) == (1, "failed", "no such video")
    assert sorted(map(tuple, taken)) == [(0,), (1,), (2,)]


def test_summaries_of_all_generations(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"job_id": 1, "num_clusters": 2, "keyframes": [{"index": 1, "timestamp": 3.5}]}, indent=2))
    (tmp_path / "2.json").write_text(json.dumps({"job_id": 2, "num_clusters": 1, "grid_path": "g.png", "importance_weights": {"dominance": 0.15}, "keyframes": [], "unknown": {"x": 1}}))
    (tmp_path / "3.json").write_text('{"job_id": 3, "keyframes": [')
    got = files.summaries(spark, str(tmp_path))
    assert got.count() == 3 and got.cache().where("_corrupt_record is not null").count() == 1
    view = {r.job_id: r for r in files.summary_view(got).collect()}
    assert set(view) == {1, 2} and not view[1].has_grid and view[2].has_grid and view[1].keyframes[0].timestamp == 3.5


def test_store_grows_columns(spark, tmp_path):
    spark.createDataFrame([(1, 5, "old")], "id long, job_id long, stage string").write.parquet(f"{tmp_path}/logs")
    files.append(spark.createDataFrame([(2, 5, "new", "hello")], "id long, job_id long, stage string, message string"), f"{tmp_path}/logs", schemas.LOGS)
    got = files.load(spark, f"{tmp_path}/logs", schemas.LOGS).orderBy("id").collect()
    assert [(r.stage, r.message) for r in got] == [("old", None), ("new", "hello")]
    files.write_summaries(spark.createDataFrame([(1, "a")], "job_id long, video_filename string"), f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").first().job_id == 1


def test_ingest_and_uploads(spark, tmp_path):
    header = b"RIFF\0\0\0\0AVI LIST\0\0\0\0hdrlavih" + struct.pack("<I", 56) + struct.pack("<10I", 40000, 0, 0, 0, 50, 0, 1, 0, 320, 240) + b"\0" * 16 + b"strlstrh\0\0\0\0vidsMJPG"
    (tmp_path / "a.avi").write_bytes(header)
    (tmp_path / "b.AVI").write_bytes(header.replace(struct.pack("<I", 50), struct.pack("<I", 0), 1))
    (tmp_path / "c.txt").write_bytes(b"text")
    got = {r.filename: r for r in files.ingest(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    a = got["a.avi"]
    assert (a.fps, a.total_frames, a.width, a.height, a.codec, a.duration, a.error) == (25.0, 50, 320, 240, "MJPG", 2.0, None)
    assert got["b.AVI"].error == "no frames" and got["c.txt"].error == "cannot be opened"
    assert {r.path.rsplit("/", 1)[1]: r.rejection for r in files.uploads(spark, str(tmp_path)).collect()} == {"a.avi": None, "b.AVI": None, "c.txt": "extension"}
    assert spark.range(1).select(files.job_folder("/s", F.lit(4), "summary").alias("x")).first().x == "/s/jobs/4/summary"


def _box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def _mp4(frames=50, scale=600, length=1200, handler=b"vide"):
    track = _box(
        b"trak", _box(b"tkhd", bytes(76) + struct.pack(">II", 640 << 16, 360 << 16)),
        _box(b"mdia", _box(b"mdhd", bytes(12) + struct.pack(">II", scale, length) + bytes(4)), _box(b"hdlr", bytes(8) + handler + bytes(13)), _box(b"minf", _box(b"stbl", _box(b"stsd", bytes(4) + struct.pack(">I", 1) + struct.pack(">I", 86) + b"avc1"), _box(b"stsz", bytes(8) + struct.pack(">I", frames))))),
    )
    return _box(b"ftyp", b"isom") + _box(b"mdat", bytes(30)) + _box(b"moov", _box(b"mvhd", bytes(20)), _box(b"trak", _box(b"mdia", _box(b"hdlr", bytes(8) + b"soun"))), track)


def test_ingest_reads_mp4_headers(spark):
    rows = [("a/one.mp4", _mp4()), ("a/two.mp4", _mp4(frames=0)), ("a/three.mp4", _mp4(handler=b"soun")), ("a/four.mp4", _mp4()[:100]), ("a/five.mp4", b"")]
    df = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], "path string, length long, content binary")
    got = {r.filename: r for r in files.ingest(df).collect()}
    one = got["one.mp4"]
    assert (one.fps, one.total_frames, one.width, one.height, one.codec, one.duration, one.error) == (25.0, 50, 640, 360, "avc1", 2.0, None)
    assert got["two.mp4"].error == "no frames" and {got[f"{n}.mp4"].error for n in ("three", "four", "five")} == {"cannot be opened"}


def test_zero_shot_labels(spark):
    from reelspark.operators import scoring

    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 2.0])], "video_id long, frame_index long, features array<double>")
    labels = spark.createDataFrame([("sea", [0.0, 1.0]), ("forest", [1.0, 0.0])], "label string, vector array<double>")
    assert {r.frame_index: r.label for r in scoring.zero_shot(df, labels).collect()} == {0: "forest", 1: "sea"}
    assert {(r.label, r.score) for r in scoring.zero_shot(df).collect()} == {("Visual Scene", 0.5)}


def test_kernels_of_stacks_are_those_of_their_frames(spark):
    """Frames of several sizes and channels in one column, each as if it were alone."""
    rng = np.random.default_rng(4)
    shapes = [(4, 5, 3), (30, 40, 3), (4, 5, 4), (1, 1, 3)]
    pictures = [rng.integers(0, 256, shapes[i % 4], dtype=np.uint8) if i % 5 else np.full(shapes[i % 4], 4 * i, np.uint8) for i in range(60)]
    fields = pd.DataFrame([(*x.shape, x.tobytes()) for x in pictures], columns=["height", "width", "nChannels", "data"])
    for make in (K.brightness, K.blur_score, K.bgr_histogram, K.colour_features, K.scene_histogram, K.colour_entropy, K.is_uniform):
        assert np.allclose(K.of_stacks(fields, make), [make(x[..., :3]) for x in pictures], atol=1e-9)
    x = K.hsv(pictures[1])
    assert (K.histogram(x[..., 0], 32, 180) == np.histogram(x[..., 0], 32, (0, 180))[0]).all() and (K.histogram(x[..., 1], 30, 256) == np.histogram(x[..., 1], 30, (0, 256))[0]).all()
    calls = []
    K.of_stacks(fields, lambda x: calls.append(len(x)) or K.brightness(x))
    assert sorted(calls) == [15] * 4  # a call for each size, not for each frame


def test_only_the_asked_metrics_are_made(spark):
    frames = _frames(spark, [flat(10), CHECKER, flat(200)])
    whole = K.frame_metrics(frames).orderBy("frame_index").collect()
    some = K.frame_metrics(frames, metrics=("brightness", "sharpness")).orderBy("frame_index")
    assert some.columns == [*[c for c in frames.columns if c != "image"], "brightness", "sharpness"]
    assert [(r.brightness, r.sharpness) for r in some.collect()] == [(r.brightness, r.sharpness) for r in whole]
    assert K.frame_metrics(frames.limit(0)).count() == 0
