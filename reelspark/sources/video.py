"""AVI files as tables of frames: a data source that reads frames by their place in the file's index, and its sink.

A large file is cut into ranges of the frames that are asked for, each a partition of its own; small files share one. A
partition reads a file's header and index and then its frames, neighbours in one request. The driver lists files and opens
none. Filters on video and frame are taken by the reader, so a frame that isn't asked for isn't read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

FORMAT = "avi_frames"
SCHEMA = "video_id long, path string, frame_index long, ts double, codec string, height int, width int, bottom_up boolean, content binary"
#: Bytes of files for each partition, a file's opening taken as OPEN_BYTES; bytes of one request for neighbouring frames.
RANGE_BYTES, OPEN_BYTES, REQUEST_BYTES = 64 << 20, 1 << 20, 8 << 20
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
#: Spark's mark of three bytes a pixel, blue first.
BGR_MODE = 16


@dataclass
class Clip:
    """What an AVI file says of its video stream, and where its frames lie: offsets of their bytes, sizes."""

    fps: float
    width: int
    height: int
    bottom_up: bool
    codec: str
    offset: np.ndarray
    size: np.ndarray


def _chunks(f, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, size) of the chunks between two places of a file; of a list, its kind and where its content begins."""
    while at + 8 <= end:
        head = f.read_at(12, at)
        if len(head) < 8:
            return
        kind, size = head[:4], struct.unpack_from("<I", head, 4)[0]
        if kind in (b"LIST", b"RIFF"):
            yield head[8:12], at + 12, size - 4
        else:
            yield kind, at + 8, size
        at += 8 + size + (size & 1)


def _video_stream(header: bytes) -> tuple[int, float, int, int, bool, str]:
    """(number of the stream, fps, width, height, bottom_up, codec) of the first video stream in a header list."""
    at, number = 0, -1
    micros = struct.unpack_from("<I", header, header.index(b"avih") + 8)[0]
    while (at := header.find(b"strh", at)) >= 0:
        number += 1
        kind, at = header[at + 8 : at + 12], at + 8
        if kind != b"vids":
            continue
        scale, rate = struct.unpack_from("<II", header, at + 20)
        form = header.index(b"strf", at) + 8
        width, height, _, bits, code = struct.unpack_from("<iiHHI", header, form + 4)
        codec = "BGR" if code == 0 and bits == 24 else struct.pack("<I", code).decode("latin-1") if code else f"RGB{bits}"
        fps = rate / scale if rate and scale else 1e6 / micros if micros else 0.0
        return number, fps, width, abs(height), height > 0, codec
    raise ValueError("no video stream")


def read_clip(f) -> Clip:
    """Reads the header and the index of an AVI file that is open for random access; without an index, the chunks are walked."""
    end = f.size()
    if f.read_at(4, 0) != b"RIFF" or f.read_at(4, 8) != b"AVI ":
        raise ValueError("not an AVI file")
    header = movie = index = None
    for kind, at, size in _chunks(f, 12, end):
        if kind == b"hdrl":
            header = f.read_at(size, at)
        elif kind == b"movi":
            movie = at, min(size, end - at)
        elif kind == b"idx1":
            index = f.read_at(size, at)
    if header is None or movie is None:
        raise ValueError("no header or no frames")
    try:
        number, fps, width, height, bottom_up, codec = _video_stream(header)
    except struct.error as e:
        raise ValueError("broken header") from e
    names = [f"{number:02d}{kind}".encode() for kind in ("db", "dc")]
    if index:
        entries = np.frombuffer(index[: len(index) // 16 * 16], [("kind", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")])
        entries = entries[np.isin(entries["kind"], names)]
        # offsets count from the list's kind, or from the begin of the file in some writers' files
        base = movie[0] - 4 if len(entries) and f.read_at(4, movie[0] - 4 + int(entries["offset"][0])) == entries["kind"][0] else 0
        offset, size = entries["offset"].astype(np.int64) + base + 8, entries["size"].astype(np.int64)
    else:
        found = [(at, n) for at, n in _walk(f, movie[0], movie[0] + movie[1], names)]
        offset, size = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
    whole = offset + size <= end  # frames that a cut file has lost are no frames
    return Clip(fps, width, height, bottom_up, codec, offset[whole], size[whole])


def _walk(f, at: int, end: int, names: list[bytes]) -> Iterator[tuple[int, int]]:
    for kind, start, size in _chunks(f, at, end):
        if kind in names:
            yield start, size
        elif kind == b"rec ":
            yield from _walk(f, start, start + size, names)


@dataclass
class Asked:
    """Which frames are asked for: a range, a list if not None, and a step; and which videos, those with a number if ``numbered``."""

    low: int = 0
    high: int | None = None
    frames: list[int] | None = None
    videos: list[int] | None = None
    numbered: bool = False
    step: int = 1

    def take(self, f: Filter) -> bool:
        """Narrows what is asked for by a filter, if it is one on video or frame."""
        name, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if isinstance(f, IsNotNull):
            self.numbered |= name == ("video_id",)
            return len(name) == 1  # nothing else is ever null
        if name == ("frame_index",):
            if isinstance(f, EqualTo) or isinstance(f, In):
                some = [f.value] if isinstance(f, EqualTo) else list(value)
                self.frames = sorted({x for x in some if x is not None} & set(self.frames if self.frames is not None else some))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                top = value + isinstance(f, LessThanOrEqual)
                self.high = top if self.high is None else min(self.high, top)
            else:
                return False
            return True
        if name == ("video_id",) and isinstance(f, (EqualTo, In)):
            some = [f.value] if isinstance(f, EqualTo) else list(value)
            self.videos = [x for x in some if x is not None and (self.videos is None or x in self.videos)]
            return True
        return False

    def wants(self, video: int | None) -> bool:
        return (video is not None or not self.numbered) and (self.videos is None or video in self.videos)

    def of(self, n: int) -> np.ndarray:
        """The asked frames of a video of n frames, ascending."""
        high = n if self.high is None else max(0, min(n, self.high))
        low = max(0, self.low)
        if self.frames is not None:
            some = np.array([x for x in self.frames if low <= x < high], np.int64)
            return some[some % self.step == 0]
        first = -(-low // self.step) * self.step
        return np.arange(first, high, self.step, dtype=np.int64)


@dataclass
class FrameRange:
    """Part ``part`` of ``parts`` of a file's asked frames."""

    path: str
    video_id: int | None
    part: int = 0
    parts: int = 1


class FrameRanges(InputPartition):
    """What one task reads."""

    def __init__(self, ranges: list[FrameRange]):
        self.ranges = ranges


def video_of(path: str) -> int | None:
    """The number in video_id=N of a path."""
    found = re.search(r"video_id=(\d+)", path)
    return int(found[1]) if found else None


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the AVI files under a folder of any file system that Arrow knows, or of one file."""
    system, at = located(folder)
    prefix = folder[: len(folder) - len(at)] if folder.endswith(at) else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.lower().endswith(".avi"))


class AviFrames(DataSource):
    """Options: path (a folder or file), every (a stride over all frames), rangeBytes, mode (permissive: files that can't be read give no rows)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return AviReader(dict(self.options))


class AviReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.asked = Asked(step=max(1, int(options.get("every", 1))))
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.asked.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        out, small, total = [], [], 0
        for path, size in listed(self.folder):
            video = video_of(path)
            if not self.asked.wants(video):
                continue
            parts = max(1, -(-size // self.range_bytes))
            if self.asked.frames is not None:
                parts = max(1, min(parts, len(self.asked.frames)))
            if parts > 1:
                out += [FrameRanges([FrameRange(path, video, k, parts)]) for k in range(parts)]
                continue
            if small and total + size > self.range_bytes:
                out, small, total = [*out, FrameRanges(small)], [], 0
            small.append(FrameRange(path, video))
            total += size + OPEN_BYTES
        return [*out, FrameRanges(small)] if small or not out else out

    def read(self, partition: FrameRanges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            system, at = located(one.path)
            with system.open_input_file(at) as f:
                try:
                    clip = read_clip(f)
                except ValueError as e:
                    if self.permissive:
                        continue
                    raise ValueError(f"{one.path}: {e}") from e
                frames = self.asked.of(len(clip.offset))
                a, b = (len(frames) * k // one.parts for k in (one.part, one.part + 1))
                yield from _batches(one, clip, _contents(f, clip, frames[a:b]))


def _contents(f, clip: Clip, frames: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(frame, bytes); frames that lie side by side come with one request."""
    start, end, k = clip.offset[frames], clip.offset[frames] + clip.size[frames], 0
    while k < len(frames):
        last = k
        while last + 1 < len(frames) and 0 <= start[last + 1] - end[last] <= 64 and end[last + 1] - start[k] <= REQUEST_BYTES:
            last += 1
        block = f.read_at(int(end[last] - start[k]), int(start[k]))
        for i in range(k, last + 1):
            yield int(frames[i]), block[int(start[i] - start[k]) : int(end[i] - start[k])]
        k = last + 1


def _batches(of: FrameRange, clip: Clip, contents: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    index, data, total = [], [], 0

    def made() -> pa.RecordBatch:
        n = len(index)
        ts = [i / clip.fps if clip.fps > 0 else 0.0 for i in index]
        same = lambda value, kind: pa.array([value] * n, kind)
        return pa.RecordBatch.from_arrays(
            [same(of.video_id, pa.int64()), same(of.path, pa.string()), pa.array(index, pa.int64()), pa.array(ts, pa.float64()), same(clip.codec, pa.string()), same(clip.height, pa.int32()), same(clip.width, pa.int32()), same(clip.bottom_up, pa.bool_()), pa.array(data, pa.binary())],
            names=["video_id", "path", "frame_index", "ts", "codec", "height", "width", "bottom_up", "content"],
        )

    for i, content in contents:
        index.append(i)
        data.append(content)
        total += len(content)
        if len(index) >= BATCH_ROWS or total >= BATCH_BYTES:
            yield made()
            index, data, total = [], [], 0
    if index:
        yield made()


def bgr_rows(content: bytes, height: int, width: int, bottom_up: bool) -> bytes:
    """The pixels of an uncompressed frame, top row first, without the padding of rows to four bytes."""
    wide = (3 * width + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, wide * height).reshape(height, wide)[:, : 3 * width]
    return rows[::-1].tobytes() if bottom_up else rows.tobytes()


def as_image(origin: Column, codec: Column, height: Column, width: Column, bottom_up: Column, content: Column, decoder: Callable[[bytes], np.ndarray] | None = None) -> Column:
    """Spark's image struct of a frame; null for a compressed one without ``decoder`` (bytes to a BGR array), or one it can't decode."""

    @F.pandas_udf(IMAGE)
    def made(origin: pd.Series, codec: pd.Series, height: pd.Series, width: pd.Series, bottom_up: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for o, c, h, w, up, raw in zip(origin, codec, height, width, bottom_up, content, strict=True):
            try:
                if c == "BGR":
                    rows.append((o, h, w, 3, BGR_MODE, bgr_rows(raw, h, w, up)))
                elif decoder is not None:
                    x = np.ascontiguousarray(decoder(bytes(raw)), np.uint8)
                    rows.append((o, x.shape[0], x.shape[1], 3, BGR_MODE, x.tobytes()))
                else:
                    rows.append(None)
            except ValueError:
                rows.append(None)
        names = ["origin", "height", "width", "nChannels", "mode", "data"]
        return pd.DataFrame([r or (None,) * 6 for r in rows], columns=names).astype({"height": "Int32", "width": "Int32", "nChannels": "Int32", "mode": "Int32"})

    image = made(origin, codec, height, width, bottom_up, content)
    return F.when(image["data"].isNotNull(), image)


def video_chunks(spark: SparkSession, folder: str, every: int = 1, range_bytes: int = RANGE_BYTES, permissive: bool = False) -> DataFrame:
    """The frames of a folder's AVI files as they are stored (SCHEMA), every ``every``-th of each file by its index from 0.

    Filters on video_id and frame_index that follow are pushed into the reader; the session's switch for that is set. A file
    that can't be read fails the query unless ``permissive``; frames that a cut file has lost are left out.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AviFrames)
    return spark.read.format(FORMAT).option("every", every).option("rangeBytes", range_bytes).option("mode", "permissive" if permissive else "failfast").load(folder)


def video_frames(chunks: DataFrame, decoder: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """(video_id, frame_index, ts, image) of video_chunks, as image_frames gives them; frames that nothing decodes are left out."""
    image = as_image(*(F.col(c) for c in ("path", "codec", "height", "width", "bottom_up", "content")), decoder)
    return chunks.select("video_id", "frame_index", "ts", image.alias("image")).where(F.col("image").isNotNull())


#: Bytes from a file's beginning in which an AVI header lies.
HEAD_BYTES = 64 << 10


def _head(f: pa.NativeFile, size: int) -> bytes:
    """What ingest needs of an open file: the first HEAD_BYTES of an AVI file whose header they hold, else all of it."""
    content = f.read_at(min(size, HEAD_BYTES), 0)
    if size > HEAD_BYTES and not (content[:4] == b"RIFF" and b"avih" in content and b"vids" in content):
        content = f.read_at(size, 0)
    return content


def heads(files: DataFrame) -> DataFrame:
    """(path, length, content) of the files that ``files`` has the paths of, as ingest takes them; of an AVI file whose header they hold, the first HEAD_BYTES.

    Files are opened where their rows are; nothing is listed.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(path: str) -> tuple[str, int, bytes]:
            system, at = located(path)
            with system.open_input_file(at) as f:
                size = f.size()
                return path, size, _head(f, size)

        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                rows = [read(x) for x in batch.column(0).slice(a, BATCH_ROWS).to_pylist()]
                paths, sizes, contents = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary())], names=["path", "length", "content"])

    return files.select("path").mapInArrow(work, "path string, length long, content binary")


#: Bytes of a file that its digest takes at once.
DIGEST_BYTES = 1 << 20


def read_by_path(files: DataFrame, most_bytes: int) -> DataFrame:
    """(path, modificationTime, length, content, digest) of files by (path, wanted), of a batch or a stream; content as in ``heads``, digest the SHA-256 of all of it.

    Files are looked up and opened where their rows are; nothing is listed. Those that aren't wanted or have more than ``most_bytes``
    aren't opened, and those that are gone have no length either.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(path: str, wanted: bool) -> tuple[str, int | None, int | None, bytes | None, str | None]:
            system, at = located(path)
            info = system.get_file_info(at)
            if info.type != fs.FileType.File:
                return path, None, None, None, None
            known = path, None if info.mtime_ns is None else info.mtime_ns // 1000, info.size
            if not wanted or info.size > most_bytes:
                return *known, None, None
            with system.open_input_file(at) as f:
                content, digest = _head(f, info.size), hashlib.sha256()
                if len(content) == info.size:
                    digest.update(content)
                else:
                    f.seek(0)
                    while part := f.read(DIGEST_BYTES):
                        digest.update(part)
            return *known, content, digest.hexdigest()

        def rows(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=["path", "modificationTime", "length", "content", "digest"])

        kinds = (pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary(), pa.string())
        for batch in batches:
            held, total = [], 0
            for path, wanted in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                held.append(read(path, wanted))
                total += len(held[-1][3] or b"")
                if len(held) >= BATCH_ROWS or total >= BATCH_BYTES:
                    yield rows(held)
                    held, total = [], 0
            if held:
                yield rows(held)

    return files.select("path", "wanted").mapInArrow(work, "path string, modificationTime timestamp, length long, content binary, digest string")


# --- sink -----------------------------------------------------------------------------------------------------------


@dataclass
class _Writer:
    """An uncompressed AVI file whose number of frames is known, written front to back."""

    out: object
    n: int
    height: int
    width: int
    fps: float
    done: int = 0

    def __post_init__(self) -> None:
        self.row = (3 * self.width + 3) // 4 * 4
        size = self.row * self.height
        rate = (int(round(self.fps * 1000)), 1000)
        form = struct.pack("<IiiHHIIiiII", 40, self.width, self.height, 1, 24, 0, size, 0, 0, 0, 0)
        stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"DIB ", 0, 0, 0, 0, rate[1], rate[0], 0, self.n, size, 0, 0, 0, 0, self.width, self.height)
        main = struct.pack("<14I", int(round(1e6 / self.fps)), 0, 0, 16, self.n, 0, 1, size, self.width, self.height, 0, 0, 0, 0)
        part = lambda kind, data: kind + struct.pack("<I", len(data)) + data
        group = lambda kind, data: part(b"LIST", kind + data)
        header = group(b"hdrl", part(b"avih", main) + group(b"strl", part(b"strh", stream) + part(b"strf", form)))
        movie = 4 + self.n * (8 + size)
        self.out.write(b"RIFF" + struct.pack("<I", 4 + len(header) + 8 + movie + 8 + 16 * self.n) + b"AVI " + header + b"LIST" + struct.pack("<I", movie) + b"movi")

    def add(self, frames: list[bytes]) -> None:
        """Frames of three bytes a pixel, some at a time; all of one batch are one request if they are small."""
        size, step = self.row * self.height, max(1, REQUEST_BYTES // (8 + self.row * self.height))
        for at in range(0, len(frames), step):
            some = frames[at : at + step]
            chunks = np.zeros((len(some), 8 + size), np.uint8)
            chunks[:, :8] = np.frombuffer(b"00db" + struct.pack("<I", size), np.uint8)
            bgr = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), self.height, 3 * self.width)
            chunks[:, 8:].reshape(len(some), self.height, self.row)[:, :, : 3 * self.width] = bgr[:, ::-1]
            self.out.write(chunks.tobytes())
        self.done += len(frames)

    def close(self) -> None:
        if self.done != self.n:
            raise ValueError(f"{self.done} frames of {self.n}")
        size = self.row * self.height
        index = np.empty((self.n, 4), "<u4")
        index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00db", "little"), 16, size
        index[:, 2] = 4 + np.arange(self.n) * (8 + size)
        self.out.write(b"idx1" + struct.pack("<I", 16 * self.n) + index.tobytes())


def write_videos(frames: DataFrame, folder: str, fps: float) -> DataFrame:
    """Writes frames (video_id, ts, frame_index, image of 3 channels) as folder/video_id=N/clip.avi, a file for each video, in the order of time.

    (video_id, path, frames) of what was written. A video's frames come sorted, a batch at a time; they must be of one size. A
    file is written under a name of its own and moved to its place when it is complete, so a task that runs again does no harm.
    Null ids are left out.
    """
    counted = frames.where(F.col("video_id").isNotNull()).select("video_id", "ts", "frame_index", "image", F.count("*").over(W.partitionBy("video_id")).alias("n"))
    ordered = counted.repartition("video_id").sortWithinPartitions("video_id", "ts", "frame_index")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, root = located(folder)
        video = writer = None
        name = f"{uuid.uuid4().hex}.part"

        def done() -> tuple[int, str, int]:
            writer.close()
            writer.out.close()
            place = f"{root}/video_id={video}/clip.avi"
            system.move(f"{root}/video_id={video}/{name}", place)
            return video, folder[: len(folder) - len(root)] + place, writer.done

        def rows(written: list[tuple[int, str, int]]) -> pa.RecordBatch:
            ids, paths, sizes = zip(*written, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths), pa.array(sizes, pa.int64())], names=["video_id", "path", "frames"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, written, image = np.asarray(batch.column("video_id")), [], batch.column("image")
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                if int(ids[a]) != video:
                    if writer is not None:
                        written.append(done())
                    video = int(ids[a])
                    system.create_dir(f"{root}/video_id={video}", recursive=True)
                    n, height, width = batch.column("n")[a].as_py(), image.field("height")[a].as_py(), image.field("width")[a].as_py()
                    writer = _Writer(system.open_output_stream(f"{root}/video_id={video}/{name}"), n, height, width, fps)
                frames = image.field("data").slice(a, b - a).to_pylist()
                if any(len(x) != writer.height * writer.width * 3 for x in frames):
                    raise ValueError(f"video {video}: frames of several sizes")
                writer.add(frames)
            if written:
                yield rows(written)
        if writer is not None:
            yield rows([done()])

    return ordered.mapInArrow(work, "video_id long, path string, frames long")
