"""Audio files as blocks of samples, and tracks as WAV files. WAV is built in; decoders of other formats are registered, and tried in order."""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BLOCK_SEC = 60.0
Decoder = Callable[[bytes], tuple[np.ndarray, int]]
#: Decoders by extension, in the order in which they are tried: bytes to (samples, channels) float array and sample rate.
DECODERS: dict[str, list[Decoder]] = {}
#: Tried after those, whatever the extension.
FALLBACKS: list[Decoder] = []
BLOCKS = "rec long, path string, sr int, channels int, channel int, block_no long, start_sample long, samples array<float>"


def wav_header(f, length: int) -> tuple[int, int, int, int, int]:
    """(sample rate, channels, bytes of a sample, place of the data, bytes of it) of a RIFF or RF64 stream of PCM; data that the file is too short for do not count."""
    kind, _, wave = struct.unpack("<4sI4s", f.read(12).ljust(12))
    if kind not in (b"RIFF", b"RF64") or wave != b"WAVE":
        raise ValueError("not a WAV file")
    found, long, at = None, None, 12
    while True:
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            raise ValueError("no samples in the WAV file")
        name, size = struct.unpack("<4sI", head)
        if name == b"ds64":
            long = struct.unpack("<QQ", f.read(16))[1]
        elif name == b"fmt ":
            body = f.read(size)
            tag, channels, sr, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            tag = struct.unpack("<H", body[24:26])[0] if tag == 0xFFFE and size >= 26 else tag
            if tag != 1 or bits not in (8, 16, 24, 32) or not channels:
                raise ValueError(f"WAV format {tag} with {bits}-bit samples is not supported")
            found = sr, channels, bits // 8
        elif name == b"data":
            if found is None:
                raise ValueError("WAV samples before their format")
            size = long if long is not None and size == 0xFFFFFFFF else size
            return (*found, at + 8, max(0, min(size, length - at - 8)))
        at += 8 + size + size % 2


def pcm(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Whole frames of PCM as float32 in [-1, 1], a column for each channel."""
    raw = raw[: len(raw) - len(raw) % (width * channels)]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000).astype(np.float32) / 8388608
    else:
        x = (np.frombuffer(raw, "<i4").astype(np.float64) / 2147483648).astype(np.float32)
    return x.reshape(-1, channels)


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """PCM of 8, 16, 24 or 32 bits."""
    sr, channels, width, at, size = wav_header(io.BytesIO(data), len(data))
    return pcm(data[at : at + size], width, channels), sr


FALLBACKS.append(decode_wav)


def decode(path: str, data: bytes, decoders: list[Decoder]) -> tuple[np.ndarray, int]:
    """By the first of the decoders that can; where all fail, an error with the last cause."""
    cause: Exception | None = None
    for f in decoders:
        try:
            x, sr = f(data)
            return (x if x.ndim == 2 else x[:, None]), sr
        except Exception as e:
            cause = e
    raise RuntimeError(f"{path} could not be decoded: {cause}") from cause


def read_blocks(spark: SparkSession, path: str, block_sec: float = BLOCK_SEC, keep_errors: bool = False) -> DataFrame:
    """rec, path, sr, channels, channel, block_no, start_sample, samples of all audio files under a path, of whatever rates and channel counts.

    A file is decoded by one task and leaves it in blocks of ``block_sec`` seconds, so nothing after that is as long as a recording; ``read_wav`` splits WAV files. A
    file that cannot be decoded is an error, or, with ``keep_errors``, one row whose last column, ``error``, holds the cause.
    """
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("rec"), "path", "content")
    own_kind, any_kind = dict(DECODERS), list(FALLBACKS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                own = {"rec": [r.rec], "path": [r.path]}
                try:
                    x, sr = decode(r.path, bytes(r.content), [*own_kind.get(r.path.rsplit(".", 1)[-1].lower(), []), *any_kind])
                except RuntimeError as e:
                    if not keep_errors:
                        raise
                    yield pd.DataFrame(own | {"sr": [0], "channels": [0], "channel": [0], "block_no": [0], "start_sample": [0], "samples": [np.zeros(0, np.float32)], "error": [str(e)]})
                    continue
                size = max(1, int(block_sec * sr))
                for c in range(x.shape[1]):
                    for i, at in enumerate(range(0, max(1, len(x)), size)):
                        row = pd.DataFrame(own | {"sr": [sr], "channels": [x.shape[1]], "channel": [c], "block_no": [i], "start_sample": [at], "samples": [x[at : at + size, c]]})
                        yield row.assign(error=None) if keep_errors else row

    return files.mapInPandas(run, BLOCKS + ", error string" * keep_errors)


def _opened(path: str):
    """A file of any store that Arrow knows; Spark names local files file:/..."""
    store, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store.open_input_file(at)


def wav_ranges(spark: SparkSession, path: str, block_sec: float = BLOCK_SEC) -> DataFrame:
    """rec, path, sr, channels, width, block_no, start_sample, n, offset: the blocks of all WAV files under a path as ranges of bytes. Tasks read headers only."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("rec"), "path", "length")

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                with _opened(r.path) as f:
                    sr, channels, width, at, size = wav_header(f, r.length)
                yield pd.DataFrame({"rec": [r.rec], "path": [r.path], "sr": [sr], "channels": [channels], "width": [width], "at": [at], "total": [size // (width * channels)]})

    headed = files.mapInPandas(heads, "rec long, path string, sr int, channels int, width int, at long, total long")
    size = F.greatest(F.lit(1), F.floor(F.col("sr") * F.lit(float(block_sec))))
    rows = headed.withColumn("size", size).withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("total") - 1, F.lit(0)) / F.col("size")))))
    start = F.col("block_no") * F.col("size")
    rows = rows.withColumn("start_sample", start).withColumn("n", F.least("size", F.col("total") - start))
    return rows.select("rec", "path", "sr", "channels", "width", "block_no", "start_sample", "n", (F.col("at") + start * F.col("width") * F.col("channels")).alias("offset"))


def read_ranges(ranges: DataFrame) -> DataFrame:
    """The blocks of ``wav_ranges``, as ``read_blocks`` has them: every range is read alone, so a long file is many tasks' work and none holds it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                with _opened(r.path) as f:
                    f.seek(r.offset)
                    x = pcm(f.read(r.n * r.width * r.channels), r.width, r.channels)
                for c in range(r.channels):
                    yield pd.DataFrame({"rec": [r.rec], "path": [r.path], "sr": [r.sr], "channels": [r.channels], "channel": [c], "block_no": [r.block_no], "start_sample": [r.start_sample], "samples": [x[:, c]]})

    return ranges.repartition("rec", "block_no").mapInPandas(run, BLOCKS)


def read_wav(spark: SparkSession, path: str, block_sec: float = BLOCK_SEC) -> DataFrame:
    """``read_blocks`` for WAV files of any length, in a store that Arrow can open."""
    return read_ranges(wav_ranges(spark, path, block_sec))


def recordings(blocks: DataFrame) -> DataFrame:
    """rec, sr, channels, n_samples, duration."""
    n = blocks.where("channel = 0").groupBy("rec", "sr", "channels").agg(F.sum(F.size("samples")).cast("long").alias("n_samples"))
    return n.withColumn("duration", F.col("n_samples") / F.col("sr"))


def file_name(rec: int, speaker: int) -> str:
    return f"{rec}-SPEAKER_{speaker + 1}.wav"


class Written(WriterCommitMessage):
    """What a task has written: (place among the unfinished files, final name) of each."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class WavWriter(DataSourceArrowWriter):
    """Tasks write files under a folder of the job's own; only when all are done are the files of those that succeeded moved to their names."""

    def __init__(self, root: str, sr: int):
        self.root, self.sr, self.job = root.rstrip("/"), sr, f"_unfinished-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows in order of rec, speaker, block_no, channel; the channels of a block are laid side by side."""
        store, folder = self._store()
        store.create_dir(f"{folder}/{self.job}")
        done, who, out, block, parts = [], None, None, None, []

        def flush() -> None:
            if parts:
                x = np.clip(np.stack(parts, axis=1).astype(np.float64), -1, 1)
                out.write(np.rint(x * 32767).astype("<i2").tobytes())
                parts.clear()

        try:
            for batch in iterator:
                samples = batch.column("samples")
                for i, (rec, speaker, no, total, channels) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rec", "speaker", "block_no", "total", "channels")), strict=True)):
                    if (rec, speaker, no) != block:
                        flush()
                        block = rec, speaker, no
                    if (rec, speaker) != who:
                        if out is not None:
                            out.close()
                        who, at = (rec, speaker), f"{self.job}/{uuid.uuid4().hex}.wav"
                        size = 2 * channels * total
                        if size > 0xFFFFFFFF - 36:
                            raise ValueError(f"recording {rec}, speaker {speaker}: {size} bytes are too many for a WAV file")
                        out = store.open_output_stream(f"{folder}/{at}", compression=None)
                        out.write(b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, self.sr, 2 * channels * self.sr, 2 * channels, 16) + b"data" + struct.pack("<I", size))
                        done.append((at, file_name(rec, speaker)))
                    parts.append(samples[i].values.to_numpy(zero_copy_only=False))
            flush()
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = self._store()
        for message in messages:
            for at, name in message.files if message else ():
                store.move(f"{folder}/{at}", f"{folder}/{name}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = self._store()
        if store.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.job}")


class WavSink(DataSource):
    """``df.write.format("speaker_wav").option("sr", ...).mode("append").save(uri)`` for rows (rec, speaker, channels, total, block_no, channel, samples)."""

    @classmethod
    def name(cls) -> str:
        return "speaker_wav"

    def schema(self) -> str:
        return "rec long, speaker int, channels int, total long, block_no long, channel int, samples array<float>"

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(self.options["path"], int(self.options["sr"]))


def write_wav(tracks: DataFrame, root: str, sr: int) -> DataFrame:
    """Write 16-bit WAV, one file for each rec and speaker of tracks (rec, speaker, channel, block_no, samples); rec, speaker, channels, path, n_samples of the files.

    Lengths come first, from an aggregation, for the header; then each track is one ordered stream of blocks to its file, channels side by side. Files appear under
    ``root`` (a URI) when all tasks are done, so neither a failed task nor a failed job leaves one. Samples are clipped to [-1, 1].
    """
    spark = tracks.sparkSession
    spark.dataSource.register(WavSink)
    total = tracks.groupBy("rec", "speaker").agg((F.max("channel") + 1).alias("channels"), F.sum(F.when(F.col("channel") == 0, F.size("samples")).otherwise(0)).cast("long").alias("total"))
    rows = tracks.join(total, ["rec", "speaker"]).select("rec", F.col("speaker").cast("int").alias("speaker"), F.col("channels").cast("int").alias("channels"), "total", "block_no", F.col("channel").cast("int").alias("channel"), F.col("samples").cast("array<float>").alias("samples"))
    ordered = rows.repartition("rec", "speaker").sortWithinPartitions("rec", "speaker", "block_no", "channel")
    ordered.write.format("speaker_wav").option("sr", sr).mode("append").save(root)
    name = F.concat(F.lit(root.rstrip("/") + "/"), F.col("rec").cast("string"), F.lit("-SPEAKER_"), (F.col("speaker") + 1).cast("string"), F.lit(".wav"))
    return total.select("rec", "speaker", "channels", name.alias("path"), F.col("total").alias("n_samples"))
