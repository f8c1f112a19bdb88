"""Recordings: headers and samples of WAV files, read as binary files and parsed in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from io import BytesIO
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import settle
from corpusloom.sources import files

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


class LoadError(ValueError):
    """The bytes are no recording that can be decoded here."""


#: Names of sample formats by kind and bits (fixed values).
SUBTYPES = {(PCM, 8): "PCM_U8", (PCM, 16): "PCM_16", (PCM, 24): "PCM_24", (PCM, 32): "PCM_32", (FLOAT, 32): "FLOAT", (FLOAT, 64): "DOUBLE"}


def probe(file: BinaryIO, size: int) -> dict:
    """rate, channels, bits, kind, subtype, frames and where the samples are in a RIFF/WAVE file of ``size`` bytes.

    Only the heads of the file's chunks are read; samples are skipped.
    """
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise LoadError("no RIFF/WAVE header")
    at, form, body = 12, None, None
    while at + 8 <= size and (form is None or body is None):
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            held = file.read(min(length, 40))
            if length < 16 or len(held) < 16:
                raise LoadError("the format chunk is too short")
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", held)
            if kind == EXTENSIBLE and len(held) >= 26:
                kind = struct.unpack_from("<H", held, 24)[0]
            form = {"kind": kind, "channels": channels, "sample_rate": rate, "bits": bits}
        elif name == b"data":
            body = at + 8, min(length, size - at - 8)
        at += 8 + length + length % 2
    if form is None or body is None:
        raise LoadError("no format or no samples")
    if form["sample_rate"] <= 0 or form["channels"] <= 0:
        raise LoadError("rate and channels must be positive")
    if (form["kind"], form["bits"]) not in SUBTYPES:
        raise LoadError(f"samples of kind {form['kind']} with {form['bits']} bits")
    frames = body[1] // (form["channels"] * form["bits"] // 8)
    return form | {"format": "WAV", "subtype": SUBTYPES[form["kind"], form["bits"]], "frames": frames, "start": body[0]}


def parse(data: bytes) -> dict:
    """What ``probe`` tells, and the bytes of the samples."""
    held = probe(BytesIO(data), len(data))
    return held | {"body": data[held["start"] : held["start"] + held["frames"] * held["channels"] * held["bits"] // 8]}


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(frames, channels) of float32 in [-1, 1] for integer samples, and the rate."""
    held = parse(data)
    raw, bits = held["body"], held["bits"]
    if held["kind"] == FLOAT:
        x = np.frombuffer(raw, "<f4" if bits == 32 else "<f8").astype(np.float32)
    elif bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, "<i2" if bits == 16 else "<i4").astype(np.float64) / 2.0 ** (bits - 1)
    return x.astype(np.float32).reshape(-1, held["channels"]), held["sample_rate"]


def encode(x: np.ndarray, rate: int) -> bytes:
    """A 32-bit float WAV file of (frames,) or (frames, channels)."""
    x = np.asarray(x, "<f4")
    channels = 1 if x.ndim == 1 else x.shape[1]
    body = x.tobytes()
    form = struct.pack("<HHIIHH", FLOAT, channels, rate, rate * channels * 4, channels * 4, 32)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body


def write_clips(clips: DataFrame, folder: str) -> int:
    """32-bit float WAV files of (name, samples ARRAY<FLOAT>, sample_rate) below a folder; gives their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            made = [encode(values[a:b], r) for a, b, r in zip(ends[:-1], ends[1:], batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch({"name": batch.column(0), "content": pa.array(made, pa.binary())})

    return files.write_files(clips.select("name", "samples", "sample_rate").mapInArrow(run, "name string, content binary"), folder)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all WAV files below a folder, those of no bytes included."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    void = files.list_files(spark, [path], ".wav", recursive=True).where("size = 0")
    return raw.select(files.plain(F.col("path")).alias("path"), "content").unionByName(void.select("path", F.lit("").cast("binary").alias("content")))


def read_headers(spark: SparkSession, path: str, files_a_task: int = 2000, threads: int = 8) -> DataFrame:
    """(path, sample_rate, channels, frames, duration, format, subtype, error): error says why a file can't be read, the rest
    is null then. Of a file only the heads of its chunks are read, by several threads a task."""

    def one(row: tuple[str, int]) -> tuple:
        path_, size = row
        try:
            store, at = files.store_of(path_)
            with store.open_input_file(at) as f:
                h = probe(f, size)
            return (path_, h["sample_rate"], h["channels"], h["frames"], h["frames"] / h["sample_rate"], h["format"], h["subtype"], None)
        except (LoadError, OSError) as e:
            return (path_, None, None, None, None, None, None, str(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                rows = list(pool.map(one, zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.string()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
                names = ["path", "sample_rate", "channels", "frames", "duration", "format", "subtype", "error"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    held = settle(files.list_files(spark, [path], ".wav", recursive=True).select("path", "size"), "files")
    tasks = max(1, -(-held.count() // files_a_task))
    shape = "path string, sample_rate int, channels int, frames long, duration double, format string, subtype string, error string"
    return held.repartition(max(tasks, spark.sparkContext.defaultParallelism)).mapInArrow(run, shape)


def read_clips(spark: SparkSession, path: str, mono: bool = True) -> DataFrame:
    """(path, samples, channels, sample_rate, error): samples at the file's own rate, averaged to one channel unless told
    otherwise (then interleaved)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column(0), batch.column(1), strict=True):
                x, channels, rate, error = None, None, None, None
                try:
                    x, rate = decode(memoryview(data.as_buffer()).tobytes())
                    channels, x = (1, x.mean(1, dtype=np.float32)) if mono else (x.shape[1], x.ravel())
                except LoadError as e:
                    error = str(e)
                samples = pa.array([None], pa.list_(pa.float32())) if x is None else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                rest = zip((channels, rate, error), (pa.int32(), pa.int32(), pa.string()), strict=True)
                yield pa.record_batch([pa.array([p.as_py()], pa.string()), samples, *[pa.array([v], k) for v, k in rest]], ["path", "samples", "channels", "sample_rate", "error"])

    return _files(spark, path).select("path", "content").mapInArrow(run, "path string, samples array<float>, channels int, sample_rate int, error string")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path).select("path", F.sha2("content", 256).alias("sha256"))
