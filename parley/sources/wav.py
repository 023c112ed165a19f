"""WAV files to sample chunks."""

import io
import wave
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CHUNK_FRAMES = 1024
BATCH = 256
NAMES = ["path", "chunk_id", "rate", "channels", "start_frame", "samples"]
CHUNKS = ("path string, chunk_id bigint, rate int, channels int, start_frame bigint, "
          "samples array<smallint>")


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option(
        "recursiveFileLookup", True).load(path).select("path", "content")


def _read(path, content, chunk_frames):
    with wave.open(io.BytesIO(content)) as f:
        rate, channels, at = f.getframerate(), f.getnchannels(), 0
        while data := f.readframes(chunk_frames):
            samples = np.frombuffer(data, dtype="<i2")
            yield path, at // chunk_frames, rate, channels, at, samples
            at += len(samples) // channels


def _chunks(chunk_frames: int):
    def read(batches):
        for pdf in batches:
            rows = chain.from_iterable(
                _read(path, content, chunk_frames) for path, content in zip(pdf["path"], pdf["content"]))
            while some := list(islice(rows, BATCH)):
                yield pd.DataFrame(some, columns=NAMES)
    return read


def audio_chunks(files: DataFrame, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Chunks of 16-bit samples from (path, content). A file is read chunk by chunk,
    and leaves the reader in small batches of chunks."""
    return files.mapInPandas(_chunks(chunk_frames), CHUNKS)
