"""Files as frames and back: project documents with sidecars, label documents, sound, signals, boxes, presets."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT = "project_id string, name string, updated_at long, media array<struct<media_id: string, path: string, duration: double>>"
SIDECAR = "media_id string, status string, rallies array<struct<start: double, end: double, score: double>>"
LABELS = "media_id string, rallies array<struct<start: double, end: double, note: string>>, hits array<struct<t: double, ours: boolean>>"


def projects(spark: SparkSession, documents: str, sidecars: str) -> DataFrame:
    """One row for each medium of each project, with its sidecar's status and rallies where it has one; unreadable documents give none."""
    roots = spark.read.schema(PROJECT).json(documents, multiLine=True, mode="PERMISSIVE").where("project_id is not null")
    media = roots.select("project_id", "name", "updated_at", F.explode_outer("media").alias("m")).select("project_id", "name", "updated_at", "m.*")
    side = spark.read.schema(SIDECAR).json(sidecars, multiLine=True, mode="PERMISSIVE").where("media_id is not null").dropDuplicates(["media_id"])
    return media.join(side, "media_id", "left")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Label documents; missing lists are empty."""
    rows = spark.read.schema(LABELS).json(path, multiLine=True, mode="PERMISSIVE").where("media_id is not null")
    return rows.select("media_id", F.coalesce("rallies", F.array()).alias("rallies"), F.coalesce("hits", F.array()).alias("hits"))


def sounds(spark: SparkSession, path: str, block: int = 16_000) -> DataFrame:
    """(path, rate, at, samples): the mean of a WAV file's channels in [-1, 1], in blocks of samples; 8, 16 and 32 bits."""

    def blocks(frames):
        for frame in frames:
            for name, content in zip(frame.path, frame.content):
                with wave.open(io.BytesIO(content)) as f:
                    width, channels = f.getsampwidth(), f.getnchannels()
                    if width not in (1, 2, 4):
                        raise ValueError(f"{name}: {8 * width} bits a sample")
                    scale, shift = {1: (128.0, 128), 2: (2.0**15, 0), 4: (2.0**31, 0)}[width]
                    at = 0
                    while raw := f.readframes(block):
                        x = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
                        mono = ((x - shift) / scale).reshape(-1, channels).mean(axis=1)
                        yield pd.DataFrame({"path": [name], "rate": [f.getframerate()], "at": [at], "samples": [mono.tolist()]})
                        at += len(mono)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(blocks, "path string, rate int, at long, samples array<double>")


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet below one folder for each key; only the folders that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_labels_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document a line."""
    df.write.mode("overwrite").json(path)
