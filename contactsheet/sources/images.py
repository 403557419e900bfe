"""Decoded pictures: perceptual hashes and model scores in batches."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, on_workers, shared_dir, written
from .metadata import scan_files

MEAN, DEVIATION = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)


#: Formats that Spark's image reader decodes.
DECODED = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".wbmp")
#: Pictures that one job reads.
AT_ONCE = 50_000


def decoded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, height, width, nChannels, data (rows of BGR) of those pictures that decode."""
    rows = spark.read.format("image").option("dropInvalid", True).load(paths)
    return rows.select(F.regexp_replace("image.origin", "^file:/+", "/").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def read_images(spark: SparkSession, path: str, run: Callable[[DataFrame], DataFrame] | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """What `run` makes of all pictures below a folder (path, height, width, nChannels, data) that decode.

    Executors list the folder.  The reader of pictures wants its paths from the driver, so these are dealt into shares of
    about `at_once` by a hash, and `run` (such as `hashed_images`) is applied to one share after the other, each written
    before the next: the driver never holds more paths than that.  Without `run` the pixels themselves are written.
    Where there are no pictures, no rows.
    """
    paths = scan_files(spark, path, DECODED).select("path")
    paths = written(paths, "pictures")
    shares = max(1, -(-paths.count() // at_once))
    dealt = written(paths.withColumn("share", F.pmod(F.xxhash64("path"), F.lit(shares))).repartition("share"), "shares")
    at = f"{shared_dir(spark)}/read-{uuid.uuid4().hex}"
    for k in range(shares):
        own = [r["path"] for r in dealt.where(F.col("share") == k).collect()]
        if own:
            rows = decoded(spark, own)
            rows = run(rows) if run else rows
            schema = rows.schema
            rows.write.parquet(f"{at}/share={k}")
    if not exists(spark, at):
        none = spark.createDataFrame([], "path string, height int, width int, nChannels int, data binary")
        return run(none) if run else none
    return spark.read.schema(schema).parquet(at).select(*schema.names)


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Height x width x 3 in RGB order, as floats."""
    raw = np.frombuffer(bytes(data), np.uint8).reshape(height, width, channels).astype(np.float32)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """By averaging where it shrinks and by nearest pixels where it grows."""
    for axis, size in ((0, height), (1, width)):
        n = image.shape[axis]
        if size >= n:
            image = np.take(image, np.arange(size) * n // size, axis=axis)
            continue
        edges = np.linspace(0, n, size + 1)
        sums = np.concatenate([np.zeros_like(np.take(image, [0], axis)), np.cumsum(image, axis=axis, dtype=np.float64)], axis=axis)
        low = np.floor(edges).astype(int)
        part = (edges - low).reshape([-1 if a == axis else 1 for a in range(image.ndim)])
        at = np.take(sums, low, axis) * (1 - part) + np.take(sums, np.minimum(low + 1, n), axis) * part
        image = np.diff(at, axis=axis) / (n / size)
    return image


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))


def phash64(image: np.ndarray) -> int:
    """Signs of the 8 x 8 lowest cosine coefficients of the grey 32 x 32 picture against their median, as a signed number."""
    grey = resized(image @ np.array([0.299, 0.587, 0.114]), 32, 32)
    c = _cosines(32)
    low = (c @ grey @ c.T)[:8, :8]
    return int(np.packbits(low.ravel() > np.median(low)).view(">i8")[0])


def hashed_images(images: DataFrame) -> DataFrame:
    """path, hash64 of each picture."""
    on_workers(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "hash64": np.array([phash64(pixels(*x)) for x in zip(b["data"], b["height"], b["width"], b["nChannels"])], np.int64)})

    return images.mapInPandas(run, "path string, hash64 long")


def preprocess(image: np.ndarray, resize: int = 416, crop: int = 384) -> np.ndarray:
    """3 x crop x crop, centred, scaled to 0..1 and normalised by channel."""
    x = resized(image, resize, resize)
    a = (resize - crop) // 2
    return (((x[a : a + crop, a : a + crop] / 255 - MEAN) / DEVIATION).transpose(2, 0, 1)).astype(np.float32)


_SESSIONS: dict[str, Callable] = {}


def onnx_scorer(model: str) -> Callable[[np.ndarray], np.ndarray]:
    """A scorer that opens the model once in each Python worker."""

    def score(batch: np.ndarray) -> np.ndarray:
        if model not in _SESSIONS:
            import onnxruntime

            session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
            _SESSIONS[model] = lambda x: session.run(None, {session.get_inputs()[0].name: x})[0]
        return _SESSIONS[model](batch)

    return score


def score_images(images: DataFrame, scorer: Callable[[np.ndarray], np.ndarray] | None, size: int = 32) -> DataFrame:
    """path, logits of each picture; without a scorer no rows, and an error in the log."""
    if scorer is None:
        logging.getLogger(__name__).error("there is no model, so no picture is scored")
        return images.sparkSession.createDataFrame([], "path string, logits array<double>")
    on_workers(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), size):
                part = b.iloc[s : s + size]
                x = np.stack([preprocess(pixels(*r)) for r in zip(part["data"], part["height"], part["width"], part["nChannels"])])
                yield pd.DataFrame({"path": part["path"].to_numpy(), "logits": [list(map(float, r)) for r in scorer(x)]})

    return images.mapInPandas(run, "path string, logits array<double>")
