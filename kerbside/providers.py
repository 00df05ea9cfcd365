"""Models behind an interface: describers turn images into text, embedders turn text and images into unit vectors.

A provider runs on the executors, in Arrow batches, and loads its model once for each worker process. What comes with this
package needs no model: a hashing embedder and a describer that looks descriptions up. Others register themselves by name.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside import backends
from kerbside.functions import textbytes
from kerbside.functions.text import SCENE_FIELDS, file_stem, with_scene_fields
from kerbside.operators.merge import not_done
from kerbside.prompts import prompt_for
from kerbside.session import cut, ship
from kerbside.sources import files
from kerbside.sources.tables import IMAGE_SUFFIXES, list_images

DEFAULT_INSTRUCTION = "Represent the street view for retrieval."
TEXT_BATCH, IMAGE_BATCH, DESCRIBE_BATCH = 32, 8, 8
COMMIT_ROWS = 10_000


class EmbeddingBackend(Protocol):
    def embed(self, items: Sequence[list[dict]], instruction: str) -> np.ndarray:
        """A row for each item, a chat message's content: parts {"type": "image" | "text", ...}."""


class DescribeBackend(Protocol):
    def generate(self, images: Sequence[str], system: str, user: str) -> list[str]: ...


class HashEmbedder:
    """Counts of hashed words and of the byte triples within them; an image counts by its bytes where it can be read, else by its path. Equal texts have equal vectors, everywhere."""

    def __init__(self, dimension: int = 128):
        self.dimension = dimension

    def embed(self, items: Sequence[list[dict]], instruction: str = DEFAULT_INSTRUCTION) -> np.ndarray:
        out = np.zeros((len(items), self.dimension))
        texts = [" ".join(p["text"] if p["type"] == "text" else "" if _image_bytes(p["image"]) is not None else str(p["image"]) for p in parts).lower() for parts in items]
        for row, data, offsets in textbytes.slices(pa.array(texts, pa.string())):
            flags = textbytes.WORD[data]
            starts, ends = textbytes.runs(flags, offsets)
            word = textbytes.span_hashes(data, starts, ends)
            left = np.zeros(len(data), np.int64)  # bytes left in a word
            left[flags] = np.repeat(ends, ends - starts) - np.flatnonzero(flags)
            at = np.flatnonzero(left >= 3)
            triple = textbytes.mix((data[at].astype(np.uint64) << np.uint64(16)) | (data[at + 1].astype(np.uint64) << np.uint64(8)) | data[at + 2])
            self._count(out[row : row + len(offsets) - 1], np.concatenate([textbytes.owner(starts, offsets), textbytes.owner(at, offsets)]), np.concatenate([word, triple]))
        for k, parts in enumerate(items):
            for p in parts:
                if p["type"] == "image" and (raw := _image_bytes(p["image"])) is not None and len(raw) > 3:
                    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
                    grams = textbytes.mix((x[:-3] << np.uint64(24)) | (x[1:-2] << np.uint64(16)) | (x[2:-1] << np.uint64(8)) | x[3:])
                    self._count(out[k : k + 1], np.zeros(len(grams), np.int64), grams)
        return out.astype(np.float32)

    def _count(self, out: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> None:
        place = rows * self.dimension + ((hashes >> np.uint64(1)) % np.uint64(self.dimension)).astype(np.int64)
        out += np.bincount(place, np.where(hashes & np.uint64(1), 1.0, -1.0), out.size).reshape(out.shape)


def _image_bytes(image) -> bytes | None:
    """The bytes of an image on a disk that this process can read."""
    path = re.sub(r"^file:(//)?", "", str(image))
    if "://" in path or not os.path.isfile(path):
        return None
    return Path(path).read_bytes()


class TableDescriber:
    """Descriptions that are known already, by file stem; an unknown image gives an answer that is no JSON."""

    def __init__(self, known: dict[str, str] | None = None):
        self.known = known or {}

    def generate(self, images: Sequence[str], system: str, user: str) -> list[str]:
        stems = [re.sub(r"(?<=.)\.[^.]*$", "", re.split(r"[/\\]", p)[-1]) for p in images]
        return [self.known.get(s, "") for s in stems]


#: In the order in which auto tries them: those whose libraries are not there are passed over.
EMBEDDERS: dict[str, Callable[..., EmbeddingBackend]] = {"vllm": backends.VllmEmbedder, "transformers": backends.TransformersEmbedder, "hash": HashEmbedder}
DESCRIBERS: dict[str, Callable[..., DescribeBackend]] = {"vllm": backends.VllmDescriber, "transformers": backends.TransformersDescriber, "table": TableDescriber}


def register(kind: str, name: str, make: Callable) -> None:
    """Adds a backend: kind is embedder or describer."""
    {"embedder": EMBEDDERS, "describer": DESCRIBERS}[kind][name] = make


def _chosen(registry: dict[str, Callable], name: str) -> Callable:
    """A backend by name; auto takes the first that can run here, such as a GPU's with a GPU."""
    if name == "auto":
        return next(make for make in registry.values() if getattr(make, "available", lambda: True)())
    if name not in registry:
        raise ValueError(f"unknown backend {name!r}; one of {sorted(registry)} or auto")
    return registry[name]


def message(text: str | None = None, image: str | Sequence[str] | None = None) -> list[dict]:
    """A chat message's content: the image or images first, then the text; with neither, an empty text. Local paths become absolute file:// URLs."""
    images = [] if image is None else [image] if isinstance(image, str) else list(image)
    parts = [backends.picture(i if not isinstance(i, str) or re.match(r"[a-z][a-z0-9+.-]*:", i) else f"file://{os.path.abspath(i)}") for i in images]
    return [*parts, backends.words(text or "")] if text is not None or not parts else parts


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1)).astype(np.float32)


_loaded: dict = {}


def _backend(make: Callable, options: tuple):
    """The backend of this process; loaded at its first use."""
    key = (make.__module__, make.__qualname__, repr(options))
    if key not in _loaded:
        _loaded[key] = make(**dict(options))
    return _loaded[key]


@dataclass
class ImageEmbedder:
    backend: str = "auto"
    instruction: str = DEFAULT_INSTRUCTION
    batch_size: int = 4 * TEXT_BATCH
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.make = _chosen(EMBEDDERS, self.backend)

    def embed(self, df: DataFrame, text_column: str | None = None, output_column: str = "embedding", image_column: str | None = None) -> DataFrame:
        """df with unit vectors of its texts, images (by path), or both. Rows with neither are embedded as an empty text."""
        if text_column is None and image_column is None:
            raise ValueError("embedding needs a column of texts or of images")
        ship(df.sparkSession)
        make, options, size, told = self.make, tuple(self.options.items()), self.batch_size, self.instruction

        @F.arrow_udf("array<float>")
        def embedded(texts: pa.Array, images: pa.Array) -> pa.Array:
            model, out = _backend(make, options), []
            pairs = list(zip(texts.to_pylist(), images.to_pylist(), strict=True))
            for at in range(0, len(pairs), size):
                out.append(unit(np.asarray(model.embed([message(t, i) for t, i in pairs[at : at + size]], told))))
            flat = np.concatenate(out) if out else np.zeros((0, 1), np.float32)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))

        none = F.lit(None).cast("string")
        text = F.col(f"`{text_column}`").cast("string") if text_column else none
        image = F.col(f"`{image_column}`").cast("string") if image_column else none
        return df.withColumn(output_column, embedded(text, image))

    def embed_texts(self, df: DataFrame, column: str) -> DataFrame:
        return self.embed(df, column)

    def embed_images(self, df: DataFrame, column: str = "image_path") -> DataFrame:
        return self.embed(df, None, image_column=column)

    def embed_multimodal(self, df: DataFrame, text_column: str, image_column: str) -> DataFrame:
        return self.embed(df, text_column, image_column=image_column)

    def embed_one(self, text: str | None = None, image: str | None = None) -> list[float]:
        """A query's vector, on the driver."""
        return [float(x) for x in unit(np.asarray(_backend(self.make, tuple(self.options.items())).embed([message(text, image)], self.instruction)))[0]]


@dataclass
class ImageDescriber:
    """Prompts: a named template, unless system or user prompts are given; then these, or the default for a missing one."""

    backend: str = "auto"
    template: str | None = None
    system_prompt: str | None = None
    user_prompt: str | None = None
    batch_size: int = DESCRIBE_BATCH
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.make = _chosen(DESCRIBERS, self.backend)
        self.prompt = prompt_for(self.template, self.system_prompt, self.user_prompt)

    def answers(self, images: DataFrame, path: str = "path") -> DataFrame:
        """images with a column answer: the model's text for each path."""
        ship(images.sparkSession)
        make, options, size, prompt = self.make, tuple(self.options.items()), self.batch_size, self.prompt

        @F.arrow_udf("string")
        def answer(paths: pa.Array) -> pa.Array:
            model, names, out = _backend(make, options), paths.to_pylist(), []
            for at in range(0, len(names), size):
                out += model.generate(names[at : at + size], prompt["system"], prompt["user"])
            return pa.array(out, pa.string())

        return images.withColumn("answer", answer(F.col(path)))

    def describe_frame(self, images: DataFrame, path: str = "path") -> DataFrame:
        """(image_path, image_id, raw_response, parsed_json, parse_error, and the scene's fields) of each image."""
        told = self.answers(images.select(F.col(path).alias("path")))
        return with_scene_fields(told, "answer").select(F.col("path").alias("image_path"), file_stem(F.col("path")).alias("image_id"), *SCENE_FIELDS)

    def describe(self, spark: SparkSession, image_dir: str, output_path: str, resume: bool = True, suffixes: Sequence[str] = IMAGE_SUFFIXES, recursive: bool = True, commit_rows: int = COMMIT_ROWS) -> DataFrame:
        """Describes the images of a directory into Parquet. With resume, those described already are left out and the rest is appended.

        About commit_rows images at a time, chosen by a hash, are described and committed, so that a crash loses no more than that.
        """
        images = list_images(spark, image_dir, suffixes, recursive).withColumn("image_id", file_stem(F.col("path")))
        append = resume and files.exists(spark, output_path)
        if append:
            images = not_done(images, spark.read.parquet(output_path))
        images = cut(images)
        parts = max(1, -(-images.count() // commit_rows))
        for part in range(parts):
            some = images.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == part)
            self.describe_frame(some).write.mode("append" if append or part else "overwrite").parquet(output_path)
        return spark.read.parquet(output_path)

    def describe_single(self, image: str) -> dict:
        """The parsed answer for one image; {"error", "raw_response"} if it is no JSON."""
        text = _backend(self.make, tuple(self.options.items())).generate([image], self.prompt["system"], self.prompt["user"])[0]
        return parse_json_response(text)


def parse_json_response(text: str) -> dict:
    """JSON from a model's answer, for one answer on the driver; columns have functions.text.json_answer."""
    body = text.strip()
    if body.startswith("```"):
        lines = body.split("\n")[1:]
        end = next((k for k, line in enumerate(lines) if line.startswith("```")), len(lines))
        body = "\n".join(lines[:end]).strip()
    body = body.removeprefix("json").lstrip()
    try:
        return json.loads(body)
    except json.JSONDecodeError as e:
        return {"error": str(e), "raw_response": text}
