"""Safetensors files: a reader, a writer, and the batch data source ``safetensors``."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..files import read_bytes, write_bytes

SCHEMA = "name string, dtype string, shape array<bigint>, values array<float>"
WIDTH = {"F32": 4, "F16": 2, "BF16": 2}


def decode(raw: bytes, dtype: str) -> np.ndarray:
    """Bytes as float32; an incomplete last element is left out."""
    if dtype not in WIDTH:
        raise ValueError(f"unsupported dtype {dtype}")
    raw = raw[: len(raw) - len(raw) % WIDTH[dtype]]
    if dtype == "F32":
        return np.frombuffer(raw, "<f4")
    if dtype == "F16":
        return np.frombuffer(raw, "<f2").astype(np.float32)
    return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)


def encode(values: np.ndarray, dtype: str) -> bytes:
    values = np.ascontiguousarray(values, np.float32)
    if dtype == "F32":
        return values.astype("<f4").tobytes()
    if dtype == "F16":
        return values.astype("<f2").tobytes()
    if dtype == "BF16":
        return (values.view(np.uint32) >> 16).astype("<u2").tobytes()
    raise ValueError(f"unsupported dtype {dtype}")


def read_header(path: str) -> dict[str, tuple[str, list[int], int, int]]:
    """name to dtype, shape, first and last byte in the file; the metadata entry is left out."""
    (size,) = struct.unpack("<Q", read_bytes(path, 0, 8))
    entries = json.loads(read_bytes(path, 8, 8 + size))
    base = 8 + size
    return {k: (v["dtype"], v["shape"], base + v["data_offsets"][0], base + v["data_offsets"][1]) for k, v in entries.items() if k != "__metadata__"}


class SafeTensors:
    """One file, read tensor by tensor."""

    def __init__(self, path: str):
        self.path, self.header = path, read_header(path)

    def names(self) -> list[str]:
        return list(self.header)

    def __contains__(self, name: str) -> bool:
        return name in self.header

    def tensor(self, name: str) -> np.ndarray:
        """The tensor of this name, or of 'bert.' and this name."""
        found = name if name in self.header else f"bert.{name}"
        if found not in self.header:
            raise KeyError(name)
        dtype, shape, start, end = self.header[found]
        return decode(read_bytes(self.path, start, end), dtype).reshape(shape)

    def all(self) -> dict[str, np.ndarray]:
        return {name: self.tensor(name) for name in self.header}


def write(path: str, tensors: dict[str, np.ndarray], dtype: str = "F32") -> None:
    entries, bodies, at = {}, [], 0
    for name, values in tensors.items():
        raw = encode(values, dtype)
        entries[name] = {"dtype": dtype, "shape": list(values.shape), "data_offsets": [at, at + len(raw)]}
        bodies.append(raw)
        at += len(raw)
    head = json.dumps({"__metadata__": {"format": "pt"}, **entries}).encode()
    write_bytes(path, b"".join([struct.pack("<Q", len(head)), head, *bodies]))


class _Tensor(InputPartition):
    def __init__(self, name: str, dtype: str, shape: list[int], start: int, end: int):
        self.name, self.dtype, self.shape, self.start, self.end = name, dtype, shape, start, end


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Tensor(name, *entry) for name, entry in read_header(self.path).items()]

    def read(self, part: _Tensor) -> Iterator[tuple]:
        yield part.name, part.dtype, part.shape, decode(read_bytes(self.path, part.start, part.end), part.dtype).tolist()


class SafetensorsSource(DataSource):
    """One partition a tensor; only its own bytes are read."""

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_safetensors(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(SafetensorsSource)
    return spark.read.format("safetensors").load(path)
