"""Sketch files (.hll): a 48-byte header and the registers, little-endian; and tab-separated reports.

Sketches that stay in Spark are best kept as Parquet of (item, idx, rho); these files are for exchange. One
validator serves headers and whole files. Where another tool's register convention isn't known, its files read but need not
compare with ours: ours index by the top bits of xxHash64.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sketch import DEFAULT_P, MAX_P, MIN_P, Sketch

# Fixed values of the file format: five capital letters, then 0, 0, 1; versions; hash type; size.
MAGIC = b"SWHLL\x00\x00\x01"
VERSIONS = (1, 2)
HASH_TYPE = 0
HEADER = "<8sIIIIQQB7x"
HEADER_BYTES = 48


@dataclass(frozen=True)
class Header:
    version: int
    precision_p: int
    k: int
    hash_type: int
    n_registers: int
    register_bytes: int
    canonical: bool


def parse_header(data: bytes, magic: bytes | None = None) -> Header:
    """``magic``: the one to insist on; None takes any five capital letters before 0, 0, 1."""
    if len(data) < HEADER_BYTES:
        raise ValueError("short header")
    tag, version, p, k, kind, n, size, canonical = struct.unpack_from(HEADER, data)
    known = tag == magic if magic else tag[5:] == MAGIC[5:] and tag[:5].isalpha() and tag[:5].isupper()
    if not known:
        raise ValueError("not a sketch file")
    if version not in VERSIONS:
        raise ValueError(f"unknown version {version}")
    if kind != HASH_TYPE:
        raise ValueError(f"unknown hash type {kind}")
    if not MIN_P <= p <= MAX_P or n != 1 << p or size != 4 * n:
        raise ValueError("sizes in the header disagree")
    if canonical not in (0, 1):
        raise ValueError("the canonical byte is neither 0 nor 1")
    return Header(version, p, k, kind, n, size, version == 1 or bool(canonical))


def encode(regs: np.ndarray, k: int, canonical: bool, magic: bytes = MAGIC) -> bytes:
    p = len(regs).bit_length() - 1
    return struct.pack(HEADER, magic, 2, p, k, HASH_TYPE, len(regs), 4 * len(regs), canonical) + regs.astype("<u4").tobytes()


def decode(data: bytes, magic: bytes | None = None) -> tuple[Header, np.ndarray]:
    h = parse_header(data, magic)
    if len(data) != HEADER_BYTES + h.register_bytes:
        raise ValueError("the body's length disagrees with the header")
    return h, np.frombuffer(data, "<u4", h.n_registers, HEADER_BYTES)


def dense(regs: DataFrame, p: int) -> np.ndarray:
    """At most 2**p rows of one sketch, as an array on the driver."""
    out = np.zeros(1 << p, np.uint32)
    for idx, rho in regs.select("idx", "rho").collect():
        out[idx] = rho
    return out


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def write_sketch(sketch: Sketch, path: str, magic: bytes = MAGIC) -> None:
    filesystem, local = _open(path)
    with filesystem.open_output_stream(local) as f:
        f.write(encode(dense(sketch.registers, sketch.precision), sketch.k or 0, sketch.canonical, magic))


def _load(spark: SparkSession, path: str) -> bytes:
    filesystem, local = _open(path)
    with filesystem.open_input_file(local) as f:
        return f.read()


def read_header(path: str, magic: bytes | None = None) -> Header:
    filesystem, local = _open(path)
    with filesystem.open_input_file(local) as f:
        return parse_header(f.read(HEADER_BYTES), magic)


def read_sketch(spark: SparkSession, path: str, magic: bytes | None = None) -> Sketch:
    h, regs = decode(_load(spark, path), magic)
    at = np.flatnonzero(regs)
    rows = spark.createDataFrame(pa.table({"idx": at.astype(np.int32), "rho": regs[at].astype(np.int32)})) if len(at) else spark.createDataFrame([], "idx int, rho int")
    return Sketch(rows, h.precision_p, h.canonical, k=h.k)


def read_sketches(spark: SparkSession, folder: str, magic: bytes | None = None) -> DataFrame:
    """(path, precision_p, k, canonical, idx, rho) of all *.hll files of a folder, decoded on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hll").load(folder).select("path", "content")

    def run(batches):
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                h, regs = decode(data, magic)
                at = np.flatnonzero(regs)
                same = lambda v, kind: pa.array([v] * len(at), kind)
                yield pa.RecordBatch.from_arrays(
                    [same(path, pa.string()), same(h.precision_p, pa.int32()), same(h.k, pa.int32()), same(h.canonical, pa.bool_()), pa.array(at.astype(np.int32)), pa.array(regs[at].astype(np.int32))],
                    ["path", "precision_p", "k", "canonical", "idx", "rho"],
                )

    return files.mapInArrow(run, "path string, precision_p int, k int, canonical boolean, idx int, rho int")


def read_packed(spark: SparkSession, folder: str, magic: bytes | None = None) -> DataFrame:
    """(path, precision_p, k, canonical, regs BINARY) of all *.hll files of a folder, empty sketches too: one byte a register, 255 at most."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hll").load(folder).select("path", "content")

    def run(batches):
        for b in batches:
            got = [decode(data, magic) for data in b.column("content").to_pylist()]
            kinds = {"precision_p": pa.int32(), "k": pa.int32(), "canonical": pa.bool_()}
            heads = [pa.array([getattr(h, c) for h, _ in got], t) for c, t in kinds.items()]
            regs = pa.array([np.minimum(r, 255).astype(np.uint8).tobytes() for _, r in got], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("path"), *heads, regs], ["path", *kinds, "regs"])

    return files.mapInArrow(run, "path string, precision_p int, k int, canonical boolean, regs binary")


def write_sketches(regs: DataFrame, folder: str, name: str, k: int, canonical: bool, p: int = DEFAULT_P, magic: bytes = MAGIC) -> DataFrame:
    """Write ``<folder>/<name>.hll`` for every value of column ``name``, on the executors; (name, output) of what was written."""
    rows = regs.groupBy(name).agg(F.collect_list(F.struct("idx", "rho")).alias("r"))

    def run(batches):
        for b in batches:
            out, lists = [], b.column("r")
            flat = lists.flatten()
            idx, rho = flat.field("idx").to_numpy(), flat.field("rho").to_numpy()
            at = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            for i, n in enumerate(b.column(name).to_pylist()):
                x = np.zeros(1 << p, np.uint32)
                x[idx[at[i] : at[i + 1]]] = rho[at[i] : at[i + 1]]
                # aside first: a task that is lost or runs twice leaves no torn file
                filesystem, local = _open(f"{folder}/{n}.hll")
                own = f"{local}.{uuid.uuid4().hex}"
                with filesystem.open_output_stream(own) as f:
                    f.write(encode(x, k, canonical, magic))
                filesystem.move(own, local)
                out.append(f"{folder}/{n}.hll")
            yield pa.RecordBatch.from_arrays([b.column(name), pa.array(out, pa.string())], [name, "output"])

    return rows.mapInArrow(run, f"`{name}` {regs.schema[name].dataType.simpleString()}, output string")


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated, without a header."""
    rows.write.mode("overwrite").option("sep", "\t").csv(path)
