"""Token ids in binary shards with a minimal perfect hash index.

An export is a folder:

* ``shard-NNNNNN.ids``: header (magic, id width, documents, ids), raw ids of the documents one after
  another, then documents + 1 offsets (uint64, in ids) and the documents' keys (int64). Documents are
  in ascending doc_id order within a shard and from shard to shard; a null doc_id comes first.
* ``index-NNNNN.mph``: keys are dealt over index parts by hash. A part holds a minimal perfect hash
  (``mph``) and per slot a 32-bit fingerprint, the shard and the document's number there, and how many
  documents in a row have the key. A lookup costs the same whatever the export's size: part, slot,
  fingerprint, offset.
* ``manifest`` rows (a table of one row a shard) stay with the caller: shard, docs, ids.

Files are written under a name of the task's own and then renamed, so a task that runs twice, or whose
executor is lost, leaves the same file. Paths go through pyarrow.fs, whichever store the shared
folder is on.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ._shared import empty_dir, new_dir, partitions, plan_bytes, read_raw, stage, write_raw
from ._words import mix
from .mph import Mph
from .tokens import default_path, encoded

# Fixed values of the file format.
SHARD_MAGIC = b"SWIDS\x00\x00\x01"
INDEX_MAGIC = b"SWMPH\x00\x00\x01"
#: Bytes of input for a shard, about: one task writes or reads a shard.
SHARD_BYTES = 32 << 20
_HEAD = "<8sIIQQ"

#: Keys of an index part, about; one task builds or reads a part. 20 bytes a key.
PART_KEYS = 1 << 17


def _shard(uri: str, n: int) -> str:
    return f"{uri}/shard-{n:06d}.ids"


def _part(uri: str, n: int) -> str:
    return f"{uri}/index-{n:05d}.mph"


def _flag(nulls: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.where(nulls, np.iinfo(np.int64).min, keys)


def _write_shards(uri: str, path: str, end_id: int):
    def run(batches):
        shard = TaskContext.get().partitionId()
        keys, counts, parts, dtype = [], [], [], None
        for b in batches:
            keys.append(b.column("doc_id"))
            for _, ids in encoded(b.column("text"), path):
                dtype = ids.dtype
                parts.append(ids.tobytes() + np.array([end_id], dtype).tobytes())
                counts.append(len(ids) + 1)
        if not counts:
            return
        column = pa.concat_arrays(keys)
        key = _flag(column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy())
        offsets = np.append(0, np.cumsum(counts)).astype("<u8")
        head = struct.pack(_HEAD, SHARD_MAGIC, dtype.itemsize, 0, len(counts), int(offsets[-1]))
        write_raw(_shard(uri, shard), [head, *parts, offsets.tobytes(), key.astype("<i8").tobytes()])
        n = len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.arange(n)), column, pa.array(np.array(counts, np.int64))], ["shard", "doc", "doc_id", "n_tokens"])

    return run


class Shard:
    """An open shard: ids(i) of its i-th document."""

    def __init__(self, uri: str, n: int):
        data = read_raw(_shard(uri, n))
        magic, width, _, docs, ids = struct.unpack_from(_HEAD, data)
        if magic != SHARD_MAGIC or len(data) != struct.calcsize(_HEAD) + width * ids + 8 * (docs + 1) + 8 * docs:
            raise ValueError(f"{_shard(uri, n)} is not a shard of ids")
        self.payload = np.frombuffer(data, f"<u{width}", ids, struct.calcsize(_HEAD))
        self.offsets = np.frombuffer(data, "<u8", docs + 1, struct.calcsize(_HEAD) + width * ids).astype(np.int64)
        self.keys = np.frombuffer(data, "<i8", docs, len(data) - 8 * docs)

    def ids(self, i: int) -> np.ndarray:
        return self.payload[self.offsets[i] : self.offsets[i + 1]]


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)


def _build_parts(uri: str):
    def run(key, g):
        keys = g["doc_id"].to_numpy(np.int64).view(np.uint64)
        h = Mph.build(keys)
        at = h.slot(keys)
        table = np.zeros(len(g), _ENTRY)
        table["print"][at] = fingerprint(keys)
        for c in ("shard", "doc", "run"):
            table[c][at] = g[c].to_numpy()
        write_raw(_part(uri, int(key[0])), [INDEX_MAGIC, struct.pack("<Q", len(g)), table.tobytes(), h.to_bytes()])
        return pd.DataFrame({"part": [int(key[0])], "keys": [len(g)]})

    return run


_ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("doc", "<u8"), ("run", "<u8")])


class Index:
    """An open index part: find(keys) gives (found, entries)."""

    def __init__(self, uri: str, n: int):
        data = read_raw(_part(uri, n))
        (size,) = struct.unpack_from("<Q", data, 8)
        if data[:8] != INDEX_MAGIC:
            raise ValueError(f"{_part(uri, n)} is not an index part")
        self.table = np.frombuffer(data, _ENTRY, size, 16)
        self.hash, _ = Mph.from_bytes(data[16 + size * _ENTRY.itemsize :])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = keys.astype(np.int64).view(np.uint64)
        at = self.hash.slot(k)
        entry = self.table[np.maximum(at, 0)] if len(self.table) else np.zeros(len(k), _ENTRY)
        return (at >= 0) & (len(self.table) > 0) & (entry["print"] == fingerprint(k)), entry


class Export:
    """A written export. shards: a DataFrame (shard, docs, ids); parts: the number of index parts."""

    def __init__(self, spark: SparkSession, uri: str, placed: DataFrame, parts: int):
        self.spark, self.uri, self.parts = spark, uri, parts
        self.placed = placed
        self.shards = placed.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("ids"))

    def part(self, column: str = "doc_id"):
        return F.pmod(F.xxhash64(F.lit(5), column), F.lit(self.parts)).cast("int")

    def find(self, keys: DataFrame) -> DataFrame:
        """(doc_id, shard, doc, run) of the keys that the index has; keys: (doc_id long)."""
        uri = self.uri

        def look(key, g):
            k = g["doc_id"].to_numpy(np.int64)
            found, entry = Index(uri, int(key[0])).find(k)
            return pd.DataFrame({"doc_id": k[found], **{c: entry[c][found].astype(np.int64) for c in ("shard", "doc", "run")}})

        dealt = keys.where("doc_id is not null").select("doc_id").distinct().withColumn("part", self.part())
        return dealt.groupBy("part").applyInPandas(look, "doc_id long, shard long, doc long, run long")

    def read(self, at: DataFrame) -> DataFrame:
        """(doc_id, shard, doc, n_tokens, ids_crc32, offset) of the documents at (shard, doc), from the files."""
        uri = self.uri

        def load(key, g):
            s = Shard(uri, int(key[0]))
            docs = g["doc"].to_numpy(np.int64)
            return pd.DataFrame(
                {
                    "doc_id": pd.array(s.keys[docs], dtype="Int64"),
                    "shard": np.full(len(docs), int(key[0])),
                    "doc": docs,
                    "n_tokens": s.offsets[docs + 1] - s.offsets[docs],
                    "ids_crc32": np.array([zlib.crc32(s.ids(i).astype("<u4").tobytes()) for i in docs.tolist()], np.int64),
                    "offset": s.offsets[docs],
                }
            )

        return at.groupBy("shard").applyInPandas(load, "doc_id long, shard long, doc long, n_tokens long, ids_crc32 long, offset long")

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """What ``read`` gives, for every document that has one of the keys, by way of the index.

        Documents that share a key lie in a row, from shard to shard.
        """
        order = self.shards.select("shard", "docs")
        hits = self.find(keys)
        # the first shard holds what it has of a run; the rest follows from document 0 of the next ones
        here = hits.join(order, "shard").withColumn("part_run", F.least("run", F.col("docs") - F.col("doc")))
        own = here.select("shard", F.explode(F.sequence("doc", F.col("doc") + F.col("part_run") - 1)).alias("doc"))
        over = here.where("run > part_run").select("doc_id", "shard")
        rest = self.placed.alias("p").join(over.select("doc_id", F.col("shard").alias("first")), "doc_id").where("shard > first").select("shard", "doc")
        return self.read(own.unionByName(rest))


def export(docs: DataFrame, end_id: int = 2, path: str | None = None, uri: str | None = None) -> Export:
    """Write the ids of every text of ``docs`` (doc_id long, text), each ended by ``end_id``, and the index.

    Null text counts as empty. Documents that share a doc_id, and those without, keep rows of their
    own, ordered by the text's hash; a null doc_id is in no index. No documents: no files.
    uri: a folder without files (an error else: files that are there stay, as a task that runs again needs).
    """
    spark = docs.sparkSession
    if uri and not empty_dir(uri):
        raise ValueError(f"{uri} holds files already")
    path, uri = path or default_path(), uri or new_dir(spark, "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = texts.repartitionByRange(max(partitions(docs), -(-plan_bytes(texts) // SHARD_BYTES)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    placed = stage(ranged.mapInArrow(_write_shards(uri, path, end_id), "shard long, doc long, doc_id long, n_tokens long"), "placed")
    place = F.col("shard") * F.lit(1 << 40) + F.col("doc")
    first = placed.where("doc_id is not null").groupBy("doc_id").agg(F.min(place).alias("place"), F.count("*").alias("run"))
    first = stage(first.select("doc_id", F.shiftright("place", 40).alias("shard"), (F.col("place") % (1 << 40)).alias("doc"), "run"), "keys")
    parts = max(1, -(-first.count() // PART_KEYS))
    out = Export(spark, uri, placed, parts)
    stage(first.withColumn("part", out.part()).groupBy("part").applyInPandas(_build_parts(uri), "part int, keys long"), "parts")
    return out


def exported(docs: DataFrame, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Export, then read every document back by key: (doc_id, start, n_tokens, ids_crc32).

    start: ids of all documents before it, in ascending doc_id order.
    """
    out = export(docs, end_id, path)
    read = out.read_keys(out.placed.select("doc_id"))
    read = read.unionByName(out.read(out.placed.where("doc_id is null").select("shard", "doc")).withColumn("doc_id", F.lit(None).cast("long")))
    # one row a shard, whatever the number of documents
    before = out.shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    return read.join(before, "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
