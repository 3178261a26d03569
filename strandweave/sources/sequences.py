"""FASTA and FASTQ files, plain, gzip or zstd, as rows of sequence chunks: a Python data source.

Rows: path, offset (of the chunk's first base in the file's bases, records being one ``N`` apart), seq (bases, the
next k - 1 with them), starts (window starts that the chunk owns). A chunk may span records: the ``N`` breaks windows.
A compressed file is one partition, read in bounded memory; a plain FASTA file is split by byte ranges, however long
its lines are. Compression is told by the first bytes, the format by the first non-blank byte.

Header lines longer than ``HEADER`` bytes aren't supported in split files.
"""

from __future__ import annotations

import io
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

READ = 1 << 20
HEADER = 1 << 16
#: Bytes of a plain FASTA file per partition, and window starts of a row.
SPLIT = 64 << 20
ROW = 1 << 16

# The first bytes of compressed files, and accepted names.
GZIP, ZSTD = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"
NAME = r"(?i)\.(fasta|fa|fna|fastq|fq)(\.(gz|zst))?$"
#: Growth that a survey assumes of compressed files, by name.
GROWTH = {".gz": 4, ".zst": 8}


def is_input_name(path: str | Column) -> Column:
    return (F.col(path) if isinstance(path, str) else path).rlike(NAME)


def detect(head: bytes) -> str:
    return "gzip" if head[:2] == GZIP else "zstd" if head[:4] == ZSTD else "plain"


def stem(path: str) -> str:
    """File name without its last extension only: a.fa.gz gives a.fa."""
    name = re.split(r"[/\\]", path)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def _open(path: str):
    from pyarrow import fs

    if "://" in path:
        filesystem, path = fs.FileSystem.from_uri(path)
    else:
        filesystem, path = fs.LocalFileSystem(), path.removeprefix("file:")
    return filesystem, path


def _pieces(path: str):
    """The decompressed bytes of a file, piece by piece; members and frames follow each other."""
    filesystem, path = _open(path)
    with filesystem.open_input_file(path) as f:
        head = f.read(4)
        f.seek(0)
        kind = detect(head)
        if kind == "zstd":
            import zstandard

            reader = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True)
            while piece := reader.read(READ):
                yield piece
        elif kind == "gzip":
            d = zlib.decompressobj(31)
            while piece := f.read(READ):
                while piece:
                    yield d.decompress(piece)
                    piece = b""
                    if d.eof:
                        # another member may follow; anything else after a member is ignored
                        rest = d.unused_data
                        if len(rest) < 2:
                            rest += f.read(2 - len(rest))
                        if rest[:2] != GZIP:
                            return
                        d, piece = zlib.decompressobj(31), rest
        else:
            while piece := f.read(READ):
                yield piece


def _lines(pieces):
    """(bytes of a line, whether it begins there, whether it ends there): long lines come in parts."""
    begins, held = True, b""
    for piece in pieces:
        parts = (held + piece).split(b"\n")
        for x in parts[:-1]:
            yield x, begins, True
            begins = True
        held = parts[-1]
        # keep what could be a split "\r\n", give out the rest of a long line
        if len(held) > HEADER:
            yield held[:-1], begins, False
            begins, held = False, held[-1:]
    if held:
        yield held, begins, True


def bases(pieces):
    """The bases of a FASTA or FASTQ stream in parts, records one ``N`` apart."""
    lines = _lines(pieces)
    first = next(((x, b, e) for x, b, e in lines if x.strip()), None)
    if first is None:
        return
    x, begins, ends = first
    mark = x.lstrip()[:1]
    if mark not in (b">", b"@"):
        raise ValueError("neither FASTA nor FASTQ: the first byte is neither '>' nor '@'")

    def rest():
        yield x.lstrip(), begins, ends
        yield from lines

    yield from (_fasta if mark == b">" else _fastq)(rest())


def _fasta(lines, header: bool = False, any_before: bool = False):
    for x, begins, ends in lines:
        if begins:
            header = x[:1] == b">"
            if header and any_before:
                yield b"N"
        if not header:
            x = x[:-1] if ends and x[-1:] == b"\r" else x
            any_before = any_before or bool(x)
            if x:
                yield x


def _fastq(lines):
    """Records of four lines each; the second holds the bases."""
    n, some = 0, False
    for x, begins, ends in lines:
        if n % 4 == 1:
            if begins and some:
                yield b"N"
            some = True
            yield x.translate(None, b"\r \t")
        n += ends


def chunked(parts, k: int, size: int, limit: int | None = None):
    """(offset, seq, starts) rows; ``limit``: bases whose windows belong to this stream, if more follow for overlap only."""
    held, offset = bytearray(), 0
    for part in parts:
        held += part
        while len(held) >= size + k - 1 and (limit is None or offset + size <= limit):
            yield offset, held[: size + k - 1].decode("latin-1"), size
            del held[:size]
            offset += size
        if limit is not None and len(held) >= limit - offset + k - 1:
            break
    own = len(held) - (k - 1) if limit is None else min(limit - offset, len(held) - (k - 1))
    if own > 0:
        yield offset, held[: own + k - 1].decode("latin-1"), own


class Range(InputPartition):
    def __init__(self, path: str, begin: int | None, end: int | None):
        self.path, self.begin, self.end = path, begin, end


class SequenceSource(DataSource):
    """Options: paths (one per line), k, row (window starts of a row), split (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return "path string, `range` long, offset long, seq string, starts int"

    def reader(self, schema):
        return SequenceReader(self.options)


class SequenceReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.k, self.row, self.split = int(options.get("k", 31)), int(options.get("row", ROW)), int(options.get("split", SPLIT))

    def partitions(self):
        out = []
        for path in self.paths:
            filesystem, local = _open(path)
            size = filesystem.get_file_info(local).size or 0
            if size <= self.split:
                out.append(Range(path, None, None))
                continue
            with filesystem.open_input_file(local) as f:
                head = f.read(HEADER)
            if detect(head) == "plain" and head.lstrip()[:1] == b">":
                out += [Range(path, a, min(size, a + self.split)) for a in range(0, size, self.split)]
            else:
                out.append(Range(path, None, None))
        return out

    def read(self, part: Range | None):
        if part is None:  # what Spark reads where there are no files
            return
        if part.begin is None:
            for offset, seq, starts in chunked(bases(_pieces(part.path)), self.k, self.row):
                yield part.path, 0, offset, seq, starts
            return
        filesystem, local = _open(part.path)
        with filesystem.open_input_file(local) as f:
            yield from self._read_range(part, f)

    def _read_range(self, part: Range, f):
        """The windows whose first byte is in the range. Bases before it only tell whether an ``N`` is due."""
        back = min(part.begin, HEADER)
        f.seek(part.begin - back)
        before = f.read(back)
        line = before.rfind(b"\n") + 1
        at_line = part.begin == 0 or line == len(before)
        header = not at_line and before[line : line + 1] == b">" and (line > 0 or back == part.begin)
        own = io.BytesIO()  # how many bases the range itself holds
        del own

        def pieces(end):
            f.seek(part.begin)
            left = end - part.begin
            while left > 0 and (piece := f.read(min(READ, left))):
                left -= len(piece)
                yield piece

        def parts(end):
            lines = _lines(pieces(end))
            if not at_line:
                first = next(lines, None)
                if first is None:
                    return
                yield from _fasta(_first(first, lines), header, True)
            else:
                yield from _fasta(lines, False, part.begin > 0)

        def _first(first, rest):
            yield first[0], False, first[2]
            yield from rest

        limit = sum(len(x) for x in parts(part.end))
        f.seek(0, 2)
        for offset, seq, starts in chunked(parts(f.tell()), self.k, self.row, limit):
            yield part.path, part.begin, offset, seq, starts


def read_sequences(spark: SparkSession, paths, k: int = 31, row: int = ROW, split: int = SPLIT) -> DataFrame:
    """(path, range, offset, seq, starts); ``offset`` counts from the start of the byte range (0 for a whole file)."""
    paths = [paths] if isinstance(paths, str) else [str(p) for p in paths]
    spark.dataSource.register(SequenceSource)
    return spark.read.format("sequences").option("paths", "\n".join(paths)).option("k", k).option("row", row).option("split", split).load()


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    """One path a line; trailing blanks, empty lines and lines that start with # don't count."""
    line = F.rtrim(F.regexp_replace("value", r"[\s]+$", ""))
    return [r[0] for r in spark.read.text(path).select(line.alias("p")).where("p != '' and not startswith(p, '#')").collect()]


def survey(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """One row: n, median (the upper one), largest, total of the sizes, compressed ones by what they grow to."""
    grown = F.col(size).cast("bigint")
    for suffix, by in GROWTH.items():
        grown = F.when(F.lower(path).endswith(suffix), F.col(size).cast("bigint") * by).otherwise(grown)
    own = files.select(grown.alias("s"))
    n = own.count()
    # the upper median by rank: the (n div 2 + 1)-th smallest, found without one global sort; half a rank less keeps rounding from the next one
    median = own.agg(F.expr(f"percentile_disc({(n // 2 + 0.5) / max(n, 1)}D) within group (order by s)").cast("bigint").alias("median"))
    return own.agg(F.count("*").alias("n"), F.max("s").alias("largest"), F.coalesce(F.sum("s"), F.lit(0)).alias("total")).crossJoin(median).select("n", "median", "largest", "total")


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(n, keys) of lines of two numbers apart by blanks."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("bigint").alias("n"), parts[1].cast("bigint").alias("keys"))
