"""BAM and SAM files as Spark data sources: format "bam" and "sam", to read and to write.

One task reads one file: a record's bam_offset is its place among all records of its file, excluded ones counted, which
needs the file from its start. Many files make many tasks. Records travel as Arrow batches. Register with
`register(spark)`, then spark.read.format("bam").load("folder/*.bam"); columns as in reads_raw, source_file_id being the
place of the path in sorted order. aux has the form of BAM files in both formats. Written folders hold one file per task,
with a header made of the `contigs` option. Paths may be local or of any file system that pyarrow reaches (hdfs, s3, gs);
on a cluster all hosts must see them. CRAM files are refused: their codecs aren't implemented.
"""

from __future__ import annotations

import fnmatch
import io
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = (
    "qname string, flag bigint, chrom string, pos bigint, mapq bigint, cigar string, seq string, qual array<int>, aux binary, "
    "source_file_id bigint, bam_offset bigint"
)
_ARROW = pa.schema(
    [("qname", pa.string()), ("flag", pa.int64()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int64()), ("cigar", pa.string()), ("seq", pa.string()),
     ("qual", pa.list_(pa.int32())), ("aux", pa.binary()), ("source_file_id", pa.int64()), ("bam_offset", pa.int64())]
)
BATCH = 4096
_BASES = "=ACMGRSVTWYHKDBN"  # fixed by the format
_OPS = "MIDNSHP=X"
#: A header line; read names may begin with '@' too.
_HEADER = re.compile(r"@[A-Z]{2}(?:\t|\s*$)")
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def open_input(path: str):
    system, inner = _system(path)
    return system.open_input_stream(inner, compression=None)


def files_of(paths: str) -> list[str]:
    """The files of comma-separated paths, patterns and folders (their *.bam and *.sam), sorted."""
    out = set()
    for given in paths.split(","):
        system, inner = _system(given)
        prefix = given[: len(given) - len(inner)] if given.endswith(inner) and "://" in given else ""
        if re.search(r"[*?\[]", inner):
            folder = re.split(r"[*?\[]", inner)[0].rpartition("/")[0] or "/"
            listed = system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
            out |= {prefix + f.path for f in listed if f.is_file and fnmatch.fnmatch(f.path, inner) and f.path.count("/") == inner.count("/")}
        elif system.get_file_info(inner).type == fs.FileType.Directory:
            out |= {prefix + f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and f.path.endswith(("bam", "sam"))}
        elif system.get_file_info(inner).type == fs.FileType.File:
            out.add(prefix + inner)
    return sorted(out)


def inflate(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a file of concatenated gzip members."""
    with open_input(path) as f:
        unzip, rest = zlib.decompressobj(31), b""
        while data := rest or f.read(size):
            rest = b""
            yield unzip.decompress(data)
            if unzip.eof:
                rest, unzip = unzip.unused_data, zlib.decompressobj(31)


class _Stream:
    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held, self.at = parts, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            more = next(self.parts, None)
            if more is None:
                raise EOFError
            self.held, self.at = self.held[self.at :] + more, 0
        out = self.held[self.at : self.at + n]
        self.at += n
        return out

    def int32(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def read_header(stream: _Stream) -> tuple[str, list[tuple[str, int]]]:
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = stream.take(stream.int32()).rstrip(b"\0").decode(errors="replace")
    contigs = [(stream.take(stream.int32())[:-1].decode(), stream.int32()) for _ in range(stream.int32())]
    return text, contigs


def _lines(path: str) -> Iterator[str]:
    with open_input(path) as f:
        yield from io.TextIOWrapper(f, encoding="utf-8", errors="replace", newline="\n")


def header_bytes(path: str) -> bytes:
    """A file's header as it stands: the text of a BAM header, or the lines of a SAM file that begin with '@'."""
    if path.endswith("bam"):
        return read_header(_Stream(inflate(path)))[0].encode()
    return "".join(itertools.takewhile(_HEADER.match, _lines(path))).encode()


def header_contigs(path: str) -> list[tuple[str, int]]:
    """(name, length) of every contig that a file's header names, with or without reads."""
    if path.endswith("bam"):
        return read_header(_Stream(inflate(path)))[1]
    fields = [dict(x.split(":", 1) for x in line.rstrip().split("\t")[1:] if ":" in x) for line in header_bytes(path).decode().splitlines() if line.startswith("@SQ")]
    return [(x["SN"], int(x.get("LN", 0))) for x in fields if "SN" in x]


#: Letters of the number types of tags, and how they are stored. Fixed by the format.
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def aux_text(aux: bytes | None) -> list[str]:
    """The tags of a BAM record as SAM fields."""
    data, at, out = bytes(aux or b""), 0, []
    try:
        while at < len(data):
            tag, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
            if kind == "A":
                value, at = chr(data[at]), at + 1
            elif kind in _NUMBERS:
                (number,) = struct.unpack_from("<" + _NUMBERS[kind], data, at)
                at += struct.calcsize(_NUMBERS[kind])
                kind, value = ("f", f"{number:.9g}") if kind == "f" else ("i", str(number))
            elif kind in "ZH":
                end = data.index(0, at)
                value, at = data[at:end].decode(), end + 1
            elif kind == "B":
                sub, (n,) = chr(data[at]), struct.unpack_from("<I", data, at + 1)
                numbers = struct.unpack_from(f"<{n}{_NUMBERS[sub]}", data, at + 5)
                at += 5 + n * struct.calcsize(_NUMBERS[sub])
                value = ",".join([sub, *(f"{x:.9g}" if sub == "f" else str(x) for x in numbers)])
            else:
                raise ValueError(kind)
            out.append(f"{tag}:{kind}:{value}")
    except (IndexError, KeyError, ValueError, struct.error) as e:
        raise ValueError(f"aux is no list of tags: {data[:40].hex()}") from e
    return out


def aux_bytes(fields: list[str]) -> bytes:
    """SAM tag fields as in a BAM record; whole numbers take 32 bits."""
    out = bytearray()
    for field in fields:
        tag, kind, value = field.split(":", 2)
        out += tag.encode()
        if kind == "A":
            out += b"A" + value.encode()[:1]
        elif kind == "i":
            number = int(value)
            out += struct.pack("<ci", b"i", number) if number < 1 << 31 else struct.pack("<cI", b"I", number)
        elif kind == "f":
            out += struct.pack("<cf", b"f", float(value))
        elif kind in "ZH":
            out += kind.encode() + value.encode() + b"\0"
        elif kind == "B":
            sub, *numbers = value.split(",")
            out += b"B" + sub.encode() + struct.pack(f"<I{len(numbers)}{_NUMBERS[sub]}", len(numbers), *[float(x) if sub == "f" else int(x) for x in numbers])
        else:
            raise ValueError(f"tag {field[:40]}")
    return bytes(out)


def bam_records(path: str) -> Iterator[tuple]:
    """The first nine columns of every record, in file order."""
    stream = _Stream(inflate(path))
    names = [n for n, _ in read_header(stream)[1]]
    while True:
        try:
            data = stream.take(stream.int32())
        except EOFError:
            return
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", data)
        at = 32 + l_name
        qname = data[32 : at - 1].decode()
        ops = struct.unpack_from(f"<{n_cigar}I", data, at)
        at += 4 * n_cigar
        packed = data[at : at + (l_seq + 1) // 2]
        at += len(packed)
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
        qual = list(data[at : at + l_seq])
        cigar = "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops)
        yield qname, flag, names[ref] if 0 <= ref < len(names) else None, pos + 1, mapq, cigar or "*", seq or "*", qual, data[at + l_seq :]


def sam_records(path: str) -> Iterator[tuple]:
    for line in itertools.dropwhile(_HEADER.match, _lines(path)):
        if not line.strip():
            continue
        x = line.rstrip("\r\n").split("\t")
        qual = [ord(c) - 33 for c in x[10]] if x[10] != "*" else [255] * (len(x[9]) if x[9] != "*" else 0)
        yield x[0], int(x[1]), None if x[2] == "*" else x[2], int(x[3]), int(x[4]), x[5], x[9], qual, aux_bytes(x[11:])


class _Reader(DataSourceReader):
    def __init__(self, options: dict, records):
        self.paths = files_of(options["path"])
        self.records = records
        if bad := [p for p in self.paths if p.endswith(".cram")]:
            raise ValueError(f"CRAM files can't be read: {bad[0]}")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.paths))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        rows = []
        for n, record in enumerate(self.records(self.paths[partition.value])):
            rows.append((*record, partition.value, n))
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def bgzf(data: bytes) -> bytes:
    """Gzip members of at most 64 KB that carry their size, as the format asks for."""
    out = bytearray()
    for i in range(0, len(data), 60_000):
        part = data[i : i + 60_000]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body
        out += struct.pack("<II", zlib.crc32(part), len(part))
    return bytes(out)


def _sam_header(contigs: list) -> str:
    return "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{length}\n" for n, length in contigs)


def bam_header(contigs: list) -> bytes:
    text = _sam_header(contigs).encode()
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    for name, length in contigs:
        raw = name.encode() + b"\0"
        out += struct.pack("<i", len(raw)) + raw + struct.pack("<i", length)
    return out


def bam_record(row: dict, ids: dict[str, int]) -> bytes:
    ops = [(int(n) << 4) | _OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    seq = "" if row["seq"] in (None, "*") else row["seq"].upper()
    codes = [max(_BASES.find(c), 0) if c in _BASES else 15 for c in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    qual = [255 if q is None else q & 255 for q in row["qual"] or []]
    name = (row["qname"] or "*").encode() + b"\0"
    if len(name) > 255 or len(qual) > len(seq):
        raise ValueError(f"read {row['qname']}: a name takes at most 254 bytes, and there are at most as many qualities as bases")
    body = struct.pack("<iiBBHHHiiii", ids.get(row["chrom"], -1), (row["pos"] or 0) - 1, len(name), row["mapq"] if row["mapq"] is not None else 255, 0, len(ops), row["flag"], len(seq), -1, -1, 0)
    body += name + struct.pack(f"<{len(ops)}I", *ops) + packed + bytes(qual + [255] * (len(seq) - len(qual))) + bytes(row["aux"] or b"")
    return struct.pack("<i", len(body)) + body


def sam_line(row: dict) -> str:
    qual = "".join(chr(33 + min(q, 93)) for q in row["qual"]) if row["qual"] and not all(q == 255 for q in row["qual"]) else "*"
    fields = [row["qname"] or "*", row["flag"], row["chrom"] or "*", row["pos"] or 0, 255 if row["mapq"] is None else row["mapq"], row["cigar"] or "*", "*", 0, 0, row["seq"] or "*", qual, *aux_text(row["aux"])]
    return "\t".join(map(str, fields)) + "\n"


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool, kind: str):
        self.folder = options["path"].rstrip("/")
        self.contigs = json.loads(options.get("contigs", "[]"))
        self.kind, self.overwrite, self.run = kind, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, folder = _system(self.folder)
        system.create_dir(folder, recursive=True)
        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId():05d}-{self.run[:8]}.{self.kind}"
        draft = f"{path}.{context.taskAttemptId()}.tmp"
        with system.open_output_stream(draft) as f:
            if self.kind == "bam":
                ids = {n: i for i, (n, _) in enumerate(self.contigs)}
                f.write(bgzf(bam_header(self.contigs)))
                held = bytearray()
                for row in rows:
                    held += bam_record(row.asDict(), ids)
                    if len(held) > 1 << 20:
                        f.write(bgzf(bytes(held)))
                        held.clear()
                f.write(bgzf(bytes(held)) + _END)
            else:
                f.write(_sam_header(self.contigs).encode())
                for row in rows:
                    f.write(sam_line(row.asDict()).encode())
        system.move(draft, path)
        return WriterCommitMessage()

    def _parts(self) -> list[tuple[fs.FileSystem, str]]:
        system, folder = _system(self.folder)
        return [(system, x.path) for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if os.path.basename(x.path).startswith("part-")]

    def commit(self, messages: list) -> None:
        for system, path in self._parts():
            if path.endswith(".tmp") and self.run[:8] in path or self.overwrite and path.endswith(f".{self.kind}") and self.run[:8] not in path:
                system.delete_file(path)

    def abort(self, messages: list) -> None:
        for system, path in self._parts():
            if self.run[:8] in path:
                system.delete_file(path)


class BamSource(DataSource):
    kind, records = "bam", staticmethod(bam_records)

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, type(self).records)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite, self.kind)


class SamSource(BamSource):
    kind, records = "sam", staticmethod(sam_records)


def register(spark: SparkSession) -> None:
    for source in (BamSource, SamSource):
        spark.dataSource.register(source)
