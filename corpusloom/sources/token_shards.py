"""Data source ``token_shards``: binary files of token ids.

A file is a header of 256 little-endian int32 values, eight of them used,
then its tokens as uint16.

Writing takes rows (shard_index, name, shard_tokens, start, tokens), all rows
of a shard in one partition and in order; see ``write_shards``.

Writing ends with a new manifest (``sources.manifest``), the one step that changes
what readers see; nothing is replaced in place.

Reading has these modes:

* ``headers``: one row per file;
* ``tokens``: chunks (split, shard_index, name, start, split_start, tokens) of
  long files, read in ranges; ``start`` counts from the shard's first token,
  ``split_start`` from the split's;
* ``windows``: fixed-length windows over all files of a split, (epoch,
  seq_idx, input_ids). File sizes tell where each window lies, so no shuffle
  is needed;
* ``ordered``: windows with ``pos``, their place in the epoch's keyed order
  (``operators.bijection``), which is known before a token is read.

Comparisons of the split, the shard number and the window index are pushed into
the reader, which then opens no other files; of the windows of an order, those
whose ``pos`` is compared away are skipped.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from corpusloom.config import (
    HEADER_BYTES,
    HEADER_INTS,
    MAX_SHARD_TOKENS,
    MAX_TOKEN_ID,
    SHARD_MAGIC,
    SHARD_PREFIX,
    SHARD_VERSION,
    TokenIdentity,
    WindowConfig,
)
from corpusloom.operators.bijection import Bijection
from corpusloom.session import ship_package
from corpusloom.sources.manifest import Entry, GenerationTaken, Manifest, expire, generations, located, put_manifest, read_manifest

FORMAT = "token_shards"
HEADER_FIELDS = ("magic", "version", "token_count", "vocab_size", "pad_id", "cls_id", "sep_id", "mask_id")

# Tokens that one task reads: 128 MB as INT, less if there are cores to spare.
MAX_PARTITION_TOKENS = 1 << 25
MIN_PARTITION_TOKENS = 1 << 16

COMMIT_THREADS = 32
# How often a commit that another writer came before is tried again.
COMMIT_TRIES = 20

SCHEMAS = {
    "headers": "split string, shard_index int, name string, path string, file_bytes bigint, header struct<"
    + ",".join(f"{f}:int" for f in HEADER_FIELDS)
    + ">",
    "tokens": "split string, shard_index int, name string, start bigint, split_start bigint, tokens array<int>",
    "windows": "epoch int, seq_idx bigint, input_ids array<int>",
    "ordered": "epoch int, seq_idx bigint, pos bigint, input_ids array<int>",
}


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark means it: one without a scheme lies in the default file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a qualified path, or of a local one without a scheme."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return pafs.LocalFileSystem(), re.sub(r"^/+", "/", rest) if colon and scheme == "file" else path
    if scheme == "dbfs":
        return pafs.LocalFileSystem(), re.sub(r"^/*", "/dbfs/", rest)
    if scheme in ("s3a", "s3n"):
        return pafs.FileSystem.from_uri(f"s3:{rest}")
    return pafs.FileSystem.from_uri(path)


@dataclass
class ShardFile:
    split: str
    shard_index: int
    name: str
    path: str
    size: int
    crc32: int | None = None

    @property
    def token_count(self) -> int:
        """As the size tells; reading a file checks its header against it."""
        return max(self.size - HEADER_BYTES, 0) // 2


def listed(fs: pafs.FileSystem, root: str, prefix: str) -> Manifest:
    """What a folder without a manifest holds, as generation 0."""
    pattern = re.compile(rf"^{re.escape(prefix)}_[^_]+_\d+\.bin$")
    found = {}
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if pattern.match(info.base_name) and info.type == pafs.FileType.File:
                found[info.base_name] = Entry(info.base_name, info.base_name, info.size)
    return Manifest(0, found)


def current(folder: str, prefix: str = SHARD_PREFIX) -> Manifest:
    """The folder's newest generation."""
    fs, root = filesystem(folder)
    return read_manifest(fs, root, prefix) or listed(fs, root, prefix)


def list_shards(
    folder: str, split: str | None = None, prefix: str = SHARD_PREFIX, manifest: Manifest | None = None
) -> list[ShardFile]:
    """The shards of the newest generation, or of the one given, in name order; no shard is opened."""
    fs, root = filesystem(folder)
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"The shard folder was not found: {folder}")
    pattern = re.compile(rf"^{re.escape(prefix)}_({re.escape(split) if split else '[^_]+'})_(\d+)\.bin$")
    shards = []
    for entry in (manifest or current(folder, prefix)).shards.values():
        match = pattern.match(entry.name)
        if match:
            path = located(root, prefix, entry.path)
            shards.append(ShardFile(match[1], int(match[2]), entry.name, path, entry.size, entry.crc32))
    if not shards:
        raise FileNotFoundError(f"No shards of prefix {prefix!r} and split {split or 'any'!r} in {folder}")
    return sorted(shards, key=lambda s: (s.split, s.shard_index, s.name))


def check_contiguous(shards: list[ShardFile]) -> None:
    """A split's shards carry numbers in a row, so that two corpora in one folder don't pass for one."""
    for before, after in zip(shards, shards[1:]):
        if before.split == after.split and after.shard_index != before.shard_index + 1:
            raise ValueError(f"Shards {before.name} and {after.name} aren't numbered in a row")


def read_header(fs: pafs.FileSystem, shard: ShardFile) -> dict[str, int]:
    with fs.open_input_file(shard.path) as f:
        raw = f.read(HEADER_BYTES)
    if len(raw) < HEADER_BYTES:
        raise ValueError(f"Header of {shard.path} is incomplete: {len(raw)} bytes")
    return dict(zip(HEADER_FIELDS, np.frombuffer(raw, "<i4", len(HEADER_FIELDS)).tolist()))


def check_header(shard: ShardFile, header: dict[str, int]) -> None:
    found = (header["magic"], header["version"])
    if found != (SHARD_MAGIC, SHARD_VERSION):
        raise ValueError(f"{shard.path} isn't a shard that can be read: magic and version are {found}")
    tokens = (shard.size - HEADER_BYTES) / 2
    if tokens != header["token_count"]:
        raise ValueError(f"The file size of {shard.path} makes {tokens:g} tokens, its header says {header['token_count']}")


@dataclass
class FilesPartition(InputPartition):
    files: list[ShardFile]


@dataclass
class RangePartition(InputPartition):
    """A part of a shard; ``base`` is the shard's place in its split's stream."""

    shard: ShardFile
    base: int
    begin: int
    end: int


@dataclass
class WindowPartition(InputPartition):
    """Windows from ``first`` on of the split's ``total``, and the parts of shards that they lie in."""

    first: int
    count: int
    segments: list[tuple[ShardFile, int, int]]
    total: int


# The range of whole numbers that a comparison leaves.
_RANGES = {
    EqualTo: lambda v: (v, v),
    GreaterThan: lambda v: (v + 1, math.inf),
    GreaterThanOrEqual: lambda v: (v, math.inf),
    LessThan: lambda v: (-math.inf, v - 1),
    LessThanOrEqual: lambda v: (-math.inf, v),
    In: lambda vs: (min(vs), max(vs)),
}


class ShardReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.mode = options.get("mode", "tokens")
        self.split = options.get("split")
        self.prefix = options.get("prefix", SHARD_PREFIX)
        self.chunk = int(options.get("chunkTokens", 1 << 16))
        self.per_task = max(int(options.get("partitionTokens", MAX_PARTITION_TOKENS)), 1)
        self.epoch = int(options.get("epoch", 0))
        self.check = options.get("validate", "true").lower() == "true"
        self.first = int(options["firstWindow"]) if "firstWindow" in options else None
        self.last = int(options["lastWindow"]) if "lastWindow" in options else None
        self.window = WindowConfig(
            int(options.get("seqLength", 512)),
            options.get("strategy", "fixed"),
            int(options.get("phases", 4)),
        )

        self.order_seed = int(options.get("orderSeed", 0))
        self.order_hash = options.get("orderHash", "xxhash64")
        self.only: dict[str, tuple[float, float]] = {}
        self.only_split: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Ranges of shard numbers or windows and the split's name prune what is read; Spark still applies them."""
        for f in filters:
            yield f
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "split" and isinstance(f, EqualTo):
                self.only_split = f.value
            elif column in ("shard_index", "seq_idx", "pos") and type(f) in _RANGES:
                low, high = _RANGES[type(f)](f.value)
                before = self.only.get(column, (-math.inf, math.inf))
                self.only[column] = (max(low, before[0]), min(high, before[1]))

    def _wanted(self, shard: ShardFile) -> bool:
        low, high = self.only.get("shard_index", (-math.inf, math.inf))
        return low <= shard.shard_index <= high and self.only_split in (None, shard.split)

    def partitions(self) -> list[InputPartition]:
        shards = list_shards(self.folder, self.split, self.prefix)
        check_contiguous(shards)
        if self.mode not in ("windows", "ordered"):
            bases: dict[str, int] = {}
            placed = []
            for shard in shards:
                placed.append((shard, bases.get(shard.split, 0)))
                bases[shard.split] = placed[-1][1] + shard.token_count
            placed = [x for x in placed if self._wanted(x[0])]
            shards = [shard for shard, _ in placed]
        if self.mode == "headers":
            return [FilesPartition(shards[i : i + 64]) for i in range(0, len(shards), 64)] or [FilesPartition([])]
        if self.mode == "tokens":
            step = -(-self.per_task // self.chunk) * self.chunk
            return [
                RangePartition(s, base, begin, min(begin + step, s.token_count))
                for s, base in placed
                for begin in range(0, s.token_count, step)
            ] or [FilesPartition([])]
        return self._window_partitions(shards)

    def _window_partitions(self, shards: list[ShardFile]) -> list[InputPartition]:
        length, offset = self.window.max_seq_length, self.window.offset(self.epoch)
        total = sum(s.token_count for s in shards)
        count = max(total - offset, 0) // length
        low, high = self.only.get("seq_idx", (-math.inf, math.inf))
        first = int(max(self.first or 0, low, 0))
        last = int(min(count if self.last is None else self.last, count, high + 1))
        step = max(self.per_task // length, 1)
        tasks = [WindowPartition(i, min(step, last - i), [], count) for i in range(first, last, step)]
        task, base = 0, 0
        for shard in shards:
            end = base + shard.token_count
            while task < len(tasks):
                begin = offset + tasks[task].first * length
                stop = begin + tasks[task].count * length
                if max(begin, base) < min(stop, end):
                    tasks[task].segments.append((shard, max(begin, base) - base, min(stop, end) - base))
                if stop > end:
                    break
                task += 1
            base = end
        return tasks or [FilesPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.folder)
        if isinstance(partition, FilesPartition):
            if partition.files:
                yield self._headers(fs, partition.files)
        elif isinstance(partition, RangePartition):
            yield from self._chunks(fs, partition)
        elif self.mode == "ordered":
            yield from self._ordered(fs, partition)
        else:
            yield from self._windows(fs, partition)

    def _headers(self, fs: pafs.FileSystem, files: list[ShardFile]) -> pa.RecordBatch:
        headers = []
        for shard in files:
            header = read_header(fs, shard)
            if self.check:
                check_header(shard, header)
            headers.append(header)
        fields = pa.struct([(f, pa.int32()) for f in HEADER_FIELDS])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([s.split for s in files]),
                pa.array([s.shard_index for s in files], pa.int32()),
                pa.array([s.name for s in files]),
                pa.array([s.path for s in files]),
                pa.array([s.size for s in files], pa.int64()),
                pa.array(headers, fields),
            ],
            names=["split", "shard_index", "name", "path", "file_bytes", "header"],
        )

    def _blocks(
        self, fs: pafs.FileSystem, shard: ShardFile, begin: int, end: int, block: int
    ) -> Iterator[np.ndarray]:
        check_header(shard, read_header(fs, shard))
        with fs.open_input_file(shard.path) as f:
            for at in range(begin, end, block):
                n = min(block, end - at)
                yield np.frombuffer(f.read_at(2 * n, HEADER_BYTES + 2 * at), "<u2").astype(np.int32)

    def _chunks(self, fs: pafs.FileSystem, part: RangePartition) -> Iterator[pa.RecordBatch]:
        at = part.begin
        for tokens in self._blocks(fs, part.shard, part.begin, part.end, self.chunk):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.shard.split]),
                    pa.array([part.shard.shard_index], pa.int32()),
                    pa.array([part.shard.name]),
                    pa.array([at], pa.int64()),
                    pa.array([part.base + at], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), pa.array(tokens)),
                ],
                names=["split", "shard_index", "name", "start", "split_start", "tokens"],
            )
            at += len(tokens)

    def _windows(self, fs: pafs.FileSystem, part: WindowPartition) -> Iterator[pa.RecordBatch]:
        length = self.window.max_seq_length
        block = max(1, (1 << 20) // length) * length
        seq_idx, rest = part.first, np.empty(0, np.int32)
        for shard, begin, end in part.segments:
            for tokens in self._blocks(fs, shard, begin, end, block):
                rest = np.concatenate([rest, tokens])
                n = len(rest) // length
                if n:
                    ids, rest = rest[: n * length], rest[n * length :]
                    offsets = pa.array(np.arange(n + 1) * length, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, self.epoch), pa.int32()),
                            pa.array(np.arange(seq_idx, seq_idx + n), pa.int64()),
                            pa.ListArray.from_arrays(offsets, pa.array(ids)),
                        ],
                        names=["epoch", "seq_idx", "input_ids"],
                    )
                    seq_idx += n


    def _ordered(self, fs: pafs.FileSystem, part: WindowPartition) -> Iterator[pa.RecordBatch]:
        """Windows with their place in the epoch; those whose place is compared away aren't read."""
        length = self.window.max_seq_length
        order = Bijection(part.total, self.order_seed, self.epoch, self.order_hash)
        low, high = self.only.get("pos", (-math.inf, math.inf))
        ends = np.cumsum([end - begin for _, begin, end in part.segments])
        block = max(1, (1 << 20) // length)
        with ExitStack() as files:
            opened: dict[int, pa.NativeFile] = {}

            def tokens(begin: int, end: int) -> np.ndarray:
                """Tokens [begin, end), counted from the partition's first."""
                found = []
                for k in range(int(np.searchsorted(ends, begin, "right")), len(ends)):
                    shard, first, last = part.segments[k]
                    before = int(ends[k]) - (last - first)
                    if before >= end:
                        break
                    if k not in opened:
                        check_header(shard, read_header(fs, shard))
                        opened[k] = files.enter_context(fs.open_input_file(shard.path))
                    a, b = first + max(begin - before, 0), first + min(end - before, last - first)
                    found.append(np.frombuffer(opened[k].read_at(2 * (b - a), HEADER_BYTES + 2 * a), "<u2"))
                return np.concatenate(found).astype(np.int32)

            for at in range(0, part.count, block):
                places = np.arange(at, min(at + block, part.count))
                pos = order.positions(part.first + places)
                left = (pos >= low) & (pos <= high)
                places, pos = places[left], pos[left]
                if not len(places):
                    continue
                # Neighbours are read together.
                runs = np.split(places, np.flatnonzero(np.diff(places) > 1) + 1)
                ids = np.concatenate([tokens(int(r[0]) * length, (int(r[-1]) + 1) * length) for r in runs])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(places), self.epoch), pa.int32()),
                        pa.array(part.first + places),
                        pa.array(pos),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1) * length, pa.int32()), pa.array(ids)),
                    ],
                    names=["epoch", "seq_idx", "pos", "input_ids"],
                )


@dataclass
class WrittenShards(WriterCommitMessage):
    """Shard name, its file in the staging folder, size and checksum of each shard."""

    shards: list[tuple[str, str, int, int]]


class _Summed:
    """An output stream that keeps size and checksum of what went through."""

    def __init__(self, out: pa.NativeFile) -> None:
        self.out, self.size, self.crc32 = out, 0, 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.crc32 = zlib.crc32(data, self.crc32)

    def close(self) -> None:
        self.out.close()


class ShardWriter(DataSourceArrowWriter):
    """Tasks write whole shards into a folder of their own; the commit adds a manifest that names them.

    With ``flat`` a shard whose name is free moves up into the shard folder, as
    other tools expect it; a move is a copy in object stores, so it can be left out.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder = options["path"]
        self.overwrite = overwrite
        self.prefix = options.get("prefix", SHARD_PREFIX)
        self.flat = options.get("flat", "true").lower() == "true"
        self.header = [int(options[f]) for f in ("vocab_size", "pad_id", "cls_id", "sep_id", "mask_id")]
        self.staging = f"@/{uuid.uuid4().hex}"

    def _open(self, fs: pafs.FileSystem, root: str, name: str, token_count: int):
        if not 0 < token_count <= MAX_SHARD_TOKENS:
            raise ValueError(f"Token count {token_count} of {name} doesn't fit the header")
        header = np.zeros(HEADER_INTS, "<i4")
        header[: len(HEADER_FIELDS)] = [SHARD_MAGIC, SHARD_VERSION, token_count, *self.header]
        unique = f"{name}.{uuid.uuid4().hex}"
        out = _Summed(fs.open_output_stream(f"{located(root, self.prefix, self.staging)}/{unique}"))
        out.write(header.tobytes())
        return unique, out

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenShards:
        fs, root = filesystem(self.folder)
        fs.create_dir(located(root, self.prefix, self.staging), recursive=True)
        done: list[tuple[str, str, int, int]] = []
        name, unique, out, at, expected = None, None, None, 0, 0

        def finish() -> None:
            if out is not None:
                out.close()
                if at != expected:
                    raise ValueError(f"Shard {name} has {at} of its {expected} tokens in this partition")
                done.append((name, unique, out.size, out.crc32))

        for batch in iterator:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rows = batch.num_rows
            if not rows:
                continue
            index = cols["shard_index"].to_numpy()
            tokens = cols["tokens"]
            sizes, starts = np.diff(tokens.offsets.to_numpy()).astype(np.int64), cols["start"].to_numpy()
            ids = tokens.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            if len(ids) and not (ids.min() >= 0 and ids.max() <= MAX_TOKEN_ID):
                raise ValueError("Tokens must fit in uint16, some don't")
            # Rows of one shard lie together: a run is checked and written at once.
            borders = np.concatenate(([0], np.flatnonzero(index[1:] != index[:-1]) + 1, [rows]))
            for first, stop in zip(borders[:-1].tolist(), borders[1:].tolist()):
                row_name = cols["name"][first].as_py()
                if row_name != name:
                    finish()
                    name, at, expected = row_name, 0, cols["shard_tokens"][first].as_py()
                    unique, out = self._open(fs, root, name, expected)
                begin = ends[first] - sizes[first]
                wrong = np.flatnonzero(starts[first:stop] != at + ends[first:stop] - sizes[first:stop] - begin)
                if len(wrong):
                    raise ValueError(f"Shard {name} lacks tokens before {starts[first + wrong[0]]} in this partition")
                out.write(ids[begin : ends[stop - 1]].astype("<u2").tobytes())
                at += int(ends[stop - 1] - begin)
        finish()
        return WrittenShards(done)

    def commit(self, messages: list[WrittenShards | None]) -> None:
        fs, root = filesystem(self.folder)
        fs.create_dir(root, recursive=True)
        written = [x for m in messages if m is not None for x in m.shards]
        if len({name for name, *_ in written}) != len(written):
            self.abort(messages)
            raise ValueError("A shard was written by more than one task")
        if read_manifest(fs, root, self.prefix) is None:
            # From here on the listing doesn't count, so files may arrive one by one.
            try:
                put_manifest(fs, root, self.prefix, listed(fs, root, self.prefix))
            except GenerationTaken:
                pass

        def place(shard: tuple[str, str, int, int]) -> Entry:
            name, unique, size, crc32 = shard
            path = f"{self.staging}/{unique}"
            if self.flat and fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                fs.move(located(root, self.prefix, path), f"{root}/{name}")
                path = name
            return Entry(name, path, size, crc32)

        with ThreadPoolExecutor(COMMIT_THREADS) as pool:
            placed = list(pool.map(place, written))
        for _ in range(COMMIT_TRIES):
            before = read_manifest(fs, root, self.prefix)
            shards = {} if self.overwrite else dict(before.shards)
            shards |= {e.name: e for e in placed}
            try:
                put_manifest(fs, root, self.prefix, Manifest(before.generation + 1, shards))
                break
            except GenerationTaken:
                continue
        else:
            raise RuntimeError(f"{self.folder} is being written by others: no generation was free in {COMMIT_TRIES} tries")
        expire(fs, root, self.prefix)
        if not any(e.path.startswith("@/") for e in placed):
            self._clean(fs, root)

    def abort(self, messages: list[WrittenShards | None]) -> None:
        self._clean(*filesystem(self.folder))

    def _clean(self, fs: pafs.FileSystem, root: str) -> None:
        staging = located(root, self.prefix, self.staging)
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        mode = self.options.get("mode", "tokens")
        if mode not in SCHEMAS:
            raise ValueError(f"Unknown mode {mode!r}. Available: {list(SCHEMAS)}")
        return SCHEMAS[mode]

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenShards)


def write_shards(
    shard_pieces: DataFrame, folder: str, identity: TokenIdentity, prefix: str = SHARD_PREFIX, mode: str = "append",
    partitions: int | None = None, placed: bool = False,
) -> None:
    """Writes ``shard_pieces`` of ``operators.stream``, one file per shard, each by one task.

    ``placed`` says that each shard already is in one partition and in order.
    ``mode`` "append" adds shards to those of the folder, "overwrite" leaves the
    new ones only, and "error" refuses a folder that holds shards of the prefix.
    """
    spark = shard_pieces.sparkSession
    register(spark)
    folder = qualified(spark, folder)
    if mode == "error":
        refuse_shards(folder, prefix)
        mode = "append"
    rows = shard_pieces.select("shard_index", "name", "shard_tokens", "start", "tokens")
    if not placed:
        width = [partitions] if partitions else []
        rows = rows.repartition(*width, "shard_index").sortWithinPartitions("shard_index", "start")
    rows.write.format(FORMAT).mode(mode).options(
        prefix=prefix,
        vocab_size=identity.vocab_size,
        pad_id=identity.pad_id,
        cls_id=identity.cls_id,
        sep_id=identity.sep_id,
        mask_id=identity.mask_id,
    ).save(folder)


def refuse_shards(folder: str, prefix: str = SHARD_PREFIX) -> None:
    """Raises FileExistsError if the folder holds shards of the prefix."""
    try:
        first = list_shards(folder, None, prefix)[0].name
    except FileNotFoundError:
        return
    raise FileExistsError(f"{folder} already holds shards, {first} for one; write with mode='overwrite' to replace them")


def read_headers(spark: SparkSession, folder: str, split: str | None = None, **options) -> DataFrame:
    return _read(spark, folder, "headers", split, options)


def read_tokens(spark: SparkSession, folder: str, split: str | None = None, **options) -> DataFrame:
    return _read(spark, folder, "tokens", split, options)


def read_windows(
    spark: SparkSession, folder: str, split: str, config: WindowConfig, epoch: int = 0, **options
) -> DataFrame:
    layout = {
        "seqLength": config.max_seq_length,
        "strategy": config.sampling_strategy,
        "phases": config.num_offset_phases,
        "epoch": epoch,
    }
    return _read(spark, folder, "windows", split, {**layout, **options})


def read_ordered(
    spark: SparkSession, folder: str, split: str, config: WindowConfig, seed: int, epoch: int = 0,
    hash_fn: str = "xxhash64", **options,
) -> DataFrame:
    """Windows with ``pos``, their place in the keyed order of seed + epoch; filters on ``pos`` skip windows unread."""
    layout = {"seqLength": config.max_seq_length, "strategy": config.sampling_strategy, "phases": config.num_offset_phases}
    order = {"epoch": epoch, "orderSeed": seed, "orderHash": hash_fn}
    return _read(spark, folder, "ordered", split, {**layout, **order, **options})


def manifest_rows(spark: SparkSession, folder: str, prefix: str = SHARD_PREFIX) -> DataFrame:
    """``(generation, name, path, size, crc32)`` of the shards of each generation that is kept; a row per shard."""
    fs, root = filesystem(qualified(spark, folder))
    rows = []
    for generation in generations(fs, root, prefix):
        made = read_manifest(fs, root, prefix, generation)
        rows += [(generation, e.name, e.path, e.size, e.crc32) for e in made.shards.values()]
    return spark.createDataFrame(rows, "generation bigint, name string, path string, size bigint, crc32 bigint")


def damaged_shards(spark: SparkSession, folder: str, prefix: str = SHARD_PREFIX) -> DataFrame:
    """``(name, problem)`` of the newest generation's shards that are missing or whose bytes don't match the manifest."""
    register(spark)
    folder = qualified(spark, folder)
    files = [(s.name, s.path, s.size, s.crc32) for s in list_shards(folder, None, prefix)]
    rows = spark.createDataFrame(files, "name string, path string, size bigint, crc32 bigint")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                info = fs.get_file_info(row["path"])
                if info.type != pafs.FileType.File:
                    found.append((row["name"], "missing"))
                elif info.size != row["size"]:
                    found.append((row["name"], f"{info.size} bytes, not {row['size']}"))
                elif row["crc32"] is not None:
                    crc32 = 0
                    with fs.open_input_stream(row["path"]) as f:
                        while data := f.read(1 << 22):
                            crc32 = zlib.crc32(data, crc32)
                    if crc32 != row["crc32"]:
                        found.append((row["name"], "checksum differs"))
            yield pa.RecordBatch.from_pylist(
                [{"name": n, "problem": p} for n, p in found], pa.schema([("name", pa.string()), ("problem", pa.string())])
            )

    tasks = min(max(len(files), 1), 1 << 14)
    return rows.repartition(tasks).mapInArrow(check, "name string, problem string")


def _read(spark: SparkSession, folder: str, mode: str, split: str | None, options: dict) -> DataFrame:
    register(spark)
    folder = qualified(spark, folder)
    total = sum(s.token_count for s in list_shards(folder, split, options.get("prefix", SHARD_PREFIX)))
    per_core = -(-total // spark.sparkContext.defaultParallelism)
    options.setdefault("partitionTokens", min(max(per_core, MIN_PARTITION_TOKENS), MAX_PARTITION_TOKENS))
    reader = spark.read.format(FORMAT).option("mode", mode).options(**options)
    if split is not None:
        reader = reader.option("split", split)
    return reader.load(folder)
