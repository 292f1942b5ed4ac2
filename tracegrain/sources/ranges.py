"""A Spark data source over the bytes of files: one row for each range of a fixed length, with its hash."""

from __future__ import annotations

import fnmatch
import hashlib
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class Run:
    """Consecutive leaves of one file."""

    path: str
    size: int
    first: int
    count: int


@dataclass
class Runs(InputPartition):
    runs: list[Run]


PARTITION_BYTES = 128 << 20  # what a task reads where there is work for all


def deal(files: list[tuple[str, int]], leaf: int, partition_bytes: int, parts_wanted: int | None = None) -> list[list[Run]]:
    """The leaves of all files in order, cut into parts of about ``partition_bytes``: a large file spreads over many, small ones share one.

    Parts beyond ``parts_wanted`` only cost the start of a task each, so parts grow, up to PARTITION_BYTES, where there would be more of them.
    """
    if parts_wanted is not None:
        partition_bytes = max(partition_bytes, min(PARTITION_BYTES, -(-sum(size for _, size in files) // parts_wanted)))
    most = max(1, partition_bytes // leaf)
    parts: list[list[Run]] = [[]]
    room = most
    for path, size in files:
        leaves = max(1, -(-size // leaf))  # an empty file is one empty leaf
        first = 0
        while first < leaves:
            if room == 0:
                parts.append([])
                room = most
            count = min(room, leaves - first)
            parts[-1].append(Run(path, size, first, count))
            first, room = first + count, room - count
    return parts if parts[0] else []


class ByteRangeSource(DataSource):
    """Options: path (a URI), pattern of file names, leaf (bytes of a range), partitionBytes (bytes a task reads), partsWanted (parts above which tasks read more).

    Files and folders whose names begin with a dot or an underscore are left out, as in Spark's own file sources; ``key=value`` folders stay.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, bytes bigint, node bigint, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return ByteRangeReader(dict(self.options))


class ByteRangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.pattern = options["path"], options.get("pattern", "*")
        self.leaf, self.partition_bytes = int(options["leaf"]), int(options.get("partitionbytes") or options["partitionBytes"])
        wanted = options.get("partswanted") or options.get("partsWanted")
        self.parts_wanted = int(wanted) if wanted else None

    def _open(self):
        """The file system, the folder in it, and what stands before its paths in a URI."""
        from pyarrow import fs

        if self.uri.startswith("file:"):
            return fs.LocalFileSystem(), "/" + self.uri[len("file:"):].lstrip("/"), "file:"
        system, path = fs.FileSystem.from_uri(self.uri)
        return system, path, self.uri[:self.uri.rindex(path)] if path else self.uri

    def _listed(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, folder, _ = self._open()
        root = folder.rstrip("/")
        if system.get_file_info(root).type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            names = info.path[len(root):].strip("/").split("/")
            hidden = any(n.startswith(".") or (n.startswith("_") and "=" not in n) for n in names)
            if info.is_file and not hidden and fnmatch.fnmatchcase(names[-1], self.pattern):
                found.append((info.path, info.size))
        return sorted(found)

    def partitions(self) -> list[InputPartition]:
        # Without files there is still a partition, as Spark asks a source for one.
        return [Runs(runs) for runs in deal(self._listed(), self.leaf, self.partition_bytes, self.parts_wanted)] or [Runs([])]

    def read(self, partition: Runs):
        import pyarrow as pa

        system, _, prefix = self._open()
        for run in partition.runs:
            hashes = []
            with system.open_input_file(run.path) as f:
                f.seek(run.first * self.leaf)
                for k in range(run.first, run.first + run.count):
                    data = f.read(self.leaf)
                    if len(data) != min(self.leaf, run.size - k * self.leaf):
                        raise OSError(f"{run.path} changed while it was read")
                    hashes.append(hashlib.sha256(data).hexdigest())
            n = run.count
            yield pa.RecordBatch.from_arrays(
                [pa.array([prefix + run.path] * n, pa.string()), pa.array([run.size] * n, pa.int64()), pa.array(range(run.first, run.first + n), pa.int64()),
                 pa.array(hashes, pa.string())], names=["path", "bytes", "node", "sha256"])
