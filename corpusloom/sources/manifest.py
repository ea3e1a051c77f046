"""Which files make up a shard folder: one manifest per generation, written whole.

A manifest lists a prefix's shards with their paths, sizes and checksums. The
newest one is what readers see. A commit brings its files into the folder first
and then adds the next manifest under a name that nothing holds yet; that one
write is the commit. A writer that dies before it leaves the generation before as
it was, one that dies after it leaves files that no manifest names. Files of the
generation before stay until the next commit, for readers that are at work.

A folder without a manifest, written by hand or by another tool, is what its
listing says. Manifests, and files whose names are taken in the folder, lie in a
folder next to it, so that the shard folder holds shards and nothing else.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field

import pyarrow.fs as pafs

# Generations whose files stay: the newest and the one before.
KEPT = 2


@dataclass(frozen=True)
class Entry:
    """A shard file and the CRC-32 of its bytes, if known; see ``located`` for its path."""

    name: str
    path: str
    size: int
    crc32: int | None = None


@dataclass(frozen=True)
class Manifest:
    generation: int
    shards: dict[str, Entry] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"generation": self.generation, "shards": [asdict(e) for e in self.shards.values()]})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        read = json.loads(text)
        return cls(read["generation"], {e["name"]: Entry(**e) for e in read["shards"]})


class GenerationTaken(Exception):
    """Another writer committed first."""


def manifest_dir(root: str, prefix: str) -> str:
    """Next to the shard folder."""
    parent, slash, name = root.rstrip("/").rpartition("/")
    return f"{parent}{slash}_{name}.shards-{prefix}"


def located(root: str, prefix: str, path: str) -> str:
    """An entry's file: a plain name lies in the shard folder, one after ``@/`` next to the manifests."""
    return f"{manifest_dir(root, prefix)}/{path[2:]}" if path.startswith("@/") else f"{root}/{path}"


def _path(root: str, prefix: str, generation: int) -> str:
    return f"{manifest_dir(root, prefix)}/{generation:012d}.json"


def generations(fs: pafs.FileSystem, root: str, prefix: str) -> list[int]:
    """Numbers of the generations that a manifest is kept of, ascending."""
    folder = manifest_dir(root, prefix)
    if fs.get_file_info(folder).type != pafs.FileType.Directory:
        return []
    names = (i.base_name for i in fs.get_file_info(pafs.FileSelector(folder)) if i.type == pafs.FileType.File)
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_manifest(fs: pafs.FileSystem, root: str, prefix: str, generation: int | None = None) -> Manifest | None:
    """The newest manifest, or that of a generation; None if there is none."""
    known = generations(fs, root, prefix)
    wanted = known[-1] if generation is None and known else generation
    if wanted not in known:
        return None
    with fs.open_input_file(_path(root, prefix, wanted)) as f:
        return Manifest.from_json(f.read().decode())


def put_manifest(fs: pafs.FileSystem, root: str, prefix: str, manifest: Manifest) -> None:
    """Adds a generation, whole or not at all; GenerationTaken if it is there already."""
    fs.create_dir(manifest_dir(root, prefix), recursive=True)
    try:
        put_new(fs, _path(root, prefix, manifest.generation), manifest.to_json().encode())
    except FileExistsError as error:
        raise GenerationTaken(str(error)) from error


def put_new(fs: pafs.FileSystem, path: str, body: bytes) -> None:
    """Writes a file whole or not at all; FileExistsError if the name is taken.

    A local file gets its name by a link and one in HDFS by a rename, which both
    refuse a taken name. Object stores show an object once it is complete; where
    they don't refuse a taken name, two writers at the same moment need a lock.
    """
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    if fs.type_name not in ("local", "hdfs"):
        with fs.open_output_stream(path) as out:
            out.write(body)
        return
    draft = f"{path.rpartition('/')[0]}/_draft-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(body)
    try:
        if fs.type_name == "local":
            os.link(draft, path)
            fs.delete_file(draft)
        else:
            fs.move(draft, path)
    except OSError as error:
        fs.delete_file(draft)
        raise FileExistsError(path) from error


def expire(fs: pafs.FileSystem, root: str, prefix: str, keep: int = KEPT) -> list[str]:
    """Deletes the generations before the newest ``keep``, and the files that only they name."""
    known = generations(fs, root, prefix)
    old, kept = known[:-keep], known[-keep:]
    used = {e.path for g in kept for e in read_manifest(fs, root, prefix, g).shards.values()}
    gone = []
    for g in old:
        for entry in read_manifest(fs, root, prefix, g).shards.values():
            path = located(root, prefix, entry.path)
            if entry.path not in used and fs.get_file_info(path).type == pafs.FileType.File:
                fs.delete_file(path)
                gone.append(entry.path)
        # Last, so that a crash leaves the list of what is still to be deleted.
        fs.delete_file(_path(root, prefix, g))
    return gone
