"""File contents as a data source: a folder tree, or the tree of a commit in a git repository.

    register(spark)
    spark.read.format("content").load("/repos/app")                                 # the working tree
    spark.read.format("content").option("commit", "main").load("/repos/app.git")    # what is committed
    ... .where("path like 'src/%' and path like '%.py'")

Columns: path (from the root, with /), size, modified (null for a commit), sha (the blob's name; null for a
folder), content. A working tree leaves out what its .gitignore files and .git/info/exclude name, and folders named in the option
skip; a commit has all it tracks but folders to skip. Symbolic links are not followed.

Filters on path (=, in, prefix, suffix) reach the planning: folders outside a prefix are never listed, and files that do not
match are never opened. Files are dealt into partitions of about partitionBytes by size (a commit: partitionFiles by number), in
path order, so that a task opens its own files and no other. The option maxBytes leaves files beyond it with null content; by
default there is none. Paths must be reachable from all executors, as with any file system that is mounted.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "path string, size long, modified timestamp, sha string, content binary"
#: Folders that hold no sources of their own.
SKIP = (".git", "node_modules", "target", "__pycache__", "vendor", "dist", "build")
PARTITION_BYTES, PARTITION_FILES = 32 << 20, 500
BATCH_BYTES = 4 << 20


class Wanted:
    """What is asked of a path: every one of some tests."""

    def __init__(self) -> None:
        self.prefixes: list[str] = []
        self.suffixes: list[str] = []
        self.among: list[frozenset[str]] = []

    def take(self, f: Filter) -> bool:
        """Whether the filter is wholly taken over."""
        if getattr(f, "attribute", None) != ("path",):
            return False
        if isinstance(f, StringStartsWith):
            self.prefixes.append(f.value)
        elif isinstance(f, StringEndsWith):
            self.suffixes.append(f.value)
        elif isinstance(f, EqualTo) and isinstance(f.value, str):
            self.among.append(frozenset([f.value]))
        elif isinstance(f, In):
            self.among.append(frozenset(v for v in f.value if v is not None))
        else:
            return False
        return True

    def file(self, path: str) -> bool:
        return all(path.startswith(p) for p in self.prefixes) and all(path.endswith(s) for s in self.suffixes) and all(path in a for a in self.among)

    def folder(self, path: str) -> bool:
        """Whether a folder (a path with / at its end) can hold a wanted file."""
        return all(p.startswith(path) or path.startswith(p) for p in self.prefixes) and all(any(x.startswith(path) for x in a) for a in self.among)


# --- working trees


def ignore_rule(line: str, base: str) -> tuple[re.Pattern, bool, bool] | None:
    """A line of a .gitignore file below base: pattern over paths, whether it keeps, whether it names folders only."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\n\r"))
    keeps = line.startswith("!")
    line = line[keeps:]
    if not line or line.startswith("#"):
        return None
    line = line[1:] if line[:2] in ("\\#", "\\!") else line
    folders = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    if not line:
        return None
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "**" and (i == 0 or line[i - 1] == "/"):
            out, i = out + ".+", len(line)
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := line.find("]", i + 2)) > 0:
            out, i = out + "[" + ("^" if line[i + 1] in "!^" else "") + line[i + 1 + (line[i + 1] in "!^") : end].replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(re.escape(base) + ("" if anchored else "(?:.*/)?") + out), keeps, folders


def working_files(root: str, wanted: Wanted, skip: frozenset[str]) -> Iterator[tuple[str, int, int]]:
    """path, size, modified (ns) of a tree's files, folder by folder in the order of names."""

    def rules(file: str, base: str) -> list:
        if not os.path.isfile(file):
            return []
        with open(file, encoding="utf-8", errors="replace") as f:
            return [r for r in (ignore_rule(x, base) for x in f) if r]

    def walk(base: str, held: list) -> Iterator[tuple[str, int, int]]:
        here = held + rules(os.path.join(root, base, ".gitignore"), base)
        for e in sorted(os.scandir(os.path.join(root, base)), key=lambda e: e.name):
            path = base + e.name
            if e.is_symlink():
                continue
            folder = e.is_dir()
            if folder and (e.name in skip or not wanted.folder(path + "/")):
                continue
            ignored = False
            for pattern, keeps, folders in here:
                if (folder or not folders) and pattern.fullmatch(path):
                    ignored = not keeps
            if ignored:
                continue
            if folder:
                yield from walk(path + "/", here)
            elif wanted.file(path):
                s = e.stat()
                yield path, s.st_size, s.st_mtime_ns

    yield from walk("", rules(os.path.join(root, ".git", "info", "exclude"), ""))


# --- commits


class Repository:
    """Reads objects of a git repository, loose or packed."""

    KINDS = {1: b"commit", 2: b"tree", 3: b"blob", 4: b"tag"}

    def __init__(self, root: str):
        inner = os.path.join(root, ".git")
        if os.path.isfile(inner):  # a linked working tree names its folder
            with open(inner, encoding="utf-8") as f:
                inner = os.path.join(root, f.read().partition("gitdir:")[2].strip())
        self.at = inner if os.path.isdir(inner) else root
        common = os.path.join(self.at, "commondir")
        self.common = self.at
        if os.path.isfile(common):
            with open(common, encoding="utf-8") as f:
                self.common = os.path.normpath(os.path.join(self.at, f.read().strip()))
        self.stores = [os.path.join(self.common, "objects")]
        for store in self.stores:  # grows while it is gone through
            names = os.path.join(store, "info", "alternates")
            if os.path.isfile(names):
                with open(names, encoding="utf-8") as f:
                    self.stores += [os.path.normpath(os.path.join(store, x.strip())) for x in f if x.strip()]
        self.packs: list[tuple[str, bytes]] | None = None

    def resolve(self, name: str) -> str:
        """The object that a branch, tag, HEAD or full sha names."""
        for _ in range(10):
            if re.fullmatch(r"[0-9a-f]{40}", name):
                return name
            for where in (self.at, self.common):
                for prefix in ("", "refs/", "refs/tags/", "refs/heads/", "refs/remotes/"):
                    file = os.path.join(where, prefix + name)
                    if os.path.isfile(file):
                        with open(file, encoding="utf-8") as f:
                            found = f.read().strip()
                        break
                else:
                    continue
                break
            else:
                found = self._packed_ref(name)
            name = found.removeprefix("ref: ")
        raise ValueError(f"{name} leads nowhere")

    def _packed_ref(self, name: str) -> str:
        file = os.path.join(self.common, "packed-refs")
        if os.path.isfile(file):
            with open(file, encoding="utf-8") as f:
                held = {ref: sha for sha, _, ref in (x.strip().partition(" ") for x in f if x[:1] not in "#^")}
            for prefix in ("", "refs/", "refs/tags/", "refs/heads/", "refs/remotes/"):
                if prefix + name in held:
                    return held[prefix + name]
        raise ValueError(f"the repository has no {name}")

    def read(self, sha: str) -> tuple[bytes, bytes]:
        """Kind and content."""
        for store in self.stores:
            file = os.path.join(store, sha[:2], sha[2:])
            if os.path.isfile(file):
                with open(file, "rb") as f:
                    head, _, body = zlib.decompress(f.read()).partition(b"\0")
                return head.split(b" ")[0], body
        if self.packs is None:
            self.packs = []
            for store in self.stores:
                folder = os.path.join(store, "pack")
                for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
                    if name.endswith(".idx"):
                        with open(os.path.join(folder, name), "rb") as f:
                            self.packs.append((os.path.join(folder, name[:-3] + "pack"), f.read()))
        for pack, index in self.packs:
            at = self._offset(index, bytes.fromhex(sha))
            if at is not None:
                with open(pack, "rb") as f:
                    return self._entry(f, at)
        raise KeyError(f"object {sha} is not in the repository")

    @staticmethod
    def _offset(index: bytes, sha: bytes) -> int | None:
        """Where an object lies in a pack, by its index (version 2)."""
        if index[:8] != b"\xfftOc\0\0\0\2":
            raise ValueError("only pack indexes of version 2 are read")
        fan = struct.unpack(">256I", index[8:1032])
        low, high, n = fan[sha[0] - 1] if sha[0] else 0, fan[sha[0]], fan[255]
        k = bisect_left(range(low, high), sha, key=lambda i: index[1032 + 20 * i : 1052 + 20 * i]) + low
        if k == high or index[1032 + 20 * k : 1052 + 20 * k] != sha:
            return None
        offsets = 1032 + 24 * n
        (at,) = struct.unpack(">I", index[offsets + 4 * k : offsets + 4 * k + 4])
        if at >> 31:
            far = offsets + 4 * n + 8 * (at & 0x7FFFFFFF)
            (at,) = struct.unpack(">Q", index[far : far + 8])
        return at

    def _entry(self, f, at: int) -> tuple[bytes, bytes]:
        f.seek(at)
        c = f.read(1)[0]
        kind, size, shift = c >> 4 & 7, c & 15, 4
        while c & 128:
            c = f.read(1)[0]
            size |= (c & 127) << shift
            shift += 7
        base = None
        if kind == 6:
            c = f.read(1)[0]
            back = c & 127
            while c & 128:
                c = f.read(1)[0]
                back = (back + 1) << 7 | c & 127
            base = ("here", at - back)
        elif kind == 7:
            base = ("named", f.read(20).hex())
        z, body = zlib.decompressobj(), b""
        while not z.eof:
            body += z.decompress(f.read(max(4096, min(size, 1 << 20))))
        if base is None:
            return self.KINDS[kind], body
        kind_name, source = self._entry(f, base[1]) if base[0] == "here" else self.read(base[1])
        return kind_name, self._patched(source, body)

    @staticmethod
    def _patched(source: bytes, delta: bytes) -> bytes:
        """A delta's copies and insertions, applied."""
        at = 0
        for _ in range(2):  # both sizes
            while delta[at] & 128:
                at += 1
            at += 1
        out = []
        while at < len(delta):
            op = delta[at]
            at += 1
            if op & 128:
                value = 0
                for bit in range(7):
                    if op >> bit & 1:
                        value |= delta[at] << 8 * bit
                        at += 1
                start, size = value & 0xFFFFFFFF, value >> 32 or 0x10000
                out.append(source[start : start + size])
            else:
                out.append(delta[at : at + op])
                at += op
        return b"".join(out)

    def files(self, commit: str, wanted: Wanted, skip: frozenset[str]) -> Iterator[tuple[str, str]]:
        """path, blob of a commit's files; trees outside the wanted folders are not read."""
        kind, body = self.read(self.resolve(commit))
        while kind == b"tag":
            kind, body = self.read(body.split(b"\n", 1)[0].split(b" ")[1].decode())
        if kind != b"commit":
            raise ValueError(f"{commit} is a {kind.decode()}, not a commit")

        def walk(tree: str, base: str) -> Iterator[tuple[str, str]]:
            _, body = self.read(tree)
            at = 0
            while at < len(body):
                end = body.index(b"\0", at)
                mode, _, name = body[at:end].partition(b" ")
                sha = body[end + 1 : end + 21].hex()
                at = end + 21
                path = base + name.decode("utf-8", "replace")
                if mode == b"40000":
                    if name.decode("utf-8", "replace") not in skip and wanted.folder(path + "/"):
                        yield from walk(sha, path + "/")
                elif mode.startswith(b"100") and wanted.file(path):
                    yield path, sha

        yield from walk(body.split(b"\n", 1)[0].split(b" ")[1].decode(), "")


@lru_cache(maxsize=8)
def _repository(root: str) -> Repository:
    return Repository(root)


# --- the source


class Files(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(None)
        self.rows = rows


class ContentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.root = options["path"].removeprefix("file://")
        self.commit = options.get("commit")
        self.skip = frozenset(options["skip"].split(",")) if "skip" in options else frozenset(SKIP)
        self.bytes, self.files = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("partitionfiles", PARTITION_FILES))
        self.most = int(options["maxbytes"]) if "maxbytes" in options else None
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Files]:
        out: list[list[tuple]] = []
        n = self.bytes
        if self.commit is not None:
            for k, (path, sha) in enumerate(Repository(self.root).files(self.commit, self.wanted, self.skip)):
                if k % self.files == 0:
                    out.append([])
                out[-1].append((path, None, None, sha))
        else:
            for path, size, modified in working_files(self.root, self.wanted, self.skip):
                if n + size > self.bytes or len(out[-1]) >= 100 * self.files:
                    out.append([])
                    n = 0
                out[-1].append((path, size, modified, None))
                n += size
        return [Files(x) for x in out or [[]]]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, size, modified, sha in partition.rows:
            if sha is None:
                content = None
                if self.most is None or size <= self.most:
                    with open(os.path.join(self.root, path), "rb") as f:
                        content = f.read()
                yield path, size, datetime.fromtimestamp(modified / 1e9, timezone.utc), None, content
            else:
                content = _repository(self.root).read(sha)[1]
                yield path, len(content), None, sha, content if self.most is None or len(content) <= self.most else None


class Content(DataSource):
    @classmethod
    def name(cls) -> str:
        return "content"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ContentReader:
        return ContentReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Content)


def texts(df, encoding: str = "UTF-8"):
    """path and text of files that are text: contents with a zero byte are left out."""
    from pyspark.sql import functions as F

    return df.where(F.col("content").isNotNull() & ~F.contains("content", F.lit(b"\0"))).select("path", F.decode("content", encoding).alias("text"))
