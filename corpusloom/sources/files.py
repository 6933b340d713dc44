"""A folder of text files as a corpus: listing with ignore rules, then reading on the executors.

The listing runs on the driver (names and stats only); contents are read in Arrow batches by
the executors, so the folder must be one that all of them see.
"""

from __future__ import annotations

import os
import re
import stat
import subprocess
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.index import FOLDER

IGNORE_FILE, OLD_IGNORE_FILE = ".loomignore", ".corpusignore"
#: Never entered below the root.
SKIPPED = frozenset({FOLDER, ".git"})
HEAD = 8192
#: Kinds of files that a first index leaves out.
DEFAULT_IGNORED = {
    "Images": "png jpg jpeg gif bmp svg ico webp tiff", "Video": "mp4 avi mov mkv wmv flv webm", "Audio": "mp3 wav flac aac ogg m4a",
    "Programs": "exe dll so dylib a lib obj o", "Archives": "zip tar tar.gz tgz rar 7z bz2 gz", "Data": "db sqlite sqlite3 parquet arrow", "Configuration": "json yaml yml",
}

SCHEMA = "path string, size long, mtime_ns long, unreadable boolean, hash string, readable_text boolean, content string"


@dataclass(frozen=True)
class WalkOptions:
    hidden: bool = False
    no_ignore: bool = False
    no_own_ignore: bool = False


@lru_cache(maxsize=4096)
def glob_regex(glob: str) -> re.Pattern:
    """One gitignore glob over a path: * and ? stop at /, ** does not."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(out + r"\Z", re.DOTALL)


@dataclass(frozen=True)
class Rules:
    """The patterns of one ignore file, for paths relative to its folder."""

    patterns: tuple[tuple[re.Pattern, bool, bool, bool], ...]

    @staticmethod
    def parse(text: str) -> Rules:
        out = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            if line:
                out.append((glob_regex(line.lstrip("/") if anchored else line), anchored, only_dirs, keep))
        return Rules(tuple(out))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored; False: kept by a !pattern; None: no pattern speaks. The last one wins."""
        name = path.rsplit("/", 1)[-1]
        for regex, anchored, only_dirs, keep in reversed(self.patterns):
            if (is_dir or not only_dirs) and regex.match(path if anchored else name):
                return not keep
        return None


def _rules(path: str) -> Rules | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as file:
            return Rules.parse(file.read())
    except OSError:
        return None


def default_ignore_text() -> str:
    blocks = ["# What a first index leaves out; the syntax is that of .gitignore."]
    blocks += ["\n".join([f"# {kind}", *(f"*.{e}" for e in endings.split())]) for kind, endings in DEFAULT_IGNORED.items()]
    return "\n\n".join(blocks) + "\n"


def ensure_ignore_file(root: str, options: WalkOptions = WalkOptions()) -> bool:
    """Write the default ignore file where the corpus has none; not if the run ignores such files."""
    if options.no_own_ignore or any(os.path.exists(os.path.join(root, f)) for f in (IGNORE_FILE, OLD_IGNORE_FILE)):
        return False
    with open(os.path.join(root, IGNORE_FILE), "w", encoding="utf-8") as file:
        file.write(default_ignore_text())
    return True


def _global_rules() -> Rules | None:
    try:
        told = subprocess.run(["git", "config", "--get", "core.excludesFile"], capture_output=True, text=True, check=False).stdout.strip()
    except OSError:
        told = ""
    return _rules(os.path.expanduser(told or "~/.config/git/ignore"))


def listing(root: str, options: WalkOptions = WalkOptions()) -> list[tuple[str, int, int]]:
    """(path, size, mtime_ns) of the files under root that no rule leaves out, sorted; links are not followed."""
    root = os.path.abspath(root)
    own = [] if options.no_own_ignore else [IGNORE_FILE]
    if own and not os.path.exists(os.path.join(root, IGNORE_FILE)) and os.path.exists(os.path.join(root, OLD_IGNORE_FILE)):
        own.append(OLD_IGNORE_FILE)
        warnings.warn(f"reading {OLD_IGNORE_FILE}; its name is {IGNORE_FILE} now", stacklevel=2)
    # nearer folders and, within one, earlier names go first
    names = [*own, *([] if options.no_ignore else [".ignore", ".gitignore"])]

    def of(folder: str) -> list[tuple[str, str, Rules]]:
        found = [(folder, n, r) for n in names if (r := _rules(os.path.join(folder, n)))]
        if not options.no_ignore and (r := _rules(os.path.join(folder, ".git", "info", "exclude"))):
            found.append((folder, "exclude", r))
        return found

    above: list[tuple[str, str, Rules]] = []
    folder = os.path.dirname(root)
    while folder != os.path.dirname(folder):
        above += of(folder)
        folder = os.path.dirname(folder)
    if not options.no_ignore and (r := _global_rules()):
        above.append((root, "global", r))

    def ignored(path: str, is_dir: bool, rules: list[tuple[str, str, Rules]]) -> bool:
        for wanted in (*own, ".ignore", ".gitignore", "exclude", "global"):
            for base, name, rule in rules:
                if name == wanted and (said := rule.verdict(os.path.relpath(path, base).replace(os.sep, "/"), is_dir)) is not None:
                    return said
        return False

    out: list[tuple[str, int, int]] = []

    def walk(folder: str, rules: list[tuple[str, str, Rules]]) -> None:
        rules = [*of(folder), *rules]
        try:
            entries = list(os.scandir(folder))
        except OSError:
            return
        for entry in entries:
            if entry.name in SKIPPED or (entry.name.startswith(".") and not options.hidden):
                continue
            try:
                info = entry.stat(follow_symlinks=False)
            except OSError:
                continue
            is_dir = stat.S_ISDIR(info.st_mode)
            if not (is_dir or stat.S_ISREG(info.st_mode)) or ignored(entry.path, is_dir, rules):
                continue
            if is_dir:
                walk(entry.path, rules)
            else:
                out.append((os.path.relpath(entry.path, root).replace(os.sep, "/"), info.st_size, info.st_mtime_ns))

    walk(root, above)
    return sorted(out)


def looks_binary(head: bytes) -> bool:
    """A NUL byte, or no UTF-8 but for a sequence cut off at the end."""
    if 0 in head:
        return True
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as error:
        return not (error.reason == "unexpected end of data" and len(head) - error.start <= 4)
    return False


def walked(spark: SparkSession, root: str, options: WalkOptions = WalkOptions(), indexed: DataFrame | None = None) -> DataFrame:
    """The corpus as rows of SCHEMA; binary files are left out.

    A file whose size and time the index knows is listed without being opened: its hash and
    content are null. An unreadable file is a row with unreadable true.
    """
    rows = listing(root, options)
    frame = spark.createDataFrame(rows, "path string, size long, mtime_ns long") if rows else spark.createDataFrame([], "path string, size long, mtime_ns long")
    if indexed is not None:
        stats = indexed.select("path", "size", "mtime_ns", F.lit(True).alias("known"))
        frame = frame.join(stats, ["path", "size", "mtime_ns"], "left")
    else:
        frame = frame.withColumn("known", F.lit(None).cast("boolean"))
    base = os.path.abspath(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = []
            for path, size, mtime, known in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "mtime_ns", "known")), strict=True):
                if known:
                    out.append((path, size, mtime, False, None, True, None))
                    continue
                try:
                    with open(os.path.join(base, path), "rb") as file:
                        data = file.read(HEAD)
                        if looks_binary(data):
                            continue
                        data += file.read()
                except OSError:
                    out.append((path, size, mtime, True, None, False, None))
                    continue
                try:
                    text = data.decode("utf-8")
                except UnicodeDecodeError:
                    text = None
                out.append((path, size, mtime, False, hashlib.sha256(data).hexdigest(), text is not None, text))
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.string())
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "size", "mtime_ns", "unreadable", "hash", "readable_text", "content"])

    return frame.mapInArrow(read, SCHEMA)


def index_root(path: str) -> str | None:
    """The nearest folder at or above a path that holds an index."""
    folder = os.path.abspath(path)
    if not os.path.isdir(folder):
        folder = os.path.dirname(folder)
    while True:
        if os.path.isdir(os.path.join(folder, FOLDER)):
            return folder
        if folder == os.path.dirname(folder):
            return None
        folder = os.path.dirname(folder)


def scope_of(root: str, path: str) -> str | None:
    """A path as a scope under root; None for the root itself."""
    relative = os.path.relpath(os.path.abspath(path), os.path.abspath(root)).replace(os.sep, "/")
    if relative == ".":
        return None
    if relative.startswith(".."):
        raise ValueError(f"{path} is not under {root}")
    return relative
