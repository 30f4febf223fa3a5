"""Source trees as tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope.operators.graph import detect_language
from depscope.sources.shared import settled

SUFFIXES = ("ts", "tsx", "py", "go", "rs")
#: Bytes above which a file is not read as source.
MAX_BYTES = 16 << 20
#: Bytes of files that a task hands on at a time.
READ_BYTES = 16 << 20


def scan_source_files(spark: SparkSession, root_or_df: str | DataFrame, suffixes: tuple[str, ...] = SUFFIXES, repo: str = "default") -> DataFrame:
    """(repo, path, lang, content, n_bytes, parse_ok) of the source files of a folder, or of a table (repo, path, content).

    content is text; bytes that are no UTF-8 are replaced. parse_ok: there is content, without NUL bytes, of MAX_BYTES at
    most. Suffixes are compared in lower case. A folder is listed and its files are read in tasks,
    hidden ones (__init__.py) too, which Spark's own file sources would leave out.
    """
    df = _tree(spark, root_or_df, repo, suffixes) if isinstance(root_or_df, str) else root_or_df
    kept = df.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))
    raw = F.col("content").cast("binary")
    text = F.make_valid_utf8(raw.cast("string"))
    size, lang = F.octet_length(raw).cast("long"), detect_language(F.col("path"))
    return kept.select("repo", "path", lang.alias("lang"), text.alias("content"), size.alias("n_bytes"), parse_ok(raw).alias("parse_ok"))


def parse_ok(content: Column) -> Column:
    bad = F.contains(content.cast("binary"), F.lit(b"\0"))
    return F.coalesce(~bad & (F.octet_length(content) <= MAX_BYTES), F.lit(False))


def _open(root: str):
    """The file system of an address, and the path in it."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    return store, base.rstrip("/")


def _suffix(name: str) -> str:
    return name.rpartition("/")[2].rpartition(".")[2].lower()


def _tree(spark: SparkSession, root: str, repo: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(repo, path, content): the files below root with one of the suffixes, which driver and tasks reach by the same address.

    Tasks list the folders, level by level; names never reach the driver, and only files that are wanted are opened.
    Folders that are links are not followed.
    """

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = _open(root)
        local = isinstance(store, fs.LocalFileSystem)
        for f in frames:
            for folder in f["name"]:
                found = store.get_file_info(fs.FileSelector(folder))
                rows = [(i.path, i.type == fs.FileType.Directory) for i in found]
                kept = [(p, d) for p, d in rows if (not (local and os.path.islink(p)) if d else _suffix(p) in suffixes)]
                yield pd.DataFrame(kept, columns=["name", "folder"]).astype({"folder": bool})

    base = _open(root)[1]
    level, files = spark.createDataFrame([(base,)], "name string"), None
    while True:
        found = settled(level.mapInPandas(listed, "name string, folder boolean"), "listed")
        own = found.filter("not folder").select("name")
        files = own if files is None else files.unionByName(own)
        level = found.filter("folder").select("name").repartition("name")
        if found.filter("folder").isEmpty():
            break

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _open(root)
        names: list[str] = []
        held: list[bytes] = []
        for f in frames:
            for name in f["name"]:
                names.append(name[len(base) + 1 :])
                held.append(store.open_input_file(name).readall())
                if sum(map(len, held)) > READ_BYTES or len(held) == 64:
                    yield pd.DataFrame({"repo": repo, "path": names, "content": held})
                    names, held = [], []
        if held:
            yield pd.DataFrame({"repo": repo, "path": names, "content": held})

    return files.repartition("name").mapInPandas(read, "repo string, path string, content binary")
