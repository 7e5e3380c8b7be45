"""Files in, revisions out.

A store is a folder of immutable revisions, ``rev=N/<table>``, with a manifest each, ``manifests/N.json``; the greatest is the current one. A revision
becomes visible when its manifest is put in place whole, which is the last step, and none is ever replaced, so readers see whole revisions only and the
second of two writers of one revision fails.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths

#: Folders that hold no sources of one's own, and the size above which a file isn't indexed.
IGNORED = ("node_modules", ".git", "target", "dist", "build", "out", "bin", "obj", "__pycache__", ".venv", "venv", "vendor", ".idea", ".vscode", "coverage")
IGNORE_FILES = (".gitignore", ".ignore")
MAX_BYTES = 1 << 20
SCHEMA_VERSION = 1
LANGUAGES = {"py": "python", "rs": "rust", "ts": "typescript", "js": "javascript", "mjs": "javascript", "java": "java", "go": "go", "json": "json", "toml": "toml", "md": "markdown", "yaml": "yaml", "yml": "yaml"}


def _text(spark: SparkSession, path: str) -> str | None:
    """A small text file, or None; hidden ones, which Spark's readers leave out, too."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("text")
    for e, lang in LANGUAGES.items():
        out = F.when(ext == e, F.lit(lang)).otherwise(out)
    return out


def looks_like_text(content: Column) -> Column:
    """No zero byte within the first 8,192."""
    return ~F.contains(F.substring(content, 1, 8192), F.lit(bytearray(b"\0")))


def scan(spark: SparkSession, root: str, glob: str = "*", ignored: tuple[str, ...] = IGNORED, max_bytes: int = MAX_BYTES, profile: str = "full_index") -> DataFrame:
    """Text files below a folder: path (relative), language, size, hash, content, line_count, last_modified.

    Ignored folders, what the root's ignore files name (see :func:`codeloom.functions.paths.walked`), files above the size, minified names and binary contents are left
    out; listing and reading are distributed. Empty files hold nothing to index and aren't listed.
    """
    rules = [r for name in IGNORE_FILES for r in paths.ignore_rules(_text(spark, f"{root.rstrip('/')}/{name}") or "")]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.removeprefix("file://").rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + "".join("\\" + c if not c.isalnum() else c for c in base), "")
    skip = "(^|/)(" + "|".join(w.replace(".", "\\.") for w in ignored) + ")/"
    rows = raw.filter(F.col("length") <= max_bytes).select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime"), "content")
    rows = rows.filter(paths.walked(F.col("path"), rules, profile))
    rows = rows.filter(~F.col("path").rlike(skip) & ~F.col("path").rlike(r"[.-]min\.\w+$") & looks_like_text(F.col("content")))
    text = F.decode("content", "UTF-8")
    return rows.select("path", language_of(F.col("path")).alias("language"), "size", F.sha2("content", 256).alias("hash"), text.alias("content"), F.size(F.split(text, "\n")).cast("long").alias("line_count"), F.unix_timestamp("modificationTime").alias("last_modified"))


class Store:
    """Tables by revision."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _newest(self) -> int:
        """The greatest revision with a manifest; 0 for none."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max([int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()], default=0)

    def manifest(self) -> dict:
        newest = self._newest()
        if not newest:
            return {"revision": 0, "schema_version": SCHEMA_VERSION, "tables": {}}
        found = json.loads(_text(self.spark, f"{self.root}/manifests/{newest}.json"))
        if found["schema_version"] > SCHEMA_VERSION:
            raise RuntimeError(f"the store has schema version {found['schema_version']}, newer than this code's {SCHEMA_VERSION}")
        return found

    def read(self, table: str) -> DataFrame | None:
        path = self.manifest()["tables"].get(table)
        return self.spark.read.parquet(path) if path else None

    def publish(self, tables: dict[str, DataFrame], kind: str = "incremental") -> int:
        """Writes tables as the next revision; tables not given keep their former files."""
        before = self.manifest()
        revision = before["revision"] + 1
        places = dict(before["tables"])
        for name, df in tables.items():
            path = f"{self.root}/rev={revision}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            places[name] = path
        text = json.dumps({"revision": revision, "schema_version": SCHEMA_VERSION, "kind": kind, "tables": places, "created_at": int(time.time())})
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        temp, final = self._path(f"{self.root}/.manifest-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{revision}.json")
        out = self._fs.create(temp, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise RuntimeError(f"another writer published revision {revision} first")
        return revision

    def apply(self, table: str, changed: DataFrame, deleted: DataFrame, key: str) -> int:
        """Replaces the rows of changed and deleted keys."""
        from codeloom.operators.changes import apply_changes

        old = self.read(table)
        return self.publish({table: apply_changes(old, changed, deleted, key) if old is not None else changed})

    def delete_files(self, gone: DataFrame) -> int:
        """The next revision is without all that hangs on some files (file_path), in one step."""
        from codeloom.operators.projection import CASCADE, delete_files

        return self.publish(delete_files({t: self.read(t) for t, _ in CASCADE if t in self.manifest()["tables"]}, gone), "delete")

    def wipe(self) -> int:
        """The next revision has every table empty."""
        return self.publish({t: self.read(t).limit(0) for t in self.manifest()["tables"]}, "wipe")

    def info(self) -> dict[str, int]:
        """Rows by table."""
        return {t: self.read(t).count() for t in self.manifest()["tables"]}


def keep_known(df: DataFrame, column: str, keys: DataFrame, key: str = "id") -> DataFrame:
    """References to unknown keys become null; the rows stay."""
    known = keys.select(F.col(key).alias("__k"))
    return df.join(known, F.col(column) == F.col("__k"), "left").withColumn(column, F.col("__k")).drop("__k")
