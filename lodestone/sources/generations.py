"""Rebuilding a collection as a commit protocol: generations, a strict manifest, and a pointer that is replaced atomically.

A rebuild writes its rows to a new generation's folder, checks them, writes the manifest beside them, and only then moves
the pointer `CURRENT` to it, by the file system's own atomic rename. A reader resolves the pointer once and reads that
generation, whatever happens meanwhile. A run that fails at any step leaves the pointer where it was; what it wrote is a dead
generation, which a later clean-up removes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lodestone.operators import digest
from lodestone.sources.store import StoreError

SCHEMA_VERSION = 1
#: Generations before the current one that the pointer names.
HISTORY = 16


@dataclass(frozen=True)
class Signature:
    """What a collection was built with: settings, and digests of its catalog and its raw rows."""

    collection: str
    provider: str
    model: str
    dimensions: int
    chunk_size: int
    chunk_overlap: int
    catalog_sha256: str
    content_sha256: str


@dataclass(frozen=True)
class Manifest:
    """A generation's signature and what was stored; all fields must be there, and no others."""

    schema_version: int
    signature: Signature
    count: int
    rows_sha256: str
    generation: str
    generated_at: str


_SETTINGS = ("collection", "provider", "model", "dimensions", "chunk_size", "chunk_overlap")
#: The least dimensions and chunk size that a manifest may name.
LEAST_DIMENSIONS, LEAST_CHUNK = 256, 200


def parse_manifest(text: str, least_dimensions: int = LEAST_DIMENSIONS) -> Manifest:
    """The manifest of a JSON text; StoreError for anything that is not exactly one."""

    def typed(kind, raw):
        want = {f.name: f.type for f in fields(kind)}
        if not isinstance(raw, dict) or set(raw) != set(want):
            raise StoreError("the manifest has other fields")
        for name, value in raw.items():
            if want[name] in ("str", "int") and type(value) is not {"str": str, "int": int}[want[name]]:
                raise StoreError(f"{name} is of another type")
        return raw

    try:
        raw = json.loads(text)
    except ValueError as e:
        raise StoreError("the manifest cannot be read") from e
    raw = dict(typed(Manifest, raw))
    s = Signature(**typed(Signature, raw.pop("signature")))
    digests = [s.catalog_sha256, s.content_sha256, raw["rows_sha256"]]
    if raw["schema_version"] != SCHEMA_VERSION or raw["count"] < 0 or s.dimensions < least_dimensions or s.chunk_size < LEAST_CHUNK or not 0 <= s.chunk_overlap < s.chunk_size:
        raise StoreError("the manifest's values are out of range")
    if any(len(d) != 64 or set(d) - set("0123456789abcdef") for d in digests) or not (s.collection and s.provider and s.model):
        raise StoreError("the manifest's values are no names or digests")
    return Manifest(signature=s, **raw)


class _Files:
    """The few file operations of the protocol, on whatever file system the path is on."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = path.rstrip("/")
        base = self._at("")
        self._fs = base.getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(base).toUri(), self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        at = self._at(name)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file beside its place, flush it, and rename it over the old one."""
        fresh = self._at(f".{name.rsplit('/', 1)[-1]}-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._at(""))
        stream = self._fs.create(fresh, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        self._context.rename(fresh, self._at(name), options)

    def folders(self, name: str) -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.isDirectory()) if self._fs.exists(at) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the generation that readers see; None where none was committed."""
    return next(iter(committed(spark, path)), None)


def committed(spark: SparkSession, path: str) -> list[str]:
    """The current generation and those that were current before it, newest first, as far as the pointer names them."""
    return (_Files(spark, path).read("CURRENT") or "").split()


def read_manifest(spark: SparkSession, path: str, least_dimensions: int = LEAST_DIMENSIONS) -> Manifest | None:
    """The current generation's manifest; None where there is none, StoreError where it is none."""
    name = current(spark, path)
    text = _Files(spark, path).read(f"generations/{name}/manifest.json") if name else None
    return parse_manifest(text, least_dimensions) if text is not None else None


def open_current(spark: SparkSession, path: str) -> DataFrame:
    """The current generation's rows."""
    name = current(spark, path)
    if name is None:
        raise StoreError(f"nothing was committed at {path}")
    try:
        return spark.read.parquet(f"{path}/generations/{name}/rows")
    except AnalysisException as e:
        raise StoreError(f"the generation {name} cannot be read") from e


def rebuild(spark: SparkSession, path: str, build: Callable[[], DataFrame], signature: Callable[[], Signature], now: str, reset: bool = False, keep: int = 1, least_dimensions: int = LEAST_DIMENSIONS) -> Manifest:
    """Write the collection that `build` gives anew and commit it.

    In order: the signature; a refusal if rows are there and no `reset` was asked for; the rows; their count and digest, and
    that every vector (`embedding`) has the signature's dimensions; the signature again, which must be the same; the
    manifest; the pointer; and the removal of generations beyond the `keep` before this one. `now` is the time that the
    manifest names. Anything that fails before the pointer moves leaves the old collection as it was.
    """
    files = _Files(spark, path)
    before = signature()
    old = current(spark, path)
    if old is not None and not reset and not open_current(spark, path).isEmpty():
        raise StoreError("the collection is not empty; ask for a reset")
    name = f"{now.replace(':', '').replace(' ', 'T')}-{uuid.uuid4().hex}"
    home = f"{path}/generations/{name}"
    build().write.parquet(f"{home}/rows")
    rows = spark.read.parquet(f"{home}/rows")
    if "embedding" in rows.columns and not rows.where(F.coalesce(F.size("embedding"), F.lit(-1)) != before.dimensions).isEmpty():
        raise StoreError("a vector has other dimensions")
    found, count = digest.root(rows)
    if count != rows.count():
        raise StoreError("the stored rows changed while they were counted")
    if signature() != before:
        raise StoreError("settings or content changed during the rebuild")
    manifest = Manifest(SCHEMA_VERSION, before, count, found, name, now)
    text = json.dumps(asdict(manifest), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    parse_manifest(text, least_dimensions)
    files.replace(f"generations/{name}/manifest.json", text)
    if current(spark, path) != old:
        raise StoreError("another rebuild was committed meanwhile")
    files.replace("CURRENT", "\n".join([name, *committed(spark, path)[:HISTORY]]))
    clean(spark, path, keep)
    return manifest


def clean(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove generations but the current one and the `keep` that were current before it; their names. Others are older,
    or runs that failed."""
    files = _Files(spark, path)
    kept = committed(spark, path)[: 1 + keep]
    dead = [g for g in files.folders("generations") if g not in kept] if kept else []
    for g in dead:
        files.remove(f"generations/{g}")
    return dead


def inspect_strict(spark: SparkSession, path: str, want: Signature, least_dimensions: int = LEAST_DIMENSIONS) -> str:
    """The first of eight reasons for which the collection at a path can or cannot serve, from what is stored there."""
    try:
        rows = open_current(spark, path)
        count = rows.count()
    except Exception as e:  # whatever the store failed with
        if current(spark, path) is None and not isinstance(e, StoreError):
            raise
        return "index_unavailable"
    if not count:
        return "empty_index"
    try:
        got = read_manifest(spark, path, least_dimensions)
    except StoreError:
        return "invalid_manifest"
    if got is None:
        return "missing_manifest"
    if any(getattr(got.signature, f) != getattr(want, f) for f in _SETTINGS):
        return "settings_mismatch"
    if (got.signature.catalog_sha256, got.signature.content_sha256) != (want.catalog_sha256, want.content_sha256):
        return "content_mismatch"
    if got.count != count:
        return "chunk_count_mismatch"
    return "compatible"
