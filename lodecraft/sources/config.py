"""Configuration: typed records read from YAML or JSON, overrides, pinned digests, and where a split's file lies.

Faults of any kind are ``ConfigError`` with the path and every field that is wrong.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import typing
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import file_system
from . import files
from .readers import LOADERS

try:
    import yaml
except ImportError:  # JSON only
    yaml = None

ANSWER_TYPES = ("integer", "rational", "real", "expression", "set", "tuple", "interval")
UNPINNED = "0" * 64


class ConfigError(ValueError):
    """A configuration that cannot be read or is not valid."""


def parse(text: str, name: str):
    try:
        return json.loads(text) if yaml is None or name.endswith(".json") else yaml.safe_load(text)
    except Exception as fault:
        raise ConfigError(f"cannot read {name}: {fault}") from fault


def read(spark: SparkSession, path: str):
    try:
        text = files.read_bytes(spark, path).decode()
    except Exception as fault:
        raise ConfigError(f"cannot read {path}: {fault}") from fault
    return parse(text, path)


def _fits(value, kind) -> bool:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is typing.Literal:
        return any(value == a and type(value) is type(a) for a in args)
    if args and origin not in (dict, list, tuple):
        return any(_fits(value, a) for a in args)
    if kind is float:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind is int:
        return isinstance(value, int) and not isinstance(value, bool)
    return isinstance(value, origin or kind)


def build(kind: type, raw, where: str):
    """A data class from a mapping: no field may be unknown, missing or of another type."""
    if not isinstance(raw, Mapping):
        raise ConfigError(f"{where}: a mapping is wanted, not {type(raw).__name__}")
    hints, fields = typing.get_type_hints(kind), {f.name: f for f in dataclasses.fields(kind)}
    optional = {n for n, f in fields.items() if f.default is not dataclasses.MISSING or f.default_factory is not dataclasses.MISSING}
    faults = [f"{k}: unknown" for k in raw if k not in fields]
    faults += [f"{k}: missing" for k in fields if k not in raw and k not in optional]
    faults += [f"{k}: {v!r} is not {getattr(hints[k], '__name__', hints[k])}" for k, v in raw.items() if k in fields and not _fits(v, hints[k])]
    if faults:
        raise ConfigError(f"{where}: " + "; ".join(faults))
    try:
        return kind(**raw)
    except (TypeError, ValueError) as fault:
        raise ConfigError(f"{where}: {fault}") from fault


def load(spark: SparkSession, path: str, kind: type):
    return build(kind, read(spark, path), path)


def override(config, pairs: Iterable[str]):
    """(config, changes) with ``key=value`` pairs put in; a value is read as JSON if it is JSON, else taken as text."""
    known, changes = {f.name for f in dataclasses.fields(config)}, {}
    for pair in pairs:
        key, equals, value = pair.partition("=")
        if not equals or not value:
            raise ConfigError(f"{pair!r} is not key=value")
        if key not in known:
            raise ConfigError(f"{key!r} is not one of {', '.join(sorted(known))}")
        try:
            changes[key] = json.loads(value)
        except ValueError:
            changes[key] = value
    return build(type(config), dataclasses.asdict(config) | changes, "overrides"), changes


def require_digest(spark: SparkSession, path: str, pinned: str) -> None:
    """The file has the digest that a configuration pins; a digest of zeros is a place-holder and never passes."""
    if not files.SHA256.match(pinned):
        raise ConfigError(f"{pinned!r} is not a SHA-256 digest")
    if pinned == UNPINNED:
        raise ConfigError(f"the digest of {path} is still the place-holder")
    try:
        found = hashlib.sha256(files.read_bytes(spark, path)).hexdigest()
    except Exception as fault:
        raise ConfigError(f"cannot read {path}: {fault}") from fault
    if found != pinned:
        raise ConfigError(f"{path} has digest {found}, {pinned} is pinned")


@dataclasses.dataclass(frozen=True)
class Source:
    """One data set, pinned to a revision."""

    name: str
    uri: str
    revision: str
    license: str
    intended_use: typing.Literal["train", "eval"]
    citation: str
    loader: str
    answer_type: typing.Literal[ANSWER_TYPES]
    loader_params: dict = dataclasses.field(default_factory=dict)


@dataclasses.dataclass(frozen=True)
class SourceRegistry:
    version: str
    sources: dict

    def eval_names(self) -> frozenset[str]:
        return frozenset(n for n, s in self.sources.items() if s.intended_use == "eval")

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row for each source; small by nature, so it may be broadcast."""
        rows = [(key, s.name, s.uri, s.revision, s.license, s.intended_use, s.citation, s.loader, s.answer_type, json.dumps(files.plain(s.loader_params), sort_keys=True)) for key, s in sorted(self.sources.items())]
        return spark.createDataFrame(rows, "source string, name string, uri string, revision string, license string, intended_use string, citation string, loader string, answer_type string, loader_params string")


def source_registry(raw, where: str = "registry") -> SourceRegistry:
    """A registry of checked sources; the faults of all sources are told at once."""
    found, sources, faults = build(SourceRegistry, raw, where), {}, []
    for key, spec in found.sources.items():
        try:
            sources[key] = build(Source, spec, f"{where}.sources.{key}")
            if sources[key].loader not in LOADERS:
                faults.append(f"{where}.sources.{key}: loader {sources[key].loader!r} is not one of {', '.join(sorted(LOADERS))}")
        except ConfigError as fault:
            faults.append(str(fault))
    if faults:
        raise ConfigError("\n".join(faults))
    return dataclasses.replace(found, sources=sources)


def load_registry(spark: SparkSession, path: str) -> SourceRegistry:
    return source_registry(read(spark, path), path)


def resolve_split(spark: SparkSession, manifest: str, name: str, root: str | None = None) -> str | None:
    """Where a manifest's split lies: in ``root``, in ``processed/<manifest>`` beside the manifests' folder, beside the manifest, or, if
    only one file below the manifest's folder has the name, there; else null."""
    folder, _, own = manifest.rpartition("/")
    above = folder.rpartition("/")[0]
    likely = [root] if root else []
    likely += [f"{above}/processed/{own.rsplit('.', 1)[0]}", folder]
    for place in likely:
        if files.exists(spark, f"{place.rstrip('/')}/{name}"):
            return f"{place.rstrip('/')}/{name}"
    system, _ = file_system(spark, folder)
    below, pending = [], [folder]
    while pending:
        for status in system.listStatus(spark._jvm.org.apache.hadoop.fs.Path(pending.pop())):
            path = status.getPath()
            if path.getName() == name:
                below.append(path.toString())
            elif status.isDirectory():
                pending.append(path.toString())
    return below[0] if len(below) == 1 else None


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """Diagnostic JSON lines with text in ``source_hash`` and ``outcome``; a line without either fails the job. Blank lines are skipped."""
    line = spark.read.text(path).where(F.trim("value") != "").select("value", F.try_parse_json("value").alias("v"))
    text = {c: F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{c}", "variant")) == "STRING", F.try_variant_get("v", f"$.{c}", "string")) for c in ("source_hash", "outcome")}
    checked = {c: F.coalesce(t, F.raise_error(F.concat(F.lit(f"no text in {c}: "), "value"))).alias(c) for c, t in text.items()}
    return line.select(*checked.values(), F.col("value").alias("row"))
