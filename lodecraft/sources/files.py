"""Small documents (configuration, manifests, markers) on any file system that Hadoop knows, and digests of written tables."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import file_system

SHA256 = re.compile(r"[0-9a-f]{64}\Z")
REVISION = re.compile(r"[0-9a-f]{40}\Z")


def exists(spark: SparkSession, path: str) -> bool:
    files, where = file_system(spark, path)
    return files.exists(where)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file as a whole, on the driver."""
    files, where = file_system(spark, path)
    stream = files.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def rename(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    """One rename: readers see the old file or the new one. On stores without renames it is a copy."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE if overwrite else option.NONE
    source, target = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
    context.rename(source, target, options)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> str:
    """Replace a small file by one rename; its SHA-256."""
    staged = f"{path}.{uuid.uuid4().hex}.tmp"
    files, where = file_system(spark, staged)
    stream = files.create(where, False)
    try:
        stream.write(content)
    finally:
        stream.close()
    rename(spark, staged, path, overwrite=True)
    return hashlib.sha256(content).hexdigest()


def read_json(spark: SparkSession, path: str):
    return json.loads(read_bytes(spark, path))


def write_json(spark: SparkSession, path: str, value) -> str:
    """Sorted keys, two spaces, a line feed at the end; the digest of what was written."""
    return write_bytes(spark, path, (json.dumps(plain(value), ensure_ascii=False, sort_keys=True, indent=2) + "\n").encode())


def plain(value):
    """Any value as JSON has it: scalars stay, sequences become lists, mappings get text keys, arrays' scalars their Python values, the rest text."""
    match value:
        case None | str() | bool() | int() | float():
            return value
        case list() | tuple():
            return [plain(v) for v in value]
        case dict():
            return {str(k): plain(v) for k, v in value.items()}
    return value.item() if hasattr(value, "item") else str(value)


def replace_folder(spark: SparkSession, staged: str, target: str) -> None:
    """Put a written folder in the place of another; the old one goes only once the new one is there, and comes back if that fails."""
    files, where = file_system(spark, target)
    aside = None
    if files.exists(where):
        aside = f"{target}.{uuid.uuid4().hex}.old"
        rename(spark, target, aside)
    try:
        rename(spark, staged, target)
    except BaseException:
        if aside:
            rename(spark, aside, target)
        raise
    if aside:
        files.delete(file_system(spark, aside)[1], True)


def empty_folder(spark: SparkSession, path: str) -> str:
    """``path``, made if it is not there; an error if anything lies in it."""
    files, where = file_system(spark, path)
    if files.exists(where) and len(files.listStatus(where)):
        raise FileExistsError(f"{path} is not empty")
    files.mkdirs(where)
    return path


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of each data file of a folder, hashed by executors; a file has to be under 2 GB."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(~name.rlike(r"^[._]")).select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def folder_digest(spark: SparkSession, path: str) -> str:
    """One digest of a folder: that of its files' digests in order. Only digests are gathered, a line for each file."""
    lines = file_digests(spark, path).agg(F.array_join(F.array_sort(F.collect_list("sha256")), "\n").alias("d")).first()["d"]
    return hashlib.sha256(lines.encode()).hexdigest()


def ids_digest(ids: DataFrame, column: str) -> str:
    """Digest of a set of ids: sorted ids of each of 65,536 ranges (by the first four hex digits of MD5) are hashed on executors, then the digests of ranges in order.

    It depends on the ids alone, never on partitions, and no task holds more than a 65,536th of them.
    """
    keyed = ids.select(F.col(column).cast("string").alias("id")).withColumn("range", F.substring(F.md5("id"), 1, 4))
    ranges = keyed.groupBy("range").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("d"))
    joined = ranges.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "d"))), lambda r: r["d"]), "\n").alias("d")).first()["d"]
    return hashlib.sha256(joined.encode()).hexdigest()
