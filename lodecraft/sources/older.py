"""Trajectory files and training checkpoints of the older workflow: JSON documents with nested states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

# The fields of the files. States and metadata are free objects and stay JSON text.
TRANSITIONS = "array<struct<state:string,action:string,next_state:string,reward:double,done:boolean,info:string>>"
TRAJECTORY = f"query string, route_decision string, transitions {TRANSITIONS}, final_answer string, success boolean, total_reward double, steps long, timestamp string, metadata string"
METRICS = "episode long, avg_reward double, success_rate double, avg_steps double, timestamp string"


def _inside(columns: str) -> str:
    """The columns of a table as the fields of a struct."""
    return ",".join(c.replace(" ", ":", 1) for c in columns.split(", "))


def _recount(rows: DataFrame) -> DataFrame:
    """``steps`` and ``total_reward`` from the transitions alone; what a file says of them is not added."""
    list_ = F.coalesce("transitions", F.array().cast(TRANSITIONS))
    total = F.aggregate(list_, F.lit(0.0), lambda a, t: a + F.coalesce(t["reward"], F.lit(0.0)))
    return rows.withColumn("transitions", list_).withColumn("steps", F.size("transitions").cast("long")).withColumn("total_reward", F.round(total, 9))


def read_trajectories(spark: SparkSession, path: str | Sequence[str], layout: str = "lines") -> DataFrame:
    """``TRAJECTORY`` rows of files: ``lines``, a trajectory a line; ``document``, one object a file with a list of them and statistics.

    Documents are read whole, one a task at least, so large corpora are kept as lines. A trajectory without transitions has none (not null). Lines that are no JSON are left out.
    """
    if layout == "lines":
        return _recount(spark.read.schema(TRAJECTORY).option("mode", "DROPMALFORMED").json(path))
    if layout != "document":
        raise ValueError(f"unknown layout {layout}; known: document, lines")
    found = spark.read.schema(f"trajectories array<struct<{_inside(TRAJECTORY)}>>").json(path, multiLine=True)
    return _recount(found.select(F.inline("trajectories")))


def _text(value) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.struct(value.alias("a")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _as_objects(rows: DataFrame) -> DataFrame:
    """One JSON text for each trajectory, in which states and metadata are objects again."""

    def member(name: str, value) -> Column:
        return F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null")))

    def free(value) -> Column:
        return F.coalesce(F.translate(value, "\r\n", "  "), F.lit("{}"))  # in JSON, line feeds stand between its parts only

    inner = F.transform("transitions", lambda t: F.concat(F.lit("{"), F.concat_ws(",", member("state", free(t["state"])), member("action", _text(t["action"])), member("next_state", free(t["next_state"])), member("reward", t["reward"].cast("string")), member("done", t["done"].cast("string")), member("info", free(t["info"]))), F.lit("}")))
    plain = [member(c, _text(F.col(c))) for c in ("query", "route_decision", "final_answer", "timestamp")] + [member(c, F.col(c).cast("string")) for c in ("success", "total_reward", "steps")]
    return rows.select(F.concat(F.lit("{"), F.concat_ws(",", *plain, member("metadata", free(F.col("metadata")))), F.lit(',"transitions":['), F.array_join(inner, ","), F.lit("]}")).alias("value"))


def write_trajectories(rows: DataFrame, path: str) -> None:
    """Write ``TRAJECTORY`` rows as lines, by all tasks at once; ``steps`` and ``total_reward`` are counted anew."""
    _as_objects(_recount(rows)).write.mode("errorifexists").text(path)


def write_checkpoint(spark: SparkSession, path: str, config: Mapping, episode: int, metrics: Sequence[Mapping], timestamp: str) -> str:
    """A small JSON document, replaced by one rename; its SHA-256."""
    return files.write_json(spark, path, {"config": files.plain(dict(config)), "episode": episode, "metrics": [files.plain(dict(m)) for m in metrics], "timestamp": timestamp})


def read_checkpoint(spark: SparkSession, path: str, schema: str = METRICS) -> tuple[dict, int, DataFrame]:
    """(config, episode, metrics in their order: place and ``schema``). A field that is missing is null, an episode that is missing 0."""
    found = files.read_json(spark, path)
    rows = spark.read.schema(f"metrics array<struct<{_inside(schema)}>>").json(path, multiLine=True)
    return found.get("config", {}), int(found.get("episode", 0)), rows.select(F.posexplode("metrics").alias("place", "m")).select("place", "m.*")
