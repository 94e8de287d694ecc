"""Webhook payloads and build descriptions, from JSON text to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators.events import pipeline_type

_USER = "struct<id: bigint, name: string, username: string, email: string>"
GITLAB_EVENT = f"""
  object_kind string,
  object_attributes struct<id: bigint, iid: bigint, url: string, ref: string, sha: string, status: string,
    source: string, stages: array<string>, created_at: string, finished_at: string, duration: double,
    variables: array<struct<key: string, value: string>>>,
  project struct<id: bigint, name: string, description: string, web_url: string, path_with_namespace: string>,
  merge_request map<string, string>,
  user {_USER},
  commit struct<id: string, message: string, timestamp: string, url: string, author: struct<name: string, email: string>>,
  builds array<struct<id: bigint, stage: string, name: string, status: string, created_at: string, started_at: string,
    finished_at: string, duration: double, allow_failure: boolean, user: {_USER},
    runner: struct<id: bigint, description: string, active: boolean, is_shared: boolean>>>"""
JENKINS_EVENT = """
  job_name string, build_number string, build_url string, status string, jenkins_url string, timestamp string,
  name string, number string, job struct<name: string, url: string>,
  build struct<number: string, url: string, status: string>"""
STAGE_META = """
  stages array<struct<id: string, name: string, status: string, durationMillis: bigint,
    stageFlowNodes: array<struct<name: string, status: string, durationMillis: bigint>>>>"""
BUILD_META = """
  duration bigint, timestamp bigint, result string,
  actions array<struct<_class: string, parameters: array<struct<name: string, value: string>>,
    causes: array<struct<_class: string, userId: string>>>>"""
CI_INSTANCES = "instances array<struct<jenkins_url: string, jenkins_user: string, description: string>>"


def read_json_text(spark: SparkSession, path: str, column: str = "body") -> DataFrame:
    """One JSON document per line, as text."""
    return spark.read.text(path).withColumnRenamed("value", column)


def read_json_files(spark: SparkSession, path: str, column: str = "body") -> DataFrame:
    """One JSON document per file, as text."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumnRenamed("value", column)


def _parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn("_e", F.from_json(column, schema)).drop(column)


def readable(events: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(rows whose text is a JSON object, all others as they came)."""
    good = F.from_json(column, "map<string, string>").isNotNull()
    return events.filter(good), events.filter(~good)


def gitlab_events(events: DataFrame, column: str = "body") -> DataFrame:
    """Pipeline events as typed rows; missing parts become nulls or empty lists. Text that is no JSON object gives no row; `readable`
    tells such rows apart."""
    events, _ = readable(events, column)
    a, p = F.col("_e.object_attributes"), F.col("_e.project")
    keep = [c for c in events.columns if c != column]
    return _parsed(events, column, GITLAB_EVENT).select(
        *keep,
        F.coalesce("_e.object_kind", F.lit("unknown")).alias("event_type"),
        a["id"].alias("pipeline_id"), a["url"].alias("pipeline_url"), p["id"].alias("project_id"),
        p["name"].alias("project_name"), p["path_with_namespace"].alias("project_path"),
        pipeline_type(a["source"], F.size("_e.merge_request") > 0).alias("pipeline_type"),
        a["status"].alias("status"), a["ref"].alias("ref"), a["sha"].alias("sha"), a["source"].alias("source"),
        text.parse_moment(a["created_at"]).alias("created_at"), text.parse_moment(a["finished_at"]).alias("finished_at"),
        a["duration"].alias("duration"), F.col("_e.user").alias("user"), F.col("_e.commit").alias("commit"),
        F.coalesce("_e.builds", F.array().cast(f"array<{_element(GITLAB_EVENT)}>")).alias("builds"),
        F.coalesce(a["stages"], F.array().cast("array<string>")).alias("stages"),
        F.coalesce(a["variables"], F.array().cast("array<struct<key: string, value: string>>")).alias("variables"),
    )


def _element(schema: str) -> str:
    """Element type of the `builds` array of a schema text."""
    return schema.split("builds array<", 1)[1].rsplit(">", 1)[0]


def jenkins_events(events: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(typed build rows, rejected rows). Four layouts are tried in order: custom, generic, notification, fallback."""
    e = F.col("_e")
    layout = (
        F.when(e["job_name"].isNotNull() & e["build_number"].isNotNull(), "custom")
        .when(e["job"].isNotNull() & e["build"].isNotNull(), "generic")
        .when(e["name"].isNotNull() & e["build"].isNotNull(), "notification")
        .otherwise("fallback")
    )
    kind, nested = F.col("layout"), F.col("layout").isin("generic", "notification")
    job = (
        F.when(kind == "custom", e["job_name"]).when(kind == "generic", F.coalesce(e["job"]["name"], F.lit("")))
        .when(kind == "notification", e["name"])
        .otherwise(F.coalesce(text.filled(e["job_name"]), text.filled(e["name"]), F.lit("unknown")))
    )
    number = (
        F.when(kind == "custom", e["build_number"]).when(nested, F.coalesce(e["build"]["number"], F.lit("0")))
        .otherwise(F.coalesce(text.filled(e["build_number"]), text.filled(e["number"])))
    ).try_cast("bigint")
    # The job part is removed as a suffix.
    job_url, suffix = F.coalesce(e["job"]["url"], F.lit("")), F.concat(F.lit("/job/"), F.coalesce(e["job"]["name"], F.lit("")))
    bare = F.rtrim(job_url, F.lit("/"))
    server = F.when(bare.endswith(suffix), F.left(bare, F.length(bare) - F.length(suffix))).otherwise(bare)
    keep = [c for c in events.columns if c != column]
    typed = events.withColumn("_e", F.from_json(column, JENKINS_EVENT)).withColumn("layout", layout).select(
        *keep, F.col(column), "layout", job.alias("job_name"), number.alias("build_number"),
        F.coalesce(F.when(nested, e["build"]["url"]).otherwise(e["build_url"]), F.lit("")).alias("build_url"),
        F.coalesce(F.when(nested, e["build"]["status"]).otherwise(e["status"]), F.lit("UNKNOWN")).alias("status"),
        F.when(kind == "generic", server).when(kind == "notification", "")
        .otherwise(F.coalesce(e["jenkins_url"], F.lit(""))).alias("jenkins_url"),
        F.when(kind == "custom", e["timestamp"]).alias("timestamp"),
    )
    bad = F.col("build_number").isNull() | ((kind == "fallback") & (F.col("build_number") == 0))
    return typed.filter(~bad).drop(column), typed.filter(bad).select(*keep, column)


def stage_meta(events: DataFrame, column: str = "body") -> DataFrame:
    """Stage rows (stage_pos, stage_id, name, status, duration_ms, nodes) of stage descriptions."""
    keep = [c for c in events.columns if c != column]
    s = F.col("_s")
    node = F.transform(
        F.coalesce(s["stageFlowNodes"], F.array().cast("array<struct<name: string, status: string, durationMillis: bigint>>")),
        lambda n: F.struct(
            F.coalesce(n["name"], F.lit("Unknown")).alias("name"), F.coalesce(n["status"], F.lit("UNKNOWN")).alias("status"),
            F.coalesce(n["durationMillis"], F.lit(0)).alias("duration_ms"),
        ),
    )
    return _parsed(events, column, STAGE_META).select(*keep, F.posexplode_outer("_e.stages").alias("stage_pos", "_s")).select(
        *keep, "stage_pos", F.coalesce(s["id"], F.lit("")).alias("stage_id"), F.coalesce(s["name"], F.lit("Unknown")).alias("name"),
        F.coalesce(s["status"], F.lit("UNKNOWN")).alias("status"),
        F.coalesce(s["durationMillis"], F.lit(0)).alias("duration_ms"), node.alias("nodes"),
    ).filter(F.col("stage_pos").isNotNull())


def stage_nodes(stages: DataFrame) -> DataFrame:
    keep = [c for c in stages.columns if c not in ("name", "status", "duration_ms", "nodes")]
    return stages.select(*keep, F.posexplode("nodes").alias("node_pos", "_n")).select(*keep, "node_pos", "_n.*")


def build_params(builds: DataFrame, column: str = "body") -> DataFrame:
    """Add parameters (a later value wins), duration_ms, started, result and user_id from build metadata text.

    `result` falls back to the `status` of the event.
    """
    from ..operators.payload import build_user

    actions = F.coalesce(F.col("_e.actions"), F.array().cast(_actions_type()))
    picked = F.filter(actions, lambda a: a["_class"] == fixed.PARAMETERS_ACTION)
    pairs = F.transform(
        F.flatten(F.transform(picked, lambda a: F.coalesce(a["parameters"], F.array().cast("array<struct<name: string, value: string>>")))),
        lambda p: F.struct(p["name"].alias("key"), p["value"].alias("value")),
    )
    return _parsed(builds, column, BUILD_META).withColumns(
        {
            "parameters": text.later_wins(pairs), "duration_ms": F.coalesce("_e.duration", F.lit(0)),
            "started": F.col("_e.timestamp"), "result": F.coalesce(F.col("_e.result"), F.col("status")),
            "user_id": build_user(actions),
        }
    ).drop("_e")


def _actions_type() -> Column:
    return BUILD_META.split("actions ", 1)[1]


def ci_instances(registry: DataFrame, column: str = "body") -> DataFrame:
    """Instance rows by normalised URL; the last entry for a URL wins. Credentials are not read."""
    url = text.normalize_url(F.col("_i.jenkins_url"))
    value = F.struct(F.col("_i.jenkins_user").alias("jenkins_user"), F.col("_i.description").alias("description"))
    return (
        _parsed(registry, column, CI_INSTANCES).select(F.posexplode("_e.instances").alias("_pos", "_i"))
        .groupBy(url.alias("jenkins_url")).agg(F.max_by(value, "_pos").alias("_v")).select("jenkins_url", "_v.*")
    )


def domain_patterns(files: DataFrame, column: str = "body") -> DataFrame:
    """{category: [{failure, solution}]} as rows; blank failures are dropped."""
    schema = "map<string, array<struct<failure: string, solution: string>>>"
    keep = [c for c in files.columns if c != column]
    return (
        files.select(*keep, F.explode(F.from_json(column, schema)).alias("category", "_items"))
        .select(*keep, "category", F.explode("_items").alias("_i")).select(*keep, "category", "_i.*")
        .filter(text.not_blank(F.col("failure")).isNotNull())
        .withColumn("solution", F.coalesce("solution", F.lit("")))
    )


def fix_import_json(files: DataFrame, column: str = "body") -> DataFrame:
    """Entries of fix files as MAP rows: a list, {"entries": []}, {"items": []} or a single object."""
    listed, single = "array<map<string, string>>", "map<string, string>"
    body = F.ltrim(column)
    top = F.from_json(column, single)

    def inner(key: str) -> Column:
        return F.when(F.ltrim(top[key]).startswith("["), F.from_json(top[key], listed))

    entries = F.when(body.startswith("["), F.from_json(column, listed)).otherwise(
        F.coalesce(inner("entries"), inner("items"), F.array(top))
    )
    keep = [c for c in files.columns if c != column]
    return files.select(*keep, F.explode(entries).alias("entry"))


def fix_import_csv(spark: SparkSession, path: str) -> DataFrame:
    """Entries of CSV fix files with a header, as MAP rows."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in rows.columns])
    return rows.select(F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("entry"))
