"""CI tables derived from the driver tables, so that every operator runs over whole real rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocked import number_rows
from ..operators.shared import settle

S = SparkSession

_stored: dict[tuple, DataFrame] = {}


def _version(spark: S, sf: str) -> tuple:
    """Names, times and sizes of the input tables: changed tables are ingested anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in listed))


def stored(spark: S, sf: str, name: str, df: DataFrame) -> DataFrame:
    """Ingest once: the rows are written as a table in the shared folder and read from there afterwards."""
    key = (spark.sparkContext.applicationId, sf, name, _version(spark, sf))
    if key in _stored:
        try:
            return spark.read.schema(df.schema).parquet(*_stored[key].inputFiles())
        except AnalysisException:  # the folder was cleared in the meantime
            pass
    _stored[key] = settle(df, name)
    return _stored[key]


def table(spark: S, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def numbered_events(spark: S, sf: str) -> DataFrame:
    """Events as lines of one log per user; numbering is cut by hour, so no user is sorted in one task."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    numbered = number_rows(
        events.withColumnRenamed("user_id", "log_id"), ["log_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "line_no"
    )
    return stored(spark, sf, "numbered_events", numbered)


def _raw() -> F.Column:
    i = F.col("event_id")
    s = i.cast("string")
    err = F.col("event_type") == "error"
    return (
        F.when(err & (i % 7 == 0), F.concat(F.lit("ERROR: tag v"), s))
        .when(err & (i % 5 == 0), F.lit("\x1b[31mTraceback\x1b[0m (most recent call last)"))
        .when(err & (i % 3 == 0), F.concat(F.lit("[12:00:00]make: *** [t"), s, F.lit("] Error 2")))
        .when(err, F.concat(F.lit("2024-01-01 00:00:00,123  build   failed "), s))
        .when((F.col("event_type") == "purchase") & (i % 11 == 0), F.lit(""))
        .otherwise(F.concat(F.col("event_type"), F.lit(" step "), s, F.lit(" é✗")))
    )


def log_lines(spark: S, sf: str) -> DataFrame:
    return numbered_events(spark, sf).select("log_id", "line_no", _raw().alias("raw"))


def console(spark: S, sf: str) -> DataFrame:
    """Console with one-line stage markers and parallel blocks."""
    m, n = F.col("line_no") % 20, F.floor(F.col("line_no") / 20).cast("string")
    marker = (
        F.when(m == 0, F.concat(F.lit("[Pipeline] stage (S"), n, F.lit(")")))
        .when(m == 5, F.lit("[Pipeline] parallel"))
        .when(m.isin(6, 10), F.concat(F.lit("[Pipeline] { (B"), n, F.when(m == 10, "x").otherwise(""), F.lit(")")))
        .when(m.isin(9, 13), F.lit("[Pipeline] }"))
        .when(m == 14, F.lit("[Pipeline] // parallel"))
        .when(m == 19, F.lit("[Pipeline] // stage"))
    )
    return log_lines(spark, sf).withColumn("raw", F.coalesce(marker, F.col("raw")))


def console_steps(spark: S, sf: str) -> DataFrame:
    """Console in the two-line style: a bare stage marker, then a block with the stage name."""
    m, n = F.col("line_no") % 20, F.floor(F.col("line_no") / 20).cast("string")
    marker = (
        F.when(m == 0, F.lit("[Pipeline] stage"))
        .when(m == 1, F.concat(F.lit("[Pipeline] { (S"), n, F.lit(")")))
        .when(m == 6, F.concat(F.lit("[Pipeline] { (B"), n, F.lit("-unit)")))
        .when(m == 9, F.lit("[Pipeline] }"))
        .when(m == 19, F.lit("[Pipeline] // stage"))
    )
    return log_lines(spark, sf).withColumn("raw", F.coalesce(marker, F.col("raw")))


def console_nested(spark: S, sf: str) -> DataFrame:
    """Console with stages inside parallel blocks inside stages, in both styles; some closing markers close nothing."""
    m, n = F.col("line_no") % 40, F.floor(F.col("line_no") / 40)
    name = n.cast("string")
    marker = (
        F.when(m == 0, F.lit("[Pipeline] stage"))
        .when(m == 1, F.concat(F.lit("[Pipeline] { (S"), name, F.lit(")")))
        .when(m == 4, F.lit("[Pipeline] parallel"))
        .when(m == 5, F.concat(F.lit("[Pipeline] { (Branch: A"), name, F.lit(")")))
        .when(m == 6, F.concat(F.lit("[Pipeline] stage (I"), name, F.lit(")")))
        .when(m.isin(9, 31), F.lit("[Pipeline] // stage"))
        .when(m.isin(10, 17, 30), F.lit("[Pipeline] }"))
        .when(m == 11, F.concat(F.lit("[Pipeline] { (B"), name, F.lit(")")))
        .when(m == 18, F.lit("[Pipeline] // parallel"))
        .when((m == 35) & (n % 2 == 0), F.lit("[Pipeline] // stage"))
    )
    return log_lines(spark, sf).withColumn("raw", F.coalesce(marker, F.col("raw")))


def nested_meta(spark: S, sf: str) -> DataFrame:
    """Stage descriptions of `console_nested`: outer stages with two blocks, inner ones, and some the log does not hold."""
    n = F.floor(F.col("line_no") / 40)
    numbers = numbered_events(spark, sf).select("log_id", n.alias("n")).distinct()
    name = F.col("n").cast("string")

    def node(prefix):
        return F.struct(F.concat(F.lit(prefix), name).alias("name"), F.lit("SUCCESS").alias("status"), (F.col("n") * 10).alias("duration_ms"))

    outer = numbers.select("log_id", (F.col("n") * 2).alias("stage_pos"), F.concat(F.lit("s"), name).alias("name"), F.array(node("A"), node("B")).alias("nodes"), "n")
    inner = numbers.select("log_id", (F.col("n") * 2 + 1).alias("stage_pos"), F.concat(F.when(F.col("n") % 3 == 2, "ZZ").otherwise("I"), name).alias("name"),
                           F.array(node("x")).alias("nodes"), "n")
    return outer.unionByName(inner).select("log_id", "stage_pos", "name", F.lit("FAILED").alias("status"), (F.col("n") * 100).alias("duration_ms"), "nodes")


def requests(spark: S, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    u, i, k = F.col("user_id"), F.col("event_id"), F.col("event_type")
    status = (
        F.when(k.isin("view", "click"), "completed").when(k == "purchase", "skipped").when(k == "error", "failed")
        .otherwise("processing")
    )
    kind = F.when(u % 4 == 0, "main").when(u % 4 == 1, "child").when(u % 4 == 2, "merge_request")
    return e.select(
        i.alias("id"), F.col("ts").alias("timestamp"), (u % 10).alias("project_id"), u.alias("pipeline_id"),
        kind.alias("pipeline_type"), status.alias("status"),
        F.when(i % 2 == 0, "main").otherwise("dev").alias("ref"), F.md5(i.cast("string")).alias("sha"),
        F.when(u % 4 == 1, "parent_pipeline").otherwise("push").alias("source"),
        F.lit("Pipeline Hook").alias("event_type"),
        F.concat(F.lit("10.0.0."), (u % 250).cast("string")).alias("client_ip"),
        F.when(i % 13 != 0, F.col("value")).alias("processing_time"),
        (i % 6 + i % 3).cast("int").alias("job_count"),
        F.when(k != "signup", i % 6).cast("int").alias("success_count"),
        F.when(i % 5 != 0, i % 3).cast("int").alias("error_count"),
        F.when(k == "error", F.concat(F.lit("boom "), i.cast("string"))).alias("error_message"),
        F.concat(F.lit('{"project_name": "p'), (u % 10).cast("string"), F.lit('"}')).alias("metadata"),
    )


def request_updates(spark: S, sf: str) -> DataFrame:
    """State changes: every request goes to processing; those not still processing get a final state later."""
    r = requests(spark, sf)
    none = F.lit(None)
    first = r.select(
        "id", (F.col("id") * 2).alias("event_seq"), F.lit("processing").alias("status"),
        none.cast("double").alias("processing_time"), none.cast("int").alias("success_count"),
        none.cast("int").alias("error_count"), none.cast("string").alias("error_message"),
    )
    last = r.filter(F.col("status") != "processing").select(
        "id", (F.col("id") * 2 + 1).alias("event_seq"), "status", "processing_time", "success_count", "error_count",
        "error_message",
    )
    return first.unionByName(last)


def pipelines(spark: S, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    s = k.cast("string")
    project = (c % 25).cast("string")
    return o.select(
        k.alias("pipeline_id"),
        F.concat(F.lit("https://ci.example.com/p/"), s).alias("pipeline_url"),
        F.when(k % 10 < 9, "Pipeline Hook").otherwise("Push Hook").alias("event_type"),
        (c % 25).alias("project_id"),
        F.when(c % 3 == 0, F.concat(F.lit("NATION_"), project)).otherwise(
            F.concat(F.lit("group é/NATION_"), project)).alias("project_name"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "success")
        .otherwise("running").alias("status"),
        F.when(p == "1-URGENT", "push").when(p == "2-HIGH", "parent_pipeline").when(p == "3-MEDIUM", "schedule")
        .when(p == "5-LOW", "api").otherwise("external_pr").alias("source"),
        (k % 5 == 0).alias("has_merge_request"),
        F.when(k % 2 == 0, "main").otherwise(F.concat(F.lit("feature/"), s)).alias("ref"),
        F.when(k % 13 != 0, F.md5(s)).alias("sha"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.when(k % 17 != 0, (k % 400).cast("double")).alias("duration"),
        F.when(k % 3 != 0, F.concat(F.lit("user"), (c % 100).cast("string"))).alias("username"),
        F.when(k % 6 != 0, F.concat(F.lit("Name "), (c % 100).cast("string"))).alias("user_full_name"),
        F.when(k % 11 == 0, F.array(F.lit("build"), F.lit("external"))).otherwise(
            F.array(F.lit("build"), F.lit("test"))).alias("stages"),
    )


JOB_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def jobs_key() -> F.Column:
    return F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")
    )


def jobs(spark: S, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    key = jobs_key()
    flag = F.col("l_returnflag")
    return li.select(
        F.col("l_orderkey").alias("pipeline_id"), key.alias("job_id"),
        F.concat(F.lit("job "), F.col("l_linenumber").cast("string")).alias("name"),
        F.when(F.col("l_linestatus") == "F", "build").otherwise("test").alias("stage"),
        F.when(flag == "R", "failed").when(flag == "A", "success").when(F.col("l_linenumber") == 7, "skipped")
        .otherwise("canceled").alias("status"),
        F.col("l_quantity").alias("duration"),
        F.col("l_partkey").alias("log_id"),
        F.struct(*JOB_ORDER).alias("job_order"),
    )


def stage_numbers(spark: S, sf: str) -> DataFrame:
    """One row per console and stage number."""
    return numbered_events(spark, sf).select("log_id", F.floor(F.col("line_no") / 20).alias("n")).distinct()


def stage_meta(spark: S, sf: str) -> DataFrame:
    """Stage descriptions: stages with two flow nodes are parallel, others have one."""
    n, k = F.col("n").cast("string"), F.col("log_id") + F.col("n")

    def node(name, status):
        return F.struct(name.alias("name"), status.alias("status"), (F.col("n") * 10).alias("duration_ms"))

    first = node(F.concat(F.lit("B"), n), F.when(k % 2 == 0, "FAILED").otherwise("SUCCESS"))
    second = node(F.concat(F.lit("B"), n, F.lit("x")), F.when(k % 3 == 0, "SUCCESS").otherwise("FAILED"))
    return stage_numbers(spark, sf).select(
        "log_id", F.col("n").alias("stage_pos"), F.concat(F.lit("S"), n).alias("name"),
        F.when(k % 3 == 0, "FAILED").otherwise("SUCCESS").alias("status"), (F.col("n") * 100).alias("duration_ms"),
        F.when(k % 2 == 0, F.array(first, second)).otherwise(F.array(first)).alias("nodes"),
    )


def failed_stages(spark: S, sf: str) -> DataFrame:
    """Failed stages with the failed step's name (null for some) and, for some, a name the console does not hold."""
    n, k = F.col("n").cast("string"), F.col("log_id") + F.col("n")
    return stage_numbers(spark, sf).filter(k % 3 == 0).select(
        "log_id", F.col("n").alias("stage_pos"),
        F.concat(F.when(k % 7 == 0, F.lit("ZZ")).otherwise(F.lit("S")), n).alias("name"),
        F.when(k % 2 == 0, F.concat(F.when(k % 4 == 0, "B").otherwise("QQ"), n)).alias("step_name"),
        (k % 5 == 0).alias("has_own_log"),
    )


def own_stage_logs(spark: S, sf: str) -> DataFrame:
    """Own logs of the failed stages that have one: the log lines of that stage."""
    lines = log_lines(spark, sf).withColumn("stage_pos", F.floor(F.col("line_no") / 20))
    owners = failed_stages(spark, sf).filter("has_own_log").select("log_id", "stage_pos", "name")
    return lines.join(owners, ["log_id", "stage_pos"]).select("log_id", "name", "line_no", "raw")


def builds(spark: S, sf: str) -> DataFrame:
    """Build events with parameters; who started them varies by key."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = k.cast("string")
    entries = F.array(
        F.struct(F.when(k % 2 == 0, "gitlabSourceNamespace").otherwise("sourceNamespace").alias("key"),
                 F.when(k % 19 != 0, "group").alias("value")),
        F.struct(F.lit("gitlabSourceRepoName").alias("key"), F.concat(F.lit("NATION_"), (c % 25).cast("string")).alias("value")),
        F.struct(F.lit("gitlabMergeRequestIid").alias("key"),
                 F.when(k % 3 == 0, F.concat(F.lit("!"), s)).when(k % 3 == 1, c.cast("string")).alias("value")),
        F.struct(F.lit("gitlabMergeRequestLastCommit").alias("key"),
                 F.when(k % 2 == 0, "unknown").otherwise(F.md5(s)).alias("value")),
        F.struct(F.lit("gitlabSourceBranch").alias("key"),
                 F.when(k % 7 == 0, "unknown").otherwise(F.concat(F.lit("br"), s)).alias("value")),
    )
    return stored(spark, sf, "builds", table(spark, sf, "orders").select(
        k.alias("build_id"), F.concat(F.lit("job "), (c % 40).cast("string")).alias("job_name"),
        F.concat(F.lit("https://ci"), (c % 30).cast("string"), F.lit(".example.com/job/"), s).alias("build_url"),
        F.when(c % 31 != 0, F.concat(F.lit("HTTPS://CI"), (c % 30).cast("string"), F.lit(".example.com//"))).otherwise("").alias("jenkins_url"),
        F.when(k % 4 == 0, "Jenkins").when(k % 4 == 1, F.concat(F.lit("user"), (c % 50).cast("string"))).alias("user_id"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("parameters"),
    ))


def ci_projects(spark: S, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").filter("n_regionkey <> 4")
    return n.select(F.lit("group").alias("namespace"), F.col("n_name").alias("repo"), F.col("n_nationkey").cast("bigint").alias("project_id"))


def ci_merge_requests(spark: S, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        (F.col("c_custkey") % 25).alias("project_id"), F.col("c_custkey").alias("iid"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("mr"), F.col("c_custkey").cast("string"))).alias("username"),
    )


def ci_commits(spark: S, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = k.cast("string")
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 25).alias("project_id"), F.md5(s).alias("sha"),
        F.when(k % 5 < 3, F.concat(F.lit("dev"), s, F.lit("@mail.example"))).otherwise("").alias("author_email"),
        F.when(k % 5 == 3, F.concat(F.lit("Dev "), s)).alias("author_name"),
    )


def ci_branches(spark: S, sf: str) -> DataFrame:
    s = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 25).alias("project_id"), F.concat(F.lit("br"), s).alias("name"), F.md5(s).alias("head_sha")
    )


def ci_instances(spark: S, sf: str) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    return table(spark, sf, "nation").select(
        F.concat(F.lit("https://ci"), n, F.lit(".example.com/")).alias("jenkins_url"),
        F.concat(F.lit("bot"), n).alias("jenkins_user"),
        F.concat(F.lit("CI of "), F.col("n_name")).alias("description"),
    )


def users(spark: S, sf: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    dotted = F.lower(F.replace(name, F.lit("#"), F.lit(".")))
    return table(spark, sf, "customer").select(
        F.concat(F.lit("U"), k.cast("string")).alias("id"), k.alias("pos"),
        F.concat(dotted, F.lit("@internal.com")).alias("email"), name.alias("real_name"), dotted.alias("name"),
    )


def people(spark: S, sf: str) -> DataFrame:
    """Who to find: addresses, names in odd case, parts of names and strangers, one per order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    pad = F.lpad(c, 9, "0")
    return table(spark, sf, "orders").select(
        k.alias("order_id"),
        F.when(k % 6 == 0, F.concat(F.lit("customer."), pad, F.lit("@internal.com")))
        .when(k % 6 == 1, F.concat(F.lit("CUSTOMER#"), pad))
        .when(k % 6 == 2, F.concat(F.lit("customer."), pad))
        .when(k % 6 == 3, c)
        .when(k % 6 == 4, F.concat(F.lit("stranger"), c, F.lit("@else.example")))
        .otherwise(F.concat(F.lit("R#0"), F.right(pad, F.lit(3)))).alias("person"),
    )


def job_logs(spark: S, sf: str) -> DataFrame:
    """Fetch results for jobs: some fail, some are missing, the rest name a text of `log_texts`."""
    s = F.col("l_suppkey") % 10
    return table(spark, sf, "lineitem").filter(s < 9).select(
        jobs_key().alias("job_id"), F.lit(200).alias("fetch_status"), F.col("l_partkey").alias("text_id"),
        F.when(s == 0, "timeout").alias("fetch_error"),
    )


def log_texts(spark: S, sf: str) -> DataFrame:
    """Texts of logs: the documents."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), F.col("text").alias("content"))


def fixes(spark: S, sf: str) -> DataFrame:
    """Stored fixes; blank and placeholder texts occur."""
    v, s, label = F.col("vec_id"), F.col("vec_id").cast("string"), F.col("label")
    return table(spark, sf, "embeddings").filter("vec_id % 10 <> 0").select(
        F.concat(F.lit("fix-"), s).alias("id"), F.concat(F.lit("Error V"), s).alias("error_text"),
        F.when(label == 7, " ").when(label == 8, "(empty fix)").when(label == 9, "").otherwise(F.concat(F.lit("do "), s)).alias("fix_text"),
        F.when(v % 3 == 0, "alice").alias("approved_by"), F.when(v % 4 != 0, "approved").alias("status"), "embedding",
    )


def fix_queries(spark: S, sf: str) -> DataFrame:
    """Error vectors: a stored vector plus a share of another one, so that similarities spread over the thresholds."""
    e = table(spark, sf, "embeddings")
    own = e.filter("vec_id % 10 = 0").select("vec_id", F.col("embedding").alias("_a"))
    near = e.filter("vec_id % 10 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_b"))
    share = (F.lit(2) + F.col("vec_id") / 10 % 6) / 10
    mixed = F.zip_with("_b", "_a", lambda b, a: (b.cast("double") + a.cast("double") * F.col("_w")))
    return own.join(near, "vec_id").withColumn("_w", share.cast("double")).select(
        F.sha2(F.concat(F.lit("error q"), F.col("vec_id").cast("string")), 256).alias("error_hash"), "vec_id",
        F.concat(F.lit(" error q"), F.col("vec_id").cast("string"), F.lit("\n\n  line two ")).alias("error_text"),
        mixed.alias("embedding"),
    )


def domain_patterns(spark: S, sf: str) -> DataFrame:
    """Domain patterns with vectors: benchmark passages."""
    b, e = table(spark, sf, "benchmark"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    i = F.col("item_id")
    return b.withColumn("item_id", i * 10 + 1).join(e, "item_id").select(
        F.concat(F.lit("p"), i.cast("string")).alias("id"), i.alias("seq"),
        F.when(i % 3 == 0, "IT").when(i % 3 == 1, "Product").otherwise("Devops").alias("category"),
        F.when(i % 70 == 1, " ").otherwise(F.col("text")).alias("failure"),
        F.concat(F.lit("see "), i.cast("string")).alias("solution"), "embedding",
    )


def reviews(spark: S, sf: str) -> DataFrame:
    """Review actions: assistant and system turns press buttons, user turns reply."""
    n, c = F.length("text"), F.col("conv_id")
    button = F.col("role") != "user"
    act = F.when(F.col("role") == "system", "edit").when(n % 5 == 0, "approve").when(n % 5 == 4, "discard").otherwise("edit")
    return table(spark, sf, "conversations").select(
        c.alias("error_id"), F.col("turn").alias("seq"), F.when(button, "button").otherwise("reply").alias("kind"),
        F.when(button, act).alias("action"),
        F.concat(F.lit("U"), F.when(n % 4 == 0, c % 2 + 1).otherwise(c % 2).cast("string")).alias("user_id"),
        F.lit("c1").alias("channel_id"),
        F.when(~button & (n % 5 != 0), F.concat(F.when(n % 5 == 1, "x").otherwise("m"), c.cast("string"))).alias("thread_ts"),
        F.when(~button, F.concat(F.lit(" try "), n.cast("string"), F.lit(" "))).alias("text"),
    )


def review_records(spark: S, sf: str) -> DataFrame:
    c = F.col("conv_id").cast("string")
    return table(spark, sf, "conversations").select("conv_id").distinct().filter("conv_id % 6 <> 5").select(
        F.col("conv_id").alias("error_id"), F.concat(F.lit("err "), c).alias("error"), F.concat(F.lit("fix "), c).alias("fix"),
        F.lit("c1").alias("channel_id"), F.concat(F.lit("m"), c).alias("message_ts"),
    )


# ---- raw inputs, as the outside world sends them ----

def _json(df: DataFrame, keys: list[str]) -> DataFrame:
    """The other columns as one JSON document per row."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias("body"))


def gitlab_payloads(spark: S, sf: str) -> DataFrame:
    """Pipeline webhooks: (pipeline_no, hook, body). Nulls are left out of the JSON, as a sender would."""
    p = pipelines(spark, sf)
    k = F.col("pipeline_id")
    created = F.when(k % 2 == 0, F.concat("created_at", F.lit(" UTC"))).otherwise(
        F.concat(F.translate("created_at", " ", "T"), F.lit("Z")))
    attributes = F.struct(
        k.alias("id"), F.col("pipeline_url").alias("url"), "ref", "sha", "status", "source", "stages",
        created.alias("created_at"), "duration",
    )
    build = F.struct((k * 10).alias("id"), F.lit("build").alias("stage"), F.lit("compile").alias("name"), "status",
                     F.when(k % 2 == 0, True).alias("allow_failure"))
    body = p.select(
        F.col("pipeline_id").alias("pipeline_no"), F.col("event_type").alias("hook"),
        F.when(k % 4 != 0, "pipeline").alias("object_kind"), attributes.alias("object_attributes"),
        F.struct(F.col("project_id").alias("id"), F.col("project_name").alias("name")).alias("project"),
        F.when(F.col("has_merge_request"), F.struct(k.alias("iid"))).otherwise(
            F.when(k % 5 == 1, F.struct(F.lit(None).cast("bigint").alias("iid")))).alias("merge_request"),
        F.struct("username", F.col("user_full_name").alias("name")).alias("user"), F.array(build).alias("builds"),
    )
    return _json(body, ["pipeline_no", "hook"])


def all_deliveries(spark: S, sf: str) -> DataFrame:
    """Pipeline webhooks, and for every ninth a second delivery that broke off in its middle."""
    sent = gitlab_payloads(spark, sf)
    broken = sent.filter("pipeline_no % 9 = 0").withColumn("body", F.left("body", F.length("body") / 2))
    return sent.unionByName(broken)


def jenkins_payloads(spark: S, sf: str) -> DataFrame:
    """Build webhooks in the four layouts; some of the last have no build number."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    s = k.cast("string")
    name = F.concat(F.lit("job-"), (F.col("o_custkey") % 40).cast("string"))
    url = F.concat(F.lit("https://bob.example.com/job/"), name)
    m = k % 5
    nested = F.struct(s.alias("number"), F.concat(F.lit("u"), s).alias("url"), F.when(k % 2 == 0, "FAILURE").alias("status"))
    body = o.select(
        k.alias("event_no"), F.when(m == 0, name).alias("job_name"), F.when(m == 0, s).alias("build_number"),
        F.when(m == 0, "https://ci.example.com/").alias("jenkins_url"), F.when(m == 0, "t1").alias("timestamp"),
        F.when(m == 1, F.struct(name.alias("name"), url.alias("url"))).alias("job"),
        F.when(m.isin(1, 2), nested).alias("build"), F.when(m.isin(2, 3, 4), name).alias("name"),
        F.when(m == 3, s).alias("number"),
    )
    return _json(body, ["event_no"])


def stage_payloads(spark: S, sf: str) -> DataFrame:
    """Stage descriptions: one document per console."""
    nodes = F.transform("nodes", lambda n: F.struct(n["name"].alias("name"), n["status"].alias("status"), n["duration_ms"].alias("durationMillis")))
    stage = F.struct(F.col("stage_pos").cast("string").alias("id"), "name", "status", F.col("duration_ms").alias("durationMillis"), nodes.alias("stageFlowNodes"))
    return _json(stage_meta(spark, sf).select("log_id", "stage_pos", F.array(stage).alias("stages")), ["log_id", "stage_pos"])


def build_payloads(spark: S, sf: str) -> DataFrame:
    """Build metadata with repeated parameters, several actions and causes."""
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")

    def param(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    def action(kind, params, user):
        return F.struct(F.lit(kind).alias("_class"), params.alias("parameters"), user.alias("causes"))

    no_params = F.lit(None).cast("array<struct<name: string, value: string>>")
    no_causes = F.lit(None).cast("array<struct<_class: string, userId: string>>")
    user = F.array(
        F.struct(F.lit("hudson.model.Cause$RemoteCause").alias("_class"), F.lit("remote").alias("userId")),
        F.struct(F.lit("hudson.model.Cause$UserIdCause").alias("_class"), F.when(k % 3 != 0, F.concat(F.lit("user"), c)).alias("userId")),
    )
    actions = F.array(
        action("hudson.model.CauseAction", no_params, user),
        action("hudson.model.ParametersAction", F.array(param("branch", F.lit("old")), param("repo", F.concat(F.lit("r"), c))), no_causes),
        action("other.Action", F.array(param("branch", F.lit("no"))), no_causes),
        action("hudson.model.ParametersAction", F.array(param("branch", F.concat(F.lit("b"), c))), no_causes),
    )
    body = o.select(
        k.alias("build_id"), F.lit("UNKNOWN").alias("status"), F.when(k % 2 == 0, k * 5).alias("duration"),
        (k + 1000).alias("timestamp"), F.when(k % 4 != 0, "FAILURE").alias("result"), actions.alias("actions"),
    )
    return _json(body, ["build_id", "status"])


def fix_files(spark: S, sf: str) -> DataFrame:
    """Fix import files in four shapes, one per labelled document; toxic ones have a blank fix."""
    d, q = F.col("doc_id"), F.col("quality").cast("string")
    entry = F.struct(
        F.when(d % 2 == 0, F.col("text")).alias("error_text"), F.when(d % 2 == 1, F.col("text")).alias("error"),
        F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("fix "), d.cast("string"))).alias("fix"),
        F.when(d % 3 == 0, "ann").alias("approver"), F.when(d % 3 == 1, "ben").alias("approved_by"), q.alias("quality"),
    )
    e = F.to_json(entry)
    body = (
        F.when(d % 4 == 0, F.concat(F.lit(" ["), e, F.lit("]"))).when(d % 4 == 1, F.concat(F.lit('{"entries": ['), e, F.lit("]}")))
        .when(d % 4 == 2, F.concat(F.lit('{"items": ['), e, F.lit("]}"))).otherwise(e)
    )
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", body.alias("body"))


def domain_files(spark: S, sf: str) -> DataFrame:
    """Domain pattern files, one per benchmark item."""
    i = F.col("item_id")
    item = F.struct(F.when(i % 7 == 0, "  ").otherwise(F.col("text")).alias("failure"),
                    F.when(i % 3 != 0, F.concat(F.lit("see "), i.cast("string"))).alias("solution"))
    category = F.when(i % 2 == 0, "IT").otherwise("Devops")
    body = F.concat(F.lit('{"'), category, F.lit('": ['), F.to_json(item), F.lit("]}"))
    return table(spark, sf, "benchmark").select(i.alias("item_id"), body.alias("body"))


def registry_files(spark: S, sf: str) -> DataFrame:
    """Instance registries, one per nation, each naming its URL twice."""
    n = F.col("n_nationkey").cast("string")

    def inst(url, user):
        return F.struct(url.alias("jenkins_url"), user.alias("jenkins_user"), F.col("n_name").alias("description"))

    both = F.array(
        inst(F.concat(F.lit("https://CI"), n, F.lit(".example.com/")), F.concat(F.lit("old"), n)),
        inst(F.concat(F.lit("https://ci"), n, F.lit(".example.com")), F.concat(F.lit("bot"), n)),
    )
    return _json(table(spark, sf, "nation").select("n_nationkey", both.alias("instances")), ["n_nationkey"])


def app_log_lines(spark: S, sf: str) -> DataFrame:
    """Lines of the service log, one file per user, with continuation lines."""
    e = numbered_events(spark, sf)
    i, u = F.col("event_id"), F.col("log_id")
    s = i.cast("string")
    level = F.when(F.col("event_type") == "error", "ERROR ").when(F.col("event_type") == "signup", "WARN  ").otherwise("INFO  ")
    ctx = F.concat(
        F.lit(" | pipeline_id="), (u % 50).cast("string"), F.lit(" project_name=p"), (u % 10).cast("string"),
        F.lit(" event_type=Pipeline Hook processing_time="), (i % 400).cast("string"),
    )
    head = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" | "), level, F.lit(" | src.mod"), (i % 7).cast("string"),
        F.lit("        | r"), (i % 97).cast("string"), F.lit("    | message "), s,
        F.when(i % 4 == 0, " | more").otherwise(""), F.when(i % 5 != 0, ctx).otherwise(""),
    )
    raw = F.when(i % 9 == 4, F.concat(F.lit('  File "x.py", line '), s)).otherwise(head)
    return e.select(u.alias("file"), "line_no", raw.alias("raw"))


def api_log_lines(spark: S, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = k.cast("string")
    line = F.concat(
        F.lit("["), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("] PIPELINE_ID="), s, F.lit(" PROJECT_ID="),
        (c % 25).cast("string"), F.lit(" URL=http://collector.example.com/api/analyze STATUS="),
        F.when(k % 6 == 0, "ERROR").otherwise("200"), F.lit(" DURATION="), (k % 3000).cast("string"), F.lit("ms "),
        F.when(k % 6 == 0, F.concat(F.lit("ERROR=read timed out "), s, F.lit(" "))).otherwise(""),
        F.lit('RESPONSE={"n": '), s, F.lit("}"),
    )
    return table(spark, sf, "orders").select(F.when(k % 50 == 0, "noise").otherwise(line).alias("raw"))


def listing(spark: S, sf: str) -> DataFrame:
    """Stored files: job logs, build stage logs and consoles, and pipeline metadata."""
    li = table(spark, sf, "lineitem")
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    files = li.select(
        F.when(n < 5, F.concat(F.lit("/data/NATION_"), (F.col("l_orderkey") % 25).cast("string"), F.lit("_"), (F.col("l_orderkey") % 25).cast("string"),
                               F.lit("/pipeline_"), k, F.lit("/job_"), jobs_key(), F.lit("_job_"), n.cast("string"), F.lit(".log")))
        .when(n == 5, F.concat(F.lit("/data/jenkins-builds/job"), (F.col("l_partkey") % 40).cast("string"), F.lit("/"), k, F.lit("/stage_S"), F.col("l_suppkey").cast("string"), F.lit(".log")))
        .when(n == 6, F.concat(F.lit("/data/jenkins-builds/job"), (F.col("l_partkey") % 40).cast("string"), F.lit("/"), k, F.lit("/console.log")))
        .otherwise(F.concat(F.lit("/data/NATION_1_1/pipeline_"), k, F.lit("/metadata.json"))).alias("path"),
        F.floor("l_extendedprice").cast("bigint").alias("size"), F.col("l_shipdate").alias("mtime"),
    )
    return stored(spark, sf, "listing", files)


def snapshots(spark: S, sf: str) -> DataFrame:
    p = F.col("o_orderpriority")
    tier = F.when(p == "1-URGENT", "daily").when(p == "2-HIGH", "weekly").when(p == "3-MEDIUM", "monthly").otherwise("manual")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id"), tier.alias("tier"), F.col("o_orderdate").alias("mtime"))
