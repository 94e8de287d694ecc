"""Failure payloads and the look-ups they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .postings import first_containing


def attach_logs(jobs: DataFrame, logs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Jobs with their log text; `logs(job_id, fetch_status, content, fetch_error)`. A missing row counts as 404.

    Logs may name their text instead of holding it: with `texts(text_id, content)` they have `text_id` in place of `content`, and a
    text that is not there counts as 404. Texts come in last, so each is shuffled once and not once per job.
    """
    job = F.col("job_id").cast("string")
    before, after = fixed.NO_LOG_TEXT.split("{}")
    err_before, err_after = fixed.LOG_ERROR_TEXT.split("{}")
    found, missing = jobs.join(logs, "job_id", "left"), F.col("fetch_status").isNull() | (F.col("fetch_status") == 404)
    if texts is not None:
        # Jobs that name no text are spread over many keys that match nothing.
        lot = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(job), F.lit(4096)).cast("string"))
        known = texts.select(F.col("text_id").cast("string").alias("_text"), "content")
        found = found.withColumn("_want", F.coalesce(F.col("text_id").cast("string"), lot))
        found = found.join(known, F.col("_want") == F.col("_text"), "left").drop("_want", "_text")
        missing = missing | F.col("content").isNull()
    return found.withColumn(
        "log",
        F.when(F.col("fetch_error").isNotNull(), F.concat(F.lit(err_before), F.col("fetch_error"), F.lit(err_after)))
        .when(missing, F.concat(F.lit(before), job, F.lit(after)))
        .otherwise(F.col("content")),
    ).drop("content", "fetch_status", "fetch_error", "text_id")


def join_instance_by_url(builds: DataFrame, instances: DataFrame, default: str) -> DataFrame:
    """Builds with their CI instance (`instance_url`, `jenkins_user`); unknown or empty URLs get the default."""
    known = instances.select(
        text.normalize_url(F.col("jenkins_url")).alias("_url"), F.col("jenkins_url").alias("instance_url"), "jenkins_user"
    )
    url = text.normalize_url(text.filled(F.col("jenkins_url")))
    joined = builds.withColumn("_url", url).join(known, "_url", "left")
    return joined.withColumn("instance_url", F.coalesce("instance_url", F.lit(default))).drop("_url")


def build_user(actions: Column) -> Column:
    """User id of the first user cause with one, from build metadata `actions`."""
    causes = F.flatten(F.transform(F.filter(actions, lambda a: a["_class"] == fixed.CAUSE_ACTION), lambda a: a["causes"]))
    ids = F.filter(causes, lambda c: (c["_class"] == fixed.USER_CAUSE) & (F.length(c["userId"]) > 0))
    return F.when(F.size(ids) > 0, ids[0]["userId"])


def resolve_trigger_user(
    builds: DataFrame, projects: DataFrame, merge_requests: DataFrame, commits: DataFrame, branches: DataFrame
) -> DataFrame:
    """Add `triggered_by`: manual user, else merge request author, commit author, branch head author, else the system user.

    `builds(user_id, parameters MAP)`; look-up tables as projects(namespace, repo, project_id), merge_requests(project_id,
    iid, username), commits(project_id, sha, author_email, author_name), branches(project_id, name, head_sha).
    """
    p = F.col("parameters")

    def param(*names: str) -> Column:
        return F.coalesce(*[text.filled(p[n]) for n in names])

    def known(value: Column) -> Column:
        return F.when(value != "unknown", value)

    user = text.filled(F.col("user_id"))
    authors = commits.select(
        "project_id", "sha",
        F.when(F.col("author_email").contains("@"), text.email_local_part(F.col("author_email")))
        .otherwise(F.col("author_name")).alias("_author"),
    )
    keyed = builds.withColumns(
        {
            "_manual": F.when(F.lower(user) != fixed.SYSTEM_USER, user),
            "_namespace": param("gitlabSourceNamespace", "sourceNamespace"),
            "_repo": param("gitlabSourceRepoName"),
            "_iid": param("gitlabMergeRequestIid").try_cast("bigint"),
            "_sha": known(param("gitlabMergeRequestLastCommit")),
            "_branch": known(param("gitlabSourceBranch")),
        }
    )
    # A row without a key matches nothing; its key is replaced by one of many that no table has, so that such rows spread.
    lot = F.pmod(F.monotonically_increasing_id(), F.lit(4096))

    def spread(key: str, with_key: str) -> Column:
        lacking = F.col(key).isNull() | F.col(with_key).isNull()
        return F.when(lacking, F.concat(F.lit("\u0000"), F.col("_lot").cast("string"))).otherwise(F.col(key).cast("string"))

    def by_key(table: DataFrame, key: str, with_key: str) -> DataFrame:
        found = table.dropna(subset=[key, with_key]).withColumn("_key", F.col(key).cast("string"))
        return found.select("_key", F.col(with_key).alias("_with"), *[c for c in table.columns if c not in (key, with_key)])

    def look_up(rows: DataFrame, found: DataFrame, key: str, with_key: str) -> DataFrame:
        none = F.lit("") if with_key == "_namespace" else F.lit(-1)
        same = (F.col("_want") == F.col("_key")) & (F.coalesce(F.col(with_key), none) == F.col("_with"))
        return rows.withColumn("_want", spread(key, with_key)).join(found, same, "left").drop("_want", "_key", "_with")

    # The heads meet the commits by the keys by which builds meet them, so the commits are shuffled once for both.
    commit_authors = by_key(authors, "sha", "project_id")
    head = (F.col("head_sha").cast("string") == F.col("_key")) & (F.col("project_id") == F.col("_with"))
    heads = branches.join(commit_authors, head).select("project_id", "name", F.col("_author").alias("_head_author"))
    # Builds started by hand and builds of unknown projects need no look-up of people, builds without a commit none of commits.
    by_hand = keyed.filter(F.col("_manual").isNotNull()).withColumn("_found", F.col("_manual"))
    asked = keyed.filter(F.col("_manual").isNull()).withColumn("_lot", lot)
    of_project = projects.select("namespace", "repo", F.col("project_id").alias("_project"))
    asked = look_up(asked, by_key(of_project, "repo", "namespace"), "_repo", "_namespace")
    placed = asked.filter(F.col("_project").isNotNull())
    no_place = asked.filter(F.col("_project").isNull()).withColumn("_found", F.lit(None).cast("string"))
    requests = merge_requests.select("project_id", "iid", F.col("username").alias("_mr_author"))
    placed = look_up(placed, by_key(requests, "iid", "project_id"), "_iid", "_project")
    with_commit = look_up(placed.filter(F.col("_sha").isNotNull()), commit_authors, "_sha", "_project")
    placed = with_commit.unionByName(placed.filter(F.col("_sha").isNull()).withColumn("_author", F.lit(None).cast("string")))
    placed = look_up(placed, by_key(heads, "name", "project_id"), "_branch", "_project")
    looked_up = placed.withColumn("_found", F.coalesce(*[text.filled(F.col(c)) for c in ("_mr_author", "_author", "_head_author")]))
    named = F.concat(F.coalesce(F.col("_found"), F.lit(fixed.SYSTEM_USER)), F.lit(fixed.MAIL_DOMAIN)).alias("triggered_by")
    out = by_hand.select(*builds.columns, named)
    return out.unionByName(no_place.select(*builds.columns, named)).unionByName(looked_up.select(*builds.columns, named))


def failed_steps_gitlab(jobs: DataFrame, texts: DataFrame) -> DataFrame:
    """Failed jobs as steps: error_lines holds the error sections of the job's log, or is empty."""
    failed = jobs.filter(F.col("status") == "failed").join(texts, "log_id", "left")
    return failed.withColumn("step_name", F.coalesce("name", F.lit("unknown"))).withColumn(
        "error_lines", F.array_compact(F.array("text"))
    ).drop("text")


def failed_steps_jenkins(stages: DataFrame) -> DataFrame:
    """Failed stages as steps; `stages(..., name, status, log_content)`. A stage without text gets a placeholder."""
    return _as_steps(_failed(stages))


def _failed(stages: DataFrame) -> DataFrame:
    return stages.filter(F.col("status").isin(*fixed.FAILED_STAGE_STATUSES))


def _as_steps(failed: DataFrame) -> DataFrame:
    name = F.coalesce("name", F.lit("unknown"))
    before, after = fixed.NO_STAGE_TEXT.split("{}")
    shown = F.coalesce(text.filled(F.col("log_content")), F.concat(F.lit(before), name, F.lit(after)))
    return failed.withColumn("step_name", name).withColumn("error_lines", F.array(shown))


def build_failures_gitlab(pipelines: DataFrame, jobs: DataFrame, texts: DataFrame, numbered: bool = False) -> DataFrame:
    """One row per job under its pipeline's header, in one form at every size.

    Header: source, repo, branch, commit, pipeline_id (its URL), triggered_by. Job: job_order, job_id, job_name, failed, error_lines
    (the error sections of a failed job's log; empty for other jobs). Nothing is gathered per pipeline, so a pipeline
    may have any number of jobs; `one_payload` nests the rows of a single pipeline. With `numbered`, `job_no` counts the jobs of a pipeline
    from 1. Texts come in last: once they are with their job, they are not shuffled again.
    """
    user = F.coalesce(text.filled(F.col("username")), text.filled(F.col("user_full_name")))
    headers = pipelines.select(
        F.col("pipeline_id").alias("_pipeline"),
        F.lit("gitlab").alias("source"),
        text.repo_short_name(F.col("project_name")).alias("repo"),
        F.coalesce("ref", F.lit("unknown")).alias("branch"),
        text.short_sha(F.col("sha")).alias("commit"),
        F.coalesce("pipeline_url", F.lit("")).alias("_url"),
        F.coalesce(F.concat(user, F.lit(fixed.MAIL_DOMAIN)), F.col("source"), F.lit("unknown")).alias("triggered_by"),
    )
    own = jobs.select("pipeline_id", "job_order", "job_id", "name", "status", "log_id")
    rows = headers.join(own, F.col("_pipeline") == F.col("pipeline_id"))
    if numbered:
        rows = rows.withColumn("job_no", F.row_number().over(Window.partitionBy("pipeline_id").orderBy("job_order")))
    shown = (
        "source", "repo", "branch", "commit", F.col("_url").alias("pipeline_id"), "triggered_by", "job_order", "job_id",
        F.coalesce("name", F.lit("unknown")).alias("job_name"), *(["job_no"] if numbered else []),
    )
    steps = failed_steps_gitlab(rows, texts).select(*shown, F.lit(True).alias("failed"), "error_lines")
    others = rows.filter(F.coalesce(F.col("status") != "failed", F.lit(True))).select(
        *shown, F.lit(False).alias("failed"), F.array().cast("array<string>").alias("error_lines")
    )
    return steps.unionByName(others)


def jenkins_headers(builds: DataFrame) -> DataFrame:
    """Builds with the payload's `repo`, `branch` and `commit` out of their parameters, which are then only needed to find the trigger user."""
    p = F.col("parameters")
    return builds.withColumns(
        {
            "repo": F.coalesce(p["gitlabSourceRepoName"], F.col("job_name")),
            "branch": F.coalesce(p["gitlabSourceBranch"], F.lit("unknown")),
            "commit": F.coalesce(p["gitlabMergeRequestLastCommit"], F.lit("unknown")),
        }
    )


def build_failures_jenkins(builds: DataFrame, stages: DataFrame) -> DataFrame:
    """One row per failed stage under its build's header; a build without failed stages has one row without a step.

    `builds(build_id, job_name, build_url, parameters, triggered_by)`, or with the columns of `jenkins_headers` in place of the parameters;
    `stages(build_id, stage_pos, ...)`. Placeholders are put in after the join, so they are not shuffled.
    """
    if "parameters" in builds.columns:
        builds = jenkins_headers(builds)
    header = ("repo", "branch", "commit", "job_name", F.col("build_url").alias("pipeline_id"), "triggered_by")
    failed = _failed(stages).select(F.col("build_id").alias("_build"), "stage_pos", "name", "log_content")
    rows = builds.select("build_id", *header).join(failed, F.col("build_id") == F.col("_build"), "left")
    step = F.col("_build").isNotNull()
    return _as_steps(rows).select(
        F.lit("jenkins").alias("source"), "repo", "branch", "commit", "job_name", "pipeline_id", "triggered_by", "stage_pos",
        F.when(step, F.col("step_name")).alias("step_name"), F.when(step, F.col("error_lines")).alias("error_lines"),
    )


def one_payload(failures: DataFrame, pipeline_id: str) -> DataFrame:
    """The nested payload of one pipeline, from the rows of `build_failures_gitlab`: job names and failed steps in job order."""
    rows = failures.filter(F.col("pipeline_id") == pipeline_id)
    job = F.struct("job_order", "job_id", "job_name", "failed", "error_lines")
    header = ("source", "repo", "branch", "commit", "pipeline_id", "triggered_by")
    nested = rows.groupBy(*header).agg(F.array_sort(F.collect_list(job)).alias("_jobs"))
    failed = F.filter("_jobs", lambda j: j["failed"])
    return nested.select(
        *header, F.array_join(F.col("_jobs.job_name"), ",").alias("job_name"),
        F.transform(failed, lambda j: F.struct(j["job_name"].alias("step_name"), j["error_lines"].alias("error_lines"))).alias("failed_steps"),
    )


def match_user_exact(people: DataFrame, users: DataFrame) -> DataFrame:
    """`people(person)` with `user_id`: by e-mail when the text has '@', else the first user whose name equals it."""
    names = _names(users).groupBy("_name").agg(F.min("pos").alias("_by_name"))
    return _match(people, users, names)


def match_user_fuzzy(people: DataFrame, users: DataFrame) -> DataFrame:
    """As `match_user_exact`, but the name may be any part of a user's name.

    The parts of names that are as long as some text are kept once, with the first user who has them; no (person, user) pairs are formed.
    """
    held = users.select("pos", _both_names().alias("texts"))
    wanted = people.select(F.lower("person").alias("needle"))
    first = first_containing(wanted, held).select(F.col("needle").alias("_name"), F.col("pos").alias("_by_name"))
    return _match(people, users, first)


def _both_names() -> Column:
    return F.array_distinct(F.array(F.lower(F.coalesce("real_name", F.lit(""))), F.lower(F.coalesce("name", F.lit("")))))


def _names(users: DataFrame) -> DataFrame:
    return users.select("pos", F.explode(_both_names()).alias("_name")).filter(F.col("_name") != "")


def _match(people: DataFrame, users: DataFrame, names: DataFrame) -> DataFrame:
    """Each distinct text once: by mail, else by name; then the user at that place of the directory."""
    ids = people.select("person").distinct()
    mails = users.filter(F.length("email") > 0).groupBy("email").agg(F.min("pos").alias("_by_mail"))
    found = (
        ids.withColumn("email", F.when(F.col("person").contains("@"), F.col("person"))).join(mails, "email", "left")
        .withColumn("_name", F.when(F.col("_by_mail").isNull(), F.lower("person"))).join(names, "_name", "left")
        .select("person", F.coalesce("_by_mail", "_by_name").alias("pos"))
        .join(users.select("pos", F.col("id").alias("user_id")), "pos", "left").drop("pos")
    )
    return people.join(found, "person", "left")
