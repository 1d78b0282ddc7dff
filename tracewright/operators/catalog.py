"""Reads and writes of the job catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.sources.tables import discard, stored

# Accepted media types and the size limit of uploads.
MEDIA_TYPES = {"video/mp4": ".mp4", "video/quicktime": ".mov", "video/webm": ".webm", "video/x-matroska": ".mkv", "video/x-msvideo": ".avi"}
MOST_BYTES = 2 * 1024**3


def admitted(uploads: DataFrame, projects: DataFrame) -> DataFrame:
    """Uploads with the status that the first failed rule gives them."""
    types = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    known = projects.select("project_id", F.lit(True).alias("_known"))
    out = uploads.join(known, "project_id", "left").withColumn("extension", F.try_element_at(types, F.col("content_type")))
    status = F.when(F.col("_known").isNull(), 404).when(F.col("byte_size") > MOST_BYTES, 413).when(F.col("extension").isNull(), 415).otherwise(200)
    return out.withColumn("status", status).withColumn("filename", F.left(F.col("filename"), F.lit(500))).drop("_known")


def job_list(videos: DataFrame, jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs of videos with their report, if there is one: one plan instead of one query per job."""
    return jobs.join(videos, "video_id").join(reports, "job_id", "left")


def timeline(jobs: DataFrame, **children: DataFrame) -> DataFrame:
    """Each job with its child rows as ordered arrays; a child's first column after job_id orders it."""
    out = jobs
    for name, rows in children.items():
        cols = [c for c in rows.columns if c != "job_id"]
        out = out.join(rows.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)), "job_id", "left")
    return out


def heads(revisions: DataFrame) -> DataFrame:
    """The newest revision of every report."""
    w = Window.partitionBy("report_id").orderBy(F.col("created_at").desc(), F.col("revision_id").desc())
    return revisions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def accepted_edits(edits: DataFrame, current: DataFrame) -> DataFrame:
    """Edits that were made on the head they name (optimistic lock)."""
    head = current.select("report_id", F.col("revision_id").alias("_head"))
    return edits.join(head, "report_id").where(F.col("parent_revision_id") == F.col("_head")).drop("_head")


def merged_settings(old, new):
    """Right-biased shallow merge of two string maps."""
    keys = F.array_distinct(F.concat(F.map_keys(old), F.map_keys(new)))
    pairs = F.transform(keys, lambda k: F.struct(k, F.coalesce(F.try_element_at(new, k), F.try_element_at(old, k))))
    return F.map_from_entries(pairs)


def settings_updated(updates: DataFrame, orgs: DataFrame) -> DataFrame:
    """Updates (org_id, settings) with 200 and the merged settings, or 404 for an organisation that is not there."""
    empty = F.create_map().cast("map<string,string>")
    known = orgs.select("org_id", F.coalesce("settings", empty).alias("_old"), F.lit(True).alias("_known"))
    out = updates.join(known, "org_id", "left")
    merged = F.when(F.col("_known"), merged_settings(F.col("_old"), F.coalesce("settings", empty)))
    return out.select("org_id", F.when(F.col("_known"), 200).otherwise(404).alias("code"), merged.alias("settings"))


def projects_created(requests: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers to requests (request_id, org_id, name, created_at): 201 and the project's id, and the projects with the new ones.

    A new project is named by its request, so a batch that runs again makes no second one; names may repeat.
    """
    new = requests.select(F.col("request_id").alias("project_id"), "org_id", "name", "created_at")
    fresh = new.join(projects.select("project_id"), "project_id", "left_anti")
    answers = new.select(F.col("project_id").alias("request_id"), F.lit(201).alias("code"), "project_id", "name")
    return answers, projects.select(*new.columns).unionByName(fresh)


def project_list(projects: DataFrame) -> DataFrame:
    """Each organisation's projects as one array, oldest first."""
    return projects.groupBy("org_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "project_id", "name"))).alias("projects"))


def stage_sets(stages: DataFrame) -> DataFrame:
    """Stages done and failed of each job, sorted."""
    names = lambda status: F.array_sort(F.array_compact(F.collect_set(F.when(F.col("status") == status, F.col("stage")))))
    return stages.groupBy("job_id").agg(names("done").alias("done"), names("failed").alias("failed"))


def renumbered(steps: DataFrame, dropped: DataFrame) -> DataFrame:
    """Steps that an edit left, numbered anew."""
    w = Window.partitionBy("job_id").orderBy("idx")
    return steps.join(dropped, ["job_id", "idx"], "left_anti").withColumn("new_idx", F.row_number().over(w).cast("long"))


def edited(steps: DataFrame, merges: DataFrame) -> DataFrame:
    """Steps after merges with the next one, numbered anew.

    ``merges`` names (job_id, idx) of steps to merge with their next; a merge of
    the last step, or of one that the step before it has taken up, does nothing.
    """
    w = Window.partitionBy("job_id").orderBy("idx")
    asked = steps.join(merges.select("job_id", "idx", F.lit(True).alias("_asked")), ["job_id", "idx"], "left")
    nxt = asked.withColumn("_next", F.lead(F.struct("text", "evidence", "confidence")).over(w))
    wish = F.coalesce("_asked", F.lit(False)) & F.col("_next").isNotNull()
    # In a run of wishes every other one is granted: a step that was taken up is gone.
    runs = nxt.withColumn("_wish", wish).withColumn("_run", F.sum(F.when(F.col("_wish"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("job_id", "_run", "_wish").orderBy("idx"))
    granted = runs.withColumn("_takes", F.col("_wish") & (place % 2 == 1))
    kept = granted.withColumn("_taken", F.coalesce(F.lag("_takes").over(w), F.lit(False))).where("NOT _taken")
    takes, n = F.col("_takes"), F.col("_next")
    text = F.concat(F.regexp_replace("text", r"\.$", ""), F.lit(", then "), F.lower(F.left(n["text"], F.lit(1))), F.substr(n["text"], F.lit(2)))
    values = {"text": F.when(takes, text).otherwise(F.col("text")), "evidence": F.when(takes, F.concat("evidence", n["evidence"])).otherwise(F.col("evidence")), "confidence": F.when(takes, F.least("confidence", n["confidence"])).otherwise(F.col("confidence"))}
    return kept.select(*[values.get(c, F.col(c)).alias(c) for c in steps.columns], F.row_number().over(w).cast("long").alias("new_idx"))


def completed(uploads: DataFrame, objects: DataFrame) -> DataFrame:
    """Uploads whose object has arrived become ``uploaded`` with its size; others are answered 409."""
    there = objects.select("storage_key", F.col("length").alias("_size"))
    out = uploads.join(there, "storage_key", "left")
    arrived = F.col("_size").isNotNull()
    return out.withColumn("code", F.when(arrived, 200).otherwise(409)).withColumn("status", F.when(arrived, "uploaded").otherwise(F.col("status"))).withColumn("byte_size", F.coalesce("_size", "byte_size")).drop("_size")


# Videos that a job may be made of, jobs that no stage runs for, roles in their order.
READY = ("uploaded", "processed", "failed")
OVER = ("failed", "canceled")
ROLES = ("viewer", "reviewer", "editor", "admin", "owner")


def created_jobs(requests: DataFrame, videos: DataFrame) -> DataFrame:
    """Requests (request_id, video_id) with their answer: 202 and a queued job, 404 or 409."""
    out = requests.join(videos.select("video_id", F.col("status").alias("_video")), "video_id", "left")
    code = F.when(F.col("_video").isNull(), 404).when(F.col("_video").isin(*READY), 202).otherwise(409)
    return out.withColumn("code", code).withColumn("status", F.when(F.col("code") == 202, "queued")).drop("_video")


def runnable(jobs: DataFrame) -> DataFrame:
    """Jobs whose next stage may run."""
    return jobs.where(~F.col("status").isin(*OVER))


def rank_of(role: Column) -> Column:
    """Place of a role, null for none."""
    place = F.array_position(F.array(*map(F.lit, ROLES)), role)
    return F.when(place > 0, place - 1)


def allowed(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """Requests (org_id, user_id, minimum) with 200, 403 (role too low) or 404 (no member, so nothing is told)."""
    out = requests.join(memberships.select("org_id", "user_id", "role"), ["org_id", "user_id"], "left")
    return out.withColumn("code", F.when(F.col("role").isNull(), 404).when(rank_of(F.col("role")) < rank_of(F.col("minimum")), 403).otherwise(200))


ENTRIES = "array<struct<stage:string,status:string,ms:bigint>>"


def with_stage(jobs: DataFrame, done: DataFrame, order: str = "stage") -> DataFrame:
    """Jobs with more entries in ``stages``, an array of (stage, status, ms); a failed stage fails the job.

    The entries of one job are appended in the order of the column ``order``
    (stages are named in the order in which they run).
    """
    entry = F.struct(F.col(order).alias("at"), F.struct("stage", F.col("stage_status").alias("status"), F.col("ms").cast("bigint").alias("ms")).alias("entry"))
    new = done.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]).alias("_new"), F.bool_or(F.col("stage_status") == "failed").alias("_failed"))
    none = F.array().cast(ENTRIES)
    out = jobs.join(new, "job_id", "left")
    return out.withColumn("stages", F.concat(F.coalesce("stages", none), F.coalesce("_new", none))).withColumn("status", F.when(F.col("_failed"), "failed").otherwise(F.col("status"))).drop("_new", "_failed")


def answered(edits: DataFrame, reports: DataFrame) -> DataFrame:
    """Edits of a batch with the code that each gets if they come one after the other.

    200: made on the head of its moment, which it becomes.  409: made on
    another revision (a fork, an unknown parent, one that is not there yet).
    422: made on the head, but ``valid`` is false.  404: no such report.

    ``edits`` has report_id, revision_id (new and unique), parent_revision_id,
    created_at; ties come in the order of revision_id.  The edit that follows a revision is the
    first valid one behind it that names it, so every edit has one place it can
    hang on, and those that hang on the head through others are accepted.  They
    are found by doubling these pointers, a join for each doubling, however long
    the chain of one report is.
    """
    known = reports.select("report_id", F.col("head_revision_id").alias("_head"), F.lit(True).alias("_known"))
    at = F.struct("created_at", "revision_id")
    valid = F.coalesce("valid", F.lit(True)) if "valid" in edits.columns else F.lit(True)
    rows = edits.join(known, "report_id", "left").select("report_id", "revision_id", "parent_revision_id", "_head", F.coalesce("_known", F.lit(False)).alias("_known"), valid.alias("_valid"), at.alias("_at"))
    parents = rows.select("report_id", F.col("revision_id").alias("parent_revision_id"), F.col("_at").alias("_parent_at"))
    placed = rows.join(parents, ["report_id", "parent_revision_id"], "left")
    on_head = F.coalesce(F.col("parent_revision_id") == F.col("_head"), F.lit(False))
    placed = stored(placed.withColumn("_after", F.col("_known") & (on_head | F.coalesce(F.col("_at") > F.col("_parent_at"), F.lit(False)))).withColumn("_on_head", on_head), "edits")
    follows = placed.where("_after AND _valid").groupBy("report_id", "parent_revision_id").agg(F.min("_at").alias("_next"))
    links = placed.where("_after AND _valid").join(follows, ["report_id", "parent_revision_id"]).where(F.col("_at") == F.col("_next"))
    # up: the revision that a link has been followed to; held: whether it is the head.
    chain = stored(links.select("report_id", "revision_id", F.col("parent_revision_id").alias("up"), F.col("_on_head").alias("held")), "edit-links")
    while chain.where("NOT held AND up IS NOT NULL").limit(1).count():
        above = chain.select("report_id", F.col("revision_id").alias("up"), F.col("up").alias("_up"), F.col("held").alias("_held"))
        step = chain.join(above, ["report_id", "up"], "left")
        chain, before = stored(step.select("report_id", "revision_id", F.when(F.col("held"), F.col("up")).otherwise(F.col("_up")).alias("up"), (F.col("held") | F.coalesce("_held", F.lit(False))).alias("held")), "edit-links"), chain
        discard(before)
    taken = chain.where("held").select("report_id", "revision_id", F.lit(True).alias("_taken"))
    # A revision that was the head: the one the batch found, and those accepted, until the next accepted edit.
    was = taken.select("report_id", F.col("revision_id").alias("parent_revision_id"), F.lit(True).alias("_was"))
    out = placed.join(taken, ["report_id", "revision_id"], "left").join(was, ["report_id", "parent_revision_id"], "left").join(follows, ["report_id", "parent_revision_id"], "left")
    head_then = F.col("_after") & (F.col("_on_head") | F.coalesce("_was", F.lit(False))) & (F.col("_next").isNull() | (F.col("_at") < F.col("_next")))
    code = F.when(~F.col("_known"), 404).when(F.col("_taken"), 200).when(head_then, 422).otherwise(409)
    answers = out.select("report_id", "revision_id", code.alias("code"))
    return edits.join(answers, ["report_id", "revision_id"], "left").withColumn("code", F.coalesce("code", F.lit(404)))


def saved(edits: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New revisions of the accepted edits, and the reports with their heads moved and in review.

    ``edits`` as in ``answered``, with a change_note; reports without a head take none.
    """
    taken = stored(answered(edits, reports), "edits-answered").where("code = 200").drop("code")
    new = taken.groupBy("report_id").agg(F.max_by("revision_id", F.struct("created_at", "revision_id")).alias("_new"))
    moved = reports.join(new, "report_id", "left").withColumn("status", F.when(F.col("_new").isNotNull(), "in_review").otherwise(F.col("status"))).withColumn("head_revision_id", F.coalesce("_new", "head_revision_id")).drop("_new")
    return taken.withColumn("author_type", F.lit("human")), moved


def approved(reports: DataFrame, approvals: DataFrame) -> DataFrame:
    """Reports with those that were approved marked so."""
    marks = approvals.select("report_id", F.lit(True).alias("_ok")).distinct()
    return reports.join(marks, "report_id", "left").withColumn("status", F.when(F.col("_ok"), "approved").otherwise(F.col("status"))).drop("_ok")


FORMATS = ("json", "markdown", "text", "github", "ado")


def exports(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """Requests (report_id, format) with 201, 400 (format), 404 or 409 (no revision), and the status the report then has."""
    out = requests.join(reports.select("report_id", "status", "head_revision_id", F.lit(True).alias("_known")), "report_id", "left")
    code = F.when(F.col("_known").isNull(), 404).when(F.col("head_revision_id").isNull(), 409).when(~F.col("format").isin(*FORMATS), 400).otherwise(201)
    out = out.withColumn("code", code)
    return out.withColumn("status", F.when((F.col("code") == 201) & (F.col("status") == "approved"), "exported").otherwise(F.col("status"))).drop("_known", "head_revision_id")


def history(revisions: DataFrame) -> DataFrame:
    """Each report's revisions, newest first, as one array."""
    new = lambda x, y: F.when(x["created_at"] > y["created_at"], -1).when(x["created_at"] < y["created_at"], 1).when(x["revision_id"] > y["revision_id"], -1).when(x["revision_id"] < y["revision_id"], 1).otherwise(0)
    return revisions.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "revision_id")), new).alias("revisions"))


def comments(rows: DataFrame) -> DataFrame:
    """Each report's comments, oldest first, as one array."""
    return rows.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "comment_id", "step_key", "t_ms", "body", "resolved"))).alias("comments"))


def media_keys(videos: DataFrame, objects: DataFrame) -> DataFrame:
    """(video_id, key) of the kind of media asked for (original, normalized, proxy), of the original where a derivative is missing."""
    derived = F.concat(F.lit("derived/"), F.col("video_id").cast("string"), F.lit("/"), F.col("kind"))
    wanted = videos.withColumn("_wanted", F.when(F.col("kind") != "original", derived))
    there = objects.select(F.col("storage_key").alias("_there")).distinct()
    return wanted.join(there, F.col("_wanted") == F.col("_there"), "left").select("video_id", F.coalesce("_there", "storage_key").alias("key"))


def latencies(log: DataFrame, group: str, value: str, tops: tuple[int, ...]) -> DataFrame:
    """Counter, cumulative histogram and sum of a value per group."""
    bucket = lambda top: F.sum(F.when(F.col(value) <= top, 1).otherwise(0)).alias(f"le_{top}")
    return log.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[bucket(t) for t in tops], F.round(F.sum(value), 4).alias("total"))


def job_details(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs with their report, if there is one, and how far they are."""
    return jobs.join(reports.select("job_id", "report_id"), "job_id", "left")
