"""Queries over reports and the job catalogue, media and progress, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import catalog, media, recordings, render, targets
from tracewright.plans.texts import label_sql
from tracewright.sources import adapters as a
from tracewright.sources.tables import fresh, stored, table
from tracewright.streaming import progress


def render_markdown(spark, sf):
    return a.reports(spark, sf).select("job_id", render.markdown().alias("body"))


def render_text(spark, sf):
    return a.reports(spark, sf).select("job_id", render.plain_text().alias("body"))


def repro_html(spark, sf):
    return a.reports(spark, sf).select("job_id", render.html().alias("body"))


def github_labels(spark, sf):
    r = a.reports(spark, sf).select("job_id", F.array_join(render.issue_labels(), ",").alias("labels"))
    return r


def issue_payloads(spark, sf):
    """Issues as JSON, read back."""
    r = a.reports(spark, sf).select("job_id", render.issue_payload().alias("p"))
    labels = F.from_json(F.get_json_object("p", "$.labels"), "array<string>")
    return r.select("job_id", F.get_json_object("p", "$.title").alias("title"), F.md5(F.get_json_object("p", "$.body").cast("binary")).alias("body_md5"), F.array_join(labels, ",").alias("labels"))


def ticket_patches(spark, sf):
    """Work items as JSON patches, read back; some organisations have not set all that is asked for."""
    k = F.col("job_id")
    fields = render.ticket_fields(F.when(k % 2 == 0, "Web\\Shop"), F.when(k % 3 == 0, ""))
    token = render.setting(F.when(k % 4 == 0, ""), F.when(k % 5 != 0, "t"))
    r = a.reports(spark, sf).select("job_id", render.ticket_code(F.lit("org"), render.setting(F.lit(None).cast("string"), F.lit("p")), token).alias("code"), render.ticket_patch(fields).alias("p"))
    ops = F.from_json("p", "array<struct<op:string,path:string,value:string>>")
    values = F.map_from_entries(F.transform(ops, lambda o: F.struct(F.substring_index(o["path"], "/", -1), o["value"])))
    v = lambda name: F.coalesce(F.element_at("v", name), F.lit(""))
    back = r.select("job_id", "code", F.array_join(F.array_distinct(F.transform(ops, lambda o: o["op"])), ",").alias("ops"), values.alias("v"))
    return back.select("job_id", "code", "ops", F.size("v").cast("long").alias("n"), v("System.Title").alias("title"), F.md5(v("Microsoft.VSTS.TCM.ReproSteps").cast("binary")).alias("steps_md5"), v("Microsoft.VSTS.Common.Severity").alias("severity"), v("System.Tags").alias("tags"), v("System.AreaPath").alias("area"))


def settings_updated(spark, sf):
    """Settings of organisations that exist, merged; others are told so."""
    c = table(spark, sf, "customer")
    orgs = c.where("c_custkey % 6 <> 0").select(F.col("c_custkey").alias("org_id"), F.when(F.col("c_custkey") % 4 != 0, F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("tier"), F.lit("base"))).alias("settings"))
    updates = c.select(F.col("c_custkey").alias("org_id"), F.when(F.col("c_custkey") % 5 != 0, F.create_map(F.lit("tier"), F.lit("gold"))).alias("settings"))
    got = catalog.settings_updated(updates, orgs)
    at = lambda k: F.coalesce(F.try_element_at("settings", F.lit(k)), F.lit(""))
    return got.select("org_id", "code", at("segment").alias("segment"), at("tier").alias("tier"))


def projects_listed(spark, sf):
    """Projects of each nation: some there already, some created by this batch, some of them for the second time."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("request_id"), F.col("s_nationkey").alias("org_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 7).alias("created_at"))
    there = s.where("request_id % 3 = 0").withColumnRenamed("request_id", "project_id")
    _, after = catalog.projects_created(s.where("request_id % 2 = 0"), there)
    return catalog.project_list(after).select("org_id", F.array_join(F.transform("projects", lambda p: p["name"]), ",").alias("projects"))


def severity(spark, sf):
    return a.reports(spark, sf).groupBy(render.severity(F.col("bug_type")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def job_list(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_name").alias("filename"))
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "awaiting_review").otherwise("failed")
    j = table(spark, sf, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("job_id"), status.alias("status"))
    r = table(spark, sf, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.min("l_partkey").alias("report_id"))
    return catalog.job_list(c, j, r).withColumn("report_id", F.coalesce("report_id", F.lit(-1).cast("long")))


def timeline(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    jobs = o.select(F.col("o_orderkey").alias("job_id"))
    segs = li.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("idx"), F.col("l_quantity").cast("long").alias("ms"))
    acts = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("idx"))
    t = catalog.timeline(jobs, segments=segs, actions=acts)
    show = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit(""))
    return t.select("job_id", show("segments", lambda s: F.concat(s["idx"].cast("string"), F.lit("@"), s["ms"].cast("string"))).alias("segments"), show("actions", lambda s: s["idx"].cast("string")).alias("actions"))


def revision_head(spark, sf):
    return catalog.heads(a.revisions(spark, sf)).select("report_id", "revision_id", F.coalesce("parent_revision_id", F.lit(0).cast("long")).alias("parent_revision_id"))


def optimistic_lock(spark, sf):
    r = a.revisions(spark, sf)
    edits = r.select("report_id", F.col("revision_id").alias("parent_revision_id"), (F.col("revision_id") % 2 == 0).alias("even"))
    return catalog.accepted_edits(edits, catalog.heads(r)).select("report_id", "parent_revision_id", "even")


def settings_merge(spark, sf):
    c = table(spark, sf, "customer")
    old = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    new = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("nation"), F.lit("moved"), F.lit("tier"), F.lit("gold"))).otherwise(F.create_map(F.lit("tier"), F.lit("base")))
    merged = c.select("c_custkey", catalog.merged_settings(old, new).alias("m"))
    team = render.setting(F.when(F.col("c_custkey") % 3 == 0, ""), F.when(F.col("c_custkey") % 4 == 0, F.element_at("m", "tier")), F.lit("default"))
    return merged.select(F.col("c_custkey").alias("org_id"), F.element_at("m", "segment").alias("segment"), F.element_at("m", "nation").alias("nation"), F.element_at("m", "tier").alias("tier"), team.alias("team"))


def stage_sets(spark, sf):
    li = table(spark, sf, "lineitem")
    names = F.array(*map(F.lit, progress.STAGES))
    s = li.select(F.col("l_orderkey").alias("job_id"), F.element_at(names, F.col("l_linenumber")).alias("stage"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("done").alias("status"))
    sets = catalog.stage_sets(s)
    return sets.select("job_id", F.array_join("done", ",").alias("done"), F.array_join("failed", ",").alias("failed"))


def next_stages(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    stage = F.element_at(F.array(*map(F.lit, progress.STAGES)), F.col("l_linenumber"))
    return li.select(stage.alias("stage"), progress.next_stage(stage).alias("next"), progress.stage_percent(stage).alias("pct"), "n")


def upload_admission(spark, sf):
    p = table(spark, sf, "part")
    kinds = F.array(*map(F.lit, [*sorted(catalog.MEDIA_TYPES), "text/plain"]))
    up = p.select(F.col("p_partkey").alias("upload_id"), (F.col("p_partkey") % 30).cast("int").alias("project_id"), F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int")).alias("content_type"), (F.col("p_size").cast("long") * 50_000_000).alias("byte_size"), F.col("p_name").alias("filename"))
    return catalog.admitted(up, table(spark, sf, "nation").select(F.col("n_nationkey").alias("project_id"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("extension").alias("extension"))


def media_kind(spark, sf):
    v = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("video_id"), F.concat(F.lit("raw/"), "s_name").alias("storage_key"), F.element_at(F.array(F.lit("original"), F.lit("normalized"), F.lit("proxy")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("kind"))
    there = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("derived/"), F.col("s_suppkey").cast("string"), F.lit("/proxy")).alias("storage_key"))
    return catalog.media_keys(v, there)


def steps_renumbered(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("idx"), "l_returnflag")
    return catalog.renumbered(li.select("job_id", "idx").distinct(), li.where("l_returnflag = 'R'").select("job_id", "idx"))


def stage_latency(spark, sf):
    return catalog.latencies(table(spark, sf, "events"), "event_type", "value", (1, 5, 25, 125))


def job_details(spark, sf):
    o = table(spark, sf, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("video_id"), F.element_at(F.array(*map(F.lit, progress.STAGES)), (F.col("o_orderkey") % 11 + 1).cast("int")).alias("current_stage"))
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.min("l_partkey").alias("report_id"))
    return catalog.job_details(jobs.withColumn("progress", progress.stage_percent(F.col("current_stage"))), r).withColumn("report_id", F.coalesce("report_id", F.lit(-1).cast("long")))


def _gray_recordings(spark, sf):
    """Four frames of 24 x 24 for each supplier: a bright square that jumps once."""
    w = h = 24
    col = F.expr(f"sequence(0, {w * h - 1})")
    dot = lambda f: F.transform(col, lambda p: F.when((F.abs(p % w - (F.col("s_suppkey") % 10 + 4 + f)) <= 1) & (F.abs(F.floor(p / w) - 12) <= 1), "FF").otherwise("40"))
    head = F.lit("P5 24 24 255\n").cast("binary")
    frame = lambda f: F.concat(head, F.unhex(F.array_join(dot(f), "")))
    return table(spark, sf, "supplier").select(F.col("s_name").alias("path"), F.concat(*[frame(f) for f in (0, 0, 3, 3)]).alias("content"))


def media_frames(spark, sf):
    """All frame kernels over gray recordings."""
    return media.frames_of(_gray_recordings(spark, sf), fps=10.0, sample_fps=5.0)


def media_change(spark, sf):
    """What of the frame kernels is a count: time, light, and pixels that changed."""
    f = media.frames_of(_gray_recordings(spark, sf), fps=10.0, sample_fps=5.0)
    return f.select("path", "t_ms", "lum", F.round(F.col("change_frac") * 576).cast("long").alias("changed"))


#: Side of a square frame of text bytes: 49 pixels, of which no mean ends in an exact half.
SIDE = 7


def media_texts(spark, sf):
    """The bytes of every turn as frames of a recording, written as files and measured by stretches of three frames."""
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b")).where(F.length("b") > 0)
    size = SIDE * SIDE
    cut = c.select("name", "b", F.explode(F.sequence(F.lit(0), F.floor((F.length("b") - 1) / size))).alias("frame"))
    pixels = F.rpad(F.substring(F.col("b"), F.col("frame") * size + 1, F.lit(size)), size, F.lit(b"\0"))
    frames = cut.select("name", "frame", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), pixels.alias("pixels"))
    paths = stored(recordings.written(frames, fresh(spark, "recordings")), "recordings-paths")
    m = recordings.sampled(recordings.ranges(paths, 1, 3), 5.0, 5.0)
    return m.select(F.substring_index("path", "/", -1).alias("name"), "t_ms", "lum", "blur", "score", "change_frac")


def targets_recognised(spark, sf):
    """From pixels to names: recordings that show part names, clicks on them, two engines that read what is shown.

    The first engine fails on every fifth part, the second on every fifteenth too.
    """
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    place = F.row_number().over(Window.partitionBy(F.col("p_partkey") % 20).orderBy("p_partkey")) - 1
    shown = p.select("p_partkey", (F.col("p_partkey") % 20).cast("string").alias("name"), place.cast("long").alias("frame"), F.rpad(F.encode("p_name", "UTF-8"), 64, F.lit(b" ")).alias("row"))
    # A frame: its key in the first row, the name in the second.
    key = F.rpad(F.encode(F.col("p_partkey").cast("string"), "UTF-8"), 64, F.lit(b" "))
    frames = shown.select("name", "frame", F.lit(64).alias("width"), F.lit(2).alias("height"), F.concat(key, "row").alias("pixels"))
    paths = stored(recordings.written(frames, fresh(spark, "recordings")), "recordings-paths")
    per_task = 50
    windows = shown.join(paths.select("path", F.substring_index("path", "/", -1).alias("name")), "name").select(
        F.col("name").alias("job_id"), F.col("p_partkey").cast("string").alias("event_id"), "path", (F.col("frame") * 100).alias("t_ms"), F.lit(20).alias("x"), F.lit(1).alias("y"),
        F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(64).alias("x1"), F.lit(2).alias("y1")).alias("crop"),
    )

    def reader(every):
        def lines(picture):
            half = picture[::2, ::2] if picture.shape[0] == 4 else picture
            if int(bytes(half[0]).decode()) % every == 0:
                raise ValueError("too blurred")
            return [(bytes(half[1]).decode().strip(), 0.9, 0, 0, 2 * half.shape[1], 4)]

        return lines

    engines = [recordings.Engine("first", reader(5), 1200), recordings.Engine("second", reader(15))]
    rows = stored(recordings.recognised(windows, recordings.ranges(paths, 1, per_task), 10.0, engines, per_task), "recognised")
    named = targets.crop_labels(windows, rows.where("failure IS NULL"))
    failed = rows.where("failure IS NOT NULL").groupBy("event_id").agg(F.count(F.lit(1)).alias("failures"))
    return windows.join(named, ["job_id", "event_id"], "left").join(failed, "event_id", "left").select("event_id", "t_ms", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("failures", F.lit(0)).alias("failures"))


def progress_stream(spark, sf):
    """Latest state of each job from a stream of messages, one a day."""
    folder = fresh(spark, "progress")
    li = table(spark, sf, "lineitem")
    names = F.array(*map(F.lit, progress.STAGES))
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=F.col("l_linenumber") * 20)
    msg = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    msg = msg.select(F.col("l_orderkey").cast("string").alias("job_id"), F.element_at(names, F.col("l_linenumber")).alias("stage"), F.when(F.col("l_linenumber") == 7, "awaiting_review").otherwise("running").alias("status"), (F.col("q") / 100).alias("pct"), at.alias("at"))
    progress.publish(msg, folder + "/in")
    got = progress.run_to_end(progress.messages(spark, folder + "/in"), folder + "/out", folder + "/state")
    return got.groupBy("stage", "status", "ended").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pct"), 4).alias("pct"))


QUERIES = {
    f.__name__: f
    for f in (
        render_markdown, render_text, repro_html, github_labels, issue_payloads, ticket_patches, settings_updated, projects_listed, severity, job_list, timeline, revision_head, optimistic_lock, settings_merge,
        stage_sets, next_stages, upload_admission, media_kind, steps_renumbered, stage_latency, job_details, media_frames, media_change, media_texts, targets_recognised, progress_stream,
    )
}


def _ms(x: str) -> str:
    return f"(({x}) // 60000)::VARCHAR || ':' || lpad(((({x}) // 1000) % 60)::VARCHAR, 2, '0')"


def _esc(x: str) -> str:
    return f"""replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


STEP = """'Open part ' || l_partkey || CASE WHEN l_returnflag = 'R' THEN ' & <return> it' ELSE '' END || '.'"""
REPORT = f"""li AS (SELECT l_orderkey AS job_id, l_linenumber AS n, {STEP} AS text, round(0.5 + l_discount * 4, 2) AS conf, l_tax > 0.05 AS noted, (l_quantity * 1000)::BIGINT AS ms, l_partkey, l_returnflag FROM lineitem
), rep AS (SELECT o_orderkey AS job_id, o_custkey AS c, o_orderstatus AS s, 'Issue in ' || substr(o_orderpriority, 3) AS title,
    CASE o_orderstatus WHEN 'F' THEN 'crash' WHEN 'O' THEN 'functional' ELSE 'unknown' END AS bug_type, round(0.3::DOUBLE + (o_orderkey % 7) / 10.0::DOUBLE, 2) AS conf, o_orderkey * 10 AS bug_ms FROM orders WHERE o_orderkey IN (SELECT job_id FROM li)
)"""
NL = "chr(10)"
ORDER = "ORDER BY n, text, conf"
MD = f"""WITH {REPORT}, st AS (SELECT job_id, string_agg(n || '. [' || {_ms('ms')} || '] ' || text || CASE WHEN conf < 0.6 THEN ' (low confidence)' ELSE '' END || CASE WHEN noted THEN {NL} || '   - Note: price may include tax' ELSE '' END, {NL} {ORDER}) AS steps FROM li GROUP BY job_id)
SELECT job_id, array_to_string(list_filter([
  '# ' || title, '', CASE WHEN c % 2 = 0 THEN 'Seen <twice> & more.' || {NL} END, 'Bug type: ' || bug_type || ' | Overall confidence: ' || printf('%.2f', conf), '',
  CASE WHEN c % 3 = 0 THEN '## Preconditions' || {NL} || {NL} || '- Signed in' || {NL} END, '## Steps to Reproduce', '', steps, '', '## Observed Result', '', 'It stops.',
  CASE WHEN s <> 'P' THEN '(evidence at ' || {_ms('bug_ms')} || ')' END, '', '## Expected Result', '',
  CASE WHEN s = 'O' THEN 'It goes on.' || {NL} || '(basis: visible_convention, confidence 0.50)' ELSE 'Not stated - the recording does not contain enough evidence to infer expected behavior.' END, '',
  '## Environment (inferred from video)', '', '- Device: desktop', '- Resolution: 1080x720', '- Theme: dark', '',
  CASE WHEN s <> 'P' THEN '## Bug Manifestation' || {NL} || {NL} || 'At ' || {_ms('bug_ms')} || ' (confidence 0.85)' || {NL} END,
  CASE WHEN c % 5 = 0 THEN '## Ambiguities' || {NL} || {NL} || '- The recording is blurry; extracted text may be incomplete.' || {NL} END,
  '## Omitted Activity', '', '- 1:01-2:05: after the bug', '', '---', 'Generated from a screen recording. Steps are evidence-grounded; confidence is per-step.'], lambda x: x IS NOT NULL), {NL}) AS body
FROM rep JOIN st USING (job_id)"""
TXT = f"""WITH {REPORT}, st AS (SELECT job_id, string_agg(lpad(n::VARCHAR, 2, ' ') || '. ' || text || CASE WHEN conf < 0.6 THEN ' (low confidence)' ELSE '' END || ' [' || {_ms('ms')} || ']' || CASE WHEN noted THEN {NL} || '    Note: price may include tax' ELSE '' END, {NL} {ORDER}) AS steps FROM li GROUP BY job_id)
SELECT job_id, array_to_string(list_filter([
  'BUG REPORT', '==========', '', 'Title:      ' || title, 'Bug type:   ' || bug_type, 'Confidence: ' || printf('%.2f', conf) || ' (overall)', CASE WHEN c % 2 = 0 THEN {NL} || 'Seen <twice> & more.' END, '',
  CASE WHEN c % 3 = 0 THEN 'PRECONDITIONS' || {NL} || '-------------' || {NL} || '- Signed in' || {NL} END, 'STEPS TO REPRODUCE', '------------------', steps, '', 'OBSERVED RESULT', '---------------', 'It stops.',
  CASE WHEN s <> 'P' THEN '(evidence at ' || {_ms('bug_ms')} || ')' END, '', 'EXPECTED RESULT', '---------------',
  CASE WHEN s = 'O' THEN 'It goes on.' || {NL} || '(basis: visible_convention, confidence 0.50)' ELSE 'Not stated - the recording does not contain enough evidence to infer expected behavior.' END, '',
  'ENVIRONMENT (inferred from video)', '---------------------------------', '- Device: desktop', '- Resolution: 1080x720', '- Theme: dark', '',
  CASE WHEN s <> 'P' THEN 'BUG MANIFESTATION' || {NL} || '-----------------' || {NL} || 'At ' || {_ms('bug_ms')} || ' (confidence 0.85)' || {NL} END,
  CASE WHEN c % 5 = 0 THEN 'AMBIGUITIES' || {NL} || '-----------' || {NL} || '- The recording is blurry; extracted text may be incomplete.' || {NL} END,
  'OMITTED ACTIVITY', '----------------', '- 1:01-2:05: after the bug', '', 'Generated from a screen recording.'], lambda x: x IS NOT NULL), {NL}) AS body
FROM rep JOIN st USING (job_id)"""
HTML = f"""WITH {REPORT}, st AS (SELECT job_id, string_agg('<li>' || {_esc('text')} || ' [' || {_ms('ms')} || ']' || CASE WHEN noted THEN '<br/><i>Note: price may include tax</i>' ELSE '' END || '</li>', '' {ORDER}) AS steps FROM li GROUP BY job_id)
SELECT job_id, CASE WHEN c % 2 = 0 THEN '<p>Seen &lt;twice&gt; &amp; more.</p>' ELSE '' END || CASE WHEN c % 3 = 0 THEN '<p><b>Preconditions</b></p><ul><li>Signed in</li></ul>' ELSE '' END
  || '<p><b>Steps to Reproduce</b></p><ol>' || steps || '</ol><p><b>Observed Result</b><br/>It stops.</p>'
  || CASE WHEN s = 'O' THEN '<p><b>Expected Result</b><br/>It goes on. <i>(basis: visible_convention)</i></p>' ELSE '<p><b>Expected Result</b><br/><i>Not inferable from the recording; reviewer should confirm.</i></p>' END
  || '<p><b>Environment (inferred from video)</b><br/>Device: desktop<br/>Resolution: 1080x720</p>'
  || CASE WHEN c % 5 = 0 THEN '<p><b>Ambiguities</b></p><ul><li>The recording is blurry; extracted text may be incomplete.</li></ul>' ELSE '' END
  || '<p><i>Overall confidence ' || printf('%.2f', conf) || '</i></p>' AS body FROM rep JOIN st USING (job_id)"""
STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in progress.STAGES) + "]"
TYPES = "[" + ", ".join(f"'{t}'" for t in [*sorted(catalog.MEDIA_TYPES), "text/plain"]) + "]"
EXTS = "[" + ", ".join(f"'{catalog.MEDIA_TYPES[t]}'" for t in sorted(catalog.MEDIA_TYPES)) + ", NULL]"
REV = """n AS (SELECT l_orderkey AS report_id, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS revision_id, l_shipdate AS created_at FROM lineitem
), r AS (SELECT *, lag(revision_id) OVER (PARTITION BY report_id ORDER BY revision_id) AS parent_revision_id FROM n
), h AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY created_at DESC, revision_id DESC) = 1)"""

ORACLE_SQL = {
    "job_details": f"""SELECT o_orderkey AS job_id, o_custkey AS video_id, {STAGE_LIST}[o_orderkey % 11 + 1] AS current_stage, round((o_orderkey % 11) / 11.0::DOUBLE, 4) AS progress, coalesce(r.id, -1) AS report_id
      FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS id FROM lineitem GROUP BY 1) r ON r.l_orderkey = o_orderkey""",
    "media_change": """SELECT s_name AS path, t.ms AS t_ms, round((567 * 64 + 9 * 255) / 576.0::DOUBLE, 1) AS lum, t.changed AS changed FROM supplier, (VALUES (0::BIGINT, 0::BIGINT), (200::BIGINT, 18::BIGINT)) AS t(ms, changed)""",
    "media_texts": """WITH c AS (SELECT conv_id || '-' || turn AS name, hex(encode(text)) AS h FROM conversations WHERE length(text) > 0
      ), f AS (SELECT name, i, list_transform(range(49), lambda p: CASE WHEN (i * 49 + p) * 2 < length(h) THEN ('0x' || substr(h, (i * 49 + p) * 2 + 1, 2))::BIGINT ELSE 0 END) AS px FROM (SELECT name, h, unnest(range((length(h) // 2 + 48) // 49)) AS i FROM c)
      ), b AS (SELECT *, lag(px) OVER (PARTITION BY name ORDER BY i) AS prev FROM f
      ), lap AS (SELECT name, i, var_pop(px[y * 7 + x + 1] * -4 + px[abs(y - 1) * 7 + x + 1] + px[(6 - abs(5 - y)) * 7 + x + 1] + px[y * 7 + abs(x - 1) + 1] + px[y * 7 + (6 - abs(5 - x)) + 1]) AS blur
        FROM f, range(7) AS ys(y), range(7) AS xs(x) GROUP BY name, i
      ), bins AS (SELECT name, i, k, len(list_filter(px, lambda v: v // 4 = k)) AS q, len(list_filter(prev, lambda v: v // 4 = k)) AS p FROM b, range(64) AS ks(k) WHERE prev IS NOT NULL
      ), unit AS (SELECT name, i, p / sqrt(sum(p * p) OVER w) AS p, q / sqrt(sum(q * q) OVER w) AS q FROM bins WINDOW w AS (PARTITION BY name, i)
      ), hist AS (SELECT name, i, corr(p, q) AS alike FROM unit GROUP BY name, i
      ), ch AS (SELECT name, i, list_sum(list_transform(range(1, 50), lambda k: (abs(px[k] - prev[k]) > 25)::INT)) / 49.0::DOUBLE AS share FROM b WHERE prev IS NOT NULL)
      SELECT b.name, (b.i * 200)::BIGINT AS t_ms, round(list_sum(b.px) / 49.0::DOUBLE, 1) AS lum, round(blur, 3) AS blur, round(coalesce(0.6::DOUBLE * greatest(0.0::DOUBLE, 1 - coalesce(alike, 1.0::DOUBLE)) + 0.4::DOUBLE * share, 0.0::DOUBLE), 4) AS score, round(coalesce(share, 0.0::DOUBLE), 4) AS change_frac
      FROM b JOIN lap USING (name, i) LEFT JOIN hist USING (name, i) LEFT JOIN ch USING (name, i)""",
    "targets_recognised": f"""WITH src AS (SELECT p_partkey::VARCHAR AS key, p_name AS text FROM part) {label_sql('src', 'lb')}
      SELECT p_partkey::VARCHAR AS event_id, ((row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) - 1) * 100)::BIGINT AS t_ms, CASE WHEN p_partkey % 15 = 0 THEN '' ELSE label END AS label, (CASE WHEN p_partkey % 15 = 0 THEN 2 WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS failures
      FROM part JOIN lb ON lb.key = p_partkey::VARCHAR""",
    "progress_stream": f"""WITH m AS (SELECT l_orderkey AS job_id, l_linenumber AS n, min(l_quantity) / 100 AS pct FROM lineitem GROUP BY 1, 2), h AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1)
      SELECT {STAGE_LIST}[n] AS stage, CASE WHEN n = 7 THEN 'awaiting_review' ELSE 'running' END AS status, n = 7 AS ended, count(*) AS n, round(sum(pct), 4) AS pct FROM h GROUP BY n""",
    "render_markdown": MD,
    "render_text": TXT,
    "repro_html": HTML,
    "github_labels": f"WITH {REPORT} SELECT job_id, 'bug,recording:' || bug_type || CASE WHEN conf < 0.6 THEN ',needs-verification' ELSE '' END AS labels FROM rep",
    "issue_payloads": f"""WITH m AS ({MD}), {REPORT} SELECT rep.job_id, title, md5(m.body) AS body_md5, 'bug,recording:' || bug_type || CASE WHEN conf < 0.6 THEN ',needs-verification' ELSE '' END AS labels FROM rep JOIN m ON m.job_id = rep.job_id""",
    "ticket_patches": f"""WITH m AS ({HTML}), {REPORT} SELECT rep.job_id, CASE WHEN rep.job_id % 5 = 0 THEN 400 ELSE 201 END::INT AS code, 'add' AS ops, (4 + (rep.job_id % 2 = 0)::INT)::BIGINT AS n, title, md5(m.body) AS steps_md5,
      CASE bug_type WHEN 'crash' THEN '1 - Critical' WHEN 'functional' THEN '2 - High' ELSE '3 - Medium' END AS severity, 'recording; ' || bug_type AS tags, CASE WHEN rep.job_id % 2 = 0 THEN 'Web\\Shop' ELSE '' END AS area FROM rep JOIN m ON m.job_id = rep.job_id""",
    "settings_updated": """SELECT c_custkey AS org_id, CASE WHEN c_custkey % 6 = 0 THEN 404 ELSE 200 END::INT AS code, CASE WHEN c_custkey % 6 <> 0 AND c_custkey % 4 <> 0 THEN c_mktsegment ELSE '' END AS segment,
      CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 5 <> 0 THEN 'gold' WHEN c_custkey % 4 <> 0 THEN 'base' ELSE '' END AS tier FROM customer""",
    "projects_listed": """SELECT s_nationkey AS org_id, string_agg(s_name, ',' ORDER BY s_suppkey % 7, s_suppkey) AS projects FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0 GROUP BY 1""",
    "severity": f"WITH {REPORT} SELECT CASE bug_type WHEN 'crash' THEN '1 - Critical' WHEN 'functional' THEN '2 - High' ELSE '3 - Medium' END AS severity, count(*) AS n FROM rep GROUP BY 1",
    "job_list": """SELECT o_orderkey AS job_id, o_custkey AS video_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'awaiting_review' ELSE 'failed' END AS status, c_name AS filename, coalesce(r.report_id, -1) AS report_id
      FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS report_id FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) r ON r.l_orderkey = o_orderkey""",
    "timeline": """SELECT o_orderkey AS job_id, coalesce(string_agg(l_linenumber || '@' || l_quantity::BIGINT, ',' ORDER BY l_linenumber, l_quantity::BIGINT), '') AS segments,
      coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (l_returnflag = 'R'), '') AS actions FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "revision_head": f"WITH {REV} SELECT report_id, revision_id, coalesce(parent_revision_id, 0) AS parent_revision_id FROM h",
    "optimistic_lock": f"WITH {REV} SELECT r.report_id, r.revision_id AS parent_revision_id, r.revision_id % 2 = 0 AS even FROM r JOIN h ON h.report_id = r.report_id AND h.revision_id = r.revision_id",
    "settings_merge": """SELECT c_custkey AS org_id, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN 'moved' ELSE c_nationkey::VARCHAR END AS nation, CASE WHEN c_custkey % 2 = 0 THEN 'gold' ELSE 'base' END AS tier,
      CASE WHEN c_custkey % 4 = 0 THEN 'gold' ELSE 'default' END AS team FROM customer""",
    "stage_sets": f"""WITH s AS (SELECT DISTINCT l_orderkey AS job_id, {STAGE_LIST}[l_linenumber] AS stage, l_returnflag = 'R' AS bad FROM lineitem)
      SELECT job_id, coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (NOT bad), '') AS done, coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (bad), '') AS failed FROM s GROUP BY job_id""",
    "next_stages": f"SELECT {STAGE_LIST}[l_linenumber] AS stage, {STAGE_LIST}[l_linenumber + 1] AS next, round((l_linenumber - 1) / 11.0::DOUBLE, 4) AS pct, count(*) AS n FROM lineitem GROUP BY l_linenumber",
    "upload_admission": f"""WITH u AS (SELECT p_partkey % 30 AS project_id, {TYPES}[p_partkey % 6 + 1] AS t, {EXTS}[p_partkey % 6 + 1] AS extension, p_size::BIGINT * 50000000 AS b FROM part)
      SELECT (CASE WHEN project_id NOT IN (SELECT n_nationkey FROM nation) THEN 404 WHEN b > 2147483648 THEN 413 WHEN extension IS NULL THEN 415 ELSE 200 END)::INT AS status, count(*) AS n, max(extension) AS extension FROM u GROUP BY 1""",
    "media_kind": "SELECT s_suppkey AS video_id, CASE WHEN s_suppkey % 3 = 2 AND s_acctbal > 0 THEN 'derived/' || s_suppkey || '/proxy' ELSE 'raw/' || s_name END AS key FROM supplier",
    "steps_renumbered": """WITH li AS (SELECT l_orderkey AS job_id, l_linenumber AS idx, bool_or(l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1, 2)
      SELECT job_id, idx, row_number() OVER (PARTITION BY job_id ORDER BY idx) AS new_idx FROM li WHERE NOT bad""",
    "stage_latency": """SELECT event_type, count(*) AS n, sum(CASE WHEN value <= 1 THEN 1 ELSE 0 END)::BIGINT AS le_1, sum(CASE WHEN value <= 5 THEN 1 ELSE 0 END)::BIGINT AS le_5,
      sum(CASE WHEN value <= 25 THEN 1 ELSE 0 END)::BIGINT AS le_25, sum(CASE WHEN value <= 125 THEN 1 ELSE 0 END)::BIGINT AS le_125, round(sum(value), 4) AS total FROM events GROUP BY 1""",
}
