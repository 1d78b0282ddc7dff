"""Queries over screen text, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import events as ev
from tracewright.operators import media, steps
from tracewright.plans.segmentation import BASE
from tracewright.sources import adapters as a
from tracewright.sources.tables import table

UI = """ui AS (
  SELECT 'doc:' || doc_id || ':' || pos AS key, string_split(text, chr(10))[pos + 1] AS text FROM documents, unnest(range(0, len(string_split(text, chr(10))))) AS u(pos)
  UNION ALL SELECT 'url:' || page_id, 'fm) 6 ' || regexp_replace(url, '^https?://', '') || ' 3' FROM pages
  UNION ALL SELECT 'part:' || p_partkey, '«|' || p_name || '® wll' FROM part
  UNION ALL SELECT 'customer:' || c_custkey, c_name FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, day(o_orderdate) || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || ' ' || substr(o_orderpriority, 3) FROM orders
)"""


# The SQL writes the rules out on its own, so that a slip in the operators' constants shows.
SPACES = r"[\s\p{Z}]+"
ENDS = """.,;:!?()"''"""
TIME_TOKEN = r"^[^\p{L}\p{N}_]*[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?[^\p{L}\p{N}_]*$"
TIME_INSIDE = r"(^|[^\p{L}\p{N}_])[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?([^\p{L}\p{N}_]|$)"
DOMAIN = r"^[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}(/[^\s]*)?$"
EMAIL = r"^[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[A-Za-z]{2,}$"
NUMBER = r"^[+-]?[0-9][0-9,.]*%?$"
WORD_PATTERN = r"^[A-Za-z][A-Za-z''&.-]*$"
WORD_DIGITS = r"^[A-Za-z]+[0-9]{1,6}$"
GLYPHS = "'ull', 'ul', 'ules', 'ies', 'wll', 'atl', 'lte', 'volte', '5g', '4g', '3g'"
SHORTS = "'ok', 'on', 'in', 'to', 'of', 'at', 'go', 'no', 'up', 'or', 'if', 'my', 'we', 'he', 'it', 'is', 'as', 'an', 'am', 'do', 'be', 'by'"
ERROR_WORDS = "error|failed|failure|exception|crash|undefined|null|nan|oops|something went wrong|not found|cannot|unable to|invalid"


def _clean(x: str) -> str:
    artifacts = r"[«»©®™•¤§|`~^*_=<>{}\[\]\\‘’“”\x00-\x1f]"
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '{artifacts}', ' ', 'g'), '{SPACES}', ' ', 'g'), ' .,;:-')"


KIND = f"""CASE WHEN b = '' THEN 'junk' WHEN regexp_matches(b, '{TIME_TOKEN}') THEN 'time'
    WHEN regexp_matches(b, '{DOMAIN}') OR regexp_matches(b, '{EMAIL}') THEN 'domain'
    WHEN regexp_matches(b, '{NUMBER}') THEN 'number'
    WHEN regexp_matches(b, '{WORD_DIGITS}') THEN CASE WHEN length(regexp_replace(b, '[0-9]', '', 'g')) >= 3 AND regexp_matches(lower(b), '[aeiouy]') THEN 'word' ELSE 'junk' END
    WHEN NOT regexp_matches(b, '{WORD_PATTERN}') OR lower(b) IN ({GLYPHS}) THEN 'junk'
    WHEN length(b) >= 3 THEN CASE WHEN regexp_matches(lower(b), '[aeiouy]') OR (b = upper(b) AND length(b) <= 5) THEN 'word' ELSE 'junk' END
    WHEN lower(b) IN ({SHORTS}) OR (length(b) = 2 AND b = upper(b)) THEN 'word' ELSE 'junk' END"""


def quality_sql(source: str, p: str, column: str = "text") -> str:
    """CTEs {p}_k (tokens with kinds) and {p} (key, c, quality) of a relation with key and text."""
    return f""", {p}_c AS (SELECT key, {_clean(column)} AS c FROM {source}
), {p}_t AS (SELECT key, c, pos, string_split(c, ' ')[pos] AS tok FROM {p}_c, unnest(range(1, len(string_split(c, ' ')) + 1)) AS u(pos) WHERE c <> ''
), {p}_b AS (SELECT *, trim(tok, '{ENDS}') AS b FROM {p}_t
), {p}_r AS (SELECT *, {KIND} AS raw, lower(lag(tok) OVER w) AS before, lower(lead(tok) OVER w) AS after FROM {p}_b WINDOW w AS (PARTITION BY key ORDER BY pos)
), {p}_k AS (SELECT *, CASE WHEN raw = 'word' AND length(tok) <= 3 AND (coalesce(before = lower(tok), false) OR coalesce(after = lower(tok), false)) THEN 'junk' ELSE raw END AS kind FROM {p}_r
), {p}_s AS (SELECT key, sum(length(tok)) AS total, coalesce(sum(length(tok)) FILTER (kind = 'word'), 0) AS word, coalesce(sum(length(tok)) FILTER (kind = 'junk'), 0) AS junk,
    coalesce(sum(length(tok)) FILTER (kind = 'number'), 0) AS number, count(*) FILTER (kind = 'domain') AS domains, count(*) FILTER (kind = 'time') AS times,
    count(*) FILTER (kind = 'word') AS words, count(*) FILTER (kind = 'junk') AS junks, count(*) FILTER (kind = 'number') AS numbers, string_agg(kind, ' ' ORDER BY pos) AS kinds FROM {p}_k GROUP BY key
), {p} AS (SELECT c.key, c.c, coalesce(s.kinds, '') AS kinds, (CASE WHEN length(c.c) < 2 THEN 0.0 WHEN domains > 0 THEN 0.9 WHEN times > 0 AND word < 10 THEN 0.0 WHEN junk > word THEN 0.0
    WHEN words = 1 AND word <= 3 AND junks >= 1 THEN 0.0 WHEN words = 0 THEN CASE WHEN numbers = 1 AND length(c.c) <= 10 AND junks = 0 THEN 0.5 ELSE 0.0 END
    ELSE round(least(1.0, (word + 0.5::DOUBLE * number) / greatest(total, 1)), 3) END)::DOUBLE AS quality FROM {p}_c c LEFT JOIN {p}_s s ON s.key = c.key
)"""


def label_sql(source: str, p: str, most: int = 60) -> str:
    """CTE {p} (key, label, quality of the label's source) of a relation with key and text."""
    return (
        quality_sql(source, p + "q")
        + f""", {p}_m AS (SELECT key, arg_min(b, pos) FILTER (regexp_matches(b, '{DOMAIN}') OR regexp_matches(b, '{EMAIL}')) AS url,
    min(pos) FILTER (raw <> 'junk') AS lo, max(pos) FILTER (raw <> 'junk') AS hi FROM {p}q_k GROUP BY key
), {p}_mid AS (SELECT m.key, coalesce(string_agg(k.tok, ' ' ORDER BY k.pos) FILTER (k.pos BETWEEN m.lo AND m.hi), '') AS text FROM {p}_m m JOIN {p}q_k k ON k.key = m.key GROUP BY m.key
)"""
        + quality_sql(f"{p}_mid", p + "mq")
        + f""", {p}_l AS (SELECT q.key, CASE WHEN m.url IS NOT NULL THEN m.url WHEN q.quality >= 0.5 AND mq.quality >= 0.5 THEN mid.text ELSE '' END AS label
    FROM {p}q q LEFT JOIN {p}_m m ON m.key = q.key LEFT JOIN {p}mq mq ON mq.key = q.key LEFT JOIN {p}_mid mid ON mid.key = q.key
), {p} AS (SELECT key, CASE WHEN length(label) > {most} THEN rtrim(left(label, {most - 3})) || '...' ELSE label END AS label FROM {p}_l
)"""
    )


BLOCKS = (
    r"""bl AS (
  SELECT conv_id AS job_id, conv_id || '-' || turn AS frame_id, turn * 1500 AS t_ms, turn * 10000 + pos AS block_no, s AS text, (pos * 97) % 600 AS x, (pos % 7) * 173 + 40 AS y, 120 AS w, 40 AS h,
         round(0.40::DOUBLE + (length(s) % 60) / 100.0::DOUBLE, 2) AS confidence, conv_id || '-' || turn || ':' || pos AS key
  FROM (SELECT conv_id, turn, pos, string_split(text, '. ')[pos + 1] AS s FROM conversations, unnest(range(0, len(string_split(text, '. ')))) AS u(pos))
)"""
    + quality_sql("bl", "bq")
    + f""", br AS (
  SELECT bl.*, bq.c, bq.quality, CASE WHEN y < 64.8 THEN CASE WHEN regexp_matches(bq.c, '{TIME_INSIDE}') OR bq.quality < 0.5 THEN 'status_bar'
           WHEN contains(bl.text, '/') OR starts_with(bl.text, 'http') OR starts_with(bl.text, 'www.') OR contains(string_split(bl.text, ' ')[1], '.') THEN 'url_bar' ELSE 'title_bar' END
         WHEN y < 172.8 AND len(list_filter(regexp_split_to_array(bl.text, '{SPACES}'), lambda t: regexp_matches(trim(t, '{ENDS}'), '{DOMAIN}'))) > 0 THEN 'url_bar'
         WHEN y + h > 1026 THEN 'status_bar' WHEN length(bl.text) <= 24 AND w < 270 AND h < 64.8 THEN 'button_like' ELSE 'body' END AS role
  FROM bl JOIN bq ON bq.key = bl.key
)"""
)


def _ui(spark, sf):
    u = a.ui_strings(spark, sf)
    return u.select(F.concat_ws(":", "src", "id").alias("key"), "text")


def clean_text(spark, sf):
    return _ui(spark, sf).select("key", text.clean(F.col("text")).alias("clean"))


def token_classes(spark, sf):
    q = text.with_quality(_ui(spark, sf), "text")
    return q.select("key", F.array_join(F.transform("q_kinds", lambda k: k["kind"]), " ").alias("kinds"))


def label_quality(spark, sf):
    return text.with_quality(_ui(spark, sf), "text").select("key", F.col("q_quality").alias("quality"))


def readable_filter(spark, sf):
    q = text.with_quality(_ui(spark, sf), "text").where("q_quality >= 0.5")
    return q.groupBy(F.split_part("key", F.lit(":"), F.lit(1)).alias("src")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("q_clean")).alias("chars"))


def clock_detect(spark, sf):
    return _ui(spark, sf).select("key", text.clock_like(text.clean(F.col("text"))).alias("clock"))


def typed_text_gate(spark, sf):
    q = text.with_quality(_ui(spark, sf), "text")
    return q.select("key", text.typed_ok(F.col("q_clean"), F.col("q_tokens"), F.col("q_quality")).alias("ok"))


def sanitize_label(spark, sf):
    return text.with_label(_ui(spark, sf), "text").select("key", "label")


def ocr_role(spark, sf):
    return a.blocks(spark, sf).select("frame_id", "block_no", "role")


def typing_growth(spark, sf):
    """Two frames per document: its first line, then its whole text, in boxes of which half overlap enough."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), "text")
    both = d.select("job_id", F.posexplode(F.array(F.split("text", "\n")[0], F.col("text"))).alias("pos", "text"))
    fid = F.concat_ws("-", "job_id", "pos")
    frames = both.select("job_id", fid.alias("frame_id"), (F.col("pos") * 1000).cast("long").alias("t_ms"), F.lit(0).alias("segment_idx"), F.col("pos").alias("seq"))
    blocks = both.select("job_id", fid.alias("frame_id"), F.col("pos").alias("block_no"), "text", (F.lit(10) + F.col("pos") * 40 * (F.col("job_id") % 4)).cast("long").alias("x"), *[F.lit(v).cast("long").alias(n) for n, v in (("y", 200), ("w", 101), ("h", 40))], F.lit(0.9).alias("confidence"), F.lit("body").alias("role"))
    return ev.typing(blocks, frames).select("job_id", "t_start_ms", "t_end_ms", "final_text", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


def _events_on_turns(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("job_id"), F.concat_ws("-", "conv_id", "turn").alias("event_id"), (F.col("turn") * 1500).alias("t_start_ms"), ((F.col("conv_id") * 37) % 500).cast("long").alias("x"), ((F.col("turn") * 211) % 900).cast("long").alias("y"), F.lit("click").alias("type"))


def nearest_label(spark, sf):
    return ev.nearest_labels(_events_on_turns(spark, sf), a.blocks(spark, sf))


def form_submit_promotion(spark, sf):
    e = a.event_list(spark, sf).select("job_id", "event_id", "type", "target")
    labels = e.where("target <> ''").select("job_id", "event_id", F.col("target").alias("label"))
    return ev.promoted(e, labels).groupBy("type", "button").agg(F.count(F.lit(1)).alias("n"))


def _turn_segments(spark, sf):
    s = a.frames(spark, sf).select("job_id", F.col("segment_idx").alias("idx"), "t_ms").groupBy("job_id", "idx").agg(F.min("t_ms").alias("start_ms"))
    return s.withColumn("transition_type", F.when(F.col("idx") % 2 == 1, "nav").otherwise("dialog"))


def navigation_target(spark, sf):
    return ev.navigations(_turn_segments(spark, sf), a.blocks(spark, sf), a.frames(spark, sf)).withColumn("signals", F.array_join("signals", ","))


def error_anomalies(spark, sf):
    e, p = a.base(spark, sf), table(spark, sf, "part").select("p_partkey", "p_name")
    b = e.join(p, e["k"] == p["p_partkey"]).select("job_id", "t_ms", F.concat(F.initcap("event_type"), F.lit(" "), "p_name").alias("text"), F.round(0.40 + (F.col("k") % 60) / 100, 2).alias("confidence"), F.col("event_id").alias("block_no"))
    return ev.error_texts(b).select("job_id", "t_ms", "text", "score", "ord")


def line_rollup(spark, sf):
    li = table(spark, sf, "lineitem")
    words = li.select(F.col("l_orderkey").alias("job_id"), F.lit("f").alias("frame_id"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), (F.col("l_partkey") % 2).alias("line_num"), F.col("l_linenumber").alias("word_no"), F.concat(F.lit(" "), "l_returnflag", F.col("l_linenumber").cast("string")).alias("word"), (F.col("l_quantity") * 2).alias("conf"), (F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 50).alias("y"), F.lit(10).alias("w"), F.lit(8).alias("h"))
    return media.lines_of(words).select("job_id", "line_num", "text", "confidence", "x", "y", "w", "h")


def title_pick(spark, sf):
    return steps.title_sources(a.blocks(spark, sf))


def entry_step(spark, sf):
    f = a.frames(spark, sf)
    jobs = f.select("job_id").distinct().withColumn("device_class", F.when(F.col("job_id") % 2 == 0, "mobile").otherwise("desktop"))
    return steps.entry_steps(jobs, a.blocks(spark, sf), f).select("job_id", "text", "grounding", "confidence", "uncertainty_note", F.col("evidence")[0]["frame_id"].alias("frame_id"), F.col("evidence")[0]["t_end_ms"].alias("t_end_ms"))


def preconditions(spark, sf):
    f = a.frames(spark, sf)
    return steps.preconditions(f.select("job_id").distinct(), a.blocks(spark, sf), f)


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, token_classes, label_quality, readable_filter, clock_detect, typed_text_gate, sanitize_label, ocr_role, typing_growth,
        nearest_label, form_submit_promotion, navigation_target, error_anomalies, line_rollup, title_pick, entry_step, preconditions,
    )
}

TWO = """two AS (SELECT doc_id AS job_id, v.pos AS pos, 'd' || doc_id || '-' || v.pos AS key, CASE WHEN v.pos = 0 THEN string_split(text, chr(10))[1] ELSE text END AS text FROM documents, (VALUES (0), (1)) AS v(pos))"""
EARLY = ", early AS (SELECT job_id, frame_id FROM (SELECT DISTINCT conv_id AS job_id, conv_id || '-' || turn AS frame_id, turn FROM conversations) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY turn) <= 2)"
WEIGHT = ", wl AS (SELECT br.*, lb.label, round(lq.quality * least(length(lb.label), 8) / 8, 9) AS weight FROM br JOIN lb ON lb.key = br.key JOIN lq ON lq.key = br.key WHERE lb.label <> '')"
LABELLED = BLOCKS + label_sql("bl", "lb") + ", lt AS (SELECT key, label AS text FROM lb)" + quality_sql("lt", "lq")
LABEL80 = BLOCKS + label_sql("bl", "lb", 80) + ", lt AS (SELECT key, label AS text FROM lb)" + quality_sql("lt", "lq")

ORACLE_SQL = {
    "clean_text": f"WITH {UI} SELECT key, {_clean('text')} AS clean FROM ui",
    "token_classes": f"WITH {UI} {quality_sql('ui', 'q')} SELECT key, kinds FROM q",
    "label_quality": f"WITH {UI} {quality_sql('ui', 'q')} SELECT key, quality FROM q",
    "readable_filter": f"WITH {UI} {quality_sql('ui', 'q')} SELECT split_part(key, ':', 1) AS src, count(*) AS n, sum(length(c))::BIGINT AS chars FROM q WHERE quality >= 0.5 GROUP BY 1",
    "clock_detect": f"""WITH {UI}, cc AS (SELECT key, {_clean('text')} AS c FROM ui), rr AS (SELECT key, c, regexp_replace(regexp_replace(c, '{TIME_INSIDE}', '\\1 \\3', 'g'), '{TIME_INSIDE}', '\\1 \\3', 'g') AS r FROM cc
      ), tt AS (SELECT key, tok, trim(tok, '{ENDS}') AS b FROM rr, unnest(string_split(r, ' ')) AS u(tok) WHERE tok <> ''
      ), ww AS (SELECT key, sum(length(tok)) AS n FROM tt WHERE ({KIND}) = 'word' AND lower(tok) NOT IN ('am', 'pm') GROUP BY key)
      SELECT cc.key, regexp_matches(c, '{TIME_INSIDE}') AND coalesce(ww.n, 0) < 10 AS clock FROM cc LEFT JOIN ww ON ww.key = cc.key""",
    "typed_text_gate": f"""WITH {UI} {quality_sql('ui', 'q')}, caps AS (SELECT key, bool_and(regexp_matches(regexp_replace(tok, '[^\\p{{L}}]', '', 'g'), '^(\\p{{Ll}}*|\\p{{Lu}}+|\\p{{Lu}}\\p{{Ll}}*)$')) AS regular FROM q_k GROUP BY key
      ), n AS (SELECT q.*, coalesce(caps.regular, true) AS regular, length(regexp_replace(c, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(c, '[^0-9]', '', 'g')) AS digits FROM q LEFT JOIN caps ON caps.key = q.key)
      SELECT key, length(c) >= 3 AND NOT regexp_matches(c, '{TIME_INSIDE}') AND ((digits >= 3 AND letters = 0 AND length(c) <= 20) OR (letters >= 3 AND regular AND quality >= 0.65)) AS ok FROM n""",
    "sanitize_label": f"WITH {UI} {label_sql('ui', 'lb')} SELECT key, label FROM lb",
    "ocr_role": f"WITH {BLOCKS} SELECT frame_id, block_no, role FROM br",
    "typing_growth": f"""WITH {TWO} {quality_sql('two', 'q')}, caps AS (SELECT key, bool_and(regexp_matches(regexp_replace(tok, '[^\\p{{L}}]', '', 'g'), '^(\\p{{Ll}}*|\\p{{Lu}}+|\\p{{Lu}}\\p{{Ll}}*)$')) AS regular FROM q_k GROUP BY key
      ), n AS (SELECT two.job_id, two.pos, q.c, q.quality, caps.regular, length(regexp_replace(c, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(c, '[^0-9]', '', 'g')) AS digits FROM two JOIN q ON q.key = two.key LEFT JOIN caps ON caps.key = two.key)
      SELECT b.job_id, 0::BIGINT AS t_start_ms, 1000::BIGINT AS t_end_ms, left(b.c, 200) AS final_text, (60 + 40 * (b.job_id % 4))::BIGINT AS x, 220::BIGINT AS y FROM n p JOIN n b ON b.job_id = p.job_id AND p.pos = 0 AND b.pos = 1
      WHERE b.job_id % 4 < 2 AND length(b.c) - length(p.c) >= 3 AND (p.c = '' OR length(p.c) >= 2) AND starts_with(lower(b.c), lower(left(p.c, 3))) AND length(b.c) >= 3 AND NOT regexp_matches(b.c, '{TIME_INSIDE}')
        AND ((b.digits >= 3 AND b.letters = 0 AND length(b.c) <= 20) OR (b.letters >= 3 AND coalesce(b.regular, true) AND b.quality >= 0.65))""",
    "nearest_label": f"""WITH {LABELLED}, ce AS (SELECT conv_id AS job_id, conv_id || '-' || turn AS event_id, turn * 1500 AS t, (conv_id * 37) % 500 AS x, (turn * 211) % 900 AS y FROM conversations
      ), m AS (SELECT ce.job_id, ce.event_id, br.block_no, br.role, lb.label, lq.quality, sqrt(pow(ce.x - (br.x + br.w / 2), 2) + pow(ce.y - (br.y + br.h / 2), 2)) AS d
        FROM ce JOIN br ON br.job_id = ce.job_id AND abs(br.t_ms - ce.t) <= 3000 AND br.role IN ('button_like', 'body') AND br.confidence >= 0.45 JOIN lb ON lb.key = br.key AND lb.label <> '' JOIN lq ON lq.key = br.key
      ), s AS (SELECT *, round((1 - d / 151) + CASE WHEN role = 'button_like' THEN 0.3 ELSE 0.0 END::DOUBLE + 0.15::DOUBLE * quality - CASE WHEN length(label) > 40 THEN 0.1 ELSE 0.0 END::DOUBLE, 9) AS score FROM m WHERE d <= 150)
      SELECT job_id, event_id, arg_max(label, (score, -block_no)) AS label FROM s WHERE score > 0 GROUP BY job_id, event_id""",
    "form_submit_promotion": f"""WITH {BASE}, e AS (SELECT CASE event_type WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'form_submit' WHEN 'error' THEN CASE WHEN k < 50 THEN 'navigate' ELSE 'dialog_open' END ELSE 'scroll' END AS type, k FROM base
      ), p AS (SELECT type, type = 'click' AND k % 5 <> 0 AND k % 3 = 0 AS sends FROM e)
      SELECT CASE WHEN sends THEN 'form_submit' ELSE type END AS type, CASE WHEN sends THEN 'Save' END AS button, count(*) AS n FROM p GROUP BY 1, 2""",
    "navigation_target": f"""WITH {LABEL80}, fr AS (SELECT conv_id AS job_id, turn // 2 AS idx, min(turn) AS turn FROM conversations GROUP BY 1, 2
      ), tg AS (SELECT fr.job_id, fr.idx, arg_min(lb.label, br.block_no) AS target FROM fr JOIN br ON br.frame_id = fr.job_id || '-' || fr.turn AND br.role IN ('url_bar', 'title_bar') AND br.confidence > 0.45 JOIN lb ON lb.key = br.key AND lb.label <> '' GROUP BY 1, 2)
      SELECT fr.job_id, fr.idx::BIGINT AS idx, CASE WHEN fr.idx % 2 = 1 THEN 'navigate' ELSE 'dialog_open' END AS type, fr.turn * 1500 AS t_start_ms, fr.turn * 1500 + 300 AS t_end_ms,
        CASE WHEN fr.idx % 2 = 1 THEN coalesce(tg.target, '') ELSE '' END AS target, CASE WHEN fr.idx % 2 = 1 THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence, CASE WHEN fr.idx % 2 = 1 THEN 'segment_transition' ELSE 'localized_overlay' END AS signals FROM fr LEFT JOIN tg ON tg.job_id = fr.job_id AND tg.idx = fr.idx WHERE fr.idx > 0""",
    "error_anomalies": f"""WITH {BASE}, eb AS (SELECT job_id, t_ms, upper(event_type[1]) || event_type[2:] || ' ' || p_name AS text, round(0.40::DOUBLE + (k % 60) / 100.0::DOUBLE, 2) AS confidence, event_id AS ord, 'e' || event_id AS key FROM base JOIN part ON p_partkey = k) {quality_sql('eb', 'q')}
      SELECT job_id, t_ms, left(q.c, 300) AS text, round(least(0.85::DOUBLE, 0.5::DOUBLE + 0.4::DOUBLE * confidence), 6) AS score, ord FROM eb JOIN q ON q.key = eb.key WHERE confidence >= 0.45 AND quality >= 0.5 AND regexp_matches(lower(q.c), '(^|[^\\p{{L}}\\p{{N}}_])({ERROR_WORDS})([^\\p{{L}}\\p{{N}}_]|$)')""",
    "line_rollup": """SELECT l_orderkey AS job_id, l_partkey % 2 AS line_num, string_agg(l_returnflag || l_linenumber, ' ' ORDER BY l_linenumber, l_returnflag) AS text, round(avg(l_quantity * 2) / 100, 3) AS confidence,
      min(l_partkey % 100) AS x, min(l_suppkey % 50) AS y, max(l_partkey % 100 + 10) - min(l_partkey % 100) AS w, max(l_suppkey % 50 + 8) - min(l_suppkey % 50) AS h FROM lineitem WHERE l_quantity * 2 >= 30 GROUP BY 1, 2""",
    "title_pick": f"WITH {LABELLED} {WEIGHT} SELECT job_id, arg_max(label, (weight, -block_no)) AS title FROM wl WHERE role IN ('title_bar', 'url_bar') AND confidence > 0.5 AND weight > 0 GROUP BY job_id",
    "entry_step": f"""WITH {LABEL80} {WEIGHT} {EARLY}, cand AS (SELECT wl.*, regexp_matches(string_split(label, '/')[1], '{DOMAIN}') AS addr FROM wl JOIN early USING (job_id, frame_id) WHERE confidence > 0.45 AND weight > 0
      ), pick AS (SELECT job_id, arg_max(label, (weight, -block_no)) FILTER (addr) AS domain, arg_max(label, (weight, -block_no)) FILTER (NOT addr AND role = 'title_bar') AS title FROM cand GROUP BY job_id
      ), j AS (SELECT conv_id AS job_id, min(turn) AS turn FROM conversations GROUP BY 1)
      SELECT j.job_id, CASE WHEN domain IS NOT NULL THEN 'Open "' || domain || '" in the browser.' WHEN title IS NOT NULL THEN 'Open the "' || title || '" app.'
          ELSE 'Open the ' || CASE WHEN j.job_id % 2 = 0 THEN 'app' ELSE 'application' END || ' shown at the start of the recording.' END AS text,
        CASE WHEN domain IS NOT NULL OR title IS NOT NULL THEN 'observed' ELSE 'assumed' END AS grounding, (CASE WHEN domain IS NOT NULL THEN 0.85 WHEN title IS NOT NULL THEN 0.7 ELSE 0.5 END)::DOUBLE AS confidence,
        CASE WHEN domain IS NOT NULL OR title IS NOT NULL THEN '' ELSE 'the app name and URL were not readable on the first screen' END AS uncertainty_note,
        j.job_id || '-' || j.turn AS frame_id, j.turn * 1500 AS t_end_ms
      FROM j LEFT JOIN pick ON pick.job_id = j.job_id""",
    "preconditions": f"""WITH {BLOCKS} {label_sql('bl', 'lb', 150)} {EARLY}, c AS (SELECT br.job_id, arg_min(lb.label, br.block_no) AS label, arg_min(br.confidence, br.block_no) AS confidence FROM br JOIN early USING (job_id, frame_id) JOIN lb ON lb.key = br.key AND lb.label <> ''
        WHERE br.role IN ('url_bar', 'title_bar') AND br.confidence > 0.4 GROUP BY 1), j AS (SELECT DISTINCT conv_id AS job_id FROM conversations)
      SELECT j.job_id, CASE WHEN label IS NULL THEN 'Start on the screen visible at the beginning of the recording; prior setup steps are unknown.' ELSE 'Start on "' || label || '" (visible when the recording begins; any prior setup is unknown).' END AS text,
        CASE WHEN label IS NULL THEN 'assumed' ELSE 'observed' END AS grounding, (CASE WHEN label IS NULL THEN 0.4 ELSE round(confidence, 2) END)::DOUBLE AS confidence FROM j LEFT JOIN c ON c.job_id = j.job_id""",
}
