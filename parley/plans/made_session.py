"""A session as text, made from the events table, and what the engine must find in it, in SQL.

Views and sign-ups are rows of the rooms' reports, other events are messages of their chats; every third person shares a name
with others of the room, every eleventh writes under a name that no report has, every thirteenth registered and never came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from . import session

#: What a person says (by user_id), whether it is relevant, and the category that follows if there are messages
#: (a moderate interest where three messages of several lines have several words).
SAYINGS = ["i have paid for the program", "payment link not working", "what is the price", "no audio", "this is a scam", "prompts?", "yes", "i am a school teacher"]
RELEVANT = [0, 1, 2, 3, 4, 5, 7]
CATEGORIES = ["purchase intent high", "purchase intent high", "strong interest", "no clear intent", "negative engagement", "information seeking", "no clear intent", "moderate interest"]
#: Minutes of the session by its reports; the chats span less than half of them.
DURATION = 100_000
BANKS = scoring.Banks({
    "phrase_banks": {"payment": ["\\bpay(?:ment)?\\b", "\\bpaid\\b"], "work": ["\\bteacher\\b", "\\bengineer\\b"], "pos": ["\\bgreat\\b"]},
    "negativity_patterns": ["\\bscam\\b"], "noise_exact": ["ok", "yes"], "buying_categories": ["payment"],
    "dimensions": {"D1_buying": {"max": 20, "weights": {"payment": 6}}, "D3_urgency": {"max": 5, "weights": {}}, "D4_fit": {"max": 10, "weights": {"work": 5}}, "D5_doubt": {"max": 5, "weights": {}}, "D7_ready": {"max": 5, "weights": {"payment": 5}}},
})
HEADER = "Attended,User Name (Original Name),First Name,Last Name,Email,Phone,Registration Time,Approval Status,Join Time,Leave Time,Time in Session (minutes),Is Guest,Country/Region Name"
OWN_NAME = "CASE WHEN user_id % 3 = 0 THEN 'Name ' || CAST(user_id % 35 AS STRING) ELSE 'User ' || CAST(user_id AS STRING) END"
NAME = f"CASE WHEN user_id % 11 = 5 THEN 'Ghost ' || CAST(user_id AS STRING) ELSE {OWN_NAME} END"
_CASE = lambda key, values: f"CASE {key} % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
SAYING = _CASE("user_id", SAYINGS)
#: In the session people of one name say the same.
WHO = "CASE WHEN user_id % 3 = 0 THEN user_id % 35 ELSE user_id END"
STAMP = "MM/dd/yyyy hh:mm:ss a"


def texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The lines of the reports and of the chats: room, file_ord, line_no, line."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "user_id", "concat('Room ', user_id % 7) AS room", "event_type IN ('view', 'signup') AS present", f"{OWN_NAME} AS own_name", f"{NAME} AS name", f"{_CASE(f'({WHO})', SAYINGS)} AS saying",
        "date_trunc('SECOND', ts) AS ts", "date_trunc('SECOND', ts) + make_dt_interval(0, 0, 0, CAST(floor(value * 60) AS INT)) AS until",
    )
    came = F.col("user_id") % 13 != 4
    stamp = lambda c: F.when(came, F.concat(F.lit('"'), F.date_format(c, STAMP), F.lit('"'))).otherwise("--")
    mail = F.concat(F.lit("p"), F.col("user_id").cast("string"), F.lit("@mail.example"))
    phone = F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("9845"), (344_750 + F.col("user_id")).cast("string")))
    row = F.concat_ws(",", F.when(came, "Yes").otherwise("No"), F.concat(F.lit('"'), "own_name", F.lit('"')), F.lit("F"), F.lit("L"), mail, phone, F.lit(""), F.lit("approved"), stamp("ts"), stamp("until"), F.lit("0"), F.lit("No"), F.lit("India"))
    rows = events.filter("present").select("room", F.lit(1).alias("file_ord"), (F.col("event_id") + 10).alias("line_no"), row.alias("line"))
    start = events.filter("NOT present").groupBy("room").agg(F.date_format(F.min("ts"), "MM/dd/yyyy").alias("day"))
    head = ["Attendee Report", "Topic,Webinar ID,Actual Start Time,Actual Duration (minutes),# Registrants", None, "Host Details", "Attended,User Name (Original Name),Email,Join Time", 'Yes,Host,host@mail.example,"01/01/2020 01:00:00 AM"', "Attendee Details", HEADER]
    meta = F.concat(F.lit('T,1,"'), "day", F.lit(f' 12:00:00 AM",{DURATION},3'))
    top = start.select("room", F.lit(1).alias("file_ord"), F.posexplode(F.array(*(meta if x is None else F.lit(x) for x in head))).alias("k", "line")).select("room", "file_ord", F.col("k").cast("long").alias("line_no"), "line")

    opens = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" From "), "name", F.lit(" to Everyone:"))
    said = F.concat(F.lit("\t"), "saying")
    body = F.concat(F.array(opens, F.lit('\tReplying to "x"')), F.array_repeat(said, (1 + F.col("event_id") % 3).cast("int")))
    talk = events.filter("NOT present").select("room", F.lit(1).alias("file_ord"), "event_id", F.posexplode(body).alias("k", "line")).select("room", "file_ord", (F.col("event_id") * 8 + F.col("k")).alias("line_no"), "line")
    return top.unionByName(rows), talk


_MADE: dict[tuple[str, str], session.Session] = {}


def made(spark: SparkSession, sf_dir: str) -> session.Session:
    """The session, with its tables written once for an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MADE:
        _MADE[key] = session.Session.of_lines(*texts(spark, sf_dir), BANKS, session.Options(program="mastery"))
    return _MADE[key]


#: The same session on the table itself: seg, chat and att as they must be attributed, people and what they said.
FACTS = f"""ev AS (SELECT event_id, user_id, 'Room ' || (user_id % 7) AS room, event_type IN ('view', 'signup') AS present, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(value * 60) AS BIGINT) AS d, user_id % 13 <> 4 AS came,
    lower({OWN_NAME}) AS own_norm, lower({NAME}) AS norm, {OWN_NAME} AS own_name, {_CASE(f'({WHO})', SAYINGS)} AS saying, ({WHO}) % 8 IN ({", ".join(map(str, RELEVANT))}) AS rel FROM events),
seg AS (SELECT user_id, room, own_norm AS norm, t AS j, t + d AS l, event_id FROM ev WHERE present AND came),
chat AS (SELECT event_id AS block_id, user_id, room, norm, t, 1 + event_id % 3 AS n_lines, saying, rel FROM ev WHERE NOT present),
c AS (SELECT room, norm, user_id, count(*) OVER (PARTITION BY room, norm) AS n FROM (SELECT DISTINCT room, norm, user_id FROM seg)),
nm AS (SELECT room, norm, max(n) AS n, min(user_id) AS only_one FROM c GROUP BY room, norm),
lv AS (SELECT b.block_id, count(DISTINCT s.user_id) AS k, min(s.user_id) AS one FROM chat b JOIN seg s ON b.room = s.room AND b.norm = s.norm AND b.t BETWEEN s.j - 90 AND s.l + 90 GROUP BY b.block_id),
att AS (SELECT b.*, nm.n AS cands, CASE WHEN nm.n IS NULL THEN 'no_row' WHEN nm.n = 1 THEN 'unique' WHEN lv.k = 1 THEN 'window' ELSE 'ambiguous' END AS how,
    CASE WHEN nm.n = 1 THEN only_one WHEN nm.n > 1 AND lv.k = 1 THEN one END AS who FROM chat b LEFT JOIN nm USING (room, norm) LEFT JOIN lv USING (block_id)),
mx AS (SELECT *, max(l) OVER (PARTITION BY user_id ORDER BY j, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM seg),
tm AS (SELECT user_id, CAST(printf('%.1f', sum(greatest(l - greatest(j, coalesce(pe, j)), 0)) / 60.0::DOUBLE) AS DOUBLE) AS minutes FROM mx GROUP BY user_id),
pp AS (SELECT user_id, any_value(room) AS room, any_value(own_name) AS name, any_value(own_norm) AS norm, any_value(came) AS came, min(event_id) AS first, coalesce(any_value(minutes), 0.0) AS minutes FROM ev LEFT JOIN tm USING (user_id) WHERE present GROUP BY user_id),
win AS (SELECT room, norm, user_id FROM (SELECT *, row_number() OVER (PARTITION BY room, norm ORDER BY minutes DESC, first) AS k FROM pp WHERE came) WHERE k = 1),
talked AS (SELECT DISTINCT w.user_id FROM win w JOIN chat USING (room, norm)),
own AS (SELECT who AS user_id, block_id, n_lines, saying, rel FROM att WHERE who IS NOT NULL),
pool AS (SELECT c.user_id, att.block_id, att.n_lines, att.saying, att.cands FROM att JOIN c ON att.room = c.room AND att.norm = c.norm WHERE how = 'ambiguous'),
st AS (SELECT pp.*, EXISTS (SELECT 1 FROM own WHERE own.user_id = pp.user_id) AS has_lines, EXISTS (SELECT 1 FROM talked WHERE talked.user_id = pp.user_id) AS chatted, EXISTS (SELECT 1 FROM pool WHERE pool.user_id = pp.user_id) AS has_pool FROM pp),
cat AS (SELECT *, CASE WHEN NOT came THEN 'non attended' WHEN NOT has_lines AND NOT chatted THEN 'non chatted' WHEN NOT has_lines THEN 'no clear intent' ELSE cat_of END AS category FROM st
    LEFT JOIN (SELECT user_id AS u2, CASE WHEN any_value(saying) IN ('prompts?', 'yes') AND count(*) FILTER (n_lines > 1) >= 3 THEN 'moderate interest' ELSE any_value(c2) END AS cat_of
      FROM (SELECT who AS user_id, saying, n_lines, CASE saying {" ".join(f"WHEN '{m}' THEN '{c}'" for m, c in zip(SAYINGS, CATEGORIES))} END AS c2 FROM att WHERE who IS NOT NULL) GROUP BY user_id) ON u2 = st.user_id)"""

RESULTS = f"""WITH {FACTS},
said AS (SELECT user_id, block_id, u.k, saying, rel FROM own JOIN (VALUES (1), (2), (3)) u(k) ON u.k <= n_lines
    UNION ALL SELECT user_id, block_id, k, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY block_id, k) = 1 THEN 'unattributed -- one of ' || cands || ' same-name registrants in this room] ' || saying ELSE saying END,
      CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY block_id, k) = 1 THEN true ELSE saying <> 'yes' END FROM pool JOIN (VALUES (1), (2), (3)) u(k) ON u.k <= n_lines WHERE user_id IN (SELECT user_id FROM st WHERE chatted AND NOT has_lines)),
kinds AS (SELECT user_id, saying, any_value(rel) AS rel, min(block_id * 4 + k) AS pos FROM said GROUP BY user_id, saying),
cells AS (SELECT user_id, coalesce(string_agg(saying, ' | ' ORDER BY pos) FILTER (rel), '') AS relevant, coalesce(string_agg(saying, ' | ' ORDER BY pos) FILTER (NOT rel), '') AS deleted FROM kinds GROUP BY user_id),
nl AS (SELECT user_id, CAST(sum(n_lines) AS INTEGER) AS msg_count FROM own GROUP BY user_id)
SELECT 'p' || cat.user_id || '@mail.example' AS email, name, CASE WHEN cat.user_id % 5 = 0 THEN '' ELSE '+91' END AS cc, CASE WHEN cat.user_id % 5 = 0 THEN '' ELSE '9845' || (344750 + cat.user_id) END AS phone, category,
  coalesce(relevant, '') AS relevant, coalesce(deleted, '') AS deleted, CASE WHEN has_lines OR (chatted AND has_pool) THEN 'Yes' ELSE 'No' END AS chatted, room, CASE WHEN came THEN 'Yes' ELSE 'No' END AS attended, minutes, coalesce(msg_count, 0) AS msg_count
FROM cat LEFT JOIN cells USING (user_id) LEFT JOIN nl USING (user_id)"""


def engagement_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve columns for each person, from the text of reports and chats."""
    columns = ["email", "name", "cc", "phone", "category", "relevant", "deleted", "chatted", "room", "attended", "minutes", "msg_count"]
    return made(spark, sf_dir).deliver().select(*columns)


COUNTERS = f"""WITH {FACTS}, s AS (SELECT room, norm, bool_or(how = 'unique') AS u, bool_or(how = 'window') AS w, bool_or(how = 'ambiguous') AS a, bool_or(how = 'no_row') AS x FROM att GROUP BY room, norm),
m AS (SELECT CAST(coalesce(sum(n_lines) FILTER (how = 'unique'), 0) AS BIGINT) AS msg_unique, CAST(coalesce(sum(n_lines) FILTER (how = 'window'), 0) AS BIGINT) AS msg_time_resolved, CAST(coalesce(sum(n_lines) FILTER (how = 'ambiguous'), 0) AS BIGINT) AS msg_still_ambiguous, CAST(coalesce(sum(n_lines) FILTER (how = 'no_row'), 0) AS BIGINT) AS msg_no_csv_row FROM att)
SELECT m.*, (SELECT count(*) FROM s WHERE u) AS sender_unique, (SELECT count(*) FROM s WHERE w) AS sender_time_resolved, (SELECT count(*) FROM s WHERE a AND NOT w) AS sender_unresolved, (SELECT count(*) FROM s WHERE x) AS sender_no_csv_row,
  CAST(0 AS BIGINT) AS host_blocks, CAST(0 AS BIGINT) AS phones_dropped_shared, CAST(0 AS BIGINT) AS msg_key_not_in_people, CAST(0 AS BIGINT) AS phone_fallback_rows, msg_unique + msg_time_resolved AS msgs_attributed, msg_still_ambiguous + msg_no_csv_row AS msgs_dropped,
  round(100.0::DOUBLE * (msg_still_ambiguous + msg_no_csv_row) / greatest(1, msg_unique + msg_time_resolved + msg_still_ambiguous + msg_no_csv_row), 2) AS msgs_dropped_pct FROM m"""


def session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir).counters


ROOMS = f"""WITH {FACTS}, p AS (SELECT room, count(*) AS people, count(*) FILTER (came) AS attended FROM pp GROUP BY room), b AS (SELECT room, count(*) AS chat_blocks, max(t) - min(t) AS span FROM chat GROUP BY room)
SELECT room, coalesce(people, 0) AS people, coalesce(attended, 0) AS attended, chat_blocks, CAST(printf('%.0f', span / 60.0::DOUBLE) AS BIGINT) AS chat_span_min, {DURATION}.0::DOUBLE AS duration_min, CAST(0 AS BIGINT) AS nul_rows, true AS has_phone_col, false AS lost FROM b LEFT JOIN p USING (room)"""


def session_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir).room_stats


WARNINGS = f"""WITH {FACTS}, b AS (SELECT room, max(t) - min(t) AS span FROM chat GROUP BY room)
SELECT room, 'truncated' AS code, 'the chat spans only ' || CAST(printf('%.0f', span / 60.0::DOUBLE) AS BIGINT) || ' of about {DURATION} minutes: the export is cut off, people will falsely read as silent' AS message FROM b WHERE CAST(printf('%.0f', span / 60.0::DOUBLE) AS BIGINT) < 0.5 * {DURATION}"""


def session_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir).warnings


REPORT = f"""WITH {FACTS}, g AS (SELECT category, count(*) AS n FROM cat GROUP BY category)
SELECT '  ' || category AS label, CAST(n AS VARCHAR) AS value FROM g UNION ALL SELECT 'Rows (unique people across all rooms)', CAST(count(*) AS VARCHAR) FROM cat
UNION ALL SELECT 'Chat-clean audit (must be 0/0/0)', 'bad_chars=0 repeats=0 vocab_leaks=0'"""


def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's lines on rows, categories and audit."""
    return made(spark, sf_dir).report.filter("ord < '30' AND ord > '00' OR ord = '50'").select("label", "value")


QUERIES = {f.__name__: f for f in (engagement_results, session_counters, session_rooms, session_warnings, session_report)}
ORACLE = {"engagement_results": RESULTS, "session_counters": COUNTERS, "session_rooms": ROOMS, "session_warnings": WARNINGS, "session_report": REPORT}
