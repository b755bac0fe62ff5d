"""Queries that run the engine's operators on a session made from the events and customers tables, and the same in SQL.

The session is a template: views and sign-ups are presence segments, other events are chat messages; every third user shares
its name with others of its room.  The SQL beside each query states the expected result on the tables directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contact, text
from ..operators import attribution, categorize, chatlog, checks, cleaner, people, roster, scoring, signals
from ..sources import session as sources
from . import made_session

SPARK_SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
DUCK_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
NAME = "CASE WHEN user_id % 11 = 5 AND event_type NOT IN ('view', 'signup') THEN 'ghost ' || CAST(user_id AS STRING) WHEN user_id % 3 = 0 THEN 'name ' || CAST(user_id % 35 AS STRING) ELSE 'user ' || CAST(user_id AS STRING) END"
ROOM = "'Room ' || CAST(user_id % 7 AS STRING)"
KEY = "'p' || CAST(user_id AS STRING) || '@mail.example'"
SEGMENTS = f"SELECT event_id, user_id, {ROOM} AS room, {KEY} AS key_email, {NAME} AS norm, {{seconds}} AS j, {{seconds}} + CAST(floor(value * 60) AS BIGINT) AS l FROM events WHERE event_type IN ('view', 'signup')"
CHAT = f"SELECT event_id AS block_id, user_id, {ROOM} AS room, {NAME} AS norm, {{seconds}} AS t, 1 + event_id % 3 AS n_lines FROM events WHERE event_type NOT IN ('view', 'signup')"
RECORDS = f"SELECT {ROOM} AS room, {KEY} AS key_email, {NAME} AS norm, 'alias ' || CAST(user_id % 50 AS STRING) AS alias, user_id AS rec_ord, 'r' || CAST(user_id AS STRING) AS rec_key, CAST(floor(sum(value)) AS BIGINT) AS minutes, user_id % 13 <> 4 AS attended_flag, CASE WHEN user_id % 5 = 0 THEN '' ELSE '98' || CAST(10000000 + user_id % 61 AS STRING) END AS phone FROM events WHERE event_type IN ('view', 'signup') GROUP BY user_id, event_type = 'x'"
RECORDS = RECORDS.replace(", event_type = 'x'", "").replace(NAME, "CASE WHEN user_id % 3 = 0 THEN 'name ' || CAST(user_id % 35 AS STRING) ELSE 'user ' || CAST(user_id AS STRING) END")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, template: str, source: str = "events") -> DataFrame:
    body = template.replace("{seconds}", SPARK_SECONDS).replace(f"FROM {source}", f"FROM {{{source}}}")
    return spark.sql(body, **{source: table(spark, sf_dir, source)})


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SEGMENTS)


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CHAT)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, RECORDS)


SEG = "seg AS (" + SEGMENTS.replace("{seconds}", DUCK_SECONDS) + ")"
TALK = "chat AS (" + CHAT.replace("{seconds}", DUCK_SECONDS) + ")"
REC = "rec AS (" + RECORDS + ")"
QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query(
    "interval_union",
    f"""WITH {SEG}, m AS (SELECT *, max(l) OVER (PARTITION BY room, key_email ORDER BY j, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM seg WHERE l >= j),
    i AS (SELECT *, sum(CASE WHEN e IS NULL OR j > e THEN 1 ELSE 0 END) OVER (PARTITION BY room, key_email ORDER BY j, l ROWS UNBOUNDED PRECEDING) AS k FROM m),
    g AS (SELECT room, key_email, k, max(l) - min(j) AS d FROM i GROUP BY ALL)
    SELECT room, key_email, count(*) AS islands, CAST(sum(d) AS BIGINT) AS covered FROM g GROUP BY room, key_email""",
)
def interval_union(spark, sf_dir):
    return roster.interval_union(segments(spark, sf_dir), ["room", "key_email"], "j", "l")


@query(
    "richer_record",
    f"WITH {SEG} SELECT room, key_email, event_id, l - j AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY room, key_email ORDER BY l - j DESC, event_id) AS k FROM seg) WHERE k = 1",
)
def richer_record(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumn("seconds", F.col("l") - F.col("j"))
    return roster.richer(rows, ["room", "key_email"], "seconds", "event_id").select("room", "key_email", "event_id", "seconds")


CANDS = "c AS (SELECT room, norm, key_email, count(*) OVER (PARTITION BY room, norm) AS n FROM (SELECT DISTINCT room, norm, key_email FROM seg))"
ATTR = f"""{SEG}, {TALK}, {CANDS}, nm AS (SELECT room, norm, max(n) AS n, min(key_email) AS only_key FROM c GROUP BY room, norm),
lv AS (SELECT b.block_id, count(DISTINCT s.key_email) AS k, min(s.key_email) AS one FROM chat b JOIN seg s ON b.room = s.room AND b.norm = s.norm AND b.t BETWEEN s.j - 90 AND s.l + 90 GROUP BY b.block_id),
att AS (SELECT b.*, CASE WHEN nm.n IS NULL THEN 'no_row' WHEN nm.n = 1 THEN 'unique' WHEN lv.k = 1 THEN 'window' ELSE 'ambiguous' END AS how,
  CASE WHEN nm.n = 1 THEN only_key WHEN nm.n > 1 AND lv.k = 1 THEN one END AS key_email FROM chat b LEFT JOIN nm USING (room, norm) LEFT JOIN lv USING (block_id))"""


@query("window_attr", f"WITH {ATTR} SELECT room, norm, block_id, how, key_email FROM att")
def window_attr(spark, sf_dir):
    return attribution.attributed(chat(spark, sf_dir), segments(spark, sf_dir)).select("room", "norm", "block_id", "how", "key_email")


@query(
    "attribution_stats",
    f"""WITH {ATTR}, s AS (SELECT room, norm, bool_or(how = 'unique') AS u, bool_or(how = 'window') AS w, bool_or(how = 'ambiguous') AS a, bool_or(how = 'no_row') AS x,
      sum(n_lines) FILTER (how = 'unique') AS lu, sum(n_lines) FILTER (how = 'window') AS lw, sum(n_lines) FILTER (how = 'ambiguous') AS la, sum(n_lines) FILTER (how = 'no_row') AS lx FROM att GROUP BY room, norm)
    SELECT room, CAST(coalesce(sum(lu), 0) AS BIGINT) AS msg_unique, CAST(coalesce(sum(lw), 0) AS BIGINT) AS msg_time_resolved, CAST(coalesce(sum(la), 0) AS BIGINT) AS msg_still_ambiguous, CAST(coalesce(sum(lx), 0) AS BIGINT) AS msg_no_csv_row,
      count(*) FILTER (u) AS sender_unique, count(*) FILTER (w) AS sender_time_resolved, count(*) FILTER (a AND NOT w) AS sender_unresolved, count(*) FILTER (x) AS sender_no_csv_row FROM s GROUP BY room""",
)
def attribution_stats(spark, sf_dir):
    said = attribution.without_hosts(chat(spark, sf_dir), raw="norm")
    return attribution.stats(attribution.attributed(said, segments(spark, sf_dir)))


@query("unmatched_senders", f"WITH {SEG}, {TALK} SELECT room, norm, count(*) AS n_blocks FROM chat b WHERE NOT EXISTS (SELECT 1 FROM seg s WHERE s.room = b.room AND s.norm = b.norm) GROUP BY room, norm")
def unmatched_senders(spark, sf_dir):
    return attribution.unmatched_senders(attribution.attributed(chat(spark, sf_dir), segments(spark, sf_dir)))


@query(
    "unattributed_pool",
    f"WITH {ATTR} SELECT c.room, c.key_email, CAST(sum(att.n_lines) AS BIGINT) AS n_lines, max(c.n) AS n_candidates FROM att JOIN c ON att.room = c.room AND att.norm = c.norm WHERE how = 'ambiguous' GROUP BY c.room, c.key_email",
)
def unattributed_pool(spark, sf_dir):
    own = segments(spark, sf_dir)
    return attribution.unattributed_pool(attribution.attributed(chat(spark, sf_dir), own), own)


@query(
    "unattributed_lines",
    f"""WITH {ATTR}, f AS (SELECT room, norm, min(block_id) AS first FROM chat GROUP BY room, norm) SELECT c.room, c.key_email, string_agg('m' || att.block_id || '.' || u.k, ' / ' ORDER BY f.first, att.block_id, u.k) AS lines, CAST(max(c.n) AS BIGINT) AS n_candidates
    FROM att JOIN c ON att.room = c.room AND att.norm = c.norm JOIN f ON att.room = f.room AND att.norm = f.norm JOIN (VALUES (1), (2), (3)) u(k) ON u.k <= att.n_lines WHERE how = 'ambiguous' GROUP BY c.room, c.key_email""",
)
def unattributed_lines(spark, sf_dir):
    """The messages that ``unattributed_pool`` counts."""
    own = segments(spark, sf_dir)
    said = attribution.without_hosts(chat(spark, sf_dir), raw="norm").withColumn("lines", F.expr("transform(sequence(1, int(n_lines)), k -> 'm' || block_id || '.' || k)"))
    rows = attribution.unattributed_lines(attribution.attributed(said, own), own)
    return rows.withColumn("lines", F.array_join("lines", " / "))


@query(
    "name_winner",
    f"""WITH {REC}, u AS (SELECT room, norm, 1 AS own, minutes, rec_ord, rec_key FROM rec WHERE attended_flag UNION ALL SELECT room, alias, 0, minutes, rec_ord, rec_key FROM rec WHERE attended_flag)
    SELECT room, norm, rec_key FROM (SELECT *, row_number() OVER (PARTITION BY room, norm ORDER BY own DESC, minutes DESC, rec_ord) AS k FROM u) WHERE k = 1""",
)
def name_winner(spark, sf_dir):
    return attribution.winners(records(spark, sf_dir))


@query(
    "phone_fallback",
    f"""WITH {REC}, {TALK}, rcv AS (SELECT DISTINCT r.room, r.key_email, r.phone FROM rec r JOIN chat ON chat.user_id = r.rec_ord WHERE phone <> '' AND chat.user_id % 2 = 0),
    o AS (SELECT room, phone, min(key_email) AS owner FROM rcv GROUP BY room, phone HAVING count(DISTINCT key_email) = 1),
    w AS (SELECT phone, min(owner) AS owner FROM o GROUP BY phone HAVING count(DISTINCT owner) = 1), h AS (SELECT DISTINCT r.key_email AS gk FROM rec r JOIN chat ON chat.user_id = r.rec_ord WHERE chat.user_id % 2 = 0)
    SELECT r.key_email AS gk, w.owner AS borrowed_from FROM rec r JOIN w USING (phone) WHERE r.attended_flag AND r.phone <> '' AND r.key_email NOT IN (SELECT gk FROM h) AND w.owner <> r.key_email AND w.owner IN (SELECT gk FROM h)""",
)
def phone_fallback(spark, sf_dir):
    own = records(spark, sf_dir)
    talked = chat(spark, sf_dir).filter("user_id % 2 = 0").select(F.col("user_id").alias("rec_ord")).distinct()
    receivers = own.join(talked, "rec_ord", "left_semi").select("room", "key_email")
    owners = attribution.phone_owners(own.select("room", "key_email", "phone"), receivers)
    persons = own.select(F.col("key_email").alias("gk"), F.col("attended_flag").alias("attended"), "phone")
    return attribution.phone_fallback(persons, owners, receivers.select(F.col("key_email").alias("gk")))


@query(
    "presence_windows",
    f"""WITH {SEG}, st AS (SELECT room, min(j) AS s FROM seg GROUP BY room)
    SELECT seg.room, key_email, bool_or(j <= s + 86400 + 600 AND l >= s + 86400) AS pricing FROM seg JOIN st USING (room) GROUP BY seg.room, key_email""",
)
def presence_windows(spark, sf_dir):
    own = segments(spark, sf_dir)
    start = own.groupBy("room").agg(F.min("j").alias("s"))
    each = own.groupBy("room", "key_email").agg(F.collect_list(F.struct("j", "l")).alias("segments")).join(start, "room")
    return each.select("room", "key_email", people.present_in(F.col("segments"), F.col("s") + 86400, F.col("s") + 86400 + 600).alias("pricing"))


FOLD = f"SELECT room, key_email AS gk, CASE WHEN event_id % 4 = 0 THEN '' ELSE norm || ' ' || CAST(event_id % 9 AS STRING) END AS name, key_email AS email, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'ph' || CAST(event_id % 5 AS STRING) END AS phone, '' AS country, event_id % 10 = 1 AS attended, l - j AS minutes, event_id AS rec_ord, CAST(NULL AS BOOLEAN) AS pricing FROM seg"


@query(
    "person_fold",
    f"""WITH {SEG}, r AS ({FOLD}), o AS (SELECT *, row_number() OVER w AS k, coalesce(sum(minutes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      coalesce(max(CASE WHEN name <> '' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS named FROM r WINDOW w AS (PARTITION BY gk ORDER BY room, rec_ord))
    SELECT gk, coalesce(arg_max(name, k) FILTER (name <> '' AND (minutes >= before OR named = 0)), '') AS name, coalesce(arg_min(phone, k) FILTER (phone <> ''), '') AS phone, bool_or(attended) AS attended, CAST(sum(minutes) AS BIGINT) AS minutes,
      string_agg(room, ' | ' ORDER BY minutes DESC, k) AS rooms FROM o GROUP BY gk""",
)
def person_fold(spark, sf_dir):
    rows = spark.sql(FOLD.replace("FROM seg", "FROM {seg}"), seg=segments(spark, sf_dir))
    return people.fold(rows).select("gk", "name", "phone", "attended", "minutes", "rooms")


LINES = "SELECT 'f' || CAST(user_id % 20 AS STRING) AS file, event_id, {clock} AS clock, 'User ' || CAST(user_id AS STRING) AS sender, event_id % 6 AS kind FROM events"
SPARK_CLOCK, DUCK_CLOCK = "date_format(ts, 'HH:mm:ss')", "strftime(ts, '%H:%M:%S')"


@query(
    "chat_blocks",
    f"""WITH e AS ({LINES.replace("{clock}", DUCK_CLOCK)}), b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id) AS block_id, CAST(substr(clock, 1, 2) AS INTEGER) * 3600 + CAST(substr(clock, 4, 2) AS INTEGER) * 60 + CAST(substr(clock, 7, 2) AS INTEGER) AS c FROM e),
    d AS (SELECT *, CASE WHEN c < lag(c) OVER (PARTITION BY file ORDER BY block_id) - 43200 THEN 1 ELSE 0 END AS back FROM b),
    s AS (SELECT *, c + 86400 * sum(back) OVER (PARTITION BY file ORDER BY block_id ROWS UNBOUNDED PRECEDING) AS sec FROM d)
    SELECT file, CAST(block_id AS BIGINT) AS block_id, sender, clock AS ts, CAST(sec AS INTEGER) AS sec, CASE kind WHEN 1 THEN 'first line' ELSE 'first line / second ' || CAST(event_id AS STRING) END AS body FROM s WHERE kind <> 0""",
)
def chat_blocks(spark, sf_dir):
    rows = _sql(spark, sf_dir, LINES.replace("{clock}", SPARK_CLOCK))
    head = F.concat("clock", F.lit(" From "), "sender", F.lit(" to Everyone:"))
    quote, first, second = F.lit('\tReplying to "x"'), F.lit("\tfirst line"), F.concat(F.lit("\tsecond "), F.col("event_id").cast("string"))
    body = F.when(F.col("kind") == 0, F.array(head, quote)).when(F.col("kind") == 1, F.array(head, first, F.lit("\t "))).otherwise(F.array(head, first, second))
    lines = rows.select("file", "event_id", F.posexplode(body).alias("k", "line")).select("file", (F.col("event_id") * 4 + F.col("k")).alias("line_no"), "line")
    return chatlog.blocks(lines, ["file"]).select("file", "block_id", "sender", "ts", "sec", F.array_join("lines", " / ").alias("body"))


@query(
    "room_stats",
    f"WITH {TALK} SELECT room, count(*) AS chat_blocks, CAST(max(t) - min(t) AS BIGINT) AS span_s FROM chat GROUP BY room",
)
def room_stats(spark, sf_dir):
    return chatlog.spans(chat(spark, sf_dir).withColumnRenamed("t", "sec"), "room")


CUSTOMERS = """SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN 'Ab.c' || CAST(c_custkey AS STRING) || '@gmail.com' WHEN 1 THEN 'lead' || CAST(c_custkey AS STRING) || '+x@Gamil.con' WHEN 2 THEN 'abc@yahoo.com' WHEN 3 THEN ' buyer' || CAST(c_custkey AS STRING) || '@firm.co.in, '
WHEN 4 THEN 'u' || CAST(c_custkey AS STRING) || '@mailinator.com' WHEN 5 THEN 'nobody' WHEN 6 THEN 'v9' || CAST(177550000 + c_custkey AS STRING) || '@mail.example' ELSE 'a.b.c@gmail.com' END AS email,
CASE c_custkey % 7 WHEN 0 THEN '+91 98' || CAST(12345000 + c_custkey AS STRING) WHEN 1 THEN '919198' || CAST(23456000 + c_custkey AS STRING) WHEN 2 THEN '9.18149E+11' WHEN 3 THEN '0000000000' WHEN 4 THEN '97150' || CAST(1000000 + c_custkey AS STRING) WHEN 5 THEN '098' || CAST(34567000 + c_custkey AS STRING) ELSE CAST(1000000 + c_custkey AS STRING) || '.0' END AS phone,
CASE c_custkey % 3 WHEN 0 THEN 'India' WHEN 1 THEN 'United Arab Emirates' ELSE '' END AS country FROM customer"""


@query(
    "contact_keys",
    f"""WITH c AS ({CUSTOMERS}) SELECT k,
    CASE k % 8 WHEN 0 THEN 'ab.c' || k || '@gmail.com' WHEN 1 THEN 'lead' || k || '+x@gmail.com' WHEN 2 THEN 'abc@yahoo.com' WHEN 3 THEN 'buyer' || k || '@firm.co.in' WHEN 4 THEN 'u' || k || '@mailinator.com' WHEN 5 THEN '' WHEN 6 THEN email ELSE 'a.b.c@gmail.com' END AS canon,
    CASE k % 8 WHEN 0 THEN 'abc' || k || '@gmail.com' WHEN 1 THEN 'lead' || k || '@gmail.com' WHEN 3 THEN 'buyer' || k || '@firm.co.in' WHEN 6 THEN email ELSE '' END AS match_key,
    CASE WHEN k % 8 = 6 THEN '9' || (177550000 + k) END AS mobile,
    CASE k % 7 WHEN 0 THEN '98' || (12345000 + k) WHEN 1 THEN '98' || (23456000 + k) WHEN 4 THEN phone WHEN 5 THEN '98' || (34567000 + k) WHEN 6 THEN CAST(1000000 + k AS VARCHAR) ELSE '' END AS phone_key FROM c""",
)
def contact_keys(spark, sf_dir):
    rows = _sql(spark, sf_dir, CUSTOMERS, "customer")
    return rows.select("k", contact.canon_email(F.col("email")).alias("canon"), contact.key_email(F.col("email")).alias("match_key"), contact.phone_in_email(F.col("email")).alias("mobile"), contact.norm_phone(F.col("phone")).alias("phone_key"))


@query(
    "cc_split",
    f"""WITH c AS ({CUSTOMERS}), n AS (SELECT k, country, CASE k % 7 WHEN 0 THEN '+9198' || (12345000 + k) WHEN 1 THEN '98' || (23456000 + k) WHEN 4 THEN phone WHEN 5 THEN '98' || (34567000 + k) WHEN 6 THEN CAST(1000000 + k AS VARCHAR) ELSE '' END AS p FROM c)
    SELECT k, CASE WHEN p = '' THEN '' WHEN k % 7 = 0 THEN '+91' WHEN k % 7 = 6 THEN CASE k % 3 WHEN 0 THEN '+91' WHEN 1 THEN '+971' ELSE '' END WHEN k % 7 = 4 AND k % 3 = 1 THEN '+971' WHEN k % 7 = 4 THEN '+91' WHEN k % 3 = 1 THEN '+971' ELSE '+91' END AS cc,
    CASE WHEN k % 7 = 0 THEN substr(p, 4) WHEN k % 7 = 4 AND k % 3 = 1 THEN substr(p, 4) ELSE p END AS national FROM n""",
)
def cc_split(spark, sf_dir):
    rows = _sql(spark, sf_dir, CUSTOMERS, "customer")
    phone = F.when(F.col("k") % 7 == 0, F.regexp_replace("phone", " ", "")).otherwise(contact.norm_phone(F.col("phone")))
    split = rows.select("k", contact.cc_split(F.col("country"), phone).alias("s"))
    return split.select("k", "s.cc", "s.national")


REPORT = "SELECT user_id % 7 AS file, event_id, user_id, {j} AS joined, {l} AS left_at, event_type FROM events WHERE event_type IN ('view', 'signup')"


@query(
    "roster_merge",
    f"""WITH e AS (SELECT user_id % 7 AS file, user_id, event_id, {DUCK_SECONDS} AS j, event_type FROM events WHERE event_type IN ('view', 'signup')), s AS (SELECT *, j + 600 AS l FROM e WHERE event_type = 'view'),
    m AS (SELECT *, max(l) OVER (PARTITION BY file, user_id ORDER BY j, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM s),
    g AS (SELECT file, user_id, sum(l - greatest(j, coalesce(pe, j))) FILTER (l > coalesce(pe, j)) AS seconds, count(*) AS n FROM m GROUP BY file, user_id)
    SELECT e.file, 'u' || e.user_id || '@mail.example' AS rec_key, 'User ' || e.user_id AS name, bool_or(e.event_type = 'view') AS attended_flag, CAST(coalesce(any_value(g.seconds), 0) AS BIGINT) AS seconds_present, CAST(greatest(coalesce(any_value(g.n), 0) - 1, 0) AS INTEGER) AS reconnections
    FROM e LEFT JOIN g ON e.file = g.file AND e.user_id = g.user_id GROUP BY e.file, e.user_id""",
)
def roster_merge(spark, sf_dir):
    """Attendance reports as text: written from the events, then read by the sectioned parser."""
    rows = _sql(spark, sf_dir, REPORT.replace("{j}", "date_format(ts, 'MM/dd/yyyy hh:mm:ss a')").replace("{l}", "date_format(ts + INTERVAL 10 MINUTES, 'MM/dd/yyyy hh:mm:ss a')"))
    view = F.col("event_type") == "view"
    user = F.col("user_id").cast("string")
    cells = [F.when(view, "Yes").otherwise("No"), F.concat(F.lit('"User '), user, F.lit('"')), F.concat(F.lit("u"), user, F.lit("@mail.example"))]
    cells += [F.when(view, F.concat(F.lit('"'), c, F.lit('"'))).otherwise("--") for c in (F.col("joined"), F.col("left_at"))]
    line = F.concat_ws(",", *cells)
    head = ["Attendee Report", "Host Details,", "Attended,User Name (Original Name),Email,Join Time", 'Yes,Host,host@mail.example,"01/01/2020 01:00:00 AM"', "Attendee Details,", "Attended,User Name (Original Name),First Name,Email,Join Time,Leave Time"]
    body = rows.select("file", F.col("event_id").alias("line_no"), F.regexp_replace(line, '^([^,]*,"[^"]*"),', "$1,F,").alias("line"))
    files = rows.select("file").distinct()
    top = files.select("file", F.posexplode(F.array(*map(F.lit, head))).alias("k", "line")).select("file", (F.col("k") - 100).cast("long").alias("line_no"), "line")
    found = roster.records(roster.typed_rows(roster.attendee_rows(top.unionByName(body), ["file"])), ["file"])
    return found.select("file", "rec_key", "name", "attended_flag", "seconds_present", F.col("reconnections").cast("int").alias("reconnections"))


@query(
    "chat_file_containment",
    """WITH e AS (SELECT user_id % 5 AS room, event_id, event_id % 3 AS f FROM events), k AS (SELECT DISTINCT room, CASE WHEN f = 2 AND event_id % 7 = 0 THEN 'b' WHEN f = 2 THEN 'e' WHEN event_id % 2 = 0 THEN 'a' ELSE 'c' END AS file, event_id FROM e
      UNION SELECT room, 'd', event_id FROM e WHERE f <> 2 AND event_id % 2 = 0 AND event_id % 10 <> 0), n AS (SELECT room, file, count(*) AS n_keys FROM k GROUP BY ALL) SELECT room, file, n_keys, file <> 'd' AS kept FROM n""",
)
def chat_file_containment(spark, sf_dir):
    """Every event is in a file; d repeats most of a."""
    e = table(spark, sf_dir, "events").selectExpr("user_id % 5 AS room", "event_id", "event_id % 3 AS f")
    own = e.selectExpr("room", "CASE WHEN f = 2 AND event_id % 7 = 0 THEN 'b' WHEN f = 2 THEN 'e' WHEN event_id % 2 = 0 THEN 'a' ELSE 'c' END AS file", "event_id")
    copy = e.filter("f <> 2 AND event_id % 2 = 0 AND event_id % 10 <> 0").selectExpr("room", "'d' AS file", "event_id")
    blocks = own.unionByName(copy).selectExpr("room", "file", "CAST(event_id AS INT) AS sec", "'n' AS norm", "array('x') AS lines")
    return chatlog.drop_contained(blocks, "room", "file", "norm")


@query("payload_dedup", "SELECT source, md5, doc_id FROM (SELECT source, md5(coalesce(text, '')) AS md5, doc_id, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def payload_dedup(spark, sf_dir):
    """The first upload of each payload: hashes are grouped, payloads are not moved."""
    docs = table(spark, sf_dir, "documents")
    uploads = docs.select(F.col("doc_id").alias("upload_ord"), F.col("source").alias("path"), F.lit(0).alias("member_ord"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return sources.without_copies(uploads).select(F.col("path").alias("source"), F.md5("content").alias("md5"), F.col("upload_ord").alias("doc_id"))


RANKED = f"SELECT key_email AS email, norm AS name, minutes, rec_ord, CASE WHEN rec_ord % 4 = 0 THEN 'strong interest' WHEN rec_ord % 4 = 1 THEN 'non chatted' ELSE 'moderate' END AS category FROM rec"


@query("result_page", f"WITH {REC}, r AS ({RANKED}) SELECT email, name, minutes, category FROM r WHERE category = 'moderate' AND (contains(lower(name), 'er') OR contains(lower(email), 'er')) ORDER BY minutes DESC, lower(name), rec_ord LIMIT 25 OFFSET 10")
def result_page(spark, sf_dir):
    rows = spark.sql(RANKED.replace("FROM rec", "FROM {rec}"), rec=records(spark, sf_dir))
    return people.page(rows, [F.desc("minutes"), F.lower("name"), "rec_ord"], "moderate", "ER", 10, 25).select("email", "name", "minutes", "category")


@query("category_histogram", f"WITH {REC}, r AS ({RANKED}) SELECT category, count(*) AS n FROM r GROUP BY category")
def category_histogram(spark, sf_dir):
    return categorize.histogram(spark.sql(RANKED.replace("FROM rec", "FROM {rec}"), rec=records(spark, sf_dir)))


CHECKED = """e AS (SELECT event_id, user_id % 9 AS n, event_type IN ('view', 'signup') AS present, {clock} AS clock, {stamp} AS stamp FROM events)"""


@query(
    "preflight",
    f"""WITH {CHECKED.replace("{clock}", "date_trunc('second', ts)::TIME").replace("{stamp}", "''")},
    r AS (SELECT n, count(*) FILTER (present) AS rows, count(*) FILTER (present AND NOT (n = 3 AND event_id % 4 > 0)) AS yes, count(*) FILTER (present AND n = 4 AND event_id % 2 = 0) AS bad,
      (max(epoch(clock)) FILTER (NOT present) - min(epoch(clock)) FILTER (NOT present)) / 60.0 AS span, count(*) FILTER (NOT present) AS clocks FROM e GROUP BY n)
    SELECT 'Room ' || n AS room, CASE WHEN n IN (0, 1) THEN 0 ELSE yes END AS attended, concat_ws('; ', CASE WHEN n = 0 THEN 'no attendee report' WHEN n = 1 THEN 'attendee report has no rows' END, CASE WHEN n = 2 THEN '1 NUL byte(s) in the attendee report were repaired' END,
      CASE WHEN n > 1 AND rows - yes > 0.6 * rows THEN printf('%.0f', 100.0 * (rows - yes) / rows) || '% of rows did not attend' END, CASE WHEN n = 4 AND 100 * (yes - bad) < 75 * yes THEN 'only ' || printf('%.0f', 100.0 * (yes - bad) / yes) || '% of join times parse' END,
      CASE WHEN n = 5 THEN 'no chat export' WHEN n = 6 THEN 'chat has no times' WHEN span < 0.5 * (CASE WHEN n = 7 THEN 4000.0 WHEN n < 2 THEN 200.0 ELSE 400.0 END) THEN 'chat spans ' || printf('%.0f', span) || ' of about ' || (CASE WHEN n = 7 THEN 4000 WHEN n < 2 THEN 200 ELSE 400 END) || ' min' END) AS messages FROM r""",
)
def preflight(spark, sf_dir):
    """Rooms with one fault each, as text: no report, no rows, NUL bytes, absent people, times that don't parse, no chat, no times,
    a chat that ends early, none."""
    e = spark.sql("WITH " + CHECKED.replace("{clock}", "date_format(ts, 'HH:mm:ss')").replace("{stamp}", "date_format(ts, 'MM/dd/yyyy hh:mm:ss a')").replace("FROM events", "FROM {events}") + " SELECT * FROM e", events=table(spark, sf_dir, "events"))
    e = e.withColumn("room", F.concat(F.lit("Room "), F.col("n").cast("string")))
    yes = F.when((F.col("n") == 3) & (F.col("event_id") % 4 > 0), "No").otherwise("Yes")
    joined = F.when((F.col("n") == 4) & (F.col("event_id") % 2 == 0), "soon").otherwise(F.concat(F.lit('"'), "stamp", F.lit('"')))
    rows = e.filter("present AND n > 1").select("room", F.lit(1).alias("file_ord"), (F.col("event_id") + 10).alias("line_no"), F.concat_ws(",", yes, F.concat(F.lit("User "), F.col("event_id").cast("string")), F.lit("F"), F.lit("u@x.example"), joined).alias("line"))
    meta = F.concat(F.lit("T,1,,"), F.when(F.col("n") == 7, "4000").otherwise("400"))
    head = F.array(F.lit("Topic,Webinar ID,Actual Start Time,Actual Duration (minutes)"), meta, F.lit("Attended,User Name (Original Name),First Name,Email,Join Time"), F.when(F.col("n") == 2, "Maybe,\0").otherwise(""))
    head = F.when(F.col("n") == 1, F.slice(head, 3, 2)).otherwise(head)
    top = e.filter("n > 0").select("room", "n").distinct().select("room", F.lit(1).alias("file_ord"), F.posexplode(head).alias("k", "line")).select("room", "file_ord", F.col("k").cast("long").alias("line_no"), "line")
    opens = F.concat(F.when(F.col("n") == 6, "now").otherwise(F.col("clock")), F.lit(" From A to Everyone:"))
    chats = e.filter("NOT present AND n <> 5").select("room", F.lit(1).alias("file_ord"), F.col("event_id").alias("line_no"), opens.alias("line"))
    return checks.check_rooms(top.unionByName(rows), chats).select("room", "attended", F.array_join("messages", "; ").alias("messages"))


@query(
    "display_names",
    """SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'Mary-Jane O''Neil ' || c_custkey WHEN 1 THEN 'Élodie Brûlé' WHEN 2 THEN '王小明 ' || c_custkey WHEN 3 THEN 'User' || c_custkey || 'Xy' ELSE '' END AS name,
    CASE c_custkey % 5 WHEN 0 THEN 'mj' || c_custkey || '@firm.example' WHEN 1 THEN 'a.b+c@x.y.example' WHEN 2 THEN '' WHEN 3 THEN '' ELSE 'q' || c_custkey || '@sub.domain.example' END AS email,
    CASE c_custkey % 5 WHEN 0 THEN 'mary jane o neil ' || c_custkey WHEN 1 THEN 'élodie brûlé' WHEN 2 THEN '王小明 ' || c_custkey WHEN 3 THEN 'user' || c_custkey || 'xy' ELSE '' END AS norm FROM customer""",
)
def display_names(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    which = lambda *values: F.when(F.col("c_custkey") % 5 == 0, values[0]).when(F.col("c_custkey") % 5 == 1, values[1]).when(F.col("c_custkey") % 5 == 2, values[2]).when(F.col("c_custkey") % 5 == 3, values[3]).otherwise(values[4])
    name = which(F.concat(F.lit("2505445126_\u200bmary-JANE  o'neil "), k), F.lit(" ÉLODIE  brûlé\ufeff"), F.concat(F.lit("王小明  "), k), F.concat(F.lit("1234567_USER"), k, F.lit("xY")), F.lit("\u200b "))
    mail = which(F.concat(F.lit(" MJ"), k, F.lit("@Firm.example.; ")), F.lit("A.b+C@x. y.example,"), F.lit("no address"), F.lit("two@at@x"), F.concat(F.lit("q\u200b"), k, F.lit("@sub.domain.example")))
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), text.clean_display_name(name).alias("name"), text.clean_email(mail).alias("email"))
    return raw.withColumn("norm", text.norm_name(text.nfkc("name")))


@query(
    "timestamps",
    "SELECT event_id, CASE WHEN event_id % 13 > 10 THEN NULL WHEN event_id % 13 IN (1, 3, 5, 7, 9) THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS at FROM events",
)
def timestamps(spark, sf_dir):
    """Every format that timestamps come in, and what is none."""
    which = F.lit(None).cast("string")
    for k, f in enumerate(text.TIMESTAMP_FORMATS):
        which = F.when(F.col("event_id") % 13 == k, F.date_format("ts", f)).otherwise(which)
    raw = F.when(F.col("event_id") % 13 == 11, "--").when(F.col("event_id") % 13 == 12, "31/31/2024 25:00").otherwise(which)
    return table(spark, sf_dir, "events").select("event_id", text.parse_timestamp(F.concat(F.lit(' "'), raw, F.lit('"'))).alias("at"))


CLOCKS = "SELECT user_id, event_id, {clock} AS clock, {day} AS day, user_id % 3 = 0 OR (user_id % 3 = 2 AND event_id % 2 = 0) AS dated, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events"


@query(
    "chat_clocks",
    f"""WITH RECURSIVE e AS ({CLOCKS.replace("{clock}", "CAST(epoch(date_trunc('second', ts)::TIME) AS BIGINT)").replace("{day}", "CAST(ts AS DATE)")}), f AS (SELECT user_id, min(day) FILTER (dated) AS first FROM e GROUP BY user_id),
    w AS (SELECT e.user_id, e.k, 0 AS days, CASE WHEN dated THEN clock + 86400 * greatest(0, day - first) ELSE clock END AS sec FROM e JOIN f USING (user_id) WHERE k = 1
      UNION ALL SELECT e.user_id, e.k, CASE WHEN NOT dated AND clock + 86400 * w.days < w.sec - 43200 THEN w.days + 1 ELSE w.days END,
        CASE WHEN dated THEN clock + 86400 * greatest(0, day - first) WHEN clock + 86400 * w.days < w.sec - 43200 THEN clock + 86400 * (w.days + 1) ELSE clock + 86400 * w.days END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1 JOIN f ON f.user_id = e.user_id)
    SELECT user_id, k AS block_id, CAST(sec AS INTEGER) AS sec FROM w""",
)
def chat_clocks(spark, sf_dir):
    """Files that are dated throughout, not at all, and at every other header."""
    rows = _sql(spark, sf_dir, CLOCKS.replace("{clock}", "date_format(ts, 'HH:mm:ss')").replace("{day}", "date_format(ts, 'yyyy-MM-dd ')"))
    head = F.concat(F.when(F.col("dated"), F.col("day")).otherwise(""), "clock", F.lit(" From A to Everyone:"))
    lines = rows.select("user_id", F.posexplode(F.array(head, F.lit("\tx"))).alias("i", "line"), "k").select("user_id", (2 * F.col("k") + F.col("i")).alias("line_no"), "line")
    return chatlog.blocks(lines, ["user_id"]).select("user_id", "block_id", "sec")


SAYINGS = made_session.SAYINGS
SAID = made_session.SAYING
#: Scores by saying; two of the sayings are of one word, which is no meaningful message.
SCORES = {0: (6, 0, 5), 1: (6, 0, 5), 7: (0, 5, 0)}
_SCORE = lambda k: "CASE user_id % 8 " + " ".join(f"WHEN {i} THEN {v[k]}" for i, v in SCORES.items()) + " ELSE 0 END"


@query(
    "dimension_scores",
    f"""SELECT user_id, {_SCORE(0)} AS D1, {_SCORE(1)} AS D4, {_SCORE(2)} AS D7, count(*) FILTER (user_id % 8 NOT IN (5, 6) OR event_id % 10 = 9) AS mean, count(*) FILTER (user_id % 8 IN (0, 1) AND event_id % 10 < 9) AS intent, count(*) FILTER (user_id % 8 = 4) AS neg,
    count(*) FILTER (event_id % 10 = 9) AS pasted, count(*) FILTER (event_id % 10 = 9 AND user_id % 8 IN (0, 1)) AS pasted_blocked FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 10 < 9) > 0""",
)
def dimension_scores(spark, sf_dir):
    """Banks, dimensions, meaningful and negative messages; every tenth message was pasted and credits nothing."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"concat({SAID}, if(event_id % 10 = 9, ' 3 hrs ago', '')) AS m")
    rows = rows.join(rows.filter("event_id % 10 < 9").select("user_id").distinct(), "user_id", "left_semi")
    found = scoring.dimension_scores(rows, "user_id", "m", made_session.BANKS)
    return found.select("user_id", "D1", "D4", "D7", "mean", "intent", "neg", "pasted", "pasted_blocked")


@query(
    "engagement_category",
    f"""WITH p AS (SELECT user_id, CAST(count(*) FILTER (event_type NOT IN ('view', 'signup')) AS BIGINT) AS n, CAST(count(*) FILTER (event_type NOT IN ('view', 'signup') AND event_id % 3 > 0) AS BIGINT) AS several FROM events GROUP BY user_id)
    SELECT user_id, n AS n_msgs, CASE WHEN user_id % 10 = 3 THEN 'non attended' WHEN n = 0 THEN 'non chatted' ELSE CASE user_id % 8 {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(made_session.CATEGORIES))} END END AS category,
      CASE WHEN user_id % 10 = 3 THEN 'registered, never joined' WHEN user_id % 8 = 7 THEN 'use-case/profession fit (D4=5)' || CASE WHEN n > 2 THEN '; ' || n || ' meaningful msgs' ELSE '' END WHEN user_id % 8 = 6 THEN 'only greetings/generic chat, no substantive signal; watched 50% of session' END AS some_basis FROM p""",
)
def engagement_category(spark, sf_dir):
    """Signals and dimensions of everybody's messages, then the ladder of categories; the basis where it is short."""
    events = table(spark, sf_dir, "events")
    said = events.filter("event_type NOT IN ('view', 'signup')").selectExpr("user_id", f"{SAID} AS m")
    dims = scoring.dimension_scores(said, "user_id", "m", made_session.BANKS).drop("pos", "pasted", "pasted_blocked", "cat")
    persons = events.select("user_id").distinct().join(dims, "user_id", "left").join(signals.person_signals(said, "user_id", "m"), "user_id", "left")
    facts = {"attended": F.col("user_id") % 10 != 3, "chatted": F.col("n_msgs").isNotNull(), "pct": F.lit(50.0), "cta": F.lit(None).cast("boolean"), "pricing": F.lit(False), "orphan": F.lit(False), "no_text": F.lit(False)}
    rows = categorize.categorized(persons.withColumns(facts))
    told = F.when((F.col("user_id") % 10 == 3) | (F.col("user_id") % 8).isin(6, 7), F.col("basis"))
    return rows.select("user_id", F.coalesce("n_msgs", F.lit(0)).cast("long").alias("n_msgs"), "category", told.alias("some_basis"))


RAW = ["readyyyyyy", "Yes yes yes yes", "what is the fees??", "MB MB MB", "hello!!! hello!!!", "can you tell me the duration", "10x  10 X 10x"]
CLEAN = ["ready", "Yes", "what is the fees?", "MB", "hello!", "can you tell me the duration", "10x"]


@query(
    "cleaned_messages",
    "WITH r AS (SELECT user_id, event_id % 7 AS k, min(event_id) AS a, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT *, CASE k " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLEAN)) + " END AS m FROM r) "
    "SELECT user_id, coalesce(string_agg(m, ' | ' ORDER BY a) FILTER (k IN (2, 4, 5)), '') AS relevant, coalesce(string_agg(m, ' | ' ORDER BY a) FILTER (k NOT IN (2, 4, 5)), '') AS deleted, CAST(sum(n) AS BIGINT) AS raw, CAST(sum(n) - count(*) AS BIGINT) AS dup_removed FROM c GROUP BY user_id",
)
def cleaned_messages(spark, sf_dir):
    """Messages of each person cleaned, without duplicates, split into relevant and ignorable."""
    raw = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(RAW)) + " END AS m"
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", raw)
    out = cleaner.process_messages(rows, "user_id", "event_id", "m")
    return out.select("user_id", "relevant", "deleted", F.col("raw").cast("long").alias("raw"), F.col("dup_removed").cast("long").alias("dup_removed"))


NEAR = ["please tell me the duration of the course", "please tell me the duration of the courses", "please tell me the duratoin of the course", "what is the price"]
_NEAR = "CASE event_id % 4 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(NEAR)) + " END"


@query(
    "near_messages",
    f"""WITH r AS (SELECT user_id, event_id % 4 AS k, min(event_id) AS a, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT user_id, min(a) FILTER (k < 3) AS a, bool_or(k = 0) AND bool_or(k = 1) AS begins, arg_max(k, a) FILTER (k < 3) AS last, min(a) FILTER (k = 3) AS other, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY user_id)
    SELECT user_id, concat_ws(' | ', CASE WHEN other < a THEN '{NEAR[3]}' END, CASE WHEN begins THEN '{NEAR[1]}' WHEN last = 0 THEN '{NEAR[0]}' WHEN last = 1 THEN '{NEAR[1]}' WHEN last = 2 THEN '{NEAR[2]}' END, CASE WHEN other > a OR a IS NULL THEN '{NEAR[3]}' END) AS relevant,
      n - CASE WHEN a IS NULL THEN 0 ELSE 1 END - CASE WHEN other IS NULL THEN 0 ELSE 1 END AS dup_removed FROM u""",
)
def near_messages(spark, sf_dir):
    """Wordings of one message: the longer one where one begins the other, else the last one, at the place of the first."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"{_NEAR} AS m")
    out = cleaner.process_messages(rows, "user_id", "event_id", "m")
    return out.select("user_id", "relevant", F.col("dup_removed").cast("long").alias("dup_removed"))


@query(
    "audit",
    """WITH m AS (SELECT CASE event_id % 6 WHEN 0 THEN 'what is the price' WHEN 1 THEN 'from pune' WHEN 2 THEN 'Yes' WHEN 3 THEN 'price 😀 of it' WHEN 4 THEN 'go on go on' ELSE '12,5 %' END AS m, event_id % 6 AS k FROM events), g AS (SELECT k, m, count(*) AS n FROM m GROUP BY k, m)
    SELECT CASE k WHEN 3 THEN 'bad_chars' WHEN 4 THEN 'repeats' WHEN 1 THEN 'freq_suspects' ELSE 'vocab_leaks' END AS kind, CASE k WHEN 3 THEN '😀' WHEN 2 THEN 'yes' ELSE m END AS value, CAST(n AS BIGINT) AS n FROM g WHERE k > 0 AND (k <> 1 OR n >= 40)""",
)
def audit(spark, sf_dir):
    """Cells of relevant messages with what should not be in them."""
    said = "CASE event_id % 6 WHEN 0 THEN 'what is the price' WHEN 1 THEN 'from pune' WHEN 2 THEN 'Yes' WHEN 3 THEN 'price 😀 of it' WHEN 4 THEN 'go on go on' ELSE '12,5 %' END"
    cells = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.collect_list(F.expr(said)), " | ").alias("relevant"))
    return cleaner.audit(cells).select("kind", "value", "n")
