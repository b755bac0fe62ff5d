"""One session from the lines of its files to a row for each person, with counters, warnings, audit and report.

The stages are those of the operators: reports to records, chats to blocks, attribution within a room, persons over rooms,
dimensions and signals of what they said, category, relevant and removed messages.  Everything is declared; nothing is
collected but the gate's counts when a result is delivered.

Defined results: a room with chat alone is lost, with a warning; a report without rows adds nobody; blank and absent times are
no presence; rows without address, name and phone are nobody's; an empty session gives empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contact, text
from ..operators import attribution, categorize, chatlog, cleaner, people, roster, scoring, signals, sinks
from ..sources import session as sources
from ..tables import drop, materialize

MINUTES = 10
CELL_MOST = 32_000
WIDE = 1 << 32
#: Lines of a file that stay together when lines are dealt.
LINES = 10_000


class InvariantError(Exception):
    """The results contradict themselves."""


def offset(raw: str | float | None) -> float | None:
    """Minutes as they were typed into a form: a number from 0 to 1440, else nothing."""
    try:
        minutes = float(str(raw).strip())
    except ValueError:
        return None
    return minutes if 0 <= minutes <= 1440 else None


@dataclass(frozen=True)
class Options:
    """What a deployment or an upload sets: minutes of the pricing and closing windows (or pairs of them), names of hosts, a
    pattern of their names, the programme's own names, more words of no sense."""

    pricing: float | tuple[float, float] | None = None
    cta: float | tuple[float, float] | None = None
    hosts: tuple[str, ...] = chatlog.HOSTS
    program: str = signals.NEVER
    more_ignorable: tuple[str, ...] = ()


def _norm(raw: Column) -> Column:
    return text.norm_name(text.nfkc(raw))


class Session:
    """reports and chats: room, file_ord, line_no, line of the attendee reports and the saved chats."""

    def __init__(self, reports: DataFrame, chats: DataFrame, banks: scoring.Banks, options: Options = Options()):
        self.reports, self.chats, self.banks, self.options = reports, chats, banks, options
        self._tables: list[DataFrame] = []

    def _kept(self, table: DataFrame, tag: str) -> DataFrame:
        """What several stages read is written once."""
        self._tables.append(materialize(table, tag))
        return self._tables[-1]

    def close(self) -> None:
        """Deletes the tables between the stages; what was made of them can't be read after that."""
        drop(*self._tables)
        self._tables.clear()

    @classmethod
    def of_files(cls, files: DataFrame, banks: scoring.Banks, options: Options = Options()) -> Session:
        """From room, file_ord, role, text (see ``sources.session.rooms``)."""
        return cls._of_roles(roster.numbered_lines(files), banks, options)

    @classmethod
    def of_lines(cls, reports: DataFrame, chats: DataFrame, banks: scoring.Banks, options: Options = Options()) -> Session:
        """From room, file_ord, line_no, line of the reports and of the chats, which may cost much to make."""
        role = lambda rows, name: rows.select("room", "file_ord", F.lit(name).alias("role"), "line_no", "line")
        return cls._of_roles(role(reports, "attendee").unionByName(role(chats, "chat")), banks, options)

    @classmethod
    def _of_roles(cls, lines: DataFrame, banks: scoring.Banks, options: Options) -> Session:
        # Files are few and lines many: they are dealt anew, written once, and every later stage reads lines.
        lines = materialize(lines.repartition("room", "file_ord", "role", F.floor(F.col("line_no") / LINES)), "lines")
        own = lambda role: lines.filter(F.col("role") == role).select("room", "file_ord", "line_no", "line")
        session = cls(own("attendee"), own("chat"), banks, options)
        session._tables.append(lines)
        return session

    @classmethod
    def of_uploads(cls, uploads: DataFrame, banks: scoring.Banks, options: Options = Options()) -> Session:
        """From upload_ord, path, content of uploaded files: archives, compressed and plain ones."""
        members = sources.without_copies(sources.members(uploads))
        files = materialize(sources.rooms(sources.sorted_out(members)), "files")
        session = cls.of_files(files, banks, options)
        drop(files)
        return session

    # -- reports

    @cached_property
    def report_files(self) -> DataFrame:
        """room, file_ord, start, duration_min and the counts of parsing of each report."""
        file = ["room", "file_ord"]
        all_files = self.reports.select(*file).distinct()
        meta = roster.session_meta(self.reports, file).select(*file, "start", "duration_min")
        return all_files.join(meta, file, "left").join(roster.parse_counts(self.reports, file), file, "left")

    @cached_property
    def room_meta(self) -> DataFrame:
        """room, start, duration_min (of the first report that has a start, else of the first one), nul, bad, has_phone_col."""
        some = F.struct("start", "duration_min")
        chosen = F.coalesce(F.min_by(some, F.when(F.col("start").isNotNull(), F.col("file_ord"))), F.min_by(some, "file_ord"))
        n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
        rooms = self.report_files.groupBy("room").agg(chosen.alias("m"), n("nul"), n("bad"), F.coalesce(F.bool_or("has_phone_col"), F.lit(False)).alias("has_phone_col"))
        return self._kept(rooms.select("room", "m.start", F.coalesce("m.duration_min", F.lit(0.0)).alias("duration_min"), "nul", "bad", "has_phone_col"), "rooms")

    @cached_property
    def records(self) -> DataFrame:
        """The record of each person in each room, the richer one of several reports, with norm, alias, key_email and minutes."""
        rows = roster.typed_rows(roster.attendee_rows(self.reports, ["room", "file_ord"]))
        each = roster.records(rows, ["room", "file_ord"]).withColumn("minutes", text.round_tenth(F.col("seconds_present") / 60.0))
        place = F.min(F.col("file_ord") * F.lit(WIDE) + F.col("rec_ord")).over(Window.partitionBy("room", "rec_key"))
        one = roster.richer(each.withColumn("rec_ord", place), ["room", "rec_key"], "minutes", "file_ord")
        return self._kept(one.withColumns({"norm": _norm(F.col("name")), "alias": _norm(F.col("orig")), "key_email": contact.key_email(F.col("email"))}), "records")

    # -- chats

    @cached_property
    def chat_files(self) -> DataFrame:
        """room, file_ord, rank (by distinct messages), kept of each chat with a message."""
        files = chatlog.drop_contained(self.all_blocks, "room", "file_ord", "norm")
        return files.withColumn("rank", F.row_number().over(Window.partitionBy("room").orderBy(F.desc("n_keys"), "file_ord")))

    @cached_property
    def all_blocks(self) -> DataFrame:
        file = ["room", "file_ord"]
        headed = self._kept(chatlog.untimed(self.chats, file), "headed")
        return self._kept(chatlog.timed(headed, file).withColumn("norm", _norm(F.col("sender"))), "blocks")

    @cached_property
    def blocks(self) -> DataFrame:
        """room, block_id (in order of files and blocks), sender, norm, sec, t, lines, n_lines of the chats that count.

        ``t`` is the second of the message on the room's day: that of its start, else of the first arrival.
        """
        kept = self.chat_files.filter("kept").select("room", "file_ord", "rank")
        rows = self.all_blocks.join(kept, ["room", "file_ord"])
        arrived = self.records.groupBy("room").agg(F.min("first_join").alias("first_join"))
        day = self.room_meta.join(arrived, "room", "left").select("room", F.to_date(F.coalesce("start", "first_join")).alias("day"))
        rows = rows.join(day, "room", "left")
        t = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long") * chatlog.DAY + F.col("sec")
        return rows.select("room", (F.col("rank") * F.lit(WIDE) + F.col("block_id")).alias("block_id"), "sender", "norm", "sec", t.alias("t"), "lines", F.size("lines").cast("long").alias("n_lines"))

    @cached_property
    def said(self) -> DataFrame:
        """The blocks of attendees: of rooms with a report, without hosts."""
        known = self.blocks.join(self.room_meta.select("room"), "room", "left_semi")
        return attribution.without_hosts(known, names=self.options.hosts)

    @cached_property
    def variants(self) -> DataFrame:
        return attribution.name_variants(self.records)

    @cached_property
    def attributed(self) -> DataFrame:
        return self._kept(attribution.attributed(self.said, self.variants), "attributed")

    # -- persons

    @cached_property
    def keyed_records(self) -> DataFrame:
        """The records with gk, pricing and cta of the room's windows."""
        rows = self.records.join(self.room_meta.select("room", "start", "duration_min"), "room")
        times = F.transform("segments", lambda s: F.struct(s["j"].alias("j"), s["l"].alias("l")))
        inside = lambda o: people.present_in(times, *people.window(F.col("start"), o, MINUTES))
        no_times = (F.size("segments") == 0) & (F.col("attended_flag") | F.col("unparsed_ts"))
        return rows.withColumns({
            "gk": people.room_key(F.col("key_email"), F.col("email"), F.col("rec_key"), F.col("room")),
            "attended": F.col("attended_flag"), "pricing": inside(self.options.pricing), "cta": inside(self.options.cta), "no_timing": no_times,
        })

    @cached_property
    def persons(self) -> DataFrame:
        return self._kept(people.fold(self.keyed_records), "persons")

    @cached_property
    def own_blocks(self) -> DataFrame:
        """gk, at (order of room, the sender's first message, message), lines of what is attributed to a person of the session."""
        first = self.said.groupBy("room", "norm").agg(F.min("block_id").alias("first"))
        rows = self.attributed.filter("key_email IS NOT NULL").join(first, ["room", "norm"])
        own = rows.select(F.col("key_email").alias("gk"), F.struct("room", "first", "block_id").alias("at"), "lines")
        return self._kept(own.join(self.persons.select("gk"), "gk", "left_semi"), "own-blocks")

    @cached_property
    def borrowed(self) -> DataFrame:
        """gk, borrowed_from: silent attended people whose phone is that of one person who wrote."""
        own = self.attributed.filter("key_email IS NOT NULL").select("room", "key_email").distinct()
        named = self.variants.select("room", "key_email").distinct()
        phones = self.records.filter("attended_flag").join(named, ["room", "key_email"], "left_semi").select("room", "key_email", "phone")
        return attribution.phone_fallback(self.persons, attribution.phone_owners(phones, own), self.own_blocks)

    @cached_property
    def messages(self) -> DataFrame:
        """gk, at, lines: own blocks, and for borrowers those of the person they borrow from."""
        lent = self.borrowed.join(self.own_blocks.withColumnRenamed("gk", "borrowed_from"), "borrowed_from").select("gk", "at", "lines")
        return self.own_blocks.unionByName(lent)

    @cached_property
    def pools(self) -> DataFrame:
        """gk, pool, n_candidates: messages of a shared name that nobody gets, for those who may have written them and are
        shown them: their name wrote, and nothing else is theirs.  All namesakes' lists would be the square of the session."""
        quiet = self.chatted.join(self.messages.select("gk").distinct(), "gk", "left_anti").select(F.col("gk").alias("key_email"))
        rows = attribution.unattributed_lines(self.attributed, self.variants, quiet)
        ordered = F.array_sort(F.collect_list(F.struct("room", "lines")))
        return rows.groupBy(F.col("key_email").alias("gk")).agg(F.flatten(F.transform(ordered, lambda r: r["lines"])).alias("pool"), F.max("n_candidates").alias("n_candidates"))

    @cached_property
    def chatted(self) -> DataFrame:
        """gk of those whose name wrote in a room, whoever the messages are attributed to."""
        own = attribution.chatted_winners(self.said, attribution.winners(self.records))
        return self.keyed_records.join(own, ["room", "rec_key"], "left_semi").select("gk").distinct()

    # -- results

    @cached_property
    def judged(self) -> DataFrame:
        """The persons with what they said, the flags of their chat, dimensions, signals, category and basis."""
        texts = self.messages.groupBy("gk").agg(F.array_sort(F.collect_list(F.struct("at", "lines"))).alias("b"))
        texts = texts.select("gk", F.flatten(F.transform("b", lambda b: b["lines"])).alias("said"))
        whole = self.own_blocks.select("gk", F.array_join("lines", " ").alias("m"))
        dims = scoring.dimension_scores(whole, "gk", "m", self.banks).drop("pos", "pasted", "pasted_blocked", "cat")
        sums = signals.person_signals(self.messages.select("gk", F.explode("lines").alias("m")), "gk", "m", self.options.program)
        rows = self.persons.join(texts, "gk", "left").join(dims, "gk", "left").join(sums, "gk", "left").join(self.pools, "gk", "left")
        rows = rows.join(self.chatted.withColumn("chatted", F.lit(True)), "gk", "left").withColumn("chatted", F.coalesce("chatted", F.lit(False)))
        has = F.coalesce(F.size("said") > 0, F.lit(False))
        rows = rows.withColumns({
            "has_lines": has, "orphan": has & ~F.col("chatted"), "no_text": F.col("chatted") & ~has,
            "from_pool": ~has & F.col("chatted") & F.coalesce(F.size("pool") > 0, F.lit(False)),
            "pct": people.percent_attended(F.col("minutes"), F.col("duration_min"), F.col("no_timing")),
        })
        missing = [d for d in ("D1", "D3", "D4", "D5", "D7") if d not in rows.columns]
        return self._kept(categorize.categorized(rows.withColumns({d: F.lit(0) for d in missing})), "judged")

    @cached_property
    def cells(self) -> DataFrame:
        """gk, all_chats: everything in one cell; what a namesake may have written is marked as such."""
        prefix = F.format_string("[unattributed -- one of %d same-name registrants in this room] ", F.col("n_candidates").cast("long"))
        cell = F.when(F.col("has_lines"), sinks.all_chats(F.col("said"))).when(F.col("from_pool"), sinks.all_chats(F.col("pool"), prefix))
        return self.judged.select("gk", cell.alias("all_chats")).filter("all_chats <> ''")

    @cached_property
    def results(self) -> DataFrame:
        """A row for each person: the columns of the deliverable and of its extras, in no order (see ``ordered``)."""
        parts = self.cells.select("gk", F.posexplode(F.split("all_chats", " \\| ")).alias("k", "m"))
        split = cleaner.process_messages(parts, "gk", "k", "m", self.options.more_ignorable, self._kept).select("gk", "relevant", "deleted")
        rows = self.judged.join(self.cells, "gk", "left").join(split, "gk", "left")
        cut = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(CELL_MOST)).alias(c)
        yes = lambda c: F.when(c, "Yes").otherwise("No")
        phone = contact.cc_split(F.col("country"), F.col("phone"))
        row = rows.withColumn("_p", phone).select(
            "name", "email", F.col("_p.cc").alias("cc"), F.col("_p.national").alias("phone"), "category", "basis", cut("relevant"), cut("deleted"),
            F.coalesce("all_chats", F.lit("")).alias("all_chats"), yes(F.col("has_lines") | F.col("from_pool")).alias("chatted"), F.col("rooms").alias("room"),
            yes(F.col("attended")).alias("attended"), text.round_tenth(F.col("minutes")).alias("minutes"), F.coalesce(F.size("said"), F.lit(0)).alias("msg_count"),
            "pricing", "cta", "person_ord",
        )
        return self._kept(row, "results")

    def ordered(self) -> DataFrame:
        """The results as they are delivered: by category, presence and name."""
        return self.results.orderBy(*order())

    # -- what is told about the session

    @cached_property
    def room_stats(self) -> DataFrame:
        """room, people, attended, chat_blocks, chat_span_min, duration_min, nul_rows, has_phone_col, lost."""
        own = self.records.groupBy("room").agg(F.count(F.lit(1)).alias("people"), F.count_if("attended_flag").alias("attended"))
        talk = chatlog.spans(self.blocks, "room")
        rooms = self.room_meta.withColumn("lost", F.lit(False)).join(own, "room", "left").join(talk, "room", "full_outer")
        no = F.lit(0).cast("long")
        lost = F.coalesce("lost", F.lit(True))
        told = lambda c: F.when(~lost, c)
        return rooms.select(
            "room", F.coalesce("people", no).alias("people"), F.coalesce("attended", no).alias("attended"), F.coalesce("chat_blocks", no).alias("chat_blocks"),
            told(F.bround(F.coalesce(F.col("span_s"), F.lit(0)) / 60.0).cast("long")).alias("chat_span_min"), told(F.col("duration_min")).alias("duration_min"),
            told(F.col("nul")).alias("nul_rows"), told(F.col("has_phone_col")).alias("has_phone_col"), lost.alias("lost"),
        )

    @cached_property
    def counters(self) -> DataFrame:
        """One row: senders and messages by what became of them, with the counters of phones, hosts and lost keys."""
        each = attribution.stats(self.attributed)
        sums = each.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in each.columns if c != "room"))
        known = self.blocks.join(self.room_meta.select("room"), "room", "left_semi")
        hosts = attribution.host_blocks(known, names=self.options.hosts).agg(F.coalesce(F.sum("host_blocks"), F.lit(0)).cast("long").alias("host_blocks"))
        own = self.attributed.filter("key_email IS NOT NULL").select("room", "key_email").distinct()
        named = self.variants.select("room", "key_email").distinct()
        phones = self.records.filter("attended_flag").join(named, ["room", "key_email"], "left_semi").select("room", "key_email", "phone")
        shared = attribution.phones_dropped_shared(phones, own).agg(F.coalesce(F.sum("phones_dropped_shared"), F.lit(0)).cast("long").alias("phones_dropped_shared"))
        rest = attribution.session_counters(self.attributed, self.persons, self.borrowed)
        row = sums.crossJoin(hosts).crossJoin(shared).crossJoin(rest)  # of one row each
        sent, dropped = F.col("msg_unique") + F.col("msg_time_resolved"), F.col("msg_still_ambiguous") + F.col("msg_no_csv_row")
        share = F.round(100.0 * dropped / F.greatest(F.lit(1), sent + dropped), 2)
        return row.withColumns({"msgs_attributed": sent, "msgs_dropped": dropped, "msgs_dropped_pct": share})

    @cached_property
    def session_date(self) -> DataFrame:
        """One row: the first day that a room started on."""
        return self.room_meta.agg(F.to_date(F.min("start")).alias("session_date"))

    @cached_property
    def audit(self) -> DataFrame:
        return cleaner.audit(self.results, more_ignorable=self.options.more_ignorable)

    @cached_property
    def warnings(self) -> DataFrame:
        """room, code, message: what degrades a room's results."""
        talk = self.chats.groupBy("room", "file_ord").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line").rlike(chatlog.HEADER)).alias("heads"))
        chats = self.chats.select("room").distinct().withColumn("has_chat", F.lit(True))
        rooms = self.room_stats.join(self.room_meta.select("room", "bad", "start"), "room", "left").join(chats, "room", "left").withColumn("has_chat", F.coalesce("has_chat", F.lit(False)))
        reported = ~F.col("lost")
        num = lambda c: F.col(c).cast("long")
        rules = [
            ("nul_rows", F.col("nul_rows") > 0, F.format_string("%d attendee row(s) had NUL bytes; they were repaired and kept, ask for a new export", num("nul_rows"))),
            ("bad_rows", F.col("bad") > 0, F.format_string("%d attendee row(s) can't be read and were skipped", num("bad"))),
            ("no_rows", reported & (F.col("people") == 0), F.lit("the attendee report has no rows (a changed header?); the room adds nobody")),
            ("no_report", F.col("lost"), F.lit("chat without an attendee report: it can't be attributed and is lost")),
            ("no_chat", reported & ~F.col("has_chat") & (F.col("people") > 0), F.lit("attendee report without a chat export: everybody will read as silent")),
            ("no_start", reported & F.col("start").isNull() & (F.col("people") > 0), F.lit("the start can't be read: windows and names that several people have are less certain")),
            (
                "truncated",
                reported & (F.col("chat_blocks") > 0) & (F.col("duration_min") > 0) & (F.col("chat_span_min") < 0.5 * F.col("duration_min")),
                F.format_string("the chat spans only %d of about %d minutes: the export is cut off, people will falsely read as silent", num("chat_span_min"), F.bround("duration_min").cast("long")),
            ),
        ]
        told = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), m.alias("message"))) for code, c, m in rules)))
        per_room = rooms.select("room", F.inline(told))
        silent = talk.filter("heads = 0 AND lines > 50").select("room", F.lit("no_headers").alias("code"), F.lit("a chat-like file has no headers (a new format?)").alias("message"))
        copies = self.chat_files.filter("NOT kept").select("room", F.lit("duplicate_chat").alias("code"), F.lit("a chat file repeats the messages of another one and was skipped").alias("message"))
        return per_room.unionByName(silent).unionByName(copies)

    @cached_property
    def summary(self) -> DataFrame:
        """One row, summary: what a status page shows, as JSON."""
        kinds = self.audit.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in sinks.GATED))
        suspects = self.audit.filter("kind = 'freq_suspects' AND rank <= 12").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda r: F.struct(r["value"], r["n"])).alias("freq_suspects"))
        rows = self.results.agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("chatted") == "Yes").alias("chatted"), F.count_if("pricing").alias("pricing_yes"), F.count_if("cta").alias("cta_yes"),
            F.map_filter(F.map_from_arrays(F.array(*map(F.lit, categorize.ORDER)), F.array(*(F.count_if(F.col("category") == c) for c in categorize.ORDER))), lambda _, n: n > 0).alias("category_counts"),
        )
        rooms = self.room_stats.agg(F.array_sort(F.collect_list(F.struct(*self.room_stats.columns))).alias("room_stats"))
        missing = self.room_stats.filter("people > 0 AND NOT has_phone_col").agg(F.array_sort(F.collect_list("room")).alias("phone_col_missing"))
        warnings = self.warnings.agg(F.array_sort(F.collect_list(F.struct("room", "code", "message"))).alias("warnings"))
        row = rows.crossJoin(self.session_date)
        for one, name in ((self.counters, "attribution"), (kinds, "audit")):
            row = row.crossJoin(one.select(F.struct(*one.columns).alias(name)))
        for one in (rooms, missing, warnings, suspects):
            row = row.crossJoin(one)
        row = row.withColumn("have_offsets", F.lit(self.options.pricing is not None or self.options.cta is not None))
        return row.select(F.to_json(F.struct(*row.columns)).alias("summary"))

    @cached_property
    def report(self) -> DataFrame:
        """ord, label, value: the run report's lines."""
        line = lambda order, label, value="": F.struct(F.lit(order).alias("ord"), (F.lit(label) if isinstance(label, str) else label).alias("label"), (F.lit(value) if isinstance(value, str) else value.cast("string")).alias("value"))
        totals = self.results.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("category") == c).alias(c) for c in categorize.ORDER))
        count = lambda k, c: F.when(F.col(f"`{c}`") > 0, line(f"20.{k}", "  " + c, F.col(f"`{c}`")))
        first = totals.select(F.inline(F.array_compact(F.array(line("10", "Rows (unique people across all rooms)", F.col("n")), *(count(k, c) for k, c in enumerate(categorize.ORDER))))))
        room = F.format_string(
            "people=%d attended=%d chat_blocks=%d span=%smin/%smin nul_rows=%d%s", "people", "attended", "chat_blocks", F.coalesce(F.col("chat_span_min").cast("string"), F.lit("?")),
            F.coalesce(F.col("duration_min").cast("string"), F.lit("?")), F.coalesce("nul_rows", F.lit(0).cast("long")), F.when(F.col("lost"), " [NO USABLE ATTENDEE REPORT]").otherwise(""),
        )
        rooms = self.room_stats.select(F.concat(F.lit("31."), "room").alias("ord"), F.concat(F.lit("  "), "room").alias("label"), room.alias("value"))
        names = [("sender_unique", "senders resolved by unique name"), ("sender_time_resolved", "senders resolved by presence window"), ("sender_unresolved", "senders unresolved"), ("sender_no_csv_row", "senders with no attendee-report row"), ("msgs_attributed", "messages attributed")]
        dropped = F.concat(F.col("msgs_dropped").cast("string"), F.lit(" ("), F.col("msgs_dropped_pct").cast("string"), F.lit("%), dropped rather than guessed"))
        chat = self.counters.select(F.inline(F.array(*(line(f"41.{k}", "  " + label, F.col(c)) for k, (c, label) in enumerate(names)), line("41.9", "  messages dropped (ambiguous or unmatchable)", dropped))))
        audit = self.audit.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in sinks.GATED))
        gate = audit.select(F.inline(F.array(line("50", "Chat-clean audit (must be 0/0/0)", F.format_string(" ".join(f"{k}=%d" for k in sinks.GATED), *sinks.GATED)))))
        warned = self.warnings.select(F.concat(F.lit("71."), "room", F.lit("."), "code").alias("ord"), F.lit("  !").alias("label"), F.concat(F.lit("room "), "room", F.lit(": "), "message").alias("value"))
        used = f"pricing={self.options.pricing} min, CTA={self.options.cta} min ({MINUTES}-minute windows)" if (self.options.pricing, self.options.cta) != (None, None) else "none: categories are the same, only the basis says less"
        fixed = [("00", "Run report", ""), ("30", "Rooms", ""), ("40", "Chat attribution", ""), ("60", "Offsets used", used)]
        spark = self.reports.sparkSession
        heads = spark.createDataFrame(fixed, "ord string, label string, value string")
        titles = self.warnings.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("70").alias("ord"), F.lit("Warnings").alias("label"), F.lit("").alias("value"))
        rows = heads
        for more in (first, rooms, chat, gate, warned, titles):
            rows = rows.unionByName(more)
        return rows

    def deliver(self) -> DataFrame:
        """The ordered results, once they are free of contradictions and the audit is clean."""
        check_invariants(self.results, self.persons)
        sinks.check_gate(self.audit)
        return self.ordered()


def order() -> list[Column]:
    """Results are delivered by category, presence and name; equal ones as their people came."""
    return [categorize.rank(F.col("category")), F.desc("minutes"), F.lower("name"), F.col("person_ord")]


def contradictions(results: DataFrame) -> DataFrame:
    """The rows that can't be: an unknown category, chat text without chat, or chat text of the silent and the absent."""
    some = (F.col("relevant") != "") | (F.col("deleted") != "")
    quiet = F.col("category").isin(categorize.SILENT, categorize.ABSENT)
    wrong = ~F.col("category").isin(*categorize.ORDER) | (some & ((F.col("all_chats") == "") | (F.col("chatted") != "Yes") | quiet))
    return results.filter(F.coalesce(wrong, F.lit(True)))


def check_invariants(results: DataFrame, persons: DataFrame | None = None) -> None:
    if not contradictions(results).isEmpty():
        raise InvariantError("a row has chat text that it can't have, or no known category")
    if persons is not None and results.count() != persons.count():
        raise InvariantError("there are not as many rows as people")
