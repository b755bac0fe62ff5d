"""Eight engagement categories from signals, dimensions and presence: the first rule that fits decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The categories in the order that results are sorted by.
HIGH, STRONG, MODERATE, SEEKING, UNCLEAR, NEGATIVE, SILENT, ABSENT = ORDER = [
    "purchase intent high", "strong interest", "moderate interest", "information seeking", "no clear intent", "negative engagement", "non chatted", "non attended",
]


def rank(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORDER)), category)


def histogram(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def categorized(people: DataFrame) -> DataFrame:
    """The rows with category and basis.

    Reads attended, chatted, pct, cta, pricing, orphan, no_text; D1, D3, D4, D5, D7, intent, mean, neg; and the sums of
    ``signals.person_signals`` (null for people without messages).
    """
    names = {"pay", "frict", "toolp", "griev", "join", "emi", "disc", "price", "q", "qc", "sneg", "mild", "mild_tgt", "rit", "pos", "tech", "sneg_rec", "sneg_av", "nothanks", "delib", "cdq", "quip", "addon", "courseq", "progbuy", "progfit", "recveto", "sells", "fup", "nonrit", "nontech", "sub", "n_msgs", "D1", "D3", "D4", "D5", "D7", "intent", "mean", "neg"}
    filled = people.withColumns({f"_{n}": F.coalesce(F.col(n), F.lit(0)) for n in names})
    v = lambda n: F.col(f"_{n}")
    yes = lambda n: v(n) > 0
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    least1 = F.greatest(v("mean"), F.lit(1))

    # An angry payer's mentions are no confirmation; a rant that names instalments or joining is no ask.
    angry = yes("pay") & (v("sneg") + v("mild") >= 5) & ~(yes("join") | yes("emi") | yes("disc") | yes("price") | yes("frict"))
    filled = filled.withColumn("_pay", F.when(angry, 0).otherwise(v("pay")))
    rant = yes("sneg") & (3 * v("sneg") >= least1) & ~(yes("pay") | yes("frict") | yes("price"))
    filled = filled.withColumn("_rant", rant)
    filled = filled.withColumns({f"_{n}": F.when(F.col("_rant"), 0).otherwise(v(n)) for n in ("join", "emi", "disc")})
    buy = yes("pay") | yes("frict") | yes("join") | yes("emi") | yes("disc") | yes("price")
    no_buy = ~buy & (v("D1") == 0) & (v("intent") == 0) & (v("D7") == 0) & (v("D3") == 0)
    dominated = ((v("sneg") >= 2) & (3 * v("sneg") >= least1)) | ((v("sneg") == 1) & (v("mean") <= 2) & (v("n_msgs") <= 6) & (v("qc") == 0))
    neg_dom = ~buy & (v("intent") == 0) & (v("D7") == 0) & (v("join") == 0) & dominated
    open_to_neg = no_buy | neg_dom

    substance = F.greatest(F.lit(1), v("n_msgs") - v("rit") - v("tech"))
    weary = (v("sneg") == 0) & ((v("mild") >= 3) | ((v("mild") >= 2) & (2 * v("mild") >= least1)) | (yes("mild") & (substance <= 3) & (v("mean") <= 2) & yes("mild_tgt")))
    weary = weary & ~((v("rit") >= 6) & (v("mild") <= 3)) & ~(v("pos") > v("mild")) & ~(yes("qc") & (v("mild") <= 1)) & ~(v("qc") >= 3) & ~yes("delib")
    weary = weary & ~((v("mild") == 1) & yes("quip") & (v("rit") >= v("n_msgs") - 1))
    calm = (v("mild") == 0) & ~yes("griev")
    mixed = (
        (((v("sneg") == 1) | ((v("sneg") == 2) & yes("pos"))) & calm & (v("mean") >= 6) & (v("qc") >= 2) & (v("sneg_rec") == v("sneg")))
        | ((v("sneg") == 1) & (v("sneg_rec") == 1) & calm & ~yes("recveto"))
        | ((v("sneg") == 1) & yes("nothanks") & (v("pos") >= 2))
        | ((v("sneg") == 1) & yes("sneg_av") & (v("mild") <= 1) & (v("tech") >= 3) & ~yes("recveto") & ~yes("sells"))
        | (yes("delib") & (v("sneg") == 0))
    )
    grief = yes("griev") & ~yes("frict") & open_to_neg
    negative = ~mixed & open_to_neg & (yes("sneg") | weary)

    courseq = yes("courseq") | yes("cdq")
    corrob = buy | yes("price") | courseq
    progfit = yes("progfit") | yes("delib")
    dims_ok = (corrob | yes("toolp") | yes("progbuy")) & ~(yes("toolp") & ~corrob)
    high = yes("pay") | yes("frict") | yes("join") | yes("emi") | yes("disc") | courseq | ((v("D1") >= 9) & dims_ok) | ((v("intent") >= 2) & corrob) | (yes("D7") & corrob) | (yes("D1") & yes("D3") & dims_ok)
    technical = yes("nonrit") & (v("nontech") == 0) & yes("tech")
    praising = yes("nonrit") & (v("sub") == 0) & ~buy & ~yes("price")
    generic = (technical | praising) & (v("D4") == 0) & ~buy
    strong = yes("price") | ((yes("D1") | yes("intent") | yes("D3") | yes("D5") | yes("D7")) & (dims_ok | progfit))
    moderate = yes("D4") | (v("mean") >= 3)
    seeking = (yes("mean") | yes("qc")) & (yes("qc") | yes("toolp"))
    stayed = yes("mean") & flag("cta") & flag("pricing") & yes("sub")

    text = lambda s, *cs: F.format_string(s, *(c.cast("long") for c in cs))
    watched = [F.when(F.col("pct") > 0, text("watched %d%% of session", F.bround("pct"))), F.when(flag("pricing"), "present at pricing"), F.when(flag("cta"), "stayed to CTA")]
    watch = F.array_compact(F.array(*watched))
    said = lambda s: F.array_join(F.concat(F.array(F.lit(s) if isinstance(s, str) else s), F.when(F.size(watch) > 0, F.array(F.array_join(watch, ", "))).otherwise(F.array().cast("array<string>"))), "; ")
    addon = yes("addon") & yes("pay") & ~(yes("frict") | yes("join") | yes("emi") | yes("disc") | courseq)
    tone = yes("neg") | yes("sneg") | yes("mild")
    context = [F.when(flag("pricing"), "present at pricing"), F.when(flag("cta"), "stayed to CTA"), F.when(tone, text("%d negative msg(s) (mixed tone)", F.greatest(v("neg"), v("sneg") + v("mild"))))]
    evidence = [
        F.when(addon, "paid registration add-on (fulfilment follow-up)").when(yes("pay"), "payment-confirmation in chat"),
        F.when(yes("frict"), "payment friction/attempt (tried or asked how to pay)"),
        F.when(yes("join"), "asked how to join/enroll"),
        F.when(yes("emi"), "EMI/installment ask"),
        F.when(yes("disc"), "discount ask"),
        F.when(v("D1") >= 9, text("strong buying language (D1=%d)", v("D1"))).when(yes("D1"), text("buying language (D1=%d)", v("D1"))),
        F.when(v("intent") >= 2, text("%d intent msgs", v("intent"))).when(v("intent") == 1, "1 intent msg"),
        F.when(yes("D7"), "decision-ready (payment/registration ask)"),
        F.when(yes("D3"), "urgency/timeline language"),
        F.when(yes("D5"), "practical purchase objection"),
        F.when(courseq, "course-detail ask"),
        F.when(yes("fup") & ~corrob, text("%d follow-up ask(s) (certificate/link/notes)", v("fup"))),
    ]
    priced = F.when(yes("price"), "program price ask")
    more = [F.when(yes("D4"), text("use-case/profession fit (D4=%d)", v("D4"))), F.when(v("mean") >= 3, text("%d meaningful msgs", v("mean")))]
    joined = lambda *parts: F.array_join(F.array_compact(F.array(*parts)), "; ")
    complaint = F.when(yes("sneg"), text("%d strongly negative/complaint msg(s), negativity dominates, zero buying signals", v("sneg"))).otherwise(text("%d pitch-fatigue/complaint msg(s) dominate the chat, zero buying signals", v("mild")))
    asks = F.when(yes("toolp") & ~yes("q"), "asks tool-cost/availability questions (not program intent)").otherwise(text("asks content/how-to questions (%d meaningful msg(s)), no buying language", v("mean")))
    silent = ~flag("chatted") & ~(flag("orphan") & yes("n_msgs"))
    rules = [
        (~flag("attended"), ABSENT, F.lit("registered, never joined")),
        (silent, SILENT, F.when(F.size(watch) > 0, said("no chat messages")).otherwise("no chat messages; barely present")),
        (flag("no_text"), UNCLEAR, said("engine counted chat but no message could be attributed to this contact (same-name ambiguity); label capped")),
        (grief, NEGATIVE, said("existing-customer grievance (paid earlier, unresolved issue)")),
        (negative, NEGATIVE, joined(complaint, F.when(yes("mean"), text("%d meaningful msg(s)", v("mean"))))),
        (high, HIGH, joined(*evidence, *context)),
        (generic, UNCLEAR, said(F.when(technical, "only technical/AV/pace messages and generic chat").otherwise("only praise/AV/generic chat, no substantive signal"))),
        (strong, STRONG, joined(*evidence, priced, *context)),
        (moderate, MODERATE, joined(*evidence, priced, *more, *context)),
        (seeking, SEEKING, joined(asks, *context)),
        (stayed, MODERATE, joined(text("chatted (%d meaningful msg(s))", v("mean")), *context)),
    ]
    last = said(F.when(yes("tech"), "only technical/AV messages and generic chat").otherwise("only greetings/generic chat, no substantive signal"))
    category, basis = F.lit(UNCLEAR), last
    for condition, name, why in reversed(rules):
        category, basis = F.when(condition, name).otherwise(category), F.when(condition, why).otherwise(basis)
    matched = flag("attended") & flag("orphan") & ~silent
    basis = F.when(matched, F.concat(F.lit("contact-matched chat (engine room-match miss); "), basis)).otherwise(basis)
    return filled.withColumns({"category": category, "basis": basis}).select(*people.columns, "category", "basis")
