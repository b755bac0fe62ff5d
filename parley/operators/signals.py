"""What single messages say, as flags, summed for each person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .signal_patterns import PATTERNS

# Smaller patterns that the rules combine, and parts of questions.
PARTS = {
    "waste_request": r"\b(?:don'? ?t|do not|stop|please stop|without|no) wast\w+\b|\b(?:otherwise|or else|if not)\b[^.\n|]{0,30}\bwaste\b|\bwast\w+\b[^.\n|]{0,35}\bif (?:there|you|it|we|i|th(?:e|is|at))\b|\bwhy (?:are|r) (?:you|u|we)\b[^.\n|]{0,15}\bwast|\b\d+ ?min\w{0,4} waste\b",
    "hard_verdict": r"scam|fraud|fake|useless|worst|rubbish|bakwas|shit|crap|fool",
    "av": r"echo|audio|mic|sound|volume|lag|network|wifi|internet",
    "waste": r"\bwast\w+\b",
    "tool_topic": r"\b(?:chat ?gpt|perplexity|claude|gemini|linkedin|job profiles?|data|detect\w*|identify|filter|email|n8n|automat\w*|connect\w*|website|app|account|hack\w*|safe|secur\w*)\b",
    "ironic": r"\b(?:nice|super|great|wow|lovely|wah|what a)\b\W{0,6}\b(?:scam\w*|fraud|fake)",
    "cheat_sheet": r"cheat\s?-?\s?sheet",
    "crazy": r"craz+y+",
    "or_live": r"\bor live\b|\blive or\b",
    "rec_tag": r"record\w*[^.\n|]{0,15}(?:right|na|no)\s*\?*\s*$",
    "qualified": r"not interested in (?:the |your )?(?:whole|entire|full|complete)|not interested[^.\n|]{0,40}\bbut\b|not interested in (?:creating|making|building|generating|watching|seeing|hearing)|right now[^.\n|]{0,25}not interested|not interested[^.\n|]{0,15}(?:right now|for now|yet|at the moment)|in ?case[^.\n|]{0,30}not interested|if[^.\n|]{0,25}not interested",
    "loved": r"\bi loved? (?:it|this)\b|\blove it but\b",
    "swears_at": r"fuck(?:ing)? ?(?:off|you|u\b|this|it\b)",
    "fire": r"🔥|😍|🥵|🤯",
    "as_hell": r"\b\w+ as fuck\b",
    "not_praise": r"wast|nothing|worst|scam|fake|shit|bull|crap|useless",
    "course_word": r"\b(?:course|program|ads?|pitch)\b",
    "target": r"\b(?:session|workshop|webinar|class|you|your|this|it|ad\w*|promo\w*|market\w*|sell\w*|course|pitch|intro\w*|guys)\b",
    "curse_only": r"^\s*(?:f+u+c+k+|wtf)\W*$",
    "booked": r"^\s*(?:booked|enrolled)\s*[.!]*\s*$",
    "join_other": r"\bjoin (?:the )?(?:chat|zoom|meeting|audio|call|class today|link)\b|\bstart (?:it|this|the (?:tool|app|website|recording|video))\b|\bstart\b[^.\n|]{0,12}\bwhen writing\b",
    "other_discount": r"\b(?:coupon code for|pro coupon|lovable|swiggy|zomato|flight|ticket|payout|discount card|scholarship program\b.{0,20}(?:austria|abroad|ms\b))\b|\b(?:create|apply\w*|book)\b[^.\n|]{0,20}\bdiscount\b",
    "purchase_order": r"purchase order",
    "sells": r"\b(?:sell\w*|promot\w*|market\w*|advertis\w*|bech\w*)\b",
}
DIRECTIVES = ["too long", "wrap up", "wind up", "is it over", "can we end", "end here", "end now", "move ahead", "come to the point", "get to the point", "cut it short", "sum up", "sum it up"]
QUESTIONS = [" how ", " what ", " which ", " when ", " where ", " why ", " kaise", " kya ", "can i", "can we", "can you", "can u ", "could you", "please share", "pls share", "share the", "send the", "is there", "will i", "will we", "do we", "does it", "tell me", "any link"]
COUNTS = ["pay", "frict", "toolp", "griev", "join", "emi", "disc", "price", "q", "qc", "sneg", "mild", "mild_tgt", "dirmild", "rit", "pos", "tech", "pay_sup", "sneg_rec", "sneg_av", "nothanks", "delib", "cdq", "quip", "addon"]
ANY = ["courseq", "progbuy", "progfit", "recveto", "sells"]
NEVER = "(?!)"


def message_signals(messages: DataFrame, person: str, message: str, program: str = NEVER) -> DataFrame:
    """person and the counters of each message.  ``program``: pattern of the programme's own names."""
    raw = F.regexp_replace(F.coalesce(F.col(message), F.lit("")), "[’‘]", "'")
    texts = {name: "(?iu)" + p.replace("{program}", program) for name, p in {**PATTERNS, **PARTS}.items()}
    rows = messages.select(F.col(person), raw.alias("m"))
    hits = rows.select(person, "m", *(F.col("m").rlike(p).alias(f"h_{name}") for name, p in texts.items()), F.lower(F.regexp_extract("m", texts["SEVERE"], 0)).alias("tok"), F.lower(F.regexp_extract("m", texts["MILDNEG"], 0)).alias("mild_tok"))
    everyone = Window.partitionBy(person)
    ritual = F.trim("m").rlike(texts["RITUALTOK"])
    hits = hits.withColumn("h_RITUALTOK", ritual).withColumns({"n_own": F.count(F.lit(1)).over(everyone), "n_pos": F.count_if("h_POSTOK").over(everyone), "n_rit": F.count_if("h_RITUALTOK").over(everyone)})
    h = lambda name: F.col(f"h_{name}")
    starts = lambda *words: F.col("tok").rlike("^(?:" + "|".join(words) + ")")
    length, asks = F.length("m"), F.col("m").contains("?")
    bare = F.trim("m")

    guard = h("NEGGUARD") | h("NEGPOS") | (h("PROFWORDS") & h("PROFCTX"))
    techx = h("TECHNOISE") & ((length <= 60) | ~h("SEVERE"))
    first = ~techx & ~guard & (h("SEVERE") | (h("SUSREC") & h("SUSPAIR")))
    asked = first & h("waste_request") & ~h("hard_verdict")
    begun = first & ~asked & h("waste") & h("STARTREQ") & ~h("PROMOW")
    left = first & ~asked & ~begun
    others_fine = ((F.col("n_pos") - h("POSTOK").cast("int")) > 0) | ((F.col("n_rit") - h("RITUALTOK").cast("int")) == F.col("n_own") - 1)
    topic = starts("scam", "fraud", "fake")
    recorded = h("SEVERE") & F.col("tok").contains("record")
    exempt = (
        F.when(topic & F.trim("m").rlike(texts["NEGQ_TOPIC"]) & ~h("WHATA"), "topic")
        .when(topic & asks & h("tool_topic"), "tool")
        .when(h("JOKE") & (length <= 40) & ~h("ironic"), "joke")
        .when(h("DEMOTGT") & (length <= 30), "demo")
        .when(starts("cheat") & h("cheat_sheet"), "sheet")
        .when(starts("shit") & h("crazy"), "crazy")
        .when(recorded & h("CDQ") & (asks | F.lower("m").contains(" or ")), "cdq")
        .when(recorded & (h("or_live") | h("rec_tag") | bare.endswith("?") | h("RECQSTART") | h("RECHEDGE")) & ~h("RECVETO"), "hedge")
        .when(starts("not interested") & h("qualified"), "qualified")
        .when(h("FEARRE"), "fear")
        .when(topic & h("RECHEDGE") & h("POSTOK"), "doubt")
        .when(F.col("tok").rlike("wast|time ?pass") & h("loved"), "loved")
        .when(starts("f+u+c+k", "wtf") & ~h("swears_at") & (h("fire") | h("as_hell") | (h("POSTOK") & ~h("not_praise"))), "oath")
        .when((F.length(bare) <= 12) & (F.col("n_own") >= 3) & ~h("ironic") & others_fine, "quip")
    )
    hits = hits.withColumns({"exempt": F.when(left, exempt), "first": first, "asked": asked, "begun": begun}).withColumn("sev", left & F.col("exempt").isNull())
    sev = F.col("sev")
    praise = h("POSTOK") & ~h("QUOTEMB") & ~h("SEVERE")
    weary = ~sev & ~techx & ~guard & h("MILDNEG") & ~praise
    kind = (
        F.when(F.col("mild_tok").isin("too long", "too much time") & h("TASKCTX"), "task")
        .when(F.col("mild_tok").rlike("^(?:irritat|annoy)") & (h("QUOTEMB") | h("RIGHTTIC")) & ~h("SEVERE"), "directive")
        .when((h("DIRECTIVE") | F.col("mild_tok").isin(DIRECTIVES)) & ~h("VERDICTS") & ~h("course_word"), "directive")
        .otherwise("mild")
    )
    hits = hits.withColumns({"praise": praise, "weary": F.when(weary, kind)})
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    mild = F.col("weary") == "mild"
    quiet = F.col("asked") & ~h("av")
    paid = (h("PAYRE") | h("booked")) & ~h("TOOLPRICE") & ~h("PAYNEG")
    friction = h("PAYFRICT") & ~h("TOOLPRICE") & ~h("PAYNEG") & ~h("BUILDPAY")
    step = F.when(h("PASTGRIEV"), "griev").when(friction, "frict").when(paid & sev, "pay_sup").when(paid & h("PAYQOBJ") & ~h("PAYACT"), "toolp").when(paid, "pay")
    question = ~h("TECHNOISE") & (asks | F.exists(F.array(*map(F.lit, QUESTIONS)), lambda k: F.concat(F.lit(" "), F.lower("m"), F.lit(" ")).contains(k)))
    values = {
        "pay": one(step == "pay"),
        "frict": one(step == "frict"),
        "toolp": one(step == "toolp") + one(h("TOOLPRICE")),
        "griev": one(step == "griev"),
        "join": one(~sev & h("JOINHOW") & ~h("join_other") & ~(h("SESSJOIN") & ~h("PROGANCH"))),
        "emi": one(h("EMIASK") & ~sev),
        "disc": one(h("DISCOUNT") & ~sev & ~h("TOOLPRICE") & ~h("other_discount")),
        "price": one(h("PRICEASK") & ~h("TOOLPRICE") & ~sev),
        "q": one(question),
        "qc": one(question & ~h("MILDNEG") & ~h("SEVERE")),
        "sneg": one(sev),
        "mild": one(quiet & h("PROMOW") & ~h("STARTREQ")) + one(F.col("exempt").isin("loved", "quip")) + F.when(mild, F.when((length >= 80) & ~asks, 2).otherwise(1)).otherwise(0),
        "mild_tgt": one(mild & h("target")),
        "dirmild": one(quiet & (~h("PROMOW") | h("STARTREQ"))) + one(F.col("begun")) + one(F.col("weary") == "directive"),
        "rit": one(h("RITUALTOK")),
        "pos": one(F.col("praise")),
        "tech": one(h("TECHNOISE")),
        "pay_sup": one(step == "pay_sup"),
        "sneg_rec": one(sev & F.contains(F.lower("m"), F.lit("record"))),
        "sneg_av": one(sev & (F.col("tok").rlike("\\bwast|useless|time ?pass") | ((F.length(bare) <= 8) & h("curse_only")))),
        "nothanks": one(sev & starts("no thanks")),
        "delib": one(h("DELIB")),
        "cdq": one(F.col("exempt") == "cdq"),
        "quip": one(F.col("exempt") == "quip"),
        "addon": one((step == "pay") & h("ADDONPAY")),
        "courseq": one(h("COURSEQ") & ~h("TOOLPRICE") & ~h("SESSDUR")),
        "progbuy": one(h("PROGBUY") & ~h("TOOLPRICE") & ~h("PAYNEG") & ~h("BUILDPAY") & ~h("purchase_order")),
        "progfit": one(h("PROGFIT")),
        "recveto": one(h("RECVETO")),
        "sells": one(h("sells")),
        "fup": one(h("FOLLOWUP")),
        "nonrit": one(~h("RITUALTOK")),
        "nontech": one(~h("RITUALTOK") & ~h("TECHNOISE")),
        "sub": one(~h("RITUALTOK") & ~h("TECHNOISE") & ~(h("POSTOK") & (length < 80) & ~asks) & (F.length(bare) > 3) & ~h("MILDNEG")),
    }
    return hits.select(person, *(v.alias(k) for k, v in values.items()))


def person_signals(messages: DataFrame, person: str, message: str, program: str = NEVER) -> DataFrame:
    """person, n_msgs and the sums of the counters; the shuffle on the person serves the flags of siblings and the sums."""
    rows = message_signals(messages, person, message, program)
    return rows.groupBy(person).agg(F.count(F.lit(1)).alias("n_msgs"), *(F.sum(c).alias(c) for c in rows.columns if c != person))
