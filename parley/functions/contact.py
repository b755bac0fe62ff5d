"""E-mail and phone keys as column expressions.

All functions take and return columns and stay inside generated code; null reads as empty and the results are never null
unless said so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domains and endings that are typing errors, providers, placeholders, free and disposable domains, local parts
# that many people type.
DOMAIN_REPAIRS = {
    "gamil": "gmail", "gmial": "gmail", "gmal": "gmail", "gmil": "gmail", "gmaii": "gmail", "gmali": "gmail", "gemail": "gmail", "googlemail": "gmail", "gmai": "gmail",
    "hotmial": "hotmail", "hotmali": "hotmail", "hotmil": "hotmail",
    "yaho": "yahoo", "yahooo": "yahoo", "yhaoo": "yahoo", "rediffmal": "rediffmail",
}
ENDING_REPAIRS = ["con", "vom", "cim", "comm", "coom", "om", "cm", "ocm", "clm", "xom"]
PROVIDERS = ["gmail", "yahoo", "hotmail", "outlook", "rediffmail", "icloud", "live", "aol", "protonmail", "ymail"]
PLACEHOLDERS = ["1234567890", "0123456789", "9876543210", "0987654321"]
FREE_DOMAINS = [
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.in", "yahoo.co.in", "yahoo.co.uk", "yahoo.com.au",
    "hotmail.com", "hotmail.co.uk", "hotmail.in", "outlook.com", "outlook.in", "rediffmail.com", "rediff.com",
    "icloud.com", "me.com", "live.com", "live.in", "aol.com", "ymail.com", "protonmail.com", "proton.me",
    "msn.com", "zoho.com", "zohomail.in", "gmx.com", "mail.com", "yandex.com",
]
GENERIC_LOCALS = [
    "abc", "abcd", "abcde", "xyz", "test", "testing", "tester", "na", "no", "none", "nil", "noemail", "nomail", "notavailable", "nothing", "asdf", "asdfg", "qwerty", "dummy", "sample", "example", "user", "admin", "email", "mail", "aaa", "aaaa", "fake", "random", "unknown",
    "xxx", "xxxx", "demo", "temp", "tempmail", "info", "contact", "support", "me", "my", "myemail",
    "123", "1234", "12345", "123456", "abc123", "a1", "nomailid", "noid", "not", "nope", "anonymous",
]
DISPOSABLE_DOMAINS = ["mailinator.com", "yopmail.com", "tempmail.com", "temp-mail.org", "10minutemail.com", "guerrillamail.com", "trashmail.com", "fakeinbox.com", "sharklasers.com", "getnada.com", "dispostable.com", "maildrop.cc", "emailondeck.com", "mohmal.com", "mytemp.email"]
DIAL_CODES = {
    "India": "91", "United Arab Emirates": "971", "United States": "1", "Saudi Arabia": "966",
    "Australia": "61", "Germany": "49", "Japan": "81", "Singapore": "65", "Netherlands": "31",
    "Pakistan": "92", "Oman": "968", "United Kingdom": "44", "Canada": "1", "Nigeria": "234",
    "Kuwait": "965", "Qatar": "974", "Kenya": "254", "Nepal": "977", "Bangladesh": "880",
    "France": "33", "Romania": "40", "Thailand": "66", "Uganda": "256", "Norway": "47",
    "Hong Kong SAR": "852", "Hong Kong": "852", "Italy": "39", "Sri Lanka": "94", "Malaysia": "60",
    "Philippines": "63", "Bahrain": "973", "New Zealand": "64", "Ghana": "233", "Uzbekistan": "998",
    "Ireland": "353", "Brazil": "55", "Denmark": "45", "Bhutan": "975", "Belgium": "32", "Mexico": "52",
    "Switzerland": "41", "Spain": "34", "Sweden": "46", "South Africa": "27", "Indonesia": "62",
    "China": "86", "Egypt": "20", "Turkey": "90", "Russia": "7", "Vietnam": "84", "Poland": "48",
    "Portugal": "351", "Austria": "43", "Finland": "358", "Greece": "30", "Israel": "972",
    "Mauritius": "230", "Tanzania": "255", "Zambia": "260", "Zimbabwe": "263", "Ethiopia": "251",
    "Morocco": "212", "Jordan": "962", "Lebanon": "961", "Afghanistan": "93", "South Korea": "82",
}
HOME_CODE = "91"
INVISIBLE = "[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}\\x{FEFF}\\x{A0}]"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(phone: Column) -> Column:
    """The digits of a phone cell; empty where a spreadsheet has lost some of them."""
    s = _text(phone)
    whole = F.regexp_extract(s, "^\\s*(\\d+)\\.0+\\s*$", 1)
    return (
        F.when(s.rlike("^\\s*\\d+(?:\\.\\d+)?[eE][+-]?\\d+\\s*$"), "")
        .when((F.length(whole) >= 11) & whole.endswith("00000"), "")
        .when(whole != "", whole)
        .when(s.rlike("^\\s*\\d+\\.\\d*[1-9]\\d*\\s*$"), "")
        .otherwise(F.regexp_replace(s, "[^0-9]", ""))
    )


def _home_mobile(d: Column) -> Column:
    return d.rlike("^[6-9][0-9]{9}$")


def peel(number: Column) -> Column:
    """Without dialling prefixes that wrap a home number; foreign numbers stay as they are."""

    def step(d: Column) -> Column:
        bare = F.ltrim(d, F.lit("0"))
        wrapped = d.startswith("91") & ((F.length(d) > 12) | d.rlike("^91[6-9][0-9]{9}$"))
        trunk = d.startswith("0") & (F.length(d) > 10) & bare.rlike("^(?:91)?[6-9][0-9]{9}$")
        return F.when(wrapped, F.substr(d, F.lit(3))).when(trunk, bare).otherwise(d)

    start = F.when(number.startswith("00") & (F.length(number) > 12), F.substr(number, F.lit(3))).otherwise(number)
    # Each step that changes a number takes two digits at least, but for a trunk prefix, which comes once.
    steps = F.sequence(F.lit(0), F.floor(F.length(number) / 2).cast("int") + 1)
    peeled = F.aggregate(steps, start, lambda d, _: step(d))
    return F.when(number.startswith("00") & (F.length(number) <= 12), number).otherwise(peeled)


def is_junk_phone(d: Column) -> Column:
    d = _text(d)
    return (d != "") & (d.rlike("([0-9])\\1{6,}") | d.rlike("^([0-9])\\1*$") | d.isin(PLACEHOLDERS) | ((F.length(d) >= 10) & F.right(d, F.lit(10)).isin(PLACEHOLDERS)))


def norm_phone(phone: Column) -> Column:
    return _let(peel(digits(phone)), lambda d: F.when((F.length(d) < 7) | is_junk_phone(d), "").otherwise(d))


def bare10(d: Column) -> Column:
    """The last ten digits of a home mobile number, else null."""
    tail = F.right(d, F.lit(10))
    return F.when(d.rlike("^(?:|0|91|091|0091|9191)[6-9][0-9]{9}$") & ~is_junk_phone(tail), tail)


def phone_in_email(email: Column) -> Column:
    """The first home mobile number in the local part, else null."""
    local = F.split_part(_text(email), F.lit("@"), F.lit(1))
    runs = F.filter(F.regexp_extract_all(local, F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r).between(10, 13))
    found = F.filter(F.transform(runs, lambda r: bare10(norm_phone(r))), lambda b: b.isNotNull())
    return F.when(_text(email).contains("@"), F.get(found, F.lit(0)))


def canon_email(email: Column) -> Column:
    """Lower case, without invisible characters and blanks, with known typing errors of providers repaired; or empty."""
    plain = F.rtrim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(_text(email), INVISIBLE, ""))), " ", ""), F.lit(".,;:"))

    def repaired(e: Column) -> Column:
        local, domain = F.regexp_extract(e, "(?s)^(.*)@", 1), F.substring_index(e, "@", -1)
        first, rest = F.split_part(domain, F.lit("."), F.lit(1)), F.regexp_extract(domain, "(?s)^[^.]*(.*)$", 1)
        table = F.create_map(*(F.lit(x) for pair in DOMAIN_REPAIRS.items() for x in pair))

        def with_first(name: Column) -> Column:
            ending = F.substring_index(rest, ".", -1)
            fixed = F.when(name.isin(PROVIDERS) & ending.isin(ENDING_REPAIRS) & (rest != ""), F.regexp_replace(rest, "[^.]+$", "com")).otherwise(rest)
            return F.when((local == "") | (domain == "") | (rest == ""), "").otherwise(F.concat(local, F.lit("@"), name, fixed))

        return F.when(e.contains("@"), _let(F.coalesce(table[first], first), with_first)).otherwise("")

    return _let(plain, repaired)


def gmail_key(email: Column) -> Column:
    """Without dots and tag, for Gmail addresses; else null."""
    e = _text(email)
    local = F.regexp_replace(F.split_part(F.regexp_extract(e, "(?s)^(.*)@", 1), F.lit("+"), F.lit(1)), "\\.", "")
    return F.when(e.endswith("@gmail.com") & (local != ""), F.concat(local, F.lit("@gmail.com")))


def is_junk_email(email: Column) -> Column:
    """Addresses that many people share: disposable domains, and generic or tiny local parts of free providers."""
    raw = F.lower(F.trim(_text(email)))

    def judged(e: Column) -> Column:
        local, domain = F.regexp_extract(e, "(?s)^(.*)@", 1), F.substring_index(e, "@", -1)
        return e.contains("@") & (domain.isin(DISPOSABLE_DOMAINS) | (domain.isin(FREE_DOMAINS) & (local.isin(GENERIC_LOCALS) | (F.length(local) <= 2))))

    return _let(_let(canon_email(raw), lambda c: F.when(c == "", raw).otherwise(c)), judged)


def key_email(email: Column) -> Column:
    """The key that people are matched by, or empty."""

    def keyed(canon: Column) -> Column:
        folded = F.coalesce(gmail_key(canon), canon)
        return F.when((canon == "") | is_junk_email(canon) | is_junk_email(folded), "").otherwise(folded)

    return _let(canon_email(email), keyed)


def cc_split(country: Column, phone: Column) -> Column:
    """struct<cc, national> of a phone, by country or by its own prefix."""
    raw = F.trim(_text(phone))
    table = F.create_map(*(F.lit(x) for pair in DIAL_CODES.items() for x in pair))
    codes = F.array(*(F.lit(c) for c in sorted(set(DIAL_CODES.values()), key=lambda c: (-len(c), c))))
    pair = lambda cc, n: F.struct(cc.alias("cc"), n.alias("national"))
    plus = lambda cc: F.concat(F.lit("+"), cc)
    after = lambda d, cc: F.substr(d, F.length(cc) + 1)
    empty = F.lit("")

    def split(x: Column) -> Column:
        d, cc = x["d"], x["cc"]
        own = F.get(F.filter(codes, lambda c: d.startswith(c)), F.lit(0))
        known = cc.isNotNull() & d.startswith(F.coalesce(cc, F.lit("-")))
        return (
            F.when(d == "", pair(empty, empty))
            .when(raw.startswith("+") & known, pair(plus(cc), after(d, cc)))
            .when(raw.startswith("+") & own.isNotNull(), pair(plus(own), after(d, own)))
            .when(raw.startswith("+"), pair(empty, plus(d)))
            .when(known & (cc != HOME_CODE) & (F.length(d) > 10), pair(plus(cc), after(d, cc)))
            .when((F.length(d) == 12) & d.startswith(HOME_CODE), pair(plus(F.lit(HOME_CODE)), F.substr(d, F.lit(3))))
            .when((F.length(d) < 9) & cc.isNotNull() & (F.length(d) >= 7), pair(plus(cc), d))
            .when(F.length(d) < 9, pair(empty, raw))
            .otherwise(pair(plus(F.coalesce(cc, F.lit(HOME_CODE))), d))
        )

    return _let(F.struct(F.regexp_replace(raw, "[^0-9]", "").alias("d"), table[F.trim(_text(country))].alias("cc")), split)
