"""Phrase banks: what a person's messages hit, and the weighted dimensions of it."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns of text that was pasted from elsewhere.  One of the first, or two of the others.
STRONG_PASTE = "(?iu)(?:•\\s*)?\\b\\d+\\s*(?:mo|min|mins|hr|hrs|sec|secs|d|h|w|y)\\s+ago\\b"
WEAK_PASTE = [
    "(?iu)\\b(?:u/|r/)[A-Za-z0-9_]{3,}\\b",
    "(?iu)\\b\\d+\\s+(?:upvotes?|downvotes?|likes?|repl(?:y|ies)|comments?|shares?)\\b",
    "(?iu)\\b(?:upvote|downvote|reblog|retweet|original poster)\\b",
    "(?iu)\\b(?:originally posted|posted by|read more|show more|see more)\\b",
    "(?iu)★|⭐|\\b[0-5](?:\\.\\d)?\\s*/\\s*5\\b",
    "(?iu)\\b\\d+\\s*(?:day|days|hour|hours|week|weeks|month|months|year|years)\\s+ago\\b",
    "\\b[A-Z][a-z]+[A-Z][A-Za-z]*\\d{2,}\\b",
]
WORD = "[a-z']+|[\\p{L}\\p{N}&&[^\\p{Nd}a-z_]]+"


class Banks:
    """phrase_banks, negativity_patterns, noise_exact, buying_categories and dimensions of a configuration.

    An empty bank or a blank pattern would match every message, so it is refused by name.
    """

    def __init__(self, config: dict):
        lists = {**config["phrase_banks"], "negativity_patterns": config["negativity_patterns"]}
        for name, patterns in lists.items():
            if not patterns or any(not str(p).strip() for p in patterns):
                raise ValueError(f"phrase bank {name!r} is empty or has a blank pattern, which would match every message")
            for p in patterns:
                re.compile(p)
        self.banks = {name: "|".join(p) for name, p in config["phrase_banks"].items()}
        self.negative = "|".join(config["negativity_patterns"])
        self.noise = list(config["noise_exact"])
        self.buying = [c for c in config["buying_categories"] if c in self.banks]
        self.dimensions = {name.split("_")[0]: (d["weights"], d["max"]) for name, d in config["dimensions"].items()}

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Banks:
        """From a JSON file that Spark can read."""
        return cls(json.loads(spark.read.text(path, wholetext=True).first()[0]))


def is_pasted(message: Column) -> Column:
    weak = sum((message.rlike(p).cast("int") for p in WEAK_PASTE[1:]), message.rlike(WEAK_PASTE[0]).cast("int"))
    return message.rlike(STRONG_PASTE) | (weak >= 2)


def is_noise(low: Column, noise: list[str]) -> Column:
    return low.isin(noise) | (F.length(low) <= 2) | (low.rlike("^(?:\\p{Nd}|[^\\p{L}\\p{N}_])+$") & ~low.rlike("[0-9]{3,}"))


def message_hits(messages: DataFrame, message: str, banks: Banks) -> DataFrame:
    """The rows with noisy, negative, pasted, meaningful and a boolean ``hit_<bank>`` for each bank."""
    m = F.trim(F.coalesce(F.col(message), F.lit("")))
    rows = messages.withColumn("_m", m).filter("_m <> ''").withColumn("_low", F.lower("_m"))
    rows = rows.withColumns({"noisy": is_noise(F.col("_low"), banks.noise), "negative": F.col("_low").rlike(banks.negative), "pasted": is_pasted(F.col("_m"))})
    rows = rows.withColumn("meaningful", ~F.col("noisy") & (F.regexp_count("_low", F.lit(WORD)) >= 2))
    hit = {f"hit_{name}": ~F.col("noisy") & F.col("_low").rlike(p) for name, p in banks.banks.items()}
    return rows.withColumns(hit).drop("_m", "_low")


def dimension_scores(messages: DataFrame, person: str, message: str, banks: Banks) -> DataFrame:
    """person, the dimensions, mean, intent, neg, pos, pasted, pasted_blocked and cat (map of hits by bank).

    A bank counts once for a dimension however many messages hit it; pasted messages credit nothing.  One shuffle, with the
    counts summed before it.
    """
    rows = message_hits(messages, message, banks)
    own = lambda name: F.col(f"hit_{name}") & ~F.col("pasted") & (~F.col("negative") if name == "pos" else F.lit(True))
    some = lambda names, f: F.greatest(*(f(n) for n in names), F.lit(False))
    counts = {name: F.count_if(own(name)).alias(f"n_{name}") for name in banks.banks}
    grouped = rows.groupBy(person).agg(
        F.count_if("meaningful").alias("mean"),
        F.count_if(some(banks.buying, own)).alias("intent"),
        F.count_if("negative").alias("neg"),
        F.count_if("pasted").alias("pasted"),
        F.count_if(F.col("pasted") & some([c for c in banks.buying if c != "pos"], lambda n: F.col(f"hit_{n}"))).alias("pasted_blocked"),
        *counts.values(),
    )
    score = lambda weights, most: F.least(F.lit(most), sum((F.when(F.col(f"n_{c}") > 0, w).otherwise(0) for c, w in weights.items() if c in banks.banks), F.lit(0)))
    pairs = F.map_filter(F.create_map(*(x for name in banks.banks for x in (F.lit(name), F.col(f"n_{name}")))), lambda _, n: n > 0)
    positive = F.col("n_pos") if "pos" in banks.banks else F.lit(0).cast("long")
    return grouped.select(person, *(score(w, most).alias(d) for d, (w, most) in banks.dimensions.items()), "mean", "intent", "neg", positive.alias("pos"), "pasted", "pasted_blocked", pairs.alias("cat"))
