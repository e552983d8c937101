"""Ordered rules: the first that fails names a row's exclusion, with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses and the rules they fail.
STATUS_RULES = {"no_feed_url": "R1", "feed_unreachable": "R2", "feed_unparseable": "R3", "no_audio": "R4"}


def first_failing_rule(df: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """df with rule and evidence of the first (name, predicate, evidence) that holds; NULL rows passed."""
    hit = F.coalesce(*[F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(n).alias("rule"), e.cast("string").alias("evidence"))) for n, p, e in rules])
    return df.withColumn("_hit", hit).withColumns({"rule": F.col("_hit.rule"), "evidence": F.col("_hit.evidence")}).drop("_hit")


def first_term(text: Column, terms: list[str]) -> Column:
    """The first term, in list order, that stands as whole words in text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(r"\b\Q" + t + r"\E\b"), F.lit(t)) for t in terms], F.lit(None).cast("string"))


def first_pattern(text: Column, patterns: list[str]) -> Column:
    """struct(pattern, found) of the first pattern that matches."""
    none = F.lit(None).cast("struct<pattern:string,found:string>")
    return F.coalesce(*[F.when(text.rlike(p), F.struct(F.lit(p).alias("pattern"), F.regexp_extract(text, p, 0).alias("found"))) for p in patterns], none)


def not_english(lang: Column) -> Column:
    tag = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    return (tag != "") & ~tag.startswith("en")


def inclusion_rules(terms: list[str], patterns: list[str], exceptions: list[int], manual: dict[int, str], min_hours: float) -> list[tuple[str, Column, Column]]:
    """R1 to R6 over show_id, status, error, publisher, show_name, rss_description, rss_author, rss_language, hours_available."""
    free = ~F.col("show_id").isin(*exceptions) if exceptions else F.lit(True)
    by_hand = F.lit(None).cast("string")
    for key, why in manual.items():
        by_hand = F.when(F.col("show_id") == key, F.lit(why)).otherwise(by_hand)
    term = first_term(F.col("publisher"), terms)
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("show_name", "rss_description", "rss_author")]))
    found = first_pattern(text, patterns)
    frame = "R5_non_us_politics"
    rules = [(f"{r}_{s}", F.col("status") == s, F.coalesce("error", F.lit(""))) for s, r in STATUS_RULES.items()]
    rules.append((frame, free & by_hand.isNotNull(), F.concat(F.lit("curated list: "), by_hand)))
    rules.append((frame, free & term.isNotNull(), F.concat(F.lit("publisher matches blocklist term '"), term, F.lit("' ("), F.col("publisher"), F.lit(")"))))
    rules.append((frame, free & not_english(F.col("rss_language")), F.concat(F.lit("rss_language='"), F.col("rss_language"), F.lit("' (non-English feed)"))))
    rules.append((frame, free & found.isNotNull(), F.concat(F.lit("title/description matches /"), found["pattern"], F.lit("/ ('"), found["found"], F.lit("')"))))
    short = F.concat(F.col("hours_available").cast("string"), F.lit(f" h available < {min_hours} h threshold"))
    rules.append(("R6_insufficient_catalog", F.col("hours_available") < min_hours, short))
    return rules
