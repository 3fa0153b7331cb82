"""Two-axis lexicon classifier: what the text says, and whether its context bears it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.functions.text import first_hit, squeeze_for_match, without
from newsgraph.lexicon import Lexicon

TEXT_LISTS = ("decisive", "test_strong", "test_weak", "checkpoint_strong", "checkpoint_weak", "driving", "enforcement", "crash", "alcohol", "campaign", "negative", "evergreen")


def _any_source(source: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: F.contains(source, t))


def classify(articles: DataFrame, words: Lexicon, title: str = "title", summary: str = "summary", source: str = "source") -> DataFrame:
    """``articles`` with ``passed, confidence, reason``; confidence is high, medium or none.

    In steps: the normalised texts, the first hit of each list in them, the verdict. A null title,
    summary or source is an empty one. Every list is searched once, so plans stay small.
    """
    short = without(squeeze_for_match(F.coalesce(title, F.lit(""))), words.place_guard)
    full = without(squeeze_for_match(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")))), words.place_guard)
    texts = articles.withColumns({"_short": short, "_full": full, "_source": F.lower(F.coalesce(source, F.lit("")))})
    hits = {f"_{name}": first_hit(F.col("_full"), getattr(words, name)) for name in TEXT_LISTS}
    hits |= {"_in_title": first_hit(F.col("_short"), words.decisive), "_soft": _any_source(F.col("_source"), words.soft_block), "_hard": _any_source(F.col("_source"), words.hard_block)}
    found = texts.withColumns(hits)

    hit = lambda name: F.col(f"_{name}")
    has = lambda *names: F.coalesce(*[hit(n) for n in names]).isNotNull()
    verdict = lambda level, label, name: F.struct(F.lit(level).alias("level"), F.concat(F.lit(f"{label}: "), hit(name)).alias("why"))
    ladder = (
        F.when(has("in_title"), verdict("high", "dui-title", "in_title"))
        .when(has("test_strong"), verdict("high", "alcotest", "test_strong"))
        .when(has("checkpoint_strong"), verdict("high", "checkpoint", "checkpoint_strong"))
        .when(has("decisive"), verdict("medium", "dui-body", "decisive"))
        .when(has("test_weak") & has("driving", "enforcement", "checkpoint_weak"), verdict("high", "alcotest-weak", "test_weak"))
        .when(has("checkpoint_weak") & has("alcohol") & has("driving", "enforcement"), verdict("medium", "checkpoint-weak", "checkpoint_weak"))
        .when(has("alcohol") & has("driving") & has("crash", "enforcement"), verdict("medium", "alcohol+driving", "alcohol"))
        .when(has("campaign") & has("driving"), verdict("medium", "campaign", "campaign"))
    )
    judged = found.withColumn("_verdict", ladder)
    level = F.col("_verdict.level")
    lowered = (level == "high") & (has("evergreen") | hit("soft"))
    notes = F.concat(F.when(has("evergreen"), F.concat(F.lit(" +evergreen: "), hit("evergreen"))).otherwise(""), F.when(hit("soft"), F.lit(" +social")).otherwise(""))
    vetoed = has("negative") & ~has("decisive")
    out = judged.withColumns(
        {
            "passed": ~hit("hard") & ~vetoed & level.isNotNull(),
            "confidence": F.when(hit("hard") | vetoed | level.isNull(), "none").when(lowered, "medium").otherwise(level),
            "reason": F.when(hit("hard"), F.concat(F.lit("blocked source: "), F.col(source)))
            .when(vetoed, F.concat(F.lit("negative: "), hit("negative")))
            .when(level.isNull(), "no matching criteria")
            .otherwise(F.concat(F.col("_verdict.why"), F.when(lowered, notes).otherwise(""))),
        }
    )
    return out.drop("_short", "_full", "_source", "_verdict", *hits)
