"""Coverage of evaluation samples by their matches.

`facts` reduces the matches to three numbers per sample that answer every threshold: the best image score, the best
text score, and the highest threshold at which the sample's image and text matches still agree on a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traincover.sources.vectors import IMAGE, TEXT

AGREE, BOTH, ONLY_IMAGE, ONLY_TEXT, NONE = "agree", "both", "image", "text", "none"
FILTERS = ("all", ONLY_IMAGE, ONLY_TEXT, BOTH, AGREE, NONE)
# Slider steps, score bands, display labels.
THRESHOLD_STEPS = 20
BAND_HIGH, BAND_MID = 0.9, 0.7
LABELS = {
    AGREE: ("🟣", "图文一致"),
    BOTH: ("🔴", "双重匹配"),
    ONLY_IMAGE: ("🟠", "图像匹配"),
    ONLY_TEXT: ("🟡", "文本匹配"),
    NONE: ("🟢", "无匹配"),
}


def score_band(score: Column) -> Column:
    return F.when(score > BAND_HIGH, "high").when(score > BAND_MID, "mid").otherwise("low")


def facts(samples: DataFrame, matches: DataFrame) -> DataFrame:
    """Add best_image, best_text (0.0 without matches) and agree_at (NULL: no shared name) to each sample.

    `samples` carries sample_id and whatever should stay with it. A name agrees at t if both its best image score and
    its best text score reach t; empty names never agree. Matches are aggregated before they meet the samples.
    """
    def best(channel: str) -> Column:
        return F.max(F.when(F.col("channel") == channel, F.col("score")))

    by_name = matches.groupBy("sample_id", F.coalesce("text", F.lit("")).alias("name")).agg(
        best(IMAGE).alias("image"), best(TEXT).alias("text")
    )
    # Both sides present; `least` alone would skip a missing one.
    shared = (F.col("name") != "") & F.col("image").isNotNull() & F.col("text").isNotNull()
    by_sample = by_name.groupBy("sample_id").agg(
        F.max("image").alias("best_image"),
        F.max("text").alias("best_text"),
        F.max(F.when(shared, F.least("image", "text"))).alias("agree_at"),
    )
    return samples.join(by_sample, "sample_id", "left").withColumns({
        "best_image": F.coalesce("best_image", F.lit(0.0)),
        "best_text": F.coalesce("best_text", F.lit(0.0)),
    })


def hits(threshold: Column) -> dict[str, Column]:
    """The overlapping hit conditions over `facts` at a threshold."""
    image, text = F.col("best_image") >= threshold, F.col("best_text") >= threshold
    return {
        "image_hit": image,
        "text_hit": text,
        "both_hit": image & text,
        "agree": F.coalesce(F.col("agree_at") >= threshold, F.lit(False)),
        "no_hit": ~image & ~text,
    }


def category(threshold: Column) -> Column:
    """The exclusive category: the first that applies of agree, both, image, text, none."""
    met = hits(threshold)
    return (
        F.when(met["agree"], AGREE).when(met["both_hit"], BOTH).when(met["image_hit"], ONLY_IMAGE)
        .when(met["text_hit"], ONLY_TEXT).otherwise(NONE)
    )


def classify(covered: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`facts` with the hit flags and the category."""
    at = F.lit(float(threshold))
    return covered.withColumns({**hits(at), "category": category(at)})


def _counters(threshold: Column) -> list[Column]:
    met = hits(threshold)
    total = F.count("*")
    counts = {
        "image_hits": F.count_if(met["image_hit"]),
        "text_hits": F.count_if(met["text_hit"]),
        "both_hits": F.count_if(met["both_hit"]),
        "agree_hits": F.count_if(met["agree"]),
        "no_hits": F.count_if(met["no_hit"]),
    }
    columns = [total.alias("total")]
    for name, count in counts.items():
        columns.append(count.alias(name))
        # Whole percent, rounded down.
        columns.append(F.floor(count * 100 / F.greatest(total, F.lit(1))).alias(f"{name}_pct"))
    return columns


def summary(covered: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: how many samples are hit. Image and text hits include those hit by both."""
    return covered.agg(*_counters(F.lit(float(threshold))))


def sweep(covered: DataFrame, steps: int = THRESHOLD_STEPS) -> DataFrame:
    """`summary` at thresholds 0, 1/steps, ..., 1 in one pass over the samples."""
    thresholds = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    at_each = covered.withColumn("threshold", F.explode(thresholds))
    return at_each.groupBy("threshold").agg(*_counters(F.col("threshold"))).orderBy("threshold")


def filter_condition(choice: str) -> Column:
    """Which classified samples a filter shows: image, text and both overlap; agree and none are exclusive."""
    if choice not in FILTERS:
        raise ValueError(f"unknown filter {choice!r}; one of {FILTERS}")
    return {
        "all": F.lit(True), ONLY_IMAGE: F.col("image_hit"), ONLY_TEXT: F.col("text_hit"), BOTH: F.col("both_hit"),
        AGREE: F.col("category") == AGREE, NONE: F.col("category") == NONE,
    }[choice]


def filtered(classified: DataFrame, choice: str) -> DataFrame:
    return classified.where(filter_condition(choice))


def filter_membership(classified: DataFrame) -> DataFrame:
    """One row per (filter, sample) it shows, for all filters in one pass."""
    shown = F.array_compact(F.array(*[F.when(filter_condition(name), name) for name in FILTERS]))
    return classified.select("sample_id", F.explode(shown).alias("filter"))


def agreed_matches(matches: DataFrame, classified: DataFrame, threshold: float) -> DataFrame:
    """Image matches of `agree` samples whose name is also among the text matches, all at or over the threshold.

    `sequence` numbers them per sample by rank. One window over the few matches of a sample replaces a self-join.
    """
    over = matches.where((F.col("score") >= threshold) & (F.coalesce("text", F.lit("")) != ""))
    same_name = Window.partitionBy("sample_id", "text")
    agreed = (
        over.withColumn("_in_text", F.max(F.col("channel") == TEXT).over(same_name))
        .where((F.col("channel") == IMAGE) & F.col("_in_text")).drop("_in_text")
        .join(classified.where(F.col("category") == AGREE).select("sample_id"), "sample_id", "left_semi")
    )
    by_rank = Window.partitionBy("sample_id").orderBy("rank")
    return agreed.withColumn("sequence", F.row_number().over(by_rank))


def shown_hidden(matches: DataFrame, threshold: float) -> DataFrame:
    """(sample_id, channel, n_shown, n_hidden): matches at or over the threshold, and the ones below it."""
    shown = F.col("score") >= threshold
    return matches.groupBy("sample_id", "channel").agg(
        F.count_if(shown).alias("n_shown"), F.count_if(~shown).alias("n_hidden")
    )


def overview(classified: DataFrame, text: str = "query_text", stem: str = "sample_id") -> DataFrame:
    """The overview table: stem, text, both best scores to four places, category. Best image score first."""
    return classified.select(
        F.col(stem).alias("stem"),
        F.coalesce(F.nullif(F.col(text), F.lit("")), F.lit("-")).alias("text"),
        F.round("best_image", 4).alias("best_image"),
        F.round("best_text", 4).alias("best_text"),
        "category",
    ).orderBy(F.desc("best_image"), "stem")
