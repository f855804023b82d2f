"""Quality rules over annotations, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traincover.functions.text import first_filled, is_blank, strip
from traincover.operators.ids import positions
from traincover.session import stage

# Severities, bucket label of empty values, issue messages, list lengths of the reports.
ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"
EMPTY_LABEL = "(空)"
MESSAGE_NAME_BLANK = "实体名称为空（将无法作为文本检索目标）"
MESSAGE_ANNOTATION_BLANK = "打标结果（assistant 回答）为空"
MESSAGE_TOO_SHORT = "打标结果过短 (%d 字符 < %d)"
MESSAGE_TOO_LONG = "打标结果过长 (%d 字符 > %d)"
MESSAGE_NAME_ABSENT = "打标结果中未出现实体名称「%s」"
MESSAGE_NO_IMAGE_PATH = "图像相对路径为空"
MESSAGE_MODEL_BLANK = "打标模型名称为空"
MESSAGE_IMAGE_UNREADABLE = "图像无法从 tar 中读取"
TOP_SOURCES, TOP_FIELDS, LISTED_PROBLEMS = 15, 10, 200

# Distinct values a single task may rank.
WINDOW_VALUES = 1_000_000

DIMENSIONS = {"source": "source_name", "model": "model_name", "dataset": "source_dataset"}


def _issue(when: Column, severity: str, field: str, message: Column) -> Column:
    return F.when(
        when, F.struct(F.lit(severity).alias("severity"), F.lit(field).alias("field"), message.alias("message"))
    )


def issues(
    length: Column, min_length: int = 50, max_length: int = 20_000, image_readable: str | None = None
) -> Column:
    """ARRAY<STRUCT<severity, field, message>> of one annotation row.

    `length` is the stripped length of the annotation. `image_readable` names a BOOLEAN column.
    """
    name, text = F.col("entity_name"), F.col("annotation")
    blank = is_blank(text)
    rules = [
        _issue(is_blank(name), WARNING, "entity_name", F.lit(MESSAGE_NAME_BLANK)),
        _issue(blank, ERROR, "annotation", F.lit(MESSAGE_ANNOTATION_BLANK)),
        _issue(~blank & (length < min_length), WARNING, "annotation",
               F.format_string(MESSAGE_TOO_SHORT, length, F.lit(min_length))),
        _issue(~blank & (length > max_length), WARNING, "annotation",
               F.format_string(MESSAGE_TOO_LONG, length, F.lit(max_length))),
        _issue(~blank & ~is_blank(name) & ~F.contains(text, strip(name)), INFO, "annotation",
               F.format_string(MESSAGE_NAME_ABSENT, name)),
        _issue(F.coalesce("image_relative_path", F.lit("")) == "", ERROR, "image_relative_path",
               F.lit(MESSAGE_NO_IMAGE_PATH)),
        _issue(is_blank(F.col("model_name")), WARNING, "model_name", F.lit(MESSAGE_MODEL_BLANK)),
    ]
    if image_readable:
        rules.append(_issue(~F.col(image_readable), ERROR, "image", F.lit(MESSAGE_IMAGE_UNREADABLE)))
    return F.array_compact(F.array(*rules))


def check(rows: DataFrame, **options) -> DataFrame:
    """Add `name` (the label to show), `issues` and the flags derived from them. No row is dropped."""
    def any_of(severity: str) -> Column:
        return F.exists("issues", lambda issue: issue["severity"] == severity)

    # Stripping walks the whole text, so its length becomes a column of its own: computed once per row.
    measured = rows.withColumn("_length", F.length(strip(F.col("annotation"))))
    checked = measured.withColumn("issues", issues(F.col("_length"), **options)).drop("_length")
    return checked.withColumns({
        "name": first_filled(F.col("entity_name"), F.col("image_relative_path"), F.col("data_uuid")),
        "has_error": any_of(ERROR),
        "has_warning": any_of(WARNING),
        "is_clean": F.size("issues") == 0,
    })


def summary(checked: DataFrame) -> DataFrame:
    """One row of counters. Whatever is neither clean nor an error counts as a warning, INFO-only samples too."""
    return checked.agg(
        F.count("*").alias("total_samples"),
        F.count_if("is_clean").alias("clean_samples"),
        F.count_if("has_error").alias("error_samples"),
        F.count_if(~F.col("is_clean") & ~F.col("has_error")).alias("warning_samples"),
    )


def _ranked(counts: DataFrame) -> DataFrame:
    """Rank within each dimension: most frequent first, ties in the order of first appearance.

    A window ranks as many values as one task can sort; more than that are ranked by a distributed sort.
    """
    counts = stage(counts, "counts")
    order = [F.desc("n"), F.col("first_seen")]
    if counts.count() <= WINDOW_VALUES:
        return counts.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(*order)))
    placed = positions(counts, "dimension", *order)
    starts = placed.groupBy("dimension").agg(F.min("position").alias("start"))  # one row per dimension
    return placed.join(F.broadcast(starts), "dimension").withColumn(
        "rank", (F.col("position") - F.col("start") + 1).cast("int")
    ).drop("position", "start")


def distributions(rows: DataFrame, order: str = "global_id") -> DataFrame:
    """(dimension, value, n, rank): how often each source, model and dataset occurs. One pass for all three."""
    entries = F.array(*[
        F.struct(
            F.lit(dimension).alias("dimension"),
            F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(EMPTY_LABEL)).alias("value"),
        )
        for dimension, column in DIMENSIONS.items()
    ])
    counts = (
        rows.select(order, F.explode(entries).alias("entry"))
        .groupBy("entry.dimension", "entry.value")
        .agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    )
    return _ranked(counts).select("dimension", "value", "n", "rank")


def top_sources(rows: DataFrame, order: str = "global_id", limit: int = TOP_SOURCES) -> DataFrame:
    """The most frequent sources: (value, n)."""
    value = F.coalesce(F.nullif(F.col("source_name"), F.lit("")), F.lit(EMPTY_LABEL)).alias("value")
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(limit).select("value", "n")


def issue_fields(checked: DataFrame, order: str = "global_id") -> DataFrame:
    """(field, n, percent, rank): issues per field; a sample can add several. Percent of all samples, one decimal.

    Two small aggregates meet at the end: the fields (at most five) and the number of samples.
    """
    exploded = checked.select(order, F.posexplode_outer("issues").alias("at", "issue"))
    # The total rides along: each sample contributes exactly one row with at = 0 or no issue at all.
    counts = exploded.groupBy(F.col("issue.field").alias("field")).agg(
        F.count("*").alias("n"),
        F.min(F.struct(order, "at")).alias("first_seen"),
        F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("samples"),
    )
    total = F.greatest(F.sum("samples").over(Window.partitionBy(F.lit(1))), F.lit(1))
    shared = counts.withColumn("percent", F.round(F.col("n") * 100.0 / total, 1)).where(F.col("field").isNotNull())
    order_by = Window.orderBy(F.desc("n"), "first_seen")
    return shared.select("field", "n", "percent", F.row_number().over(order_by).alias("rank"))


def exploded_issues(checked: DataFrame, *keep: str) -> DataFrame:
    """One row per issue."""
    # The outer form keeps Catalyst from testing the size of `issues` first, which would compute every rule twice.
    return checked.select(*keep, F.inline_outer("issues")).where(F.col("severity").isNotNull())


def problems(
    checked: DataFrame, severities: tuple[str, ...] = (ERROR, WARNING), order: str = "global_id",
    limit: int | None = None,
) -> DataFrame:
    """The samples with an issue of the chosen severities, with those issues. `limit` looks at the first so many samples
    with any issue only; the report shows LISTED_PROBLEMS."""
    first = checked.where(~F.col("is_clean"))
    if limit is not None:
        first = first.orderBy(order).limit(limit)
    chosen = first.withColumn("issues", F.filter("issues", lambda issue: issue["severity"].isin(*severities)))
    return chosen.where(F.size("issues") > 0).withColumn(
        "is_error", F.exists("issues", lambda issue: issue["severity"] == ERROR)
    )


def report_text(checked: DataFrame, order: str = "global_id") -> str:
    """The summary for people. Collects one counter row and the report's own short lists."""
    rule = "=" * 60
    counters = summary(checked).first()
    by_dimension: dict[str, list] = {name: [] for name in DIMENSIONS}
    spread = distributions(checked, order)
    shown = spread.where((F.col("dimension") != "source") | (F.col("rank") <= TOP_SOURCES))
    for row in shown.orderBy("dimension", "rank").toLocalIterator():
        by_dimension[row.dimension].append(f"  {row.value}: {row.n}")
    fields = issue_fields(checked, order).where(F.col("rank") <= TOP_FIELDS).orderBy("rank").collect()
    return "\n".join([
        rule, "📋 数据集质检报告", rule,
        f"总样本数:     {counters.total_samples}",
        f"通过 (无问题): {counters.clean_samples}",
        f"警告:         {counters.warning_samples}",
        f"错误 (不可用): {counters.error_samples}",
        "", "--- 数据源分布 ---", *by_dimension["dataset"],
        "", "--- 打标模型分布 ---", *by_dimension["model"],
        "", "--- 来源分布 (Top 15) ---", *by_dimension["source"],
        "", "--- 高频问题字段 ---", *[f"  {row.field}: {row.n} 条" for row in fields],
        rule,
    ])
