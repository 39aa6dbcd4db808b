"""Findings, recommended steps and modelling challenges as rows, and the report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscope.functions.text import byte_size, thousands
from tabscope.operators.charts import histograms, missing_matrix
from tabscope.operators.classes import class_imbalance
from tabscope.operators.column_stats import worst_missing
from tabscope.operators.correlation import correlation_matrix, correlations, heatmap_columns
from tabscope.operators.summary import summary_wide
from tabscope.plans.profile import Profile, build_profile, profile_record
from tabscope.session import stage_table
from tabscope.sources.csv_tables import load_csv, load_day
from tabscope.sources.tables import write_csv, write_record, write_text

TOP = 5
FINDINGS = (
    "missing",
    "infinite",
    "duplicate",
    "constant",
    "low_variance",
    "correlated",
    "imbalance",
)


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Item rows numbered from 1; at most one row per column, pair or class."""
    return df.withColumn("item", F.row_number().over(Window.orderBy(*order)))


def _rows(df: DataFrame, finding: str, subject, count, value, item=None) -> DataFrame:
    return df.select(
        F.lit(FINDINGS.index(finding) + 1).alias("ord"),
        F.lit(finding).alias("finding"),
        (F.col("item") if item is None else F.lit(item)).cast("int").alias("item"),
        subject.alias("subject"),
        count.cast("long").alias("count"),
        value.cast("double").alias("value"),
    )


def _total(df: DataFrame, finding: str) -> DataFrame:
    """The heading row of a finding; 'none observed' for an empty one."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    subject = F.when(F.col("n") == 0, "none observed").otherwise("total")
    return _rows(n, finding, subject, F.col("n"), F.lit(None), 0)


def quality_findings(profile: Profile) -> DataFrame:
    """``(ord, finding, item, subject, count, value)``: heading rows have item 0."""
    none, name = F.lit(None), F.col("column")
    worst = _ranked(worst_missing(profile.columns, TOP), F.desc("count"), F.col("ord"))
    infinite = _ranked(profile.infinite, F.desc("count"), F.col("ord"))
    constant = _ranked(profile.constant, F.col("ord"))
    low = _ranked(profile.low_variance, F.col("ord"))
    strong = _ranked(
        profile.correlated, F.abs("correlation").desc(), F.col("ord_a"), F.col("ord_b")
    ).filter(F.col("item") <= TOP)
    pair = F.concat_ws(" <-> ", "feature_a", "feature_b")
    parts = [
        _total(profile.missing, "missing"),
        _rows(worst, "missing", name, F.col("count"), F.col("pct")),
        _total(profile.infinite, "infinite"),
        _rows(infinite, "infinite", name, F.col("count"), none),
        _rows(
            profile.duplicates,
            "duplicate",
            F.lit("total"),
            F.col("duplicate_rows"),
            F.col("duplicate_pct"),
            0,
        ),
        _total(profile.constant, "constant"),
        _rows(constant, "constant", name, none, none),
        _total(profile.low_variance, "low_variance"),
        _rows(low, "low_variance", name, none, F.col("variance")),
        _total(profile.correlated, "correlated"),
        _rows(strong, "correlated", pair, none, F.col("correlation")),
    ]
    if profile.classes is not None:
        ratio = class_imbalance(profile.classes)
        tenth = F.round("ratio", 1)
        parts += [
            _rows(ratio, "imbalance", F.lit("total"), F.col("n_classes"), tenth, 0),
            _rows(ratio, "imbalance", F.col("majority"), F.col("majority_count"), none, 1),
            _rows(ratio, "imbalance", F.col("minority"), F.col("minority_count"), none, 2),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _counts(profile: Profile) -> dict[str, int]:
    return {
        "constant": profile.constant.count(),
        "infinite": profile.infinite.count(),
        "missing": profile.missing.count(),
        "duplicate": profile.duplicates.first().duplicate_rows,
        "low_variance": profile.low_variance.count(),
        "correlated": profile.correlated.count(),
        "classes": 0 if profile.classes is None else profile.classes.count(),
    }


def recommended_steps(profile: Profile) -> DataFrame:
    """Numbered steps; a step appears only if its finding does."""
    n = _counts(profile)
    rules = [
        ("drop constant columns", n["constant"], n["constant"] > 0),
        ("make infinite values missing, then impute", n["infinite"], n["infinite"] > 0),
        ("impute or drop missing values", n["missing"], n["missing"] > 0),
        ("remove duplicate rows before splitting", n["duplicate"], n["duplicate"] > 0),
        ("review low-variance columns", n["low_variance"], n["low_variance"] > 0),
        ("reduce correlated columns", n["correlated"], n["correlated"] > 0),
        ("encode the label and scale the features", None, True),
        ("address class imbalance", n["classes"], n["classes"] > 1),
    ]
    due = [(text, amount) for text, amount, applies in rules if applies]
    rows = [(i, text, amount) for i, (text, amount) in enumerate(due, start=1)]
    return profile.columns.sparkSession.createDataFrame(
        rows, "step int, action string, affected long"
    )


def modelling_challenges(profile: Profile) -> DataFrame:
    """``(ord, challenge, value)`` in the order of the report."""
    n = _counts(profile)
    ratio = None
    if n["classes"] > 1:
        ratio = class_imbalance(profile.classes).select(F.round("ratio", 1)).first()[0]
    rules = [
        ("class imbalance", ratio, n["classes"] > 1),
        ("multicollinearity", float(n["correlated"]), n["correlated"] > 0),
        ("columns against rows", float(profile.n_rows), True),
        ("infinite and missing values", float(n["infinite"] + n["missing"]),
         n["infinite"] + n["missing"] > 0),
        ("transfer beyond the capture window", None, True),
    ]
    due = [(text, value) for text, value, applies in rules if applies]
    rows = [(i, text, value) for i, (text, value) in enumerate(due, start=1)]
    return profile.columns.sparkSession.createDataFrame(
        rows, "ord int, challenge string, value double"
    )


def report_text(profile: Profile, name: str) -> str:
    """The findings as one Markdown text."""
    spark = profile.columns.sparkSession
    head = (
        spark.createDataFrame([(profile.n_rows, profile.size_bytes)], "n long, b long")
        .select(thousands(F.col("n")).alias("n"), byte_size(F.col("b")).alias("b"))
        .first()
    )
    lines = [
        f"# Profile of {name}",
        "",
        f"{head.n} rows, {profile.n_cols} columns, about {head.b}.",
        "",
        "## Data quality",
        "",
    ]
    shown = quality_findings(profile).withColumn("n", thousands(F.col("count")))
    for r in shown.orderBy("ord", "item").collect():
        facts = [str(x) for x in (r.n, r.value) if x is not None]
        title = r.finding.replace("_", " ")
        text = f"**{title}**: {r.subject}" if r.item == 0 else f"`{r.subject}`"
        lines.append(("- " if r.item == 0 else "  - ") + ", ".join([text, *facts]))
    lines += ["", "## Steps before training", ""]
    for r in recommended_steps(profile).orderBy("step").collect():
        lines.append(f"{r.step}. {r.action}" + ("" if r.affected is None else f" ({r.affected:,})"))
    lines += ["", "## Challenges for a model", ""]
    for r in modelling_challenges(profile).orderBy("ord").collect():
        lines.append(f"- {r.challenge}" + ("" if r.value is None else f" ({r.value:,.1f})"))
    return "\n".join(lines) + "\n"


def profile_job(
    df: DataFrame,
    output: str,
    *,
    label: str = "Label",
    name: str = "table",
    key: str | None = None,
    **options,
) -> dict[str, str]:
    """Profile ``df`` and write record, tables, chart data and report below ``output``."""
    spark = df.sparkSession
    profile = build_profile(df, label, **options)
    columns = [r["column"] for r in profile.summary.orderBy("ord").select("column").collect()]
    charted = heatmap_columns(df, profile.columns)
    pairs = profile.pairs
    if len(charted) < len(columns):
        pairs = correlations(df, charted)
    written = {"profile_json": write_record(spark, profile_record(profile), f"{output}/profile")}
    if columns:
        wide = summary_wide(profile.summary, columns).orderBy("ord").drop("ord")
        written["summary_csv"] = write_csv(wide, f"{output}/summary_statistics")
    strong = profile.correlated.select("feature_a", "feature_b", "correlation")
    written["pairs_csv"] = write_csv(strong, f"{output}/correlation_pairs")
    charts = {
        "histograms": histograms(df, profile.columns),
        "missing_matrix": missing_matrix(df, key),
    }
    if len(charted) > 1:
        charts["correlation_matrix"] = correlation_matrix(pairs, profile.columns, charted)
    if profile.classes is not None:
        charts["class_counts"] = profile.classes
    for chart, table in charts.items():
        written[chart] = f"{output}/charts/{chart}"
        table.coalesce(1).write.mode("overwrite").parquet(written[chart])
    written["report"] = write_text(spark, report_text(profile, name), f"{output}/report")
    return written


def profile_csv(spark: SparkSession, path: str, output: str, **options) -> dict[str, str]:
    """Profile one CSV. It is parsed into a columnar table first: the passes
    then read only the columns they need instead of every line."""
    return profile_job(stage_table(load_csv(spark, path), "profiled"), output, **options)


def profile_day(
    spark: SparkSession, day: str, output: str, *, raw_dir: str, **options
) -> dict[str, str]:
    """Profile a catalogued capture day."""
    table = stage_table(load_day(spark, day, raw_dir=raw_dir), "profiled")
    return profile_job(table, output, **{"name": day, **options})
