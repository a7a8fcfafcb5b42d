"""Statements in, all result tables out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from munim.operators import aggregates as AG, anomaly as AN, clean as C, forecast as FC
from munim.operators import forest, insights as I, ledger_forest, recurring as R
from munim.operators import statement_tables as TB, statement_text as ST
from munim.operators.classify import Merchant, classify
from munim.schema import PIPELINE
from munim.session import ensure_checkpoint_dir
from munim.sources import files as L, statements as S


@dataclass(frozen=True)
class Loaded:
    """The pipeline table; every CSV line with its fate; files that gave no row, with the reason."""

    table: DataFrame
    lines: DataFrame
    rejected: DataFrame


def load(spark: SparkSession, path: str) -> DataFrame:
    """Statement files to the pipeline table."""
    return load_all(spark, path).table


def load_all(spark: SparkSession, path: str) -> Loaded:
    """Statement files of every kind, and an account of what was left out.

    CSV and other text files are read as CSV, ``.pdf.txt`` files as extracted document text.  Binary
    documents and workbooks are rejected: their text or rows have to be extracted first.  Every
    line of a CSV file is in ``lines`` once, as ``row`` if it is in the table.
    """
    ensure_checkpoint_dir(spark)
    lines = L.read_lines(spark, path).checkpoint()
    csv = lines.where("kind = 'csv'").select(S.KEY, "line_no", "line")
    rows = C.clean(S.scan_csv(csv)).checkpoint()
    text = lines.where("kind = 'document'").select(S.KEY, "line_no", "line")
    table = rows.select(PIPELINE.names)
    if not text.isEmpty():
        # Repeats are marked in documents; like those of CSV files they do not count twice.
        records = TB.document_table(records_of(text), ST.detect_issuer(text)).where("NOT is_duplicate")
        documents = C.to_pipeline(C.document_to_interchange(records)).checkpoint()
        table = table.unionByName(documents.select(PIPELINE.names))
    kept = rows.select(S.KEY, "line_no", F.lit(True).alias("_kept"))
    fates = L.line_fates(csv).join(kept, [S.KEY, "line_no"], "left").withColumn(
        "fate", F.when((F.col("fate") == L.ROW) & F.col("_kept").isNull(), L.REPEAT).otherwise(F.col("fate"))).drop("_kept")
    with_rows = lines.select(S.KEY, "path").distinct().join(table.select(S.KEY).distinct(), S.KEY)
    rejected = _files_without_rows(L.list_files(spark, path), with_rows)
    return Loaded(table, fates.join(lines.select(S.KEY, "path").distinct(), S.KEY), rejected)


def records_of(lines: DataFrame) -> DataFrame:
    """Records of document lines; cells are parted by tabs or several blanks."""
    cells = F.split(F.col("line"), r"\t| {2,}")
    return TB.parse_documents(lines.select(S.KEY, "line_no", cells.alias("cells")), lines, ST.detect_issuer(lines))


def _files_without_rows(files: DataFrame, with_rows: DataFrame) -> DataFrame:
    """(path, kind, reason) of files that gave no row; empty files are not listed.

    Paths are compared without their scheme.
    """
    bare = lambda c: F.regexp_replace(F.col(c), "^[a-z0-9]+:/*", "/")
    done = with_rows.select(bare("path").alias("_bare")).distinct()
    return files.withColumn("_bare", bare("path")).join(done, "_bare", "left_anti").select(
        "path", "kind", F.when(F.col("kind") == "binary", "not text: extract its text or rows first")
        .otherwise("no dated row").alias("reason"))


def analyse(
    table: DataFrame, merchants: Sequence[Merchant] | DataFrame | None = None, trees: int = 200
) -> dict[str, DataFrame]:
    """Every result table of a cleaned pipeline table.

    The classified and the scored table feed all others, so each is checkpointed
    once instead of being recomputed per result.
    """
    ensure_checkpoint_dir(table.sparkSession)
    classified = classify(table, merchants).checkpoint()
    scored = forest.with_credits(
        classified, ledger_forest.detect(classified, trees=trees)).checkpoint()
    forecasts = FC.forecast(scored)
    summary = FC.forecast_summary(forecasts)
    facts = I.facts(scored, summary)
    recurring = R.recurring_merchants(scored)
    return {
        "transactions": scored,
        "summary": AG.summary_stats(scored),
        "categories": AG.category_breakdown(scored),
        "month_over_month": AG.mom_by_category(scored),
        "recurring": recurring,
        "subscriptions": R.subscription_rollup(recurring),
        "anomalies": AN.top_anomalies(scored),
        "forecast": summary,
        "forecast_total": FC.forecast_total(forecasts),
        "health": I.health_score(facts),
        "insights": I.key_insights(facts),
        "story": I.story(facts),
        "advice": I.rule_advice(facts),
        "personality": I.spending_personality(scored),
    }
