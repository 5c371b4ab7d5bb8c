"""Answers to a table of spend questions in one plan."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions import calendar as cal
from spendlake.functions.jurisdiction import canonical_source, detect_source
from spendlake.functions.money import format_money
from spendlake.functions.questions import answer_text, context_text, fallback_keyword, parse_question
from spendlake.functions.text import blank_to_null
from spendlake.operators.batch import batch_total_spend
from spendlake.operators.entities import best_candidates
from spendlake.operators.filters import lookback_start
from spendlake.session import staged


def question_filters(questions: DataFrame, catalog: DataFrame, now: date, lookback: int = cal.DEFAULT_LOOKBACK) -> DataFrame:
    """One filter per question.

    The source is the given hint, else the jurisdiction named in the text, else all. A question
    in no known phrasing is searched by keyword, narrowed to the best-matching supplier.
    """
    hint = blank_to_null("source") if "source" in questions.columns else F.lit(None).cast("string")
    parsed = questions.select(
        "question_id", "text",
        parse_question("text").alias("_q"),
        F.coalesce(F.when(hint.isNotNull(), canonical_source(hint)), detect_source("text")["source"]).alias("source"),
    ).select(
        "question_id", "text", "source", F.col("_q.company").alias("company"), F.col("_q.agency").alias("agency")
    )
    understood = F.col("company").isNotNull() | F.col("agency").isNotNull()
    parsed = parsed.withColumn("keyword", F.when(~understood, fallback_keyword("text")))
    unknown = parsed.where(F.col("keyword").isNotNull()).select("question_id", F.col("keyword").alias("_text"), "source")
    best = best_candidates(unknown, catalog, "company", "question_id", "_text", source="source").select(
        "question_id", F.col("name").alias("_name"), F.col("source").alias("_source")
    )
    start = F.lit(lookback_start(now, lookback)).cast("timestamp")
    return parsed.join(best, "question_id", "left").select(
        F.col("question_id").alias("filter_id"), "text", "keyword",
        F.coalesce("company", "_name").alias("company"), "agency",
        F.coalesce("_source", "source").alias("source"),
        start.alias("start"), F.lit(now).cast("timestamp").alias("end"),
    )


def answer_questions(
    questions: DataFrame, notices: DataFrame, catalog: DataFrame, now: date, lookback: int = cal.DEFAULT_LOOKBACK
) -> DataFrame:
    """question_id, company, agency, keyword, source, contracts, total and the sentence.

    Questions without any searchable term get no answer text.
    """
    filters = staged(question_filters(questions, catalog, now, lookback), "questions")
    totals = batch_total_spend(filters, notices, with_keywords=True, catalog=catalog)
    joined = filters.join(totals, "filter_id")
    subject = F.coalesce("company", F.when(F.col("agency").isNull(), F.col("keyword")))
    years, shown = F.lit(lookback), format_money("total")
    return joined.select(
        F.col("filter_id").alias("question_id"), "company", "agency", "keyword", "source", "contracts",
        F.col("total").cast("double").alias("total_spend"),
        answer_text(subject, F.col("agency"), F.col("source"), years, shown).alias("answer"),
        context_text(subject, F.col("agency"), F.col("source"), years, shown).alias("context"),
    )
