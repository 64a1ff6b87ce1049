"""Page analysis from end to end, and its report tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakflow.functions import urls
from weakflow.functions.text import fixed_decimals, percent, preview, timestamp_text, tokenize
from weakflow.operators import classify, rules
from weakflow.operators.classify import NaiveBayes
from weakflow.operators.pages import page_features
from weakflow.operators.tokens import encode_sequences
from weakflow.schemas import FEATURES
from weakflow.sources.staging import stage
from weakflow.sources.tables import write_csv

DOMAIN_BUCKETS = 64


def analyze_pages(
    pages: DataFrame,
    vocab: DataFrame,
    model: NaiveBayes,
    labels: DataFrame,
    analyzed_at: Column,
    temperature: str = "length",
) -> DataFrame:
    """Features, prediction, risk and recommendations of every page.

    ``analyzed_at`` is an argument so that a run can be repeated. With a vocabulary and a
    model of bounded size the whole analysis is one pass without a shuffle.
    """
    featured = page_features(pages).withColumn("text", rules.with_keywords(rules.named_features()))
    tokens = featured.withColumn("tokens", tokenize(F.col("text")))
    scored = classify.score(encode_sequences(tokens, vocab), model)
    predicted = classify.predict(classify.probabilities(scored, temperature), labels)
    return predicted.select(
        "page_id",
        "url",
        F.col("label").alias("predicted_vulnerability"),
        "confidence",
        F.col("top").alias("top_3_predictions"),
        *FEATURES,
        rules.risk_level(F.col("confidence")).alias("risk_level"),
        rules.recommendations(
            F.col("security_headers"), F.col("headers"), F.col("forms"), F.col("label")
        ).alias("recommendations"),
        timestamp_text(analyzed_at).alias("analysis_timestamp"),
        F.lit(temperature).alias("temperature"),
    )


def _prediction(i: int) -> Column:
    top = F.get("top_3_predictions", F.lit(i))
    return F.concat(top["label"], F.lit(" ("), fixed_decimals(top["confidence"], 3), F.lit(")"))


def main_report(analysis: DataFrame) -> DataFrame:
    """One row per page, twelve report columns; a missing prediction is NULL."""
    return analysis.select(
        F.col("url").alias("URL"),
        F.col("analysis_timestamp").alias("Analysis_Timestamp"),
        F.col("risk_level").alias("Risk_Level"),
        F.col("predicted_vulnerability").alias("Predicted_Vulnerability"),
        fixed_decimals(F.col("confidence"), 4).alias("Confidence"),
        *[_prediction(i).alias(f"Top_Prediction_{i + 1}") for i in range(3)],
        (F.col("security_headers") != "").alias("Security_Headers_Present"),
        F.col("technologies").alias("Technologies_Detected"),
        (F.col("forms") != "").alias("Forms_Found"),
        F.size("recommendations").alias("Recommendations_Count"),
    )


def recommendations_report(analysis: DataFrame) -> DataFrame:
    listed = analysis.select("page_id", "url", F.posexplode("recommendations").alias("i", "Recommendation"))
    return listed.select("page_id", "url", (F.col("i") + 1).alias("Rank"), "Recommendation")


def features_report(analysis: DataFrame) -> DataFrame:
    """One row per page and feature."""
    long = analysis.select("page_id", "url", *FEATURES).unpivot(
        ["page_id", "url"], list(FEATURES), "Feature_Type", "value"
    )
    shown = F.when(F.col("value") == "", "None").otherwise(preview(F.col("value"), 500))
    return long.select("page_id", "url", "Feature_Type", shown.alias("Content"))


def technical_report(analysis: DataFrame) -> DataFrame:
    def either(column: str, yes: str, no: str) -> Column:
        return F.when(F.col(column) != "", yes).otherwise(no)

    return analysis.select(
        "page_id",
        preview(F.col("technologies"), 100).alias("Technologies_Detected"),
        either("security_headers", "Present", "Missing").alias("Security_Headers"),
        either("forms", "Yes", "No").alias("Forms_Detected"),
        either("links", "Found", "None").alias("Suspicious_Links"),
        preview(F.col("errors"), 100).alias("Error_Patterns"),
        "risk_level",
        rules.risk_colour(F.col("risk_level")).alias("risk_colour"),
    )


def details_report(analysis: DataFrame) -> DataFrame:
    return analysis.select(
        "page_id",
        F.col("url").alias("URL"),
        F.col("analysis_timestamp").alias("Analysis_Date"),
        F.col("risk_level").alias("Risk_Level"),
        F.col("predicted_vulnerability").alias("Predicted_Vulnerability"),
        percent(F.col("confidence")).alias("Confidence_Score"),
    )


def top_report(analysis: DataFrame) -> DataFrame:
    ranked = analysis.select("page_id", F.posexplode("top_3_predictions").alias("i", "t"))
    return ranked.select(
        "page_id",
        (F.col("i") + 1).alias("Rank"),
        F.col("t.label").alias("Vulnerability_Type"),
        percent(F.col("t.confidence")).alias("Confidence"),
    )


def write_reports(analysis: DataFrame, folder: str) -> None:
    """The three CSV reports; the main report is partitioned by a bucket of the domain.

    The analysis is stored once for its three readers. The number of folders is fixed, however
    many domains there are; rebalancing brings the rows of a bucket together and splits one
    that is too large for one task. The domain stays a column.
    """
    analysis = stage(analysis, "analysis")
    main = main_report(analysis).withColumn("domain", urls.domain_key(F.col("URL")))
    main = main.withColumn("bucket", F.pmod(F.xxhash64("domain"), F.lit(DOMAIN_BUCKETS)).cast("int"))
    write_csv(main.hint("rebalance", F.col("bucket")), f"{folder}/main", ["bucket"])
    write_csv(recommendations_report(analysis), f"{folder}/recommendations")
    write_csv(features_report(analysis), f"{folder}/features")
