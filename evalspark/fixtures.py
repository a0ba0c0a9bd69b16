"""Stand-ins for the record shapes the operators work on, built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.plans.storage import spread, use_all_cores

# Raters with the bounds (two hex digits of an md5) below which a
# rater gets the name or the unit wrong.
RATERS = [
    ("m0", "08", "04"),
    ("m1", "60", "20"),
    ("m2", "04", "02"),
    ("m3", "02", "02"),
    ("m4", "18", "04"),
    ("m5", "30", "08"),
]
MODELS = [r[0] for r in RATERS]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
FIELDS = [
    "activity_name",
    "geography",
    "reference_product_name",
    "reference_product_unit",
]
FEATURES7 = [f"f{i:02d}" for i in range(7)]
FEATURES64 = [f"f{i:02d}" for i in range(64)]
PLANTED = ["f00", "f01"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_all_cores(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = use_all_cores(table(spark, sf_dir, "part"), by_files=True)
    nation = table(spark, sf_dir, "nation")
    unit = F.col("p_size") % 4
    return part.join(
        F.broadcast(nation), F.col("p_partkey") % 25 == F.col("n_nationkey")
    ).select(
        F.col("p_partkey").alias("activity_uuid"),
        F.concat("p_name", F.lit(", "), F.lower("p_type"), F.lit(" production")).alias("activity_name"),
        F.col("n_name").alias("geography"),
        F.col("p_brand").alias("reference_product_name"),
        F.when(unit == 0, "kg").when(unit == 1, "m3").when(unit == 2, "kWh").otherwise("unit")
        .alias("reference_product_unit"),
        F.col("p_size").alias("reference_product_amount"),
    )


def answers(spark: SparkSession, sf_dir: str, salt: str = "") -> DataFrame:
    """Long answer store: one raw answer per case and rater."""
    raters = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(n).alias("name_thr"), F.lit(u).alias("unit_thr"))
            for m, n, u in RATERS
        ]
    )

    def draw(what: str):
        return F.md5(
            F.concat(F.col("activity_uuid").cast("string"), F.lit("|"), F.col("model"), F.lit(f"|{what}{salt}"))
        )

    x = (
        activities(spark, sf_dir)
        .withColumn("r", F.explode(raters))
        .select("*", "r.*")
        .withColumn("h1", draw("name"))
        .withColumn("h2", draw("unit"))
        .withColumn("h3", draw("form"))
    )
    name = (
        F.when(F.col("h1") < F.col("name_thr"), "unknown")
        .when(F.col("h1") > "f0", F.concat(F.lit(" "), F.upper("activity_name")))
        .otherwise(F.col("activity_name"))
    )
    unit = F.when(F.col("h2") < F.col("unit_thr"), "kilogram").otherwise(F.col("reference_product_unit"))
    body = F.concat(
        F.lit('{"activity_name": "'), name,
        F.lit('", "geography": "'), F.col("geography"),
        F.lit('", "reference_product_name": "'), F.col("reference_product_name"),
        F.lit('", "reference_product_unit": "'), unit,
        F.lit('"}'),
    )
    x = x.withColumn("body", body)
    h3 = F.col("h3")
    raw = (
        F.when(h3 < "05", F.lit(None).cast("string"))
        .when(h3 < "08", "")
        .when(h3 < "0c", F.substring("body", 1, 25))
        .when(h3 < "0e", "[1, 2]")
        .when(h3 < "10", F.concat("body", F.lit(" Hope this helps")))
        .when(h3 < "50", F.concat(F.lit("```json\n"), "body", F.lit("\n```")))
        .otherwise(F.col("body"))
    )
    return x.select(F.col("activity_uuid").alias("case_id"), "model", raw.alias("raw"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activities(spark, sf_dir).select(
        F.col("activity_uuid").alias("case_id"), F.struct(*FIELDS).alias("ground_truth")
    )


def features7(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    line = table(spark, sf_dir, "lineitem")
    # Line items are summed before the join, so one part's lines never meet in one task.
    sums = line.groupBy(F.col("l_partkey").alias("row_id")).agg(
        F.count("*").cast("double").alias("f00"),
        F.sum("l_quantity").alias("f01"),
        F.avg("l_extendedprice").alias("f02"),
        F.avg("l_discount").alias("f03"),
        F.avg("l_tax").alias("f04"),
    )
    return sums.join(
        part.select(
            F.col("p_partkey").alias("row_id"),
            F.col("p_retailprice").alias("f05"),
            F.col("p_size").cast("double").alias("f06"),
        ),
        "row_id",
    )


def named_features7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features7(spark, sf_dir).join(
        activities(spark, sf_dir).withColumnRenamed("activity_uuid", "row_id"), "row_id"
    )


def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.col("label").alias("cluster"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(FEATURES64)],
    )


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = use_all_cores(table(spark, sf_dir, "part").select("p_partkey"), by_files=True)
    i = keys.select(F.col("p_partkey").alias("row_id"), F.col("p_partkey").alias("id"))
    i_ = F.col("id")
    far = i_ % 101 == 100
    return i.select(
        "row_id",
        (i_ % 4).cast("int").alias("truth"),
        F.when(far, ((i_ * 3737) % 20011) / F.lit(100.0) - 100)
        .otherwise(10 * (i_ % 2) + ((i_ * 7919) % 99991) / F.lit(99991.0)).alias("f00"),
        F.when(far, ((i_ * 5353) % 20011) / F.lit(100.0) - 100)
        .otherwise(5 * (i_ % 4 - i_ % 2) + ((i_ * 104729) % 99989) / F.lit(99989.0)).alias("f01"),
    )


def separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four clusters of ``planted`` without the far points."""
    return planted(spark, sf_dir).filter(F.col("row_id") % 101 != 100)


RUBRIC_PHRASES = [
    "The Goal of this study.", "Its intended use is open.", "For stakeholders.", "Per functional unit.", "Cradle-to-gate.", "One limitation.",
    "No comparative assertions.", "Allocation by mass.", "Capital goods left out.", "See ISO 14040.", "goalkeeper", "",
]


def rubric_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that end in one or two phrases of the rubric, by their number."""
    phrases = F.array(*[F.lit(p) for p in RUBRIC_PHRASES])
    n = len(RUBRIC_PHRASES)
    some = F.concat_ws(" ", phrases[(F.col("case_id") % n).cast("int")], phrases[(F.col("case_id") % 7).cast("int")])
    return drafts(spark, sf_dir).withColumn("draft", F.concat_ws(" ", "draft", some))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("case_id"), F.col("source").alias("model"), F.col("text").alias("draft")
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day, for each event type, whether it happened: long 0/1 table."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("|"), F.date_format("ts", "yyyy-MM-dd")).alias("case_id"),
        "event_type",
    )
    # Users and days are few bytes and many groups: merged into one task, they would not fit.
    seen = (
        spread(events, "case_id")
        .groupBy("case_id")
        .agg(*[F.max((F.col("event_type") == t).cast("int")).alias(t) for t in EVENT_TYPES])
    )
    return seen.unpivot(["case_id"], EVENT_TYPES, "model", "correct")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """features7 with two columns turned to text, some of them not numbers."""
    f = features7(spark, sf_dir)
    h = F.md5(F.col("row_id").cast("string"))
    return f.withColumn(
        "f05",
        F.when(h < "08", "n/a").when(h < "0c", "").when(h < "10", "nan").otherwise(
            F.col("f05").cast("decimal(18,2)").cast("string")
        ),
    ).withColumn("f06", F.when(h > "e0", None).otherwise(F.col("f06").cast("int").cast("string")))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their given cluster and two threshold flags."""
    w = wide_features(spark, sf_dir)
    return w.select(
        "row_id", "cluster", F.concat(F.lit("v"), (F.col("row_id") % 37).cast("string")).alias("name"),
        (F.col("f00") > 0.15).alias("flag_a"), (F.col("f01") > 0.12).alias("flag_b"),
    )
