"""Text descriptions of records and the request table made from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import amount_text, phrase_of

# Sentences and codes that the descriptions must contain word for word.
QUOTED = (
    "This life cycle inventory dataset covers the activity '{activity_name}', located in the "
    "region '{geography}'. It produces {reference_product_amount} {reference_product_unit} of "
    "'{reference_product_name}' as its reference product."
)
PARAPHRASED = (
    "An industrial process record describes operations related to {activity_name_lower}. This "
    "process is documented as taking place in {geography_phrase}. The output of this process, "
    "when measured, comes to {reference_product_amount} units (specifically "
    "{reference_product_unit}) of a product known as {reference_product_name_lower}. Based on "
    "this record, identify the underlying process/activity name (matching {standard}'s standard "
    "naming), the applicable {standard} geography code (not the plain-language region name given "
    "above), the resulting product name, and its unit of measure."
)
UNKNOWN_REGION = "the region coded %s"
REGIONS = {
    "GLO": "worldwide",
    "RoW": "the rest of the world",
    "RER": "the European region",
    "CH": "Switzerland",
    "US": "the United States",
    "JP": "Japan",
    "MA": "Morocco",
    "CN": "China",
    "DE": "Germany",
    "FR": "France",
    "GB": "the United Kingdom",
    "CA": "Canada",
    "IN": "India",
    "BR": "Brazil",
    "AU": "Australia",
}
EXTRACT_REQUEST = "Extract the fields from this description:\n\n{description}"
IDENTIFY_REQUEST = "Identify the fields from this description:\n\n{description}"


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """Put columns into the ``{name}`` places of a template."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        if text:
            pieces.append(F.lit(text))
        pieces.append(values[name].cast("string"))
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def map_code(df: DataFrame, column: str, phrases: Mapping[str, str], default: str = UNKNOWN_REGION, out: str = "phrase") -> DataFrame:
    """Readable phrase for a code column, with a formatted default for unknown codes."""
    return df.withColumn(out, phrase_of(F.col(column), phrases, default))


def _values(df: DataFrame) -> dict[str, Column]:
    values = {c: F.col(f"`{c}`") for c in df.columns}
    amount = "reference_product_amount"
    if amount in values and dict(df.dtypes)[amount] in ("double", "float"):
        values[amount] = amount_text(values[amount])
    return values


def render(df: DataFrame, template: str = QUOTED, out: str = "description") -> DataFrame:
    """Description that quotes the record's fields."""
    return df.withColumn(out, fill(template, _values(df)))


def render_hard(
    df: DataFrame,
    regions: Mapping[str, str] = REGIONS,
    standard: str = "the database",
    out: str = "description",
) -> DataFrame:
    """Paraphrased description: names in lower case, the region by its phrase."""
    values = _values(df)
    values["activity_name_lower"] = F.lower("activity_name")
    values["reference_product_name_lower"] = F.lower("reference_product_name")
    values["geography_phrase"] = phrase_of(F.col("geography"), regions, UNKNOWN_REGION)
    values["standard"] = F.lit(standard)
    return df.withColumn(out, fill(PARAPHRASED, values))


def request_table(cases: DataFrame, models: Sequence[str], system: str, template: str = EXTRACT_REQUEST) -> DataFrame:
    """One request per case and model: system text and user text."""
    return (
        cases.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
        .withColumn("system", F.lit(system))
        .withColumn("user", fill(template, {c: F.col(f"`{c}`") for c in cases.columns}))
    )
