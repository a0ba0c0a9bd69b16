"""Sources, cleaning, sampling, stores, scores, tests and rubrics (sections A to G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import fixtures as X
from evalspark.functions.text import normalize, word_count
from evalspark.operators import cleaning, describe, rubric, sampling, scoring, sigtest, store
from evalspark.plans.storage import cut, new_folder
from evalspark.queries.ctes import norm, sql
from evalspark.sources import buckets, sheet, stores, tables
from evalspark.streaming import landing

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FIELDS = X.FIELDS
META = ["activity_uuid", *FIELDS, "reference_product_amount"]


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def r6(column) -> F.Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def r9(column: str) -> F.Column:
    """Means of many two-digit prices often end in a five at the seventh digit."""
    return F.round(F.col(column), 9) + F.lit(0.0)


def d9(x: str) -> str:
    return f"round({x}, 9) + 0.0"


def d6(x: str) -> str:
    return f"round(cast({x} as double), 6) + 0.0"


def scored(spark: SparkSession, sf: str, salt: str = "") -> DataFrame:
    parsed = store.parse_answers(X.answers(spark, sf, salt), FIELDS)
    return scoring.field_correct(parsed.join(X.truth(spark, sf), "case_id"), FIELDS)


# --- A: sources and sinks ---------------------------------------------------

N_META = 7


def sheet_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Header lines of a sheet with one indicator per kind of part."""
    kinds = X.table(spark, sf, "part").select("p_brand", "p_type", "p_name").distinct()  # the columns of a sheet
    every = F.array_sort(F.collect_list(F.struct("p_brand", "p_type", "p_name")))  # one entry per column
    null = F.lit(None).cast("string")
    blank, tail = F.array_repeat(null, N_META), F.array_repeat(null, 3)
    cols = kinds.agg(every.alias("k"))

    def line(no: int, field: str) -> DataFrame:
        return cols.select(F.lit(no).alias("line_no"), F.concat(blank, F.col(f"k.{field}"), tail).alias("cells"))

    return tables.union_all([line(1, "p_brand"), line(2, "p_type"), line(3, "p_name")])


@query("""
select cast(6 + row_number() over (order by p_brand, p_type, p_name) as int) as idx,
  p_type || ': ' || p_name || ' [' || p_brand || ']' as name
from (select distinct p_brand, p_type, p_name from part)""")
def a01_flatten_header(spark, sf):
    return sheet.flatten_header(sheet_lines(spark, sf), N_META)


@query("select p_partkey as activity_uuid, p_brand as product, p_size as amount from part")
def a02_scan_activities(spark, sf):
    return tables.scan(
        spark, f"{sf}/part.parquet", {"p_partkey": "activity_uuid", "p_brand": "product", "p_size": "amount"}
    )


@query(sql(["activities"], """
select activity_uuid, activity_name, geography from activities
where geography not in ('NATION_3', 'NATION_7') and reference_product_name <> 'Brand#2'"""))
def a03_require(spark, sf):
    a = X.activities(spark, sf)
    holes = a.withColumns({
        "geography": F.when(~F.col("geography").isin("NATION_3", "NATION_7"), F.col("geography")),
        "reference_product_name": F.nullif(F.col("reference_product_name"), F.lit("Brand#2")),
    })
    kept = tables.require(holes, ["activity_name", "geography", "reference_product_name"])
    return kept.select("activity_uuid", "activity_name", "geography")


FEATURE_COLUMNS = ", ".join(d9(c) + f" as {c}" for c in X.FEATURES7)


@query(sql(["features7"], f"select row_id, {FEATURE_COLUMNS} from features7"))
def a04_save_features(spark, sf):
    saved = tables.save_table(X.features7(spark, sf), new_folder(spark, "features"))
    return saved.select("row_id", *[r9(c).alias(c) for c in X.FEATURES7])


def cases(spark, sf, n: int, seed: int, start: int = 0) -> DataFrame:
    sample = sampling.sample_n(X.activities(spark, sf), "activity_uuid", n, seed, start)
    return sampling.build_cases(sample, FIELDS, describe.render)


QUOTED_SQL = """concat('This life cycle inventory dataset covers the activity ''', activity_name,
  ''', located in the region ''', geography, '''. It produces ', cast(reference_product_amount as varchar), ' ',
  reference_product_unit, ' of ''', reference_product_name, ''' as its reference product.')"""


def drawn_sql(n: int, seed: int, source: str = "activities", start: int = 0) -> str:
    return (
        f"select *, row_number() over (order by md5('{seed}:' || cast(activity_uuid as varchar)), activity_uuid)"
        f" - 1 + {start} as id from {source} qualify id < {n + start}"
    )


CASE_FLAT = ["id", "activity_uuid", "description", *[f"ground_truth.{f}" for f in FIELDS]]


@query(sql(["activities"], f"""
select id, cast(activity_uuid as varchar) as activity_uuid, {QUOTED_SQL} as description,
  activity_name, geography, reference_product_name, reference_product_unit from ({drawn_sql(100, 42)})"""))
def a05_case_files(spark, sf):
    path = new_folder(spark, "cases")
    tables.write_cases(cases(spark, sf, 100, 42), path)
    return tables.read_cases(spark, path).select(*CASE_FLAT)


@query(sql(["answers"], "select case_id, model, raw from answers"))
def a06_read_store(spark, sf):
    path = new_folder(spark, "store")
    wide = stores.spread_models(X.answers(spark, sf), ["case_id"], X.MODELS, "raw")
    stores.write_store(wide, path)
    return stores.read_store(spark, path, X.MODELS)


@query(sql(["answers"], "select case_id, model, raw from answers"))
def a07_melt_models(spark, sf):
    wide = stores.spread_models(X.answers(spark, sf), ["case_id"], X.MODELS, "raw")
    return stores.melt_models(wide, ["case_id"], X.MODELS)


def missing_sql(columns) -> str:
    rows = " union all ".join(
        f"select '{c}' as \"column\", count(*) as n_rows, count(*) filter (where {c} is null) as n_missing from clean"
        for c in columns
    )
    return f"missing as ({rows})"


MISSING_SELECT = f'select "column", n_missing, {d6("100.0 * n_missing / n_rows")} as pct_missing from missing'


@query(sql(["clean"], MISSING_SELECT, missing_sql(X.FEATURES7)))
def a08_report_sink(spark, sf):
    report = cleaning.missing_by_column(cleaning.coerce_numeric(X.dirty(spark, sf), X.FEATURES7), X.FEATURES7)
    back = tables.write_report(report.coalesce(1), new_folder(spark, "report"))
    return back.withColumn("pct_missing", r6("pct_missing"))


@query(sql(["scored"], """
select model, to_json(map_from_entries(list((field, n) order by field))) as document
from (unpivot (select model, """ + ", ".join(f"cast(sum({f}_correct) as bigint) as {f}" for f in FIELDS)
    + " from scored group by model) on " + ", ".join(FIELDS) + " into name field value n) group by model"))
def a09_summary_document(spark, sf):
    facts = scoring.field_accuracy(scored(spark, sf), FIELDS)
    return tables.summary_document(facts, ["model"], "field", "n_correct")


@query(sql(["flagged"], """
select 'rows where cluster = ' || cast(cluster as varchar) as "check", count(*) as written, count(*) as expected, true as ok
from flagged group by cluster
union all select 'rows', count(*), count(*), true from flagged
union all select 'columns of the same type', 5, 5, true"""))
def a10_verify_sink(spark, sf):
    df, path = X.flagged(spark, sf), new_folder(spark, "labels")
    tables.save_table(df, path)
    return tables.verify_sink(df, path, "cluster")


REPORT_SCHEMA = """sample_size long, overall map<string, double>, fields map<string, map<string, double>>, failures map<string, long>,
  cochran struct<q: double, df: int>, pairs array<struct<model_a: string, model_b: string, b: long, c: long>>"""


@query(sql(["scored"], f"""
select 'sample_size' as section, null as a, null as b, cast(count(distinct case_id) as double) as value from scored
union all select 'overall', model, null, {d6('avg(correct)')} from scored group by model
union all select 'fields', model, field, round(n * 1.0 / k, 6) + 0.0 from (
  unpivot (select model, count(*) as k, {', '.join(f'cast(sum({f}_correct) as bigint) as {f}' for f in FIELDS)} from scored group by model)
  on {', '.join(FIELDS)} into name field value n)
union all select 'failures', model, null, count(*) filter (where parse_state = 'parse_error') from scored group by model
union all select 'pairs', a.model, b.model, count(*) filter (where a.correct = 0 and b.correct = 1)
    + 1000000 * count(*) filter (where a.correct = 1 and b.correct = 0)
  from scored a join scored b on a.case_id = b.case_id and a.model < b.model group by all
union all select 'cochran', null, null, round(k * (k - 1) * (c2 - total * total / k) / (k * total - r2), 4) + 0.0
  from (select count(*) as k, sum(c) as total, sum(c * c) as c2 from (select model, cast(sum(correct) as double) as c from scored group by model))
  cross join (select sum(r * r) as r2 from (select case_id, cast(sum(correct) as double) as r from scored group by case_id))"""))
def a09_nested_report(spark, sf):
    """The whole report in one document, written, read back and laid out as facts."""
    answers = cut(scored(spark, sf))
    patterns = sigtest.answer_patterns(answers)
    fields = scoring.field_accuracy(answers, FIELDS)
    overall = scoring.overall_accuracy(answers)
    report = tables.nested_report(spark, {
        "sample_size!": overall.agg(F.max("n_cases").alias("n")),
        "overall": overall.select("model", r6("accuracy").alias("accuracy")),
        "fields": fields.select("model", "field", r6("accuracy").alias("accuracy")),
        "failures": scoring.parse_failures(answers),
        "cochran!": sigtest.cochrans_q(patterns).select((F.round("q", 4) + F.lit(0.0)).alias("q"), "df"),
        "pairs": sigtest.pairwise_discordant(patterns).select(
            "model_a", "model_b", F.col("a_wrong_b_right").alias("b"), F.col("a_right_b_wrong").alias("c")),
    })
    path = new_folder(spark, "report")
    report.write.text(path)
    back = spark.read.schema(REPORT_SCHEMA).json(path)

    def rows(section, exploded, a, b, value):
        part = back if exploded is None else back.select(exploded)
        null = F.lit(None).cast("string")
        return part.select(F.lit(section).alias("section"), (null if a is None else F.col(a)).alias("a"),
                           (null if b is None else F.col(b)).alias("b"), F.expr(value).cast("double").alias("value"))

    maps = back.select(F.explode("fields").alias("a", "m")).select("a", F.explode("m").alias("b", "value"))
    return tables.union_all([
        rows("sample_size", None, None, None, "sample_size"),
        rows("overall", F.explode("overall").alias("a", "v"), "a", None, "v"),
        maps.select(F.lit("fields").alias("section"), "a", "b", "value"),
        rows("failures", F.explode("failures").alias("a", "v"), "a", None, "v"),
        rows("pairs", F.explode("pairs").alias("p"), "p.model_a", "p.model_b", "p.b + 1000000 * p.c"),
        rows("cochran", None, None, None, "cochran.q"),
    ])


SHEET_NAMES = [f"quantity {c}: part {c} [lines]" for c in X.FEATURES7]


@query(sql(["features7", "activities"], "select a.activity_name, a.geography, " + ", ".join(
    d9(c) + f' as {c}' for c in X.FEATURES7) + " from features7 f join activities a on a.activity_uuid = f.row_id"))
def a11_sheet_to_features(spark, sf):
    """A sheet with a header of four lines, written as text, read, and cut to seven columns by their names."""
    base = new_folder(spark, "sheet")
    extra = ["unused"]
    columns = [*X.FEATURES7, *extra]
    blank = [None] * N_META
    head = [
        [*blank, *["lines"] * len(columns), None], [*blank, *[f"quantity {c}" for c in columns], None],
        [*blank, *[f"part {c}" for c in columns], None], ["uuid", "note", "name", "geography", "product", "unit", "amount", *["kg"] * len(columns), None],
    ]
    schema = ", ".join(f"c{i} string" for i in range(len(head[0])))
    spark.createDataFrame(head, schema).coalesce(1).write.csv(f"{base}/0", emptyValue="")
    body = X.named_features7(spark, sf).select(
        "row_id", F.lit("two\nlines").alias("note"), "activity_name", "geography", "reference_product_name", "reference_product_unit",
        "reference_product_amount", *X.FEATURES7, F.lit("n/a").alias("unused"), F.lit(None).cast("string").alias("end"))
    body.write.csv(f"{base}/1", emptyValue="")
    clean = sheet.read_sheet(spark, f"{base}/*", [(2, "activity_name"), (3, "geography")], N_META, "activity_name")
    chosen = cleaning.select_representative(clean, ["activity_name", "geography"], [*SHEET_NAMES, "not there"])
    return chosen.select("activity_name", "geography", *[r9(f"`{n}`").alias(c) for n, c in zip(SHEET_NAMES, X.FEATURES7)])


# --- B: cleaning and text ---------------------------------------------------

CLEAN_COLUMNS = ", ".join(d9(c) + f" as {c}" for c in X.FEATURES7)


@query(sql(["clean"], f"select row_id, {CLEAN_COLUMNS} from clean"))
def b01_coerce_numeric(spark, sf):
    clean = cleaning.coerce_numeric(X.dirty(spark, sf), X.FEATURES7)
    return clean.select("row_id", *[r9(c).alias(c) for c in X.FEATURES7])


@query(sql(["clean"], f"select row_id, {CLEAN_COLUMNS} from clean where f05 is not null and f06 is not null"))
def b02_complete_cases(spark, sf):
    clean = cleaning.coerce_numeric(X.dirty(spark, sf), X.FEATURES7)
    return cleaning.complete_cases(clean, X.FEATURES7).select("row_id", *[r9(c).alias(c) for c in X.FEATURES7])


@query(sql(["clean"], f"""
select cast(sum(n_rows) as bigint) as total_cells, cast(sum(n_missing) as bigint) as missing_cells,
  {d6('100.0 * sum(n_missing) / sum(n_rows)')} as pct_missing from missing""", missing_sql(X.FEATURES7)))
def b03_missing_overall(spark, sf):
    clean = cleaning.coerce_numeric(X.dirty(spark, sf), X.FEATURES7)
    return cleaning.missing_overall(clean, X.FEATURES7).withColumn("pct_missing", r6("pct_missing"))


@query(sql(["clean"], f"""select * from (
  ({MISSING_SELECT.replace('select ', "select 'most' as side, ", 1)} order by n_missing desc, "column" limit 3) union all
  ({MISSING_SELECT.replace('select ', "select 'least' as side, ", 1)} order by n_missing, "column" limit 3))""",
    missing_sql(X.FEATURES7)))
def b04_missing_by_column(spark, sf):
    clean = cleaning.coerce_numeric(X.dirty(spark, sf), X.FEATURES7)
    most = cleaning.missing_by_column(clean, X.FEATURES7, 3).withColumn("side", F.lit("most"))
    least = cleaning.missing_by_column(clean, X.FEATURES7, 3, most=False).withColumn("side", F.lit("least"))
    return most.unionByName(least).withColumn("pct_missing", r6("pct_missing"))


TARGETS = [
    "ECONOMY: small ring [Brand#2]",
    "PROMO: blue [Brand#0]",
    "LARGE: red widget [Brand#99]",
    "SMALL: no such thing [Brand#1]",
]


@query(f"""
with names as (select row_number() over (order by p_brand, p_type, p_name) as idx,
    p_type || ': ' || p_name || ' [' || p_brand || ']' as name from (select distinct p_brand, p_type, p_name from part)),
  targets(target) as (values {', '.join(f"('{t}')" for t in TARGETS)}),
  phrased as (select target, trim(split_part(split_part(target, ':', 2), '[', 1)) as phrase from targets)
select target, true as found, 1 as rank, name from phrased join names on name = target
union all
select target, false, cast(rank as int), name from (
  select target, name, row_number() over (partition by target order by idx) as rank
  from (select * from phrased where target not in (select name from names)) left join names on contains(name, phrase))
where rank <= 3""")
def b05_select_representative(spark, sf):
    names = sheet.flatten_header(sheet_lines(spark, sf), N_META)
    targets = spark.createDataFrame([(t,) for t in TARGETS], "target string")
    return cleaning.representative_candidates(names, targets)


@query(f"""
select cast(sum(n) as bigint) as n_rows, cast(sum(n - 1) as bigint) as n_excess,
  {d6('100.0 * sum(n - 1) / sum(n)')} as pct_excess
from (select count(*) as n from lineitem group by l_quantity, l_discount, l_tax)""")
def b06_duplicate_excess(spark, sf):
    line = X.table(spark, sf, "lineitem")
    out = cleaning.duplicate_excess(line, ["l_quantity", "l_discount", "l_tax"])
    return out.withColumn("pct_excess", r6("pct_excess"))


@query(sql(["planted"], """
select row_id, row_number() over (partition by f00, f01 order by row_id) > 1 as is_duplicate from planted"""))
def b06_duplicate_flags(spark, sf):
    return cleaning.duplicate_flags(X.planted(spark, sf), X.PLANTED)


# Phrases for some of the region codes of the stand-in table.
PHRASES = {"NATION_0": "worldwide", "NATION_1": "the rest of the world", "NATION_2": "the European region"}
PHRASE_SQL = (
    "case geography " + " ".join(f"when '{k}' then '{v}'" for k, v in PHRASES.items())
    + " else 'the region coded ' || geography end"
)


@query(sql(["activities"], f"select activity_uuid, geography, {PHRASE_SQL} as phrase from activities"))
def b07_map_code(spark, sf):
    return describe.map_code(X.activities(spark, sf), "geography", PHRASES).select("activity_uuid", "geography", "phrase")


@query(sql(["activities"], f"select activity_uuid, {QUOTED_SQL} as description from activities"))
def b08_render(spark, sf):
    return describe.render(X.activities(spark, sf)).select("activity_uuid", "description")


HARD_SQL = f"""concat('An industrial process record describes operations related to ', lower(activity_name),
  '. This process is documented as taking place in ', {PHRASE_SQL},
  '. The output of this process, when measured, comes to ', cast(reference_product_amount as varchar),
  ' units (specifically ', reference_product_unit, ') of a product known as ', lower(reference_product_name),
  '. Based on this record, identify the underlying process/activity name (matching the database''s standard naming), ',
  'the applicable the database geography code (not the plain-language region name given above), ',
  'the resulting product name, and its unit of measure.')"""


@query(sql(["activities"], f"select activity_uuid, {HARD_SQL} as description from activities"))
def b09_render_hard(spark, sf):
    return describe.render_hard(X.activities(spark, sf), PHRASES).select("activity_uuid", "description")


@query(sql(["activities"], f"""
select activity_uuid, model, 'Answer with JSON only.' as system,
  concat('Extract the fields from this description:', chr(10), chr(10), {QUOTED_SQL}) as "user"
from activities cross join (values {', '.join(f"('{m}')" for m in X.MODELS)}) m(model)"""))
def b10_request_table(spark, sf):
    described = describe.render(X.activities(spark, sf))
    requests = describe.request_table(described, X.MODELS, "Answer with JSON only.")
    return requests.select("activity_uuid", "model", "system", "user")


@query(f"""
select item, {norm('value')} as normalized from (
  select 'd' || cast(doc_id as varchar) as item, text as value from documents
  union all select 'p' || cast(p_partkey as varchar), chr(9) || ' ' || p_name || chr(10) from part
  union all select 'e' || cast(event_id as varchar), cast(nullif(user_id, 8) as varchar) from events)""")
def b11_normalize(spark, sf):
    docs = X.documents(spark, sf).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("item"), normalize(F.col("text")).alias("normalized")
    )
    parts = X.table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("item"),
        normalize(F.concat(F.lit("\t "), "p_name", F.lit("\n"))).alias("normalized"),
    )
    users = X.table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("item"),
        normalize(F.nullif(F.col("user_id"), F.lit(8))).alias("normalized"),
    )
    return docs.unionByName(parts).unionByName(users)


@query("""
select doc_id, cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as int) as words
from documents""")
def b12_word_count(spark, sf):
    return X.documents(spark, sf).select("doc_id", word_count(F.col("text")).alias("words"))


# --- C: samples and test sets -----------------------------------------------

EXTENDED = f"""first as ({drawn_sql(100, 42)}), rest as (
  select * from activities where activity_uuid not in (select activity_uuid from first)),
  second as ({drawn_sql(100, 43, 'rest', 100)})"""


@query(sql(["activities"], f"select activity_uuid, id from ({drawn_sql(100, 42)})"))
def c01_sample_n(spark, sf):
    return sampling.sample_n(X.activities(spark, sf), "activity_uuid", 100, 42).select("activity_uuid", "id")


@query(sql(["activities"], "select activity_uuid, id from second", EXTENDED))
def c02_extend_sample(spark, sf):
    a = X.activities(spark, sf)
    first = sampling.sample_n(a, "activity_uuid", 100, 42)
    return sampling.extend_sample(a, first, "activity_uuid", 100, 43, 100).select("activity_uuid", "id")


def two_batches(spark, sf) -> DataFrame:
    a = X.activities(spark, sf)
    first = sampling.sample_n(a, "activity_uuid", 100, 42)
    return sampling.union_batches(first, sampling.extend_sample(a, first, "activity_uuid", 100, 43, 100))


@query(sql(["activities"], """select id, activity_uuid, 'original' as batch from first
union all select id, activity_uuid, 'new' from second""", EXTENDED))
def c03_union_batches(spark, sf):
    return two_batches(spark, sf).select("id", "activity_uuid", "batch")


@query(sql(["activities"], f"""
select id, cast(activity_uuid as varchar) as activity_uuid, {QUOTED_SQL} as description, activity_name, geography,
  reference_product_name, reference_product_unit, batch
from (select *, 'original' as batch from first union all select *, 'new' from second)""", EXTENDED))
def c04_build_cases(spark, sf):
    return sampling.build_cases(two_batches(spark, sf), FIELDS, describe.render).select(*CASE_FLAT, "batch")


# --- D: answer stores -------------------------------------------------------

P_FIELDS = ", ".join(f"p_{f} as {f}" for f in FIELDS)


@query(sql(["parsed"], f"select case_id, model, parse_state, {P_FIELDS} from parsed"))
def d01_parse_answers(spark, sf):
    parsed = store.parse_answers(X.answers(spark, sf), FIELDS)
    return parsed.select("case_id", "model", "parse_state", "parsed.*")


@query(sql(["answers"], """
select model, count(*) as n, count(*) filter (where coalesce(raw, '') = '') as without_text,
  count(*) filter (where coalesce(raw, '') = '') as recorded_as_error from answers group by model"""))
def d02_missing_answer_is_error(spark, sf):
    parsed = store.parse_answers(X.answers(spark, sf), FIELDS)
    empty = F.coalesce("raw", F.lit("")) == ""
    return parsed.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(empty).alias("without_text"),
        F.count_if(empty & (F.col("parse_state") == "parse_error")).alias("recorded_as_error"),
    )


REUSABLE = ["m0", "m1"]


@query(sql(["answers", "answers_hard"], """
select w.case_id, w.model, coalesce(w.raw, e.raw) as raw,
  case when w.raw is not null then 'kept' when e.raw is not null then 'reused' else 'open' end as origin
from answers w left join (select * from answers_hard where model in ('m0', 'm1') and coalesce(raw, '') <> '') e
  on w.case_id = e.case_id and w.model = e.model"""))
def d03_reuse_answers(spark, sf):
    earlier = X.answers(spark, sf, "#hard")
    return store.reuse_answers(X.answers(spark, sf), earlier, REUSABLE, ["case_id", "model"])


@query(sql(["answers"], "select case_id, model from answers where raw is null"))
def d04_pending(spark, sf):
    ids = X.activities(spark, sf).select(F.col("activity_uuid").alias("case_id"))
    return store.pending(ids, X.MODELS, X.answers(spark, sf))


@query(sql(["answers"], """
select case_id, count(raw) as n_answered, count(raw) = 6 as complete from answers group by case_id"""))
def d04_complete(spark, sf):
    return store.complete(X.answers(spark, sf), X.MODELS)


@query(sql(["answers"], "select case_id from answers where model = 'm3' and coalesce(raw, '') = ''"))
def d05_gaps(spark, sf):
    return store.gaps(X.answers(spark, sf), "m3")


@query(sql(["answers", "answers_hard"], """
select coalesce(o.case_id, n.case_id) as case_id, coalesce(o.model, n.model) as model, coalesce(n.raw, o.raw) as raw
from answers o full join (select * from answers_hard where model = 'm3') n
  on o.case_id = n.case_id and o.model = n.model"""))
def d06_upsert(spark, sf):
    patch = X.answers(spark, sf, "#hard").filter(F.col("model") == "m3")
    return store.upsert(X.answers(spark, sf), patch)


@query(sql(["answers", "answers_hard"], """
select coalesce(o.case_id, n.case_id) as case_id, coalesce(o.model, n.model) as model, coalesce(n.raw, o.raw) as raw
from answers o full join (select * from answers_hard where model = 'm3') n
  on o.case_id = n.case_id and o.model = n.model"""))
def d06_upsert_buckets(spark, sf):
    """The same in a store of hash buckets, where a patch rewrites what it touches."""
    answers = X.answers(spark, sf)
    kept = buckets.BucketStore.create(spark, new_folder(spark, "answers"), answers.schema)
    kept.upsert(answers, batch=0)
    kept.upsert(X.answers(spark, sf, "#hard").filter(F.col("model") == "m3"), batch=1)
    return kept.read()


@query(sql(["parsed"], """
select model, parse_state, count(*) as n from parsed group by model, parse_state"""))
def d07_land_stream(spark, sf):
    return landing.land_twice(X.answers(spark, sf), FIELDS)


@query(sql(["parsed"], """
select model, parse_state, count(*) as n from parsed group by model, parse_state"""))
def d07_land_compacted(spark, sf):
    return landing.land_twice(X.answers(spark, sf), FIELDS, compacting=True)


# --- E: scores --------------------------------------------------------------

FLAGS = ", ".join(f"{f}_correct" for f in FIELDS)


@query(sql(["scored"], f"select case_id, model, {FLAGS} from scored"))
def e01_field_correct(spark, sf):
    return scored(spark, sf).select("case_id", "model", *[f"{f}_correct" for f in FIELDS])


NONEMPTY = ", ".join(f"cast(sum({f}_correct * cast({norm('p_' + f)} <> '' as int)) as bigint) as {f}" for f in FIELDS)


@query(sql(["scored"], f"select model, {NONEMPTY} from scored group by model"))
def e01_field_correct_nonempty(spark, sf):
    parsed = store.parse_answers(X.answers(spark, sf), FIELDS).join(X.truth(spark, sf), "case_id")
    strict = scoring.field_correct(parsed, FIELDS, require_nonempty=True)
    return strict.groupBy("model").agg(*[F.sum(f"{f}_correct").alias(f) for f in FIELDS])


@query(sql(["scored"], "select case_id, model, correct from scored"))
def e02_exact_match(spark, sf):
    return scored(spark, sf).select("case_id", "model", "correct")


@query(sql(["parsed"], """
select model, count(*) filter (where parse_state = 'parse_error') as parse_failures from parsed group by model"""))
def e03_parse_failures(spark, sf):
    return scoring.parse_failures(store.parse_answers(X.answers(spark, sf), FIELDS))


def field_accuracy_sql(name: str, source: str) -> str:
    rows = " union all ".join(
        f"select model, '{f}' as field, count(*) as n_cases, cast(sum({f}_correct) as bigint) as n_correct "
        f"from {source} group by model" for f in FIELDS
    )
    return f"{name} as ({rows})"


@query(sql(["scored"], f"select model, field, n_cases, n_correct, {d6('n_correct / n_cases')} as accuracy from fa",
           field_accuracy_sql("fa", "scored")))
def e04_field_accuracy(spark, sf):
    out = scoring.field_accuracy(scored(spark, sf), FIELDS)
    return out.select("model", "field", "n_cases", "n_correct", r6("accuracy").alias("accuracy"))


@query(sql(["scored"], f"""
select model, count(*) as n_cases, cast(sum(correct) as bigint) as n_correct, {d6('avg(correct)')} as accuracy
from scored group by model"""))
def e05_overall_accuracy(spark, sf):
    out = scoring.overall_accuracy(scored(spark, sf))
    return out.select("model", "n_cases", "n_correct", r6("accuracy").alias("accuracy"))


@query(sql(["scored"], "select case_id, "
           + ", ".join(f"max(correct) filter (where model = '{m}') as {m}" for m in X.MODELS)
           + " from scored group by case_id"))
def e06_correctness_matrix(spark, sf):
    return scoring.correctness_matrix(scored(spark, sf), X.MODELS)


MISMATCH_SQL = " union all ".join(
    f"select case_id, model, '{f}' as field, p_{f} as predicted, t_{f} as actual from scored "
    f"where parse_state <> 'parse_error' and {norm('p_' + f)} <> {norm('t_' + f)}" for f in FIELDS
)


@query(sql(["scored"], MISMATCH_SQL))
def e07_mismatches(spark, sf):
    return scoring.mismatches(scored(spark, sf), FIELDS)


@query(sql(["scored"], f"select model, count(distinct case_id) as failure_cases from ({MISMATCH_SQL}) group by model"))
def e07_failure_count(spark, sf):
    return scoring.failure_count(scoring.mismatches(scored(spark, sf), FIELDS))


@query(sql(["parsed"], """
select case_id, raw from parsed where model = 'm4' and parse_state = 'parse_error' order by case_id limit 5"""))
def e08_failed_samples(spark, sf):
    return scoring.failed_samples(store.parse_answers(X.answers(spark, sf), FIELDS), "m4", 5)


NAMES = {"m0": "Rater Zero", "m1": "Rater One", "m2": "Rater Two"}


@query(sql(["scored"], """
select case model when 'm0' then 'Rater Zero' when 'm1' then 'Rater One' when 'm2' then 'Rater Two' else model end
  as model_name, model, cast(sum(correct) as bigint) as n_correct from scored group by model"""))
def e09_label_models(spark, sf):
    out = scoring.overall_accuracy(scored(spark, sf)).select("model", "n_correct")
    return stores.label_models(out, NAMES)


@query(sql(["scored"], f"""
select model, count(*) as sample_size, count(*) filter (where parse_state = 'parse_error') as parse_failures,
  cast(sum(correct) as bigint) as exact_match_count, 'field extraction' as task from scored group by model"""))
def e10_run_summary(spark, sf):
    return scoring.run_summary(scored(spark, sf), "field extraction", stamp=False).drop("exact_match_pct")


@query(sql(["scored", "scored_hard"], f"""
select model, field, {d6('a.n_correct / a.n_cases')} as accuracy_first, {d6('b.n_correct / b.n_cases')} as accuracy_second,
  {d6('b.n_correct / b.n_cases - a.n_correct / a.n_cases')} as delta from fa a full join fb b using (model, field)""",
    field_accuracy_sql("fa", "scored") + ", " + field_accuracy_sql("fb", "scored_hard")))
def e11_accuracy_delta(spark, sf):
    easy = scoring.field_accuracy(scored(spark, sf), FIELDS)
    hard = scoring.field_accuracy(scored(spark, sf, "#hard"), FIELDS)
    out = scoring.accuracy_delta(easy, hard)
    return out.withColumns({c: r6(c) for c in ("accuracy_first", "accuracy_second", "delta")})


# --- F: paired tests --------------------------------------------------------


@query("""
select 'quality' as model_a, 'toxic' as model_b,
  count(*) filter (where quality = 0 and toxic = 1) as a_wrong_b_right,
  count(*) filter (where quality = 1 and toxic = 0) as a_right_b_wrong from labels""")
def f01_discordant(spark, sf):
    raters = X.table(spark, sf, "labels").unpivot(["doc_id"], ["quality", "toxic"], "model", "correct")
    return sigtest.discordant(raters, "quality", "toxic", key="doc_id")


def families(spark, sf) -> DataFrame:
    """Three families of raters: answers, harder answers, event types per user and day."""
    parts = [("answers", scored(spark, sf)), ("harder answers", scored(spark, sf, "#hard")), ("events", X.blocks(spark, sf))]
    return tables.union_all(
        [df.select(F.lit(t).alias("task"), F.col("case_id").cast("string"), "model", "correct") for t, df in parts]
    )


FAMILY_SQL = """families as (
  select 'answers' as task, cast(case_id as varchar) as case_id, model, correct from scored
  union all select 'harder answers', cast(case_id as varchar), model, correct from scored_hard
  union all select 'events', case_id, model, correct from blocks)"""
PAIR_SQL = FAMILY_SQL + """, pairs as (
  select a.task, a.model as model_a, b.model as model_b,
    count(*) filter (where a.correct = 0 and b.correct = 1) as a_wrong_b_right,
    count(*) filter (where a.correct = 1 and b.correct = 0) as a_right_b_wrong
  from families a join families b on a.task = b.task and a.case_id = b.case_id and a.model < b.model
  group by all)"""
FAMILY_PARTS = ["scored", "scored_hard", "blocks"]


def family_pairs(spark, sf) -> DataFrame:
    return sigtest.pairwise_discordant(sigtest.answer_patterns(families(spark, sf), ["task"]), ["task"])


@query(sql(FAMILY_PARTS, "select * from pairs", PAIR_SQL))
def f02_pairwise_discordant(spark, sf):
    return family_pairs(spark, sf)


@query(sql(FAMILY_PARTS, "select * from pairs", PAIR_SQL))
def f02_pairwise_discordant_bits(spark, sf):
    """The same by slices of bits, which don't grow with the number of patterns."""
    return sigtest.pairwise_discordant_bits(families(spark, sf), ["task"])


def gappy(df: DataFrame) -> DataFrame:
    """An eighth of the rows is missing."""
    return df.filter(F.md5(F.concat_ws("|", F.col("case_id").cast("string"), "model", F.lit("gap"))) >= "20")


GAPPY = "md5(concat(cast(case_id as varchar), '|', model, '|gap')) >= '20'"
FULL_SQL = f"""present as (select * from scored where {GAPPY}),
  whole as (select c.case_id, m.model, coalesce(p.correct, 0) as correct,
      {', '.join(f'coalesce(p.{f}_correct, 0) as {f}_correct' for f in FIELDS)}
    from (select distinct case_id from scored) c cross join (select distinct model from present) m
    left join present p on p.case_id = c.case_id and p.model = m.model)"""


@query(sql(["scored"], """
select a.model as model_a, b.model as model_b, count(*) filter (where a.correct = 0 and b.correct = 1) as a_wrong_b_right,
  count(*) filter (where a.correct = 1 and b.correct = 0) as a_right_b_wrong
from whole a join whole b on a.case_id = b.case_id and a.model < b.model group by all""", FULL_SQL))
def f02_pairwise_discordant_gaps(spark, sf):
    return sigtest.pairwise_discordant(sigtest.answer_patterns(gappy(scored(spark, sf))))


@query(sql(["scored"], """
select k as n_raters, cast(k - 1 as int) as df, round(k * (k - 1) * (c2 - total * total / k) / (k * total - r2), 4) + 0.0 as q
from (select count(*) as k, sum(c) as total, sum(c * c) as c2 from (select model, cast(sum(correct) as double) as c from whole group by model))
cross join (select sum(r * r) as r2 from (select case_id, cast(sum(correct) as double) as r from whole group by case_id))""", FULL_SQL))
def f04_cochrans_q_gaps(spark, sf):
    q = sigtest.cochrans_q(sigtest.answer_patterns(gappy(scored(spark, sf))))
    return q.select("n_raters", "df", (F.round("q", 4) + F.lit(0.0)).alias("q"))


@query(sql(["scored"], """
select k as n_raters, cast(k - 1 as int) as df, round(k * (k - 1) * (c2 - total * total / k) / (k * total - r2), 4) + 0.0 as q
from (select count(*) as k, sum(c) as total, sum(c * c) as c2 from (select model, cast(sum(correct) as double) as c from whole group by model))
cross join (select sum(r * r) as r2 from (select case_id, cast(sum(correct) as double) as r from whole group by case_id))""", FULL_SQL))
def f04_cochrans_q_bits(spark, sf):
    q = sigtest.cochrans_q_bits(gappy(scored(spark, sf)))
    return q.select("n_raters", "df", (F.round("q", 4) + F.lit(0.0)).alias("q"))


@query(sql(["scored"], """
select model, count(*) as n_cases, cast(sum(correct) as bigint) as n_correct,
  round(avg(correct), 6) + 0.0 as accuracy from whole group by model""", FULL_SQL))
def e05_overall_accuracy_gaps(spark, sf):
    out = scoring.overall_accuracy(gappy(scored(spark, sf)), cases=X.truth(spark, sf))
    return out.select("model", "n_cases", "n_correct", r6("accuracy").alias("accuracy"))


@query(sql(["scored"], f"""
select model, field, n_cases, n_correct from (
  unpivot (select model, count(*) as n_cases, {', '.join(f'cast(sum({f}_correct) as bigint) as {f}' for f in FIELDS)} from whole group by model)
  on {', '.join(FIELDS)} into name field value n_correct)""", FULL_SQL))
def e04_field_accuracy_gaps(spark, sf):
    out = scoring.field_accuracy(gappy(scored(spark, sf)), FIELDS, cases=X.truth(spark, sf))
    return out.select("model", "field", "n_cases", "n_correct")


@query(sql(["answers"], f"""
select model, (select count(*) from part) - count(*) filter (where coalesce(raw, '') <> '') as missing_drafts
from answers where {GAPPY} group by model"""))
def g05_missing_drafts_gaps(spark, sf):
    return rubric.missing_drafts(gappy(X.answers(spark, sf)), "raw", cases=X.truth(spark, sf))


# The checking engine sums the binomial terms with its log-gamma function instead.
P_SQL = PAIR_SQL + """, tested as (
  select *, case when a_wrong_b_right + a_right_b_wrong = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(
      range(0, least(a_wrong_b_right, a_right_b_wrong) + 1),
      lambda i: exp(lgamma(a_wrong_b_right + a_right_b_wrong + 1.0) - lgamma(i + 1.0)
        - lgamma(a_wrong_b_right + a_right_b_wrong - i + 1.0) - (a_wrong_b_right + a_right_b_wrong) * ln(2.0))))) end as p
  from pairs)"""
LOG_P = "case when p = 0 then null else round(ln(p), 6) + 0.0 end"


def log_p(column: str = "p_value"):
    """Probabilities far in the tail are compared by their logarithm."""
    return F.when(F.col(column) != 0, F.round(F.log(column), 6) + F.lit(0.0))


@query(sql(FAMILY_PARTS, f"select task, model_a, model_b, {LOG_P} as log_p from tested", P_SQL))
def f03_mcnemar_exact(spark, sf):
    return sigtest.mcnemar_exact(family_pairs(spark, sf)).select("task", "model_a", "model_b", log_p().alias("log_p"))


@query(sql(FAMILY_PARTS, f"""
select task, k as n_raters, cast(k - 1 as int) as df,
  round(k * (k - 1) * (c2 - total * total / k) / (k * total - r2), 4) + 0.0 as q
from (select task, count(*) as k, sum(c) as total, sum(c * c) as c2
      from (select task, model, cast(sum(correct) as double) as c from families group by task, model) group by task)
join (select task, sum(r * r) as r2 from (
      select task, case_id, cast(sum(correct) as double) as r from families group by task, case_id) group by task)
using (task)""", FAMILY_SQL))
def f04_cochrans_q(spark, sf):
    q = sigtest.cochrans_q(sigtest.answer_patterns(families(spark, sf), ["task"]), ["task"])
    return q.select("task", "n_raters", "df", (F.round("q", 4) + F.lit(0.0)).alias("q"))


# An upper tail by Simpson's rule over 4,000 steps, with the density's own factor from lgamma.
@query(sql(FAMILY_PARTS, """
select task, n_raters, df, round(case when q > 1400 then 0 else (select sum(
    (case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end) * h / 3
      * exp((df / 2.0 - 1) * ln(q + i * h) - (q + i * h) / 2 - (df / 2.0) * ln(2.0) - lgamma(df / 2.0)))
  from (select 80.0 / 4000 as h, unnest(range(0, 4001)) as i)) end, 6) + 0.0 as p_value
from qs""", FAMILY_SQL + """, qs as (
select task, k as n_raters, cast(k - 1 as int) as df, k * (k - 1) * (c2 - total * total / k) / (k * total - r2) as q
from (select task, count(*) as k, sum(c) as total, sum(c * c) as c2
      from (select task, model, cast(sum(correct) as double) as c from families group by task, model) group by task)
join (select task, sum(r * r) as r2 from (
      select task, case_id, cast(sum(correct) as double) as r from families group by task, case_id) group by task)
using (task))"""))
def f05_chi2_sf(spark, sf):
    q = sigtest.cochrans_q(sigtest.answer_patterns(families(spark, sf), ["task"]), ["task"])
    return q.select("task", "n_raters", "df", (F.round("p_value", 6) + F.lit(0.0)).alias("p_value"))


@query(sql(FAMILY_PARTS, """
select task, model_a, model_b, round(0.05 / count(*) over (partition by task), 9) as bonferroni_alpha,
  p < 0.05 / count(*) over (partition by task) as significant from tested""", P_SQL))
def f06_bonferroni(spark, sf):
    tests = sigtest.bonferroni(sigtest.mcnemar_exact(family_pairs(spark, sf)), by=["task"])
    return tests.select("task", "model_a", "model_b", F.round("bonferroni_alpha", 9).alias("bonferroni_alpha"), "significant")


@query(sql(FAMILY_PARTS, """
select task, model_a, model_b,
  case when p < 0.05 then 'statistically significant' else 'not statistically significant' end as verdict
from tested""", P_SQL))
def f07_verdict(spark, sf):
    tests = sigtest.mcnemar_exact(family_pairs(spark, sf))
    return sigtest.verdict(tests).select("task", "model_a", "model_b", "verdict")


RATER_SQL = P_SQL + f""", acc as (
  select model, {d6('avg(correct)')} as accuracy from scored group by model)"""


@query(sql(FAMILY_PARTS, f"""
select model_a, model_b, a.accuracy as acc_a, b.accuracy as acc_b, a_wrong_b_right, a_right_b_wrong, {LOG_P} as log_p,
  p < 0.05 / count(*) over () as significant
from tested join acc a on a.model = model_a join acc b on b.model = model_b where task = 'answers'""", RATER_SQL))
def flagship_rater_comparison(spark, sf):
    return rater_comparison(spark, sf)


def rater_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Which rater is more accurate, and is the difference significant?

    The accuracies come from the same pattern counts as the tests, so the cases are
    read, parsed and shuffled once.
    """
    patterns = sigtest.answer_patterns(scored(spark, sf))  # at most 2**6 rows
    raters = (
        patterns.select("n_cases", F.explode("pattern").alias("r"))
        .groupBy(F.col("r.model").alias("model"))
        .agg(F.try_divide(F.sum(F.col("n_cases") * F.col("r.correct")), F.sum("n_cases")).alias("acc"))
    )
    tests = sigtest.bonferroni(sigtest.mcnemar_exact(sigtest.pairwise_discordant(patterns)))
    for side in ("a", "b"):
        tests = tests.join(
            F.broadcast(raters.select(F.col("model").alias(f"model_{side}"), r6("acc").alias(f"acc_{side}"))),
            f"model_{side}",
        )
    return tests.select(
        "model_a", "model_b", "acc_a", "acc_b", "a_wrong_b_right", "a_right_b_wrong", log_p().alias("log_p"), "significant"
    )


# --- G: rubric --------------------------------------------------------------

CHECKS = {
    "license": ["licen[cs]e", "apache"],
    "contact": ["@", "phone", r"\btel\b"],
    "rights": ["all rights reserved"],
}
TURN_CHECKS = {"asks": [r"\?"], "numbers": [r"\b[0-9]+\b", "percent"], "links": ["https?://", r"\bwww\."]}


def flag_sql(checks, text: str) -> str:
    return ", ".join(
        "cast(coalesce({t}, '') <> '' and regexp_matches(lower(coalesce({t}, '')), '{p}') as int) as {n}".format(
            t=text, p="|".join(f"(?:{p})" for p in patterns), n=name
        )
        for name, patterns in checks.items()
    )


FLAG_PART = f"flags as (select *, {flag_sql(CHECKS, 'draft')} from drafts)"
SUMS = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in CHECKS)


@query(sql(["drafts"], f"select case_id, model, {', '.join(CHECKS)} from flags", FLAG_PART))
def g01_rubric_flags(spark, sf):
    return rubric.rubric_flags(X.drafts(spark, sf), "draft", CHECKS).drop("draft")


@query(f"select conv_id, turn, role, {flag_sql(TURN_CHECKS, 'text')} from conversations")
def g01_rubric_flags_turns(spark, sf):
    return rubric.rubric_flags(X.table(spark, sf, "conversations"), "text", TURN_CHECKS).drop("text")


TEN = rubric.STRUCTURAL | rubric.PRECISION


@query(sql(["rubric_drafts"], f"select case_id, model, {flag_sql(TEN, 'draft')} from rubric_drafts"))
def g01_rubric_ten_checks(spark, sf):
    flags = rubric.rubric_flags(X.rubric_drafts(spark, sf), "draft", TEN)
    return flags.select("case_id", "model", *TEN)


def counts(spark, sf) -> DataFrame:
    return rubric.rubric_counts(rubric.rubric_flags(X.drafts(spark, sf), "draft", CHECKS), list(CHECKS))


@query(sql(["drafts"], f"select model, {SUMS} from flags group by model", FLAG_PART))
def g02_rubric_counts(spark, sf):
    return counts(spark, sf)


@query(sql(["drafts"], f"""unpivot (select model, {SUMS} from flags group by model)
on {', '.join(CHECKS)} into name "check" value n_present""", FLAG_PART))
def g02_rubric_counts_long(spark, sf):
    return rubric.rubric_counts_long(counts(spark, sf), list(CHECKS))


@query(sql(["drafts"], f"""
select model, cast(sum({' + '.join(CHECKS)}) as bigint) as n_present,
  cast(3 * (select count(distinct case_id) from drafts) as bigint) as n_possible,
  {d6(f"100.0 * sum({' + '.join(CHECKS)}) / (3 * (select count(distinct case_id) from drafts))")} as completeness_pct
from flags group by model""", FLAG_PART))
def g03_completeness(spark, sf):
    n_cases = X.drafts(spark, sf).groupBy("case_id").agg(F.lit(1)).agg(F.count("*")).scalar()
    out = rubric.completeness(counts(spark, sf), list(CHECKS), n_cases)
    return out.withColumn("completeness_pct", r6("completeness_pct"))


@query(sql(["drafts"], f"""
select model, {d6("coalesce(avg(case when coalesce(draft, '') <> '' then len(list_filter(regexp_split_to_array(draft, '\\s+'), lambda w: w <> '')) end), 0)")}
  as avg_words from drafts group by model"""))
def g04_avg_words(spark, sf):
    return rubric.avg_words(X.drafts(spark, sf)).withColumn("avg_words", r6("avg_words"))


@query(sql(["answers"], """
select model, count(*) filter (where coalesce(raw, '') = '') as missing_drafts from answers group by model"""))
def g05_missing_drafts(spark, sf):
    return rubric.missing_drafts(X.answers(spark, sf), "raw")


REVIEW_MODELS = ["m1", "m3", "m4", "m9"]
REVIEW_CASES = [0, 5, 17, 41]


@query(sql(["answers"], "select case_id, "
           + ", ".join(f"coalesce(min(raw) filter (where model = '{m}'), 'MISSING') as {m}" for m in REVIEW_MODELS)
           + f" from answers where case_id in ({', '.join(map(str, REVIEW_CASES))}) group by case_id"))
def g06_review_extract(spark, sf):
    return rubric.review_extract(X.answers(spark, sf), REVIEW_CASES, REVIEW_MODELS, text="raw")
