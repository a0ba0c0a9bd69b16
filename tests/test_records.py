"""Published values and edge cases of scores, tests, answers, stores and sources."""

import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from evalspark.functions.stats import chi2_upper, split_probability
from evalspark.functions.text import amount_text, normalize, word_count
from evalspark.operators import cleaning, describe, rubric, sampling, scoring, sigtest, store
from evalspark.sources import buckets, sheet, stores, tables
from evalspark.streaming import landing

# Published test rows (a wrong b right, a right b wrong, p, significant of 15).
PUBLISHED = [
    (0, 18, 8e-06, True), (0, 0, 1.0, False), (18, 0, 8e-06, True),
    (3, 28, 5e-06, True), (7, 5, 0.774414, False), (8, 3, 0.226562, False), (3, 11, 0.057373, False),
    (4, 20, 0.001544, True), (30, 3, 1e-06, True), (30, 0, 0.0, True), (21, 4, 0.000911, True),
    (15, 6, 0.078354, False), (6, 3, 0.507812, False), (3, 13, 0.021271, False), (0, 18, 8e-06, True),
    (3, 16, 0.004425, False), (1, 22, 6e-06, True), (6, 14, 0.115318, False),
]


def test_published_mcnemar_rows(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(PUBLISHED)], "i int, b long, c long, p double, s boolean")
    got = sigtest.mcnemar_exact(rows, "b", "c").withColumn("sig", F.col("p_value") < 0.05 / 15).collect()
    assert all(abs(r["p_value"] - r["p"]) < 1e-6 and r["sig"] == r["s"] for r in got)


def test_mcnemar_large_counts(spark):
    row = spark.createDataFrame([(900, 1000), (5000, 5200)], "b long, c long")
    for r in sigtest.mcnemar_exact(row, "b", "c").collect():
        n, m = r["b"] + r["c"], min(r["b"], r["c"])
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(m + 1)]
        assert r["p_value"] == pytest.approx(min(1.0, 2 * sum(math.exp(x) for x in logs)), rel=1e-8)


def quoted_task(spark):
    """182 cases right for all six raters, 18 cases wrong for the second rater only."""
    return spark.range(200).select(
        F.col("id").alias("case_id"),
        F.explode(F.array(*[F.struct(F.lit(f"m{j}").alias("model"),
                                     F.when((F.col("id") < 18) & F.lit(j == 1), 0).otherwise(1).alias("correct"))
                            for j in range(6)])).alias("s"),
    ).select("case_id", "s.*")


def test_published_q_and_alpha(spark):
    patterns = sigtest.answer_patterns(quoted_task(spark))
    q = sigtest.cochrans_q(patterns).first()
    assert q["q"] == pytest.approx(90.0) and q["df"] == 5 and q["p_value"] == pytest.approx(6.7e-18, rel=0.02)
    tests = sigtest.bonferroni(sigtest.mcnemar_exact(sigtest.pairwise_discordant(patterns)))
    assert tests.count() == 15 and round(tests.first()["bonferroni_alpha"], 5) == 0.00333
    assert tests.filter("significant").count() == 5


def test_q_undefined_when_all_agree(spark):
    same = quoted_task(spark).withColumn("correct", F.lit(1))
    q = sigtest.cochrans_q(sigtest.answer_patterns(same)).first()
    assert q["q"] is None and q["p_value"] is None


def test_chi_square_tail():
    assert chi2_upper(66.667, 5) == pytest.approx(5.1e-13, rel=0.02)
    assert chi2_upper(3.841459, 1) == pytest.approx(0.05, rel=1e-5)
    assert chi2_upper(9.487729, 4) == pytest.approx(0.05, rel=1e-5)
    assert chi2_upper(0.0, 3) == 1.0


# Answers and the state a strict JSON reader gives them.
ANSWERS = [
    ('{"a":"x"}', "ok", "x"), ('```json\n{"a":"x"}\n```', "ok", "x"), ('```\n{"a":"x"}\n```', "ok", "x"),
    ("[1,2]", "not_object", None), ("5", "not_object", None), ("null", "not_object", None),
    ('{"a":', "parse_error", None), ("", "parse_error", None), (None, "parse_error", None),
    ('{"a":1} trailing', "parse_error", None), ('{"a":1}{"b":2}', "parse_error", None),
    ('{"a":1}] x', "parse_error", None), ('{"a":1},"z":2', "parse_error", None), ('{"a":1},{"b":2}', "parse_error", None),
    ('  {"a":" X "}\t\n', "ok", " X "), ('```\n{"a":"my json text"}\n```', "ok", "my  text"),
    ('{"a":null}', "ok", None), ('{"b":1}', "ok", None), ('{"a":1}', "ok", "1"), ("plain words", "parse_error", None),
]


def test_answer_states(spark):
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(ANSWERS)], "i int, raw string, state string, a string")
    for r in store.parse_answers(df, ["a"]).collect():
        assert (r["parse_state"], r["parsed"]["a"] if r["parsed"] else None) == (r["state"], r["a"]), r["raw"]


def test_empty_equals_empty_unless_required(spark):
    df = spark.createDataFrame([(1, '{"a":""}')], "case_id int, raw string")
    scored = store.parse_answers(df, ["a"]).withColumn("ground_truth", F.struct(F.lit(None).cast("string").alias("a")))
    assert scoring.field_correct(scored, ["a"]).first()["correct"] == 1
    assert scoring.field_correct(scored, ["a"], require_nonempty=True).first()["correct"] == 0


def test_text_functions(spark):
    texts = ["  Two\twords ", "", None, " \n", "one", "a b　c", " X\x1f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", normalize(F.col("t")).alias("n"), word_count(F.col("t")).alias("w")
    ).collect()
    for r in rows:
        assert r["n"] == (r["t"] or "").strip().lower() and r["w"] == len((r["t"] or "").split())


def test_amounts_as_text(spark):
    values = [1.0, 0.5, 1e7, 12345678.25, 1e15, 1e16, 1.5e22, 0.001, 0.0001, 0.00001234, -2.5e9, 0.0, 100.0, 123456789012.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", amount_text(F.col("v")).alias("t"))
    assert [(r["v"], r["t"]) for r in rows.collect()] == [(v, repr(v)) for v in values]


def test_descriptions(spark):
    record = spark.createDataFrame(
        [("u", "Steel Making", "GLO", "Steel", "kg", 1.0), ("v", "Iron", "XX", "Ore", "kg", 2.5)],
        "activity_uuid string, activity_name string, geography string, reference_product_name string, "
        "reference_product_unit string, reference_product_amount double",
    )
    quoted = [r["description"] for r in describe.render(record).collect()]
    assert "'Steel Making', located in the region 'GLO'. It produces 1.0 kg of 'Steel'" in quoted[0]
    hard = [r["description"] for r in describe.render_hard(record).collect()]
    assert "steel making" in hard[0] and "in worldwide." in hard[0] and "in the region coded XX." in hard[1]


def test_rubric_patterns(spark):
    df = spark.createDataFrame(
        [("The GOAL and scope; cradle-to-gate system. Capital goods excluded, ISO 14044.",), ("goalkeeper",), (None,), ("",)],
        "draft string",
    )
    rows = rubric.rubric_flags(df, "draft", rubric.STRUCTURAL | rubric.PRECISION).collect()
    first = rows[0].asDict()
    assert [first[c] for c in ("goal_purpose", "system_boundaries", "capital_goods", "iso_citation")] == [1, 1, 1, 1]
    assert first["target_audience"] == 0
    assert all(sum(v for k, v in r.asDict().items() if k != "draft") == 0 for r in rows[1:])


def test_completeness_counts_missing_drafts(spark):
    df = spark.createDataFrame([("a", "goal"), ("a", None)], "model string, draft string")
    flags = rubric.rubric_flags(df, "draft", {"g": ["goal"]})
    row = rubric.completeness(rubric.rubric_counts(flags, ["g"]), ["g"], F.lit(2)).first()
    assert (row["n_present"], row["n_possible"], row["completeness_pct"]) == (1, 2, 50.0)
    assert rubric.avg_words(df.filter("draft is null")).first()["avg_words"] == 0.0
    assert rubric.missing_drafts(df).first()["missing_drafts"] == 1


def test_sample_does_not_depend_on_layout(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = sampling.sample_n(df.repartition(1), "k", 50, 7).collect()
    b = sampling.sample_n(df.repartition(13), "k", 50, 7).collect()
    assert a == b and [r["id"] for r in a] == list(range(50))


def test_large_sample_is_the_small_one(spark):
    df = spark.range(2000).select(F.when(F.col("id") > 2, F.col("id")).alias("k"))  # three rows without a key
    for n in (2, 1000, 2000, 2500):
        want = sampling.sample_n(df, "k", n, 7, 10).select("id", "k").collect()
        got = sampling.sample_n(df, "k", n, 7, 10, few=1 if n == 2 else 5).select("id", "k").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == min(n, 2000)
    one = spark.range(900).select(F.lit(1).alias("k"))  # a key alone
    assert [r["id"] for r in sampling.sample_n(one, "k", 400, 7, few=5).orderBy("id").collect()] == list(range(400))
    chosen = sampling.sample_n(df.dropna(), "k", 900, 7, few=5)
    more = sampling.extend_sample(df.dropna(), chosen, "k", 900, 8, 900, few=5).collect()
    assert sorted(r["id"] for r in more) == list(range(900, 1800)) and not {r["k"] for r in more} & {r["k"] for r in chosen.collect()}


def test_upsert_keeps_old_answer_on_failure(spark):
    old = spark.createDataFrame([(1, "m", "x"), (2, "m", None)], "case_id int, model string, raw string")
    patch = spark.createDataFrame([(1, "m", None), (2, "m", "y"), (3, "m", "z")], "case_id int, model string, raw string")
    assert {r["case_id"]: r["raw"] for r in store.upsert(old, patch).collect()} == {1: "x", 2: "y", 3: "z"}


def test_missing_and_numbers(spark):
    df = spark.createDataFrame([("1",), ("n/a",), ("",), ("nan",), (None,), ("2.5",)], "x string")
    clean = cleaning.coerce_numeric(df, ["x"])
    assert [r["x"] for r in clean.collect()] == [1.0, None, None, None, None, 2.5]
    assert cleaning.missing_overall(clean, ["x"]).first()["missing_cells"] == 4
    assert cleaning.missing_overall(clean.limit(0), ["x"]).first()["pct_missing"] is None


def test_sheet(spark, tmp_path):
    lines = [
        ",,,,,,,IPCC,IPCC,,", ",,,,,,,climate change,climate: fossil,,", ",,,,,,,GWP100,GWP20,,",
        "uuid,,name,geo,product,unit,amount,kg,kg,,", 'u1,,"steel, hot",GLO,steel,kg,1,0.5,n/a,,',
        "u2,,,GLO,steel,kg,1,2.0,3.0,,", "u3,,iron,CH,ore,kg,2,1.5,2.5,,",
    ]
    path = tmp_path / "sheet.csv"
    path.write_text("\n".join(lines) + "\n")
    df = sheet.read_sheet(spark, str(path), [(2, "activity_name"), (3, "geography")], 7, "activity_name")
    assert df.columns == ["activity_name", "geography", "climate change: GWP100 [IPCC]", "climate: fossil: GWP20 [IPCC]"]
    assert sorted(tuple(r) for r in df.collect()) == [("iron", "CH", 1.5, 2.5), ("steel, hot", "GLO", 0.5, None)]


def test_sheet_with_line_breaks_and_repeated_header_text(spark, tmp_path):
    head = [",,,,,,,M,M", ",,,,,,,c,d", ",,,,,,,i,j", "uuid,,name,geo,product,unit,amount,kg,kg"]
    (tmp_path / "a.csv").write_text("\n".join([*head, 'u1,,"two\nlines",GLO,p,kg,1,1,nan', "uuid,,name,geo,product,unit,amount,kg,kg"]) + "\n")
    (tmp_path / "b.csv").write_text("u3,,third,CH,p,kg,1,3,4\n")
    df = sheet.read_sheet(spark, str(tmp_path), [(2, "name")], 7, "name")
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == [("name", None, None), ("third", 3.0, 4.0), ("two\nlines", 1.0, None)]


def test_large_split_takes_no_time():
    start = time.perf_counter()
    p = split_probability(5 * 10**8, 5_001 * 10**5)
    assert 0.0015 < p < 0.0016 and time.perf_counter() - start < 1


def test_pretty_printed_store(spark, tmp_path):
    (tmp_path / "s.json").write_text('{\n "1": {"id": 1, "a_raw": "x", "b_raw": null},\n "10": {"a_raw": "y"}\n}')
    rows = stores.read_store(spark, str(tmp_path), ["a", "b"], whole_file=True).collect()
    assert sorted(tuple(r) for r in rows if r["raw"]) == [(1, "a", "x"), (10, "a", "y")] and len(rows) == 4


def test_verify_sink_sees_a_difference(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, g string")
    df.filter("k = 1").write.parquet(str(tmp_path / "t"))
    checks = {r["check"]: r["ok"] for r in tables.verify_sink(df, str(tmp_path / "t"), "g").collect()}
    assert checks == {"rows where g = a": True, "rows where g = b": False, "rows": False, "columns of the same type": True}


def test_landing_can_restart(spark, tmp_path):
    src, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    first = spark.createDataFrame([(1, "m", '{"a":"x"}', 0), (2, "m", '{"a":"y"}', 0)], landing.ANSWER_SCHEMA)
    first.write.mode("append").json(src)
    for _ in range(2):  # the second run finds nothing new
        landing.land_stream(spark, src, out, state, ["a"]).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    later = spark.createDataFrame([(1, "m", None, 1), (2, "m", '{"a":"z"}', 1)], landing.ANSWER_SCHEMA)
    later.write.mode("append").json(src)
    landing.land_stream(spark, src, out, state, ["a"]).awaitTermination()
    got = {r["case_id"]: r["parsed"]["a"] for r in landing.latest(spark, out).collect()}
    assert got == {1: "x", 2: "z"}


def _files(folder):
    return sorted((os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_buckets_rewrite_what_a_patch_touches(spark, tmp_path):
    rows = [(i, m, f"{m}{i}") for i in range(200) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "case_id long, model string, raw string")
    kept = buckets.BucketStore.create(spark, str(tmp_path / "s"), df.schema, buckets=16)
    assert kept.read().count() == 0
    assert kept.upsert(df) == 1
    before, held = _files(tmp_path / "s"), kept.manifest()[2]
    patch = spark.createDataFrame([(7, "a", "new"), (7, "a", None)], df.schema)
    assert kept.upsert(patch) == 2
    after = _files(tmp_path / "s")
    assert set(before) < set(after) and len(after) == len(before) + 1  # one bucket written, the other files untouched
    now = kept.manifest()[2]
    assert sum(now[b] != held[b] for b in now) == 1
    want = {(i, m): r for i, m, r in rows} | {(7, "a"): "new"}
    assert {(r["case_id"], r["model"]): r["raw"] for r in buckets.BucketStore(spark, str(tmp_path / "s")).read().collect()} == want
    assert kept.upsert(patch.limit(0)) == 2


def test_buckets_after_a_failure(spark, tmp_path):
    df = spark.createDataFrame([(1, "m", "x"), (2, "m", None)], "case_id long, model string, raw string")
    kept = buckets.BucketStore.create(spark, str(tmp_path / "s"), df.schema, buckets=4)
    kept.upsert(df, batch=0)
    # Data of a version without a manifest are of a run that failed: nobody reads them, the next run writes over them.
    df.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / "s/data/version=2"))
    assert kept.read().count() == 2
    patch = spark.createDataFrame([(2, "m", "y"), (3, "m", "z")], df.schema)
    for _ in range(2):  # the same batch again changes nothing
        assert kept.upsert(patch, batch=1) == 2
    assert sorted((r["case_id"], r["raw"]) for r in kept.read().collect()) == [(1, "x"), (2, "y"), (3, "z")]


def test_states_are_counted_without_the_texts(spark, tmp_path):
    rows = [(i, "m", '{"a":"x"}', 0) for i in range(20)] + [(0, "m", None, 1), (1, "m", "[1]", 1), (None, "m", '{"a":"y"}', 0)]
    spark.createDataFrame(rows, landing.ANSWER_SCHEMA).write.json(f"{tmp_path}/in")
    landing.land_stream(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/state", ["a"]).awaitTermination()
    whole, states = (landing.latest(spark, f"{tmp_path}/store", columns=c) for c in (None, ["parse_state"]))
    assert sorted(map(str, states.collect())) == sorted(map(str, whole.select(*states.columns).collect()))
    assert states.columns == ["case_id", "model", "parse_state"] and states.filter("parse_state = 'ok'").count() == 20
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "parsed" not in plan  # neither read nor sorted
    assert "raw" not in plan.split("Project")[0]  # read to rank by, but not sorted


def test_landing_compacted_again_and_again(spark, tmp_path):
    src, out, state, packed = (str(tmp_path / d) for d in ("in", "out", "state", "packed"))
    for version, rows in enumerate(([(1, '{"a":"x"}'), (2, None)], [(1, None), (2, '{"a":"y"}')], [(3, '{"a":"z"}')])):
        spark.createDataFrame([(i, "m", r, version) for i, r in rows], landing.ANSWER_SCHEMA).write.mode("append").json(src)
        landing.land_stream(spark, src, out, state, ["a"]).awaitTermination()
        target = landing.compact(spark, out, packed, buckets=4) if version < 2 else target
        again = landing.compact(spark, out, packed, buckets=4) if version == 0 else target
        assert again.manifest()[0] == target.manifest()[0]
    assert target.read().count() == 2
    for compacted in (None, target):
        got = {r["case_id"]: r["parsed"]["a"] for r in landing.latest(spark, out, compacted=compacted).collect()}
        assert got == {1: "x", 2: "y", 3: "z"}


def test_bit_slices_of_many_raters(spark):
    """Sixty raters with gaps, repeated and missing rows, and one that is never right, beside counting case by case."""
    draw = random.Random(6)
    right = {(c, f"r{m:02d}"): int(draw.random() < (0 if m == 59 else 0.3 + 0.01 * m)) for c in range(400) for m in range(60) if draw.random() > 0.1}
    rows = [(c, m, v) for (c, m), v in right.items()]
    df = spark.createDataFrame(rows + rows[:50], "case_id long, model string, correct int")
    got = {(r["model_a"], r["model_b"]): (r["a_wrong_b_right"], r["a_right_b_wrong"]) for r in sigtest.pairwise_discordant_bits(df, cases_per_group=1).collect()}
    names = sorted({m for _, m in right})
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            pairs = [(right.get((c, a), 0), right.get((c, b), 0)) for c in range(400)]
            want[a, b] = pairs.count((0, 1)), pairs.count((1, 0))
    assert got == want
    few = df.filter("model < 'r06'")
    a, b = sigtest.cochrans_q(sigtest.answer_patterns(few)).first(), sigtest.cochrans_q_bits(few).first()
    assert a["n_raters"] == b["n_raters"] and b["q"] == pytest.approx(a["q"]) and b["p_value"] == pytest.approx(a["p_value"])
    assert sigtest.pairwise_discordant_bits(df.limit(0)).count() == 0


def test_patterns_are_counted_in_as_many_tasks_as_the_session_shuffles_into(spark, tmp_path, monkeypatch):
    from evalspark import fixtures

    rows = [(u, t) for u in range(40) for t in fixtures.EVENT_TYPES[: 1 + u % 5]] + [(7, "view"), (None, "view")]
    events = spark.createDataFrame(rows, "user_id long, event_type string").withColumn("ts", F.lit("2024-01-02").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    blocks = fixtures.blocks(spark, str(tmp_path))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert blocks.rdd.getNumPartitions() == tasks > 1

    plans, cut = [], sigtest.cut
    monkeypatch.setattr(sigtest, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    patterns = sigtest.answer_patterns(blocks)
    per_case = plans[0].split("collect_list")[-1].split("Expand")[0]  # from the patterns down to the rows of the raters
    assert "REPARTITION_BY_NUM" in per_case and "ENSURE_REQUIREMENTS" not in per_case
    assert patterns.agg(F.sum("n_cases")).first()[0] == 41
    pairs = {(r["model_a"], r["model_b"]): r["a_right_b_wrong"] for r in sigtest.pairwise_discordant(patterns).collect()}
    assert pairs["click", "view"] == 31 and pairs["click", "error"] == 8
