"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing names; and the pipeline."""

import collections

import pytest

import corpus_pipeline
from evalspark.llm.queries import QUERIES

GOOD = " ".join(f"Word{chr(97 + i % 26)}x and other{chr(97 + i % 26)}y things, plain{chr(97 + i % 26)}z text here." for i in range(24))
CLASH = "shard long, fingerprint string, f long, component_id string, row int, found int, node int, verdict string, rank int, _answer int, whole int"
MORE = (7, "x", 1, "c", 2, 3, 4, "v", 5, 6, 8)


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edges"))
    long = "lang " * 60_000 + "x" * 70_000
    docs = [
        (1, GOOD, "en", "a", len(GOOD)), (2, GOOD, "en", "a", len(GOOD)), (2, GOOD, "en", "a", len(GOOD)),
        (3, None, "en", "a", None), (4, "", "en", None, 0), (5, " \t\n ", None, None, 3), (6, long, "en", "b", len(long)),
        (None, GOOD + " null id", "en", "b", 10), (7, "éà 中文 \U0001f600 <|endoftext|> AKIA" + "Z" * 20, "fr", "b", 5), (None, None, None, None, None),
        (8, GOOD.upper(), "en", "b", 1), (9, 'password="abcdefghijklmnop" ' + " ".join(GOOD.split()[::-1]), "en", "c", 1), (10, "a b", "de", "c", 3), (11, "12 34", "de", "c", 3),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
    spark.createDataFrame([(*r, *MORE) for r in docs], schema).write.parquet(f"{d}/documents.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(20 * i, [0.1 * i, 0.5, -0.3]) for i in range(4)] + [(i, [0.25, 0.25, 0.25]) for i in (1, 2, 3, 3)]
    vectors += [(5, None), (6, [None, 1.0, 1.0]), (7, [nan, 0.0, 0.0]), (8, [inf, 0.0, 0.0]), (None, [0.0, 0.0, 0.0]), (80, []), (60, [0.1, 0.5, -0.3])]
    spark.createDataFrame([(*r, 1, "s", None) for r in vectors], "vec_id long, embedding array<float>, score int, vector string, label int").write.parquet(f"{d}/embeddings.parquet")
    pages = [
        (1, "https://WWW.Example.com/en/x?y#z", "<p>one<p>two &amp; three"), (2, None, None), (3, "no scheme", ""), (4, "http://net/es/", "<nav>menu</nav>"),
        (4, "http://net/es/", "<nav>menu</nav>"), (None, "http://a.b?x", "<div>" * 3000 + "deep"), (5, "://host", "<script>if (a<b) '</p>'</script><p>text" + " long" * 50_000),
    ]
    spark.createDataFrame([(*r, 1, "t") for r in pages], "page_id long, url string, html string, host int, text string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, edge_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "embeddings", "pages"):
        spark.read.parquet(f"{edge_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty(spark, empty_dir, name):
    assert (QUERIES | {"pipeline": corpus_pipeline.run})[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] in ("op4", "op5", "op6", "op7", "op8", "op9", "op11")])
def test_one_row_each(spark, edge_dir, name):
    rows = QUERIES[name](spark, edge_dir).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted([1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None, None], key=str)
    by_id = {r["doc_id"]: r for r in rows}
    if name.startswith("op4"):
        assert {by_id[i]["fingerprint"] for i in (3, 4, 5)} == {"0" * 16} and by_id[5]["component_id"] == 3
        assert by_id[2]["component_id"] == by_id[8]["component_id"] == 1  # upper case makes no difference
    if name.startswith("op5"):
        assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (3, 4, 5, 11))
        assert by_id[1]["lang_pred"] == "en"
    if name.startswith("op6"):
        assert by_id[3]["n_words"] == 0 and by_id[3]["base_failed"] and by_id[1]["kept"]
    if name.startswith("op7"):
        assert by_id[3]["size"] == 16 and by_id[3]["text_crc32"] == 0
    if name.startswith("op8"):
        assert by_id[3]["spans"] == "" and by_id[9]["n_assign"] == 1 and by_id[7]["n_access"] == 1
    if name.startswith("op9"):
        assert by_id[3]["n_tokens"] == 0 == by_id[4]["n_tokens"]
    if name.startswith("op11"):
        assert (by_id[3]["n"], by_id[3]["form"], by_id[5]["n"], by_id[6]["n"]) == (0, "plain", 1, 60_001)
        assert all((r["form"] == "plain") == (r["middle_chars"] is None) for r in rows)


def test_packing_edges(spark, edge_dir):
    rows = QUERIES["op3_packing"](spark, edge_dir).collect()
    tokens = collections.Counter()
    for r in rows:
        tokens[r["doc_id"]] += r["length"]
    assert tokens[3] == tokens[4] == 1 and tokens[2] == 2 * tokens[1] and len(tokens) == 12
    best = collections.Counter()
    for r in QUERIES["op13_best_fit"](spark, edge_dir).collect():
        best[r["doc_id"]] += r["length"]
    assert best == tokens


def test_codes_edges(spark, edge_dir):
    rows = QUERIES["op12_vector_codes"](spark, edge_dir).collect()
    assert sorted((r["vec_id"] for r in rows), key=str) == sorted([0, 20, 40, 60, 1, 2, 3, 3, None, 80, 60], key=str)
    assert all(r["error"] == 0 == r["label_error"] and len(r["code"]) == 32 for r in rows)  # fewer vectors than entries


def test_top_k_edges(spark, edge_dir):
    rows = QUERIES["op2_exact_top_k"](spark, edge_dir).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 60, 80}
    assert got[80] == [(i, 0) for i in (0, 1, 2, 3, 3, 20, 40, 60, 60)]  # an empty vector is one of zeros; ties to the smaller id
    assert all(q not in [i for i, _ in found] for q, found in got.items())


def test_pages_edges(spark, edge_dir):
    urls = QUERIES["op1_url_filter"](spark, edge_dir).collect()
    assert len(urls) == 7
    by_id = {r["page_id"]: r for r in urls}
    assert (by_id[1]["host"], by_id[1]["path"], by_id[1]["rule"], by_id[1]["verdict"]) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (by_id[2]["host"], by_id[2]["path"]) == ("", "") == (by_id[3]["host"], by_id[3]["path"])
    assert by_id[4]["rule"] == "net/es/" and (by_id[None]["host"], by_id[None]["path"]) == ("a.b", "") and by_id[5]["host"] == "host"
    text = {r["page_id"]: r for r in QUERIES["op10_html_extraction"](spark, edge_dir).collect()}
    assert text[1]["text"] == "one\ntwo & three" and text[2]["text"] == "" == text[4]["text"] and text[None]["text"] == "deep"
    assert text[5]["n_chars"] == len("text" + " long" * 50_000)


def test_pipeline_edges(spark, edge_dir):
    """Every stage on what the one before kept, beside what the operators say about it."""
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    names, ids = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, edge_dir).collect(), docs.schema)
        assert docs.columns == names
        ids.append(sorted((r["doc_id"] for r in docs.collect()), key=str))
    assert 11 not in ids[0] and {3, 4, 5}.isdisjoint(ids[0]) and {1, 2, 6, 7, 8, 9} <= set(ids[0])
    assert {6, 10, 7}.isdisjoint(ids[1]) and 1 in ids[1] and 9 in ids[1]
    assert ids[2].count(1) == 1 and 2 not in ids[2] and 9 in ids[2]
    text = {r["doc_id"]: r for r in docs.collect()}
    assert "abcdefghijklmnop" not in text[9]["text"] and text[9]["n_chars"] == len(text[9]["text"])
    assert text[1]["text"] == GOOD
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, edge_dir)
    assert {r["doc_id"] for r in packed.collect()} == set(ids[3])


def test_pipeline_is_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        kept.append({r["doc_id"] for r in docs.collect()})
    op6 = {r["doc_id"] for r in QUERIES["op6_quality_rules"](spark, sf).filter("kept").collect()}
    assert kept[1] == op6 and kept[2] < kept[1]
    groups = {r["doc_id"]: r["component_id"] for r in QUERIES["op4_simhash"](spark, sf).collect()}
    assert {groups[i] for i in kept[1]} == {groups[i] for i in kept[2]} and len({groups[i] for i in kept[2]}) <= len(kept[2])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == kept[3]


def test_pipeline_stages_bound_the_batches_that_reach_python(spark, edge_dir):
    """A batch of 10,000 texts, or of 64 MB, is held several times by each running task."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    name, rows = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    docs = spark.read.schema("doc_id long, text string, lang string, source string, n_chars long").parquet(f"{edge_dir}/documents.parquet")
    long = spark.range(0, 64, 1, 1).selectExpr("repeat('abcd ', 50000) as text")
    before = {c: spark.conf.get(c) for c in (name, rows)}
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, "64m")
            spark.conf.set(rows, "4096")
            stage(spark, docs, edge_dir)
            assert spark.conf.get(rows) == "512"
            assert long.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] < 5 << 20
        for given in ("1m", "4095k"):  # a smaller bound stays
            spark.conf.set(name, given)
            spark.conf.set(rows, "100")
            corpus_pipeline.pack(spark, docs, edge_dir)
            assert (spark.conf.get(name), spark.conf.get(rows)) == (given, "100")
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
