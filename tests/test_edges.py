"""Inputs that the driver tables do not hold: each case failed once, or guards a rule the tables never reach."""
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from stargraph.functions import text as X
from stargraph.operators import aggregates as A
from stargraph.operators import graph as G
from stargraph.operators import reviews as R
from stargraph.plans import intents as Q
from stargraph.plans import registry
from stargraph.plans import retrieval as RT
from stargraph.session import is_local_master, local_path, scratch_path
from stargraph.sources import files as S
from stargraph.sources import batches, graph_store, review_export
from stargraph.streaming import reload as ST

ROW = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def deliver(spark, base, number, rows):
    spark.createDataFrame(rows, ROW).write.parquet(ST.delivery_path(f"{base}/in", number))


def load(spark, base, checkpoint):
    t = ST.run_reload(spark, f"{base}/in", ROW, f"{base}/table", f"{base}/{checkpoint}", ["k"], ["v"])
    return {r.k: r.v for r in t.collect()}


def test_reload_with_a_new_checkpoint_sees_the_new_delivery(spark):
    base = scratch_path(spark, "reload-test")
    deliver(spark, base, 1, [(1, "a"), (2, "a"), (3, "a")])
    assert load(spark, base, "c1") == {1: "a", 2: "a", 3: "a"}
    deliver(spark, base, 2, [(2, "b")])
    assert load(spark, base, "c1") == {1: "a", 2: "b", 3: "a"}
    deliver(spark, base, 3, [(2, "B"), (4, "x")])
    assert load(spark, base, "c2") == {1: "a", 2: "B", 3: "a", 4: "x"}
    assert load(spark, base, "c2") == {1: "a", 2: "B", 3: "a", 4: "x"}


def test_reload_replays_and_rewrites_only_touched_buckets(spark):
    base = scratch_path(spark, "reload-replay")
    run = ST.upsert_batch(f"{base}/t", ["k"], ["v"], checkpoint="c")
    rows = spark.createDataFrame([(i, "a", 1) for i in range(200)], "k long, v string, load_no int")
    run(rows, 0)
    first = ST.manifest(spark, f"{base}/t")
    run(rows.limit(0), 1)
    run(rows, 0)  # the same micro-batch again
    assert ST.manifest(spark, f"{base}/t") == first
    run(spark.createDataFrame([(7, "b", 2)], rows.schema), 2)
    second = ST.manifest(spark, f"{base}/t")
    assert sum(second["folders"][b] != f for b, f in first["folders"].items()) == 1
    t = ST.read_table(spark, f"{base}/t", rows.schema)
    assert t.count() == 200 and t.filter("v = 'b'").count() == 1
    for epoch in range(3, 8):
        run(spark.createDataFrame([(7, "c", epoch)], rows.schema), epoch)
    assert len(ST.completed_versions(spark, f"{base}/t")) == ST.KEEP_VERSIONS
    assert ST.read_table(spark, f"{base}/t", rows.schema).count() == 200


def test_every_written_file_has_the_header(spark):
    df = spark.createDataFrame([(i, f"# v\t{i}\\\n \u0001") for i in range(10)], "id long, v string").repartition(3)
    path = scratch_path(spark, "tsv-split")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        S.write_tsv_noquote(df.withColumn("v", X.clean_text("v")), path)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    back = S.read_tsv(spark, path, ["id", "v"]).collect()
    assert sorted(int(r.id) for r in back) == list(range(10)) and all(r.v.startswith("# v ") for r in back)
    empty = scratch_path(spark, "tsv-empty")
    S.write_tsv_noquote(df.limit(0), empty)
    assert [r.value for r in spark.read.text(empty).collect()] == ["id\tv"]


def test_csv_columns_follow_the_header(spark):
    path = scratch_path(spark, "csv-order")
    lines = spark.createDataFrame([('en,1,"a\n\nb",x',), ("de,2,c",), ("fr,3,d,y,z",)], "line string").coalesce(1)
    S.write_lines_with_header(lines, "lang,doc_id,body,more", path)
    wanted = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("body", T.StringType()), T.StructField("none", T.StringType())])
    rows = {r.doc_id: r for r in S.read_csv_tolerant(spark, path, wanted).collect()}
    assert set(rows) == {1, 2} and rows[1].body == "a\n\nb" and rows[1].none is None
    strict = S.read_csv_strict_arity(spark, path, ["body", "lang"]).collect()
    assert [tuple(r) for r in strict] == [("a\n\nb", "en")]
    report = S.cleaning_report(S.read_csv_all_records(spark, path, ["lang"])).first()
    assert (report.input, report.kept, report.dropped) == (3, 1, 2)


def test_split_csv_reads_records_over_block_borders(spark):
    rows = [(i, ("line %d\n" % i) * (i % 9) + 'a "q", b' * (i % 3) + "x" * (i % 50)) for i in range(400)]
    records = [('%d,"%s",t' % (i, v.replace('"', '""')) + (",extra" if i % 10 == 0 else ""),) for i, v in rows]
    path = scratch_path(spark, "csv-blocks")
    S.write_lines_with_header(spark.createDataFrame(records, "line string").coalesce(1), "id,v,t", path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        blocks = spark.read.text(path).select("_metadata.file_block_start").distinct().count()
        strict = S.read_csv_strict_arity(spark, path, ["id", "v"], split=True)
        got = {int(r.id): r.v for r in strict.collect()}
        whole = {int(r.id): r.v for r in S.read_csv_strict_arity(spark, path, ["id", "v"]).collect()}
        assert blocks > 20 and strict.count() == len(got)
        assert {i: v or "" for i, v in got.items()} == {i: v for i, v in rows if i % 10}
        assert got == whole
        report = S.cleaning_report(S.read_csv_all_records(spark, path, ["id"], split=True)).first()
        assert tuple(report) == (400, 360, 40)
        assert S.read_csv_tolerant(spark, path, ["id", "v", "t"], split=True).count() == 360
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_malformed_json_lines_are_dropped_and_counted(spark):
    path = scratch_path(spark, "jsonl")
    spark.createDataFrame([('{"a":1}',), ("{broken",), ('{"a":2}',)], "v string").write.text(path)
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert sorted(r.a for r in S.read_jsonl(spark, path, schema).collect()) == [1, 2]
    assert tuple(S.count_jsonl(spark, path, schema).first()) == (3, 2, 1)


def test_stars_reject_suffixes_and_keep_large_values(spark):
    given = ["3d", "5f", "2D", "9999999999", " 4.7 ", "-1.9", "nan", "", "1e3", "1e300"]
    df = spark.createDataFrame([(v,) for v in given], "v string")
    assert [r[0] for r in df.select(X.stars_to_int("v")).collect()] == [0, 0, 0, 9999999999, 4, -1, 0, 0, 1000, 0]


def test_request_and_response_defaults(spark):
    df = spark.createDataFrame([("q", "28 \n", ""), ("q", "\t", "c")], "question string, pid string, category string")
    got = [json.loads(r[0]) for r in df.select(RT.build_request(df, "question", "pid", "category")).collect()]
    assert got == [{"question": "q", "product_id": "28"}, {"question": "q", "category": "c"}]
    raw = spark.createDataFrame([('{"body":{"intent":"x"}}',), ('{"error":"e"}',)], "raw string")
    first, second = [r[0] for r in raw.select(RT.unwrap_body(F.col("raw"))).collect()]
    assert (first.answer, first.context, first.error) == ("", "", None)
    assert (second.answer, second.context, second.error) == (None, None, "e")


def test_context_values_survive_line_separators(spark):
    line = "\tTítulo: \u0085A\u2028B | Score bayesiano:\t4.5 | Avg stars: 5"
    row = RT.parse_context(spark.createDataFrame([(line,)], "context string")).first()
    assert row.product == "A\u2028B..." and row.score == "4.5" and row.reviews == "N/A"


def test_null_load_is_the_oldest(spark):
    rows = [(1, None, "old"), (1, 1, "new"), (2, None, "only")]
    df = spark.createDataFrame(rows, "k long, load_no int, v string")
    assert {r.k: r.v for r in R.keep_latest(df, ["k"], "load_no", ["v"]).collect()} == {1: "new", 2: "only"}


REVIEWS = "review_id long, reviewer_id long, product_id long, title string, category string, stars int, ts timestamp"


def small_reviews(spark):
    rows = [(1, 1, 1, "a", "007", 5), (2, 1, 2, "b", None, 4), (3, 1, 3, "c", "", 3), (4, 2, 1, "a", "007", 5), (5, 2, 2, "b", None, 2),
            (6, 2, 4, "d", "8", 1), (7, 1, 4, "d", "8", 1)]
    return spark.createDataFrame([(*r, None) for r in rows], REVIEWS)


@pytest.mark.parametrize("given", [(), ("products",), ("reviewed", "belongs_to", "co_purchased"), tuple(t for _, t in G.PARTS.values())])
def test_counts_in_shared_passes_equal_the_counts_of_the_tables(spark, given):
    odd = spark.createDataFrame([(8, None, 1, "a", "007", 5, None), (9, 2, None, "e", "8", 4, None), (10, None, None, None, None, 3, None)], REVIEWS)
    for reviews in [small_reviews(spark).unionByName(odd)] + ([] if given else [odd.limit(0)]):
        g = G.build_graph(reviews, bot_min_reviews=None, active_min_reviews=2)
        g = g.with_tables(**{t: getattr(g, t) for t in given})
        rows = [{(r.kind, r.name): r.n for r in df.collect()} for df in (G.count_graph(g), A.graph_counts(G.graph_parts(g)))]
        assert rows[0] == rows[1] and len(rows[0]) == 10


def test_counts_do_not_join_reviews(spark):
    """Four tables of the reviews come from one aggregation: no join but those of the pairs."""
    g = G.build_graph(small_reviews(spark), bot_min_reviews=None).with_tables(co_purchased=spark.range(3))
    plan = G.count_graph(g)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Expand") == 2  # the grouping sets and the rollup


def test_edges_of_reviews_without_category(spark):
    r = small_reviews(spark)
    assert {(x.reviewer_id, x.category) for x in A.active_in(r).collect()} == {(1, "007"), (1, "8"), (2, "007"), (2, "8")}
    co = {(x.src, x.dst): x for x in G.build_graph(r).co_purchased.collect()}
    assert co[(1, 4)].cross_cat and not co[(1, 2)].cross_cat and not co[(2, 4)].cross_cat
    assert A.category_affinity_directed(G.build_graph(r).co_purchased).count() == 1


def test_merge_categories_keeps_every_category(spark):
    frames = {c: spark.createDataFrame([(1,)], "review_id long") for c in ("a", "b", "c", "d", "e", "f", "seventh")}
    assert {r.category for r in G.merge_categories(frames).collect()} == set(frames)


def test_merge_categories_plan_does_not_grow(spark):
    from stargraph.plans import registry

    merged = registry.QUERIES["merge_categories"](spark, "/root/testdata/sf0.001")
    assert merged.select("category").distinct().count() > 2
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_stored_graph_keeps_types_and_usable_reviews(spark):
    base = scratch_path(spark, "small-graph")
    graph_store.write_graph_tables(G.build_graph(small_reviews(spark)), base)
    g = graph_store.load_graph(spark, base)
    assert {r.category for r in g.products.collect()} == {"007", "8", None}
    assert A.product_stats(g.reviews).count() == 4


def scanned_rows(df):
    """Rows that the file scans of a collected plan gave on, after the row groups that statistics and filters rule out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves() if "AdaptiveSparkPlan" not in plan.getClass().getName() else plan.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_anchored_lookup_reads_few_row_groups(spark):
    base = scratch_path(spark, "ranged-graph")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 50)
    try:
        graph_store.write_graph_tables(registry.graph(spark, SF_SMALL), base)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    g = graph_store.load_graph(spark, base)
    edges = spark.read.parquet(f"{base}/co_purchased")
    total, files = edges.count(), edges.select(F.input_file_name()).distinct().count()
    assert files > 10
    anchor = g.co_purchased.groupBy("dst").count().orderBy("count", "dst").first().dst
    first = g.co_purchased.filter(F.col("src") == g.co_purchased.first().src)
    second = g.co_purchased.filter(F.col("dst") == anchor)
    spans = edges.groupBy(F.input_file_name()).agg(F.min("dst").alias("lo"), F.max("dst").alias("hi"))
    inside = spans.filter((F.col("lo") <= anchor) & (F.col("hi") >= anchor)).count()
    assert scanned_rows(first) <= first.count() + 100 < total
    assert scanned_rows(second) <= 50 * max(3, inside // 3)  # statistics alone would leave every file whose span holds it
    built = registry.graph(spark, SF_SMALL)
    key = lambda df: sorted((r.src, r.dst, r.weight) for r in df.collect())
    assert key(g.anchored_edges([anchor])) == key(built.anchored_edges([anchor]))


def test_entity_contexts_and_fallbacks(spark):
    g = registry.graph(spark, SF_SMALL)
    known = g.co_purchased.first().src
    rows = [("copurchase", None, known), ("similar_to", None, -1), ("copurchase", None, None), ("top_by_category", None, None),
            ("weather", None, None), ("top_rated", None, None)]
    asked = spark.createDataFrame(rows, "intent string, category string, product_id long")
    out = {(r.intent, r.product_id): r.context for r in RT.answer_contexts(asked, RT.intent_contexts(g), g).collect()}
    want = Q.copurchase_by_product(g, known, k=15).count()
    assert len(out[("copurchase", known)].split("\n")) == want and out[("similar_to", -1)] == ""
    assert out[("copurchase", None)] and out[("copurchase", None)] != out[("copurchase", known)]
    assert out[("top_by_category", None)] == out[("weather", None)] == out[("top_rated", None)]


def test_batches_are_written_as_files(spark):
    path = scratch_path(spark, "batches")
    batches.send_batches(spark.range(2500).withColumnRenamed("id", "review_id"), "review_id", path, batch_size=100, bucket_rows=1000)
    per_file = spark.read.json(f"{path}/data").groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.countDistinct("batch").alias("b")).collect()
    assert sum(r.n for r in per_file) == 2500 and max(r.n for r in per_file) <= 100 and all(r.b == 1 for r in per_file)


def test_export_to_reviews(spark):
    raw, tsv, report = (scratch_path(spark, n) for n in ("raw", "tsv", "report"))
    lines = [('u1,5,"t ""x""\n1",p1,r1',), ("u1,3,ok,p2,r2",), ("u2,bad,ok,p1,",), ("u1,3,ok",)]
    S.write_lines_with_header(spark.createDataFrame(lines, "line string").coalesce(1), "reviewer_id,stars,review_title,product_id,review_id", raw)
    review_export.clean_reviews(spark, raw, tsv, report)
    got = sorted(tuple(r) for r in review_export.reviews_from_tsv(spark, tsv).collect())
    assert got == [("r1", "u1", "p1", "t x 1", None, 5, None), ("r2", "u1", "p2", "ok", None, 3, None)]
    assert tuple(spark.read.schema("input long, kept long, dropped long").json(report).first()) == (4, 3, 1)


def test_scratch_folder_needs_a_shared_one_off_local_masters():
    assert is_local_master("local") and is_local_master("local[4]") and is_local_master("local[*]")
    assert not is_local_master("local-cluster[2,1,1024]") and not is_local_master("spark://host:7077") and not is_local_master("yarn")


@pytest.mark.parametrize("folder", ["stargraph"])
def test_library_never_checkpoints_locally(folder):
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), folder)
    for where, _, names in os.walk(root):
        for name in names:
            if name.endswith(".py"):
                assert "localCheckpoint" not in open(os.path.join(where, name)).read(), name
    assert local_path("file:/x") == "/x"


def test_batches_are_sent_once_over_failures(spark):
    path = scratch_path(spark, "batches-failing")
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), "id")).alias("v"))
    how = dict(batch_size=30, bucket_rows=200)
    done = []

    def lost(wave):
        done.append(wave)
        if len(done) in (2, 4):
            raise OSError("lost")

    for _ in range(2):
        with pytest.raises(OSError):
            batches.send_batches(df, "k", path, after_wave=lost, **how)
    batches.send_batches(df, "k", path, **how)
    got = batches.sent_rows(spark, path, df.schema)
    assert sorted((r.k, r.v) for r in got.collect()) == sorted(map(tuple, df.collect()))
    before = spark.read.json(f"{path}/ledger").count()
    files = len(spark.read.json(f"{path}/data").inputFiles())
    batches.send_batches(df, "k", path, **how)
    assert spark.read.json(f"{path}/ledger").count() == before and len(spark.read.json(f"{path}/data").inputFiles()) == files
    changed = df.withColumn("v", F.when(F.col("k") == 5, F.lit("new")).otherwise(F.col("v")))
    batches.send_batches(changed, "k", path, **how)
    assert spark.read.json(f"{path}/ledger").count() == before + 1
    got = batches.sent_rows(spark, path, df.schema)
    assert sorted((r.k, r.v) for r in got.collect()) == sorted(map(tuple, changed.collect()))


def test_datasets_of_folders_in_one_scan(spark):
    root = scratch_path(spark, "datasets")
    names = ["Toys+Games 50%", "plain", "category=a=b", "ü"]
    for i, name in enumerate(names):
        df = spark.createDataFrame([(i, "t")], "review_id long, title string")
        (df.drop("title") if i % 2 else df).write.parquet(f"{root}/{name}")
    got = S.read_datasets(spark, root, T.StructType([T.StructField("review_id", T.LongType()), T.StructField("title", T.StringType())]))
    assert sorted((r.category, r.review_id, r.title) for r in got.collect()) == sorted(
        [("Toys+Games 50%", 0, "t"), ("plain", 1, None), ("a=b", 2, "t"), ("ü", 3, None)])


def test_subgraphs_of_a_table_of_questions(spark):
    from stargraph.plans import question_subgraphs as QS
    from stargraph.plans import subgraph as SG

    g = registry.graph(spark, SF_SMALL)
    known = g.co_purchased.first().src
    asked = [("top_rated", None, None), ("similar_to", None, known), ("copurchase", None, -1), ("copurchase", None, None),
             ("top_by_category", "STANDARD", None), ("top_by_category", "", None), ("combined_score", None, known), ("weather", None, None)]
    questions = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)] + [(99, *asked[1])], "q long, intent string, category string, product_id long")
    keyed, nodes, edges = QS.question_subgraphs(g, questions)
    summary = {r.q: (r.nodes, r.relationships) for r in QS.question_summary(g, questions).collect()}
    for key in keyed.filter("q in (1, 4, 6)").collect():
        _, rows = Q.subgraph_rows(g, key.intent, key.product_id if key.intent == "similar_to" else None, key.category)
        own = F.lit(True)
        for k in QS.KEYS:
            own = own & F.col(k).eqNullSafe(F.lit(key[k]))
        for many, one in ((nodes, SG.subgraph_nodes(rows, g.products)), (edges, SG.subgraph_edges(rows))):
            assert sorted(map(str, many.filter(own).drop(*QS.KEYS).collect())) == sorted(map(str, one.collect()))
        assert summary[key.q] == (nodes.filter(own).count(), edges.filter(own).count())
    assert summary[2] == (0, 0) and summary[99] == summary[1] and summary[5] == summary[7] == summary[0]


def test_files_of_a_wave_are_written_by_many_tasks(spark):
    """the files are the work, not their few bytes."""
    path = scratch_path(spark, "batches-tasks")
    batches.send_batches(spark.range(2500).withColumnRenamed("id", "k"), "k", path, batch_size=10, bucket_rows=50)
    files = spark.read.json(f"{path}/data").inputFiles()
    assert len(files) >= 250 and len({f.rsplit("/", 1)[1][:10] for f in files}) > 1


def test_cleaning_works_without_patterns(spark):
    """the same texts as by the patterns, which took most of the time."""
    from stargraph.functions import text as X

    odd = ["", None, "a", " a b ", "\t\r\n\"x\"\n", "\r\r\n\n\\", "a\\\\\"b\t", "é\xa0", "\x85", "　z ", "​q", "\x1cq\x1f", "᠎w", "🙂 \n",
           *[f"{c}m{c}" for c in X.WHITE_SPACE]]
    df = spark.createDataFrame([(v,) for v in odd], "v string")
    v = F.col("v")
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "\r\n", " "), "[\n\r\t]", " "), '"', "")
    was = [cleaned, F.regexp_replace(v, '"', '""'), F.regexp_replace(v, r"(?U)^\s+|\s+$", ""),
           F.regexp_replace(F.coalesce(v, F.lit("")), r'([\\\t\r\n"])', r"\\$1")]
    now = df.select(X.clean_text(v), X.double_quotes(v), X.strip(v), S.tsv_escape(v))
    assert [tuple(r) for r in now.collect()] == [tuple(r) for r in df.select(*was).collect()]
    latin = spark.createDataFrame([("abc",), ("",), (None,), ("Ã©a\x80",), ("é",)], "v string")
    assert [r[0] for r in latin.select(S._well_formed(v)).collect()] == ["abc", "", None, "éa", ""]
    plan = df.select(X.clean_text(v), X.double_quotes(v), X.strip(v), S.tsv_escape(v))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
