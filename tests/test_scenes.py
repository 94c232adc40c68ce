"""Rules matched and counted per scene, against the evidence in rows."""

from pyspark.sql import functions as F

from trackloom.operators import masking, rules


def facts(spark):
    rows = []
    for e in range(30):
        label = e % 3 == 0
        rows.append((e, label, f"segment_state(S,{'slow' if e % 2 else 'fast'}).", None))
        for o in range(e % 4):
            rows += [(e, label, f"object_class(S,O,{'car' if (e + o) % 2 else 'bus'}).", o), (e, label, f"object_near(S,O,{(e * o) % 3}).", o)]
        if e % 5 == 4:
            # a track seen twice has the templates of both
            rows += [(e, label, "object_class(S,O,van).", 0), (e, label, "object_class(S,O,tram).", 0)]
    return spark.createDataFrame(rows, "example_id int, label boolean, template string, o int").distinct()


def keyed(df, *names):
    return {tuple(str(r[n]) for n in names): r for r in df.collect()}


def test_scenes_count_as_the_evidence_does(spark):
    f = facts(spark)
    scenes = rules.scenes(f)
    got = rules.summarize_scenes(scenes, rules.situations(scenes), 3, "example_id")
    pairs = rules.extend_evidence(rules.as_bodies(f), f)
    columns = ["positive_support", "negative_support", "positive_firings", "negative_firings", "confidence"]
    wanted = rules.unary_rules(f, 0).select("body", *columns)
    for evidence in (pairs, rules.extend_evidence(pairs, f)):
        wanted = wanted.unionByName(rules.summarize(evidence, ["body"]).select("body", *columns))
    a, b = ({k: tuple(r[c] for c in columns) for k, r in keyed(x, "body").items()} for x in (got, wanted))
    assert a == b


def test_scenes_fire_the_rules_that_match_and_move_no_rows(spark):
    f = facts(spark)
    scenes = rules.scenes(f).repartition(4, "example_id")
    kinds = rules.situations(scenes).persist()
    pool = rules.candidate_bodies(kinds, 2).persist()
    found = rules.fired_bindings(scenes, kinds, pool, "example_id")
    got = {(r.example_id, r.rule_id) for r in found.select("example_id", F.explode("fired").alias("rule_id")).collect()}
    assert got == {(r.example_id, r.rule_id) for r in rules.match_counts(pool, f).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(example_id" in plan and "hashpartitioning(rule_id" not in plan


def test_masks_of_scenes_are_those_of_rows(spark):
    rows = [(1, 1, True, 0.9), (2, 1, False, 0.9), (2, 2, False, 0.9), (3, 1, True, 0.9), (3, 2, True, 0.4), (3, 3, True, 0.4), (4, 2, False, 0.4)]
    fired = spark.createDataFrame(rows, "example_id int, rule_id int, label boolean, confidence double")
    listed = fired.groupBy("example_id", "label").agg(F.collect_list(F.struct("confidence", "rule_id")).alias("fired"))
    flat = masking.mask_rules(fired)
    columns = ["label", "rules", "top", "masked_score", "delta", "flipped", "influence"]
    a, b = ({k: tuple(r[c] for c in columns) for k, r in keyed(x, "example_id", "rule_id").items()} for x in (masking.mask_scenes(listed), flat))
    assert a == b
    names = ["triggers", "flips", "redundant", "delta_max", "key_rule", "key_influence", "mostly_redundant"]
    a, b = ({k: tuple(r[c] for c in names) for k, r in keyed(x, "example_id").items()} for x in (masking.scene_summary(listed), masking.example_summary(flat)))
    assert a == b


def test_alike_scenes_count_as_single_ones_and_select_the_same_rules(spark):
    from trackloom.operators import greedy, metrics

    f = facts(spark)
    scenes = rules.scenes(f)
    kinds = rules.situations(scenes).persist()
    each = rules._situated(scenes).groupBy("example_id", "label").agg(F.sort_array(F.collect_list("situation")).alias("situations"))
    rows = rules.alike(each).persist()
    # 30 scenes in fewer rows
    assert rows.count() < 30 and rows.agg(F.sum("n")).first()[0] == 30
    key = ["label", "situations"]
    columns = ["positive_support", "negative_support", "positive_firings", "negative_firings", "confidence"]
    counted = [rules.summarize_scenes(s, kinds, 2, k).select("body", *columns) for s, k in ((rows, key), (scenes, "example_id"))]
    a, b = ({k: tuple(r[c] for c in columns) for k, r in keyed(x, "body").items()} for x in counted)
    assert a == b
    pool = rules.candidate_bodies(kinds, 2).persist()
    fired = rules.fired_bindings(rows, kinds, pool, key).select("label", F.array_distinct("fired").alias("fired"), "n")
    single = rules.match_counts(pool, f)
    assert greedy.oracle_curve(fired, 10, 4) == greedy.oracle_curve(single, 10, 4) != []
    given = pool.select("rule_id", F.lit(0.5).alias("confidence"), F.col("rule_id").cast("string").alias("family"), F.lit(0).alias("negative_support"))
    assert greedy.select_diverse(given, fired, 3) == greedy.select_diverse(given, single, 3) != []
    scored = spark.createDataFrame([(1, 0.9, 2), (0, 0.9, 1), (0, 0.2, 3), (1, 0.1, 1)], "label int, score double, n int").withColumn("m", F.lit("m"))
    flat = scored.withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    assert metrics.roc_auc(scored, ["m"], F.col("n")).collect() == metrics.roc_auc(flat, ["m"]).collect()


def test_a_track_seen_twice_has_the_templates_of_both(spark, tmp_path):
    from trackloom.plans.views import Inputs

    orders = [(k, 1, f"1998-01-0{k}", "3-MEDIUM", "F") for k in (1, 2, 3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string, o_orderstatus string").withColumn(
        "o_orderdate", F.to_timestamp("o_orderdate")
    ).write.parquet(f"{tmp_path}/orders.parquet")
    items = [(1, 1, 1, 5.0, 0.0, "A"), (1, 2, 1, 5.0, 0.05, "A"), (1, 1, 2, 5.0, 0.0, "A")]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "A"), (2, "B")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.scene: r.situations for r in Inputs(spark, str(tmp_path)).scenes().collect()}
    free = "segment_forward_state(S,stopping)."
    one = ["object_class(S,O,a).", "object_distance_state(S,O,near).", "object_x_position_state(S,O,left_of_ego).", free]
    both = [one[0], "object_class(S,O,b).", one[1], "object_x_position_state(S,O,centered).", *one[2:]]
    assert got == {1: sorted(["\n".join(one), "\n".join(both)]), 2: [free]}
