import math

import pytest
from pyspark.sql import functions as F

from kinweave.operators import decisions, exports, features, priors, retrieval, splits


def test_winner_ties_and_runner_up(spark):
    rows = [("x", "q", "7", 0.9), ("x", "q", "3", 0.9), ("x", "q", "5", 0.4), ("x", "p", "1", 0.2)]
    got = {r.query_id: (r.ref_id, r.score, r.runnerup_score) for r in decisions.winners(spark.createDataFrame(rows, "country string, query_id string, ref_id string, score double")).collect()}
    assert got == {"q": ("3", 0.9, 0.9), "p": ("1", 0.2, -1.0)}


def test_f_half(spark):
    row = spark.range(1).select(decisions.f_half(F.lit(1), F.lit(1), F.lit(2)).alias("a"), decisions.f_half(F.lit(1), F.lit(1.9), F.lit(2)).alias("b"), decisions.f_half(F.lit(0), F.lit(0), F.lit(0)).alias("c"), decisions.f_half(F.lit(0), F.lit(1), F.lit(0)).alias("d")).first()
    assert (row.a, round(row.b, 6), row.c, row.d) == (0.5, 0.367647, 1.0, 0.0)


def curve_by_hand(decided, truth, grid, stress):
    out = {}
    for b, t in enumerate(grid):
        values = []
        for ref, n in truth.items():
            own = [o for r, o, s in decided if r == ref and s >= t]
            tp, wrong, un = sum(o == ref for o in own), sum(o is not None and o != ref for o in own), sum(o is None for o in own)
            down = 4 * tp + 4 * (wrong + stress * un) + n
            values.append(1.0 if down == 0 else 5 * tp / down)
        out[b] = round(sum(values) / len(values), 9)
    return out


def test_curve_against_counting(spark):
    truth = {"a": 2, "b": 0, "c": 1}
    decided = [("a", "a", 0.9), ("a", None, 0.5), ("b", "a", 0.5), ("c", "c", 0.1), ("a", "a", 1.0)]
    df = spark.createDataFrame([("x", str(i), r, o, s) for i, (r, o, s) in enumerate(decided)], "country string, query_id string, ref_id string, owner_id string, score double")
    refs = spark.createDataFrame([("x", r, n) for r, n in truth.items()], "country string, ref_id string, truth long")
    grid = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {r.bin: (round(r.f_half, 9), round(r.f_stress, 9)) for r in decisions.metric_curve(df, refs, grid).collect()}
    plain, stressed = curve_by_hand(decided, truth, grid, 1.0), curve_by_hand(decided, truth, grid, 1.9)
    assert got == {b: (plain[b], stressed[b]) for b in plain}


def test_threshold_policies(spark):
    curve = spark.createDataFrame([("x", t, v) for t, v in ((0.1, 0.5), (0.2, 0.8), (0.3, 0.8), (0.4, 0.1))], "country string, threshold double, f_half double")
    assert [decisions.choose_threshold(curve, strictest=s).first().threshold for s in (True, False)] == [0.3, 0.2]


@pytest.mark.parametrize("q, r, wanted", [("101", "105", True), ("99", "101", False), ("101", "111", False), (None, "1", False), ("7", "7", False)])
def test_decoy(spark, q, r, wanted):
    names = F.array(F.lit("a"))
    assert spark.range(1).select(decisions.decoy(names, names, F.lit(q).cast("string"), F.lit(r).cast("string")).alias("x")).first().x is wanted


def test_priors(spark):
    rows = [("x", str(i), ["w"], i < 60) for i in range(100)] + [("x", f"y{i}", ["rare"], False) for i in range(19)] + [("x", f"z{i}", [], True) for i in range(19)]
    df = spark.createDataFrame(rows, "country string, entity_id string, tok array<string>, owned boolean")
    got = {r.token: r.prior for r in priors.token_priors(df, F.col("owned")).collect()}
    p0 = 79 / 138
    assert abs(got["w"] - (60 + 50 * p0) / 150) < 1e-12 and abs(got["rare"] - p0) < 1e-12


def test_dictionaries_leave_folds_out(spark):
    pairs = spark.createDataFrame([(0, ["क"], ["k"]), (0, ["क"], ["k"]), (1, ["क"], ["c"]), (2, ["क"], ["c"]), (3, ["क", "x"], ["k"])], "fold int, native array<string>, latin array<string>")
    got = {(r.scope, r.native): r.latin for r in priors.dictionaries(priors.spelling_counts(pairs, "native", "latin")).collect()}
    assert got == {("full", "क"): "c", ("0", "क"): "c", ("1", "क"): "k", ("2", "क"): "k", ("3", "क"): "c", ("4", "क"): "c"}


def test_a_native_token_needs_support_over_its_spellings(spark):
    pairs = spark.createDataFrame([(0, ["क"], ["k"]), (1, ["क"], ["c"]), (2, ["ख"], ["kh"])], "fold int, native array<string>, latin array<string>")
    got = {(r.scope, r.native): r.latin for r in priors.dictionaries(priors.spelling_counts(pairs, "native", "latin")).collect()}
    assert got == {(s, "क"): "c" for s in ("full", "2", "3", "4")}


def records(spark, rows):
    return spark.createDataFrame(rows, "country string, entity_id string, name_core string, address_clean string")


def test_retrieval_by_hand(spark):
    refs = records(spark, [("x", "1", "blue cafe", "1 main st"), ("x", "2", "blue bar", ""), ("y", "3", "blue cafe", "1 main st")])
    queries = records(spark, [("x", "q", "blue cafe", ""), ("x", "none", "", ""), ("z", "other", "blue", "")])
    scored = retrieval.scores(queries, refs)
    pairs = {(r.query_id, r.ref_id): r for r in retrieval.union_modes(scored, 10).collect()}
    assert set(pairs) == {("q", "1"), ("q", "2")}
    assert pairs["q", "1"].name_score == 1.0 and pairs["q", "1"].name_rank == 1 and pairs["q", "1"].address_rank == 11 and pairs["q", "1"].combo_score == 0.5
    limited = retrieval.union_modes(scored, 1).collect()
    assert [(r.query_id, r.ref_id) for r in limited] == [("q", "1")]
    sizes = refs.groupBy("country").count().withColumnRenamed("count", "refs")
    row = retrieval.context(retrieval.union_modes(scored, 10), sizes).first()
    assert row.name_best == 1.0 and row.address_best == 0.0 and row.address_second == 0.0


def test_both_paths_agree(spark):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 5)))
    rows = [(r.choice("xy"), str(i), " ".join(word() for _ in range(r.randrange(4))), " ".join(word() for _ in range(r.randrange(5)))) for i in range(120)]
    refs, queries = records(spark, rows[:50]), records(spark, rows[50:])
    wanted = retrieval.union_modes(retrieval.scores(queries, refs), 4)
    for tile in (1024, 7):
        got = retrieval.union_lists(retrieval.top_lists(queries, refs, 4, tile=tile), 4)
        assert sorted(map(tuple, got.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))


def test_tiles_rank_what_the_mask_leaves(spark):
    import random

    r = random.Random(6)
    rows = [("x", str(i), f"{r.choice('abcd') * 3} {r.choice('abcd') * 4}", f"{r.choice('abc') * 5}") for i in range(90)]
    refs, queries = records(spark, rows[:40]), records(spark, rows[40:])
    number = F.col("entity_id").cast("long")
    allowed = F.when(number % 3 == 0, 0).otherwise(F.pow(F.lit(2), number % 4)).cast("long")
    mask = F.when(number % 5 == 0, 3).when(number % 7 == 0, 0).otherwise(F.pow(F.lit(2), number % 4)).cast("long")
    wanted = retrieval.union_modes(retrieval.scores(queries, refs), 4, queries.select(F.col("entity_id").alias("query_id"), allowed.alias("allowed")), refs.select(F.col("entity_id").alias("ref_id"), mask.alias("mask")))
    columns = ["country", "query_id", "ref_id", "combo_score", "name_rank", "address_rank", "combo_rank"]
    got = retrieval.union_lists(retrieval.top_lists(queries, refs, 4, tile=16, allowed=allowed, mask=mask), 4)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, wanted.select(*columns).collect()))


def test_tiles_by_one_field_and_in_parts(spark):
    rows = [("xy"[i % 2], str(i), ["", "blue cafe", "Blue\tbar", "été 漢字 😀x", "blue"][i % 5] + " " * (i % 3) + "abc"[i % 3], "x") for i in range(90)]
    refs, queries = records(spark, rows[:40]), records(spark, rows[40:])
    wanted = retrieval.top_k(retrieval.scores(queries, refs, fields={"name": "name_core"}), "name", 4).select("country", "query_id", "ref_id", "name", "rank")
    lists = retrieval.top_lists(queries, refs, 4, tile=3, fields={"name": "name_core"}, most_refs=12)
    assert sorted(map(tuple, lists.select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))


def test_tiles_that_meet_are_not_shuffled(spark):
    # Tiles used to be dealt out once for each tile of the other side, which filled the disk at 1 GB.
    refs, queries = (records(spark, [("x", str(i), f"name {i}", "") for i in ids]) for ids in (range(40), range(40, 90)))
    plan = retrieval.top_lists(queries, refs, tile=7)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan


def test_one_list_alone_is_what_it_is_among_all(spark):
    import random

    r = random.Random(7)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 5)))
    rows = [(r.choice("xy"), str(i), " ".join(word() for _ in range(r.randrange(4))), " ".join(word() for _ in range(r.randrange(5)))) for i in range(120)]
    refs, queries = records(spark, rows[:50]), records(spark, rows[50:])
    for most_refs in (200_000, 12):
        every = retrieval.top_lists(queries, refs, 4, tile=7, most_refs=most_refs).where("mode = 'combo' and rank <= 2")
        alone = retrieval.top_lists(queries, refs, 2, tile=7, most_refs=most_refs, modes=("combo",), by_query=False)
        assert sorted(map(tuple, alone.select(*every.columns).collect())) == sorted(map(tuple, every.collect())) and alone.count() > 80


def test_only_tiles_stay_stored(spark):
    from pathlib import Path

    stored = lambda: len(list(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob("*/rdd-*")))
    refs, queries = records(spark, [("x", "1", "blue cafe", "")]), records(spark, [("x", "q", "blue cafe", "")])
    before = stored()
    lists = retrieval.top_lists(queries, refs)
    assert stored() == before + 1 and lists.count() == 2


def test_mask(spark):
    refs = records(spark, [("x", "1", "blue cafe", ""), ("x", "2", "blue cafe", "")])
    queries = records(spark, [("x", "q", "blue cafe", "")])
    allowed = spark.createDataFrame([("q", 2)], "query_id string, allowed long")
    masks = spark.createDataFrame([("1", 1), ("2", 2)], "ref_id string, mask long")
    pairs = retrieval.union_modes(retrieval.scores(queries, refs), 10, allowed, masks).collect()
    assert [r.ref_id for r in pairs] == ["2"]


@pytest.mark.parametrize("q, r, wanted", [("a b", "a b", 0), ("a", "a b", 1), ("a b", "a", 2), ("a c", "a b", 3), ("c", "a", 4), ("a c d", "a b", 5), ("", "a", 6)])
def test_name_relation(spark, q, r, wanted):
    from kinweave.operators import records as R

    given = [("q", "x", 2, q, "", None), ("r", "x", 1, r, "", None)]
    stats = R.record_stats(R.prepare(spark.createDataFrame(given, "entity_id string, country string, source int, raw_name string, raw_address string, owner_id string")))
    zero = {c: F.lit(0.0) for c in ("tw_full", "tw_num", "tw_name", "tw_addr", "wp_min", "wp_mean", "wp_low", "vocab_min", "r_name_mult", "r_claims")}
    stats = stats.withColumns(zero)
    pairs = spark.createDataFrame([("x", "q", "r")], "country string, query_id string, ref_id string")
    vocab = spark.createDataFrame([("x", "a", 1)], "country string, token string, freq long")
    out = features.perturb_features(features.sides(pairs, stats.where("source = 2"), stats.where("source = 1")), vocab)
    assert out.first().nr_rel == wanted
    assert features.non_finite(out, features.PERTURB).count() == 0 and len(features.PERTURB) == 31 and len(features.BASE) == 61


def test_pairs_are_looked_up_by_record_and_joined_twice(spark):
    from kinweave.operators import records as R

    given = [("q1", "x", 2, "a b zz", "Apt 0, 12 Rue 5b", None), ("q2", "x", 3, "", "", None), ("r1", "x", 1, "a c", "12 Rue 5b", None), ("r2", "x", 1, "a d d", "Unit 000", None)]
    stats = R.record_stats(R.prepare(spark.createDataFrame(given, "entity_id string, country string, source int, raw_name string, raw_address string, owner_id string")))
    zero = {c: F.lit(0.0) for c in ("tw_full", "tw_num", "tw_name", "tw_addr", "wp_min", "wp_mean", "wp_low", "vocab_min", "r_name_mult", "r_claims")}
    stats = stats.withColumns(zero)
    pairs = spark.createDataFrame([("x", q, r) for q in ("q1", "q2") for r in ("r1", "r2")], "country string, query_id string, ref_id string")
    vocab = spark.createDataFrame([("x", "a", 2), ("x", "b", 5), ("x", "c", 1), ("x", "d", 3), ("y", "zz", 9)], "country string, token string, freq long")
    q, r = stats.where("source <> 1"), stats.where("source = 1")
    plain = features.perturb_features(features.sides(pairs, q, r), vocab)
    ready = features.perturb_features(features.sides(pairs, features.with_frequencies(q, vocab), features.with_frequencies(r, vocab)), vocab)
    rows = {(x.query_id, x.ref_id): x for x in ready.collect()}
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, rows.values())) and len(rows) == 4
    assert rows["q1", "r1"].nr_q_only_vocab_min == 0 and math.isclose(rows["q1", "r1"].nr_r_only_vocab_min, math.log1p(1)) and math.isclose(rows["q1", "r2"].nr_r_only_vocab_min, math.log1p(3))
    assert rows["q2", "r1"].nr_q_only_vocab_min == -1 and rows["q2", "r1"].nr_rel == 6
    # Lists come out as they went in, empty ones and empty texts among them.
    kept = {x.q_entity_id: x for x in features.sides(pairs.where("ref_id = 'r1'"), q, r).collect()}
    for x in q.collect():
        assert all(kept[x.entity_id][f"q_{c}"] == x[c] for c, kind in q.dtypes if kind == "array<string>")
    # Wide rows meet no table of pairs: the only exchanges of pairs are those of the two joins.
    lists = features.sides(pairs, features.with_frequencies(q, vocab).checkpoint(), features.with_frequencies(r, vocab).checkpoint())
    assert features.perturb_features(lists.hint("merge"), vocab)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_exports_and_constraints(spark):
    refs = spark.createDataFrame([("1",), ("2",)], "ref_id string")
    pairs = spark.createDataFrame([("b", "1"), ("a", "1"), ("c", "1")], "query_id string, ref_id string")
    good = pairs.where("query_id <> 'c'")
    lists = exports.matches(refs, good)
    assert {r.ref_id: r.matches for r in lists.collect()} == {"1": "a,b", "2": ""}
    assert {r.violations for r in exports.constraints(refs, lists, good, pairs).collect()} == {0}
    bad = good.union(spark.createDataFrame([("a", "2")], "query_id string, ref_id string"))
    found = {r.constraint: r.violations for r in exports.constraints(refs, exports.matches(refs, bad), bad, pairs).collect()}
    assert found["one_owner"] == 1 and found["matches_are_candidates"] == 1


def test_isolation_keeps_sets_apart(spark):
    refs = spark.createDataFrame([("x", str(i)) for i in range(60)], "country string, entity_id string")
    roles = splits.roles(refs, 1, 10)
    counts = {r.role: r["count"] for r in roles.groupBy("role").count().collect()}
    assert counts[splits.TUNE] == counts[splits.CHECK] == 5
    assert {r.fold for r in roles.where(roles.role != splits.TRAIN).collect()} == {0} and roles.where("fold = 0 and role = 0").count() == 0
    with pytest.raises(Exception, match="fewer than 40 references"):
        splits.roles(refs, 1, 40).collect()
    assert {r.role for r in splits.roles(refs, 1, 40, need_all=False).where("fold = 0").collect()} == {splits.TUNE, splits.CHECK}
    queries = spark.createDataFrame([("x", f"q{i}", str(i)) for i in range(60)], "country string, entity_id string, owner_id string")
    pairs = spark.createDataFrame([("x", f"q{i}", str((i + 1) % 60)) for i in range(60)], "country string, query_id string, ref_id string")
    out = splits.isolation(queries, pairs, roles, 2, 1)
    assert out.where("eval and train").count() == 0 and out.where("eval").count() >= 10


def test_pair_features_are_those_of_the_terms(spark):
    # Each text was cleaned and cut into trigrams again for every kind of term: 0.1 GB took too long.
    from pyspark.ml.feature import HashingTF

    from kinweave.functions import text as T
    from kinweave.operators import models

    texts = ["", " | ", "Café Łódź GmbH | 12 Rue de l'Œuvre", "cafe lodz gmbh | 12 rue", "東京都 港区 | 1-2-3", "a", "a b", "ﬁne Ⅷ 😀 x𝔘y", "नमस्ते दुनिया", "aaa aaaa aaaaa", "İstanbul\tA\n.Ş", "x" * 300]
    df = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "i int, j int, a string, b string")
    a, b = (F.array_distinct(T.trigrams(T.clean_words(F.col(c)))) for c in ("a", "b"))
    tagged = lambda tag, grams: F.transform(grams, lambda g: F.concat(F.lit(tag), g))
    share = F.floor(10 * F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))).cast("int")
    grades = F.transform(F.sequence(F.lit(0), share), lambda i: F.concat(F.lit("j"), i.cast("string")))
    terms = df.withColumn("terms", F.concat(tagged("=", F.array_intersect(a, b)), tagged("<", F.array_except(a, b)), tagged(">", F.array_except(b, a)), grades))
    for size in (1 << 14, 97):
        wanted = HashingTF(inputCol="terms", outputCol="features", numFeatures=size, binary=True).transform(terms).select("i", "j", "features")
        coded = models.HashedPairScorer(features=size)._coded(df)
        assert sorted(coded.select("i", "j", "features").collect(), key=lambda r: r[:2]) == sorted(wanted.collect(), key=lambda r: r[:2])
        assert coded._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 2
    cleaned = df.select("i", "j", *[models.HashedPairScorer.clean(F.col(c)).alias(c) for c in ("a", "b")])
    features = lambda scorer, rows: sorted(scorer._coded(rows).select("i", "j", "features").collect(), key=lambda r: r[:2])
    assert features(models.HashedPairScorer(cleaned=True), cleaned) == features(models.HashedPairScorer(), df)
    labelled = df.withColumn("label", F.col("i") == F.col("j"))
    scored = models.HashedPairScorer(iterations=5).fit(labelled).score(labelled)
    assert scored.columns == ["i", "j", "a", "b", "label", "text_score"] and scored.where("label").agg(F.min("text_score")).first()[0] > 0
