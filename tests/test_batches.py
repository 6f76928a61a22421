import math
import os
import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions.similarity import lcs_length
from kinweave.operators import batches, features
from kinweave.operators import records as R
from kinweave.plans import linkage

DATA = "/root/testdata/sf0.001"


def stats(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcß é漢字1") for _ in range(r.randrange(1, 6)))
    names = ["", "the a b c inc", "abc", "a b c", "ABC cafe", "東京都 港区", "x" * 70 + " " + "y z " * 20, "b a b a", "Œuvre & fils sarl", *[" ".join(word() for _ in range(r.randrange(12))) for _ in range(30)]]
    places = ["", "Apt 0, 12 Rue 5b", "12 Rue 5b, floor 3", "Unit 000", f"{'9' * 19} {'9' * 20} 007", "0 00 000", "12 13 14 15 12", "1st 2b-3 44/5", f"{'1' * 18}2 rue", "b " * 80 + "c" * 130, *[f"{r.randrange(300)} {word()} {word()} {r.randrange(9)}" for _ in range(29)]]
    r.shuffle(places)
    rows = [(f"{i}", "xy"[i % 2], 1 + i % 3, n, p, str(3 * r.randrange(13)) if i % 5 else None) for i, (n, p) in enumerate(zip(names, places))]
    return R.record_stats(R.prepare(spark.createDataFrame(rows, "entity_id string, country string, source int, raw_name string, raw_address string, owner_id string"))).checkpoint()


def test_batches_give_what_the_columns_give(spark):
    records = stats(spark)
    ids = lambda side, key: side.select("country", F.col("entity_id").alias(key))
    pairs = ids(linkage.noisy(records), "query_id").join(ids(linkage.references(records), "ref_id"), "country")
    scores = {f"{m}_{x}": F.pmod(F.xxhash64("query_id", "ref_id", F.lit(m + x)), F.lit(1000)) / 1000.0 for m in features.MODES for x in ("score", "best", "second")}
    pairs = pairs.withColumns(scores | {f"{m}_rank": F.lit(n + 1) for n, m in enumerate(features.MODES)}).checkpoint()
    queries, refs = linkage.query_side(records).checkpoint(), linkage.reference_side(records, pairs).checkpoint()
    wanted = {(r.query_id, r.ref_id): r for r in features.all_features(features.sides(pairs, queries, refs), None).collect()}
    got = batches.described(pairs, queries, refs, perturb=True, keep=("owner_id",))
    assert got.columns == [*features.KEYS, *features.BASE, *features.PERTURB, "owner_id"]
    rows = got.collect()
    assert len(rows) == len(wanted) > 100 and {r.owner_id for r in rows} >= {None}
    for row in rows:
        other = wanted[row.query_id, row.ref_id]
        assert all(math.isclose(row[c], other[c], rel_tol=1e-14, abs_tol=1e-14) for c in features.BASE + features.PERTURB), (row, other)
    # Trees read stored vectors: rows of 92 columns were made, and assembled, at each pass.
    vectors = batches.described(pairs, queries, refs, perturb=True, keep=("owner_id",), vectors=True)
    assert vectors.columns == [*features.KEYS, "owner_id", "features"]
    assert sorted([(*r[:3], *r.features) for r in vectors.collect()]) == sorted(tuple(r[:-1]) for r in rows)
    base = batches.described(pairs, queries, refs)
    assert sorted(map(tuple, base.collect())) == sorted(map(tuple, got.select(*base.columns).collect()))


def test_subsequences_of_any_length(monkeypatch):
    import pyarrow as pa

    r = random.Random(4)
    texts = ["", "a", *["".join(r.choice("ab漢😀c") for _ in range(n)) for n in (1, 2, 63, 64, 65, 127, 128, 129, 200, 300)]]
    rows = batches._letters(pa.array(texts))
    letters = batches._coded(rows)
    met = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    a, b = map(batches.np.array, zip(*met))
    for side_by_side in (4096, 3):
        monkeypatch.setattr(batches, "SIDE_BY_SIDE", side_by_side)
        assert batches.lcs(rows, a, rows, b, letters).tolist() == [lcs_length(texts[i], texts[j]) for i, j in met]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_pairs_are_described_in_one_step(spark):
    # Nine comparisons of texts, each a column of its own, and lists sorted again for each of them took too long at 1 GB; so did records made for each join.
    from kinweave.plans.queries import QUERIES

    plan = QUERIES["pair_features_base"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "array_sort" not in plan and "regexp" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_trees_read_stored_vectors(spark, monkeypatch):
    # Each of four passes described all pairs again, and found by md5 of each pair's query whether it teaches.
    from kinweave.plans import queries

    read = []
    fit = linkage.fit_and_score
    monkeypatch.setattr(linkage, "fit_and_score", lambda rows, teach, settings: read.append(teach._jdf.queryExecution().optimizedPlan().toString()) or fit(rows, teach, settings))
    out = queries.QUERIES["gbt_match"](spark, DATA)
    assert out.columns == ["country", "query_id", "ref_id", "score", "label"] and out.count() > 0
    assert read[0].count("MapInArrow") == 1 and "Join" not in read[0] and "md5" not in read[0]
