import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinweave.plans import linkage, stages
from kinweave.plans.stages import Busy, Chain, Store, doctor
from kinweave.sources import tables, tsv


def test_literal_tsv(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_bytes('id\tname\n1\t"quoted" \\n\r\n2\t\n'.encode())
    rows = tsv.read_literal(spark, str(path), ["id", "name"]).collect()
    assert [tuple(r) for r in rows] == [("1", '"quoted" \\n'), ("2", "")]
    with pytest.raises(tsv.MalformedTable):
        tsv.read_literal(spark, str(path), ["id", "other"])
    path.write_text("id\tname\n1\ta\tb\n")
    with pytest.raises(Exception, match="malformed row"):
        tsv.read_literal(spark, str(path), ["id", "name"]).collect()


def test_tsv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", 'x"y'), (1, "a", ""), (3, "c", " z ")], "place int, id string, v string")
    tsv.write_literal(rows, str(tmp_path / "out"), order="place", single=True)
    (part,) = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert part.read_bytes() == b'id\tv\na\t\nb\tx"y\nc\t z \n'
    assert [tuple(r) for r in tsv.read_results(spark, str(part), ["id", "v"]).collect()] == [("a", ""), ("b", 'x"y'), ("c", " z ")]


def test_tables(spark, tmp_path):
    rows = spark.range(100).withColumn("v", F.col("id") % 7)
    tables.write_sorted(rows, str(tmp_path / "t"), "id", 3)
    assert tables.key_range(spark, str(tmp_path / "t"), "id", 10, 20).count() == 10
    assert tables.count_rows(spark, str(tmp_path / "t"), F.col("v") == 0) == 15
    tables.write(rows, str(tmp_path / "p"), ["v"], shard_rows=5)
    assert tables.scan(spark, str(tmp_path / "p"), ["id"], F.col("v") == 3).count() == 14
    tables.write_document(spark, {"a": [1, "é"]}, str(tmp_path / "d"))
    assert tables.read_document(spark, str(tmp_path / "d")) == {"a": [1, "é"]}


@pytest.fixture
def chain(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows = []
    for i in range(0, 120, 3):
        name, address = f"{word()} {word()}", f"{i + 10} {word()}"
        rows += [(str(i), "US", 1, name, address, None), (str(i + 1), "US", 2, name, address, str(i)), (str(i + 2), "US", 3, name[:-1], address, str(i))]
    records = spark.createDataFrame(rows, "entity_id string, country string, source int, raw_name string, raw_address string, owner_id string").cache()
    return Chain(Store(spark, str(tmp_path / "run")), linkage.STAGES, {"records": records}, {"records": "fixture"}, linkage.SMOKE)


def test_chain_runs_resumes_and_locks(chain):
    assert chain.next() == "prepared"
    with pytest.raises(RuntimeError):
        chain.read("matches")
    with chain.lock("prepared"), pytest.raises(Busy):
        chain.run("prepared")
    assert chain.run_all() == [s.name for s in linkage.STAGES]
    assert chain.run_all() == [] and chain.next() is None
    lists = {r.ref_id: r.matches for r in chain.read("matches").collect()}
    assert len(lists) == 40 and sum(len(m.split(",")) for m in lists.values() if m) > 0
    chosen = chain.read("threshold").first()
    assert 0 <= chosen.tune <= 1 and 0 <= chosen.check <= 1
    roles, split = chain.read("roles"), chain.read("split")
    assert {r.fold for r in roles.where("role in (1, 2)").collect()} == {0} and split.where("eval and train").count() == 0 and split.where("train").count() > 0
    before = chain.fingerprint("candidates")
    chain.settings = chain.settings | {"top_k": 2}
    assert chain.fingerprint("candidates") != before and chain.done("prepared") and not chain.done("candidates")
    assert chain.log("matches/x", "once") and not chain.log("matches/x", "again")


def test_stale_code_and_inputs_are_seen(spark, tmp_path):
    source = Path(stages.__file__).parent.parent
    copied = tmp_path / "package"
    shutil.copytree(source, copied, ignore=shutil.ignore_patterns("__pycache__"))
    before = stages.code_digest(copied)
    assert before == stages.code_digest()
    with open(copied / "operators" / "retrieval.py", "a") as out:
        out.write("# changed\n")
    assert stages.code_digest(copied) != before
    table = str(tmp_path / "t")
    spark.range(10).write.parquet(table)
    named = stages.file_identity(spark, table)
    assert named == stages.file_identity(spark, table)
    chain = Chain(Store(spark, str(tmp_path / "run")), linkage.STAGES, {"records": spark.read.parquet(table)}, {"records": named}, {})
    changed = Chain(chain.store, chain.stages, chain.sources, chain.identities, {}, code=stages.code_digest(copied))
    assert chain.fingerprint("prepared") != changed.fingerprint("prepared")
    spark.range(5).write.mode("append").parquet(table)
    assert stages.file_identity(spark, table) != named


def test_store_replaces_a_file(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write("a/b", "one")
    store.write("a/b", "two")
    assert store.read("a/b") == "two" and not list((tmp_path / "s" / "a").glob("b.*"))


def test_doctor(spark):
    assert doctor(spark)["works"]
