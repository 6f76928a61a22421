"""Prepared records and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import fold

#: Columns of a prepared record, in order, with their types.
PREPARED = {
    "entity_id": "string", "country": "string", "source": "tinyint", "raw_name": "string", "raw_address": "string", "name_full": "string", "name_core": "string", "address_clean": "string",
    "owner_id": "string", "owner_fold": "tinyint", "name_script": "smallint", "unknown_native_tokens": "smallint", "reference_state_mask": "bigint",
}


def prepare(records: DataFrame, dictionary: Column | None = None, learned_states: Column | None = None) -> DataFrame:
    """Prepared records from entity_id, country, source, raw_name, raw_address and owner_id (null: none).

    dictionary and learned_states are map columns: native spelling to Latin token, native spelling to state. Null texts are
    empty. A source-1 record of India tells the states its address names, others tell none. A fold is the owner's, -1
    without one.
    """
    name, address = F.coalesce("raw_name", F.lit("")), F.coalesce("raw_address", F.lit(""))
    full = T.name_full(name, dictionary)
    known = dictionary if dictionary is not None else F.create_map().cast("map<string,string>")
    out = records.select(
        "entity_id", "country", "source", name.alias("raw_name"), address.alias("raw_address"), full.alias("name_full"), T.address_clean(address, F.col("country"), learned_states).alias("address_clean"),
        "owner_id", F.coalesce(fold(F.col("owner_id")), F.lit(-1)).alias("owner_fold"), T.script_mask(name).alias("name_script"), T.unknown_native(T.without_joiners(name), known).alias("unknown_native_tokens"),
        F.when((F.col("source") == 1) & (F.col("country") == "India"), T.state_mask(address)).otherwise(0).alias("reference_state_mask"),
    ).withColumn("name_core", T.name_core(F.col("name_full")))
    return out.select(*[F.col(c).cast(kind).alias(c) for c, kind in PREPARED.items()])


def record_stats(prepared: DataFrame) -> DataFrame:
    """Prepared records with what pair features need of each: computed once a record, before any join makes pairs."""
    core, raw = F.col("name_core"), F.col("raw_address")
    return prepared.withColumns(
        {
            "tok": F.array_distinct(T.words(core)), "compact": T.compact(core), "initials": T.initials(core), "house": T.house(raw), "units": T.units(raw), "alnum": T.premises(raw), "numset": T.number_set(raw),
            "numbers": T.numbers(raw), "address_tok": F.array_distinct(T.words(F.col("address_clean"))), "addr_empty": F.trim(raw) == "",
        }
    )


def _with_group_size(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """rows with the number of rows of a country that share the keys: counted before the shuffle, so a frequent key is a row."""
    sizes = rows.groupBy("country", *keys).agg(F.count(F.lit(1)).alias(name))
    return rows.join(sizes, ["country", *keys], "left")


def twins(stats: DataFrame) -> DataFrame:
    """How many other records share name and address, name and numbers, name, address (0 for an empty one), within a country."""
    out = stats.withColumn("number_key", F.array_join(F.array_sort("numset"), " "))
    for name, keys in {"tw_full": ["name_core", "address_clean"], "tw_num": ["name_core", "number_key"], "tw_name": ["name_core"], "tw_addr": ["address_clean"]}.items():
        out = _with_group_size(out, name, *keys).withColumn(name, F.coalesce(F.col(name) - 1, F.lit(0)))
    return out.withColumn("tw_addr", F.when(F.col("address_clean") == "", 0).otherwise(F.col("tw_addr"))).drop("number_key").select(*stats.columns, "tw_full", "tw_num", "tw_name", "tw_addr")


def name_multiplicity(refs: DataFrame) -> DataFrame:
    """How many references of a country have each one's core name."""
    return _with_group_size(refs, "r_name_mult", "name_core").select(*refs.columns, "r_name_mult")
