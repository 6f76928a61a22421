"""The driver's tables as inputs of record linkage, in Spark and in SQL for a second engine.

Documents are the records: the first line is the name, the second the address, the language the country, every third one
(by id) a reference. A record's owner is the first reference of its country whose text begins alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

COUNTRY = {"en": "US", "fr": "France"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, country, source, raw_name, raw_address, owner_id."""
    lines = F.split("text", "\n")
    country = F.when(F.col("lang") == "en", "US").when(F.col("lang") == "fr", "France").otherwise(F.col("lang"))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("entity_id"), "doc_id", country.alias("country"), (1 + F.col("doc_id") % 3).cast("int").alias("source"), F.substring("text", 1, 60).alias("head"),
        F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, 80).alias("raw_name"), F.substring(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), 1, 120).alias("raw_address"),
    )
    owners = rows.where("source = 1").groupBy("country", "head").agg(F.min("doc_id").cast("string").alias("first_id"))
    joined = rows.join(owners, ["country", "head"], "left")
    return joined.select("entity_id", "country", "source", "raw_name", "raw_address", F.when(F.col("source") != 1, F.col("first_id")).alias("owner_id"))


RECORDS_SQL = """
heads AS (
  SELECT CAST(doc_id AS VARCHAR) AS entity_id, doc_id, CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'France' ELSE lang END AS country, CAST(1 + doc_id % 3 AS INTEGER) AS source, substr(text, 1, 60) AS head,
    substr(coalesce(string_split(text, chr(10))[1], ''), 1, 80) AS raw_name, substr(coalesce(string_split(text, chr(10))[2], ''), 1, 120) AS raw_address
  FROM documents),
owners AS (SELECT country, head, CAST(min(doc_id) AS VARCHAR) AS first_id FROM heads WHERE source = 1 GROUP BY country, head),
records AS (
  SELECT h.entity_id, h.country, h.source, h.raw_name, h.raw_address, CASE WHEN h.source <> 1 THEN o.first_id END AS owner_id
  FROM heads h LEFT JOIN owners o ON h.country = o.country AND h.head = o.head)"""


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(map(sql_text, values)) + "]"


def sql_case(key: str, mapping: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def sql_clean(x: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents({x})), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def sql_name_full(x: str) -> str:
    text = f"regexp_replace({x}, {sql_text(fixed.ALIAS_MARKER)}, '')"
    text = f"string_split({text}, ' | ')[1]"
    text = sql_clean(f"regexp_replace({text}, {sql_text(fixed.WEB_PARTS)}, ' ', 'g')")
    return rf"regexp_replace(regexp_replace({text}, '\bl l c\b', 'llc', 'g'), '\bl l p\b', 'llp', 'g')"


def sql_name_core(full: str) -> str:
    core = f"array_to_string(list_filter(string_split({full}, ' '), lambda w: NOT list_contains({sql_list(fixed.LEGAL_FORMS)}, w)), ' ')"
    return f"coalesce(nullif({core}, ''), {full})"


def sql_address(raw: str, country: str) -> str:
    parts = f"list_transform(string_split({raw}, ','), lambda p: regexp_replace(p, '^[ \\t\\r\\n\"'']+|[ \\t\\r\\n\"'']+$', '', 'g'))"
    french, us = sql_case("lower(p)", {k: v for k, v in fixed.FRENCH_REGIONS.items()}, "p"), sql_case("lower(p)", fixed.US_STATES, "p")
    parts = f"CASE {country} WHEN 'France' THEN list_transform({parts}, lambda p: {french}) WHEN 'US' THEN list_transform({parts}, lambda p: {us}) ELSE {parts} END"
    joined = sql_clean(f"array_to_string({parts}, ', ')")
    french, other = sql_case("w", fixed.FRENCH_STREET_WORDS, "w"), sql_case("w", fixed.STREET_WORDS, "w")
    each = f"string_split({joined}, ' ')"
    return f"array_to_string(list_filter(CASE {country} WHEN 'France' THEN list_transform({each}, lambda w: {french}) ELSE list_transform({each}, lambda w: {other}) END, lambda w: w <> 'null'), ' ')"


def sql_zeros(x: str) -> str:
    return f"CASE WHEN regexp_replace({x}, '^0+', '') = '' THEN '0' ELSE regexp_replace({x}, '^0+', '') END"


def sql_fold(x: str, folds: int = fixed.FOLDS) -> str:
    return f"CAST(md5_number({x}) % {folds} AS INTEGER)"


PREPARED_SQL = f"""{RECORDS_SQL},
named AS (SELECT *, {sql_name_full("raw_name")} AS name_full, {sql_address("raw_address", "country")} AS address_clean FROM records),
prepared AS (SELECT *, {sql_name_core("name_full")} AS name_core FROM named)"""


def sql_set(x: str) -> str:
    """Distinct values of a list in order."""
    return f"list_sort(list_distinct({x}))"


STATS_SQL = rf"""{PREPARED_SQL},
stats AS (
  SELECT *, {sql_set(sql_words("name_core"))} AS tok, replace(name_core, ' ', '') AS compact, array_to_string(list_transform({sql_words("name_core")}, lambda w: substr(w, 1, 1)), '') AS initials,
    CASE WHEN regexp_extract(rest, '(\d+)', 1) <> '' THEN {sql_zeros("regexp_extract(rest, '(\\d+)', 1)".replace(chr(92) * 2, chr(92)))} END AS house,
    {sql_set("list_transform(phrases, lambda p: regexp_replace(regexp_extract(p, '(" + chr(92) + "d+)" + chr(92) + "D*$', 1), '^0+', ''))")} AS units,
    {sql_set("list_filter(list_transform(regexp_extract_all(low, " + sql_text(fixed.PREMISE) + "), lambda p: regexp_replace(p, '[-/]', '', 'g')), lambda p: NOT regexp_matches(p, " + sql_text(fixed.ORDINAL) + "))")} AS alnum,
    {sql_set("list_transform(regexp_extract_all(low, '" + chr(92) + "d+'), lambda n: " + sql_zeros("n") + ")")} AS numset,
    list_transform(list_filter(regexp_extract_all(low, '\d+'), lambda n: length(n) < 20), lambda n: {sql_zeros("n")}) AS numbers,
    {sql_set(sql_words("address_clean"))} AS address_tok, trim(raw_address) = '' AS addr_empty
  FROM (SELECT *, lower(raw_address) AS low, list_concat(regexp_extract_all(lower(raw_address), {sql_text(fixed.UNIT_PHRASE)}), regexp_extract_all(lower(raw_address), {sql_text(fixed.FLOOR_PHRASE)})) AS phrases,
    regexp_replace(regexp_replace(lower(raw_address), {sql_text(fixed.UNIT_PHRASE)}, ' ', 'g'), {sql_text(fixed.FLOOR_PHRASE)}, ' ', 'g') AS rest FROM prepared))"""


def sql_trigrams(x: str) -> str:
    return f"flatten(list_transform(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))))"


SCORES_SQL = rf"""{STATS_SQL},
fields AS (SELECT country, source, entity_id, 'name' AS field, name_core AS t FROM stats UNION ALL SELECT country, source, entity_id, 'address', address_clean FROM stats),
grams AS (SELECT country, source, entity_id, field, unnest(list_distinct({sql_trigrams("t")})) AS gram FROM fields),
sizes AS (SELECT country, count(*) AS refs FROM stats WHERE source = 1 GROUP BY country),
df AS (SELECT country, field, gram, count(*) AS df FROM grams WHERE source = 1 GROUP BY ALL),
rated AS (SELECT g.*, d.df, ln((s.refs + 1.0) / (coalesce(d.df, 0) + 1.0)) + 1 AS idf FROM grams g JOIN sizes s USING (country) LEFT JOIN df d USING (country, field, gram)),
postings AS (SELECT *, idf / sqrt(sum(idf * idf) OVER (PARTITION BY country, entity_id, field)) AS w FROM rated),
sums AS (
  SELECT q.country, q.entity_id AS query_id, r.entity_id AS ref_id, round(sum(CASE WHEN q.field = 'name' THEN q.w * r.w ELSE 0 END), 9) AS name, round(sum(CASE WHEN q.field = 'address' THEN q.w * r.w ELSE 0 END), 9) AS address
  FROM postings q JOIN postings r USING (country, field, gram) WHERE q.source <> 1 AND r.source = 1 GROUP BY ALL),
scored AS (SELECT *, round({fixed.NAME_WEIGHT} * name + {1 - fixed.NAME_WEIGHT} * address, 10) AS combo FROM sums)"""


def sql_ranked(source: str = "scored", k: int = fixed.TOP_K) -> str:
    lists = " UNION ALL ".join(
        f"SELECT * FROM (SELECT *, '{m}' AS mode, row_number() OVER (PARTITION BY country, query_id ORDER BY {m} DESC, ref_id) AS rank FROM {source} WHERE {m} > 0) WHERE rank <= {k}" for m in ("name", "address", "combo")
    )
    ranks = ", ".join(f"CAST(coalesce(min(CASE WHEN mode = '{m}' THEN rank END), {k + 1}) AS INTEGER) AS {m}_rank" for m in ("name", "address", "combo"))
    return f"""mode_lists AS ({lists}),
pairs AS (SELECT country, query_id, ref_id, any_value(name) AS name_score, any_value(address) AS address_score, any_value(combo) AS combo_score, {ranks} FROM mode_lists GROUP BY country, query_id, ref_id)"""


PAIRS_SQL = f"{SCORES_SQL},\n{sql_ranked()}"

#: The longest common subsequence of two texts, as nested folds over letters.
SQL_LCS = (
    "list_max(list_reduce(string_split({a}, ''), lambda row, c: list_reduce(range(1, length({b}) + 1), lambda new, j: list_append(new, greatest(new[j], row[j + 1], CASE WHEN substr({b}, CAST(j AS BIGINT), 1) = c THEN row[j] + 1 ELSE 0 END)), [CAST(0 AS BIGINT)]), "
    "list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS BIGINT))))"
)


def sql_indel(a: str, b: str) -> str:
    lcs = SQL_LCS.format(a=a, b=b)
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 2.0 * {lcs} / (length({a}) + length({b})) END"
