"""Pair features: 61 of evidence and text, and 31 of how names and numbers were perturbed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import similarity as S

MODES = ("name", "address", "combo")
KEYS = ("country", "query_id", "ref_id")

BASE = [
    *[f"{m}_cosine" for m in MODES], *[f"{m}_rank" for m in MODES], *[f"{m}_{x}" for m in MODES for x in ("best", "second", "to_best", "top_margin")],
    "name_ratio", "name_sort_ratio", "name_set_ratio", "name_compact_ratio", "name_full_ratio", "name_exact", "name_jaccard", "name_query_coverage", "name_ref_coverage", "name_initials_equal",
    "name_length_ratio", "name_query_tokens", "name_ref_tokens", "address_ratio", "address_sort_ratio", "address_set_ratio", "address_compact_ratio", "address_exact", "address_jaccard",
    "address_query_coverage", "address_ref_coverage", "address_query_missing", "address_ref_missing", "address_length_ratio", "address_query_tokens", "address_ref_tokens",
    "number_query_count", "number_ref_count", "number_intersection", "number_jaccard", "number_query_coverage", "number_ref_coverage", "number_sets_equal", "number_first_equal", "number_first_edit",
    "number_best_edit", "number_first_log_difference", "number_first_same_length", "number_first_prefix", "number_first_suffix", "query_has_native_name", "query_unknown_native_tokens", "query_source",
]

PERTURB = [
    "nr_shared", "nr_q_only", "nr_r_only", "nr_rel", "nr_swap_ratio", "nr_q_only_filler", "nr_q_only_vocab_min", "nr_r_only_vocab_min", "q_vocab_min", "nr_acronym", "nr_compact_prefix", "nr_alias",
    "wp_min", "wp_mean", "wp_low", "hn_equal", "hn_sub1", "hn_absdiff_log", "unit_equal", "unit_conflict", "alnum_shared", "alnum_conflict", "num_q_extra", "num_r_missing",
    "tw_full", "tw_num", "tw_name", "tw_addr", "r_name_mult", "r_claims", "q_addr_empty",
]


#: What ends each element of a list that travels as one text; no token or number holds it.
END = "\x1f"


def _listed(kind: str, x: str) -> Column:
    """A list of texts as one text, or any other value as it is: a fifth of the bytes of a list of short tokens."""
    return F.array_join(F.transform(x, lambda e: F.concat(e, F.lit(END))), "") if kind == "array<string>" else F.col(x)


def _unlisted(x: str) -> Column:
    parts = F.split(x, END)
    return F.slice(parts, 1, F.size(parts) - 1)


def sides(pairs: DataFrame, queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Candidate pairs with both records' columns, as q_* and r_*; records are joined by key, pairs are never renumbered.

    Lists of the query's side, which is shuffled once a pair, travel as texts.
    """
    q = queries.select(*[_listed(kind, c).alias(f"q_{c}") for c, kind in queries.dtypes])
    r = refs.select(*[F.col(c).alias(f"r_{c}") for c in refs.columns])
    joined = pairs.join(q, (F.col("query_id") == F.col("q_entity_id")) & (F.col("country") == F.col("q_country")))
    joined = joined.join(r, (F.col("ref_id") == F.col("r_entity_id")) & (F.col("country") == F.col("r_country")))
    return joined.withColumns({f"q_{c}": _unlisted(f"q_{c}") for c, kind in queries.dtypes if kind == "array<string>"})


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def base_columns() -> dict[str, Column]:
    """The 61 features of a row that sides() and a context made."""
    c = F.col
    out: dict[str, Column] = {f"{m}_cosine": c(f"{m}_score") for m in MODES}
    out |= {f"{m}_rank": c(f"{m}_rank").cast("double") for m in MODES}
    for m in MODES:
        out |= {f"{m}_best": c(f"{m}_best"), f"{m}_second": c(f"{m}_second"), f"{m}_to_best": c(f"{m}_score") - c(f"{m}_best"), f"{m}_top_margin": c(f"{m}_best") - c(f"{m}_second")}
    for kind, core, tok in (("name", "name_core", "tok"), ("address", "address_clean", "address_tok")):
        q, r, qt, rt = c(f"q_{core}"), c(f"r_{core}"), c(f"q_{tok}"), c(f"r_{tok}")
        close = F.replace(q, F.lit(" "), F.lit("")), F.replace(r, F.lit(" "), F.lit(""))
        out |= {f"{kind}_ratio": S.indel_ratio(q, r), f"{kind}_sort_ratio": S.token_sort_ratio(q, r), f"{kind}_set_ratio": S.token_set_ratio(q, r), f"{kind}_compact_ratio": S.indel_ratio(*close)}
        out[f"{kind}_exact"] = _flag((q != "") & (q == r))
        out |= dict(zip((f"{kind}_jaccard", f"{kind}_query_coverage", f"{kind}_ref_coverage"), S.overlap(qt, rt)))
        out |= {f"{kind}_length_ratio": S.length_ratio(q, r), f"{kind}_query_tokens": F.size(qt).cast("double"), f"{kind}_ref_tokens": F.size(rt).cast("double")}
    out["name_full_ratio"] = S.indel_ratio(c("q_name_full"), c("r_name_full"))
    out["name_initials_equal"] = _flag((c("q_initials") != "") & (c("q_initials") == c("r_initials")))
    out |= {"address_query_missing": _flag(c("q_address_clean") == ""), "address_ref_missing": _flag(c("r_address_clean") == "")}
    qs, rs = F.array_distinct(c("q_numbers")), F.array_distinct(c("r_numbers"))
    out |= {"number_query_count": F.size(qs).cast("double"), "number_ref_count": F.size(rs).cast("double"), "number_intersection": F.size(F.array_intersect(qs, rs)).cast("double")}
    out |= dict(zip(("number_jaccard", "number_query_coverage", "number_ref_coverage"), S.overlap(qs, rs)))
    out["number_sets_equal"] = _flag((F.size(qs) > 0) & (F.array_sort(qs) == F.array_sort(rs)))
    a, b = F.get("q_numbers", F.lit(0)), F.get("r_numbers", F.lit(0))
    out |= {"number_first_equal": _flag(a == b), "number_first_edit": F.coalesce(S.levenshtein_similarity(a, b), F.lit(0.0))}
    best = F.array_max(F.flatten(F.transform(qs, lambda x: F.transform(rs, lambda y: S.levenshtein_similarity(x, y)))))
    out |= {"number_best_edit": F.coalesce(best, F.lit(0.0)), "number_first_log_difference": _first_difference(a, b), "number_first_same_length": _flag(F.length(a) == F.length(b))}
    out |= {"number_first_prefix": _flag(F.startswith(a, b) | F.startswith(b, a)), "number_first_suffix": _flag(F.endswith(a, b) | F.endswith(b, a))}
    out |= {"query_has_native_name": _flag(c("q_name_script") != 0), "query_unknown_native_tokens": c("q_unknown_native_tokens").cast("double"), "query_source": c("q_source").cast("double")}
    return {name: out[name] for name in BASE}


def _first_difference(a: Column, b: Column) -> Column:
    # Numbers have up to 19 digits, more than a long holds.
    return F.coalesce(F.log1p(F.abs(a.cast("decimal(20,0)") - b.cast("decimal(20,0)")).cast("double")), F.lit(-1.0))


def base_features(rows: DataFrame) -> DataFrame:
    """(country, query_id, ref_id) and the 61 features, in their order."""
    return rows.select(*KEYS, *[x.cast("double").alias(name) for name, x in base_columns().items()])


def with_frequencies(records: DataFrame, vocabulary: DataFrame, tokens: str = "tok", keys: tuple[str, str] = ("country", "entity_id")) -> DataFrame:
    """Records with tok_freq, how many references have each of their tokens: looked up once a record, not once a pair."""
    each = records.select(*keys, F.explode(F.array_distinct(tokens)).alias("token"))
    found = each.join(vocabulary.select(F.col("country").alias(keys[0]), "token", "freq"), [keys[0], "token"], "left")
    listed = found.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("token", F.coalesce("freq", F.lit(0)).alias("freq")))).alias("tok_freq"))
    return records.join(listed, list(keys), "left")


def _least(only: str, known: str) -> Column:
    """log1p of the least frequency among a list's tokens, -1 without any."""
    return F.coalesce(F.log1p(F.array_min(F.transform(only, lambda t: F.try_element_at(F.col(known), t))).cast("double")), F.lit(-1.0))


def _with_perturbed(rows: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Rows and, of their columns, the 31 features.

    rows come from sides() with the queries' q_tw_*, q_wp_*, q_vocab_min and the references' r_r_name_mult, r_r_claims;
    vocabulary is (country, token, freq). Where the records have no tok_freq (see with_frequencies()), it is looked up here.
    """
    c = F.col
    for side in ("q", "r"):
        if f"{side}_tok_freq" not in rows.columns:
            keys = (f"{side}_country", f"{side}_entity_id")
            known = with_frequencies(rows.select(*keys, f"{side}_tok").distinct(), vocabulary, f"{side}_tok", keys)
            rows = rows.join(known.select(*keys, F.col("tok_freq").alias(f"{side}_tok_freq")), list(keys), "left")
    rows = rows.withColumns({"q_only": F.array_sort(F.array_except("q_tok", "r_tok")), "r_only": F.array_sort(F.array_except("r_tok", "q_tok")), "shared": F.size(F.array_intersect("q_tok", "r_tok"))})
    ql, rl, qo, ro = F.size("q_tok"), F.size("r_tok"), F.size("q_only"), F.size("r_only")
    relation = F.when((ql == 0) | (rl == 0), 6).when((qo == 0) & (ro == 0), 0).when(qo == 0, 1).when(ro == 0, 2).when(c("shared") == 0, 4).when((qo == 1) & (ro == 1), 3).otherwise(5)
    acronym = lambda x, y, n: (F.length(c(f"{x}_compact")) >= 2) & (c(f"{x}_compact") == c(f"{y}_initials")) & (n >= 2)
    prefix = lambda x, y: (F.length(c(f"{x}_compact")) >= 4) & F.startswith(c(f"{y}_compact"), c(f"{x}_compact"))
    units_met, premises_met = F.size(F.array_intersect("q_units", "r_units")), F.size(F.array_intersect("q_alnum", "r_alnum"))
    two = lambda x: (F.size(f"q_{x}") > 0) & (F.size(f"r_{x}") > 0)
    qh, rh = c("q_house"), c("r_house")
    out = {
        "nr_shared": c("shared"), "nr_q_only": qo, "nr_r_only": ro, "nr_rel": relation,
        "nr_swap_ratio": F.when((qo == 0) | (ro == 0), 0.0).otherwise(S.indel_ratio(F.array_join("q_only", " "), F.array_join("r_only", " "))),
        "nr_q_only_filler": F.size(F.filter("q_only", lambda w: w.isin(fixed.FILLER_WORDS))),
        "nr_q_only_vocab_min": _least("q_only", "q_tok_freq"), "nr_r_only_vocab_min": _least("r_only", "r_tok_freq"), "q_vocab_min": c("q_vocab_min"),
        "nr_acronym": _flag(acronym("q", "r", rl) | acronym("r", "q", ql)), "nr_compact_prefix": _flag((c("q_compact") != c("r_compact")) & (prefix("q", "r") | prefix("r", "q"))),
        "nr_alias": _flag((ql == 1) & (c("q_vocab_min") <= 0)), "wp_min": c("q_wp_min"), "wp_mean": c("q_wp_mean"), "wp_low": c("q_wp_low"),
        "hn_equal": F.when(qh.isNull() | rh.isNull(), -1.0).otherwise((qh == rh).cast("double")), "hn_sub1": _flag((F.length(qh) == F.length(rh)) & (F.levenshtein(qh, rh) == 1)), "hn_absdiff_log": S.log_difference(qh, rh),
        "unit_equal": _flag(two("units") & (units_met > 0)), "unit_conflict": _flag(two("units") & (units_met == 0)), "alnum_shared": premises_met, "alnum_conflict": _flag(two("alnum") & (premises_met == 0)),
        "num_q_extra": F.size(F.array_except("q_numset", "r_numset")), "num_r_missing": F.size(F.array_except("r_numset", "q_numset")),
        "tw_full": c("q_tw_full"), "tw_num": c("q_tw_num"), "tw_name": c("q_tw_name"), "tw_addr": c("q_tw_addr"), "r_name_mult": c("r_r_name_mult"), "r_claims": F.coalesce("r_r_claims", F.lit(0)), "q_addr_empty": _flag(c("q_addr_empty")),
    }
    return rows, {name: out[name] for name in PERTURB}


def perturb_features(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(country, query_id, ref_id) and the 31 features, in their order, of rows as _with_perturbed() takes them."""
    rows, columns = _with_perturbed(rows, vocabulary)
    return rows.select(*KEYS, *[x.cast("double").alias(name) for name, x in columns.items()])


def all_features(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(country, query_id, ref_id), the 61 and the 31 features: columns of one row, so no pair meets itself in a join."""
    rows, columns = _with_perturbed(rows, vocabulary)
    return rows.select(*KEYS, *[x.cast("double").alias(name) for name, x in (base_columns() | columns).items()])


def non_finite(features: DataFrame, names: list[str]) -> DataFrame:
    """The rows that hold a feature that is null or not finite: none may."""
    bad = F.lit(False)
    for name in names:
        bad = bad | ~F.coalesce(S.finite(F.col(name)), F.lit(False))
    return features.where(bad)
