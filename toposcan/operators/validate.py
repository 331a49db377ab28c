"""Checks of response, root and dictionary tables; errors as rows or maps, never exceptions per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Accepted codes.
RELATIONS = ["same", "similar", "different"]
RESPONSE_LANGS = ["por", "tup", "mixed", "unknown"]
PROPOSAL_LANGS = ["por", "tup", "araw", "macro-je", "mixed", "unknown"]
ROOT_LANGS = ["por", "tup", "araw", "mixed", "unknown"]
RESPONSE_FIELDS = ["canonical_id", "canonical_name", "relation", "confidence", "reasoning"]
PROPOSAL_FIELDS = ["root", "lang", "meaning_en", "meaning_ja", "confidence", "frequency", "example_toponyms", "reasoning"]
ACTION_PARAMS = {
    "set_param": ["param_name", "param_value"],
    "add_exclude_mask": ["mask_type", "mask_source", "threshold"],
    "add_root_weight": ["root", "weight"],
}
ENTRY_FIELDS = ["canonical_id", "canonical_name", "variant_name", "confidence"]


def parse_weights(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """One row per root and weight found in a response text; weights clamped to [0.1, 1].

    The JSON may stand in a fenced block or anywhere between the outer braces. Values
    that are not JSON numbers are dropped, and responses without weights give no rows.
    """
    text = F.trim(F.col(col))
    fenced = F.regexp_extract(text, r"(?s)```json[^\n]*\n(.*?)```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    # a fence that is never closed holds no answer
    body = F.when(text.contains("```json"), F.nullif(fenced, F.lit(""))).when(bare != "", bare).otherwise(text)
    doc = F.from_json(body, "struct<weights: map<string,variant>>")
    value = F.try_variant_get("_v", "$", "double")
    return (
        df.select(*keys, F.explode(doc["weights"]).alias("root", "_v"))
        .filter(is_json_number(F.col("_v")) & value.isNotNull())
        .select(*keys, "root", F.greatest(F.lit(0.1), F.least(F.lit(1.0), value)).alias("weight"))
    )


def is_json_number(value: Column) -> Column:
    """True where a variant is a JSON number; a quoted number is a string and no weight."""
    kind = F.schema_of_variant(value)
    return kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")


def _error_map(pairs: dict[str, Column]) -> Column:
    entries = [x for k, v in pairs.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def _missing(field: str) -> Column:
    return F.when(F.col(field).isNull(), F.lit(f"{field}: no value"))


def _bad_code(field: str, codes: Sequence[str]) -> Column:
    return F.when(F.col(field).isNotNull() & ~F.col(field).isin(list(codes)), F.concat(F.lit(f"{field}: unknown code "), field))


def _bad_confidence(col: str = "confidence") -> Column:
    number = F.col(col).try_cast("double")
    return F.when(F.col(col).isNotNull() & number.isNull(), F.lit("not a number")).when(
        ~number.between(0.0, 1.0), F.concat(F.lit("outside 0 to 1: "), F.col(col)))


def validate_responses(df: DataFrame, langs: Sequence[str] = RESPONSE_LANGS) -> DataFrame:
    """Add ``errors``: field to message; an empty map means valid."""
    errors = {f: _missing(f) for f in RESPONSE_FIELDS}
    errors["relation"] = F.coalesce(errors["relation"], _bad_code("relation", RELATIONS))
    errors["confidence"] = F.coalesce(errors["confidence"], _bad_confidence())
    errors["lang"] = F.when(F.col("lang") != "", _bad_code("lang", langs))
    return df.withColumn("errors", _error_map(errors))


def validate_proposals(df: DataFrame, langs: Sequence[str] = PROPOSAL_LANGS) -> DataFrame:
    """The same for root proposals (``example_toponyms`` is an array)."""
    errors = {f: _missing(f) for f in PROPOSAL_FIELDS}
    freq = F.col("frequency").try_cast("int")
    errors["lang"] = F.coalesce(errors["lang"], _bad_code("lang", langs))
    errors["confidence"] = F.coalesce(errors["confidence"], _bad_confidence())
    errors["frequency"] = F.coalesce(
        errors["frequency"],
        F.when(freq.isNull(), "no whole number").when(freq < 1, "below 1"))
    errors["example_toponyms"] = F.coalesce(
        errors["example_toponyms"], F.when(F.size("example_toponyms") == 0, "no example"))
    return df.withColumn("errors", _error_map(errors))


def validate_actions(df: DataFrame, action: str = "action", params: str = "params") -> DataFrame:
    """Add ``params_valid``: the action is known and its parameter map has the required keys."""
    out = F.lit(False)
    for name, needed in ACTION_PARAMS.items():
        have = F.size(F.array_intersect(F.map_keys(params), F.array(*[F.lit(k) for k in needed]))) == len(needed)
        out = F.when(F.col(action) == name, have).otherwise(out)
    return df.withColumn("params_valid", F.coalesce(out, F.lit(False)))


def _compiles(token: Column) -> Column:
    """Whether the engine that runs the token takes it as a regular expression: its own compiler is asked, null instead of an error."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), token).isNotNull()


def validate_roots(df: DataFrame, langs: Sequence[str] = ROOT_LANGS) -> DataFrame:
    """Add ``errors``: messages for missing fields, a token that is no regular expression, an unknown language."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    checks = [
        F.when(blank("root"), "root: no value"),
        F.when(blank("regex_token"), "regex_token: no value"),
        F.when(~blank("regex_token") & ~_compiles(F.coalesce("regex_token", F.lit(""))), "regex_token: no regular expression"),
        F.when(~blank("lang"), _bad_code("lang", langs)),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def format_roots(df: DataFrame) -> DataFrame:
    """Trimmed dictionary columns, missing language as ``unknown``, empty strings as null."""
    fields = ["root", "lang", "regex_token", "meaning_en", "meaning_ja"]
    cols = {}
    for f in fields:
        value = F.coalesce(F.col(f), F.lit("unknown" if f == "lang" else "")) if f in df.columns else F.lit(
            "unknown" if f == "lang" else "")
        cols[f] = F.nullif(F.trim(value), F.lit(""))
    return df.withColumns(cols)


def validate_entries(df: DataFrame) -> DataFrame:
    """Rows with all required fields and a confidence in [0, 1]; text that is no number becomes null and is kept."""
    out = df.dropna(subset=ENTRY_FIELDS).withColumn("confidence", F.col("confidence").try_cast("double"))
    return out.filter(F.col("confidence").isNull() | F.col("confidence").between(0.0, 1.0))


def search_variants(df: DataFrame, term: str, fuzzy: bool = False) -> DataFrame:
    """Dictionary rows by variant: equal ignoring case, or the term as a regular expression in variant or canonical."""
    if not fuzzy:
        return df.filter(F.lower("variant_name") == term.lower())
    pattern = "(?i)" + term  # the term is a regular expression, as given
    return df.filter(F.col("variant_name").rlike(pattern) | F.col("canonical_name").rlike(pattern))
