"""Every string form that any later operator asks for, once per record instead of once per pair."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as N
from ..functions import tokens as T


def prepare(records: DataFrame) -> DataFrame:
    """entity_id, the raw columns, and full, base, addr, country, nums, postals, tokens (the blocking tokens)."""
    clean = records.select(
        "entity_id", F.coalesce("business_name", F.lit("")).alias("name"), F.coalesce("business_address", F.lit("")).alias("address"), F.coalesce("country", F.lit("")).alias("raw_country"),
        N.normalize_name(F.col("business_name")).alias("full"), N.normalize_name(F.col("business_name"), True).alias("base"),
        N.normalize_address(F.col("business_address")).alias("addr"), N.normalize_country(F.col("country")).alias("country"),
    )
    return clean.withColumns({"nums": T.numeric_tokens(F.col("address")), "postals": T.postal_tokens(F.col("address")), "tokens": T.blocking_tokens(F.col("base"))})


def with_forms(prepared: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """prepared with the token sets that pair features compare, or with those named by only: in a struct, Catalyst makes all of them for a query that reads one twice. What prepared has already isn't made again."""
    base, full, addr = F.col("base"), F.col("full"), F.col("addr")
    forms = {
        "words": T.words(base), "bigrams": T.name_bigrams(base), "abbrev": T.name_abbreviation(base), "first": T.first_word(base),
        "full3": T.char_ngrams(full, 3), "full4": T.char_ngrams(full, 4), "suffix": T.legal_suffix(full),
        "addr_words": T.words(addr), "addr3": T.char_ngrams(addr, 3), "addr4": T.char_ngrams(addr, 4), "street": T.street_number(F.col("address")),
        "nums": T.numeric_tokens(F.col("address")), "postals": T.postal_tokens(F.col("address")),
    }
    return prepared.drop("tokens").withColumns({n: c for n, c in forms.items() if n not in prepared.columns and (only is None or n in only)})
