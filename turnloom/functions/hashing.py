"""Digests of messages and chain keys over histories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The root of all chains is the digest of this label; a parameter of chain_keys.
ROOT = "chain/1"


def json_string(text: Column) -> Column:
    """The text as a JSON string literal, null as null."""
    whole = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(F.substring(whole, F.lit(2), F.length(whole) - 2))


def message_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the message's canonical JSON: keys in code-point order, no blanks; absent (null) fields are left out."""
    parts = [F.when(fields[k].isNotNull(), F.concat(F.lit(f'"{k}":'), json_string(fields[k]))) for k in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def chain_keys(digests: Column, root: str = ROOT) -> Column:
    """K_i = sha256(K_{i-1} . d_i) over hex strings, for an array of digests."""
    start = F.array(F.sha2(F.lit(root), 256))
    chain = F.aggregate(digests, start, lambda acc, d: F.concat(acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), d), 256))))
    return F.slice(chain, F.lit(2), F.size(digests))


def is_prefix(a: Column, b: Column) -> Column:
    return F.slice(b, F.lit(1), F.size(a)) == a
