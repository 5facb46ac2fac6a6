"""Joins from a long table to a table that is unique on the key."""

from pyspark.sql import DataFrame, functions as F

from drayage.operators.skew import HotKeys, hot_keys

AUTO = object()


def lookup_join(
    facts: DataFrame, lookup: DataFrame, keys, how: str = "inner", hot: HotKeys | None = AUTO, salt_by=None
) -> DataFrame:
    """facts joined to the one lookup row of its key, safe for hot keys.

    Without hot keys this is a plain join and Spark picks the strategy.  With
    them, the facts of a hot key are spread over count / limit salts and only
    the lookup rows of those few keys are repeated, once per salt.
    ``hot`` may be passed when already known for (a superset of) the facts;
    ``salt_by`` names the columns that tell the facts of a key apart.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if hot is AUTO:
        hot = hot_keys(facts, keys)
    if hot is None:
        return facts.join(lookup, keys, how)
    salts = F.ceil(F.col("hot_count") / F.lit(hot.limit)).cast("int")
    spread = F.coalesce(F.pmod(F.xxhash64(*(salt_by or facts.columns)), salts).cast("int"), F.lit(0))
    salted = facts.join(hot.renamed(), hot.matches(facts), "left").select(
        *[facts[c] for c in facts.columns], spread.alias("__salt")
    )
    repeated = lookup.join(hot.renamed(), hot.matches(lookup), "left").select(
        *[lookup[c] for c in lookup.columns],
        F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)).alias("__salt"),
    )
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")
