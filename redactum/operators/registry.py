"""A registry of pseudonyms: no two different values share one, in this batch or a later one.

Short pseudonyms collide once there are many values. Each distinct value is hashed once
with the key; values whose leading digits are equal are found by an aggregate over all
of them, and these alone get as many digits as tell them apart. The registry holds
hashes and widths and no value; a later batch joins it, keeps what it has and fits new
values in. The key stays in the workers' function and stands in no plan's text.
"""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redactum.functions.columns import held
from redactum.functions.crypto import DIGITS
from redactum.session import ship_package

#: Hex digits of a whole hash.
WHOLE = 64


def hashed(labels: Column, values: Column, secret: bytes) -> Column:
    """The whole hash of label and value, in lower-case hex digits; null for a null value."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        key = hmac.new(secret, digestmod=hashlib.sha256)
        out = []
        for label, value in zip(x.to_pylist(), y.to_pylist(), strict=True):
            if value is None:
                out.append(None)
                continue
            h = key.copy()
            h.update(f"{label}:{value}".encode())
            out.append(h.hexdigest())
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(labels, values)


def token_hashes(tokens: DataFrame, secret: bytes, label: str = "label", value: str = "value") -> DataFrame:
    """(label, value, hash) of the distinct values of each label; null values have none."""
    ship_package(tokens.sparkSession)
    rows = tokens.select(F.col(label).alias("label"), F.col(value).alias("value")).where("value IS NOT NULL").distinct()
    return rows.withColumn("hash", hashed(F.col("label"), F.col("value"), secret))


def _same(a: str, b: str) -> str:
    """SQL: how many leading digits two hashes have in common; 0 if one is null."""
    return f"IF({a} IS NULL OR {b} IS NULL, 0, coalesce(array_min(filter(sequence(1, {WHOLE}), i -> left({a}, i) <> left({b}, i))) - 1, {WHOLE}))"


def extended(hashes: DataFrame, registry: DataFrame | None = None, digits: int = DIGITS) -> DataFrame:
    """(label, hash, width) of the registry and of the new hashes (label, hash).

    What the registry has stays. A new hash gets ``digits``, or as many more as tell it
    from every other one of its label. Only hashes with equal leading digits meet, and
    these are few: a group is ``16 ** digits`` times smaller than its label. The same
    hashes and registry give the same widths, in any order.
    """
    new = hashes.select("label", "hash").distinct().withColumn("width", F.lit(None).cast("int"))
    both = new
    if registry is not None:
        both = registry.select("label", "hash", "width").unionByName(new).groupBy("label", "hash").agg(F.max("width").alias("width"))
    groups = both.withColumn("head_", F.left("hash", F.lit(digits)))
    near = W.partitionBy("label", "head_").orderBy("hash")
    groups = groups.withColumns({"before_": F.lag("hash").over(near), "after_": F.lead("hash").over(near)})
    width = f"coalesce(width, least({WHOLE}, greatest({digits}, {_same('hash', 'before_')} + 1, {_same('hash', 'after_')} + 1)))"
    return groups.select("label", "hash", F.expr(width).cast("int").alias("width"))


def named(hashes: DataFrame, registry: DataFrame) -> DataFrame:
    """``hashes`` (label, hash, ...) with ``pseudonym`` as the registry has it."""
    found = hashes.join(registry.select("label", "hash", "width"), ["label", "hash"], "left")
    return found.withColumn("pseudonym", F.expr(f"concat('[', label, '-', upper(left(hash, coalesce(width, {WHOLE}))), ']')")).drop("width")


_WHOLE_TOKEN = rf"\[([A-Z_]+)-([A-F0-9]{{{WHOLE}}})\]"


def shortened(df: DataFrame, key: str, registry: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the pseudonyms of ``WHOLE`` digits in a text, as ``replace(digits=WHOLE)``
    makes them, cut to the registry's widths; one that it does not have stays whole.

    Hashes and keys are shuffled, texts meet their widths by ``key``, which is unique.
    """
    found = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(_WHOLE_TOKEN), F.lit(0)))).alias("t_"))
    found = found.select(key, "t_", F.regexp_extract("t_", _WHOLE_TOKEN, 1).alias("label"), F.lower(F.regexp_extract("t_", _WHOLE_TOKEN, 2)).alias("hash"))
    short = named(found, registry).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("t_", "pseudonym"))).alias("short_"))
    out = held(df.join(short, key, "left"), {"parts_": F.split(F.regexp_replace(F.col(f"`{text}`"), _WHOLE_TOKEN, "\x01$0\x01"), "\x01")})
    cut = F.expr(f"IF(short_ IS NULL, `{text}`, array_join(transform(parts_, p -> coalesce(try_element_at(short_, p), p)), ''))")
    return held(out, {text: cut}).drop("parts_", "short_")
