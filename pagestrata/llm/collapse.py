"""Records that differ in formatting only, collapsed by commutative multiset hashes.

Each field value is normalised (letters and digits, ignoring case) and hashed together with its field's
role; the hashes of a record's fields are added up, so their order does not matter. Records are grouped by
two such sums (122 bits). Equality with the group's first record is then verified value by value, as
multisets and without sorting; a record that only collided is grouped again by its values themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.runtime import one_delivery, written

PRIME = (1 << 61) - 1


# Letters whose case folding is not one small letter.
FOLDED = {"ß": "ss", "ẞ": "ss", "ſ": "s", "ς": "σ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def normalized(text: Column) -> Column:
    """Letters and digits only, ignoring case by full folding (ß equals SS). Accents stay."""
    folded = F.lower(F.upper(text))
    for letter, small in FOLDED.items():
        folded = F.replace(folded, F.lit(letter), F.lit(small))
    return F.regexp_replace(folded, r"[^\p{L}\p{N}\p{M}]+|[\x{FE00}-\x{FE0F}]", "")


def multiset_hash(fields: Column, seed: int) -> Column:
    """Sum, modulo a prime, of the hashes of (role, value) pairs: the same for any order of the pairs."""
    each = F.transform(fields, lambda f: F.pmod(F.xxhash64(F.lit(seed), f["role"], f["value"]), F.lit(PRIME)))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, h: (s + h) % PRIME)


def same_multiset(a: Column, b: Column) -> Column:
    times = lambda e, xs: F.size(F.filter(xs, lambda x: x == e))
    return (F.size(a) == F.size(b)) & F.forall(a, lambda e: times(e, a) == times(e, b))


def collapse(records: DataFrame, id_column: str, roles: dict[str, str]) -> DataFrame:
    """(keep_id, id) for every record with a non-blank value in all fields; keep_id is the group's smallest id.

    roles maps each field to its role; fields of one role may stand for each other. Records with a null id
    or a null or blank field belong to no group. Redelivered ids count once. A group may hold most records:
    groups are aggregated before anything else is shuffled, and members meet their group's one row in a
    join whose skewed partitions are split.
    """
    full = records.where(F.lit(True))
    for field in roles:
        full = full.where(F.col(field).rlike(r"(?U)\S"))
    fields = F.array(*[F.struct(F.lit(role).alias("role"), normalized(F.col(field)).alias("value")) for field, role in roles.items()])
    hashed = one_delivery(full, id_column, list(roles)).select(F.col(id_column).alias("id"), fields.alias("fields"))
    hashed = hashed.select("id", "fields", multiset_hash(F.col("fields"), 1).alias("h1"), multiset_hash(F.col("fields"), 2).alias("h2"))
    hashed = written(hashed, "multiset-hashes")
    groups = hashed.groupBy("h1", "h2").agg(F.min("id").alias("keep_id"), F.min_by("fields", "id").alias("kept"), F.count("*").alias("n"))
    met = hashed.join(groups.where("n > 1"), ["h1", "h2"])
    met = written(met.select("id", "keep_id", "h1", "h2", F.when(~same_multiset(F.col("fields"), F.col("kept")), F.col("fields")).alias("collided")), "multiset-groups")
    held = met.where(F.col("collided").isNull()).select("keep_id", "id")
    values = F.array_sort(F.transform("collided", lambda f: F.concat_ws("\u0001", f["role"], f["value"])))
    collided = met.where(F.col("collided").isNotNull()).select("id", values.alias("values"))
    again = collided.join(collided.groupBy("values").agg(F.min("id").alias("keep_id")), "values").select("keep_id", "id")
    alone = hashed.select("h1", "h2", "id").join(groups.where("n = 1").select("h1", "h2"), ["h1", "h2"], "left_semi").select(F.col("id").alias("keep_id"), "id")
    return held.unionByName(again).unionByName(alone).withColumnRenamed("id", id_column)


def copy_counts(records: DataFrame, id_column: str, roles: dict[str, str]) -> DataFrame:
    """(keep_id, copies): one row a distinct record, with how many records it stands for."""
    return collapse(records, id_column, roles).groupBy("keep_id").agg(F.count("*").alias("copies"))


PAGE_ROLES = {"title": "text", "meta_description": "text"}


def found(pages: DataFrame) -> DataFrame:
    return collapse(pages, "page_id", PAGE_ROLES).where("keep_id <> page_id")
