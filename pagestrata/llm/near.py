"""Near-duplicate texts by min-max hashing.

A text is the set of its word n-grams, each a 64-bit hash. Under every permutation of the hashes both the
smallest and the largest value are kept: the two coincide with those of another set with probability equal
to the sets' similarity each, so one evaluation yields two signature values, and their joint estimate has
a lower variance than two separate minima. Bands of signature values bring candidates together; candidates
are then verified on the full sets. Texts with the same set are collapsed first, so that copies never
multiply the candidates.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.rows import map_rows
from pagestrata.runtime import one_delivery, written

WORD = re.compile(r"[^\W_]+")
SHINGLE = 3
SIMILARITY = 0.5
# 100 bands of five values: a pair of similarity 0.59 meets in none with probability 0.0006, one of 0.1 in any with 0.001.
PERMUTATIONS = 250
BAND_ROWS = 5
BIT_DIGITS = 10
BITS = 1 << BIT_DIGITS
SEED = 20240607
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_SHIFT = np.uint64(31)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> _SHIFT)


class Shingler:
    """Texts to sorted arrays of distinct n-gram hashes; the hash of each word is kept for the next text."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text.lower()) if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > 2_000_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        ids = np.array([known[w] for w in words], np.uint64)
        n = min(self.size, len(words))
        mixed = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            mixed = _scramble(mixed * _MIX[0] + ids[k : len(ids) - n + 1 + k] + np.uint64(k + 1))
        return np.unique(mixed)


def _permutations(count: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def min_max(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Smallest and largest value of each permutation: two rows of 32-bit values."""
    low_factor = (factors >> np.uint64(32) | np.uint64(1)).astype(np.uint32)
    out = np.empty((2, len(factors)), np.uint32)
    out[0], out[1] = 0xFFFFFFFF, 0
    # All permutations at once, over parts of the set that stay in the processor's cache.
    for start in range(0, len(hashes), 512):
        part = hashes[start : start + 512]
        v = (part >> np.uint64(32)).astype(np.uint32) * factors.astype(np.uint32)[:, None]
        v += part.astype(np.uint32) * low_factor[:, None]
        v += offsets.astype(np.uint32)[:, None]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(12)
        np.minimum(out[0], v.min(axis=1), out=out[0])
        np.maximum(out[1], v.max(axis=1), out=out[1])
    return out


def band_keys(signature: np.ndarray, band_rows: int) -> np.ndarray:
    """One 64-bit key a band, over the minima and the maxima of disjoint groups of permutations."""
    sides = signature.reshape(2, -1, band_rows).astype(np.uint64)
    keys = np.zeros(sides.shape[:2], np.uint64)
    for r in range(band_rows):
        keys = _scramble(keys * _MIX[1] + sides[:, :, r] + np.uint64(r + 1))
    return keys.reshape(-1)


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """A set as BITS bits, each the parity of the members that fall on it: two sets differ in at least as many members as bits."""
    counts = np.bincount((hashes >> np.uint64(64 - BIT_DIGITS)).astype(np.int64), minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def signatures(texts: DataFrame, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS) -> DataFrame:
    """(id, text) to (id, size, whole, bands, bits): whole identifies the set, bands are its candidate keys, bits its parities."""

    def measure(c: dict[str, list]) -> dict[str, list]:
        shingler, (factors, offsets) = Shingler(shingle), _permutations(permutations)
        sizes, wholes, bands, bits = [], [], [], []
        for text in c["text"]:
            h = shingler(text)
            sizes.append(len(h))
            wholes.append(xxhash.xxh3_128_digest(h.tobytes()))
            bands.append(band_keys(min_max(h, factors, offsets), band_rows).view(np.int64) if len(h) else None)
            bits.append(parity_bits(h) if len(h) else None)
        return {"id": c["id"], "size": sizes, "whole": wholes, "bands": bands, "bits": bits}

    return map_rows(texts, measure, "id long, size int, whole binary, bands array<long>, bits array<long>")


def _candidates(heads: DataFrame, similarity: float) -> DataFrame:
    """(a, b, size_a, size_b): pairs that share a band and whose sizes allow the similarity, each once.

    All rows are placed by band key once. Most keys stand alone, so keys are counted where they lie and only the rows of
    repeated ones are joined to each other.
    """
    keyed = heads.select("id", "size", F.posexplode("bands").alias("band", "key")).select("id", "size", F.xxhash64("band", "key").alias("key"))
    keyed = keyed.repartition("key")
    repeated = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = written(keyed.join(repeated.hint("shuffle_hash"), "key", "left_semi"), "shared-bands")
    s, l = met.alias("s"), met.alias("l")
    ordered = (F.col("s.size") < F.col("l.size")) | ((F.col("s.size") == F.col("l.size")) & (F.col("s.id") < F.col("l.id")))
    return (
        s.join(l, (F.col("s.key") == F.col("l.key")) & ordered & (F.col("s.size") >= F.col("l.size") * F.lit(similarity)))
        .select(F.col("s.id").alias("a"), F.col("l.id").alias("b"), F.col("s.size").alias("size_a"), F.col("l.size").alias("size_b"))
        .distinct()
    )


def near_pairs(
    texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of a table (id, text) with unique ids.

    members: (id, class), the class being the smallest id with the same set of n-grams. links: (a, b,
    similarity) between classes, a < b, each pair once: candidates share a band; those whose parity bits prove that they differ in too many
    n-grams are set aside, which loses none, and the rest are verified on the full sets. Null texts, texts without a word
    and null ids are no member. An empty table gives two empty ones.
    """
    signed = written(signatures(texts.where(F.col("id").isNotNull()), shingle, permutations, band_rows), "min-max").where("size > 0")
    classes = signed.groupBy("whole").agg(F.min("id").alias("class"))
    members = signed.select("id", "whole").join(classes, "whole").select("id", "class")
    heads = signed.select("id", "size", "bands").join(classes.select(F.col("class").alias("id")), "id", "left_semi")
    bits_a, bits_b = (signed.select(F.col("id").alias(k), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, v: n + v)
    # Sets of similarity t or more differ in at most (1 - t) / (1 + t) of their sizes' sum.
    most = (F.col("size_a") + F.col("size_b")) * F.lit((1 - similarity) / (1 + similarity) + 1e-9)
    likely = _candidates(heads, similarity).join(bits_a, "a").join(bits_b, "b").where(apart <= most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    likely = written(likely, "candidate-pairs")
    named = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = map_rows(texts.select("id", "text").join(named, "id", "left_semi"), lambda c: _sets(c, shingle), "id long, grams array<long>")
    sets = written(sets, "candidate-sets")
    set_a, set_b = (sets.select(F.col("id").alias(k), F.col("grams").alias(f"grams_{k}")) for k in "ab")
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    links = (
        likely.join(set_a, "a")
        .join(set_b, "b")
        .select("a", "b", common.alias("common"), (F.size("grams_a") + F.size("grams_b") - common).alias("all"))
        .select("a", "b", (F.col("common") / F.col("all")).alias("similarity"))
        .where(F.col("similarity") >= similarity)
    )
    return members, links


def _sets(c: dict[str, list], shingle: int) -> dict[str, list]:
    shingler = Shingler(shingle)
    return {"id": c["id"], "grams": [shingler(t).view(np.int64) for t in c["text"]]}


def pair_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair (a, b, similarity) of members: those of linked classes, and those within a class at 1."""
    one, two = (members.select(F.col("class").alias(f"class_{k}"), F.col("id").alias(f"id_{k}")) for k in "xy")
    several = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class").alias("class_x"))
    within = one.join(several, "class_x", "left_semi").join(two, (F.col("class_x") == F.col("class_y")) & (F.col("id_x") < F.col("id_y")))
    across = links.join(one, F.col("a") == F.col("class_x")).join(two, F.col("b") == F.col("class_y"))
    pair = [F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")]
    return within.select(*pair, F.lit(1.0).alias("similarity")).unionByName(across.select(*pair, "similarity"))


def page_texts(pages: DataFrame) -> DataFrame:
    """(id, text) of the pages that are compared: status 200 and 120 words at least, each once."""
    chosen = pages.where((F.col("status") == 200) & (F.col("word_count") >= 120) & F.col("body_text").isNotNull())
    return one_delivery(chosen, "page_id", ["body_text"]).select(F.col("page_id").alias("id"), F.col("body_text").alias("text"))


def found(pages: DataFrame) -> DataFrame:
    members, links = near_pairs(page_texts(pages))
    return pair_members(members, links).select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"))
