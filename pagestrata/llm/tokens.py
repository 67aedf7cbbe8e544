"""Byte-pair encoding of a corpus inside Spark, by higher-order functions.

A text is split into words by the vocabulary's pattern. A word that is itself a token gets its id from a
literal map. Every other distinct word of the corpus is encoded once: a fold keeps the word's pieces
and the ranks of all adjacent pairs, merges the pair of lowest rank, and renews the two ranks beside it,
until no pair has a rank. The ids then go back to the texts by a join on the word.

Ranks come from a literal map of the vocabulary's pairs (its size is fixed, about 110,000 entries), spread over
buckets so that a look-up scans a handful of keys. A piece stands in the fold as one character, that of its id: a fold copies its
state at every step, and two strings cost less to copy than arrays of bytes. Words beyond LONG_WORD bytes, which no text of a language holds but
runs of blanks or encoded data do, are merged in the same order with a heap, in Arrow batches. Texts
beyond BLOCK_WORDS words are encoded in blocks of so many and put together again.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import os
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.rows import map_rows
from pagestrata.runtime import written

DEFAULT_VOCABULARY = os.environ.get("PAGESTRATA_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's own split pattern, with Unicode classes switched on for Java.
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 16384
PAIR_BUCKETS = 32768
LONG_WORD = 1000
# The character of id 0; those of all ids lie below the surrogates. EDGE stands around a word, NO_RANK for a pair that is no token.
FIRST_CHARACTER = 256
EDGE, NO_RANK = "\ufffc", "\ufffd"
BLOCK_WORDS = 32768


class Vocabulary:
    """A rank file as literal columns."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}

        if max(self.ranks.values()) + FIRST_CHARACTER >= 0xD800:
            raise ValueError("the vocabulary has more ids than there are characters for them")

    def character(self, piece: bytes) -> str:
        """The character of a piece's id; NO_RANK where it is no token."""
        return chr(self.ranks[piece] + FIRST_CHARACTER) if piece in self.ranks else NO_RANK

    @functools.cached_property
    def _pairs_json(self) -> str:
        """By bucket: the character of what two pieces give, for each pair of tokens that together are one."""
        buckets: list[dict[str, str]] = [{} for _ in range(PAIR_BUCKETS)]
        for piece in self.ranks:
            for k in range(1, len(piece)):
                if piece[:k] in self.ranks and piece[k:] in self.ranks:
                    pair = self.character(piece[:k]) + self.character(piece[k:])
                    buckets[zlib.crc32(pair.encode()) % PAIR_BUCKETS][pair] = self.character(piece)
        return json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))

    @functools.cached_property
    def _byte_pairs_json(self) -> str:
        """Character of each pair of bytes, by first * 256 + second."""
        return json.dumps([self.character(bytes((x, y))) for x in range(256) for y in range(256)], ensure_ascii=False, separators=(",", ":"))

    @functools.cached_property
    def _words_json(self) -> str:
        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for piece, rank in self.ranks.items():
            try:
                key = piece.decode("utf-8")
            except UnicodeDecodeError:
                continue
            buckets[zlib.crc32(piece) % BUCKETS][key] = rank
        return json.dumps(buckets, separators=(",", ":"))

    @functools.cached_property
    def _texts_json(self) -> str:
        pieces = [""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            pieces[rank] = piece.hex().upper()
        return json.dumps(pieces, separators=(",", ":"))

    def merged(self, pair: Column) -> Column:
        """Character of what a pair of characters gives; NO_RANK where that is no token."""
        table = F.from_json(F.lit(self._pairs_json), "array<map<string,string>>")
        return F.coalesce(F.get(table, (F.crc32(pair) % PAIR_BUCKETS).cast("int"))[pair], F.lit(NO_RANK))

    def merged_bytes(self, first: Column, second: Column) -> Column:
        return F.get(F.from_json(F.lit(self._byte_pairs_json), "array<string>"), first * 256 + second)

    def id_of_word(self, word: Column) -> Column:
        """Id of a word that is one token, else null."""
        table = F.from_json(F.lit(self._words_json), "array<map<string,int>>")
        return F.get(table, (F.crc32(word) % BUCKETS).cast("int"))[word]

    def piece_of(self, token: Column) -> Column:
        """Hex of a token's bytes; ids outside the vocabulary give nothing."""
        return F.coalesce(F.get(F.from_json(F.lit(self._texts_json), "array<string>"), token), F.lit(""))


@functools.lru_cache(maxsize=4)
def vocabulary(path: str = DEFAULT_VOCABULARY) -> Vocabulary:
    return Vocabulary(path)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def merged_ids(word: Column, vocab: Vocabulary) -> Column:
    """Token ids of one word by a fold of ranked merges over its byte array.

    The state holds the pieces between two edges, and what each adjacent pair would give, both as strings of id characters: their order is
    that of the ranks. Each step merges the leftmost pair of lowest rank and looks up the two pairs beside it; without
    any ranked pair it leaves the state as it is. The pair map stands in the expression once, as a plan carries each copy of a literal along.
    """
    bytes_of = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    every = [bytes([b]) for b in range(256)]
    pieces = F.translate(bytes_of, "".join(map(chr, range(256))), "".join(map(vocab.character, every)))

    def start(codes: Column) -> Column:
        pairs = F.transform(F.slice(codes, F.lit(1), F.size(codes) - 1), lambda x, i: vocab.merged_bytes(x, F.get(codes, i + 1)))
        return F.struct(F.concat(F.lit(EDGE), pieces, F.lit(EDGE)).alias("pieces"), F.concat(F.lit(NO_RANK), F.array_join(pairs, ""), F.lit(NO_RANK)).alias("gives"))

    def step(state: Column, k: Column) -> Column:
        pieces, gives = state["pieces"], state["gives"]
        rest = F.lit(1 << 30)

        def at(best: Column) -> Column:
            def merge(place: Column) -> Column:
                beside = F.array(F.concat(F.substring(pieces, place - 1, F.lit(1)), best), F.concat(best, F.substring(pieces, place + 2, F.lit(1))))
                return F.struct(
                    F.concat(F.substring(pieces, F.lit(1), place - 1), best, F.substring(pieces, place + 2, rest)).alias("pieces"),
                    F.concat(F.substring(gives, F.lit(1), place - 2), F.array_join(F.transform(beside, vocab.merged), ""), F.substring(gives, place + 2, rest)).alias("gives"),
                )

            return F.when(best < F.lit(NO_RANK), _let(F.instr(gives, best), merge)).otherwise(state)

        return _let(F.array_min(F.split(gives, "")), at)

    ids = lambda state: F.transform(F.split(F.substring(state["pieces"], F.lit(2), F.char_length(state["pieces"]) - 2), ""), lambda c: F.ascii(c) - FIRST_CHARACTER)
    return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), _let(F.transform(F.split(bytes_of, ""), F.ascii), start), step, ids)


def heap_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a long word: the same merges, lowest rank and then leftmost first, from a heap of pairs."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        # A pair that was merged meanwhile, or whose pieces have grown, is stale.
        if end[i] <= i or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        end[i], end[j] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _spelled(rare: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(__word, __ids) of distinct words that are no token."""
    long = F.octet_length("__word") > LONG_WORD
    folded = rare.where(~long).select("__word", merged_ids(F.col("__word"), vocab).alias("__ids"))
    if not rare.where(long).limit(1).count():
        return folded
    carried = rare.sparkSession.sparkContext.broadcast(vocab.ranks)

    def merge(c: dict[str, list]) -> dict[str, list]:
        return {"__word": c["__word"], "__ids": [heap_ids(w.encode("utf-8", "surrogatepass"), carried.value) for w in c["__word"]]}

    return folded.unionByName(map_rows(rare.where(long), merge, "__word string, __ids array<int>"))


def _words(documents: DataFrame, text_column: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text_column), F.lit("")), F.lit(SPLIT), F.lit(0))


def encode_corpus(documents: DataFrame, vocab: Vocabulary, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, ids ARRAY<INT>, and the columns in keep) of every row, without special tokens.

    Null and empty texts give an empty list. Ids may be null or repeat: rows are kept apart by a key of
    their own, and every input row gives one output row. Columns not in keep are ignored. An empty table gives
    an empty result. Texts of any length are encoded whole.
    """
    kept = keep or []
    words = documents.select(*kept, F.col(id_column).alias("__id"), F.monotonically_increasing_id().alias("__row"), _words(documents, text_column).alias("__all"))
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("__all") - 1) / BLOCK_WORDS).cast("int")))
    words = words.select(*kept, "__id", "__row", (F.size("__all") > BLOCK_WORDS).alias("__long"), "__all", F.explode(parts).alias("__block"))
    words = words.select(*kept, "__id", "__row", "__long", "__block", F.when(F.col("__long"), F.slice("__all", F.col("__block") * BLOCK_WORDS + 1, F.lit(BLOCK_WORDS))).otherwise(F.col("__all")).alias("__words"))
    words = words.withColumn("__known", F.transform("__words", vocab.id_of_word))
    words = words.withColumn("__rare", F.array_distinct(F.filter("__words", lambda w, i: F.get(F.col("__known"), i).isNull())))
    codes = F.transform("__known", lambda c, i: F.coalesce(c, -F.array_position(F.col("__rare"), F.get(F.col("__words"), i)).cast("int")))
    coded = written(words.select("__row", "__block", "__long", "__id", *kept, codes.alias("__codes"), "__rare"), "token-codes")
    rare = written(coded.select(F.explode("__rare").alias("__word")).distinct(), "rare-words")
    spelled = written(_spelled(rare, vocab), "token-words")
    found = (
        coded.select("__row", "__block", F.posexplode("__rare").alias("__at", "__word"))
        .join(spelled, "__word")
        .groupBy("__row", "__block")
        .agg(F.array_sort(F.collect_list(F.struct("__at", "__ids"))).alias("__spelled"))
        .select("__row", "__block", F.col("__spelled.__ids").alias("__spelled"))
    )
    placed = F.flatten(F.transform("__codes", lambda c: F.when(c >= 0, F.array(c)).otherwise(F.get(F.col("__spelled"), -c - 1))))
    encoded = coded.drop("__rare").join(found, ["__row", "__block"], "left").select("__row", "__block", "__long", "__id", *kept, placed.alias("ids"))
    out = [F.col("__id").alias(id_column), F.col("ids"), *kept]
    if not coded.where("__long").limit(1).count():
        return encoded.select(*out)
    whole = encoded.where("__long").groupBy("__row").agg(
        F.first("__id").alias("__id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__block", "ids"))), lambda b: b["ids"])).alias("ids"), *[F.first(k).alias(k) for k in kept]
    )
    return encoded.where(~F.col("__long")).select(*out).unionByName(whole.select(*out))


def count_tokens(documents: DataFrame, vocab: Vocabulary, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, size, and the columns in keep) of every row: how many ids encode_corpus gives it, without making them.

    Words that are tokens are counted where they stand; of the others only the distinct ones of each text, with how often it has them,
    are met with their sizes. The cases are those of encode_corpus.
    """
    kept = keep or []
    words = documents.select(*kept, F.col(id_column).alias("__id"), F.monotonically_increasing_id().alias("__row"), _words(documents, text_column).alias("__words"))
    rare = F.filter("__words", lambda w: vocab.id_of_word(w).isNull())
    coded = words.select("__row", "__id", *kept, F.size("__words").alias("__all"), rare.alias("__rare"))
    coded = written(coded, "token-counts")
    each = coded.select("__row", F.explode("__rare").alias("__word"))
    distinct = written(each.select("__word").distinct(), "rare-words")
    spelled = _spelled(distinct, vocab).select("__word", (F.size("__ids") - 1).alias("__more"))
    more = each.join(written(spelled, "token-sizes"), "__word").groupBy("__row").agg(F.sum("__more").alias("__more"))
    size = F.col("__all") + F.coalesce("__more", F.lit(0))
    return coded.drop("__rare").join(more, "__row", "left").select(F.col("__id").alias(id_column), size.cast("long").alias("size"), *kept)


def decoded(ids: Column, vocab: Vocabulary) -> Column:
    """The text of a list of ids: its binary pieces concatenated. A null list gives null, an empty one ''."""
    return F.decode(F.unhex(F.concat_ws("", F.transform(ids, vocab.piece_of))), "UTF-8")
