"""Encoding of a whole corpus with a public byte-level BPE vocabulary, and back.

A byte-level BPE cuts a text into words by a fixed pattern and encodes each word by itself, so
a corpus needs as many encodings as it has distinct words.  Words are exploded with their
positions by the JVM, each distinct word is encoded once on a worker, and the ids join back
and are put together by position.

Skew.  A frequent word may make up a third of all words.  Words that hold more than one in
``COMMON`` of all occurrences are joined by broadcast: at most ``COMMON`` of them whatever the
corpus, and together no more than ``COMMON`` times the mean length of a word.  No other word has
more than one in ``COMMON``, so the shuffled join has no hot key and few rows.  Joined by
broadcast, the words of a text stay in its task and are gathered there before anything is
shuffled; a word of one token travels as one number, its position and its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ensure_on_workers
from ..spec import tick

#: White space of Unicode, for a pattern of the JVM.
_SPACE = r"\t-\r \u0085   -     　"

#: The word pattern of the vocabularies, for the JVM's regular expressions.
WORD_PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}++| ?\p{{N}}++| ?[^{_SPACE}\p{{L}}\p{{N}}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]++"

#: A word is broadcast if it holds more than one in so many occurrences.
COMMON = 20_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


_encoders: dict[str, object] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def word_encoder(path: str):
    """Encoder of single words, one per worker process and vocabulary."""
    if path not in _encoders:
        import tiktoken

        _encoders[path] = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})
    return _encoders[path]


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, pos, word); h tells rows of one id with different texts apart."""
    text = F.col(tick(text_col))
    rows = docs.where(F.length(text) > 0).select(F.col(tick(id_col)).alias("id"), F.xxhash64(text).alias("h"), text.alias("_t"))
    return rows.select("id", "h", F.posexplode(F.regexp_extract_all("_t", F.lit(WORD_PATTERN), F.lit(0))).alias("pos", "word"))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """Distinct words with their number of occurrences ``n`` and their ``ids``."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(path)
        for batch in batches:
            yield batch.assign(ids=[encoder.encode_ordinary(w) for w in batch["word"]])

    ensure_on_workers(words.sparkSession)
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.mapInPandas(encode, "word string, n bigint, ids array<int>")


def _joined(words: DataFrame, path: str, value: Column) -> DataFrame:
    """(id, h, pos, value) for every word of the corpus."""
    table = cut(encode_words(words, path)).withColumn("value", value)
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = F.broadcast(table.where(F.col("n") * COMMON > total).select("word", "value"))
    rare = table.where(F.col("n") * COMMON <= total).select("word", "value")
    a = words.join(common, "word").select("id", "h", "pos", "value")
    b = words.join(common, "word", "left_anti").join(rare, "word").select("id", "h", "pos", "value")
    return a.unionByName(b)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row (id, ids) per document.  NULL and empty texts have no ids: an empty list.

    Special tokens are never produced; their strings are ordinary text.  A row given several
    times comes out once; rows of one id with different texts come out once each, NULL and
    empty counting as one text.
    """
    path = path or vocabulary_path()
    words = _words(docs, id_col, text_col)
    single = F.size("value") == 1
    code = F.shiftleft(F.col("pos").cast("bigint"), 24).bitwiseOR(F.get("value", F.lit(0)).cast("bigint"))
    parts = _joined(words, path, F.col("ids")).select("id", "h", "pos", F.when(single, code).alias("one"), F.when(~single, F.struct("pos", "value")).alias("many")).groupBy("id", "h")
    gathered = parts.agg(F.collect_list("one").alias("one"), F.collect_list("many").alias("many"), F.count_if(F.col("pos") == 0).cast("int").alias("m"))
    opened = F.transform("one", lambda c: F.struct(F.shiftright(c, 24).cast("int").alias("pos"), F.array(c.bitwiseAND(F.lit((1 << 24) - 1)).cast("int")).alias("value")))
    listed = gathered.select("id", "m", F.array_sort(F.concat(opened, "many")).alias("l"))
    # A text given m times has every position m times.
    once = F.filter("l", lambda _, i: i % F.col("m") == 0)
    full = listed.select("id", F.flatten(F.transform(once, lambda x: x["value"])).alias("ids"))
    text = F.col(tick(text_col))
    void = docs.where(text.isNull() | (F.length(text) == 0)).select(F.col(tick(id_col)).alias("id"), F.array().cast("array<int>").alias("ids")).distinct()
    return full.unionByName(void).withColumnRenamed("id", id_col)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row (id, n_tokens) per document, without putting ids together.

    Rows of one id with different texts are counted together; repeats count once.
    """
    path = path or vocabulary_path()
    words = _words(docs, id_col, text_col)
    sums = _joined(words, path, F.size("ids")).groupBy("id", "h").agg(F.sum("value").alias("s"), F.count_if(F.col("pos") == 0).alias("m"))
    counted = sums.groupBy("id").agg(F.sum(F.col("s") / F.col("m")).cast("int").alias("n_tokens"))
    text = F.col(tick(text_col))
    void = docs.where(text.isNull() | (F.length(text) == 0)).select(F.col(tick(id_col)).alias("id"), F.lit(0).alias("n_tokens"))
    return counted.unionByName(void).groupBy("id").agg(F.max("n_tokens").alias("n_tokens")).withColumnRenamed("id", id_col)


def token_bytes(spark, path: str | None = None) -> DataFrame:
    """The vocabulary as a table (token, hex): its size is that of the vocabulary file."""
    ranks = read_ranks(path or vocabulary_path())
    return spark.createDataFrame(pd.DataFrame({"token": list(ranks.values()), "hex": [b.hex() for b in ranks]}), "token int, hex string")


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) from ids, by a join with the token-byte table; no ids give the empty text.

    Ids outside the vocabulary are left out.  Rows of one id are decoded each by itself.
    """
    table = F.broadcast(token_bytes(encoded.sparkSession, path))  # as many rows as the vocabulary
    rows = encoded.select(F.col(tick(id_col)).alias("id"), F.xxhash64(F.col(tick(ids_col))).alias("h"), F.posexplode(F.col(tick(ids_col))).alias("pos", "token"))
    hexes = rows.join(table, "token").groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("pos", "hex"))).alias("l"))
    text = F.decode(F.unhex(F.array_join(F.transform("l", lambda x: x["hex"]), "")), "UTF-8")
    full = hexes.select("id", text.alias("text"))
    void = encoded.where(F.coalesce(F.size(F.col(tick(ids_col))), F.lit(0)) <= 0).select(F.col(tick(id_col)).alias("id"), F.lit("").alias("text")).distinct()
    return full.unionByName(void).withColumnRenamed("id", id_col)
