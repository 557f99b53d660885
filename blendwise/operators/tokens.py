"""Tokens: vocabulary, split, encode, special ids, decode, strict lookup, stats.

Text is split on an explicit whitespace class (no ``\\s``: its meaning differs
between regex engines).  Ids come either from a hash of the token (no lookup
table, no shuffle) or from a vocabulary table joined in.  Id 0 is reserved
for EOS/BOS/UNK.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blendwise.functions.hashing import hashed_token_id
from blendwise.functions.prefix import prefix_rank
from blendwise.session import cut_lineage, ship_package, small_batches

# The whitespace class that separates tokens, the reserved id.
WHITESPACE = "[ \\t\\n\\r\\f]+"
SPECIAL_ID = 0
# Storage width rule of the packed format: 2-byte ids below this vocabulary size, else 4.
U16_VOCAB_LIMIT = 65500

# A vocabulary of this many rows or fewer is broadcast; above it AQE picks the join.
VOCAB_BROADCAST_ROWS = 1 << 20

# A dictionary lookup takes rows of about this many tokens (or ids) into one group, which one task holds.
GROUP_ITEMS = 1 << 22

# A sub-word tokenizer works on texts of this many characters at a time: it keeps some hundred bytes for every id.
SLICE_CHARS = 1 << 19


def tokenize(df: DataFrame, text: str = "text", out: str = "words") -> DataFrame:
    """Token strings of a text; empty pieces (leading whitespace) removed."""
    return df.withColumn(out, F.array_remove(F.split(F.col(text), WHITESPACE), ""))


def encode(
    df: DataFrame,
    words: str = "words",
    out: str = "ids",
    vocab_size: int = 1024,
    vocab: DataFrame | None = None,
    key: str = "doc_id",
    unk_id: int = SPECIAL_ID,
    fn: Callable | None = None,
    vocab_rows: int | None = None,
) -> DataFrame:
    """Token strings to ids.

    * default: hashed id ``1 + md5(token)[:8] mod (vocab_size - 1)``, a pure
      projection (``transform``), no join;
    * ``vocab`` (token, id): looked up for the distinct tokens of groups of rows (:func:`look_up`), which ``key`` deals;
      unknown tokens get ``unk_id``; ``vocab_rows`` is a known bound of the vocabulary's size;
    * ``fn``: a vectorised ``pandas_udf`` from ``array<string>`` to ``array<int>``
      (a pluggable sub-word codec).
    """
    if fn is not None:
        return df.withColumn(out, fn(F.col(words)))
    if vocab is None:
        return df.withColumn(out, F.transform(F.col(words), lambda w: hashed_token_id(w, vocab_size)))
    entries = bounded_vocab(vocab.select(F.col("token").alias("_item"), F.col("id").cast("int").alias("_value")), vocab_rows)

    def ids(lists: pa.Array, found: pa.Table) -> pa.Array:
        offsets, places = placed(lists, found)
        return pa.ListArray.from_arrays(offsets, pc.fill_null(found["_value"].combine_chunks().take(places), unk_id))

    return look_up(df, words, key, entries, ids, out, T.ArrayType(T.IntegerType()))


def look_up(df: DataFrame, items: str, key: str, entries: DataFrame, fn: Callable[[pa.Array, pa.Table], pa.Array], out: str,
            kind: T.DataType) -> DataFrame:
    """``df`` with ``out`` = ``fn`` of the array column ``items`` and the dictionary entries ``(_item, _value)`` that it needs.

    Rows are dealt by ``key`` into groups of about ``GROUP_ITEMS`` items (their number is counted first).  The distinct items of a group are
    joined with the dictionary, so an item crosses the network once for each group, not for each occurrence, and no
    task gets all occurrences of a frequent one; a group's rows then meet its entries in one task.  Both steps read one
    shuffle of the rows, so ``df`` is computed twice, for the number of items and for that shuffle."""
    ship_package(df.sparkSession)
    total = df.agg(F.sum(F.greatest(F.size(items), F.lit(1)).cast("bigint"))).first()[0] or 0
    groups = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // GROUP_ITEMS))
    d = df.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))

    def distinct(group: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        item = pa.chunked_array([x.flatten() for x in rows[items].chunks]).unique().drop_null()
        return pa.table({"_of": pa.array(np.full(len(item), group[0].as_py(), np.int32)), "_item": item})

    wanted = T.StructType().add("_of", T.IntegerType()).add("_item", df.schema[items].dataType.elementType)
    found = d.groupBy("_group").applyInArrow(distinct, wanted).join(entries, "_item").select("_of", "_item", "_value")
    columns = [c for c in df.columns if c != out]

    def attach(rows: pa.Table, found: pa.Table) -> pa.Table:
        made = pa.chunked_array([fn(x, found) for x in rows[items].chunks])
        return rows.select(columns).append_column(out, made)

    schema = T.StructType([df.schema[c] for c in columns]).add(out, kind)
    return d.groupBy("_group").cogroup(found.groupBy("_of")).applyInArrow(attach, schema)


def placed(lists: pa.Array, found: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Offsets of the lists (null: empty) in their flat items, and the place of every item among the entries (null: none)."""
    flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]), pa.int32())
    return offsets, pc.index_in(flat, value_set=found["_item"].combine_chunks().cast(flat.type))


class SubwordCodec:
    """A sub-word tokenizer file as two Arrow functions on whole texts: ids of a text, text of ids.

    ``path`` is a file of the ``tokenizers`` library on every worker (or shipped with the job); each worker loads it once."""

    def __init__(self, path: str):
        self.path = path

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def encode(self, text: Column) -> Column:
        path = self.path

        def ids(texts: pd.Series) -> pd.Series:
            codec, texts, out = SubwordCodec.load(path), texts.fillna("").tolist(), []
            for lo, hi in slices([len(t) for t in texts], SLICE_CHARS):
                made = codec.encode_batch(texts[lo:hi], add_special_tokens=False)
                out += [np.array(e.ids, np.int32) for e in made]
            return pd.Series(out, dtype=object)

        return F.pandas_udf(ids, "array<int>").asNondeterministic()(text)  # else a use of the ids encodes once more

    def decode(self, ids: Column) -> Column:
        path = self.path

        def texts(ids: pd.Series) -> pd.Series:
            codec, ids, out = SubwordCodec.load(path), ids.tolist(), []
            for lo, hi in slices([len(x) for x in ids], SLICE_CHARS // 4):
                out += codec.decode_batch([x.tolist() for x in ids[lo:hi]], skip_special_tokens=False)
            return pd.Series(out, dtype=object)

        return F.pandas_udf(texts, "string")(ids)


def slices(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to at most ``limit`` (at least one row each)."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def encode_texts(df: DataFrame, codec: SubwordCodec, text: str = "text", out: str = "ids", eos: int | None = None) -> DataFrame:
    """T3/T4 with a pluggable codec: ids of whole texts, with ``eos`` at the end if given."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    d = df.withColumn(out, codec.encode(F.col(text)))
    return add_special(d, out, eos=eos) if eos is not None else d


def bounded_vocab(v: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast a vocabulary of known, bounded size; any other is joined by a shuffle on the token or id."""
    return F.broadcast(v) if rows is not None and rows <= VOCAB_BROADCAST_ROWS else v


def add_special(
    df: DataFrame, ids: str = "ids", bos: int | None = None, eos: int | None = SPECIAL_ID, max_length: int = -1
) -> DataFrame:
    """T4: optional BOS in front, EOS at the end (default), then truncation.

    Truncation comes after EOS is added, so a truncated sequence loses its EOS.
    """
    c = F.col(ids)
    if bos is not None:
        c = F.concat(F.array(F.lit(bos).cast("int")), c)
    if eos is not None:
        c = F.concat(c, F.array(F.lit(eos).cast("int")))
    if max_length > 0:
        c = F.slice(c, 1, max_length)
    return df.withColumn(ids, c)


def encode_documents(
    docs: DataFrame,
    vocab_size: int = 1024,
    bos: int | None = None,
    eos: int | None = SPECIAL_ID,
    max_length: int = -1,
    text: str = "text",
    keep: Sequence[str] = ("doc_id", "source"),
) -> DataFrame:
    """T2 -> T3 (hashed) -> T4 as one projection: (keep..., n_tokens, ids)."""
    d = tokenize(docs.select(*keep, text), text=text)
    # length from the words alone: a plan that needs only lengths (offsets)
    # prunes the hashing of every token
    n = F.size("words") + F.lit(int(bos is not None) + int(eos is not None))
    if max_length > 0:
        n = F.least(n, F.lit(max_length))
    d = d.withColumn("n_tokens", n.cast("bigint"))
    d = encode(d, vocab_size=vocab_size)
    d = add_special(d, bos=bos, eos=eos, max_length=max_length)
    return d.drop("words", text)


def each_token(df: DataFrame, words: str) -> DataFrame:
    """One row per token.  A plain ``explode`` adds a filter on the array's size, which splits the texts a second time."""
    return df.select(F.explode_outer(words).alias("token")).filter(F.col("token").isNotNull())


def build_vocab(df: DataFrame, words: str = "words", max_size: int | None = None) -> DataFrame:
    """(token, id, n) for all tokens, or the ``max_size - 1`` most frequent ones.

    Rank by count descending, then token; ids start at 1.  With ``max_size`` the top-k is a
    distributed ``TakeOrderedAndProject`` and the numbering runs on the bounded
    result only.  Without it tokens are ranked inside their count by a two-level rank over
    ranges of the token's first bytes, and the base of a count comes from the table of distinct counts.
    """
    counts = each_token(df, words).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    if max_size is None:
        counts = cut_lineage(counts)  # three branches read it, and the plan would split the texts again for each
        # tokens of one count are ranked by token inside (count, first two bytes) groups
        d = counts.withColumn("_neg", -F.col("n")).withColumn("_first", F.substring(F.hex("token"), 1, 4))
        d = prefix_rank(d, ["_neg"], ["_first", "token"], "_in", bucket=F.conv(F.rpad("_first", 4, "0"), 16, 10))
        of_count = counts.groupBy((-F.col("n")).alias("_neg")).agg(F.count(F.lit(1)).alias("_k"))
        before = Window.orderBy("_neg").rowsBetween(Window.unboundedPreceding, -1)  # one row per distinct count
        of_count = of_count.withColumn("_base", F.coalesce(F.sum("_k").over(before), F.lit(0)))
        d = d.join(of_count, "_neg")
        return d.select("token", (F.col("_base") + F.col("_in")).cast("int").alias("id"), "n")
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(max_size - 1)
    vocab = top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("token"))).cast("int"))
    return vocab.select("token", "id", "n")


def decode(df: DataFrame, vocab: DataFrame, ids: str = "ids", key: str = "doc_id", out: str = "text",
           vocab_rows: int | None = None) -> DataFrame:
    """T5: ids back to a space-joined string; unknown ids are skipped.  Every row of ``df``
    comes back: without any known id its text is empty."""
    entries = bounded_vocab(vocab.select(F.col("id").cast("int").alias("_item"), F.col("token").alias("_value")), vocab_rows)

    def texts(lists: pa.Array, found: pa.Table) -> pa.Array:
        offsets, places = placed(lists, found)
        before = np.concatenate([[0], np.cumsum(places.is_valid().to_numpy(zero_copy_only=False))])  # known ids before a place
        tokens = found["_value"].combine_chunks().take(places.drop_null())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(before[offsets.to_numpy()], pa.int32()), tokens), " ")

    return look_up(cut_lineage(df.select(key, ids)), ids, key, entries, texts, out, T.StringType())  # counted, then dealt


def missing_tokens(df: DataFrame, vocab: DataFrame, words: str = "words", vocab_rows: int | None = None) -> DataFrame:
    """Tokens of ``df`` that the vocabulary lacks (left anti join)."""
    toks = each_token(df, words).distinct()
    v = bounded_vocab(vocab.select("token"), vocab_rows)
    return toks.join(v, "token", "left_anti")


def require_ids(df: DataFrame, vocab: DataFrame, words: str = "words", vocab_rows: int | None = None) -> DataFrame:
    """Strict lookup; raises when a token is absent, else returns the ids."""
    vocab = cut_lineage(vocab.select("token", "id"))  # the check and the lookup read it
    missing = missing_tokens(df, vocab, words, vocab_rows).limit(5).collect()
    if missing:
        raise ValueError(f"tokens not found in the vocabulary: {[r.token for r in missing]}")
    return encode(df, words=words, vocab=vocab, vocab_rows=vocab_rows)


def corpus_stats(df: DataFrame, keys: Sequence[str] = ("source",), ids: str = "ids", vocab_size: int = 1024) -> DataFrame:
    """Documents, tokens, shortest/longest document and storage bytes per key."""
    width = 2 if vocab_size < U16_VOCAB_LIMIT else 4
    n = F.size(F.col(ids))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(n).cast("bigint").alias("n_tokens"),
        F.min(n).cast("bigint").alias("min_tokens"),
        F.max(n).cast("bigint").alias("max_tokens"),
        (F.sum(n) * F.lit(width)).cast("bigint").alias("bytes"),
    ).withColumn("id_width", F.lit(width).cast("int"))


def token_percentiles(df: DataFrame, keys: Sequence[str] = ("source",), ids: str = "ids", exact: bool = False) -> DataFrame:
    """Document-length quartiles per key: a mergeable sketch, or (``exact``) from the
    counts of the distinct lengths, interpolated."""
    n, at = F.size(ids), [0.25, 0.5, 0.75]
    if exact:
        lengths = df.groupBy(*keys, n.alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
        return lengths.groupBy(*keys).agg(F.percentile("_len", F.array(*[F.lit(x) for x in at]), F.col("_n")).alias("length_quartiles"))
    return df.groupBy(*keys).agg(F.percentile_approx(n, at, 1000).alias("length_quartiles"))
