"""Token counts: every distinct pre-token of the corpus is cut into pieces once, its count is joined to the documents'
pre-token frequencies, and documents sum the products.  Ids are never gathered.

A pre-token here is a unit that no piece reaches across.  For JSON tokenizers that drop white space it is a run between
ASCII spaces; for sentencepiece models whose pieces hold spaces only at their beginning it is a word with the spaces before
it.  Both conditions are checked when the tokenizer is loaded.

1. Tasks collect their distinct pre-tokens; one aggregation makes them distinct over the corpus; each is counted once.
2. Pre-tokens that occur in most places, at most ``HEAD`` of them and none over ``HEAD_BYTES`` bytes, are the head, a table of
   bounded size that tasks read from the shared folder: frequencies meet these counts inside the task.
3. All other pre-tokens are rare ones.  Their (document, pre-token, frequency) rows are joined to the counts by a shuffle
   and summed per document.

Edge cases: a null or blank text has 0 tokens; special strings inside a text count as the tokenizer's default has them; very
long texts are worked on alone, very long pre-tokens are never in the head; repeated rows get a row each; null ids stay
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import ROW_BITS, Scratch, filesystem, large_text, slices, written

#: Pre-tokens of the head, and the bytes of the longest one: the head holds less than HEAD * HEAD_BYTES bytes.
HEAD = 300_000
HEAD_BYTES = 128
#: Distinct pre-tokens that a task of the first pass holds before it hands them on.
TABLE_SIZE = 500_000
PART = "_row long, doc_id long, n_bytes long, n_tokens long, token string, frequency long"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Pre-tokens of texts, and the number of pieces of a pre-token."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.spaced = path.endswith(".model")
        if self.spaced:
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
            plain = all("▁" not in x.lstrip("▁") for x in names)
            probes = ["a", "a b", " a  b ", "a\tb\n c", "", "x  ", "é 世界  \U0001f600"]
            if not plain or any(sum(self.counts(self.units(pa.array([t], pa.large_string()))[1].to_pylist())) != len(self.sp.encode(t)) for t in probes):
                raise ValueError("this model has pieces that reach across words; its pre-tokens can't be counted apart")
        else:
            from tokenizers import Tokenizer

            self.json = Tokenizer.from_file(path)
            self.json.no_truncation()
            self.json.no_padding()
            size = lambda x: len(self.json.encode(x, add_special_tokens=False))
            if size(" a\n\t b ") != size("a") + size("b"):
                raise ValueError("this tokenizer has pieces that hold spaces; its pre-tokens can't be counted apart")

    def units(self, texts: pa.Array):
        """(owner, pre-token) of every pre-token of the texts."""
        import re

        import numpy as np
        import pyarrow.compute as pc

        if not self.spaced:
            lists = pc.ascii_split_whitespace(texts)
            owner, flat = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()
            full = pc.not_equal(flat, "")
            return owner[full.to_numpy(zero_copy_only=False)], flat.filter(full)
        # The model puts a space before a text that isn't empty.
        found = [re.findall(r"[ ▁]*[^ ▁]+|[ ▁]+$", " " + t) if t else [] for t in texts.to_pylist()]
        return np.repeat(np.arange(len(texts)), [len(x) for x in found]), pa.array([u for x in found for u in x], pa.large_string())

    def counts(self, units: list[str]) -> list[int]:
        if not self.spaced:
            return [len(x) for x in self.json.encode_batch_fast(units, add_special_tokens=False)]
        # After a letter, the model adds no space of its own.
        lead = len(self.sp.encode("x"))
        return [len(x) - lead for x in self.sp.encode(["x" + u for u in units], num_threads=1)]


def _distinct(path: str, table_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        pieces, held, size = Pieces(path), [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("token").aggregate([("seen", "sum")]).rename_columns(["token", "seen"])

        for batch in (s for b in batches for s in slices(b, "text")):
            found = pc.value_counts(pieces.units(large_text(batch.column("text")))[1])
            held.append(pa.table({"token": found.field("values").cast(pa.string()), "seen": found.field("counts")}))
            size += len(found)
            if size > 2 * table_size:
                held = [merged()]
                size = held[0].num_rows
                if size > table_size:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from merged().to_batches()

    return run


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 10_000):
                part = batch.slice(i, 10_000)
                n = pieces.counts(part.column("token").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], names=["token", "seen", "pieces"])

    return run


def _summed(path: str, head: str):
    """One row per document with the tokens of its head pre-tokens, and one per document and other pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        fs, folder = filesystem(head)
        table = pq.read_table(folder, filesystem=fs, columns=["token", "pieces"])
        known = table.column("token").cast(pa.large_string()).combine_chunks()
        size = np.append(table.column("pieces").to_numpy(), 0)
        pieces, row = Pieces(path), TaskContext.get().partitionId() << ROW_BITS
        for batch in (s for b in batches for s in slices(b, "text")):
            text = large_text(batch.column("text"))
            owner, units = pieces.units(text)
            coded = units.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), len(known)).to_numpy(zero_copy_only=False)
            n = np.bincount(owner, weights=size[at[codes]], minlength=len(text)).astype(np.int64)
            rows = np.arange(row, row + len(text))
            row += len(text)
            own = len(text)
            rare = np.flatnonzero(at[codes] == len(known))
            pairs, frequency = np.unique(np.stack([owner[rare], codes[rare]]), axis=1, return_counts=True)
            none = pa.nulls(pairs.shape[1], pa.int64())
            columns = [
                np.concatenate((rows, rows[pairs[0].astype(np.int64)])), pa.concat_arrays([batch.column("doc_id"), none]), pa.concat_arrays([pc.binary_length(text).cast(pa.int64()), none]), pa.concat_arrays([pa.array(n), none]),
                pa.concat_arrays([pa.nulls(own, pa.string()), coded.dictionary.take(pa.array(pairs[1].astype(np.int64))).cast(pa.string())]), pa.concat_arrays([pa.nulls(own, pa.int64()), pa.array(frequency.astype(np.int64))]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), *columns[1:]], names=[x.split()[0] for x in PART.split(", ")])

    return run


def piece_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """(token, seen, pieces): every distinct pre-token of the corpus, how often it occurs, and its number of pieces."""
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_distinct(tokenizer, table_size), "token string, seen long")
    return written(found.groupBy("token").agg(F.sum("seen").alias("seen")).mapInArrow(_counted(tokenizer), "token string, seen long, pieces long"), "pieces")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    ``tokenizer``: path of a tokenizer file on the executors.
    """
    Pieces(tokenizer)  # a tokenizer that can't be counted by pre-tokens is refused here
    pieces = piece_counts(docs, tokenizer, text_col, table_size)
    short = pieces.where(F.octet_length("token") <= HEAD_BYTES)
    n = short.count()
    # More often than this many times at most ``head`` pre-tokens occur; what is at the bound itself is left out.
    least = short.agg(F.percentile_approx("seen", F.lit(1 - head / n), F.lit(100_000))).first()[0] if n > head else 0
    common = short.where(F.col("seen") > least).orderBy(F.desc("seen"), "token").limit(head) if n > head else short
    common = Scratch(common.select("token", "pieces").coalesce(1), "head")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = written(rows.mapInArrow(_summed(tokenizer, common.path), PART), "token-parts")
    rest = parts.where(F.col("token").isNotNull()).join(pieces.select("token", "pieces"), "token").groupBy("_row").agg(F.sum(F.col("frequency") * F.col("pieces")).alias("rest"))
    out = parts.where(F.col("token").isNull()).select("_row", "doc_id", "n_bytes", "n_tokens").join(rest, "_row", "left")
    total = F.col("n_tokens") + F.coalesce("rest", F.lit(0))
    return out.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
