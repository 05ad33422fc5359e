"""Packing into windows of fixed size by deficit round-robin over source queues.

Each source is a queue of grains: pieces of at most ``grain`` tokens, in the order of its documents.  In every round, which
is one window, a queue is credited with its share of the window and sends the grains that its credit covers; credit that
does not cover the next grain is carried on.  A grain is therefore sent in the first round whose summed credit reaches the
grain's end in its queue, which only needs the queue's running sum: rounds can be worked out in any partition, and deficits
pass across windows and partitions without any state.  Grains in order of (round, source, place in the queue) follow one
another without gaps; windows cut that sequence at every multiple of the window size, so only the last window is padded.

Weights: a queue that has run dry leaves its share to the others, in proportion to their weights.  When every queue has been
credited with v times its weight, all have sent the sum of min(v * weight, tokens), which is the round times the window
size; the rounds at the ends of each queue's slots come from prefix sums over that sum, and credit is even inside a slot.

With training positions instead, documents queue in that order, and credits change over time: training is divided into
``KNOTS`` spans, and in the rounds of a span a queue is credited with an even part of the tokens that it holds there.

A document's ids stay in the file of the task that made them: placements go to them, not they to the placements.

Edge cases: a null position sorts last; a null text is an empty one and has the end token alone; rows that repeat an id are
documents of their own; a null source is a queue of its own; null ids stay null; an empty table gives no pieces; texts of any
length are cut into grains; weights of 0 or less are refused; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.llm.common import ROW_BITS, WORD_SLICE_BYTES, Scratch, large_text, never_null, released, running_sum, slices, visit_rows, written

WINDOW = 1024
GRAIN = 256
END = 0
SLOTS = 1024
KNOTS = 64
TABLE_SIZE = 400_000
# Distinct words that one call encodes.
TOGETHER = 4096
TOKENS = "_row long, doc_id long, source string, slot int, tie long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# White space as Unicode has it, without the four separators that only Python counts.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class WordTokens:
    """Token ids of texts, by way of the ids of their space-separated words.

    A byte-level tokenizer of this kind never joins what stands before a single space with what stands after, and takes
    the space to the word that follows.  So the ids of a text are those of its first word and of each ' word' after it.
    ``ranked``: whether :func:`ranks_agree` holds for the file.  Then the distinct words of many texts are encoded together,
    as a text of their own, which is cut into words by its tokens' lengths; otherwise each word is encoded once and kept in a
    table.  Texts in which a space has white space beside it, or with a special string, are encoded whole.
    """

    def __init__(self, path: str, table_size: int = TABLE_SIZE, ranked: bool = False):
        import numpy as np

        self.whole = _tokenizer(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.kind = id_type(self.whole)
        self.fast = None
        if ranked:
            self.fast, ranks = _ranked(self.whole)
            self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            self.sizes[list(ranks.values())] = [len(token) for token in ranks]
        self.table_size = table_size
        self.table: dict[str, bytes] = {}

    def _encode(self, text: str) -> list[int]:
        if self.fast is not None and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids

    def _alone(self, words: pa.Array, lead: str) -> tuple:
        """Lengths and ids of words that are encoded one by one."""
        import numpy as np

        lists, table = [], self.table if self.fast is None else {}
        for word in words.to_pylist():
            ids = table.get(lead + word)
            if ids is None:
                ids = table[lead + word] = np.array(self._encode(lead + word), self.kind).tobytes()
            lists.append(ids)
        flat = np.frombuffer(b"".join(lists), self.kind)
        return np.array([len(x) for x in lists], np.int64) // flat.itemsize, flat

    def _together(self, words: pa.Array, lead: str) -> tuple:
        """Lengths and ids of words that are not empty and don't end in white space."""
        import numpy as np
        import pyarrow.compute as pc

        lengths, flat = [np.zeros(0, np.int64)], [np.zeros(0, self.kind)]
        bounds = pc.binary_length(words).to_numpy(zero_copy_only=False) + len(lead)
        for i in range(0, len(words), TOGETHER):
            text = lead + lead.join(words.slice(i, TOGETHER).to_numpy(zero_copy_only=False))
            ids = np.array(self.fast.encode_ordinary(text), self.kind)
            last = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(bounds[i : i + TOGETHER]))
            lengths.append(np.diff(last + 1, prepend=0))
            flat.append(ids)
        return np.concatenate(lengths), np.concatenate(flat)

    def of(self, texts: pa.Array) -> list:
        """An array of ids, without an end token, for each text."""
        import numpy as np
        import pyarrow.compute as pc

        if len(self.table) > self.table_size:
            self.table.clear()
        odd = pc.match_substring_regex(texts, f"[{_SPACE}][ ]|[ ][{_SPACE}]")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list = [np.zeros(0, self.kind)] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.array(self._encode(texts[i].as_py()), self.kind)
        plain = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
        if len(plain):
            chosen = texts.take(pa.array(plain))
            lists = pc.split_pattern(chosen, " ")
            words, stops = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            first, blank = np.zeros((2, len(words)), bool)
            first[np.concatenate(([0], stops[:-1]))] = True
            # Only the last word of a text may be empty or end in white space, which would meet the next word's space.
            blank[stops[pc.match_substring_regex(chosen, f"[{_SPACE}]$").to_numpy(zero_copy_only=False)] - 1] = True
            codes, lengths, flat, known = np.empty(len(words), np.int64), [], [], 0
            for lead, mask, encode in (("", first, self._alone), (" ", blank & ~first, self._alone), (" ", ~blank & ~first, self._together if self.fast else self._alone)):
                coded = words.filter(pa.array(mask)).dictionary_encode()
                codes[mask] = known + coded.indices.to_numpy(zero_copy_only=False)
                known += len(coded.dictionary)
                for to, part in zip((lengths, flat), encode(coded.dictionary, lead), strict=True):
                    to.append(part)
            lengths, flat = np.concatenate(lengths), np.concatenate(flat)
            begins = np.cumsum(lengths) - lengths
            n = lengths[codes]
            ends = np.cumsum(n)
            ids = flat[np.repeat(begins[codes] - (ends - n), n) + np.arange(ends[-1])]
            for i, part in zip(plain.tolist(), np.split(ids, ends[stops - 1][:-1]), strict=True):
                out[i] = part
        return out


@functools.lru_cache(maxsize=1)
def _encoder(path: str, table_size: int, ranked: bool) -> WordTokens:
    """The encoder of a worker, whose later tasks need not read the file again."""
    return WordTokens(path, table_size, ranked)


def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return whole


def id_type(tokenizer) -> str:
    """The least unsigned type that holds every id of the vocabulary."""
    return "<u2" if max(END, *tokenizer.get_vocab().values()) < 1 << 16 else "<u4"


def _byte_names() -> dict[str, int]:
    """The character that byte-level tokenizers write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(tokenizer):
    """The same vocabulary for a library that merges by rank, and its tokens' ranks."""
    import json

    import public_tokenizers
    import tiktoken

    spec, byte_of = json.loads(tokenizer.to_str()), _byte_names()
    added = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def ranks_agree(path: str) -> bool:
    """Whether merging by rank gives the file's ids: a byte-level BPE without a normaliser or exceptions, whose merges stand in
    the order of their ids and make every token that is no byte, and whose tokens both libraries encode alike."""
    import json

    whole = _tokenizer(path)
    spec = json.loads(whole.to_str())
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return False
    vocab, byte_of = model["vocab"], _byte_names()
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    added = {t["content"] for t in spec["added_tokens"]}
    plain = {t for t in vocab if t not in added}
    if any(vocab[a] >= vocab[b] for a, b in zip(made, made[1:], strict=False)) or {t for t in plain if len(t) > 1} != set(made) or any(c not in byte_of for t in plain for c in t):
        return False
    (fast, _), texts = _ranked(whole), []
    for token in plain:
        try:
            texts.append(bytes(byte_of[c] for c in token).decode())
        except UnicodeDecodeError:  # a part of a character is no text
            continue
    return all(a.ids == fast.encode_ordinary(t) for a, t in zip(whole.encode_batch(texts, add_special_tokens=False), texts, strict=True))


def _tokenize(path: str, slots: int, table_size: int, ordered: bool, ranked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash
        from pyspark import TaskContext

        encoder, row = _encoder(path, table_size, ranked), TaskContext.get().partitionId() << ROW_BITS
        names = [x.split()[0] for x in TOKENS.split(", ")]
        end = np.array([END], encoder.kind)
        for batch in (s for b in batches for s in slices(b, "text", WORD_SLICE_BYTES)):
            ids = [np.concatenate((x, end)) for x in encoder.of(large_text(batch.column("text")))]
            if ordered:
                at = batch.column("position").fill_null(1.0).to_numpy(zero_copy_only=False)
                ties = (np.clip(at, 0.0, 1 - 2.0**-53) * 2.0**63).astype(np.int64)
            else:
                ties = np.array([xxhash.xxh64_intdigest(str(x)) >> 1 for x in batch.column("doc_id").to_pylist()], np.int64)
            rows = np.arange(row, row + len(ids))
            row += len(ids)
            columns = [pa.array(rows), batch.column("doc_id"), batch.column("source"), pa.array((ties >> 32) * slots >> 31, pa.int64()).cast(pa.int32()), pa.array(ties), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(encoder.kind).tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return released(run)


def _cut(window: int, kind: str):
    """Pieces of the placed grains (_row, start, len, at) of a file's documents."""

    def visit(batches: Iterator[pa.RecordBatch], asks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ahead = np.zeros((0, 4), np.int64)
        for batch in batches:
            rows = batch.column("_row").to_numpy()
            while not len(ahead) or ahead[-1, 0] <= rows[-1]:
                more = next(asks, None)
                if more is None:
                    break
                ahead = np.concatenate((ahead, np.stack([c.to_numpy() for c in more.columns], axis=1)))
            n = int(np.searchsorted(ahead[:, 0], rows[-1], side="right"))
            (row, start, length, at), ahead = ahead[:n].T, ahead[n:]
            if not n:
                continue
            # Grains that follow one another in the document and in the sequence are one run; runs are cut at windows.
            first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + length[:-1]))))
            length = np.add.reduceat(length, first)
            row, start, at = row[first], start[first], at[first]
            parts = (at + length - 1) // window - at // window + 1
            run = np.repeat(np.arange(len(row)), parts)
            turn = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = np.maximum(at[run], (at[run] // window + turn) * window)
            end = np.minimum(at[run] + length[run], (at[run] // window + turn + 1) * window)
            place = start[run] + begin - at[run]
            doc = np.searchsorted(rows, row[run])
            ids = batch.column("ids")
            bounds = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)
            flat = np.frombuffer(ids.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(kind).astype("<u4").view(np.uint8).data
            base = 4 * ((bounds[:-1] - bounds[0]) // np.dtype(kind).itemsize).astype(np.int64)[doc] + 4 * place
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(base.tolist(), (base + 4 * (end - begin)).tolist(), strict=True)]
            index = pa.array(doc)
            columns = [batch.column("doc_id").take(index), pa.array(place), pa.array(end - begin), pa.array(crc, pa.int64()), batch.column("n_tokens").take(index), pa.array(begin // window), pa.array(begin % window)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")])

    return visit


def _by_weight(sums: DataFrame, queues: DataFrame, window: int) -> DataFrame:
    """(key, slot, r1): the round in which the queue's slot has been sent, from (key, slot, n, base) and (key, total, weight)."""
    if queues.where(~(F.col("weight") > 0)).limit(1).count():
        raise ValueError("weights must be above 0")
    most = queues.agg(F.max(F.col("total") / F.col("weight")).alias("v"), F.sum("weight").alias("w")).first()
    points = sums.join(queues, "key").select("key", "slot", ((F.col("base") + F.col("n")) / F.col("weight")).alias("v"), F.lit(0).cast("double").alias("n"), F.lit(0.0).alias("w"))
    dry = queues.select("key", F.lit(None).cast("int").alias("slot"), (F.col("total") / F.col("weight")).alias("v"), F.col("total").cast("double").alias("n"), F.col("weight").alias("w"))
    points = points.unionByName(dry).withColumn("one", F.lit(0)).withColumn("bin", F.floor(F.col("v") / (most["v"] or 1.0) * 4096).cast("int"))
    points = written(points, "points")
    for value in ("n", "w"):
        points = running_sum(points, ["one"], ["v"], "bin", value, f"dry_{value}")
    sent = F.col("dry_n") + F.col("v") * F.greatest((most["w"] or 0.0) - F.col("dry_w"), F.lit(0.0))
    return points.where(F.col("slot").isNotNull()).select("key", "slot", (sent / window).alias("r1"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, grain: int = GRAIN, weights: dict[str | None, float] | tuple[float, ...] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS, table_size: int = TABLE_SIZE, position_col: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    ``weights``: share of each source in a window, by source, where sources without a weight get the least of the weights, or as
    a tuple that sources in order of their names take in turn; by default a source's share of all tokens, so that all queues
    last to the end.  ``position_col``: training positions in 0..1 that
    order the documents and set the shares over time, instead of weights.
    """
    if weights and position_col:
        raise ValueError("shares are set by weights or by positions")
    if window < 1 or not 0 < grain <= window:
        raise ValueError("0 < grain <= window is needed")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), *([F.col(position_col).cast("double").alias("position")] if position_col else []))
    tokens = Scratch(rows.mapInArrow(_tokenize(tokenizer, slots, table_size, position_col is not None, ranks_agree(tokenizer)), TOKENS), "tokens")
    meta = tokens.df.select("_row", never_null(F.col("source")).alias("key"), "slot", "tie", "n_tokens")
    sums = meta.groupBy("key", "slot").agg(F.sum("n_tokens").alias("n"))
    sums = written(sums.withColumn("base", F.sum("n").over(W.partitionBy("key").orderBy("slot")) - F.col("n")), "slots")
    queues = sums.groupBy("key").agg(F.sum("n").alias("total"))
    queues = queues.withColumn("queue", F.row_number().over(W.orderBy("key")))
    share = F.col("total").cast("double")
    if isinstance(weights, tuple):
        share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("queue") - 1) % len(weights) + 1).cast("int"))
    elif weights:
        share = F.coalesce(*[F.when(F.col("key") == ("null" if k is None else f"={k}"), F.lit(float(v))) for k, v in weights.items()], F.lit(float(min(weights.values()))))
    queues = written(queues.select("key", "total", share.alias("weight"), "queue"), "queues")
    # The rounds between which each slot of a queue is sent.
    if position_col:
        rounds = (queues.agg(F.sum("total")).first()[0] or 0) / window
        own = W.partitionBy("key", "span")
        by_slot = sums.withColumn("span", F.floor(F.col("slot") * KNOTS / slots))
        by_slot = by_slot.withColumn("held", F.sum("n").over(own)).withColumn("passed", F.min("base").over(own))
        by_slot = by_slot.select("key", "slot", "n", "base", *[(rounds * (F.col("span") + (F.col("base") + x - F.col("passed")) / F.col("held")) / KNOTS).alias(r) for r, x in (("r0", F.lit(0)), ("r1", F.col("n")))])
    else:
        by_slot = sums.join(_by_weight(sums, queues.drop("queue"), window), ["key", "slot"])
        # A queue's rounds never fall, however the sums were rounded: grains of a round must follow one another.
        by_slot = by_slot.withColumn("r1", F.max("r1").over(W.partitionBy("key").orderBy("slot")))
        by_slot = by_slot.withColumn("r0", F.coalesce(F.lag("r1").over(W.partitionBy("key").orderBy("slot")), F.lit(0.0)))
    by_slot = by_slot.join(queues.select("key", "queue"), "key")
    inside = W.partitionBy("key", "slot").orderBy("tie", "_row").rowsBetween(W.unboundedPreceding, -1)
    placed = meta.join(by_slot, ["key", "slot"]).withColumn("past", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    grains = placed.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(grain).cast("long"))))
    grains = grains.withColumn("len", F.least(F.lit(grain).cast("long"), F.col("n_tokens") - F.col("start"))).withColumn("inside", F.col("past") + F.col("start"))
    sent = F.col("r0") + (F.col("inside") + F.col("len")) / F.col("n") * (F.col("r1") - F.col("r0"))
    grains = written(grains.select("_row", "queue", "start", "len", (F.col("base") + F.col("inside")).alias("from"), F.ceil(F.least(sent, "r1")).cast("long").alias("round")), "grains")
    # Where each queue's part of each round begins in the sequence.
    turns = grains.groupBy("round", "queue").agg(F.min("from").alias("first"), F.sum("len").alias("sent"))
    last = grains.agg(F.max("round")).first()[0] or 0
    turns = turns.withColumn("block", F.floor(F.col("round") / max(64, -(-last // 4096))).cast("long")).withColumn("one", F.lit(0))
    turns = running_sum(turns, ["one"], ["round", "queue"], "block", "sent", "begin").select("round", "queue", (F.col("begin") - F.col("first")).alias("shift"))
    laid = grains.join(turns, ["round", "queue"]).select("_row", "start", "len", (F.col("from") + F.col("shift")).alias("at"))
    return visit_rows(tokens, laid, ["doc_id", "n_tokens", "ids"], _cut(window, id_type(_tokenizer(tokenizer))), PIECES)
