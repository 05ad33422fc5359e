"""SentencePiece encoding and decoding with merge-type models, by a table of last tokens.

Merging a text and merging any stretch of its result give the same tokens, so every prefix of a text has one encoding, and that
ends in one token: the only piece ending there that is *compatible* with the last token of the prefix before it, which means
that merging the two pieces' characters gives these two pieces again.  The table of last tokens is filled in one pass: an
Aho-Corasick automaton lists the pieces of several characters that end at each character, longest first, and the first
compatible one is entered; where none is, the character itself is the token.  Reading the table backwards from the end gives
the tokens.  Characters without a piece become the pieces of their bytes.

Compatibility is tested by the model's own rule (best score first, then leftmost) on the few characters of the two pieces,
and remembered.  Where no piece holds a space after another character, nothing merges across the beginning of a word, so the
table is filled per word with the spaces before it, once per distinct word that a task holds; for other models the whole text
is one word.

Tasks keep at most ``WORDS`` words and ``PAIRS`` pairs and then begin anew.  Models are refused where the normaliser does more
than put a space in front and write spaces as ``▁``, where bytes have no pieces, or where probes differ from the library.

Edge cases: null and empty texts have no ids and decode to the empty text; special strings inside texts are plain text; very
long texts are worked on alone, very long words fill one table of 8 bytes a character; repeated rows get a row each; an
empty table gives no rows; other columns are passed on, a column of the result's name is refused.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from strataflow.llm.common import large_text, slices

WORDS = 400_000
PAIRS = 2_000_000
SPACE = "▁"
PROBES = ["", "a", " ", "   ", "a b", " a  b ", "x      yz\t\n  q", "ﬁ Ａé 世界  \U0001f600\U0001f600", "▁▁ ▁a▁", "<s>a</s><unk><0x41>", "aaaaaaaaaaaaaa", "http://exa-mple.org/?q=1&r=%20", "\x00​", "==============="]


class _Fits(dict):
    """Whether two tokens are compatible, by left * base + right; at the beginning, whether merging the one gives itself.

    Characters without a piece are the negative numbers -1 - code point.
    """

    def __init__(self, table: PrefixTable):
        super().__init__()
        self.table = table

    def __missing__(self, key: int) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        left, right = divmod(key, self.table.start[0])
        pair = [self.table.names[right]]
        if left != self.table.start[0]:
            pair.insert(0, self.table.names[left] if left >= 0 else chr(-1 - left))
        self[key] = fit = self.table.merged(list("".join(pair))) == pair
        return fit


class _Lone(dict):
    """The entry of a character by itself: (token, length)."""

    def __missing__(self, char: str) -> tuple[int, int]:
        return -1 - ord(char), 1


class PrefixTable:
    """The encoder; texts are given with their spaces written as ``▁``."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.sp.get_piece_size())
        own = [i for i in ids if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        self.names = {i: self.sp.id_to_piece(i) for i in own}
        self.score = {name: self.sp.get_score(i) for i, name in self.names.items()}
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.by_word = all(SPACE not in name.lstrip(SPACE) for name in self.names.values())
        joined = set("".join(name for name in self.names.values() if len(name) > 1))
        # Nothing merges with these characters, such as line ends.
        alone = "".join(rf"\x{c:02X}" for c in range(128) if chr(c) not in joined)
        self.word = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.automaton = ahocorasick.Automaton()
        for i, name in self.names.items():
            if len(name) > 1:
                self.automaton.add_word(name, (i, len(name)))
        self.lone = _Lone({name: (i, 1) for i, name in self.names.items() if len(name) == 1})
        self.automaton.make_automaton()
        #: What stands before the first token: a number that no token has.
        self.start = (len(ids), 0)
        self.fits = _Fits(self)
        plain = all(self.sp.normalize(t) == SPACE + t.replace(" ", SPACE) for t in PROBES if t)
        if not plain or not all(map(self.sp.is_byte, self.bytes)):
            raise ValueError("this model normalises texts or lacks pieces for bytes")
        if any(self.encode(t) != self.sp.encode(t) for t in PROBES):
            raise ValueError("this model is not of the merge type")

    def words(self, text: str) -> list[str]:
        """The stretches of a text that are encoded apart."""
        whole = SPACE + text.replace(" ", SPACE) if text else ""
        if not self.by_word:
            return [whole] if whole else []
        return self.word.findall(whole)

    def merged(self, symbols: list[str]) -> list[str]:
        """The model's rule on a few symbols: join the best pair, of equals the leftmost, until none has a piece."""
        none, score = float("-inf"), self.score.get
        scores = [score(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            k = scores.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = score(symbols[k - 1] + symbols[k], none)
            if k < len(scores):
                scores[k] = score(symbols[k] + symbols[k + 1], none)
        return symbols

    def ids(self, word: str) -> list[int]:
        last: list = [self.start, *map(self.lone.__getitem__, word)]
        fits, base, filled = self.fits, self.start[0], 0
        for end, entry in self.automaton.iter(word):
            # The first fit at a character is the only one; where no longer piece fits, its own entry stands there already.
            if filled <= end and fits[last[end + 1 - entry[1]][0] * base + entry[0]]:
                filled = end + 1
                last[filled] = entry
        out, at = [], len(word)
        while at:
            token, length = last[at]
            if token >= 0:
                out.append(token)
            else:
                out.extend(self.bytes[b] for b in reversed(chr(-1 - token).encode()))
            at -= length
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in self.ids(w)]


@functools.lru_cache(maxsize=2)
def _table(path: str) -> PrefixTable:
    return PrefixTable(path)


class _Codes(dict):
    """Number of each distinct word; a new word is encoded, and its ids are added to one flat array."""

    def __init__(self, table: PrefixTable):
        super().__init__()
        self.table, self.flat, self.starts = table, array("i"), array("q", [0])

    def __missing__(self, word: str) -> int:
        self.flat.extend(self.table.ids(word))
        self.starts.append(len(self.flat))
        self[word] = code = len(self)
        return code

    def ids(self, texts: list[str]) -> pa.ListArray:
        """The ids of every text, gathered from the flat array."""
        import numpy as np

        parts = [np.fromiter(map(self.__getitem__, self.table.words(t)), np.int64) for t in texts]
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        flat, starts = np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32), np.array(self.starts)
        size = (starts[1:] - starts[:-1])[codes]
        after = np.cumsum(size)
        at = np.arange(int(after[-1]) if len(after) else 0) + np.repeat(starts[:-1][codes] - after + size, size)
        rows = np.cumsum([0, *map(len, parts)])
        ends = np.concatenate(([0], after))[rows]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[at], pa.int32()))


def _with(df: DataFrame, name: str, kind) -> StructType:
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    return StructType([*df.schema.fields]).add(name, kind)


def encode_texts(docs: DataFrame, model: str, text_col: str = "text", out_col: str = "ids", words: int = WORDS) -> DataFrame:
    """All columns of ``docs`` and the ids of the text, without begin or end ids.  ``model``: its path on the executors."""
    _table(model)  # a model that can't be encoded so is refused here
    schema = _with(docs, out_col, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(_table(model))
        for batch in (s for b in batches for s in slices(b, text_col)):
            if len(codes) > words:
                codes = _Codes(_table(model))
            ids = codes.ids(large_text(batch.column(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns and the text that the library decodes the ids to; null ids decode to the empty text."""
    schema = _with(encoded, out_col, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        sp = _table(model).sp
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column(ids_col)
                flat, size = ids.flatten().to_numpy().tolist(), pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
                ends = np.cumsum(size)
                texts = [sp.decode(flat[a:b]) if b > a else "" for a, b in zip(ends - size, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    return encoded.mapInArrow(run, schema)


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text that they decode to."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = decode_ids(encode_texts(rows, model).drop("text"), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
