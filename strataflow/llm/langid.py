"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly the strings that occur in it.  A document is parsed
into phrases: the longest string that continues to occur, then the next.  The language that needs the fewest phrases per
letter position wins.  The automata are laid out as one transition table, whose missing moves start a new phrase, and many
stretches of text walk through it at once.

Training: rows whose crc32(id) mod 5 is not 0, with text and language.  Every language is learned.  A bounded sample makes its
automaton: the first ``sample_chars`` characters of its rows in order of a hash of their id or, where there are many
languages, an equal share of ``total_chars``.  Both bounds are parameters; they bound what reaches the driver, and with it the
table of all automata in a worker, whatever the corpus.

Edge cases: a null text or one without a letter gives ``und`` and score 0; with nothing to learn from, every text does;
ties go to the language that sorts first; repeated rows are judged alike; language, source and id never enter a
prediction; very long texts are cut into stretches, all of which count; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.llm.common import large_text, slices

SAMPLE_CHARS = 40_000
TOTAL_CHARS = 640_000
FOLDS = 5
STRETCH = 1024
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def fold(id_col):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def training_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> dict[str, str]:
    """A bounded sample of labelled text per language; at most ``total_chars`` characters reach the driver.

    Rows are taken in order of a hash of their id.  A threshold on the hash, set from the number of rows and the mean length of
    each language, lets through about three times the sample; of all languages at once only those rows are sorted.  A
    language whose rows below its threshold hold too little is asked for again with a wider one.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.coalesce(fold(id_col), F.lit(1)) != 0))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    left = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    size = min(sample_chars, max(1, total_chars // max(1, len(left))))
    out, wider = {}, 1
    while left:
        shares = {k: min(1.0, wider * (3 * size / max(1, r["chars"]) + 20 / r["n"])) for k, r in left.items()}
        bounds = rows.sparkSession.createDataFrame([(k, min(int(-(2**63) + x * (2**64 - 1)), 2**63 - 1)) for k, x in shares.items()], "lang string, bound long")
        some = rows.join(F.broadcast(bounds), "lang").where(F.col("h") <= F.col("bound")).select("lang", "h", F.substring("text", 1, size).alias("t"))
        before = F.sum(F.length("t")).over(W.partitionBy("lang").orderBy("h", "t").rowsBetween(W.unboundedPreceding, -1))
        texts: dict[str, list[str]] = {}
        for r in some.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < size).select("lang", "h", "t", F.substring("t", F.lit(1), (size - F.col("before")).cast("int")).alias("cut")).orderBy("lang", "h", "t").collect():
            texts.setdefault(r["lang"], []).append(r["cut"])
        for k in list(left):
            if shares[k] == 1.0 or sum(map(len, texts.get(k, []))) >= size:
                out[k] = "\n".join(texts.get(k, []))[:size]
                del left[k]
        wider *= 8
    return {k: v for k, v in sorted(out.items()) if any(c.isalpha() for c in v)}


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the least automaton of all substrings (online construction); state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nxt


class CrossParser:
    """All languages' automata in one table: entry = 2 * next row + (1 if a phrase ends before this symbol)."""

    def __init__(self, texts: dict[str, str]):
        import numpy as np

        self.languages = sorted(texts)
        # Symbols: 0 ends a stretch, 1 is any ASCII byte that is no letter, then letters, then the other bytes.
        self.classes = np.ones(256, np.uint8)
        for i in range(26):
            self.classes[97 + i] = 2 + i
        seen = sorted({b for t in texts.values() for b in t.lower().encode() if b >= 128})
        for i, b in enumerate(seen):
            self.classes[b] = 28 + i
        width = 29 + len(seen)
        for b in range(128, 256):
            if b not in set(seen):
                self.classes[b] = width - 1
        self.width = width
        tables, self.starts, base = [], [], 0
        for lang in self.languages:
            codes = self.symbols(np.frombuffer(texts[lang].lower().encode(), np.uint8)).tolist()
            nxt = suffix_automaton(codes)
            # One more state stands for a symbol that this language lacks: a phrase by itself, which ends at the next symbol.
            lacks = 2 * (base + len(nxt)) * width
            root = np.full(width, lacks + 1, np.int64)
            for c, s in nxt[0].items():
                root[c] = 2 * (base + s) * width + 1
            table = np.tile(root, (len(nxt) + 1, 1))
            for s, moves in enumerate(nxt):
                for c, to in moves.items():
                    table[s, c] = 2 * (base + to) * width
            table[0, table[0] == lacks + 1] = lacks  # at the start no phrase is open
            table[:, 0] = 2 * base * width  # the end of a stretch goes back to the start and is no phrase
            tables.append(table)
            self.starts.append(base * width)
            base += len(nxt) + 1
        self.table = np.concatenate(tables).reshape(-1).astype(np.int32 if 2 * base * width < 2**31 else np.int64) if tables else None

    def symbols(self, data):
        """Classes of bytes; runs of what is no letter become one symbol."""
        import numpy as np

        codes = self.classes[data]
        again = np.zeros(len(codes), bool)
        again[1:] = (codes[1:] == 1) & (codes[:-1] == 1)
        return codes[~again]

    def phrases(self, stretches):
        """Phrases that each language needs for each row of a matrix (rows, STRETCH) of symbols."""
        import numpy as np

        counts = np.zeros((len(self.languages), len(stretches)), np.int32)
        steps = np.ascontiguousarray(stretches.T)
        for k, start in enumerate(self.starts):
            state = np.full(len(stretches), start, self.table.dtype)
            moved = np.empty_like(state)
            for row in steps:
                np.add(state, row, out=state)
                np.take(self.table, state, out=moved, mode="clip")
                counts[k] += moved & 1
                np.right_shift(moved, 1, out=state)
        return counts


_parsers: dict[int, CrossParser] = {}


def _parser(texts: dict[str, str]) -> CrossParser:
    """Built once per Python worker."""
    key = hash(tuple(sorted(texts.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(texts)
    return _parsers[key]


def predict(texts: pa.Array, parser: CrossParser) -> tuple[list[str], list[float]]:
    import numpy as np
    import pyarrow.compute as pc

    text = large_text(texts)
    letters = pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False)
    if parser.table is None:
        return ["und"] * len(text), [0.0] * len(text)
    rows, owner, n_symbols = [], [], np.ones(len(text), np.int64)
    for i, t in enumerate(pc.utf8_lower(text)):
        if letters[i]:
            codes = parser.symbols(np.frombuffer(t.as_buffer(), np.uint8))
            n = -(-len(codes) // STRETCH)
            block = np.zeros((n, STRETCH), np.uint8)
            block.reshape(-1)[: len(codes)] = codes
            rows.append(block)
            owner += [i] * n
            n_symbols[i] = len(codes)
    total = np.zeros((len(text), len(parser.languages)))
    if rows:
        stretches, owner = np.concatenate(rows), np.array(owner)
        # Short stretches first, so that each block is walked only as far as its longest row.
        used = (stretches != 0).sum(axis=1)
        order = np.argsort(used, kind="stable")
        for a in range(0, len(order), 4096):
            part = order[a : a + 4096]
            counts = parser.phrases(stretches[part, : used[part].max()])
            for k in range(len(parser.languages)):
                np.add.at(total[:, k], owner[part], counts[k])
    rate = (total + 1) / n_symbols[:, None]
    best = rate.argmin(axis=1)
    least = rate[np.arange(len(text)), best]
    rate[np.arange(len(text)), best] = np.inf
    second = rate.min(axis=1)
    score = np.where(np.isfinite(second), 1 - least / np.where(np.isfinite(second), second, 1), 1.0)
    return [parser.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(score, letters, strict=True)]


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (how far the winner's phrase rate lies below the second's) of every row."""
    learned = docs.sparkSession.sparkContext.broadcast(training_texts(docs, id_col, text_col, lang_col, sample_chars, total_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataflow.llm import langid

        parser = langid._parser(learned.value)
        for batch in (s for b in batches for s in slices(b, "text")):
            langs, scores = langid.predict(batch.column("text"), parser)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
