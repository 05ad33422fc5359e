"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

Signatures: every shingle draws, for j = 0, 1, 2, ..., a value in [j, j + 1) for the j-th entry of its own random
permutation of the slots; a slot keeps the least value.  The shingles of one document use different ranks in each slot,
so the slots are negatively correlated and the estimate's variance is below that of independent permutations.  The draw
stops at the first level j where all slots of a document hold values under j + 1, which is after one to three levels for
all but short texts.

Links: documents that share a band of a signature are candidates.  Each bucket compares its members with its least member
(a star, never all pairs) on full sets; what is confirmed is grouped.  Members of buckets that still hold several groups
are open.  Two linked sets share one of the first quarter of their elements in any common order, so open nodes are keyed by
those, rarest first: a node with enough elements of its own then meets nobody.  Keys with equal members count once, and
within a key the nodes outside its largest group meet the nodes of other groups.  The join's condition holds parity bitmaps
of the sets against each other: sets differ in at least as many elements as their bitmaps in bits, so a pair with too many
is no link and is never made; nodes only meet others of about their size.  What passes is compared in full, so no link
between groups of open nodes is lost.  32 bands of 4 slots miss a pair of similarity 0.75 with probability 5e-6.  A set that
is compared with many others is sent once for each slice of them.

Texts are written once with a number for each row; nodes go by that number, and what later steps need of a text is made by
the task that reads its file, so whole texts are never shuffled.

Edge cases: a null or blank text has no shingles, is linked with nothing and is its own component; texts under ``k``
words have their whole word sequence as one shingle; equal sets fall together before banding, whatever their number; rows
that repeat a doc_id are rows of their own: all of a group's rows with the least id count as kept in ``near_duplicates``,
while ``distinct_documents`` keeps one; rows with a null id are linked like others, but their group is named by an id if it
has one, and has a null component if it has none; an empty table gives no rows; other columns are ignored, and
``distinct_documents`` passes them on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from strataflow.llm.common import WORD_SLICE_BYTES, Scratch, large_text, mix64, numbered, released, slices, visit_rows, written
from strataflow.llm.components import connected_components

SHINGLE = 5
BANDS = 32
ROWS = 4
PERCENT = 75
SKETCH = "_row long, doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, parity array<long>"
#: Longs in the parity bitmap of a set.
PARITY = 16


def shingle_hashes(texts: pa.Array, k: int = SHINGLE):
    """Distinct shingle hashes of each text: (flat sorted uint64 array, number per text)."""
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(large_text(texts)))
    n_texts = len(lists)
    owner = np.repeat(np.arange(n_texts), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten().dictionary_encode()
    named = flat.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in named), np.uint64, len(named))
    empty = np.fromiter((w == "" for w in named), bool, len(named))
    codes = flat.indices.to_numpy(zero_copy_only=False)
    if empty.any():  # blanks at an end of a text give empty words
        full = ~empty[codes]
        owner, codes = owner[full], codes[full]
    words = hashes[codes]
    counts = np.bincount(owner, minlength=n_texts)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    # Every shingle begins at a word that has k - 1 words after it; short texts have one shingle of all their words.
    at = np.arange(len(words)) - starts[owner]
    left = counts[owner] - at
    take = (left >= k) | ((at == 0) & (left > 0))
    first, length = np.flatnonzero(take), np.minimum(left[take], k)
    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        more = length > i
        step = mix64(h[more] ^ words[first[more] + i]) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i + 1)
        h[more] = step
    h, of = mix64(h), owner[first]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[fresh], np.bincount(of[fresh], minlength=n_texts)


def super_minhash(hashes, counts, slots: int):
    """SuperMinHash of many sets at once: float64 array (sets, slots); slots of empty sets stay infinite."""
    import numpy as np

    out = np.full(len(counts) * slots, np.inf)
    of = np.repeat(np.arange(len(counts)), counts)
    block = 1 << 17  # elements whose permutations are held at a time
    with np.errstate(over="ignore"):
        active = np.ones(len(counts), bool)
        held: list = []
        for j in range(slots):
            if not active.any():
                break
            if j == 0:
                chosen = np.arange(len(hashes))
            else:
                chosen = chosen[active[of[chosen]]]
            seeds = mix64(hashes[chosen] + np.uint64(j + 1) * np.uint64(0xD1342543DE82EF95))
            k = j + ((seeds >> np.uint64(32)) % np.uint64(slots - j)).astype(np.int64)
            value = j + (seeds & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32
            held.append((chosen, k))
            slot = k.copy()
            if j:
                slot = _entries(held, chosen, k, j, slots, block)
            np.minimum.at(out, of[chosen] * slots + slot, value)
            active &= out.reshape(-1, slots).max(axis=1) >= j + 1
            active &= counts > 0
    return out.reshape(-1, slots)


def _entries(held: list, chosen, k, j: int, slots: int, block: int):
    """What stands at entry k of each chosen element's permutation after the swaps (0, k0), ..., (j - 1, k of j - 1)."""
    import numpy as np

    slot = k.copy()
    for i in range(j - 1, -1, -1):
        before, swap = held[i]
        if len(before) != len(chosen):
            swap = swap[np.searchsorted(before, chosen)]
        slot = np.where(swap == slot, i, slot)
    return slot


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in (s for b in batches for s in slices(b, "text", WORD_SLICE_BYTES)):
            with np.errstate(over="ignore"):
                hashes, counts = shingle_hashes(batch.column("text"), k)
                ends = np.concatenate(([0], np.cumsum(counts)))
                totals = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(h))) for h in (mix64(hashes), mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
                f1, f2 = (mix64(t[ends[1:]] - t[ends[:-1]] + counts.astype(np.uint64)) for t in totals)
                ranks = super_minhash(hashes, counts, bands * rows).view(np.uint64).reshape(len(counts), bands, rows)
                band = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                for r in range(rows):
                    band = mix64(band ^ ranks[:, :, r]) + np.uint64(r)
                at = np.repeat(np.arange(len(counts)), counts) * (64 * PARITY) + (hashes % np.uint64(64 * PARITY)).astype(np.int64)
                odd = np.zeros(len(counts) * 64 * PARITY, np.uint8)  # a byte that wraps around keeps its parity
                np.add.at(odd, at, np.uint8(1))
                parity = pa.array(np.packbits(odd & 1).view(np.int64))
            full = counts > 0
            values = pa.array(band[full].reshape(-1).view(np.int64))
            offsets = np.concatenate(([0], np.cumsum(np.where(full, bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), values)
            columns = [batch.column("_row"), batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists, pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * PARITY), parity)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SKETCH.split(", ")])

    return released(run)


def _asked(batch: pa.RecordBatch, asks: Iterator[pa.RecordBatch], held: list) -> list[int]:
    """Places in a batch of the asked rows; ``held`` keeps asks for later batches."""
    import numpy as np

    rows = batch.column("_row").to_numpy()
    while not held or held[-1][-1] < rows[-1]:
        more = next(asks, None)
        if more is None:
            break
        held.append(more.column(0).to_numpy())
    if not held:
        return []
    wanted = np.unique(np.concatenate(held))
    n = int(np.searchsorted(wanted, rows[-1], side="right"))
    held[:] = [wanted[n:]] if n < len(wanted) else []
    return np.searchsorted(rows, wanted[:n]).tolist()


def _sets(k: int, text_col: str):
    """The shingle sets of the asked rows of a file."""

    def visit(batches: Iterator[pa.RecordBatch], asks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list = []
        for whole in batches:
            if not (at := _asked(whole, asks, held)):
                continue
            for batch in slices(whole.take(pa.array(at)), text_col, WORD_SLICE_BYTES):
                with np.errstate(over="ignore"):
                    hashes, counts = shingle_hashes(batch.column(text_col), k)
                ends = np.concatenate(([0], np.cumsum(counts)))
                raw = hashes.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array([raw[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["node", "hashes"])

    return visit


def _others(schema: pa.Schema):
    """The rows of a file that were not asked for."""

    def visit(batches: Iterator[pa.RecordBatch], asks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list = []
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[_asked(batch, asks, held)] = False
            yield from pa.Table.from_batches([batch]).select(schema.names).filter(pa.array(keep)).cast(schema).to_batches()

    return visit


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, token) rows of sets."""
    import numpy as np

    for whole in batches:
        for batch in slices(whole, "hashes", WORD_SLICE_BYTES):
            parts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("hashes")]
            owner = np.repeat(batch.column("node").to_numpy(), [len(x) for x in parts])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(parts))], names=["node", "token"])


LINKS = "a long, b long"


def _linked(percent: int):
    """The pairs of a batch that are linked on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            found = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    found.append(i)
            if found:
                take = batch.take(pa.array(found))
                yield pa.RecordBatch.from_arrays([take.column("a"), take.column("b")], names=["a", "b"])

    return released(run)


def _open_keys(level: DataFrame) -> DataFrame:
    """Rows (key, node, component) of keys with several groups, and whether the node is ``outside`` the largest group.  Of
    keys with equal members one stays."""
    groups = level.groupBy("key", "component").agg(F.count("*").alias("k"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"))
    keys = groups.groupBy("key").agg(F.sum("k").alias("m"), F.sum("s").alias("s"), F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
    keys = keys.groupBy("m", "s", "top").agg(F.min("key").alias("key")).select("key", F.col("top.component").alias("main"))
    return level.join(keys, "key").select("key", "node", "component", (F.col("component") != F.col("main")).alias("outside"))


#: Members that one copy of a star's centre is compared with.
SLICE = 2000


def _groups(table: Scratch, id_col: str, text_col: str, k: int, bands: int, rows: int, percent: int) -> DataFrame:
    """(_row, doc_id, n_shingles, component_id, keeper) of a numbered table; keeper: the row with the least id of the group."""
    texts = table.df.select("_row", F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = written(texts.mapInArrow(_sketches(k, bands, rows), SKETCH), "sketches")
    # Documents with equal sets are one node, named by its first row.
    first = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.col("_row").alias("row"))
    known = sketches.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min(F.struct("_row", "n_shingles", "bands", "parity")).alias("r"), F.min(first).alias("first"))
    nodes = written(known.select("f1", "f2", F.col("r._row").alias("node"), F.col("r.n_shingles").alias("n"), F.col("r.bands").alias("bands"), F.col("r.parity").alias("parity"), "first"), "nodes")
    buckets = nodes.select(F.explode("bands").alias("band"), "node", "n")
    centres = buckets.groupBy("band").agg(F.min("node").alias("centre"), F.min_by("n", "node").alias("m"), F.count("*").alias("members")).where("members > 1").drop("members")
    shared = written(buckets.join(centres, "band"), "buckets")
    # The sets of all nodes that share a band with another one, made once.
    wanted = shared.select(F.col("node").alias("_row")).distinct()
    sets = written(visit_rows(table, wanted, [text_col], _sets(k, text_col), "node long, hashes binary"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs.toDF("a", "b").distinct(), "pairs")
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("parts"))
        left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")).join(parts, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        sliced = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
        right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
        both = sliced.join(right, "b").join(left, ["a", "part"]).select("a", "b", "x", "y")
        return written(both.mapInArrow(_linked(percent), LINKS), "links")

    def grouped(rows: DataFrame, merged: DataFrame) -> DataFrame:
        known = merged.withColumnRenamed("node", "of")
        return rows.join(known, F.col("node") == F.col("of"), "left").drop("of").withColumn("component", F.coalesce("component", "node"))

    close = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    stars = shared.where((F.col("node") != F.col("centre")) & close("n", "m")).select("centre", "node")
    merged = written(connected_components(confirmed(stars)), "groups")
    labelled = grouped(shared.select("band", "node", "n"), merged)
    mixed = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    open_nodes = written(labelled.join(mixed, "band").select("node", "n", "component").distinct(), "open")
    # The beginning of each open set in order of rarity; elements that no other open set has come first and make no key.
    tokens = written(sets.join(open_nodes.select("node"), "node", "left_semi").mapInArrow(released(_tokens), "node long, token long"), "tokens")
    common = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1").withColumnRenamed("token", "t")
    of_node = Window.partitionBy("node")
    begin = tokens.join(common, F.col("token") == F.col("t")).select("node", "token", F.count("*").over(of_node).alias("c"), F.row_number().over(of_node.orderBy("f", "token")).alias("i"))
    begin = begin.join(open_nodes, "node").where(F.col("i") + F.col("n") - F.col("c") <= F.floor((100 - percent) * F.col("n") / 100) + 1)
    level = _open_keys(begin.select(F.col("token").alias("key"), "node", "component"))
    bits = nodes.join(open_nodes.select("node"), "node", "left_semi").select("node", "n", *[F.col("parity")[i].alias(f"p{i}") for i in range(PARITY)])
    # Sizes of linked sets lie less than one step apart, so only neighbouring steps meet.
    step = F.floor(F.log("n") / (math.log(100 / percent) * 1.001)).cast("int") if percent < 100 else F.col("n").cast("int")
    level = written(level.join(bits, "node").withColumn("step", step), "keys")
    asked = level.where("outside").withColumn("step", F.explode(F.array(*[F.col("step") + i for i in (-1, 0, 1)])))
    asked = asked.select(*[F.col(c).alias(f"_{c}") for c in asked.columns])
    differ = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"_p{i}"))) for i in range(1, PARITY)), F.bit_count(F.col("p0").bitwiseXOR(F.col("_p0"))))
    # Similarity of percent or more: 100 * (sum - d) >= percent * (sum + d) for a symmetric difference of d elements.
    able = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("_n"))
    pairs = asked.join(level, (F.col("_key") == F.col("key")) & (F.col("_step") == F.col("step")) & (F.col("_component") != F.col("component")) & close("_n", "n") & able)
    links = confirmed(pairs.select(F.least("_node", "node").alias("a"), F.greatest("_node", "node").alias("b")))
    merged = written(connected_components(links.unionByName(merged.toDF("a", "b"))), "groups")
    members = nodes.join(merged, "node", "left").select("f1", "f2", "first", F.coalesce("component", "node").alias("component"))
    named = members.groupBy("component").agg(F.min("first").alias("least"))
    named = members.drop("first").join(named, "component").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "least")
    out = sketches.join(named, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("least").isNull(), F.col("doc_id")).when(~F.col("least.no_id"), F.col("least.id"))
    return out.select("_row", "doc_id", "n_shingles", component.alias("component_id"), F.coalesce("least.row", "_row").alias("keeper"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable) and kept."""
    table = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "texts")
    out = _groups(table, "doc_id", "text", k, bands, rows, percent)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def distinct_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT
) -> DataFrame:
    """The rows of ``docs`` without the near copies of others: of each group one row stays, that with the least id."""
    table = numbered(docs, "texts")
    groups = _groups(table, id_col, text_col, k, bands, rows, percent)
    return visit_rows(table, groups.where("keeper <> _row").select("_row"), docs.columns, _others(to_arrow_schema(docs.schema)), docs.schema)
