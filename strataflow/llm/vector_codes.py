"""Vector codes: vectors cut into parts, each part replaced by the number of the nearest entry of its position's codebook.

Components become integers, so distances, sums and means are exact and every run gives the same codes.  Each round is one pass:
tasks assign the parts of their vectors and hand on one sum per part, entry and place, and only codebooks (parts x entries x
places) reach the driver.  A last pass assigns all parts again.

Assignment filters entries by lower bounds, from coarse to fine: a part is cut into 1, 2, 4, ... blocks, and for each block the
difference of the means and that of the norms of what the means leave (the residuals) bound the distance from below:

    |x - c|^2  >=  sum over blocks of  len (mean x - mean c)^2 + (|residual x| - |residual c|)^2

The entry with the least coarse bound gives a first exact distance; entries whose bound, less an allowance for rounding, is
above it are dropped, and only survivors reach the next level and at last exact integer distances.  An entry that is nearest,
or as near, is never dropped.

Edge cases: rows whose vector is null or holds null, NaN or infinite components are dropped; kept vectors must have one length
that the parts divide, and components small enough for exact 64-bit sums, else the job fails with a message; fewer kept vectors
than entries give smaller codebooks; equal ids are put in order by their vectors, null ids come last; repeated rows are coded
alike and count as often as they stand there; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from strataflow.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that one step of an assignment works on.
STEP = 4096
#: A row of label sums is repeated this often, so that a label with a third of all rows is met in this many places.
SALTS = 16


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][entry][place]``; no parts where no vector was kept."""

    entries: list[list[list[int]]]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for entry in part for v in entry).encode()).hexdigest()

    @property
    def width(self) -> int:
        return len(self.entries[0][0]) if self.entries else 0


def _kept(batch: pa.RecordBatch, column: str, scale: int, parts: int):
    """(numbers of the kept rows, their integer components as a matrix of rows x components)."""
    import numpy as np
    import pyarrow.compute as pc

    col = batch.column(column).cast(pa.list_(pa.float64()))
    size = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    owner = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    bad = size < 0
    bad[owner[~np.isfinite(values)]] = True
    rows = np.flatnonzero(~bad)
    if not len(rows):
        return rows, np.zeros((0, 0), np.int64)
    width = int(size[rows[0]])
    if (size[rows] != width).any() or width % parts or not width:
        raise ValueError(f"vectors must have one length that {parts} parts divide; found {sorted(set(size[rows].tolist()))[:3]}")
    whole = np.floor(values[~bad[owner]] * scale)
    # Squares of sums over a part, and errors over a vector, must fit 62 bits.
    if np.abs(whole).max() > 2**30 / width:
        raise ValueError("components are too large for exact sums")
    return rows, whole.astype(np.int64).reshape(len(rows), width)


def _blocks(x, count: int):
    """Per row and block: the sum, the block's length, and the norm of what the mean leaves, exact under the root."""
    import numpy as np

    edges = np.linspace(0, x.shape[1], count + 1).astype(int)
    length = np.diff(edges)
    total = np.add.reduceat(x, edges[:-1], axis=1)
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    return total.astype(np.float64), length, np.sqrt((length * square - total * total).astype(np.float64) / length)


def nearest_entries(x, entries):
    """(number of the nearest entry, squared distance) of every row of ``x``; of entries as near, the first."""
    import numpy as np

    n, width = x.shape
    energy = (x * x).sum(axis=1)[:, None] + (entries * entries).sum(axis=1)[None, :]
    # Rounding of a bound is far below this part of the two squared norms.
    allowance = 1e-11 * energy + 1e-6

    def exact(i, j):
        d = x[i] - entries[j]
        return np.einsum("ij,ij->i", d, d)

    level, best, i, j = 1, None, None, None
    while True:
        sx, length, rx = _blocks(x, level)
        se, _, re = _blocks(entries, level)
        if best is None:
            bound = sum((sx[:, b, None] - se[None, :, b]) ** 2 / length[b] + (rx[:, b, None] - re[None, :, b]) ** 2 for b in range(level))
            best = exact(np.arange(n), bound.argmin(axis=1))
            i, j = np.nonzero(bound - allowance <= best[:, None])
        else:
            bound = ((sx[i] - se[j]) ** 2 / length + (rx[i] - re[j]) ** 2).sum(axis=1)
            stay = bound - allowance[i, j] <= best[i]
            i, j = i[stay], j[stay]
        level *= 2
        if level >= width or len(i) == n:
            break
    distance = np.full((n, len(entries)), np.iinfo(np.int64).max)
    distance[i, j] = exact(i, j)
    chosen = distance.argmin(axis=1)
    return chosen, distance[np.arange(n), chosen]


def _assigned(x, books: list):
    """(entry numbers, squared distances), both rows x parts."""
    import numpy as np

    width = x.shape[1] // len(books)
    if width != books[0].shape[1]:
        raise ValueError(f"vectors have {x.shape[1]} components, the codebooks were made for {len(books) * books[0].shape[1]}")
    found = [nearest_entries(np.ascontiguousarray(x[:, p * width : (p + 1) * width]), book) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            yield batch.slice(start, STEP)


def _first_vectors(vectors: DataFrame, id_col: str, vector_col: str, parts: int, entries: int, scale: int) -> list[list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            rows, x = _kept(batch, vector_col, scale, parts)
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(rows)), pa.array(list(x), pa.list_(pa.int64()))], names=["id", "vector"])

    kept = vectors.select(F.col(id_col).cast("long").alias("_id"), vector_col).mapInArrow(run, "id long, vector array<long>")
    return [r["vector"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()]


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks that begin as the parts of the first vectors and move to their parts' means, rounded down, in every round."""
    first = _first_vectors(vectors, id_col, vector_col, parts, entries, scale)
    if not first:
        return Codebooks([])
    width = len(first[0]) // parts
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]

    def sums(books: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            own = [np.array(b, np.int64) for b in books]
            k = len(own[0])
            total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
            for batch in _steps(batches):
                rows, x = _kept(batch, vector_col, scale, parts)
                if len(rows):
                    codes, _ = _assigned(x, own)
                    for p in range(parts):
                        np.add.at(total[p], codes[:, p], x[:, p * width : (p + 1) * width])
                        count[p] += np.bincount(codes[:, p], minlength=k)
            p, e, at = np.indices(total.shape).reshape(3, -1)
            used = count[p, e] > 0
            columns = [p[used], e[used], at[used], total.reshape(-1)[used], count[p, e][used]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "place", "total", "n"])

        found = vectors.select(vector_col).mapInArrow(run, "part long, entry long, place long, total long, n long")
        return found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))

    for _ in range(rounds):
        moved = [[list(e) for e in part] for part in books]
        for r in sums(books).collect():  # parts x entries x places rows
            moved[r["part"]][r["entry"]][r["place"]] = r["total"] // r["n"]
        books = moved
    return Codebooks(books)


def encode_vectors(vectors: DataFrame, codebooks: Codebooks, vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The other columns of the kept rows, ``code`` (two hex digits a part) and ``error`` (squared distances over all parts)."""
    names = [c for c in vectors.columns if c != vector_col]
    if clash := {"code", "error"} & set(names):
        raise ValueError(f"columns of the result's names: {sorted(clash)}")
    if codebooks.entries and len(codebooks.entries[0]) > 256:
        raise ValueError("two hex digits number 256 entries")
    schema = StructType([vectors.schema[c] for c in names]).add("code", StringType()).add("error", LongType())
    books = codebooks.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = [np.array(b, np.int64) for b in books]
        for batch in _steps(batches):
            rows, x = _kept(batch, vector_col, scale, max(1, len(own)))
            if not len(rows):
                continue
            codes, distance = _assigned(x, own)
            text = [c.tobytes().hex() for c in codes.astype(np.uint8)]
            columns = [batch.column(c).take(pa.array(rows)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(text, pa.string()), pa.array(distance.sum(axis=1))], names=[*names, "code", "error"])

    return vectors.mapInArrow(run, schema)


def compressed_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    rows = vectors.select("vec_id", "label", "embedding")
    books = fit_codebooks(rows)
    coded = written(encode_vectors(rows, books), "vector-codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("label", "of")
    salted = coded.withColumn("own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The query's rows in DuckDB's SQL: all distances of all entries in every round."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r FROM kept)",
        f"flat AS MATERIALIZED (SELECT r, unnest(range(len(v))) // (len(v) // {parts}) AS part, unnest(range(len(v))) % (len(v) // {parts}) AS place, unnest(v) AS x FROM numbered)",
        f"book0 AS MATERIALIZED (SELECT part, r AS entry, place, x AS c FROM flat WHERE r < {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT r, part, entry, sum((x - c) * (x - c)) AS d FROM flat JOIN book{k} USING (part, place) GROUP BY ALL)")
        steps.append(f"best{k} AS MATERIALIZED (SELECT r, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM near{k} GROUP BY ALL)")
        if k < rounds:
            steps.append(f"sums{k} AS MATERIALIZED (SELECT part, entry, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM flat JOIN best{k} USING (r, part) GROUP BY ALL)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT part, entry, place, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM book{k} LEFT JOIN sums{k} USING (part, entry, place))")
    steps.append(f"coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM best{rounds} GROUP BY r)")
    steps.append(f"digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM numbered JOIN coded USING (r), digest"
