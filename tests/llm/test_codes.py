"""SentencePiece tokens, vector codes and fill-in-middle against the library or brute force, and their edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.llm import infill, merge_tokens, queries, token_counts, vector_codes

MODEL = token_counts.tokenizer_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def table():
    return merge_tokens.PrefixTable(MODEL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank and very long texts, marks, special strings, repeated rows and null ids."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000)) + "y" * 300_000
    rows = [(0, "a b c d e f g"), (1, None), (2, ""), (3, " \n\t "), (None, "x y z"), (5, "same text twice "), (5, "same text twice "), (6, long), (7, "naïve ÉTÉ <s>x</s> 😀  x y\x00z"), (8, "has <S> in it"), (9, "  lead"), (10, "tail  \n")]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def stored(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# Merge-type tokens


def test_tokens_equal_the_library(table):
    rng = random.Random(1)
    chars = "abcdefghijklmnopqrstuvwxyz      ▁▁ABC.,;:!?\n\t0123456789éüßñ世界学語\U0001f600<>/\\\"'=-_#́​"
    pieces = list(table.names.values())
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(200))) for _ in range(500)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(1500)]
    texts += [" " * n + "a" for n in range(60)] + ["ab" * 5000, "=" * 3001, " " * 5000, "the" * 1000]
    for t in texts:
        assert table.encode(t) == table.sp.encode(t), t


def test_every_prefix_has_one_last_token(table):
    """What the table rests on: of the pieces that end at a prefix, exactly the library's last token is compatible."""
    for text in ("▁internationalisation", "▁▁▁▁indentation", "▁antidisestablishment==unlikely"):
        base = table.start[0]
        for n in range(1, len(text) + 1):
            tails = [i for i, name in table.names.items() if text[:n].endswith(name)]
            last = {0: base}
            for k in range(1, n):
                last[k] = table.ids(text[:k])[-1]
            fit = [i for i in tails if table.fits[last[n - len(table.names[i])] * base + i]]
            assert fit == [table.ids(text[:n])[-1]]


def test_tokens_of_odd_texts(spark, table, odd, tmp_path):
    got = queries.op11_prefix_table_tokens(spark, stored(odd, tmp_path, "documents")).collect()
    assert len(got) == 12
    seen = {(r["doc_id"], r["ids_sha256"]): r for r in got}
    for r in odd.collect():
        ids = table.sp.encode(r["text"] or "")
        own = seen[r["doc_id"], sha(",".join(map(str, ids)))]
        assert own["n_tokens"] == len(ids) and own["decoded_sha256"] == sha(table.sp.decode(ids) if ids else "")


def test_tokens_pass_columns_on_and_bound_their_words(spark, table, odd):
    out = merge_tokens.encode_texts(odd, MODEL, out_col="pieces", words=3)
    assert out.columns == [*odd.columns, "pieces"]
    for r in out.collect():
        assert r["pieces"] == table.sp.encode(r["text"] or "")
    with pytest.raises(ValueError):
        merge_tokens.encode_texts(odd, MODEL, out_col="lang")
    assert merge_tokens.decode_ids(out.limit(0), MODEL, "pieces").count() == 0
    nulls = spark.createDataFrame([(None,), ([],), (table.sp.encode("Hello"),)], "ids array<int>")
    assert [r["decoded"] for r in merge_tokens.decode_ids(nulls, MODEL).collect()] == ["", "", "Hello"]


def test_pairs_are_forgotten_without_harm(monkeypatch, table):
    monkeypatch.setattr(merge_tokens, "PAIRS", 5)
    small = merge_tokens.PrefixTable(MODEL)
    assert small.encode("forgetting pairs does no harm") == table.sp.encode("forgetting pairs does no harm") and len(small.fits) <= 5


# Vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(p, c[p])[0], []).append(c[p])
            books[p] = [[sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)] if e in groups else b for e, b in enumerate(books[p])]
    digest = sha(",".join(str(v) for part in books for e in part for v in e))
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for _, d in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for e, _ in f), err, labels[label], digest) for (i, _, label), f, err in zip(kept, found, errors, strict=True)), key=str)


def vectors(n, width, seed, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(9)]
    return [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice([None, 1, 1, 1, 2])) for i in range(n)]


@pytest.mark.parametrize(("n", "width"), [(300, 64), (120, 8), (5, 16), (90, 40)])
def test_codes_equal_brute_force(spark, tmp_path, n, width):
    rows = vectors(n, width, n)
    # Repeated rows, ties, equal and null ids, and rows that are dropped.
    rows += [rows[0], rows[0], (3, rows[1][1], 2), (None, rows[2][1], None), (-4, None, 1), (-3, [None] * width, 1), (-2, [math.nan] * width, 1), (-1, [math.inf] + [0.0] * (width - 1), 1)]
    df = spark.createDataFrame(rows, VECTORS)
    got = [tuple(r) for r in queries.op12_segment_mean_codes(spark, stored(df.repartition(3), tmp_path, "embeddings")).collect()]
    assert sorted(got, key=str) == brute_codes(rows)


def test_nearest_entry_is_never_filtered():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 7, 8, 32):
        for size in (3, 4000, 2**24 // width):
            x = rng.integers(-size, size, (500, width))
            entries = np.concatenate((x[:6], x[:3], x[6:10] + 1, rng.integers(-size, size, (3, width))))
            code, distance = vector_codes.nearest_entries(x, entries)
            whole = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
            assert (code == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


def test_vectors_that_do_not_fit_are_refused(spark):
    frame = lambda *rows: spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], VECTORS)
    for bad in (frame([1.0] * 8, [1.0] * 16), frame([1.0] * 9), frame([1e9] * 8)):
        with pytest.raises(Exception, match="one length|too large|made for"):
            vector_codes.compressed_vectors(bad.coalesce(1)).collect()
    none = frame().where("vec_id < 0")
    assert vector_codes.compressed_vectors(none).count() == 0
    assert vector_codes.compressed_vectors(frame(None, [math.nan] * 8)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.encode_vectors(none.withColumn("code", F.lit(1)), vector_codes.Codebooks([]))


def test_codes_pass_columns_on(spark):
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in vectors(40, 16, 7)], VECTORS + ", kept string")
    out = vector_codes.encode_vectors(df, vector_codes.fit_codebooks(df, parts=2, entries=4, rounds=2))
    assert out.columns == ["vec_id", "label", "kept", "code", "error"] and {len(r["code"]) for r in out.collect()} == {4}


# Fill-in-middle


def brute_infill(i, text, seed=42):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = sha(f"{seed}:{'' if i is None else i}")
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_equals_brute_force(spark, odd, tmp_path):
    rng = random.Random(2)
    more = [(i, "".join(rng.choice("ab \n\té😀<>PSM") for _ in range(rng.randrange(60))), "en", "s", 1) for i in range(100, 400)]
    df = odd.unionByName(spark.createDataFrame(more, DOCS))
    got = queries.op13_fill_in_middle(spark, stored(df.repartition(3), tmp_path, "documents")).collect()
    want = []
    for r in df.collect():
        n, form, p, m, out = brute_infill(r["doc_id"], r["text"] or "")
        want.append((r["doc_id"], n, form, p, m, sha(out), sha(r["text"] or "")))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_infill_passes_columns_on(spark, odd):
    out = infill.fill_in_middle(odd, seed=7, rate=100, spm_rate=0)
    assert out.columns[: len(odd.columns)] == odd.columns
    rows = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))["text"]).collect()
    assert all(r["back"] == (r["text"] or "") and r["form"] in ("plain", "psm") for r in rows) and any(r["form"] == "psm" for r in rows)
    assert infill.fill_in_middle(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(odd.withColumn("form", F.lit("x")))
