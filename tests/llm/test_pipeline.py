"""The pipeline's stages and the whole of it against brute-force versions; nulls, repeated ids, empty tables, clashing columns."""

import collections
import hashlib
import random
import re

import pytest

import corpus_pipeline
from strataflow.llm import mixing, packing, quality
from strataflow.llm.token_counts import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


def prose(rng, n):
    common = quality.COMMON_WORDS["en"]
    return " ".join(rng.choice(common) if rng.random() < 0.3 else "w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    """Groups of row numbers by similarity of the shingle sets."""
    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    out = collections.defaultdict(list)
    for i in range(len(rows)):
        out[root(i)].append(i)
    return list(out.values())


def odd_rows(seed=4):
    """Clean texts, near and exact copies, repeated and null ids, and junk under a good document's id."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(40, 160)), "en", rng.choice("ab")) for i in range(30)]
    base = rows[3][1].split()
    near = [" ".join([*base[:20], f"x{k}", *base[21:]]) for k in range(3)]
    rows += [(3, near[0], "en", "a"), (None, near[1], "en", "b"), (700, near[2], "en", None), (None, rows[5][1], "en", "a"), (5, rows[5][1], "en", "a")]
    rows += [(None, prose(rng, 80), None, None), (None, prose(rng, 90), "en", "a"), (7, "too short", "en", "a"), (7, "a b c d e f g h " * 20, "en", "b"), (8, None, "en", "a"), (None, "", None, "b"), (9, " \n ", "en", None)]
    return rows


@pytest.fixture(scope="module")
def stages():
    return dict(corpus_pipeline.STAGES)


def test_quality_judges_rows_not_ids(spark, stages):
    rows = odd_rows()
    got = collections.Counter((r["doc_id"], r["text"]) for r in stages["by_quality"](spark, docs(spark, rows).withColumnRenamed("n_chars", "n_chars"), "").collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        spans = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if spans[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        if len(w) >= 20 and 100 * len(hit) <= 30 * len(w):
            want[(i, t)] += 1
    assert got == want and got[(7, rows[7][1])] == 1 and sum(i is None for i, _ in got) == 4


def test_near_copies_keep_one_row_of_each_group(spark, stages):
    rows = odd_rows()
    got = stages["by_near_copies"](spark, docs(spark, rows).repartition(3), "").collect()
    left = collections.Counter((r["doc_id"], r["text"]) for r in got)
    for group in groups(rows):
        own = [(rows[i][0], rows[i][1]) for i in group]
        kept = [k for k in left.elements() if k in own]
        assert len(kept) == (len(own) if not shingles(own[0][1]) else 1), own
        if shingles(own[0][1]) and any(i is not None for i, _ in own):
            assert kept[0][0] == min(i for i, _ in own if i is not None)
    assert sum(left.values()) == sum(len(g) if not shingles(rows[g[0]][1]) else 1 for g in groups(rows))
    assert {(r["doc_id"], r["source"], r["n_chars"]) for r in got} <= {(i, s, None if t is None else len(t)) for i, t, _, s in rows}


def test_lines_keep_rows_without_repeats(spark, stages):
    rows = odd_rows()
    got = stages["by_lines"](spark, docs(spark, rows), "").collect()
    texts = collections.Counter((r["doc_id"], r["text"]) for r in got)
    # Only the exact copy of another row's line goes; rows equal in id and text are one document.
    gone = collections.Counter((i, t) for i, t, *_ in rows) - texts
    assert gone == {(None, rows[5][1]): 1}
    assert (8, None) in texts and (None, "") in texts


def brute_mixture(rows, targets):
    """(row number, words, position) of every copy."""
    out, by = [], collections.defaultdict(list)
    for k, (i, t, _, s) in enumerate(rows):
        by[s].append((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i is None, i or 0, len(WORD.findall(t or "")), k))
    for rank, s in enumerate(sorted((s for s in by if s is not None)) + [None] * (None in by)):
        knots = mixing.SCHEDULES[rank % 3]
        size, before = sum(x[3] for x in by[s]), 0
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))

        def at(share, knots=knots, whole=whole):
            lo, hi = 0.0, 1.0
            for _ in range(60):
                mid, area = (lo + hi) / 2, 0.0
                for (t0, h0), (t1, h1) in zip(knots, knots[1:], strict=False):
                    end = min(max(mid, t0), t1)
                    area += (end - t0) * (h0 + h0 + (h1 - h0) * (end - t0) / (t1 - t0)) / 2
                lo, hi = (mid, hi) if area < share * whole else (lo, mid)
            return lo

        goal = int(targets[s])
        for *_, n, k in sorted(by[s]):
            for p in range(2):
                words = max(min(goal - p * size - before, n), 0)
                if words:
                    out.append((k, words, at((before + p * size + words / 2) / targets[s])))
            before += n
    return out


def test_mixture_against_brute_force(spark, stages):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en", rng.choice("aaaaaaabc")) for i in range(120)] + [(200, None, "en", "a"), (None, prose(rng, 12), None, None), (201, "", "en", "d")]
    targets = {r["source"]: r["target"] for r in mixing.schedule(docs(spark, rows)).select("source", "target").distinct().collect()}
    want = brute_mixture(rows, targets)
    got = stages["by_mixture"](spark, docs(spark, rows).repartition(3), "").collect()
    assert len(got) == len(want) and [r["position"] for r in got] == sorted(r["position"] for r in got)
    texts = {k: WORD.findall(rows[k][1]) for k, *_ in want}
    expected = sorted((p, " ".join(texts[k][:n]), str(rows[k][0])) for k, n, p in want)
    ours = sorted((r["position"], " ".join(WORD.findall(r["text"])), str(r["doc_id"])) for r in got)
    assert [x[1:] for x in ours] == [x[1:] for x in expected]
    assert [x[0] for x in ours] == pytest.approx([x[0] for x in expected], abs=1e-6)


def test_every_stage_takes_an_empty_table(spark, stages):
    for name, stage in stages.items():
        frame = docs(spark, [])
        if name == "by_packing":
            frame = frame.selectExpr("*", "CAST(0.5 AS DOUBLE) AS position")
        assert stage(spark, frame, "").count() == 0, name


def test_windows_hold_the_weights_until_queues_run_dry(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(20, 120)), "en", "abc"[i % 3]) for i in range(450)]
    weights = {"a": 6.0, "b": 3.0, "c": 1.0}
    pieces = packing.pack(docs(spark, rows).repartition(4), tokenizer_path("byte_bpe_50k.json"), weights=weights).collect()
    sent = collections.defaultdict(collections.Counter)
    for r in pieces:
        sent[r["sequence_id"]]["abc"[r["doc_id"] % 3]] += r["length"]
    total = collections.Counter()
    for c in sent.values():
        total.update(c)
    last = max(sent)
    assert all(sum(sent[k].values()) == 1024 for k in range(last)) and set(sent) == set(range(last + 1))
    dry = {k: max(i for i in sent if sent[i][k]) for k in "abc"}
    assert dry["a"] < dry["b"] < dry["c"] == last
    done = collections.Counter()
    for i in range(last + 1):
        done.update(sent[i])
        if i < dry["a"] - 1:  # credits that don't cover a grain are carried on, so sums stay within a grain or two
            for k, w in weights.items():
                assert abs(done[k] - 1024 * (i + 1) * w / 10) <= 600, (i, k)
        elif dry["a"] < i < dry["b"] - 1:
            left = 1024 * (i + 1) - total["a"]
            assert abs(done["b"] - left * 0.75) <= 900, i


def test_run_leaves_one_table_and_keeps_clean_documents(spark, tmp_path):
    from pathlib import Path

    from strataflow.llm.common import scratch_root

    rng = random.Random(6)
    rows = [(i, "\n".join(prose(rng, 40) for _ in range(3)), "en", "ab"[i % 2]) for i in range(60)]
    # A near copy that has a word of its own in each line, so that no line repeats.
    near = "\n".join(x + " one" for x in rows[0][1].split("\n"))
    copies = [(100, near, "en", "a"), (101, rows[1][1], "en", "b"), (102, "no no no", "en", "a"), (None, "\n".join(prose(rng, 40) for _ in range(3)), "en", "a")]
    docs(spark, rows + copies).write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(scratch_root(spark).removeprefix("file://"))
    before = set(folder.glob("*/*"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(set(folder.glob("*/*")) - before) == 1
    # Every clean document, also the one without an id, is packed once or twice; copies and junk are gone.
    ids = {r["doc_id"] for r in pieces}
    assert ids == {*range(60), None}
    whole = collections.defaultdict(list)
    for r in pieces:
        whole[(r["sequence_id"], r["offset"])].append(r["length"])
    assert all(len(v) == 1 for v in whole.values())
    assert sum(r["length"] for r in pieces if r["sequence_id"] == 0) == 1024
