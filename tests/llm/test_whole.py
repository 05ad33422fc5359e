"""Whole results of the training-data queries and the pipeline's stages, on tables of a few rows."""

import collections
import random
import re

import pytest

import corpus_pipeline
from strataflow.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


def stored(spark, rows, folder):
    """A folder with the rows as its documents."""
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def brute_runs(rows, min_words):
    """Positions of lines in any run of min_words words that has an earlier copy; every match goes on to its end."""
    place = [(i, t.split("\n")) for i, t in sorted(rows)]
    gone = collections.defaultdict(set)
    for k, (i, lines) in enumerate(place):
        for _, earlier in place[: k + 1]:
            own = earlier is lines
            for a in range(len(lines)):
                for b in range(a if own else len(earlier)):
                    n = 0
                    while a + n < len(lines) and b + n < len(earlier) and lines[a + n] == earlier[b + n]:
                        n += 1
                    if n and sum(len(WORD.findall(x)) for x in lines[a : a + n]) >= min_words:
                        gone[i] |= set(range(a, a + n))
    return gone


@pytest.mark.parametrize("seed", range(2))
def test_line_runs_are_deleted_to_their_ends(spark, tmp_path, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"p{i}w{j}" for j in range(rng.choice((0, 0, 3, 8, 20, 60)))) for i in range(30)]
    rows = []
    for i in range(40):
        start = rng.randrange(20)
        rows.append((i, "\n".join([f"own {i} {rng.random()}", *pool[start : start + rng.randrange(1, 11)], *rng.sample(pool, 3)])))
    # A line of 60 and one of 20 words, a blank one before and after, and a copy inside one document.
    run = "\n".join(["", "x " * 60, "y " * 20, ""])
    rows += [(100, f"a\n{run}\nb"), (101, f"c\n{run}\nd\n{run}\ne")]
    gone = brute_runs(rows, 30)
    assert gone[101] == {1, 2, 3, 4, 6, 7, 8, 9}
    got = {r["doc_id"]: r for r in queries.op10_line_runs(spark, stored(spark, [(i, t, "en", "s") for i, t in rows], tmp_path)).collect()}
    for i, t in rows:
        assert (got[i]["n_deleted"], got[i]["kept_text"]) == (len(gone[i]), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])), i


def test_quality_rejects_prose_without_common_words(spark, tmp_path):
    rng = random.Random(5)
    common = quality.COMMON_WORDS["en"]
    rare = ["".join(rng.choice("aeinorstlhd") for _ in range(rng.randrange(3, 9))) for _ in range(4000)]
    rare = [w for w in rare if w not in common]

    def prose(n, share):
        """Common words spread evenly, so that every text has the share."""
        return " ".join(rng.choice(common) if int((i + 1) * share) > int(i * share) else rng.choice(rare) for i in range(n))

    rows = [(i, prose(rng.randrange(60, 400), 0.16), "en", "s") for i in range(200)]
    rows += [(1000 + i, " | ".join(rng.sample(rare, rng.randrange(60, 400))), "en", "s") for i in range(10)]
    rows += [(2000 + i, prose(rng.randrange(60, 400), 0), "en", "s") for i in range(10)]
    got = {r["doc_id"]: r["kept"] for r in queries.op1_quality_divergence(spark, stored(spark, rows, tmp_path)).collect()}
    assert all(got[i] for i in range(200)) and not any(got[i] for i in got if i >= 1000)


def test_mixture_gives_every_copy_a_position(spark, tmp_path):
    # All of source a is taken twice, and a part of source b once.
    rows = [(i, "w " * 50, "en", "a") for i in range(20)] + [(100 + i, "w " * 50, "en", "b") for i in range(200)]
    got = queries.op8_curriculum_mixture(spark, stored(spark, rows + [(999, "", "en", "a")], tmp_path)).collect()
    assert len(got) == 221
    a = [r for r in got if r["source"] == "a" and r["size"]]
    assert all(r["taken"] == 100 for r in a)

    # Source a fades from 1.5 to 0.5: by t it has demanded 1.5 t - t^2 / 2 of its words.
    demand = sorted(1.5 * t - t * t / 2 for r in a for t in (r["position"], r["position_2"]))
    assert demand == pytest.approx([(k + 0.5) / 40 for k in range(40)], abs=1e-6)
    assert all((r["position"] is None) == (r["taken"] == 0) and (r["position_2"] is None) == (r["taken"] <= r["size"]) for r in got)
    taken = [r["position"] for r in got if r["taken"]]
    assert taken == sorted(taken) and [r["doc_id"] for r in got if r["position"] is None][-1] == 999


def test_windows_follow_the_curriculum(spark):
    rows = [(1000 * k + i, f"word{i} " * rng, "en", s) for k, s in enumerate("abc") for i, rng in enumerate([100] * 150 + [900] * 2)]
    mixed = corpus_pipeline.by_mixture(spark, docs(spark, rows), "").collect()
    order = [r["position"] for r in mixed]
    assert order == sorted(order) and len(set(order)) > 300
    frame = spark.createDataFrame(mixed).repartition(3)
    pieces = corpus_pipeline.by_packing(spark, frame, "").collect()
    assert sum(r["length"] for r in pieces if r["start"] + r["length"] == r["doc_tokens"]) > 0
    half = max(r["sequence_id"] for r in pieces) / 2
    share = [collections.Counter(), collections.Counter()]
    for r in pieces:
        share[r["sequence_id"] > half]["abc"[r["doc_id"] // 1000]] += r["length"]
    early, late = ({k: n / sum(c.values()) for k, n in c.items()} for c in share)
    # The first source fades, the third rises.
    assert early["a"] - late["a"] > 0.08 and late["c"] - early["c"] > 0.04, (early, late)
    # A document's copies lie in the windows at their positions.
    when = collections.defaultdict(list)
    for r in pieces:
        if r["start"] == 0:
            when[r["doc_id"]].append(r["sequence_id"] / (2 * half))
    once = [r for r in mixed if len(when[r["doc_id"]]) == 1]
    ranks = sorted(once, key=lambda r: when[r["doc_id"]][0])
    assert len(once) > 10 and sum(abs(i - j) for i, j in enumerate(sorted(range(len(ranks)), key=lambda i: ranks[i]["position"]))) < len(ranks) ** 2 / 10
