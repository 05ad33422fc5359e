"""Edge cases of every operator on tables of a few rows: nulls, empty and repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strataflow.llm import components, langid, license_scan, line_dedup, media, minhash, mixing, packing, quality, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean"
PROSE = "the cat of the house and the dog in that garden is to it for on "


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, False) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(0, "a b c d e f g", "en", "s"), (1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "fr", None), (None, "x y z", None, "t"), (5, "a b c d e f g", "en", "s"), (5, "a b c d e f g", "en", "s"), (6, long, "en", "t"), (7, "naïve ÉTÉ <|endoftext|> 😀  x", "fr", "s")]
    return docs(spark, rows)


def empty(spark):
    return docs(spark, [])


def base_counts(text):
    words = WORD.findall(text or "")
    spans = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if spans[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, odd):
    repeated = docs(spark, [(20, "\n".join([PROSE * 3] * 3), "en", "s"), (21, "a b c d e f g h i " * 2 + "z", "en", "s"), (22, PROSE * 8, "en", "s"), (23, "#$%& " * 200 + PROSE * 2, "en", "s")])
    every = odd.unionByName(repeated)
    got = quality.quality_verdicts(every).collect()
    assert len(got) == every.count()
    for r, t in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_words"])), sorted(every.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"])), strict=True):
        n = base_counts(t["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n, t["doc_id"]
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_verdicts(empty(spark)).count() == 0


def test_quality_rejects_what_no_language_has(spark):
    import random

    rng = random.Random(3)
    words = quality.COMMON_WORDS["en"] + ["house", "garden", "window", "yellow"]
    clean = [(i, " ".join(rng.choice(words) for _ in range(200)), "en", "s") for i in range(20)]
    junk = [(100 + i, " ".join(f"{rng.choice(words)}{rng.choice('#$%&*')}{rng.randrange(10**6)}" for _ in range(200)), "en", "s") for i in range(5)]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(docs(spark, clean + junk)).collect()}
    assert all(kept[i] for i, *_ in clean) and not any(kept[i] for i, *_ in junk)


def test_quality_judges_a_text_alike_in_any_case(spark):
    import random

    rng = random.Random(7)
    own = {"en": quality.COMMON_WORDS["en"], "da": ["og", "i", "at", "det", "en", "den", "til", "er", "som", "på"]}
    rest = ["house", "garden", "window", "yellow", "river", "ærlig", "åben"]
    # Every word, common or not, with punctuation around it now and then.
    word = lambda k: rng.choice(own[k] if rng.random() < 0.4 else rest)
    text = lambda k: " ".join(rng.choice(["{}", "{}", "{}", "{},", "({})", "“{}”", "{}."]).format(word(k)) for _ in range(rng.randrange(70, 300)))
    rows = [(i, text(k), k, "s") for i, k in enumerate(["en", "da"] * 40)]
    forms = [(1000 * (j + 1) + i, f(t), k, "s") for i, t, k, _ in rows[:10] for j, f in enumerate((str.title, str.upper))]
    junk = [(9000 + i, "".join(rng.choice("QXZVWK0#$ ") for _ in range(900)), "en", "s") for i in range(5)]
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs(spark, rows + forms + junk)).collect()}
    for i in range(10):
        for j in (1000, 2000):
            assert got[j + i]["kept"] and got[i]["kept"]
            assert got[j + i]["word_distance"] == got[i]["word_distance"] and got[j + i]["char_distance"] == got[i]["char_distance"], (j, i)
    assert not any(got[9000 + i]["kept"] for i in range(5))


def js(p, q):
    import math

    half = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    part = lambda x: sum(a * math.log2(a / h) for a, h in zip(x, half, strict=True) if a > 0)
    return math.sqrt(max((part(p) + part(q)) / 2, 0.0))


def test_quality_distances_against_brute_force(spark):
    """Three languages, one of them without a fixed list of words, and one with too few documents for a reference."""
    import random

    rng = random.Random(11)
    own = {"en": quality.COMMON_WORDS["en"], "ru": ["и", "в", "не", "на", "что", "он", "как", "это", "но", "по"]}
    rest = {"en": ["house", "garden", "window", "yellow", "river"], "ru": ["дом", "окно", "сад", "река", "улица"]}
    text = lambda k: " ".join(rng.choice(own[k] if rng.random() < 0.4 else rest[k]) for _ in range(rng.randrange(30, 200)))
    rows = [(i, text(k), k, "s") for i, k in enumerate(["en", "ru"] * 40)]
    rows += [(500, "語 " * 300, "zh", "s"), (501, "# $ % " * 100 + text("en"), "en", "s"), (502, text("ru"), None, "s"), (503, text("en"), "ru", "s"), (504, "42 17 99 " * 1 + " ".join(str(rng.randrange(10**9)) for _ in range(90)), "ru", "s")]
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs(spark, rows)).collect()}
    words = {k: collections.Counter(w for _, t, lang, _ in rows if lang == k for w in WORD.findall(t)) for k in ("en", "ru")}
    learned = sorted(words["ru"], key=lambda w: (-words["ru"][w], w))[:10]
    vocabulary = sorted({*quality.COMMON_WORDS["en"], *learned})

    def counts(t):
        n = [0] * 7
        for c in t:
            n[0 if "a" <= c <= "z" else 1 if c in "\t\n\x0b\x0c\r " else 2 if "A" <= c <= "Z" else 3 if c.isalpha() else 4 if "0" <= c <= "9" else 5 if c in ".,;:!?'\"()-" else 6] += 1
        w = collections.Counter(WORD.findall(t))
        return n, [w[x] for x in vocabulary] + [sum(w.values()) - sum(w[x] for x in vocabulary)]

    shares = lambda n: [x / sum(n) for x in n]
    total = {}
    for i, t, lang, _ in rows:
        base, (c, w) = base_counts(t), counts(t)
        if lang in own and not got[i]["base_failed"] and 100 * base[2] <= len(t) and 5 * c[2] <= c[0] and base[0] >= 60:
            for k, x in enumerate((c, w)):
                held = total.setdefault(lang, [[0] * 7, [0] * (len(vocabulary) + 1)])[k]
                held[:] = [a + b for a, b in zip(held, x, strict=True)]
    for i, t, lang, _ in rows:
        c, w = counts(t)
        near = [min(js(shares(x), shares(total[k][j])) for k in total) for j, x in ((0, c), (1, w))]
        assert got[i]["char_distance"] == (pytest.approx(near[0], abs=2e-6) if len(t) >= 200 else None), i
        assert got[i]["word_distance"] == (pytest.approx(near[1], abs=2e-6) if sum(w) >= 60 else None), i
    kept = {i: r["kept"] for i, r in got.items()}
    # A language without a reference passes, also where its letters are like nothing else; so does a text of another language.
    assert kept[502] and kept[503] and not kept[501] and not kept[504]
    assert kept[500] == (not got[500]["base_failed"]) and sum(kept[i] for i in range(80)) > 70


def test_media_round_trip_and_retries(spark, odd, tmp_path):
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["error"]) for r in media.media_column(odd).collect())
    want = collections.Counter()
    for r in odd.collect():
        b = (r["text"] or "").encode()
        p = media.padded(b)
        want[(r["doc_id"], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), None)] += 1
    assert got == want
    assert media.media_column(empty(spark)).count() == 0


def test_damaged_media_become_rows_with_errors(spark, tmp_path):
    import zipfile

    folder = f"file://{tmp_path}/broken"
    media.write_media(docs(spark, [(i, f"text {i} " * 50, "en", "s") for i in range(20)]).coalesce(1), folder)
    archive = next((tmp_path / "broken").glob("*.zip"))
    # What a lost attempt leaves behind does not count.
    (tmp_path / "broken" / "part-000000-lost-0000.zip").write_bytes(archive.read_bytes())
    data = bytearray(archive.read_bytes())
    second = data.index(b"PK\x03\x04", 4)
    data[second : second + 4] = b"????"
    entry = data.index(b"PK\x01\x02")
    data[entry + 16] ^= 1  # the CRC-32 of the first member
    archive.write_bytes(bytes(data))
    rows = media.media_features(media.read_media(spark, folder, rangebytes=200, retries=1, retrywait=0)).collect()
    assert len(rows) == 20 and {r["doc_id"] for r in rows if r["error"]} == {0, 1}
    assert media.read_media(spark, folder, rangebytes=200, retries=0).rdd.getNumPartitions() > 1
    # Archives from elsewhere: bad WAV data, a name of another kind, and no archive at all.
    other = tmp_path / "other"
    other.mkdir()
    with zipfile.ZipFile(other / "a.zip", "w") as z:
        z.writestr("7/0-64.wav", b"RIFF, but no more")
        z.writestr("sound.wav", media.to_wav(b"y" * 64))
        z.writestr("folder/", b"")
    (other / "b.zip").write_bytes(b"nothing")
    got = {(r["doc_id"], r["n_bytes"], r["error"] is None) for r in media.media_features(media.read_media(spark, f"file://{other}", retries=0)).collect()}
    assert got == {(7, None, False), (None, 64, True), (None, None, False)}


def test_warc(spark):
    big, other = "<p>" + "x" * 200, "<p>" + "y" * 200
    rows = [(5, "u5", big), (2, "u2", big), (3, None, other), (4, "u\r\n4", None), (6, "u6", ""), (7, "u7", "short"), (8, "u8", "short"), (None, "u", big), (9, "u9", "y\r\n\r\n" * 40), (2, "u2", big), (None, "n", "z" * 150), (None, "n", "z" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit(1)).withColumn("record_type", F.lit("x"))
    got = warc.deduplicated_pages(pages.repartition(3)).collect()
    assert len(got) == len(rows)
    digest = {t: hashlib.sha256((t or "").encode()).hexdigest() for *_, t in rows}
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == collections.Counter((i, len(t or ""), digest[t]) for i, _, t in rows)
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == digest[big])
    assert kinds == {(2, "response", None): 1, (2, "revisit", 2): 1, (5, "revisit", 2): 1, (None, "revisit", 2): 1}
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < 100 or r["payload_digest"] == digest["z" * 150])
    assert warc.deduplicated_pages(pages.limit(0)).count() == 0


def test_warc_records_are_valid_and_old_revisits_are_resolved(spark, tmp_path):
    import gzip

    big, small = "<p>" + "x" * 200, "<p>"
    rows = [(2, "http://a", big), (5, "http://b", big), (3, "http://c", small), (9, "http://d", "<p>" + "z" * 300)]
    folders = [f"file://{tmp_path}/{k}" for k in "abc"]
    for k in "abc":
        (tmp_path / k).mkdir()
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folders[0], date="2024-05-06T07:08:09Z")
    # Archives from elsewhere: a revisit of the small page, and one of a payload that no archive holds.
    digest = hashlib.sha256(small.encode()).hexdigest()
    old = [("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", "http://e"), ("WARC-Refers-To", "<urn:uuid:0>")]
    (tmp_path / "a" / "old.warc.gz").write_bytes(warc._record("warcinfo", [("WARC-Record-ID", "<urn:uuid:7>")], b"software: x\r\n") + warc._record("revisit", [*old, ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Row-Id", "1")], b"") + warc._record("revisit", [*old, ("WARC-Payload-Digest", "sha256:00"), ("X-Row-Id", "8")], b""))
    results = []
    for source, target in zip(folders, folders[1:]):
        assert warc.write_deduplicated(spark, source, warc.resolve_revisits(warc.read_archives(spark, source)).cache(), target) == 7
        results.append({(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.described(warc.read_archives(spark, target)).collect()})
    # A second pass over its own archives changes nothing.
    assert results[0] == results[1] == {(2, 203, "response", None), (5, 203, "revisit", 2), (3, 3, "response", None), (9, 303, "response", None), (1, 3, "revisit", 3), (8, None, "revisit", None)}
    text = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "c").glob("*.warc.gz"))).decode()
    records = [dict(x.split(": ", 1) for x in head.split("\r\n")[1:] if ": " in x) for head in re.findall(r"WARC/1\.1\r\n.*?\r\n\r\n", text, re.S)]
    names = {r["WARC-Record-ID"]: r for r in records if r.get("WARC-Type") == "response"}
    revisit = next(r for r in records if r.get("X-Row-Id") == "5")
    assert names[revisit["WARC-Refers-To"]]["X-Row-Id"] == "2" and revisit["WARC-Refers-To-Target-URI"] == "http://a" and revisit["WARC-Refers-To-Date"] == "2024-05-06T07:08:09Z"
    assert all(r["WARC-Date"] == "2024-05-06T07:08:09Z" and r["Content-Type"].startswith("application/http") for r in names.values()) and len(names) == 3


def test_warc_archives_from_elsewhere(spark, tmp_path):
    import base64
    import gzip

    for k in "abc":
        (tmp_path / k).mkdir()
    folders = [f"file://{tmp_path}/{k}" for k in "abc"]
    big, other = b"<p>" + b"x" * 200, b"<p>" + b"y" * 200
    sha1 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()

    def record(kind, number, block=b"", **more):
        headers = [("WARC-Record-ID", f"<urn:uuid:{number}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", f"http://e/{number}")]
        return warc._record(kind, [*headers, *((k.replace("_", "-"), v) for k, v in more.items())], block)

    def response(number, payload, **more):
        return record("response", number, warc._http(payload), Content_Type=warc.HTTP, X_Row_Id=str(number), **more)

    reply = b"HTTP/1.1 304 Not Modified\r\n\r\n"
    parts = [
        record("warcinfo", 1, b"software: x\r\n"),
        response(2, big, WARC_Payload_Digest="sha1:ABC", WARC_Warcinfo_ID="<urn:uuid:1>"),
        record("request", 3, b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<urn:uuid:2>"),
        # By the record that it names; by its label alone; by a digest that no response's header says; by none.
        record("revisit", 4, reply, WARC_Refers_To="<urn:uuid:2>", X_Row_Id="4", Content_Type=warc.HTTP, WARC_Payload_Digest="sha1:ABC"),
        record("revisit", 5, WARC_Payload_Digest="sha1:ABC", X_Row_Id="5"),
        record("revisit", 6, WARC_Payload_Digest=sha1(other), X_Row_Id="6"),
        record("revisit", 7, WARC_Payload_Digest=sha1(b"else"), WARC_Refers_To="<urn:uuid:99>", X_Row_Id="7"),
        response(8, other),
        response(9, big, WARC_Payload_Digest=sha1(big)),
    ]
    (tmp_path / "a" / "one.warc.gz").write_bytes(b"".join(parts))
    # A damaged member, a sound one, bytes that are no member, one without a length, and one that is cut short.
    broken = bytearray(response(10, b"q" * 5000))
    broken[40:60] = b"\xff" * 20
    (tmp_path / "a" / "two.warc.gz").write_bytes(bytes(broken) + response(11, other) + b"noise" + gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n") + response(12, b"w") + response(13, big)[:-30])
    (tmp_path / "a" / "empty.warc.gz").write_bytes(b"")
    results = []
    for source, target, damaged in zip(folders, folders[1:], (3, 0), strict=False):
        headers = warc.read_archives(spark, source).cache()
        assert headers.where("record_type = 'damaged'").count() == damaged
        assert warc.write_deduplicated(spark, source, warc.resolve_revisits(headers).cache(), target) == 11
        results.append({(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.described(warc.read_archives(spark, target)).collect()})
    x, y, w = (hashlib.sha256(t).hexdigest() for t in (big, other, b"w"))
    assert results[0] == results[1] == {
        (2, 203, x, "response", None), (4, 203, x, "revisit", 2), (5, 203, x, "revisit", 2), (9, 203, x, "revisit", 2), (6, 203, y, "revisit", 8),
        (7, None, None, "revisit", None), (8, 203, y, "response", None), (11, 203, y, "revisit", 8), (12, 1, w, "response", None),
    }
    found = {}
    for f in sorted((tmp_path / "b").glob("*.warc.gz")):
        with open(f, "rb", buffering=0) as raw:
            found |= {dict(fields)["warc-record-id"]: (dict(fields), block) for _, fields, block in warc._records(raw)}
    # Every record has a fresh id, and what named a record of the archives names its new one.
    assert len(found) == 11 and not any(re.fullmatch(r"<urn:uuid:\d+>", i) for i in found)
    kinds = {h["warc-type"] + h.get("x-row-id", ""): (i, h, block) for i, (h, block) in found.items()}
    assert kinds["request"][1]["warc-concurrent-to"] == kinds["response2"][0] and kinds["response2"][1]["warc-warcinfo-id"] == kinds["warcinfo"][0]
    assert kinds["revisit4"][1]["warc-refers-to"] == kinds["response2"][0] and kinds["revisit4"][2] == reply
    assert kinds["revisit7"][1]["warc-refers-to"] == "<urn:uuid:99>" and kinds["revisit7"][1]["warc-payload-digest"] == sha1(b"else")


@pytest.mark.parametrize("label", ["sha1:TKMUYRPUHRW6RO5RB3DXZBNJWFMBXPVF", "SHA-1: 9a994c45f43c6de8bbb10ec77c85a9b1581bbea5", "sha1:9A994C45F43C6DE8BBB10EC77C85A9B1581BBEA5"])
def test_digests_are_compared_in_one_form(label):
    import base64

    value = label.replace("SHA-1: ", "sha1:").split(":")[1]
    bare = base64.b32decode(value).hex() if len(value) == 32 else value.lower()
    assert warc.canonical_digest(label) == "sha1:" + bare
    assert warc.canonical_digest("sha1:ABC") == "sha1:ABC" and warc.canonical_digest("xyz") == "xyz" and warc.canonical_digest("sha256:00") == "sha256:00"


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_rows(seed, n=160, words=80):
    """A base and copies with a growing number of edits, so that many pairs lie about the threshold."""
    import random

    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            at = rng.randrange(len(w))
            kind = rng.random()
            if kind < 0.5:
                w[at] = f"e{rng.randrange(40)}"
            elif kind < 0.75:
                del w[at]
            else:
                w.insert(at, f"i{rng.randrange(40)}")
        rows.append((i, " ".join(w)))
    return rows + [(1000 + i, " ".join(f"u{i}_{j}" for j in range(30))) for i in range(20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = near_rows(seed)
    want = brute_components(rows)
    got = minhash.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd(spark, odd):
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect())
    assert got[(5, 3, 0, False)] == 2 and got[(0, 3, 0, True)] == 1 and got[(1, 0, 1, True)] == 1 and got[(3, 0, 3, True)] == 1 and got[(None, 1, None, True)] == 1
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_super_minhash_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(5)
    error = []
    for _ in range(30):
        both = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.unique(both[:240]), np.unique(both[60:])
        sig = minhash.super_minhash(np.concatenate((a, b)), np.array([len(a), len(b)]), 128)
        assert np.isfinite(sig).all() and len(set(np.floor(sig[0]))) >= 1
        error.append((sig[0] == sig[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(error)) < 0.02
    # A set of one element visits each slot once: its values have all different whole parts.
    one = minhash.super_minhash(np.array([7], np.uint64), np.array([1]), 64)[0]
    assert sorted(np.floor(one)) == list(range(64))


def test_components(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(rows, "a long, b long").repartition(3)).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 0, 201: 200}


def test_licenses(spark):
    notice = license_scan.TEMPLATES["Apache-2.0"][1]
    rows = [
        (1, "a/LICENSE", notice), (2, "a/b/c/x.py", "print(1)"), (3, "a/b/LICENSE", "Released under the MIT License."), (4, "z/y.py", "x"), (5, None, "x"), (6, "a/b/c/q.py", "code\n" * 30 + "# Licensed under CC BY-NC 4.0.\ncode"), (7, "top.txt", None),
        (8, "a/w.py", "no licence is given here, and the word alone says nothing of any text that one could know " * 3), (9, "a/b2/v.py", ""), (2, "a/b/c/x.py", "print(1)"),
    ]
    files = spark.createDataFrame(rows, "id long, path string, text string").withColumn("license", F.lit("x"))
    got = {r["id"]: (r["own_license"], r["is_license_file"], r["license"], r["inherited_from"], r["basis"]) for r in license_scan.scan_licenses(files, "id", "path", "text").collect()}
    assert got[1][:3] == ("Apache-2.0", True, "Apache-2.0") and got[3][:3] == ("MIT", True, "MIT")
    assert got[2] == (None, False, "MIT", "a/b", "inherited") and got[9] == (None, False, "Apache-2.0", "a", "inherited") and got[8][2] == "Apache-2.0"
    assert got[6] == ("CC-BY-NC-4.0", False, "CC-BY-NC-4.0", None, "own") and got[4][4] == got[5][4] == got[7][4] == "none"
    assert license_scan.scan_licenses(files, "id", "path", "text").count() == len(rows)
    assert license_scan.scan_licenses(files.limit(0), "id", "path", "text").count() == 0


def wrapped(text, mark="", width=68):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_licenses_in_headers_and_files(spark):
    from pathlib import Path

    t = license_scan.TEMPLATES
    code = "\nimport os\nprint(os.name)\n" * 5
    cases = {f"{name}/LICENSE": (name, "Copyright (c) 2020 Some One\n\n" + wrapped(t[name][0])) for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "0BSD")}
    cases |= {f"{name}/h.c": (name, wrapped(t[name][1], " * ") + code) for name in ("GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "Apache-2.0")}
    cases |= {"m/h.py": ("MPL-2.0", wrapped(t["MPL-2.0"][0], "# ", 40) + code), "gpl/short.py": ("GPL-3.0", wrapped(t["GPL-3.0"][0], "# ") + code), "s/a.py": ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later" + code), "s/b.py": ("MIT", "// SPDX-License-Identifier: (MIT)" + code), "s/c.py": (None, "# SPDX-License-Identifier: Unknown-1.0" + code)}
    whole = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0"}
    shared = Path("/usr/share/common-licenses")
    cases |= {f"full/{k}/COPYING": (v, (shared / k).read_text()) for k, v in whole.items() if (shared / k).exists()}
    cases["plain.txt"] = (None, "the terms of the house are subject to the general garden\n" * 20)
    files = spark.createDataFrame([(None, k, text) for k, (_, text) in cases.items()], "id long, path string, text string")
    got = {r["path"]: r["own_license"] for r in license_scan.scan_licenses(files, "id", "path", "text").collect()}
    assert got == {k: name for k, (name, _) in cases.items()}


def test_license_cosines_against_brute_force(spark):
    import math

    templates = {"A": ["alpha beta gamma delta alpha"], "B": ["beta gamma omega"]}
    texts = ["alpha beta gamma delta", "beta gamma omega other", "alpha other words here", "beta beta gamma gamma omega omega"]
    found = spark.createDataFrame([(i, f"l{i}", t, len(t.split())) for i, t in enumerate(texts)], "file long, passage string, text string, words long")
    got = {r["file"]: (r["license"], r["cosine"]) for r in license_scan.template_cosines(found, templates, 0.0).collect()}
    every = [collections.Counter(t.split()) for t in [*texts, templates["A"][0], templates["B"][0]]]
    idf = {w: math.log((len(every) + 1) / (sum(w in c for c in every) + 1)) + 1 for c in every for w in c}
    vector = lambda c: {w: (1 + math.log(n)) * idf[w] for w, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for i in range(len(texts)):
        v = vector(every[i])
        cosines = {k: sum(v.get(w, 0) * x for w, x in u.items()) / norm(v) / norm(u) for k, u in zip("AB", map(vector, every[-2:]))}
        best = max(cosines, key=lambda k: (cosines[k], -ord(k)))
        assert got[i][0] == best and abs(got[i][1] - cosines[best]) < 2e-6


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, odd, name):
    path = token_counts.tokenizer_path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        size = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lambda x: len(sp.encode(x))
    more = docs(spark, [(30, "It's THE don't <|startoftext|>x<|ENDOFTEXT|> a\u001cb   će İstanbul", "en", "s"), (31, "x" * 5000, "en", "s")])
    every = odd.unionByName(more)
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()), size(r["text"] or "")) for r in every.collect())
    # With a head of all pre-tokens, and with one of a few: the others are joined by a shuffle.
    for head in (token_counts.HEAD, 3):
        got = token_counts.token_counts(every, path, table_size=50, head=head).collect()
        assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    tokens = [r["token"] for r in token_counts.piece_counts(every, path, table_size=50).collect()]
    assert len(tokens) == len(set(tokens)) > 1000
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert token_counts.token_counts(empty(spark), path).count() == 0


def brute_phrases(text, training):
    """Greedy longest-match parse: phrases until the end."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in training:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_cross_parsing_counts_phrases():
    import numpy as np

    texts = {"en": "the house is on the hill and the dog sleeps", "fr": "la maison est sur la colline et le chien dort"}
    parser = langid.CrossParser(texts)
    for sample in ("the dog is on the hill", "la maison et le chien", "zzz the", "e"):
        codes = parser.symbols(np.frombuffer(sample.encode(), np.uint8))
        block = np.zeros((1, langid.STRETCH), np.uint8)
        block[0, : len(codes)] = codes
        got = parser.phrases(block)[:, 0]
        for lang, n in zip(parser.languages, got, strict=True):
            # The parser counts a phrase where one ends, so the last one is not counted.
            assert n + 1 == brute_phrases(sample, texts[lang]) or abs(n + 1 - brute_phrases(sample, texts[lang])) <= sample.count("z")


def test_languages_of_held_out_documents(spark):
    got = langid.identify_languages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").select("doc_id", "lang").collect()}
    known = [r for r in got if r["doc_id"] in lang and r["lang_pred"] != "und"]
    assert len(known) > 100 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in known) >= 0.97 * len(known)


def test_every_language_is_learned_from_short_rows(spark):
    import random

    rng = random.Random(2)
    names = [f"l{i:02d}" for i in range(80)]
    letters = {k: rng.sample("abcdefghijklmnopqrstuvwxyz", 5) for k in names}
    rows = [(1000 * i + j, " ".join("".join(rng.choice(letters[k]) for _ in range(4)) for _ in range(6)), k, "s") for i, k in enumerate(names) for j in range(12)]
    learned = langid.training_texts(docs(spark, rows), sample_chars=150)
    assert sorted(learned) == names and all(len(t) >= 140 for t in learned.values())
    small = langid.training_texts(docs(spark, rows), sample_chars=1000, total_chars=800)
    assert sorted(small) == names and all(len(t) <= 10 for t in small.values())


def test_a_text_over_one_stretch_counts_whole(spark):
    texts = {"en": "the house is on the hill and the dog sleeps", "fr": "la maison est sur la colline et le chien dort"}
    import pyarrow as pa

    parser = langid.CrossParser(texts)
    long = "la maison est sur la colline et " * 200
    mixed = "the house is on the hill and " * 30 + long
    langs, scores = langid.predict(pa.array([long, mixed, None, "123"]), parser)
    assert langs == ["fr", "fr", "und", "und"] and scores[0] > scores[1] > 0 and scores[2:] == [0.0, 0.0]


def test_languages_odd(spark, odd):
    got = collections.defaultdict(list)
    for r in langid.identify_languages(odd).collect():
        got[r["doc_id"]].append(r)
    assert got[1][0]["lang_pred"] == "und" and got[3][0]["lang_pred"] == "und" and got[3][0]["score"] == 0
    assert all(0 <= r["score"] <= 1 for rows in got.values() for r in rows) and len(got[5]) == 2
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, rows in got.items() if i is not None for r in rows)
    assert langid.identify_languages(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in langid.identify_languages(docs(spark, [(i, "abc", None, "s") for i in range(3)])).collect()} == {"und"}


def test_mixture(spark, odd):
    got = mixing.mixture(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    for rows in by.values():
        assert sum(r["size"] for r in rows) == rows[0]["source_size"]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    again = mixing.mixture(odd.repartition(3)).collect()
    assert collections.Counter(got) == collections.Counter(again)
    assert mixing.mixture(empty(spark)).count() == 0
    blank = mixing.mixture(docs(spark, [(1, "", "en", "s"), (2, None, "en", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2


def test_targets_are_the_fixed_point(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 0, "e": 40, None: 300}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    names = sorted((k for k in sizes if k is not None)) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[k] for k in full)
        total = sum(weight[k] for k in names if k not in full)
        new = {k for k in names if k not in full and left * weight[k] / total > 2 * sizes[k]}
        if not new:
            break
        full |= new
    for k in names:
        assert abs(got[k] - (2 * sizes[k] if k in full else left * weight[k] / total)) < 1e-6


def test_position_inverts_the_integral(spark):
    knots = ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))
    got = spark.createDataFrame([(i / 20,) for i in range(21)], "u double").select("u", mixing.position_at(F.col("u"), knots).alias("t")).collect()
    for r in got:
        t = r["t"]
        assert abs((0.5 * t + 0.5 * t * t) - r["u"]) < 1e-9


def test_packing(spark, odd):
    import numpy as np
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    more = docs(spark, [(30 + i, x, "en", f"q{i}") for i, x in enumerate(["a  b", " a", "a ", "a\n b", "a \n b", "it's  <|endoftext|> x", "  a  b", "a\u001c b\u001d", "x" * 3000, "\n\n\n", "tab\tx y\r\nz"])])
    every = odd.unionByName(more)
    ids = {(r["doc_id"], r["text"]): np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in every.collect()}
    got = packing.pack(every, path, table_size=100).collect()
    total = sum(len(ids[r["doc_id"], r["text"]]) for r in every.collect())
    assert sum(r["length"] for r in got) == total
    known = {(i, len(v)): v for (i, _), v in ids.items()}
    pieces = collections.defaultdict(collections.Counter)
    for r in got:
        v = known[r["doc_id"], r["doc_tokens"]]
        assert r["ids_crc32"] == zlib.crc32(v[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"], r["doc_tokens"]].update(range(r["start"], r["start"] + r["length"]))
    copies = collections.Counter((r["doc_id"], len(ids[r["doc_id"], r["text"]])) for r in every.collect())
    for k, c in pieces.items():
        assert c == {i: copies[k] for i in range(k[1])}
    windows = collections.defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, w in windows.items():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at == 1024 or k == max(windows)
    assert sorted(windows) == list(range(len(windows)))
    assert packing.pack(empty(spark), path).count() == 0


def test_words_are_encoded_together():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_path("byte_bpe_50k.json")
    whole, rnd = Tokenizer.from_file(path), random.Random(3)
    parts = ["a", "Zé", "語", "don't", "'s", "12", "...", "\n", "\t", "\u0085", "\u001c", "\u2003", "🙂", " ", "  ", "<|endoftext|>", "|>"]
    texts = ["", " ", "\n", "a ", "a\n", "a b\n\n", " a", "a\u2003", *("".join(rnd.choices(parts, weights=[1] * 13 + [12, 1, 1, 1], k=rnd.randrange(12))) for _ in range(2000))]
    texts += [" ".join(f"w{i}x{k}," for k in range(200)) for i in range(50)]  # 10,000 distinct words
    expected = [whole.encode(x, add_special_tokens=False).ids for x in texts]
    for ranked in (True, False):
        words = packing.WordTokens(path, 100, ranked)
        assert [x.tolist() for x in words.of(pa.array(texts, pa.large_string()))] == expected
    words, calls = packing.WordTokens(path, ranked=True), []
    words.fast = type("Counted", (), {"encode_ordinary": lambda self, text, fast=words.fast: calls.append(text) or fast.encode_ordinary(text)})()
    assert [x.tolist() for x in words.of(pa.array(texts[-50:], pa.large_string()))] == expected[-50:]
    assert len(calls) < 100  # the 50 first words, and all others together


def test_packing_keeps_proportions(spark):
    path = token_counts.tokenizer_path("byte_bpe_50k.json")
    rows = docs(spark, [(i, f"word{i} " * 400, "en", "big" if i % 4 else "small") for i in range(80)])
    got = packing.pack(rows, path).toPandas().merge(rows.select("doc_id", "source").toPandas(), on="doc_id")
    share = got[got.source == "big"].groupby("sequence_id").length.sum() / 1024
    whole = got[got.source == "big"].length.sum() / got.length.sum()
    assert (share.iloc[:-1] - whole).abs().max() <= (packing.GRAIN + 1) / 1024


def brute_lines(rows, min_words):
    """Positions of lines that a later copy of a repeated run of min_words words covers."""
    place = sorted((i, t) for i, t in rows if t is not None)
    seen, gone = set(), collections.defaultdict(set)
    for i, t in place:
        lines = t.split("\n")
        words = [len(WORD.findall(x)) for x in lines]
        for a in range(len(lines)):
            if not words[a]:
                continue
            n, b = 0, a
            while b < len(lines) and n < min_words:
                n += words[b]
                b += 1
            if n < min_words:
                continue
            block = tuple(lines[a:b])
            if block in seen:
                gone[i, t] |= set(range(a, b))
            seen.add(block)
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    pool = [" ".join(f"p{i}w{j}" for j in range(rng.randrange(0, 9))) for i in range(30)]
    rows = []
    for i in range(60):
        start = rng.randrange(20)
        rows.append((i, "\n".join([f"own {i} {rng.random()}", *pool[start : start + rng.randrange(1, 11)], *rng.sample(pool, 3)])))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "\n" * 40)]
    gone = brute_lines(rows, 10)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, [(i, t, "en", "s") for i, t in rows]), min_words=10).collect()}
    for i, t in rows:
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])
        assert (got[i]["text"], got[i]["n_deleted"]) == (left, len(gone[i, t])), i
    assert sum(map(len, gone.values())) > 50


def test_line_dedup_odd(spark, odd):
    out = line_dedup.dedup_lines(odd)
    assert out.count() == odd.count() and out.where("n_deleted > 0").count() == 0
    twice = docs(spark, [(1, PROSE * 4, "en", "s"), (1, PROSE * 4, "en", "s"), (None, PROSE * 4, "en", "s")])
    assert sorted((r["doc_id"] is None, r["n_deleted"]) for r in line_dedup.dedup_lines(twice).collect()) == [(False, 0), (False, 0), (True, 1)]
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_packing_with_more_than_16_bits_of_ids(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    path = f"{tmp_path}/wide.json"
    made.save(path)
    assert packing.id_type(made) == "<u4" and not packing.ranks_agree(path)
    ids = [[69_990 + (i + j) % 10 for j in range(7 + i)] for i in range(20)]
    rows = [(i, " ".join(f"w{x}" for x in own), "en", "s") for i, own in enumerate(ids)]
    for r in packing.pack(docs(spark, rows), path, window=16, grain=8).collect():
        part = [*ids[r["doc_id"]], 0][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) + 1


def test_ranks_are_used_only_where_both_libraries_agree():
    assert packing.ranks_agree(token_counts.tokenizer_path("byte_bpe_50k.json"))
    assert not packing.ranks_agree(token_counts.tokenizer_path("word_bpe_49k.json"))


def test_sketches_and_ids_are_made_in_little_memory(monkeypatch):
    """What a task holds at once follows the slice, not the record batch: workers live beside a heap that may be full."""
    import random
    import tracemalloc

    import pyarrow as pa
    import pyspark

    class Task:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(pyspark.TaskContext, "get", Task)
    path = token_counts.tokenizer_path("byte_bpe_50k.json")
    runs = {"sketches": minhash._sketches(minhash.SHINGLE, minhash.BANDS, minhash.ROWS), "ids": packing._tokenize(path, 16, 1000, False, packing.ranks_agree(path))}
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    short = [" ".join(rng.choices(words, k=3)) for _ in range(10_000)]
    long = [" ".join(rng.choices(words, k=1000)) for _ in range(1300)]
    for kind, texts, most in (("sketches", short, 64), ("sketches", long, 80), ("ids", long, 60)):
        n = len(texts)
        batch = pa.record_batch({"_row": pa.array(range(n)), "doc_id": pa.array(range(n)), "source": pa.array(["s"] * n), "text": pa.array(texts)})
        for _ in runs[kind](iter([batch.slice(0, 2)])):  # what is loaded once
            pass
        tracemalloc.start()
        try:
            assert sum(b.num_rows for b in runs[kind](iter([batch]))) == n
            peak = tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()
        assert peak < most
