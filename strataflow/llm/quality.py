"""Quality rules: distribution divergence of a document from language references (DataFrame functions only).

Every document gets a histogram of character classes and one of common words.  The references are the same two
histograms, summed over all documents of each language that pass the base rules and are plain prose (few
symbols and capitals, and as long as the word guard).  Every language with ``min_reference`` documents has its common words:
those of a fixed list, or its most frequent words where there is none.  Words are compared in lower case without the
punctuation around them, and distances take capitals and small letters for one class, so that a text is judged alike in small
letters, in title case and in capitals; capitals are counted only to leave such texts out of the references.  A document is rejected
when the smallest Jensen-Shannon distance to any reference is too large; short documents are guarded, because their
histograms are noise, and a document whose language has no reference is not judged by them.  Common words are a small share of prose, so a text without any of them is not far from a reference:
its distance follows from the reference's share, and word distances are also held against that one.

Edge cases: a null text counts as an empty one; an empty table gives an empty result; documents below the length guards
are never rejected for their distance; where no reference exists only the base rules decide; a null language is judged by the
nearest reference of all; very long texts are read as a whole; repeated rows are judged alike; columns other than the id, text and language are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.llm.common import SPACE_CLASS, words_of, written

# The most common short words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "nicht"],
    "en": ["the", "of", "and", "to", "in", "that", "is", "it", "for", "on"],
    "es": ["de", "la", "que", "el", "en", "los", "se", "por", "con", "para"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "que", "pour"],
}
CLASSES = ["lower", "space", "upper", "letter", "digit", "point", "other"]
#: What may stand around a word.
EDGES = ".,;:!?'\"()[]{}-\u00ab\u00bb\u2018\u2019\u201a\u201c\u201d\u201e\u2026\u00bf\u00a1\u2013\u2014"


@dataclass(frozen=True)
class QualityRules:
    """Thresholds.  Distances are square roots of divergences in bits, so they lie in 0..1."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    #: Character histograms of texts under so many characters are not judged.
    guard_chars: int = 200
    #: Word histograms of texts under so many words are not judged.
    guard_words: int = 60
    max_char_distance: float = 0.3
    max_word_distance: float = 0.45
    #: Word distances as shares of the distance that a text without any common word has from the same reference.
    max_word_share: float = 0.9
    #: Languages that get references; None: every language that is found.
    languages: tuple[str, ...] | None = None
    #: Plain documents that a reference is made from at least, and common words of a language without a fixed list.
    min_reference: int = 20
    n_common: int = 10


def _folded(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(EDGES))


def _class_counts() -> Column:
    """The classes of ``CLASSES`` with those of small letters and capitals in one."""
    c = F.col("classes")
    return F.concat(F.array(c[0] + c[2], c[1]), F.slice(c, 4, len(CLASSES) - 3))


def common_words(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text", lang_col: str = "lang") -> list[str]:
    """The common words of all languages: of a language without a fixed list, its most frequent words.

    One count per language comes to the driver, and ``n_common`` words of each that has no list; the words are counted over all of
    its documents.
    """
    rows = docs.where(F.col(lang_col).isNotNull())
    if rules.languages is not None:
        rows = rows.where(F.col(lang_col).isin(*rules.languages))
    found = [r["lang"] for r in rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().where(F.col("count") >= rules.min_reference).collect()]
    words = {w for lang in found for w in COMMON_WORDS.get(lang, [])}
    if new := [lang for lang in found if lang not in COMMON_WORDS]:
        each = rows.where(F.col(lang_col).isin(*new)).select(F.col(lang_col).alias("lang"), F.explode(words_of(F.col(text_col))).alias("word"))
        each = each.withColumn("word", _folded(F.col("word"))).where(F.col("word") != "").groupBy("lang", "word").count()
        place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("count"), "word"))
        words |= {r["word"] for r in each.withColumn("place", place).where(F.col("place") <= rules.n_common).collect()}
    return sorted(words)


def _with_pairs(df: DataFrame, of: str, gap: int, out: str) -> DataFrame:
    """Adds hashes of the elements of ``of`` that stand ``gap`` apart; a step of its own, so that nothing is computed twice."""
    n = F.greatest(F.size(of) - gap, F.lit(0))
    return df.withColumn(out, F.zip_with(F.slice(of, F.lit(1), n), F.slice(of, F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b)))


def document_features(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False) -> DataFrame:
    """Counts per document: id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, commons; with
    ``carry`` also ``row``, a struct of all columns of ``docs``."""
    if rules.window != 8:
        raise ValueError("windows are built by doubling to 8 words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = ["row"] if carry else []
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("t"), words_of(F.col(text_col)).alias("words"), *([F.struct("*").alias("row")] if carry else []))
    # Each step takes one class of characters away, so that later steps read ever shorter strings.
    base = base.withColumn("t1", F.regexp_replace("t", "[a-z]+", ""))
    base = base.withColumn("t2", F.regexp_replace("t1", SPACE_CLASS + "+", ""))
    base = base.withColumn("t3", F.regexp_replace("t2", "[A-Z]+", ""))
    base = base.withColumn("t4", F.regexp_replace("t3", r"\p{L}+", ""))
    base = base.withColumn("t5", F.regexp_replace("t4", "[0-9]+", ""))
    base = base.withColumn("t6", F.regexp_replace("t5", r"[.,;:!?'\"()-]+", ""))
    base = base.withColumn("t7", F.regexp_replace("t6", "[#*$%&|<>]+", ""))
    n = [F.length(c).cast("long") for c in ("t", "t1", "t2", "t3", "t4", "t5", "t6")]
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]"))
    vocabulary = common_words(docs, rules, text_col, lang_col)
    base = base.select(
        "doc_id", "lang", "words",
        F.size("words").cast("long").alias("n_words"),
        (n[0] - (n[1] - n[2])).alias("word_chars"),
        (n[6] - F.length("t7")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.array(n[0] - n[1], n[1] - n[2], n[2] - n[3], n[3] - n[4], n[4] - n[5], n[5] - n[6], n[6]).alias("classes"),
        F.filter(F.transform("words", _folded), lambda w: w.isin(vocabulary)).alias("known"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("one"), *carried,
    )
    base = _with_pairs(base.drop("words"), "one", 1, "two")
    base = _with_pairs(base.drop("one"), "two", 2, "four")
    base = _with_pairs(base.drop("two"), "four", 4, "windows").drop("four")
    known = F.size("known").cast("long")
    counts = [known - F.size(F.array_remove("known", F.lit(w))) for w in vocabulary]
    base = base.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "classes",
        F.array(*counts, F.col("n_words") - known).alias("commons"),
        # Only texts in which some window repeats go on to the sort.
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"), *carried,
    )
    m = F.size("s")
    nil = F.lit(None).cast("bigint")
    after = F.concat(F.transform(F.slice("s", F.lit(2), m), lambda x: x["h"]), F.array(nil))
    before = F.concat(F.array(nil), F.transform(F.slice("s", F.lit(1), m - 1), lambda x: x["h"]))
    same = F.zip_with(F.zip_with("s", before, lambda x, b: F.struct(x["i"].alias("i"), x["h"].alias("h"), x["h"].eqNullSafe(b).alias("e"))), after, lambda x, a: F.when(x["e"] | x["h"].eqNullSafe(a), x["i"]))
    base = base.withColumn("at", F.when(F.col("s").isNotNull(), F.array_sort(F.array_compact(same)))).drop("s")
    # The words that the repeated windows cover: each window adds what the next does not.
    steps = F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), lambda a, b: F.least(F.coalesce(b - a, F.lit(rules.window)), F.lit(rules.window)))
    covered = F.aggregate(steps, F.lit(0).cast("int"), lambda a, x: a + x)
    return base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def _failed(rules: QualityRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def _shares(counts: list[float]) -> list[float] | None:
    total = sum(counts)
    return [c / total for c in counts] if total else None


def language_references(features: DataFrame, rules: QualityRules = QualityRules()) -> dict[str, tuple[list[float], list[float]]]:
    """Shares of the character classes and common words of all plain documents of each language.

    One row of counts for each language comes to the driver, whatever the size of the corpus.
    """
    chars, c = F.aggregate("classes", F.lit(0).cast("bigint"), lambda a, x: a + x), F.col("classes")
    plain = (100 * F.col("n_symbols") <= chars) & (5 * c[2] <= c[0]) & (F.col("n_words") >= rules.guard_words)
    asked = F.col("lang").isin(*rules.languages) if rules.languages is not None else F.col("lang").isNotNull()
    good = features.where(asked & plain & ~_failed(rules))
    n_words = (features.select(F.size("commons")).first() or [1])[0]
    sums = [F.sum(_class_counts()[i]).alias(f"c{i}") for i in range(len(CLASSES) - 1)]
    sums += [F.sum(F.col("commons")[i]).alias(f"w{i}") for i in range(n_words)]
    found = {}
    for row in good.groupBy("lang").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= rules.min_reference).collect():
        shares = [_shares([row[f"{k}{i}"] for i in range(n)]) for k, n in (("c", len(CLASSES) - 1), ("w", n_words))]
        if shares[0] and shares[1]:
            found[row["lang"]] = (shares[0], shares[1])
    return dict(sorted(found.items()))


def js_distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance, base 2, of a share array from a fixed reference."""
    q = F.array(*[F.lit(x) for x in reference])

    def term(x: Column, y: Column) -> Column:
        half = (x + y) / 2
        log = lambda v: F.when(v > 0, v * F.log2(v / half)).otherwise(F.lit(0.0))
        return F.when(half > 0, log(x) + log(y)).otherwise(F.lit(0.0))

    total = F.aggregate(F.zip_with(shares, q, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _bare_distance(reference: list[float]) -> float:
    """Jensen-Shannon distance of a text without any common word from a reference, whose last share is that of other words."""
    other = reference[-1]
    total = (1 - other) + math.log2(2 / (1 + other)) + (other * math.log2(2 * other / (1 + other)) if other else 0.0)
    return math.sqrt(max(total / 2, 0.0))


def _judged(features: DataFrame, rules: QualityRules) -> DataFrame:
    """Adds ``base_failed``, both distances (null under the guards) and ``kept`` to written features."""
    references = language_references(features, rules)

    def distances(counts: Column, k: int) -> Column:
        total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
        shares = F.transform(counts, lambda x: x / total)
        each = [js_distance(shares, r[k]) for r in references.values()]
        return F.array(*each) if each else F.lit(None).cast("array<double>")

    chars = F.aggregate("classes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = features.withColumn("base_failed", _failed(rules))
    out = out.withColumn("char_distance", F.when(chars >= rules.guard_chars, F.array_min(distances(_class_counts(), 0))))
    out = out.withColumn("words_away", F.when(F.col("n_words") >= rules.guard_words, distances(F.col("commons"), 1)))
    # A reference without common words says nothing about a text without them.
    bare = F.array(*[F.lit(d or None).cast("double") for d in (_bare_distance(r[1]) for r in references.values())])
    out = out.withColumn("word_distance", F.array_min("words_away")).withColumn("word_share", F.array_min(F.zip_with("words_away", bare, lambda d, b: d / b)))
    far = F.coalesce(F.col("char_distance") > rules.max_char_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > rules.max_word_distance, F.lit(False))
    far = far | F.coalesce(F.col("word_share") > rules.max_word_share, F.lit(False))
    # A language without a reference is not measured against those of others.
    far = far & (F.col("lang").isNull() | F.col("lang").isin(*references)) if references else F.lit(False)
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def quality_verdicts(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: its counts, ``base_failed``, both distances and ``kept``."""
    out = _judged(written(document_features(docs, rules, id_col, text_col, lang_col), "quality"), rules)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"), "kept",
    )


def good_documents(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep.  Rows go with their counts, so that each is judged by itself whatever its id."""
    features = written(document_features(docs, rules, id_col, text_col, lang_col, carry=True), "quality")
    return _judged(features, rules).where("kept").select("row.*")
