"""Quality rules: divergence of a text's histograms from those of its languages.

Of each text two kinds of histogram are taken: of character classes, and for each language of
that language's common words against all others. The same histograms summed over all documents
of a language are its reference. A text whose Jensen-Shannon distance from every language's
reference is too large is rejected, if it is long enough for its histogram to mean something.
Counting rules come first. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, written

#: Common words of some languages (fixed values); those of other languages are counted.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "zu", "den", "das", "mit", "von", "ein", "auf", "für"],
    "en": ["the", "of", "and", "to", "in", "is", "it", "that", "for", "was", "on", "with"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "las", "un", "por", "con"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour"],
}
#: Character classes as patterns; what fits none of them is a class of its own.
CLASSES = {
    "lower": "[a-z]",  # most characters; the others are looked for in what is left without them
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "space": r"[\x20\x09-\x0D]",
    "stop": r"[.,;:!?'\x22()-]",
    "symbol": "[#*$%&|<>]",
    "wide": r"[^\x00-\x7F]",
}
#: Share of the distance of a text without listed words beyond which a text has too few of them.
MOST_BARE = 0.98
#: Quantile of the shares of common words that stands for a language's ordinary texts.
NINE_TENTHS = 0.9
WORD = r"[^\x20\x09-\x0D]+"


def vocabulary(common: dict[str, list[str]]) -> list[str]:
    return sorted({w for words in common.values() for w in words})


def common_words(docs: DataFrame, common: dict[str, list[str]], least_docs: int, most_words: int = 12) -> dict[str, list[str]]:
    """The words given, and for each further language with enough documents the words that it uses most.

    Words are lower-cased; ties go to the smaller one. Words are read only if there are such languages.
    """
    lang = F.col("lang").cast("string")
    rows = docs.where(lang.isNotNull()).groupBy(lang.alias("lang")).agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)
    further = sorted({r["lang"] for r in rows.collect()} - set(common))
    if not further:
        return common
    words = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD), F.lit(0)))
    counted = docs.where(lang.isin(further)).select(lang.alias("lang"), words.alias("word")).groupBy("lang", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    # a language's words are cut down by an aggregate, so that none has to be sorted whole
    top = counted.groupBy("lang", F.pmod(F.xxhash64("word"), F.lit(64)).alias("part")).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), 1, most_words).alias("top"))
    top = top.select("lang", F.explode("top").alias("x")).select("lang", "x.*")
    order = Window.partitionBy("lang").orderBy("n", "word")
    best = top.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_words).orderBy("lang", "place").collect()
    found = {x: [] for x in further}
    for r in best:
        found[r["lang"]].append(r["word"])
    return common | {x: ws for x, ws in found.items() if ws}


def text_counts(docs: DataFrame, common: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """The document, its doc_id and lang, and all counts of its whole text; a null text counts as empty.

    `classes` are the character class counts and the rest; `common` the counts of vocabulary()
    among the words with A-Z and other letters lower-cased, in its order.
    """
    listed = vocabulary(common)
    longest = max(map(len, listed))
    # one character stands for each listed word, the first for all others; the range of surrogates is left out
    signs = "".join(chr(33 + i if 33 + i < 0xD800 else 0x10000 + i) for i in range(len(listed) + 1))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.struct(*docs.columns).alias("document"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    split = base.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    words, n = F.col("words"), F.size("words")
    # three words in a row are told from others of their text by a 64-bit hash
    triples = F.when(n >= 3, F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    short = F.filter(words, lambda w: F.length(w) <= longest)
    coded = F.array_join(F.transform(short, lambda w: F.substring(F.lit(signs), F.array_position(F.array(*map(F.lit, listed)), F.lower(w)).cast("int") + 1, F.lit(1))), "")
    held = split.select("document", "doc_id", "lang", "text", F.regexp_replace("text", CLASSES["lower"] + "+", "").alias("left"), n.cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), triples.alias("triples"), lines.alias("lines"), coded.alias("coded"))
    triples = F.col("triples")
    # equal triples stand together when sorted with their places
    placed = F.sort_array(F.transform(triples, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    repeated = F.size(F.array_distinct(triples)) < F.size(triples)
    sorted_once = held.select("*", F.when(repeated, placed).alias("placed"))
    p = F.col("placed")
    again = F.sort_array(F.transform(F.filter(p, lambda x, i: ((i > 0) & (F.get(p, i - 1)["t"] == x["t"])) | ((i < F.size(p) - 1) & (F.get(p, i + 1)["t"] == x["t"]))), lambda x: x["i"]))
    again = sorted_once.select("*", again.alias("again"))
    a = F.col("again")
    # a repeated triple covers its three words, or those before the next repeated one
    covered = F.aggregate(F.transform(a, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(a, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    lower = (F.length("text") - F.length("left")).cast("long")
    classes = [lower, *(F.regexp_count("left", F.lit(pattern)).cast("long") for name, pattern in CLASSES.items() if name != "lower")]
    return again.select(
        "document",
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.length("text").cast("long").alias("n_chars"),
        F.array(*classes).alias("classes"),
        F.array(*(F.length("coded").cast("long") - F.length(F.replace("coded", F.lit(c), F.lit(""))) for c in signs[1:])).alias("common"),
    )


def references(counts: DataFrame, common: dict[str, list[str]], least_docs: int, failed: Column) -> list[dict[str, tuple[list[float], list[float]]]]:
    """For each language with enough documents, the shares of character classes and common words: of all rows, and of ordinary ones.

    Junk dilutes the first. The second sum only rows that pass the base rules and have at least
    half the share of their language's common words that its quantile at NINE_TENTHS has (in
    thousandths, so that the quantile is exact and its state small).
    """
    listed = vocabulary(common)
    own = {lang: sum(F.col("common")[listed.index(w)] for w in ws) for lang, ws in common.items()}
    share = F.floor(1000 * F.coalesce(*(F.when(F.col("lang") == lang, x) for lang, x in own.items())) / F.greatest(F.col("n_words"), F.lit(1))).cast("int")
    rated = counts.where(F.col("lang").isin(list(common))).withColumn("share", F.when(~failed, share))
    high = rated.groupBy("lang").agg(F.percentile_approx("share", NINE_TENTHS, 10000).alias("high")).collect()  # a row for each language
    least = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(r["high"] / 2)) for r in high if r["high"] is not None), F.lit(None).cast("double"))
    ordinary = F.coalesce(F.col("share") >= least, F.lit(False))
    counted = {"chars": F.col("n_chars"), "words": F.col("n_words"), "docs": F.lit(1)}
    counted |= {f"c{i}": F.col("classes")[i] for i in range(len(CLASSES))} | {f"w{i}": F.col("common")[i] for i in range(len(listed))}
    rows = rated.groupBy("lang", ordinary.alias("ordinary")).agg(*(F.sum(x).alias(name) for name, x in counted.items())).collect()
    whole, good = {}, {}
    for r in rows:
        for sums in [whole, good] if r["ordinary"] else [whole]:
            sums[r["lang"]] = {name: r[name] + sums.get(r["lang"], {}).get(name, 0) for name in counted}
    out = []
    for kind in (whole, good):
        shares = {}
        for lang, r in sorted(kind.items()):
            if whole[lang]["docs"] >= least_docs and r["chars"] and r["words"]:
                kinds = [r[f"c{i}"] for i in range(len(CLASSES))]
                mine = [r[f"w{listed.index(w)}"] for w in common[lang]]
                shares[lang] = [x / r["chars"] for x in [*kinds, r["chars"] - sum(kinds)]], [x / r["words"] for x in [*mine, r["words"] - sum(mine)]]
        out.append(shares)
    return out


def js_distance(shares: Column, reference: list[float]) -> Column:
    """The Jensen-Shannon distance (base 2) of an array of shares from fixed ones."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    total = F.aggregate(F.zip_with(shares, F.array(*map(F.lit, reference)), term), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def bare_distance(listed_share: float) -> float:
    """The distance of a text without any listed word from a reference with that share of listed words."""
    s = min(max(listed_share, 0.0), 1.0)
    rest = (1 - s) * math.log2(2 * (1 - s) / (2 - s)) if s < 1 else 0.0
    return math.sqrt(max(s + math.log2(2 / (2 - s)) + rest, 0.0) / 2)


def judge(
    docs: DataFrame,
    common: dict[str, list[str]] = COMMON_WORDS,
    most_class: float = 0.25,
    most_common: float = 0.295,
    most_bare: float = MOST_BARE,
    least_chars: int = 200,
    least_words: int = 100,
    least_docs: int = 20,
    min_words: int = 50,
    most_repeat_percent: int = 50,
    carry: bool = False,
) -> DataFrame:
    """One row per document: the counts, the distances, base_failed and kept.

    base_failed: fewer than min_words words, or more than most_repeat_percent of them in repeated
    triples. A language has two references, of all its rows and of its ordinary ones; a text is
    far if it is far from every language by both kinds. class_distance and common_distance are the least over the references, which each language with at least least_docs documents has; null if there is none, or the text is shorter than least_chars or
    least_words. kept: not base_failed, and not too far from every language; a text of a
    language that is neither in `common` nor has a reference is not rejected by distance (those
    of `common` that are too rare are measured against the others, as the SQL does). By common words
    that is beyond most_common; for a text with a smaller share of them than the reference also
    beyond most_bare times the distance that a text without any has from that reference, which
    falls as junk rows dilute the reference. A reference without any common
    word tells nothing and is passed over. Texts that are null or empty fail the base rules. Repeated rows are judged alike (each counts in the references);
    a null lang counts in none. Columns other than doc_id, text and lang don't matter; with
    carry, the struct `document` has all of a document's columns.
    """
    given = list(common)
    common = common_words(docs, common, least_docs)
    counts = text_counts(docs, common)
    # with whole documents a checkpoint, which Spark can remove when it isn't needed any more
    counts = cut(counts) if carry else written(counts.drop("document"), "text-counts")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    kinds_of = references(counts, common, least_docs, failed)
    listed = vocabulary(common)
    chars, n = F.greatest(F.col("n_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    kinds = [F.col("classes")[i] for i in range(len(CLASSES))]
    shares = {"class_shares": F.array(*(k / chars for k in [*kinds, F.col("n_chars") - sum(kinds)]))}
    place = {lang: f"shares_{i}" for i, lang in enumerate(kinds_of[0])}
    for lang, name in place.items():
        own = [F.col("common")[listed.index(w)] for w in common[lang]]
        shares[name] = F.array(*(x / n for x in [*own, F.col("n_words") - sum(own)]))
    counts = counts.withColumns(shares)
    by_class, by_common, far = [], [], F.lit(True)
    for found in kinds_of:
        of_class = [js_distance(F.col("class_shares"), c) for c, _ in found.values()]
        of_common = [js_distance(F.col(place[lang]), w) for lang, (_, w) in found.items()]
        fits = []
        for d, (lang, (_, w)) in zip(of_common, found.items(), strict=True):
            if w[-1] < 1:
                limit = F.when(F.element_at(place[lang], -1) > w[-1], min(most_common, most_bare * bare_distance(1 - w[-1]))).otherwise(most_common)
                fits.append(d <= limit)
        odd = (F.col("n_chars") >= least_chars) & (F.array_min(F.array(*of_class)) > most_class) if of_class else F.lit(False)
        few = (F.col("n_words") >= least_words) & ~F.exists(F.array(*fits), lambda x: x) if fits else F.lit(False)
        if found or not by_class:
            far = far & (odd | few)
        by_class, by_common = by_class + of_class, by_common + of_common
    least = lambda d, long: F.when(long, F.array_min(F.array(*d))) if d else F.lit(None).cast("double")
    out = counts.select(
        *(["document"] if carry else []),
        "doc_id",
        "n_words",
        "word_chars",
        F.col("classes")[list(CLASSES).index("symbol")].alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        least(by_class, F.col("n_chars") >= least_chars).alias("class_distance"),
        least(by_common, F.col("n_words") >= least_words).alias("common_distance"),
        far.alias("far"),
        (F.col("lang").isNull() | F.col("lang").isin([*given, *place])).alias("comparable"),
    )
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("comparable") & F.col("far"))).drop("far", "comparable")


def passing_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return judge(docs, carry=True, **options).where("kept").select("document.*")
