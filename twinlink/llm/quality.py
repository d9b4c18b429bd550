"""Quality rules by distribution divergence, in DataFrame functions only.

Each document has a histogram of character classes and one of common words (plus all other
words).  References are the same histograms summed over all documents of a language with a
list of common words; a document's distance to a reference is the mean of the two Jensen-Shannon
distances (square roots of the divergence to base 2), and only the nearest reference counts, so
a document's own language label is not used.  Each of the two distances is judged by itself, against
a bound from the whole table: median plus ``spread`` times the scaled median absolute deviation among the
documents of the same nearest reference and octave of length (short histograms diverge more by chance).  Equal
documents count once there, and a group of fewer than ``LEAST`` takes the bound of its reference at all lengths.
Documents of fewer than ``min_words`` words are not judged by distance, nor are those labelled with a
language that has no reference (they would be held against foreign ones).  Base rules: too few words, or too
many words in repeated 5-word windows.

The histograms and the distances are each written once (numbers only); the references are one aggregate of at
most one row per listed language, the bounds one row per language and octave.  Repeated windows are found within each row: equal hashes first decide whether
there can be any, and only then the windows' words are sorted and compared.

Edge cases: a null text counts as empty and fails the base rule; null or unlisted languages add to no
reference (null ones are judged by the nearest); without any reference no distance is judged; repeated rows and null ids are rated row by row;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .frames import written

# Fixed lists: common words by language.
COMMON = {
    "en": "the of and to in is that it for was on are as with be this have from or by",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "le la les de des et en un une du dans que qui pour sur est par pas au plus",
    "es": "el la los las de y en que un una del por con para es se al lo su más",
}
WORDS = sorted({w for own in COMMON.values() for w in own.split()})
# One character for each listed word, so that a text's listed words are one string that native counts read.
MARKS = {w: chr(0x4E00 + k) for k, w in enumerate(WORDS)}
CLASSES = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "space": " \t\n\x0b\x0c\r",
    "stop": ".,;:!?",
    "sign": "#*$%&|<>@^_~=+/\\{}[]",
}
_BLANK = "\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
# Distances are counted in steps of 1 / STEPS; LEAST documents give a bound of their own.
STEPS, LEAST = 2000, 30


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _BLANK, " " * len(_BLANK)), " "), lambda w: w != "")


def repeat_words(words: Column, width: int = 5) -> Column:
    """Number of words inside windows of ``width`` words that occur twice or more."""
    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.when(k + 1 < F.size(at), F.least(F.lit(width), F.get(at, k + 1) - p))
                            .otherwise(width))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def near(own: Column, k: Column, field: str) -> Column:
        return (F.coalesce(F.get(own, k - 1)[field] == F.get(own, k)[field], F.lit(False))
                | F.coalesce(F.get(own, k + 1)[field] == F.get(own, k)[field], F.lit(False)))

    def positions(windows: Column) -> Column:
        same = F.filter(windows, lambda x, k: near(windows, k, "w"))
        return F.array_sort(F.transform(same, lambda x: x["p"]))

    def exact(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), (k + 1).alias("p"))))
        suspects = _let(placed, lambda own: F.filter(own, lambda x, k: near(own, k, "h")))
        windows = F.array_sort(F.transform(suspects, lambda x: F.struct(
            F.array_join(F.slice(words, x["p"], width), " ").alias("w"), x["p"].alias("p"))))
        return _let(_let(windows, positions), covered)

    starts = F.sequence(F.lit(0), F.size(words) - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(0))
    return F.when(F.size(words) > width, found).otherwise(0)


def histograms(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``id, lang``, the base counts, and the histograms ``chars`` and ``common`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("text"))

    def line_repeats(lines: Column) -> Column:
        return F.size(lines) - F.size(F.array_distinct(lines))

    lines = F.filter(F.split("text", "\n"), lambda s: F.translate(s, CLASSES["space"], "") != "")
    # Each class is counted on what the classes before it left over, symbols on the short rest with the signs.
    left, classes = F.col("text"), {}
    for name, signs in CLASSES.items():
        if name == "sign":
            n_symbols = F.length(left) - F.length(F.translate(left, _SYMBOLS, ""))
        rest = F.translate(left, signs, "")
        classes[name] = F.length(left) - F.length(rest)
        left = rest
    n_chars = F.length("text") - classes["space"]

    cut = _BLANK + CLASSES["stop"]

    marks = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])

    def common(own: Column) -> Column:
        return F.array(*[F.length(own) - F.length(F.replace(own, F.lit(c), F.lit(""))) for c in MARKS.values()])

    def measures(words: Column) -> Column:
        low = F.filter(F.split(F.translate(F.lower("text"), cut, " " * len(cut)), " "), lambda w: w.isin(*WORDS))
        marked = F.array_join(F.transform(low, lambda w: F.element_at(marks, w)), "")
        return F.struct(F.size(words).cast("bigint").alias("n_words"),
                        repeat_words(words).cast("bigint").alias("n_repeat_words"),
                        _let(marked, lambda own: F.concat(common(own), F.array(F.greatest(F.size(words) - F.length(own), F.lit(0))))).alias("common"))

    return base.select(
        "id", "lang", _let(split_words(F.col("text")), measures).alias("m"),
        n_chars.cast("bigint").alias("word_chars"), n_symbols.cast("bigint").alias("n_symbols"),
        _let(lines, line_repeats).cast("bigint").alias("n_dup_lines"),
        F.array(*classes.values(), F.length(left)).alias("chars"),
    ).select("id", "lang", "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "chars", "m.common")


def references(table: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Character and common-word shares of every listed language (at most one row for each)."""
    sums = [F.sum(F.col(c)[k].cast("bigint")).alias(f"{c}{k}")
            for c, size in (("chars", len(CLASSES) + 1), ("common", len(WORDS) + 1)) for k in range(size)]
    out = {}
    for row in table.where(F.col("lang").isin(*COMMON)).groupBy("lang").agg(*sums).collect():
        parts = [[row[f"{c}{k}"] for k in range(size)]
                 for c, size in (("chars", len(CLASSES) + 1), ("common", len(WORDS) + 1))]
        if all(sum(p) for p in parts):
            out[row["lang"]] = tuple([x / sum(p) for x in p] for p in parts)
    return dict(sorted(out.items()))


def js_distance(counts: Column, share: list[float]) -> Column:
    """Jensen-Shannon distance (0 to 1) of a row's counts to reference shares; null without counts."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b)
    reference = F.array(*[F.lit(float(s)) for s in share])

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    def distance(n: Column) -> Column:
        parts = F.zip_with(counts, reference, lambda c, q: term(c / n, q) + term(q, c / n))
        return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))
    return F.when(total > 0, _let(total, distance))


def bounds(judged: DataFrame, spread: float) -> dict[tuple[str, int | None], tuple[float, float]]:
    """Largest usual character and word distance by nearest reference and octave (None: all lengths)."""
    own = judged.select("nearest", "octave", "n_words", "char_distance", "word_distance").distinct()
    steps = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.round(F.col(c) * STEPS).cast("int").alias("step"))
                               for k, c in enumerate(("char_distance", "word_distance"))]))
    cells = own.select("nearest", "octave", steps).groupBy("nearest", "octave", "kind", "step").agg(F.count("*").alias("n"))
    cells = written(cells, "distance-counts")
    found: dict[tuple[str, int | None], list] = {}
    for keys in (["nearest", "kind"], ["nearest", "octave", "kind"]):
        middle = cells.groupBy(*keys).agg(F.percentile("step", 0.5, F.col("n")).alias("median"), F.sum("n").alias("size"))
        off = cells.join(F.broadcast(middle), keys).groupBy(*keys, "median", "size").agg(
            F.percentile(F.abs(F.col("step") - F.col("median")), 0.5, F.col("n")).alias("mad"))
        for r in off.collect():
            key = (r["nearest"], r["octave"] if "octave" in keys else None)
            if key[1] is None or r["size"] >= LEAST:
                found.setdefault(key, [0.0, 0.0])[r["kind"]] = (r["median"] + spread * 1.4826 * max(r["mad"], 1.0)) / STEPS
    return {k: tuple(v) for k, v in sorted(found.items(), key=str)}


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
         min_words: int = 50, spread: float = 3.5) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``kept``, ``nearest`` language and its ``distance``."""
    table = written(histograms(docs, id_col, text_col, lang_col), "histograms")
    languages = references(table)
    found = [_let(F.struct(js_distance(F.col("chars"), a).alias("c"), js_distance(F.col("common"), b).alias("w")),
                  lambda d, lang=lang: F.struct(((d["c"] + d["w"]) / 2).alias("distance"), F.lit(lang).alias("nearest"),
                                                d["c"].alias("char_distance"), d["w"].alias("word_distance")))
             for lang, (a, b) in languages.items()]
    none = F.struct(F.lit(None).cast("double").alias("distance"), F.lit(None).cast("string").alias("nearest"),
                    F.lit(None).cast("double").alias("char_distance"), F.lit(None).cast("double").alias("word_distance"))
    nearest = F.array_min(F.array(*found)) if found else none
    table = written(table.withColumn("near", nearest).select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "near.*",
        (F.col("lang").isNull() | F.col("lang").isin(*languages)).alias("known"),
        F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int").alias("octave")), "distances")
    most = bounds(table.where((F.col("n_words") >= min_words) & F.col("distance").isNotNull() & F.col("known")), spread)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))

    def beyond(c: float, w: float) -> Column:
        return (F.col("char_distance") > c) | (F.col("word_distance") > w)

    far = F.lit(False)
    # Octaves with a bound of their own go before the bound of the reference.
    for lang, octave in sorted(most, key=lambda k: (k[1] is not None, str(k))):
        same = F.col("nearest") == lang
        far = F.when(same if octave is None else same & (F.col("octave") == octave), beyond(*most[lang, octave])).otherwise(far)
    diverges = (F.col("n_words") >= min_words) & F.col("known") & F.coalesce(far, F.lit(False))
    return table.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & ~diverges).alias("kept"), "nearest", "distance")
