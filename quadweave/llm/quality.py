"""Quality rules and a hashed n-gram log-likelihood ratio, in built-in expressions only.

Words and pairs of neighbouring words are hashed into a fixed number of cells. The counts of the cells
over trusted documents and over the whole raw corpus are two multinomials, each smoothed by one; the
mean over a text's n-grams of the log of their ratio says how much likelier the trusted source is than
the raw corpus to have written it. A document is kept if it passes the base rules and that mean is at
least a fixed threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import WHITE, WHITE_CHARS, others, whole

#: Cells of the hashed n-grams: what is gathered from the corpus is one count per cell.
CELLS = 1 << 16
#: Least mean log-likelihood ratio of a kept document.
THRESHOLD = -0.2
#: Trusted identifiers are broadcast up to this many; beyond, they meet the documents in a shuffle.
BROADCAST_IDS = 1_000_000
# The characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though ``body`` uses it inside loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE + "+"), lambda w: w != "")


def ngrams(words: Column, cells: int = CELLS) -> Column:
    """The cells of all words and of all pairs of neighbours."""
    last = F.size(words) - 1
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(cells)))
    pairs = F.transform(
        F.slice(words, 1, F.greatest(last, F.lit(0))), lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(cells))
    )
    return F.concat(single, pairs)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that stand in a window of ``width`` words found twice or more in the text, first included."""

    def covered(at: Column) -> Column:
        gain = F.transform(at, lambda p, i: F.when(i == 0, width).otherwise(F.least(F.lit(width), p - F.get(at, i - 1))))
        return F.aggregate(gain, F.lit(0), lambda a, b: a + b)

    def places(ordered: Column) -> Column:
        same = lambda e, i, step: F.coalesce(F.get(ordered, i + step)["h"] == e["h"], F.lit(False))
        twice = F.filter(ordered, lambda e, i: ((i > 0) & same(e, i, -1)) | same(e, i, 1))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def of(hashes: Column) -> Column:
        numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        found = let(let(F.sort_array(numbered), places), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)

    starts = F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(0)))
    windows = F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)]))
    return let(windows, of)


def weights(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", cells: int = CELLS) -> list[float] | None:
    """The log-likelihood ratio of every cell, or None without a trusted n-gram.

    ``trusted`` has the identifiers of the trusted documents in its first column; nulls, repeats and
    unknown ones do no harm. Counts run over all documents and whole texts; what reaches the driver
    is one row per cell.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("_id")).filter(F.col("_id").isNotNull()).distinct()
    ids = ids.withColumn("_trusted", F.lit(1))
    few = len(ids.select(F.lit(1)).limit(BROADCAST_IDS + 1).groupBy().count().filter(F.col("count") <= BROADCAST_IDS).take(1)) > 0
    texts = docs.select(F.col(doc_id).alias("_doc"), whole(text).alias("_text"))
    marked = texts.join(F.broadcast(ids) if few else ids, F.col("_doc") == F.col("_id"), "left")
    cell = F.explode(let(words_of(F.col("_text")), lambda w: ngrams(w, cells)))
    counts = marked.select(F.coalesce("_trusted", F.lit(0)).alias("_t"), cell.alias("_cell"))
    counts = counts.groupBy("_cell").agg(F.count("*").alias("raw"), F.sum("_t").alias("trusted")).collect()
    raw, own = sum(r["raw"] for r in counts), sum(r["trusted"] for r in counts)
    if not own:
        return None
    base = math.log(raw + cells) - math.log(own + cells)
    ratios = [base] * cells
    for r in counts:
        ratios[r["_cell"]] = round(math.log(r["trusted"] + 1) - math.log(r["raw"] + 1) + base, 4)
    return ratios


def judge(
    docs: DataFrame, ratios: list[float] | None, text: str = "text", threshold: float = THRESHOLD, cells: int = CELLS
) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    Columns of ``docs`` with one of these names are replaced. A null text has no words, so it fails the
    base rules, like an empty one. Texts of any length are judged whole, every row by itself, so ties
    and repeated rows get the same verdict. Without ``ratios`` (no trusted document) scores are zero
    and the base rules decide.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole(text).alias("body"))
    body = F.col("body")
    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.translate(line, WHITE_CHARS, "")) > 0)
    table = None if ratios is None else F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")

    def measure(words: Column) -> Column:
        total = F.lit(0.0)
        if table is not None:
            total = F.aggregate(ngrams(words, cells), F.lit(0.0), lambda a, cell: a + F.get(table, cell.cast("int")))
        return F.struct(F.size(words).alias("n"), repeated_words(words).alias("r"), total.alias("llr"))

    found = rows.withColumn("found", let(words_of(body), measure))
    count, repeats = F.col("found.n"), F.col("found.r")
    failed = (count < 10) | (100 * repeats > 20 * count)
    mean = F.when(count == 0, 0.0).otherwise(F.col("found.llr") / (2 * count - 1))
    measured = {
        "n_words": count.cast("long"),
        "word_chars": F.length(F.translate(body, WHITE_CHARS, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeats.cast("long"),
        "base_failed": failed,
        "score": mean,
        "kept": ~failed & (mean >= threshold),
    }
    return found.select(*others(docs, measured), *[x.alias(name) for name, x in measured.items()])
