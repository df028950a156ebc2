"""Quality rules: a threshold table compiled into one projection, without user functions.

Words are runs of `[^\\x20\\x09-\\x0D]`. A null text counts as empty: it has no words and is
rejected. Rows are judged one by one, so repeated rows and empty tables need no special case. No text
goes for its length, and the stop-word rule judges only texts whose language column names one of the
languages that the list covers; without that column it judges none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.columns import total, words_of

WINDOW = 8
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in that it is was for on are as with be this have from or at by not but "
    "der die das und ist nicht ein eine zu von mit den dem des im auf sich für es als auch an "
    "le la les de des et un une est que qui dans pour pas sur du au avec elle il ne se "
    "el los las del y en que por con para una su al lo como más o"
).split()
STOP_WORD_LANGUAGES = ("en", "de", "fr", "es")
#: (rule, metric, kind of bound, bound). A text is kept if no rule fails; a missing metric breaks none.
THRESHOLDS = (
    ("too_few_words", "n_words", "min", 20),
    ("short_words", "mean_word_chars", "min", 2.0),
    ("long_words", "mean_word_chars", "max", 25.0),
    ("symbols", "symbols_per_word", "max", 0.25),
    ("shouting", "shouts_per_word", "max", 0.25),
    ("few_stop_words", "stop_word_ratio", "min", 0.02),
    ("repeated_lines", "dup_line_ratio", "max", 0.5),
    ("bullet_lines", "bullet_line_ratio", "max", 0.9),
    ("ellipsis_lines", "ellipsis_line_ratio", "max", 0.5),
)


def _hashes_of_twice(hashes: Column, span: int) -> Column:
    """Hashes of runs of 2 * span words from those of span words; the runs at the end are left out."""
    joined = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + span)))
    return F.slice(joined, F.lit(1), F.size(hashes) - span)


def _repeat_positions(sorted_windows: Column) -> Column:
    """Starts of windows that equal a neighbour in the sorted list, ascending."""

    def marked(x, k):
        same = (F.get(sorted_windows, k - 1)["w"] == x["w"]) | (F.get(sorted_windows, k + 1)["w"] == x["w"])
        return F.when(F.coalesce(same, F.lit(False)), x["i"])

    return F.sort_array(F.filter(F.transform(sorted_windows, marked), lambda i: i.isNotNull()))


def _covered(starts: Column) -> Column:
    """Words in the union of the windows that begin at the given ascending starts."""
    return total(
        F.transform(
            starts,
            lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))).cast("long"),
        )
    )


def text_metrics(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per row of docs: the id and the metrics that the thresholds name."""
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    covered = F.coalesce(lang.isin(*STOP_WORD_LANGUAGES), F.lit(False))
    words = F.col("words")
    starts = F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)
    long_enough = F.col("n_words") >= WINDOW
    no_longs = F.array().cast("array<bigint>")

    def window(i):
        return F.slice(words, i + 1, WINDOW)

    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), covered.alias("covered")
    )
    split = split.select("doc_id", "text", "covered", words_of(F.col("text")).alias("words"), lines.alias("lines"))
    sized = split.withColumn("n_words", F.size("words").cast("long"))
    # Equal windows have equal hashes: only texts with a repeated hash need the windows themselves.
    # Hashes of 8 words come from hashes of 4, 2 and 1, so that a word is read once.
    hashed = sized.withColumn("hashes", F.when(long_enough, F.transform(words, lambda w: F.xxhash64(w))))
    for span in (1, 2, 4):
        hashed = hashed.withColumn("hashes", F.when(long_enough, _hashes_of_twice(F.col("hashes"), span)))
    hashed = hashed.withColumn("hashes", F.coalesce("hashes", no_longs))
    suspect = hashed.withColumn("suspect", F.size(F.array_distinct("hashes")) < F.size("hashes")).drop("hashes")
    windows = F.transform(starts, lambda i: F.struct(F.array_join(window(i), " ").alias("w"), i.alias("i")))
    ordered = suspect.withColumn("windows", F.when(F.col("suspect"), F.sort_array(windows)))
    marked = ordered.withColumn(
        "starts", F.when(F.col("suspect"), _repeat_positions(F.col("windows")))
    ).drop("windows")

    n_lines = F.size("lines")
    stop = F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    per_line = F.greatest(n_lines, F.lit(1))
    dup_lines = (n_lines - F.size(F.array_distinct("lines"))).cast("long")
    counted = marked.select(
        "doc_id",
        "n_words",
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        dup_lines.alias("n_dup_lines"),
        F.coalesce(F.when(F.col("suspect"), _covered(F.col("starts"))), F.lit(0)).cast("long").alias("n_repeat_words"),
        ((F.char_length("text") - F.char_length(F.replace("text", F.lit("!"), F.lit("")))) / per_word).alias("shouts_per_word"),
        F.when(F.col("covered"), F.size(stop) / per_word).alias("stop_word_ratio"),
        (dup_lines / per_line).alias("dup_line_ratio"),
        (F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•]"))) / per_line).alias("bullet_line_ratio"),
        (F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))) / per_line).alias("ellipsis_line_ratio"),
    )
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return counted.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / per_word,
            "symbols_per_word": F.col("n_symbols") / per_word,
        }
    )


def failed_rules(thresholds=THRESHOLDS) -> Column:
    """The names of the rules that a row of `text_metrics` breaks."""

    def broken(rule, metric, kind, bound):
        over = F.col(metric) < bound if kind == "min" else F.col(metric) > bound
        return F.when(over, F.lit(rule))

    found = F.array(*[broken(*row) for row in thresholds])
    return F.filter(found, lambda name: name.isNotNull())


def judge(
    docs: DataFrame, thresholds=THRESHOLDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Metrics, base verdict, broken rules and `kept` for every row of docs."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = text_metrics(docs, id_col, text_col, lang_col).withColumns(
        {"base_failed": base, "failed_rules": failed_rules(thresholds)}
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep(docs: DataFrame, thresholds=THRESHOLDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that no rule rejects, all columns."""
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("text"), lang.alias("lang")
    )
    # The row number keeps the filter above the projections: pushed through them, it would repeat
    # every shared expression.
    judged = judge(rows, thresholds, "row", "text").select("doc_id", "kept", F.monotonically_increasing_id().alias("n"))
    return judged.filter("kept and n >= 0").select("doc_id.*")
