"""Secret scans: patterns find candidates, corpus-wide ownership tells live ones from examples.

Only DataFrame operations. A candidate's value is hashed; the distinct repositories and owners of
each hash over the whole corpus separate widely copied examples (many owners) from credentials
that belong to one owner. Candidates of the three base kinds are always reported; generic ones
(long mixed strings) are reported only where they are owner-specific.

Null text counts as empty, a null owner or repository as an owner or repository of its own.
Rows are told apart by a row number, so repeated ids and rows each get their own result.
Positions are code points, the end exclusive. One pass over a text leaves the lengths of its matches
and of the gaps between them; positions are running sums over the matches as rows, so that the work
of a text grows with its length and its matches, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.session import materialise

#: The base kinds in their order, and the kind that ownership decides.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
GENERIC = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "generic")
#: A value of at least this many owners is an example that people copy.
EXAMPLE_OWNERS = 3

_MATCHES = "array<struct<kind:int,gap:int,size:int,value:string>>"


def _matches(text: Column, pattern: str, kind: int, counts, value_group: int = 0) -> Column:
    """All leftmost non-overlapping matches, each with the length of the gap before it, and the
    hash of its value if that counts."""

    def match(found, value, gap):
        size = F.char_length(found).alias("size")
        hashed = F.when(counts(value), F.sha2(value, 256)).alias("value")
        return F.struct(F.lit(kind).alias("kind"), F.char_length(gap).alias("gap"), size, hashed)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)  # one more than matches
    if value_group:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
        pairs = F.zip_with(found, values, lambda f, v: F.struct(f.alias("f"), v.alias("v")))
        each = F.zip_with(pairs, gaps, lambda p, gap: match(p["f"], p["v"], gap))
    else:
        each = F.zip_with(found, gaps, lambda f, gap: match(f, f, gap))
    each = F.filter(each, lambda m: m["size"].isNotNull())
    return F.when(text.rlike(pattern), each.cast(_MATCHES)).otherwise(F.array().cast(_MATCHES))


def candidates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository_col: str = "doc_id",
    owner_col: str = "source",
) -> DataFrame:
    """(row, doc_id, repository, owner, matches) of every row: the only pass over the texts."""
    text = F.col("text")
    sources = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(repository_col).cast("string").alias("repository"),
        F.col(owner_col).cast("string").alias("owner"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    anything = F.lit(True)
    matches = F.concat(
        _matches(text, ASSIGN, 0, lambda v: F.char_length(v) >= 6, 1),
        _matches(text, ACCESS, 1, lambda v: anything),
        _matches(text, HEX, 2, lambda v: anything),
        _matches(text, GENERIC, 3, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")),
    )
    row = F.monotonically_increasing_id().alias("row")
    return materialise(
        sources.select(row, "doc_id", "repository", "owner", matches.alias("matches")), "secret-candidates"
    )


def spans_of(found: DataFrame) -> DataFrame:
    """(row, repository, owner, start, kind, end, value): one row per span that counts. Generic spans
    that touch a span of the base kinds are left out."""
    exploded = found.filter(F.size("matches") > 0).select(
        "row", "repository", "owner", F.posexplode("matches").alias("nth", "m")
    )
    each = exploded.select("row", "repository", "owner", "nth", "m.*").repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int"))
    placed = placed.filter("value IS NOT NULL").select(
        "row", "repository", "owner", (F.col("end") - F.col("size")).alias("start"), "kind", "end", "value"
    )
    # Base spans come first at a place: the farthest end so far, and the nearest start from here on.
    ahead = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"))
    behind = behind.rowsBetween(Window.unboundedPreceding, 0)
    base = F.col("kind") < 3
    marked = placed.withColumn("reach", F.max(F.when(base, F.col("end"))).over(ahead)).withColumn(
        "next", F.min(F.when(base, F.col("start"))).over(behind)
    )
    touched = (F.col("reach") > F.col("start")) | (F.col("next") < F.col("end"))
    kept = marked.filter(base | ~F.coalesce(touched, F.lit(False)))
    return materialise(kept.drop("reach", "next"), "secret-spans")


def ownership(spans: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories) of every candidate hash of the corpus."""
    held = spans.select(
        "value", F.to_json(F.struct("owner")).alias("owner"), F.to_json(F.struct("repository")).alias("repository")
    )
    by_repository = held.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories")
    )


def _judged(found: DataFrame, example_owners: int) -> DataFrame:
    """The spans to report, one per row, with their hash's owners and repositories."""
    spans = spans_of(found)
    judged = spans.drop("repository", "owner").join(ownership(spans), "value")
    judged = judged.withColumn("example", F.col("n_owners") >= example_owners)
    return judged.filter((F.col("kind") < 3) | ~F.col("example"))


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, **columns: str) -> DataFrame:
    """One row per row of docs: doc_id, `base` and `spans`, each span with its hash, the owners
    and repositories of that hash, and whether it is an example."""
    found = candidates(docs, **columns)
    span = F.struct("start", "kind", "end", "value", "n_owners", "n_repositories", "example")
    spans = _judged(found, example_owners).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    result = found.select("row", "doc_id").join(spans, "row", "left")
    empty = F.array().cast(spans.schema["spans"].dataType)
    result = result.select("row", "doc_id", F.coalesce("spans", empty).alias("spans"))
    return result.select("row", "doc_id", F.filter("spans", lambda s: s["kind"] < 3).alias("base"), "spans")


def span_text(spans: Column) -> Column:
    """`kind:start:end`, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def _united(spans: DataFrame) -> DataFrame:
    """(row, start, end): overlapping spans of a row as one."""
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    apart = F.coalesce(F.max("end").over(before) <= F.col("start"), F.lit(True))
    numbered = spans.select("row", "start", "end", apart.cast("int").alias("apart"))
    numbered = numbered.withColumn("block", F.sum("apart").over(upto))
    return numbered.groupBy("row", "block").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark in place of each span."""

    def cut(wide: Column, start: Column, end: Column) -> Column:
        return F.decode(F.substring(wide, start * 4 + 1, (end - start) * 4), "UTF-32")

    def whole(wide: Column) -> Column:
        def piece(s, k):
            before = F.when(k > 0, F.get(spans, k - 1)["end"]).otherwise(0)
            return F.concat(cut(wide, before, s["start"]), F.lit(mark))

        rest = cut(wide, F.get(spans, F.size(spans) - 1)["end"], F.char_length(text))
        return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

    # Four bytes a code point: a piece is cut out without reading what stands before it. The bytes are
    # an element of an array, which is handed on as it is; a column of bytes would be copied for each.
    return F.get(F.transform(F.array(F.encode(text, "UTF-32")), whole), 0)


def redact(docs: DataFrame, mark: str = "[SECRET]", **columns: str) -> DataFrame:
    """The documents with every span that is no example replaced by a mark; same columns and rows.

    Rows meet their spans by (id, hash of the text): rows equal in both have the same spans. Only
    columns of this operator's own stand beside the document, which travels as one.
    """
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    key = F.struct(
        F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text")
    )
    keyed = docs.select(F.struct("*").alias("doc"), key.alias("key"))
    found = candidates(
        docs.select(
            key.alias("id"),
            F.col(text_col).alias("text"),
            F.col(columns.get("repository_col", "doc_id")).alias("repository"),
            F.col(columns.get("owner_col", "source")).alias("owner"),
        ),
        id_col="id",
        text_col="text",
        repository_col="repository",
        owner_col="owner",
    )
    live = _united(_judged(found, EXAMPLE_OWNERS).filter(~F.col("example")))
    listed = live.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    hidden = found.select("row", F.col("doc_id").alias("hidden")).join(listed, "row")
    hidden = hidden.groupBy("hidden").agg(F.first("spans").alias("spans"))
    same = F.col("key.id").eqNullSafe(F.col("hidden.id")) & (F.col("key.text") == F.col("hidden.text"))
    met, text = keyed.join(hidden, same, "left"), F.col("doc")[text_col]
    new = F.when(F.col("spans").isNull(), text).otherwise(_without(text, F.col("spans"), mark))
    return met.select(F.col("doc").withField(text_col, new).alias("doc")).select("doc.*")
