"""Token and type counts, type/token ratios, composition by part of speech, corpus checks.

Ratios are NULL where their denominator is 0.  Standardised ratios cut the running text into chunks of
``window`` selected tokens, drop the rest and average; the running text of a corpus or group crosses documents in
(doc_id, position) order.  Its numbering takes no global sort: a document's start is a sum of sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.storage import stored

from .kwic import let

#: Rows that are sent to the executors whole.
MOST_SENT = 200_000
#: Documents in a block of the two-step running sum.
BLOCK = 4096


def select_tokens(tokens: DataFrame, include_function_words: bool) -> DataFrame:
    return tokens if include_function_words else tokens.where(~F.col("is_function"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _running(counts: DataFrame, groups: list[str]) -> DataFrame:
    """counts (groups, doc_id, n) + start: how many tokens of the group stand in documents before."""
    c = counts.withColumn("__block", F.floor(F.col("doc_id") / BLOCK))
    blocks = c.groupBy(*groups, "__block").agg(F.sum("n").alias("m"))
    first = blocks.withColumn("__first", F.sum("m").over(Window.partitionBy(*groups).orderBy("__block")) - F.col("m")).drop("m")
    on = F.lit(True)
    for g in [*groups, "__block"]:
        on = on & c[g].eqNullSafe(first[g])
    inside = Window.partitionBy(*(c[g] for g in groups), c["__block"]).orderBy("doc_id")
    joined = c.join(first, on)
    return joined.select(*(c[g] for g in groups), "doc_id", (F.col("__first") + F.sum("n").over(inside) - F.col("n")).alias("start"))


def numbered_words(rows: DataFrame, unit: str = "lemma", include_function_words: bool = False, groups: tuple[str, ...] = ()) -> DataFrame:
    """groups, doc_id, k, unit: the selected tokens of ``annotate.in_rows``, numbered within their row."""
    chosen = F.col("t") if include_function_words else F.filter("t", lambda x: ~x["is_function"])
    words = F.transform(chosen, lambda x: x[unit])
    return rows.select(*groups, "doc_id", F.posexplode(words).alias("k", unit))


def chunk_means(selected: DataFrame, unit: str, window: int, groups: list[str]) -> DataFrame:
    """groups + sttr, for groups with at least one full chunk.  selected: groups, doc_id, unit and k (the token's number in
    its document) or, where that must be found by a sort, position."""
    in_doc = F.col("k") if "k" in selected.columns else F.row_number().over(Window.partitionBy("doc_id").orderBy("position")) - 1
    rows = selected.select(*groups, "doc_id", F.col(unit).alias("w"), in_doc.alias("k"))
    if groups == ["doc_id"]:
        placed = rows.withColumn("chunk", F.floor(F.col("k") / window))
    else:
        starts = _running(selected.groupBy(*groups, "doc_id").agg(F.count("*").alias("n")), groups).select(F.col("doc_id").alias("__doc"), "start")
        placed = rows.join(starts, F.col("doc_id") == F.col("__doc")).withColumn("chunk", F.floor((F.col("start") + F.col("k")) / window))
    chunks = placed.groupBy(*groups, "chunk").agg(F.count("*").alias("n"), F.count_distinct("w").alias("t")).where(F.col("n") == window)
    return chunks.groupBy(*groups).agg((F.sum("t") / F.count("*") / window).alias("sttr"))


def standardized_ttr(tokens: DataFrame, unit: str = "lemma", include_function_words: bool = False, window: int = 1000) -> DataFrame:
    """One row; NULL if there is no full chunk.  tokens: a table, or selected words from ``numbered_words``."""
    if window <= 0:
        return tokens.sparkSession.range(1).select(F.lit(None).cast("double").alias("sttr"))
    means = chunk_means(tokens if "k" in tokens.columns else select_tokens(tokens, include_function_words), unit, window, [])
    return means.agg(F.first("sttr").alias("sttr"))


def basic_stats(tokens: DataFrame, unit: str = "lemma", include_function_words: bool = False, sttr_window: int = 1000, words: DataFrame | None = None) -> DataFrame:
    """words: the selected tokens from ``numbered_words``, where there are rows to take them from."""
    keep = F.lit(True) if include_function_words else ~F.col("is_function")
    # counts by word instead of distinct counts over every token; from rows, every document with tokens has one at place 0
    by_word = tokens.groupBy(F.col(unit).alias("w")).agg(F.count("*").alias("a"), F.count_if(keep).alias("n"), F.count_if(F.col("position") == 0).alias("begins"))
    one = by_word.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_tokens_all"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count_if((F.col("n") > 0) & F.col("w").isNotNull()).alias("n_types"), F.coalesce(F.sum("begins"), F.lit(0)).alias("n_documents"))
    if words is None:
        one = one.drop("n_documents").crossJoin(F.broadcast(tokens.agg(F.count_distinct("doc_id").alias("n_documents"))))  # one row each
    both = one.crossJoin(F.broadcast(standardized_ttr(words if words is not None else tokens, unit, include_function_words, sttr_window)))
    return both.select("n_tokens_all", "n_tokens", "n_types", ratio(F.col("n_types"), F.col("n_tokens")).alias("ttr"), "sttr", F.lit(sttr_window).cast("long").alias("sttr_window"), "n_documents")


def _types_in(words: Column) -> Column:
    return F.size(F.array_distinct(words)).cast("long")


def repeated_ids(rows: DataFrame) -> DataFrame:
    """doc_id of several rows, and null: documents that no row has whole, or that have no id to be met by."""
    return rows.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 OR doc_id IS NULL").select("doc_id")


def document_stats_in_rows(rows: DataFrame, sttr_window: int = 1000) -> DataFrame:
    """``per_document_stats`` of the selected words in ``annotate.word_rows``, found in a document's row.  Rows that repeat an id are
    one document and meet by a shuffle."""

    def sttr(w: Column) -> Column:
        full = F.floor(F.size(w) / sttr_window).cast("int")
        types = F.transform(F.sequence(F.lit(0), full - 1), lambda c: _types_in(F.slice(w, c * sttr_window + 1, sttr_window)))
        return F.when(full > 0, F.aggregate(types, F.lit(0).cast("long"), lambda s, x: s + x) / full / sttr_window)

    def stats(w: Column) -> Column:
        chunks = sttr(w) if sttr_window > 0 else F.lit(None).cast("double")
        return F.struct(F.size(w).cast("long").alias("n_tokens"), _types_in(w).alias("n_types"), chunks.alias("sttr"))

    def own(chosen: DataFrame) -> DataFrame:
        found = chosen.select("doc_id", let(F.col("words"), stats).alias("x")).select("doc_id", "x.*").where("n_tokens > 0")
        return found.select("doc_id", "n_tokens", "n_types", ratio(F.col("n_types"), F.col("n_tokens")).alias("ttr"), "sttr")

    again = stored(repeated_ids(rows), "repeated")
    found = own(rows)
    if n := again.count():
        known = again.select(F.col("doc_id").alias("__doc"))
        known = F.broadcast(known) if n <= MOST_SENT else known
        on = rows["doc_id"].eqNullSafe(known["__doc"])
        several = rows.join(known, on, "left_semi").select("doc_id", F.posexplode("words").alias("k", "lemma"))
        found = own(rows.join(known, on, "left_anti")).unionByName(per_document_stats(several, "lemma", True, sttr_window))
    return stored(found, "statistics").orderBy("doc_id")  # a sort asks for its rows twice


def group_stats_in_rows(rows: DataFrame, group: str, sttr_window: int = 1000) -> DataFrame:
    """``per_group_stats`` of the selected words in ``annotate.word_rows``, which carry the group.  Types are summed before they are shuffled; of a
    chunk each document sends the distinct words of its piece, and of a whole one their number."""
    rows = stored(rows.select(F.col(group).alias("group"), "doc_id", "words").where(F.size("words") > 0), "words")
    if repeated_ids(rows.select("doc_id")).limit(1).count():
        return per_group_stats(rows.select("group", "doc_id", F.posexplode("words").alias("k", "lemma")), None, "group", "lemma", True, sttr_window)
    sizes = rows.select("group", "doc_id", F.size("words").cast("long").alias("n"))
    counts = sizes.groupBy("group").agg(F.count("doc_id").alias("n_documents"), F.sum("n").alias("n_tokens"))
    words = rows.select("group", F.explode(F.array_distinct("words")).alias("w")).groupBy("group", "w").agg(F.count("*").alias("k"))
    counts = counts.join(words.groupBy("group").agg(F.count("*").alias("n_types")).withColumnRenamed("group", "__t"), F.col("group").eqNullSafe(F.col("__t")))
    starts = stored(_running(sizes, ["group"]).select(F.col("doc_id").alias("__doc"), "start"), "starts")
    side = F.broadcast(starts) if starts.count() <= MOST_SENT else starts
    placed = rows.join(side, F.col("doc_id").eqNullSafe(F.col("__doc")))

    def pieces(w: Column) -> Column:
        def piece(c: Column) -> Column:
            begin = F.greatest(c * sttr_window - F.col("start"), F.lit(0)).cast("int")
            end = F.least((c + 1) * sttr_window - F.col("start"), F.size(w)).cast("int")
            own = F.array_distinct(F.slice(w, begin + 1, end - begin))
            whole = end - begin == sttr_window
            return F.struct(c.alias("chunk"), (end - begin).alias("n"), F.when(whole, F.size(own)).alias("t"), F.when(~whole, own).alias("w"))

        first, last = F.floor(F.col("start") / sttr_window), F.floor((F.col("start") + F.size(w) - 1) / sttr_window)
        return F.transform(F.sequence(first, last), piece)

    cut = placed.select("group", F.explode(let(F.col("words"), pieces)).alias("p")).select("group", "p.*")
    chunks = cut.groupBy("group", "chunk").agg(F.sum("n").alias("n"), F.max("t").alias("t"), F.collect_list("w").alias("w")).where(F.col("n") == sttr_window)
    chunks = chunks.select("group", F.coalesce("t", _types_in(F.flatten("w"))).alias("t"))
    means = chunks.groupBy("group").agg((F.sum("t") / F.count("*") / sttr_window).alias("sttr")).withColumnRenamed("group", "__g")
    joined = counts.join(means, F.col("group").eqNullSafe(F.col("__g")), "left")
    return joined.select("group", "n_documents", "n_tokens", "n_types", ratio(F.col("n_types"), F.col("n_tokens")).alias("ttr"), "sttr").orderBy("group")


def per_document_stats(tokens: DataFrame, unit: str = "lemma", include_function_words: bool = False, sttr_window: int = 1000) -> DataFrame:
    """tokens: a table, or selected words from ``numbered_words``."""
    selected = tokens if "k" in tokens.columns else select_tokens(tokens, include_function_words)
    counts = selected.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_distinct(unit).alias("n_types"))
    means = chunk_means(selected, unit, sttr_window, ["doc_id"])
    return counts.join(means, "doc_id", "left").select("doc_id", "n_tokens", "n_types", ratio(F.col("n_types"), F.col("n_tokens")).alias("ttr"), "sttr").orderBy("doc_id")


def per_group_stats(tokens: DataFrame, documents: DataFrame | None, group: str, unit: str = "lemma", include_function_words: bool = False, sttr_window: int = 1000) -> DataFrame:
    """A null group is a row of its own.  tokens: a table, or selected words from ``numbered_words``; documents: where tokens
    do not carry the group."""
    selected = tokens if "k" in tokens.columns else select_tokens(tokens, include_function_words)
    place = "k" if "k" in tokens.columns else "position"
    if group in tokens.columns:
        selected = selected.select(F.col(group).alias("group"), "doc_id", place, unit)
    else:
        selected = selected.join(documents.select("doc_id", F.col(group).alias("group")), "doc_id", "left").select("group", "doc_id", place, unit)
    counts = selected.groupBy("group").agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_tokens"), F.count_distinct(unit).alias("n_types"))
    means = chunk_means(selected, unit, sttr_window, ["group"]).withColumnRenamed("group", "__g")
    return counts.join(means, F.col("group").eqNullSafe(F.col("__g")), "left").select("group", "n_documents", "n_tokens", "n_types", ratio(F.col("n_types"), F.col("n_tokens")).alias("ttr"), "sttr").orderBy("group")


def pos_composition(tokens: DataFrame, include_function_words: bool = True) -> DataFrame:
    counts = select_tokens(tokens, include_function_words).groupBy("pos").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("pos", "count", ratio(F.col("count"), F.col("total")).alias("ratio")).orderBy(F.desc("count"), "pos")


def corpus_summary(tokens: DataFrame, documents: DataFrame, language: str, unit: str = "lemma") -> DataFrame:
    # counts by word, summed before the shuffle, instead of distinct counts over every token
    each = F.col("n") if "n" in tokens.columns else F.lit(1).cast("long")  # tokens: a table, or tokens counted by type
    words = tokens.groupBy(F.col(unit).alias("w")).agg(F.sum(each).alias("n"), F.sum(F.when(~F.col("is_function"), each).otherwise(0)).alias("c"))
    known = F.col("w").isNotNull()
    one = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count_if(known).alias("n_types"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_tokens_content"), F.count_if(known & (F.col("c") > 0)).alias("n_types_content"))
    return documents.agg(F.count("*").alias("n_documents")).crossJoin(F.broadcast(one)).withColumn("language", F.lit(language))


def document_sizes(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens."""
    return tokens.groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


def tokens_per_document(sizes: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Documents with at least one token.  sizes: tokens, or documents with n_tokens (``annotate.token_counts``)."""
    if "n_tokens" not in sizes.columns:
        sizes = document_sizes(sizes)
    return (sizes if documents is None else documents.join(sizes, "doc_id")).where("n_tokens > 0")


def group_sizes(tokens: DataFrame, documents: DataFrame | None, group: str) -> DataFrame:
    """Documents and tokens by group, null groups left out.  tokens: a table, or documents with n_tokens and the group."""
    if "n_tokens" in tokens.columns:
        docs = tokens.select(F.col(group).alias("group"), F.col("n_tokens").alias("n"))
    else:
        docs = documents.select("doc_id", F.col(group).alias("group")).join(document_sizes(tokens).withColumnRenamed("n_tokens", "n"), "doc_id", "left")
    out = docs.where("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
    return out.orderBy(F.desc("n_documents"), "group")


def count_parts(documents: DataFrame, part: str = "doc_id") -> DataFrame:
    return documents.agg((F.count("*") if part == "doc_id" else F.count_distinct(part)).alias("n_parts"))
