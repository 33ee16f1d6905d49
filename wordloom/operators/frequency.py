"""Word frequencies with per-million rates and dispersion.

Rates and part sizes are over all tokens, whatever is selected.  Dispersion is half the sum, over the parts, of
|share of the word - share of the corpus|; the parts that a word lacks contribute exactly their corpus share, so only
the (word, part) pairs that occur are needed: 1/2 (sum |v - s| + 1 - sum s) over those, where sum v is 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.storage import stored

from .annotate import Annotator, runs
from .basic import ratio


def first_label(tokens: DataFrame, unit: str) -> list[Column]:
    """An aggregate ``first`` for the label of a word's first token; none where a label is the word itself.

    A minimum of structs makes Spark sort all rows of a group; most tables (those of the native annotator say
    so in the column's metadata) can do without."""
    if unit != "lemma" or tokens.schema["lemma_label"].metadata.get("same_as") == unit:
        return []
    return [F.min(F.struct("doc_id", "position", F.col("lemma_label").alias("label"))).alias("first")]


def _label(rows: DataFrame) -> list[Column]:
    return [F.min("first")["label"].alias("label")] if "first" in rows.columns else []


def _with_label(words: DataFrame) -> DataFrame:
    return words.withColumn("label", F.coalesce("label", "word") if "label" in words.columns else F.col("word"))


def counted(tokens: DataFrame) -> Column:
    """How many tokens the rows of a group are: tables counted by type (``annotate.types``) have their number in n."""
    return F.sum("n") if "n" in tokens.columns else F.count("*")


def vocabulary(selected: DataFrame, unit: str, extra: list[Column] | None = None) -> DataFrame:
    """A row for each word: freq, pos (most frequent, ties by name), label (first in text order).

    Two partial aggregations: by (word, pos), then by word; a frequent word is summed before each shuffle.
    selected: a table, or tokens counted by type."""
    return words_from(selected.groupBy(F.col(unit).alias("word"), "pos").agg(counted(selected).alias("n"), *first_label(selected, unit), *(extra or [])))


def words_from(by_pos: DataFrame) -> DataFrame:
    """A row for each word, from rows (word, pos, n, further sums)."""
    names = [c for c in by_pos.columns if c not in ("word", "pos", "n", "first")]
    words = by_pos.groupBy("word").agg(F.sum("n").alias("freq"), F.min(F.struct((-F.col("n")).alias("n"), "pos"))["pos"].alias("pos"), *_label(by_pos), *(F.sum(c).alias(c) for c in names))
    return _with_label(words)


#: Words that are sent to the executors whole.
MOST_SENT = 200_000


def _less(words: DataFrame, pairs: DataFrame, largest: int, n_parted: int, chosen: Column) -> DataFrame:
    """word, less: what dispersion adds for the parts that have less of a chosen word than the corpus; no row for words that no part lacks.

    Half the sum of |f/F - s| over the parts is 1 - share, if no part has less of the word than the corpus, else more by s - f/F for each that has.
    Only a word with over N / size occurrences can lack in a part of that size, and of those there are no more than a part has
    tokens: they meet the pairs by broadcast, but for what only parts of over MOST_SENT tokens can lack."""
    often = words.where(chosen & (F.col("freq") * F.lit(largest) > F.lit(n_parted))).select("word", "freq")
    lacking = F.col("f") * F.lit(n_parted) < F.col("freq") * F.col("size")
    sent = F.col("freq") * MOST_SENT >= F.lit(n_parted)
    met = pairs.join(F.broadcast(often.where(sent)), "word")
    if largest > MOST_SENT:
        met = met.unionByName(pairs.where(F.col("size") > MOST_SENT).join(often.where(~sent), "word"))
    less = met.where(lacking).groupBy("word").agg(F.sum(F.col("size") / F.lit(float(n_parted)) - F.col("f") / F.col("freq")).alias("less"))
    return less if largest > MOST_SENT else F.broadcast(less)


def _dp(n_parted: int) -> Column:
    return 1 - F.col("share") / F.lit(float(n_parted)) + F.coalesce("less", F.lit(0.0))


def _table(words: DataFrame, pairs: DataFrame, total: DataFrame, largest: int, n_parted: int, chosen: Column | None = None) -> DataFrame:
    """The table from stored words (word, label, pos, freq, share, n_parts) and pairs (word, f, size); without a label, the word is its own and no
    shuffle has it twice.  chosen: which words the table has (the others are ranked, no more)."""
    chosen = F.lit(True) if chosen is None else chosen
    less = _less(_with_label(words), pairs, largest, n_parted, chosen)
    out = _with_label(ranked(words)).where(chosen)
    out = (out if "label" in words.columns else out.drop("label")).join(less, "word", "left").crossJoin(F.broadcast(total)).orderBy("rank")
    return _with_label(out).select("rank", "word", "label", "pos", "freq", (F.col("freq") / F.col("n_all") * 1e6).alias("pmw"), _dp(n_parted).alias("dp"), "n_parts")


def _sums(sizes: DataFrame) -> tuple[DataFrame, int, int]:
    """One row n_all; the largest part; the tokens of all parts."""
    own = F.when(F.col("part").isNotNull(), F.col("size"))
    r = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n_all"), F.coalesce(F.max(own), F.lit(0)).alias("largest"), F.coalesce(F.sum(own), F.lit(0)).alias("n")).first()
    return sizes.sparkSession.range(1).select(F.lit(r["n_all"]).alias("n_all")), r["largest"], r["n"]


def frequency_table(tokens: DataFrame, unit: str = "lemma", include_function_words: bool = False, part: str = "doc_id") -> DataFrame:
    """rank, word, label, pos, freq, pmw, dp, n_parts.  Tokens without a part count only in the rate's denominator.

    tokens: a table, or tokens counted by type and part."""
    keep = F.lit(True) if include_function_words else ~F.col("is_function")
    # tokens are counted once, and the counts stored: part sizes, corpus size and the words all come from them
    keys = [F.col(part).alias("part"), F.col(unit).alias("word"), "pos", keep.alias("keep")]
    if "n" in tokens.columns and part == "doc_id":  # counted in documents' rows already: one shuffle, by document, does for all
        pairs = tokens.select(*keys, "n").repartition("part").groupBy("part", "word", "pos", "keep").agg(F.sum("n").alias("n"))
        pairs = stored(pairs.withColumn("size", F.sum("n").over(Window.partitionBy("part"))), "pairs")
        sizes = pairs.groupBy("part").agg(F.first("size").alias("size"))
    else:
        pairs = stored(tokens.groupBy(*keys).agg(counted(tokens).alias("n"), *first_label(tokens, unit)), "pairs")
        sizes = stored(pairs.groupBy("part").agg(F.sum("n").alias("size")), "sizes")
    total, largest, n_parted = _sums(sizes)
    kept = pairs.where("keep AND part IS NOT NULL AND word IS NOT NULL")
    by_pos = stored(kept.groupBy("word", "pos").agg(F.sum("n").alias("n"), *([F.min("first").alias("first")] if "first" in kept.columns else [])), "by-pos")
    names = words_from(by_pos).select("word", "pos", "label")
    if "size" not in kept.columns:
        kept = kept.join(F.broadcast(sizes) if sizes.count() <= MOST_SENT else sizes, "part")
    sized = _over_pos(kept.select("part", "word", F.col("n").alias("f"), "size"), by_pos)
    words = sized.groupBy("word").agg(F.sum("f").alias("freq"), F.sum("size").alias("share"), F.count("*").alias("n_parts")).join(names, "word")
    return _table(stored(words, "words"), sized, total, largest, n_parted)


def _over_pos(pairs: DataFrame, by_pos: DataFrame) -> DataFrame:
    """word, f, size: pairs (part, word, f, size), where only words of several parts of speech have to be summed."""
    several = stored(by_pos.groupBy("word").agg(F.count("*").alias("k")).where("k > 1").select("word"), "several")
    n = several.count()
    if not n:
        return pairs.drop("part")
    known = F.broadcast(several) if n <= MOST_SENT else several
    summed = pairs.join(known, "word", "left_semi").groupBy("word", "part").agg(F.sum("f").alias("f"), F.max("size").alias("size"))
    return pairs.join(known, "word", "left_anti").select("word", "f", "size").unionByName(summed.select("word", "f", "size"))


def _words_of(rows: DataFrame, by: Annotator, include_function_words: bool) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """Stored words (word, pos, freq, share, n_parts), pairs (word, f, size) and what ``_sums`` gives, of ``annotate.word_rows``."""
    found = stored(rows.select(F.col("doc_id").alias("part"), F.size("words").cast("long").alias("size"), runs(F.col("words")).alias("counts")), "counts")
    sizes = found.select("part", "size")
    repeated = stored(sizes.where("part IS NOT NULL").groupBy("part").agg(F.count("*").alias("k"), F.sum("size").alias("__size")).where("k > 1").drop("k"), "repeated")
    pairs = found.where("part IS NOT NULL").select("part", "size", F.explode("counts").alias("c")).select("part", "size", "c.word", F.col("c.n").alias("f"))
    if n := repeated.count():  # rows of one document
        known = F.broadcast(repeated) if n <= MOST_SENT else repeated
        again = pairs.join(known, "part").groupBy("part", "word").agg(F.max("__size").alias("size"), F.sum("f").alias("f"))
        pairs = pairs.join(known, "part", "left_anti").unionByName(again.select("part", "size", "word", "f"))
        sizes = sizes.groupBy("part").agg(F.sum("size").alias("size"))
    words = pairs.groupBy("word").agg(F.sum("f").alias("freq"), F.sum("size").alias("share"), F.count("*").alias("n_parts"))
    words = words.select("word", by.pos(F.col("word")).alias("pos"), "freq", "share", "n_parts")
    if not include_function_words:
        words = words.where(~F.col("pos").isin(*by.function_pos))
    return stored(words, "words"), pairs.drop("part"), *_sums(sizes)


def table_of_rows(rows: DataFrame, by: Annotator, include_function_words: bool = False, chosen: Column | None = None) -> DataFrame:
    """``frequency_table`` by document of ``annotate.word_rows``: a document's words are counted in its row, and only words, summed, are
    shuffled.  by: the annotator, whose parts of speech are those of a word, whatever its case.  chosen: which words the table has, by
    word, label, pos and freq; dispersion is found for those."""
    return _table(*_words_of(rows, by, include_function_words), chosen)


def dispersion_of_rows(rows: DataFrame, by: Annotator, include_function_words: bool = False, judged: Column | None = None) -> DataFrame:
    """word, pos, freq, dp, n_parts of ``table_of_rows``, for what needs neither rank nor order: once summed, words are not shuffled again.
    judged: of which words dispersion is found, by word, label, pos and freq; it is null for the others."""
    words, pairs, _, largest, n_parted = _words_of(rows, by, include_function_words)
    judged = F.lit(True) if judged is None else judged
    out = words.join(_less(_with_label(words), pairs, largest, n_parted, judged), "word", "left")
    return _with_label(out).select("word", "pos", "freq", F.when(judged, _dp(n_parted)).alias("dp"), "n_parts")


def words_alone(types: DataFrame, unit: str = "lemma", include_function_words: bool = False) -> DataFrame:
    """word, label, freq of the table's words, for what needs no parts: no document's words are counted apart.

    types: tokens counted by type, of documents with an id, whose labels are the words themselves (``annotate.types``)."""
    chosen = types if include_function_words else types.where(~F.col("is_function"))
    words = chosen.where(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("word")).agg(F.sum("n").alias("freq"))
    return words.select("word", F.col("word").alias("label"), "freq")


def ranked(words: DataFrame) -> DataFrame:
    """words (word, freq, ...) + rank: 1 to n by (freq descending, word), no ties.

    No single task sorts a vocabulary: a frequency class starts where the classes above it end (one row a frequency
    value), and a class is split by the words' first letters, each part again starting where those before it end."""
    w = words.withColumn("__p", F.substring("word", 1, 3))
    parts = w.groupBy("freq", "__p").agg(F.count("*").alias("n"))
    classes = parts.groupBy("freq").agg(F.sum("n").alias("m"))
    above = classes.select("freq", (F.sum("m").over(Window.orderBy(F.desc("freq"))) - F.col("m")).alias("above"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("freq").orderBy("__p")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("freq", "__p").orderBy("word"))
    placed = w.join(before, ["freq", "__p"]).join(above, "freq")
    return placed.withColumn("rank", (F.col("above") + F.col("before") + inside).cast("long")).drop("above", "before", "__p")


def with_parts(tokens: DataFrame, documents: DataFrame, part: str) -> DataFrame:
    if part == "doc_id" or part in tokens.columns:
        return tokens
    return tokens.join(documents.select("doc_id", part), "doc_id", "left")


def expand_compounds(tokens: DataFrame) -> DataFrame:
    """A row with parts becomes one for each part, at its position."""
    if "compound_parts" not in tokens.columns:
        return tokens
    part = F.explode(F.when(F.col("compound_parts") == "", F.array(F.lit(None).cast("string"))).otherwise(F.split("compound_parts", r"\+")))
    t = tokens.withColumn("__part", part)
    new = {c: F.coalesce("__part", c) for c in ("surface", "lemma", "lemma_label")} | {"compound_parts": F.lit("")}
    out = t.select(*(new.get(c, F.col(c)).alias(c) for c in tokens.columns))
    if tokens.schema["lemma_label"].metadata.get("same_as") != "lemma":
        return out
    return out.withColumn("lemma_label", F.col("lemma").alias("lemma_label", metadata={"same_as": "lemma"}))


def compounds(tokens: DataFrame) -> DataFrame:
    return tokens.where("compound_parts <> ''").groupBy("surface", "compound_parts").agg(counted(tokens).alias("count")).orderBy(F.desc("count"), "surface")


def word_distribution(tokens: DataFrame, word: str, unit: str = "lemma", part: str = "doc_id") -> DataFrame:
    """part, part_tokens, freq, pmw_in_part, share: all parts, by exact key."""
    parts = tokens.where(F.col(part).isNotNull()).groupBy(F.col(part).alias("part")).agg(F.count("*").alias("part_tokens"), F.count_if(F.col(unit) == word).alias("freq"))
    total = parts.agg(F.sum("freq").alias("total"))
    out = parts.crossJoin(F.broadcast(total))
    return out.select("part", "part_tokens", "freq", (ratio(F.col("freq"), F.col("part_tokens")) * 1e6).alias("pmw_in_part"), F.coalesce(ratio(F.col("freq"), F.col("total")), F.lit(0.0)).alias("share")).orderBy(F.desc("freq"), "part")


def zipf(frequencies: DataFrame) -> DataFrame:
    """frequencies: the table, or its words alone, which are stored and ranked."""
    if "rank" not in frequencies.columns:
        frequencies = ranked(stored(frequencies, "words")).orderBy("rank")
    return frequencies.select("rank", "freq", "word")


def shown(min_freq: int = 1, pos: str | None = None, contains: str = "") -> Column:
    """Which words ``filtered`` leaves."""
    out = F.col("freq") >= min_freq
    if pos is not None:
        out &= F.col("pos") == pos
    return out & (F.contains("label", F.lit(contains)) | F.contains("word", F.lit(contains))) if contains else out


def filtered(frequencies: DataFrame, min_freq: int = 1, pos: str | None = None, contains: str = "") -> DataFrame:
    return frequencies.where(shown(min_freq, pos, contains))


def duplicate_labels(frequencies: DataFrame) -> DataFrame:
    """How many rows share their label with another.  frequencies: the table, or its words alone."""
    same = frequencies.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    return same.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def high_frequency_cutoff(tokens: DataFrame, unit: str = "lemma", top_ratio: float = 0.01) -> DataFrame:
    """cutoff: the frequency of the k-th most frequent word, k = max(1, ceil(types * top_ratio)); 2^31 without words.

    Taken from the histogram of frequencies, not from a sorted vocabulary.  tokens: a table, or words with their freq."""
    words = tokens.where("word IS NOT NULL") if "freq" in tokens.columns else tokens.where(F.col(unit).isNotNull()).groupBy(unit).agg(counted(tokens).alias("freq"))
    freqs = words.groupBy("freq").agg(F.count("*").alias("types"))
    whole = freqs.agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("types") * F.lit(top_ratio))).alias("k"))
    upto = freqs.withColumn("upto", F.sum("types").over(Window.orderBy(F.desc("freq"))))  # a row a frequency value
    return upto.crossJoin(F.broadcast(whole)).where(F.col("upto") >= F.col("k")).agg(F.coalesce(F.max("freq"), F.lit(2**31)).alias("cutoff"))


def compare_frequency_list(frequencies: DataFrame, external: DataFrame, top: int = 30, low: float = 0.8, high: float = 1.25) -> DataFrame:
    """The external list's top words beside our counts.  external: word, freq."""
    best = external.orderBy(F.desc("freq"), "word").limit(top).select("word", F.col("freq").alias("freq_external"))
    joined = best.join(frequencies.select("word", F.col("freq").alias("freq_own")), "word", "left").withColumn("ratio", ratio(F.col("freq_own"), F.col("freq_external")))
    return joined.withColumn("in_band", F.coalesce(F.col("ratio").between(low, high), F.lit(False)))


