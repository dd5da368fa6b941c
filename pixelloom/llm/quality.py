"""Quality rules: cross-document line frequency, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import SPACE, documents, fresh, staged, words

#: A line goes if at least so many documents of its host have it ...
MIN_DOCS = 50
#: ... and more than this share of the host's documents.
MAX_SHARE = 0.005
#: A document goes if its frequent lines hold more than this share of its words.
MAX_REMOVED = 0.7
#: Base rules.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Parts that the rows of one line are split into where they meet the frequent lines.
SALTS = 8


def base_features(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of ``docs`` with the counts of the base rules.

    All counts come from arrays within the row, so nothing is shuffled. Windows
    are compared by 64-bit hash; only texts that repeat a window sort them.
    """
    text = F.coalesce("text", F.lit(""))
    step = docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_hash"),
        F.col(host).alias("host"),
        words(F.col("text")).alias("ws"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    step = step.select(
        "doc_id", "text_hash", "host", "n_symbols",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"),
    )
    # A run of 2, 4, then 8 words is hashed from its halves; too short texts end with no run.
    for k in (1, 2, 4):
        left = F.size("hs") - k
        step = step.withColumn("hs", F.when(left > 0, F.zip_with(F.slice("hs", F.lit(1), left), F.slice("hs", F.lit(k + 1), left), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))
    step = step.withColumn(
        "sorted",
        F.when(
            F.size("hs") > F.size(F.array_distinct("hs")),
            F.sort_array(F.transform("hs", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))),
        ),
    ).drop("hs")
    twice = F.filter(
        F.transform(
            "sorted",
            lambda x, k: F.when((F.get(F.col("sorted"), k - 1)["h"] == x["h"]) | (F.get(F.col("sorted"), k + 1)["h"] == x["h"]), x["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.aggregate(
        F.sort_array(twice),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    step = step.withColumn("n_repeat_words", F.when(F.col("sorted").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("sorted")
    return step.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def line_rows(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row per line with a word: doc_id, text_hash, host, hash ``h`` of the normalised line, its place and words."""
    clean = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, SPACE, " "))))
    hashed = F.transform(F.filter(F.transform(clean, lambda x, i: F.struct(x.alias("l"), i.alias("pos"))), lambda x: x["l"] != ""), lambda x: F.struct(F.xxhash64(x["l"]).alias("h"), x["pos"].alias("pos"), (F.length(x["l"]) - F.length(F.replace(x["l"], F.lit(" "), F.lit(""))) + 1).cast("long").alias("w")))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.col(host).alias("host"), F.explode(hashed).alias("x"))
    return rows.select("doc_id", "text_hash", "host", "x.h", "x.pos", "x.w")


def frequent_lines(rows: DataFrame, docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """The (host, h) of the lines in ``rows`` that more documents of the host have than the limits allow.

    Documents of equal text are one document here, for lines and for hosts.
    Distinct (host, line, document) are found first, so a line that a third of
    all documents have is counted in many tasks.
    """
    once = rows.groupBy("host", "h", "text_hash").agg(F.lit(1).alias("one"))
    counts = once.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    texts = docs.select(F.col(host).alias("of"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).distinct()
    hosts = texts.groupBy("of").agg(F.count("*").alias("docs"))
    return counts.join(hosts, counts["host"].eqNullSafe(hosts["of"])).where(F.col("n") > max_share * F.col("docs")).select("host", "h")


def verdicts(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """The rows of ``quality`` with ``text_hash``, ``host`` and ``gone``, the places of the frequent lines (null: none)."""
    rows = staged(line_rows(docs, host), "lines")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    bad = frequent_lines(rows, docs, host, min_docs, max_share).select(F.col("host").alias("bad_host"), F.col("h").alias("bad_h"), salt)
    hit = rows.join(bad, (rows["h"] == bad["bad_h"]) & rows["host"].eqNullSafe(bad["bad_host"]) & (F.pmod(rows["text_hash"], F.lit(SALTS)) == bad["salt"]))
    #: Rows of one text can be repeated: a set of places counts each line once.
    hit = hit.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), F.col("host").alias("hit_host")).agg(F.collect_set(F.struct("pos", "w")).alias("hits"))
    out = base_features(docs, host)
    out = out.join(hit, out["doc_id"].eqNullSafe(hit["hit_id"]) & (out["text_hash"] == hit["hit_hash"]) & out["host"].eqNullSafe(hit["hit_host"]), "left")
    out = out.withColumn("n_removed_words", F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["w"]), F.lit(0).cast("long")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= max_removed * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "text_hash", "host", F.col("hits.pos").alias("gone"))


def quality(docs: DataFrame, **limits) -> DataFrame:
    """Base counts and the verdict ``kept`` for each row of ``docs``.

    Lines are normalised (lower case, white space squeezed) and hashed, distinct
    documents are counted per host and line, words of lines above the limits are
    counted as removed, and a document is rejected if they are more than
    ``max_removed`` of its words; ``keep_good`` takes the lines out of the texts.
    Documents are told apart by their text: exact copies count once.
    Cases: a null text has no words and fails the base rules; a null host is a
    host; a count at a limit is not above it (no ties to break); a text of any
    length is read whole, its words and lines as arrays of one row; rows with
    the same doc_id, text and host get the same verdict, and repeated rows stay;
    an empty table gives an empty result; other columns of ``docs`` are not read.
    """
    return verdicts(docs, **limits).drop("host", "gone")


def keep_good(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, without their frequent lines; other columns are as they were.

    Cases are those of ``quality``: rows with a null text go, as it has no
    words; repeated rows stay or go together; lines are taken from texts of any
    length; an empty table stays empty; columns of any name pass through.
    """
    of = verdicts(docs, host, **limits).where(~F.col("kept") | F.col("gone").isNotNull())
    names = [fresh(f"of_{c}", docs) for c in ("doc_id", "text_hash", "host", "kept", "gone")]
    id_, hash_, host_, kept, gone = names
    of = of.select("doc_id", "text_hash", "host", "kept", "gone").toDF(*names).dropDuplicates([id_, hash_, host_])
    both = docs.join(of, docs["doc_id"].eqNullSafe(of[id_]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == of[hash_]) & docs[host].eqNullSafe(of[host_]), "left")
    both = both.where(F.coalesce(kept, F.lit(True)))
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return both.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest)).select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).drop("text_hash")
