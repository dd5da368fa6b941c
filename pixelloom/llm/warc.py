"""WARC archives: written by Spark's text sink, read back by boundary-chain verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import drop_path, drop_table, maybe_among, new_path, staged

#: Fixed values of the WARC 1.0 format.
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Payloads of fewer bytes are never written as revisits.
MIN_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"


def _plan(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that repeat the payload of a larger page_id."""
    meta = pages.select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("n"), F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest")).where(F.col("n") >= min_bytes).drop("n")
    first = meta.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return meta.join(first, "digest").where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) to archives under ``path``.

    Of equal payloads of ``min_bytes`` or more, the row with the largest page_id
    is a response and the others revisit it. Payloads are the UTF-8 bytes of the
    html (null: empty); a record is one row of the text sink, whose line
    separator is the end of a record. Responses are written where they are read:
    only rows that a filter of bounded size takes for a repeat are joined.
    """
    plan = staged(_plan(pages, min_bytes).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to"), "repeats")
    html = F.coalesce("html", F.lit(""))
    rows = maybe_among(pages.select("page_id", "url", "html").withColumn("digest", F.sha1(html.cast("binary"))), ["page_id", "digest"], plan, ["p", "d"])
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))
    sure = rows.where(~F.col("maybe")).withColumn("refers_to", F.lit(None).cast(plan.schema["refers_to"].dataType)).drop("maybe")
    rows = sure.unionByName(rows.where("maybe").join(plan, same, "left").drop("maybe", "p", "d"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, html))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("refers_to")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " "),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(END),
    )
    rows.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value")).write.option("lineSep", END).text(path)
    drop_table(plan)


def _parsed(value: Column) -> list[Column]:
    """Columns of a record from what follows its magic: header length, block length, fields, payload."""
    head = F.substring_index(value, END, 1)
    field = lambda k: F.nullif(F.regexp_extract(head, rf"(?im)^{k}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    return [
        (F.octet_length(head) + 4).cast("long").alias("head"),
        field("Content-Length").try_cast("long").alias("block"),
        field("WARC-Type").alias("type"),
        field("WARC-Record-ID").alias("id"),
        field("WARC-Refers-To").alias("refers"),
        field("WARC-Payload-Digest").alias("said"),
    ]


def _payload(value: str = "value") -> list[Column]:
    """Length and digest of the payload, for a value that is a whole record."""
    block = F.expr(f"substring(cast({value} as binary), cast(head + 1 as int), cast(block as int))")
    skip = (F.octet_length(F.substring_index(block.cast("string"), END, 1)) + 4).alias("skip")
    return [block.alias("bytes"), skip]


def _with_payload(rows: DataFrame) -> DataFrame:
    rows = rows.select("*", *_payload())
    body = F.expr("substring(bytes, skip + 1)")
    return rows.withColumn("payload_bytes", F.octet_length(body).cast("long")).withColumn("payload_digest", F.sha1(body)).drop("bytes", "skip")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics, with the split it begins in and its order there."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), (F.octet_length("value") + len(MAGIC)).cast("long").alias("len"))


def _offsets(chunks: DataFrame, before: DataFrame) -> DataFrame:
    """Adds ``off``, where the chunk's magic begins in the file."""
    w = Window.partitionBy("file", "split").orderBy("nth")
    return chunks.join(before, ["file", "split"]).withColumn("off", F.col("before") + F.sum("len").over(w) - F.col("len") - len(MAGIC)).drop("before")


def runs(rows: DataFrame) -> DataFrame:
    """``rows`` (file, split, nth, off, next) with ``run``: records of a split that follow each other.

    A run also begins wherever a pointer other than its predecessor's leads, so
    a chain enters runs at their first record only.
    """
    w = Window.partitionBy("file", "split").orderBy("nth")
    rows = rows.withColumn("follows", F.coalesce(F.col("next") == F.lead("off").over(w), F.lit(False)))
    targets = rows.where("not follows and next is not null").select(F.col("file").alias("t_file"), F.col("next").alias("t_off")).distinct()
    rows = rows.join(targets, (F.col("file") == F.col("t_file")) & (F.col("off") == F.col("t_off")), "left")
    begins = F.col("t_off").isNotNull() | ~F.coalesce(F.lag("follows").over(w), F.lit(False))
    return rows.withColumn("run", F.sum(begins.cast("int")).over(w)).drop("t_file", "t_off", "follows")


def reachable(candidates: DataFrame) -> DataFrame:
    """The (file, off) on the chain from offset 0, by pointer jumping.

    ``candidates`` (file, off, next). After round k, pointers lead 2^k places
    on and the first 2^k places are known; each round is two joins on the
    offset, so neither a long file nor a hot one gathers in a task.
    """
    jump = staged(candidates.where("next is not null").select("file", "off", "next"), "jump")
    known = staged(candidates.where("off = 0").select("file", "off"), "known")
    while True:
        onward = known.join(jump, ["file", "off"]).select("file", F.col("next").alias("off"))
        onward = onward.join(candidates.select("file", "off"), ["file", "off"], "left_semi")
        longer = staged(known.union(onward).distinct(), "known")
        far = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.next") == F.col("b.off"))).select("a.file", "a.off", F.col("b.next").alias("next"))
        far = staged(far, "jump")
        drop_table(jump)
        drop_table(known)
        jump, known = far, longer
        if jump.isEmpty():
            drop_table(jump)
            return known


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: file, off, type, id, refers, said, payload_bytes, payload_digest.

    Spark splits the files and cuts them at every magic; a running sum gives
    each piece its offset, and its header the offset of its successor. Records
    of a split that follow each other are first drawn together into runs. Only
    records on the chain from the start of the file are real; a magic inside a
    payload is not on it, and the pieces of such a payload are put together
    again. The text of clean records is never shuffled.
    """
    chunks = _chunks(spark, path)
    meta = chunks.select("file", "split", "nth", "len", "value", *_parsed(F.col("value")))
    whole = F.col("len") - len(MAGIC) == F.col("head") + F.col("block") + len(END)
    meta = _with_payload(meta.withColumn("whole", F.coalesce(whole, F.lit(False))))
    meta = staged(meta.drop("value"), "chunks")
    splits = meta.groupBy("file", "split").agg(F.sum("len").alias("len"))
    before = splits.select("file", "split", (F.sum("len").over(Window.partitionBy("file").orderBy("split")) - F.col("len")).alias("before"))
    rows = _offsets(meta, before).withColumn("next", F.col("off") + len(MAGIC) + F.col("head") + F.col("block") + len(END))
    rows = staged(runs(rows), "offsets")
    drop_table(meta)
    places = rows.where("off >= 0").groupBy("file", "split", "run").agg(F.min("off").alias("off"), F.max_by("next", "off").alias("next"))
    places = staged(places, "runs")
    on_chain = places.join(reachable(places), ["file", "off"], "left_semi").select("file", "split", "run")
    found = rows.where("off >= 0").join(on_chain, ["file", "split", "run"], "left_semi")
    fields = ["file", "off", "type", "id", "refers", "said", "payload_bytes", "payload_digest"]
    cut = staged(found.where(~F.col("whole")).select("file", "off", "next"), "cut")
    if cut.isEmpty():
        return found.select(fields)
    ends = cut.groupBy("file").agg(F.min("off").alias("from"), F.max("next").alias("until"))
    touched = rows.join(ends, "file").where("off < until and off + len > from").select("file", "split").distinct()
    pieces = _offsets(chunks.join(touched, ["file", "split"], "left_semi"), rows.groupBy("file", "split").agg((F.min("off") + len(MAGIC)).alias("before")))
    #: Steps of a megabyte of offsets keep this join by ranges from meeting all pieces of a file.
    step = 1 << 20
    cells = cut.select("file", F.col("off").alias("start"), "next", F.explode(F.sequence(F.floor(F.col("off") / step), F.floor(F.col("next") / step))).alias("cell"))
    pieces = pieces.select("file", "off", "value").withColumn("cell", F.floor(F.col("off") / step))
    mine = pieces.join(cells, ["file", "cell"]).where("off >= start and off < next")
    joined = mine.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("off", F.col("value").cast("binary").alias("value")))).alias("p"))
    glue = F.aggregate(F.slice("p", 2, F.size("p")), F.get("p", F.lit(0))["value"], lambda acc, x: F.concat(acc, F.lit(MAGIC.encode()), x["value"]))
    joined = joined.select("file", F.col("start").alias("off"), glue.cast("string").alias("value"))
    joined = _with_payload(joined.select("file", "off", "value", *_parsed(F.col("value"))))
    return found.where("whole").select(fields).unionByName(joined.select(fields))


def archive_digest(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives of ``pages``, reads them back and returns a row per page.

    Cases: a null html is an empty payload; a null page_id is written as such
    and revisits a page that has one; repeated rows are repeated records, all
    responses if theirs is the largest page_id (a tie); one page_id may stand
    with several payloads; payloads are one row each, of up to 2 GB; an empty
    table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    if not spark.read.text(path).select("value").isEmpty():
        records = staged(read_archives(spark, path), "records")
        drop_path(spark, path)
    else:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    number = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    rows = records.select(number(F.col("id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number(F.col("refers")).alias("refers_to"), F.regexp_replace("said", "^sha1:", "").alias("said"))
    first = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("first_id"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("n"))
    again = rows.where("record_type = 'revisit'").join(first, (F.col("refers_to") == F.col("first_id")) & (F.col("said") == F.col("d")), "left").select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")
    return rows.where("record_type = 'response'").drop("said").unionByName(again)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digest(spark.read.parquet(f"{sf_dir}/pages.parquet"))
