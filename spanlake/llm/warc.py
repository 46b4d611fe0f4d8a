"""WARC archives: writing records as files, reading them back by boundary-chain verification.

Writing: one record per page through Spark's text writer, whose line separator is the
blank line that ends a WARC record. Pages with equal payloads of ``REVISIT_BYTES`` or
more are stored once; the others are revisits that name the record with the payload.

Reading: Spark's text reader splits files at the record magic, wherever it stands. Each
piece is a candidate record with its offset in the (uncompressed) file and, from its
header's length, the offset of its successor. Pointer jumping from the file's start
doubles the known part of the chain in each round of equi-joins and keeps only what is
reachable, so a magic inside a payload is no record, whatever follows it. Only
numbers take part in that; payloads stay where they were read, and are digested there.
The pieces of a payload that holds a magic are put together again, record by record.
Those that look like records themselves are read a second time for that, and known by
file and content: the order in which a second reading meets them says nothing.

Defined results: a null payload is empty; a null page id or url is an absent
header; among equal payloads the largest id is the response (without any id all are
responses); repeated rows give a record each; a record that a file's end cuts off is
no candidate; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.tables import is_small, split_by_keys, write_scratch
from spanlake.session import Rounds, scratch_path

REVISIT_BYTES = 1000
# Fixed values of the format.
MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _plain(value: Column) -> Column:
    """A header value without line breaks."""
    return F.regexp_replace(value, r"[\r\n]+", " ")


def decided(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest and, for revisits, the id of the page that has the payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload"), "digest": F.sha1(F.col("payload").cast("binary")), "hash": F.xxhash64("payload")})
    equal = F.sha2("payload", 256).alias("equal")
    shared = rows.where(F.col("n") >= REVISIT_BYTES).select("page_id", "hash", equal).groupBy("equal", "hash")
    shared = shared.agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1 AND first_id IS NOT NULL")
    shared = write_scratch(shared.select("equal", "hash", "first_id"), "shared-payloads")
    stay, asked = split_by_keys(rows, F.col("r.hash"), shared.select("hash"))
    asked = asked.withColumn("equal", equal).join(shared.drop("hash").hint("merge"), "equal", "left").drop("equal")
    rows = stay.withColumn("first_id", F.lit(None).cast("long")).unionByName(asked)
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return rows.withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id", "hash")


def record(rows: DataFrame) -> Column:
    """The text of each record without the blank line that ends it."""
    urn = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.col("digest"), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", _plain(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )


def write(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archives under ``path``, one per task."""
    rows = decided(pages)
    rows.select(record(rows).alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def numbered(df: DataFrame) -> DataFrame:
    """(file, nth, value): pieces between magics with their order in the file, which holds for one reading only."""
    nth = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select(F.col("_metadata.file_path").alias("file"), nth.alias("nth"), "value")


def candidates(df: DataFrame) -> DataFrame:
    """One row per piece between magics: file, number, sizes, header fields, digest of a whole payload.

    ``body`` is kept only for pieces that are no whole record: parts of payloads that hold
    a magic, and what follows a false one.
    """
    value = F.col("value")
    split = F.instr(value, END)
    head = F.when(split > 0, F.substring(value, F.lit(1), split - 1))
    field = lambda name, what: F.nullif(F.regexp_extract(F.col("head"), rf"(?m)^{name}: {what}\r?$", 1), F.lit(""))
    rows = numbered(df).select(
        "file",
        "nth",
        value,
        F.octet_length(value).cast("long").alias("n"),
        head.alias("head"),
    )
    rows = rows.withColumns(
        {
            "type": field("WARC-Type", r"(\w+)"),
            "length": F.expr(r"try_cast(nullif(regexp_extract(head, '(?m)^Content-Length: (\\d{1,15})\\r?$', 1), '') AS BIGINT)"),
            "id": field("WARC-Record-ID", r"<([^>]*)>"),
            "refers": field("WARC-Refers-To", r"<([^>]*)>"),
            "claimed": field("WARC-Payload-Digest", r"sha1:(\S+)"),
            "head_n": F.octet_length("head").cast("long"),
        }
    )
    # From one record's start to the next one's.
    span = len(MAGIC) + F.col("head_n") + len(END) + F.col("length") + len(END)
    real = F.col("type").isNotNull() & F.col("length").isNotNull()
    rows = rows.withColumn("span", F.when(real, span)).withColumn("whole", F.coalesce(F.col("span") == F.col("n") + len(MAGIC), F.lit(False)))
    body = F.col("value").cast("binary")
    payload = F.substring(body, (F.col("head_n") + len(END) + 1).cast("int"), F.col("length").cast("int"))
    return rows.select(
        "file", "nth", "n", "type", "id", "refers", "claimed", "head_n", "length", "span", "whole",
        F.when(F.col("whole"), F.sha1(payload)).alias("digest"),
        F.when(F.col("whole"), F.sha1("head")).alias("head_digest"),
        F.when(~F.col("whole"), body).alias("body"),
    )


def reachable(nodes: DataFrame) -> DataFrame:
    """The (file, at) that a chain from 0 of its file reaches, over nodes (file, at, next).

    Pointer jumping: after round r every node's pointer is 2^r records further on, and
    2^r records of each file are known. Pointers past the last record fall away.
    """
    rounds = Rounds("chain")
    state = rounds.keep(nodes.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("reached")))
    while state.where("jump IS NOT NULL").limit(1).count():
        hit = state.where("reached AND jump IS NOT NULL").select("file", F.col("jump").alias("at"), F.lit(True).alias("hit")).distinct()
        far = state.select("file", F.col("at").alias("jump"), F.col("jump").alias("further"), F.lit(True).alias("real"))
        state = rounds.keep(
            state.join(hit.hint("merge"), ["file", "at"], "left")
            .join(far.hint("merge"), ["file", "jump"], "left")
            .select("file", "at", F.when(F.col("real"), F.col("further")).alias("jump"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached"))
        )
    return state.where("reached").select("file", "at")


def read(df: DataFrame) -> DataFrame:
    """One row per verified record of the archives that ``lines`` opened: id, type, refers, claimed, bytes, digest."""
    pieces = write_scratch(candidates(df), "candidates")
    order = Window.partitionBy("file").orderBy("nth")
    # The n bytes of a piece follow a magic, but for the first piece of a file.
    at = F.sum(F.col("n") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    narrow = pieces.drop("body").withColumn("at", F.coalesce(at, F.lit(0)) - len(MAGIC))
    total = F.max(F.col("at") + F.col("n") + len(MAGIC)).over(Window.partitionBy("file"))
    placed = write_scratch(narrow.withColumn("total", total), "placed")
    nodes = placed.where("span IS NOT NULL AND at >= 0 AND at + span <= total").select("file", "at", (F.col("at") + F.col("span")).alias("next"))
    known = reachable(nodes)
    # A million rows of one file's places take a few MB of a file and hundreds as a broadcast.
    found = placed.join(known.hint("merge"), ["file", "at"])
    fields = ["id", "type", "refers", "claimed", F.col("length").alias("bytes")]
    done = found.where("whole").select(*fields, "digest")
    broken = found.where("NOT whole")
    if not broken.limit(1).count():
        return done
    return done.unionByName(_assembled(df, pieces, placed, broken, fields))


def _assembled(df: DataFrame, pieces: DataFrame, placed: DataFrame, broken: DataFrame, fields: list) -> DataFrame:
    """Records whose payload holds a magic, from their pieces.

    Pieces that look like whole records but are payload are read again.
    """
    marks = write_scratch(_covering(placed, broken, fields), "broken")
    parts = marks.where("NOT whole").join(pieces.where("body IS NOT NULL").select("file", "nth", "body"), ["file", "nth"])
    forged = marks.where("whole")
    if forged.limit(1).count():
        bodies = _read_again(df, forged)
        parts = parts.unionByName(forged.join(bodies, ["file", "n", "head_digest", "digest"]).select(parts.columns))
    magic = F.lit(MAGIC).cast("binary")
    whole = parts.groupBy("file", "start").agg(
        *[F.first(c).alias(c) for c in ("head_n", "id", "type", "refers", "claimed", "bytes", "stop")],
        F.array_sort(F.collect_list(F.struct("piece", "body"))).alias("parts"),  # one record's bytes
    )
    text = F.aggregate("parts", F.lit("").cast("binary"), lambda a, x: F.when(F.length(a) == 0, x["body"]).otherwise(F.concat(a, magic, x["body"])))
    whole = whole.withColumn("text", text)
    complete = F.length("text") + len(MAGIC) >= F.col("stop") - F.col("start")
    payload = F.substring("text", (F.col("head_n") + len(END) + 1).cast("int"), F.col("bytes").cast("int"))
    digest = F.when(complete, F.sha1(payload)).otherwise(F.raise_error(F.concat(F.lit("parts missing of "), F.col("id"))).cast("string"))
    return whole.select("id", "type", "refers", "claimed", "bytes", digest.alias("digest"))


def _read_again(df: DataFrame, forged: DataFrame) -> DataFrame:
    """(file, n, head_digest, digest, body) of the pieces with these contents, each content once."""
    sizes = forged.select("file", "n").distinct()
    rows = df.select(F.col("_metadata.file_path").alias("file"), "value").withColumn("n", F.octet_length("value").cast("long"))
    rows = rows.join(F.broadcast(sizes) if is_small(sizes) else sizes, ["file", "n"], "left_semi")
    at = F.instr("value", END)
    body = F.col("value").cast("binary")
    head_n = F.octet_length(F.substring("value", F.lit(1), at - 1))
    payload = F.substring(body, head_n + len(END) + 1, (F.col("n") - head_n - 2 * len(END)).cast("int"))
    keyed = rows.where(at > 0).select(
        "file", "n", F.sha1(F.substring("value", F.lit(1), at - 1)).alias("head_digest"), F.sha1(payload).alias("digest"), body.alias("body")
    )
    keys = forged.select("file", "n", "head_digest", "digest").distinct()
    return keyed.join(keys, ["file", "n", "head_digest", "digest"], "left_semi").dropDuplicates(["file", "n", "head_digest", "digest"])


def _covering(placed: DataFrame, broken: DataFrame, fields: list) -> DataFrame:
    """Pieces with the broken record they belong to: the last one that starts at or before them."""
    marks = broken.select("file", "at", (F.col("at") + F.col("span")).alias("stop"))
    starts = placed.join(marks, ["file", "at"], "left").withColumn("start", F.when(F.col("stop").isNotNull(), F.col("at")))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spread = starts.select(
        "file", "nth", "whole", "n", "head_digest", "digest", F.col("at").alias("piece"), F.last("start", ignorenulls=True).over(before).alias("start"), F.last("stop", ignorenulls=True).over(before).alias("stop")
    ).where("piece < stop")
    return spread.join(broken.select("file", F.col("at").alias("start"), "head_n", *fields), ["file", "start"])


def lines(spark, path: str) -> DataFrame:
    """Archives split at every magic, with the source's metadata at hand."""
    return spark.read.option("lineSep", MAGIC).text(path)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); revisits have the payload of what they name.

    Fails where a payload does not have the digest that its record claims.
    """
    records = write_scratch(records, "records")
    page = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d*):", 1), F.lit("")).cast("long")
    own = records.where("type = 'response'")
    of = own.groupBy(F.col("id").alias("of")).agg(F.first("bytes").alias("of_bytes"), F.first("digest").alias("of_digest"))
    of = write_scratch(of, "responses")  # so that a payload with very many copies is split in the join
    back = records.where("type = 'revisit'").join(of.hint("merge"), F.col("refers") == F.col("of"), "left")
    both = own.select("id", "type", F.lit(None).cast("string").alias("refers"), "claimed", "bytes", "digest").unionByName(
        back.select("id", "type", "refers", "claimed", F.col("of_bytes").alias("bytes"), F.col("of_digest").alias("digest"))
    )
    sound = F.when(F.col("digest") == F.col("claimed"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload digest of "), F.col("id"))).cast("string"))
    return both.select(
        page("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), sound.alias("payload_digest"), F.col("type").alias("record_type"), page("refers").alias("refers_to")
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    return resolved(read(lines(spark, path)))
