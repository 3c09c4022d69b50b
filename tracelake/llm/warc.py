"""WARC archives: records written and read by Spark's own text source, boundaries verified by their chain.

Reading splits the files at every ``WARC/1.0`` line, wherever it stands, so tasks need no common view of a
file. Each piece that begins with a plausible header is a candidate and names its successor's offset. Within
a task's split candidates that follow each other are folded into one node, and pointer jumping over the nodes
from each file's start keeps the reachable ones: a magic inside a payload is never reached, and its text goes
back to the record around it. Pieces are known by file and byte offset, whatever the splits, so that text
which is read a second time finds its record. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import scratch, stored

MAGIC = "WARC/1.0\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, 32 digits."""
    digest = F.sha1(payload)
    part = lambda k: F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*(part(k) for k in range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, per_file: int = 20000, broadcast_rows: int = 100_000) -> None:
    """A record for each row: response, or revisit of the smallest id with an equal payload.

    Payloads below ``revisit_bytes`` bytes are always responses. A null payload is empty; a null url gives no
    target line; control characters and blanks in it are percent-encoded. Rows with a null id are written
    without an id and are responses. Repeated rows are as much responses as the first of them. The rows that
    revisit another are broadcast only if there are at most ``broadcast_rows``; else they are joined by id.
    """
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    small = stored(own.select("id", base32_sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("bytes")), "digests")
    keyed = small.where(F.col("id").isNotNull() & (F.col("bytes") >= revisit_bytes))
    first = keyed.groupBy("digest", "bytes").agg(F.min("id").alias("to"), F.max("id").alias("last")).where(F.col("to") < F.col("last")).drop("last")
    again = stored(keyed.join(first, ["digest", "bytes"]).where(F.col("id") > F.col("to")).select("id", "digest", "to").distinct(), "revisits")
    if again.count() <= broadcast_rows:
        again = F.broadcast(again)
    again = again.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "to")
    digest, size = base32_sha1(F.col("html").cast("binary")), F.octet_length("html")
    own = own.withColumn("digest", digest).join(again, (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    url = F.col("url")
    for c in (9, 10, 13, 32):
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    url = F.regexp_replace(url, "[\\x00-\\x1F\\x7F]", "%20")
    revisit = F.col("to").isNotNull()
    block = F.concat(F.lit(_HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise("response"),
        F.lit("\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        line("WARC-Target-URI", url),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nX-Payload-Length: "),
        size.cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
        F.lit("\r\n\r"),  # and the writer's line feed
    )
    own.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


def _field(name: str) -> Column:
    found = F.regexp_extract("head", f"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics: value, file, split, and k, which rises within a split. split and k mean something within one plan only."""
    return spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("k"))


def candidates(raw: DataFrame) -> DataFrame:
    """Pieces of the files, with the head fields of those that have a head; span: how far off the successor is (null: no head)."""
    raw = raw.withColumn("bytes", F.octet_length("value").cast("long"))
    end = F.instr("value", "\r\n\r\n")
    raw = raw.withColumn("head", F.when(end > 0, F.concat(F.lit("\r\n"), F.substring(F.col("value"), F.lit(1), end - 1)))).withColumn("head_bytes", (F.octet_length("head") + 2).cast("long"))
    raw = raw.withColumn("length", F.try_to_number(F.regexp_extract("head", "(?i)\r\nContent-Length:[ \t]*([0-9]{1,15})[ \t]*(?:\r\n|$)", 1), F.lit("999999999999999")).cast("long"))
    # the payload of a piece that holds its whole record is judged here; of others the text is kept
    whole = F.col("head_bytes") + F.col("length") + 4 == F.col("bytes")
    body = F.expr("substring(value, char_length(head) + 3, char_length(value) - char_length(head) - 6)")
    raw = raw.withColumns({"whole": F.coalesce(whole, F.lit(False)), "type": F.lower(_field("WARC-Type")), "body": body})
    payload = F.expr("substring(body, locate('\r\n\r\n', body) + 4)")
    raw = raw.withColumns({"payload": F.when(F.col("whole"), payload)})
    raw = raw.select(
        "file", "split", "k", "bytes", "whole", "type",
        (F.col("head_bytes") + F.col("length") + 4 + len(MAGIC)).alias("span"),
        F.regexp_extract(_field("WARC-Record-ID"), "<urn:page:(-?[0-9]+)>", 1).alias("id"),
        F.regexp_extract(_field("WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1).alias("refers"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:([A-Z2-7]{32})", 1).alias("said"),
        _field("X-Payload-Length").alias("said_bytes"),
        base32_sha1(F.col("payload").cast("binary")).alias("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(~F.col("whole"), F.col("value")).alias("value"),
    )
    return raw


def _before(rows: DataFrame, order: str, value: Column, total, pick) -> Column:
    """``total`` of ``value`` over what stands before a row, ``pick(within its split, in earlier splits)``: no task sees a whole file."""
    inside = W.partitionBy("file", "split").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_within", total(value).over(inside))
    splits = rows.groupBy("file", "split").agg(total(value).alias("_all"))
    earlier = total("_all").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))  # a row a split
    splits = splits.select("file", "split", earlier.alias("_earlier"))
    return rows.join(splits, ["file", "split"]).withColumn("_before", pick(F.col("_within"), F.col("_earlier"))).drop("_within", "_earlier")


def placed(raw: DataFrame) -> DataFrame:
    """Pieces (file, split, k, bytes) with off, the offset of their magic; what stands before a file's first magic is no piece."""
    size = F.col("bytes") + len(MAGIC)
    at = _before(raw, "k", size, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return at.withColumn("off", F.col("_before") - len(MAGIC)).drop("_before").where("off >= 0")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_ok) of every true record.

    payload_bytes and payload_digest are of the full payload: from its text for a response, from the headers
    of a revisit. target_ok: the digest in the header is the payload's. Pieces before the first record of a
    file, and candidates the chain doesn't reach, are no records. An empty folder gives no rows.
    """
    at = placed(stored(candidates(pieces(spark, path)), "candidates")).withColumn("next", F.col("off") + F.col("span"))
    # fold runs within a split: a candidate that its predecessor names needs no jump
    line = W.partitionBy("file", "split").orderBy("off")
    at = at.withColumn("linked", F.coalesce(F.lag("next").over(line) == F.col("off"), F.lit(False)))
    at = stored(at.withColumn("run", F.last(F.when(~F.col("linked"), F.col("off")), True).over(line.rowsBetween(W.unboundedPreceding, 0))), "pieces")
    exits = at.groupBy("file", "run").agg(F.max_by("next", "off").alias("leaves")).where("leaves is not null")
    jump = exits.join(at.select("file", F.col("off").alias("leaves"), F.col("run").alias("to")), ["file", "leaves"]).select("file", "run", "to", F.col("leaves").alias("enter"))
    jump = stored(jump, "jumps")
    reached = stored(at.where("off = 0").select("file", "run", F.col("off").alias("enter")), "reached")
    n = reached.count()
    while not jump.isEmpty():
        # all that is reached jumps at once, and then every jump doubles
        ahead = reached.join(jump.select("file", "run", "to", F.col("enter").alias("e")), ["file", "run"]).select("file", F.col("to").alias("run"), F.col("e").alias("enter"))
        reached = stored(reached.union(ahead).groupBy("file", "run").agg(F.min("enter").alias("enter")), "reached")
        more = reached.count()
        if more == n:
            break
        n = more
        then = jump.select("file", F.col("run").alias("to"), F.col("to").alias("to2"), F.col("enter").alias("e2"))
        jump = stored(jump.join(then, ["file", "to"]).select("file", "run", F.col("to2").alias("to"), F.col("e2").alias("enter")), "jumps")
    done = at.join(reached, ["file", "run"], "left").withColumn("real", F.coalesce(F.col("off") >= F.col("enter"), F.lit(False)))
    clear = done.where("real and whole").select("id", "type", "refers", "said", "said_bytes", "digest", "payload_bytes")
    # a false candidate's text belongs to the record before it
    broken = stored(done.where("real and not whole").select("file", F.col("off").alias("home")), "broken")
    if not broken.isEmpty():
        there = done.join(broken.select("file").distinct(), "file", "left_semi").select("file", "split", "off", "real", "id", "type", "refers", "said", "said_bytes", "span")
        home = _before(there, "off", F.when(F.col("real"), F.col("off")), F.max, F.coalesce)
        home = home.withColumn("home", F.when(F.col("real"), F.col("off")).otherwise(F.col("_before"))).drop("_before", "split")
        clear = clear.union(_texts(pieces(spark, path), stored(home.join(broken, ["file", "home"], "left_semi"), "parts")))
    return clear.select(
        F.when(F.col("id") != "", F.col("id").cast("long")).alias("page_id"),
        F.when(F.col("type") == "revisit", F.col("said_bytes").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.col("said")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(F.col("refers") != "", F.col("refers").cast("long")).alias("refers_to"),
        ((F.col("type") == "revisit") | (F.col("said") == F.col("digest"))).alias("target_ok"),
    )


def _texts(raw: DataFrame, parts: DataFrame) -> DataFrame:
    """Records that hold a magic, put together from their pieces, which are read again. Fails if one isn't found."""
    some = raw.join(parts.select("file").distinct(), "file", "left_semi").withColumn("bytes", F.octet_length("value").cast("long"))
    found = placed(some).select("file", "off", "value")
    own = parts.join(found, ["file", "off"], "left").withColumn("value", F.coalesce("value", F.raise_error(F.concat(F.lit("no text at "), F.col("off").cast("string"), F.lit(" of "), F.col("file"))).cast("string")))
    one = own.groupBy("file", "home").agg(
        F.array_sort(F.collect_list(F.struct("off", "value"))).alias("p"),
        *(F.max(F.when(F.col("real"), F.col(c))).alias(c) for c in ("id", "type", "refers", "said", "said_bytes", "span")),
    )
    whole = F.array_join(F.transform("p", lambda x: x["value"]), MAGIC)
    one = one.withColumn("whole", whole)
    # the block ends at span; the blank lines after it, and the last piece's rest, don't count
    one = one.withColumn("block", F.expr("substring(whole, locate('\r\n\r\n', whole) + 4)"))
    one = one.withColumn("payload", F.expr("substring(block, locate('\r\n\r\n', block) + 4, char_length(block) - locate('\r\n\r\n', block) - 3 - 4)"))
    return one.select("id", "type", "refers", "said", "said_bytes", base32_sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path)
