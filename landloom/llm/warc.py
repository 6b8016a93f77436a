"""Content-addressed WARC archive: payload bytes once by strong digest, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from landloom.session import cut, read, scratch_path

#: Written into every record; a run's date is a parameter, so that runs can be compared byte by byte.
DATE = "2024-01-01T00:00:00Z"
END = "\r\n"
#: Slots by which tasks know the digests that repeat: a bound on what is broadcast.
SLOTS = 1 << 20


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hex SHA-1: 40 bits at a time, written in base 32 with digits 0-9A-V and then renamed."""
    part = lambda k: F.lpad(F.conv(F.substring(hex_digest, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(k) for k in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column, kind: Column) -> Column:
    """A UUID made from what the record is, the same in every run."""
    h = F.md5(F.concat_ws("|", kind, F.coalesce(page_id.cast("string"), F.lit("null"))))
    cut = [F.substring(h, *at) for at in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def headers(page: Column, url: Column, kind: Column, digest: Column, size: Column, refers: Column, date: str = DATE) -> Column:
    """The header block of a record up to and with its empty line. Line ends in a URL, which would end the line, are percent-coded."""
    clean = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = kind == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id(page, kind)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(refers, F.lit("response")))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page: "), refers.cast("string"))),
        F.when(page.isNotNull(), F.concat(F.lit("X-Page: "), page.cast("string"))),
        F.concat(F.lit("X-Payload-Length: "), size.cast("string")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(size.cast("string"))),
    ]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END))


def write(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> None:
    """Archive all pages below ``path``: payloads (sha256, payload), each payload once, and records (sha256, header, stored).

    Of records with equal payloads of ``least`` bytes or more that of the greatest id is the response and the others revisit it, storing no payload
    of their own; each smaller one is a response. Where rows repeat the greatest id with the same payload, the one of the smallest URL is the response and the others
    revisit it. Null payloads are empty; a null id is less than any other; an empty table gives empty archives; other columns are left out. Which digests repeat is
    counted first, and only payloads that do move, so distinct ones are written from where they are read.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("page", "url", "payload", F.sha2("payload", 256).alias("sha256"))
    narrow = cut(rows.select("page", "url", "sha256", base32(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("size")))
    each = narrow.groupBy("sha256", "page").agg(F.count("*").alias("n"))  # before digests meet, so that a common payload is a few rows a task
    first = cut(each.groupBy("sha256").agg(F.max("page").alias("first"), F.sum("n").alias("n"), F.max_by("n", F.struct(F.col("page").isNotNull(), "page")).alias("top")))
    told = narrow.join(first, "sha256")
    leading = F.col("page").eqNullSafe(F.col("first")) & (F.col("size") >= least)
    alone = (F.col("size") < least) | F.col("page").eqNullSafe(F.col("first"))
    # Rows that repeat the greatest id are numbered among themselves; there are few.
    tied = told.where(leading & (F.col("top") > 1)).withColumn("alone", F.row_number().over(Window.partitionBy("sha256").orderBy("url")) == 1)
    told = told.where(~(leading & (F.col("top") > 1))).withColumn("alone", alone).unionByName(tied)
    kind = F.when(F.col("alone"), F.lit("response")).otherwise(F.lit("revisit"))
    header = headers(F.col("page"), F.col("url"), kind, F.col("sha1"), F.col("size"), F.col("first"), date)
    told.select("sha256", header.alias("header"), F.col("alone").alias("stored")).write.parquet(f"{path}/records")
    # A payload that no other record shares is stored from where it is read. Digests that repeat are told to all tasks by their slot, of which there
    # are SLOTS at most; only payloads of those slots move, and of these only rows of the greatest id bear the payload.
    slot = F.pmod(F.xxhash64("sha256"), F.lit(SLOTS)).cast("int")
    shared = F.broadcast(first.where("n > 1").select(slot.alias("slot")).distinct())
    held = rows.select("sha256", "page", "payload").withColumn("slot", slot)
    keys = first.where("n > 1").select(F.col("sha256").alias("s"), F.col("first").alias("p"))
    contested = held.join(shared, "slot", "left_semi")
    sole = contested.select("sha256", "page", "payload").join(keys.select("s"), F.col("sha256") == F.col("s"), "left_anti").select("sha256", "payload")
    bearing = contested.select("sha256", "page", "payload").join(keys, (F.col("sha256") == F.col("s")) & F.col("page").eqNullSafe(F.col("p")), "left_semi")
    kept = held.join(shared, "slot", "left_anti").select("sha256", "payload").unionByName(sole).unionByName(bearing.select("sha256", "payload").dropDuplicates(["sha256"]))
    kept.write.option("compression", "zstd").parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The store's (sha256, payload); reading a payload whose bytes don't have its digest is an error."""
    store = spark.read.parquet(f"{path}/payloads")
    wrong = F.concat(F.lit("payload doesn't match its digest "), F.col("sha256"))
    held = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(wrong).cast("binary"))
    return store.select("sha256", held.alias("payload"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records rebuilt: (header, payload, record). ``payload`` is the full one; ``record`` are the exact bytes, in which a revisit has none. Empty archives give no rows."""
    joined = spark.read.parquet(f"{path}/records").join(payloads(spark, path), "sha256")
    body = F.when(F.col("stored"), F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n"))
    return joined.select("header", "payload", record.alias("record"))


def field(header: Column, name: str) -> Column:
    """A field of a header block; null if it isn't there."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)", 1)
    return F.when(found != "", found)


def parsed(rebuilt: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as the bytes of rebuilt records say.

    Digest and length are those of the body that the record holds, for a revisit those of the payload that it refers to. A record whose header says
    another digest, payload length or content length is an error.
    """
    size = F.octet_length("header")
    body = F.col("record").substr(size + 1, F.octet_length("record") - size - 4)
    head = F.col("record").substr(F.lit(1), size).cast("string")
    read_back = rebuilt.select(head.alias("head"), body.alias("body"), "payload").withColumn("kind", field(F.col("head"), "WARC-Type"))
    full = F.when(F.col("kind") == "revisit", F.col("payload")).otherwise(F.col("body"))
    found = read_back.select("head", "kind", F.octet_length("body").alias("content"), F.octet_length(full).cast("long").alias("bytes"), base32(F.sha1(full)).alias("digest"))
    said = lambda name: field(F.col("head"), name)
    right = (said("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("digest"))) & (said("X-Payload-Length").cast("long") == F.col("bytes")) & (said("Content-Length").cast("long") == F.col("content"))
    checked = F.when(right, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("a record isn't what its header says: "), F.col("head"))).cast("string"))
    return found.select(
        said("X-Page").cast("long").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        checked.alias("payload_digest"),
        F.col("kind").alias("record_type"),
        said("X-Refers-To-Page").cast("long").alias("refers_to"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(read(spark, sf_dir, "pages"), path)
    return parsed(records(spark, path))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS first FROM p),
b AS (SELECT *, list_transform(range(32), lambda k: ('0x' || substr(hex || '0', (k * 5) // 4 + 1, 2))::INTEGER) AS two FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (two[k + 1] // (1 << (3 - (k * 5) % 4))) % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
