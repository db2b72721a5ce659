"""WARC archives as a chunked record table.

Writing: payloads are cut into chunks of at most ``CHUNK`` characters, and each
chunk is one record: the first is the ``response``, further ones are
``continuation`` records of the same segmented payload (WARC/1.1 segmentation).
A chunk also ends inside every ``WARC/1.1`` of a payload, so that text never
occurs inside a block and marks record starts beyond doubt. A record is one row
of Spark's text writer; the archive is plain text split anywhere by the reader.

Reading: the archive is split at record starts into rows; headers are parsed
into (record id, chunk number, chunk). A payload of one chunk is digested as
it is; longer ones stream through a task in chunk order with one running
SHA-1 and a byte count, so no whole record is ever held.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with
the largest id is the response and the others are ``revisit`` records without
a block, which name it; smaller payloads are always written out.

Defined results: a null payload is empty; a null id is written as an empty
record name and read back as null, it counts as smaller than any other; rows
that repeat an id and payload are records of their own, and all rows with the
largest id are responses; an empty table gives empty archives and no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspots.operators.joins import broadcast_if_small

#: Characters of payload in one record, and the payload size from which copies become revisits.
CHUNK = 1 << 18
REVISIT_BYTES = 1000

_MARK = "WARC/1.1"
_START = _MARK + "\r\n"
_END = "\r\n\r\n"


# -- digests over chunk rows ------------------------------------------------------

def chunk_rows(records: DataFrame, payload: str, chunk: int = CHUNK) -> DataFrame:
    """Columns of ``records`` but the payload, plus n_chunks, chunk_no, chunk:
    at most ``chunk`` characters each, and no chunk holds ``WARC/1.1``: the line
    end behind a block must not complete a record start."""
    text = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    safe = F.split(text, "(?<=WARC)(?=/1\\.1)")

    def cut(part: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(part) - 1, F.lit(0)) / chunk).cast("int")),
                           lambda i: F.substring(part, i * chunk + 1, F.lit(chunk)))

    plain = (F.length(text) <= chunk) & ~F.contains(text, F.lit(_MARK))
    chunks = F.when(plain, F.array(text)).otherwise(F.flatten(F.transform(safe, cut)))
    rest = [c for c in records.columns if c != payload]
    return (records.select(*[F.col(f"`{c}`") for c in rest], chunks.alias("_chunks"))
            .select(*[F.col(f"`{c}`") for c in rest], F.size("_chunks").alias("n_chunks"),
                    F.posexplode("_chunks").alias("chunk_no", "chunk")))


def payload_digests(chunks: DataFrame, key: str) -> DataFrame:
    """(key, payload_bytes, payload_digest) of every record of a chunk table.
    Records of several chunks are sorted into chunk order and digested as they
    stream by."""
    whole = (chunks.filter("n_chunks = 1")
             .select(F.col(key), F.octet_length("chunk").cast("long").alias("payload_bytes"),
                     F.sha1(F.col("chunk").cast("binary")).alias("payload_digest")))
    split = (chunks.filter("n_chunks > 1").select(key, "chunk_no", "chunk")
             .repartition(key).sortWithinPartitions(key, "chunk_no").select(key, "chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, digest = None, 0, None
        kind = None

        def rows(done):
            keys, sizes, digests = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(sizes, pa.int64()), pa.array(digests)],
                                              names=[key, "payload_bytes", "payload_digest"])

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for k, c in zip(batch.column(0), batch.column(1)):
                if digest is None or k.as_py() != now:
                    if digest is not None:
                        done.append((now, size, digest.hexdigest()))
                    now, size, digest = k.as_py(), 0, hashlib.sha1()
                raw = c.as_py().encode()
                size += len(raw)
                digest.update(raw)
            if done:
                yield rows(done)
        if digest is not None:
            yield rows([(now, size, digest.hexdigest())])

    kind = chunks.schema[key].dataType.simpleString()
    return whole.union(split.mapInArrow(run, f"{key} {kind}, payload_bytes long, payload_digest string"))


# -- writing -----------------------------------------------------------------------------

def _header(kind: Column, record: Column, *fields: tuple[str, Column]) -> Column:
    lines = [F.lit(_START), F.lit("WARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <urn:record:"), record, F.lit(">")]
    for name, value in fields:
        lines += [F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value.cast("string")), F.lit(""))]
    return F.concat(*lines, F.lit(_END))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", payload: str = "html",
                   chunk: int = CHUNK) -> None:
    """One (segmented) record per row of ``pages`` under the folder ``path``."""
    rows = pages.select(F.col(f"`{page_id}`").alias("id"),
                        F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("payload"))
    keyed = rows.select("id", "payload", F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("h"))
    # copies are found by length and hash first, then by SHA-1 of the few rows that share both
    shared = (keyed.filter(F.col("size") >= REVISIT_BYTES).groupBy("size", "h")
              .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")).checkpoint()
    keyed = keyed.join(broadcast_if_small(shared.withColumn("again", F.lit(True))), ["size", "h"], "left")
    keyed = keyed.select("id", "payload", F.when(F.col("again"), F.sha1(F.col("payload").cast("binary"))).alias("copy"))
    first = (keyed.filter("copy is not null").groupBy("copy")
             .agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1 and first is not null").drop("n")).checkpoint()
    typed = (keyed.join(broadcast_if_small(first), "copy", "left")
             .select("id", "payload", F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(),
                                                 F.lit(False)).alias("again"), "first", "copy")
             # each row is a record of its own, whatever its id
             .withColumn("name", F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("/"), F.expr("uuid()"))))
    chunks = chunk_rows(typed.withColumn("payload", F.when(~F.col("again"), F.col("payload"))), "payload", chunk)
    segmented = F.col("n_chunks") > 1
    size = F.octet_length("chunk")
    kind = (F.when(F.col("again"), "revisit").when(F.col("chunk_no") > 0, "continuation").otherwise("response"))
    record = F.concat("name", F.lit("/"), F.col("chunk_no").cast("string"))
    text = F.concat(
        _header(kind, record,
                ("WARC-Payload-Digest", F.when(F.col("again"), F.concat(F.lit("sha1:"), "copy"))),
                ("WARC-Refers-To", F.when(F.col("again"), F.col("first"))),
                ("WARC-Segment-Number", F.when(segmented, F.col("chunk_no") + 1)),
                ("WARC-Segment-Origin-ID", F.when(segmented, F.col("name"))),
                ("WARC-Segment-Count", F.when(segmented, F.col("n_chunks"))),
                ("Content-Type", F.lit("text/html; charset=utf-8")),
                ("Content-Length", size)),
        "chunk", F.lit("\r\n"))
    chunks.select(text.alias("value")).write.option("lineSep", "\r\n").text(path)


# -- reading -----------------------------------------------------------------------------

def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives under ``path``: record, id,
    kind (response, revisit or continuation), refers_to, copy_digest, n_chunks,
    chunk_no, chunk. A block whose length differs from its header is an error."""
    raw = spark.read.option("lineSep", _START).text(path).filter(F.length("value") > 0)
    cut = F.instr("value", _END)
    head = F.substring(F.col("value"), F.lit(1), cut + 1)
    rest = F.substring(F.col("value"), cut + 4, F.length("value"))

    def field(name: str) -> Column:
        found = F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head")), rf"\r\n{name}: ([^\r]*)\r\n", 1)
        return F.when(found != "", found)

    parsed = raw.select(head.alias("head"), F.substring(rest, F.lit(1), F.length(rest) - len(_END)).alias("chunk"))
    bad = F.octet_length("chunk") != field("Content-Length").cast("int")
    name = F.regexp_extract(field("WARC-Record-ID"), "^<urn:record:(.*)/[0-9]+>$", 1)
    named = parsed.withColumn("record", name)
    return named.select(
        "record", _id_of("record").alias("id"), field("WARC-Type").alias("kind"),
        field("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(F.coalesce(field("WARC-Payload-Digest"), F.lit("")), "^sha1:(.*)$", 1).alias("copy_digest"),
        F.coalesce(field("WARC-Segment-Count").cast("int"), F.lit(1)).alias("n_chunks"),
        (F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk_no"),
        F.when(bad, F.raise_error(F.lit("block length differs from Content-Length"))).otherwise(F.col("chunk")).alias("chunk"))


def summarise(table: DataFrame) -> DataFrame:
    """Per record: id, payload_bytes, payload_digest (of the full payload, a
    revisit's from the response it names), record_type, refers_to."""
    digests = payload_digests(table.filter("kind != 'revisit'"), "record")
    responses = digests.select(_id_of("record").alias("id"), "payload_bytes", "payload_digest",
                               F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    again = table.filter("kind = 'revisit'").select("id", "refers_to", "copy_digest")
    named = (responses.select(F.col("id").alias("named"), "payload_bytes", "payload_digest")
             .join(again.select(F.col("refers_to").alias("named")).distinct(), "named", "left_semi").distinct())
    revisits = (again.join(named, (again.refers_to == named.named) & (again.copy_digest == named.payload_digest))
                .select("id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))
    return responses.union(revisits)


def _id_of(record: str) -> Column:
    found = F.regexp_extract(record, "(?s)^(.*)/", 1)
    return F.when(found != "", found)
