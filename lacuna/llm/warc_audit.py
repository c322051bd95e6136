"""WARC fixity audit with Merkle trees.

``records`` lays pages out as WARC response records: each file holds the pages of one range of ids, in order, and each record has its byte
range.  A file of more than ``FILE_PAGES`` different pages (unknown or repeated ids) goes on in further volumes; equal pages travel as one row
with their number until they are laid out.

``audit`` compares two replicas.  A record's place in its file's tree is a key of what it is a record of (id and address), never of its content or
position: a page that changes, grows or goes touches the nodes above it and no other record's.  Slots at the bottom hash their records, ordered ranges
of ``FANOUT`` slots are hashed into parents, up to one root for each file; each level is written once, both replicas together, and made from the one below.
Roots are compared, then only the children of nodes that differ; records are read in the slots that are left.  A slot's digest is made of sums of
its records' digests, so a slot that many records share is no group of one task.  ``read`` gives the records of WARC bytes, so stored files can be
audited, too.

Everything is done with DataFrame functions only.

Defined cases: null html or url count as empty; a null page_id belongs to file -1; equal rows are told apart by their number; a record that one replica
lacks is a finding with a null digest on that side (so are a whole file's); where one record of an id and address differs, it is one finding with both
digests, where several do, each is a finding of its own; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.operators.ranks import placed

from ._spark import mapped, materialize, table

#: Pages whose ids lie in one range of this many make a file; children of a tree's node.
FILE_PAGES, FANOUT = 4096, 1 << 4
#: The day that records state (fixed, as the pages have none).
DATE = "1970-01-01T00:00:00Z"
#: Bits of a key, and of a tree's level.
KEY_BITS, STEP = 60, 4
_LANES = 8


def record_id(url: Column, page_id: Column) -> Column:
    """A record's id, made of what it is a record of."""
    h = F.md5(F.concat(url, F.lit(" "), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def body_of(url: Column, html: Column, page_id: Column) -> Column:
    """The bytes of a page's record."""
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "), record_id(url, page_id), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame) -> DataFrame:
    """file, volume, record (0, 1, ... there), page_id, offset, length, digest, key and name of each page's WARC record.

    ``name`` is a hash of id and address; ``key`` orders a file's records: by id within its range and a hash of the address.
    """
    url, html, page_id = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("page_id").cast("long")
    body = body_of(url, html, page_id)
    inside = F.pmod(page_id, F.lit(FILE_PAGES).cast("long")) * (1 << 48) + F.shiftrightunsigned(F.xxhash64(url), 16)
    made = pages.select(
        page_id.alias("page_id"),
        F.coalesce(F.floor(page_id / FILE_PAGES), F.lit(-1)).cast("long").alias("file"),
        F.octet_length(body).cast("long").alias("length"),
        F.sha2(body, 256).alias("digest"),
        F.coalesce(inside, F.shiftrightunsigned(F.xxhash64(url), 64 - KEY_BITS)).alias("key"),
        F.xxhash64(page_id, url).alias("name"),
    )
    same = ["file", "key", "name", "digest", "page_id", "length"]
    made = made.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"))
    # places by ranges: no file is one task, and no volume holds more than FILE_PAGES rows
    placed_ = placed(made, ["file"], ["key", "name", "digest"], "place")
    placed_ = placed_.withColumn("volume", F.floor((F.col("place") - 1) / FILE_PAGES).cast("long"))
    before = W.partitionBy("file", "volume").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    first = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0)).cast("long")
    laid = placed_.select("file", "volume", "page_id", "length", "digest", "key", "name", first("copies").alias("record"), first(F.col("copies") * F.col("length")).alias("offset"), "copies")
    each = laid.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select(
        "file", "volume", (F.col("record") + F.col("k")).alias("record"), "page_id", (F.col("offset") + F.col("k") * F.col("length")).alias("offset"), "length", "digest", "key", "name"
    )


def tree(both: DataFrame) -> list[DataFrame]:
    """Levels of the trees, roots first, from records with a ``side`` and the ``height`` of their file: side, file, node, height, offset, length, digest.

    A node is a prefix of keys; its offset and length are those of the records below it.  Each level is written, and the next one is made from it.
    """
    lane = lambda k: F.sum(F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long"))
    slots = both.groupBy("side", "file", "height", F.expr(f"shiftright(key, cast({KEY_BITS} - {STEP} * height as int))").alias("node")).agg(
        F.min("offset").alias("offset"), F.sum("length").alias("length"), F.sha2(F.concat_ws("|", F.count(F.lit(1)), *[lane(k) for k in range(_LANES)]), 256).alias("digest")
    )
    slots = materialize(slots.select("side", "file", "node", "height", "offset", "length", "digest"))
    levels: list[DataFrame] = []
    for level in range(slots.agg(F.max("height")).first()[0] or 0, -1, -1):
        here = slots.where(F.col("height") == level)
        if levels:
            children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # FANOUT at most
            text = F.array_join(F.transform(children, lambda x: F.concat(F.hex(x["node"]), F.lit(":"), x["digest"])), "")
            above = levels[-1].groupBy("side", "file", F.shiftright("node", STEP).alias("node"), "height").agg(
                F.min("offset").alias("offset"), F.sum("length").alias("length"), F.sha2(text, 256).alias("digest")
            )
            here = materialize(here.unionByName(above))
        levels.append(here)
    return levels[::-1]


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records that differ in the second replica: file, volume, record, offset, length, digest, replica_digest, page_id.

    Both are tables of ``records``.  A record that one replica lacks has a null digest on that side, and stands where the other has it.
    """
    both = materialize(first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1))))
    most = both.groupBy("file", "side").agg(F.count(F.lit(1)).alias("n")).groupBy("file").agg(F.max("n").alias("n"))
    # a slot for each page of an ordinary file; a larger file has more levels, the same in both replicas
    more = F.ceil(F.log(F.greatest(F.col("n") / FILE_PAGES, F.lit(1.0))) / F.log(F.lit(float(FANOUT))))
    heights = materialize(most.select("file", F.least(F.lit(3) + more, F.lit(KEY_BITS // STEP)).cast("int").alias("height")))
    high = both.join(heights, "file")
    levels = tree(high)
    bottom, differing = None, None
    for level, nodes in enumerate(levels):
        if differing is not None:  # only the children of nodes that differ are read
            above = differing.where(F.col("height") > level - 1).select("file", F.col("node").alias("above"))
            nodes = nodes.withColumn("above", F.shiftright("node", STEP)).join(above, ["file", "above"], "left_semi")
        side = lambda k: F.max(F.when(F.col("side") == k, F.col("digest")))
        differing = materialize(nodes.groupBy("file", "node", "height").agg(side(0).alias("ours"), side(1).alias("theirs")).where(~F.col("ours").eqNullSafe(F.col("theirs"))))
        ended = differing.where(F.col("height") == level).select("file", "node")
        bottom = ended if bottom is None else bottom.unionByName(ended)
    slot = F.expr(f"shiftright(key, cast({KEY_BITS} - {STEP} * height as int))")
    suspect = high.withColumn("node", slot).join(bottom, ["file", "node"], "left_semi")
    # copies of one page lie side by side: of those that the other replica lacks, the last ones are named
    of = lambda k, x: x(F.when(F.col("side") == k, 1))
    same = suspect.groupBy("file", "name", "page_id", "digest", "length").agg(
        of(0, F.count).alias("n0"), of(1, F.count).alias("n1"), *[F.min(F.when(F.col("side") == k, F.struct("volume", "record", "offset"))).alias(f"at{k}") for k in (0, 1)]
    ).where("n0 <> n1")
    ours = F.col("n0") > F.col("n1")
    same = same.select("file", "name", "page_id", "digest", "length", (~ours).cast("int").alias("side"), F.when(ours, F.col("at0")).otherwise(F.col("at1")).alias("at"), F.explode(F.sequence(F.least("n0", "n1"), F.greatest("n0", "n1") - 1)).alias("k"))
    left = materialize(same.select("file", "name", "page_id", "side", "digest", "length", "at.volume", (F.col("at.record") + F.col("k")).alias("record"), (F.col("at.offset") + F.col("k") * F.col("length")).alias("offset")))
    counts = left.groupBy("file", "name").agg(F.count_if(F.col("side") == 0).alias("c0"), F.count_if(F.col("side") == 1).alias("c1"))
    met = left.join(counts, ["file", "name"])
    one = (F.col("c0") == 1) & (F.col("c1") == 1)
    place = ["volume", "record", "offset", "length"]
    changed = met.where(one).groupBy("file", "name", "page_id").agg(*[F.max(F.when(F.col("side") == 0, F.col(c))).alias(c) for c in [*place, "digest"]], F.max(F.when(F.col("side") == 1, F.col("digest"))).alias("replica_digest"))
    alone = met.where(~one).select("file", "page_id", *place, *[F.when(F.col("side") == k, F.col("digest")).alias(n) for k, n in ((0, "digest"), (1, "replica_digest"))])
    columns = ["file", *place, "digest", "replica_digest", "page_id"]
    return changed.select(*columns).unionByName(alone.select(*columns)).select("file", "volume", "record", "offset", "length", "digest", "replica_digest", "page_id")


_READ = "file string, record long, offset long, length long, digest string, record_id string, url string, complete boolean"


def read(files: DataFrame) -> DataFrame:
    """The records of WARC bytes (file, content): byte range, digest of the whole record, id and address.

    Records are found one after another by their Content-Length.  Bytes that are not a record, and a record that breaks off, end the
    file with one row that is not complete; null or empty bytes have no records.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = n = 0
                data = data or b""
                while at < len(data):
                    head = data.find(b"\r\n\r\n", at)
                    said = dict(x.split(b":", 1) for x in data[at:head].split(b"\r\n")[1:] if b":" in x) if head > 0 and data.startswith(b"WARC/", at) else {}
                    said = {k.strip().lower(): v.strip() for k, v in said.items()}
                    size = said.get(b"content-length", b"")
                    end = head + 4 + int(size) + 4 if size.isdigit() else len(data) + 1
                    sound = end <= len(data)
                    own = data[at : min(end, len(data))]
                    rows.append((name, n, at, len(own), hashlib.sha256(own).hexdigest(), *(said[k].decode("utf-8", "replace") if k in said else None for k in (b"warc-record-id", b"warc-target-uri")), sound))
                    at, n = end, n + 1
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])

    return mapped(files.select(F.col("file").cast("string").alias("file"), F.col("content").cast("binary").alias("content")), run, _READ)


def decayed(pages: DataFrame) -> DataFrame:
    """A replica in which some pages have lost a character: those whose content's hash ends in '00'."""
    hit = F.endswith(F.sha2(F.col("html"), 256), F.lit("00"))
    return pages.select("page_id", "url", F.when(hit, F.concat(F.lit("?"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")).alias("html"))


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record (byte range and digest) with what the audit of a decayed replica says of it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    laid = materialize(records(pages))
    found = audit(laid, records(decayed(pages))).where("digest is not null").select("file", "volume", "record", F.lit(True).alias("found"))
    out = laid.join(found, ["file", "volume", "record"], "left")
    return out.select("page_id", "file", "volume", "record", "offset", "length", "digest", F.coalesce("found", F.lit(False)).alias("corrupt"))


def _body(html: str) -> str:
    h = "md5(url || ' ' || page_id)"
    part = lambda a, n: f"substr({h}, {a}, {n})"
    name = f"'<urn:uuid:' || {part(1, 8)} || '-' || {part(9, 4)} || '-' || {part(13, 4)} || '-' || {part(17, 4)} || '-' || {part(21, 12)} || '>'"
    line = " || chr(13) || chr(10) || "
    return (
        f"'WARC/1.1'{line}'WARC-Type: response'{line}'WARC-Record-ID: ' || {name}{line}'WARC-Date: {DATE}'{line}'WARC-Target-URI: ' || url"
        f"{line}'Content-Type: text/html'{line}'Content-Length: ' || CAST(strlen({html}) AS VARCHAR){line}chr(13) || chr(10) || {html}{line}chr(13) || chr(10)"
    )


ORACLE_SQL = f"""
WITH made AS (
  SELECT page_id, page_id // {FILE_PAGES} AS file, url, html, {_body('html')} AS body FROM pages
)
SELECT page_id, CAST(file AS BIGINT) AS file, CAST(0 AS BIGINT) AS volume,
  row_number() OVER w - 1 AS record,
  CAST(sum(strlen(body)) OVER w - strlen(body) AS BIGINT) AS "offset",
  strlen(body) AS length, sha256(body) AS digest,
  sha256(html) LIKE '%00' AND html <> '?' || substring(html, 2) AS corrupt
FROM made WINDOW w AS (PARTITION BY file ORDER BY page_id, url ROWS UNBOUNDED PRECEDING)
"""
