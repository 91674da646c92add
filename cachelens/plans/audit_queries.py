"""Identities of namespaces, audits of ring views, batch puts and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachelens.functions import identity as I
from cachelens.operators import kv
from cachelens.plans import views as V
from cachelens.plans.book import Book
from cachelens.plans.identity_queries import _NS_SQL, _framed, _le, _namespace

Q = Book()

# Namespaces: intact, cut short, with a byte too many, of an unknown pool kind, without a fingerprint, a rank beyond its axis, plain.
_AT = f"8 + 4 + strlen('t' || tenant) + 4 + strlen(ns) + 4 + 2"
_KINDS = f"""CASE doc_id % 7 WHEN 1 THEN nsb[1:octet_length(nsb) - 1] WHEN 2 THEN nsb || unhex('00') WHEN 3 THEN nsb[1:{_AT}] || unhex('0900') || nsb[{_AT} + 3:]
  WHEN 4 THEN nsb[1:octet_length(nsb) - 48] || unhex('0000000000000000') || nsb[octet_length(nsb) - 39:] WHEN 5 THEN nsb[1:octet_length(nsb) - 4] || unhex('02000000') WHEN 6 THEN encode(ns) ELSE nsb END"""


def _spoiled(spark: SparkSession, d: str) -> DataFrame:
    o = _namespace(V.objects(spark, d))
    n, b, kind = F.octet_length("nsb"), F.col("nsb"), F.col("doc_id") % 7
    at = 8 + 4 + F.octet_length(F.concat(F.lit("t"), "tenant")) + 4 + F.octet_length("ns") + 4 + 2
    cut = lambda a, size: F.substring(b, a, size)
    hex_ = lambda h: F.unhex(F.lit(h))
    out = F.when(kind == 1, cut(F.lit(1), n - 1)).when(kind == 2, F.concat(b, hex_("00"))).when(kind == 3, F.concat(cut(F.lit(1), at), hex_("0900"), cut(at + 3, n)))
    out = out.when(kind == 4, F.concat(cut(F.lit(1), n - 48), hex_("00" * 8), cut(n - 39, n))).when(kind == 5, F.concat(cut(F.lit(1), n - 4), hex_("02000000"))).when(kind == 6, F.col("ns").cast("binary"))
    return o.select("doc_id", F.explode(F.array(out.otherwise(b))).alias("bytes"))


_WHOLE = "substr(sha256(encode('DFKVTENANT1') || " + _le("octet_length(x)", 8) + " || x), 1, 16)"


@Q.add("b6_tenant_identity", f"SELECT doc_id, {_WHOLE} AS tenant_hash FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN encode('t' || tenant) ELSE {_KINDS} END AS x FROM (SELECT *, {_NS_SQL} AS nsb FROM objects))", "objects")
def tenant_identity(spark: SparkSession, d: str) -> DataFrame:
    """Tenant hash of the first field of a canonical namespace, of all bytes of any other."""
    return _spoiled(spark, d).select("doc_id", I.namespace_tenant_hash(F.col("bytes")).alias("tenant_hash"))


@Q.add("c6_canonical", "SELECT doc_id, doc_id % 7 = 0 AND tenant IS NOT NULL AND ns IS NOT NULL AS canonical FROM objects", "objects")
def canonical(spark: SparkSession, d: str) -> DataFrame:
    return _spoiled(spark, d).select("doc_id", I.canonical_tenant(F.col("bytes")).isNotNull().alias("canonical"))


@Q.add("b5_descriptor_error", """SELECT doc_id, CASE WHEN doc_id % 11 = 1 THEN 'model_id is empty or too long' WHEN doc_id % 11 = 2 THEN 'layout_fingerprint is 0' WHEN doc_id % 11 = 3 THEN 'block_tokens is 0' WHEN doc_id % 11 = 4 THEN 'layer range is empty or overflows'
  WHEN doc_id % 9 = 8 THEN 'tp rank is out of range' WHEN doc_id % 11 = 6 THEN 'component is empty or too long' WHEN doc_id % 5 >= 1 + doc_id % 6 THEN 'chunk_index is out of range' END AS error FROM objects""", "objects")
def descriptor_error(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    k = n % 11
    error = I.descriptor_error(
        {"tenant_id": F.lit("t"), "model_id": F.when(k == 1, "").otherwise("m")}, F.when(k == 2, "0" * 16).otherwise("0" * 15 + "7"), F.when(k == 3, 0).otherwise(64),
        F.when(k == 4, F.lit(0xFFFFFFFF).cast("long")).otherwise(0), F.lit(32), {"tp": (F.lit(8), n % 9), "dp": (F.lit(1), F.lit(-1))}, F.when(k == 6, F.repeat(F.lit("c"), 257)).otherwise("page"), n % 5, 1 + n % 6)
    return V.objects(spark, d).select("doc_id", error.alias("error"))


_FP = "sha256(encode('DFKVLAYOUT1') || " + _framed("'raw/v1'") + " || " + _framed("'heads'") + " || " + _framed("'int:' || doc_id % 16") + ")"
_FP_LE = "unhex(substr(f, 1, 16))"


@Q.add("b10_canonical_namespace", f"SELECT doc_id, lower(to_hex(unhex('44464b564e530002') || {_framed(chr(39) + 'default' + chr(39))} || {_framed('ns')} || {_framed('ns')} || unhex('ffff') || {_framed(chr(39) + 'raw/v1' + chr(39))} || {_framed(chr(39) + 'opaque' + chr(39))} || {_FP_LE} || unhex('01000000000000000000000001000000' || '01000000ffffffff' || '01000000ffffffff' || '01000000ffffffff'))) AS namespace_hex FROM (SELECT *, {_FP} AS f FROM objects)", "objects")
def canonical_namespace(spark: SparkSession, d: str) -> DataFrame:
    out = I.canonical_namespace(F.col("ns"), F.lit("raw/v1"), {"heads": F.concat(F.lit("int:"), F.col("doc_id") % 16)})
    return V.objects(spark, d).select("doc_id", F.lower(F.hex(out)).alias("namespace_hex"))


_AXES = " || ".join([_le("1", 4), _le("-1", 4), _le("8", 4), _le("doc_id % 8", 4), _le("1", 4), _le("0", 4), _le("1", 4), _le("0", 4), _le("1", 4), _le("0", 4)])


@Q.add("b11_pool_keys", f"SELECT doc_id, lower(to_hex(k)) AS pool_key, CASE WHEN doc_id % 4 > 0 THEN lower(to_hex(k || unhex('44464b56534702') || {_le('doc_id % 4', 4)} || {_le('doc_id % 3', 4)})) END AS scatter_key FROM (SELECT doc_id, unhex('44464b56504f4f4c02') || {_framed(chr(39) + 'kv' + chr(39))} || {_framed('object_key')} || {_AXES} || {_le('doc_id % 5', 4)} || {_framed(chr(39) + 'all' + chr(39))} AS k FROM objects)", "objects")
def pool_keys(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    k = I.pool_key(F.col("object_key"), F.lit("kv"), {"tp": (F.lit(8), n % 8)}, n % 5, F.lit("all"))
    return V.objects(spark, d).select("doc_id", F.explode(F.array(k)).alias("k")).select("doc_id", F.lower(F.hex("k")).alias("pool_key"), F.lower(F.hex(I.scatter_key(F.col("k"), n % 4, n % 3))).alias("scatter_key"))


_CHUNK = _framed("lower(to_hex(doc_id * 7919))")
_COMPONENT = _framed("CASE WHEN doc_id % 3 = 0 THEN 'all' ELSE 'layer' || doc_id % 3 END")


@Q.add("b12_chunk_keys", f"SELECT doc_id, lower(to_hex(unhex('44464b56504f4f4c02') || {_framed(chr(39) + 'kv' + chr(39))} || {_CHUNK} || {_AXES.replace('doc_id % 8', 'doc_id % 4').replace(_le('8', 4), _le('greatest(doc_id % 8, 4)', 4))} || {_le('0', 4)} || {_COMPONENT})) AS key FROM objects", "objects")
def chunk_keys(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    k = I.chunk_key(n * 7919, F.greatest(n % 8, F.lit(4)), n % 4, F.when(n % 3 > 0, n % 3))
    return V.objects(spark, d).select("doc_id", F.lower(F.hex(k)).alias("key"))


@Q.add("b24_info_fields", "SELECT id, ver, CASE WHEN num % 4 > 0 THEN 'z' || num % 4 END AS zone, NULL::VARCHAR AS host FROM members", "members")
def info_fields(spark: SparkSession, d: str) -> DataFrame:
    m = V.members(spark, d).withColumn("info", _info())
    return m.select("id", *(I.info_field(F.col("info"), k).alias(k) for k in ("ver", "zone", "host")))


def _info():  # noqa: ANN202
    zone = F.when(F.col("num") % 4 > 0, F.concat(F.lit(",zone=z"), F.col("num") % 4)).otherwise("")
    return F.concat(F.lit("ver="), "ver", zone, F.when(F.col("num") % 5 == 0, ",rack=").otherwise(",rack=r1"))


@Q.add("c11_missing_info", "SELECT id, array_to_string(list_filter([CASE WHEN num % 4 = 0 THEN 'zone' END, CASE WHEN num % 5 = 0 THEN 'rack' END], lambda x: x IS NOT NULL), ',') AS missing FROM members WHERE num % 4 = 0 OR num % 5 = 0", "members")
def missing_info(spark: SparkSession, d: str) -> DataFrame:
    """Members whose self-report lacks a required field or leaves it empty."""
    m = V.members(spark, d).withColumn("info", _info())
    absent = F.array_compact(F.array(*(F.when(F.coalesce(I.info_field(F.col("info"), k), F.lit("")) == "", k) for k in ("ver", "zone", "rack"))))
    return m.select("id", F.array_join(absent, ",").alias("missing")).where("missing <> ''")


@Q.add("b30_legacy_status", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 3 ELSE 4 END AS legacy FROM events")
def legacy_status(spark: SparkSession, d: str) -> DataFrame:
    """Status names as the older protocol's byte: quota and input errors fold into one, what is unknown is invalid."""
    names = F.array(*map(F.lit, ("ok", "not_found", "cache_full", "quota_exceeded", "io_error", "invalid", "strange")))
    byte = F.create_map(*(F.lit(x) for kv in {"ok": 0, "not_found": 1, "cache_full": 2, "quota_exceeded": 3, "io_error": 3, "invalid": 4}.items() for x in kv))
    e = V.table(spark, d, "events").select("event_id", F.get(names, (F.col("event_id") % 7).cast("int")).alias("status"))
    return e.select("event_id", F.coalesce(F.try_element_at(byte, F.col("status")), F.lit(4)).alias("legacy"))


@Q.add("c2_host_port", "SELECT s_suppkey, s_suppkey % 6 IN (0, 1) AS valid FROM supplier")
def host_port(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    address = F.when(k % 6 == 0, F.concat(F.lit("10.0.0.1:"), 1 + k % 65535)).when(k % 6 == 1, "[::1]:65535").when(k % 6 == 2, ":80").when(k % 6 == 3, "host:").when(k % 6 == 4, F.concat(F.lit("host:"), 65536 + k)).otherwise("host:8x")
    return V.table(spark, d, "supplier").select("s_suppkey", I.valid_host_port(address).alias("valid"))


# Ring views of three endpoints: m1 gives some members another weight, m2 another self-report.
V.SQL["ring_views"] = """SELECT e AS endpoint, grp, id, num, '10.0.0.' || num % 250 || ':' || (28000 + num % 100) AS address, CASE WHEN e = 'm1' AND grp = 'ASIA' AND num % 3 = 0 THEN weight + 1 ELSE weight END AS weight,
  160 * weight AS vnodes, 'ver=' || CASE WHEN e = 'm2' AND grp = 'EUROPE' THEN 'v9' ELSE ver END AS info FROM members, (SELECT unnest(['m0', 'm1', 'm2']) AS e)"""
_JSON = """'[' || string_agg('{"address":"' || address || '","info":"' || info || '","node_id":"' || id || '","vnodes":' || vnodes || ',"weight":' || weight || '}', ',' ORDER BY id) || ']'"""


def ring_views(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("num")
    m = V.members(spark, d).withColumn("endpoint", F.explode(F.array(*map(F.lit, ("m0", "m1", "m2")))))
    other = (F.col("endpoint") == "m1") & (F.col("grp") == "ASIA") & (n % 3 == 0)
    info = F.concat(F.lit("ver="), F.when((F.col("endpoint") == "m2") & (F.col("grp") == "EUROPE"), "v9").otherwise(F.col("ver")))
    return m.select("endpoint", "grp", "id", F.concat(F.lit("10.0.0."), n % 250, F.lit(":"), 28000 + n % 100).alias("address"), (F.col("weight") + F.when(other, 1).otherwise(0)).alias("weight"), (160 * F.col("weight")).alias("vnodes"), info.alias("info"))


def fingerprints(views: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint (SHA-256 of the canonical JSON of a view's members by id) and placement (the same of id, address and weight)."""
    rows = lambda *names: F.sha2(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("id", F.struct(*names).alias("m")))), lambda r: r["m"])), 256)
    return views.groupBy(*keys).agg(rows("address", "info", F.col("id").alias("node_id"), "vnodes", "weight").alias("fingerprint"), rows("address", F.col("id").alias("node_id"), "weight").alias("placement"))


@Q.add("b16_view_fingerprint", f"SELECT endpoint, grp, sha256({_JSON}) AS fingerprint FROM ring_views GROUP BY endpoint, grp", "members", "ring_views")
def view_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints(ring_views(spark, d), ["endpoint", "grp"]).select("endpoint", "grp", "fingerprint")


@Q.add("d8_view_drift", "SELECT endpoint, grp, CASE WHEN bool_or(weight <> w) THEN 'split_brain' ELSE 'self_report_drift' END AS issue FROM (SELECT a.*, b.weight AS w, b.info AS i FROM ring_views a JOIN ring_views b ON a.grp = b.grp AND a.id = b.id AND b.endpoint = 'm0') GROUP BY endpoint, grp HAVING bool_or(weight <> w OR info <> i)", "members", "ring_views")
def view_drift(spark: SparkSession, d: str) -> DataFrame:
    """Every endpoint's view of a group against the first endpoint's: another placement, or only another self-report."""
    f = fingerprints(ring_views(spark, d), ["endpoint", "grp"])
    first = f.where("endpoint = 'm0'").select("grp", F.col("fingerprint").alias("f0"), F.col("placement").alias("p0"))
    issue = F.when(F.col("placement") != F.col("p0"), "split_brain").when(F.col("fingerprint") != F.col("f0"), "self_report_drift")
    return f.join(first, "grp").select("endpoint", "grp", issue.alias("issue")).where("issue is not null")


@Q.add("h2_in_both_views", "SELECT id FROM members WHERE num % 5 <> 0 INTERSECT SELECT id FROM members WHERE num % 7 <> 0", "members")
def in_both(spark: SparkSession, d: str) -> DataFrame:
    m = V.members(spark, d)
    return m.where("num % 5 <> 0").select("id").join(m.where("num % 7 <> 0").select("id"), "id").distinct()


@Q.add("e18_disk_stats", "SELECT grp, count(*) AS disks, sum(used_bytes)::BIGINT AS used, sum(capacity_bytes - used_bytes)::BIGINT AS free, sum(objects)::BIGINT AS resident, bool_or(NOT has_stats) AS failed FROM members GROUP BY grp", "members")
def disk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Slab statistics summed over a group's disks; one that failed marks the sum."""
    return V.members(spark, d).groupBy("grp").agg(F.count("*").alias("disks"), F.sum("used_bytes").alias("used"), F.sum(F.col("capacity_bytes") - F.col("used_bytes")).alias("free"), F.sum("objects").alias("resident"), F.bool_or(~F.col("has_stats")).alias("failed"))


@Q.add("g2_attention_order", "SELECT req, pos, row_number() OVER (PARTITION BY req ORDER BY (NOT present)::INT, pos) - 1 AS place FROM chunks", "chunks")
def attention_order(spark: SparkSession, d: str) -> DataFrame:
    """Groups of full attention first, otherwise in their order (chunks that are present stand for the full ones)."""
    place = F.row_number().over(Window.partitionBy("req").orderBy((~F.col("present")).cast("int"), "pos")) - 1
    return V.chunks(spark, d).select("req", "pos", place.cast("long").alias("place"))


@Q.add("f8_by_node", "SELECT req, tenant AS node, count(*) AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM chunks GROUP BY req, tenant", "chunks")
def by_node(spark: SparkSession, d: str) -> DataFrame:
    """A batch's items by node, with the places at which their answers belong (a batch is one request's chunks)."""
    order = F.array_join(F.sort_array(F.collect_list("pos")).cast("array<string>"), ",")
    return V.chunks(spark, d).groupBy("req", F.col("tenant").alias("node")).agg(F.count("*").alias("n"), order.alias("positions"))


@Q.add("i2_put_status", "SELECT req, pos, CASE WHEN size % 5 = 0 THEN 'invalid' WHEN hash IN (SELECT hash FROM chunks WHERE req % 3 = 0) THEN 'ok_present' ELSE 'ok_new' END AS status FROM chunks WHERE req % 3 <> 0", "chunks")
def put_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of each item of a batch put: empty values (here: sizes that are multiples of five) are invalid, present keys are ok and write nothing."""
    c = V.chunks(spark, d)
    items = c.where("req % 3 <> 0").select("req", "pos", F.col("hash").alias("key"), F.when(F.col("size") % 5 == 0, 0).otherwise(F.col("size")).alias("len"))
    held = c.where("req % 3 = 0").select(F.col("hash").alias("key")).distinct().withColumn("held", F.lit(True))
    status = kv.put_status(items)
    return items.join(held, "key", "left").select("req", "pos", F.when(status == "ok", F.when(F.col("held"), "ok_present").otherwise("ok_new")).otherwise(status).alias("status"))


@Q.add("i3_scatter_put", "SELECT req, tenant AS grp, count(*) AS segments, sum(CASE WHEN present THEN size ELSE 0 END)::BIGINT AS bytes, CASE WHEN count(*) > 2 OR sum(CASE WHEN present THEN size ELSE 0 END) = 0 THEN 'invalid' ELSE 'ok' END AS status, CASE WHEN NOT (count(*) > 2 OR sum(CASE WHEN present THEN size ELSE 0 END) = 0) THEN md5(string_agg(CASE WHEN present THEN hash ELSE '' END, '' ORDER BY pos)) END AS value_md5 FROM chunks GROUP BY req, tenant", "chunks")
def scatter_put(spark: SparkSession, d: str) -> DataFrame:
    """Objects put as segments: joined in order; more than two segments or no byte at all fail the item, single empty segments don't."""
    c = V.chunks(spark, d).withColumn("bytes", F.when(F.col("present"), F.col("size")).otherwise(0))
    value = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("present"), F.col("hash")).otherwise("").alias("v")))), lambda r: r["v"]), "")
    g = c.groupBy("req", F.col("tenant").alias("grp")).agg(F.count("*").alias("segments"), F.sum("bytes").alias("bytes"), value.alias("value"))
    bad = (F.col("segments") > 2) | (F.col("bytes") == 0)
    return g.select("req", "grp", "segments", "bytes", F.when(bad, "invalid").otherwise("ok").alias("status"), F.when(~bad, F.md5(F.col("value").cast("binary"))).alias("value_md5"))


@Q.add("c10_store_mask", "SELECT req, pos FROM chunks WHERE pos % 4 >= 4 - ceil((6 - 1) / 2.0) AND pos < (SELECT any_value(n) FROM (SELECT req AS r, count(*) // 4 * 4 AS n FROM chunks GROUP BY req) q WHERE q.r = chunks.req)", "chunks")
def store_mask(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that some later hit can need: of each segment of four chunks (hits end there) the last ones that a window of six tokens, two to a chunk, reaches."""
    c = V.chunks(spark, d)
    segment, window, tokens = 4, 6, 2
    needed = -(-(window - 1) // tokens)
    mask = spark.createDataFrame([(i, i >= segment - needed) for i in range(segment)], "place long, needed boolean")
    whole = c.groupBy("req").agg((F.floor(F.count("*") / segment) * segment).alias("n"))
    j = c.join(whole, "req").withColumn("place", F.col("pos") % segment).join(F.broadcast(mask), "place")
    return j.where("needed and pos < n").select("req", "pos")
