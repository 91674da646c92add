"""Member records: fixed bytes, tails, and what is malformed."""

import struct

from pyspark.sql import functions as F

from cachelens.functions.epoch import fnv1a, member_bytes
from cachelens.sources import codec as K
from cachelens.sources.text import prefix_successor


def record(spark):
    stats = [F.lit(k + 1) for k in range(len(K.STATS))]
    return bytes(spark.range(1).select(K.registration(F.lit("node-7"), F.lit("10.2.3.7"), F.lit(28001), F.lit(3), F.lit(28000), F.lit("ver=9"), stats)).first()[0])


def test_round_trip_and_tails(spark):
    data = record(spark)
    (m,) = K.read_members(data)
    assert (m["id"], m["ip"], m["port"], m["weight"], m["tcp_port"], m["info"], m["stats"]) == ("node-7", "10.2.3.7", 28001, 3, 28000, "ver=9", list(range(1, 13)))
    head = 12 + 4 + 6 + 4 + 8 + 8
    assert data[:12] == struct.pack("<QI", 0, 1)
    assert K.read_members(data[:15]) is None and K.read_members(None) is None
    (bare,) = K.read_members(data[:head])
    assert (bare["tcp_port"], bare["info"], bare["stats"]) == (0, "", None)
    (unknown,) = K.read_members(data[:head] + struct.pack("<II", 0x31313131, 5))
    assert unknown["tcp_port"] == 0
    at = data.index(struct.pack("<I", K.STATS_TAG)) + 4
    longer = data[:at] + bytes([13]) + data[at + 1 :] + struct.pack("<q", 99)
    assert K.read_members(longer)[0]["stats"] == list(range(1, 13)), "fields that a newer writer adds are skipped"


def test_malformed_records_are_told(spark):
    df = spark.createDataFrame([(1, bytearray(record(spark))), (2, bytearray(b"short")), (3, None)], "n long, r binary")
    got = {r["n"]: (r["bad"], r["id"]) for r in K.parse_members_binary(df, "r", ["n"]).collect()}
    assert got == {1: (False, "node-7"), 2: (True, None), 3: (True, None)}


def test_epoch_hash_and_prefix():
    assert fnv1a(b"") == 1469598103934665603 and member_bytes("a", "b", 1, 2) == b"\1\0\0\0a\1\0\0\0b\1\0\0\0\2\0\0\0"
    assert prefix_successor("/a/") == "/a0"


def test_strict_reading_tells_what_is_wrong(spark):
    data = record(spark)
    m = K.read_registration(data)
    assert (m["grp"], m["id"], m["port"], m["tcp_port"], m["info"]) == (None, "node-7", 28001, 28000, "ver=9")
    assert K.read_registration(struct.pack("<I", 2) + b"eu" + data, grouped=True)["grp"] == "eu"
    bare = data[: 12 + 4 + 6 + 4 + 8 + 8]
    assert K.read_registration(bare)["info"] == "-" and K.read_registration(bare + struct.pack("<I", 7))["tcp_port"] == 0
    cases = {None: "missing", b"": "truncated", data[:-1]: "truncated", b"\1" + data[1:]: "epoch or count", data[:8] + b"\2" + data[9:]: "epoch or count", data.replace(b"node", b"nod\xff"): "encoding"}
    rows = spark.createDataFrame([(k, None if r is None else bytearray(r)) for k, r in enumerate(cases)], "n long, r binary")
    assert {r["n"]: r["error"] for r in K.parse_registrations(rows, "r", ["n"]).collect()} == dict(enumerate(cases.values()))
    assert K.parse_registrations(rows.where("n < 0"), "r", ["n"]).count() == 0
