"""Canonical identities as column expressions: framed bytes, digests, placement hashes.

Unsigned 64-bit values are 16-digit lower-case hex strings; unsigned 32-bit values are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domain strings and record marks of stored identities.
TENANT_DOMAIN = "DFKVTENANT1"
KEY_DOMAIN = "DFKVKEY2"
NAMESPACE_MARK = "44464b564e530002"
OBJECT_MARK = "44464b564f424a32"


def le(value: Column, width: int) -> Column:
    """`width` bytes of an integer, little-endian."""
    digits = F.lower(F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * width)))
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in range(width - 1, -1, -1))))


def framed(value: Column) -> Column:
    """Four little-endian bytes of length, then the bytes."""
    data = value.cast("binary")
    return F.concat(le(F.octet_length(data), 4), data)


def tenant_hash(namespace: Column) -> Column:
    """First eight digest bytes of a plain (not canonical) namespace."""
    data = namespace.cast("binary")
    return F.substring(F.sha2(F.concat(F.lit(TENANT_DOMAIN).cast("binary"), le(F.octet_length(data), 8), data), 256), 1, 16)


def block_digest(namespace: Column, key: Column) -> Column:
    """32 hex digits: the high and low digest words of a namespaced key."""
    n, k = namespace.cast("binary"), key.cast("binary")
    joined = F.concat(F.lit(KEY_DOMAIN).cast("binary"), le(F.octet_length(n), 8), n, le(F.octet_length(k), 8), k)
    return F.substring(F.sha2(joined, 256), 1, 32)


def block_id(namespace: Column, key: Column) -> Column:
    """48 hex digits, tenant first: the file name of a block."""
    return F.concat(tenant_hash(namespace), block_digest(namespace, key))


def block_path(block: Column) -> Column:
    return F.concat(F.lit("blocks/"), F.substring(block, 1, 2), F.lit("/"), F.substring(block, 1, 4), F.lit("/"), block)


def valid_block_id(block: Column) -> Column:
    return F.coalesce(block.rlike("^[0-9a-f]{48}$"), F.lit(False))


def valid_name(name: Column) -> Column:
    """Group and member identifiers."""
    return F.coalesce(name.rlike("^[A-Za-z0-9._-]{1,128}$"), F.lit(False))


def rank(size: Column, number: Column) -> Column:
    return F.concat(le(size, 4), le(number, 4))


def namespace_bytes(tenant, model, revision, pool_kind, pool, dtype, fingerprint_hex, block_tokens, group, layer_begin, layers, tp, dp, pp) -> Column:  # noqa: ANN001
    """Serialised namespace; fingerprint as 16 hex digits, tp/dp/pp as (size, rank) pairs."""
    pairs = (F.substring(fingerprint_hex, 2 * i + 1, 2) for i in range(7, -1, -1))
    parts = [F.unhex(F.lit(NAMESPACE_MARK)), framed(tenant), framed(model), framed(revision), le(pool_kind, 2), framed(pool), framed(dtype), F.unhex(F.concat(*pairs)), *(le(x, 4) for x in (block_tokens, group, layer_begin, layers)), rank(*tp), rank(*dp), rank(*pp)]
    return F.concat(*parts)


def object_bytes(namespace: Column, key: Column, component: Column, chunk: Column, chunks: Column) -> Column:
    return F.concat(F.unhex(F.lit(OBJECT_MARK)), framed(namespace), framed(key), framed(component), le(chunk, 4), le(chunks, 4))


def ring_hash(key: Column, word: int = 0) -> Column:
    """Unsigned little-endian 32-bit word of the MD5 digest."""
    digest = F.md5(key.cast("binary"))
    return F.conv(F.concat(*(F.substring(digest, 8 * word + 2 * i + 1, 2) for i in (3, 2, 1, 0))), 16, 10).cast("long")


def human_bytes(n: Column) -> Column:
    """1024-steps from B to P, one decimal, ties to even as in C."""
    out = F.format_string("%.1fP", F.bround(n / 1024.0**5, 1))
    for unit, power in (("T", 4), ("G", 3), ("M", 2), ("K", 1), ("B", 0)):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.1f{unit}", F.bround(n / 1024.0**power, 1))).otherwise(out)
    return out


def escape_label(text: Column) -> Column:
    """Metric label text: backslash, quote and line end escaped."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def clamp_range(size: Column, offset: Column, length: Column) -> Column:
    """Bytes that a range read returns: null beyond the end; length 0 asks for the rest."""
    rest = size - offset
    return F.when(offset > size, None).when(length == 0, rest).otherwise(F.least(length, rest))


# Fixed value: mark of layout fingerprints.
LAYOUT_DOMAIN = "DFKVLAYOUT1"


def layout_fingerprint(layout: Column, fields: dict[str, Column]) -> Column:
    """16 hex digits of a layout's typed fields, sorted by name; fields are text like `int:8` or `str:bf16`."""
    parts = [F.lit(LAYOUT_DOMAIN).cast("binary"), framed(layout)]
    for name, value in sorted(fields.items()):
        parts += [framed(F.lit(name)), framed(value)]
    digest = F.sha2(F.concat(*parts), 256)
    word = F.concat(*(F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)))
    return F.when(word == "0" * 16, "0" * 15 + "1").otherwise(word)


def participant(rank: Column, size: Column, effective: Column) -> Column:
    """Stripe of a rank among `effective` evenly spaced storing ranks; null if it does not store."""
    spacing = F.floor(size / effective)
    index = F.floor(rank / spacing)
    return F.when((rank % spacing == 0) & (index < effective), index)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(data: Column, at: Column, width: int) -> Column:
    """Unsigned little-endian number of `width` (at most 4) bytes at a 0-based offset; null beyond the end."""
    text = F.hex(F.substring(data, at + 1, F.lit(width)))
    value = F.conv(F.concat(*(F.substring(text, 2 * i + 1, 2) for i in range(width - 1, -1, -1))), 16, 10).cast("int" if width < 4 else "long")
    return F.when(F.octet_length(data) >= at + width, value.cast("long"))


# Largest field of a namespace, its numbers after the last field, and the rank of a replicated axis.
FIELD_LIMIT, TAIL_BYTES, NO_RANK = 1 << 20, 48, 0xFFFFFFFF


def _field_end(data: Column, at: Column) -> Column:
    """Offset behind a framed field, null where it is empty, too long or cut short."""
    return let(_number(data, at, 4), lambda n: F.when((n > 0) & (n <= FIELD_LIMIT) & (at + 4 + n <= F.octet_length(data)), (at + 4 + n).cast("int")))


def _tail_ok(data: Column, at: Column) -> Column:
    """The numbers that end a namespace: fingerprint, tokens, group, layers and three (size, rank) axes."""
    begin, layers = _number(data, at + 16, 4), _number(data, at + 20, 4)
    axis = lambda k: let(F.struct(_number(data, at + 24 + 8 * k, 4).alias("size"), _number(data, at + 28 + 8 * k, 4).alias("rank")), lambda a: (a["size"] > 0) & ((a["rank"] == NO_RANK) | (a["rank"] < a["size"])))
    fine = (F.hex(F.substring(data, at + 1, F.lit(8))) != "0" * 16) & (_number(data, at + 8, 4) > 0) & (layers > 0) & (begin + layers <= NO_RANK)
    return (F.octet_length(data) == at + TAIL_BYTES) & fine & axis(0) & axis(1) & axis(2)


def canonical_tenant(namespace: Column) -> Column:
    """The tenant field of a canonical namespace (bytes); null for any other, also where a byte is missing or left over."""
    kind_ok = lambda b, at: let(_number(b, at, 2), lambda k: k.between(1, 8) | (k == 65535))

    def tail(b: Column, first: Column, third: Column) -> Column:
        after = let(_field_end(b, third + 2), lambda p: _field_end(b, p))
        return let(after, lambda p: F.when(kind_ok(b, third) & _tail_ok(b, p), F.substring(b, F.lit(13), first - 12)))

    def fields(b: Column) -> Column:
        marked = F.lower(F.hex(F.substring(b, F.lit(1), F.lit(8)))) == NAMESPACE_MARK
        first = F.when(marked, _field_end(b, F.lit(8)))
        return let(first, lambda p1: let(_field_end(b, p1), lambda p2: let(_field_end(b, p2), lambda p3: tail(b, p1, p3))))

    return let(namespace.cast("binary"), fields)


def namespace_tenant_hash(namespace: Column) -> Column:
    """Tenant hash of the canonical tenant field, or of the whole namespace where it is not canonical."""
    return let(F.coalesce(canonical_tenant(namespace), namespace.cast("binary")), tenant_hash)


def descriptor_error(fields: dict[str, Column], fingerprint_hex: Column, block_tokens: Column, layer_begin: Column, layers: Column, axes: dict[str, tuple[Column, Column]], component: Column, chunk: Column, chunks: Column) -> Column:
    """The first thing wrong with a namespace or object descriptor, null if nothing is."""
    size = lambda v: F.coalesce(F.octet_length(v), F.lit(0))
    found = [F.when((size(v) == 0) | (size(v) > FIELD_LIMIT), f"{name} is empty or too long") for name, v in fields.items()]
    found += [F.when(fingerprint_hex == "0" * 16, "layout_fingerprint is 0"), F.when(block_tokens <= 0, "block_tokens is 0"), F.when((layers <= 0) | (layer_begin + layers > NO_RANK), "layer range is empty or overflows")]
    found += [F.when((n <= 0) | (r < -1) | (r >= n), f"{name} rank is out of range") for name, (n, r) in axes.items()]
    found += [F.when((size(component) == 0) | (size(component) > 256), "component is empty or too long"), F.when((chunks <= 0) | (chunk >= chunks), "chunk_index is out of range")]
    return F.coalesce(*found)


def canonical_namespace(model: Column, layout: Column, layout_fields: dict[str, Column], tenant: Column | None = None) -> Column:
    """A namespace with the defaults of a raw layout: custom pool, opaque type, one token and layer, all axes replicated."""
    one = F.lit(1)
    axis = (one, F.lit(-1))
    return namespace_bytes(F.lit("default") if tenant is None else tenant, model, model, F.lit(65535), layout, F.lit("opaque"), layout_fingerprint(layout, layout_fields), one, F.lit(0), F.lit(0), one, axis, axis, axis)


# Marks of pool keys and scatter keys.
POOL_MARK, SCATTER_MARK = "44464b56504f4f4c02", "44464b56534702"
AXES = ("dp", "tp", "pcp", "dcp", "pp")


def pool_key(page: Column, pool: Column, axes: dict[str, tuple[Column, Column]], group: Column, component: Column) -> Column:
    """Bytes of a cache object's key; axes that are not given have size 1 (dp and tp replicated, the others rank 0)."""
    default = {name: (F.lit(1), F.lit(-1 if name in ("dp", "tp") else 0)) for name in AXES}
    pairs = [rank(*(default | axes)[name]) for name in AXES]
    return F.concat(F.unhex(F.lit(POOL_MARK)), framed(pool), framed(page), *pairs, le(group, 4), framed(component))


def scatter_key(key: Column, width: Column, group: Column) -> Column:
    """A key with its scatter geometry; null for a width below 1."""
    return F.when(width >= 1, F.concat(key, F.unhex(F.lit(SCATTER_MARK)), le(width, 4), le(group, 4)))


def chunk_key(chunk_hash: Column, world: Column, worker: Column, layer: Column) -> Column:
    """Pool key of a token chunk: its hash in hex, the worker's rank, all layers or one."""
    component = F.when(layer.isNull(), F.lit("all")).otherwise(F.concat(F.lit("layer"), layer))
    return pool_key(F.lower(F.hex(chunk_hash)), F.lit("kv"), {"tp": (F.greatest(world, F.lit(1)), worker)}, F.lit(0), component)


def info_field(info: Column, key: str) -> Column:
    """Text of a key in `k=v,k=v` member info, null where it is absent."""
    return F.try_element_at(F.str_to_map(info, F.lit(","), F.lit("=")), F.lit(key))


def valid_host_port(address: Column) -> Column:
    port = F.regexp_extract(address, r"^.+:([0-9]{1,9})$", 1).try_cast("long")
    return F.coalesce(port.between(1, 65535), F.lit(False))
