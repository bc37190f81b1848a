"""Scalar functions as column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of identities, topics and message types, which other systems read and write too.
SEGMENT = "^[a-z0-9]([a-z0-9-]*[a-z0-9])?$"
AGGREGATE = "^[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?$"
SEGMENT_MOST, AGGREGATE_MOST, TOPIC_MOST, TOPIC_WARNING, MESSAGE_TYPE_MOST = 64, 256, 249, 200, 192
EXTENSIONS_MOST, EXTENSION_KEY_MOST, EXTENSION_VALUE_MOST = 32, 128, 2048

#: One or two segments, and ``.events``.
TOPIC = "^" + SEGMENT[1:-1] + "(\\." + SEGMENT[1:-1] + ")?\\.events$"
MESSAGE_TYPE = "^([a-z0-9]+)-(" + SEGMENT[1:-1].replace("(", "(?:") + ")-v([0-9]+)$"


def kebab(name: Column) -> Column:
    """PascalCase to kebab-case: a word begins at a capital behind a small letter or digit, at the last capital of a run, and at a digit behind a letter."""
    return F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-zA-Z])(?=[0-9])", "-"))


def message_type(value: Column) -> dict[str, Column]:
    """Domain, name and version of ``{domain}-{name}-v{N}``, the domain up to the first hyphen; null where the text isn't one."""
    version = F.regexp_extract(value, MESSAGE_TYPE, 3).try_cast("int")
    ok = value.rlike(MESSAGE_TYPE) & (F.length(value) <= MESSAGE_TYPE_MOST) & (version >= 1)
    return {"type_domain": F.when(ok, F.regexp_extract(value, MESSAGE_TYPE, 1)), "type_name": F.when(ok, F.regexp_extract(value, MESSAGE_TYPE, 2)), "type_version": F.when(ok, version)}


def message_type_of(domain: Column, name: Column, version: Column) -> Column:
    """The message type of a PascalCase name; null where its parts don't make a valid one."""
    text = F.concat(domain, F.lit("-"), kebab(name), F.lit("-v"), version.cast("string"))
    return F.when(F.nvl(message_type(text)["type_domain"] == domain, F.lit(False)), text)


def identity(text: Column) -> dict[str, Column]:
    """Tenant, domain and aggregate of ``tenant:domain:aggregate``, the first two in lower case; null where the text isn't one."""
    parts = F.split(text, ":", -1)
    tenant, domain, aggregate = F.lower(F.get(parts, F.lit(0))), F.lower(F.get(parts, F.lit(1))), F.get(parts, F.lit(2))
    ok = (F.size(parts) == 3) & identity_valid(tenant, domain, aggregate)
    return {"tenant_id": F.when(ok, tenant), "domain": F.when(ok, domain), "aggregate_id": F.when(ok, aggregate)}


def state_key(key: Column) -> dict[str, Column]:
    """Identity and suffix (all behind the third colon) of a state store's key; null where it isn't one."""
    parts = F.split(key, ":", -1)
    own = identity(F.array_join(F.slice(parts, 1, 3), ":"))
    ok = (F.size(parts) > 3) & own["tenant_id"].isNotNull()
    return {**{k: F.when(ok, c) for k, c in own.items()}, "suffix": F.when(ok, F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), ":"))}


def identity_valid(tenant: Column, domain: Column, aggregate: Column) -> Column:
    part = lambda c: c.rlike(SEGMENT) & (F.length(c) <= SEGMENT_MOST)
    return part(tenant) & part(domain) & aggregate.rlike(AGGREGATE) & (F.length(aggregate) <= AGGREGATE_MOST)


def actor_id(tenant: Column, domain: Column, aggregate: Column) -> Column:
    return F.concat_ws(":", F.lower(tenant), F.lower(domain), aggregate)


def topic(tenant: Column, domain: Column) -> Column:
    return F.when(tenant == "system", F.concat(domain, F.lit(".events"))).otherwise(F.concat(tenant, F.lit("."), domain, F.lit(".events")))


def topic_valid(name: Column) -> Column:
    return (F.length(name) <= TOPIC_MOST) & name.rlike(TOPIC)


def topic_warns(name: Column) -> Column:
    """Valid, but near the limit."""
    return topic_valid(name) & (F.length(name) > TOPIC_WARNING)


def domain_name(kind: Column) -> Column:
    """The domain that a type is named for: its name without Aggregate, Projection or Processor at the end, in kebab-case; null where nothing valid is left."""
    name = kebab(F.regexp_replace(kind, "(Aggregate|Projection|Processor)$", ""))
    return F.when(name.rlike(SEGMENT), name)


def query_type_name(kind: Column) -> Column:
    name = kebab(F.regexp_replace(kind, "Query$", ""))
    return F.when(name.rlike(SEGMENT), name)


def resource_names(tenant: Column, domain: Column) -> dict[str, Column]:
    """Names that follow from tenant and domain: state store, command endpoint and the topic of changed projections; null where either isn't valid."""
    ok = tenant.rlike(SEGMENT) & domain.rlike(SEGMENT)
    # The formats of the names.
    told = {"state_store": F.concat(domain, F.lit("-eventstore")), "command_endpoint": F.concat(domain, F.lit("-commands")), "changed_topic": F.concat(tenant, F.lit("."), domain, F.lit(".projection-changed"))}
    return {k: F.when(ok, c) for k, c in told.items()}


def checksum(value: Column, length: int = 11) -> Column:
    """First characters of the URL-safe base64 of the SHA-256."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(value, 256))), "+/", "-_"), 1, length)


def aggregate_label(domain: Column) -> Column:
    return F.concat(F.upper(F.substring(domain, 1, 1)), F.substring(domain, 2, 1 << 20), F.lit("Aggregate"))


def type_name(stored: Column) -> Column:
    """A type's full name without the names of assemblies, those inside of generic arguments neither."""
    inside = F.regexp_replace(stored, "(?<!\\]),(?![\\],])[^\\[\\]]*(?=\\])", "")
    return F.regexp_replace(inside, "^([^\\[,]*(?:\\[.*\\])?[^,\\[\\]]*),[^\\[\\]]*$", "$1")


def type_short_name(stored: Column) -> Column:
    """The part of a type's full name behind its last '.' or '+', generic arguments kept."""
    return F.regexp_replace(type_name(stored), "^[^\\[]*[.+](?=[^.+\\[]*(\\[|$))", "")


def csv_cell(value: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike("[,\"\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def url64(value: Column) -> Column:
    return F.rtrim(F.translate(F.base64(value), "+/", "-_"), F.lit("="))


def etag(kind: Column, version: Column) -> Column:
    """A tag that names its projection type: URL-safe base64 of the type, a dot, the version."""
    return F.concat(url64(F.encode(kind, "UTF-8")), F.lit("."), version.cast("string"))


def etag_parts(tag: Column) -> dict[str, Column]:
    """Projection type and version of a tag; null where it is none, or the type is empty or holds a colon."""
    head, rest = F.substring_index(tag, ".", 1), F.regexp_extract(tag, "^[^.]+[.]([\\s\\S]+)$", 1)
    raw = F.translate(head, "-_", "+/")
    padded = F.rpad(raw, (F.ceil(F.length(raw) / 4) * 4).cast("int"), "=")
    kind = F.when(head.rlike("^[A-Za-z0-9_-]+$") & (F.length(head) % 4 != 1) & (rest != ""), F.decode(F.unbase64(padded), "UTF-8"))
    ok = kind.isNotNull() & (kind != "") & ~F.contains(kind, F.lit(":"))
    return {"projection_type": F.when(ok, kind), "version": F.when(ok, rest)}


def extensions_problem(extensions: Column) -> Column:
    """The first rule that a map of extensions breaks: Count, KeyLength, ValueLength, KeyCharacters, ControlCharacters; null if none."""
    pairs = F.map_entries(extensions)

    def some(rule):
        return F.exists(pairs, rule)

    return (
        F.when(F.size(pairs) > EXTENSIONS_MOST, "Count")
        .when(some(lambda e: F.length(e["key"]) > EXTENSION_KEY_MOST), "KeyLength")
        .when(some(lambda e: F.length(e["value"]) > EXTENSION_VALUE_MOST), "ValueLength")
        .when(some(lambda e: ~e["key"].rlike("^[a-zA-Z0-9_.-]+$")), "KeyCharacters")
        .when(some(lambda e: e["value"].rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")), "ControlCharacters")
    )


def extensions_size(extensions: Column) -> Column:
    """UTF-8 bytes of all keys and values."""
    return F.aggregate(F.map_entries(extensions), F.lit(0).cast("long"), lambda n, e: n + F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]), F.lit(0)))


def canonical_json(text: Column) -> Column:
    """The same value with sorted keys and no white space; null where the text isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def intent_digest(parts: list[Column]) -> Column:
    """SHA-256 of the parts, each behind its length in bytes (-1: null), so that no two lists of parts share a digest."""
    told = [F.concat(F.coalesce(F.octet_length(p), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in (c.cast("string") for c in parts)]
    return F.sha2(F.concat(*told), 256)


def tolerant_long(json: Column, path: str) -> Column:
    """A number in JSON, written as number or text; null where it is neither."""
    return F.get_json_object(json, path).try_cast("bigint")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")
