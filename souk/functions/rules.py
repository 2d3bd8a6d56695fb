"""Column rules: cleaning, parsing, keys and text facts as native expressions. Null in, null out unless said."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions import config as C

#: What Python counts as white space: the property, and the four separators U+001C to U+001F.
BLANKS = r"[\s\x1C-\x1F]+"
SPACE = "(?U)" + BLANKS


def _empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _assigned() -> Iterator[str]:
    return (chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000)


@functools.cache
def composing() -> str:
    """Every character that NFC may change, by itself or after another: those it replaces, marks, and second halves of compositions."""
    halves = {chr(int(d[1], 16)) for d in (unicodedata.decomposition(c).split() for c in _assigned()) if len(d) == 2 and d[0][0] != "<"}
    jamo = {chr(i) for i in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    return "".join(c for c in _assigned() if unicodedata.combining(c) or c in halves or c in jamo or unicodedata.normalize("NFC", c) != c)


def _wide(c: Column) -> Column:
    """Whether a text holds anything but ASCII: two lengths that Spark has at hand."""
    return F.octet_length(c) > F.length(c)


def _may_compose(c: Column) -> Column:
    return F.when(_wide(c), F.translate(c, composing(), "") != c).otherwise(False)


def nfc(c: Column) -> Column:
    """NFC of a text. Spark has no such function: texts that hold a character it may change go through Arrow, all others stay where they are."""
    import pyarrow as pa

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.coalesce(F.arrow_udf(run, "string")(F.when(_may_compose(c), c)), c)


def nfc_each(c: Column) -> Column:
    """:func:`nfc` of a list's texts."""
    import pyarrow as pa

    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [None if t is None else unicodedata.normalize("NFC", t) for t in x] for x in lists.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.coalesce(F.arrow_udf(run, "array<string>")(F.when(F.exists(c, lambda t: F.coalesce(_may_compose(t), F.lit(False))), c)), c)


def spaced(c: Column) -> Column:
    """White space runs to one blank, trimmed; empty is null."""
    return _empty_to_null(F.btrim(F.regexp_replace(c, SPACE, " ")))


def text(c: Column) -> Column:
    """NFC, white space runs to one blank, trimmed; empty is null."""
    return spaced(nfc(c))


def strip_html(c: Column) -> Column:
    """Tags become blanks, six entities their characters, in this order."""
    out = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return text(out)


def _plain(c: str) -> str:
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()


@functools.cache
def folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition has one ASCII character, and those where it has several: all of Unicode's."""
    found = {c: p for c in _assigned() if (p := _plain(c))}
    return {c: p for c, p in found.items() if len(p) == 1}, {c: p for c, p in found.items() if len(p) > 1}


def plain(c: Column) -> Column:
    """NFKD of a text, of which the ASCII characters stay. Spark has no such function: wide texts go through Arrow, all others stay where they are."""
    import pyarrow as pa

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _plain(t) for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.coalesce(F.arrow_udf(run, "string")(F.when(_wide(c), c)), c)


def plain_each(c: Column) -> Column:
    """:func:`plain` of a list's texts."""
    import pyarrow as pa

    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [None if t is None else _plain(t) for t in x] for x in lists.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.coalesce(F.arrow_udf(run, "array<string>")(F.when(F.exists(c, lambda t: F.coalesce(_wide(t), F.lit(False))), c)), c)


def _dashed(c: Column) -> Column:
    return F.coalesce(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(""))


def slug(c: Column) -> Column:
    """ASCII letters and digits in lower case, all else one dash; other letters drop. Null gives an empty text."""
    return _dashed(plain(c))


def _decoded(c: Column) -> Column:
    """Form decoding: plus is a blank, ``%xx`` a byte of UTF-8, any other per cent sign itself."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(c: Column) -> Column:
    """Form encoding that leaves letters, digits and ``_.-~``."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url(c: Column) -> Column:
    """Lower-case scheme and host, no tracking parameters, sorted query, no fragment, no trailing slash but the root's.

    Query names and values are decoded, sorted and encoded again; those without a
    value go. A text with neither scheme nor host only loses its trailing slashes.
    """
    raw = F.regexp_replace(F.regexp_replace(c, r"^[\s\x00-\x1F]+|[\s]+$", ""), "[\t\r\n]", "")
    part = lambda i: F.regexp_extract(raw, r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", i)
    scheme, host = F.lower(part(1)), F.lower(part(2))

    def tracked(p):
        name = F.lower(p["k"])
        hit = name.isin(*C.TRACKING_NAMES)
        for prefix in C.TRACKING_PREFIXES:
            hit = hit | name.startswith(prefix)
        return hit

    valued = F.filter(F.split(part(4), "&"), lambda p: p.contains("=") & (F.locate("=", p) < F.length(p)))
    pairs = F.transform(valued, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    query = F.array_join(F.transform(F.array_sort(F.filter(pairs, lambda p: ~tracked(p))), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    path = F.when(F.length(part(3)) > 1, F.regexp_replace(part(3), "/+$", "")).otherwise(part(3))
    rooted = (host != "") | path.startswith("//") | (scheme.isin("", *C.ROOTED_SCHEMES) & ((path == "") | path.startswith("/")))
    whole = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit(":"), F.when(rooted, F.concat(F.lit("//"), host)).otherwise(""), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    bare = _empty_to_null(F.regexp_replace(raw, "/+$", ""))
    return F.when(raw != "", F.when((scheme == "") & (host == ""), bare).otherwise(whole))


def _country(t: Column) -> Column:
    key = F.btrim(F.lower(t), F.lit(". "))
    names = F.create_map(*[F.lit(x) for kv in C.COUNTRIES.items() for x in kv])
    return F.coalesce(names[key], F.when(t.rlike(r"^\p{Lu}"), t).otherwise(F.initcap(t)))


def country(c: Column) -> Column:
    """One name per country: aliases, else as it is if capitalised, else in title case."""
    return _country(text(c))


def country_list(c: Column) -> Column:
    """Names of a list, or split at ``; , | /``, each normalized, first of equal ones kept, in order. c: text."""
    return countries(F.split(c, r"[;,|/]"))


def countries(c: Column) -> Column:
    """:func:`country_list` of a list of texts."""
    parts = F.transform(nfc_each(c), lambda x: _country(spaced(x)))
    return F.coalesce(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())), F.array().cast("array<string>"))


def price(c: Column) -> Column:
    """Number of a price text: the right-most of dot and comma is the decimal mark; one comma before three last digits groups thousands."""
    t = F.regexp_replace(c.cast("string"), r"[^\d,.\-]", "")
    comma, dot = F.instr(t, ",") > 0, F.instr(t, ".") > 0
    last = lambda ch: F.length(t) - F.instr(F.reverse(t), ch)
    drop = lambda x, ch: F.replace(x, F.lit(ch), F.lit(""))
    both = F.when(last(",") > last("."), F.replace(drop(t, "."), F.lit(","), F.lit("."))).otherwise(drop(t, ","))
    one = F.when((F.length(F.substring_index(t, ",", -1)) == 3) & (F.length(t) - F.length(drop(t, ",")) == 1), drop(t, ",")).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    plain = F.when(comma & dot, both).when(comma, one).otherwise(t)
    return F.when(plain.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), plain).try_cast("double")


def ts_utc(c: Column) -> Column:
    """Timestamp of ISO text (zone or none: UTC), a date, or epoch seconds."""
    t = F.btrim(c.cast("string"))
    return F.when(t.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_seconds(t.try_cast("double"))).otherwise(F.try_to_timestamp(t))


def tri_bool(c: Column) -> Column:
    """True, false, or null for an unknown word."""
    t = F.lower(F.btrim(c.cast("string")))
    return F.when(t.isin(*C.TRUE_WORDS), True).when(t.isin(*C.FALSE_WORDS), False)


def as_int(c: Column) -> Column:
    """Truncated number of a numeric text, else null."""
    t = F.btrim(c.cast("string"))
    return F.when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), t).try_cast("double").try_cast("int")


def present(c: Column) -> Column:
    """True for a text that says something, null for null or empty."""
    return F.when(text(c.cast("string")).isNotNull(), True)


def digest20(*parts: Column) -> Column:
    """First 20 hex digits of the SHA-256 of the non-empty parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *[_empty_to_null(p.cast("string")) for p in parts]), 256), 1, 20)


def supplier_key(sid: Column, link: Column, name: Column, place: Column) -> Column:
    """``sid:``, else ``surl:``, else ``shash:``; null where nothing identifies a supplier."""
    s, u, n = text(sid), url(link), slug(name)
    return F.coalesce(F.concat(F.lit("sid:"), s), F.concat(F.lit("surl:"), F.when(u.isNotNull(), digest20(u))), F.when(n != "", F.concat(F.lit("shash:"), digest20(n, slug(place)))))


def variant_signature(variants: Column) -> Column:
    """Digest of the sorted slugs of ``sku:id:option:title`` texts; empty for none."""
    parts = F.array_sort(F.filter(F.transform(plain_each(variants), _dashed), lambda x: x != ""))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 20)).otherwise("")


def product_key(skey: Column, pid: Column, sku: Column, link: Column, name: Column, variants: Column) -> Column:
    """``pid:``, else ``psku:``, else ``purl:``, else ``phash:``; null where nothing identifies a product."""
    p, s, u, n = text(pid), text(sku), url(link), slug(name)
    return F.coalesce(
        F.concat(F.lit("pid:"), p),
        F.when(s.isNotNull(), F.concat(F.lit("psku:"), digest20(skey, s))),
        F.when(u.isNotNull(), F.concat(F.lit("purl:"), digest20(u))),
        F.when(n != "", F.concat(F.lit("phash:"), digest20(skey, n, variant_signature(variants)))),
    )


def first_match(c: Column, table) -> Column:
    """Label of the first pattern that a text holds."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(table):
        out = F.when(F.lower(c).rlike("(?U)" + pattern), label).otherwise(out)
    return out


def material(c: Column) -> Column:
    return first_match(c, C.MATERIALS)


def dimensions(c: Column) -> Column:
    found = F.regexp_replace(_empty_to_null(F.regexp_extract(c, C.DIMENSION, 1)), SPACE, "")
    return F.replace(F.replace(found, F.lit("x"), F.lit(" × ")), F.lit("×"), F.lit(" × "))


def weight(c: Column) -> Column:
    return F.regexp_replace(_empty_to_null(F.regexp_extract(c, C.WEIGHT, 1)), SPACE, "")


def merge_tags(a: Column, b: Column) -> Column:
    """Tags of both lists, blanks trimmed; of tags equal but for case the first stays."""
    every = F.filter(F.transform(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), lambda x: F.btrim(x)), lambda x: x != "")
    low = F.transform(every, F.lower)
    return F.filter(every, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def handle(title: Column, key: Column) -> Column:
    return F.coalesce(_empty_to_null(slug(title)), _empty_to_null(slug(key)), F.lit("product"))


def clip(c: Column, n: int) -> Column:
    """At most n characters, no trailing blanks or ``,.;:-``."""
    t = F.btrim(c)
    return F.when(F.length(t) <= n, t).otherwise(F.regexp_replace(F.substring(t, 1, n), r"[\s,.;:\-]+$", ""))


REDACTED = "***REDACTED***"
_SECRET = re.compile(C.SECRET, re.IGNORECASE)
#: A text, a bracket, a comma or colon, white space, or anything else in one piece.
_JSON = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[\]{}:,]|[\x20\t\n\r]+|[^"\[\]{}:,\x20\t\n\r]+', re.DOTALL)


def redacted(said: str) -> str:
    """A JSON text in which the value under each secret-looking key, of any kind and at any depth, is ``"***REDACTED***"``.

    All else stays as it is, byte for byte. Broken JSON is read as far as its brackets go:
    what follows a secret's colon is hidden up to the comma or bracket that ends it.
    """
    out, parts, i = [], _JSON.findall(said), 0
    while i < len(parts):
        p = parts[i]
        out.append(p)
        i += 1
        if p[0] != '"':
            continue
        try:
            name = json.loads(p, strict=False)
        except ValueError:
            name = p
        if not _SECRET.search(name):
            continue
        j = i
        while j < len(parts) and parts[j].isspace():
            j += 1
        if j == len(parts) or parts[j] != ":":
            continue
        j += 1
        while j < len(parts) and parts[j].isspace():
            j += 1
        out.extend(parts[i:j])
        out.append(f'"{REDACTED}"')
        value, depth = j, 0
        while j < len(parts) and (depth or parts[j] not in (",", "}", "]")):
            depth += (parts[j] in "[{") - (parts[j] in "]}")
            j += 1
        while j > value and parts[j - 1].isspace():
            j -= 1
        i = j
    return "".join(out)


def redact_json(c: Column) -> Column:
    """:func:`redacted` of JSON texts; those that name nothing secret do not leave the JVM."""
    import pyarrow as pa

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redacted(t) for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    named = c.rlike("(?iu)" + C.SECRET) | c.contains("\\u")
    return F.coalesce(F.arrow_udf(run, "string")(F.when(named, c)), c)


def stock_status(c: Column) -> Column:
    """In Stock, Out Of Stock or Low Stock, spelled so in any case; all else Unknown."""
    words = F.create_map(*[F.lit(x) for w in ("In Stock", "Out Of Stock", "Low Stock") for x in (w.lower(), w)])
    return F.coalesce(words[F.lower(c)], F.lit("Unknown"))


def completeness(*cols: Column) -> Column:
    """Per cent of the columns that hold something (lists: at least one element), one decimal, as DECIMAL(5,1)."""
    held = [F.when(c, 1).otherwise(0) for c in cols]
    total = held[0]
    for h in held[1:]:
        total = total + h
    return F.bround((total * 100 / len(cols)).cast("decimal(18,6)"), 1).cast("decimal(5,1)")


def holds(c: Column, is_list: bool = False) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False)) if is_list else F.coalesce(F.btrim(c.cast("string")) != "", F.lit(False))


def normalize_table(df: DataFrame, spec: dict) -> tuple[DataFrame, DataFrame]:
    """Apply a rule to each named column; and one row per column: values that were null, changed, unparseable."""
    out = df.select(*[spec[c](F.col(c)).alias(c) if c in spec else F.col(c) for c in df.columns])
    facts = []
    for c, rule in spec.items():
        old, new = F.col(c), rule(F.col(c))
        facts.append(F.struct(F.lit(c).alias("column_name"), F.count_if(old.isNull()).alias("nulls"), F.count_if(new.isNotNull() & ~old.cast("string").eqNullSafe(new.cast("string"))).alias("changed"), F.count_if(old.isNotNull() & new.isNull()).alias("unparseable")))
    report = df.agg(F.array(*facts).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return out, report
