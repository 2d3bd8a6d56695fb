"""Text rules against plain Python over every code point, and redaction against a walk of the parsed tree."""

from __future__ import annotations

import json
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from souk.functions import rules as R

EVERY = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Cn", "Co")]


def plain_text(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", t)).strip() or None


def plain_slug(t):
    t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii").lower()
    return re.sub(r"[^a-z0-9]+", "-", t).strip("-")


@pytest.fixture(scope="module")
def characters(spark):
    """Each character between letters, after a letter, before a mark, and by itself."""
    chars = spark.createDataFrame([(c,) for c in EVERY], "c string").repartition(8)
    forms = F.array(F.concat(F.lit("a"), "c", F.lit("b c"), "c"), F.concat(F.lit("e"), "c", F.lit("́")), F.concat(F.lit("ᄀ"), "c", "c", F.lit(" x̸")), F.col("c"))
    return chars.select(F.explode(forms).alias("t"))


def test_text_of_every_code_point(characters):
    rows = characters.select("t", R.text(F.col("t")).alias("o")).collect()
    assert len(rows) == 4 * len(EVERY)
    assert not [(r.t, r.o) for r in rows if r.o != plain_text(r.t)][:5]


def test_slug_of_every_code_point(characters):
    rows = characters.select("t", R.slug(F.col("t")).alias("o")).collect()
    assert not [(r.t, r.o, plain_slug(r.t)) for r in rows if r.o != plain_slug(r.t)][:5]


def test_keys_follow_the_full_tables(spark):
    df = spark.createDataFrame([("ＡＢＣ　mug ㎏ 5",), ("abc mug kg 5",), ("\U0001d401old café",), ("Bold café",)], "n string")
    none = F.lit(None).cast("string")
    keys = [r.k for r in df.select(R.product_key(F.lit("sid:1"), none, none, none, F.col("n"), F.array(none)).alias("k")).collect()]
    assert keys[0] == keys[1] and keys[2] == keys[3]
    assert [r.s for r in df.select(R.slug(F.col("n")).alias("s")).collect()] == [plain_slug(r.n) for r in df.collect()]


def test_strip_html_composes_after_entities(spark):
    df = spark.createDataFrame([("<p>é&lt;̸</p>\x1c x",), (None,)], "t string")
    assert [r.o for r in df.select(R.strip_html(F.col("t")).alias("o")).collect()] == ["é≮ x", None]


def test_lists_of_countries(spark):
    df = spark.createDataFrame([(["deutschland", "Germany", None, " ", "Österreich", "Österreich"],), (None,)], "c array<string>")
    assert [r.o for r in df.select(R.countries(F.col("c")).alias("o")).collect()] == [["Germany", "Austria"], []]


def test_addresses_of_files(spark):
    df = spark.createDataFrame([("file:///x/",), ("FILE:///",), ("mailto:a@b",), ("svn+ssh:/p/",)], "u string")
    from urllib.parse import urlsplit, urlunsplit

    def plain(u):
        p = urlsplit(u)
        return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/") if len(p.path) > 1 else p.path, "", ""))

    assert [r.o for r in df.select(R.url(F.col("u")).alias("o")).collect()] == [plain(r.u) for r in df.collect()]


def walk(v):
    if isinstance(v, dict):
        return {k: R.REDACTED if re.search(r"authorization|cookie|token|password|secret|api[-_]?key|x-auth", k, re.I) else walk(x) for k, x in v.items()}
    return [walk(x) for x in v] if isinstance(v, list) else v


KEYS = st.sampled_from(["a", "token", "X-Auth", "my_Api-Key", "Set-Cookies", "paſſword", "toKen", 'q"token\\', "note: token", "k", ""])
TREES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6) | st.just('a", "token": "b'), lambda x: st.lists(x, max_size=3) | st.dictionaries(KEYS, x, max_size=3), max_leaves=12)


@settings(max_examples=400, deadline=None)
@given(TREES, st.booleans(), st.sampled_from([None, 1]))
def test_redaction_of_any_tree(tree, ascii_, indent):
    said = json.dumps(tree, ensure_ascii=ascii_, indent=indent)
    assert json.loads(R.redacted(said)) == walk(tree)
    assert R.redacted(R.redacted(said)) == R.redacted(said)


def test_redaction_keeps_all_else_as_it_is(spark):
    said = [
        '{"token":{"v":1}}', '{"cookies":["a"]}', '{"x-auth":"a"}', '{ "x" : [1, {"secret" :  null , "y": "token"} ] }', '{"to\\u006ben": 1.5e3}', '["token", "b"]', None, "not json",
        '{"password": [1, {"a": "]"}', '{"token" 5}', '{"token": }',
    ]
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    got = [r.o for r in df.select("i", R.redact_json(F.col("t")).alias("o")).orderBy("i").collect()]
    hidden = f'"{R.REDACTED}"'
    assert got == [
        '{"token":%s}' % hidden, '{"cookies":%s}' % hidden, '{"x-auth":%s}' % hidden, '{ "x" : [1, {"secret" :  %s , "y": "token"} ] }' % hidden, '{"to\\u006ben": %s}' % hidden, '["token", "b"]', None, "not json",
        '{"password": %s' % hidden, '{"token" 5}', '{"token": %s}' % hidden,
    ]
