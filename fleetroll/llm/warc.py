"""WARC derivatives: conversion (plain text) and metadata records that refer to the responses they come from."""

from __future__ import annotations

import json
import zlib
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain

CRLF = "\r\n"
#: What is dropped with its content. Every pattern here also ends with the text: what is opened and never closed is one
#: match to the end, as in HTML, and no opener is tried again from the next one on.
_DROP = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(rf"<{t}\b.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "template", "noscript"))
#: The rest of a tag: values in quotes may hold ``>``.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+(?:>|\z)"""
_BLOCK = r"(?i)<(?:/?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|main|title|head|body|blockquote|pre)|br)\b" + _ATTRIBUTES
_TAG = "</?[a-zA-Z]" + _ATTRIBUTES + "|<[/!?][^>]*+(?:>|\\z)"
_LINK = r"(?i)<a\b" + _ATTRIBUTES
_HREF = r"(?i)\bhref\s*="
_HTML = r"(?i)<html\b" + _ATTRIBUTES
_LANG = r"""(?i)\blang=["']?([a-zA-Z-]+)"""
_BUCKETS = 512
#: Names that HTML also reads without a semicolon, longest first.
_BARE = "^(" + "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))) + ")"
#: What numeric references to 128-159 stand for: windows-1252, where it has a character.
_C1 = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160))


def _named(name: Column) -> Column:
    """The characters of an entity name (semicolon included, where it has one), or null: maps in buckets by crc32, as a map is read from end to end."""
    maps: list[dict[str, str]] = [{} for _ in range(_BUCKETS)]
    for k, v in html5.items():
        maps[zlib.crc32(k.encode()) % _BUCKETS][k] = v.replace("\xa0", " ")
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,string>>")
    return F.try_element_at(F.get(table, (F.crc32(name.cast("binary")) % _BUCKETS).cast("int")), name)


def _numbered(digits: Column, base: int) -> Column:
    """The character of a code point without leading zeros; U+FFFD for none, as in HTML."""
    n = F.conv(digits, base, 10).cast("int")
    char = (
        F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd"))
        .when(n.between(128, 159), F.substring(F.lit(_C1), n - 127, F.lit(1)))
        .when(n == 160, F.lit(" "))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )
    return F.when(F.length(digits) > 7, F.lit("\ufffd")).otherwise(char)


def unescaped(text: Column) -> Column:
    """HTML character references put back in one pass, so that what they give is not read again.

    These are all names of the HTML table (``html.entities.html5``: 2,125 with a semicolon, 106 that are also read
    without one, the longest first) and decimal and hexadecimal references with or without a semicolon: 0, surrogates
    and numbers beyond U+10FFFF give U+FFFD, 128 to 159 are read as windows-1252.  No-break spaces become spaces.
    Anything else after an ampersand stays as it is.
    """

    def one(s: Column, i: Column) -> Column:
        def put(pattern: str, char) -> Column:
            own = F.regexp_extract(s, pattern, 0)
            return F.when(own != "", F.concat(char(F.regexp_extract(s, pattern, 1)), F.substr(s, F.length(own) + 1)))

        found = F.when(s.startswith("#"), F.coalesce(put(r"^#0*([0-9]+);?", lambda x: _numbered(x, 10)), put(r"^#[xX]0*([0-9a-fA-F]+);?", lambda x: _numbered(x, 16)))).otherwise(
            F.coalesce(put(r"^([A-Za-z][A-Za-z0-9]*;)", _named), put(_BARE, _named))
        )
        return F.when(i == 0, s).otherwise(F.coalesce(found, F.concat(F.lit("&"), s)))

    return F.array_join(F.transform(F.split(text, "&"), one), "")


def record_id(kind: str, *parts: Column) -> Column:
    """A urn:uuid of the parts' digest: the same response always gets the same ids."""
    h = F.sha2(F.concat_ws("\n", F.lit(kind), *parts), 256)
    s = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *s), F.lit(">"))


def plain_text(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags; blocks on lines of their own; references put back (``unescaped``).

    What is opened and never closed, of tags too, takes the rest of the page.  Linear in the page's length.
    """
    t = F.regexp_replace(html, _DROP, " ")
    t = F.regexp_replace(t, _BLOCK, "\n")
    t = F.regexp_replace(t, _TAG, "")
    t = unescaped(t)
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    return F.trim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages(page_id, url, html): what a crawler would have written.

    A null url or html is an empty one.
    """
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("target_uri"), F.coalesce("html", F.lit("")).alias("payload"))
    digest = F.concat(F.lit("sha256:"), F.sha2("payload", 256))
    p = p.withColumn("payload_digest", digest)
    return p.select(
        "page_id",
        record_id("response", F.coalesce(F.col("page_id").cast("string"), F.lit("~null")), F.col("target_uri"), F.col("payload_digest")).alias("record_id"),
        "target_uri",
        F.lit(date).alias("warc_date"),
        "payload_digest",
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n")).alias("http_headers"),
        "payload",
    )


def _record(kind: str, content_type: str, block: str, own_id: str) -> Column:
    head = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), F.col(own_id)),
        F.concat(F.lit("WARC-Refers-To: "), F.col("record_id")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri")),
        F.concat(F.lit("WARC-Date: "), F.col("warc_date")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(F.col(block), 256)),
        F.concat(F.lit("WARC-Source-Payload-Digest: "), F.col("payload_digest")),
        F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), F.col(block), F.lit(CRLF * 2))


def derivatives(resp: DataFrame) -> DataFrame:
    """For each response(record_id, target_uri, warc_date, payload_digest, http_headers, payload): two linked records.

    ``conversion_record`` holds the plain text, ``metadata_record`` application/warc-fields: the source's digest and
    length, its HTTP status and headers line by line, the language, the conversion's id and the number of links.  Both
    refer to the response's id, and their heads name its payload's digest (an extension field).  Null and empty
    payloads give empty texts; other null fields are left out.  Columns of the input pass through, but for those with
    the name of a result; no shuffle, built-in functions only.
    """
    resp = plain(resp, "text", "conversion_id", "metadata_id", "lang", "n_links", "metadata", "conversion_record", "metadata_record")
    payload = F.coalesce("payload", F.lit(""))
    d = resp.withColumn("text", plain_text(payload))
    d = d.withColumn("conversion_id", record_id("conversion", F.col("record_id"))).withColumn("metadata_id", record_id("metadata", F.col("record_id")))
    d = d.withColumn("lang", F.nullif(F.lower(F.regexp_extract(F.regexp_extract(payload, _HTML, 0), _LANG, 1)), F.lit("")))
    d = d.withColumn("n_links", F.size(F.filter(F.regexp_extract_all(payload, F.lit(_LINK), 0), lambda t: t.rlike(_HREF))).cast("long"))
    lines = F.split(F.rtrim(F.col("http_headers"), F.lit(CRLF)), CRLF)
    headers = F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(i == 0, "source-http-status: ").otherwise("source-http-header: "), x)), CRLF)
    fields = F.concat_ws(
        CRLF,
        F.concat(F.lit("source-payload-digest: "), F.col("payload_digest")),
        F.concat(F.lit("source-length: "), F.octet_length(payload).cast("string")),
        headers,
        F.concat(F.lit("conversion-record-id: "), F.col("conversion_id")),
        F.concat(F.lit("conversion-length: "), F.octet_length("text").cast("string")),
        F.concat(F.lit("outlinks: "), F.col("n_links").cast("string")),
        F.concat(F.lit("language: "), F.col("lang")),
    )
    d = d.withColumn("metadata", F.concat(fields, F.lit(CRLF)))
    d = d.withColumn("conversion_record", _record("conversion", "text/plain; charset=utf-8", "text", "conversion_id"))
    return d.withColumn("metadata_record", _record("metadata", "application/warc-fields", "metadata", "metadata_id"))


def _sql_unescaped(text: str) -> str:
    """SQL for ``unescaped``, with the tables ``m`` (named characters) in scope."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    fffd = "chr(65533)"
    char = lambda digits, n: (
        f"CASE WHEN length({digits}) > 7 THEN {fffd} ELSE (CASE WHEN {n} = 0 OR {n} BETWEEN 55296 AND 57343 OR {n} > 1114111 THEN {fffd} WHEN {n} BETWEEN 128 AND 159 THEN substr({q(_C1)}, ({n} - 127)::INT, 1) WHEN {n} = 160 THEN ' ' ELSE chr({n}::INT) END) END"
    )
    ten, hexa = "regexp_extract(s, '^#0*([0-9]+);?', 1)", "regexp_extract(s, '^#[xX]0*([0-9a-fA-F]+);?', 1)"
    ten_n = f"coalesce(try_cast({ten} AS BIGINT), 0)"
    hexa_n = f"coalesce(list_reduce(list_transform(string_split(lower({hexa}), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT), lambda x, y: (x * 16 + y) % 9007199254740881), 0)"
    rest = lambda pattern: f"substr(s, length(regexp_extract(s, {q(pattern)})) + 1)"
    named, bare = "^([A-Za-z][A-Za-z0-9]*;)", _BARE
    one = (
        f"CASE WHEN regexp_matches(s, '^#0*[0-9]+') THEN {char(ten, ten_n)} || {rest('^#0*([0-9]+);?')} "
        f"WHEN regexp_matches(s, '^#[xX]0*[0-9a-fA-F]+') THEN {char(hexa, hexa_n)} || {rest('^#[xX]0*([0-9a-fA-F]+);?')} "
        f"WHEN m[regexp_extract(s, {q(named)}, 1)] IS NOT NULL THEN m[regexp_extract(s, {q(named)}, 1)] || {rest(named)} "
        f"WHEN regexp_matches(s, {q(bare)}) THEN m[regexp_extract(s, {q(bare)}, 1)] || {rest(bare)} ELSE '&' || s END"
    )
    return f"string_split({text}, '&')[1] || array_to_string(list_transform(string_split({text}, '&')[2:], lambda s: {one}), '')"


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    text = "payload"
    plain_form = lambda pat: pat.replace("++", "+").replace("*+", "*").replace("?+", "?")  # noqa: E731  no possessive forms there
    for pat, to in ((_DROP, "' '"), (_BLOCK, "chr(10)"), (_TAG, "''")):
        pat = plain_form(pat)
        text = f"regexp_replace({text}, {q(pat)}, {to}, 'g')"
    names = ", ".join(f"({q(k)}, {q(v.replace(chr(160), ' '))})" for k, v in html5.items())
    bare_tags = text
    text = _sql_unescaped("untagged")
    text = f"regexp_replace({text}, {q('[ \\t\\r\\f\\x0B]+')}, ' ', 'g')"
    text = f"trim(regexp_replace({text}, {q(' ?\\n[ \\n]*')}, chr(10), 'g'), ' ' || chr(10))"
    uid = lambda h: f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"
    nl, crlf = "chr(10)", "chr(13) || chr(10)"
    record = lambda kind, ctype, block, own: (
        f"'WARC/1.1' || {crlf} || 'WARC-Type: {kind}' || {crlf} || 'WARC-Record-ID: ' || {own} || {crlf} || 'WARC-Refers-To: ' || record_id || {crlf} || 'WARC-Target-URI: ' || target_uri || {crlf} || 'WARC-Date: 2024-01-01T00:00:00Z' || {crlf} || "
        f"'WARC-Block-Digest: sha256:' || sha256({block}) || {crlf} || 'WARC-Source-Payload-Digest: ' || payload_digest || {crlf} || 'Content-Type: {ctype}' || {crlf} || 'Content-Length: ' || strlen({block}) || {crlf} || {crlf} || {block} || {crlf} || {crlf}"
    )
    return f"""
    WITH e AS (SELECT map_from_entries([{names}]) AS m), p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
    r AS (SELECT *, 'sha256:' || sha256(payload) AS payload_digest FROM p),
    i AS (SELECT *, sha256('response' || {nl} || coalesce(page_id::VARCHAR, '~null') || {nl} || target_uri || {nl} || payload_digest) AS h FROM r),
    j AS (SELECT *, {uid("h")} AS record_id, {bare_tags} AS untagged FROM i),
    k AS (SELECT *, sha256('conversion' || {nl} || record_id) AS hc, sha256('metadata' || {nl} || record_id) AS hm, {text} AS text,
          nullif(lower(regexp_extract(regexp_extract(payload, {q(plain_form(_HTML))}), {q(_LANG)}, 1)), '') AS lang,
          len(list_filter(regexp_extract_all(payload, {q(plain_form(_LINK))}), lambda t: regexp_matches(t, {q(_HREF)})))::BIGINT AS n_links FROM j, e),
    l AS (SELECT *, {uid("hc")} AS conversion_id, {uid("hm")} AS metadata_id FROM k),
    m AS (SELECT *, 'source-payload-digest: ' || payload_digest || {crlf} || 'source-length: ' || strlen(payload) || {crlf} ||
          'source-http-status: HTTP/1.1 200 OK' || {crlf} || 'source-http-header: Content-Type: text/html; charset=utf-8' || {crlf} || 'source-http-header: Content-Length: ' || strlen(payload) || {crlf} ||
          'conversion-record-id: ' || conversion_id || {crlf} || 'conversion-length: ' || strlen(text) || {crlf} || 'outlinks: ' || n_links || coalesce({crlf} || 'language: ' || lang, '') || {crlf} AS metadata FROM l)
    SELECT page_id, record_id AS refers_to, conversion_id, metadata_id, payload_digest, lang, n_links, strlen(text)::BIGINT AS text_bytes, sha256(text) AS text_sha256,
      sha256({record("conversion", "text/plain; charset=utf-8", "text", "conversion_id")}) AS conversion_sha256,
      sha256({record("metadata", "application/warc-fields", "metadata", "metadata_id")}) AS metadata_sha256 FROM m"""


SQL = _sql()
