"""WARC derivatives: response records become metadata and plain-text conversion records.

responses() wraps raw pages as WARC/1.1 response records, parse() splits any record
into its headers and block, and derive() makes two records of each response: metadata
(title, the source's headers and resolved links, as warc-fields) and conversion (plain text).
Both name the response in WARC-Refers-To and carry its target, date and payload digest, so
they stay linked when the files part; the identifiers are hashes of what they name, so a
task that runs again gives the same records.

derive() is one Arrow pass: nothing is shuffled, and a task holds one batch of pages
(shared.bounded_batches). Patterns are linear: no tag pattern crosses another "<".

Pages follow the HTML standard where it matters for text: comments, scripts and styles are no
text (unclosed ones reach to the end of the page), "<" opens a tag only before a letter, "/", "!" or
"?", attribute values may be quoted either way or bare, and all named and numeric characters are
decoded once. Links follow RFC 3986 from the page's address or its <base>.

Defined results: a null page is an empty page, a null url an empty target; of repeated
headers the first counts and all are carried; headers that the source lacks are left out of its
derivatives; a block without an empty line is all payload; repeated rows give equal records; null
page_ids pass through; an empty table gives no records; very long pages need memory in proportion;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from hashlib import md5, sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalpanel.llm.shared import bounded_batches

DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"

# Elements that break a line.
BLOCK_TAGS = (
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul"
).split()

_HIDDEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|(script|style)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*>|\Z))", re.I | re.S)
_TAG = re.compile(r"""<(?:/?([a-z][^\s/<>]*)|[!?])(?:[^<>"']*(?:(?:"[^"<]*"|'[^'<]*')[^<>"']*)*|[^<>]*)>""", re.I)
_ANCHOR = re.compile(r"<a(?=[\s/])", re.I)
_BASE = re.compile(r"<base(?=[\s/])", re.I)
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s<>"'][^\s<>]*)))?""")
_TITLE = re.compile(r"<title(?=[\s/>])[^<>]*>(.*?)(?:</title|\Z)", re.I | re.S)
_BLANKS = re.compile("[\\x09\\x0B-\\x0D\\x20\\xA0]+")
_BREAKS = re.compile(r" ?\n[ \n]*")
_SPACES = re.compile("[\\x09-\\x0D\\x20\\xA0]+")
_REFERENCE = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?", re.S)
_breaks = frozenset(BLOCK_TAGS)


def plain_text(visible: str) -> str:
    """Text of a page without its hidden parts: block tags break lines, other tags go, spaces and empty lines collapse."""
    text = markup.unescape(_TAG.sub(lambda m: "\n" if (m[1] or "").lower() in _breaks else "", visible))
    return _BREAKS.sub("\n", _BLANKS.sub(" ", text)).strip(" \n")


def _attribute(tag_rest: str, at: int, name: str) -> str | None:
    """The first attribute of that name in the tag whose name ends at `at`."""
    while found := _ATTRIBUTE.match(tag_rest, at):
        if found[1].lower() == name:
            value = next((g for g in found.groups()[1:] if g is not None), "")
            return re.sub(r"[\t\r\n]", "", markup.unescape(value)).strip()
        at = found.end()
    return None


def _without_dots(path: str) -> str:
    """RFC 3986, section 5.2.4."""
    if "/." not in path and not path.startswith("."):
        return path
    kept: list[str] = []
    parts = path.split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "..":
            if len(kept) > 1 or (kept and kept[0] != ""):
                kept.pop()
            if last:
                kept.append("")
        elif part == ".":
            if last:
                kept.append("")
        else:
            kept.append(part)
    out = "/".join(kept)
    return out if out.startswith("/") or not path.startswith("/") else "/" + out


class Base:
    """An address that links are resolved from (RFC 3986, section 5.2.2)."""

    def __init__(self, url: str):
        self.scheme, self.host, self.path, self.query, _ = _REFERENCE.match(url).groups()

    def resolve(self, link: str) -> str:
        scheme, host, path, query, fragment = _REFERENCE.match(link).groups()
        if scheme is None:
            scheme = self.scheme
            if host is None:
                host = self.host
                if not path:
                    path, query = self.path, self.query if query is None else query
                elif path.startswith("/"):
                    path = _without_dots(path)
                elif self.host is not None and not self.path:
                    path = _without_dots("/" + path)
                else:
                    path = _without_dots(self.path[: self.path.rfind("/") + 1] + path)
            else:
                path = _without_dots(path)
        else:
            path = _without_dots(path)
        parts = [f"{scheme}:" if scheme is not None else "", f"//{host}" if host is not None else "", path]
        return "".join([*parts, f"?{query}" if query is not None else "", f"#{fragment}" if fragment is not None else ""])


def links(visible: str, url: str) -> list[str]:
    """The resolved targets of all anchors, in order, repeats included."""
    base = Base(url)
    for tag in _BASE.finditer(visible):
        target = _attribute(visible, tag.end(), "href")
        if target is not None:
            base = Base(base.resolve(target))
            break
    found = (_attribute(visible, tag.end(), "href") for tag in _ANCHOR.finditer(visible))
    return [base.resolve(x) for x in found if x is not None]


def title(visible: str) -> str:
    found = _TITLE.search(visible)
    return _SPACES.sub(" ", markup.unescape(found[1])).strip(" ") if found else ""


def split_record(record: str) -> tuple[list[tuple[str, str]], str]:
    """(headers in order, block). A folded header line is one line; the two line ends after a block go."""
    head, _, block = record.partition(END)
    return split_headers(head), block.removesuffix(END)


def split_headers(head: str) -> list[tuple[str, str]]:
    lines = re.sub(r"\r\n[ \t]+", " ", head).split("\r\n") if head else []
    return [(name.strip(), value.strip()) for name, colon, value in (line.partition(":") for line in lines) if colon]


def urn(text: str) -> str:
    d = md5(text.encode()).hexdigest()
    return f"<urn:uuid:{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:]}>"


def derivatives(record: str) -> list[dict]:
    """The metadata and the conversion record of a response; none of other records."""
    headers, block = split_record(record)
    first: dict[str, str] = {}
    for name, value in headers:
        first.setdefault(name.lower(), value)
    if first.get("warc-type", "").lower() != "response":
        return []
    http, empty_line, page = block.partition(END)
    status, page = (http.split("\r\n"), page) if empty_line else ([], block)
    visible = _HIDDEN.sub("", page)
    target = first.get("warc-target-uri", "")
    found = links(visible, target)
    fields = [("via", target), ("title", title(visible)), *(("source-header", f"{n}: {v}") for n, v in headers)]
    fields += [("http-status", status[0])] * bool(status) + [("http-header", f"{n}: {v}") for n, v in split_headers("\r\n".join(status[1:]))]
    fields += [("outlink", f"{x} L a/@href") for x in found]
    rows = []
    for kind, content_type, body in (
        ("metadata", "application/warc-fields", "".join(f"{n}: {v}\r\n" for n, v in fields)),
        ("conversion", "text/plain; charset=utf-8", plain_text(visible)),
    ):
        data = body.encode()
        digest = "sha256:" + sha256(data).hexdigest()
        refers_to = first.get("warc-record-id")
        record_id = urn("\n".join([kind, refers_to or "", digest]))
        lines = [
            ("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Refers-To", refers_to), ("WARC-Date", first.get("warc-date")), ("WARC-Target-URI", first.get("warc-target-uri")),
            ("WARC-Refers-To-Payload-Digest", first.get("warc-payload-digest")), ("WARC-Block-Digest", digest), ("Content-Type", content_type), ("Content-Length", str(len(data))),
        ]
        rows.append(
            {
                "kind": kind, "record_id": record_id, "refers_to": refers_to, "target_uri": first.get("warc-target-uri"), "date": first.get("warc-date"),
                "source_digest": first.get("warc-payload-digest"), "block_digest": digest, "content_length": len(data), "n_links": len(found), "block": body,
                "head": "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in lines if v is not None) + "\r\n",
            }
        )
    return rows


def _sha(column: str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(column, 256))


def _urn(text: Column) -> Column:
    parts = F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.concat(F.lit("<urn:uuid:"), parts, F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record): a WARC response record of each page (page_id, url, html)."""
    out = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    out = out.withColumn("payload", _sha("html")).withColumn("id", _urn(F.concat_ws("\n", F.lit("response"), "url", "payload")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END), F.col("html"))
    out = out.withColumn("block", http)
    headers = [
        ("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("id")), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.col("payload")),
        ("WARC-Block-Digest", _sha("block")), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length("block").cast("string")),
    ]
    lines = [part for name, value in headers for part in (F.lit(f"{name}: "), value, F.lit("\r\n"))]
    return out.select("page_id", F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), "block", F.lit(END)).alias("record"))


def parse(records: DataFrame) -> DataFrame:
    """records with headers (map, names in lower case, the first of repeated ones), fields (all headers in order) and block."""
    bounded_batches(records.sparkSession)
    kind = "headers map<string,string>, fields array<struct<name:string,value:string>>, block string"

    @F.pandas_udf(kind)
    def split(column: pd.Series) -> pd.DataFrame:
        rows = []
        for record in column:
            fields, block = split_record(record or "")
            rows.append(({n.lower(): v for n, v in reversed(fields)}, [{"name": n, "value": v} for n, v in fields], block))
        return pd.DataFrame(rows, columns=["headers", "fields", "block"])

    return records.withColumn("x_parts", split("record")).select(*records.columns, "x_parts.*")


def derive(records: DataFrame) -> DataFrame:
    """Two rows for each response record (page_id, record): page_id, kind, record_id, refers_to, target_uri,
    date, source_digest, block_digest, content_length, n_links, block and the whole record."""
    bounded_batches(records.sparkSession)
    kind = records.select("page_id").schema["page_id"].dataType.simpleString()
    names = "kind string, record_id string, refers_to string, target_uri string, date string, source_digest string, block_digest string, content_length long, n_links long, block string, head string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in names.split(", ")]
        for batch in batches:
            made = [derivatives(r or "") for r in batch["record"]]
            out = pd.DataFrame([row for rows in made for row in rows], columns=columns)
            out.insert(0, "page_id", batch["page_id"].repeat([len(rows) for rows in made]).to_numpy())
            yield out

    # a text column carries ids of any type through Python, nulls included
    rows = records.select(F.col("page_id").cast("string").alias("page_id"), "record").mapInPandas(run, f"page_id string, {names}")
    return rows.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("record", F.concat("head", "block", F.lit(END))).drop("head")


def write(records: DataFrame, path: str) -> None:
    """Records as gzip files, each of whole records; a record's last line end is the writer's."""
    body = F.substring(F.col("record"), F.lit(1), F.length("record") - 2).alias("record")
    records.select(body).write.option("compression", "gzip").option("lineSep", "\r\n").text(path)


def query(spark, sf_dir):
    out = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select(
        "page_id", "kind", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", "n_links", F.sha2("record", 256).alias("record_sha256")
    )


def _sql_decoded(text: str) -> str:
    """Named characters from the library's table, longest names first, and decimal and hexadecimal ones."""
    code = "CASE WHEN lower(e[3]) = 'x' THEN CAST('0x' || e[4:-2] AS BIGINT) ELSE CAST(e[3:-2] AS BIGINT) END"
    out = f"list_reduce(list_prepend({text}, list_distinct(regexp_extract_all({text}, '&#(?:[0-9]{{1,7}}|[xX][0-9A-Fa-f]{{1,6}});'))), lambda t, e: replace(t, e, chr(CAST({code} AS INTEGER))))"
    for name in ("quot", "lt", "gt", "apos", "nbsp", "copy", "middot", "hellip", "ndash", "mdash", "reg", "euro", "eacute", "uuml", "ntilde", "amp"):
        out = "replace({}, '&{};', '{}')".format(out, name, markup.unescape(f"&{name};").replace("'", "''"))
    return out


#: Written for pages as the tables hold them: closed comments and scripts, tags without ">" in
#: attributes, named characters of the list above, links without dot segments.
SQL = rf"""
WITH p AS (
  SELECT page_id, regexp_replace(coalesce(url, ''), '[\r\n]', '', 'g') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS nl FROM pages
), r AS (
  SELECT *, 'sha256:' || sha256(html) AS payload,
         'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(html) || nl || nl || html AS http
  FROM p
), i AS (
  SELECT *, md5('response' || chr(10) || url || chr(10) || payload) AS h,
         regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:script|style)(?:\s[^>]*)?>.*?</(?:script|style)>', '', 'g') AS visible
  FROM r
), j AS (
  SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:] || '>' AS id,
         split_part(url, '#', 1) AS page, regexp_extract(url, '^[^:/?#]+:') AS scheme, regexp_extract(url, '^[^:/?#]+://[^/?#]*') AS origin FROM i
), b AS (
  SELECT *, split_part(page, '?', 1) AS bare_page FROM j
), l AS (
  SELECT *, list_transform(list_transform(regexp_extract_all(visible, '(?i)<a\s(?:[^>]*\s)?href="([^"]*)"', 1), lambda x: trim({_sql_decoded("x")})),
           lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN x WHEN x LIKE '//%' THEN scheme || x WHEN x LIKE '/%' THEN origin || x
             WHEN x = '' THEN page WHEN x LIKE '#%' THEN page || x WHEN x LIKE '?%' THEN bare_page || x WHEN bare_page = origin THEN origin || '/' || x
             ELSE regexp_replace(bare_page, '[^/]*$', '') || x END) AS links,
         trim(regexp_replace({_sql_decoded("regexp_extract(visible, '(?is)<title>(.*?)</title>', 1)")}, '[\x09-\x0D\x20\xA0]+', ' ', 'g'), ' ') AS title,
         regexp_replace(regexp_replace(visible, '(?i)</?(?:{"|".join(BLOCK_TAGS)})(?:[\s/][^<>]*)?>', chr(10), 'g'), '<[/!?]?[A-Za-z][^<>]*>', '', 'g') AS bare
  FROM b
), t AS (
  SELECT *, trim(regexp_replace(regexp_replace({_sql_decoded("bare")}, '[\x09\x0B-\x0D\x20\xA0]+', ' ', 'g'), '(?: ?\n)+ ?', chr(10), 'g'), ' ' || chr(10)) AS plain,
         [('WARC-Type: response'), ('WARC-Record-ID: ' || id), ('WARC-Date: {DATE}'), ('WARC-Target-URI: ' || url), ('WARC-Payload-Digest: ' || payload),
          ('WARC-Block-Digest: sha256:' || sha256(http)), ('Content-Type: application/http; msgtype=response'), ('Content-Length: ' || strlen(http))] AS source_headers,
         ['Content-Type: text/html; charset=utf-8', 'Content-Length: ' || strlen(html)] AS http_headers
  FROM l
), k AS (
  SELECT page_id, id, url, payload, nl, len(links) AS n_links, 'metadata' AS kind, 'application/warc-fields' AS type,
         'via: ' || url || nl || 'title: ' || title || nl || array_to_string(list_transform(source_headers, lambda x: 'source-header: ' || x || nl), '')
         || 'http-status: HTTP/1.1 200 OK' || nl || array_to_string(list_transform(http_headers, lambda x: 'http-header: ' || x || nl), '')
         || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || ' L a/@href' || nl), ''), '') AS block FROM t
  UNION ALL
  SELECT page_id, id, url, payload, nl, len(links), 'conversion', 'text/plain; charset=utf-8', plain FROM t
), d AS (
  SELECT *, 'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length FROM k
), e AS (
  SELECT *, md5(kind || chr(10) || id || chr(10) || block_digest) AS h FROM d
), u AS (
  SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:] || '>' AS record_id FROM e
)
SELECT page_id, kind, record_id, id AS refers_to, url AS target_uri, payload AS source_digest, block_digest, CAST(content_length AS BIGINT) AS content_length, CAST(n_links AS BIGINT) AS n_links,
       sha256('WARC/1.1' || nl || 'WARC-Type: ' || kind || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Refers-To: ' || id || nl || 'WARC-Date: {DATE}' || nl || 'WARC-Target-URI: ' || url || nl
         || 'WARC-Refers-To-Payload-Digest: ' || payload || nl || 'WARC-Block-Digest: ' || block_digest || nl || 'Content-Type: ' || type || nl || 'Content-Length: ' || content_length || nl || nl || block || nl || nl) AS record_sha256
FROM u
"""
