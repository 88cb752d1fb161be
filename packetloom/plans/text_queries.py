"""Decoding, anonymising, parsing and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import decode, httpparse, masking
from packetloom.functions.text import text_or_empty
from packetloom.operators import enrich, profile
from packetloom.plans.registry import query, quoted, sql
from packetloom.sources.fixtures import fixture, read_table
from packetloom.sources.samples import GEO_RANGES


@query(sql("SELECT event_id, url_decode(url_decode(payload)) AS decoded FROM traffic"))
def percent_decoded_payloads(spark, sf_dir):
    """Two rounds of percent decoding."""
    rows = fixture(spark, sf_dir, "traffic")
    return rows.select("event_id", decode.double_percent_decode(F.col("payload")).alias("decoded"))


@query()
def base64_decoded_payloads(spark, sf_dir):
    """Base64 segments between percent escapes decoded in place."""
    rows = fixture(spark, sf_dir, "traffic")
    return rows.select("event_id", decode.decode_base64_segments(F.col("payload")).alias("decoded"))


@query(
    sql(
        "SELECT event_id, list_reduce(list_prepend(payload, "
        r"regexp_extract_all(payload, '\|((?:[0-7][0-9a-fA-F])+)\|', 1)), "
        "lambda acc, h: replace(acc, '|' || h || '|', '|' || decode(unhex(h)) || '|')) AS decoded "
        "FROM traffic"
    )
)
def hex_decoded_payloads(spark, sf_dir):
    """Hex blocks between bars to text."""
    rows = fixture(spark, sf_dir, "traffic")
    return rows.select("event_id", decode.decode_hex_blocks(F.col("payload")).alias("decoded"))


@query()
def decoded_payloads(spark, sf_dir):
    """The whole decoding: base64, hex, percent twice."""
    rows = fixture(spark, sf_dir, "traffic")
    return decode.with_decoded(rows, "payload", "decoded").select("event_id", "decoded")


@query(
    sql(
        "SELECT event_id, replace(replace(translate(payload, chr(10) || chr(13) || chr(9), '   '), "
        "'<', '%26lt%3B'), '>', '%26gt%3B') AS shown FROM traffic"
    )
)
def display_clean_payloads(spark, sf_dir):
    """Control characters and angle brackets made harmless."""
    rows = fixture(spark, sf_dir, "traffic")
    return rows.select("event_id", decode.display_clean(F.col("payload")).alias("shown"))


# The reference SQL has no look-around: addresses behind a version prefix are
# taken apart with a marker first, hosts are matched with their surroundings.
_MARK = "chr(1)"
_SQL_IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
_SQL_HOST = r"(?i)(://|%3a%2f%2f|www\.|host: )(.*?)(\.go\.kr|\.or\.kr|\.com|\.co\.kr)"
_SQL_PATTERNS = {
    "email": (r"([a-zA-Z0-9_.-]+)@([a-zA-Z0-9_-]+\.)", r"abc@\2", 1),
    "card": (r"[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}", "1234-XXXX-XXXX-XXXX", 0),
    "phone": (r"[0-9]{2,3}-[0-9]{3,4}-[0-9]{4}", "010-XXXX-XXXX", 0),
    "resident": (r"[0-9]{6}-[0-9]{7}", "123456-*******", 0),
    "name": ("[가-힣]{2,4}", "홍길동", 0),
}


def _marked(c: str) -> str:
    return f"regexp_replace({c}, '(\\w/[0-9]+)\\.', '\\1' || {_MARK}, 'g')"


def mask_sql(kind: str, c: str) -> str:
    if kind == "ip":
        return f"replace(regexp_replace({_marked(c)}, '{_SQL_IP}', '10.10.123.123', 'g'), {_MARK}, '.')"
    if kind == "host":
        return f"regexp_replace({c}, {quoted(_SQL_HOST)}, '\\1*****\\3', 'g')"
    pattern, put, _ = _SQL_PATTERNS[kind]
    return f"regexp_replace({c}, {quoted(pattern)}, {quoted(put)}, 'g')"


def found_sql(kind: str, c: str) -> str:
    if kind == "ip":
        return f"regexp_extract_all({_marked(c)}, '{_SQL_IP}')"
    if kind == "host":
        return f"regexp_extract_all({c}, {quoted(_SQL_HOST)}, 2)"
    pattern, _, group = _SQL_PATTERNS[kind]
    return f"regexp_extract_all({c}, {quoted(pattern)}, {group})"


def chain_sql(kinds: list[str], source: str, text: str, keep: str) -> str:
    """SELECT with m0 (the text) and m1.. (after each mask)."""
    out = f"SELECT {keep}, {text} AS m0 FROM {source}"
    for i, kind in enumerate(kinds):
        out = f"SELECT *, {mask_sql(kind, f'm{i}')} AS m{i + 1} FROM ({out})"
    return out


PAYLOAD_KINDS = [m.name for m in masking.PAYLOAD_MASKS]
WEBLOG_KINDS = [m.name for m in masking.WEBLOG_MASKS]


def _single_mask(mask: masking.Mask) -> None:
    def build(spark, sf_dir):
        rows = fixture(spark, sf_dir, "pii_text")
        return rows.select("event_id", masking.apply_mask(F.col("text"), mask).alias("masked"))

    build.__name__ = f"mask_{mask.name}"
    build.__doc__ = f"Text with every {mask.name} masked."
    query(sql(f"SELECT event_id, {mask_sql(mask.name, 'text')} AS masked FROM pii_text"))(build)


for _m in masking.PAYLOAD_MASKS:
    _single_mask(_m)


@query(
    sql(
        "SELECT event_id, m7 AS masked FROM c",
        c=chain_sql(PAYLOAD_KINDS, "traffic", "payload", "event_id"),
    )
)
def mask_payloads(spark, sf_dir):
    """All payload masks in order."""
    rows = fixture(spark, sf_dir, "traffic")
    return masking.with_masked(rows, "payload", "masked").select("event_id", "masked")


@query(
    sql(
        "SELECT event_id, m5 AS masked FROM c",
        c=chain_sql(WEBLOG_KINDS, "pii_text", "text", "event_id"),
    )
)
def mask_weblog_text(spark, sf_dir):
    """The log masks: addresses and hosts stay for the enrichment."""
    rows = fixture(spark, sf_dir, "pii_text")
    return masking.with_masked(rows, "text", "masked", masking.WEBLOG_MASKS).select(
        "event_id", "masked"
    )


@query(
    sql(
        "SELECT doc_id, m7 AS masked FROM c",
        c=chain_sql(PAYLOAD_KINDS, "documents", "text", "doc_id"),
    )
)
def mask_documents(spark, sf_dir):
    """All payload masks over whole documents."""
    rows = read_table(spark, sf_dir, "documents")
    return masking.with_masked(rows, "text", "masked").select("doc_id", "masked")


def _findings_sql() -> str:
    parts = []
    for i, kind in enumerate(PAYLOAD_KINDS):
        parts.append(
            f"SELECT event_id, '{kind}' AS kind, unnest(l) AS item, "
            f"CAST(generate_subscripts(l, 1) AS INT) AS item_no "
            f"FROM (SELECT event_id, {found_sql(kind, f'm{i}')} AS l FROM c)"
        )
    return " UNION ALL ".join(parts)


_CHAIN = chain_sql(PAYLOAD_KINDS, "pii_text", "text", "event_id")


@query(sql(_findings_sql(), c=_CHAIN))
def personal_data_items(spark, sf_dir):
    """Every item the masks take out, in order."""
    rows = fixture(spark, sf_dir, "pii_text")
    return masking.findings(rows, "text", ["event_id"]).select(
        "event_id", "kind", "item", "item_no"
    )


@query(
    sql(
        "SELECT event_id, kind, count(*) AS n_items, string_agg(item, ', ' ORDER BY item_no) AS items "
        "FROM found GROUP BY event_id, kind",
        c=_CHAIN,
        found=_findings_sql(),
    )
)
def personal_data_report(spark, sf_dir):
    """List and count of the items per text and kind."""
    rows = fixture(spark, sf_dir, "pii_text")
    return masking.findings_report(rows, "text", ["event_id"])


_TOKENS = "(?i)" + "|".join(masking.literal_regex(m.token) for m in masking.PAYLOAD_MASKS)


@query(
    sql(
        "SELECT event_id, k AS span_no, tokens[k] AS token, "
        "CAST(coalesce(list_sum(list_transform(pieces[1:k], lambda x: length(x))), 0) "
        "+ coalesce(list_sum(list_transform(tokens[1:k - 1], lambda x: length(x))), 0) AS INT) AS start_at, "
        "CAST(coalesce(list_sum(list_transform(pieces[1:k], lambda x: length(x))), 0) "
        "+ coalesce(list_sum(list_transform(tokens[1:k], lambda x: length(x))), 0) AS INT) AS end_at "
        "FROM (SELECT event_id, pieces, tokens, CAST(generate_subscripts(tokens, 1) AS INT) AS k FROM s)",
        c=_CHAIN,
        s=f"SELECT event_id, string_split_regex(m7, {quoted(_TOKENS)}) AS pieces, "
        f"regexp_extract_all(m7, {quoted(_TOKENS)}) AS tokens FROM c",
    )
)
def masked_token_spans(spark, sf_dir):
    """Positions of the stand-in texts."""
    rows = masking.with_masked(fixture(spark, sf_dir, "pii_text"), "text", "masked")
    return masking.masked_spans(rows, "masked", ["event_id"])


def _after(c: str, sep: str) -> str:
    return f"CASE WHEN strpos({c}, {quoted(sep)}) > 0 THEN substr({c}, strpos({c}, {quoted(sep)}) + {len(sep)}) END"


def _before(c: str, sep: str) -> str:
    return f"split_part({c}, {quoted(sep)}, 1)"


def _dash(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN '-' ELSE {c} END"


_METHOD_LIST = ", ".join(quoted(m) for m in httpparse.METHODS)
_URL_QUERY = f"CASE WHEN contains(uq, '?') THEN '?' || {_after('uq', '?')} ELSE '' END"

REQUESTS_SQL = f"""
SELECT event_id,
  CASE WHEN ok THEN {_dash('m')} ELSE '-' END AS http_method,
  CASE WHEN ok THEN {_dash(_before('uq', '?'))} ELSE '-' END AS http_url,
  CASE WHEN ok THEN CASE WHEN starts_with(q, '?') THEN substr(q, 2) ELSE q END ELSE '-' END AS http_query,
  CASE WHEN ok AND b <> '' THEN substr(b, 1, 8) ELSE '-' END AS http_version,
  CASE WHEN NOT ok THEN {_dash('p')} WHEN b = '' THEN '-' ELSE {_dash('substr(b, 9)')} END AS http_body,
  CASE WHEN ok THEN 'ok' ELSE 'abnormal' END AS parse_status
FROM (SELECT *, {_dash('(' + _URL_QUERY + ')')} AS q FROM (
  SELECT *, lower(m) IN ({_METHOD_LIST}) AND r IS NOT NULL AS ok, {_before('r', ' HTTP/1.')} AS uq,
    CASE WHEN contains(r, 'HTTP/1.1') THEN 'HTTP/1.1' || {_after('r', 'HTTP/1.1')}
      WHEN contains(r, 'HTTP/1.0') THEN 'HTTP/1.0' || {_after('r', 'HTTP/1.0')} ELSE '' END AS b
  FROM (SELECT event_id, p, {_before('p', ' ')} AS m, {_after('p', ' ')} AS r
    FROM (SELECT event_id, CASE WHEN starts_with(payload, chr(34)) THEN substr(payload, 2)
      ELSE coalesce(payload, '') END AS p FROM traffic))))
"""


@query(sql(REQUESTS_SQL))
def parsed_requests(spark, sf_dir):
    """Payloads as method, url, query, version and body."""
    rows = httpparse.parse_requests(fixture(spark, sf_dir, "traffic"), "payload")
    return rows.select("event_id", *httpparse.REQUEST_FIELDS, "parse_status")


def _no_quotes(c: str) -> str:
    return f"CASE WHEN ok THEN {_dash(f"replace({c}, chr(34), '')")} END"


PARSED_LOGS_SQL = f"""
SELECT event_id, web_log, {_no_quotes('m')} AS http_method, {_no_quotes(_before('uq', '?'))} AS http_url,
  {_no_quotes("(CASE WHEN starts_with(q, '?') THEN substr(q, 2) ELSE q END)")} AS http_query,
  {_no_quotes('v')} AS http_version, {_no_quotes('ua')} AS user_agent,
  CASE WHEN four THEN 'combined' ELSE 'iis' END AS log_type,
  CASE WHEN ok THEN 'web log' ELSE 'not a web log' END AS parse_status
FROM (SELECT *, {_URL_QUERY} AS q,
    coalesce(lower(m) IN ({_METHOD_LIST}) AND r IS NOT NULL AND ua IS NOT NULL, false) AS ok
  FROM (SELECT *, CASE WHEN four THEN {_before('sp', ' ')} ELSE {_before('iv', ' ')} END AS v,
      CASE WHEN four THEN {_before("(CASE WHEN starts_with(ag, ' ' || chr(34)) THEN substr(ag, 3) ELSE ag END)", '"')}
        ELSE {_before('(' + _after('iv', ' ') + ')', ' ')} END AS ua
    FROM (SELECT *, {_after('a4', '"')} AS ag FROM (SELECT *, {_after('a3', ' ')} AS a4
      FROM (SELECT *, {_after('a2', ' ')} AS a3 FROM (SELECT *, {_after('a1', ' ')} AS a2
        FROM (SELECT *, {_after('sp', ' ')} AS a1 FROM (SELECT *,
          CASE WHEN length(au) >= 9 THEN CASE WHEN substr(au, 9, 1) <> ' '
            THEN substr(au, 1, 8) || substr(au, 10) ELSE au END END AS sp,
          CASE WHEN len(regexp_extract_all(rq, '(?i)http/(.*)')) = 1
            THEN 'HTTP/' || regexp_extract(rq, '(?i)http/(.*)', 1) END AS iv
          FROM (SELECT *, {_before('r', ' ')} AS uq, coalesce({_after('r', ' ')}, '') AS au
            FROM (SELECT *, {_before('rq', ' ')} AS m, {_after('rq', ' ')} AS r
              FROM (SELECT *, CASE WHEN four THEN {_after('line', '"')}
                  WHEN len(string_split(line, ' ')) >= 5 THEN array_to_string(string_split(line, ' ')[5:], ' ') END AS rq
                FROM (SELECT *, length(line) - length(replace(line, chr(34), '')) >= 4 AS four
                  FROM (SELECT event_id, web_log,
                    replace(coalesce(web_log, ''), chr(34) || chr(34), chr(34) || ' ' || chr(34)) AS line
                    FROM weblogs)))))))))))))
"""


@query(sql(PARSED_LOGS_SQL.replace("SELECT event_id, web_log,", "SELECT event_id,", 1)))
def parsed_weblogs(spark, sf_dir):
    """Apache, NGINX and IIS lines as HTTP fields, other lines marked."""
    rows = httpparse.parse_weblogs(fixture(spark, sf_dir, "weblogs"), "web_log")
    return rows.select("event_id", *httpparse.WEBLOG_FIELDS, "log_type", "parse_status")


@query(
    sql(
        "SELECT event_id, CASE WHEN m IS NULL OR m = '-' OR p = 0 THEN web_log "
        "ELSE m || CASE WHEN strpos(rest, m) > 0 THEN substr(rest, 1, strpos(rest, m) - 1) ELSE rest END "
        "END AS scored_text FROM (SELECT *, substr(web_log, p + length(m)) AS rest FROM "
        "(SELECT event_id, web_log, http_method AS m, coalesce(strpos(web_log, http_method), 0) AS p FROM logs))",
        logs=PARSED_LOGS_SQL,
    )
)
def log_text_from_method(spark, sf_dir):
    """The part of a log line that the text model scores."""
    rows = httpparse.parse_weblogs(fixture(spark, sf_dir, "weblogs"), "web_log")
    return rows.select(
        "event_id",
        httpparse.from_method(F.col("web_log"), F.col("http_method")).alias("scored_text"),
    )


_FIRST_IP = f"nullif(regexp_extract({_marked('web_log')}, '{_SQL_IP}'), '')"


@query(sql(f"SELECT event_id, {_FIRST_IP} AS source_ip FROM weblogs"))
def source_addresses(spark, sf_dir):
    """The first address of every log line."""
    rows = fixture(spark, sf_dir, "weblogs")
    return rows.select("event_id", httpparse.first_ip(F.col("web_log")).alias("source_ip"))


_IP_NUMBER = " + ".join(
    f"CAST(split_part(source_ip, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5)
)
_COUNTRY = dict(
    ips=f"SELECT event_id, {_FIRST_IP} AS source_ip FROM weblogs",
    numbers=f"SELECT event_id, source_ip, {_IP_NUMBER} AS n FROM ips",
    located="SELECT event_id, source_ip, coalesce(g.country, 'not found') AS country FROM numbers "
    f"LEFT JOIN ({GEO_RANGES.sql()}) g ON n >= g.start_ip AND n <= g.end_ip",
)


def _located(spark, sf_dir):
    rows = fixture(spark, sf_dir, "weblogs").select(
        "event_id", httpparse.first_ip(F.col("web_log")).alias("source_ip")
    )
    return enrich.with_country(rows, "source_ip", GEO_RANGES.to_df(spark))


@query(sql("SELECT event_id, source_ip, country FROM located", **_COUNTRY))
def source_countries(spark, sf_dir):
    """The country of every source address."""
    return _located(spark, sf_dir)


@query(sql("SELECT country, count(*) AS n FROM located GROUP BY country", **_COUNTRY))
def country_counts(spark, sf_dir):
    """Log lines per source country."""
    return profile.value_counts(_located(spark, sf_dir), "country")


@query(
    sql(
        "SELECT event_id, regexp_replace(user_agent, '[^a-zA-Z]+', ' ', 'g') AS agent_words FROM logs "
        "WHERE parse_status = 'web log'",
        logs=PARSED_LOGS_SQL,
    )
)
def agent_words(spark, sf_dir):
    """Normalised user agents of the parsed lines."""
    rows = httpparse.parse_weblogs(fixture(spark, sf_dir, "weblogs"), "web_log")
    return rows.where("parse_status = 'web log'").select(
        "event_id", httpparse.agent_words(F.col("user_agent")).alias("agent_words")
    )


@query()
def cleaned_online_payloads(spark, sf_dir):
    """The online path in front of the rules: clean, decode, mask, parse."""
    rows = fixture(spark, sf_dir, "traffic")
    shown = rows.withColumn("__shown", decode.display_clean(text_or_empty(F.col("payload"))))
    decoded = decode.with_decoded(shown, "__shown", "__decoded")
    masked = masking.with_masked(decoded, "__decoded", "clean_payload")
    parsed = httpparse.parse_requests(masked, "clean_payload")
    return parsed.select("event_id", "clean_payload", *httpparse.REQUEST_FIELDS, "parse_status")
