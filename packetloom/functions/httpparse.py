"""Split requests and web-server log lines into HTTP fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.masking import IP_SEARCH
from packetloom.functions.text import FAR, after, before, dash_if_empty, text_or_empty

# Fixed values.
METHODS = (
    "",
    "upload",
    "get",
    "profind",
    "put",
    "options",
    "head",
    "trace",
    "connect",
    "delete",
    "post",
    "patch",
)
REQUEST_FIELDS = ["http_method", "http_url", "http_query", "http_version", "http_body"]
WEBLOG_FIELDS = ["http_method", "http_url", "http_query", "http_version", "user_agent"]


def _from(c: Column, start: int) -> Column:
    return F.substr(c, F.lit(start), F.lit(FAR))


def _query(url_query: Column) -> Column:
    return F.coalesce(F.concat(F.lit("?"), after(url_query, "?")), F.lit(""))


def _without_question_mark(c: Column) -> Column:
    return F.regexp_replace(c, r"^\?", "")


def parse_requests(df: DataFrame, payload_col: str) -> DataFrame:
    """Add the request fields and ``parse_status`` (``ok`` or ``abnormal``).

    A payload that does not start with a known method keeps everything in
    ``http_body``.  ``-`` stands for a missing field.
    """
    text = text_or_empty(F.col(payload_col))
    df = df.withColumn("__p", F.when(text.startswith('"'), _from(text, 2)).otherwise(text))
    p = F.col("__p")
    df = df.withColumns({"__method": before(p, " "), "__rest": after(p, " ")})
    rest = F.col("__rest")
    df = df.withColumns(
        {
            "__ok": F.lower("__method").isin(*METHODS) & rest.isNotNull(),
            "__url_query": before(rest, " HTTP/1."),
            "__tail": F.when(
                F.contains(rest, F.lit("HTTP/1.1")),
                F.concat(F.lit("HTTP/1.1"), after(rest, "HTTP/1.1")),
            )
            .when(
                F.contains(rest, F.lit("HTTP/1.0")),
                F.concat(F.lit("HTTP/1.0"), after(rest, "HTTP/1.0")),
            )
            .otherwise(""),
        }
    )
    ok, tail = F.col("__ok"), F.col("__tail")
    versioned = tail != ""
    fields = {
        "http_method": dash_if_empty(F.col("__method")),
        "http_url": dash_if_empty(before(F.col("__url_query"), "?")),
        "http_query": _without_question_mark(dash_if_empty(_query(F.col("__url_query")))),
        "http_version": F.when(versioned, F.substr(tail, F.lit(1), F.lit(8))).otherwise("-"),
        "http_body": dash_if_empty(F.when(versioned, _from(tail, 9)).otherwise("")),
    }
    out = {k: F.when(ok, v).otherwise("-") for k, v in fields.items()}
    out["http_body"] = F.when(ok, fields["http_body"]).otherwise(dash_if_empty(p))
    out["parse_status"] = F.when(ok, "ok").otherwise("abnormal")
    helpers = ["__p", "__method", "__rest", "__ok", "__url_query", "__tail"]
    return df.withColumns(out).drop(*helpers)


def parse_weblogs(df: DataFrame, log_col: str) -> DataFrame:
    """Add the log fields, ``log_type`` and ``parse_status``.

    Lines with four or more double quotes are read as Apache or NGINX lines,
    others as IIS lines.  A line that fits neither gets ``not a web log`` and
    NULL fields; nothing is thrown.
    """
    quoted = F.replace(text_or_empty(F.col(log_col)), F.lit('""'), F.lit('" "'))
    df = df.withColumn("__line", quoted)
    line = F.col("__line")
    df = df.withColumn(
        "__combined", F.length(line) - F.length(F.translate(line, '"', "")) >= 4
    )
    combined = F.col("__combined")
    fifth = F.get(F.split(line, " ", 5), F.lit(4))
    df = df.withColumn("__request", F.when(combined, after(line, '"')).otherwise(fifth))
    request = F.col("__request")
    df = df.withColumns({"__method": before(request, " "), "__rest": after(request, " ")})
    rest = F.col("__rest")
    df = df.withColumns(
        {
            "__url_query": before(rest, " "),
            "__after_url": F.coalesce(after(rest, " "), F.lit("")),
        }
    )

    # Apache and NGINX: version, status, bytes, referer, then the quoted agent
    behind = F.col("__after_url")
    # a ninth character other than a blank (the closing quote) is taken out
    spaced = F.regexp_replace(behind, "(?s)^(.{8})[^ ]", "$1")
    df = df.withColumn("__spaced", F.when(F.length(behind) >= 9, spaced))
    after_version = after(F.col("__spaced"), " ")
    after_status = after(after_version, " ")
    df = df.withColumn("__after_bytes", after(after_status, " "))
    after_referer = after(F.col("__after_bytes"), " ")
    df = df.withColumn("__agent", after(after_referer, '"'))
    combined_agent = before(F.regexp_replace("__agent", '^ "', ""), '"')

    # IIS: the only http/... to the end of its line, then the next token
    one_version = F.regexp_count(request, F.lit("(?id)http/(.*)")) == 1
    df = df.withColumn(
        "__versions",
        F.when(
            one_version,
            F.concat(F.lit("HTTP/"), F.regexp_extract(request, "(?id)http/(.*)", 1)),
        ),
    )
    iis_agent = before(after(F.col("__versions"), " "), " ")

    fields = {
        "http_method": F.col("__method"),
        "http_url": before(F.col("__url_query"), "?"),
        "http_query": _without_question_mark(_query(F.col("__url_query"))),
        "http_version": before(
            F.when(combined, F.col("__spaced")).otherwise(F.col("__versions")), " "
        ),
        "user_agent": F.when(combined, combined_agent).otherwise(iis_agent),
    }
    ok = (
        F.lower("__method").isin(*METHODS)
        & rest.isNotNull()
        & fields["user_agent"].isNotNull()
    )
    df = df.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    out = {
        k: F.when(F.col("__ok"), dash_if_empty(F.translate(v, '"', ""))) for k, v in fields.items()
    }
    out["log_type"] = F.when(combined, "combined").otherwise("iis")
    out["parse_status"] = F.when(F.col("__ok"), "web log").otherwise("not a web log")
    return df.withColumns(out).drop(
        "__line", "__combined", "__request", "__method", "__rest", "__url_query",
        "__after_url", "__spaced", "__after_bytes", "__agent", "__versions", "__ok",
    )


def first_ip(c: Column) -> Column:
    """The first address in a line, NULL when there is none."""
    found = F.regexp_extract(c, IP_SEARCH, 0)
    return F.when(found != "", found)


def from_method(log: Column, method: Column) -> Column:
    """The log text from the method on, up to a second occurrence of it."""
    at = F.position(method, log)
    behind = F.substr(log, at + F.length(method), F.lit(FAR))
    upto = F.position(method, behind)
    cut = F.when(upto > 0, F.substr(behind, F.lit(1), upto - 1)).otherwise(behind)
    return F.when(method.isNotNull() & (method != "-") & (at > 0), F.concat(method, cut)).otherwise(
        log
    )


def agent_words(agent: Column) -> Column:
    """Everything but Latin letters becomes one blank."""
    return F.regexp_replace(agent, "[^a-zA-Z]+", " ")
