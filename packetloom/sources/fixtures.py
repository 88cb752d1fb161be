"""Derived tables for tests and benchmarks.

The given ``events`` table carries no attack text.  The views below turn every
event into a request, a log line or a text with personal data, chosen by the
event id, so their size and skew follow the given table.  Each view is one SQL
text that Spark and other SQL engines read the same way.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession

from packetloom.functions.matching import GAP, instr_text, unescaped
from packetloom.functions.rulesets import FAMILIES, NOT_WORD
from packetloom.sources.dims import Dim

_FILLERS = (" ", "\t", "\n", "+x1+", "%20", " y2 ")


def sample_text(pattern: str, filler: str) -> str:
    """A text that the pattern matches, with ``filler`` in its gaps."""
    out = pattern.replace(GAP, filler).replace("(.?)", "-").replace(NOT_WORD, "(")
    return unescaped(out)


def _samples() -> list[tuple[str, str, str]]:
    """(kind, text in the request line, text behind it) per rule alternative."""
    out: list[tuple[str, str, str]] = []
    seen = set()
    fillers = count()
    for fam in ("ips", "web", "ips_training", "waf_v1"):
        for rule in FAMILIES[fam].rules:
            for alt in rule.alts:
                key = (alt.pattern, alt.scope, alt.needs)
                if key in seen:
                    continue
                seen.add(key)
                filler = _FILLERS[next(fillers) % len(_FILLERS)]
                text = instr_text(alt) if alt.literal else sample_text(alt.pattern, filler)
                if alt.needs:
                    text = sample_text(alt.needs, filler) + text
                if alt.scope == "tail":
                    out.append(("attack", "", text))
                else:
                    out.append(("attack", text, ""))
    # near misses and plain requests
    plain = [
        "name=blue+lamp",
        "cols=red;green;blue",
        "a=1&b=2&c=3",
        "page=2",
        "from=seoul",
        "order by",
        "union",
        "cat",
        "wp_login",
        "robot.txt",
        "../img/logo.png",
        "..%2f..%2f",
        "%2e%2e%2fetc",
        "%252e%252e%252fetc%252fhosts",
        "q=%E3%81%82%zz%4",
        "sig=|2e2e2f6574632f|",
        "sig=|414|x|00ff|",
        "x%3dc2VsZWN0IDEgZnJvbSB0%26y",
        "x%3dTWFu%3d",
        "x%3d==%3d",
        "{$('<@*'>)}",
        "say=\"hi\"",
        " and ",
        "+or+",
        "%20select%20",
    ]
    out += [("plain", text, "") for text in plain]
    out += [("plain", "", f" rev {i}") for i in range(60)]
    out += [("empty", "", ""), ("null", "", ""), ("twice", "id=7", ""), ("bare", "id=8", "")]
    return out


SAMPLES = Dim(
    "slot INT, kind STRING, line_text STRING, tail_text STRING",
    [(i, kind, line, tail) for i, (kind, line, tail) in enumerate(_samples())],
)
N_SLOTS = len(SAMPLES.rows)

AGENTS = Dim(
    "agent_no INT, agent STRING, agent_class STRING",
    list(
        (i, *row)
        for i, row in enumerate(
            [
                ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/118.0.0.0 Safari/537.36", "application"),
                ("Mozilla/5.0 (Macintosh; Intel Mac OS X 13_5) AppleWebKit/605.1.15 Version/16.6 Safari/605.1.15", "application"),
                ("Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/118.0", "application"),
                ("Mozilla/5.0 (iPhone; CPU iPhone OS 16_6 like Mac OS X) Mobile/15E148", "application"),
                ("okhttp/4.9.3", "application"),
                ("Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", "normal_bot_crawler"),
                ("Mozilla/5.0 (compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm)", "normal_bot_crawler"),
                ("DuckDuckBot/1.0; (+http://duckduckgo.com/duckduckbot.html)", "normal_bot_crawler"),
                ("Mozilla/5.0 (compatible; Yeti/1.1; +http://naver.me/spd)", "normal_bot_crawler"),
                ("facebookexternalhit/1.1", "normal_bot_crawler"),
                ("Mozilla/5.0 zgrab/0.x", "bad_bot_crawler"),
                ("sqlmap/1.7.2#stable (https://sqlmap.org)", "bad_bot_crawler"),
                ("masscan/1.3 (https://github.com/robertdavidgraham/masscan)", "bad_bot_crawler"),
                ("Mozilla/5.00 (Nikto/2.1.6) (Evasions:None) (Test:Port Check)", "bad_bot_crawler"),
                ("curl/7.88.1", "bad_bot_crawler"),
                ("gobuster/3.5", "bad_bot_crawler"),
                ("-", "application"),
            ]
        )
    ),
)

# user id to address; four octets that spread over many first octets
_IP = (
    "CAST(user_id % 223 + 1 AS STRING) || '.' || CAST(user_id % 251 AS STRING) || '.' || "
    "CAST(event_id % 256 AS STRING) || '.' || CAST(user_id % 97 + 1 AS STRING)"
)

TRAFFIC_SQL = f"""
SELECT e.event_id, e.ts, e.user_id, e.event_type,
  CASE s.kind
    WHEN 'null' THEN NULL
    WHEN 'empty' THEN ''
    WHEN 'bare' THEN '@' || s.line_text || ' ' || CAST(e.event_id AS STRING)
    ELSE e.verb || ' /item/' || CAST(e.event_id AS STRING) || '?'
      || CASE WHEN e.turn % 3 = 1 THEN upper(s.line_text) ELSE s.line_text END
      || ' HTTP/1.' || CASE WHEN e.event_id % 7 = 0 THEN '0' ELSE '1' END
      || chr(13) || chr(10) || 'Host: www.site' || CAST(e.user_id AS STRING) || '.co.kr'
      || chr(13) || chr(10) || 'X-From: ' || e.ip
      || chr(13) || chr(10) || 'Agent: ' || a.agent || s.tail_text
      || CASE WHEN s.kind = 'twice'
           THEN chr(10) || 'GET /item/2 HTTP/1.1' || chr(10) || 'POST /item/3 HTTP/1.1'
           ELSE '' END
  END AS payload,
  CASE WHEN s.kind = 'attack' THEN 'anomalies' ELSE 'normal' END AS label
FROM (
  SELECT event_id, ts, user_id, event_type, {_IP} AS ip,
    CASE event_id % 5 WHEN 0 THEN 'POST' WHEN 1 THEN 'HEAD' ELSE 'GET' END AS verb,
    CAST(event_id % {N_SLOTS} AS INT) AS slot,
    CAST(floor(event_id / {N_SLOTS}) AS BIGINT) AS turn,
    CAST(event_id % {len(AGENTS.rows)} AS INT) AS agent_no
  FROM events
) e
JOIN ({{samples}}) s ON e.slot = s.slot
JOIN ({{agents}}) a ON e.agent_no = a.agent_no
"""

WEBLOGS_SQL = f"""
SELECT e.event_id, e.user_id, e.event_type, a.agent_class,
  CASE
    WHEN e.event_id % 11 = 0 THEN 'kernel: link ' || CAST(e.event_id AS STRING) || ' up'
    WHEN e.event_id % 11 = 1 THEN NULL
    WHEN e.event_id % 11 IN (2, 3, 4) THEN
      '2023-11-02 10:20:3' || CAST(e.event_id % 10 AS STRING) || ' W3SVC1 ' || e.ip || ' ' || e.verb
      || ' /shelf/' || CAST(e.event_id AS STRING) || '?' || replace(e.line_text, ' ', '+')
      || ' - 443 HTTP/1.1 ' || replace(replace(a.agent, ' ', '+'), chr(34), '') || ' - 200'
    ELSE
      e.ip || ' - - [02/Nov/2023:10:20:30 +0900] ' || chr(34) || e.verb || ' /shelf/'
      || CAST(e.event_id AS STRING)
      || CASE WHEN e.event_id % 3 = 0 THEN '' ELSE '?' || replace(e.line_text, ' ', '%20') END
      || ' HTTP/1.' || CASE WHEN e.event_id % 7 = 0 THEN '0' ELSE '1' END || chr(34)
      || ' 200 ' || CAST(e.event_id % 5000 AS STRING) || ' ' || chr(34)
      || CASE WHEN e.event_id % 4 = 0 THEN '' ELSE '-' END || chr(34)
      || ' ' || chr(34) || a.agent || chr(34)
      || CASE WHEN e.event_id % 2 = 0 THEN ' ' || chr(34) || '-' || chr(34) ELSE '' END
  END AS web_log
FROM (
  SELECT b.*, replace(replace(s.line_text, chr(10), ' '), chr(34), '') AS line_text
  FROM (
    SELECT event_id, user_id, event_type, {_IP} AS ip,
      CASE event_id % 9 WHEN 0 THEN 'POST' WHEN 1 THEN 'PROFIND' WHEN 2 THEN 'BREW' ELSE 'GET' END AS verb,
      CAST(event_id % {N_SLOTS} AS INT) AS slot,
      CAST(event_id % {len(AGENTS.rows)} AS INT) AS agent_no
    FROM events
  ) b JOIN ({{samples}}) s ON b.slot = s.slot
) e
JOIN ({{agents}}) a ON e.agent_no = a.agent_no
"""

PII_SQL = f"""
SELECT event_id, event_type,
  CASE event_id % 12
    WHEN 0 THEN 'mail kim.' || CAST(user_id AS STRING) || '@mail.example.com or lee_' || CAST(event_id AS STRING) || '@corp.co.kr'
    WHEN 1 THEN 'from ' || ip || ' to ' || ip || '/24'
    WHEN 2 THEN 'Chrome/118.0.5993.88 Safari/5.1.2.3 from ' || ip
    WHEN 3 THEN 'see http://portal' || CAST(user_id AS STRING) || '.com/a and https%3a%2f%2fdesk.or.kr/b'
    WHEN 4 THEN 'Host: files' || CAST(user_id AS STRING) || '.go.kr, www.board.co.kr'
    WHEN 5 THEN 'card 1111-2222-3333-' || CAST(1000 + event_id % 9000 AS STRING) || ' paid'
    WHEN 6 THEN 'call 010-1234-' || CAST(1000 + user_id % 9000 AS STRING) || ' or 02-555-0199'
    WHEN 7 THEN 'no 900101-1' || CAST(100000 + event_id % 900000 AS STRING)
    WHEN 8 THEN '담당자 김철수 (팀' || CAST(user_id AS STRING) || ') 과 이영희님'
    WHEN 9 THEN 'nothing here ' || CAST(event_id AS STRING)
    WHEN 10 THEN NULL
    ELSE '홍보 a.b@c.d 10.0.0.' || CAST(user_id % 256 AS STRING) || ' 010-9999-8888 123456-1234567 4444-5555-6666-7777'
  END AS text
FROM (SELECT event_id, event_type, user_id, {_IP} AS ip FROM events) e
"""

QA_SQL = """
SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer
FROM conversations q JOIN conversations a
  ON q.conv_id = a.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'
"""

EDR_SQL = """
SELECT event_id,
  CASE event_id % 5 WHEN 0 THEN 'Clop' WHEN 1 THEN 'Maze' WHEN 2 THEN 'Conti'
    WHEN 3 THEN 'Bad Rabbit' ELSE 'Unknown' END || '_' || event_type AS attack_type,
  CASE event_type WHEN 'click' THEN 'ProcessStart' WHEN 'view' THEN 'FileOpen'
    WHEN 'signup' THEN 'RegistryWrite' WHEN 'error' THEN 'ProcessStop' ELSE 'NetworkOpen' END
    AS event_detail_class,
  'process ' || CAST(user_id AS STRING) || ' ' || event_type || ' ' || props AS event_summary
FROM events
"""


def _filled(template: str, *, spark_dialect: bool) -> str:
    return template.format(
        samples=SAMPLES.sql(spark_dialect=spark_dialect),
        agents=AGENTS.sql(spark_dialect=spark_dialect),
    )


TEMPLATES = {
    "traffic": TRAFFIC_SQL,
    "weblogs": WEBLOGS_SQL,
    "pii_text": PII_SQL,
    "qa_pairs": QA_SQL,
    "edr_events": EDR_SQL,
}


def fixture_sql(name: str, *, spark_dialect: bool = False) -> str:
    template = TEMPLATES[name]
    if "{samples}" in template:
        return _filled(template, spark_dialect=spark_dialect).strip()
    return template.strip()


#: Deal small tables out to all cores; only the benchmark sets it.
SPREAD = False


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """With ``SPREAD``, the rows in turn on all cores; no key, so no later shuffle is saved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if SPREAD else df


def dealt(df: DataFrame) -> DataFrame:
    """The rows in turn on all cores, however few row groups the files have.

    An event is some ten bytes in its file and becomes a text with dozens of
    features, so the splits by file size leave almost all cores idle.
    """
    session = df.sparkSession
    shuffled = int(session.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(shuffled, 2 * session.sparkContext.defaultParallelism))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view over the tables in ``sf_dir``."""
    source = "conversations" if name == "qa_pairs" else "events"
    # braces in the literals must survive the formatting of DataFrame arguments
    text = fixture_sql(name, spark_dialect=True).replace("{", "{{").replace("}", "}}")
    for word in ("FROM", "JOIN"):
        text = text.replace(f"{word} {source}", f"{word} {{{source}}}")
    table = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    # question and answer meet in a join, which deals their rows out
    table = dealt(table) if source == "events" else spread(table)
    return spark.sql(text, **{source: table})
