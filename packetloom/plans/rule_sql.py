"""The rule features spelled out as SQL, every alternative as its own regex."""

from __future__ import annotations

from packetloom.functions.matching import instr_text
from packetloom.functions.rulesets import Alt, Family, Rule, family
from packetloom.plans.registry import quoted

SPLIT_AT_HTTP = "(?s)^(.*?)http/1.(.*)$"


def prepared(source: str, text: str, keep: str) -> str:
    """SELECT with the text columns t_raw, t_lc, t_n, t_head, t_tail."""
    one_line = "translate(t_lc, chr(10) || chr(13) || chr(9), '   ')"
    return f"""
    SELECT *,
      CASE WHEN regexp_matches(t_n, 'http/1.') THEN regexp_extract(t_n, {quoted(SPLIT_AT_HTTP)}, 1)
        ELSE t_n END AS t_head,
      CASE WHEN regexp_matches(t_n, 'http/1.') THEN regexp_extract(t_n, {quoted(SPLIT_AT_HTTP)}, 2)
        ELSE '' END AS t_tail
    FROM (SELECT *, {one_line} AS t_n
      FROM (SELECT *, lower(t_raw) AS t_lc
        FROM (SELECT {keep}, coalesce({text}, '') AS t_raw FROM {source})))"""


def alternative(a: Alt) -> str:
    if a.literal:
        hit = f"contains(t_{a.scope}, {quoted(instr_text(a))})"
    else:
        hit = f"regexp_matches(t_{a.scope}, {quoted(a.pattern)})"
    if a.needs:
        hit = f"(regexp_matches(t_n, {quoted(a.needs)}) AND {hit})"
    if a.http_guard:
        hit = f"(contains(t_lc, 'http/1.') AND {hit})"
    return hit


def value(rule: Rule) -> str:
    if rule.kind == "count":
        terms = (
            f"len(regexp_extract_all(t_{a.scope}, {quoted(a.pattern)}))" for a in rule.alts
        )
        return f"CAST({' + '.join(terms)} AS INT)"
    return f"CASE WHEN {' OR '.join(alternative(a) for a in rule.alts)} THEN 1 ELSE 0 END"


def features(fam: Family | str, source: str, text: str, keep: str) -> str:
    fam = family(fam) if isinstance(fam, str) else fam
    columns = ", ".join(f"{value(r)} AS {fam.prefix}{r.feature}" for r in fam.rules)
    return f"SELECT {keep}, {columns} FROM ({prepared(source, text, keep)})"
