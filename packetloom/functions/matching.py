"""Turn rule patterns into Column expressions.

Almost every pattern is a few literal pieces with lazy gaps between them.  On
a text without line breaks ``a(.*?)b`` matches exactly when ``b`` occurs
somewhere behind the first ``a``, so substring search answers it in linear
time without decoding the row to a Java string or starting a regex engine.
The other patterns run as a regex, but only on rows that hold all their
literal pieces.

The regex dot also stops at U+0085, U+2028 and U+2029, which the one-line text
may still hold, and at line breaks in the other texts.  There the pieces are
searched line by line, so both branches give the regex result, and no pattern
of literal pieces ever backtracks.

Nor do the others, see ``first_in_line``: within a line, the first occurrence of
a piece leaves the most room for the next one, so a regex that is tied to line
starts and takes first occurrences for good answers in linear time.  A piece may
hold one character that is no letter or digit, and that may be the line break
itself; such an occurrence ends on the next line and is a case of its own.
``Finder`` lists the matches of many patterns by the same rule.
"""

from __future__ import annotations

import heapq
import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.rulesets import NOT_WORD, Alt, Rule
from packetloom.functions.text import any_of, one_line, text_or_empty

GAP = "(.*?)"
HTTP_SPLIT = "http/1."
ODD_BREAKS = ("\u0085", "\u2028", "\u2029")
_ESCAPED = re.compile(r"\[\\(.)\]|\[%%\]")
_META = re.compile(r"[.^$*+?()\[\]{}|\\]")


def unescaped(piece: str) -> str:
    return _ESCAPED.sub(lambda m: m.group(1) or "%", piece)


def literal_of(piece: str) -> str | None:
    """The plain text a pattern piece stands for, if it is plain."""
    bare = _ESCAPED.sub("", piece)
    if _META.search(bare):
        return None
    return unescaped(piece)


def instr_text(alt: Alt) -> str:
    """What a plain substring rule searches for: its text without escapes."""
    return re.sub(r"\\(.)", r"\1", alt.pattern)


def required_texts(pattern: str) -> list[str]:
    """Plain texts that every match of ``pattern`` contains."""
    out = []
    for piece in pattern.split(GAP):
        for part in piece.replace("(.?)", NOT_WORD).split(NOT_WORD):
            plain = literal_of(part)
            if plain:
                out.append(plain)
    return out


@dataclass(frozen=True)
class Scopes:
    """Names of the prepared text columns."""

    raw: str = "__raw"
    lc: str = "__lc"
    n: str = "__n"
    head: str = "__head"
    tail: str = "__tail"
    odd: str = "__odd"
    http: str = "__http"


SCOPES = Scopes()


def used_scopes(rules) -> set[str]:
    found = {a.scope for r in rules for a in r.alts}
    if any(a.needs for r in rules for a in r.alts):
        found.add("n")
    if any(a.http_guard for r in rules for a in r.alts):
        found |= {"http", "lc"}
    return found


def with_scopes(df: DataFrame, text_col: str, rules) -> DataFrame:
    """Add the text columns the rules read, each computed once per row."""
    s, used = SCOPES, used_scopes(rules)
    out = df.withColumn(s.raw, text_or_empty(F.col(text_col)))
    out = out.withColumn(s.lc, F.lower(F.col(s.raw)))
    out = out.withColumn(s.n, one_line(F.col(s.lc)))
    more = {s.odd: any_of([F.contains(F.col(s.n), F.lit(b)) for b in ODD_BREAKS])}
    if "http" in used:
        more[s.http] = F.contains(F.col(s.lc), F.lit(HTTP_SPLIT))
    out = out.withColumns(more)
    if used & {"head", "tail"}:
        # the dot of the separator is a regex dot
        parts = F.split(F.col(s.n), HTTP_SPLIT, 2)
        out = out.withColumn("__parts", parts)
        out = out.withColumns(
            {s.head: F.get("__parts", F.lit(0)), s.tail: text_or_empty(F.get("__parts", F.lit(1)))}
        ).drop("__parts")
    return out


def text_literal(text: str) -> str:
    """SQL literal of a text; raw, so that backslashes need no doubling."""
    if "'" not in text:
        return f"r'{text}'"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def has(column: str, text: str) -> str:
    return f"contains({column}, {text_literal(text)})"


def _in_order(column: str, pieces: list[str]) -> str:
    conditions = [has(column, p) for p in pieces]
    at = f"locate({text_literal(pieces[0])}, {column})"
    for previous, piece in zip(pieces, pieces[1:]):
        at = f"locate({text_literal(piece)}, {column}, {at} + {len(previous)})"
        conditions.append(f"{at} > 0")
    return " AND ".join(conditions)


#: Where the regex dot stops.
LINES = r"r'[\n\r\x85\u2028\u2029]'"


def _in_a_line(column: str, patterns: list[list[str]]) -> str:
    """Do the pieces of one of the patterns occur in order within one line?"""
    any_ = " OR ".join(f"({_in_order('line', pieces)})" for pieces in patterns)
    return f"exists(split({column}, {LINES}), line -> {any_})"


#: The same characters, as part of a regex character class.
BREAKS = r"\n\r\x85\u2028\u2029"
_LINE_START = rf"(?:\A|(?<=[{BREAKS}]))"


def _one_line_pieces(pattern: str) -> list[list[str]]:
    """The pieces; each either holds no line break or holds them where it can."""
    word = NOT_WORD[2:-1]
    out = []
    for piece in pattern.split(GAP):
        inside = piece.replace(NOT_WORD, f"[^{word}{BREAKS}]")
        across = piece.replace(NOT_WORD, f"[{BREAKS}]")
        kinds = [inside, across] if inside != piece else [piece]
        if piece.count(NOT_WORD) > 1:
            kinds.insert(1, piece)
        out.append(kinds)
    return out


def first_in_line(pattern: str, *, one_line_text: bool) -> str:
    """A regex that finds something where the pattern does, in linear time.

    It starts at line starts only and takes the first occurrence of each piece,
    in this line or across its end, without trying others.
    """
    kinds = _one_line_pieces(pattern)
    if one_line_text:
        kinds = [k[:1] for k in kinds]
    ways = ("".join(f"(?>.*?{piece})" for piece in way) for way in itertools.product(*kinds))
    return ("\\A" if one_line_text else _LINE_START) + f"(?:{'|'.join(ways)})"


def regex_of(pattern: str, *, one_line_text: bool) -> str:
    return first_in_line(pattern, one_line_text=one_line_text) if GAP in pattern else pattern


def pattern_sql(pattern: str, column: str, *, one_line_text: bool) -> str:
    """Condition that a pattern matches, cheapest exact form.

    ``one_line_text`` says that the text holds none of the characters at which
    the regex dot stops.
    """
    pieces = [literal_of(p) for p in pattern.split(GAP)]
    if None not in pieces and len(pieces) == 1:
        return has(column, pieces[0])
    if None not in pieces and one_line_text:
        return _in_order(column, pieces)
    present = [has(column, t) for t in required_texts(pattern)]
    if None not in pieces:
        return " AND ".join([*present, _in_a_line(column, [pieces])])
    regex = regex_of(pattern, one_line_text=one_line_text)
    return " AND ".join([*present, f"{column} RLIKE {text_literal(regex)}"])


def match_sql(alt: Alt) -> str:
    """Does the alternative match?  For rows without odd line breaks."""
    column = getattr(SCOPES, alt.scope)
    if alt.literal:
        hit = has(column, instr_text(alt))
    else:
        hit = pattern_sql(alt.pattern, column, one_line_text=alt.scope not in ("lc", "raw"))
    return _guarded(alt, hit)


def _guarded(alt: Alt, hit: str) -> str:
    if alt.needs:
        hit = f"{has(SCOPES.n, literal_of(alt.needs))} AND {hit}"
    if alt.http_guard:
        hit = f"{SCOPES.http} AND {hit}"
    return f"({hit})"


def _has_plain_gap(alt: Alt) -> bool:
    return not alt.literal and GAP in alt.pattern and alt.scope not in ("lc", "raw")


def merged_regex_sql(rule: Rule) -> str:
    """All alternatives of a rule, line by line, for rows with odd line breaks."""
    groups: dict[tuple, list[Alt]] = {}
    for a in rule.alts:
        groups.setdefault((a.scope, a.needs, a.http_guard, a.literal), []).append(a)
    hits = []
    for alts in groups.values():
        first, column = alts[0], getattr(SCOPES, alts[0].scope)
        if first.literal:
            hits += [_guarded(a, has(column, instr_text(a))) for a in alts]
            continue
        cut = {a.pattern: [literal_of(p) for p in a.pattern.split(GAP)] for a in alts}
        plain = [pieces for pieces in cut.values() if None not in pieces]
        joined = "|".join(regex_of(p, one_line_text=False) for p, pieces in cut.items() if None in pieces)
        if plain:
            hits.append(_guarded(first, _in_a_line(column, plain)))
        if joined:
            hits.append(_guarded(first, f"{column} RLIKE {text_literal(joined)}"))
    return " OR ".join(hits)


def rule_sql(rule: Rule) -> str:
    """INT feature value of a rule over the prepared text columns.

    SQL text rather than Column calls: a rule set has about a thousand of them,
    and each is a round trip to the JVM.
    """
    if rule.kind == "count":
        return "CAST(" + " + ".join(_occurrences_sql(a) for a in rule.alts) + " AS INT)"
    fast = " OR ".join(match_sql(a) for a in rule.alts)
    if any(_has_plain_gap(a) for a in rule.alts):
        fast = f"CASE WHEN {SCOPES.odd} THEN {merged_regex_sql(rule)} ELSE {fast} END"
    return f"CAST(({fast}) AS INT)"


def rule_column(rule: Rule) -> Column:
    return F.expr(rule_sql(rule))


def _occurrences_sql(alt: Alt) -> str:
    column = getattr(SCOPES, alt.scope)
    plain = literal_of(alt.pattern)
    if plain is not None:
        gone = f"length({column}) - length(replace({column}, {text_literal(plain)}, ''))"
        return f"CAST(({gone}) / {len(plain)} AS INT)"
    present = " AND ".join(has(column, t) for t in required_texts(alt.pattern))
    if GAP not in alt.pattern:
        return f"CASE WHEN {present} THEN regexp_count({column}, {text_literal(alt.pattern)}) ELSE 0 END"
    first, last = alt.pattern.split(GAP)
    if NOT_WORD in alt.pattern:
        raise ValueError(f"matches of {alt.pattern} are not counted line by line")
    # up to the last closing piece of a line every opening piece is closed
    closed = f"regexp_extract(line, {text_literal(chr(92) + f'A.*{last}')}, 0)"
    counted = f"regexp_count({closed}, {text_literal(f'{first}(?>.*?{last})')})"
    lines = f"aggregate(split({column}, {LINES}), 0, (n, line) -> n + {counted})"
    return f"CASE WHEN {present} THEN {lines} ELSE 0 END"


# --- matches of many patterns -------------------------------------------------


_DOT = re.compile(r"\[[^\]]*\]|\.")


def _java_dot(m: re.Match) -> str:
    """A dot outside brackets stops at all line breaks, not only at the newline."""
    return f"[^{BREAKS}]" if m[0] == "." else m[0]


class _Search:
    """Next occurrence of a piece; asked from places that only grow, so it reads a text once."""

    def __init__(self, regex: re.Pattern) -> None:
        self.regex = regex

    def begin(self) -> None:
        self.asked, self.start, self.end = 0, -1, -1

    def at(self, text: str, place: int) -> tuple[int, int] | None:
        if not self.asked <= place <= self.start:
            found = self.regex.search(text, place)
            self.start, self.end = found.span() if found else (len(text) + 1, -1)
            self.asked = place
        return None if self.end < 0 else (self.start, self.end)


class _Gapped:
    """The next match of one pattern: its pieces in order, gaps within lines."""

    def __init__(self, pattern: str) -> None:
        self.texts = required_texts(pattern)
        self.longest = max(self.texts, key=len, default="")
        self.pieces = [
            [_Search(re.compile(_DOT.sub(_java_dot, kind))) for kind in kinds]
            for kinds in _one_line_pieces(pattern)
        ]
        self.breaks = _Search(re.compile(f"[{BREAKS}]"))

    def begin(self) -> None:
        self.breaks.begin()
        for forms in self.pieces:
            for form in forms:
                form.begin()

    def _rest(self, text: str, k: int, place: int) -> int | None:
        """End of the pieces from the k-th on, the first one in the line of ``place``."""
        if k == len(self.pieces):
            return place
        stop = self.breaks.at(text, place)
        last = stop[0] if stop else len(text)
        for form in self.pieces[k]:
            found = form.at(text, place)
            if found and found[0] <= last:
                end = self._rest(text, k + 1, found[1])
                if end is not None:
                    return end
        return None

    def next(self, text: str, place: int) -> tuple[int, int] | None:
        while True:
            starts = [found for form in self.pieces[0] if (found := form.at(text, place))]
            if not starts:
                return None
            start, end = min(starts)
            done = self._rest(text, 1, end)
            if done is not None:
                return start, done
            # no later opening of this line does better, but for one across its end
            stop = self.breaks.at(text, end)
            if not stop:
                return None
            later = [found[0] for form in self.pieces[0][1:] if (found := form.at(text, start + 1))]
            place = min([stop[0], *later])


class Finder:
    """All matches of an alternation of patterns, left to right, not overlapping."""

    def __init__(self, patterns: list[str]) -> None:
        self.patterns = [_Gapped(p) for p in dict.fromkeys(patterns)]
        self.longest = [(p.longest, order) for order, p in enumerate(self.patterns)]

    def __call__(self, text: str) -> list[str]:
        out, place, ahead = [], 0, []
        for order in [order for longest, order in self.longest if longest in text]:
            pattern = self.patterns[order]
            if all(t in text for t in pattern.texts):
                pattern.begin()
                found = pattern.next(text, 0)
                if found:
                    ahead.append((found[0], order, found[1]))
        heapq.heapify(ahead)
        while ahead:
            start, order, end = heapq.heappop(ahead)
            if start >= place:
                out.append(text[start:end])
                place = end
            found = self.patterns[order].next(text, place)
            if found:
                heapq.heappush(ahead, (found[0], order, found[1]))
        return out


class Matches:
    """The places in the list of those patterns that match somewhere in a text."""

    def __init__(self, patterns: list[str]) -> None:
        self.patterns = [_Gapped(p) for p in patterns]
        self.longest = [(p.longest, place) for place, p in enumerate(self.patterns)]

    def __call__(self, text: str) -> list[int]:
        out = []
        for place in [place for longest, place in self.longest if longest in text]:
            pattern = self.patterns[place]
            if all(t in text for t in pattern.texts):
                pattern.begin()
                if pattern.next(text, 0):
                    out.append(place)
        return out
