import random
import re
import time

import pytest

from pyspark.sql import functions as F

from packetloom.functions import matching, rulesets
from packetloom.functions.rulesets import FAMILIES, family
from packetloom.operators import explain
from packetloom.operators.features import rule_features
from packetloom.plans import spelled_out
from packetloom.sources.fixtures import sample_text


def texts_for(fam):
    """A hit and near misses for every alternative."""
    out = ["", None, "plain", "HTTP/1.1", "http/10 http/1.1 bingbot", "a b"]
    for r in fam.rules:
        for a in r.alts:
            for filler in (" ", "\n", "\u2028", "+%20+"):
                base = (
                    matching.instr_text(a) if a.literal else sample_text(a.pattern, filler)
                )
                if a.needs:
                    out.append(base)
                    base = sample_text(a.needs, filler) + base
                out += [base, base[:-1], f"get /a?{base.upper()} HTTP/1.1\r\nUser-Agent: x"]
                out.append(f"get /a HTTP/1.0\r{base}\u0085{base}")
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("name", list(FAMILIES))
def test_fast_matching_equals_spelled_out_sql(spark, name):
    fam = family(name)
    rows = list(enumerate(texts_for(fam)))
    df = spark.createDataFrame(rows, "id INT, payload STRING").repartition(8).cache()
    ours = rule_features(df, "payload", fam, keep=["id"])
    plain = spelled_out.features(df, "payload", fam, ["id"])
    a = {r["id"]: r for r in ours.collect()}
    b = {r["id"]: r for r in plain.collect()}
    df.unpersist()
    wrong = [(rows[i][1], a[i], b[i]) for i in a if a[i] != b[i]]
    assert not wrong, wrong[:2]
    for f in fam.features:
        assert any(r[f] for r in a.values()), f


def test_every_alternative_hits_alone(spark):
    for fam in FAMILIES.values():
        cases = []
        for r in fam.rules:
            for a in r.alts:
                text = matching.instr_text(a) if a.literal else sample_text(a.pattern, " ")
                if a.needs:
                    text = sample_text(a.needs, " ") + text
                if a.scope == "tail":
                    text = "get / http/1.1 " + text
                elif a.http_guard:
                    text = text + " http/1.1"
                cases.append((fam.prefix + r.feature, text))
        df = spark.createDataFrame(cases, "feature STRING, payload STRING")
        for row in rule_features(df, "payload", fam).collect():
            assert row[row["feature"]] >= 1, row["payload"]


def test_counts():
    assert matching.literal_of(r"[\.][\.][\/]") == "../"
    assert matching.literal_of("a(.*?)b") is None
    assert matching.required_texts("cast(.*?)chr[^a-zA-Z0-9가-힣]") == ["cast", "chr"]


def test_count_values(spark):
    rows = [("../..%2f%2e%2e%2f....//;&&",), (None,), ("...;",)]
    df = spark.createDataFrame(rows, "payload STRING")
    out = rule_features(df, "payload", "ips").collect()
    assert [r["ips_payload_dir_count"] for r in out] == [4, 0, 0]
    assert [r["ips_payload_ampersand_count"] for r in out] == [2, 0, 0]
    assert [r["ips_payload_semicolon_count"] for r in out] == [1, 0, 1]


def test_overflow_dots_both_ways(spark):
    df = spark.createDataFrame([("." * 10,), ("[.]" * 10,)], "payload STRING")
    trained = rule_features(df, "payload", family("ips")).collect()
    fixed = rule_features(df, "payload", family("ips", fixed_dots=True)).collect()
    assert [r["ips_payload_bof_comb"] for r in trained] == [0, 1]
    assert [r["ips_payload_bof_comb"] for r in fixed] == [1, 0]


def test_projection_has_no_shuffle_and_no_python(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = rule_features(df, "text", "ips", keep=["doc_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)


HUNDRED_KB = {
    "openers": "GET / HTTP/1.1 " + "user agent " * 9_000,
    "cut by a line break": "GET / HTTP/1.1 " + "user agent " * 9_000 + "\u0085 name",
    "wrong order": "name agent user " * 6_000,
    "no word before the last piece": "xping http/1.1 " + "get " * 24_000,
    "pieces in the wrong order": "ttp 777 tmp chr char ping rf " + "wget chmod cd cast api " * 4_000,
    "one match, then openers": "get /ping api /ping " + "get api cast wget " * 6_000 + "rm -rf",
    "openers before each break": ("get api cast wget\n" * 5_000 + "\u2028") + " ping ttp chr",
}


@pytest.mark.parametrize("name", [*FAMILIES, "evidence"])
def test_long_texts_of_repeated_openers_take_seconds(spark, name):
    """Each text was a matter of hours when gaps were tried again and again."""

    def run(text):
        df = spark.createDataFrame([(1, text)], "id INT, payload STRING")
        if name == "evidence":
            out = explain.with_evidence(df, "payload", family("ips"))
        else:
            out = rule_features(df, "payload", family(name), keep=["id"])
        start = time.perf_counter()
        out.collect()
        return time.perf_counter() - start

    run("GET / HTTP/1.1")
    short = run("GET / HTTP/1.1 ")
    for kind, text in HUNDRED_KB.items():
        assert run(text) < short + 2, kind


PIECES = ["a(.*?)b(.*?)c", "ab(.*?)a", "b¬(.*?)a", "a(.*?)¬b", "c(.*?)a¬(.*?)b", "b¬b", "c¬¬", "a(.?)c(.*?)b", "a¬(.*?)¬b"]


def _random_texts(n, letters="abc \n-"):
    rng = random.Random(4)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(24))) for _ in range(n)]


def test_first_occurrences_match_where_the_pattern_does():
    for p in [p.replace("¬", rulesets.NOT_WORD) for p in PIECES]:
        lines = matching.regex_of(p, one_line_text=False)
        line = matching.regex_of(p, one_line_text=True)
        for text in _random_texts(8_000):
            assert bool(re.search(p, text)) == bool(re.search(lines, text)), (p, text)
            text = text.replace("\n", " ")
            assert bool(re.search(p, text)) == bool(re.search(line, text)), (p, text)


@pytest.mark.parametrize("seed", range(6))
def test_finder_finds_what_the_alternation_finds(seed):
    patterns = [p.replace("¬", rulesets.NOT_WORD) for p in PIECES]
    random.Random(seed).shuffle(patterns)
    patterns = patterns[: 2 + seed]
    find, plain = matching.Finder(patterns), re.compile("|".join(patterns))
    for text in _random_texts(6_000):
        assert find(text) == [m[0] for m in plain.finditer(text)], (patterns, text)


def test_evidence_is_what_the_plain_alternation_finds(spark):
    fam = family("ips")
    others, agents = explain._split_alternatives(fam)
    plain = "|".join(dict.fromkeys(explain.keyword_union(others)))
    texts = [t for t in texts_for(fam) if t]
    df = spark.createDataFrame([(t.lower().replace("\n", " "),) for t in texts], "low STRING")
    found = explain.with_found(df, "low", others, "found").withColumn(
        "want", F.regexp_extract_all("low", F.lit(plain), F.lit(0))
    )
    assert found.where("NOT (found <=> want)").count() == 0


def test_keywords_of_fragments_as_by_expression(spark):
    fam = family("ips")
    rng = random.Random(3)
    pieces = [t for r in fam.rules for a in r.alts for t in matching.required_texts(a.pattern)]
    texts = ["", " ", "http/1.1 nikto/ x", *(
        "".join(rng.choice([*rng.sample(pieces, 3), " ", "\n", " ", "x"]) for _ in range(12)) for _ in range(120)
    )]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "id int, t string")
    by_expression = F.expr(f"flatten(transform(__fragments, f -> {explain._hits_sql('f', fam.rules)}))")
    want = explain._with_fragments(df, "t", fam).select("id", by_expression.alias("e")).collect()
    got = explain.with_evidence(df, "t", fam).select("id", "evidence").collect()
    plan = explain.with_evidence(df, "t", fam)._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: list(map(tuple, r.evidence)) for r in got} == {r.id: list(map(tuple, r.e)) for r in want}
    assert any(r.e for r in want) and "lambdafunction" not in plan
