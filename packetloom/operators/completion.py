"""Prompts and calls to a completion function."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Complete = Callable[[str, int], str]  # (prompt, attempt) -> answer, may raise

ROLE = "You are a security analyst. Answer from the material below, briefly."
TEMPLATES = {
    "base": ROLE + "\npayload: {payload}\nquestion: {question}\nanswer: ",
    "continue": ROLE + "\ncontext: {context}\npayload: {payload}\nquestion: {question}\nanswer: ",
    "rule": ROLE
    + "\ncontext: {context}\nsample rule: {sample_rule}\npayload: {payload}\nquestion: {question}\nanswer: ",
    "explain": ROLE + "\nfeature importance: {xai_result}\nquestion: {question}\nanswer: ",
}


def render(template: str, **values: Column | str) -> Column:
    """Fill a template in one pass; braces inside the values stay text."""
    parts: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            v = values[field]
            parts.append(F.lit(v) if isinstance(v, str) else F.coalesce(v.cast("string"), F.lit("")))
    return F.concat(*parts)


def stub(prompt: str, attempt: int) -> str:
    """Deterministic stand-in: some prompts fail once, some always."""
    digest = hashlib.md5(prompt.encode()).hexdigest()
    if digest[0] == "f" or (digest[0] == "e" and attempt == 1):
        raise RuntimeError("no answer")
    return f"Reply\n{digest[:12]} Engagingness: {int(digest[1], 16) % 4}"


#: No pause between two tries is longer, in seconds.
LONGEST_PAUSE = 30.0


def complete(
    df: DataFrame,
    prompts: dict[str, str],
    fn: Complete = stub,
    *,
    retries: int = 3,
    parallel: int = 8,
    pause: float = 0.5,
) -> DataFrame:
    """Answer the prompt columns of every row.

    ``prompts`` maps an answer name to its prompt column.  Adds
    ``<name>``, ``<name>_status`` and ``<name>_attempts``.  A failing call is
    tried again after ``pause`` seconds, the next time after twice as long, and
    so on, each shortened at random by up to half so that tasks do not come back
    together; a call that keeps failing marks its own row only.  The calls run
    in the tasks, batch by batch, up to ``parallel`` of a task at a time, so
    ``fn`` must allow several threads; rows keep their order.  A service sees
    ``parallel`` times the number of running tasks at most.
    """
    added = []
    for name in prompts:
        added += [
            T.StructField(name, T.StringType()),
            T.StructField(f"{name}_status", T.StringType()),
            T.StructField(f"{name}_attempts", T.IntegerType()),
        ]
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(parallel) as calls:
            for batch in batches:
                # all columns are handed over before the first answer is awaited
                asked = {
                    name: calls.map(lambda p: _attempt(p, fn, retries, pause), batch[prompt])
                    for name, prompt in prompts.items()
                }
                for name, answers in asked.items():
                    results = list(answers)
                    batch[name] = [r[0] for r in results]
                    batch[f"{name}_status"] = [r[1] for r in results]
                    batch[f"{name}_attempts"] = [r[2] for r in results]
                yield batch

    return df.mapInPandas(run, schema)


def _attempt(
    prompt: str | None, fn: Complete, retries: int, pause: float
) -> tuple[str | None, str, int]:
    if prompt is None:
        return None, "no prompt", 0
    problem = ""
    for attempt in range(1, retries + 1):
        try:
            return fn(prompt, attempt), "ok", attempt
        except Exception as e:  # whatever the service raises
            problem = f"{type(e).__name__}: {e}"
            if attempt < retries and pause:
                wait = min(pause * 2 ** (attempt - 1), LONGEST_PAUSE)
                time.sleep(wait * random.uniform(0.5, 1.0))
    return None, problem, retries


def normal_answer(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("\n"), F.lit(" "))


# Questions of the two stages and the labels of the report.
IMPORTANCE_QUESTION = "피처 중요도의 AI 탐지 키워드 기반으로 설명을 작성해주세요."
QUESTIONS = {
    "reason": ("base", "입력된 payload완 연관된 공격 명 1개와 판단 근거를 작성해주세요."),
    "tactic": ("base", "입력된 payload와 연관된 Tactics ID 1개와 판단 근거를 작성해주세요."),
    "chain": ("base", "입력된 payload의 Cyber Kill Chain Model을 작성해주세요."),
    "sigma": ("rule", "입력된 payload의 Sigma Rule을 작성해주세요."),
    "response": (
        "continue",
        "입력된 payload와 연관된 Cyber Kill Chain 대응 단계 1개 및 대응 방안을 작성해주세요.",
    ),
    "snort": ("rule", "입력된 payload의 Snort Rule을 작성해주세요."),
    "cve": ("continue", "입력된 payload와 연관된 CVE 1개와 판단 근거를 작성해주세요."),
}
CONTEXT_OF = {"sigma": "reason", "response": "chain", "snort": "reason", "cve": "reason"}
REPORT = [
    ("공격 판단 근거", "reason"),
    ("Tactics 추천", "tactic"),
    ("Sigma Rule 추천", "sigma"),
    ("Snort Rule 추천", "snort"),
    ("CVE 추천", "cve"),
    ("사이버 킬 체인 대응 단계 추천", "response"),
]


def analyse(
    df: DataFrame,
    payload_col: str,
    *,
    fn: Complete = stub,
    sample_rules: dict[str, str] | None = None,
    parallel: int = 8,
    pause: float = 0.5,
) -> DataFrame:
    """Two dependent stages of questions about every payload.

    The second stage puts answers of the first into its prompts.  Both stages
    keep the payload's row together, so no shuffle lies between them.
    """
    samples = {"sigma": "", "snort": "", **(sample_rules or {})}
    payload = F.col(payload_col)

    def prompt(name: str) -> Column:
        template, question = QUESTIONS[name]
        context = F.col(CONTEXT_OF[name]) if name in CONTEXT_OF else ""
        return render(
            TEMPLATES[template],
            payload=payload,
            question=question,
            context=context,
            sample_rule=samples.get(name, ""),
        )

    first = [n for n in QUESTIONS if n not in CONTEXT_OF]
    second = list(CONTEXT_OF)
    df = df.withColumns({f"__p_{n}": prompt(n) for n in first})
    how = {"parallel": parallel, "pause": pause}
    df = complete(df, {n: f"__p_{n}" for n in first}, fn, **how).drop(*(f"__p_{n}" for n in first))
    df = df.withColumns({f"__p_{n}": prompt(n) for n in second})
    df = complete(df, {n: f"__p_{n}" for n in second}, fn, **how)
    return df.drop(*(f"__p_{n}" for n in second))


def answer_report(df: DataFrame, ids: list[str]) -> DataFrame:
    """``ids, question_no, question, answer`` of an analysed table."""
    rows = F.array(
        *(
            F.struct(
                F.lit(no).alias("question_no"),
                F.lit(label).alias("question"),
                F.coalesce(F.col(name), F.lit("-")).alias("answer"),
            )
            for no, (label, name) in enumerate(REPORT, start=1)
        )
    )
    return df.select(*ids, F.inline(rows))
