import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.functions.rulesets import family
from packetloom.operators import (
    completion,
    conversations,
    enrich,
    evaluate,
    explain,
    profile,
    retrieve,
    scoring,
    signatures,
    splits,
    spread,
    vectorize,
)
from packetloom.sources import files, samples, scratch
from packetloom.sources.fixtures import fixture


def naive_chunks(pieces, joiner, size, overlap):
    """Greedy filling, written over index ranges instead of a running list."""
    out, first, i = [], 0, 0
    while i < len(pieces):
        if i > first and len(joiner.join(pieces[first : i + 1])) > size:
            out.append(joiner.join(pieces[first:i]).strip())
            while first < i and (
                len(joiner.join(pieces[first:i])) > overlap
                or len(joiner.join(pieces[first : i + 1])) > size
            ):
                first += 1
        i += 1
    if first < len(pieces):
        out.append(joiner.join(pieces[first:]).strip())
    return [c for c in out if c]


def test_chunks_against_naive_filling(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for size, overlap in ((1000, 200), (300, 0), (50, 40)):
        got = {}
        for r in retrieve.chunks(docs, "text", ["doc_id"], separator=" ", size=size, overlap=overlap).collect():
            got.setdefault(r["doc_id"], {})[r["chunk_no"]] = r["chunk"]
        for doc_id, text in texts.items():
            want = naive_chunks([p for p in text.split(" ") if p], " ", size, overlap)
            assert [got.get(doc_id, {})[k] for k in sorted(got.get(doc_id, {}))] == want


def test_chunks_keep_separator(spark):
    df = spark.createDataFrame([(1, "a|\nbb|\nccc")], "id INT, t STRING")
    out = retrieve.chunks(df, "t", ["id"], separator=r"\|\n", size=5, keep_separator=True).collect()
    assert [r["chunk"] for r in out] == ["a|\nbb", "|\nccc"]


def test_halves(spark):
    def cut(text, limit):
        if len(text) <= limit:
            return [text]
        half = len(text) // 2
        return cut(text[:half], limit) + cut(text[half:], limit)

    texts = ["", "a", "abc", "abcde", "x" * 17, "0123456789" * 13, "y" * 1025]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    for limit in (1, 2, 3, 8, 1024):
        got = {}
        for r in retrieve.halves(df, "t", ["id"], limit).collect():
            got.setdefault(r["id"], {})[r["piece_no"]] = r["piece"]
        for i, t in enumerate(texts):
            assert [got[i][k] for k in sorted(got[i])] == cut(t, limit), (t, limit)


@pytest.mark.parametrize("block", [2048, 7])
@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_nearest_neighbours_in_blocks(spark, monkeypatch, block, metric):
    monkeypatch.setattr(retrieve, "BLOCK", block)
    rng = np.random.default_rng(3)
    corpus = rng.integers(-3, 4, size=(90, 6)).astype(float)
    queries = rng.integers(-3, 4, size=(70, 6)).astype(float)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "c BIGINT, v ARRAY<DOUBLE>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "q BIGINT, v ARRAY<DOUBLE>")
    out = retrieve.top_k_similar(
        q, c, k=3, query_id="q", corpus_id="c", query_vector="v", corpus_vector="v",
        metric=metric,
    )
    got = {}
    for r in out.collect():
        got.setdefault(r["q"], {})[r["rank"]] = (r["c"], r["similarity"])

    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    a, b = (queries, corpus) if metric == "dot" else (unit(queries), unit(corpus))
    scores = np.round(a @ b.T, 6)
    for i, line in enumerate(scores):
        want = sorted(range(90), key=lambda j: (-line[j], j))[:3]
        assert [got[i][k][0] for k in (1, 2, 3)] == want


def test_nearest_neighbours_without_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", None), ("c", [1.0, None]), ("d", [2.0]), ("e", [0.5, 0.5])]
    rows += [("f", [math.nan, 1.0]), ("g", [math.inf, 0.0]), ("h", [])]
    df = spark.createDataFrame(rows, "i STRING, embedding ARRAY<DOUBLE>")
    out = retrieve.top_k_similar(df, df, k=3, query_id="i", corpus_id="i", exclude_same_id=True)
    assert {(r["i"], r["near_i"]) for r in out.collect()} == {("a", "e"), ("e", "a")}


@pytest.mark.parametrize("exclude", [True, False])
def test_balls_out_of_reach_are_skipped(exclude):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16)) * 4
    vectors = retrieve._unit(centres[rng.integers(0, 40, 6000)] + 0.3 * rng.standard_normal((6000, 16)))
    vectors[5000:5400] = vectors[0]  # ties
    ids = rng.permutation(6000)
    nearest = retrieve._Nearest(ids[:300], vectors[:300], 5, exclude)
    best = {i: [] for i in ids[:300].tolist()}
    for start in range(0, 6000, 2000):
        order, pivots = retrieve._neighbours_together(vectors[start : start + 2000])
        order = order + start
        q, c, score = nearest.search(ids[order], vectors[order], retrieve._ball_starts(pivots))
        for a, b, s in zip(ids[q].tolist(), ids[order][c].tolist(), score.tolist(), strict=True):
            best[a].append((-s, b))
    scores = np.round(vectors[:300] @ vectors.T, 6)
    for row, i in enumerate(ids[:300].tolist()):
        every = sorted((-s, j) for s, j in zip(scores[row].tolist(), ids.tolist(), strict=True) if j != i or not exclude)
        assert sorted(best[i])[:5] == every[:5]
    assert nearest.multiplied < 0.4 * 300 * 6000


def test_similarity_floor(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "i BIGINT, embedding ARRAY<DOUBLE>")
    out = retrieve.top_k_similar(rows, rows, k=3, query_id="i", corpus_id="i", floor=0.7, exclude_same_id=True)
    assert {(r["i"], r["near_i"]) for r in out.collect()} == {(1, 2), (2, 1)}


def test_country_borders(spark):
    rows = [("11.0.0.0",), ("40.99.255.255",), ("40.100.128.0",), ("10.9.9.9",), ("300.1.1.1",), (None,), ("1.2",)]
    df = spark.createDataFrame(rows, "ip STRING")
    out = {r["ip"]: r["country"] for r in enrich.with_country(df, "ip", samples.GEO_RANGES.to_df(spark)).collect()}
    assert out["11.0.0.0"] == out["40.99.255.255"] == "United States"
    for ip in ("40.100.128.0", "10.9.9.9", "300.1.1.1", None, "1.2"):
        assert out[ip] == "not found"


def test_country_with_a_hot_address(spark):
    hot = spark.range(20000).select(F.lit("12.0.0.1").alias("ip"))
    cold = spark.range(2000).select(F.concat(F.lit("150.20."), F.col("id") % 256, F.lit(".9")).alias("ip"))
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = enrich.with_country(hot.union(cold), "ip", samples.GEO_RANGES.to_df(spark))
        counts = {r["country"]: r["n"] for r in profile.value_counts(out, "country").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
    assert counts == {"United States": 20000, "France": 2000}


def test_batches_do_not_depend_on_ranges(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id") % 100003 + F.col("id") * 7).alias("k")).distinct()
    wanted = {k: i // 10 for i, k in enumerate(sorted(r["k"] for r in df.collect()))}
    for n in (1, 3, 50):
        out = splits.with_batch_number(df, "k", 10, n_ranges=n)
        assert {r["k"]: r["batch_no"] for r in out.collect()} == wanted


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(5003).select("id", F.when(F.col("id") % 100 == 0, "rare").otherwise("often").alias("label"))
    one = splits.stratified_split(df, "id", "label", "s", 20)
    two = splits.stratified_split(df.repartition(5), "id", "label", "s", 20)
    counts = {(r["label"], r["part"]): r["n"] for r in profile.value_counts(one, "label", "part").collect()}
    assert counts[("rare", "test")] == 51 * 20 // 100
    assert counts[("often", "test")] == (5003 - 51) * 20 // 100
    assert one.exceptAll(two).count() == 0
    tiny = splits.stratified_split(df.limit(3), "id", None, "s", 20)
    assert {r["part"] for r in tiny.collect()} == {"train"}


def test_pairs_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 3)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(20) if t != 7]
    df = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    got = {(r["turn"], r["answer"]) for r in conversations.question_answer_pairs(df).collect()}
    assert got == {(t, f"t{t + 1}") for t in range(0, 20, 2) if t != 6}


def test_history(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    got = {r["turn"]: r["prompt"] for r in conversations.history_prompts(df).collect()}
    assert got == {1: "latest question: a", 3: "prior question: a\nprior answer: b\nlatest question: c"}


def test_history_crosses_blocks(spark, monkeypatch):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"c{c}t{t}") for c in (1, 2) for t in range(11)]
    df = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    whole = {(r["conv_id"], r["turn"]): r["prompt"] for r in conversations.history_prompts(df).collect()}
    monkeypatch.setattr(conversations, "BLOCK", 3)
    cut = {(r["conv_id"], r["turn"]): r["prompt"] for r in conversations.history_prompts(df).collect()}
    assert whole == cut and len(whole) == 12
    assert whole[2, 2] == "prior question: c2t0\nprior answer: c2t1\nlatest question: c2t2"


def test_spread_join_deals_out_a_hot_key(spark):
    rows = spark.range(10_000, numPartitions=4).select("id", F.when(F.col("id") % 100 > 0, 1).otherwise(F.col("id") % 5).alias("k"))
    table = spark.createDataFrame([(0, "zero"), (1, "one"), (None, "none")], "k LONG, v STRING")
    out = spread.join_spread(rows, table, ["k"])
    assert {(r["k"], r["v"]): r["n"] for r in profile.value_counts(out, "k", "v").collect()} == {
        (0, "zero"): 100, (1, "one"): 9_900,
    }
    missing = spread.join_spread(rows, table.where("k = 0"), ["k"])
    assert missing.where("v IS NULL").count() == 9_900
    plan = missing._jdf.queryExecution().optimizedPlan().toString()
    assert "__group" in plan


def test_queries_are_built_without_a_job(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("label"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "no job is started")
    splits.stratified_split(df, "id", "label", "s", 20)
    evaluate.with_class_weight(df, "label")
    assert tracker.getJobIdsForGroup("build") == []
    spark.sparkContext.setJobGroup("tests", "")


def test_replies(spark):
    df = spark.createDataFrame([("one\nquestion: two",), ("a\nb\n질문: c",), ("plain\ntext",)], "t STRING")
    out = df.select(conversations.cut_reply(F.col("t")), conversations.drop_last_line(F.col("t"))).collect()
    assert out[0][0] == "one" and out[1][1] == "ab" and tuple(out[2]) == ("plain\ntext", "plain\ntext")


def test_completion_retries_and_isolates(spark):
    def sometimes(prompt, attempt):
        if prompt == "never" or (prompt == "late" and attempt < 3):
            raise ValueError("busy")
        return prompt.upper()

    df = spark.createDataFrame([("ok",), ("late",), ("never",), (None,)], "p STRING")
    done = completion.complete(df, {"a": "p"}, sometimes, pause=0.01)
    out = {r["p"]: tuple(r)[1:] for r in done.collect()}
    assert out["ok"] == ("OK", "ok", 1)
    assert out["late"] == ("LATE", "ok", 3)
    assert out["never"] == (None, "ValueError: busy", 3)
    assert out[None] == (None, "no prompt", 0)


def test_completion_calls_eight_at_a_time_and_keeps_order(spark):
    def meeting(prompt, attempt):
        # the same object for all calls of the task, as threads share it
        state = meeting.__dict__.setdefault("state", [threading.Barrier(8), threading.Lock(), 0, 0])
        with state[1]:
            state[2] += 1
            state[3] = max(state[3], state[2])
        state[0].wait(timeout=20)  # breaks unless eight calls run together
        with state[1]:
            state[2] -= 1
        if prompt == "p5":
            raise ValueError("busy")
        return f"{prompt}:{state[3]}"

    rows = spark.createDataFrame([(i, f"p{i}") for i in range(16)], "id INT, p STRING").coalesce(1)
    out = completion.complete(rows, {"a": "p"}, meeting, retries=1, parallel=8).collect()
    assert [r["id"] for r in out] == list(range(16))
    assert [r["a_status"] for r in out] == ["ValueError: busy" if i == 5 else "ok" for i in range(16)]
    assert all(r["a"] == f"p{r['id']}:8" for r in out if r["id"] > 8)


def test_completion_pauses_longer_each_time(monkeypatch):
    waits = []
    monkeypatch.setattr(completion.time, "sleep", waits.append)

    def never(prompt, attempt):
        raise ValueError("busy")

    assert completion._attempt("x", never, 10, 1.0) == (None, "ValueError: busy", 10)
    ceilings = [min(2.0**k, completion.LONGEST_PAUSE) for k in range(9)]
    assert len(waits) == 9 and all(c / 2 <= w <= c for w, c in zip(waits, ceilings, strict=True))


def test_prompt_keeps_braces_of_values(spark):
    df = spark.createDataFrame([("{question}",)], "payload STRING")
    prompt = completion.render("p: {payload} q: {question}", payload=F.col("payload"), question="why")
    assert df.select(prompt).first()[0] == "p: {question} q: why"


def test_importance_sums_and_ties(spark):
    fam = family("ips")
    df = spark.createDataFrame([tuple([1] + [0] * 32)], ", ".join(["id INT", *(f"{f} INT" for f in fam.features)]))
    coefs = {f: 0.5 for f in fam.features}
    rows = explain.with_importance(df, explain.attributions(coefs, {f: 0.0 for f in fam.features}))
    top = explain.top_features(rows, ["id"]).orderBy("rank").collect()
    assert [r["feature"] for r in top] == fam.features[:10]
    assert all(math.isclose(r["importance_percent"], 3.12, abs_tol=0.011) for r in top)


def test_both_ways_to_importance_agree(spark):
    names = ["a", "b", "c_count"]
    df = spark.createDataFrame([(1, 1, 0, 7), (2, 0, 0, 0), (3, 1, 1, 2)], "id INT, a INT, b INT, c_count INT")
    coefs, means = {"a": 0.7, "b": -1.25, "c_count": 0.05}, {"a": 0.5, "b": 0.25, "c_count": 1e-05}
    one = explain.explain_linear(df, coefs, means)
    two = explain.with_importance(df, explain.attributions(coefs, means))
    for r, q in zip(one.orderBy("id").collect(), two.orderBy("id").collect()):
        assert [x["feature"] for x in r["explained"]] == [x["feature"] for x in q["explained"]]
        for x, y in zip(r["explained"], q["explained"]):
            assert x["importance"] == y["importance"] and x["direction"] == y["direction"]
            assert math.isclose(x["phi"], y["phi"], abs_tol=1e-12)
    assert set(names) == {x["feature"] for x in one.first()["explained"]}


def test_evidence_of_user_agents_needs_one_version(spark):
    rows = [
        (1, "GET / HTTP/1.1 User-Agent: sqlmap"),
        (2, "GET / HTTP/1.1 HTTP/1.1 User-Agent: sqlmap"),
        (3, "GET /?q=union select User-Agent: sqlmap"),
        (4, "GET / HTTP/1.1 HTTP/1.1 x HTTP/1.0 user agent nmap"),
    ]
    df = spark.createDataFrame(rows, "id INT, payload STRING")
    found = explain.evidence(df, "payload", ["id"], family("ips")).collect()
    agents = {r["id"] for r in found if r["feature"].endswith("useragent_comb")}
    assert agents == {1, 4}
    assert any(r["id"] == 3 and r["keyword"] == "union[~]select" for r in found)


def test_first_signature_wins(spark):
    df = spark.createDataFrame([(1, "SQLMAP then ../ and sqlmap")], "id INT, t STRING")
    out = signatures.signature_matches(df, "t", ["id"], samples.SIGNATURES.to_df(spark)).orderBy("detection_no").collect()
    assert [r["detection_name"] for r in out] == ["SQL tool", "parent path", "SQL tool"]


def test_class_names(spark):
    df = spark.createDataFrame([(float(i),) for i in range(4)], "p DOUBLE")
    out = df.select(scoring.class_name(F.col("p")), scoring.other_classes(F.col("p"))).collect()
    assert [tuple(r) for r in out] == [
        ("CMD Injection", "기타 (SQL, XSS, 정상)"),
        ("정상", "기타 (CMD, SQL, XSS)"),
        ("SQL Injection", "기타 (CMD, XSS, 정상)"),
        ("XSS", "기타 (CMD, SQL, 정상)"),
    ]


def test_lower_case_never_meets_the_version_separator(spark):
    df = spark.createDataFrame([("GET /a HTTP/1.1",)], "t STRING")
    assert df.select(vectorize.tokens(F.col("t"))).first()[0] == ["get", "", "a", "http", "1.1"]


def test_json_field_and_folders(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"train": [{"instruction": "a", "input": "", "output": "가"}]}', "utf-8")
    out = files.read_json_field(spark, str(tmp_path / "d.json"), "train", "struct<instruction:string,input:string,output:string>")
    assert [tuple(r) for r in out.collect()] == [("a", "", "가")]
    assert scratch.shared_folder(spark) == scratch.shared_folder(spark)


def test_stream_equals_batch(spark, sf_dir):
    from packetloom.plans import QUERIES
    from packetloom.plans.model_queries import COEFS, INTERCEPT
    from packetloom.streaming import detect

    streamed = QUERIES["stream_detections"].build(spark, sf_dir)
    rows = fixture(spark, sf_dir, "traffic").select("event_id", "payload")
    batch = detect.detections(rows, "payload", COEFS, INTERCEPT, keep=["event_id"]).withColumn(
        "attack_proba", F.round("attack_proba", 9)
    )
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_nested_ranges_give_the_narrowest_country(spark):
    ranges = spark.createDataFrame(
        [(0, 2**24, "wide"), (256, 511, "narrow"), (300, 300, "one"), (256, 511, "twin")],
        "start_ip LONG, end_ip LONG, country STRING",
    )
    df = spark.createDataFrame([("0.0.0.7",), ("0.0.1.1",), ("0.0.1.44",), (None,)], "ip STRING")
    out = {r["ip"]: r["country"] for r in enrich.with_country(df, "ip", ranges).collect()}
    assert out == {"0.0.0.7": "wide", "0.0.1.1": "narrow", "0.0.1.44": "one", None: "not found"}


def test_csv_keeps_missing_and_empty_apart(spark, tmp_path):
    rows = [(None, "a"), ("", "b"), ('x "y"\nz', None)]
    path = f"{tmp_path}/rows"
    files.write_csv(spark.createDataFrame(rows, files.PAYLOAD_SCHEMA), path)
    back = files.read_csv(spark, path, files.PAYLOAD_SCHEMA).collect()
    assert {tuple(r) for r in back} == set(rows)


def test_long_scores_keep_ids_without_features(spark):
    long = spark.createDataFrame([(1, "f", 2.0)], "id LONG, feature STRING, value DOUBLE")
    every = spark.createDataFrame([(1,), (2,)], "id LONG")
    coefs = spark.createDataFrame([("f", 0.5)], "feature STRING, coef DOUBLE")
    out = scoring.long_scores(long, every, ["id"], coefs, -1.0).collect()
    assert {r["id"]: r["score"] for r in out} == {1: 0.0, 2: -1.0}


def test_class_explanations_add_up(spark):
    rng = np.random.default_rng(9)
    names, means = ["f0", "f1", "f2"], {"f0": 0.5, "f1": 0.25, "f2": 2.0}
    coefs = {c: {f: float(w) for f, w in zip(names, rng.normal(size=3), strict=True)} for c in range(4)}
    bases = {c: float(b) for c, b in enumerate(rng.normal(size=4))}
    rows = [tuple(int(x) for x in rng.integers(0, 4, 3)) for _ in range(50)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id INT, f0 INT, f1 INT, f2 INT")
    classed = explain.with_class_scores(df, coefs, bases)
    out = explain.explain_classes(classed, coefs, means, names=("a", "b", "c", "d"), others=("A", "B", "C", "D"))
    for r in out.collect():
        logits = [bases[c] + sum(coefs[c][f] * x for f, x in zip(names, rows[r.id], strict=True)) for c in range(4)]
        assert r.prediction == int(np.argmax(logits))
        assert np.allclose(r.proba, np.exp(logits) / np.exp(logits).sum())
        c = r.prediction
        mean = bases[c] + sum(coefs[c][f] * means[f] for f in names)
        assert sum(x.phi for x in r.explained) == pytest.approx(logits[c] - mean)
        for x in r.explained:
            assert x.phi == pytest.approx(coefs[c][x.feature] * (rows[r.id][names.index(x.feature)] - means[x.feature]))
            assert x.direction == ("abcd" if x.phi >= 0 else "ABCD")[c]
    ties = explain.with_class_scores(df.limit(1), {c: dict.fromkeys(names, 0.0) for c in range(4)}, dict.fromkeys(range(4), 0.0))
    assert ties.first().prediction == 0
