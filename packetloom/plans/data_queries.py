"""Datasets, retrieval, conversations, prompts, files."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from packetloom.functions.rulesets import family
from packetloom.operators import completion, conversations, datasets, profile, retrieve, splits
from packetloom.operators import features as feat
from packetloom.plans import rule_sql
from packetloom.plans.registry import query, quoted, sql
from packetloom.sources import files, samples
from packetloom.sources.fixtures import fixture, read_table
from packetloom.sources.scratch import scratch_path

#: Tokens of a training text.
TOKEN_BUDGET = 1024

# --- question answering data ------------------------------------------------

_SQUAD = (
    "SELECT conv_id, turn, conv_id * 1000 + turn AS row_id, "
    "CASE WHEN conv_id % 3 = 0 THEN question ELSE question || ' ' || answer END AS context, "
    "answer AS payload, question, answer FROM qa_pairs"
)
_SPANNED = (
    "SELECT conv_id, turn, row_id, lower(context) AS context, payload, lower(question) AS question, "
    "lower(answer) AS answer, CAST(strpos(context, answer) - 1 AS INT) AS answer_start, "
    "CAST(strpos(context, answer) - 1 + length(answer) AS INT) AS answer_end FROM squad"
)


def squad_rows(spark, sf_dir):
    pairs = fixture(spark, sf_dir, "qa_pairs")
    whole = F.concat_ws(" ", "question", "answer")
    return pairs.select(
        "conv_id",
        "turn",
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.when(F.col("conv_id") % 3 == 0, F.col("question")).otherwise(whole).alias("context"),
        F.col("answer").alias("payload"),
        "question",
        "answer",
    )


@query(
    sql(
        "SELECT row_id, context, question, answer, answer_start, answer_end FROM spanned",
        squad=_SQUAD,
        spanned=_SPANNED,
    )
)
def answer_spans(spark, sf_dir):
    """Position of the answer in its context."""
    return datasets.with_answer_span(squad_rows(spark, sf_dir)).select(
        "row_id", "context", "question", "answer", "answer_start", "answer_end"
    )


@query(
    sql(
        "SELECT row_id, CAST(to_json({'paragraphs': [{'context': context, 'payload': payload, 'qas': [{'question': question, "
        "'id': CAST(row_id AS VARCHAR), 'answers': [{'text': answer, 'answer_start': answer_start, 'answer_end': answer_end}]}]}]}) "
        "AS VARCHAR) AS article FROM spanned",
        squad=_SQUAD,
        spanned=_SPANNED,
    )
)
def squad_articles(spark, sf_dir):
    """Nested question articles as JSON text."""
    rows = datasets.with_answer_span(squad_rows(spark, sf_dir))
    return rows.select("row_id", F.to_json(datasets.squad_article("row_id")).alias("article"))


@query(
    sql(
        "SELECT context, payload, question, CAST(row_id AS VARCHAR) AS id, answer, answer_start, answer_end FROM spanned",
        squad=_SQUAD,
        spanned=_SPANNED,
    )
)
def squad_flattened(spark, sf_dir):
    """Articles written as JSON lines, read back and flattened."""
    rows = datasets.with_answer_span(squad_rows(spark, sf_dir))
    path = scratch_path(spark, "squad")
    files.write_json_lines(rows.select(datasets.squad_article("row_id").alias("a")).select("a.*"), path)
    articles = files.read_json_lines(spark, path, f"paragraphs array<{datasets.PARAGRAPH}>")
    return datasets.flatten_squad(articles.select(F.struct("*").alias("article")), "article")


def _token_no(pos: str) -> str:
    return (
        f"CASE WHEN {pos} >= 0 AND regexp_matches(substr(whole, {pos} + 1, 1), '\\S') "
        f"THEN CAST(len(list_filter(string_split_regex(substr(whole, 1, {pos} + 1), '\\s+'), lambda x: x <> '')) - 1 AS INT) "
        "ELSE 0 END"
    )


@query(
    sql(
        f"SELECT row_id, {_token_no('answer_start')} AS token_start, {_token_no('(answer_end - 1)')} AS token_end "
        "FROM (SELECT *, context || ' ' || payload AS whole FROM spanned)",
        squad=_SQUAD,
        spanned=_SPANNED,
    )
)
def answer_token_spans(spark, sf_dir):
    """The same position in tokens."""
    rows = datasets.with_answer_span(squad_rows(spark, sf_dir))
    return datasets.with_token_span(rows).select("row_id", "token_start", "token_end")


@query(
    sql(
        "SELECT DISTINCT lower(answer) AS answer FROM qa_pairs "
        "UNION SELECT DISTINCT lower(question) FROM qa_pairs"
    )
)
def distinct_answers(spark, sf_dir):
    """Distinct values of two lists together."""
    pairs = fixture(spark, sf_dir, "qa_pairs").select(
        F.lower("answer").alias("answer"), F.lower("question").alias("question")
    )
    questions = profile.distinct_values(pairs, "question").withColumnRenamed("question", "answer")
    return profile.distinct_values(pairs, "answer").union(questions).distinct()


_INSTRUCTIONS = (
    "SELECT coalesce(question, '') AS instruction, "
    "CASE WHEN turn % 2 = 0 THEN translate(coalesce(answer, ''), chr(10) || chr(13) || chr(9), '   ') ELSE '' END AS input, "
    "coalesce(answer, '') AS output FROM qa_pairs"
)


def _instructions(spark, sf_dir):
    # even turns carry an input, odd ones have none
    pairs = fixture(spark, sf_dir, "qa_pairs").withColumn(
        "given", F.when(F.col("turn") % 2 == 0, F.col("answer"))
    )
    return datasets.instruction_records(pairs, "question", "given", "answer")


@query(sql("SELECT instruction, input, output FROM i", i=_INSTRUCTIONS))
def instruction_records(spark, sf_dir):
    """Instruction data written as nested documents and read back."""
    path = scratch_path(spark, "instructions")
    nested = files.nested_records(_instructions(spark, sf_dir), "train")
    files.write_json_lines(nested, path)
    record = "struct<instruction:string,input:string,output:string>"
    docs = files.read_json_lines(spark, path, f"train array<{record}>")
    return docs.select(F.inline("train"))


_PROMPTS = (
    "SELECT 'User: ' || CASE WHEN input <> '' THEN instruction || ': ' || input ELSE instruction END "
    "|| chr(10) || chr(10) || 'Assistant: ' || output AS prompt FROM i"
)


@query(sql("SELECT prompt FROM p", i=_INSTRUCTIONS, p=_PROMPTS))
def instruction_prompts(spark, sf_dir):
    """Training texts with and without input."""
    return _instructions(spark, sf_dir).select(datasets.instruction_prompt().alias("prompt"))


@query(
    sql(
        f"SELECT prompt, CASE WHEN len(t) < {TOKEN_BUDGET} THEN list_append(t, '</s>') ELSE t END AS input_tokens, "
        f"CAST(CASE WHEN len(t) < {TOKEN_BUDGET} THEN len(t) + 1 ELSE len(t) END AS BIGINT) AS n_tokens FROM "
        f"(SELECT prompt, string_split_regex(prompt, '\\s+')[1:{TOKEN_BUDGET}] AS t FROM p)",
        i=_INSTRUCTIONS,
        p=_PROMPTS,
    )
)
def training_tokens(spark, sf_dir):
    """Tokens of the training texts within a budget, with end marker."""
    prompts = _instructions(spark, sf_dir).select(datasets.instruction_prompt().alias("prompt"))
    tokens = datasets.training_tokens(F.split("prompt", "\\s+"), TOKEN_BUDGET)
    return prompts.withColumn("input_tokens", tokens).withColumn(
        "n_tokens", F.size("input_tokens").cast("long")
    )


_TECHNIQUE_ROWS = (
    "SELECT family, trim(unnest(string_split(technique_ids, ','))) AS technique_id "
    f"FROM ({samples.TECHNIQUES.sql()})"
)


@query(
    sql(
        "SELECT e.event_id, split_part(e.attack_type, '_', 1) AS attack_family, t.technique_id "
        "FROM edr_events e LEFT JOIN t ON split_part(e.attack_type, '_', 1) = t.family",
        t=_TECHNIQUE_ROWS,
    )
)
def attack_techniques(spark, sf_dir):
    """Techniques of the attack family of every event."""
    rows = fixture(spark, sf_dir, "edr_events").select(
        "event_id", datasets.attack_family(F.col("attack_type")).alias("attack_family")
    )
    return datasets.with_techniques(rows, "attack_family", samples.TECHNIQUES.to_df(spark))


@query(
    sql(
        "SELECT split_part(attack_type, '_', 1) AS attack_family, count(*) AS n, "
        "count(DISTINCT event_detail_class) AS n_classes FROM edr_events GROUP BY 1"
    )
)
def attack_family_counts(spark, sf_dir):
    """Events and distinct detail classes per attack family."""
    rows = fixture(spark, sf_dir, "edr_events")
    return rows.groupBy(datasets.attack_family(F.col("attack_type")).alias("attack_family")).agg(
        F.count("*").alias("n"), F.countDistinct("event_detail_class").alias("n_classes")
    )


def stub_sql(prompt: str, source: str, keep: str) -> str:
    """The stand-in completion in SQL: answer, status, attempts."""
    return f"""
    SELECT {keep}, prompt,
      CASE WHEN h[1] = 'f' THEN NULL ELSE 'Reply' || chr(10) || substr(h, 1, 12) || ' Engagingness: '
        || CAST(CAST('0x' || h[2] AS INT) % 4 AS VARCHAR) END AS answer,
      CASE WHEN h[1] = 'f' THEN 'RuntimeError: no answer' ELSE 'ok' END AS status,
      CASE WHEN h[1] = 'f' THEN 3 WHEN h[1] = 'e' THEN 2 ELSE 1 END AS attempts
    FROM (SELECT *, md5(prompt) AS h FROM (SELECT {keep}, {prompt} AS prompt FROM {source}))"""


_AUGMENT = (
    "'ransomware name: ' || split_part(attack_type, '_', 1) || chr(10) || "
    "'EDR log event detailed classification: ' || event_detail_class || chr(10) || "
    "'EDR log summary: ' || event_summary || chr(10) || 'T-ID: '"
)
_AUGMENT_TEMPLATE = (
    "ransomware name: {attack_type}\nEDR log event detailed classification: {event_class}\n"
    "EDR log summary: {summary}\nT-ID: "
)


@query(
    sql(
        "SELECT event_id, batch_no, replace(lower(answer), chr(10), ' ') AS technique, status, attempts FROM "
        f"({stub_sql(_AUGMENT, 'numbered', 'event_id, batch_no')})",
        numbered="SELECT *, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 100) AS BIGINT) AS batch_no FROM edr_events",
    )
)
def augmented_events(spark, sf_dir):
    """Events in batches of a hundred, each completed and normalised."""
    rows = fixture(spark, sf_dir, "edr_events")
    prompt = completion.render(
        _AUGMENT_TEMPLATE,
        attack_type=datasets.attack_family(F.col("attack_type")),
        event_class=F.col("event_detail_class"),
        summary=F.col("event_summary"),
    )
    numbered = splits.with_batch_number(rows, "event_id", 100).select(
        "event_id", "batch_no", prompt.alias("prompt")
    )
    done = completion.complete(numbered, {"answer": "prompt"}, pause=0)
    return done.select(
        "event_id",
        "batch_no",
        completion.normal_answer(F.col("answer")).alias("technique"),
        F.col("answer_status").alias("status"),
        F.col("answer_attempts").alias("attempts"),
    )


# --- chunks and retrieval ---------------------------------------------------


@query()
def document_chunks(spark, sf_dir):
    """Chunks of at most 1000 characters with 200 characters overlap."""
    docs = read_table(spark, sf_dir, "documents")
    return retrieve.chunks(docs, "text", ["doc_id"], separator=" ", size=1000, overlap=200)


@query()
def page_chunks(spark, sf_dir):
    """Page text in chunks that keep the line separator."""
    pages = read_table(spark, sf_dir, "pages").select(
        "page_id", files.html_text(F.col("html")).alias("text")
    )
    return retrieve.chunks(pages, "text", ["page_id"], separator="\n", size=1000, keep_separator=True)


def _halves_sql(source: str, text: str, key: str, limit: int) -> str:
    return (
        f"WITH RECURSIVE cut({key}, path, piece) AS (SELECT {key}, '', {text} FROM {source} WHERE {text} IS NOT NULL "
        f"UNION ALL SELECT {key}, path || s.side, CASE WHEN s.side = '0' THEN substr(piece, 1, length(piece) // 2) "
        f"ELSE substr(piece, length(piece) // 2 + 1) END FROM cut, (VALUES ('0'), ('1')) AS s(side) WHERE length(piece) > {limit}) "
        f"SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY path) AS INT) AS piece_no, piece "
        f"FROM cut WHERE length(piece) <= {limit}"
    )


@query(_halves_sql("documents", "text", "doc_id", 8192))
def document_halves(spark, sf_dir):
    """Documents cut in half until no piece is above 8192 characters."""
    return retrieve.halves(read_table(spark, sf_dir, "documents"), "text", ["doc_id"], 8192)


@query(_halves_sql("pages", "html", "page_id", 4096))
def page_halves(spark, sf_dir):
    """Pages cut in half until no piece is above 4096 characters."""
    return retrieve.halves(read_table(spark, sf_dir, "pages"), "html", ["page_id"], 4096)


_TEXT_SQL = (
    r"regexp_replace(regexp_replace(regexp_replace(html, "
    r"'(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<!--.*?-->', ' ', 'g'), "
    r"'(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/article|/section)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
)
for _e, _c in files._ENTITIES:
    _TEXT_SQL = f"replace({_TEXT_SQL}, {quoted(_e)}, {quoted(_c)})"
_TEXT_SQL = (
    f"trim(regexp_replace(regexp_replace({_TEXT_SQL}, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ')"
)


@query(f"SELECT page_id, {_TEXT_SQL} AS text FROM pages")
def page_text(spark, sf_dir):
    """Readable text of the stored pages."""
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", files.html_text(F.col("html")).alias("text"))


_NORM = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


def _cosine(a: str, b: str) -> str:
    return (
        f"round(list_dot_product({a}, {b}) / ({_NORM.format(v=a)} * {_NORM.format(v=b)}), 6)"
    )


_CENTROIDS = (
    "SELECT label, list(m ORDER BY i) AS center FROM (SELECT label, i, avg(x) AS m FROM "
    "(SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) "
    "GROUP BY label, i) GROUP BY label"
)


def _centers(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    as_vector = array_to_vector(F.col("embedding").cast("array<double>"))
    centers = vectors.groupBy("label").agg(Summarizer.mean(as_vector).alias("c"))
    return vectors, centers.select("label", vector_to_array("c").alias("center"))


def _centroid_sql(k: int, floor: float) -> str:
    return (
        "SELECT label, rank, vec_id, similarity FROM (SELECT *, "
        "CAST(row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM "
        f"(SELECT c.label, e.vec_id, {_cosine('c.center', 'CAST(e.embedding AS DOUBLE[])')} AS similarity "
        f"FROM centers c, embeddings e)) WHERE rank <= {k} AND similarity >= {floor}"
    )


@query(sql(_centroid_sql(3, 0.2), centers=_CENTROIDS))
def nearest_to_label_centers(spark, sf_dir):
    """The three vectors nearest to the mean of each label, above a floor."""
    vectors, centers = _centers(spark, sf_dir)
    return retrieve.top_k_similar(
        centers, vectors, k=3, query_id="label", corpus_id="vec_id",
        query_vector="center", floor=0.2,
    )


@query(
    "SELECT vec_id, near_vec_id, rank, similarity FROM (SELECT a.vec_id, b.vec_id AS near_vec_id, "
    f"{_cosine('CAST(a.embedding AS DOUBLE[])', 'CAST(b.embedding AS DOUBLE[])')} AS similarity, "
    "CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY "
    f"{_cosine('CAST(a.embedding AS DOUBLE[])', 'CAST(b.embedding AS DOUBLE[])')} DESC, b.vec_id) AS INT) AS rank "
    "FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE rank <= 3"
)
def nearest_vectors(spark, sf_dir):
    """The three nearest other vectors of every vector."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return retrieve.top_k_similar(
        vectors, vectors, k=3, query_id="vec_id", corpus_id="vec_id", exclude_same_id=True
    )


def _hashed_sql(source: str, key: str, text: str) -> str:
    """Long form: key, cell, count."""
    return (
        f"SELECT {key}, CAST('0x' || substr(md5(w), 1, 4) AS INT) % 64 AS cell, count(*) AS n FROM "
        f"(SELECT {key}, unnest(string_split_regex(lower({text}), '[^a-z0-9]+')) AS w FROM {source}) "
        f"WHERE w <> '' GROUP BY 1, 2"
    )


_BEST = dict(
    qv=_hashed_sql("qa", "row_id", "question"),
    cv=_hashed_sql("benchmark", "item_id", "text"),
    dots="SELECT qa.row_id, b.item_id, coalesce(d.similarity, 0) AS similarity FROM (SELECT row_id FROM qa) qa, "
    "(SELECT item_id FROM benchmark) b LEFT JOIN (SELECT row_id, item_id, CAST(sum(qv.n * cv.n) AS DOUBLE) AS similarity "
    "FROM qv JOIN cv ON qv.cell = cv.cell GROUP BY row_id, item_id) d ON d.row_id = qa.row_id AND d.item_id = b.item_id",
    best="SELECT row_id, item_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY row_id "
    "ORDER BY similarity DESC, item_id) AS k FROM dots) WHERE k = 1",
)
_QA_ROWS = "SELECT conv_id * 1000 + turn AS row_id, question, answer FROM qa_pairs"


def _best_passages(spark, sf_dir):
    pairs = fixture(spark, sf_dir, "qa_pairs").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "question", "answer"
    )
    passages = read_table(spark, sf_dir, "benchmark")
    found = retrieve.top_k_similar(
        pairs.withColumn("v", retrieve.hashed_counts(F.col("question"))),
        passages.withColumn("v", retrieve.hashed_counts(F.col("text"))),
        k=1, query_id="row_id", corpus_id="item_id", query_vector="v", corpus_vector="v", metric="dot",
    )
    return pairs, passages, found


@query(
    sql("SELECT row_id, item_id, similarity FROM best", qa=_QA_ROWS, **_BEST)
)
def best_passages(spark, sf_dir):
    """The passage with the largest dot product for every question."""
    _, _, found = _best_passages(spark, sf_dir)
    return found.select("row_id", "item_id", "similarity")


_PASSAGE_SQL = (
    "'Answer the question in whole sentences from the passage; ignore the passage when it does not help.' || chr(10) "
    "|| 'QUESTION: ' || chr(39) || question || chr(39) || chr(10) || 'PASSAGE: ' || chr(39) "
    "|| replace(replace(replace(text, chr(39), ''), chr(34), ''), chr(10), ' ') || chr(39) || chr(10) || chr(10) || 'ANSWER:' || chr(10)"
)


@query(
    sql(
        f"SELECT qa.row_id, {_PASSAGE_SQL} AS prompt FROM best JOIN qa ON best.row_id = qa.row_id "
        "JOIN benchmark b ON best.item_id = b.item_id",
        qa=_QA_ROWS,
        **_BEST,
    )
)
def passage_prompts(spark, sf_dir):
    """Prompts with the best passage, quotes taken out."""
    pairs, passages, found = _best_passages(spark, sf_dir)
    joined = found.join(pairs, "row_id").join(passages, "item_id")
    prompt = completion.render(
        retrieve.PASSAGE_PROMPT,
        query=F.col("question"),
        passage=retrieve.escape_passage(F.col("text")),
    )
    return joined.select("row_id", prompt.alias("prompt"))


_RATE_TEMPLATE = "context: {context}\nquestion: {question}\nanswer: {answer}\n- Engagingness: "


@query(
    sql(
        "SELECT score, status, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM "
        "(SELECT CAST(nullif(regexp_extract(answer, 'Engagingness: ([0-9])', 1), '') AS INT) AS score, status, attempts FROM "
        f"({stub_sql(chr(39) + 'context: ' + chr(39) + ' || text || chr(10) || ' + chr(39) + 'question: ' + chr(39) + ' || question || chr(10) || ' + chr(39) + 'answer: ' + chr(39) + ' || answer || chr(10) || ' + chr(39) + '- Engagingness: ' + chr(39), 'joined', 'row_id')})) "
        "GROUP BY score, status",
        qa=_QA_ROWS,
        **_BEST,
        joined="SELECT qa.row_id, b.text, qa.question, qa.answer FROM best JOIN qa ON best.row_id = qa.row_id "
        "JOIN benchmark b ON best.item_id = b.item_id",
    )
)
def rated_answers(spark, sf_dir):
    """Answers rated against the retrieved passage, counted by score."""
    pairs, passages, found = _best_passages(spark, sf_dir)
    joined = found.join(pairs, "row_id").join(passages, "item_id")
    prompt = completion.render(
        _RATE_TEMPLATE, context=F.col("text"), question=F.col("question"), answer=F.col("answer")
    )
    done = completion.complete(
        joined.select("row_id", prompt.alias("prompt")), {"rating": "prompt"}, pause=0
    )
    return (
        done.withColumn("score", conversations.rating(F.col("rating")))
        .groupBy("score", F.col("rating_status").alias("status"))
        .agg(F.count("*").alias("n"), F.sum("rating_attempts").alias("attempts"))
    )


_KNOWLEDGE = (
    "'Tactic TA000' || CAST(event_id % 7 + 1 AS STRING) || ' of ' || attack_type || ': T10' || "
    "CAST(event_id % 80 + 10 AS STRING) || '.00' || CAST(event_id % 9 + 1 AS STRING) || ' (' || event_detail_class || "
    "') then T14' || CAST(event_id % 17 + 70 AS STRING) || ' (Impact ' || CAST(event_id % 5 AS STRING) || ')'"
)


@query(
    sql(
        "SELECT event_id, tactic_id, p.technique_id, p.technique_name FROM (SELECT event_id, "
        "regexp_extract(text, 'TA[0-9]{4}') AS tactic_id, "
        r"unnest(list_transform(list_zip(regexp_extract_all(text, '\b(T[0-9]{4}(?:\.[0-9]{3})?) \(([^)]*)\)', 1), "
        r"regexp_extract_all(text, '\b(T[0-9]{4}(?:\.[0-9]{3})?) \(([^)]*)\)', 2)), "
        "lambda z: {'technique_id': z[1], 'technique_name': z[2]})) AS p FROM k)",
        k=f"SELECT event_id, {_KNOWLEDGE} AS text FROM edr_events",
    )
)
def extracted_techniques(spark, sf_dir):
    """Typed technique rows out of descriptive text."""
    rows = fixture(spark, sf_dir, "edr_events").select("event_id", F.expr(_KNOWLEDGE).alias("text"))
    return retrieve.extract_techniques(rows, "text", ["event_id"])


_PIECES = _halves_sql("pages", "html", "page_id", 4096)


@query(
    "SELECT status, count(*) AS n, CAST(sum(extracted) AS BIGINT) AS total FROM (SELECT TRY_CAST(f AS INT) AS extracted, "
    "CASE WHEN TRY_CAST(f AS INT) IS NOT NULL THEN 'ok' WHEN f = '' THEN 'nothing found' ELSE 'not a number' END AS status "
    "FROM (SELECT regexp_extract(piece, '(?:<h|href=./)([0-9a-z]+)', 1) AS f FROM (" + _PIECES + "))) GROUP BY status"
)
def extraction_status(spark, sf_dir):
    """Typed values from page pieces; failures stay with their piece."""
    pieces = retrieve.halves(read_table(spark, sf_dir, "pages"), "html", ["page_id"], 4096)
    typed = retrieve.with_extracted_number(pieces, "piece", "(?:<h|href=./)([0-9a-z]+)")
    return typed.groupBy("status").agg(F.count("*").alias("n"), F.sum("extracted").alias("total"))


# --- conversations ----------------------------------------------------------


@query(
    "SELECT conv_id, turn, text AS question, answer FROM (SELECT *, "
    "lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, "
    "lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) "
    "WHERE role = 'user' AND next_role = 'assistant'"
)
def turn_pairs(spark, sf_dir):
    """Questions with the answer of the next turn."""
    return conversations.question_answer_pairs(read_table(spark, sf_dir, "conversations"))


@query(
    "SELECT conv_id, turn, CASE WHEN prior IS NULL THEN latest ELSE prior || chr(10) || latest END AS prompt FROM "
    "(SELECT conv_id, turn, role, 'latest question: ' || text AS latest, "
    "string_agg(CASE WHEN role = 'assistant' THEN 'prior answer: ' ELSE 'prior question: ' END || text, chr(10) ORDER BY turn) "
    "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior "
    "FROM conversations WHERE role IN ('user', 'assistant')) WHERE role = 'user'"
)
def history_prompts(spark, sf_dir):
    """Every question with the turns before it."""
    return conversations.history_prompts(read_table(spark, sf_dir, "conversations"))


_REPLY = (
    "CASE turn % 4 WHEN 0 THEN text || chr(10) || 'question: and then?' "
    "WHEN 1 THEN text || chr(10) || '질문: next' WHEN 2 THEN '답변: ' || text || chr(10) || 'end' ELSE text END"
)


@query(
    sql(
        "SELECT conv_id, turn, CASE WHEN contains(reply, 'question:') THEN split_part(reply, chr(10), 1) ELSE reply END AS first_line, "
        "CASE WHEN regexp_matches(reply, '(?m)^(질문|답변):') THEN trim(array_to_string(string_split(reply, chr(10))[1:-2], ''), ' ') "
        "ELSE reply END AS without_last FROM r",
        r=f"SELECT conv_id, turn, {_REPLY} AS reply FROM conversations",
    )
)
def cut_replies(spark, sf_dir):
    """Replies cut where the model starts another turn."""
    rows = read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.expr(_REPLY).alias("reply")
    )
    return rows.select(
        "conv_id",
        "turn",
        conversations.cut_reply(F.col("reply")).alias("first_line"),
        conversations.drop_last_line(F.col("reply")).alias("without_last"),
    )


@query(
    "SELECT conv_id, turn, translate(text, chr(10) || chr(13) || chr(9) || chr(34), '    ') AS message FROM conversations "
    "WHERE role = 'user'"
)
def clean_messages(spark, sf_dir):
    """User messages without line breaks and quotes."""
    rows = read_table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", conversations.clean_message(F.col("text")).alias("message"))


@query(
    "SELECT q.conv_id, q.turn, q.text AS question, coalesce(a.text, '_silence_') AS answer FROM conversations q "
    "LEFT JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' "
    "WHERE q.role = 'user'"
)
def answered_or_silent(spark, sf_dir):
    """Every question; unanswered ones get the silence mark."""
    turns = read_table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    questions = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return questions.join(answers, ["conv_id", "turn"], "left").withColumn(
        "answer", conversations.silence(F.col("answer"))
    )


_TRANSCRIPT = (
    "'question: ' || question || chr(10) || 'answer: ' || answer || chr(10) || 'question: garbage' "
    "|| chr(10) || 'answer: garbage' || chr(10)"
)


@query(
    sql(
        "SELECT row_id, CAST(k AS INT) AS pair_no, q[k] AS question, a[k] AS answer FROM (SELECT row_id, "
        r"regexp_extract_all(t, 'question: (.*?)\nanswer: (.*?)\n', 1) AS q, "
        r"regexp_extract_all(t, 'question: (.*?)\nanswer: (.*?)\n', 2) AS a, "
        r"generate_subscripts(regexp_extract_all(t, 'question: (.*?)\nanswer: (.*?)\n', 1), 1) AS k FROM s)",
        s="SELECT conv_id * 1000 + turn AS row_id, replace(replace(replace(replace("
        f"{_TRANSCRIPT}, chr(10) || 'question', chr(1) || 'question'), chr(10) || 'answer', chr(1) || 'answer'), chr(10), ' '), chr(1), chr(10)) || '' AS t0, "
        "t0 AS t FROM qa_pairs",
    )
)
def transcript_pairs(spark, sf_dir):
    """Pairs parsed from transcripts with lines that go on."""
    rows = fixture(spark, sf_dir, "qa_pairs").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.expr(_TRANSCRIPT).alias("t")
    )
    return conversations.pairs_from_text(rows, "t", ["row_id"])


# --- prompts ----------------------------------------------------------------

_ROLE_SQL = quoted(completion.ROLE)


def prompt_sql(name: str, context: str = "''") -> str:
    template, question = completion.QUESTIONS[name]
    mid = "" if template == "base" else f" || chr(10) || 'context: ' || coalesce({context}, '')"
    rule = " || chr(10) || 'sample rule: '" if template == "rule" else ""
    return (
        f"{_ROLE_SQL}{mid}{rule} || chr(10) || 'payload: ' || coalesce(payload, '') || chr(10) || 'question: ' || "
        f"{quoted(question)} || chr(10) || 'answer: '"
    )


@query(sql(f"SELECT event_id, {prompt_sql('tactic')} AS prompt FROM traffic"))
def payload_prompts(spark, sf_dir):
    """The prompt of one question about every payload."""
    template, question = completion.QUESTIONS["tactic"]
    rows = fixture(spark, sf_dir, "traffic")
    prompt = completion.render(
        completion.TEMPLATES[template], payload=F.col("payload"), question=question
    )
    return rows.select("event_id", prompt.alias("prompt"))


def _stage(name: str, source: str, context: str = "''") -> str:
    inner = stub_sql(prompt_sql(name, context), source, "event_id")
    return f"SELECT event_id, answer FROM ({inner})"


_ANSWERS = dict(
    reason=_stage("reason", "traffic"),
    tactic=_stage("tactic", "traffic"),
    chain=_stage("chain", "traffic"),
    with_reason="SELECT t.event_id, t.payload, r.answer AS reason_answer, c.answer AS chain_answer FROM traffic t "
    "JOIN reason r ON t.event_id = r.event_id JOIN chain c ON t.event_id = c.event_id",
    sigma=_stage("sigma", "with_reason", "reason_answer"),
    response=_stage("response", "with_reason", "chain_answer"),
    snort=_stage("snort", "with_reason", "reason_answer"),
    cve=_stage("cve", "with_reason", "reason_answer"),
)


@query(
    sql(
        " UNION ALL ".join(
            f"SELECT event_id, {no} AS question_no, {quoted(label)} AS question, coalesce(answer, '-') AS answer FROM {name}"
            for no, (label, name) in enumerate(completion.REPORT, start=1)
        ),
        **_ANSWERS,
    )
)
def answer_report(spark, sf_dir):
    """Two stages of dependent questions about every payload, as a report."""
    rows = fixture(spark, sf_dir, "traffic").select("event_id", "payload")
    return completion.answer_report(completion.analyse(rows, "payload", pause=0), ["event_id"])


# --- files ------------------------------------------------------------------

_RENAMED = "SELECT replace(payload, 'item', 'webpage') AS payload, CASE WHEN label = 'anomalies' THEN 1 ELSE 0 END AS label FROM traffic"


@query(sql(_RENAMED))
def csv_round_trip(spark, sf_dir):
    """Labelled payloads through CSV, recoded on the way in."""
    path = scratch_path(spark, "payloads")
    rows = fixture(spark, sf_dir, "traffic").select("payload", "label")
    files.write_csv(rows, path)
    back = files.register(files.read_csv(spark, path, files.PAYLOAD_SCHEMA), "labelled_payloads")
    return back.select(
        F.replace("payload", F.lit("item"), F.lit("webpage")).alias("payload"),
        F.when(F.col("label") == "anomalies", 1).otherwise(0).alias("label"),
    )


@query(sql("SELECT event_id, coalesce(text, '') AS text FROM pii_text"))
def korean_csv_round_trip(spark, sf_dir):
    """Korean text through a CSV in EUC-KR."""
    path = scratch_path(spark, "korean")
    rows = fixture(spark, sf_dir, "pii_text").select("event_id", "text")
    files.write_csv(rows, path, encoding="EUC-KR")
    back = files.read_csv(spark, path, "event_id BIGINT, text STRING", encoding="EUC-KR")
    return back.fillna("", ["text"])


@query(
    "SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS characters FROM documents GROUP BY lang"
)
def text_corpus(spark, sf_dir):
    """Documents as text files of a hundred, loaded file by file."""
    path = scratch_path(spark, "corpus")
    docs = read_table(spark, sf_dir, "documents").select("lang", "text")
    docs.write.partitionBy("lang").option("maxRecordsPerFile", 100).text(path)
    corpus = files.read_text_corpus(spark, path + "/*")
    lang = F.regexp_extract("path", "lang=([^/]+)", 1)
    return corpus.groupBy(lang.alias("lang")).agg(F.sum(F.length("text")).alias("characters"))


_SQL_FLAG = family("ips").prefix + "sql_01_comb"
_ROUND = rule_sql.features("ips", "traffic", "payload", "event_id")


@query(sql(f"SELECT event_id, {_SQL_FLAG} FROM f", f=_ROUND))
def feature_table_round_trip(spark, sf_dir):
    """Features through a parquet table, one column read back."""
    path = scratch_path(spark, "features")
    wide = feat.rule_features(
        fixture(spark, sf_dir, "traffic"), "payload", "ips", keep=["event_id"]
    )
    wide.write.parquet(path)
    return spark.read.parquet(path).select("event_id", _SQL_FLAG)
