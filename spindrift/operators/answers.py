"""Metadata of hits, prompts, answers and verdicts. Models are functions handed in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SYSTEM = (
    "You look up information in UK MHRA Drug Safety Updates and give no medical advice.\n"
    "Use only the numbered passages of the user's message. If they don't hold the answer, reply with exactly: "
    f'"{T.REFUSAL}"\n'
    "Don't guess beyond the passages, fill gaps from what you know, or soften or reassure where they don't.\n"
    'Name the source URLs you used under "Sources:". Keep advice for healthcare professionals and for patients apart and labelled, '
    "and never give advice meant for professionals as advice to a patient. Be brief and factual.\n"
)
METADATA_RULES = "Passages are tagged with [register] and [date]: keep HCP advice apart from patient advice, and where passages conflict follow the latest and say so.\n"


# The format of the user's message.
NO_PASSAGES = "(no passages retrieved)"
BEFORE_CONTEXT, BEFORE_QUESTION = "CONTEXT PASSAGES:\n", "\n\nQUESTION:\n"
CLOSING = "\n\nAnswer using only the context above, following all the rules."


def system_prompt(metadata: bool) -> str:
    return SYSTEM + (METADATA_RULES if metadata else "")


def article_metadata(articles: DataFrame, url: str, slug: str, date: str) -> DataFrame:
    return articles.select(F.col(url).alias("source_url"), F.coalesce(F.col(date), F.lit("")).alias("date"), T.subtype(slug).alias("subtype"), T.topic(slug).alias("drug_or_device"))


def enrich(hits: DataFrame, metadata: DataFrame, text: str = "text") -> DataFrame:
    """Hits with date, subtype and drug of their article (empty where unknown) and the register of their own text."""
    j = hits.join(metadata, "source_url", "left")
    return j.select(*[F.col(c) for c in hits.columns], *[F.coalesce(c, F.lit("")).alias(c) for c in ("date", "subtype", "drug_or_device")], T.register(text).alias("register"))


def context(hits: DataFrame, query: str = "query", metadata: bool = False) -> DataFrame:
    """(query, context): each query's hits by rank as numbered blocks; the number of hits of a query is the search's k."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] source_url: "), F.col("source_url"))
    if metadata:
        for name in ("register", "date", "drug_or_device"):
            head = F.concat(head, F.lit(f" | [{name}]: "), F.col(name))
    block = F.struct(F.col("rank"), F.concat(head, F.lit("\n"), F.col("text")).alias("b"))
    return hits.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n\n").alias("context"))


def prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query, question, prompt) for every question, also those without hits."""
    c = F.coalesce("context", F.lit(NO_PASSAGES))
    body = F.concat(F.lit(BEFORE_CONTEXT), c, F.lit(BEFORE_QUESTION), F.col("question"), F.lit(CLOSING))
    return questions.join(contexts, "query", "left").select("query", "question", body.alias("prompt"))


def sources(hits: DataFrame, query: str = "query") -> DataFrame:
    """Sorted distinct URLs of all hits retrieved."""
    return hits.groupBy(query).agg(F.array_sort(F.collect_set("source_url")).alias("sources"))


def generate(prompt_rows: DataFrame, model, keep=("query",), name: str = "answer") -> DataFrame:
    """(keep..., name) by a function from a list of prompts to a list of texts, called once per Arrow batch on the executors."""
    from .. import ship

    ship(prompt_rows.sparkSession)
    src = prompt_rows.select(*keep, "prompt")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{name: model(pdf["prompt"].tolist())})[[*keep, name]]

    return src.mapInPandas(run, src.select(*keep, F.lit("").alias(name)).schema)


def extractive(prompts_in: list[str]) -> list[str]:
    """The offline stand-in for a model: the first passage of the prompt, or the refusal."""
    out = []
    for p in prompts_in:
        head = p.split(BEFORE_QUESTION)[0].split("\n", 1)[-1]
        out.append(T.REFUSAL if head.startswith(NO_PASSAGES) else head.split("\n\n")[0].split("\n", 1)[-1])
    return out


FAITH_HEAD = "Does the context support every claim of the answer? Reply with JSON: {\"faithful\": true or false, \"reason\": text}."
RIGHT_HEAD = "Does the answer hold the facts of the key? Reply with JSON: {\"label\": \"correct\", \"incomplete\" or \"wrong\", \"reason\": text}."


def _parts(head: str, **parts):
    return F.concat(F.lit(head), *[x for k, v in parts.items() for x in (F.lit(f"\n\n{k.upper()}:\n"), F.coalesce(F.col(v), F.lit("")))])


def faithfulness_prompt(answer: str, context_col: str):
    return _parts(FAITH_HEAD, answer=answer, context=context_col)


def correctness_prompt(question: str, key: str, answer: str):
    return _parts(RIGHT_HEAD, question=question, key=key, answer=answer)


def overlap_judge(prompts_in: list[str]) -> list[str]:
    """The offline stand-in for a judge: shares of an answer's words in the context, of a key's words in the answer."""
    import json
    import re

    out = []
    for p in prompts_in:
        part = dict(re.findall(r"\n\n([A-Z]+):\n(.*?)(?=\n\n[A-Z]+:\n|\Z)", p, re.S))
        words = {k: set(re.findall("[a-z0-9]+", v.lower())) for k, v in part.items()}
        if p.startswith(FAITH_HEAD):
            a, c = words.get("ANSWER", set()), words.get("CONTEXT", set())
            out.append(json.dumps({"faithful": bool(a) and len(a & c) >= 0.9 * len(a), "reason": "shared words"}))
        else:
            k, a = words.get("KEY", set()), words.get("ANSWER", set())
            share = len(k & a) / len(k) if k else 0.0
            out.append(json.dumps({"label": "correct" if share >= 0.9 else "incomplete" if share >= 0.5 else "wrong", "reason": "shared words"}))
    return out


#: Negative controls of a judge: (case, question, key, answer, context, whether it is about faithfulness); each must fail.
CONTROLS = (
    ("claims beyond the context", "", "", "Inhaler A works less well when cold, and doctors prefer it for small children.", "Inhaler A works less well when cold.", True),
    ("against the key", "Who may be given vaccine B?", "Adults over sixty without any history of allergy.", "Newborn babies only.", "", False),
    ("sure of itself without context", "", "", "These tablets must be kept in a refrigerator.", "", True),
    ("leaves out facts", "What is checked before drug C is started?", "Kidney function, blood pressure and a pregnancy test.", "Blood pressure is measured.", "", False),
)


def controls_of(passages: DataFrame, key: str, text: str) -> DataFrame:
    """Two negative controls of each passage: the passage with itself read backwards behind it as an answer from the passage alone, and backwards as an answer to whom the passage is the key."""
    back = F.reverse(F.col(text))
    beyond = passages.select(F.concat(F.lit("beyond "), F.col(key).cast("string")).alias("case"), F.lit("").alias("question"), F.lit("").alias("key"), F.concat_ws(" ", text, back).alias("answer"), F.col(text).alias("context"), F.lit(True).alias("faith"))
    against = passages.select(F.concat(F.lit("against "), F.col(key).cast("string")).alias("case"), F.lit("").alias("question"), F.col(text).alias("key"), back.alias("answer"), F.lit("").alias("context"), F.lit(False).alias("faith"))
    return beyond.unionByName(against)


def probe_judge(spark, judge, controls: DataFrame | None = None) -> DataFrame:
    """(case, raw, caught) of negative controls (``CONTROLS`` unless others are given) under a judge (a function from prompts to verdicts): caught where it doesn't let one pass."""
    rows = spark.createDataFrame([tuple(c) for c in CONTROLS], "case string, question string, key string, answer string, context string, faith boolean") if controls is None else controls
    p = F.when(F.col("faith"), faithfulness_prompt("answer", "context")).otherwise(correctness_prompt("question", "key", "answer"))
    got = generate(rows.withColumn("prompt", p), judge, ("case", "faith"), "raw")
    return got.select("case", "raw", F.when(F.col("faith"), ~faithful("raw")).otherwise(correctness("raw") != "correct").alias("caught"))


def judge_sheet(rows: DataFrame, ids: list[str], judge_name: str, model_name: str, stamp: str) -> str:
    """Markdown for grading by hand, from (id, question, answer_key, answer, sources, answerable, refused, label, faithful): the listed items, in their order."""
    by = {r.id: r for r in rows.where(F.col("id").isin(list(ids))).collect()}
    out = ["# Judge validation", f"_{stamp}, judge {judge_name}, generator {model_name}_"]
    for i in ids:
        r = by[i]
        out += ["", f"## {r.id} ({'answerable' if r.answerable else 'UNANSWERABLE'})", f"**Question:** {r.question}", f"**Key:** {r.answer_key or ''}", f"**Answer:**\n{r.answer}", "**Sources:** " + ", ".join(s.rsplit("/", 1)[-1][:40] for s in r.sources or []), f"**Refused:** {r.refused}"]
        out += [f"**Judge:** {r.label}, faithful {r.faithful}", "**Yours:** correctness [ ], faithfulness [ ]"] if r.answerable else ["**Yours:** rightly refused [ ]"]
    return "\n".join(out) + "\n"


def json_part(raw):
    """The text from the first brace to the last."""
    return F.regexp_extract(F.coalesce(F.col(raw), F.lit("")), r"(?s)\{.*\}", 0)


def faithful(raw):
    """True only where the verdict says the JSON literal true."""
    return F.coalesce(F.from_json(json_part(raw), "faithful boolean")["faithful"], F.lit(False))


def correctness(raw):
    """The verdict's label; anything unknown is wrong."""
    label = F.from_json(json_part(raw), "label string")["label"]
    return F.when(label.isin("correct", "incomplete", "wrong"), label).otherwise("wrong")


def passed(raw):
    return F.coalesce(F.upper(F.from_json(json_part(raw), "verdict string")["verdict"]) == "PASS", F.lit(False))


def demo_rows(hits: DataFrame, titles: DataFrame, snippet: int = 800) -> DataFrame:
    """Hits with title and date, score to four decimals and a snippet, for display."""
    return hits.join(titles, "source_url", "left").select("query", "rank", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("date", F.lit("")).alias("date"), F.round("score", 4).alias("score"), "source_url", F.left("text", F.lit(snippet)).alias("text"))


def demo_cache(shown: DataFrame, answered: DataFrame, adversarial: DataFrame) -> DataFrame:
    """(query, question, adversarial, answer, sources, chunks) from ``demo_rows``, (query, question, answer, sources) and the ids of adversarial questions."""
    block = F.struct("rank", "title", "date", "score", "source_url", "text")
    chunks = shown.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(block)), lambda x: F.struct(*[x[c].alias(c) for c in ("title", "date", "score", "source_url", "text")])).alias("chunks"))
    marked = answered.join(adversarial.select("query").distinct().withColumn("adversarial", F.lit(True)), "query", "left")
    return marked.join(chunks, "query", "left").select("query", "question", F.coalesce("adversarial", F.lit(False)).alias("adversarial"), "answer", "sources", "chunks")


def write_demo(cache: DataFrame, path: str, **settings: str) -> None:
    """The cache as nested JSON lines, each with the settings it was made under."""
    config = F.struct(*[F.lit(v).alias(k) for k, v in settings.items()] or [F.lit(None).alias("none")])
    cache.withColumn("config", config).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def audit(hits: DataFrame) -> DataFrame:
    """Hits for reading by hand: line breaks to spaces, 140 characters, last URL segment to 55."""
    return hits.select("query", "rank", F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(140)).alias("snippet"), F.left(T.last_segment("source_url"), F.lit(55)).alias("source"))
