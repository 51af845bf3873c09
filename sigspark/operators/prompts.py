"""Conversations to prompts, prompts to labels. One conversation per row; all operators are narrow projections."""
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.functions.arrays import indices, let
from sigspark.functions.json import decoded_json
from sigspark.operators.ranking import number_rows
from sigspark.operators.templates import QUESTION_ORDER, QUESTION_TEMPLATE, QUESTIONS, SECTION_ORDER, TEMPLATE_SCHEMA, TEMPLATES

PLACEHOLDER = "<signal>"  # fixed value: where signal tokens go
IGNORE = -100  # fixed value: label of tokens that are not learned
PAD = -2  # fixed value: padding of ragged index lists
NONE = -1  # fixed value: index list of a prompt without signal tokens

# What is removed from turns, and where a model answer ends.
TAGS = r"(?iU)<\s*(?:ecg|image)\s*>\s*\n?"
ROLE_PREFIX = r"(?iU)^\s*(?:[:：]\s*|(?:user|assistant|human|gpt|model|system|q|a)\s*:\s*)+"
ANSWER = r"(?sU)Answer:\s*(.+?)(?=\n(?:[-#]{3,}|Output:|Question:)|\z)"


def turn(role: Column, value: Column) -> Column:
    return F.struct(role.alias("from"), value.alias("value"))


def chat_turns(conversations: Column, model_role: str) -> Column:
    """Pretraining data: first question without line breaks and signal tag, then the answer."""
    question = F.replace(F.replace(conversations[0]["value"], F.lit("\n"), F.lit("")), F.lit("<ecg>"), F.lit(""))
    return F.array(turn(F.lit("human"), question), turn(F.lit(model_role), F.get(conversations, F.lit(1))["value"]))


def qa_turns(question: Column, answers: Column, model_role: str) -> Column:
    """Question and answer; an answer list is joined by spaces."""
    return F.array(turn(F.lit("human"), question), turn(F.lit(model_role), F.array_join(answers, " ")))


def cleaned(text: Column) -> Column:
    """Without signal tags and leading role names; the word image becomes signal, its capital kept."""
    text = F.regexp_replace(text, TAGS, "")
    text = F.regexp_replace(text, r"(?U)\bI(?i:mage)\b", "Signal")
    text = F.regexp_replace(text, r"(?U)\bi(?i:mage)\b", "signal")
    return F.regexp_replace(text, ROLE_PREFIX, "")


def is_human(role: Column) -> Column:
    return F.lower(role).isin("human", "user")


def with_placeholders(conversations: Column, n: int) -> Column:
    """Signal placeholders before the first human turn; none for n = 0."""
    if n == 0:
        return conversations
    marks = " ".join([PLACEHOLDER] * n) + "\n"
    roles = F.transform(conversations, lambda t: is_human(t["from"]))
    first = F.array_position(roles, F.lit(True)) - 1
    return let(
        first,
        lambda f: F.transform(
            conversations,
            lambda t, i: turn(t["from"], F.when(i == f, F.concat(F.lit(marks), t["value"])).otherwise(t["value"])),
        ),
    )


def prepared_turns(conversations: Column, n_placeholders: int) -> Column:
    """Cleaned turns with placeholders, ready to render."""
    clean = F.transform(conversations, lambda t: turn(t["from"], cleaned(t["value"])))
    return let(clean, lambda c: with_placeholders(c, n_placeholders))


def template_table(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return spark.createDataFrame(TEMPLATES if rows is None else rows, TEMPLATE_SCHEMA)


def with_templates(df: DataFrame, rows: list | None = None) -> DataFrame:
    """Each row once per template, as column ``template``; the few templates travel inside the plan."""
    names = [c.split()[0] for c in TEMPLATE_SCHEMA.split(", ")]
    structs = [
        F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, row)]) for row in (TEMPLATES if rows is None else rows)
    ]
    return df.withColumn("template", F.explode(F.array(*structs)))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rendered(conversations: Column, template: Column) -> Column:
    """Prompt text of a conversation in the style of its template; null for a style without a renderer.

    A style is a head, then per turn ``open role glue message end`` (or ``open
    role bare`` for an empty message), then a tail.
    """
    t = lambda name: F.coalesce(template[name], F.lit(""))
    style, sep = template["style"], t("sep")
    system = F.replace(t("system_template"), F.lit("{system_message}"), t("system_message"))
    has_message = F.length(t("system_message")) > 0
    n = F.lit("\n")

    head = (
        F.when(style.isin("ADD_COLON_SINGLE", "ADD_COLON_TWO", "ADD_COLON_SPACE_SINGLE"), F.concat(system, sep))
        .when(style == "ADD_NEW_LINE_SINGLE", F.when(system == "", "").otherwise(F.concat(system, sep)))
        .when(style.isin("NO_COLON_SINGLE", "NO_COLON_TWO", "DEEPSEEK_CHAT"), system)
        .when(style == "LLAMA2", F.when(has_message, system).otherwise("[INST] "))
        .when(style == "CHATML", F.when(system == "", "").otherwise(F.concat(system, sep, n)))
        .when(style == "LLAMA3", F.concat(F.lit("<|begin_of_text|>"), F.when(has_message, system).otherwise("")))
        .when(style == "GEMMA", "<bos>")
        .when(style == "DEFAULT", F.concat(system, n))
    )
    opening = F.when(style == "LLAMA3", "<|start_header_id|>").when(style == "GEMMA", "<start_of_turn>").otherwise("")
    glue = (
        F.when(style.isin("ADD_NEW_LINE_SINGLE", "CHATML", "GEMMA"), "\n")
        .when(style.isin("NO_COLON_SINGLE", "NO_COLON_TWO"), "")
        .when(style == "LLAMA2", " ")
        .when(style == "LLAMA3", "<|end_header_id|>\n\n")
        .otherwise(": ")
    )
    bare = (
        F.when(style.isin("ADD_NEW_LINE_SINGLE", "CHATML", "GEMMA"), "\n")
        .when(style.isin("NO_COLON_SINGLE", "NO_COLON_TWO", "LLAMA2"), "")
        .when(style == "LLAMA3", "<|end_header_id|>\n\n")
        .when(style == "ADD_COLON_SPACE_SINGLE", ": ")
        .otherwise(":")
    )

    def end(i):
        by_turn = F.when(i % 2 == 0, sep).otherwise(t("sep2"))
        return (
            F.when(style.isin("ADD_COLON_TWO", "NO_COLON_TWO", "LLAMA2", "DEEPSEEK_CHAT"), by_turn)
            .when(style == "CHATML", F.concat(sep, n))
            .when(style == "LLAMA3", "<|eot_id|>")
            .when(style == "DEFAULT", n)
            .otherwise(sep)
        )

    def piece(x, i):
        mapped = F.when(is_human(x["from"]), t("role_0")).otherwise(t("role_1"))
        alternating = F.when(i % 2 == 0, t("role_0")).otherwise(t("role_1"))
        role = F.when(style == "LLAMA2", alternating).otherwise(mapped)
        value = F.coalesce(x["value"], F.lit(""))
        text = F.when(style == "LLAMA3", _stripped(value)).otherwise(value)
        full = F.when((style == "LLAMA2") & (i == 0), F.concat(text, F.lit(" "))).otherwise(
            F.concat(opening, role, glue, text, end(i))
        )
        return F.when(value == "", F.concat(opening, role, bare)).otherwise(full)

    tail = F.when((style == "GEMMA") & (t("stop_str") == "<eos>"), "<eos>").otherwise("")
    return F.concat(head, F.array_join(F.transform(conversations, piece), ""), tail)


def render_error(template: Column, prompt: Column) -> Column:
    return F.when(prompt.isNull(), F.concat(F.lit("no renderer for style "), template["style"]))


def prompt_sides(prompt: Column) -> Column:
    """Text before and after the first placeholder; without one, everything is before."""
    place = F.locate(PLACEHOLDER, prompt)
    before = F.when(place > 0, prompt.substr(F.lit(1), place - 1)).otherwise(prompt)
    after = F.when(place > 0, F.substr(prompt, place + len(PLACEHOLDER))).otherwise("")
    return F.struct(before.alias("before"), after.alias("after"))


# --- labels ----------------------------------------------------------------
def _in(values: list):
    return lambda x: x.isin(*values) if values else F.lit(False)


def response_ranges(ids: Column, watch: dict) -> Column:
    """[start, stop) of every response: from behind a start pattern to the next end token, inclusive.

    Patterns count only once a begin token was seen. Only positions that hold an
    end token or a start pattern are walked, a handful per prompt, so the state
    machine costs one linear scan. An end token that closes a response is used
    up: a pattern that begins with it is not seen.
    """
    start, eos, bos = watch["response_start"], _in(watch["eos"]), _in(watch["bos"])
    k = len(start)
    state = "struct<resume:int,open:int,ranges:array<struct<start:int,stop:int>>>"

    def walk(x):
        n = F.size(x)
        hits = lambda i: reduce(
            lambda a, b: a & b, [F.get(x, i + j) == F.lit(token) for j, token in enumerate(start)], F.lit(k > 0)
        )
        begin = F.get(F.filter(indices(n), lambda i: bos(F.get(x, i))), F.lit(0))
        events = F.filter(indices(n), lambda i: (eos(F.get(x, i)) | F.coalesce(hits(i), F.lit(False))))

        def step(acc, i):
            is_start = F.coalesce(hits(i), F.lit(False)) & F.coalesce(i >= begin, F.lit(False))
            closed = F.concat(acc["ranges"], F.array(F.struct(acc["open"].alias("start"), (i + 1).alias("stop"))))
            make = lambda resume, opened, ranges: F.struct(
                resume.cast("int").alias("resume"), opened.cast("int").alias("open"), ranges.alias("ranges")
            ).cast(state)
            return (
                F.when(i < acc["resume"], acc)
                .when(acc["open"].isNull() & is_start, make(i + k, i + k, acc["ranges"]))
                .when(acc["open"].isNotNull() & eos(F.get(x, i)), make(i + 1, F.lit(None), closed))
                .otherwise(acc)
            )

        empty = F.struct(
            F.lit(0).alias("resume"),
            F.lit(None).cast("int").alias("open"),
            F.array().cast("array<struct<start:int,stop:int>>").alias("ranges"),
        ).cast(state)

        def finish(acc):
            rest = F.array(F.struct(acc["open"].alias("start"), n.alias("stop")))
            return F.when(acc["open"] < n, F.concat(acc["ranges"], rest)).otherwise(acc["ranges"])

        return F.aggregate(events, empty, step, finish)

    return let(ids, walk)


def labels(ids: Column, watch: dict) -> Column:
    """Token id inside responses, IGNORE elsewhere; a final end token of the whole prompt is labelled too."""
    final = _in(watch["final_eos"])

    def mark(ranges):
        inside = lambda i: F.exists(ranges, lambda r: (i >= r["start"]) & (i < r["stop"]))
        last = lambda x, i: (i == F.size(ids) - 1) & final(x)
        return F.transform(ids, lambda x, i: F.when(inside(i) | last(x, i), x).otherwise(F.lit(IGNORE)))

    return let(response_ranges(ids, watch), mark)


def label_runs(marked: Column) -> Column:
    """Maximal [start, stop) runs of labelled positions."""

    def runs(x):
        on = lambda i: F.coalesce(F.get(x, i) != IGNORE, F.lit(False))
        starts = F.filter(indices(F.size(x)), lambda i: on(i) & ((i == 0) | ~on(F.greatest(i - 1, F.lit(0)))))
        stops = F.filter(indices(F.size(x)), lambda i: on(i) & ~on(i + 1))
        return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop")))

    return let(marked, runs)


def misaligned(ids: Column, runs: Column, watch: dict) -> Column:
    """Runs that do not follow the start pattern or do not end in an end token."""
    start, ends = watch["response_start"], _in([*watch["eos"], *watch["final_eos"]])
    k = len(start)
    pattern = F.array(*[F.lit(t) for t in start])
    led = lambda r: (r["start"] >= k) & (F.slice(ids, F.greatest(r["start"] - k + 1, F.lit(1)), k) == pattern)
    return F.filter(runs, lambda r: ~(led(r) & ends(F.get(ids, r["stop"] - 1))))


def response_texts(words: Column, ids: Column, runs: Column, special: list) -> Column:
    """Text of each run, special tokens left out."""
    pairs = F.arrays_zip(words.alias("w"), ids.alias("i"))
    return let(
        pairs,
        lambda p: F.transform(
            runs,
            lambda r: F.trim(
                F.array_join(
                    F.transform(
                        F.filter(F.slice(p, r["start"] + 1, r["stop"] - r["start"]), lambda x: ~x["i"].isin(*special)),
                        lambda x: x["w"],
                    ),
                    " ",
                )
            ),
        ),
    )


def continuation(prompt: Column, generated: Column, stops: list) -> Column:
    """Generated ids without a repeated prompt, cut before the first stop id."""
    shared = F.slice(generated, 1, F.size(prompt)) == prompt
    cont = F.when(shared, F.slice(generated, F.size(prompt) + 1, F.size(generated))).otherwise(generated)

    def cut(x):
        first = F.get(F.filter(indices(F.size(x)), lambda i: F.get(x, i).isin(*stops)), F.lit(0))
        return F.slice(x, 1, F.coalesce(first, F.size(x)))

    return let(cont, cut)


# --- lengths ---------------------------------------------------------------
def fitted(ids: Column, length: int, pad: int) -> Column:
    """Exactly ``length`` ids: padded on the left, or the last ones kept."""
    short = F.concat(F.array_repeat(F.lit(pad).cast("int"), F.greatest(F.lit(length) - F.size(ids), F.lit(0))), ids)
    kept = F.slice(ids, F.greatest(F.size(ids) - length + 1, F.lit(1)), length)
    return F.when(F.size(ids) <= length, short).otherwise(kept)


def budgeted(before: Column, signal: Column, after: Column, length: int, min_signal: int, pad: int) -> Column:
    """Prompt of ``length`` ids: ``before`` is kept, the signal is cut to what is left but not below its minimum, then ``after``."""
    b, s, a = F.size(before), F.size(signal), F.size(after)
    target = F.least(s, F.greatest(F.lit(min_signal), F.lit(length) - (b + a)))
    cut = F.slice(signal, 1, target)
    rest = F.slice(after, 1, F.greatest(F.lit(length) - b - F.size(cut), F.lit(0)))
    whole = F.concat(F.array_repeat(F.lit(pad).cast("int"), F.greatest(F.lit(length) - (b + s + a), F.lit(0))), before, signal, after)
    failure = F.raise_error(F.lit("before and the minimal signal exceed the length")).cast("array<int>")
    return (
        F.when(b + s + a <= length, whole).when(b + min_signal > length, failure).otherwise(F.concat(before, cut, rest))
    )


def attention_mask(ids: Column, bos: int) -> Column:
    """0 before the first begin token, 1 from there on."""
    n = F.size(ids)
    zeros = F.array_position(ids, F.lit(bos)).cast("int") - 1
    return F.when(zeros >= 0, F.concat(F.array_repeat(F.lit(0), zeros), F.array_repeat(F.lit(1), n - zeros)))


def positions_of(ids: Column, wanted: list) -> Column:
    """Indices of the wanted ids, or [NONE]."""
    found = F.filter(indices(F.size(ids)), lambda i: F.get(ids, i).isin(*wanted))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit(NONE))))


def batched(df: DataFrame, row: str, lists: list[str], size: int) -> DataFrame:
    """Rows without nulls in batches of ``size`` in row order, each list padded to the longest of its batch."""
    full = reduce(lambda d, c: d.filter(F.col(c).isNotNull()), lists, df)
    placed = number_rows(full, [], [row], "row_index").withColumn("batch", F.floor(F.col("row_index") / size)).drop("row_index")
    batch = Window.partitionBy("batch")
    for c in lists:
        placed = placed.withColumn(f"_{c}", F.max(F.size(c)).over(batch))
        gap = F.col(f"_{c}") - F.size(c)
        placed = placed.withColumn(c, F.concat(c, F.array_repeat(F.lit(PAD).cast("int"), gap))).drop(f"_{c}")
    return placed


# --- structured questions, requests and answers ----------------------------
def question_sheet(spark: SparkSession, questions=QUESTIONS, sections=SECTION_ORDER, order=QUESTION_ORDER) -> DataFrame:
    """One row (``sheet``): the questions that the order names, below the heading of their section."""
    asked = spark.createDataFrame(questions, "section string, key string, question string, choices array<string>")
    headings = spark.createDataFrame(list(enumerate(sections)), "part int, section string")
    places = spark.createDataFrame(list(enumerate(order)), "place int, key string")
    choices = F.array_join(F.transform("choices", lambda c: F.concat(F.lit('"'), c, F.lit('"'))), ", ")
    entry = F.format_string("\n\n%s: %s\n  Choices: [%s]", "key", "question", choices)
    listed = headings.join(asked.join(places, "key").withColumn("entry", entry), "section", "left")
    entries = F.array_sort(F.collect_list(F.struct("place", "entry")))
    body = F.array_join(F.transform(entries, lambda e: e["entry"]), "")  # a section without questions has one null entry
    parts = listed.groupBy("part", "section").agg(F.concat(F.lit("\n## "), F.col("section"), F.lit(" Section"), body).alias("text"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "\n").alias("sheet"))


def question_prompt(report: Column, sheet: DataFrame) -> Column:
    """The template with a report and the one row of :func:`question_sheet`; the report goes in last and stays as it is."""
    return F.replace(F.replace(F.lit(QUESTION_TEMPLATE), F.lit("{questions}"), sheet.scalar()), F.lit("{report}"), report)


def intake(df: DataFrame, response: str) -> tuple[DataFrame, DataFrame]:
    """Responses that are JSON, parsed (``parsed`` VARIANT), and the others."""
    parsed = df.withColumn("parsed", decoded_json(F.col(response)))
    return parsed.filter(F.col("parsed").isNotNull()), parsed.filter(F.col("parsed").isNull()).drop("parsed")


def extracted_answer(text: Column) -> Column:
    """Last ``Answer:`` up to a rule, the next field or the end; one line, without closing stops and spaces."""
    last = F.coalesce(F.get(F.reverse(F.regexp_extract_all(text, F.lit(ANSWER), F.lit(1))), F.lit(0)), F.lit(""))
    return F.regexp_replace(F.replace(_stripped(last), F.lit("\n"), F.lit(" ")), r"[ .]+$", "")


def request_messages(system: str, question: Column) -> Column:
    """JSON of a system and a user message."""
    content = F.array(F.struct(F.lit("input_text").alias("type"), question.alias("text")))
    user = F.to_json(F.struct(F.lit("user").alias("role"), content.alias("content")))
    head = F.to_json(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return F.concat(F.lit("["), head, F.lit(","), user, F.lit("]"))
