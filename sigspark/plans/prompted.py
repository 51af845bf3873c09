"""Queries on conversations, prompts and labels."""
from pyspark.sql import functions as F

from sigspark.functions.arrays import unrolled
from sigspark.operators import prompts
from sigspark.operators.templates import TEMPLATES, WATCH_TOKENS
from sigspark.plans.bindings import WHITESPACE, conv, table

WATCH = WATCH_TOKENS["llama-3.2"]


def _turns(df, column, keep=("conv_id",)):
    t = unrolled(df, keep, F.col(column), "t", "turn")
    return t.select(*keep, F.col("turn").cast("bigint").alias("turn"), F.col("t.from").alias("role"), F.col("t.value").alias("value"))


# --- turns -----------------------------------------------------------------
def chat_normalisation(spark, d):
    """Every conversation; one without an answer has a null in its place."""
    c = conv(spark, d)
    first = F.col("conversations")[0]
    marked = F.concat(F.array(prompts.turn(first["from"], F.concat(F.lit("<ecg>\n"), first["value"]))), F.slice("conversations", 2, F.size("conversations")))
    c = c.withColumn("conversations", marked)
    return _turns(c.withColumn("x", prompts.chat_turns(F.col("conversations"), "assistant")), "x").withColumn("value", F.md5("value"))


def qa_normalisation(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("answers"), "lang")
    x = docs.withColumn("x", prompts.qa_turns(F.col("lang"), F.col("answers"), "model"))
    return _turns(x, "x", ("doc_id",)).withColumn("value", F.md5("value"))


def _tagged(spark, d):
    lead = F.element_at(
        F.array(*map(F.lit, ["<ECG>\n", " User: Assistant :  ", "< image >The Image and image; imagery ", ": q: <ecg> ", ""])),
        (F.col("conv_id") % 5 + 1).cast("int"),
    )
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", F.concat(lead, "text", F.lit(" IMAGE")).alias("text"))


def text_cleaning(spark, d):
    return _tagged(spark, d).select("conv_id", "turn", prompts.cleaned(F.col("text")).alias("text"))


_TAGGED = """tagged AS (SELECT conv_id, turn, role, ['<ECG>\n', ' User: Assistant :  ', '< image >The Image and image; imagery ', ': q: <ecg> ', ''][conv_id % 5 + 1]
                               || text || ' IMAGE' AS text FROM conversations)"""
_CLEANED = r"""cleaned AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(?i)<\s*(?:ecg|image)\s*>\s*\n?', '', 'g'), '\bI(?i:mage)\b', 'Signal', 'g'), '\bi(?i:mage)\b', 'signal', 'g'),
    '(?i)^\s*(?:[:：]\s*|(?:user|assistant|human|gpt|model|system|q|a)\s*:\s*)+', '') AS text FROM tagged)"""


def role_mapping(spark, d):
    c = table(spark, d, "conversations")
    role = F.when(prompts.is_human(F.col("role")), 0).otherwise(1)
    return c.select("conv_id", "turn", role.alias("side"))


def placeholder_injection(spark, d):
    x = conv(spark, d).withColumn("x", prompts.with_placeholders(F.col("conversations"), 3))
    return _turns(x, "x").withColumn("value", F.md5("value"))


# --- rendering -------------------------------------------------------------
# One template per separator style, with and without a system message.
STYLE_NAMES = [
    "ADD_COLON_SINGLE", "ADD_COLON_TWO", "ADD_COLON_SPACE_SINGLE", "ADD_NEW_LINE_SINGLE", "NO_COLON_SINGLE", "NO_COLON_TWO",
    "LLAMA2", "CHATML", "LLAMA3", "DEEPSEEK_CHAT", "GEMMA", "DEFAULT",
]
STYLES = [(f"{s}-plain", "{system_message}", "", "USER", "BOT", s, " | ", "</s>", None) for s in STYLE_NAMES] + [
    (f"{s}-system", "<{system_message}>", "Be brief.", "USER", "BOT", s, " | ", "</s>", "<eos>") for s in STYLE_NAMES
]


def _some_empty(spark, d):
    """Conversations in which the closing turn of every third one is still empty."""
    last = F.size("conversations") - 1
    emptied = F.transform(
        "conversations",
        lambda t, i: prompts.turn(t["from"], F.when((i == last) & (F.col("conv_id") % 3 == 0), F.lit(None)).otherwise(t["value"])),
    )
    return conv(spark, d).withColumn("conversations", emptied)


def _rendered(spark, d, rows):
    t = prompts.with_templates(_some_empty(spark, d), rows)
    t = t.withColumn("prompt", prompts.rendered(F.col("conversations"), F.col("template")))
    error = prompts.render_error(F.col("template"), F.col("prompt"))
    return t.select("conv_id", F.col("template.name").alias("template"), F.md5("prompt").alias("prompt_md5"), error.alias("error"))


def style_rendering(spark, d):
    return _rendered(spark, d, STYLES)


def template_rendering(spark, d):
    return _rendered(spark, d, TEMPLATES)


def _quoted(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _render_sql(rows):
    values = ", ".join("(" + ", ".join(_quoted(v) for v in row) + ")" for row in rows)
    return f"""WITH tpl(name, systpl, sysmsg, r0, r1, style, sep0, sep2_0, stop) AS (VALUES {values}),
t AS (SELECT *, replace(systpl, '{{system_message}}', sysmsg) AS sys, coalesce(sep0, '') AS sep, coalesce(sep2_0, '') AS sep2 FROM tpl),
msg AS (SELECT conv_id, turn, lower(role) IN ('human', 'user') AS human,
               CASE WHEN conv_id % 3 = 0 AND turn = max(turn) OVER (PARTITION BY conv_id) THEN '' ELSE text END AS m FROM conversations),
p AS (SELECT conv_id, turn, m, t.*, CASE WHEN human THEN r0 ELSE r1 END AS role, CASE WHEN turn % 2 = 0 THEN r0 ELSE r1 END AS tag,
             CASE WHEN turn % 2 = 0 THEN sep ELSE sep2 END AS alt FROM msg, t),
pieces AS (SELECT conv_id, turn, name, style, sys, sysmsg, sep, stop, CASE style
    WHEN 'ADD_COLON_SINGLE' THEN CASE WHEN m = '' THEN role || ':' ELSE role || ': ' || m || sep END
    WHEN 'ADD_COLON_TWO' THEN CASE WHEN m = '' THEN role || ':' ELSE role || ': ' || m || alt END
    WHEN 'ADD_COLON_SPACE_SINGLE' THEN CASE WHEN m = '' THEN role || ': ' ELSE role || ': ' || m || sep END
    WHEN 'ADD_NEW_LINE_SINGLE' THEN CASE WHEN m = '' THEN role || chr(10) ELSE role || chr(10) || m || sep END
    WHEN 'NO_COLON_SINGLE' THEN CASE WHEN m = '' THEN role ELSE role || m || sep END
    WHEN 'NO_COLON_TWO' THEN CASE WHEN m = '' THEN role ELSE role || m || alt END
    WHEN 'LLAMA2' THEN CASE WHEN m = '' THEN tag WHEN turn = 0 THEN m || ' ' ELSE tag || ' ' || m || alt END
    WHEN 'CHATML' THEN CASE WHEN m = '' THEN role || chr(10) ELSE role || chr(10) || m || sep || chr(10) END
    WHEN 'LLAMA3' THEN '<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)
        || CASE WHEN m = '' THEN '' ELSE regexp_replace(m, '^{WHITESPACE}|{WHITESPACE}$', '', 'g') || '<|eot_id|>' END
    WHEN 'DEEPSEEK_CHAT' THEN CASE WHEN m = '' THEN role || ':' ELSE role || ': ' || m || alt END
    WHEN 'GEMMA' THEN '<start_of_turn>' || role || chr(10) || CASE WHEN m = '' THEN '' ELSE m || sep END
    WHEN 'DEFAULT' THEN CASE WHEN m = '' THEN role || ':' ELSE role || ': ' || m || chr(10) END END AS piece FROM p),
bodies AS (SELECT conv_id, name, style, sys, sysmsg, sep, stop, string_agg(piece, '' ORDER BY turn) AS body FROM pieces GROUP BY ALL),
whole AS (SELECT conv_id, name, style, CASE style
    WHEN 'ADD_NEW_LINE_SINGLE' THEN CASE WHEN sys = '' THEN '' ELSE sys || sep END || body
    WHEN 'CHATML' THEN CASE WHEN sys = '' THEN '' ELSE sys || sep || chr(10) END || body
    WHEN 'LLAMA2' THEN CASE WHEN sysmsg = '' THEN '[INST] ' ELSE sys END || body
    WHEN 'LLAMA3' THEN '<|begin_of_text|>' || CASE WHEN sysmsg = '' THEN '' ELSE sys END || body
    WHEN 'GEMMA' THEN '<bos>' || body || CASE WHEN stop = '<eos>' THEN '<eos>' ELSE '' END
    WHEN 'DEFAULT' THEN sys || chr(10) || body
    WHEN 'NO_COLON_SINGLE' THEN sys || body WHEN 'NO_COLON_TWO' THEN sys || body WHEN 'DEEPSEEK_CHAT' THEN sys || body
    WHEN 'CHATINTERN' THEN NULL ELSE sys || sep || body END AS prompt FROM bodies)
SELECT conv_id, name AS template, md5(prompt) AS prompt_md5, CASE WHEN prompt IS NULL THEN 'no renderer for style ' || style END AS error FROM whole"""


def _signal_prompts(spark, d):
    c = conv(spark, d).withColumn("conversations", prompts.prepared_turns(F.col("conversations"), 2))
    t = prompts.with_templates(c, [r for r in TEMPLATES if r[0] == "gemini"])
    return t.select("conv_id", prompts.rendered(F.col("conversations"), F.col("template")).alias("prompt"))


def prompt_split(spark, d):
    s = _signal_prompts(spark, d).withColumn("s", prompts.prompt_sides(F.col("prompt")))
    return s.select("conv_id", F.col("s.before").alias("before"), F.md5("s.after").alias("after_md5"))


# --- labels ----------------------------------------------------------------
def _words(text):
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def _word_id(w):
    return (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int") % 100000).cast("int")


def _ids(*values):
    return F.array(*[F.lit(v).cast("int") for v in values])


def prompt_ids(spark, d):
    """Token ids of whole conversations: begin, then header, words and end of every turn; and the same as words."""
    role = lambda t: F.when(t["from"] == "assistant", 78191).otherwise(882)
    ids = lambda t: F.concat(
        F.array(F.lit(128006), role(t), F.lit(128007), F.lit(271)), F.transform(_words(t["value"]), _word_id), _ids(128009)
    )
    texts = lambda t: F.concat(F.array_repeat(F.lit("<h>"), 4), _words(t["value"]), F.array(F.lit("<e>")))
    c = conv(spark, d)
    return c.select(
        "conv_id",
        F.concat(_ids(128000), F.flatten(F.transform("conversations", ids))).alias("ids"),
        F.concat(F.array(F.lit("<b>")), F.flatten(F.transform("conversations", texts))).alias("words"),
    )


_IDS = f"""
turn_words AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '{WHITESPACE}'), lambda w: w <> '') AS w FROM conversations),
turn_ids AS (SELECT conv_id, turn, role, w, list_concat([128006, CASE WHEN role = 'assistant' THEN 78191 ELSE 882 END, 128007, 271],
                    list_transform(w, lambda x: (('0x' || substring(md5(x), 1, 6))::BIGINT % 100000)::INT), [128009]) AS t FROM turn_words),
placed AS (SELECT *, len(t) AS n, 1 + coalesce(sum(len(t)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM turn_ids),
prompt AS (SELECT conv_id, 0 AS pos, 128000 AS id, false AS resp FROM (SELECT DISTINCT conv_id FROM conversations)
           UNION ALL SELECT conv_id, base + i, t[i + 1], role = 'assistant' AND i >= 4 FROM placed, range(n) r(i)),
prompts AS (SELECT conv_id, list(id ORDER BY pos) AS ids, count(*) AS n FROM prompt GROUP BY 1)"""


def response_labels(spark, d):
    p = prompt_ids(spark, d).withColumn("labels", prompts.labels(F.col("ids"), WATCH))
    x = unrolled(p, ["conv_id"], F.arrays_zip("ids", "labels"), "x", "pos")
    return x.select("conv_id", "pos", F.col("x.ids").alias("id"), F.col("x.labels").alias("label"))


def _runs(spark, d):
    p = prompt_ids(spark, d).withColumn("labels", prompts.labels(F.col("ids"), WATCH))
    return p.withColumn("runs", prompts.label_runs(F.col("labels")))


def response_ranges(spark, d):
    r = unrolled(_runs(spark, d), ["conv_id"], F.col("runs"), "r", "response")
    return r.select("conv_id", "response", F.col("r.start").alias("start"), F.col("r.stop").alias("stop"))


def gold_responses(spark, d):
    t = _runs(spark, d).withColumn("texts", prompts.response_texts(F.col("words"), F.col("ids"), F.col("runs"), WATCH["eos"]))
    return unrolled(t, ["conv_id"], F.col("texts"), "text", "response").withColumn("text", F.md5("text"))


def generated_continuation(spark, d):
    """The prompt up to its first response as prompt, the whole as generated text; in every other case without the prompt.

    A conversation without a response is all prompt: nothing is generated.
    """
    p = _runs(spark, d)
    start = F.coalesce(F.get("runs", F.lit(0))["start"], F.size("ids"))
    prompt = F.slice("ids", 1, start)
    generated = F.when(F.col("conv_id") % 2 == 0, F.col("ids")).otherwise(F.slice("ids", start + 1, F.size("ids")))
    cont = prompts.continuation(prompt, generated, WATCH["eos"])
    return p.select("conv_id", F.size(cont).alias("n"), F.md5(F.array_join(cont.cast("array<string>"), ",")).alias("ids_md5"))


def range_alignment(spark, d):
    """Runs out of line: none as rendered, all when the header is one token short."""
    r = _runs(spark, d)
    odd = prompts.misaligned(F.col("ids"), F.col("runs"), WATCH)
    cut = F.transform("runs", lambda x: F.struct((x["start"] + 1).alias("start"), x["stop"].alias("stop")))
    return r.select("conv_id", F.size(odd).alias("misaligned"), F.size(prompts.misaligned(F.col("ids"), cut, WATCH)).alias("moved"))


def pad_and_truncate(spark, d):
    return unrolled(prompt_ids(spark, d), ["conv_id"], prompts.fitted(F.col("ids"), 96, 128004), "id", "pos")


def token_budget(spark, d):
    p = prompt_ids(spark, d)
    before, after = F.slice("ids", 1, 5), F.slice("ids", 6, F.size("ids"))
    signal = F.transform(F.sequence(F.lit(1), (F.col("conv_id") % 40 + 1).cast("int")), lambda i: i + 200000)
    out = prompts.budgeted(before, signal, after, 80, 10, 128004)
    return unrolled(p, ["conv_id"], out, "id", "pos")


_BUDGET = f"""WITH {_IDS},
parts AS (SELECT conv_id, ids[1:5] AS b, ids[6:] AS a, n - 5 AS an, list_transform(range(1, conv_id % 40 + 2), lambda i: (i + 200000)::INT) AS s,
                 conv_id % 40 + 1 AS sn FROM prompts),
cut AS (SELECT *, least(sn, greatest(10, 80 - (5 + an))) AS keep FROM parts),
whole AS (SELECT conv_id, CASE WHEN 5 + sn + an <= 80 THEN list_concat(list_transform(range(80 - 5 - sn - an), lambda i: 128004), b, s, a)
                 ELSE list_concat(b, s[1:keep], a[1:75 - keep]) END AS out FROM cut)
SELECT conv_id, i::INT AS pos, out[i + 1]::INT AS id FROM whole, range(len(out)) t(i)"""


def attention_mask(spark, d):
    # Shorter prompts are padded in front, so that some masks begin with zeros; longer ones stay whole.
    padded = F.when(F.size("ids") < 600, prompts.fitted(F.col("ids"), 600, 128004)).otherwise(F.col("ids"))
    p = prompt_ids(spark, d).withColumn("ids", padded)
    kept = p.withColumn("mask", prompts.attention_mask(F.col("ids"), 128000))
    return kept.select("conv_id", F.size("mask").alias("n"), F.array_position("mask", 1).alias("first"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("ones"))


def placeholder_positions(spark, d):
    p = prompt_ids(spark, d).withColumn("at", prompts.positions_of(F.col("ids"), [78191]))
    return unrolled(p, ["conv_id"], F.col("at"), "position", "i")


def batch_padding(spark, d):
    p = prompts.batched(prompt_ids(spark, d), "conv_id", ["ids"], 8)
    count = F.size(F.filter("ids", lambda x: x == prompts.PAD))
    return p.select("conv_id", "batch", F.size("ids").alias("length"), count.alias("padded"))


# --- questions, requests, answers ------------------------------------------
def question_prompts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", prompts.question_prompt(F.col("text"), prompts.question_sheet(spark)).alias("p"))
    return docs.select("doc_id", F.length("p").alias("chars"), F.md5("p").alias("prompt_md5"))


def answer_intake(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("diagnostic"),
        F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props")).alias("response"),
    )
    good, bad = prompts.intake(e, "response")
    kept = good.select("event_id", "diagnostic", F.try_variant_get("parsed", "$.k", "bigint").alias("k"), F.lit(True).alias("valid"))
    return kept.unionByName(bad.select("event_id", "diagnostic", F.lit(None).cast("bigint").alias("k"), F.lit(False).alias("valid")))


def answer_extraction(spark, d):
    c = table(spark, d, "conversations")
    tail = F.element_at(F.array(*map(F.lit, ["\n----\nmore", "\nOutput: x", "\nQuestion: y", " . ", ""])), (F.col("turn") % 5 + 1).cast("int"))
    text = F.concat(F.lit("Reason. Answer: first\n### \nAnswer:  "), "text", tail)
    none = F.when(F.col("conv_id") % 11 == 0, F.col("text")).otherwise(text)
    return c.select("conv_id", "turn", F.md5(prompts.extracted_answer(none)).alias("answer_md5"))


def request_payload(spark, d):
    c = table(spark, d, "conversations")
    return c.select(
        "conv_id", "turn", F.md5(prompts.request_messages("Answer in one word.", F.col("text"))).alias("messages_md5"), F.md5(F.lower("text")).alias("answer_md5")
    )


_STRIP = f"regexp_replace(text, '^{WHITESPACE}|{WHITESPACE}$', '', 'g')"

# Fixed value: the sheet of questions as it has to read.
_SHEET = """
## QRS Section

QRS: Is a QRS complex present?
  Choices: ["Yes", "No (Asystole)"]

Pacing: Is pacing present?
  Choices: ["Yes", "No"]

Axis: What is the axis of the QRS complex?
  Choices: ["normal", "Right/LPFB", "Left/LAFB", "NW"]

Lead reversal: Is there a lead reversal present?
  Choices: ["No", "LA/RA", "LA/LL", "RA/RL", "Other"]

Rate: What is the rate of the QRS complex?
  Choices: ["Bradycardia", "Tachycardia", "Normal"]

Amplitude: What is the amplitude of the QRS complex?
  Choices: ["Normal", "LVH/RVH", "Low"]

Preexcitation: Is there a preexcitation present?
  Choices: ["Yes", "No"]

AP: What is the accessory pathway (AP)?
  Choices: ["Normal", "Right/LPFB", "Left/LAFG", "NW"]

Duration: What is the duration of the QRS complex in milliseconds?
  Choices: ["<110", ">120", "110-120"]

## Noise Artifacts Section

Noise artifacts: What kind of noise artifacts are present?
  Choices: ["Missing lead", "LVAD", "Other noise"]

## T Section

T: What is the morphology of the T wave?
  Choices: ["Normal", "Peaked", "Inverted", "Nonspecific"]"""
PLANS = {
    "chat_normalisation": (
        chat_normalisation,
        """WITH n AS (SELECT conv_id, max(text) FILTER (turn = 0) AS q, max(text) FILTER (turn = 1) AS a FROM conversations GROUP BY 1)
           SELECT conv_id, t AS turn, CASE t WHEN 0 THEN 'human' ELSE 'assistant' END AS role,
                  md5(CASE t WHEN 0 THEN replace(q, chr(10), '') ELSE a END) AS value FROM n, range(2) r(t)""",
    ),
    "qa_normalisation": (
        qa_normalisation,
        """SELECT doc_id, t AS turn, CASE t WHEN 0 THEN 'human' ELSE 'model' END AS role, md5(CASE t WHEN 0 THEN lang ELSE text END) AS value
           FROM documents, range(2) r(t)""",
    ),
    "text_cleaning": (text_cleaning, f"WITH {_TAGGED}, {_CLEANED} SELECT conv_id, turn, text FROM cleaned"),
    "role_mapping": (role_mapping, "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS side FROM conversations"),
    "placeholder_injection": (
        placeholder_injection,
        """WITH f AS (SELECT conv_id, min(turn) AS f FROM conversations WHERE role = 'user' GROUP BY 1)
           SELECT conv_id, turn, role, md5(CASE WHEN turn = f THEN '<signal> <signal> <signal>' || chr(10) ELSE '' END || text) AS value
           FROM conversations LEFT JOIN f USING (conv_id)""",
    ),
    "style_rendering": (style_rendering, _render_sql(STYLES)),
    "template_rendering": (template_rendering, _render_sql(TEMPLATES)),
    "prompt_split": (
        prompt_split,
        rf"""WITH {_CLEANED.replace("FROM tagged", "FROM conversations")},
            f AS (SELECT conv_id, min(turn) AS f FROM conversations WHERE role = 'user' GROUP BY 1),
            m AS (SELECT conv_id, turn, role, CASE WHEN turn = f THEN '<signal> <signal>' || chr(10) ELSE '' END || text AS v FROM cleaned LEFT JOIN f USING (conv_id)),
            p AS (SELECT conv_id, chr(10) || string_agg(CASE WHEN v = '' THEN CASE WHEN role = 'user' THEN 'user:' ELSE 'model:' END
                  ELSE CASE WHEN role = 'user' THEN 'user: ' ELSE 'model: ' END || v || chr(10) END, '' ORDER BY turn) AS prompt FROM m GROUP BY 1)
            SELECT conv_id, string_split(prompt, '<signal>')[1] AS before,
                   md5(coalesce(substring(prompt, nullif(position('<signal>' IN prompt), 0) + 8), '')) AS after_md5 FROM p""",
    ),
    "response_labels": (
        response_labels,
        f"WITH {_IDS} SELECT conv_id, pos::INT AS pos, id::INT AS id, CASE WHEN resp THEN id ELSE -100 END::INT AS label FROM prompt",
    ),
    "response_ranges": (
        response_ranges,
        f"""WITH {_IDS} SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS response,
            (base + 4)::INT AS start, (base + n)::INT AS stop FROM placed WHERE role = 'assistant'""",
    ),
    "gold_responses": (
        gold_responses,
        f"""WITH {_IDS} SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS response,
            md5(array_to_string(w, ' ')) AS text FROM placed WHERE role = 'assistant'""",
    ),
    "generated_continuation": (
        generated_continuation,
        f"""WITH {_IDS}, f AS (SELECT conv_id, arg_min(t, turn) AS t FROM placed WHERE role = 'assistant' GROUP BY 1),
            g AS (SELECT conv_id, t[5:len(t) - 1] AS x FROM f)
            SELECT conv_id, coalesce(len(x), 0)::INT AS n, md5(coalesce(array_to_string(x, ','), '')) AS ids_md5
            FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN g USING (conv_id)""",
    ),
    "range_alignment": (
        range_alignment,
        f"""SELECT conv_id, 0 AS misaligned, count(*) FILTER (role = 'assistant')::INT AS moved FROM conversations GROUP BY 1""",
    ),
    "pad_and_truncate": (
        pad_and_truncate,
        f"""WITH {_IDS} SELECT conv_id, i::INT AS pos, (CASE WHEN n - 96 + i < 0 THEN 128004 ELSE ids[n - 96 + i + 1] END)::INT AS id FROM prompts, range(96) t(i)""",
    ),
    "token_budget": (token_budget, _BUDGET),
    "attention_mask": (
        attention_mask,
        f"""WITH {_IDS} SELECT conv_id, greatest(n, 600)::INT AS n, greatest(601 - n, 1) AS "first", n::INT AS ones FROM prompts""",
    ),
    "placeholder_positions": (
        placeholder_positions,
        f"""WITH {_IDS}, h AS (SELECT conv_id, pos FROM prompt WHERE id = 78191)
            SELECT c.conv_id, (row_number() OVER (PARTITION BY c.conv_id ORDER BY pos) - 1)::INT AS i, coalesce(pos, -1)::INT AS position
            FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN h USING (conv_id)""",
    ),
    "batch_padding": (
        batch_padding,
        f"""WITH {_IDS}, b AS (SELECT conv_id, n, (row_number() OVER (ORDER BY conv_id) - 1) // 8 AS batch FROM prompts),
            m AS (SELECT *, max(n) OVER (PARTITION BY batch) AS longest FROM b)
            SELECT conv_id, batch, longest::INT AS length, (longest - n)::INT AS padded FROM m""",
    ),
    "question_prompts": (
        question_prompts,
        f"""WITH p AS (SELECT doc_id, 'Given the ECG diagnosis: "' || text || '"

Answer the following questions about this ECG:

{_SHEET}

Respond with a JSON object containing your answers.' AS p FROM documents)
            SELECT doc_id, length(p)::INT AS chars, md5(p) AS prompt_md5 FROM p""",
    ),
    "answer_intake": (
        answer_intake,
        """SELECT event_id, event_type AS diagnostic, CASE WHEN event_id % 7 <> 0 THEN (props::JSON->>'$.k')::BIGINT END AS k, event_id % 7 <> 0 AS valid FROM events""",
    ),
    "answer_extraction": (
        answer_extraction,
        f"""SELECT conv_id, turn, md5(CASE WHEN conv_id % 11 = 0 THEN '' ELSE rtrim(replace({_STRIP}, chr(10), ' '), ' .') END) AS answer_md5 FROM conversations""",
    ),
    "request_payload": (
        request_payload,
        """SELECT conv_id, turn, md5('[{"role":"system","content":"Answer in one word."},' ||
                  to_json({'role': 'user', 'content': [{'type': 'input_text', 'text': text}]})::VARCHAR || ']') AS messages_md5,
                  md5(lower(text)) AS answer_md5 FROM conversations""",
    ),
}
