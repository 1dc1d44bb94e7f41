"""Text expressions: field resolution, text construction, tag parsing, answers.

Everything is a Column built from JVM functions. A missing field and a null field are
the same thing here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: ColumnLike) -> Column:
    """Removes white space of every kind (also line ends) at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def blank_to_null(x: ColumnLike) -> Column:
    s = strip(x)
    return F.when(s != "", s)


def or_empty(x: ColumnLike) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def dataset_from_path(path: ColumnLike, suffix: str = "_low") -> Column:
    """File stem; a trailing ``suffix`` goes unless nothing would be left."""
    stem = F.regexp_extract(_c(path), r"([^/]+?)(?:\.[^./]*)?$", 1)
    cut = F.regexp_replace(stem, f"{suffix}$", "")
    return F.when(cut != "", cut).otherwise(stem)


def prompt_answer(prompt: ColumnLike, answer: ColumnLike, completion: ColumnLike) -> Column:
    """``prompt``, line end, ``answer`` (else ``completion``); null if nothing is left."""
    return blank_to_null(F.concat(or_empty(prompt), F.lit("\n"), F.coalesce(_c(answer), _c(completion), F.lit(""))))


def unix_lines(x: ColumnLike) -> Column:
    return F.regexp_replace(_c(x), "\r\n?", "\n")


def qa_pair(prompt: ColumnLike, answer: ColumnLike) -> Column:
    """``Q: ...`` and `` A: ...`` on two lines, with Unix line ends."""
    part = lambda x: strip(unix_lines(or_empty(x)))
    return F.concat(F.lit("Q: "), part(prompt), F.lit("\n A: "), part(answer))


def instruction_text(prompt: ColumnLike, completion: ColumnLike, before: str = "Instruction: ", between: str = "\nAnswer: ") -> Column:
    return strip(F.concat(F.lit(before), or_empty(prompt), F.lit(between), or_empty(completion)))


def instruction_text_of_record(prompt: ColumnLike, completion: ColumnLike, input: ColumnLike, output: ColumnLike) -> Column:  # noqa: A002
    """As above from prompt and completion if either is there, else from input and output."""
    first = _c(prompt).isNotNull() | _c(completion).isNotNull()
    return F.when(first, instruction_text(prompt, completion)).otherwise(instruction_text(input, output))


def without_answer_line(x: ColumnLike) -> Column:
    """Cuts a closing ``Answer: ...`` line."""
    return strip(F.regexp_replace(_c(x), r"(?i)\n\s*Answer\s*:\s*[^\n]*\s*$", ""))


def library_text(task: ColumnLike, question: ColumnLike, answer: ColumnLike, body: ColumnLike, category: ColumnLike, summary: ColumnLike) -> Column:
    """Text of a library record by its task: qa, mcq, tfq, paragraph or cs; null if empty."""
    t, q = _c(task), strip(or_empty(question))
    qa = F.when(q != "", F.concat(F.lit("Q: "), q, F.lit("\nA: "), strip(or_empty(answer))))
    cs = F.concat(F.lit("C: "), strip(or_empty(category)), F.lit("\nS: "), strip(or_empty(summary)))
    cs = F.when((strip(or_empty(category)) != "") | (strip(or_empty(summary)) != ""), cs)
    choice = blank_to_null(without_answer_line(or_empty(body)))
    return F.when(t == "qa", qa).when(t.isin("mcq", "tfq"), choice).when(t == "paragraph", blank_to_null(or_empty(body))).when(t == "cs", cs)


def first_text(*fields: ColumnLike) -> Column:
    """The first field that is not blank, stripped."""
    return F.coalesce(*map(blank_to_null, fields))


def rated_text(field: ColumnLike, *others: ColumnLike, strict: bool = False) -> Column:
    """The rated field; unless ``strict``, else the first of the others that is not blank."""
    return first_text(field) if strict else first_text(field, *others)


def answer_content(x: ColumnLike) -> Column:
    """Inside of the first ``<answer>`` (case matters), stripped; without one the whole
    text, stripped."""
    pattern = r"(?s)<answer>(.*?)</answer>"
    return strip(F.when(_c(x).rlike(pattern), F.regexp_extract(_c(x), pattern, 1)).otherwise(_c(x)))


def reward_text(title: ColumnLike, question: ColumnLike, answer: ColumnLike, response: ColumnLike | None = None) -> Column:
    """Title, question and answer of a record on lines of their own, blank ones left out; the
    answer's content comes from the response's tags if there is one."""
    said = blank_to_null(answer) if response is None else F.coalesce(blank_to_null(answer_content(response)), blank_to_null(answer))
    return F.concat_ws("\n", blank_to_null(title), blank_to_null(question), said)


def content_parts(x: ColumnLike, marks: tuple[str, ...] = ("<image>", "<video>")) -> Column:
    """A prompt's text cut at media marks: an array of (type, text), in order; empty texts
    are left out, and a mark has its name as type."""
    pattern = "|".join(f"(?<={m})|(?={m})" for m in marks)
    parts = F.filter(F.split(_c(x), pattern), lambda p: p != "")

    def one(p: Column) -> Column:
        of = F.lit("text")
        for m in marks:
            of = F.when(p == m, F.lit(m.strip("<>"))).otherwise(of)
        return F.struct(of.alias("type"), F.when(of == "text", p).alias("text"))

    return F.transform(parts, one)


def templated(template: str, content: ColumnLike, name: str = "content") -> Column:
    """``{{ content | trim }}`` (or without ``trim``) of a template filled with the text."""
    import re

    out, at = [], 0
    for m in re.finditer(r"\{\{\s*" + name + r"\s*(\|\s*trim\s*)?\}\}", template):
        out += [F.lit(template[at : m.start()]), strip(content) if m[1] else _c(content)]
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))

def generated_parts(x: ColumnLike) -> tuple[Column, Column]:
    """Chain of thought and output of a generation, tags in any case; without an answer
    tag the output is the whole text."""
    think, answer = r"(?is)<think>(.*?)</think>", r"(?is)<answer>(.*?)</answer>"
    cot = F.when(_c(x).rlike(think), strip(F.regexp_extract(_c(x), think, 1))).otherwise(F.lit(""))
    return cot, F.when(_c(x).rlike(answer), strip(F.regexp_extract(_c(x), answer, 1))).otherwise(strip(x))


def until_answer_end(x: ColumnLike) -> Column:
    """The text up to and with its first ``</answer>``, in any case."""
    at = F.locate("</answer>", F.lower(_c(x)))
    return F.when(at > 0, F.substring(_c(x), F.lit(1), at + 8)).otherwise(_c(x))


def flatten_messages(messages: ColumnLike, spaced: bool = True) -> Column:
    """``### role: content`` lines of an array of (role, content)."""
    head = "### " if spaced else "###"
    line = lambda m: F.concat(F.lit(head), m["role"], F.lit(": "), m["content"], F.lit("\n"))
    return F.array_join(F.transform(_c(messages), line), "")


# What stands before and after a message of each role in a chat style, and
# what opens and closes the prompt.
CHAT_STYLES = {
    "tulu": {"user": ("<|user|>\n", "\n"), "system": ("<|system|>\n", "\n"), "assistant": ("<|assistant|>\n", "</s>\n"), "open": "", "close": "<|assistant|>\n"},
    "olmo": {"user": ("<|user|>\n", "\n"), "system": ("<|system|>\n", "\n"), "assistant": ("<|assistant|>\n", "<|endoftext|>\n"), "open": "<|endoftext|>", "close": "<|assistant|>\n"},
    "zephyr": {"user": ("<|user|>\n", "</s>\n"), "system": ("<|system|>\n", "</s>\n"), "assistant": ("<|assistant|>\n", "</s>\n"), "open": "", "close": "<|assistant|>\n"},
    "llama2": {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "assistant": (" ", " </s><s>"), "open": "<s>", "close": ""},
    "llama3": {"user": ("<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|>"), "system": ("<|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|>"), "assistant": ("<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>"), "open": "<|begin_of_text|>", "close": "<|start_header_id|>assistant<|end_header_id|>\n\n"},
    "mistral": {"user": ("[INST] ", " [/INST]"), "system": ("", "\n\n"), "assistant": (" ", "</s>"), "open": "<s>", "close": ""},
    "gemma": {"user": ("<start_of_turn>user\n", "<end_of_turn>\n"), "system": ("<start_of_turn>user\n", "<end_of_turn>\n"), "assistant": ("<start_of_turn>model\n", "<end_of_turn>\n"), "open": "<bos>", "close": "<start_of_turn>model\n"},
    "phi": {"user": ("<|user|>\n", "<|end|>\n"), "system": ("<|system|>\n", "<|end|>\n"), "assistant": ("<|assistant|>\n", "<|end|>\n"), "open": "", "close": "<|assistant|>\n"},
    "xwin": {"user": ("USER: ", " "), "system": ("", " "), "assistant": ("ASSISTANT: ", "</s>"), "open": "", "close": "ASSISTANT:"},
}


def chat(messages: ColumnLike, style: str = "tulu") -> Column:
    """Messages as one prompt in a chat style; messages of unknown roles are left out."""
    if style not in CHAT_STYLES:
        raise ValueError(f"unknown style {style}")
    marks = CHAT_STYLES[style]

    def one(m: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for role in ("user", "system", "assistant"):
            before, after = marks[role]
            out = out.when(m["role"] == role, F.concat(F.lit(before), F.coalesce(m["content"], F.lit("")), F.lit(after)))
        return out.otherwise(F.lit(""))

    return F.concat(F.lit(marks["open"]), F.array_join(F.transform(_c(messages), one), ""), F.lit(marks["close"]))


def merge_request(instruction: ColumnLike, input: ColumnLike) -> Column:  # noqa: A002
    """Instruction and input on lines of their own; either may be missing."""
    return F.concat_ws("\n", blank_to_null(instruction), blank_to_null(input))


def training_target(cot: ColumnLike, output: ColumnLike) -> Column:
    """``<think>`` part, if there is one, and ``<answer>`` part."""
    think = F.when(strip(or_empty(cot)) != "", F.concat(F.lit("<think>\n"), F.rtrim(_c(cot)), F.lit("\n</think>\n\n"))).otherwise(F.lit(""))
    return F.concat(think, F.lit("<answer>\n"), F.rtrim(or_empty(output)), F.lit("\n</answer>"))


def split_by_roles(transcript: ColumnLike, roles: list[str]) -> Column:
    """A transcript ``Role: text Role: text`` as a map of role to its texts, in order."""
    marks = "|".join(roles)
    parts = F.split(_c(transcript), rf"(?=(?:{marks}):)")

    def said(role: str) -> Column:
        mine = F.filter(parts, lambda p: p.startswith(f"{role}:"))
        return F.filter(F.transform(mine, lambda p: strip(F.substring(p, F.lit(len(role) + 2), F.length(p)))), lambda p: p != "")

    return F.map_from_arrays(F.array(*map(F.lit, roles)), F.array(*map(said, roles)))


def preference_suffixes(chosen: ColumnLike, rejected: ColumnLike) -> Column:
    """Of two transcripts (arrays of turns): for each differing turn the suffixes from
    there; if none differs, from the last turn."""
    a, b = _c(chosen), _c(rejected)
    n = F.least(F.size(a), F.size(b))
    places = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(a, i) != F.element_at(b, i))
    at = F.when(F.size(places) > 0, places).otherwise(F.array(n))
    made = F.transform(at, lambda i: F.struct(i.alias("turn"), F.slice(a, i, F.size(a)).alias("chosen"), F.slice(b, i, F.size(b)).alias("rejected")))
    return F.when(n > 0, made).otherwise(F.slice(made, 1, 0))


def last_words(x: ColumnLike, n: int = 374) -> Column:
    """The last ``n`` space-separated words."""
    words = F.split(_c(x), " ")
    return F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - (n - 1)), F.lit(n)), " ")


def flatten_names(fields: dict, prefix: str = "") -> dict[str, object]:
    """Nested dict with keys joined by ``/``."""
    out: dict[str, object] = {}
    for k, v in fields.items():
        out |= flatten_names(v, f"{prefix}{k}/") if isinstance(v, dict) else {prefix + k: v}
    return out


def unflatten_names(fields: dict[str, object]) -> dict:
    out: dict = {}
    for k, v in fields.items():
        *path, last = k.split("/")
        reduce(lambda d, p: d.setdefault(p, {}), path, out)[last] = v
    return out


# Answers of benchmarks


def last_number(x: ColumnLike) -> Column:
    """The last number once thousands separators are gone, else the text. A sign counts
    only before decimals."""
    plain = F.regexp_replace(_c(x), r"(\d),(\d)", "$1$2")
    found = F.regexp_extract_all(plain, F.lit(r"([-+]?\d*\.\d+|\d+)"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(plain)


def stated_answer(x: ColumnLike) -> Column:
    """What follows ``the answer is`` up to a stop, else the stripped text."""
    pattern = r"[t|T]he answer is (.*?)\."
    return F.when(_c(x).rlike(pattern), F.regexp_extract(_c(x), pattern, 1)).otherwise(strip(x))


def reference_number(x: ColumnLike) -> Column:
    """The text after ``####`` without thousands separators."""
    return F.regexp_replace(strip(F.element_at(F.split(_c(x), "####"), -1)), r"(\d),(\d)", "$1$2")


def normal_match(x: ColumnLike) -> Column:
    """Lower case, without punctuation: the form in which answers are compared."""
    return F.regexp_replace(F.lower(_c(x)), r"\p{Punct}", "")


def trim_answer(x: ColumnLike) -> Column:
    """Drops a leading ``A:``, cuts at the next ``Q:``, joins paragraphs."""
    s = strip(F.regexp_replace(strip(x), r"^A:", ""))
    return strip(F.regexp_replace(F.element_at(F.split(s, "Q:"), 1), r"\n\n", " "))


def reference_answers(x: ColumnLike, separator: str = ";") -> Column:
    """Answers of a list, trimmed, each with a closing stop."""
    parts = F.filter(F.transform(F.split(_c(x), separator), lambda p: strip(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.when(p.endswith("."), p).otherwise(F.concat(p, F.lit("."))))


def best_answer(x: ColumnLike) -> Column:
    s = strip(x)
    return F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit(".")))


def question_prompt(question: ColumnLike, choices: list[ColumnLike], answer: ColumnLike | None = None) -> Column:
    """A multiple-choice question with lettered choices and ``Answer:``."""
    lines = [F.concat(F.lit(f"\n{'ABCDEFGHIJ'[i]}. "), _c(c)) for i, c in enumerate(choices)]
    tail = F.lit("\nAnswer:") if answer is None else F.concat(F.lit("\nAnswer: "), _c(answer), F.lit("\n\n"))
    return F.concat(_c(question), *lines, tail)


def subject_title(x: ColumnLike) -> Column:
    return F.regexp_replace(_c(x), "_", " ")
