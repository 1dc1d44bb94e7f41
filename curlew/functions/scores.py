"""Rating expressions: task types, score parsing, compression, rewards."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _c, ColumnLike, answer_content, strip

# Order in which an id's tokens name a task type, and the ratings asked for.
TASK_TYPES = ("qa", "mcq", "para", "tfq", "cs")
RATINGS = ("Rarity", "Complexity", "Informativeness", "Overall rating")


def compress(score: ColumnLike) -> Column:
    """Scores 0..10 to 0..5: held between 4 and 9, less 4."""
    return (F.least(F.lit(9), F.greatest(F.lit(4), _c(score))) - 4).cast("int")


def task_type(source: ColumnLike, id: ColumnLike) -> Column:  # noqa: A002
    """``source`` if it is a task type, else the first type among the id's tokens, else qa."""
    s = F.lower(strip(F.coalesce(_c(source), F.lit(""))))
    tokens = F.split(F.lower(strip(F.coalesce(_c(id).cast("string"), F.lit("")))), r"[\s_\-:/\.]+")
    out = F.when(s.isin(*TASK_TYPES), s)
    for t in TASK_TYPES:
        out = out.when(F.array_contains(tokens, t), F.lit(t))
    return out.otherwise(F.lit("qa"))


def whole_score(x: ColumnLike) -> Column:
    """Numbers and numeric strings to integers, halves to even; null for anything else."""
    return F.bround(_c(x).try_cast("double")).cast("int")


def quality_norm(q: ColumnLike) -> Column:
    return F.when(_c(q).between(1, 5), (_c(q).cast("double") - 1) / 4)


def _balanced(text: str, opening: str, closing: str, last: bool = False) -> str | None:
    """The first (or last) balanced bracket of the text that no other one holds. An opener
    that never closes is passed over."""
    open_, pairs = [], []
    for i, c in enumerate(text):
        if c == opening:
            open_.append(i)
        elif c == closing and open_:
            begin = open_.pop()
            while pairs and pairs[-1][0] > begin:
                pairs.pop()
            pairs.append((begin, i))
    if not pairs:
        return None
    begin, end = pairs[-1 if last else 0]
    return text[begin : end + 1]


def parse_scores(raw: str | None, last: bool = False) -> list[list[int]]:
    """Ratings of a rater's reply: of the first balanced list of objects, else of the first
    (or last) object; missing ratings are 0, a reply that cannot be read is one row of 0."""
    none = [[0] * len(RATINGS)]
    try:
        text = raw or ""
        part = None if last else _balanced(text, "[", "]")
        part = part or _balanced(text, "{", "}", last)
        if part is None:
            return none
        data = json.loads(part)
        rows = []
        for item in data if isinstance(data, list) else [data]:
            if last and not all(k in item for k in RATINGS):
                return none
            values = [item.get(k, 0) for k in RATINGS]
            values[3] = values[3] or item.get("Overall", 0)  # absent, null and 0 alike
            rows.append([int(v) for v in values])
        return rows or none
    except (ValueError, TypeError, AttributeError):
        return none


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def extract_scores(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Brackets that nest are beyond Java's patterns, so this one is vectorised Python."""
    for part in raw:
        yield part.map(parse_scores)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def extract_last_scores(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in raw:
        yield part.map(lambda x: parse_scores(x, last=True))


def rating_detail(raw: ColumnLike, last: bool = False) -> Column:
    """The first row of parsed ratings, with the compressed overall score."""
    s = F.element_at((extract_last_scores if last else extract_scores)(_c(raw)), 1)
    return F.struct(s[0].alias("Rarity"), s[1].alias("Complexity"), s[2].alias("Informativeness"), s[3].alias("Overall"), compress(s[3]).alias("Overall_compressed"))


# Rewards


# The whole response, and what each task asks of its answer.
WHOLE_FORMAT = r"(?is)^\s*<think>.*?</think>\s*<answer>.*?</answer>\s*$"
TASK_FORMATS = {
    "qa": r"(?is)<answer>.*?Q:.*?A:.*?</answer>",
    "mcq": r"(?is)<answer>.*?Q:.*?A\).*?B\).*?C\).*?D\).*?Answer:.*?</answer>",
    "cs": r"(?is)<answer>.*?C:.*?S:.*?</answer>",
    "tfq": r"(?is)<answer>.*?Answer:.*?</answer>",
}


def task_kind(task: ColumnLike) -> Column:
    """The task's name up to the first ``_``: ``qa`` of ``qa_any_suffix``."""
    return F.substring_index(_c(task), "_", 1)


def format_reward(response: ColumnLike, task: ColumnLike) -> Column:
    """Half for a thought and an answer as the whole response, half for the form that the
    task asks of the answer (``para``: always; other unknown tasks: never)."""
    text = F.coalesce(_c(response), F.lit(""))
    kind = task_kind(task)
    form = F.when(kind == "para", 0.5)
    for name, pattern in TASK_FORMATS.items():
        form = form.when((kind == name) & text.rlike(pattern), 0.5)
    return F.when(text.rlike(WHOLE_FORMAT), 0.5).otherwise(0.0) + form.otherwise(0.0)


def alignment_reward(similarity: ColumnLike, threshold: float = 0.8) -> Column:
    return F.when(_c(similarity) >= threshold, 1.0).otherwise(0.0)


def normal_weights(quality: float, alignment: float, format: float) -> tuple[float, float, float]:  # noqa: A002
    total = quality + alignment + format
    if total <= 0:
        raise ValueError("weights must add up to more than 0")
    return quality / total, alignment / total, format / total


def combined_reward(
    task: ColumnLike,
    quality: ColumnLike,
    alignment: ColumnLike,
    format: ColumnLike,  # noqa: A002
    weights: tuple[float, float, float] = (0.7, 0.2, 0.1),
    by_task: dict[str, tuple[float | None, float | None, float | None]] | None = None,
) -> Column:
    """Weighted sum of quality, alignment and format. The common weights are normalised; a
    task's own weights replace them where they are given and not 0. Of tasks without an
    entry, qa and cs take the common weights, others .8, 0 and .2. A missing reward
    counts 0.5."""
    common = normal_weights(*weights)
    parts = [F.coalesce(_c(x), F.lit(0.5)) for x in (quality, alignment, format)]
    mix = lambda w: parts[0] * w[0] + parts[2] * w[2] + parts[1] * w[1]
    out = F.when(F.lit(False), F.lit(0.0))
    for t, own in (by_task or {}).items():
        out = out.when(_c(task) == t, mix([a or b for a, b in zip(own, common, strict=True)]))
    return out.when(task_kind(task).isin("qa", "cs"), mix(common)).otherwise(mix((0.8, 0.0, 0.2)))


def boxed(x: ColumnLike) -> Column:
    """The inside of the last ``\\boxed{...}`` without nested braces."""
    return F.try_element_at(F.regexp_extract_all(_c(x), F.lit(r"\\boxed\{([^{}]*)\}"), 1), F.lit(-1))


def squeezed(response: ColumnLike) -> Column:
    """Without white space around ``<``, ``>`` and ``/``."""
    return F.regexp_replace(_c(response), r"\s*(<|>|/)\s*", "$1")


def math_format_reward(response: ColumnLike) -> Column:
    return F.when(squeezed(response).rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), 1.0).otherwise(0.0)


def tagged_format_reward(response: ColumnLike) -> Column:
    return F.when(_c(response).rlike(r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>$"), 1.0).otherwise(0.0)


def number_of(x: Column) -> Column:
    """The value of a number, percentage or simple fraction (``a/b``, ``\\frac{a}{b}``); null for
    anything else."""
    s = F.regexp_replace(F.regexp_replace(x, r"[\s$,]|\\[!,;]", ""), r"\\[dt]frac", r"\\frac")
    parts = r"^(-?)(?:\\frac\{(-?[\d.]+)\}\{(-?[\d.]+)\}|(-?[\d.]+)/(-?[\d.]+))$"
    side = lambda a, b: F.coalesce(F.regexp_extract(s, parts, a).try_cast("double"), F.regexp_extract(s, parts, b).try_cast("double"))
    fraction = F.try_divide(side(2, 4), side(3, 5)) * F.when(F.regexp_extract(s, parts, 1) == "-", -1.0).otherwise(1.0)
    percent = F.regexp_extract(s, r"^(-?[\d.]+)\\?%$", 1).try_cast("double") / 100
    return F.coalesce(F.when(s.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), s.try_cast("double")), F.when(s.rlike(parts), fraction), percent)


def same_answer(a: Column, b: Column) -> Column:
    """Equal text, spaces and case aside, or equal value."""
    plain = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))
    near = F.abs(number_of(a) - number_of(b)) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(number_of(b)))
    return F.coalesce((plain(a) == plain(b)) | F.coalesce(near, F.lit(False)), F.lit(False))


def math_accuracy(response: ColumnLike, truth: ColumnLike) -> Column:
    """Whether the boxed answer and the truth are the same text or number."""
    return F.when(same_answer(boxed(response), _c(truth)), 1.0).otherwise(0.0)


def tagged_accuracy(response: ColumnLike, truth: ColumnLike) -> Column:
    """Whether the first one-line ``<answer>`` and the truth are the same text or number."""
    found = F.when(_c(response).rlike("<answer>(.*?)</answer>"), strip(F.regexp_extract(_c(response), "<answer>(.*?)</answer>", 1))).otherwise(strip(response))
    return F.when(same_answer(found, strip(truth)), 1.0).otherwise(0.0)


# Replacements and removals that bring a final answer to its normal form.
REPLACED = [
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
]
REMOVED = [
    "square",
    "ways",
    "integers",
    "dollars",
    "mph",
    "inches",
    "hours",
    "km",
    "units",
    "\\ldots",
    "sue",
    "points",
    "feet",
    "minutes",
    "digits",
    "cents",
    "degrees",
    "cm",
    "gm",
    "pounds",
    "meters",
    "meals",
    "edges",
    "students",
    "childrentickets",
    "multiples",
    "\\text{s}",
    "\\text{.}",
    "\\text{\ns}",
    "\\text{}^2",
    "\\text{}^3",
    "\\text{\n}",
    "\\text{}",
    "\\mathrm{th}",
    "^\\circ",
    "^{\\circ}",
    "\\;",
    ",\\!",
    "{,}",
    '"',
    "\\dots",
]


def normal_final_answer(x: ColumnLike) -> Column:
    """A final answer without its equation's left side, units and LaTeX dressing."""
    s = F.substring_index(_c(x), "=", -1)
    for old, new in [*REPLACED, *((r, "") for r in REMOVED)]:
        s = F.replace(s, F.lit(old), F.lit(new))
    # What these patterns take off must be the same for equal results.
    patterns = [
        (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
        (r"\\text\{(.*?)\}", "$1"),
        (r"\\textbf\{(.*?)\}", "$1"),
        (r"\\overline\{(.*?)\}", "$1"),
        (r"\\boxed\{(.*)\}", "$1"),
        (r"frac([^{])(.)", "frac{$1}{$2}"),
        (r"sqrt([^{])", "sqrt{$1}"),
    ]
    for old, new in patterns:
        s = F.regexp_replace(s, old, new)
    s = F.replace(s, F.lit("$"), F.lit(""))
    return strip(F.when(F.replace(s, F.lit(","), F.lit("")).rlike(r"^\d+$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(s))


def final_answer_accuracy(response: ColumnLike, truth: ColumnLike, window: int = 300) -> Column:
    """1 if the last ``Answer:`` line of the response's end equals the truth, else -1."""
    found = F.regexp_extract_all(F.right(_c(response), F.lit(window)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), 1)
    said = F.when(F.size(found) > 0, F.try_element_at(found, F.lit(-1))).otherwise(F.lit("[INVALID]"))
    return F.when(normal_final_answer(said) == normal_final_answer(truth), 1.0).otherwise(-1.0)


def overlong_penalty(length: ColumnLike, max_length: int, buffer: int) -> Column:
    """0 up to ``max_length - buffer``, then falling in a line to -1 at ``max_length``."""
    n, expected = _c(length).cast("double"), max_length - buffer
    return F.when(n <= expected, 0.0).when(n <= max_length, (expected - n) / buffer).otherwise(-1.0)
