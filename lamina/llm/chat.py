"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. It renders the prefixes of a conversation one turn
at a time; where consecutive outputs part is where a turn's span starts. Two probes that differ only in
the last turn's text show where in its span the text stands, so no knowledge of the template is needed.
A prefix that is not kept by the next output shows a template that rewrites history.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The marks of the default template.
START, MIDDLE, END = "<s>[INST]", "[/INST]", "</s>"
CONTROLS = (START, MIDDLE, END, "<s>", "[INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of each control string; unescape() takes them away."""
    text = text.replace("\\", "\\\\")
    while (cut := _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)) != text:
        text = cut
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def inst_template(turns: list[Turn], escaped: Callable[[str], str] = escape) -> str:
    """<s>[INST]role[/INST]text</s> for each turn, with role and text escaped."""
    return "".join(f"{START}{escaped(role)}{MIDDLE}{escaped(text)}{END}" for role, text in turns)


def parse_inst(formatted: str) -> list[Turn]:
    """The turns back from inst_template()'s output."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(START).partition(MIDDLE)
        turns.append((unescape(role), unescape(text)))
    return turns


@dataclass
class Formatted:
    text: str
    turn_spans: list[tuple[int, int]]
    text_spans: list[tuple[int, int]]
    rewrites: list[int]
    """Indices of turns at which the template changed what it had rendered before."""


def _prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the longest common prefix, by halving
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _suffix(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # gallops from the end: what follows a turn's text is short
        step = min(max(1, lo + 1), hi - lo)
        if a.endswith(b[len(b) - lo - step :]):
            lo += step
        else:
            hi = lo + step - 1
    return lo


def render_incrementally(turns: list[Turn], template: Template) -> Formatted:
    """Spans are character offsets into the whole output. A turn at which history is rewritten starts where the outputs part."""
    before, turn_spans, text_spans, rewrites = template([]) if turns else "", [], [], []
    if not turns:
        return Formatted(template([]), [], [], [])
    for i, (role, text) in enumerate(turns):
        done = turns[:i]
        now = template([*done, (role, text)])
        start = _prefix(before, now)
        if start < len(before):
            rewrites.append(i)
        a, b = template([*done, (role, "0")]), template([*done, (role, "1")])
        first = _prefix(a, b)
        after = _suffix(a, b)
        turn_spans.append((start, len(now)))
        text_spans.append((first, max(first, len(now) - after)))
        before = now
    return Formatted(before, turn_spans, text_spans, rewrites)


def format_conversations(conversations: DataFrame, template: Template = inst_template) -> DataFrame:
    """(conv_id, formatted, turn_spans, text_spans, loss_spans, rewrites), one row for each conversation.

    Turns are sorted by turn, then role and text; null roles and texts count as empty, null turns come first, and rows
    without conv_id are a conversation of their own. Repeated rows are turns of their own. Other columns are not read.
    A conversation is one output row, so it must fit a task; its rows are gathered, not joined.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    cached = template is inst_template

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.list_(pa.int64()))
        for batch in batches:
            rows = []
            for turns in batch.column("turns").to_pylist():
                # Prefixes render the same turns again and again: what is escaped is kept as long as its conversation.
                render = functools.partial(template, escaped=functools.cache(escape)) if cached else template
                done = render_incrementally([(t["role"], t["text"]) for t in turns], render)
                loss = [s for s, t in zip(done.text_spans, turns, strict=True) if t["role"] == "assistant"]
                rows.append((done.text, done.turn_spans, done.text_spans, loss, done.rewrites))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), span, span, span, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "formatted", "turn_spans", "text_spans", "loss_spans", "rewrites"])

    spans = "array<array<long>>"
    return gathered.mapInArrow(run, f"conv_id long, formatted string, turn_spans {spans}, text_spans {spans}, loss_spans {spans}, rewrites array<long>")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes read back from the outputs of inst_template()."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = parse_inst(text)
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                rows.append((len(turns), _sha256("".join(f"{role}\n{said}\n" for role, said in turns)), len(loss), _sha256(loss), len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _escaped_length(column: str) -> str:
    """The length of escape()'s result in SQL: one more for each backslash and each place where a control string starts."""
    starts = {first: "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True) if c[0] == first) for first in ("<", "[")}
    found = [f"len(regexp_extract_all({column}, '{re.escape(first)}(?:{rest})'))" for first, rest in starts.items()]
    return " + ".join([f"length({column})", f"length({column}) - length(replace({column}, '\\', ''))", *found])


#: What the formatted text must lead back to, from the rows themselves.
ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn NULLS FIRST, role, said)) AS turns_sha256,
  coalesce(sum(length(said)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(said, '' ORDER BY turn NULLS FIRST, said) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START + MIDDLE + END)} + {_escaped_length("role")} + {_escaped_length("said")})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
