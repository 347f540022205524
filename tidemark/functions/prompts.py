"""What goes into a model's prompt: the memory block and its four places, tool-call pairs, profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIONS = ("system_prompt", "user_message_before", "user_message_after", "fake_tool_call")
HEADER, FOOTER = "<memory>", "</memory>"
CALL_PREFIX = "memory-"
TRAITS = ("O", "C", "E", "A", "N")
#: Characters of evidence shown per trait.
EVIDENCE_SHOWN = 60

_BREAK = "\n\n"


def wrap(body: Column) -> Column:
    return F.concat_ws("\n", F.lit(HEADER), body, F.lit(FOOTER))


def inject(system: Column, prompt: Column, body: Column, position: Column) -> tuple[Column, Column]:
    """System prompt and user's message with the block at its position; positions not known go behind the system prompt."""
    block = wrap(body)
    behind = F.concat(system, F.when(system != "", F.lit(_BREAK)).otherwise(F.lit("")), block)
    in_message = position.isin(*POSITIONS[1:3])
    return (
        F.when(in_message | (position == POSITIONS[3]), system).otherwise(behind),
        F.when(position == POSITIONS[1], F.concat(block, F.lit(_BREAK), prompt))
        .when(position == POSITIONS[2], F.concat(prompt, F.lit(_BREAK), block))
        .otherwise(prompt),
    )


def clear(text: Column) -> Column:
    """Without injected blocks and the break that set each apart."""
    block = rf"{HEADER}\n.*?\n{FOOTER}"
    return F.regexp_replace(F.regexp_replace(text, rf"(?s)^{block}(?:\n\n)?", ""), rf"(?s)(?:\n\n)?{block}", "")


def tool_pair(call_id: Column, body: Column) -> Column:
    """array<struct<role, content, call_id>> of a call and its answer."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"), call_id.alias("call_id"))
    return F.array(message("assistant", F.lit("")), message("tool", body))


def without_tool_pairs(messages: Column) -> Column:
    return F.filter(messages, lambda m: ~F.coalesce(m.call_id.startswith(CALL_PREFIX), F.lit(False)))


def persona_lines(name: Column, traits: Column, evidence: Column) -> Column:
    """Name and a line per known trait, in their usual order; empty without traits."""
    lines = []
    for t in TRAITS:
        value, said = F.try_element_at(traits, F.lit(t)), F.try_element_at(evidence, F.lit(t))
        shown = F.when(said != "", F.concat(F.lit("：").cast("string"), F.substring(said, 1, EVIDENCE_SHOWN))).otherwise("")
        percent = F.rint((value + 1) / 2 * 100).cast("int").cast("string")
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"- {t} "), percent, F.lit("%"), shown)))
    return F.when(F.size(traits) > 0, F.concat_ws("\n", name, *lines)).otherwise("")
