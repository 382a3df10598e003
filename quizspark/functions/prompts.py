"""Prompt texts from question columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quizspark import fixed_values as fv

# template -> (label case, label of the question line, lines after the question)
_SHAPES = {
    "basic_qa": ("Category: ", "Value: ", "Difficulty: ", "Question: ", ["", "Answer:"]),
    "jeopardy_style": ("Category: ", "Value: ", "Difficulty: ", "Clue: ", ["", "Response:"]),
    "chain_of_thought": ("Category: ", "Value: ", "Difficulty: ", "Clue: ", ["", *fv.THOUGHT_STEPS]),
    "few_shot": ("Category: ", "Value: ", "Difficulty: ", "Clue: ", ["Response:"]),
    "instructional": ("CATEGORY: ", "VALUE: ", "DIFFICULTY: ", "CLUE: ", ["", "YOUR RESPONSE:"]),
}
TEMPLATES = list(_SHAPES)


def _example_lines(examples: list[dict], category: bool, value: bool) -> list[str]:
    lines: list[str] = []
    for number, ex in enumerate(examples, 1):
        lines.append(f"Example {number}:")
        lines += [f"Category: {ex['category']}"] if category else []
        lines += [f"Value: {ex['value']}"] if value else []
        lines += [f"Clue: {ex['question']}", f"Response: {ex['correct_answer']}", ""]
    return lines


def build_prompt(question: Column, category: Column | None = None, value: Column | None = None,
                 difficulty: Column | None = None, template: str = "jeopardy_style",
                 system_prompt: str | None = None, examples: list[dict] | None = None) -> Column:
    """One prompt per row. A context column that is absent, NULL or empty adds no line."""
    if template not in _SHAPES:
        raise ValueError(f"unknown template {template!r}; choose from {TEMPLATES}")
    cat_label, val_label, dif_label, q_label, tail = _SHAPES[template]
    head = [system_prompt or fv.SYSTEM_PROMPTS[template], ""]
    if template == "instructional":
        head += [*fv.INSTRUCTION_LINES, ""]
    if template == "few_shot":
        head += _example_lines(examples or fv.FEW_SHOT_EXAMPLES, category is not None,
                               value is not None) + ["Now answer this new clue:"]
    context = [F.concat(F.lit(label), F.nullif(c.cast("string"), F.lit("")))
               for label, c in ((cat_label, category), (val_label, value), (dif_label, difficulty))
               if c is not None]
    # concat_ws skips NULL lines; the blank line after the context appears only with a context.
    gap = [] if template == "few_shot" or not context else [
        F.when(F.coalesce(*context).isNotNull(), F.lit(""))]
    lines = [F.lit(x) for x in head] + context + gap + [
        F.concat(F.lit(q_label), F.coalesce(question, F.lit("")))] + [F.lit(x) for x in tail]
    return F.concat_ws("\n", *lines)


def estimate_tokens(prompt: Column) -> Column:
    """Rough count: four characters per token."""
    return F.floor(F.length(prompt) / 4)
