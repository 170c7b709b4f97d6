"""Prompt building by replacement in templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The templates' slots.
KEYWORDS, KNOWLEDGE, INSTRUCTION, TEXT1, TEXT2 = "{keywords}", "{knowledge_base}", "{INSTRUCTION}", "{TEXT1}", "{TEXT2}"


def fill(template: Column | str, **slots: Column) -> Column:
    """``template`` with each ``{name}`` replaced, one after the other in the order given."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def instruction_prompt(template: str, keywords: Column) -> Column:
    """An instruction with the keywords; the slot for a knowledge base stays empty."""
    return fill(template, keywords=keywords, knowledge_base=F.lit(""))


def judge_prompt(template: str, instruction: Column) -> Column:
    return fill(template, INSTRUCTION=instruction)


def pair_prompt(template: str, text1: Column, text2: Column) -> Column:
    """The first text goes in first, so a slot for the second inside it is filled as well."""
    return fill(template, TEXT1=text1, TEXT2=text2)


def training_text(instruction: Column, response: Column) -> Column:
    return F.concat(instruction, response)


def preferred_output(answer: Column) -> Column:
    """a, b or tie from a judge's answer; null for anything else."""
    choice = F.regexp_extract(answer, r"Output \(([ab])\)", 1)
    return F.when(choice != "", choice).when(F.contains(answer, F.lit("Tie")), F.lit("tie"))
