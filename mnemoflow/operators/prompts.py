"""Prompts as Columns; the wording is ours, the shape of the answer prompts is fixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACT = (
    "List each new statement of fact, preference or belief in the segment, one on a line. Leave out what is known already. "
    "If there is none, write NO NEW PROPOSITIONS.\n<known>\n{{ existing }}\n</known>\n<segment>\n{{ segment }}\n</segment>"
)
CONDENSE = (
    "Merge these statements into at most {{ most }}, one on a line, keeping what is specific. "
    "If there is nothing to merge, write NO CONDENSED PROPOSITIONS.\n<known>\n{{ existing }}\n</known>"
)
EPISODE = (
    "Summarise the exchange as <results> of <result> tags: the user's part, the agent's part, outcome, location, reflection, then tags.\n"
    "<history>\n{{ history }}\n</history>"
)


def filled(template: str, **fields: Column) -> Column:
    """The template with each {{ name }} replaced; null as empty."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{{ " + name + " }}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def routed(template: str, **fields: Column) -> Column:
    """A template with {{ name }} places as above, any other with {name} places."""
    if "{{" in template and "}}" in template:
        return filled(template, **fields)
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def answer(question: Column, context: Column) -> Column:
    return F.concat(F.lit("User: "), question, F.lit("\nKnown context (may be empty):\n"), F.coalesce(context, F.lit("")), F.lit("\n\nAssistant:"))


def answer_after_context(question: Column, context: Column, system: str = "You answer from the context where it helps.") -> Column:
    """Context first, below a system line."""
    return F.concat(F.lit(system + "\n\nKnown context (may be empty):\n"), F.coalesce(context, F.lit("")), F.lit("\n\nUser: "), question, F.lit("\nAssistant:"))
