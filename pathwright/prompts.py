"""What models are asked: an answer to a question, other wordings of a question, a judgement of an answer. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import MARKER, STEP_TITLES

ANSWER = "\n".join(
    [
        "You model optimisation problems and solve them in Python.",
        f"Write {len(STEP_TITLES)} short steps, each as <step>Title: text</step>, with these titles: {'; '.join(STEP_TITLES)}.",
        "Then write one fenced block of complete Python code that runs from top to bottom, and nothing after it.",
        f"Its last printed line must be {MARKER} followed by a JSON object with the keys status and objective_value.",
    ]
)
REWORD = "You reword optimisation questions. Every number, name, relation and the direction of the objective must stay. Answer with one JSON object: {\"variants\": [texts]}."
JUDGE = "You judge answers to optimisation problems: the reasoning, the model, the code, the likely result. Answer with one JSON object with the keys overall_score, step_score, code_score (numbers from 0 to 1), verdict (excellent, good, weak or bad), strengths, issues (lists of short texts) and rationale (a short text)."

#: What to keep in mind in each family.
HINTS = {
    "resource_allocation": "Quantities are continuous and not negative; a linear solver is enough.",
    "production_planning": "Quantities are whole numbers; each product that is made needs a binary set-up variable.",
    "assignment": "Use one binary variable for each pair of worker and task.",
    "knapsack": "Use one binary variable for each item.",
    "tsp": "The trip is closed and visits each city once; a routing solver avoids subtours.",
}
OTHER = "State the domain of each variable."


def answer(question: Column, template: Column) -> Column:
    hints = F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair])
    return F.concat(F.lit(ANSWER + "\n\nFamily: "), template, F.lit("\nHint: "), F.coalesce(F.try_element_at(hints, template), F.lit(OTHER)), F.lit("\n\nQuestion:\n"), question)


def messages(question: Column, template: Column) -> Column:
    """The messages (role, content) before an answer."""
    hints = F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair])
    asked = F.concat(F.lit("Family: "), template, F.lit("\nHint: "), F.coalesce(F.try_element_at(hints, template), F.lit(OTHER)), F.lit("\n\nQuestion:\n"), question)
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("system", F.lit(ANSWER)), ("user", asked))])


def reword(question: Column, template: Column, instance: Column, wanted: int, styles: list[str]) -> Column:
    how = f"\n\nWordings wanted: {wanted}. Styles: {', '.join(styles) or 'memo'}.\nFamily: "
    return F.concat(F.lit(REWORD + how), template, F.lit("\n\nQuestion:\n"), question, F.lit("\n\nData:\n"), instance)


def judge(question: Column, response: Column, verification: Column) -> Column:
    seen = F.to_json(F.struct(*[verification[f].alias(f) for f in ("execution_ok", "status", "objective_match", "error_message")]))
    return F.concat(F.lit(JUDGE + "\n\nQuestion:\n"), question, F.lit("\n\nAnswer:\n"), response, F.lit("\n\nSolver:\n"), seen)
