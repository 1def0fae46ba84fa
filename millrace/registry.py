"""Every query outside the llm subpackage, with its SQL where DuckDB can express it."""

from millrace.plans import evals, evidence, privacy, synth, tables, texts

PLANS = (tables, privacy, texts, evidence, evals, synth)


def queries() -> dict:
    return {name: query for plan in PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for plan in PLANS for name, text in plan.SQL.items()}
