"""Messages for a completion service, as arrays of (role, content)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM = "Answer only from the context and cite [S<id>]."


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _ids(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: F.concat(F.lit("S"), x.cast("string"))), ", ")


def messages(question: Column, context: Column, system: str = SYSTEM) -> Column:
    """What is sent first: the rule, then the question with the packed context. A null question or context counts as empty."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.array(_message("system", F.lit(system)), _message("user", F.concat(F.lit("Question: "), blank(question), F.lit("\n\nContext:\n"), blank(context))))


def retry_messages(question: Column, context: Column, answer: Column, invalid: Column, allowed: Column, system: str = SYSTEM) -> Column:
    """What is sent once more after an answer that cited ids outside the context: the first messages, that answer, and which ids were wrong and which may be used."""
    again = F.concat(F.lit("Invalid: "), _ids(invalid), F.lit(". Allowed: "), _ids(allowed), F.lit("."))
    return F.concat(messages(question, context, system), F.array(_message("assistant", answer), _message("user", again)))
