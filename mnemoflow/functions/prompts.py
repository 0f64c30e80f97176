"""What models are asked, as columns. The answer's two last lines are what ``operators.answers`` reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CITE = "CITATIONS: event ids from the context that support it, with commas between, or none"


def numbered(options: Column) -> Column:
    """1. first option, and so on, a line each."""
    return F.array_join(F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o)), "\n")


def choice(question: Column, options: Column, context: Column) -> Column:
    """Asks for the number of one of the options."""
    return F.concat(
        F.lit("Choose the option that the context supports best.\n\nCONTEXT:\n"), context, F.lit("\n\nQUESTION: "), question, F.lit("\n\nOPTIONS:\n"), numbered(options),
        F.lit("\n\nReason briefly, then end with these two lines:\nANSWER: a number from 1 to "), F.size(options).cast("string"), F.lit("\n" + _CITE),
    )


def free(question: Column, context: Column) -> Column:
    """Asks for a short answer in words."""
    return F.concat(F.lit("Answer from the context alone.\n\nCONTEXT:\n"), context, F.lit("\n\nQUESTION: "), question, F.lit("\n\nReply with these two lines only:\nANSWER: a word or short phrase\n" + _CITE))


def reminded(prompt: Column, schema: str) -> Column:
    """The prompt once more, after an answer that couldn't be read."""
    return F.concat(prompt, F.lit(f"\n\nThe last reply could not be read. Reply with one JSON object that fits {schema}, and nothing else."))


# Own wording; each stage names the JSON that it wants.
STAGES = {
    "probe": "Does this shard know anything about the query? Give JSON: knows, confidence (0 to 1), memory_type (direct, adjacent, conflicting, vague or none), answer_value (none, low, medium or high), needs_recall, relevant (event ids).",
    "recall": "What does this shard say about the query? Give JSON: confidence (0 to 1), answer, claims (claim, support, confidence), unknowns, conflicts.",
    "synthesis": "Merge these recalls. Give JSON: summary, key_claims (claim, sources, confidence), conflicts, caveats, context.",
    "commit": "Should anything of this exchange be kept? Give JSON: action, target_shard_id, content, tags, confidence, reason.",
}


def stage(name: str, shard: Column, query: Column, body: Column) -> Column:
    """A stage's prompt: the shard, what is asked and what there is to go by."""
    return F.concat(F.lit(STAGES[name] + "\n\nSHARD: "), F.coalesce(shard, F.lit("-")), F.lit("\nQUERY: "), query, F.lit("\n\n"), body)
