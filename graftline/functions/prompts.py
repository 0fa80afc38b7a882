"""Prompts, supervision texts and replies of a language-model selector, as column expressions.

``candidates``: array of (parent, child) titles in rank order; ``gold``: array of 1-based places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MAX_CONTEXT_CHARS

EXPLANATION = "### Explanation"
RESPONSE = "### Response"
NONE = "none"
#: Entries that a list in a supervision text names before it says that there are more.
LISTED = 12

INSTRUCTION = (
    "You place a new concept into a hierarchy. Given a mention in its context and numbered candidate edges "
    "(parent -> child), name the numbers of the edges between which the mention belongs, best first, or 'none'."
)


def format_candidates(candidates: Column) -> Column:
    lines = F.transform(candidates, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["parent"], F.lit(" -> "), e["child"]))
    return F.array_join(lines, "\n")


def build_prompt(left: Column, mention: Column, right: Column, candidates: Column, max_chars: int = MAX_CONTEXT_CHARS, explain: bool = True) -> Column:
    empty = lambda c: F.coalesce(c, F.lit(""))
    before = F.right(empty(left), F.lit(max_chars))
    after = F.left(empty(right), F.lit(max_chars))
    ask = f"Give your reasons under '{EXPLANATION}', then the numbers under '{RESPONSE}'." if explain else f"Give the numbers under '{RESPONSE}'."
    return F.concat(F.lit(f"{INSTRUCTION} {ask}\n\nContext: "), before, F.lit(" [Ms] "), empty(mention), F.lit(" [Me] "), after, F.lit("\n\nCandidates:\n"), format_candidates(candidates), F.lit("\n"))


def listing(items: Column, limit: int = LISTED) -> Column:
    """Distinct items in order, joined; beyond the limit a mark; nothing is 'none'."""
    items = F.array_distinct(items)
    joined = F.array_join(F.slice(items, 1, limit), "; ")
    return F.when(F.size(items) == 0, F.lit(NONE)).when(F.size(items) > limit, F.concat(joined, F.lit(", ..."))).otherwise(joined)


def _at(candidates: Column, places: Column, field: str) -> Column:
    return F.transform(places, lambda i: F.element_at(candidates, i.cast("int"))[field])


def plain_target(gold: Column) -> Column:
    answer = F.when(F.size(gold) == 0, F.lit(NONE)).otherwise(F.array_join(F.transform(gold, lambda i: i.cast("string")), ", "))
    return F.concat(F.lit(f"{RESPONSE}\n"), answer)


def explanation_target(mention: Column, candidates: Column, gold: Column) -> Column:
    """Reasons in five steps, then the answer."""
    ups = F.transform(candidates, lambda e: e["parent"])
    downs = F.transform(candidates, lambda e: e["child"])
    right_up, right_down = listing(_at(candidates, gold, "parent")), listing(_at(candidates, gold, "child"))
    found = F.concat(
        F.lit("4. Of these, "), mention, F.lit(" is a kind of: "), right_up, F.lit(".\n5. It lies above: "), right_down, F.lit(".\n"))
    missing = F.lit("4. No parent fits.\n5. No candidate is chosen.\n")
    return F.concat(
        F.lit(f"{EXPLANATION}\n1. The mention is: "), mention, F.lit(".\n2. Possible parents: "), listing(ups), F.lit(".\n3. Possible children: "), listing(downs), F.lit(".\n"),
        F.when(F.size(gold) > 0, found).otherwise(missing), plain_target(gold))


def leaks(prompt: Column, rebuilt: Column) -> Column:
    """True where a prompt isn't what its inputs give, or holds an answer header on a line of its own."""
    header = lambda h: F.rlike(prompt, F.lit(f"(?m)^{h}"))
    return ~prompt.eqNullSafe(rebuilt) | header(EXPLANATION) | header(RESPONSE)


def parse_response(text: Column, n: Column) -> Column:
    """0-based places named after the last answer header, in order, without repeats and strays."""
    tail = F.substring_index(text, RESPONSE, -1)
    trimmed = F.regexp_replace(tail, r"(?U)^\s+|\s+$", "")
    places = F.transform(F.regexp_extract_all(tail, F.lit(r"\d+"), 0), lambda s: s.try_cast("bigint"))
    kept = F.array_distinct(F.filter(places, lambda i: i.isNotNull() & (i >= 1) & (i <= n)))
    return F.when(F.startswith(F.lower(trimmed), F.lit(NONE)), F.array().cast("array<bigint>")).otherwise(F.transform(kept, lambda i: i - 1))


def extract_explanation(text: Column) -> Column:
    at = F.locate(EXPLANATION, text)
    after = F.substring(text, at + len(EXPLANATION), F.length(text))
    body = F.regexp_replace(F.substring_index(after, RESPONSE, 1), r"(?U)^\s+|\s+$", "")
    return F.when(at == 0, F.lit("")).otherwise(body)
