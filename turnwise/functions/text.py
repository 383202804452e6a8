"""Text expressions: tokens, checks and repairs. White space is ASCII white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic characters that generated text should not have. Fixed values.
BANNED = "‘’“”–—… "
#: Signs of several requests in one turn. Fixed values.
MULTI_REQUEST = [r"\band also\b", r"\bas well as\b", r"\bplus\b", r"\bthen\b", r"\band then\b", r"\bafter that\b", r"\bin addition\b", r"\balso\b", r"\bboth\b", r"\bwhile you're at it\b"]
#: Openings that say nothing. Fixed values.
FILLER = r"(?i)^(ok|okay|sure|thanks|great|perfect|well|so|um|uh)\b"
CONNECTOR = r"(?i)\b(and|also|then|plus|that|it|this)\b"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased words without ASCII punctuation at their ends; empty ones dropped."""
    bare = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", ""))
    return F.array_remove(bare, "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets; 0 when either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / (F.size(x) + F.size(y) - both))


def has_banned(text: Column) -> Column:
    return text.rlike(f"[{BANNED}]")


def sanitised(text: Column) -> Column:
    """Typographic quotes, ellipsis and no-break space as ASCII; a dash becomes a comma."""
    t = F.translate(text, "‘’“” ", "''\"\" ")
    return F.regexp_replace(F.replace(t, F.lit("…"), F.lit("...")), r"\s*[–—]\s*", ", ")


def names_leaked(text: Column, names: list[str]) -> Column:
    """The names that occur as whole words, whatever their case."""
    return F.filter(F.array(*[F.when(text.rlike(rf"(?i)\b{n}\b"), n) for n in names]), lambda x: x.isNotNull())


def leak_reason(answer: Column) -> Column:
    """Why a leakage judge's answer rejects: what follows LEAKED:; null where it is CLEAN or anything else."""
    a = F.trim(answer)
    return F.when(F.startswith(a, F.lit("LEAKED:")), F.concat(F.lit("leakage: "), F.trim(F.substr(a, F.lit(8)))))


def json_reply(text: Column) -> Column:
    """A model reply without its code fence."""
    return F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def flow_list(reply: Column) -> Column:
    """Flow names of a JSON reply: a list or a single name under flows, flow or flow_name; lower-cased and trimmed; [] if there is none."""
    body = json_reply(reply)
    many = F.from_json(F.get_json_object(body, "$.flows"), "array<string>")
    one = F.coalesce(F.get_json_object(body, "$.flow"), F.get_json_object(body, "$.flow_name"), F.nullif(F.regexp_extract(body, r"\"flow\w*\"\s*:\s*\"([^\"]+)\"", 1), F.lit("")))
    empty = F.array().cast("array<string>")
    return F.transform(F.coalesce(many, F.when(one.isNotNull(), F.array(one)), empty), lambda x: F.lower(F.trim(x)))


def decomposed(dax: Column, names: dict[str, str]) -> Column:
    """``{03A}`` as ``name(0) + name(3) + name(A)``; ``?x`` for a digit without a name."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    digits = F.split(F.regexp_replace(dax, r"[{}]", ""), "")
    one = lambda x: F.coalesce(F.concat(F.try_element_at(table, x), F.lit("("), x, F.lit(")")), F.concat(F.lit("?"), x))
    return F.array_join(F.transform(F.filter(digits, lambda x: x != ""), one), " + ")
