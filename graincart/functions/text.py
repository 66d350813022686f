"""Text and label functions as native column expressions.

Every function takes columns or column names and treats null as the empty string unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)[\s\x1c-\x1f]+"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _array(values: Column | Sequence[str]) -> Column:
    """An array column, from a column or from Python strings."""
    if isinstance(values, Column):
        return values
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def normalize_whitespace(text: Column | str) -> Column:
    """Runs of any Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), SPACES, " "))


def normalize_text(text: Column | str) -> Column:
    """Lower case; all but ASCII letters, digits and `: / _ -` becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9:/_-]+", " "))


def normalize_label(label: Column | str) -> Column:
    """normalize_text in which `/` and `_` are spaces too; `:` and `-` stay."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(label), F.lit(""))), "[^a-z0-9:-]+", " "))


def tokens(text: Column | str) -> Column:
    """The words of normalize_text in order; an empty array for a text without any."""
    return F.filter(F.split(normalize_text(text), " "), lambda t: t != "")


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def overlap_ratio(terms: Column | Sequence[str], prediction: Column | str) -> Column:
    """Share of the distinct normalized terms all of whose words occur in the prediction; 0.0 without terms."""
    names = F.array_distinct(F.filter(F.transform(F.coalesce(_array(terms), F.array().cast("array<string>")), normalize_label), lambda t: t != ""))
    found = token_set(prediction)

    def hit(term: Column) -> Column:
        words = token_set(term)
        return (F.size(words) > 0) & (F.size(F.array_except(words, found)) == 0)

    return F.when(F.size(names) > 0, F.size(F.filter(names, hit)) / F.size(names)).otherwise(F.lit(0.0))


def exact_match(reference: Column | str, prediction: Column | str) -> Column:
    return (normalize_text(reference) == normalize_text(prediction)).cast("double")


def best_exact_match(references: Column | Sequence[str], prediction: Column | str) -> Column:
    """1.0 if any reference equals the prediction after normalize_text; 0.0 without references."""
    refs = F.coalesce(_array(references), F.array().cast("array<string>"))
    wanted = normalize_text(prediction)
    return F.exists(refs, lambda r: normalize_text(r) == wanted).cast("double")


def contains_any(text: Column | str, phrases: Column | Sequence[str]) -> Column:
    """Whether a phrase is a substring of the text, both normalized; phrases without letters or digits never are."""
    whole = normalize_text(text)
    given = F.coalesce(_array(phrases), F.array().cast("array<string>"))
    return F.exists(F.transform(given, normalize_text), lambda p: (p != "") & F.contains(whole, p))


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(normalize_whitespace(text), " "), lambda w: w != ""))


def section_headers_present(text: Column | str, headers: Column | Sequence[str]) -> Column:
    """The headers that, followed by a colon, occur in the text."""
    whole = normalize_text(text)
    given = F.coalesce(_array(headers), F.array().cast("array<string>"))
    return F.filter(given, lambda h: F.contains(whole, normalize_text(F.concat(h, F.lit(":")))))


def slugify(text: Column | str) -> Column:
    return F.replace(normalize_label(text), F.lit(" "), F.lit("-"))


def normalize_split_name(value: Column | str) -> Column:
    """`val` and `valid` are validation; other names in their label form; null and empty give the empty string."""
    name = normalize_label(value)
    return F.when(name.isin("val", "valid"), F.lit("validation")).otherwise(name)


def canonical_split(value: Column | str) -> Column:
    """The simpler rule of raw downloads: trimmed lower case, `val` and `valid` are validation."""
    name = F.lower(normalize_whitespace(value))
    return F.when(name.isin("val", "valid"), F.lit("validation")).otherwise(name)


def name_key(value: Column | str) -> Column:
    """Source and task names compare trimmed and in lower case."""
    return F.lower(normalize_whitespace(value))


def detect_split_from_path(path: Column | str) -> Column:
    """The first part of a path that is a split name, or null."""
    parts = F.transform(F.split(F.coalesce(_c(path), F.lit("")), "/"), normalize_split_name)
    return F.get(F.filter(parts, lambda p: p.isin("train", "validation", "test", "dev")), F.lit(0))


def parse_plant_label(label: Column | str) -> Column:
    """struct(crop, disease): parts before and after the first `___`, else the first `__`; else only a disease."""
    text = F.coalesce(_c(label), F.lit(""))

    def part(value: Column) -> Column:
        return normalize_whitespace(F.translate(value, "_", " "))

    def cut(mark: str) -> Column:
        at = F.instr(text, mark)
        return F.struct(
            part(F.substring(text, F.lit(1), at - 1)).alias("crop"),
            part(F.substring(text, at + len(mark), F.length(text))).alias("disease"),
        )

    return (
        F.when(F.instr(text, "___") > 0, cut("___"))
        .when(F.instr(text, "__") > 0, cut("__"))
        .otherwise(F.struct(F.lit(None).cast("string").alias("crop"), part(text).alias("disease")))
    )


def parse_pest_label(label: Column | str) -> Column:
    """`_` and `-` are spaces; the case stays."""
    return normalize_whitespace(F.translate(_c(label), "_-", "  "))


#: The five section names of a structured answer.
SECTIONS = ("Diagnosis", "Evidence", "Uncertainty", "Management", "Follow-up")
#: The texts that fill the sections which a record doesn't state.
EVIDENCE_LINE = "Visual evidence should be checked against crop-specific symptom patterns."
NO_STEPS_LINE = "No management steps provided."
FOLLOW_UP_LINE = "Request clearer close-up images and field context if confidence is limited."
UNCERTAINTY_LINE = "State uncertainty when evidence is incomplete."


def structured_answer(diagnosis: Column, steps: Column, uncertainty: Column) -> Column:
    """Five lines `Section: text`; the steps joined with `; `, blank ones left out."""
    kept = F.filter(F.transform(F.coalesce(steps, F.array().cast("array<string>")), normalize_edges), lambda s: s != "")
    management = F.when(F.size(kept) > 0, F.array_join(kept, "; ")).otherwise(F.lit(NO_STEPS_LINE))
    texts = (diagnosis, F.lit(EVIDENCE_LINE), uncertainty, management, F.lit(FOLLOW_UP_LINE))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), text) for name, text in zip(SECTIONS, texts)])


def normalize_edges(text: Column | str) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


#: The question that stands in where a record has none, by task type; "" for any other.
DEFAULT_QUESTIONS = {
    "classification": "Identify the crop issue or pest in this agricultural image.",
    "symptom_explanation": "Explain the visible symptoms in this agricultural image.",
    "clarify_or_respond": "Decide whether to clarify first or respond directly, then act accordingly.",
    "": "Answer the agricultural question using only the evidence available in the image.",
}
#: Fixed value: the system turn of every normalised record.
SYSTEM_PROMPT = "You are an agricultural vision-language assistant focused on ground-level RGB crop disease, pest, symptom, and consultation tasks."


def user_question(task_type: Column | str, question: Column | str) -> Column:
    """The question with white space collapsed, or the default of the task type."""
    result = F.when(F.coalesce(_c(question), F.lit("")) != "", normalize_whitespace(question))
    for task, text in DEFAULT_QUESTIONS.items():
        if task:
            result = result.when(_c(task_type) == task, F.lit(text))
    return result.otherwise(F.lit(DEFAULT_QUESTIONS[""]))


def normalize_decision(value: Column | str) -> Column:
    """respond, clarify, or the text itself, stripped of white space and angle brackets; null if nothing is left.

    `respond` is looked for first, and `ask` also counts inside longer words.
    """
    text = F.regexp_replace(F.lower(normalize_edges(value)), "^[<>]+|[<>]+$", "")
    return (
        F.when(text == "", F.lit(None).cast("string"))
        .when(F.contains(text, F.lit("respond")), F.lit("respond"))
        .when(F.contains(text, F.lit("clarify")) | F.contains(text, F.lit("more info")) | F.contains(text, F.lit("ask")), F.lit("clarify"))
        .otherwise(text)
    )


#: Phrases that make an answer a request for more detail (a raw question mark does too).
CLARIFY_MARKERS = ("please upload", "can you share", "need a clearer image", "before i can answer", "what crop")


def infer_decision(prediction: Column | str) -> Column:
    """clarify if the answer has a question mark or a marker phrase, else respond."""
    text = F.coalesce(_c(prediction), F.lit(""))
    return F.when(F.contains(text, F.lit("?")) | contains_any(text, CLARIFY_MARKERS), F.lit("clarify")).otherwise(F.lit("respond"))
